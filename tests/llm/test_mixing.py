import hashlib
import math
from collections import defaultdict

import pytest

from talusgrid.llm import mixing


def brute(rows, repetition=None, entropy=None, budget=None, block_tokens=40, seed=7):
    """rows: (id, text, source); gives (id, pass, block, rank) of what is taken."""
    n = [len((t or "").encode().split()) for _, t, _ in rows]
    tokens = defaultdict(int)
    for (_, _, s), k in zip(rows, n, strict=True):
        tokens[s] += k
    tokens = {s: t for s, t in tokens.items() if t}
    total = sum(tokens.values())
    p = {s: t / total for s, t in tokens.items()}
    a = 1.0
    if len(p) > 1 and max(p.values()) > min(p.values()):

        def fits(a):
            if repetition is not None and (max(p.values()) / min(p.values())) ** (1 - a) > repetition:
                return False
            w = [x**a for x in p.values()]
            h = -sum(x / sum(w) * math.log(x / sum(w)) for x in w) / math.log(len(p))
            return entropy is None or h <= entropy

        low, a = 0.0, 1.0
        if fits(0.0):
            a = 0.0
        else:
            for _ in range(40):
                middle = (low + a) / 2
                low, a = (low, middle) if fits(middle) else (middle, a)
    raw = {s: x**a for s, x in p.items()}
    z = sum(raw.values())
    spend = budget if budget is not None else total * z * max(p[s] / raw[s] for s in p)
    times = {s: spend * raw[s] / z / tokens[s] for s in p}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    blocks = defaultdict(list)
    for (doc, t, s), k in zip(rows, n, strict=True):
        key = ":".join([*([str(doc)] if doc is not None else []), hashlib.md5((t or "").encode()).hexdigest()])
        count = math.ceil(tokens[s] / block_tokens) if s in tokens else 1
        block = int(md5(f"{seed}:{key}")[:12], 16) % count
        for e in range(max(1, math.ceil(times.get(s, 1.0))) if k else 1):
            blocks[s, block, e].append((md5(f"{seed}:{e}:{key}"), key, doc, k))
    out = []
    for (s, block, e), members in blocks.items():
        share = min(times.get(s, 1.0) - e, 1.0)
        upto, whole = 0, sum(m[3] for m in members)
        for rank, (_, _, doc, k) in enumerate(sorted(members), 1):
            upto += k
            if share >= 1 or k == 0 or upto - k / 2 <= share * whole:
                out.append((doc, e, block, rank))
    return sorted(out, key=repr), a


def made_rows():
    rows = [(0, None, "a"), (1, "", "a"), (2, " ", "none"), (3, "x y", None), (4, "x y z", None)]
    for k in range(5, 205):
        rows.append((k, " ".join(["w"] * (1 + k * 7 % 23)), "big" if k % 3 else f"s{k % 4}"))
    return rows


@pytest.mark.parametrize(
    "options",
    [
        {"repetition": 2.0},
        {"repetition": None, "entropy": 0.9},
        {"repetition": 3.0, "entropy": 0.8},
        {"repetition": 4.0, "budget": 900},
    ],
)
def test_equals_brute_force(spark, options):
    rows = made_rows()
    df = spark.createDataFrame([(*r, 1, r[0]) for r in rows], "doc_id long, text string, source string, _n int, p long")
    got = mixing.mix(df, block_tokens=40, **options)
    assert got.columns[:5] == df.columns
    got = got.collect()
    want, _ = brute(rows, **options)
    assert sorted(((r.doc_id, r.mix_pass, r.mix_block, r.mix_rank) for r in got), key=repr) == want
    assert all(r.p == r.doc_id for r in got)


def test_limits_hold(spark):
    rows = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r._source: r for r in mixing.weights(df, repetition=1.5).collect()}
    assert min(r._times for r in plan.values()) == pytest.approx(1.0)
    assert max(r._times for r in plan.values()) == pytest.approx(1.5, abs=1e-6)
    w = [r._weight for r in mixing.weights(df, repetition=None, entropy=0.7).collect()]
    assert sum(w) == pytest.approx(1.0)
    assert -sum(x * math.log(x) for x in w) / math.log(len(w)) == pytest.approx(0.7, abs=1e-6) or sum(w) == 1


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "a", "s")], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 3
    assert mixing.mix(df.limit(0)).count() == 0


def test_rows_without_words_and_repeated_rows_are_split(spark):
    """A source of nothing but empty texts, and one of one row many times: no block has them all."""
    from collections import Counter

    rows = [(k, "", "empty") for k in range(5000)] + [(None, "same words", "one")] * 5000 + [(k, "a b c", "rest") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mixing.mix(df, block_rows=500).collect()
    blocks, passes = Counter(), Counter()
    for r in out:
        blocks[r.source, r.mix_pass, r.mix_block] += 1
        passes[r.source, r.mix_pass] += 1
    assert passes["empty", 0] == 5000 and passes["one", 0] == 5000 and passes["rest", 0] == 300
    assert max(n for (s, p, _), n in blocks.items() if s == "empty") < 800
    assert max(n for (s, p, _), n in blocks.items() if s == "one" and p == 0) < 800
    assert len({(r.source, r.mix_pass, r.mix_block, r.mix_rank) for r in out}) == len(out)
