import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from talusgrid.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        convs[c].append(((turn is not None, turn or 0), role, key, text))
    return {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in convs.items()}


def brute(convs):
    """All nodes with sums over subtrees by walking every path."""
    order = lambda c: (c is None, c or 0)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, who in members.items():
        cost = (len(who) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += cost
            leaves[path[:d]] += path not in children
    out = []
    for path, who in members.items():
        said = ",".join("" if c is None else str(c) for c in sorted(ends.get(path, []), key=order))
        parent = min(members[path[:-1]], key=order) if path else None
        out.append(
            (
                min(who, key=order),
                len(path),
                parent,
                len(who),
                children[path] if path in children else 0,
                leaves[path],
                saved[path],
                hashlib.sha256(said.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted(map(tuple, df.collect()), key=repr)


def made(n, seed, deepest=7):
    draw = random.Random(seed)
    said = [("user", "hi"), ("assistant", "yes"), ("user", "é\U0001f600"), (None, None), ("system", "")]
    return [
        (c, t if t else None, *said[draw.randrange(1 + min(t, 4))]) for c in range(-n // 2, n // 2) for t in range(draw.randrange(deepest) + 1)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed):
    rows = made(120, seed) + [(None, 0, "user", "hi"), (None, 1, "user", "only here")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(trie.prefix_trie(df)) == brute(in_order(rows))


def test_collisions_are_split(spark):
    """With moduli of 2 and 3 nearly all groups collide; results stay the same."""
    rows = made(60, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    turns = trie.in_order(trie.turn_keys(df)).selectExpr("_c", "_at + 1 AS depth", "_key", "_bytes").cache()
    got = trie.build(turns, turns.select("_c").distinct(), primes=(2, 3), bases=(1, 1))
    assert found(got) == brute(in_order(rows))


def test_one_conversation_in_many_tasks(spark, monkeypatch):
    """A conversation with nearly all rows is spread by range; ids and chains go in several pieces."""
    monkeypatch.setattr(trie, "IDS", 7)
    monkeypatch.setattr(trie, "RUN", 16)
    rows = [(0, t, "user", str(t % 3)) for t in range(900)] + [(1, t, "user", str(t % 3)) for t in range(400)]
    rows += [(c, 0, "user", "0") for c in range(2, 60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(trie.prefix_trie(df)) == brute(in_order(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ties_repeats_and_nothing(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "user", "a"), (2, 0, None, "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", _c int")
    assert found(trie.prefix_trie(df)) == brute(in_order(rows))
    assert found(trie.prefix_trie(df.where("false"))) == []


def rebuilt(rows):
    convs = in_order(rows)
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9 if c is not None else 0
        base = convs.get(int(c / 5) * 5, []) if c is not None else []
        out[c] = base[:h] + turns[h:]
    return out


def test_query(spark, tmp_path):
    rows = made(150, 5, 12) + [(1003, 0, "user", "its base is not there"), (None, 3, "user", "hi")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(queries.op12_prefix_trie(spark, str(tmp_path))) == brute(rebuilt(rows))
    sf = "/root/testdata/sf0.001"
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert found(queries.op12_prefix_trie(spark, sf)) == brute(rebuilt(real))
