import random
from collections import Counter

import pytest

from talusgrid.llm import substrings


def brute(texts, width):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append(([x for k, x in enumerate(w) if k not in gone], len(w), len(gone)))
    return out


def made_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 60))] for _ in range(6)]
    texts = [None, "", "  \n ", "one", "a a a a a a a a a a a a a a a a a a a a a a a a", "x" * 500 + " " + "é" * 40]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randint(1, 40))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts) + rng.choice(["", "\n"]))
    return texts + texts[10:20]


@pytest.mark.parametrize("hot", [2, 5, 10_000])
def test_equals_brute_force(spark, hot):
    texts = made_texts()
    df = spark.createDataFrame(
        [(k, t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, start long, key string"
    ).repartition(5)
    rows = {r.doc_id: r for r in substrings.remove_repeats(df, width=12, m=3, hot=hot).collect()}
    want = brute(texts, 12)
    assert len(rows) == len(texts)
    assert any(w[2] for w in want) and any(not w[2] for w in want)
    for k, (kept, n, gone) in enumerate(want):
        assert (rows[k].rs_words, rows[k].rs_removed) == (n, gone), k
        assert (rows[k].rs_text or "").encode().split() == kept
        assert rows[k].start == k and rows[k].text == texts[k]
        if not gone:
            assert rows[k].rs_text == texts[k]


def test_ids_null_or_repeated(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "short")], "doc_id long, text string")
    rows = substrings.remove_repeats(df, width=10, m=2).collect()
    assert sorted(r.rs_removed for r in rows) == [0, 40, 40, 40]


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(df).count() == 0
