"""Measures and verdicts against a brute-force version."""

import re
from collections import Counter

from talusgrid.llm import quality

TEXTS = [
    None,
    "",
    " \t\n",
    "a b",
    "one two three",
    "the cat sat on the mat and the cat sat on the mat again",
    "# $ % <b> & | *\n# $ % <b> & | *\n\n \nlast",
    "\n".join(["same line here"] * 30),
    "die Katze und der Hund " * 40,
    " ".join(f"word{i} the" for i in range(60)),
    "x" * 30_000,
    " ".join(f"w{i % 977}" for i in range(20_000)),
]


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.sub(r"[\x20\x09-\x0D]+", "", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 3)}
    n, chars = len(words), sum(map(len, words))
    symbols = sum(c in quality.SYMBOLS for c in text)
    dup = len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(covered) > 50 * n
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    kept = not failed and 2 <= chars / n <= 15 and symbols / n <= 0.2 and stop / n >= 0.005 and dup / len(lines) <= 0.5
    return n, chars, symbols, dup, len(covered), failed, kept


def frame(spark, texts):
    rows = [(k, t, "mine") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, q_kept string")


def test_measures_match_brute_force(spark):
    got = quality.apply_rules(frame(spark, TEXTS))
    columns = [f"q_{c}" for c in quality.COUNTS] + ["q_base_failed", "q_kept"]
    found = {r.doc_id: tuple(r[c] for c in columns) for r in got.collect()}
    assert found == {k: brute(t) for k, t in enumerate(TEXTS)}


def test_kept_rows_keep_their_columns_and_repeats(spark):
    df = frame(spark, TEXTS)
    kept = quality.keep_good(df.unionByName(df))
    assert kept.columns == df.columns
    want = sorted(2 * [k for k, t in enumerate(TEXTS) if brute(t)[-1]])
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert want


def test_empty_table(spark):
    df = frame(spark, TEXTS).limit(0)
    assert quality.apply_rules(df).count() == 0
    assert quality.keep_good(df).columns == df.columns
