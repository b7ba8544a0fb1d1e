import hashlib
import re

import pytest
from pyspark.sql import functions as F

from talusgrid.llm import fim, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """n, form, prefix, middle and output, with all units in a list."""
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [
    None,
    "",
    " ",
    " \n\t ",
    "one",
    "a b  c\n\nd ",
    "  lead and trail  \t",
    "smile \U0001f600 über  nbsp em á <P",
    "holds <M> marker",
    "ends with <",
    "<S <P <M> <",
    "x" * 50_000,
    " " * 50_000,
    "word " * 30_000,
    "\x00nul \x1f unit \x0b\x0c\r\n",
]


def test_units_against_a_list(spark):
    rows = [(k, TEXTS[k % len(TEXTS)], "extra") for k in range(300)] + [(None, "null id here", "x"), (5, "same id", "x"), (5, "same id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim_text string").repartition(4)
    out = fim.transform(docs.withColumn("keep", F.lit(1)))
    assert out.columns == ["doc_id", "text", "keep", "fim_n", "fim_form", "fim_start", "fim_stop", "fim_text"]
    found = out.withColumn("back", fim.restore(F.col("fim_text"), F.col("fim_form"))).collect()
    assert len(found) == len(rows)
    forms = set()
    for r in found:
        middle = None if r.fim_start is None else r.fim_stop - r.fim_start
        assert (r.fim_n, r.fim_form, r.fim_start, middle, r.fim_text) == brute(r.doc_id, r.text), r.doc_id
        assert r.back == (r.text or "")
        forms.add(r.fim_form)
    assert forms == {"plain", "psm", "spm"}


def test_passes_hold_no_list():
    import tracemalloc

    text = "ab " * 400_000
    fim.count_units(UNIT, "warm up")
    tracemalloc.start()
    n = fim.count_units(UNIT, text)
    spans = fim.ends_at(UNIT, text, n // 3, n // 2)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()
    units = UNIT.findall(text)
    assert spans == (len("".join(units[: n // 3])), len("".join(units[: n // 2])))


def test_other_rates_and_markers(spark):
    docs = spark.createDataFrame([(k, f"w{k} <P> and more") for k in range(40)], "doc_id long, text string")
    marks = ("{{pre}}", "{{suf}}", "{{mid}}")
    out = fim.transform(docs, cut_per_cent=100, spm_per_cent=0, markers=marks)
    rows = out.withColumn("back", fim.restore(F.col("fim_text"), F.col("fim_form"), marks)).collect()
    assert {r.fim_form for r in rows} == {"psm"} and all(r.back == r.text for r in rows)
    for bad in (("<a>", "<a>", "<b>"), ("", "x", "y"), ("ab", "bc", "zz"), ("abc", "b", "z")):
        with pytest.raises(ValueError):
            fim.transform(docs, markers=bad)


def test_empty_table_and_query(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transform(none).collect() == []
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in queries.op11_fill_in_middle(spark, sf).collect():
        n, form, start, middle, out = brute(r.doc_id, texts[r.doc_id])
        assert tuple(r)[1:] == (n, form, start, middle, sha(out), sha(texts[r.doc_id] or ""))
