import zlib

import numpy as np
import pytest

from talusgrid.llm import packing, queries

PATH = queries.vocabulary(queries.WORD_VOCABULARY)


def reference_ids(texts, path=PATH):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [
        np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for t in texts
    ]


def check(rows, texts, length, path=PATH):
    want = dict(enumerate(reference_ids(texts, path)))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == want[doc]
        at = 0
        for r in pieces:
            assert r.start == at and len(r.ids) == 4 * r.length and r.doc_tokens * 4 == len(want[doc])
            at += r.length
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    return len(by_seq)


TEXTS = [
    None,
    "",
    "Plain words, it's 3 of them!",
    "<|endoftext|> special <|startoftext|>",
    "É́té ΣΑΣ İstanbul     naïve\u0000x ÀB'S d'accord 12³",
    "same text",
    "same text",
    " ".join(f"word{i} tionly" for i in range(700)),
    " ".join(f"Thing{i}!!" for i in range(9000)),
] + [" ".join(["lorem", "ipsum"] * (k % 37)) for k in range(200)]


def test_every_id_lies_in_one_piece(spark):
    df = spark.createDataFrame(
        [(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, sequence_id string"
    ).repartition(3)
    rows = packing.pack(df, PATH, length=256, open_windows=4).collect()
    n = check(rows, TEXTS, 256)
    used = sum(r.length for r in rows)
    assert n * 256 < 1.05 * used


def test_merging_spans_groups(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(6)
    rows = packing.pack(df, PATH, length=2048, group=2).collect()
    check(rows, TEXTS, 2048)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, PATH).count() == 0


def test_null_id_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string")
    rows = packing.pack(df, PATH).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["7", "7", "None"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_packing(spark, sf).collect()
    assert len({r.doc_id for r in rows}) == len(docs)
    want = dict(zip(docs, reference_ids(docs.values()), strict=True))
    for r in rows:
        part = want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens * 4 == len(want[r.doc_id])
    used = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) * 2048 < 1.02 * used + 2048


def test_a_vocabulary_with_other_rules(spark):
    path = queries.vocabulary("byte_bpe_50k.json")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS[:30])], "doc_id long, text string").repartition(2)
    check(packing.pack(df, path, length=256).collect(), TEXTS[:30], 256, path)
    assert packing.word_ids(PATH).by_word and not packing.word_ids(path).by_word
