"""The pipeline's stages one by one against brute-force versions, and ``run`` against them all."""

import random

import pytest
from test_mixing import brute as mixed
from test_near import brute as classes
from test_packing import check
from test_quality import brute as measures
from test_substrings import brute as without_repeats

import corpus_pipeline
from talusgrid.llm import common, mixing, queries

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def made_documents():
    rng = random.Random(11)
    words = [*["the", "and", "of"] * 10, *(f"word{k}" for k in range(400))]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " \n\t", "too short", "x" * 9000, "# % & " * 60, "the same words again " * 40]
    passage = some(60)
    for k in range(40):
        texts.append(some(rng.randint(60, 160)))
        if k % 4 == 0:
            near = texts[-1].split()
            near[rng.randrange(len(near))] = "changed"
            texts += [" ".join(near), texts[-1]]
        if k % 5 == 0:
            texts.append(f"{some(30)} {passage}\n{some(40)}")
    texts += [f"{passage} {passage}", some(5000)]
    sources = ["web", "web", "web", "books", "code", None, ""]
    rows = [(k, t, [None, "en", "de"][k % 3], sources[k % 7], None if t is None else len(t)) for k, t in enumerate(texts)]
    # a null id, a text with two ids, and a row that is there twice
    return [*rows, (None, some(90), "en", "web", 1), (9000, texts[8], None, "late", -1), rows[10], rows[10]]


def kept_of(rows, stage):
    """What each of the first three stages keeps, as (id, text)."""
    if stage == 0:
        return [r for r in rows if measures(r[1])[-1]]
    order = lambda r: (r[0] is not None, r[0] or 0)
    if stage == 1:
        rows = sorted(rows, key=order)
        return [r for k, (r, (root, _)) in enumerate(zip(rows, classes([r[1] for r in rows]), strict=True)) if root == k]
    out = []
    for r, (words, n, gone) in zip(rows, without_repeats([r[1] for r in rows], 35), strict=True):
        if n > gone:
            out.append((r[0], b" ".join(words).decode(), *r[2:]))
    return out


def plain(rows):
    return sorted(((r[0], " ".join((r[1] or "").split()), r[2], r[3]) for r in rows), key=repr)


def test_stages_and_the_whole(spark, tmp_path):
    rows = made_documents()
    docs = spark.createDataFrame(rows, KINDS).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        got = common.table(stage(spark, docs, str(tmp_path)), f"stage{k}")
        assert got.columns == docs.columns
        want = kept_of(rows, k)
        assert plain(got.collect()) == plain(want), name
        assert 0 < len(want) and sum(len(r[1]) for r in want) < sum(len(r[1] or "") for r in rows)
        docs, rows = got, [tuple(r) for r in got.collect()]
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    got = common.table(corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)), "stage3")
    dealt, _ = mixed([(r[0], r[1], r[3]) for r in rows], repetition=mixing.REPETITION_LIMIT, block_tokens=mixing.BLOCK_TOKENS)
    texts = {r[0]: r[1] for r in rows}
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((i, texts[i]) for i, *_ in dealt), key=repr)
    assert {r[0] for r in rows} == {i for i, *_ in dealt}

    def pieces(out):
        return sorted(((r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens) for r in out.collect()), key=repr)

    # each row of the mixture is packed whole: as many rows of an id as there are first pieces of it
    numbered = common.table(got.orderBy("doc_id", "text"), "numbered").collect()
    packed = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(numbered)], KINDS), str(tmp_path))
    check(packed.collect(), [r.text for r in numbered], 2048)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    firsts = sorted((r.doc_id for r in whole if r.start == 0), key=repr)
    assert firsts == sorted((r.doc_id for r in numbered), key=repr)
    assert sum(r.length for r in whole) == sum(r.doc_tokens for r in whole if r.start == 0)
    assert max(r.offset + r.length for r in whole) <= 2048


@pytest.mark.parametrize("kind", ["no rows", "all rejected"])
def test_nothing_left(spark, tmp_path, kind):
    rows = [] if kind == "no rows" else [(1, None, None, None, None), (2, "short", "en", "web", 5)]
    spark.createDataFrame(rows, KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_columns_play_no_part(spark):
    rows = [r for r in made_documents() if r[0] is not None][:40]
    docs = spark.createDataFrame(rows, KINDS).withColumns({"digest": common.F.lit("x"), "_id": common.F.lit(1), "rs_text": common.F.lit("y"), "root": common.F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, "").columns == list(corpus_pipeline.COLUMNS)
    assert queries.QUERIES
