import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from talusgrid.llm import lattice, queries

PATH = queries.vocabulary("piece_bpe_32k.model")
TEXTS = [None, "", " \n", "The cat AND the cat", "the dog", "ÀÉ naïve 猫", "x" * 60 + " thing", "ation ations", "The cat AND the cat"]
TEXTS += [f"the thing number {k} tionly shtion" for k in range(30)]


def probability(vocab, logp, word):
    """Sum over all segmentations, by recursion on the rest of the word."""

    @lru_cache(None)
    def rest(i):
        if i == len(word):
            return 1.0
        return sum(
            math.exp(logp[vocab.ids[word[i:j]]]) * rest(j) for j in range(i + 1, len(word) + 1) if word[i:j] in vocab.ids
        )

    return rest(0)


def test_forward_sums_over_all_segmentations():
    vocab = lattice.pieces(PATH)
    rng = np.random.default_rng(1)
    logp = np.log(rng.dirichlet(np.ones(len(vocab) + 1)))
    for word in (b" thing", " naïve".encode(), b" a", " 猫".encode(), b" antidisestablish"):
        chars = np.frombuffer(word, dtype=np.uint8).reshape(1, -1).astype(np.uint64)
        got = lattice.forward(lattice.arcs(vocab, chars), len(word), 1, logp)[-1][0]
        want = math.log(probability(vocab, logp, word))
        assert got == pytest.approx(want, rel=1e-9)
        assert lattice.long_word(vocab, word, logp) == pytest.approx(want, rel=1e-9)
        uses = lattice.expected(vocab, chars, logp, np.array([2.0]))
        assert uses == pytest.approx(lattice.long_word(vocab, word, logp, 2.0))
        # each byte lies in one piece of each segmentation
        sizes = np.array([len(p) for p in vocab.ids])
        assert (uses * sizes).sum() == pytest.approx(2 * len(word))


def test_scores(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, word string")
    rows = sorted(lattice.score_documents(df.repartition(3), PATH, chunk_bytes=200).collect())
    assert len(rows) == len(TEXTS)
    held = [zlib.crc32(str(k).encode()) % 10 == 0 for k in range(len(TEXTS))]
    tokens = [[*(t or "").encode().lower().split(), None] for t in TEXTS]
    c = Counter(w for h, ws in zip(held, tokens, strict=True) if not h for w in ws)
    n = sum(c.values())
    for r, h, ws in zip(rows, held, tokens, strict=True):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert rows[3].score == rows[8].score


def test_no_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.n_known for r in lattice.score_documents(df, PATH).collect()] == [3, 3]
    assert lattice.score_documents(df.limit(0), PATH).count() == 0


def segmentations(vocab, word):
    if not word:
        yield ()
    for j in range(1, len(word) + 1):
        if word[:j] in vocab.ids:
            for rest in segmentations(vocab, word[j:]):
                yield (vocab.ids[word[:j]], *rest)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_scores_of_whole_texts_by_listing_all_segmentations(spark, rounds):
    """Scores, prior and rounds against a version that lists every segmentation of every word."""
    texts = [f"{a} {b}\t{c}" for a in ("the", "thing", "Of") for b in ("cats", "in", "não") for c in ("station", "x")] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    vocab = lattice.pieces(PATH)
    ways = {w: list(segmentations(vocab, b" " + w)) for t in texts for w in (t or "").encode().lower().split()}
    held = [zlib.crc32(str(k).encode()) % 10 == 0 for k in range(len(texts))]
    assert any(held)
    taught = Counter(w for h, t in zip(held, texts, strict=True) if not h for w in (t or "").encode().lower().split())
    p = np.exp(vocab.logp)
    for _ in range(rounds):
        total = np.exp(vocab.logp) * lattice.PRIOR * len(p)
        total[-1] += held.count(False)
        for w, n in taught.items():
            shares = np.array([np.prod(p[list(s)]) for s in ways[w]])
            for s, share in zip(ways[w], shares / shares.sum(), strict=True):
                for piece in s:
                    total[piece] += n * share
        p = total / total.sum()
    got = {r.doc_id: r.score for r in lattice.score_documents(df, PATH, rounds=rounds, chunk_bytes=60).collect()}
    for k, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        want = math.log10(p[-1]) + sum(math.log10(sum(np.prod(p[list(s)]) for s in ways[w])) for w in words)
        assert got[k] == pytest.approx(want, rel=1e-9)


def test_the_vocabularys_scores_say_which_pieces_are_likely():
    vocab = lattice.pieces(PATH)
    likely = [vocab.logp[vocab.ids[x]] for x in (b" t", b" the", b" station")]
    assert likely == sorted(likely, reverse=True)
    assert np.exp(vocab.logp).sum() == pytest.approx(1)


def test_one_very_long_word(spark):
    df = spark.createDataFrame([(1, "station" * 3000), (2, "station")], "doc_id long, text string")
    rows = {r.doc_id: r for r in lattice.score_documents(df, PATH).collect()}
    assert rows[1].n_tokens == 2 and -math.inf < rows[1].score < rows[2].score < 0
