"""Marginal document probability under a unigram model of subword pieces.

The pieces and their scores are those of an existing vocabulary file, which is
never changed. Scores that are log probabilities weight the segmentations as
they are; merge ranks, which a file for pair encoding has, by Zipf's law. So
weighted, they are where expectation maximisation over all segmentations of the
training documents begins, and the prior of every round. A document's probability sums over every way to cut it into
pieces: no piece spans white space, so the forward recursion, in log space,
runs once for each distinct word, and a document adds up its words' results.

Texts are coded once, chunk by chunk, against a chunk's own word list. Words
meet the corpus counts and the model in joins, and each chunk gets back only
the values of its own words: neither the vocabulary of the corpus nor its
counts are ever broadcast or sent to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: Bytes of text that share a word list.
CHUNK = 24_000_000
ROUNDS = 3
#: Counts that the vocabulary's own probabilities add to a round's, for each piece.
PRIOR = 0.1
#: Words of more bytes are handled one by one.
LONG = 48
MARK = "▁".encode()

_HASH = np.uint64(0x100000001B3)
_START = np.uint64(0xCBF29CE484222325)
#: Slots of a piece table, and a multiplier for each table that may be needed.
_SLOT_BITS = 20
_SLOTS = np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
#: Probabilities are stretched by this for each byte, so that words don't underflow.
_STRETCH = np.log(20.0)


class Pieces:
    """The vocabulary's pieces as byte strings with ids, and their lookup.

    The mark of a word's begin is written as a space, which no word contains.
    Ids below 256 are the single bytes that any text falls back on; the mark's
    own byte is among them. Id ``len(self)`` is the end of a text.
    """

    def __init__(self, path: str, ranked: bool = True):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found, scores = {}, {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i).encode().replace(MARK, b" ")
            scores[piece] = sp.get_score(i)
            if len(piece) > 1 and b" " not in piece[1:]:
                found[piece] = 256 + len(found)
        self.ids = {bytes([b]): b for b in range(256)} | found
        # bytes without a piece of their own, and the end, are as rare as the rarest piece
        rarest = min(scores.values())
        given = np.array([*(scores.get(p, rarest) for p in self.ids), rarest])
        weight = 1 / (1 - given) if ranked else np.exp(given - given.max())
        #: Natural logarithms of the probabilities that the scores tell.
        self.logp = np.log(weight / weight.sum())
        self.longest = max(map(len, self.ids))
        hashes = np.array([self.hash(p) for p in self.ids], dtype=np.uint64)
        assert len(np.unique(hashes)) == len(hashes)
        # a slot holds one id; what shares a slot goes to the next table
        self.hashes, self.tables, rest = hashes, [], np.arange(len(hashes))
        while len(rest):
            table_ = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)
            slots = self._slots(hashes[rest], len(self.tables))
            _, first = np.unique(slots, return_index=True)
            table_[slots[first]] = rest[first]
            self.tables.append(table_)
            rest = np.delete(rest, first)

    @staticmethod
    def _slots(h: np.ndarray, k: int) -> np.ndarray:
        return ((h * _SLOTS[k]) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ids)

    @staticmethod
    def hash(piece: bytes) -> int:
        h = int(_START)
        for b in piece:
            h = ((h ^ b) * int(_HASH)) & 0xFFFFFFFFFFFFFFFF
        return h

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed strings, -1 where there is no such piece."""
        out = np.full(len(h), -1, dtype=np.int32)
        for k, table_ in enumerate(self.tables):
            ids = table_[self._slots(h, k)]
            hit = np.flatnonzero(ids >= 0)
            hit = hit[self.hashes[ids[hit]] == h[hit]]
            out[hit] = ids[hit]
        return out


_LOADED: dict[tuple[str, bool], Pieces] = {}


def pieces(path: str, ranked: bool = True) -> Pieces:
    if (path, ranked) not in _LOADED:
        _LOADED[path, ranked] = Pieces(path, ranked)
    return _LOADED[path, ranked]


def arcs(vocab: Pieces, chars: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """For words of one length: ids of the pieces between each two places."""
    n, size = chars.shape
    found = {}
    for i in range(size):
        h = np.full(n, _START, dtype=np.uint64)
        for j in range(i + 1, min(size, i + vocab.longest) + 1):
            h = (h ^ chars[:, j - 1]) * _HASH
            ids = vocab.lookup(h)
            if ids.max() >= 0:
                found[i, j] = ids
    return found


def forward(lattice: dict, size: int, n: int, logp: np.ndarray) -> np.ndarray:
    """Log sums over all ways to reach each place."""
    alpha = np.full((size + 1, n), -np.inf)
    alpha[0] = 0.0
    with np.errstate(divide="ignore"):
        for (i, j), ids in sorted(lattice.items(), key=lambda x: x[0]):
            at = np.flatnonzero(ids >= 0)
            alpha[j, at] = np.logaddexp(alpha[j, at], alpha[i, at] + logp[ids[at]])
    return alpha


def expected(vocab: Pieces, chars: np.ndarray, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words of one length, with their counts.

    Works on stretched probabilities; words that underflow all the same are
    done again in log space.
    """
    n, size = chars.shape
    lattice = arcs(vocab, chars)
    total = np.zeros(len(vocab))
    # only the words that have a piece on an arc take part in it
    held = []
    for (i, j), ids in sorted(lattice.items(), key=lambda x: x[0]):
        at = np.flatnonzero(ids >= 0)
        got = ids[at]
        held.append((i, j, at, got, np.exp(logp[got] + _STRETCH * (j - i))))
    alpha, beta = np.zeros((size + 1, n)), np.zeros((size + 1, n))
    alpha[0] = beta[size] = 1.0
    for i, j, at, _, p in held:
        alpha[j, at] += alpha[i, at] * p
    for i, j, at, _, p in reversed(held):
        beta[i, at] += p * beta[j, at]
    low = alpha[size] < 1e-250
    share = np.where(low, 0.0, counts / np.where(low, 1.0, alpha[size]))
    uses = [alpha[i, at] * p * beta[j, at] * share[at] for i, j, at, _, p in held]
    which = np.concatenate([got for _, _, _, got, _ in held])
    total += np.bincount(which, weights=np.concatenate(uses), minlength=len(vocab))
    for k in np.flatnonzero(low):
        total += long_word(vocab, chars[k].astype(np.uint8).tobytes(), logp, counts[k])
    return total


def long_word(vocab: Pieces, word: bytes, logp: np.ndarray, count: float | None = None):
    """The same for one long word: its log probability, or expected uses."""
    size = len(word)
    alpha = np.full(size + 1, -np.inf)
    alpha[0] = 0.0
    into: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    for i in range(size):
        for j in range(i + 1, min(size, i + vocab.longest) + 1):
            piece = vocab.ids.get(word[i:j])
            if piece is not None:
                into[j].append((i, piece))
        alpha[i + 1] = np.logaddexp.reduce([alpha[a] + logp[p] for a, p in into[i + 1]])
    if count is None:
        return alpha[size]
    total = np.zeros(len(vocab))
    beta = np.full(size + 1, -np.inf)
    beta[size] = 0.0
    for j in range(size, 0, -1):
        for i, p in into[j]:
            total[p] += count * np.exp(alpha[i] + logp[p] + beta[j] - alpha[size])
            beta[i] = np.logaddexp(beta[i], logp[p] + beta[j])
    return total


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes) of the words of each length, marked, in bounded groups."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for size in np.unique(sizes):
        if size + 1 > LONG:
            continue
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), 20_000):
            part = at[k : k + 20_000]
            block = np.frombuffer(b"".join([b" " + words[i] for i in part]), dtype=np.uint8)
            yield part, block.reshape(len(part), size + 1).astype(np.uint64)


class Codes(dict):
    """Numbers for words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


_CODED = "chunk long, doc_id long, held_out boolean, codes array<int>, word binary, code int, n long"


def _code(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        chunk, size, codes, docs, counts = 0, 0, Codes(), [], np.zeros(0, dtype=np.int64)

        def rows(n, doc=None, held=None, coded=None, word=None, code=None, count=None):
            null = lambda t: pa.nulls(n, t)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, first + chunk)),
                    doc if doc is not None else null(pa.int64()),
                    held if held is not None else null(pa.bool_()),
                    coded if coded is not None else null(pa.list_(pa.int32())),
                    word if word is not None else null(pa.binary()),
                    code if code is not None else null(pa.int32()),
                    count if count is not None else null(pa.int64()),
                ],
                names=["chunk", "doc_id", "held_out", "codes", "word", "code", "n"],
            )

        def close():
            words = list(codes)
            full = np.zeros(len(words), dtype=np.int64)
            full[: len(counts)] = counts
            for k in range(0, len(words), 50_000):
                part = words[k : k + 50_000]
                yield rows(
                    len(part),
                    word=pa.array(part, pa.binary()),
                    code=pa.array(np.arange(k, k + len(part), dtype=np.int32)),
                    count=pa.array(full[k : k + len(part)]),
                )

        for batch in batches:
            ids, held, texts = (batch.column(k).to_pylist() for k in range(3))
            coded = []
            for h, text in zip(held, texts, strict=True):
                text = (text or b"").lower()
                got = np.fromiter(map(codes.__getitem__, text.split()), dtype=np.int32)
                coded.append(got)
                size += len(text)
                if not h and len(got):
                    more = np.bincount(got, minlength=len(counts))
                    more[: len(counts)] += counts
                    counts = more
            yield rows(
                len(ids),
                doc=pa.array(ids, pa.int64()),
                held=pa.array(held, pa.bool_()),
                coded=pa.array(coded, pa.list_(pa.int32())),
            )
            if size > chunk_bytes:
                yield from close()
                chunk, size, codes, counts = chunk + 1, 0, Codes(), np.zeros(0, dtype=np.int64)
        yield from close()

    return run


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches joined to ``rows`` rows or more: words are handled length by length."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _expect(path: str, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(path)
        total = np.zeros(len(vocab))
        for batch in gathered(batches):
            words = batch.column(0).to_pylist()
            counts = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for at, chars in by_length(words):
                total += expected(vocab, chars, logp, counts[at])
            for k, word in enumerate(words):
                if len(word) + 1 > LONG:
                    total += long_word(vocab, b" " + word, logp, counts[k])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    return run


def _score(path: str, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(path)
        for batch in gathered(batches):
            words = batch.column(0).to_pylist()
            out = np.zeros(len(words))
            for at, chars in by_length(words):
                lattice = arcs(vocab, chars)
                out[at] = forward(lattice, chars.shape[1], len(at), logp)[-1]
            for k, word in enumerate(words):
                if len(word) + 1 > LONG:
                    out[k] = long_word(vocab, b" " + word, logp)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out / np.log(10))], names=["word", "n", "lp"]
            )

    return run


def _add_up(train_tokens: int, distinct: int, ends: int, end_lp: float):
    spread = np.log10(train_tokens + 0.1 * (distinct + 1))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        code = words["code"].to_numpy()
        n = np.zeros(len(code), dtype=np.int64)
        lp = np.zeros(len(code))
        n[code], lp[code] = words["n"].to_numpy(), words["lp"].to_numpy()
        base, known = np.log10(n + 0.1) - spread, n > 0
        sizes, knowns, bases, scores = [], [], [], []
        for coded in docs["codes"]:
            at = np.asarray(coded.values)
            sizes.append(len(at) + 1)
            knowns.append(int(known[at].sum()) + (ends > 0))
            bases.append(float(base[at].sum() + np.log10(ends + 0.1) - spread))
            scores.append(float(lp[at].sum() + end_lp))
        return pa.table(
            [
                docs["doc_id"],
                docs["held_out"],
                pa.array(sizes, pa.int64()),
                pa.array(knowns, pa.int64()),
                pa.array([train_tokens] * len(sizes), pa.int64()),
                pa.array(bases, pa.float64()),
                pa.array(scores, pa.float64()),
            ],
            names=names,
        )

    return run


def score_documents(
    df: DataFrame,
    vocabulary_path: str,
    held_out=None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    prior: float = PRIOR,
    chunk_bytes: int = CHUNK,
    ranked: bool = True,
) -> DataFrame:
    """Log10 probabilities of whole texts, with those of a smoothed word model.

    ``ranked`` tells that the vocabulary's scores are negative ranks rather than
    log probabilities. Without ``rounds`` the scores alone are the model.

    ``held_out`` is a boolean column; rows where it is true teach nothing (by
    default, rows whose id's crc32 has no remainder by 10). Returns the id,
    ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (those seen in
    training), ``train_tokens``, ``base_score`` and ``score``.

    Defined cases: a null or empty text is an end alone; a null id counts as a
    training row; repeated rows count and are scored each on its own; bytes
    that no piece covers fall back on single-byte pieces, so every text has a
    probability; other columns are not carried; an empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    held = held_out if held_out is not None else F.crc32(F.col(id_col).cast("string")) % 10 == 0
    source = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(held, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("binary").alias("text"),
    )
    coded = table(source.mapInArrow(_code(chunk_bytes), _CODED), "coded")
    docs = coded.where("word is null").select("chunk", "doc_id", "held_out", "codes")
    listed = coded.where("word is not null").select("chunk", "word", "code", "n")
    words = table(listed.groupBy("word").agg(F.sum("n").alias("n")), "words")
    sums = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    ends = docs.where("not held_out").count()
    train_tokens, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)

    vocab = pieces(vocabulary_path, ranked)
    logp, own = vocab.logp, np.exp(vocab.logp) * prior * (len(vocab) + 1)
    taught = words.where("n > 0")
    for _ in range(rounds):
        uses = taught.mapInArrow(_expect(vocabulary_path, logp), "piece long, uses double")
        total = own.copy()
        total[-1] += ends
        for row in uses.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # pieces at most
            total[row["piece"]] += row["uses"]
        logp = np.log(total / total.sum())
    scored = words.mapInArrow(_score(vocabulary_path, logp), "word binary, n long, lp double")
    values = listed.select("chunk", "word", "code").join(scored, "word").select(F.col("chunk").alias("part"), "code", "n", "lp")
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    # about one chunk to a task, however many there are
    chunks = max(1, docs.select("chunk").distinct().count())
    out = (
        docs.repartition(chunks, "chunk").groupBy("chunk")
        .cogroup(values.repartition(chunks, "part").groupBy("part"))
        .applyInArrow(_add_up(int(train_tokens), int(distinct), int(ends), float(logp[-1] / np.log(10))), schema)
    )
    return out.withColumnRenamed("doc_id", id_col)
