"""Similarity join on word shingles with Bayesian candidate pruning.

1. Texts become sets of hashed word shingles; equal sets are one node.
2. MinHash bands propose candidates. In each bucket, pairs are compared value
   by value: after 16, 32, 48 and 64 values a pair is dropped when the posterior
   probability that its similarity reaches the threshold (uniform prior) is
   below the tolerance. What survives links nodes into candidate components.
3. Pairs of a component that stay in play by the same steps are verified on
   the whole shingle sets; a pair that was dropped doesn't come back.

Pairs are never rows. A bucket or component hands on a spanning forest and
sums of links; one of more than ``block`` members is dealt out as pairs of
blocks, so no task holds more than two blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, row_key, small_batches, table
from .substrings import mixed, run_hashes, slices, texts_of, word_hashes, word_spans

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
#: MinHash values compared one step after another, 16 bits of each.
STEPS = (16, 32, 48, 64)
TOLERANCE = 1e-7
BLOCK = 512


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``n`` hash functions, from a counter."""
    base = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:n] | np.uint64(1), base[n:]


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of ``n`` equal values at which a pair is kept.

    With a uniform prior the posterior after m matches is Beta(m+1, n-m+1), and
    the chance that it reaches t is that of at most m successes in n+1 trials.
    """
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def shingle_sets(buf: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of all words if fewer."""
    starts, ends = word_spans(buf, bounds)
    words = word_hashes(buf, starts, ends)
    grams = run_hashes(words, size)
    at = np.searchsorted(starts, bounds)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(run_hashes(words[a:b], int(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _sign(size: int, bands: int, rows: int, values: int):
    mul, add = seeds(max(bands * rows, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = texts_of(batch.column(2))
            for a, b in slices(bounds):
                base = bounds[a]
                sets = shingle_sets(buf[base : bounds[b]], bounds[a : b + 1] - base, size)
                full = np.array([k for k, s in enumerate(sets) if len(s)], dtype=np.int64)
                mins = np.zeros((len(mul), len(full)), dtype=np.uint64)
                if len(full):
                    x = np.concatenate([sets[k] for k in full])
                    heads = np.cumsum([0, *[len(sets[k]) for k in full[:-1]]])
                    t = np.empty_like(x)
                    for i in range(len(mul)):
                        np.multiply(x, mul[i], out=t)
                        t += add[i]
                        mins[i] = np.minimum.reduceat(t, heads)
                mins >>= np.uint64(32)
                keys = np.zeros((bands, len(full)), dtype=np.uint64)
                for band in range(bands):
                    acc = np.full(len(full), band + 1, dtype=np.uint64)
                    for r in range(rows):
                        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + mins[band * rows + r])
                    keys[band] = acc
                short = np.ascontiguousarray(mins[:values].T.astype(np.uint16))
                n = len(sets)
                digest, signature, band_rows = [None] * n, [None] * n, [None] * n
                for j, k in enumerate(full):
                    digest[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                    signature[k] = short[j].tobytes()
                    band_rows[k] = keys[:, j].view(np.int64) if bands == 1 else keys[:, j].copy().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(digest, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(band_rows, pa.list_(pa.int64())),
                        pa.array(signature, pa.binary()),
                    ],
                    names=["_id", "_h", "digest", "size", "bands", "sig"],
                )

    return run


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n = len(adjacent)
    seen = np.zeros(n, dtype=bool)
    edges = []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        queue = [root]
        while queue:
            u = queue.pop()
            for v in np.flatnonzero(adjacent[u] & ~seen):
                seen[v] = True
                edges.append((u, int(v)))
                queue.append(int(v))
    return edges


def surviving(sig: np.ndarray, side: np.ndarray, cross: bool, steps: list[tuple[int, int]]) -> np.ndarray:
    """Pairs (i, j) whose MinHash values keep them in play, step by step."""
    n = len(sig)
    if cross:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    else:
        i, j = np.triu_indices(n, 1)
    matches = np.zeros(len(i), dtype=np.int16)
    at = 0
    for upto, least in steps:
        for v in range(at, upto):
            matches += sig[i, v] == sig[j, v]
        at = upto
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return np.stack([i, j])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first ``keys`` columns; rows come sorted."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _pairs(rows: list[tuple], names: tuple[str, str], types: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _prune(threshold: float, tolerance: float):
    steps = [(n, least_matches(n, threshold, tolerance)) for n in STEPS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple] = set()

        def flush():
            return _pairs(list(out), ["a", "b"], (pa.binary(), pa.binary()))

        for group in _groups(batches, 3):
            cross = group[0][1] != group[0][2]
            sig = np.frombuffer(b"".join(r[5] for r in group), dtype=np.uint16).reshape(len(group), -1)
            side = np.array([int(r[3] != r[1]) for r in group])
            i, j = surviving(sig, side, cross, steps)
            if len(i) == 0:
                continue
            if len(group) == 2:
                found = [(0, 1)]
            else:
                adjacent = np.zeros((len(group), len(group)), dtype=bool)
                adjacent[i, j] = adjacent[j, i] = True
                found = forest(adjacent)
            out.update((group[u][4], group[v][4]) for u, v in found)
            if len(out) > 20_000:
                yield flush()
                out.clear()
        yield flush()

    return run


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    n = len(sets)
    ids, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    often = count > 1  # a shingle of one set alone is shared with none
    rank = np.cumsum(often) - 1
    chosen = often[inverse]
    column, owner = rank[inverse[chosen]], owner[chosen]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((n, n), dtype=np.int64)
    width = 4096
    for at in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        total += (part @ part.T).astype(np.int64)
    return total


def _verify(size: int, threshold: float, tolerance: float):
    steps = [(n, least_matches(n, threshold, tolerance)) for n in STEPS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush():
            return _pairs(out, ["a", "b", "links"], (pa.binary(), pa.binary(), pa.int64()))

        for group in _groups(batches, 3):
            cross = group[0][1] != group[0][2]
            sig = np.frombuffer(b"".join(r[6] for r in group), dtype=np.uint16).reshape(len(group), -1)
            i, j = surviving(sig, np.array([int(r[3] != r[1]) for r in group]), cross, steps)
            # texts of which no pair is in play are not read
            kept, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            if not len(kept):
                continue
            group, i, j = [group[k] for k in kept], at[: len(i)], at[len(i) :]
            texts = [r[7] for r in group]
            bounds = np.cumsum([0, *map(len, texts)])
            sets = shingle_sets(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds, size)
            sizes = np.array([len(s) for s in sets])
            inter = shared(sets)
            alike = inter / (sizes[:, None] + sizes[None, :] - inter) >= threshold
            linked = np.zeros_like(alike)
            linked[i, j] = linked[j, i] = alike[i, j]
            copies = np.array([r[5] for r in group])
            for k, links in enumerate(linked @ copies):
                if links:
                    out.append((group[k][4], None, int(links)))
            out.extend((group[u][4], group[v][4], 0) for u, v in forest(linked))
            if len(out) > 20_000:
                yield flush()
                out.clear()
        yield flush()

    return run


def _blocks(df: DataFrame, count: str, block: int, *columns: str) -> DataFrame:
    """Rows of each group with the pairs of blocks they belong to."""
    parts = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64("digest"), parts).cast("int")
    return df.select(*columns, own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).select(
        columns[0],
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "own",
        *columns[1:],
    )


def similar(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
) -> DataFrame:
    """One row for each row of ``df``: ``_id, _h``, its class and its links.

    ``class_id`` is the least id of the rows linked to it, directly or over
    others; ``n_links`` counts the other rows of similarity ``threshold`` or
    more, copies included; ``first`` says whether the row is the one that
    stands for its class.

    Defined cases: texts of fewer than ``size`` words are one shingle of all
    their words; null texts and texts without words are classes of their own;
    a null id is the least; rows repeated with one id and text are copies, and
    all of them stand for their class if one does; an empty table gives no
    rows. Other columns of ``df`` play no part.
    """
    spark = df.sparkSession
    small_batches(spark)
    text = F.col(text_col)
    docs = df.select(*row_key(F.col(id_col), text), text.cast("binary").alias("_text"))
    signed = table(
        docs.mapInArrow(
            _sign(size, BANDS, ROWS, STEPS[-1]),
            "_id long, _h long, digest binary, size int, bands array<long>, sig binary",
        ),
        "signed",
    )
    nodes = table(
        signed.where("size > 0")
        .groupBy("digest")
        .agg(
            F.min(F.struct("_id", "_h")).alias("rep"),
            F.count("*").alias("copies"),
            F.first("bands").alias("bands"),
            F.first("sig").alias("sig"),
        ),
        "nodes",
    )
    banded = nodes.select("digest", F.explode("bands").alias("key"))
    # totals of a group are written before its rows meet them: Spark can then split a hot one
    crowded = table(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "crowded")
    candidates = _blocks(
        banded.join(crowded, "key").join(nodes.select("digest", "sig"), "digest"), "c", block, "key", "digest", "sig"
    )
    maybe = (
        candidates.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(_prune(threshold, tolerance), "a binary, b binary")
    )
    groups = components(maybe).checkpoint()
    sizes = table(groups.groupBy("root").agg(F.count("*").alias("c")), "sizes")
    members = groups.join(sizes, "root").join(
        nodes.select(F.col("digest").alias("node"), "rep._id", "rep._h", "copies", "sig"), "node"
    )
    # one text for each key: rows repeated with one id and text meet as one, put together where they are read
    once = docs.groupBy("_id", "_h").agg(F.first("_text").alias("_text"))
    texts = members.join(once, ["_id", "_h"]).select("root", F.col("node").alias("digest"), "copies", "c", "sig", "_text")
    verified = table(
        _blocks(texts, "c", block, "root", "digest", "copies", "sig", "_text")
        .repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j")
        .mapInArrow(_verify(size, threshold, tolerance), "a binary, b binary, links long"),
        "verified",
    )
    classes = components(verified.where("b is not null").select("a", "b"))
    links = verified.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    known = (
        nodes.select("digest", "rep", "copies")
        .join(classes.select(F.col("node").alias("digest"), "root"), "digest", "left")
        .join(links, "digest", "left")
        .select(
            "digest",
            "rep",
            F.coalesce("root", "digest").alias("root"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    known = table(known, "known")
    heads = table(known.groupBy("root").agg(F.min("rep").alias("head")), "heads")
    known = known.join(heads, "root").select("digest", "head", "n_links")
    own = F.struct("_id", "_h")
    head = F.coalesce("head", own)
    return (
        signed.select("_id", "_h", "digest")
        .join(known, "digest", "left")
        .select(
            "_id",
            "_h",
            head["_id"].alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            (head == own).alias("first"),
        )
    )


def real_id(column: str):
    """The id that ``row_key`` made a long of; its stand-in for null back to null."""
    return F.when(F.col(column) != -(2**63), F.col(column))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without near copies: one row of each class stays.

    Of rows repeated with one id and text one stays, put together where they are
    read, so that very many of them never meet in one task.
    """
    kept = similar(df, id_col, text_col, **options).where("first").select("_id", "_h").distinct()
    kid, kh = row_key(F.col(id_col), F.col(text_col))
    once = df.select(kid, kh, F.struct("*").alias("_row")).groupBy("_id", "_h").agg(F.first("_row").alias("_row"))
    return once.join(kept, ["_id", "_h"]).select("_row.*")
