"""Exact removal of repeated word windows by super-k-mer partitioning.

Windows of ``width`` words are keyed by their minimiser, the least hash of any
``m`` consecutive words inside. Consecutive windows that share a minimiser are
one super-k-mer and travel together as one packed string to the bucket of that
minimiser, where the windows are sorted and counted by their words.

Two things keep the traffic near the size of what repeats:

* a minimiser that occurs once in the corpus can't belong to a repeated
  window, so its super-k-mer stays home; only those with company travel;
* equal packed strings are counted before they are sent, so a passage copied
  into a third of all rows arrives in its bucket once for each map task.

Super-k-mers of a minimiser that occurs in very many places travel window by
window, each under the hash of its own words, so a bucket stays bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key, small_batches, table

WIDTH = 35
#: Words of a minimiser.
M = 6
#: Occurrences of a minimiser from which its windows travel one by one.
HOT = 2000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FNV = np.uint64(0x100000001B3)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie end to end in ``buf``."""
    word = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(len(buf), dtype=bool)
    if len(buf):
        before[0] = False
        before[1:] = word[:-1]
    after = np.empty(len(buf), dtype=bool)
    if len(buf):
        after[-1] = False
        after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    size = ends - starts
    h = np.full(len(starts), 0xCBF29CE484222325, dtype=np.uint64)
    live = np.arange(len(starts))
    for k in range(24):
        if not len(live):
            break
        h[live] = (h[live] ^ buf[starts[live] + k]) * _FNV
        live = live[size[live] > k + 1]
    for i in live:  # the few longer ones
        digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, dtype=np.uint64)[0]
    return mixed(h ^ size.astype(np.uint64))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive entries; shorter by ``k - 1``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc = acc * _MIX + h[j : j + n]
    return mixed(acc)


def sliding_argmin(x: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each ``span`` consecutive entries is, leftmost, by doubling."""
    n = len(x) - span + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)

    def lower(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(x[right] < x[left], right, left)

    width, at = 1, np.arange(len(x))
    while 2 * width <= span:
        at = lower(at[:-width], at[width:])
        width *= 2
    return lower(at[:n], at[span - width : span - width + n])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each value begins."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return buf, (offsets - offsets[0]).astype(np.int64)


def slices(bounds: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes together, one text at least."""
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield at, to
        at = to


def super_kmers(buf: np.ndarray, bounds: np.ndarray, width: int, m: int) -> tuple[np.ndarray, ...]:
    """(minimiser, text, first window, windows) of each super-k-mer."""
    starts, ends = word_spans(buf, bounds)
    none = np.empty(0, dtype=np.int64)
    if len(starts) < width:
        return none, none, none, none
    text = np.searchsorted(bounds, starts, side="right") - 1
    first_word = np.searchsorted(starts, bounds[:-1], side="left")
    grams = run_hashes(word_hashes(buf, starts, ends), m)
    where = sliding_argmin(grams, width - m + 1)
    at = np.flatnonzero(text[: len(where)] == text[width - 1 :])
    if not len(at):
        return none, none, none, none
    # one run for each place: a window that repeats within its text then has
    # its minimiser in two runs, so no run that occurs once can hold one
    place, owner = where[at], text[at]
    mini = grams[place]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    return mini[head].view(np.int64), owner[head], at[head] - first_word[owner[head]], count


def _find(width: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            buf, bounds = texts_of(batch.column(2))
            for a, b in slices(bounds):
                base = bounds[a]
                mini, owner, start, count = super_kmers(buf[base : bounds[b]], bounds[a : b + 1] - base, width, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mini),
                        pa.array(ids[a + owner]),
                        pa.array(hashes[a + owner]),
                        pa.array(start.astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                    ],
                    names=["key", "_id", "_h", "start", "n"],
                )

    return run


def _extract(width: int):
    """Packed strings of the chosen super-k-mers of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, h, text, chosen in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = (text or b"").split()
                for c in chosen:
                    at, n = c["start"], c["n"]
                    if not c["hot"]:
                        rows.append((c["key"], b" ".join(words[at : at + n + width - 1]), doc, h, at))
                        continue
                    for i in range(at, at + n):
                        packed = b" ".join(words[i : i + width])
                        key = int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True)
                        rows.append((key, packed, doc, h, i))
                if len(rows) > 20_000:
                    yield _packed(rows)
                    rows = []
            if rows:
                yield _packed(rows)

    return run


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
        names=["key", "packed", "_id", "_h", "start"],
    )


def repeated(strings: list[tuple[bytes, int]], width: int) -> dict[int, list[tuple[int, int]]]:
    """For each string, the runs ``[a, b)`` of its windows that occur twice.

    ``strings`` are the distinct packed strings of a bucket with their counts.
    All windows are sorted by their words; a run of equal ones is a window,
    its strings' counts together its occurrences.
    """
    windows = []
    for k, (packed, _) in enumerate(strings):
        words = packed.split(b" ")
        windows += [(b" ".join(words[i : i + width]), k, i) for i in range(len(words) - width + 1)]
    windows.sort()
    marked: dict[int, list[int]] = {}
    for _, same in groupby(windows, key=lambda w: w[0]):
        same = list(same)
        if len(same) > 1 or strings[same[0][1]][1] > 1:
            for _, k, i in same:
                marked.setdefault(k, []).append(i)
    out = {}
    for k, at in marked.items():
        runs: list[list[int]] = []
        for i in sorted(at):
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        out[k] = [tuple(r) for r in runs]
    return out


def _count(width: int):
    """Verdicts for rows that come sorted by key."""

    def verdicts(key, strings):
        for k, runs in repeated([s[:2] for s in strings], width).items():
            yield key, strings[k][2], [{"a": a, "b": b} for a, b in runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, strings, out = None, [], []

        def flush():
            nonlocal out
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            out = []
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                ],
                names=["key", "ph", "runs"],
            )

        for batch in batches:
            for k, packed, n, ph in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if k != key and strings:
                    out.extend(verdicts(key, strings))
                    strings = []
                key = k
                strings.append((packed, n, ph))
            if len(out) > 10_000:
                yield flush()
        if strings:
            out.extend(verdicts(key, strings))
        yield flush()

    return run


def _cut(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """The text without the covered words, its words and how many went."""
    starts, ends = word_spans(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    drop = np.zeros(len(starts) + 1, dtype=np.int64)
    for s in spans:
        drop[s["a"]] += 1
        drop[s["b"]] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    if not gone.any():
        return text, len(starts), 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(text[at : starts[a]])
        at = starts[b] if b < len(starts) else ends[-1]
    out.append(text[at:])
    return b"".join(out), len(starts), int(gone.sum())


def _remove(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    kept, n, gone = None, 0, 0
                elif spans:
                    kept, n, gone = _cut(text, spans)
                else:
                    kept, n, gone = text, len(text.split()), 0
                texts.append(kept)
                counts.append(n)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[2:],
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                ],
                names=schema.names,
            )

    return run


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    m: int = M,
    hot: int = HOT,
) -> DataFrame:
    """``df`` with ``rs_text``, ``rs_words`` and ``rs_removed``.

    ``rs_text`` is the text without each word that a window of ``width`` words
    covers whose word sequence also starts anywhere else, the same row
    included; white space between kept words stays. Windows are judged on the
    input. Other columns stay as they are, unless they have one of those names.

    Defined cases: a null text stays null with no words; texts of fewer than
    ``width`` words stay whole; repeated rows (same id or null id included)
    are texts of their own, so their windows repeat; an empty table gives an
    empty table.
    """
    spark = df.sparkSession
    small_batches(spark)
    df = df.drop("rs_text", "rs_words", "rs_removed")
    text = F.col(text_col)
    docs = df.select(*row_key(F.col(id_col), text), text.cast("binary").alias("_text"))

    found = docs.mapInArrow(_find(width, m), "key long, _id long, _h long, start int, n int")
    # written first: its join with the places is then shuffled for itself alone,
    # and Spark can split the partition of a very frequent minimiser
    company = table(found.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "company")
    chosen = (
        found.join(company, "key")
        .groupBy("_id", "_h")
        .agg(F.collect_set(F.struct("key", "start", "n", (F.col("c") >= hot).alias("hot"))).alias("chosen"))
    )
    packed = table(
        docs.join(chosen, ["_id", "_h"])
        .select("_id", "_h", "_text", "chosen")
        .mapInArrow(_extract(width), "key long, packed binary, _id long, _h long, start int"),
        "superkmers",
    )

    verdicts = (
        packed.groupBy("key", "packed")
        .agg(F.count("*").alias("c"))
        .select("key", "packed", "c", F.xxhash64("packed").alias("ph"))
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_count(width), "key long, ph long, runs array<struct<a:int,b:int>>")
    )
    spans = (
        packed.select("key", F.xxhash64("packed").alias("ph"), "_id", "_h", "start")
        .join(verdicts, ["key", "ph"])
        .select("_id", "_h", "start", F.explode("runs").alias("r"))
        .groupBy("_id", "_h")
        .agg(
            F.collect_set(
                F.struct(
                    (F.col("start") + F.col("r.a")).alias("a"),
                    (F.col("start") + F.col("r.b") + (width - 1)).alias("b"),
                )
            ).alias("_spans")
        )
    )
    spans = table(spans, "spans")
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("rs_text", T.StringType()),
            T.StructField("rs_words", T.LongType()),
            T.StructField("rs_removed", T.LongType()),
        ]
    )
    kid, kh = row_key(F.col(id_col), text)
    keyed = df.select(kid, kh, F.struct("*").alias("_row"))
    return (
        keyed.join(spans, ["_id", "_h"], "left")
        .select(F.col(f"_row.`{text_col}`").cast("binary").alias("_text"), "_spans", "_row.*")
        .mapInArrow(_remove(schema), schema)
    )
