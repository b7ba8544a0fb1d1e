"""Local image descriptors that find cropped and edited copies.

Corners are found on several scales, to a fraction of a pixel; their patches are
turned to the direction of their intensity centroid and described by binary
intensity tests. Two images are linked if enough close descriptors agree on one
change of scale, direction and place; classes are what links connect.

1. Each of several Hamming tables keys a descriptor by a sample of its bits.
   Keys of one image alone are dropped after they are counted.
2. Each image of a key meets the key's least image. Pairs that meet by two
   corners are compared corner by corner, and consensus decides. Groups of
   copies become one class by about one pair for each copy.
3. Then all images of a key that aren't yet in one class meet, keys of many rows
   as pairs of blocks, and are compared in the same way. Links within a class
   change nothing, so only their pairs are left out.

Chance company grows with the square of the images, by 1e-7 to 1e-8 of the
pairs of descriptors at 48 bits on fine textures: ``width`` has to grow with the
logarithm of the collection, at a lower recall for each table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, table

#: Half a patch's side; steps of an octave; least pixels between corners of one level.
RADIUS, STEPS, APART = 8, 4, 3
#: Weakest response of a corner.
RESPONSE = 1.0
BITS = 256
#: Hamming tables, and the bits that each samples for its key.
TABLES, WIDTH = 8, 48
BLOCK = 2048
#: Most differing bits of a match; fewest corners that meet in the tables; fewest that agree.
DISTANCE, MEET, AGREE = 40, 2, 4
#: Pixels of a task's images worked on together.
TOGETHER = 1 << 18
_EDGE = RADIUS + 2


def _tests() -> np.ndarray:
    """Pairs of places in a disc of the patch's radius."""
    at = np.random.default_rng(42).uniform(-1, 1, (40 * BITS, 2))
    return (RADIUS * at[(at**2).sum(axis=1) <= 1][: 2 * BITS]).reshape(BITS, 2, 2).astype(np.float32)


def _samples() -> list[np.ndarray]:
    """The bits of each table's key."""
    return [np.random.default_rng(t).permutation(BITS)[:WIDTH] for t in range(TABLES)]


TESTS, SAMPLES = _tests(), _samples()
_span = np.arange(-RADIUS, RADIUS + 1, dtype=np.float32)
_DISC = np.stack([d.ravel() for d in np.meshgrid(_span, _span)], axis=1)
_DISC = _DISC[(_DISC**2).sum(axis=1) <= RADIUS**2]

_PGM = re.compile(rb"P5(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def decode(data: bytes) -> np.ndarray:
    """A binary PGM (P5) of 8 or 16 bits as floats up to 255; raises ValueError if it isn't one."""
    head = _PGM.match(data)
    if not head:
        raise ValueError("not a binary PGM")
    width, height, most = map(int, head.groups())
    if not 0 < most < 65536 or not width or not height:
        raise ValueError("not a binary PGM")
    kind = np.dtype(np.uint8 if most < 256 else ">u2")
    if len(data) < head.end() + width * height * kind.itemsize:
        raise ValueError("cut short")
    pixels = np.frombuffer(data, dtype=kind, count=width * height, offset=head.end())
    return pixels.reshape(height, width).astype(np.float32) * np.float32(255 / most)


def encode(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def _box(x: np.ndarray, r: int = 1) -> np.ndarray:
    """Means of squares of images, the last two axes."""
    padded = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(r, r), (r, r)], mode="edge")
    rows = sum(padded[..., k : k + x.shape[-2], :] for k in range(2 * r + 1))
    return sum(rows[..., k : k + x.shape[-1]] for k in range(2 * r + 1)) / (2 * r + 1) ** 2


def _between(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Images resampled to a smaller size, linearly."""

    def places(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.minimum(at.astype(int), size - 2)
        return low, (at - low).astype(np.float32)

    (i, a), (j, b) = places(h, x.shape[1]), places(w, x.shape[2])
    rows = x[:, i] * (1 - a)[:, None] + x[:, i + 1] * a[:, None]
    return rows[:, :, j] * (1 - b) + rows[:, :, j + 1] * b


def _at(flat: np.ndarray, w: int, start: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between pixels; ``start`` is where a corner's image begins."""
    i, j = y.astype(np.int32), x.astype(np.int32)
    a, b = y - i, x - j
    k = start + i * w + j
    return (flat[k] * (1 - b) + flat[k + 1] * b) * (1 - a) + (flat[k + w] * (1 - b) + flat[k + w + 1] * b) * a


def _peaks(response: np.ndarray) -> tuple[np.ndarray, ...]:
    """Image, row and column of the greatest responses of their neighbourhoods."""
    inner = response[:, _EDGE:-_EDGE, _EDGE:-_EDGE]
    padded = np.pad(inner, [(0, 0), (APART, APART), (APART, APART)], constant_values=-np.inf)
    rows = np.max([padded[:, k : k + inner.shape[1]] for k in range(2 * APART + 1)], axis=0)
    top = np.max([rows[:, :, k : k + inner.shape[2]] for k in range(2 * APART + 1)], axis=0)
    n, i, j = np.nonzero((inner == top) & (inner > RESPONSE))
    return n, i + _EDGE, j + _EDGE


def features(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, places and codes of the corners of images of one size.

    A place is x, y, scale (a power of 2) and direction in radians; a code is
    the bits of a descriptor. Corners of each level are as dense as the image
    has them, so a crop has those of its part.
    """
    owners, places, codes = [np.zeros(0, np.int64)], [np.zeros((0, 4), np.float32)], [np.zeros((0, BITS // 8), np.uint8)]
    base, level = images, 0
    while True:
        if level and level % STEPS == 0:
            h, w = (s // 2 * 2 for s in base.shape[1:])
            base = (base[:, :h:2, :w:2] + base[:, 1:h:2, :w:2] + base[:, :h:2, 1:w:2] + base[:, 1:h:2, 1:w:2]) / 4
        part = 2 ** (level % STEPS / STEPS)
        h, w = (round(s / part) for s in base.shape[1:])
        if min(h, w) < 2 * _EDGE + 1:
            break
        x = base if part == 1 else _between(base if part < 1.5 else _box(base), h, w)
        soft = _box(x)
        gy, gx = np.gradient(soft, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = a * b - c * c - 0.05 * (a + b) ** 2
        n, i, j = _peaks(response)

        def shift(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
            bend = low - 2 * mid + high
            return np.clip(np.where(bend < 0, 0.5 * (low - high) / np.where(bend < 0, bend, 1), 0), -0.5, 0.5)

        mid = response[n, i, j]
        y = (i + shift(response[n, i - 1, j], mid, response[n, i + 1, j])).astype(np.float32)[:, None]
        x = (j + shift(response[n, i, j - 1], mid, response[n, i, j + 1])).astype(np.float32)[:, None]
        flat, start = soft.astype(np.float32).ravel(), (n * h * w)[:, None]
        for at in range(0, len(n), 1024):
            some = slice(at, at + 1024)
            disc = _at(flat, w, start[some], y[some] + _DISC[:, 1], x[some] + _DISC[:, 0])
            turn = np.arctan2(disc @ _DISC[:, 1], disc @ _DISC[:, 0])
            cos, sin = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
            dx, dy = TESTS[..., 0], TESTS[..., 1]
            value = _at(flat, w, start[some, None], y[some, None] + sin * dx + cos * dy, x[some, None] + cos * dx - sin * dy)
            wide = images.shape[2] / w if part != 1 else 2.0 ** (level // STEPS)
            high = images.shape[1] / h if part != 1 else 2.0 ** (level // STEPS)
            place = [(x[some, 0] + 0.5) * wide - 0.5, (y[some, 0] + 0.5) * high - 0.5, np.full(len(turn), 2 ** (level / STEPS)), turn]
            owners.append(n[some])
            places.append(np.stack(place, axis=1).astype(np.float32))
            codes.append(np.packbits(value[..., 0] < value[..., 1], axis=1))
        level += 1
    return np.concatenate(owners), np.concatenate(places), np.concatenate(codes)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column(1).to_pylist()
        found: list[tuple[int, bytes, bytes]] = [(0, b"", b"")] * len(data)
        sizes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}

        def work(group: list[tuple[int, np.ndarray]]) -> None:
            owner, places, codes = features(np.stack([x for _, x in group]))
            for k, (row, _) in enumerate(group):
                own = owner == k
                found[row] = int(own.sum()), places[own].tobytes(), codes[own].tobytes()  # noqa: B023

        for row, one in enumerate(data):
            try:
                pixels = decode(one or b"")
            except ValueError:
                continue
            group = sizes.setdefault(pixels.shape, [])
            group.append((row, pixels))
            if len(group) * pixels.size >= TOGETHER:
                work(group)
                group.clear()
        for group in sizes.values():
            if group:
                work(group)
        digests = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in data]
        counts, places, codes = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(places, pa.binary()), pa.array(codes, pa.binary())],
            names=["_id", "digest", "n_corners", "places", "codes"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each corner and table; corners of images without any give none."""
    for batch in batches:
        images, codes = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for at in range(0, len(codes), 64):
            part = [np.frombuffer(c, np.uint8).reshape(-1, BITS // 8) for c in codes[at : at + 64]]
            bits = np.unpackbits(np.concatenate(part), axis=1)
            n = [len(p) for p in part]
            keys = np.zeros((TABLES, len(bits), 8), np.uint8)
            keys[..., 0] = np.arange(TABLES)[:, None]
            for t, sample in enumerate(SAMPLES):
                keys[t, :, 8 - WIDTH // 8 :] = np.packbits(bits[:, sample], axis=1)
            corner = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.reshape(-1, 8).view(">i8").ravel().astype(np.int64)),
                    pa.array(np.tile(np.repeat(images[at : at + 64], n), TABLES)),
                    pa.array(np.tile(corner, TABLES)),
                ],
                names=["key", "img", "corner"],
            )


_MEET = "a long, b long, ca int, cb int"


def _companies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of different classes that share a key; a group is one block or two."""

    def pairs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, i, j, *_ = rows[0]
        own, img, cls, corner = (np.array(c) for c in list(zip(*rows, strict=True))[3:])
        left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j)) if i != j else (np.arange(len(own)),) * 2
        for u in left:
            v = right[(cls[right] != cls[u]) & ((right > u) | (i != j))]
            if len(v):
                first = img[u] < img[v]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(first, img[u], img[v])), pa.array(np.where(first, img[v], img[u])),
                        pa.array(np.where(first, corner[u], corner[v]), pa.int32()), pa.array(np.where(first, corner[v], corner[u]), pa.int32()),
                    ],
                    names=["a", "b", "ca", "cb"],
                )

    held: list[tuple] = []
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                out += pairs(held)
                held = []
            held.append(row)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if held:
        yield from pairs(held)


def consensus(a: np.ndarray, b: np.ndarray, agree: int = AGREE) -> bool:
    """Do matches of places ``a`` and ``b`` agree on one change of scale, direction and place?

    Each match proposes the change that its scales and directions tell; the one
    with most followers is fitted to them twice, and the corners that then fall
    on their partners are counted, each once on either side.
    """
    if len(a) < agree:
        return False
    p, q = (x[:, 0].astype(float) + 1j * x[:, 1] for x in (a, b))
    own = (b[:, 2] / a[:, 2]) * np.exp(1j * (b[:, 3] - a[:, 3]).astype(float))
    best, most = None, 0
    for at in range(0, len(p), 256):
        some = slice(at, at + 256)
        way = p[None, :] - p[some, None]
        off = np.abs(q[some, None] + own[some, None] * way - q[None, :])
        fit = (off <= np.maximum(3.0 * b[None, :, 2], 0.2 * np.abs(way * own[some, None]))) & (np.abs(np.log2(np.abs(own[None, :] / own[some, None]))) < 0.7)
        counts = fit.sum(axis=1)
        if counts.max() > most:
            most, best = int(counts.max()), fit[counts.argmax()]
    if most < agree:
        return False
    for _ in range(2):
        u, v = p[best] - p[best].mean(), q[best] - q[best].mean()
        spread = (np.abs(u) ** 2).sum()
        if not spread > 0:
            return False
        change = (np.conj(u) * v).sum() / spread
        best = np.abs(q[best].mean() + change * (p - p[best].mean()) - q) <= 2.5 * np.maximum(b[:, 2], a[:, 2] * np.abs(change))
        if best.sum() < agree:
            return False
    # corners of several levels in one place are one
    one = lambda x: len(np.unique(np.rint(x[best] / 2)))
    return min(one(p), one(q)) >= agree


def matches(x: np.ndarray, y: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Each corner of ``x`` with its closest of ``y``, if within ``distance``."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    near, far = np.zeros(len(x), np.int64), np.full(len(x), BITS + 1)
    for at in range(0, len(y), 512):
        some = y[at : at + 512]
        for k in range(0, len(x), 512):
            d = np.bitwise_count(x[k : k + 512, None] ^ some[None]).sum(axis=2, dtype=np.int64)
            least = d.argmin(axis=1)
            d = np.take_along_axis(d, least[:, None], axis=1)[:, 0]
            closer = d < far[k : k + 512]
            near[k : k + 512] = np.where(closer, at + least, near[k : k + 512])
            far[k : k + 512] = np.where(closer, d, far[k : k + 512])
    at = np.flatnonzero(far <= distance)
    return at, near[at]


def alike(one: tuple[bytes, bytes], other: tuple[bytes, bytes], distance: int = DISTANCE, agree: int = AGREE) -> bool:
    """Whether two images, as (places, codes), are edited copies."""
    (pa_, ca), (pb, cb) = ((np.frombuffer(p, np.float32).reshape(-1, 4), np.frombuffer(c, np.uint8).reshape(-1, BITS // 8)) for p, c in (one, other))
    i, j = matches(ca, cb, distance)
    return consensus(pa_[i], pb[j], agree)


def _compare(distance: int, agree: int):
    """Rows come as a, b, image, places, codes; the two of a pair one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for a, b, places, codes in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if held and held[:2] == (a, b):
                    if alike(held[2], (places, codes), distance, agree):
                        out.append((a, b))
                    held = None
                else:
                    held = a, b, (places, codes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"]
            )

    return run


def agreeing(met: DataFrame, images: DataFrame, distance: int = DISTANCE, agree: int = AGREE) -> DataFrame:
    """Those of the pairs ``a, b`` (each once) whose corners agree."""
    sides = met.select("a", "b", F.explode(F.array("a", "b")).alias("img"))
    return (
        images.join(sides, "img")
        .select("a", "b", "img", "places", "codes")
        .repartition("a", "b")
        .sortWithinPartitions("a", "b", "img")
        .mapInArrow(_compare(distance, agree), "a long, b long")
    )


def links(images: DataFrame, distance: int = DISTANCE, agree: int = AGREE, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` that connect what all pairs that meet in the tables connect.

    ``images`` has the number ``img`` of each, its ``places`` and its ``codes``.
    """
    keyed = images.select("img", "codes").mapInArrow(_keys, "key long, img long, corner int")
    shared = table(
        keyed.groupBy("key")
        .agg(F.min("img").alias("first"), F.max("img").alias("last"), F.count("*").alias("n"))
        .where(F.col("first") != F.col("last"))
        .select("key", "first", "n"),
        "shared",
    )
    held = table(keyed.join(shared, "key"), "company")
    met = (
        held.where(F.col("img") != F.col("first"))
        .groupBy(F.col("first").alias("a"), F.col("img").alias("b"))
        .agg(F.count_distinct("corner").alias("n"))
        .where(F.col("n") >= MEET)
        .select("a", "b")
    )
    first = table(agreeing(table(met, "met"), images, distance, agree), "first")
    known = table(components(first).select(F.col("node").alias("img"), "root"), "known")
    rows = held.join(known, "img", "left").select("key", "n", "img", F.coalesce("root", "img").alias("cls"), "corner")
    open_ = table(rows.groupBy("key").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("key"), "open")
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("img", "corner"), parts).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    pairs = (
        dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "img", "cls", "corner")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(_companies, _MEET)
        .groupBy("a", "b")
        .agg(F.count_distinct("ca").alias("m"), F.count_distinct("cb").alias("n"))
        .where(F.least("m", "n") >= MEET)
        .select("a", "b")
    )
    return first.unionByName(table(agreeing(table(pairs, "pairs"), images, distance, agree), "rest"))


def copies(
    df: DataFrame,
    id_col: str,
    image_col: str,
    distance: int = DISTANCE,
    agree: int = AGREE,
    block: int = BLOCK,
) -> DataFrame:
    """``id_col``, ``class_id`` (least id of the class) and ``n_corners``.

    Equal files are one image; every two images that meet in the tables by two
    corners and agree by ``agree`` are linked, and classes are what links connect.

    Defined cases: a null image, one that can't be read, one cut short and one
    without corners are alike only to equal files (null: to none); a null id
    counts as the least and stays null, its class id is the least id that
    isn't; repeated rows are copies; other columns are not carried; an empty
    table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = table(
        df.select(F.col(id_col).cast("long").alias("_id"), F.col(image_col).alias("_image"))
        .mapInArrow(_describe, "_id long, digest binary, n_corners long, places binary, codes binary")
        .withColumn("img", F.monotonically_increasing_id()),
        "described",
    )
    known = table(
        rows.where("digest is not null").groupBy("digest").agg(F.min("_id").alias("first"), F.min("img").alias("head")), "files"
    )
    again = table(rows.select("digest", "img").join(known, "digest").where("img <> head").select("img"), "again")
    images = rows.where("n_corners > 0").join(again, "img", "left_anti").select("img", "places", "codes")
    classes = table(components(links(images, distance, agree, block)).select(F.col("node").alias("head"), "root"), "classes")
    known = known.join(classes, "head", "left").select("digest", "first", F.coalesce("root", "head").alias("root"))
    heads = known.groupBy("root").agg(F.min("first").alias("class_id"))
    known = known.join(heads, "root").select("digest", "class_id")
    return rows.join(known, "digest", "left").select(
        F.col("_id").alias(id_col), F.coalesce("class_id", "_id").alias("class_id"), "n_corners"
    )


def basis(side: int, n: int) -> np.ndarray:
    """``n`` fixed smooth textures that vectors are drawn with."""
    rng = np.random.default_rng(9)
    noise = rng.normal(size=(n, side, side))
    soft = np.stack([_box(_box(x)) for x in noise])
    return (soft / soft.std()).reshape(n, -1).astype(np.float32)


def _draw(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            images = []
            for v in batch.column(1).to_pylist():
                v = np.array([x or 0.0 for x in v or []], dtype=np.float32)
                if not np.linalg.norm(v) > 0:
                    images.append(None)
                    continue
                if len(v) not in made:
                    made[len(v)] = basis(side, len(v))
                picture = (v / np.linalg.norm(v)) @ made[len(v)]
                images.append(encode(np.clip(128 + 48 * picture, 0, 255).reshape(side, side)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], names=["_id", "image"])

    return run


def draw(df: DataFrame, id_col: str, vector_col: str, side: int = 64) -> DataFrame:
    """A picture for each vector: near vectors give near pictures.

    Null, empty and all-zero vectors give a null picture; null parts are zero.
    """
    return (
        df.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"))
        .mapInArrow(_draw(side), "_id long, image binary")
        .withColumnRenamed("_id", id_col)
    )
