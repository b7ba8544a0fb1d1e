"""GeoTIFF rasters as pixel rows, and pixel rows as GeoTIFF tiles or one GeoTIFF.

``spark.read.format("geotiff").load(path)`` gives ``row, col, value`` of the first
band, missing values null. Each partition range-reads the blocks of some
lines, so a raster of any size is read in parallel; conditions on ``row`` and
``col`` decide which blocks are read at all. Files are reached through
``pyarrow.fs``: local paths and the URIs it knows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

#: Fixed values of the TIFF format: field types as struct codes.
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
#: Fixed values of the TIFF format: sample format and bits as numpy types.
SAMPLE = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
#: Lines that a partition reads at least.
LINES = 256
#: Tiles that a task of ``read_tiles`` reads on average.
TILES = 4


@dataclass(frozen=True)
class Meta:
    """Size, place and missing value of a raster."""

    height: int
    width: int
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    nodata: float | None = None
    epsg: int | None = None


def opened(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, inner


def _tags(f) -> tuple[str, dict]:
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    word, size = ("Q", 20) if big else ("I", 12)
    f.seek(struct.unpack(order + word, head[8:16] if big else head[4:8])[0])
    (n,) = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))
    entries, tags = f.read(n * size), {}
    for k in range(n):
        entry = entries[k * size : (k + 1) * size]
        tag, kind, count = struct.unpack_from(order + "HH" + word, entry)
        if kind not in FIELD:
            continue
        form = f"{order}{count}{FIELD[kind]}"
        raw, need = entry[12 if big else 8 :], struct.calcsize(form)
        if need > len(raw):
            f.seek(struct.unpack(order + word, raw)[0])
            raw = f.read(need)
        found = struct.unpack(form, raw[:need])
        tags[tag] = b"".join(found).rstrip(b"\0").decode("latin-1") if kind == 2 else found
    return order, tags


def _meta(tags: dict) -> Meta:
    scale, tie = tags.get(33550, (1.0, 1.0)), tags.get(33922, (0.0,) * 6)
    keys = tags.get(34735, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    missing = tags.get(42113)
    return Meta(
        tags[257][0], tags[256][0], tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1],
        None if missing is None else float(missing), codes.get(3072, codes.get(2048)),
    )


def read_meta(path: str) -> Meta:
    """Size and place of a raster; no pixel is read."""
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        return _meta(_tags(f)[1])


def _unlzw(raw: bytes) -> bytes:
    out, bits, held, width = bytearray(), 0, 0, 9
    words: list[bytes] = []
    last = b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            words, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        word = words[code] if code < len(words) else last + last[:1]
        out += word
        if last:
            words.append(last + word[:1])
        last = word
        width = max(9, min(12, (len(words) + 1).bit_length()))
    return bytes(out)


def _decode(raw: bytes, order: str, tags: dict, lines: int, cols: int) -> np.ndarray:
    how = tags.get(259, (1,))[0]
    if how in (8, 32946):
        raw = zlib.decompress(raw)
    elif how == 5:
        raw = _unlzw(raw)
    elif how != 1:
        raise ValueError(f"TIFF compression {how} is not supported")
    samples = 1 if tags.get(284, (1,))[0] == 2 else tags.get(277, (1,))[0]
    kind = SAMPLE[tags.get(339, (1,))[0], tags[258][0]]
    guess = tags.get(317, (1,))[0]
    if guess == 3:
        size = int(kind[1])
        planes = np.frombuffer(raw, "u1").reshape(lines, cols * samples * size)
        summed = np.cumsum(planes.reshape(lines, -1, samples), axis=1, dtype="u1").reshape(lines, size, cols * samples)
        found = np.ascontiguousarray(summed.transpose(0, 2, 1)).view(">" + kind)
        return found.reshape(lines, cols, samples)[:, :, 0]
    found = np.frombuffer(raw, order + kind).reshape(lines, cols, samples)
    if guess == 2:
        found = np.cumsum(found, axis=1, dtype=kind)
    return found[:, :, 0]


def layout(tags: dict) -> tuple[int, int, int]:
    """Lines and columns of a block, and blocks side by side."""
    height, width = tags[257][0], tags[256][0]
    if 322 in tags:
        return tags[323][0], tags[322][0], -(-width // tags[322][0])
    return min(tags.get(278, (height,))[0], height), width, 1


def blocks(f, order: str, tags: dict, r0: int, r1: int, c0: int, c1: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row, column, values and where they are missing, of each block's part within a window.

    Values are compared with the missing one in the raster's own type: a number
    that a file gives in decimals may have been cut to 32 bits.
    """
    height, missing = tags[257][0], _meta(tags).nodata
    lines, cols, across = layout(tags)
    tiled = 322 in tags
    at, size = tags[324 if tiled else 273], tags[325 if tiled else 279]
    for down in range(r0 // lines, -(-r1 // lines)):
        for along in range(c0 // cols, -(-c1 // cols)):
            k = down * across + along
            top, left = max(r0, down * lines), max(c0, along * cols)
            bottom, right = min(r1, (down + 1) * lines, height), min(c1, (along + 1) * cols)
            if not size[k]:  # a block that was never written has no values
                yield top, left, np.zeros((bottom - top, right - left)), np.ones((bottom - top, right - left), bool)
                continue
            f.seek(at[k])
            high = lines if tiled else min(lines, height - down * lines)
            block = _decode(f.read(size[k]), order, tags, high, cols)
            part = block[top - down * lines : bottom - down * lines, left - along * cols : right - along * cols]
            gone = np.isnan(part) if part.dtype.kind == "f" else np.zeros(part.shape, bool)
            if missing is not None and (part.dtype.kind == "f" or np.iinfo(part.dtype).min <= missing <= np.iinfo(part.dtype).max):
                with np.errstate(over="ignore"):
                    gone |= part == part.dtype.type(missing)
            yield top, left, part, gone


def bounds(filters: list[Filter], window: list[int]) -> tuple[list[int], list[Filter]]:
    """The window that conditions on ``row`` and ``col`` leave of one, and the conditions that are none."""
    low, high = {"row": window[0], "col": window[2]}, {"row": window[1], "col": window[3]}
    rest = []
    for f in filters:
        axis = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        known = isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and isinstance(f.value, int)
        if axis in low and known:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                low[axis] = max(low[axis], f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                high[axis] = min(high[axis], f.value + (not isinstance(f, LessThan)))
            continue
        if axis in low and isinstance(f, In) and f.value and all(isinstance(v, int) for v in f.value):
            low[axis], high[axis] = max(low[axis], min(f.value)), min(high[axis], max(f.value) + 1)
        rest.append(f)
    return [low["row"], max(low["row"], high["row"]), low["col"], max(low["col"], high["col"])], rest


class _Lines(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        system, inner = opened(self.path)
        with system.open_input_file(inner) as f:
            tags = _tags(f)[1]
        self.lines, (height, width) = layout(tags)[0], (tags[257][0], tags[256][0])
        self.window = [0, height, 0, width]
        if options.get("window"):
            row, col, rows, cols = (int(x) for x in options["window"].split(","))
            self.window = [row, max(row, min(height, row + rows)), col, max(col, min(width, col + cols))]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.window, rest = bounds(filters, self.window)
        yield from rest

    def partitions(self) -> list[InputPartition]:
        first, last, left, right = self.window
        each = self.lines * -(-LINES // self.lines)
        starts = range(first // each * each, last, each) if right > left else ()
        return [_Lines(max(at, first), min(at + each, last)) for at in starts] or [_Lines(first, first)]

    def read(self, partition: _Lines) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        system, inner = opened(self.path)
        with system.open_input_file(inner) as f:
            order, tags = _tags(f)
            for top, left, part, gone in blocks(f, order, tags, partition.first, partition.last, *self.window[2:]):
                rows, columns = np.mgrid[top : top + part.shape[0], left : left + part.shape[1]].astype("i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows.ravel()),
                        pa.array(columns.ravel()),
                        pa.array(part.astype("f8").ravel(), mask=gone.ravel()),
                    ],
                    names=["row", "col", "value"],
                )


class GeoTiffSource(DataSource):
    """Options: ``path`` and ``window`` (``row,col,rows,cols``: only these pixels)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "row int, col int, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark hand conditions to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)


def lzw(raw: bytes) -> bytes:
    """TIFF's variable-width coding, most significant bit first, widths changed one code early."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    single = {bytes([k]): k for k in range(256)}
    words, width, after = dict(single), 9, 258
    put(256, width)
    word = b""
    for k in range(len(raw)):
        longer = word + raw[k : k + 1]
        if longer in words:
            word = longer
            continue
        put(words[word], width)
        words[longer] = after
        after += 1
        if after == 4094:
            put(256, 12)
            words, width, after = dict(single), 9, 258
        elif after == 1 << width:
            width += 1
        word = raw[k : k + 1]
    if word:
        put(words[word], width)
        if after + 1 == 4094:
            put(256, 12)
            width = 9
        elif after + 1 == 1 << width:
            width += 1
    put(257, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


#: Fixed values of the TIFF format: compressions.
PACKED = {"none": 1, "lzw": 5, "deflate": 8}


def _body(block: np.ndarray, kind: str, packing: str) -> bytes:
    """A block's bytes; whole numbers are stored as differences along lines."""
    data = block.astype("<" + kind)
    if kind[0] in "ui":
        data = np.diff(data, axis=1, prepend=np.zeros((len(data), 1), data.dtype)).astype(data.dtype)
    raw = data.tobytes()
    return zlib.compress(raw) if packing == "deflate" else lzw(raw) if packing == "lzw" else raw


def _common(meta: Meta, kind: str, nodata: float | None, packing: str, description: str | None = None) -> list:
    """Tags that do not depend on where blocks are. Missing values are written so that they read back as they were."""
    whole = kind[0] in "ui"
    tags = [
        (256, 4, (meta.width,)), (257, 4, (meta.height,)), (258, 3, (8 * int(kind[1]),)), (259, 3, (PACKED[packing],)), (262, 3, (1,)),
        (277, 3, (1,)), (317, 3, (2 if whole else 1,)), (339, 3, ({"u": 1, "i": 2, "f": 3}[kind[0]],)),
        (33550, 12, (meta.dx, meta.dy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, meta.x0, meta.y0, 0.0)),
    ]
    if meta.epsg:
        tags.append((34735, 3, (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, meta.epsg)))
    if description is not None:
        said = description.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        item = f'<Item name="DESCRIPTION" sample="0" role="description">{said}</Item>'
        tags.append((42112, 2, f"<GDALMetadata>{item}</GDALMetadata>".encode() + b"\0"))
    if nodata is not None:
        said = str(int(nodata)) if whole else repr(float(nodata))
        tags.append((42113, 2, said.encode() + b"\0"))
    return tags


def _directory(tags: list, start: int, big: bool) -> tuple[bytes, dict[int, int]]:
    """The tags as they lie in the file from ``start`` on, and where each tag's values begin."""
    word, held = ("Q", 8) if big else ("I", 4)
    entry = 12 + held if big else 12
    tags = sorted(tags)
    beyond = start + (8 if big else 2) + entry * len(tags) + held
    listed, rest, at = struct.pack("<Q" if big else "<H", len(tags)), b"", {}
    for n, (tag, kind_id, values) in enumerate(tags):
        raw = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{FIELD[kind_id]}", *values)
        listed += struct.pack("<HH" + word, tag, kind_id, len(values))
        if len(raw) <= held:
            at[tag] = start + (8 if big else 2) + entry * n + 4 + held
            listed += raw.ljust(held, b"\0")
        else:
            at[tag] = beyond + len(rest)
            listed += struct.pack("<" + word, at[tag])
            rest += raw + b"\0" * (-len(raw) % held)
    return listed + b"\0" * held + rest, at


def _encode(block: np.ndarray, kind: str, meta: Meta, nodata: float | None) -> bytes:
    """A small file of one deflated strip."""
    body = _body(block, kind, "deflate")
    tags = _common(meta, kind, nodata, "deflate") + [(273, 4, (8,)), (278, 4, (meta.height,)), (279, 4, (len(body),))]
    start = 8 + len(body) + len(body) % 2
    return b"II*\0" + struct.pack("<I", start) + body + b"\0" * (len(body) % 2) + _directory(tags, start, False)[0]


def _by_tile(df: DataFrame, meta: Meta, value: str, size: int) -> DataFrame:
    """``row, col, v`` of pixels with a value by ``tile_row, tile_col``, and a row without a place for every tile."""
    across, down = -(-meta.width // size), -(-meta.height // size)
    held = df.where(F.col(value).isNotNull()).select(
        F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("v"),
        F.expr(f"row div {size}").alias("tile_row"), F.expr(f"col div {size}").alias("tile_col"),
    )
    none = F.lit(None)
    every = df.sparkSession.range(across * down).select(
        none.cast("int").alias("row"), none.cast("int").alias("col"), none.cast("double").alias("v"),
        F.expr(f"id div {across}").alias("tile_row"), F.expr(f"id % {across}").alias("tile_col"),
    )
    return held.unionByName(every)


def _block(tile: pa.Table, r: int, c: int, high: int, wide: int, size: int, nodata: float | None) -> tuple[np.ndarray, int]:
    """A tile's pixels as a block, and how many have a value."""
    tile = tile.filter(pc.is_valid(tile["v"]))
    block = np.full((high, wide), 0 if nodata is None else nodata, "f8")
    block[tile["row"].to_numpy() - r * size, tile["col"].to_numpy() - c * size] = tile["v"].to_numpy()
    return block, tile.num_rows


def write_tiles(
    df: DataFrame, path: str, meta: Meta, value: str = "value", kind: str = "f4", nodata: float | None = -9999.0, size: int = 512
) -> DataFrame:
    """Writes each ``size`` x ``size`` tile as a georeferenced file ``tile_<row>_<col>.tif``.

    ``kind`` is a numpy type: ``u1, u2, i2, i4, f4, f8``. Null and absent pixels
    get ``nodata`` (0 where that is None), and tiles without any value are
    written, too. A task holds one tile. A file appears under its name only when
    whole, so a repeated task does no harm. The manifest (tile, file, pixels with
    a value) is written as Parquet beside the tiles and returned.
    """

    def save(keys: tuple, tile: pa.Table) -> pa.Table:
        r, c = (k.as_py() for k in keys)
        high, wide = min(size, meta.height - r * size), min(size, meta.width - c * size)
        block, n = _block(tile, r, c, high, wide, size, nodata)
        place = Meta(high, wide, meta.x0 + c * size * meta.dx, meta.y0 - r * size * meta.dy, meta.dx, meta.dy, nodata, meta.epsg)
        system, inner = opened(path)
        system.create_dir(inner, recursive=True)
        name, draft = f"tile_{r}_{c}.tif", f"{inner}/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as f:
            f.write(_encode(block, kind, place, nodata))
        system.move(draft, f"{inner}/{name}")
        return pa.table({"tile_row": [r], "tile_col": [c], "file": [name], "n_valid": [n]})

    done = _by_tile(df, meta, value, size).groupBy("tile_row", "tile_col").applyInArrow(save, "tile_row long, tile_col long, file string, n_valid long")
    done.write.mode("overwrite").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def write_raster(
    df: DataFrame,
    path: str,
    meta: Meta,
    value: str = "value",
    kind: str = "f4",
    nodata: float | None = -9999.0,
    size: int = 512,
    packing: str = "deflate",
    description: str | None = None,
) -> None:
    """One tiled BigTIFF at ``path`` that any reader opens as one raster.

    Tiles are encoded in tasks and kept as Parquet beside the file; running sums
    of their sizes give their places, which stand in the file's head (16 bytes
    a tile, all that the driver holds). On a file system of paths the head is
    written first, and tasks put their tiles into place in parallel; a repeated
    task writes the same bytes to the same place. Other stores only take a
    file from front to back: there one task copies the packed tiles, one at a
    time. Null and absent pixels get ``nodata`` (0 where that is None); tiles
    without any value share one body. The file appears under its name only when
    whole. ``packing``: deflate, lzw or none; ``description`` names the band.
    """
    if size % 16:
        raise ValueError("the side of a tile must be a multiple of 16")
    if packing not in PACKED:
        raise ValueError(f"unknown packing {packing}")
    spark, across, down = df.sparkSession, -(-meta.width // size), -(-meta.height // size)

    def encode(keys: tuple, tile: pa.Table) -> pa.Table:
        r, c = (k.as_py() for k in keys)
        block, n = _block(tile, r, c, size, size, size, nodata)
        body = _body(block, kind, packing) if n else b""
        return pa.table({"tile": pa.array([r * across + c], pa.int64()), "body": pa.array([body], pa.binary())})

    parts = f"{path}.parts"
    tiles = _by_tile(df, meta, value, size).groupBy("tile_row", "tile_col").applyInArrow(encode, "tile long, body binary")
    tiles.where(F.length("body") > 0).write.mode("overwrite").parquet(parts)
    encoded = spark.read.schema("tile long, body binary").parquet(parts)
    held = encoded.select("tile", F.length("body").cast("long").alias("size")).orderBy("tile").toArrow()
    empty = _body(np.full((size, size), 0 if nodata is None else nodata, "f8"), kind, packing)

    fixed = _common(meta, kind, nodata, packing, description) + [(322, 4, (size,)), (323, 4, (size,))]
    head = lambda at, n: _directory([*fixed, (324, 16, tuple(at)), (325, 16, tuple(n))], 16, True)
    blank = [0] * (across * down)
    start = 16 + len(head(blank, blank)[0])  # its length does not depend on the places
    at, n = np.full(across * down, start), np.full(across * down, len(empty))
    sizes, which = held["size"].to_numpy(), held["tile"].to_numpy()
    n[which] = sizes
    at[which] = start + len(empty) + np.cumsum(sizes) - sizes
    listed, places = head(at.tolist(), n.tolist())
    front = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + listed + empty
    system, inner = opened(path)
    draft = f"{inner}.{uuid.uuid4().hex}"
    local = isinstance(system, fs.LocalFileSystem)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(draft, "r+b") as f:
            for batch in batches:
                for tile, body in zip(batch["tile"].to_pylist(), batch["body"], strict=True):
                    f.seek(places[324] + 8 * tile if len(blank) > 1 else places[324])
                    f.seek(struct.unpack("<Q", f.read(8))[0])
                    f.write(body.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["done"])

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(path)[0].open_output_stream(draft) as f:
            f.write(front)
            for batch in batches:
                for body in batch["body"]:
                    f.write(body.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["done"])

    if local:
        with open(draft, "wb") as f:
            f.write(front)
            f.truncate(len(front) + int(sizes.sum()))
        encoded.mapInArrow(place, "done long").count()
    else:
        encoded.repartition(1).sortWithinPartitions("tile").mapInArrow(copy, "done long").count()
    system.move(draft, inner)
    system.delete_dir(opened(parts)[1])


def read_tiles(spark: SparkSession, path: str, size: int = 512) -> DataFrame:
    """``row, col, value`` of all tiles that ``write_tiles`` left below ``path``, numbered in the whole raster.

    ``size`` is the one they were written with. Tasks read a few tiles each,
    one after the other.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in (t for batch in batches for t in batch.to_pylist()):
            reader = _Reader({"path": f"{path}/{tile['file']}"})
            for part in reader.partitions():
                for found in reader.read(part):
                    row = pc.add(found.column(0), pa.scalar(tile["tile_row"] * size, pa.int32()))
                    col = pc.add(found.column(1), pa.scalar(tile["tile_col"] * size, pa.int32()))
                    yield pa.RecordBatch.from_arrays([row, col, found["value"]], names=["row", "col", "value"])

    manifest = spark.read.parquet(f"{path}/manifest")
    tasks = -(-manifest.count() // TILES) or 1
    return manifest.repartition(tasks, "file").mapInArrow(load, "row int, col int, value double")
