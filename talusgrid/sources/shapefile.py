"""Shapefiles as rows: ``spark.read.format("shapefile").load("lines.shp")``.

Columns are ``shape_id`` (from 0), ``kind``, ``parts`` (``ARRAY<ARRAY<STRUCT<x, y>>>``,
rings of polygons or lines, null for a null shape) and the attributes. The
index file tells where records lie, so partitions read disjoint byte ranges.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .geotiff import opened

#: Fixed values of the shapefile format; heights and measures are not read.
KIND = {0: "null", 1: "point", 3: "line", 5: "polygon", 8: "points", 11: "point", 13: "line", 15: "polygon", 18: "points", 21: "point", 23: "line", 25: "polygon", 28: "points"}
#: Records of a partition.
EACH = 20_000


def _read(path: str, start: int = 0, length: int | None = None) -> bytes:
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        f.seek(start)
        return f.read() if length is None else f.read(length)


def _fields(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, length of the head and of a record, and ``(name, type, width, decimals)``."""
    n, head, each = struct.unpack("<IHH", _read(path, 4, 8))
    raw = _read(path, 32, head - 32)
    fields = []
    for at in range(0, len(raw) - 31, 32):
        if raw[at] == 0x0D:
            break
        name = raw[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
    return n, head, each, fields


def _type(kind: str, decimals: int) -> str:
    if kind in "NF":
        return "double" if decimals or kind == "F" else "long"
    return "boolean" if kind == "L" else "string"


def _value(raw: bytes, kind: str, encoding: str):
    text = raw.decode(encoding, "replace").strip(" \0")
    if not text or set(text) == {"*"}:
        return None
    if kind == "boolean":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return {"long": int, "double": float}.get(kind, str)(text)


def _shape(raw: bytes) -> tuple[str, list | None]:
    (code,) = struct.unpack_from("<i", raw)
    kind = KIND[code]
    if kind == "null":
        return kind, None
    if kind == "point":
        x, y = struct.unpack_from("<2d", raw, 4)
        return kind, [[(x, y)]]
    if kind == "points":
        (n,) = struct.unpack_from("<i", raw, 36)
        starts, at = [0], 40
    else:
        parts, n = struct.unpack_from("<2i", raw, 36)
        starts, at = list(struct.unpack_from(f"<{parts}i", raw, 44)), 44 + 4 * parts
    xy = np.frombuffer(raw, "<f8", 2 * n, at).reshape(n, 2).tolist()
    return kind, [[tuple(p) for p in xy[a:b]] for a, b in zip(starts, [*starts[1:], n], strict=True)]


class _Records(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options["path"].removesuffix(".shp")
        self.encoding = options.get("encoding", "utf-8")

    def partitions(self) -> list[InputPartition]:
        n = _fields(self.base + ".dbf")[0]
        return [_Records(at, min(at + EACH, n)) for at in range(0, n, EACH)] or [_Records(0, 0)]

    def read(self, partition: _Records) -> Iterator[tuple]:
        count = partition.last - partition.first
        index = np.frombuffer(_read(self.base + ".shx", 100 + 8 * partition.first, 8 * count), ">i4").reshape(-1, 2)
        if not len(index):
            return
        start = 2 * int(index[0, 0])
        body = _read(self.base + ".shp", start, 2 * int(index[-1].sum()) + 8 - start)
        _, head, each, fields = _fields(self.base + ".dbf")
        table = _read(self.base + ".dbf", head + each * partition.first, each * count)
        for k, (at, size) in enumerate(index.tolist()):
            record = table[k * each : (k + 1) * each]
            if record[:1] == b"*":  # deleted
                continue
            place = 2 * at - start + 8
            values, left = [], 1
            for _, kind, width, decimals in fields:
                values.append(_value(record[left : left + width], _type(kind, decimals), self.encoding))
                left += width
            yield (partition.first + k, *_shape(body[place : place + 2 * size]), *values)


class ShapefileSource(DataSource):
    """Options: ``path`` and ``encoding`` of the attributes (UTF-8 by default)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        fields = _fields(self.options["path"].removesuffix(".shp") + ".dbf")[3]
        own = "".join(f", `{name}` {_type(kind, decimals)}" for name, kind, _, decimals in fields)
        return "shape_id long, kind string, parts array<array<struct<x:double,y:double>>>" + own

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)
