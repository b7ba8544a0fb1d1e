"""Readers and writers of rasters and shapes, and polygons on a grid."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talusgrid.operators import polygons
from talusgrid.sources import geotiff, shapefile


def pixels(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("kind,nodata", [("f4", -9999.0), ("u2", 65535.0), ("i2", -1.0), ("f8", -9999.0)])
def test_tiles_round_trip(spark, tmp_path, kind, nodata):
    geotiff.register(spark)
    want = {(r, c): None if (r * 7 + c) % 11 == 0 else float((r * 31 + c * 17) % 900) for r in range(50) for c in range(70)}
    df = spark.createDataFrame([(*k, v) for k, v in want.items()], "row int, col int, value double")
    meta = geotiff.Meta(50, 70, 1000.0, 5000.0, 2.0, 2.0, nodata, 2056)
    manifest = geotiff.write_tiles(df, str(tmp_path / "out"), meta, kind=kind, nodata=nodata, size=32)
    got = {}
    for t in manifest.collect():
        path = str(tmp_path / "out" / t["file"])
        found = geotiff.read_meta(path)
        assert (found.x0, found.y0) == (1000.0 + 64 * t["tile_col"], 5000.0 - 64 * t["tile_row"])
        assert (found.epsg, found.nodata, found.dx) == (2056, nodata, 2.0)
        part = pixels(spark.read.format("geotiff").load(path))
        got |= {(r + 32 * t["tile_row"], c + 32 * t["tile_col"]): v for (r, c), v in part.items()}
    assert got == want


def test_window_reads_only_its_pixels(spark, tmp_path):
    geotiff.register(spark)
    block = np.arange(40 * 30, dtype="f8").reshape(40, 30)
    path = tmp_path / "whole.tif"
    path.write_bytes(geotiff._encode(block, "f4", geotiff.Meta(40, 30), None))
    got = pixels(spark.read.format("geotiff").option("window", "5,7,4,3").load(str(path)))
    assert got == {(r, c): block[r, c] for r in range(5, 9) for c in range(7, 10)}
    with pytest.raises(ValueError):
        (tmp_path / "bad.tif").write_bytes(b"no raster at all")
        geotiff.read_meta(str(tmp_path / "bad.tif"))


def lzw(data):
    """A plain encoder, to test the decoder with."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    words, word, width = {bytes([k]): k for k in range(256)}, b"", 9
    size = 258
    put(256, 9)
    for k in data:
        longer = word + bytes([k])
        if longer in words:
            word = longer
            continue
        put(words[word], width)
        words[longer], size = size, size + 1
        width = max(9, min(12, size.bit_length()))
        if size >= 4094:
            put(256, width)
            words, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = bytes([k])
    put(words[word], width)
    put(257, width)
    put(0, 7)
    return bytes(out)


def test_unlzw():
    for seed in range(4):
        data = bytes(random.Random(seed).choices(range(1 + 60 * seed), k=30_000))
        assert geotiff._unlzw(lzw(data)) == data


def test_float_predictor():
    want = np.random.default_rng(1).normal(size=(6, 9)).astype("f4")
    planes = want.astype(">f4").view("u1").reshape(6, 9, 4).transpose(0, 2, 1).reshape(6, 36)
    raw = zlib.compress(np.diff(planes, axis=1, prepend=np.zeros((6, 1), "u1")).astype("u1").tobytes())
    tags = {259: (8,), 317: (3,), 339: (3,), 258: (32,), 277: (1,)}
    assert (geotiff._decode(raw, "<", tags, 6, 9) == want).all()


def shape_files(base, shapes):
    """``shapes``: (type code, rings or None, name, number)."""
    body, index, rows = b"", b"", b""
    for k, (code, rings, name, number) in enumerate(shapes):
        raw = struct.pack("<i", code)
        if rings:
            points = [p for r in rings for p in r]
            starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
            raw += struct.pack("<4d2i", 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts)
            raw += b"".join(struct.pack("<2d", *p) for p in points)
        index += struct.pack(">2i", (100 + len(body)) // 2, len(raw) // 2)
        body += struct.pack(">2i", k + 1, len(raw) // 2) + raw
        rows += b" " + name.encode().ljust(10) + number.rjust(6).encode()
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2).ljust(100, b"\0")
    base.with_suffix(".shp").write_bytes(head + body)
    base.with_suffix(".shx").write_bytes(head + index)
    fields = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    fields += b"number".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    dbf = struct.pack("<4BIHH", 3, 124, 1, 1, len(shapes), 32 + len(fields) + 1, 17).ljust(32, b"\0")
    base.with_suffix(".dbf").write_bytes(dbf + fields + b"\r" + rows)


def test_shapefile(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shapefile, "EACH", 2)
    shapefile.register(spark)
    rings = [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 2.0), (2.0, 3.0), (1.0, 3.0)]]
    shape_files(tmp_path / "a", [(5, rings, "one", "7"), (0, None, "", ""), (3, rings[:1], "Zürich", "-3")])
    got = spark.read.format("shapefile").load(str(tmp_path / "a.shp")).orderBy("shape_id").collect()
    assert [(r["kind"], r["name"], r["number"]) for r in got] == [("polygon", "one", 7), ("null", None, None), ("line", "Zürich", -3)]
    assert [[tuple(p) for p in ring] for ring in got[0]["parts"]] == rings
    assert got[1]["parts"] is None


def inside(x, y, rings):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x:
                n += 1
    return n % 2 == 1


def test_cover_against_every_pixel(spark):
    rnd = random.Random(5)
    shapes = {k: [[(rnd.uniform(-5, 35), rnd.uniform(-5, 25)) for _ in range(rnd.randint(3, 8))] for _ in range(2)] for k in range(12)}
    shapes[12] = [[(2.0, 2.0), (9.0, 2.0), (9.0, 8.0), (2.0, 8.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]]
    shapes |= {13: [], 14: None, 15: [[(1.0, 1.0)]]}
    df = spark.createDataFrame(list(shapes.items()), "k int, rings array<array<struct<x:double,y:double>>>")
    got = [tuple(r) for r in polygons.cover(df, "k", 20, 30).select("k", "row", "col").collect()]
    want = {(k, r, c) for k, s in shapes.items() for r in range(20) for c in range(30) if s and inside(c + 0.5, r + 0.5, s)}
    assert len(got) == len(set(got)) and set(got) == want
    touched = {tuple(r) for r in polygons.cover(df, "k", 20, 30, touched=True).select("k", "row", "col").collect()}
    assert want <= touched
    # every point of an edge lies in a pixel that counts as touched
    for k, s in shapes.items():
        for ring in s or []:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                for t in np.linspace(0.001, 0.999, 40) if (x1, y1) != (x2, y2) else ():
                    x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
                    if 0 <= x < 30 and 0 <= y < 20:
                        assert (k, int(y), int(x)) in touched


def test_burn_takes_the_last_shape(spark):
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]]
    df = spark.createDataFrame([(1, 5, square), (2, 8, [[(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]])], "k int, fold int, rings array<array<struct<x:double,y:double>>>")
    grid = spark.range(16).select(F.expr("int(id div 4)").alias("row"), (F.col("id") % 4).cast("int").alias("col"))
    got = {(r["row"], r["col"]): r["fold"] for r in polygons.burn(grid, df, "k", "fold", "k", 4, 4, touched=False).collect()}
    assert got == {(r, c): 8 if r in (1, 2) and c in (1, 2) else 5 if r < 2 and c < 2 else -1 for r in range(4) for c in range(4)}
