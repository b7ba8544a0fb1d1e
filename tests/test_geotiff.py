import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from talusgrid.sources import cube, geotiff
from talusgrid.sources.geotiff import Meta

SMALL = -3.4028234663852886e38


def frame(spark, block):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(block)]
    return spark.createDataFrame(rows, "row int, col int, v double").repartition(3)


def got(df, shape):
    found = np.full(shape, np.nan)
    rows = df.collect()
    assert len(rows) == shape[0] * shape[1]
    for r in rows:
        found[r["row"], r["col"]] = np.nan if r["value"] is None else r["value"]
    return found


def block(height, width, seed=3, high=200):
    rnd = np.random.default_rng(seed)
    out = rnd.integers(0, high, (height, width)).astype("f8")
    out[rnd.random((height, width)) < 0.2] = np.nan
    return out


@pytest.mark.parametrize("kind,nodata", [("u1", 255), ("u2", 65535), ("i2", -1), ("i4", -(2**31)), ("f4", SMALL), ("f4", -9999.0), ("f8", 1e300)])
@pytest.mark.parametrize("packing", ["deflate", "lzw", "none"])
def test_whole_file(spark, tmp_path, kind, nodata, packing):
    geotiff.register(spark)
    want, meta = block(70, 45), Meta(70, 45, 1000.0, 5000.0, 2.5, 2.0, nodata, 2056)
    path = str(tmp_path / "one.tif")
    geotiff.write_raster(frame(spark, want), path, meta, "v", kind, nodata, 32, packing, "risk <1>")
    found = geotiff.read_meta(path)
    assert (found.height, found.width, found.x0, found.y0, found.dx, found.dy, found.epsg) == (70, 45, 1000.0, 5000.0, 2.5, 2.0, 2056)
    assert found.nodata == nodata
    np.testing.assert_array_equal(got(spark.read.format("geotiff").load(path), (70, 45)), want)
    assert not list(tmp_path.glob("one.tif.*"))  # neither parts nor drafts stay


def test_whole_file_by_bytes(spark, tmp_path):
    """Every byte of a small file, put together here from the format's description."""
    path = str(tmp_path / "tiny.tif")
    df = spark.createDataFrame([(0, 0, 7.0), (0, 1, 9.0), (1, 17, 3.0)], "row int, col int, v double")
    geotiff.write_raster(df, path, Meta(2, 18, 10.0, 20.0, 1.0, 1.0, None), "v", "u1", 0, 16, "none", "b")
    said = b'<GDALMetadata><Item name="DESCRIPTION" sample="0" role="description">b</Item></GDALMetadata>\0'
    pad = lambda raw: raw + b"\0" * (-len(raw) % 8)
    n = 16
    beyond = 16 + 8 + 20 * n + 8
    far, entries = b"", b""

    def entry(tag, kind, count, raw):
        nonlocal far, entries
        held = raw.ljust(8, b"\0") if len(raw) <= 8 else struct.pack("<Q", beyond + len(far))
        far += pad(raw) if len(raw) > 8 else b""
        entries += struct.pack("<HHQ", tag, kind, count) + held

    ends = beyond + len(pad(struct.pack("<2Q", 0, 0))) * 2 + 24 + 48 + len(pad(said))
    first = bytearray(256)
    first[0:16] = bytes([7, 2, 256 - 9] + [0] * 13)  # differences along a line
    second = bytearray(256)
    second[16:18] = bytes([0, 3])
    second[18] = 253
    for tag, kind, count, raw in [
        (256, 4, 1, struct.pack("<I", 18)), (257, 4, 1, struct.pack("<I", 2)), (258, 3, 1, struct.pack("<H", 8)),
        (259, 3, 1, struct.pack("<H", 1)), (262, 3, 1, struct.pack("<H", 1)), (277, 3, 1, struct.pack("<H", 1)),
        (317, 3, 1, struct.pack("<H", 2)), (322, 4, 1, struct.pack("<I", 16)), (323, 4, 1, struct.pack("<I", 16)),
        (324, 16, 2, struct.pack("<2Q", ends + 256, ends + 512)), (325, 16, 2, struct.pack("<2Q", 256, 256)), (339, 3, 1, struct.pack("<H", 1)),
        (33550, 12, 3, struct.pack("<3d", 1, 1, 0)), (33922, 12, 6, struct.pack("<6d", 0, 0, 0, 10, 20, 0)), (42112, 2, len(said), said),
        (42113, 2, 2, b"0\0"),
    ]:
        entry(tag, kind, count, raw)
    head = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16)
    want = head + struct.pack("<Q", n) + entries + b"\0" * 8 + far + bytes(256) + bytes(first) + bytes(second)
    assert (tmp_path / "tiny.tif").read_bytes() == want


def test_lzw_as_published():
    """The example of the format's description: 7 7 7 8 8 7 7 6 6 becomes nine codes of nine bits."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    number = int("".join(f"{c:09b}" for c in codes).ljust(88, "0"), 2)
    assert geotiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == number.to_bytes(11, "big")


@pytest.mark.parametrize("size", [0, 1, 253, 254, 255, 510, 4000, 70_000])
def test_lzw_round_trip(size):
    rnd = np.random.default_rng(size)
    for high in (2, 256):
        raw = rnd.integers(0, high, size).astype("u1").tobytes()
        assert geotiff._unlzw(geotiff.lzw(raw)) == raw


def test_tiles_without_values_come_back(spark, tmp_path):
    want = block(8, 8)
    want[0:4, 4:8] = np.nan
    df = frame(spark, want).where("v is not null")  # absent pixels, not null ones
    path = str(tmp_path / "tiles")
    manifest = geotiff.write_tiles(df, path, Meta(8, 8), "v", "f4", SMALL, 4)
    assert {(r["tile_row"], r["tile_col"]): r["n_valid"] for r in manifest.collect()}[0, 1] == 0
    np.testing.assert_array_equal(got(geotiff.read_tiles(spark, path, 4), (8, 8)), want)
    geotiff.write_raster(df, f"{path}.tif", Meta(8, 8), "v", "f4", SMALL, 16)
    geotiff.register(spark)
    np.testing.assert_array_equal(got(spark.read.format("geotiff").load(f"{path}.tif"), (8, 8)), want)
    geotiff.write_raster(df.where("false"), f"{path}0.tif", Meta(8, 40), "v", "i2", -1, 16)
    assert np.isnan(got(spark.read.format("geotiff").load(f"{path}0.tif"), (8, 40))).all()


def test_conditions_decide_which_blocks_are_read(spark, tmp_path, monkeypatch):
    geotiff.register(spark)
    want, path = block(96, 96), str(tmp_path / "w.tif")
    geotiff.write_raster(frame(spark, want), path, Meta(96, 96), "v", "f4", -1.0, 16)
    df = spark.read.format("geotiff").load(path).where("row >= 20 and row < 40 and col > 60 and value is not null")
    found = {(r["row"], r["col"]): r["value"] for r in df.collect()}
    assert found == {(r, c): want[r, c] for r in range(20, 40) for c in range(61, 96) if not np.isnan(want[r, c])}
    both = spark.read.format("geotiff").load(path).where("col in (3, 5) and row = 7").collect()
    assert sorted((r["row"], r["col"]) for r in both) == [(7, 3), (7, 5)]
    assert spark.read.format("geotiff").load(path).where("row < 0").collect() == []
    # the window that is left, by the reader itself: 2 of 6 lines of blocks, 3 of 6 columns
    decoded = []
    real = geotiff._decode
    monkeypatch.setattr(geotiff, "_decode", lambda *a: decoded.append(1) or real(*a))
    reader = geotiff._Reader({"path": path})
    rest = list(reader.pushFilters([geotiff.GreaterThanOrEqual(("row",), 20), geotiff.LessThan(("row",), 40), geotiff.GreaterThan(("col",), 60), geotiff.EqualTo(("value",), 3.0)]))
    assert rest == [geotiff.EqualTo(("value",), 3.0)] and reader.window == [20, 40, 61, 96]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 20 * 35
    assert len(decoded) == 2 * 3


def rasters(spark, folder, height=70, width=50):
    made, paths = {}, {}
    for k, (kind, nodata, size, packing) in enumerate([("f4", SMALL, 32, "deflate"), ("u2", 65535, 16, "lzw"), ("f8", -9999.0, 64, "none")]):
        made[f"f{k}"], paths[f"f{k}"] = block(height, width, k), f"{folder}/f{k}.tif"
        geotiff.write_raster(frame(spark, made[f"f{k}"]), paths[f"f{k}"], Meta(height, width, nodata=nodata), "v", kind, nodata, size, packing)
    strip = block(height, width, 9)
    strip[3, 4] = np.inf
    made["strip"], paths["strip"] = strip, f"{folder}/strip.tif"
    with open(paths["strip"], "wb") as f:
        f.write(geotiff._encode(np.where(np.isnan(strip), -7.5, strip), "f4", Meta(height, width, nodata=-7.5), -7.5))
    return made, paths


def test_feature_cube(spark, tmp_path, monkeypatch):
    made, paths = rasters(spark, tmp_path)
    monkeypatch.setattr(cube, "BATCH_VALUES", 500)
    df = cube.feature_cube(spark, paths)
    assert df.columns == ["row", "col", *paths]
    rows = df.collect()
    assert len(rows) == 70 * 50
    for name, want in made.items():
        found = np.full(want.shape, np.nan)
        for r in rows:
            found[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
        np.testing.assert_array_equal(found, want)
    valid = np.all([np.isfinite(w) for w in made.values()], axis=0)
    kept = {(r["row"], r["col"]) for r in cube.feature_cube(spark, paths, only_valid=True).collect()}
    assert kept == set(zip(*(x.tolist() for x in np.nonzero(valid)), strict=True))
    mask = {(r["row"], r["col"]): r["valid"] for r in cube.valid_mask(spark, paths).collect()}
    assert mask == {(r, c): bool(v) for (r, c), v in np.ndenumerate(valid)}
    part = cube.feature_cube(spark, {k: paths[k] for k in ("f1", "strip")}, window=(10, 40, 30, 99)).where("row < 25").collect()
    assert {(r["row"], r["col"]) for r in part} == {(r, c) for r in range(10, 25) for c in range(40, 50)}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_feature_cube_names_what_is_wrong(spark, tmp_path):
    _, paths = rasters(spark, tmp_path, 20, 20)
    with pytest.raises(FileNotFoundError, match="slope.*gone.tif"):
        cube.feature_cube(spark, paths | {"slope": f"{tmp_path}/gone.tif"})
    geotiff.write_raster(frame(spark, block(20, 21)), f"{tmp_path}/other.tif", Meta(20, 21), "v", size=16)
    with pytest.raises(ValueError, match="other has 20 x 21"):
        cube.feature_cube(spark, paths | {"other": f"{tmp_path}/other.tif"})
    with pytest.raises(ValueError, match="f0 has 20 x 20 pixels, not 5 x 5"):
        cube.valid_mask(spark, paths, (5, 5))
    with pytest.raises(ValueError):
        cube.feature_cube(spark, {})
    with pytest.raises(ValueError):
        geotiff.write_raster(frame(spark, block(2, 2)), f"{tmp_path}/x.tif", Meta(2, 2), "v", size=100)


def test_missing_values_of_small_files(tmp_path):
    want = np.array([[SMALL, 1.5], [2.5, SMALL]], "f4")
    (tmp_path / "s.tif").write_bytes(geotiff._encode(want, "f4", Meta(2, 2), SMALL))
    reader = geotiff._Reader({"path": str(tmp_path / "s.tif")})
    (batch,) = [b for p in reader.partitions() for b in reader.read(p)]
    assert batch["value"].to_pylist() == [None, 1.5, 2.5, None]
