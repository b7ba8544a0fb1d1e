"""Rigorous coordinates: published points, ways there and back, and a raster of another system."""

import pytest
from pyspark.sql import functions as F

from talusgrid.functions import geodesy, projection
from talusgrid.functions.projection import LV03, LV95, WGS84
from talusgrid.operators import raster

UTM32, UTM33S = "EPSG:32632", "EPSG:32733"


def moved(spark, points, source, target):
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, x double, y double")
    return [(r.x, r.y) for r in geodesy.transform(df, "x", "y", source, target).orderBy("k").collect()]


def test_published_points(spark):
    # Rigi in the published worked example: angles on Bessel's ellipsoid, then the plane
    deg = [(8 + 29 / 60 + 11.111272154 / 3600, 47 + 3 / 60 + 28.95659233 / 3600)]
    df = spark.createDataFrame(deg, "lon double, lat double").select(F.radians("lon").alias("_lon"), F.radians("lat").alias("_lat"))
    (r,) = geodesy._angles_to_swiss(df).collect()
    assert abs(r._x - 2679520.05) < 0.01 and abs(r._y - 1212273.44) < 0.01
    back = geodesy._swiss_to_angles(spark.createDataFrame([(2679520.05, 1212273.44)], "_x double, _y double")).select(F.degrees("_lon"), F.degrees("_lat")).first()
    assert abs(back[0] - deg[0][0]) < 1e-7 and abs(back[1] - deg[0][1]) < 1e-7
    # the central meridian of a UTM zone: the arc of 45 degrees, scaled
    assert moved(spark, [(9.0, 45.0)], WGS84, UTM32)[0] == pytest.approx((500000.0, 4982950.400), abs=1e-3)
    assert moved(spark, [(9.0, 0.0)], WGS84, UTM32)[0] == pytest.approx((500000.0, 0.0), abs=1e-6)
    assert geodesy.SWISS["r"] == pytest.approx(6378815.90365, abs=1e-5) and geodesy.SWISS["alpha"] == pytest.approx(1.00072913843038, abs=1e-13)
    assert geodesy.SWISS["k"] == pytest.approx(0.0030667323772751, abs=1e-12)


PLACES = [(2_485_000.0 + 30_000 * k, 1_080_000.0 + 17_000 * (k * 5 % 11)) for k in range(11)]


@pytest.mark.parametrize("other", [WGS84, LV03, UTM32])
def test_there_and_back(spark, other):
    there = moved(spark, PLACES, LV95, other)
    back = moved(spark, there, other, LV95)
    for (x, y), (u, v) in zip(PLACES, back, strict=True):
        assert abs(x - u) < 2e-3 and abs(y - v) < 2e-3  # both ways start at height 0, though the datums' heights differ
    if other == WGS84:  # the polynomials are good to about a metre
        df = spark.createDataFrame([(k, *p) for k, p in enumerate(there)], "k int, x double, y double").orderBy("k")
        e, n = projection.reproject(F.col("x"), F.col("y"), WGS84)
        for (x, y), r in zip(PLACES, df.select(e.alias("e"), n.alias("n")).collect(), strict=True):
            assert abs(x - r.e) < 2 and abs(y - r.n) < 2


def test_other_zones_and_edges(spark):
    points = [(15.0 + d, -30.0 - d) for d in (-2.5, 0.0, 1.25)]
    for (x, y), (u, v) in zip(points, moved(spark, moved(spark, points, WGS84, UTM33S), UTM33S, WGS84), strict=True):
        assert abs(x - u) < 1e-8 and abs(y - v) < 1e-8
    assert moved(spark, [(None, 1.0)], LV95, WGS84)[0][0] is None
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert geodesy.transform(df, "x", "y", LV95, LV95) is df
    for source, target in ((None, LV95), ("EPSG:3857", LV95), (LV95, "EPSG:32661")):
        with pytest.raises(ValueError):
            geodesy.transform(df, "x", "y", source, target)


def test_warp(spark):
    cells = spark.range(20 * 30).select((F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col"))
    source = cells.withColumn("v", F.col("row") * 100 + F.col("col"))
    origin = {"x0": 2_600_000.0, "y0": 1_200_000.0, "dx": 25.0, "dy": 25.0}
    west, north = moved(spark, [(2_600_000.0, 1_200_000.0)], LV95, WGS84)[0]
    target = {"x0": west - 0.0005, "y0": north + 0.0005, "dx": 0.0004, "dy": 0.0003}
    got = {(r.row, r.col): r.v for r in raster.warp_nearest(cells, source, "v", target, origin, WGS84, LV95).collect()}
    centres = [(target["x0"] + (c + 0.5) * target["dx"], target["y0"] - (r + 0.5) * target["dy"]) for r in range(20) for c in range(30)]
    for k, (x, y) in enumerate(moved(spark, centres, WGS84, LV95)):
        r, c = int((1_200_000 - y) // 25), int((x - 2_600_000) // 25)
        assert got[divmod(k, 30)] == (r * 100 + c if 0 <= r < 20 and 0 <= c < 30 else None)
    assert None in got.values() and len(set(got.values())) > 100
    with pytest.raises(ValueError):
        raster.warp_nearest(cells, source, "v", target, origin, WGS84, None)
