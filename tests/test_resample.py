"""Resampling takes the whole raster as its source."""

from talusgrid.plans import registry

SF = "/root/testdata/sf0.01"


def test_every_pixel_has_its_source(spark):
    z = {(r.row, r.col): r.z for r in registry.lift(spark, SF).collect()}
    got = {(r.row, r.col): r.v for r in registry.QUERIES["resample_nearest_whole"](spark, SF).collect()}
    assert got.keys() == z.keys() and max(row for row, _ in z) >= 120
    for (row, col), v in got.items():
        want = z.get((row // 3, col // 3))
        assert (v is None) == (want is None) and (v is None or abs(v - float(want)) < 1e-6)
    cut = registry.QUERIES["resample_nearest"](spark, SF).where("v is not null").count()
    whole = sum(v is not None for v in got.values())
    print("not null", cut, whole, len(got))
    assert whole > cut
