"""Scoring that goes on after a stop, sample rasters and sweeps."""

import math

import pytest
from pyspark.sql import functions as F

from talusgrid.operators import model, scoring, sweep
from talusgrid.sources import geotiff


@pytest.fixture
def pixels(spark):
    cells = spark.range(40 * 12).select((F.col("id") / 12).cast("int").alias("row"), (F.col("id") % 12).cast("int").alias("col"))
    return cells.withColumn("z", F.when(F.col("col") != 3, (F.col("row") * 12 + F.col("col")) / 480.0))


def test_a_stopped_run_goes_on(pixels, tmp_path):
    spark, calls = pixels.sparkSession, []

    def score(part):
        calls.append(sorted({r.row // 16 for r in part.select("row").collect()}))
        return part.where("z is not null").select("row", "col", F.col("z").alias("risk"))

    def breaks(part):
        return score(part).withColumn("risk", F.when(F.col("row") < 16, F.col("risk")).otherwise(F.raise_error(F.lit("lost"))))

    path = str(tmp_path / "run")
    with pytest.raises(Exception, match="lost"):
        scoring.score_tiles(pixels, breaks, path, 8, 2)
    assert calls == [[0], [1]]
    assert scoring.scores(spark, path).count() == 16 * 12  # the half-written band isn't there
    assert scoring.score_tiles(pixels, score, path, 8, 2, most=1).select("band").distinct().count() == 2
    found = scoring.score_tiles(pixels, score, path, 8, 2)
    assert calls == [[0], [1], [1], [2]]
    assert scoring.score_tiles(pixels, score, path, 8, 2).count() == found.count() == 10 and len(calls) == 4
    got = {(r.row, r.col): r.risk for r in scoring.scores(spark, path).collect()}
    assert got == {(r.row, r.col): r.z for r in pixels.collect()}
    tile = found.where("tile_row = 1 and tile_col = 0").first()
    inside = [v for (r, c), v in got.items() if r // 8 == 1 and c // 8 == 0 and v is not None]
    assert (tile.n_pixels, tile.n_scored, tile.risk_min, tile.risk_max) == (64, 56, min(inside), max(inside))
    whole = scoring.summary(found).first()
    known = [v for v in got.values() if v is not None]
    assert (whole.n_tiles, whole.n_pixels, whole.n_scored) == (10, 480, 440) and math.isclose(whole.risk_mean, sum(known) / 440)
    with pytest.raises(ValueError, match="tiles of 8"):
        scoring.score_tiles(pixels, score, path, 16, 2)


def test_many_bands_take_few_jobs(pixels, tmp_path):
    """Bands of one row: the calls of ``score`` don't grow with them, and a stop in a run leaves none of it."""
    spark, calls, path = pixels.sparkSession, [], str(tmp_path / "many")

    def score(part, fails=-1):
        calls.append({r.row for r in part.select("row").distinct().collect()})
        risk = F.when(F.col("row") != fails, F.col("z")).otherwise(F.raise_error(F.lit("lost")))
        return part.select("row", "col", risk.alias("risk"))

    assert scoring.score_tiles(pixels, score, path, 1, most=1).select("band").distinct().count() == 1
    with pytest.raises(Exception, match="lost"):
        scoring.score_tiles(pixels, lambda part: score(part, 20), path, 1)
    kept = {r.band for r in scoring.manifest(spark, path).select("band").distinct().collect()}
    assert kept == set(range(max(kept) + 1)) and max(kept) < 20
    begun = len(calls)
    found = scoring.score_tiles(pixels, score, path, 1)
    assert len(calls) - begun <= scoring.JOBS and set().union(*calls[begun:]) == set(range(40)) - kept
    assert sorted((r.band, r.tile_row, r.tile_col) for r in found.collect()) == [(r, r, c) for r in range(40) for c in range(12)]
    assert {(r.row, r.col): r.risk for r in scoring.scores(spark, path).collect()} == {(r.row, r.col): r.z for r in pixels.collect()}


def test_no_pixels(pixels, tmp_path):
    none = scoring.score_tiles(pixels.limit(0), lambda p: p.select("row", "col", F.col("z").alias("risk")), str(tmp_path / "e"))
    assert none.count() == 0
    one = scoring.summary(none).first()
    assert (one.n_tiles, one.n_pixels, one.risk_mean) == (0, 0, None)


def test_sample_rasters(spark, tmp_path):
    rows = [(0, 0, 0, 1), (0, 9, 7, 0), (2, 4, 4, 1)]
    samples = spark.createDataFrame(rows, "fold int, row int, col int, label int")
    place = geotiff.Meta(10, 8, 0.0, 0.0, 1.0, 1.0, -9999.0, 2056)
    paths = scoring.write_samples(samples, str(tmp_path), place, side=16)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["fold_labels_samples_fold0.tif", "fold_labels_samples_fold2.tif"]
    geotiff.register(spark)
    for path, fold in zip(paths, (0, 2), strict=True):
        got = spark.read.format("geotiff").load(path).collect()
        assert len(got) == 80
        assert {(r.row, r.col, r.value) for r in got if r.value is not None} == {(r, c, float(v)) for f, r, c, v in rows if f == fold}


SMALL = {"depth": (1, 2, 3, 4), "trees": (5, 10, 20), "max_features": ("sqrt", "all")}


def worth(s):
    return -((s["depth"] - 3) ** 2) - abs(s["trees"] - 10) / 10 + (s["max_features"] == "all") / 2


def test_ways_find_the_best(spark, tmp_path):
    best = max(map(worth, sweep.settings(SMALL)))
    for way, cap in (("grid", 24), ("random", 24), ("bayes", 14)):
        tried = []
        found = sweep.sweep(spark, str(tmp_path / way), SMALL, lambda s: tried.append(s) or worth(s), way, cap)  # noqa: B023
        rows = found.collect()
        assert len(rows) == len(tried) == len({r.settings for r in rows}) == cap
        assert rows[0].value == best and sorted(r.trial for r in rows) == list(range(cap))


def test_a_sweep_goes_on_and_bears_trials_without_a_value(spark, tmp_path):
    path, tried = str(tmp_path / "s"), []

    def trial(s):
        tried.append(sweep._name(s))
        return None if s["depth"] == 2 else math.nan if s["depth"] == 4 else worth(s)

    assert sweep.sweep(spark, path, SMALL, trial, "bayes", 6).count() == 6
    rows = sweep.sweep(spark, path, SMALL, trial, "bayes", 24).collect()
    assert len(rows) == len(tried) == len(set(tried)) == 24
    assert rows[0].value is not None and rows[-1].value is None
    for wrong in ({}, {"a": ()}):
        with pytest.raises(ValueError):
            sweep.sweep(spark, path, wrong, trial)
    with pytest.raises(ValueError):
        sweep.sweep(spark, path, SMALL, trial, "guess")


def test_trials_are_cross_validated(spark, tmp_path):
    df = spark.range(300).select(
        F.col("id").cast("int"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") * 7 % 31).cast("double").alias("x"),
        (F.col("id") * 7 % 31 > 22).cast("int").alias("label"),
    )
    trial = sweep.cv_trial(df, ["x"], "id", model.Config(method="plain", trees=3))
    rows = sweep.sweep(spark, str(tmp_path / "cv"), {"depth": (1, 3)}, trial, "grid").collect()
    scored, _ = model.cross_validate(df, ["x"], model.Config(method="plain", trees=3, depth=3))
    want = model.cv_summary(model.cv_metrics(scored, "id")).first().auc_mean
    assert {r.settings: r.value for r in rows}['{"depth": 3}'] == pytest.approx(want)
