"""Cases that the tables don't have: edges, errors, and models against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talusgrid.functions import projection
from talusgrid.operators import events, features, forest, grid, model, ranking, raster, sampling
from talusgrid.plans import registry


def test_cells_of_events(spark):
    cells = [None, "", "nan", "None", "A;;B", " A ; A ", "  ", "\tC\n;D"]
    df = spark.createDataFrame([(k, c, "Z") for k, c in enumerate(cells)], "k int, a string, b string")
    got = {r.k: r.e for r in df.select("k", events.checked_events("a", "b").alias("e")).collect()}
    want = [[], [], [], [], ["A", "B"], ["A", "A"], [], ["C", "D"]]
    assert got == {k: [*w, "Z"] for k, w in enumerate(want)}
    odd = spark.createDataFrame([(" nan ",)], "a string")
    with pytest.raises(Exception, match="can't be counted"):
        odd.select(events.checked_events("a")).collect()


LINES = "k int, e string, parts array<array<struct<x:double,y:double>>>"


def test_geometries_are_merged_in_order(spark):
    one, two = [(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 7.0), (8.0, 8.0)]
    rows = [(0, "b;a", [one]), (1, "a;c", [one[::-1]]), (2, "d", [one, two]), (3, "d", [two[::-1], one]), (4, None, [two])]
    got = events.preprocess_geometries(spark.createDataFrame(rows, LINES).repartition(3), ["e"], "parts", "k")
    found = sorted((r.events, r.n_rows, len(r.geometry)) for r in got.collect())
    assert found == [([], 1, 1), (["b", "a", "c"], 2, 1), (["d"], 2, 2)]
    assert all(len(r.geom_uuid) == 36 for r in got.collect())
    for missing in (None, []):
        with pytest.raises(Exception, match="row 7 has no geometry"):
            events.preprocess_geometries(spark.createDataFrame([(7, "a", missing)], LINES), ["e"], "parts", "k").collect()
    report = events.duplicate_report(spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "a", "a"]), (None, ["a"]), (None, ["b"]), (2, [])], "k int, e array<string>"), "k", "e")
    assert {(r.k, r.n_rows, r.identical) for r in report.collect()} == {(1, 2, True), (None, 2, False)}


def test_events_and_their_lines(spark):
    line = [(0.0, 0.0), (1.0, 1.0)]
    geoms = spark.createDataFrame([(1, ["7", "8", "7"], [line]), (2, ["8"], [line, line]), (3, [], [line])], "g int, ev array<string>, parts array<array<struct<x:double,y:double>>>")
    people = spark.createDataFrame([("7", "x"), ("8", "y"), ("9", "z"), ("7", "again")], "pk string, other string")
    got = events.append_geometries(people, geoms, "pk", "g", "ev", "parts")
    found = {(r.pk, r.other): (r.n_geometries, r.geometry_type, len(r.geometry or [])) for r in got.collect()}
    assert found == {("7", "x"): (1, "LineString", 1), ("7", "again"): (1, "LineString", 1), ("8", "y"): (2, "MultiLineString", 3), ("9", "z"): (0, None, 0)}
    assert events.geometry_statistics(got).first().asDict() == {"n_events": 4, "without": 1, "with_one": 2, "with_more": 1, "most": 2}


def test_feature_sets_by_sigma():
    zonal = features.Feature("slope", 3, "std", 3)
    assert not features.in_set(zonal, 25) and features.in_set(features.Feature("slope", 1, "std", 3), 25)
    assert features.in_set(features.Feature("elevation", 5), 9) and not features.in_set(features.Feature("elevation", 5), 8)
    assert not features.in_set(features.Feature("elevation", 0), 3) and features.in_set(features.Feature("elevation", 0, "std", 3), 4)
    for k in (0, 31):
        with pytest.raises(ValueError):
            features.feature_set([], k)


def test_missing_features_are_named(spark):
    every = features.standard_features()
    df = spark.range(1).select(F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit(1.0).alias("slope_sigma1"))
    assert features.select_set(df, every, 13).columns == ["row", "col", "slope_sigma1"]
    with pytest.raises(ValueError, match="slope_break_index_sigma1"):
        features.select_set(df, every, 14)


def plain_ranks(rows):
    out = []
    for fold in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == fold and r[1] is not None and math.isfinite(r[1])), key=lambda r: (-r[1], r[3]))
        hits = 0
        for i, r in enumerate(own, 1):
            hits += r[2]
            out.append((fold, i, int(r[2]), len(own), hits, sum(x[2] for x in own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["spread", "one score", "few scores", "no positives"])
def test_ranks_over_slices(spark, kind, monkeypatch):
    monkeypatch.setattr(ranking, "SLICES", 5)
    rng = random.Random(kind)
    score = {"one score": lambda: 0.5, "few scores": lambda: rng.choice([0.0, -0.0, 0.1, 0.9])}.get(kind, rng.random)
    rows = [(rng.choice([None, 1, 2]), score(), kind != "no positives" and rng.random() < 0.3, k) for k in range(400)]
    rows += [(1, float("nan"), True, 900), (2, None, True, 901), (2, float("inf"), True, 902), (3, 0.2, True, 903)]
    df = spark.createDataFrame(rows, "fold int, score double, label boolean, id long").repartition(4)
    got = ranking.ranked(df, "score", "label", "id").collect()
    assert sorted([(r.fold, r.i, r.y, r.n, r.hits, r.total) for r in got], key=repr) == plain_ranks(rows)
    curve = ranking.success_rate_curve(df, "score", "label", "id").collect()
    assert all(r.detected_positives_pct == 0 for r in curve) == (kind == "no positives" and not any(r.fold == 3 for r in curve)) or kind != "no positives"


def test_curves_of_folds_smaller_than_a_share(spark):
    df = spark.createDataFrame([(1, 0.5, True, 1), (2, 0.5, True, 1), (2, 0.4, False, 2), (2, 0.3, True, 3)], "fold int, score double, label boolean, id long")
    got = {r.fold: r for r in model.cv_metrics(df.select("fold", "score", F.col("label").cast("int").alias("label"), "id"), "id").collect()}
    assert (got[1].auc, got[1].top_2_pct, got[1].mean_rank_percentile) == (0.0, 100.0, 0.0)
    assert got[2].top_2_pct == 50.0 and got[2].mean_rank_percentile == 50.0
    assert ranking.ranked(df.limit(0), "score", "label", "id").count() == 0


def test_sampling_keeps_folds_apart(spark):
    pixels = [(r, c, 1 if c < 6 else 2, (r, c) in ((2, 5), (2, 9)), 1.0) for r in range(6) for c in range(12)]
    df = spark.createDataFrame(pixels, "row int, col int, fold int, label boolean, f double")
    got = sampling.fold_sample(df, 50.0, 2, 42).collect()
    near = {(r, c) for r in range(6) for c in range(12) if abs(r - 2) <= 2 and (c < 6 and abs(c - 5) <= 2 or c >= 6 and abs(c - 9) <= 2)}
    assert {(r.row, r.col) for r in got if not r.label} == {p[:2] for p in pixels} - near
    table = sampling.training_table(sampling.fold_sample(df, 50.0, 2, 42), df, ["f"], 3.0, 42)
    assert {(r.fold, r.label): r["count"] for r in table.groupBy("fold", "label").count().collect()} == {(1, 1): 1, (1, 0): 3, (2, 1): 1, (2, 0): 3}
    with pytest.raises(ValueError, match="no samples"):
        sampling.training_table(sampling.fold_sample(df, 50.0, 2, 42), df.withColumn("f", F.lit(float("nan"))), ["f"], 3.0, 42)


def test_buffers_are_round(spark):
    cells = spark.createDataFrame([(r, c, 1.0) for r in range(12) for c in range(12)], "row int, col int, z double")
    zone = spark.createDataFrame([(4.0, 6.0, 5.0, 7.0)], "x0 double, x1 double, y0 double, y1 double")
    got = {(r.row, r.col) for r in raster.within(cells.select("row", "col"), zone, 2.0).collect()}
    away = lambda v, a, b: max(a - v, v - b, 0)
    want = {(r, c) for r in range(12) for c in range(12) if math.hypot(away(c + 0.5, 4, 6), away(r + 0.5, 5, 7)) <= 2.0}
    assert got == want and (3, 2) not in got and (6, 2) in got


def test_a_line_shorter_than_the_stencil_is_mirrored_again(spark):
    z = [3.0, 1.0, 4.0]
    df = spark.createDataFrame([(r, 0, v) for r, v in enumerate(z)], "row int, col int, z double")
    got = {r.row: r.z for r in grid.gaussian(df, 2.0, 3, 1).collect()}
    w = grid.weights(2.0)
    mirrored = (z + z[::-1]) * 9
    for r in range(3):
        assert got[r] == pytest.approx(sum(x * mirrored[(r + k - 8) % 6] for k, x in enumerate(w)))


def test_base_layer_of_flat_ground_has_no_roughness(spark):
    flat = spark.createDataFrame([(r, c, 5.0) for r in range(40) for c in range(40)], "row int, col int, z double")
    other = flat.select("row", "col", (F.col("z") * F.col("col")).alias("ice"))
    assert raster.roughness_sigma(flat, other).first().sigma == 1.0
    # local deviations in the ratio 9 give a sigma of 2, too few pixels 1
    rough = flat.select("row", "col", (F.col("col") * 9.0).alias("z"))
    ramp = flat.select("row", "col", F.col("col").cast("double").alias("ice"))
    assert raster.roughness_sigma(rough, ramp).first().sigma == pytest.approx(2.0)
    assert raster.roughness_sigma(rough.where("row < 30"), ramp.where("row < 30")).first().sigma == 1.0


def test_drivers_refuse_what_they_do_not_know(spark):
    df = registry.relief(spark, "/root/testdata/sf0.001")
    for wanted in ({"aspect": [1]}, {"slope": []}):
        with pytest.raises(ValueError):
            grid.extract_features(df, wanted, 15, 100)
    with pytest.raises(ValueError):
        grid.zonal_features(df, ["gone"], ["std"], [3])
    with pytest.raises(ValueError):
        grid.zonal_features(df, ["z"], ["mode"], [3])


def test_coordinates(spark):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in (("e", 2600000.0), ("n", 1200000.0))])
    lon, lat = projection.reproject(F.col("e"), F.col("n"), projection.LV95, projection.WGS84)
    got = row.select(lon.alias("lon"), lat.alias("lat"))
    assert (got.first().lon, got.first().lat) == pytest.approx((7.438637, 46.951081), abs=2e-5)  # the origin of the grid, at Bern
    e, n = projection.reproject(F.col("lon"), F.col("lat"), projection.WGS84)
    assert tuple(got.select(e, n).first()) == pytest.approx((2600000, 1200000), abs=1.5)
    assert projection.reproject(F.col("e"), F.col("n"), projection.LV95) is not None
    for source, target in ((None, projection.LV95), ("EPSG:3857", projection.LV95), (projection.LV95, "EPSG:3857")):
        with pytest.raises(ValueError):
            projection.reproject(F.col("e"), F.col("n"), source, target)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for k in range(900):
        x, y, noise = rng.random(), rng.random(), rng.random()
        positive = x + 0.3 * y > 0.8
        rows.append((k, k % 3, x, y, noise, int(positive and rng.random() < 0.6), positive))
    rows.append((900, 0, float("nan"), 0.5, 0.5, 0, False))
    return spark.createDataFrame(rows, "id long, fold int, x double, y double, noise double, label int, truth boolean").repartition(3).cache()


METHODS = [(m, "random_forest") for m in model.METHODS] + [("plain", "gradient_boosting"), ("PU_Bagging", "Gradient_Boosting")]


@pytest.mark.parametrize(("method", "learner"), METHODS)
def test_methods_find_the_unlabeled_positives(spark, table, tmp_path, method, learner):
    config = model.Config(method=method, learner=learner, estimators=3, hold_out=0.3, trees=8, depth=4)
    fitted = model.fit(table, ["x", "y", "noise"], config)
    scored = fitted.score(table)
    assert scored.columns == [*table.columns, "score"]
    got = {r.id: r for r in scored.collect()}
    assert len(got) == 901 and got[900].score is None
    assert all(0 <= r.score <= 1 and abs(r.x - x) < 1e-12 for r in got.values() if r.score is not None for x in [r.x])
    unlabeled = [r for r in got.values() if not r.label and r.score is not None]
    hidden = [r.score for r in unlabeled if r.truth]
    others = [r.score for r in unlabeled if not r.truth]
    assert sum(hidden) / len(hidden) > sum(others) / len(others) + 0.1
    weights = dict(fitted.importances())
    assert max(weights, key=weights.get) == "x" and sum(weights.values()) == pytest.approx(1, abs=1e-6)
    if learner.lower() == "gradient_boosting" or method == "pu_elkan_noto":
        model.save(fitted, spark, f"{tmp_path}/saved")
        again = {r.id: r.score for r in model.load(spark, f"{tmp_path}/saved").score(table).collect()}
        assert all(again[k] == pytest.approx(got[k].score) for k in range(900))


def test_bags_of_forests_are_grown_from_counts(spark, monkeypatch):
    """Of few features: as Spark's own forests score, by jobs whose number doesn't follow trees, levels and bags, however the rows are dealt."""
    rng = np.random.default_rng(7)
    x, y = rng.random(6000), rng.integers(0, 12, 6000)
    label = (rng.random(6000) < 0.1 + 0.5 * ((x > 0.6) & (y > 3))).astype(int)
    df = spark.createDataFrame([(k, float(x[k]), float(y[k]), int(label[k])) for k in range(6000)], "id long, x double, y double, label int").cache()
    df.count()
    config = model.Config(estimators=4, trees=30, depth=5)
    spark.sparkContext.setJobGroup("forests", "counted")
    fitted = model.fit(df, ["x", "y"], config)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forests"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 20 and isinstance(fitted.models[0], forest.Forest)
    again = model.fit(df.repartition(7, "id").sortWithinPartitions("y"), ["x", "y"], config)
    assert again.models == fitted.models and again.scaler == fitted.scaler
    monkeypatch.setattr(forest, "CELLS", 0)
    plain = model.fit(df, ["x", "y"], config)
    assert len(plain.models) == 4
    got, want = (np.array([r.score for r in m.score(df).orderBy("id").collect()]) for m in (fitted, plain))
    assert np.abs(got - want).mean() < 0.03 and abs(got.mean() - want.mean()) < 0.01 and np.corrcoef(got, want)[0, 1] > 0.97
    ours, theirs = dict(fitted.importances()), dict(plain.importances())
    assert sum(ours.values()) == pytest.approx(1) and all(abs(ours[c] - theirs[c]) < 0.08 for c in ours)


def test_counted_forests_by_hand(spark, tmp_path):
    """One tree of two levels over cells: leaves are shares of positives, a cell without rows gets its node's."""
    config = forest.Bagging(1, 1, 2, min_leaf=1, max_features="all", bins=4)
    bins, sizes = np.array([[0, 0, 1, 1], [0, 1, 0, 1]]), [2, 2]
    chance, weights = forest._tree(config, bins, sizes, np.array([0, 0, 8, 1]), np.array([10, 0, 2, 9]), np.random.default_rng(1))
    assert chance.tolist() == [0.0, 0.0, 0.8, 0.1] and weights[0] > 0 and weights[1] > 0
    kept = forest._tree(forest.Bagging(1, 1, 2, min_leaf=11, max_features="all"), bins, sizes, np.array([0, 0, 8, 1]), np.array([10, 0, 2, 9]), np.random.default_rng(1))
    assert kept[0].tolist() == [0.3] * 4
    values = [(float(v),) for v in [-9999.0, 0.0, 1e-300, *range(1, 9)]]
    cuts = forest._cuts(spark.createDataFrame(values, "v double"), ["v"], 32)
    assert cuts == [[0.0, 1e-300 if 1e-300 in cuts[0] else cuts[0][1], *map(float, range(1, 9))]]
    many = forest._cuts(spark.range(1000).select((F.col("id") - 500.0).alias("v"), F.lit(2.5).alias("w")), ["v", "w"], 4)
    assert len(many[0]) == 3 and many[1] == [] and all(abs(c - q) <= 2 for c, q in zip(many[0], (-250, 0, 250), strict=True))
    assert [config.chosen(9), forest.Bagging(1, 2, 1).chosen(9), forest.Bagging(1, 2, 1, max_features="0.3").chosen(9)] == [9, 3, 3]
    fitted = model.Fitted(["v"], {"v": (0.0, 1.0)}, [forest.Forest([[1.0, 2.0]], [0.25, 0.5, 0.125], [1.0])])
    model.save(fitted, spark, f"{tmp_path}/saved")
    df = spark.createDataFrame([(-5.0,), (1.0,), (1.5,), (2.0,), (None,)], "v double")
    for one in (fitted, model.load(spark, f"{tmp_path}/saved")):
        assert {r.v: r.score for r in one.score(df).collect()} == {-5.0: 0.25, 1.0: 0.5, 1.5: 0.5, 2.0: 0.125, None: None}
        assert one.importances() == [("v", 1.0)]
    with pytest.raises(ValueError, match="criterion"):
        forest.Bagging(1, 1, 1, criterion="variance")


def test_folds_are_scored_by_the_others(spark, table):
    config = model.Config(method="plain", trees=5, depth=3)
    scored, weights = model.cross_validate(table, ["x", "y"], config)
    one = {r.id: r.score for r in model.fit(table.where("fold <> 1"), ["x", "y"], config).score(table.where("fold = 1")).collect()}
    got = {r.id: r.score for r in scored.where("fold = 1").collect()}
    assert got == one
    assert scored.count() == 901 and weights.groupBy("fold").agg(F.sum("importance").alias("s")).where("abs(s - 1) > 1e-6").count() == 0
    assert [r.feature for r in model.importance_summary(weights).collect()] == ["x", "y"]
    summary = model.cv_summary(model.cv_metrics(scored, "id")).first()
    assert 0.5 < summary.auc_mean < 1 and summary.auc_std >= 0 and summary.mean_rank_percentile_mean < 50


def test_models_refuse_what_they_can_not_learn(table):
    for options in ({"method": "svm"}, {"learner": "tree"}):
        with pytest.raises(ValueError):
            model.Config(**options)
    with pytest.raises(ValueError, match="0 positives"):
        model.fit(table.where("label = 0"), ["x"])
    with pytest.raises(ValueError, match="hold_out"):
        model.fit(table, ["x"], model.Config(method="pu_elkan_noto", hold_out=0.0, trees=2, depth=2))
    with pytest.raises(ValueError, match="no rows"):
        model.cross_validate(table.limit(0), ["x"])


def test_scaler_learns_from_its_own_rows(table):
    statistics = model.scaler_statistics(table.where("id < 900"), ["x", "noise"])
    row = table.where("id < 900").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert statistics["x"] == pytest.approx((row.m, row.s))
    assert model.scaler_statistics(table.select(F.lit(4.0).alias("k")), ["k"]) == {"k": (4.0, 1.0)}


def test_tiles_meet_at_their_borders(spark):
    height, width = grid.TILE + 12, grid.TILE + 7
    z = np.random.default_rng(3).integers(0, 100, (height, width)).astype(float)
    flags = np.zeros((height, width), bool)
    flags[[0, grid.TILE - 2, grid.TILE + 9], [grid.TILE, 5, grid.TILE - 1]] = True
    cells = [(r, c, float(z[r, c]), bool(flags[r, c])) for r in range(height) for c in range(width)]
    df = spark.createDataFrame(cells, "row int, col int, z double, flag boolean")

    w = np.array(grid.weights(1.0))
    soft = np.apply_along_axis(np.convolve, 0, np.pad(z, ((4, 4), (0, 0)), "symmetric"), w, "valid")
    soft = np.apply_along_axis(np.convolve, 1, np.pad(soft, ((0, 0), (4, 4)), "symmetric"), w, "valid")
    q, p = np.gradient(soft)
    slope = np.degrees(np.arctan(np.hypot(p, q)))
    broken = np.hypot(*np.gradient(slope))
    for name, want in (("slope", slope), ("slope_break_index", broken)):
        made = grid.terrain(df, name, 1.0, height, width)
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        got = np.full((height, width), np.nan)
        for r, c, v in made.collect():
            got[r, c] = v
        np.testing.assert_allclose(got, want, atol=1e-8)

    at = np.argwhere(flags)
    near = {(r, c) for r in range(height) for c in range(width) if (np.abs(at - (r, c)).max(axis=1) <= 4).any()}
    rows = grid.dilate(df, "flag", 4).collect()
    assert len(rows) == height * width and {(r["row"], r["col"]) for r in rows if r["near"]} == near


def test_folds_of_one_file_are_dealt_over_cores(spark, table, monkeypatch):
    dealt, kept = [], model.kept
    monkeypatch.setattr(model, "kept", lambda df, name: dealt.append(df.rdd.getNumPartitions()) or kept(df, name))
    scored, _ = model.cross_validate(table.coalesce(1), ["x", "y"], model.Config(method="plain", trees=2, depth=2))
    assert dealt == [spark.sparkContext.defaultParallelism] and scored.count() == 901
