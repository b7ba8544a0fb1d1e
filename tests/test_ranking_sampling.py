"""Ranks over range partitions, samples from one pool, distinct counts and fold splits."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from talusgrid.operators import events, model, ranking, sampling


def shuffles(df):
    """Shuffles of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x or "Exchange SinglePartition" in x for x in final.splitlines())


def plain_sample(pixels, ratio, buffer, seed):
    out = set()
    for f in {p[2] for p in pixels if p[2]}:
        own = [p for p in pixels if p[2] == f and p[3] is not None]
        hits = [p[:2] for p in own if p[3]]
        free = [p[:2] for p in own if not p[3] and all(max(abs(p[0] - a), abs(p[1] - b)) > buffer for a, b in hits)]
        free.sort(key=lambda p: (hashlib.md5(f"{seed + f}:{p[0]}:{p[1]}".encode()).hexdigest(), p))
        out |= {(f, *p, 1) for p in hits} | {(f, *p, 0) for p in free[: int(len(hits) * ratio * 1.2)] if hits}
    return out


@pytest.mark.parametrize("buffer", [0, 1, 20])
def test_samples_of_a_grid_with_holes_over_tiles(spark, buffer):
    rng = random.Random(buffer)
    # fold 4 has no positives; some pixels have no fold, no label or no row; the lines cross borders of tiles
    places = [(r, c) for r in range(120, 140) for c in range(100, 270) if rng.random() < 0.8]
    fold = lambda c: None if rng.random() < 0.05 else rng.choice([0, 1, 2]) if c < 140 else 3 if c < 220 else 4
    label = lambda c: None if rng.random() < 0.02 else c < 220 and rng.random() < 0.01
    pixels = [(r, c, fold(c), label(c)) for r, c in places]
    df = spark.createDataFrame(pixels, "row int, col int, fold int, label boolean").repartition(5)
    got = [(x.fold, x.row, x.col, x.label) for x in sampling.fold_sample(df, 3.0, buffer, 7).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_sample(pixels, 3.0, buffer, 7)


def test_samples_of_nothing(spark):
    df = spark.createDataFrame([], "row int, col int, fold int, label boolean")
    assert sampling.fold_sample(df, 3.0, 2, 7).count() == 0


def test_a_training_table_runs_few_shuffles(spark):
    df = spark.range(3000).select(
        F.expr("int(id div 60)").alias("row"), F.expr("int(id % 60)").alias("col"), F.expr("int(id % 2 + 1)").alias("fold"),
        F.expr("id % 97 = 0").alias("label"), F.expr("double(id)").alias("f"),
    )
    sample = sampling.fold_sample(df, 5.0, 1, 42)
    table = sampling.training_table(sample, df, ["f"], 2.0, 42)
    assert shuffles(sample) <= 1 and shuffles(table) <= 1
    counted = {(r.fold, r.label): r["count"] for r in table.groupBy("fold", "label").count().collect()}
    assert counted[1, 0] == 2 * counted[1, 1] and counted[2, 0] == 2 * counted[2, 1]


def test_all_metrics_of_one_ranking_without_a_shuffle_of_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SLICES", 7)
    rows = [(k % 3, random.Random(k).choice([0.1, 0.2, 0.3]), k % 3 > 0 and k % 5 == 0, k) for k in range(500)]
    df = spark.createDataFrame(rows, "fold int, score double, label boolean, id long")
    ranks = ranking.ranked(df, "score", "label", "id")
    assert shuffles(ranks) == 0
    got = {r.fold: r for r in ranking.curve_metrics(ranking.curve(ranks)).collect()}
    apart = {r.fold: r for r in ranking.curve_metrics(ranking.success_rate_curve(df, "score", "label", "id")).collect()}
    assert got == apart and got[0].auc == got[0].top_20_pct == 0.0 < got[1].auc


def test_a_fold_without_positives_has_a_curve_of_101_zeros(spark):
    rows = [("a", s / 10, False, s) for s in range(7)] + [("b", s / 10, s == 3, s) for s in range(4)]
    df = spark.createDataFrame(rows, "fold string, score double, label boolean, id long")
    curve = ranking.success_rate_curve(df, "score", "label", "id")
    none = sorted((r.i, r.inspected_area_pct, r.detected_positives_pct) for r in curve.where("fold = 'a'").collect())
    assert none == [(k + 1, float(k), 0.0) for k in range(101)]
    mean = {round(r.inspected_area_pct): r for r in ranking.curve_mean_std(curve, 101).collect()}
    assert len(mean) == 101 and mean[100].detected_positives_pct_mean == 50.0 and mean[0].detected_positives_pct_mean == 50.0
    percent = {r.fold: r.mean_rank_percentile for r in ranking.rank_percentile(ranking.ranked(df, "score", "label", "id")).collect()}
    assert percent == {"a": None, "b": 0.0}


def test_distinct_counts(spark):
    rows = [(1, None, ["a", None, "a"]), (1, None, None), (2, None, []), (None, None, ["b"])]
    df = spark.createDataFrame(rows, "k int, n double, l array<string>")
    counted = {r.column: r.n_distinct for r in events.distinct_counts(df, ["k", "n"], ["l"]).collect()}
    assert counted == {"k": 2, "n": 0, "l": 2}
    assert [r.n_distinct for r in events.distinct_counts(df.limit(0), ["k"]).collect()] == [0]


def test_folds_are_split_without_rows_of_no_fold(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, None)], "id int, fold int")
    assert model.folds_of(df) == [1, 2]
    train, test = model.split(df, 2)
    assert ([r.id for r in train.collect()], sorted(r.id for r in test.collect())) == ([1], [2, 3])
