"""Second-order boosting against a plain version of it, its parameters, and its place among the learners."""

import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from talusgrid.operators import model
from talusgrid.operators.boosting import Boosted, Boosting


def table(n=400, seed=3):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        x, y, z = draw.randrange(8), draw.randrange(5), draw.randrange(6)
        label = int(draw.random() < (0.85 if x >= 4 and y < 2 else 0.2))
        rows.append((k, float(x), float(y), float(z), label, 1.0 + (k % 3) / 2))
    return rows


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "id int, x double, y double, z double, label int, w double").repartition(3)
    return VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(df)


def plainly(rows, c):
    """Scores of the same trees by loops over all cuts of all features."""
    total, ones = sum(r[5] for r in rows), sum(r[5] * r[4] for r in rows)
    margin = {r[0]: math.log(ones / (total - ones)) for r in rows}
    soft = lambda g: math.copysign(max(abs(g) - c.l1, 0), g)
    worth = lambda g, h: soft(g) ** 2 / (h + c.l2)

    def grow(part, depth):
        p = {r[0]: 1 / (1 + math.exp(-start[r[0]])) for r in part}
        gs = {r[0]: r[5] * (p[r[0]] - r[4]) for r in part}
        hs = {r[0]: r[5] * p[r[0]] * (1 - p[r[0]]) for r in part}
        g, h = sum(gs.values()), sum(hs.values())
        best = (0.0, None)
        for f in (1, 2, 3):
            for cut in sorted({r[f] for r in part})[1:]:
                left = [r[0] for r in part if r[f] < cut]
                gl, hl = sum(gs[k] for k in left), sum(hs[k] for k in left)
                if min(hl, h - hl) < c.min_weight:
                    continue
                gain = round(worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h), 6)
                if gain > 1e-6 and gain >= c.min_gain and gain > best[0]:
                    best = (gain, (f, cut))
        if depth == c.depth or best[1] is None:
            for r in part:
                margin[r[0]] -= c.rate * soft(g) / (h + c.l2)
            return
        f, cut = best[1]
        grow([r for r in part if r[f] < cut], depth + 1)
        grow([r for r in part if r[f] >= cut], depth + 1)

    for _ in range(c.trees):
        start = dict(margin)
        grow(rows, 0)
    return {k: 1 / (1 + math.exp(-m)) for k, m in margin.items()}


CASES = [
    Boosting(trees=3, depth=3, rate=0.3),
    Boosting(trees=2, depth=4, rate=0.5, l1=2.0, l2=0.5, min_weight=3.0),
    Boosting(trees=2, depth=3, rate=1.0, l2=0.0, min_gain=5.0),
]


@pytest.mark.parametrize("config", CASES)
def test_trees_equal_brute_force(spark, config):
    rows = table()
    df = vectors(spark, rows)
    got = {r.id: r.probability[1] for r in config.fit(df).transform(df).collect()}
    want = plainly(rows, config)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_parameters_hold_back(spark):
    df = vectors(spark, table())
    stump = Boosting(trees=1, depth=2, l1=1e6).fit(df)
    assert set(stump.trees[0].feature) == {-1} and set(stump.trees[0].value) == {0.0}
    assert set(Boosting(trees=1, depth=2, min_weight=1e6).fit(df).trees[0].feature) == {-1}
    one = Boosting(trees=6, depth=2, column_share=0.34).fit(df)
    for t in one.trees:  # each tree sees one feature
        assert len({f for f in t.feature if f >= 0}) <= 1
    half = Boosting(trees=2, depth=2, row_share=0.5)
    assert half.fit(df).trees == half.fit(df).trees


def test_rows_must_hold_both_labels(spark):
    df = vectors(spark, table(40))
    for part in (df.where("label = 1"), df.where("label = 0"), df.limit(0)):
        with pytest.raises(ValueError):
            Boosting(trees=1, depth=1).fit(part)
    for wrong in ({"trees": 0}, {"l2": -1.0}, {"row_share": 0.0}, {"column_share": 1.5}, {"bins": 1}):
        with pytest.raises(ValueError):
            Boosting(**wrong)


def test_one_of_the_learners(spark, tmp_path):
    df = spark.createDataFrame(table(), "id int, x double, y double, z double, label int, w double")
    config = model.Config(method="pu_bagging", learner="regularised_boosting", estimators=2, trees=3, depth=2, rate=0.5, l1=0.1)
    fitted = model.fit(df, ["x", "y", "z"], config)
    assert all(isinstance(m, Boosted) for m in fitted.models)
    got = {r.id: r.score for r in fitted.score(df).collect()}
    assert len(got) == 400 and all(0 <= s <= 1 for s in got.values())
    high = [got[r[0]] for r in table() if r[1] >= 4 and r[2] < 2]
    low = [got[r[0]] for r in table() if not (r[1] >= 4 and r[2] < 2)]
    assert sum(high) / len(high) > sum(low) / len(low) + 0.2
    weights = dict(fitted.importances())
    assert abs(sum(weights.values()) - 1) < 1e-9 and weights["z"] < weights["x"]
    model.save(fitted, spark, f"{tmp_path}/m")
    again = {r.id: r.score for r in model.load(spark, f"{tmp_path}/m").score(df).collect()}
    assert again == got
    assert fitted.score(df.withColumn("x", F.lit(None).cast("double"))).where("score is not null").count() == 0
