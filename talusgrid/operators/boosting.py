"""Boosted trees of second order with L1 and L2 weights, grown level by level from Spark aggregations.

Rows hold the bins of their features and their margin, and are written anew
after each tree. The histograms of a level are one ``groupBy`` of node, feature
and bin; the best split of each node is chosen by windows over them, so that at
most one row a node reaches the driver: 2 ** depth, whatever the table's size.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talusgrid.sources import tables

#: A split has to lessen the loss by more than this.
LEAST = 1e-6


@dataclass(frozen=True)
class Boosting:
    """What to grow: ``trees`` trees of ``depth`` levels, each leaf's step times ``rate``.

    ``l1`` and ``l2`` hold the leaves' weights down; a split needs a gain of at
    least ``min_gain`` (the change of ``G^2 / (H + l2)``, sides less parent) and
    a curvature of ``min_weight`` on both sides. Each tree sees ``row_share`` of
    the rows and ``column_share`` of the features. A feature has at most
    ``bins`` bins, cut at its quantiles.
    """

    trees: int = 50
    depth: int = 6
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 1.0
    min_gain: float = 0.0
    min_weight: float = 1.0
    row_share: float = 1.0
    column_share: float = 1.0
    bins: int = 64
    seed: int = 42

    def __post_init__(self):
        if self.trees < 1 or self.depth < 1 or self.bins < 2:
            raise ValueError("trees and depth have to be at least 1, bins at least 2")
        if min(self.l1, self.l2, self.min_gain, self.min_weight) < 0:
            raise ValueError("weights and gains can't be negative")
        if not (0 < self.row_share <= 1 and 0 < self.column_share <= 1):
            raise ValueError("shares lie above 0 and up to 1")

    def fit(self, rows: DataFrame) -> Boosted:
        """Trees for ``features`` (vector), ``label`` (0 or 1) and ``w`` (weight).

        Features have to be finite. Without a row of either label, ValueError.
        """
        return _fit(self, rows)


@dataclass
class Tree:
    """Nodes numbered from 1 at the root, children 2n and 2n + 1; a feature of -1 is a leaf."""

    feature: list[int]
    bin: list[int]
    cut: list[float]
    value: list[float]
    gain: list[float]

    @staticmethod
    def bare(depth: int) -> Tree:
        n = 2 ** (depth + 1)
        return Tree([-1] * n, [0] * n, [0.0] * n, [0.0] * n, [0.0] * n)

    def node(self, bins: str, steps: int) -> Column:
        """A row's node after that many steps from the root."""
        if not steps:
            return F.lit(1)
        feature, at = F.lit(self.feature), F.lit(self.bin)

        def step(node: Column, _: Column) -> Column:
            right = (F.col(bins)[feature[node]] > at[node]).cast("int")
            return F.when(feature[node] < 0, node).otherwise(node * 2 + right)

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(1), step)


def _soft(g: Column | float, l1: float):
    """``g`` drawn towards 0 by ``l1``."""
    if isinstance(g, Column):
        return F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0))
    return math.copysign(max(abs(g) - l1, 0.0), g)


def _leaf(config: Boosting, g: float, h: float) -> float:
    return -config.rate * _soft(g, config.l1) / (h + config.l2) if h + config.l2 > 0 else 0.0


def best_splits(rows: DataFrame, config: Boosting) -> DataFrame:
    """``node, g, h`` and the best split of each node: ``gain, feature, bin, gl, hl``; a gain of -1 is none.

    ``rows`` has ``node, g, h, bins`` and, in ``chosen``, the features to look
    at. Equal gains (to six digits) go to the first feature, then the first bin.
    """
    cells = rows.select("node", "g", "h", "bins", F.explode("chosen").alias("feature")).select(
        "node", "feature", F.col("bins")[F.col("feature")].alias("bin"), "g", "h"
    )
    sums = cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    one = Window.partitionBy("node", "feature")
    below = one.orderBy("bin")
    sides = sums.select(
        "node", "feature", "bin", F.sum("g").over(below).alias("gl"), F.sum("h").over(below).alias("hl"),
        F.sum("g").over(one).alias("g"), F.sum("h").over(one).alias("h"),
        F.lead("bin").over(below).isNull().alias("last"),
    )

    def worth(g: Column, h: Column) -> Column:
        drawn = _soft(g, config.l1)
        return F.coalesce(F.try_divide(drawn * drawn, h + config.l2), F.lit(0.0))

    gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    gain = F.round(worth(F.col("gl"), F.col("hl")) + worth(gr, hr) - worth(F.col("g"), F.col("h")), 6)
    sound = ~F.col("last") & (F.col("hl") >= config.min_weight) & (hr >= config.min_weight) & (gain > LEAST) & (gain >= config.min_gain)
    found = F.struct(
        F.when(sound, gain).otherwise(-1.0).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", "g", "h"
    )
    return sides.groupBy("node").agg(F.max(found).alias("s")).select(
        "node", "s.g", "s.h", "s.gain", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), "s.gl", "s.hl"
    )


def _binned(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """``id, bins, y, w``: a value's bin is the number of cuts up to it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                values = np.stack(part["x"].to_numpy())
                bins = np.stack([np.searchsorted(c, values[:, k], side="right") for k, c in enumerate(cuts)], 1)
                yield pd.DataFrame({"bins": list(bins.astype(np.int32)), "y": part["y"], "w": part["w"]})

    plain = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), F.col("w").cast("double").alias("w"))
    return plain.mapInPandas(cut, "bins array<int>, y double, w double").withColumn("id", F.monotonically_increasing_id())


def _cuts(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Each feature's distinct quantiles."""
    wide = rows.select(*[vector_to_array("features")[k].alias(f"x{k}") for k in range(width)])
    shares = [k / bins for k in range(1, bins)]
    return [sorted(set(found)) for found in wide.approxQuantile([f"x{k}" for k in range(width)], shares, 1 / (8 * bins))]


def _fit(config: Boosting, rows: DataFrame) -> Boosted:
    spark = rows.sparkSession
    first = rows.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("label")).alias("y"), F.first("features").alias("x")).first()
    if not first["w"] or not 0 < first["y"] < first["w"]:
        raise ValueError("rows of both labels are needed")
    width = len(first["x"])
    cuts = _cuts(rows, width, config.bins)
    base = math.log(first["y"] / (first["w"] - first["y"]))
    folder, model = tables.shared_path(spark, "boosting"), Boosted(config, width, base)
    kind = "bins array<int>, y double, w double, id long, margin double"
    _binned(rows, cuts).withColumn("margin", F.lit(base)).write.parquet(f"{folder}/0")
    try:
        for k in range(config.trees):
            at = spark.read.schema(kind).parquet(f"{folder}/{k}")
            tree = _grow(at, config, cuts, k)
            model.trees.append(tree)
            if k + 1 < config.trees:
                step = F.lit(tree.value)[tree.node("bins", config.depth)]
                at.withColumn("margin", F.col("margin") + step).write.parquet(f"{folder}/{k + 1}")
                tables.delete(spark, f"{folder}/{k}")
    finally:
        tables.delete(spark, folder)
    return model


def _grow(at: DataFrame, config: Boosting, cuts: list[list[float]], k: int) -> Tree:
    width = len(cuts)
    chosen = sorted(random.Random(f"{config.seed}:{k}").sample(range(width), max(1, round(width * config.column_share))))
    p = 1 / (1 + F.exp(-F.col("margin")))
    drawn = F.pmod(F.xxhash64("id", F.lit(config.seed), F.lit(k)), F.lit(1 << 20)) < F.lit(int(config.row_share * (1 << 20)))
    seen = at.where(drawn) if config.row_share < 1 else at
    seen = seen.select("bins", (F.col("w") * (p - F.col("y"))).alias("g"), (F.col("w") * p * (1 - p)).alias("h"), F.lit(chosen).alias("chosen"))
    tree = Tree.bare(config.depth)
    for level in range(config.depth):
        here = seen.withColumn("node", tree.node("bins", level)).where(F.col("node") >= 2**level)
        grew = False
        for s in best_splits(here, config).collect():  # a row a node
            n = s["node"]
            tree.value[n] = _leaf(config, s["g"], s["h"])
            if s["gain"] > 0:
                grew = True
                tree.feature[n], tree.bin[n], tree.gain[n] = s["feature"], s["bin"], s["gain"]
                tree.cut[n] = cuts[s["feature"]][s["bin"]]
                tree.value[2 * n] = _leaf(config, s["gl"], s["hl"])
                tree.value[2 * n + 1] = _leaf(config, s["g"] - s["gl"], s["h"] - s["hl"])
        if not grew:
            break
    return tree


@dataclass
class Boosted:
    """Grown trees; used as Spark's own classifiers are: ``transform`` and ``featureImportances``."""

    config: Boosting
    width: int
    base: float
    trees: list[Tree] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (vector of both labels') from its ``features``."""
        depth, base = self.config.depth, self.base
        grown = [(np.array(t.feature), np.array(t.cut), np.array(t.value)) for t in self.trees]

        @F.pandas_udf("double")
        def chance(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype="float64")
            x = np.stack(features.to_numpy())
            row, margin = np.arange(len(x)), np.full(len(x), base)
            for feature, cut, value in grown:
                node = np.ones(len(x), dtype=np.int64)
                for _ in range(depth):
                    f = feature[node]
                    node = np.where(f < 0, node, 2 * node + (x[row, np.maximum(f, 0)] >= cut[node]))
                margin += value[node]
            return pd.Series(1 / (1 + np.exp(-margin)))

        p = chance(vector_to_array("features"))
        return df.withColumn("_one", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_one"), F.col("_one")))).drop("_one")

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Each feature's mean gain over its splits, all together 1."""
        total, splits = np.zeros(self.width), np.zeros(self.width)
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += gain
                    splits[f] += 1
        mean = total / np.maximum(splits, 1)
        return DenseVector(mean / mean.sum() if mean.sum() else mean)

    def save(self, spark: SparkSession, path: str) -> None:
        kinds = "k int, feature array<int>, bin array<int>, cut array<double>, value array<double>, gain array<double>"
        rows = [(k, t.feature, t.bin, t.cut, t.value, t.gain) for k, t in enumerate(self.trees)]
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        head = pd.DataFrame([asdict(self.config) | {"width": self.width, "base": self.base}])
        spark.createDataFrame(head).coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        head = spark.read.parquet(f"{path}/head").first().asDict()
        width, base = head.pop("width"), head.pop("base")
        rows = spark.read.parquet(f"{path}/trees").orderBy("k").collect()
        return Boosted(Boosting(**head), width, base, [Tree(*(list(r[c]) for c in ("feature", "bin", "cut", "value", "gain"))) for r in rows])
