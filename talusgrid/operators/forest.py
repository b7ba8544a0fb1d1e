"""Bagged random forests of few features, grown from counts of rows that are alike in all bins.

Trees only see the bins of a row's features, so rows of one cell of the grid of
bins are interchangeable: Spark counts all rows by cell and label once, and what
a bag or a tree draws of a cell with replacement is a Poisson number of its
count. Trees are grown by Spark's tasks, some a task, from these counts, whose
number follows from the bins alone; a forest is the mean chance of each cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of the grid of bins, at most; with more, rows are hardly alike.
CELLS = 1 << 15
#: Bins of a feature, at most, as a row's bin is found by nested conditions.
BINS = 128
#: Significant bits of values by which quantiles are told.
BITS = 12
#: Trees that one task grows.
SHARE = 10


def fits(features: int, bins: int) -> bool:
    """Whether forests of so many features and bins are grown from counts."""
    return bins <= BINS and bins**features <= CELLS


@dataclass(frozen=True)
class Bagging:
    """What to grow: ``bags`` forests of ``trees`` trees, with the meaning that Spark's own forests give to the settings.

    Each bag has all positives and, with replacement, about as many unlabeled rows.
    """

    bags: int
    trees: int
    depth: int
    min_leaf: int = 1
    max_features: str = "sqrt"
    criterion: str = "gini"
    min_gain: float = 0.0
    bins: int = 32
    seed: int = 42

    def __post_init__(self):
        if self.bags < 1 or self.trees < 1 or self.depth < 0 or self.bins < 2:
            raise ValueError("bags and trees have to be at least 1, bins at least 2, and depth can't be negative")
        if self.criterion not in ("gini", "entropy"):
            raise ValueError(f"unknown criterion {self.criterion}")

    def chosen(self, width: int) -> int:
        """How many features a split may look at."""
        name = self.max_features.lower()
        if name == "auto":
            name = "all" if self.trees == 1 else "sqrt"
        known = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width))), "onethird": math.ceil(width / 3)}
        if name in known:
            return known[name]
        number = float(name)
        return max(1, min(width, int(number) if name.isdigit() else math.ceil(number * width)))

    def fit(self, rows: DataFrame, features: list[str]) -> Forest:
        """The forest for ``features`` (finite) and ``label`` (0 or 1). Without a row of either label, ValueError."""
        rows = rows.where("label in (0, 1)")
        cuts = _cuts(rows, features, self.bins)
        counted = rows.select(_cell([F.col(c) for c in features], cuts).alias("cell"), "label").groupBy("cell", "label").count().collect()
        counts = np.zeros((2, math.prod(len(c) + 1 for c in cuts)), dtype=np.int64)
        for r in counted:  # a row a cell and label
            counts[int(r["label"]), r["cell"]] = r["count"]
        zeros, ones = counts.sum(axis=1)
        if not ones or not zeros:
            raise ValueError(f"{ones} positives and {zeros} unlabeled rows: both are needed")
        return _grown(self, rows.sparkSession, cuts, counts)


def _cuts(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Each feature's quantiles, of all rows; values of ``BITS`` equal bits count as one, their least is the cut."""
    steps = []
    for k, c in enumerate(features):
        step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(c))) + 1 - BITS)
        steps.append(F.struct(F.lit(k).alias("k"), F.coalesce(F.floor(F.try_divide(F.col(c), step)) * step, F.lit(0.0)).alias("v")))
    seen = rows.select(F.explode(F.array(*steps)).alias("s")).groupBy("s.k", "s.v").count().toPandas()
    cuts = []
    for k in range(len(features)):
        one = seen[seen["k"] == k].sort_values("v")
        values, upto = one["v"].to_numpy(), one["count"].to_numpy().cumsum()
        if len(values) > bins:
            at = np.searchsorted(upto, np.arange(1, bins) * (upto[-1] / bins), side="left") + 1
            values = values[np.unique(np.concatenate([[0], np.minimum(at, len(values) - 1)]))]
        cuts.append([float(v) for v in values[1:]])
    return cuts


def _cell(values: list[Column], cuts: list[list[float]]) -> Column:
    """A row's cell: its bins, the numbers of cuts up to its values, as digits; the last feature's runs fastest."""

    def bin_of(value: Column, first: int, last: int, of: list[float]) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(value < of[middle], bin_of(value, first, middle, of)).otherwise(bin_of(value, middle + 1, last, of))

    cell = F.lit(0)
    for value, of in zip(values, cuts, strict=True):
        cell = cell * (len(of) + 1) + bin_of(value, 0, len(of), of)
    return cell


def _impurity(ones: np.ndarray, all_: np.ndarray, criterion: str) -> np.ndarray:
    p = ones / np.maximum(all_, 1)
    if criterion == "gini":
        return 2 * p * (1 - p)
    return -sum(x * np.log2(np.maximum(x, 1e-300)) for x in (p, 1 - p))


def _tree(config: Bagging, bins: np.ndarray, sizes: list[int], ones: np.ndarray, zeros: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One tree's chance of each cell, and each feature's gain times rows; level by level, by histograms of its nodes."""
    node, every = np.zeros(len(ones), dtype=np.int64), ones + zeros
    value, weights, width = np.array([ones.sum() / max(every.sum(), 1)]), np.zeros(len(sizes)), len(sizes)
    open_, chosen = np.array([True]), config.chosen(len(sizes))
    for _ in range(config.depth):
        n = len(value)
        total, first = np.bincount(node, every, n), np.bincount(node, ones, n)
        whole = _impurity(first, total, config.criterion)
        best, feature, cut = np.full(n, -1.0), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        allowed = rng.random((n, width)).argsort(axis=1).argsort(axis=1) < chosen
        for f, size in enumerate(sizes):
            if size < 2:
                continue
            at = node * size + bins[f]
            left, hit = (np.bincount(at, w, n * size).reshape(n, size).cumsum(axis=1)[:, :-1] for w in (every, ones))
            right = total[:, None] - left
            mixed = left * _impurity(hit, left, config.criterion) + right * _impurity(first[:, None] - hit, right, config.criterion)
            gain = whole[:, None] - mixed / np.maximum(total[:, None], 1)
            gain[(left < config.min_leaf) | (right < config.min_leaf) | (left < 1) | (right < 1) | ~(allowed[:, f] & open_)[:, None]] = -1.0
            k = gain.argmax(axis=1)
            found = gain[np.arange(n), k]
            better = found > best
            best, feature, cut = np.where(better, found, best), np.where(better, f, feature), np.where(better, k, cut)
        split = (best > 1e-15) & (best >= config.min_gain)
        if not split.any():
            break
        np.add.at(weights, feature[split], best[split] * total[split])
        # a node that isn't split stays; the others' sides get new numbers
        low = np.where(split, n + 2 * (split.cumsum() - 1), np.arange(n))
        right = np.choose(feature[node], bins) > cut[node] if width > 1 else bins[0] > cut[node]
        node = np.where(split[node], low[node] + right, node)
        more = 2 * int(split.sum())
        all_, hits = np.bincount(node, every, n + more)[n:], np.bincount(node, ones, n + more)[n:]
        value = np.concatenate([value, hits / np.maximum(all_, 1)])
        open_ = np.concatenate([np.zeros(n, dtype=bool), np.ones(more, dtype=bool)])
    return value[node], weights


def _grown(config: Bagging, spark: SparkSession, cuts: list[list[float]], counts: np.ndarray) -> Forest:
    sizes = [len(c) + 1 for c in cuts]
    zeros, ones = counts
    share = min(1.0, ones.sum() / zeros.sum())
    blocks = -(-config.trees // SHARE)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = np.stack(np.unravel_index(np.arange(len(ones)), sizes))
        for part in batches:
            for task in part["id"]:
                bag, block = divmod(int(task), blocks)
                drawn = np.random.default_rng([config.seed, bag]).poisson(share * zeros)
                chance, weights = np.zeros(len(ones)), np.zeros(len(sizes))
                for t in range(block * SHARE, min((block + 1) * SHARE, config.trees)):
                    rng = np.random.default_rng([config.seed, bag, t + 1])
                    p, w = _tree(config, bins, sizes, rng.poisson(ones), rng.poisson(drawn), rng)
                    chance += p
                    weights += w / w.sum() if w.sum() else w
                yield pd.DataFrame({"id": [task], "chance": [chance.tobytes()], "weights": [weights.tobytes()]})

    tasks = config.bags * blocks
    made = spark.range(0, tasks, 1, tasks).mapInPandas(grow, "id long, chance binary, weights binary").collect()
    chance, weights = np.zeros(len(ones)), np.zeros((config.bags, len(sizes)))
    for r in sorted(made, key=lambda r: r["id"]):
        chance += np.frombuffer(r["chance"])
        weights[r["id"] // blocks] += np.frombuffer(r["weights"])
    total = weights.sum(axis=1, keepdims=True)
    mean = (weights / np.where(total > 0, total, 1)).mean(axis=0)
    return Forest(cuts, [float(p) for p in chance / (config.bags * config.trees)], [float(w) for w in mean])


@dataclass
class Forest:
    """The mean chance of each cell over all bags' trees; used as Spark's own classifiers are: ``transform`` and ``featureImportances``."""

    cuts: list[list[float]]
    chance: list[float]
    weights: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (vector of both labels') from its ``features``."""
        values = [f"_x{k}" for k in range(len(self.cuts))]
        listed = F.split(F.lit(",".join(map(repr, self.chance))), ",").cast("array<double>")
        rows = df.withColumn("_x", vector_to_array("features")).withColumns({c: F.col("_x")[k] for k, c in enumerate(values)})
        rows = rows.withColumn("_one", listed[_cell([F.col(c) for c in values], self.cuts)])
        return rows.withColumn("probability", array_to_vector(F.array(1 - F.col("_one"), F.col("_one")))).drop("_x", "_one", *values)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Each feature's share of what splits gain, the mean over bags."""
        return DenseVector(self.weights)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.cuts, self.chance, self.weights)], "cuts array<array<double>>, chance array<double>, weights array<double>").coalesce(
            1
        ).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        row = spark.read.parquet(path).first()
        return Forest([list(c) for c in row["cuts"]], list(row["chance"]), list(row["weights"]))
