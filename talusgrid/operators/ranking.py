"""Risk-ranking metrics: cumulative gain, its area, rank percentile and bins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept

#: Shares of the inspected area at which the gain is reported, in percent.
TOP = (2, 5, 10, 20)
#: Range partitions that rows are ranked in; None leaves the number to the session.
SLICES: int | None = None


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition with the partition, their number and the positives so far."""
    part, rows, hits = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
        columns = [batch.column("_f"), np.full(len(y), part, np.int32), batch.column("y"), rows + 1 + np.arange(len(y)), hits + np.cumsum(y)]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["_f", "_p", "y", "_i", "_hits"])
        rows, hits = rows + len(y), hits + int(y.sum())


def ranked(df: DataFrame, score: str, label: str, tie: str, fold: str = "fold") -> DataFrame:
    """Rank ``i`` from 1 by falling score within folds, with ``n`` and positives so far.

    Rows whose score is null, NaN or infinite are left out; ties go by ``tie``,
    a value of which no two rows of a fold have the same.

    Runs at once: rows are sorted by fold, score and tie over range partitions,
    so neither a large fold nor a score of very many rows meets in one task.
    Each task numbers its rows as they pass and writes them to the shared
    folder. A row for each partition and fold, written as well, tells what lies
    before; readers join it, which Spark broadcasts while its files are small.
    All metrics can be taken from the one result without another shuffle.
    """
    inf = F.lit(float("inf"))
    ok = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < inf)
    rows = df.where(ok).select(
        F.col(fold).alias("_f"), (-F.col(score).cast("double") + F.lit(0.0)).alias("_s"), F.col(tie).alias("_t"), F.when(F.col(label), 1).otherwise(0).alias("y")
    )
    order = ["_f", "_s", "_t"]
    ranges = rows.repartitionByRange(SLICES, *order) if SLICES else rows.repartitionByRange(*order)
    kind = rows.schema["_f"].dataType.simpleString()
    made = ranges.sortWithinPartitions(*order).select("_f", "y").mapInArrow(_numbered, f"_f {kind}, _p int, y int, _i long, _hits long")
    numbered = kept(made, "ranked")
    whole = Window.partitionBy("_f")  # a row a partition
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = numbered.groupBy("_f", "_p").agg(
        F.count("*").alias("_n"), F.sum("y").alias("_h"), (F.min("_i") - 1).alias("_i0"), F.min(F.col("_hits") - F.col("y")).alias("_h0")
    )
    moved = parts.select(
        F.col("_f").alias("_fx"), F.col("_p").alias("_px"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_i0")).alias("_by"),
        (F.coalesce(F.sum("_h").over(before), F.lit(0)) - F.col("_h0")).alias("_hits_by"),
        F.sum("_n").over(whole).alias("n"), F.sum("_h").over(whole).alias("total"),
    )
    place = F.col("_f").eqNullSafe(F.col("_fx")) & (F.col("_p") == F.col("_px"))
    return numbered.join(kept(moved, "ranked-parts"), place).select(
        F.col("_f").alias(fold), (F.col("_i") + F.col("_by")).alias("i"), "y", "n", (F.col("_hits") + F.col("_hits_by")).alias("hits"), "total"
    )


def success_rate_curve(df: DataFrame, score: str, label: str, tie: str, fold: str = "fold") -> DataFrame:
    """``curve`` of the ranks of ``df``."""
    return curve(ranked(df, score, label, tie, fold), fold)


def curve(ranks: DataFrame, fold: str = "fold") -> DataFrame:
    """Share of positives found against share of the area inspected, in percent.

    ``before_pct`` and ``before_area_pct`` are the shares before the row. A fold
    without positives has the 101 points from 0 to 100 percent, all zero.
    """
    share = lambda hits: hits / F.col("total") * 100
    found = ranks.where("total > 0").select(
        fold,
        "i",
        "n",
        (F.col("i") / F.col("n") * 100).alias("inspected_area_pct"),
        share(F.col("hits")).alias("detected_positives_pct"),
        share(F.col("hits") - F.col("y")).alias("before_pct"),
        ((F.col("i") - 1) / F.col("n") * 100).alias("before_area_pct"),
    )
    k, zero = F.col("k").cast("double"), F.lit(0.0)
    none = ranks.where("total = 0 AND i = 1").select(fold, F.explode(F.sequence(F.lit(0), F.lit(100))).alias("k"))
    return found.unionByName(
        none.select(
            fold, (F.col("k") + 1).cast("long").alias("i"), F.lit(101).cast("long").alias("n"), k.alias("inspected_area_pct"),
            zero.alias("detected_positives_pct"), zero.alias("before_pct"), F.greatest(k - 1, zero).alias("before_area_pct"),
        )
    )


def curve_metrics(curve: DataFrame, fold: str = "fold") -> DataFrame:
    """Area under each fold's curve (trapezoids from its first point) and top gains."""
    y = F.col("detected_positives_pct")
    area = F.when(F.col("i") > 1, 100 / F.col("n") * (y + F.col("before_pct")) / 2)
    top = [
        F.max(F.when(F.col("i") == F.ceil(F.col("n") * F.lit(p / 100)), y)).alias(f"top_{p}_pct") for p in TOP
    ]
    return (
        curve.withColumn("area", area)
        .groupBy(fold)
        .agg((F.coalesce(F.sum("area"), F.lit(0.0)) / 10000).alias("auc"), *top)
    )


def mean_rank_percentile(df: DataFrame, score: str, label: str, tie: str, fold: str = "fold") -> DataFrame:
    """``rank_percentile`` of the ranks of ``df``."""
    return rank_percentile(ranked(df, score, label, tie, fold), fold)


def rank_percentile(ranks: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean place of positives, 0 at the top and 100 at the bottom; null if none."""
    place = F.coalesce((F.col("i") - 1) / F.nullif(F.col("n") - 1, F.lit(0)) * 100, F.lit(0.0))
    return ranks.groupBy(fold).agg(F.avg(F.when(F.col("y") == 1, place)).alias("mean_rank_percentile"))


def gain_bins(df: DataFrame, score: str, label: str, tie: str, size: int = 5, fold: str = "fold") -> DataFrame:
    """``bins`` of the ranks of ``df``."""
    return bins(ranked(df, score, label, tie, fold), size, fold)


def bins(ranks: DataFrame, size: int = 5, fold: str = "fold") -> DataFrame:
    """Percent of a fold's positives in each equal share of the ranking."""
    count = 100 // size
    at = F.least(F.floor((F.col("i") - 1) / F.col("n") * 100 / size), F.lit(count - 1)).cast("int")
    return (
        ranks.where("total > 0")
        .groupBy(fold, at.alias("bin"))
        .agg((F.sum("y") / F.max("total") * 100).alias("pct_positives"))
        .select(fold, "bin", ((F.col("bin") + 0.5) * size).alias("bin_center"), "pct_positives")
    )


def mean_std(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Mean and population deviation of ``values`` over the rows of ``by``; null and NaN don't count."""
    known = {v: F.when(~F.isnan(v), F.col(v)) for v in values}
    made = [f(known[v]).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.groupBy(*by).agg(*made)


def gain_bins_mean_std(bins: DataFrame, folds: int, size: int = 5) -> DataFrame:
    """Mean and deviation of each bin over ``folds`` folds; a bin that a fold doesn't have counts as zero."""
    v = F.col("pct_positives")
    mean = F.sum(v) / folds
    spread = F.sqrt(F.greatest(F.sum(v * v) / folds - mean * mean, F.lit(0.0)))
    return bins.groupBy("bin").agg(mean.alias("pct_positives_mean"), spread.alias("pct_positives_std")).select(
        ((F.col("bin") + 0.5) * size).alias("bin_center"), "pct_positives_mean", "pct_positives_std"
    )


def curve_mean_std(curve: DataFrame, points: int = 100, fold: str = "fold") -> DataFrame:
    """Folds' curves read off at ``points`` places from 0 to 100: mean and population deviation.

    Linear between points; before a curve's first point its first value holds.
    Each row knows the point before it, so no window is needed: it takes the
    places after that point up to its own.
    """
    x, y = F.col("inspected_area_pct"), F.col("detected_positives_pct")
    step = 100.0 / (points - 1)
    back = F.col("before_area_pct")
    low = F.when(F.col("i") == 1, 0).otherwise(F.floor(back / step + 1e-9) + 1).cast("int")
    high = F.floor(x / step + 1e-9).cast("int")
    placed = curve.select("i", x.alias("x2"), back.alias("x1"), y.alias("y2"), F.col("before_pct").alias("y1"), low.alias("low"), high.alias("high"))
    placed = placed.where("low <= high").select("*", F.explode(F.sequence("low", "high")).alias("k"))
    g = F.col("k") * step
    part = (g - F.col("x1")) / (F.col("x2") - F.col("x1"))
    value = F.when(F.col("i") == 1, F.col("y2")).otherwise(F.col("y1") + part * (F.col("y2") - F.col("y1")))
    return (
        placed.select("k", g.alias("inspected_area_pct"), value.alias("v"))
        .groupBy("k", "inspected_area_pct")
        .agg(
            F.avg("v").alias("detected_positives_pct_mean"),
            F.stddev_pop("v").alias("detected_positives_pct_std"),
        )
        .drop("k")
    )
