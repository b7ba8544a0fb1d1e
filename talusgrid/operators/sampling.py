"""Fold-stratified sampling around positives, and feature sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept
from .neighbourhood import Tile, by_tile, side_for


def fold_sample(df: DataFrame, ratio: float, buffer: int, seed: int, label: str = "label") -> DataFrame:
    """All positives of each fold and a sample of its unlabeled pixels.

    Unlabeled pixels within ``buffer`` steps of a positive of their own fold
    are out. Of the others, ``int(positives * ratio * 1.2)`` are taken, or all
    if there are fewer, in the order of an md5 of seed, fold and place. Fold 0
    and pixels without a fold or label are never sampled; a fold without
    positives gives no rows. Runs at once, up to the pool of pixels.

    Only pixels of a fold are shuffled, once, into tiles with a margin; a
    tile's positives are counted in every pixel's box by sums from a corner.
    """
    side = side_for(buffer)

    def free(keys: tuple, rows: pa.Table) -> pa.Table:
        tile = Tile(keys, rows, buffer, side)
        fold, positive = rows["fold"].to_numpy(), rows["label"].to_numpy() == 1
        kept_, edge = tile.own.copy(), side + 2 * buffer + 1
        for f in np.unique(fold[positive]):
            here = positive & (fold == f)
            sums = np.zeros((edge, edge), np.int32)
            sums[tile.row[here] - tile.r0 + buffer + 1, tile.col[here] - tile.c0 + buffer + 1] = 1
            sums = sums.cumsum(0).cumsum(1)
            asked = np.flatnonzero(tile.own & ~positive & (fold == f))
            r, c, w = tile.row[asked] - tile.r0, tile.col[asked] - tile.c0, 2 * buffer + 1
            kept_[asked] = sums[r + w, c + w] - sums[r, c + w] - sums[r + w, c] + sums[r, c] == 0
        return rows.select(["fold", "row", "col", "label"]).filter(pa.array(kept_))

    known = df.where((F.col("fold") > 0) & F.col(label).isNotNull()).select("fold", "row", "col", F.col(label).cast("int").alias("label"))
    schema = ", ".join(f"{c} {known.schema[c].dataType.simpleString()}" for c in known.columns)
    pool = by_tile(known, buffer, side).groupBy("_tr", "_tc").applyInArrow(free, schema)
    return _drawn(pool, lambda n: F.floor(n * F.lit(ratio) * F.lit(1.2)), seed)[0]


def _drawn(pool: DataFrame, wanted: Callable[[Column], Column], seed: int) -> tuple[DataFrame, int]:
    """Rows of ``pool`` with label 1, of the others the first ``wanted`` of a fold's positives; and the number of folds with positives.

    The pool is written once. One aggregate by fold and the first four digits
    of the md5 of seed, fold and place tells for all folds in which of these
    65536 parts the last row lies, so a filter takes the parts before it and
    only the rows of that part are put in order. A row a fold comes to the driver.
    """
    key = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("fold")).cast("string"), F.col("row").cast("string"), F.col("col").cast("string")))
    rows = kept(pool.withColumn("_part", F.substring(key, 1, 4)), "pool")
    whole = Window.partitionBy("fold")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("fold", "_part").agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n"))
    placed = counts.select("fold", "_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_p").over(whole).alias("_p"))
    over = F.col("_before") + F.col("_n") > wanted(F.col("_p"))
    ends = placed.where("_p > 0").groupBy("fold").agg(
        F.min(F.when(over, F.col("_part"))).alias("_end"), F.max(F.when(over, wanted(F.col("_p")) - F.col("_before"))).alias("_left")
    )
    found = ends.collect()
    marked = rows.join(F.broadcast(rows.sparkSession.createDataFrame(found, ends.schema)), "fold")
    taken = marked.where("label = 1 OR label = 0 AND (_end IS NULL OR _part < _end)")
    order = Window.partitionBy("fold").orderBy(key, "row", "col")
    last = marked.where("label = 0 AND _part = _end").withColumn("_i", F.row_number().over(order)).where("_i <= _left")
    return taken.select(*pool.columns).unionByName(last.select(*pool.columns)), len(found)


def gather(samples: DataFrame, pixels: DataFrame, features: list[str]) -> DataFrame:
    """``fold, row, col, label`` of the samples with their features; only those columns are read."""
    return samples.join(pixels.select("row", "col", *features), ["row", "col"]).select("fold", "row", "col", "label", *features)


def trim(samples: DataFrame, features: list[str], ratio: float, seed: int) -> DataFrame:
    """Samples whose features are all finite: all positives, and ``int(positives * ratio)`` others of a fold.

    The others are the first by an md5 of seed, fold and place, all if there
    are fewer; a fold without valid positives gives no rows. Runs at once.
    """
    return _trimmed(samples, features, ratio, seed)[0]


def _trimmed(samples: DataFrame, features: list[str], ratio: float, seed: int) -> tuple[DataFrame, int]:
    return _drawn(valid(samples, features), lambda n: F.floor(n * F.lit(ratio)), seed)


def training_table(samples: DataFrame, pixels: DataFrame, features: list[str], ratio: float, seed: int) -> DataFrame:
    """``gather`` and ``trim``; raises ValueError if nothing is left."""
    made, folds = _trimmed(gather(samples, pixels, features), features, ratio, seed)
    if not folds:
        raise ValueError("no samples are left")
    return made


def fold_statistics(samples: DataFrame) -> DataFrame:
    """Positives, others, their ratio and their number for each fold, and for all under a null fold."""
    count = F.count("*")
    positives, others = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return samples.rollup("fold").agg(
        positives.alias("positives"), others.alias("unlabeled"), (others / F.nullif(positives, F.lit(0))).alias("ratio"), count.alias("n_samples")
    )


def valid(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows whose features are all finite."""
    ok = F.lit(True)
    for f in features:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) < F.lit(float("inf")))
    return df.where(ok)


def standard_scale(df: DataFrame, features: list[str]) -> DataFrame:
    """Features less their mean, over their population deviation (1 where it is 0)."""
    stats = df.agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features]
    )
    both = df.crossJoin(F.broadcast(stats))  # one row
    return both.select(
        *[c for c in df.columns if c not in features],
        *[((F.col(f) - F.col(f"_m_{f}")) / F.coalesce(F.nullif(F.col(f"_s_{f}"), F.lit(0.0)), F.lit(1.0))).alias(f) for f in features],
    )
