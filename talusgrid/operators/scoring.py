"""Risk maps scored by bands, with counters of each tile and a manifest from which a stopped run goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talusgrid.sources import geotiff, tables


#: The jobs of one call of ``score_tiles`` at most, so that small tiles don't make as many jobs as bands.
JOBS = 16


def score_tiles(
    pixels: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, side: int = 2048, tile_rows: int = 1, most: int | None = None
) -> DataFrame:
    """``pixels`` scored by ``score`` (``row, col, risk`` of some rows) below ``path``; the manifest so far.

    A band is ``tile_rows`` rows of tiles of ``side`` pixels. Bands are scored
    one by one, or in ``JOBS`` runs of neighbours if there are more: one
    condition on ``row``, which reaches the source, and one Spark job. A run's
    scores are written before its part of the manifest, and its bands count as
    done by the latter alone; so a call that was stopped anywhere, and made
    again, scores what is missing and nothing that was done. At most ``most``
    bands are scored in this call. A table scored with another ``side`` or
    ``tile_rows`` raises ValueError. No pixels make an empty manifest.
    """
    if side < 1 or tile_rows < 1:
        raise ValueError("side and tile_rows have to be at least 1")
    spark = pixels.sparkSession
    plan = tables.made_once(spark, f"{path}/plan", lambda: spark.createDataFrame([(side, tile_rows)], "side int, tile_rows int")).first()
    if (plan["side"], plan["tile_rows"]) != (side, tile_rows):
        raise ValueError(f"{path} was begun with tiles of {plan['side']} pixels, {plan['tile_rows']} rows of them a band")
    high = side * tile_rows
    done = {r[0] for r in manifest(spark, path).select("band").distinct().collect()}  # bands, not tiles
    ends = pixels.agg(F.min("row"), F.max("row")).first()
    bands = [] if ends[0] is None else [b for b in range(ends[0] // high, ends[1] // high + 1) if b not in done]
    for first, last in _runs(bands[:most]):
        part = pixels.where((F.col("row") >= first * high) & (F.col("row") < (last + 1) * high))
        scored = part.select("row", "col").join(score(part).select("row", "col", "risk"), ["row", "col"], "left")
        name = f"band={first}" if first == last else f"bands={first}..{last}"
        scored.write.mode("overwrite").parquet(f"{path}/scores/{name}")
        counted = counters(spark.read.schema(scored.schema).parquet(f"{path}/scores/{name}"), side)
        counted.write.mode("overwrite").parquet(f"{path}/manifest/{name}")
    return manifest(spark, path)


def _runs(bands: list[int]) -> list[tuple[int, int]]:
    """First and last of runs of neighbours that hold all ``bands``, each at most a ``JOBS``-th of them."""
    size = -(-len(bands) // JOBS)
    runs: list[tuple[int, int]] = []
    for b in bands:
        if runs and b == runs[-1][1] + 1 and b - runs[-1][0] < size:
            runs[-1] = (runs[-1][0], b)
        else:
            runs.append((b, b))
    return runs


_COUNTERS = "tile_row int, tile_col int, n_pixels long, n_scored long, risk_min double, risk_max double, risk_sum double"


def counters(risk: DataFrame, side: int) -> DataFrame:
    """A row for each tile of ``row, col, risk``: pixels, scored ones, least, greatest and summed risk."""
    at = [F.floor(F.col(c) / side).cast("int").alias(f"tile_{c}") for c in ("row", "col")]
    r = F.col("risk")
    return risk.groupBy(*at).agg(
        F.count("*").alias("n_pixels"), F.count(r).alias("n_scored"), F.min(r).alias("risk_min"), F.max(r).alias("risk_max"), F.sum(r).alias("risk_sum")
    )


def _bands(spark: SparkSession, path: str, kind: str, columns: str) -> DataFrame:
    """The parts below ``path`` whose writing ended."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    ended = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/band*/_SUCCESS")
    )
    names = [s.getPath().getParent().getName() for s in ended or []]
    if not names:
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(*[f"{path}/{kind}/{n}" for n in names])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The counters of every tile that was scored, and its ``band``."""
    tile_rows = spark.read.schema("side int, tile_rows int").parquet(f"{path}/plan").first()["tile_rows"]
    return _bands(spark, path, "manifest", _COUNTERS).withColumn("band", F.floor(F.col("tile_row") / tile_rows).cast("int"))


def scores(spark: SparkSession, path: str) -> DataFrame:
    """``row, col, risk`` of every band that the manifest holds; what a stopped run left half done isn't read."""
    return _bands(spark, path, "scores", "row int, col int, risk double")


def summary(counted: DataFrame) -> DataFrame:
    """One row over a manifest: tiles, pixels, scored ones, least, greatest and mean risk (null without any)."""
    return counted.agg(
        F.count("*").alias("n_tiles"), F.coalesce(F.sum("n_pixels"), F.lit(0)).alias("n_pixels"), F.coalesce(F.sum("n_scored"), F.lit(0)).alias("n_scored"),
        F.min("risk_min").alias("risk_min"), F.max("risk_max").alias("risk_max"), F.try_divide(F.sum("risk_sum"), F.sum("n_scored")).alias("risk_mean"),
    )


def write_samples(samples: DataFrame, path: str, place: geotiff.Meta, fold: str = "fold", side: int = 512) -> list[str]:
    """One raster of labels for each fold, ``fold_labels_samples_fold<k>.tif`` below ``path``; their paths.

    Pixels that no sample holds are missing (-9999).
    """
    written = []
    for k in [r[0] for r in samples.select(fold).distinct().orderBy(fold).collect()]:  # folds, a few
        out = f"{path}/fold_labels_samples_fold{k}.tif"
        rows = samples.where(F.col(fold) == k).select("row", "col", F.col("label").cast("double").alias("label"))
        geotiff.write_raster(rows, out, place, "label", "f4", -9999.0, side, "deflate", "fold_labels_samples")
        written.append(out)
    return written
