"""Raster algebra, resampling and rasterisation of rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.functions import geodesy

from .grid import box_variance, gaussian

#: Side of the cells by which rectangles and pixels meet.
CELL = 32


def subtract(surface: DataFrame, layer: DataFrame, value: str = "z", other: str = "ice") -> DataFrame:
    """Surface minus layer, the surface alone where there is no layer."""
    rest = F.col(value) - F.coalesce(F.col(other), F.lit(0.0))
    return surface.join(layer, ["row", "col"], "left").select("row", "col", rest.alias(value))


def quantise(df: DataFrame, value: str = "z") -> DataFrame:
    """Whole numbers from 0 to 65534, halves to even; null is 65535."""
    whole = F.greatest(F.least(F.bround(value, 0), F.lit(65534.0)), F.lit(0.0)).cast("int")
    return df.withColumn(value, F.coalesce(F.when(F.col(value).isNotNull(), whole), F.lit(65535)))


def resample_nearest(grid: DataFrame, source: DataFrame, factor: float, value: str) -> DataFrame:
    """``grid``'s pixels with the value of the source pixel that holds their centre."""
    at = {f"s_{a}": F.floor((F.col(a) + 0.5) / factor).cast("int") for a in ("row", "col")}
    src = source.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), value)
    return grid.withColumns(at).join(src, ["s_row", "s_col"], "left").drop("s_row", "s_col")


def _cells(low: str, high: str):
    return F.explode(F.sequence(F.floor(F.col(low) / CELL), F.floor(F.col(high) / CELL)))


def inside(grid: DataFrame, shapes: DataFrame, touched: bool = False) -> DataFrame:
    """``row, col`` with the shapes (rectangles ``x0, x1, y0, y1``) that hold the pixel.

    A pixel belongs to a shape that holds its centre; with ``touched``, to any
    it touches. Shapes and pixels meet by coarse cells, so the join is on
    equal keys and a shape of any size is spread over its cells.
    """
    reach = 1.0 if touched else 0.5
    spread = shapes.select("*", _cells("x0", "x1").alias("_cx")).select("*", _cells("y0", "y1").alias("_cy"))
    if touched:  # a pixel's near edge may lie in the cell before its shape's
        spread = spread.select(
            *[c for c in spread.columns if c not in ("_cx", "_cy")],
            F.explode(F.array(F.col("_cx"), F.col("_cx") - 1)).alias("_cx"),
            "_cy",
        ).select("*", F.explode(F.array(F.col("_cy"), F.col("_cy") - 1)).alias("_cy2"))
        spread = spread.drop("_cy").withColumnRenamed("_cy2", "_cy").distinct()
    keyed = grid.withColumns({"_cx": F.floor(F.col("col") / CELL), "_cy": F.floor(F.col("row") / CELL)})
    low, high = (0.0, reach) if touched else (0.5, 0.5)
    met = (
        (F.col("col") + high >= F.col("x0"))
        & (F.col("col") + low <= F.col("x1"))
        & (F.col("row") + high >= F.col("y0"))
        & (F.col("row") + low <= F.col("y1"))
    )
    return keyed.join(spread, ["_cx", "_cy"]).where(met).drop("_cx", "_cy")


def clip(grid: DataFrame, shapes: DataFrame, buffer: float) -> DataFrame:
    """Pixels with their centre in a shape's bounds, widened by ``buffer``."""
    wide = shapes.select(
        (F.col("x0") - buffer).alias("x0"), (F.col("x1") + buffer).alias("x1"),
        (F.col("y0") - buffer).alias("y0"), (F.col("y1") + buffer).alias("y1"),
    )
    keep = inside(grid.select("row", "col"), wide).select("row", "col").distinct()
    return grid.join(keep, ["row", "col"], "left_semi")


def rasterise(grid: DataFrame, shapes: DataFrame, value: str, order: str, fill: int = -1) -> DataFrame:
    """Each pixel with the value of the last shape, in table order, that touches it."""
    burned = inside(grid.select("row", "col"), shapes, touched=True)
    last = burned.groupBy("row", "col").agg(F.max_by(value, order).alias(value))
    return grid.select("row", "col").join(last, ["row", "col"], "left").withColumn(
        value, F.coalesce(value, F.lit(fill)).cast("int")
    )


def within(grid: DataFrame, shapes: DataFrame, distance: float) -> DataFrame:
    """``row, col`` with the rectangles no further than ``distance`` from the pixel's centre."""
    wide = shapes.select(
        "*", F.struct("x0", "x1", "y0", "y1").alias("_box")
    ).withColumns({"x0": F.col("x0") - distance, "x1": F.col("x1") + distance, "y0": F.col("y0") - distance, "y1": F.col("y1") + distance})
    away = lambda at, low, high: F.greatest(F.col(low) - at, at - F.col(high), F.lit(0.0))
    dx, dy = away(F.col("col") + 0.5, "_box.x0", "_box.x1"), away(F.col("row") + 0.5, "_box.y0", "_box.y1")
    return inside(grid, wide).where(dx * dx + dy * dy <= distance * distance).drop("_box")


def priority_labels(grid: DataFrame, outlines: DataFrame, zones: DataFrame, buffer: float, value: str = "z") -> DataFrame:
    """3 in a zone, else 2 within ``buffer`` of one, else 1 in an outline and valid, else 0."""
    pixels = grid.select("row", "col")
    marks = (
        inside(grid.where(F.col(value).isNotNull()).select("row", "col"), outlines).select("row", "col", F.lit(1).alias("m"))
        .unionByName(within(pixels, zones, buffer).select("row", "col", F.lit(2).alias("m")))
        .unionByName(inside(pixels, zones).select("row", "col", F.lit(3).alias("m")))
        .groupBy("row", "col")
        .agg(F.max("m").alias("label"))
    )
    return pixels.join(marks, ["row", "col"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def align(grid: DataFrame, source: DataFrame, value: str, target: dict[str, float], origin: dict[str, float]) -> DataFrame:
    """``grid``'s pixels with the value of the source pixel that holds their centre, by coordinates.

    ``target`` and ``origin`` are the places of the two rasters: ``x0, y0`` of
    the upper left corner and ``dx, dy`` of a pixel; rows run down. Where the
    source has no pixel the value is null.
    """
    x = target["x0"] + (F.col("col") + 0.5) * target["dx"]
    y = target["y0"] - (F.col("row") + 0.5) * target["dy"]
    at = {"s_row": F.floor((origin["y0"] - y) / origin["dy"]).cast("int"), "s_col": F.floor((x - origin["x0"]) / origin["dx"]).cast("int")}
    src = source.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), value)
    return grid.withColumns(at).join(src, ["s_row", "s_col"], "left").drop("s_row", "s_col")


def warp_nearest(
    grid: DataFrame, source: DataFrame, value: str, target: dict[str, float], origin: dict[str, float], target_crs: str, source_crs: str | None
) -> DataFrame:
    """``align`` between rasters of two coordinate systems: a target pixel's centre is taken back to the source's system.

    One join on equal pixels; every target pixel has one row, null where the
    source has no pixel. Systems are those of ``geodesy.transform``.
    """
    centres = grid.withColumns({
        "s_x": target["x0"] + (F.col("col") + 0.5) * target["dx"], "s_y": target["y0"] - (F.col("row") + 0.5) * target["dy"],
    })
    if source_crs is None:
        raise ValueError("the source has no coordinate system")
    back = geodesy.transform(centres, "s_x", "s_y", target_crs, source_crs)
    at = {
        "s_row": F.floor((origin["y0"] - F.col("s_y")) / origin["dy"]).cast("int"), "s_col": F.floor((F.col("s_x") - origin["x0"]) / origin["dx"]).cast("int"),
    }
    src = source.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), value)
    return back.withColumns(at).join(src, ["s_row", "s_col"], "left").drop("s_row", "s_col", "s_x", "s_y")


def crop(df: DataFrame) -> DataFrame:
    """Rows and columns counted anew from the least that is left."""
    ends = df.agg(F.min("row").alias("_r"), F.min("col").alias("_c"))  # one row
    moved = {"row": (F.col("row") - F.col("_r")).cast("int"), "col": (F.col("col") - F.col("_c")).cast("int")}
    return df.crossJoin(F.broadcast(ends)).withColumns(moved).drop("_r", "_c")


def bedrock(surface: DataFrame, ice: DataFrame, outlines: DataFrame, buffer: float, target: dict, origin: dict) -> DataFrame:
    """The ground below the ice: aligned, subtracted, clipped to the widened outlines, cropped, quantised.

    ``surface`` has ``row, col, z``, ``ice`` ``row, col, ice`` on its own grid.
    """
    thick = align(surface.select("row", "col"), ice, "ice", target, origin)
    return quantise(crop(clip(subtract(surface, thick), outlines, buffer)))


def roughness_sigma(surface: DataFrame, ice: DataFrame, value: str = "z", other: str = "ice") -> DataFrame:
    """One row ``sigma``: how much the surface has to be smoothed to be as rough as the ice.

    The square root of the ratio of their mean local deviations in squares of
    5 pixels, less one, between 0.5 and 5; 1 where no more than 1000 pixels
    have both or a mean is not positive. A deviation is null unless its whole
    square is valid.
    """
    local = lambda df, v, name: box_variance(df.select("row", "col", v), value=v).select("row", "col", F.sqrt("local_variance").alias(name))
    both = local(surface, value, "a").join(local(ice, other, "b"), ["row", "col"]).where("a IS NOT NULL AND b IS NOT NULL")
    means = both.agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.count("*").alias("n"))
    sigma = F.least(F.greatest(F.sqrt(F.col("a") / F.col("b")) - 1, F.lit(0.5)), F.lit(5.0))
    return means.select(F.when((F.col("n") > 1000) & (F.col("a") > 0) & (F.col("b") > 0), sigma).otherwise(F.lit(1.0)).alias("sigma"))


def smooth_filled(df: DataFrame, sigma: float, height: int, width: int, value: str = "z") -> DataFrame:
    """Smoothing that takes missing pixels for zeros and leaves them missing."""
    filled = df.select("row", "col", F.coalesce(value, F.lit(0.0)).alias(value), F.col(value).isNull().alias("_gone"))
    soft = gaussian(filled, sigma, height, width, value)
    return soft.select("row", "col", F.when(~F.col("_gone"), F.col(value)).alias(value))


def smoothed_bedrock(
    surface: DataFrame, ice: DataFrame, outlines: DataFrame, buffer: float, target: dict, origin: dict, height: int, width: int, sigma: float | None = None
) -> DataFrame:
    """``bedrock`` of the smoothed surface; without ``sigma``, of ``roughness_sigma``."""
    thick = align(surface.select("row", "col"), ice, "ice", target, origin)
    if sigma is None:
        sigma = roughness_sigma(surface, thick).first()["sigma"]
    soft = smooth_filled(surface, sigma, height, width)
    return quantise(crop(clip(subtract(soft, thick), outlines, buffer)))
