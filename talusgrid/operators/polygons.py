"""Rasterising of general polygons and what lies near them, with DataFrame functions only.

A shape is an id and its rings, ``rings ARRAY<ARRAY<STRUCT<x, y>>>`` in pixel
units (pixel ``(row, col)`` spans ``[col, col + 1) x [row, row + 1)``). Rings may
be open or closed; holes are rings too, as inside means an odd number of
crossings. The work is split by edge and then by shape and line, so no task
holds more than the crossings of one line of one shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import clip as clip_boxes

#: Edges are cut to this length, in pixels, before the pixels near them are listed.
PIECE = 32
#: Edges whose neighbourhoods one task lists, so that tasks grow in number, not in memory.
SHARE = 2000


def edges(shapes: DataFrame, key: str, rings: str = "rings", closed: bool = True) -> DataFrame:
    """``key, x1, y1, x2, y2``: one row for each edge; rings are closed, lines with ``closed=False`` are not."""
    ring = shapes.select(key, F.explode(rings).alias("_ring")).where(F.size("_ring") >= 2)
    after = F.slice("_ring", F.lit(2), F.size("_ring") - 1)
    after = F.concat(after, F.slice("_ring", 1, 1)) if closed else after
    before = F.col("_ring") if closed else F.slice("_ring", F.lit(1), F.size("_ring") - 1)
    pair = ring.select(key, F.explode(F.arrays_zip(before.alias("a"), after.alias("b"))).alias("e"))
    return pair.select(
        key,
        F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"),
        F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"),
    ).where("x1 <> x2 or y1 <> y2")


def _steps(first: Column, last: Column, low: int | None, high: int | None) -> Column:
    """The whole numbers from ``first`` to ``last`` that lie in ``[low, high)``; all without these."""
    a = first.cast("long") if low is None else F.greatest(first, F.lit(low)).cast("int")
    b = last.cast("long") if high is None else F.least(last, F.lit(high - 1)).cast("int")
    return F.explode(F.when(a <= b, F.sequence(a, b)))


def spans(sides: DataFrame, key: str, height: int | None = None) -> DataFrame:
    """``key, row, a, b``: where each shape begins and ends along the middle of a row, once for each time."""
    low = None if height is None else 0
    top, bottom = F.least("y1", "y2"), F.greatest("y1", "y2")
    y = F.col("row") + 0.5
    # half-open, so that a corner on a line counts once
    hits = sides.where("y1 <> y2").select(
        "*", _steps(F.ceil(top - 0.5), F.ceil(bottom - 0.5) - 1, low, height).alias("row")
    ).select(key, "row", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    crossed = hits.groupBy(key, "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return crossed.select(
        key, "row", "xs", F.explode(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2))).alias("_pair")
    ).select(key, "row", F.element_at("xs", F.col("_pair")).alias("a"), F.element_at("xs", F.col("_pair") + 1).alias("b"))


def centres(sides: DataFrame, key: str, height: int | None = None, width: int | None = None) -> DataFrame:
    """``key, row, col``: the pixels whose centre lies inside, of a grid or, without its size, of the whole plane."""
    low = None if width is None else 0
    return spans(sides, key, height).select(key, "row", _steps(F.ceil(F.col("a") - 0.5), F.ceil(F.col("b") - 0.5) - 1, low, width).alias("col"))


def _touched(sides: DataFrame, key: str, height: int, width: int) -> DataFrame:
    top, bottom = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = sides.select("*", _steps(F.floor(top), F.floor(bottom), 0, height).alias("row"))

    def at(y: Column) -> Column:
        held = F.least(F.greatest(y, top), bottom)
        return F.col("x1") + (held - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))

    flat = F.col("y1") == F.col("y2")
    a = F.when(flat, F.col("x1")).otherwise(at(F.col("row")))
    b = F.when(flat, F.col("x2")).otherwise(at(F.col("row") + 1))
    return rows.select(key, "row", _steps(F.floor(F.least(a, b)), F.floor(F.greatest(a, b)), 0, width).alias("col"))


def cover(shapes: DataFrame, key: str, height: int, width: int, touched: bool = False, rings: str = "rings") -> DataFrame:
    """``key, row, col``: the pixels of a grid that each shape covers, once each.

    A pixel is covered when its centre is inside; with ``touched``, also when an
    edge passes through it. Null or empty rings and rings of one point cover
    nothing; parts outside the grid are left out.
    """
    sides = edges(shapes, key, rings)
    inside = centres(sides, key, height, width)
    if touched:
        inside = inside.unionByName(_touched(sides, key, height, width)).distinct()
    return inside


def burn(
    grid: DataFrame, shapes: DataFrame, key: str, value: str, order: str,
    height: int, width: int, touched: bool = True, fill: int = -1, rings: str = "rings",
) -> DataFrame:
    """Each pixel of ``grid`` with the value of the last shape, by ``order``, that covers it."""
    named = shapes.select(F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_s"), F.col(rings).alias("_r"))
    last = cover(named, "_s", height, width, touched, "_r").groupBy("row", "col").agg(F.max("_s")["v"].alias(value))
    return grid.select("row", "col").join(last, ["row", "col"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def near(shapes: DataFrame, key: str, height: int, width: int, distance: float, rings: str = "rings", closed: bool = True) -> DataFrame:
    """``key, row, col``: the pixels of a grid whose centre is no further than ``distance`` from an edge, once each.

    Long edges are cut into pieces, and each piece lists the few pixels around
    it, so the work grows with the outlines' length and no task meets a whole
    raster. Distances are of the whole edge, exact.
    """
    sides = edges(shapes, key, rings, closed)
    n = _tasks(sides)
    return _beside(sides.repartition(n), key, height, width, distance).repartition(n, key, "row").distinct()


def _tasks(sides: DataFrame) -> int:
    return max(sides.sparkSession.sparkContext.defaultParallelism, -(-sides.count() // SHARE))


def _beside(sides: DataFrame, key: str, height: int, width: int, distance: float) -> DataFrame:
    """The pixels of ``near``, once for each edge that they are near to."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / PIECE), F.lit(1)).cast("int")
    parts = sides.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    at = lambda low, d, k: F.col(low) + d * (F.col("_k") + k) / F.col("_n")
    parts = parts.withColumns({"_ax": at("x1", dx, 0), "_bx": at("x1", dx, 1), "_ay": at("y1", dy, 0), "_by": at("y1", dy, 1)})
    span = lambda a, b, size: _steps(F.floor(F.least(a, b) - distance - 0.5), F.ceil(F.greatest(a, b) + distance - 0.5), 0, size)
    pixels = parts.select("*", span("_ay", "_by", height).alias("row")).select("*", span("_ax", "_bx", width).alias("col"))
    x, y = F.col("col") + 0.5, F.col("row") + 0.5
    t = ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / (dx * dx + dy * dy)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    away_x, away_y = x - (F.col("x1") + t * dx), y - (F.col("y1") + t * dy)
    return pixels.where(away_x * away_x + away_y * away_y <= distance * distance).select(key, "row", "col")


def within(shapes: DataFrame, key: str, height: int, width: int, distance: float, rings: str = "rings") -> DataFrame:
    """``key, row, col``: the pixels whose centre is in a shape or no further than ``distance`` from it: its round buffer."""
    sides = edges(shapes, key, rings)
    n = _tasks(sides)
    sides = sides.repartition(n)
    both = centres(sides, key, height, width).unionByName(_beside(sides, key, height, width, distance))
    return both.repartition(n, key, "row").distinct()


def boxes(shapes: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """``key, x0, x1, y0, y1``: the bounds of each shape that has points."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return shapes.where(F.size(points) > 0).select(
        key, F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1")
    )


def clip(grid: DataFrame, shapes: DataFrame, key: str, buffer: float, rings: str = "rings") -> DataFrame:
    """Pixels with their centre in the bounds, widened by ``buffer``, of any shape.

    The bounds of a shape's round buffer are its own, widened; shapes that
    overlap count once.
    """
    return clip_boxes(grid, boxes(shapes, key, rings), buffer)


def priority_labels(
    grid: DataFrame, outlines: DataFrame, zones: DataFrame, key: str, buffer: float, height: int, width: int, value: str = "z", rings: str = "rings"
) -> DataFrame:
    """3 in a zone, else 2 within ``buffer`` of one, else 1 in an outline and valid, else 0."""
    marked = lambda df, m: df.select("row", "col", F.lit(m).alias("m"))
    held = marked(cover(outlines, key, height, width, rings=rings), 1)
    valid = grid.where(F.col(value).isNotNull()).select("row", "col")
    marks = (
        held.distinct().join(valid, ["row", "col"])
        .unionByName(marked(near(zones, key, height, width, buffer, rings), 2))
        .unionByName(marked(cover(zones, key, height, width, rings=rings), 3))
        .groupBy("row", "col")
        .agg(F.max("m").alias("label"))
    )
    return grid.select("row", "col").join(marks, ["row", "col"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
