"""Neighbourhood operators on dense grids of ``(row, col, value)`` rows.

Every pixel of the grid exists as a row; a missing value is null. Each
operator shuffles the grid once, into square tiles with a margin of their
neighbours' pixels, and then works along the rows and the columns of each tile
with window functions: both kinds of line lie within the tile's partition.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Pixels along the side of a tile. A wide margin wants larger ones: the rows
#: grow by ``(1 + 2 * margin / TILE) ** 2``.
TILE = 128


def tiles(df: DataFrame, margin: int, side: int = TILE) -> DataFrame:
    """``df`` with ``_tr, _tc``: each pixel in its own tile and in those whose margin it lies in."""
    reach = lambda axis: F.sequence(
        F.greatest(F.floor((F.col(axis) - margin) / side), F.lit(0)), F.floor((F.col(axis) + margin) / side)
    )
    return df.withColumn("_tr", F.explode(reach("row"))).withColumn("_tc", F.explode(reach("col"))).repartition("_tr", "_tc")


def core(df: DataFrame, side: int = TILE) -> DataFrame:
    """The pixels of ``tiles`` without the margins."""
    own = (F.floor(F.col("row") / side) == F.col("_tr")) & (F.floor(F.col("col") / side) == F.col("_tc"))
    return df.where(own).drop("_tr", "_tc")


def line(axis: str):
    """The window along an axis of a tile: 'col' walks along a row, 'row' down a column."""
    other = "row" if axis == "col" else "col"
    return Window.partitionBy("_tr", "_tc", other).orderBy(axis)


def weights(sigma: float) -> list[float]:
    """Gaussian weights out to four sigmas, summing to one."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-(k**2) / (2 * sigma**2)) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def _smooth(df: DataFrame, value: str, axis: str, size: int, w: list[float]) -> DataFrame:
    radius = len(w) // 2
    at = F.col(axis)
    turns = range(-(radius // (2 * size)) - 1, radius // (2 * size) + 2)  # a line may be mirrored more than once
    reach = [F.when(x.between(-radius, size - 1 + radius), x) for k in turns for x in (at + 2 * size * k, 2 * size * k - 1 - at)]
    places = F.array_compact(F.array(*reach))
    mirrored = df.withColumn(axis, F.explode(places))
    along = line(axis)
    total = reduce(
        lambda a, b: a + b, [F.lit(x) * F.lag(value, radius - k).over(along) for k, x in enumerate(w)]
    )
    return mirrored.withColumn(value, total).where((at >= 0) & (at < size))


def _soft(cut: DataFrame, sigma: float, height: int, width: int, value: str) -> DataFrame:
    if sigma <= 0:
        return cut
    w = weights(sigma)
    return _smooth(_smooth(cut, value, "row", height, w), value, "col", width, w)


def _margin(sigma: float) -> int:
    """Pixels that a smoothed value takes from around it, and three differences of it."""
    return (len(weights(sigma)) // 2 if sigma > 0 else 0) + 3


def gaussian(df: DataFrame, sigma: float, height: int, width: int, value: str = "z") -> DataFrame:
    """Separable smoothing, mirrored at the edges; null wherever the stencil meets null."""
    if sigma <= 0:
        return df
    return core(_soft(tiles(df, _margin(sigma)), sigma, height, width, value))


def gradient(value: str, axis: str, size: int, step: float = 1.0) -> Column:
    """Central differences; one-sided at the first and last pixel of a line."""
    along = line(axis)
    here, after, before = F.col(value), F.lead(value).over(along), F.lag(value).over(along)
    return (
        F.when(F.col(axis) == 0, (after - here) / step)
        .when(F.col(axis) == size - 1, (here - before) / step)
        .otherwise((after - before) / (2 * step))
    )


def derivatives(df: DataFrame, height: int, width: int, dx: float = 1.0, dy: float = 1.0, value: str = "z") -> DataFrame:
    """``p, q`` and the second differences ``zxx, zyy, zxy`` of a surface in ``tiles``."""
    first = df.withColumns({"p": gradient(value, "col", width, dx), "q": gradient(value, "row", height, dy)})
    return first.withColumns(
        {
            "zxx": gradient("p", "col", width, dx),
            "zyy": gradient("q", "row", height, dy),
            "zxy": gradient("p", "row", height, dy),
        }
    )


def _slope() -> Column:
    return F.degrees(F.atan(F.sqrt(F.col("p") ** 2 + F.col("q") ** 2)))


def _g() -> Column:
    return F.col("p") * F.col("p") + F.col("q") * F.col("q")


def _mean() -> Column:
    p, q = F.col("p"), F.col("q")
    top = F.col("zxx") * (1 + q * q) - 2 * F.col("zxy") * p * q + F.col("zyy") * (1 + p * p)
    return top / (2 * F.pow(1 + _g(), 1.5))


def _gauss() -> Column:
    return (F.col("zxx") * F.col("zyy") - F.col("zxy") * F.col("zxy")) / F.pow(1 + _g(), 2.0)


def _spread() -> Column:
    return F.sqrt(F.greatest(_mean() * _mean() - _gauss(), F.lit(0.0)))


def _profile() -> Column:
    p, q = F.col("p"), F.col("q")
    top = F.col("zxx") * p * p + 2 * F.col("zxy") * p * q + F.col("zyy") * q * q
    return top / F.nullif(F.pow(_g(), 1.5), F.lit(0.0))


def _planform() -> Column:
    p, q = F.col("p"), F.col("q")
    top = F.col("zxx") * q * q - 2 * F.col("zxy") * p * q + F.col("zyy") * p * p
    return top / F.nullif(F.sqrt(_g()), F.lit(0.0))


#: Attribute name to its expression over ``derivatives``.
ATTRIBUTES = {
    "slope": _slope,
    "profile_curvature": _profile,
    "planform_curvature": _planform,
    "mean_curvature": _mean,
    "gaussian_curvature": _gauss,
    "max_curvature": lambda: _mean() + _spread(),
    "min_curvature": lambda: _mean() - _spread(),
}


def terrain(
    df: DataFrame,
    attribute: str,
    sigma: float,
    height: int,
    width: int,
    dx: float = 1.0,
    dy: float = 1.0,
    value: str = "z",
) -> DataFrame:
    """``row, col`` and the attribute of the smoothed surface, named for its sigma.

    'elevation' is the smoothed surface itself; 'slope_break_index' is the size
    of the slope's own gradient and smooths by half a pixel at least. An
    unknown attribute raises ValueError.
    """
    name = f"{attribute}_sigma{sigma:g}"
    if attribute == "elevation":
        return gaussian(df, sigma, height, width, value).select("row", "col", F.col(value).alias(name))
    if attribute == "slope_break_index":
        sigma = max(sigma, 0.5)
        soft = _soft(tiles(df.select("row", "col", value), _margin(sigma)), sigma, height, width, value)
        steep = derivatives(soft, height, width, dx, dy, value).withColumn("s", _slope())
        both = steep.withColumns({"sx": gradient("s", "col", width, dx), "sy": gradient("s", "row", height, dy)})
        return core(both).select("row", "col", F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2).alias(name))
    if attribute not in ATTRIBUTES:
        raise ValueError(f"unknown attribute {attribute}")
    soft = _soft(tiles(df.select("row", "col", value), _margin(sigma)), sigma, height, width, value)
    return core(derivatives(soft, height, width, dx, dy, value)).select("row", "col", ATTRIBUTES[attribute]().alias(name))


def spans(radius: int) -> dict[int, int]:
    """Half the width of a disc at each vertical offset."""
    return {d: math.isqrt(radius * radius - d * d) for d in range(-radius, radius + 1)}


def bins(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``vmin, vmax`` of the grid and the value's bin of 256."""
    ends = df.agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))
    scaled = (F.col(value) - F.col("vmin")) / F.nullif(F.col("vmax") - F.col("vmin"), F.lit(0.0)) * 255
    bin_ = F.greatest(F.least(F.coalesce(scaled.cast("int"), F.lit(0)), F.lit(255)), F.lit(0))
    return df.crossJoin(F.broadcast(ends)).withColumn("bin", F.when(F.col(value).isNotNull(), bin_))


def focal(df: DataFrame, stat: str, radius: int, value: str = "z") -> DataFrame:
    """A statistic of the disc around each pixel, null unless all of it is valid.

    'std' and 'var' are of the values (population). 'min', 'max', 'range',
    'mean' and 'median' are of 256 bins between the grid's extremes, scaled
    back; the mean's bin is cut to a whole one. Unknown ones raise ValueError.

    A disc is cut into row spans: one window for each distinct width along
    rows, then the spans are put together down columns. The median has no such
    parts: its bins are counted by ``neighbourhood.zonal``.
    """
    if stat not in ("std", "var", "min", "max", "range", "mean", "median"):
        raise ValueError(f"unknown statistic {stat}")
    if stat == "median":
        from .neighbourhood import zonal

        return zonal(df, [value], [stat], [radius])
    binned = stat not in ("std", "var")
    src = bins(df, value) if binned else df
    x = F.col("bin").cast("double") if binned else F.col(value).cast("double")
    src = tiles(src.withColumn("x", x).select("row", "col", "x", *(["vmin", "vmax"] if binned else [])), radius)
    cut, along, down = spans(radius), line("col"), line("row")
    widths = sorted(set(cut.values()))
    made = {}
    for s in widths:
        over = along.rowsBetween(-s, s)
        made[f"n{s}"] = F.count("x").over(over)
        if stat in ("std", "var", "mean"):
            made[f"s{s}"] = F.sum("x").over(over)
        if stat in ("std", "var"):
            made[f"q{s}"] = F.sum(F.col("x") * F.col("x")).over(over)
        if stat in ("min", "range"):
            made[f"l{s}"] = F.min("x").over(over)
        if stat in ("max", "range"):
            made[f"h{s}"] = F.max("x").over(over)
    wide = src.withColumns(made)
    at = lambda kind: [F.lag(f"{kind}{s}", -d).over(down) for d, s in cut.items()]
    plus = lambda columns: reduce(lambda a, b: a + b, columns)
    size = sum(2 * s + 1 for s in cut.values())
    full = plus([F.coalesce(c, F.lit(0)) for c in at("n")]) == size
    back = lambda b: F.col("vmin") + b / 255 * (F.col("vmax") - F.col("vmin"))
    if stat in ("std", "var"):
        mean = plus(at("s")) / size
        out = F.greatest(plus(at("q")) / size - mean * mean, F.lit(0.0))
        out = F.sqrt(out) if stat == "std" else out
    elif stat == "mean":
        out = back(F.floor(plus(at("s")) / size))
    else:
        low = F.least(*at("l")) if stat != "max" else None
        high = F.greatest(*at("h")) if stat != "min" else None
        out = back(low) if stat == "min" else back(high) if stat == "max" else back(high) - back(low)
    name = f"{value}_{stat}_w{radius}"
    return core(wide.withColumn(name, F.when(full, out))).select("row", "col", name)


def box_variance(df: DataFrame, half: int = 2, value: str = "z") -> DataFrame:
    """Local variance in a square, null unless all of it is valid."""
    along, down = line("col").rowsBetween(-half, half), line("row").rowsBetween(-half, half)
    lines = tiles(df.select("row", "col", value), half).withColumns(
        {
            "n": F.count(value).over(along),
            "s": F.sum(value).over(along),
            "q": F.sum(F.col(value) * F.col(value)).over(along),
        }
    )
    size = (2 * half + 1) ** 2
    mean = F.sum("s").over(down) / size
    var = F.greatest(F.sum("q").over(down) / size - mean * mean, F.lit(0.0))
    return core(lines.withColumn("local_variance", F.when(F.sum("n").over(down) == size, var))).select("row", "col", "local_variance")


def dilate(df: DataFrame, flag: str, steps: int) -> DataFrame:
    """``df`` with ``near``: whether a flagged pixel lies within ``steps``, diagonals included."""
    one = F.when(F.col(flag), 1).otherwise(0)
    rows = tiles(df, steps).withColumn("_r", F.max(one).over(line("col").rowsBetween(-steps, steps)))
    near = F.max("_r").over(line("row").rowsBetween(-steps, steps)) == 1
    return core(rows.withColumn("near", near).drop("_r"))


def extract_features(df: DataFrame, wanted: dict[str, list[float]], height: int, width: int, dx: float = 1.0, dy: float = 1.0, value: str = "z") -> DataFrame:
    """Attributes of all sigmas at once: ``neighbourhood.attributes``."""
    from .neighbourhood import attributes

    return attributes(df, wanted, height, width, dx, dy, value)


def zonal_features(df: DataFrame, columns: list[str], stats: list[str], radii: list[int]) -> DataFrame:
    """Disc statistics of all columns and radii at once: ``neighbourhood.zonal``."""
    from .neighbourhood import zonal

    return zonal(df, columns, stats, radii)
