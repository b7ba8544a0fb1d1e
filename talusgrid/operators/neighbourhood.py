"""Terrain attributes and disc statistics of whole tiles at once.

``grid`` works a statistic at a time with window functions. Here the raster is
shuffled once, into tiles whose margin serves the widest stencil asked for,
and each task makes all columns of its tile from arrays: every attribute of
every sigma, or every statistic of every radius. Radii share their row spans:
the span of half width w is that of w - 1 and two pixels more, and a disc is
its rows' spans, shifted. So a disc of radius r costs in the order of r passes
over the tile, not r squared, for sums, counts and extremes alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import Feature
from .grid import spans, weights

#: Least side of a tile, and how many times its pixels a tile with its margin may have.
SIDE = 128
MOST = 1.3
STATISTICS = ("std", "var", "min", "max", "range", "mean", "median")
ATTRIBUTES = (
    "elevation", "slope", "slope_break_index", "profile_curvature", "planform_curvature", "mean_curvature",
    "gaussian_curvature", "max_curvature", "min_curvature",
)


def side_for(margin: int) -> int:
    """The least side, doubled from ``SIDE``, at which the margin makes few more rows."""
    side = SIDE
    while (1 + 2 * margin / side) ** 2 > MOST:
        side *= 2
    return side


def by_tile(df: DataFrame, margin: int, side: int) -> DataFrame:
    """``df`` with ``_tr, _tc``: each pixel's own tile and those in whose margin it lies."""
    at = lambda axis: F.explode(
        F.sequence(F.greatest(F.floor((F.col(axis) - margin) / side), F.lit(0)), F.floor((F.col(axis) + margin) / side))
    )
    return df.withColumn("_tr", at("row")).withColumn("_tc", at("col"))


class Tile:
    """A tile's rows as arrays of the tile and its margin; NaN where there is no value."""

    def __init__(self, keys: tuple, rows: pa.Table, margin: int, side: int):
        self.r0, self.c0 = (int(k.as_py()) * side for k in keys)
        self.margin, self.side = margin, side
        self.row, self.col, self.rows = rows["row"].to_numpy(), rows["col"].to_numpy(), rows
        self.own = (self.row // side * side == self.r0) & (self.col // side * side == self.c0)

    def array(self, column: str) -> np.ndarray:
        n = self.side + 2 * self.margin
        out = np.full((n, n), np.nan)
        values = self.rows[column].to_numpy().astype("f8")
        out[self.row - self.r0 + self.margin, self.col - self.c0 + self.margin] = values
        return out

    def table(self, made: dict[str, np.ndarray], kept: list[str]) -> pa.Table:
        """The tile's own pixels with ``made`` (arrays without margin) and columns as they came."""
        row, col = self.row[self.own], self.col[self.own]
        out = {"row": pa.array(row, pa.int32()), "col": pa.array(col, pa.int32())}
        which = pa.array(self.own)
        out |= {c: self.rows[c].filter(which) for c in kept}
        for name, values in made.items():
            held = values[row - self.r0, col - self.c0]
            out[name] = pa.array(held, mask=np.isnan(held))
        return pa.table(out)


# discs ----------------------------------------------------------------------


def _shift(a: np.ndarray, by: int, axis: int, empty) -> np.ndarray:
    """``out[i] = a[i + by]``, ``empty`` beyond the array."""
    if not by:
        return a
    out = np.full_like(a, empty)
    n = a.shape[axis]
    take, put = (slice(by, n), slice(0, n - by)) if by > 0 else (slice(0, n + by), slice(-by, n))
    index = lambda s: (s, slice(None)) if axis == 0 else (slice(None), s)
    out[index(put)] = a[index(take)]
    return out


def _discs(a: np.ndarray, radii: list[int], join, empty) -> dict[int, np.ndarray]:
    """``join`` over each radius' disc around every pixel; row spans are made once for all radii."""
    wanted = {w for r in radii for w in spans(r).values()}
    span, held = a, {}
    for w in range(max(wanted) + 1):
        if w:
            span = join(join(span, _shift(a, -w, 1, empty)), _shift(a, w, 1, empty))
        if w in wanted:
            held[w] = span
    out = {}
    for r in radii:
        total = None
        for d, w in spans(r).items():
            part = _shift(held[w], d, 0, empty)
            total = part if total is None else join(total, part)
        out[r] = total
    return out


def _median(bins: np.ndarray, radius: int, margin: int, side: int, valid: np.ndarray) -> np.ndarray:
    """The middle of each disc's bins, by one histogram of 256 a line that slides along the columns.

    All lines of the tile slide together: a step takes the pixels of the disc's
    right rim in and those of its left rim out. Only discs that are whole count.
    """
    cut = spans(radius)
    half = sum(2 * w + 1 for w in cut.values()) // 2
    hist = np.zeros((side, 256), np.int32)
    lines = np.arange(side)
    out = np.full((side, side), np.nan)

    def change(d: int, column: int, by: int) -> None:
        held = bins[margin + d : margin + d + side, column]
        hist[lines, held] += by

    for c in range(margin, margin + side):
        for d, w in cut.items():
            if c == margin:
                for x in range(c - w, c + w + 1):
                    change(d, x, 1)
            else:
                change(d, c + w, 1)
                change(d, c - w - 1, -1)
        which = np.flatnonzero(valid[:, c - margin])
        if len(which):
            # the first bin at which more than half of the disc is counted
            out[which, c - margin] = (np.cumsum(hist[which], axis=1) > half).argmax(axis=1)
    return out


def disc_statistics(
    a: np.ndarray, stats: list[str], radii: list[int], margin: int, side: int, low: float | None, high: float | None
) -> dict[tuple[str, int], np.ndarray]:
    """Each statistic of each radius, NaN unless all of the disc has values.

    'std' and 'var' are of the values (population), the others of 256 bins
    between ``low`` and ``high``, scaled back; the mean's bin is cut to a whole one.
    """
    inner = (slice(margin, margin + side),) * 2
    there = ~np.isnan(a)
    count = _discs(there.astype("i4"), radii, np.add, 0)
    sizes = {r: sum(2 * w + 1 for w in spans(r).values()) for r in radii}
    full = {r: count[r][inner] == sizes[r] for r in radii}
    out = {}
    if {"std", "var"} & set(stats):
        held = np.where(there, a, 0.0)
        sums, squares = _discs(held, radii, np.add, 0.0), _discs(held * held, radii, np.add, 0.0)
        for r in radii:
            mean = sums[r][inner] / sizes[r]
            var = np.where(full[r], np.maximum(squares[r][inner] / sizes[r] - mean * mean, 0.0), np.nan)
            out["var", r], out["std", r] = var, np.sqrt(var)
    if set(stats) - {"std", "var"}:
        wide = 0.0 if low is None else high - low
        scaled = (np.where(there, a, low or 0.0) - (low or 0.0)) / (wide or 1.0) * 255
        bins = np.clip(scaled, 0, 255).astype("i4")
        back = lambda b: np.nan if low is None else low + b / 255 * wide
        least = _discs(np.where(there, bins, 255), radii, np.minimum, 255) if {"min", "range"} & set(stats) else None
        most = _discs(np.where(there, bins, 0), radii, np.maximum, 0) if {"max", "range"} & set(stats) else None
        sums = _discs(np.where(there, bins, 0), radii, np.add, 0) if "mean" in stats else None
        for r in radii:
            hide = lambda x, r=r: np.where(full[r], x, np.nan)
            if "min" in stats:
                out["min", r] = hide(back(least[r][inner]))
            if "max" in stats:
                out["max", r] = hide(back(most[r][inner]))
            if "range" in stats:
                out["range", r] = hide(back(most[r][inner]) - back(least[r][inner]))
            if "mean" in stats:
                out["mean", r] = hide(back(sums[r][inner] // sizes[r]))
            if "median" in stats:
                out["median", r] = hide(back(_median(bins, r, margin, side, full[r])))
    return out


def zonal(
    df: DataFrame, columns: list[str], stats: list[str], radii: list[int], keep: list[str] | None = None, side: int | None = None
) -> DataFrame:
    """``row, col``, the columns of ``keep`` and ``{column}_{stat}_w{radius}`` of each of ``columns``.

    Radii are in pixels. One shuffle, whatever is asked for. Statistics of bins
    need the least and greatest value of each column: one aggregate before it,
    over ``df`` as it is, so write ``df`` first where it is dear. Columns that
    ``df`` doesn't have are skipped; with none left, or for an unknown
    statistic, ValueError.
    """
    known = [c for c in columns if c in df.columns]
    if not known:
        raise ValueError(f"none of {', '.join(columns)} is there")
    for stat in stats:
        if stat not in STATISTICS:
            raise ValueError(f"unknown statistic {stat}")
    keep, radii = keep or [], sorted(set(radii))
    margin = max(radii)
    side = side or side_for(margin)
    ends = {}
    if set(stats) - {"std", "var"}:
        found = df.agg(*[f(c).cast("double").alias(f"{f.__name__}_{k}") for k, c in enumerate(known) for f in (F.min, F.max)]).first()
        ends = {c: (found[f"min_{k}"], found[f"max_{k}"]) for k, c in enumerate(known)}

    def made(keys: tuple, rows: pa.Table) -> pa.Table:
        tile = Tile(keys, rows, margin, side)
        out = {}
        for c in known:
            found = disc_statistics(tile.array(c), stats, radii, margin, side, *ends.get(c, (None, None)))
            out |= {f"{c}_{s}_w{r}": found[s, r] for r in radii for s in stats}
        return tile.table(out, keep)

    needed = [*known, *[c for c in keep if c not in known]]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ["row int", "col int", *(f"`{c}` {kinds[c]}" for c in keep)]
    schema += [f"`{c}_{s}_w{r}` double" for c in known for r in radii for s in stats]
    return by_tile(df.select("row", "col", *needed), margin, side).groupBy("_tr", "_tc").applyInArrow(made, ", ".join(schema))


# attributes -----------------------------------------------------------------


def _mirrored(low: int, high: int, size: int) -> np.ndarray:
    """The pixels that places from ``low`` to before ``high`` show when a line of ``size`` is mirrored at its ends."""
    at = np.arange(low, high) % (2 * size)
    return np.where(at < size, at, 2 * size - 1 - at)


def _smoothed(a: np.ndarray, w: list[float], axis: int) -> np.ndarray:
    n = a.shape[axis] - len(w) + 1
    total = 0.0
    for k, x in enumerate(w):
        total = total + x * (a[k : k + n] if axis == 0 else a[:, k : k + n])
    return total


def _gradient(a: np.ndarray, axis: int, first: int, size: int, step: float) -> np.ndarray:
    """Central differences, one-sided at the grid's ends; ``first`` is the place of ``a``'s first line.

    Both axes lose a pixel at each side, so that all differences stay aligned.
    """
    a = a if axis == 0 else a.T
    at = np.arange(first + 1, first + len(a) - 1)[:, None]
    here, before, after = a[1:-1], a[:-2], a[2:]
    out = np.where(at == 0, (after - here) / step, np.where(at == size - 1, (here - before) / step, (after - before) / (2 * step)))
    out[(at[:, 0] < 0) | (at[:, 0] >= size) | (size == 1)] = np.nan
    out = out[:, 1:-1]
    return out if axis == 0 else out.T


def _surface(z: np.ndarray, r0: int, c0: int, height: int, width: int, dx: float, dy: float) -> dict[str, np.ndarray]:
    """All attributes of a surface whose first pixel is at ``r0, c0``; each array without ``z``'s outer three pixels."""
    dcol = lambda a, out: _gradient(a, 1, c0 + out, width, dx)
    drow = lambda a, out: _gradient(a, 0, r0 + out, height, dy)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = dcol(z, 0), drow(z, 0)
        zxx, zyy, zxy = dcol(p, 1), drow(q, 1), drow(p, 1)
        slope = np.degrees(np.arctan(np.sqrt(p * p + q * q)))
        broken = np.sqrt(dcol(slope, 1) ** 2 + drow(slope, 1) ** 2)
        p, q, slope = p[1:-1, 1:-1], q[1:-1, 1:-1], slope[1:-1, 1:-1]
        g = p * p + q * q
        mean = (zxx * (1 + q * q) - 2 * zxy * p * q + zyy * (1 + p * p)) / (2 * np.power(1 + g, 1.5))
        gauss = (zxx * zyy - zxy * zxy) / np.power(1 + g, 2.0)
        spread = np.sqrt(np.maximum(mean * mean - gauss, 0.0))
        steep = np.where(g == 0, np.nan, g)
        made = {
            "slope": slope,
            "slope_break_index": broken,
            "profile_curvature": (zxx * p * p + 2 * zxy * p * q + zyy * q * q) / np.power(steep, 1.5),
            "planform_curvature": (zxx * q * q - 2 * zxy * p * q + zyy * p * p) / np.sqrt(steep),
            "mean_curvature": mean,
            "gaussian_curvature": gauss,
            "max_curvature": mean + spread,
            "min_curvature": mean - spread,
        }
    made = {name: a[1:-1, 1:-1] for name, a in made.items()}
    return made | {"elevation": z[3:-3, 3:-3]}


def attributes(
    df: DataFrame, wanted: dict[str, list[float]], height: int, width: int, dx: float = 1.0, dy: float = 1.0, value: str = "z", side: int | None = None
) -> DataFrame:
    """``row, col`` and ``{attribute}_sigma{sigma}`` for each attribute and sigma of ``wanted``, by one shuffle.

    Surfaces are smoothed out to four sigmas, mirrored at the grid's edges;
    'slope_break_index' smooths by half a pixel at least, and 'elevation' of
    sigma 0 is the surface itself. Null where the pixel itself is missing or the
    stencil meets a missing one. ValueError for an unknown attribute, or one
    without a sigma.
    """
    for name, sigmas in wanted.items():
        if name not in ATTRIBUTES:
            raise ValueError(f"unknown attribute {name}")
        if not sigmas:
            raise ValueError(f"{name} has no sigma")
    asked = [(name, s, max(s, 0.5) if name == "slope_break_index" else s) for name, sigmas in wanted.items() for s in sigmas]
    reach = {s: len(weights(s)) // 2 if s > 0 else 0 for _, _, s in asked}
    margin = max(reach.values()) + 3
    side = side or side_for(margin)

    def made(keys: tuple, rows: pa.Table) -> pa.Table:
        tile = Tile(keys, rows, margin, side)
        raw, out = tile.array(value), {}
        down = _mirrored(tile.r0 - margin, tile.r0 + side + margin, height) - tile.r0 + margin
        along = _mirrored(tile.c0 - margin, tile.c0 + side + margin, width) - tile.c0 + margin
        # places beyond the grid's far side may show pixels that no tile here holds; no own pixel needs them
        ok = lambda at: np.where((at >= 0) & (at < len(raw)), at, 0)
        padded = raw[np.ix_(ok(down), ok(along))]
        here = ~np.isnan(raw[margin : margin + side, margin : margin + side])
        for sigma in sorted({s for _, _, s in asked}):
            cut = margin - 3 - reach[sigma]
            z = padded[cut : len(padded) - cut, cut : len(padded) - cut]
            if sigma > 0:
                w = weights(sigma)
                z = _smoothed(_smoothed(z, w, 0), w, 1)
            found = _surface(z, tile.r0 - 3, tile.c0 - 3, height, width, dx, dy)
            for name, s, soft in asked:
                if soft == sigma:
                    out[f"{name}_sigma{s:g}"] = np.where(here, found[name], np.nan)
        return tile.table({f"{name}_sigma{s:g}": out[f"{name}_sigma{s:g}"] for name, s, _ in asked}, [])

    schema = ["row int", "col int", *(f"`{name}_sigma{s:g}` double" for name, s, _ in asked)]
    rows = df.select("row", "col", F.col(value).cast("double").alias(value))
    return by_tile(rows, margin, side).groupBy("_tr", "_tc").applyInArrow(made, ", ".join(schema))


def feature_table(base: DataFrame, features: list[Feature]) -> DataFrame:
    """``row, col`` and the columns of ``features``: those of ``base`` and disc statistics of them, by one shuffle.

    ``base`` has the features without a statistic. Statistics that not all
    columns and radii share are made for all and left out.
    """
    plain = [f.column for f in features if not f.zonal]
    zones = [f for f in features if f.zonal]
    if not zones:
        return base.select("row", "col", *plain)
    sources = list(dict.fromkeys(Feature(f.name, f.sigma).column for f in zones))
    missing = [c for c in [*plain, *sources] if c not in base.columns]
    if missing:
        raise ValueError(f"no such features: {', '.join(missing)}")
    stats = list(dict.fromkeys(f.stat for f in zones))
    made = zonal(base, sources, stats, [f.window for f in zones], keep=plain)
    return made.select("row", "col", *[f.column for f in features])


def wanted_of(features: list[Feature]) -> dict[str, list[float]]:
    """Attributes and sigmas that ``features`` are made from."""
    out: dict[str, list[float]] = {}
    for f in features:
        held = out.setdefault(f.name, [])
        if f.sigma not in held:
            held.append(f.sigma)
    return out
