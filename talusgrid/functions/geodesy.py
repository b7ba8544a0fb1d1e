"""Coordinates between the Swiss grids, UTM and geographic ones by closed forms, as steps of a DataFrame.

The Swiss grids are an oblique Mercator projection of Bessel's ellipsoid, UTM is
Krueger's series of fourth order, and datums differ by a shift of geocentric
coordinates at height 0 of the source's ellipsoid, so a way there and back ends
up to two millimetres off within the country. ``projection.reproject`` has the
approximate polynomials, good to a metre. The distortions of the older Swiss
grid aren't modelled.

Each step is a column of its own, so that Spark works it out once.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .projection import LV03, LV95, WGS84

#: Half axis and squared eccentricity of the two ellipsoids.
BESSEL = (6377397.155, 0.006674372230614)
WORLD = (6378137.0, 0.0066943799901413165)
#: Origin of the Swiss projection, and geocentric metres from its datum to WGS 84.
PHI0, LAMBDA0 = math.radians(46 + 57 / 60 + 8.66 / 3600), math.radians(7 + 26 / 60 + 22.5 / 3600)
SHIFT = (674.374, 15.056, 405.346)


def _swiss_constants() -> dict[str, float]:
    a, ee = BESSEL
    e, s = math.sqrt(ee), math.sin(PHI0)
    alpha = math.sqrt(1 + ee / (1 - ee) * math.cos(PHI0) ** 4)
    b0 = math.asin(s / alpha)
    k = (
        math.log(math.tan(math.pi / 4 + b0 / 2)) - alpha * math.log(math.tan(math.pi / 4 + PHI0 / 2))
        + alpha * e / 2 * math.log((1 + e * s) / (1 - e * s))
    )
    return {"r": a * math.sqrt(1 - ee) / (1 - ee * s * s), "alpha": alpha, "b0": b0, "k": k, "e": e}


SWISS = _swiss_constants()


def _steps(df: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    for step in steps:
        df = df.withColumns(step)
    return df


def _swiss_to_angles(df: DataFrame) -> DataFrame:
    """``_x, _y`` (LV95) to longitude and latitude in radians on Bessel's ellipsoid."""
    c, s = math.cos(SWISS["b0"]), math.sin(SWISS["b0"])
    x, y, lat, b = F.col("_x"), F.col("_y"), F.col("_lat"), F.col("_b")
    turn = {"_l": (x - 2_600_000) / SWISS["r"], "_b": 2 * F.atan(F.exp((y - 1_200_000) / SWISS["r"])) - math.pi / 2}
    globe = {
        "_lon": F.atan2(F.sin("_l"), c * F.cos("_l") - s * F.tan(b)) / SWISS["alpha"] + LAMBDA0,
        "_b": F.asin(c * F.sin(b) + s * F.cos(b) * F.cos("_l")),
    }
    start = {"_s": (F.log(F.tan(math.pi / 4 + b / 2)) - SWISS["k"]) / SWISS["alpha"], "_lat": b}
    nearer = {"_lat": 2 * F.atan(F.exp(F.col("_s") + SWISS["e"] * F.log(F.tan(math.pi / 4 + F.asin(SWISS["e"] * F.sin(lat)) / 2)))) - math.pi / 2}
    return _steps(df, [turn, globe, start, *[nearer] * 6]).drop("_l", "_b", "_s")


def _angles_to_swiss(df: DataFrame) -> DataFrame:
    c, s = math.cos(SWISS["b0"]), math.sin(SWISS["b0"])
    lat, b, high = F.col("_lat"), F.col("_b"), F.col("_h")
    bent = SWISS["e"] * F.sin(lat)
    drawn = {
        "_s": SWISS["alpha"] * (F.log(F.tan(math.pi / 4 + lat / 2)) - SWISS["e"] / 2 * F.log((1 + bent) / (1 - bent))) + SWISS["k"],
        "_l": SWISS["alpha"] * (F.col("_lon") - LAMBDA0),
    }
    turn = {"_b": 2 * F.atan(F.exp("_s")) - math.pi / 2}
    turned = {"_x": F.atan2(F.sin("_l"), s * F.tan(b) + c * F.cos("_l")), "_h": c * F.sin(b) - s * F.cos(b) * F.cos("_l")}
    flat = {"_x": F.col("_x") * SWISS["r"] + 2_600_000, "_y": SWISS["r"] / 2 * F.log((1 + high) / (1 - high)) + 1_200_000}
    return _steps(df, [drawn, turn, turned, flat]).drop("_s", "_l", "_b", "_h")


def _shift(df: DataFrame, source: tuple, target: tuple, sign: int) -> DataFrame:
    """Angles on one ellipsoid to those on another whose centre is ``SHIFT`` away."""
    (a, ee), (a2, ee2) = source, target
    b2 = a2 * math.sqrt(1 - ee2)
    lon, lat, n = F.col("_lon"), F.col("_lat"), F.col("_n")
    steps = [
        {"_n": a / F.sqrt(1 - ee * F.sin(lat) * F.sin(lat))},
        {
            "_u": n * F.cos(lat) * F.cos(lon) + sign * SHIFT[0],
            "_v": n * F.cos(lat) * F.sin(lon) + sign * SHIFT[1],
            "_w": n * (1 - ee) * F.sin(lat) + sign * SHIFT[2],
        },
        {"_p": F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v")), "_lon": F.atan2("_v", "_u")},
        {"_t": F.atan2(F.col("_w") * a2, F.col("_p") * b2)},
        {"_lat": F.atan2(F.col("_w") + ee2 / (1 - ee2) * b2 * F.pow(F.sin("_t"), 3), F.col("_p") - ee2 * a2 * F.pow(F.cos("_t"), 3))},
    ]
    return _steps(df, steps).drop("_n", "_u", "_v", "_w", "_p", "_t")


def _series() -> tuple[float, list[float], list[float], list[float]]:
    """Radius of the meridian's circle and Krueger's coefficients: to the plane, from it, and of the latitude."""
    a, ee = WORLD
    f = 1 - math.sqrt(1 - ee)
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    # The published coefficients of the powers of n from the first to the fourth.
    to = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
    back = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
    lat = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))
    return radius, *[[sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in table] for table in (to, back, lat)]


RADIUS, TO_PLANE, FROM_PLANE, OF_LATITUDE = _series()
SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0


def _zone(code: str) -> tuple[float, float] | None:
    """Central meridian (radians) and false northing of a UTM zone's code."""
    found = re.fullmatch(r"EPSG:32([67])(\d\d)", code)
    if not found or not 1 <= int(found[2]) <= 60:
        return None
    return math.radians(6 * int(found[2]) - 183), SOUTH if found[1] == "7" else 0.0


def _angles_to_utm(df: DataFrame, zone: tuple[float, float]) -> DataFrame:
    e = math.sqrt(WORLD[1])
    lat, p, q = F.col("_lat"), F.col("_p"), F.col("_q")
    steps = [
        {"_d": F.col("_lon") - zone[0], "_t": F.sinh(F.atanh(F.sin(lat)) - e * F.atanh(e * F.sin(lat)))},
        {"_p": F.atan2(F.col("_t"), F.cos("_d")), "_q": F.asinh(F.sin("_d") / F.sqrt(F.col("_t") * F.col("_t") + F.cos("_d") * F.cos("_d")))},
        {
            "_x": q + sum((c * F.cos(2 * k * p) * F.sinh(2 * k * q) for k, c in enumerate(TO_PLANE, 1)), F.lit(0.0)),
            "_y": p + sum((c * F.sin(2 * k * p) * F.cosh(2 * k * q) for k, c in enumerate(TO_PLANE, 1)), F.lit(0.0)),
        },
        {"_x": EAST + SCALE * RADIUS * F.col("_x"), "_y": zone[1] + SCALE * RADIUS * F.col("_y")},
    ]
    return _steps(df, steps).drop("_d", "_t", "_p", "_q")


def _utm_to_angles(df: DataFrame, zone: tuple[float, float]) -> DataFrame:
    p, q, c = F.col("_p"), F.col("_q"), F.col("_c")
    steps = [
        {"_p": (F.col("_y") - zone[1]) / (SCALE * RADIUS), "_q": (F.col("_x") - EAST) / (SCALE * RADIUS)},
        {
            "_p": p - sum((b * F.sin(2 * k * p) * F.cosh(2 * k * q) for k, b in enumerate(FROM_PLANE, 1)), F.lit(0.0)),
            "_q": q - sum((b * F.cos(2 * k * p) * F.sinh(2 * k * q) for k, b in enumerate(FROM_PLANE, 1)), F.lit(0.0)),
        },
        {"_c": F.asin(F.sin(p) / F.cosh(q)), "_lon": zone[0] + F.atan2(F.sinh(q), F.cos(p))},
        {"_lat": c + sum((d * F.sin(2 * k * c) for k, d in enumerate(OF_LATITUDE, 1)), F.lit(0.0))},
    ]
    return _steps(df, steps).drop("_p", "_q", "_c")


def transform(df: DataFrame, x: str, y: str, source: str | None, target: str) -> DataFrame:
    """``df`` with columns ``x`` and ``y`` (easting and northing, or degrees of longitude and latitude) in another system.

    Systems are LV95, LV03, WGS84 and the UTM zones ``EPSG:326zz`` and
    ``EPSG:327zz``; equal ones change nothing. A missing or unknown system
    raises ValueError. Null coordinates stay null. LV03 is LV95 less its offset.
    Names that begin with ``_`` are taken by the steps.
    """
    if source is None:
        raise ValueError("the source has no coordinate system")
    for code in (source, target):
        if code not in (LV95, LV03, WGS84) and _zone(code) is None:
            raise ValueError(f"can't go from {source} to {target}")
    if source == target:
        return df
    swiss = (LV95, LV03)
    out = df.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    if source == LV03:
        out = out.withColumns({"_x": F.col("_x") + 2_000_000, "_y": F.col("_y") + 1_000_000})
    if source not in swiss or target not in swiss:
        if source in swiss:
            out = _shift(_swiss_to_angles(out), BESSEL, WORLD, 1)
        elif source == WGS84:
            out = out.withColumns({"_lon": F.radians("_x"), "_lat": F.radians("_y")})
        else:
            out = _utm_to_angles(out, _zone(source))
        if target in swiss:
            out = _angles_to_swiss(_shift(out, WORLD, BESSEL, -1))
        elif target == WGS84:
            out = out.withColumns({"_x": F.degrees("_lon"), "_y": F.degrees("_lat")})
        else:
            out = _angles_to_utm(out, _zone(target))
        out = out.drop("_lon", "_lat")
    if target == LV03:
        out = out.withColumns({"_x": F.col("_x") - 2_000_000, "_y": F.col("_y") - 1_000_000})
    return out.withColumns({x: F.col("_x"), y: F.col("_y")}).drop("_x", "_y")
