"""Coordinates between the Swiss grids and geographic ones, as column expressions.

The polynomials are the published approximate ones of the Swiss federal office
of topography, good to about one metre within the country.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of LV95, LV03 and WGS 84.
LV95, LV03, WGS84 = "EPSG:2056", "EPSG:21781", "EPSG:4326"


def _geographic(e: Column, n: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of LV95 coordinates."""
    y, x = (e - 2_600_000) / 1_000_000, (n - 1_200_000) / 1_000_000
    # The published coefficients.
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = 16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x
    return lon * 100 / 36, lat * 100 / 36


def _swiss(lon: Column, lat: Column) -> tuple[Column, Column]:
    """LV95 coordinates of degrees."""
    a, b = (lon * 3600 - 26782.5) / 10_000, (lat * 3600 - 169028.66) / 10_000
    # The published coefficients.
    e = 2600072.37 + 211455.93 * a - 10938.51 * a * b - 0.36 * a * b * b - 44.54 * a * a * a
    n = 1200147.07 + 308807.95 * b + 3745.25 * a * a + 76.63 * b * b - 194.56 * a * a * b + 119.79 * b * b * b
    return e, n


def reproject(x: Column, y: Column, source: str | None, target: str = LV95) -> tuple[Column, Column]:
    """``x, y`` (easting and northing, or longitude and latitude) in another system.

    Equal systems change nothing. A missing source or an unknown system raises
    ValueError.
    """
    if source is None:
        raise ValueError("the source has no coordinate system")
    known = (LV95, LV03, WGS84)
    if source not in known or target not in known:
        raise ValueError(f"can't go from {source} to {target}")
    if source == target:
        return x, y
    if source == LV03:
        x, y = x + 2_000_000, y + 1_000_000
    elif source == WGS84:
        x, y = _swiss(x, y)
    if target == LV03:
        return x - 2_000_000, y - 1_000_000
    return _geographic(x, y) if target == WGS84 else (x, y)


def reproject_lines(parts: Column, source: str | None, target: str = LV95) -> Column:
    """Lines of points ``x, y`` in another system."""

    def point(p: Column) -> Column:
        x, y = reproject(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return parts if source == target else F.transform(parts, lambda line: F.transform(line, point))
