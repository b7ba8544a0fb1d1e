"""Feature descriptors, their column names and the numbered feature sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Terrain names in their usual order, and what sets 13 to 18 hold.
TERRAIN = ("slope", "slope_break_index", "profile_curvature", "planform_curvature", "mean_curvature")
NAMED = {
    13: ("slope",),
    14: ("slope", "slope_break_index"),
    15: ("profile_curvature", "planform_curvature", "mean_curvature"),
    16: ("slope", "profile_curvature", "planform_curvature", "mean_curvature"),
    17: TERRAIN,
    18: ("elevation", *TERRAIN),
}
#: Smoothing of sets 1 to 12 (in turns of three) and of 19 to 24.
GROWING = ((1,), (1, 3), (1, 3, 5))
MIXED = ((1,), (3,), (5,), (1, 3), (3, 5), (1, 3, 5))
#: Neighbourhood statistics and radii of sets 25 to 30.
ZONAL = ((("std",), (3,)), (("range",), (3,)), (("std", "range"), (3,)), (("std",), (3, 5, 7)), (("range",), (3, 5, 7)), (("std", "range"), (3, 5, 7)))


@dataclass(frozen=True)
class Feature:
    name: str
    sigma: int
    stat: str | None = None
    window: int | None = None

    @property
    def zonal(self) -> bool:
        return self.stat is not None and self.window is not None

    @property
    def column(self) -> str:
        base = f"{self.name}_sigma{self.sigma}"
        return f"{base}_{self.stat}_w{self.window}" if self.zonal else base


def standard_features() -> list[Feature]:
    """The 16 base and 36 neighbourhood features of the standard run."""
    base = [Feature("elevation", 0), *(Feature(n, s) for n in TERRAIN for s in (1, 3, 5))]
    first = [Feature("elevation", 0), *(Feature(n, 1) for n in TERRAIN)]
    return base + [Feature(f.name, f.sigma, stat, w) for f in first for w in (3, 5, 7) for stat in ("std", "range")]


def in_set(f: Feature, k: int) -> bool:
    """Whether set ``k`` (1 to 30) holds a feature.

    Height counts as unsmoothed: of other sigmas it is treated as any feature
    of its sigma. Neighbourhood features of sets 25 to 30 are those of sigma 1.
    """
    height = f.name == "elevation"
    if k <= 12:
        if f.zonal and k not in (4, 5, 6, 10, 11, 12) or height and not f.zonal and k < 7:
            return False
        return f.sigma == 0 or f.sigma in GROWING[(k - 1) % 3]
    if k <= 18:
        return not f.zonal and f.name in NAMED[k] and f.sigma == (0 if height else 1)
    if f.name not in TERRAIN:
        return False
    if k <= 24:
        return not f.zonal and f.sigma in MIXED[k - 19]
    stats, windows = ZONAL[k - 25]
    return (f.stat in stats and f.window in windows and f.sigma == 1) if f.zonal else f.sigma in GROWING[2]


def feature_set(features: list[Feature], k: int) -> list[Feature]:
    """The features of set ``k`` in their given order.

    Other numbers raise ValueError: they name no set, so nothing stands for them.
    """
    if not 1 <= k <= 30:
        raise ValueError(f"no feature set {k}")
    return [f for f in features if in_set(f, k)]


def select_set(df: DataFrame, features: list[Feature], k: int, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """``keys`` and the columns of set ``k``; a scan below reads no others.

    Raises ValueError that names the columns that ``df`` doesn't have.
    """
    columns = [f.column for f in feature_set(features, k)]
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such features: {', '.join(missing)}")
    return df.select(*keys, *columns)
