import math

import numpy as np
import pytest

from talusgrid.operators import features, grid, neighbourhood


def surface(height, width, seed=1, holes=0.03):
    rnd = np.random.default_rng(seed)
    z = rnd.normal(0, 1, (height, width)).cumsum(0).cumsum(1) / 20
    z[rnd.random((height, width)) < holes] = np.nan
    return z


def frame(spark, z, name="z"):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, f"row int, col int, {name} double").repartition(5)


def arrays(df, shape):
    rows = df.collect()
    assert len(rows) == shape[0] * shape[1]
    out = {c: np.full(shape, np.nan) for c in df.columns if c not in ("row", "col")}
    for r in rows:
        for c, a in out.items():
            a[r["row"], r["col"]] = np.nan if r[c] is None else r[c]
    return out


def disc(z, stat, radius):
    """The statistic pixel by pixel, from a list of the disc's values."""
    low, high = np.nanmin(z), np.nanmax(z)
    bins = np.zeros(z.shape) if high == low else np.trunc((z - low) / (high - low) * 255)
    back = lambda b: low + b / 255 * (high - low)
    out = np.full(z.shape, np.nan)
    cells = [(d, e) for d in range(-radius, radius + 1) for e in range(-radius, radius + 1) if d * d + e * e <= radius * radius]
    for r in range(radius, z.shape[0] - radius):
        for c in range(radius, z.shape[1] - radius):
            v = np.array([z[r + d, c + e] for d, e in cells])
            b = np.array([bins[r + d, c + e] for d, e in cells])
            if np.isnan(v).any():
                continue
            out[r, c] = {
                "std": v.std(), "var": v.var(), "min": back(b.min()), "max": back(b.max()), "range": back(b.max()) - back(b.min()),
                "mean": back(math.floor(b.sum() / len(b))), "median": back(np.sort(b)[len(b) // 2]),
            }[stat]
    return out


@pytest.mark.parametrize("side", [16, 128])
def test_all_statistics_of_all_radii(spark, side):
    z = surface(37, 29)
    got = arrays(neighbourhood.zonal(frame(spark, z), ["z", "not there"], list(neighbourhood.STATISTICS), [1, 3, 5], side=side), z.shape)
    assert len(got) == 21
    for name, found in got.items():
        _, stat, w = name.split("_")
        np.testing.assert_allclose(found, disc(z, stat, int(w[1:])), atol=1e-9, err_msg=name)


def test_edges_of_statistics(spark):
    flat = np.full((9, 9), 2.5)
    got = arrays(neighbourhood.zonal(frame(spark, flat), ["z"], ["range", "median", "std", "mean"], [3]), flat.shape)
    assert got["z_range_w3"][4, 4] == 0 and got["z_median_w3"][4, 4] == 2.5 and got["z_std_w3"][4, 4] == 0 and got["z_mean_w3"][4, 4] == 2.5
    empty = np.full((9, 9), np.nan)
    got = arrays(neighbourhood.zonal(frame(spark, empty), ["z"], list(neighbourhood.STATISTICS), [1, 3]), empty.shape)
    assert all(np.isnan(a).all() for a in got.values())
    small = surface(3, 3, holes=0)
    assert np.isnan(arrays(neighbourhood.zonal(frame(spark, small), ["z"], ["std"], [3]), small.shape)["z_std_w3"]).all()
    none = frame(spark, small).where("false")
    assert neighbourhood.zonal(none, ["z"], ["range", "std"], [3]).collect() == []


def smooth(z, sigma):
    w = grid.weights(sigma)
    r = len(w) // 2
    for axis in (0, 1):
        z = np.apply_along_axis(lambda v: np.convolve(np.pad(v, r, mode="symmetric"), w, mode="valid"), axis, z)
    return z


def attribute(z, name, sigma, dx, dy):
    if name == "slope_break_index":
        sigma = max(sigma, 0.5)
    s = smooth(z, sigma) if sigma > 0 else z
    q, p = np.gradient(s, dy, dx)
    zxy, zxx = np.gradient(p, dy, dx)
    zyy = np.gradient(q, dy, axis=0)
    slope, g = np.degrees(np.arctan(np.hypot(p, q))), p * p + q * q
    mean = (zxx * (1 + q * q) - 2 * zxy * p * q + zyy * (1 + p * p)) / (2 * (1 + g) ** 1.5)
    gauss = (zxx * zyy - zxy**2) / (1 + g) ** 2
    spread = np.sqrt(np.maximum(mean**2 - gauss, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = {
            "elevation": s, "slope": slope, "slope_break_index": np.hypot(*np.gradient(slope, dy, dx)), "mean_curvature": mean,
            "gaussian_curvature": gauss, "max_curvature": mean + spread, "min_curvature": mean - spread,
            "profile_curvature": (zxx * p * p + 2 * zxy * p * q + zyy * q * q) / g**1.5,
            "planform_curvature": (zxx * q * q - 2 * zxy * p * q + zyy * p * p) / np.sqrt(g),
        }[name]
    return np.where(np.isnan(z) | ~np.isfinite(out), np.nan, out)


@pytest.mark.parametrize("side,holes", [(16, 0.0), (64, 0.004)])
def test_all_attributes(spark, side, holes):
    z = surface(41, 33, 4, holes)
    wanted = {a: [0, 1, 2.5] for a in neighbourhood.ATTRIBUTES}
    got = arrays(neighbourhood.attributes(frame(spark, z), wanted, *z.shape, 2.0, 3.0, side=side), z.shape)
    assert len(got) == 27
    for name, found in got.items():
        a, sigma = name.rsplit("_sigma", 1)
        want = attribute(z, a, float(sigma), 2.0, 3.0)
        np.testing.assert_allclose(found, want, atol=1e-9, rtol=1e-7, err_msg=name)


def test_a_line_shorter_than_the_stencil(spark):
    z = surface(4, 30, 2, 0.0)
    got = arrays(neighbourhood.attributes(frame(spark, z), {"elevation": [3], "slope": [3]}, 4, 30), z.shape)
    n = 4
    w = grid.weights(3)
    rows = np.arange(-12, 4 + 12) % (2 * n)
    tall = z[np.where(rows < n, rows, 2 * n - 1 - rows)]
    want = np.array([sum(w[k] * tall[r + k] for k in range(25)) for r in range(4)])
    want = np.apply_along_axis(lambda v: np.convolve(np.pad(v, 12, mode="symmetric"), w, mode="valid"), 1, want)
    np.testing.assert_allclose(got["elevation_sigma3"], want, atol=1e-9)


def test_one_shuffle_each(spark):
    every = features.standard_features()
    df = frame(spark, surface(20, 20))
    base = neighbourhood.attributes(df, neighbourhood.wanted_of(every), 20, 20)
    whole = neighbourhood.feature_table(base, every)
    assert whole.columns == ["row", "col", *[f.column for f in every]] and len(every) == 52
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    source = plan(df).count("Exchange")
    assert plan(base).count("Exchange") == source + 1 and plan(whole).count("Exchange") == source + 2
    with pytest.raises(ValueError, match="slope_sigma9"):
        neighbourhood.feature_table(base, [features.Feature("slope", 9)] + every)


def test_sides_follow_margins():
    assert neighbourhood.side_for(3) == 128 and neighbourhood.side_for(7) == 128
    assert all((1 + 2 * m / neighbourhood.side_for(m)) ** 2 <= neighbourhood.MOST for m in range(60))
