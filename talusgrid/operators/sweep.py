"""Search over model settings: a table of trials that outlives the run, by grid, by chance or by expected improvement.

A trial is Spark's work (folds fitted and scored); the driver keeps one number a
trial and chooses the next setting from them.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model

#: The settings that are varied, 36 together, and how many of them are tried.
SPACE = {"trees": (50, 100), "depth": (6, 8, 10), "min_leaf": (1, 2, 4), "max_features": ("sqrt", "0.5")}
CAP = 50
WAYS = ("grid", "random", "bayes")
_TRIALS = "trial int, settings string, value double"


def settings(space: dict[str, tuple]) -> list[dict]:
    """Every combination, the last name's values next to each other; a name without values raises ValueError."""
    if not space or not all(space.values()):
        raise ValueError("every setting needs at least one value")
    return [dict(zip(space, found, strict=True)) for found in itertools.product(*space.values())]


def _name(chosen: dict) -> str:
    return json.dumps(chosen, sort_keys=True)


def trials(spark: SparkSession, path: str) -> DataFrame:
    """``trial, settings (JSON), value`` of the trials that have ended."""
    try:
        return spark.read.schema(_TRIALS).json(f"{path}/trial=*")
    except Exception as e:  # Spark's own error for a path that matches nothing
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _TRIALS)


def _points(space: dict[str, tuple], every: list[dict]) -> np.ndarray:
    """Settings as points of the unit cube: numbers by their place from least to greatest, names by an axis each."""
    axes = []
    for name, values in space.items():
        if all(isinstance(v, int | float) and not isinstance(v, bool) for v in values):
            low, high = min(values), max(values)
            axes.append([(s[name] - low) / ((high - low) or 1) for s in every])
        else:
            axes += [[float(s[name] == v) for s in every] for v in values]
    return np.array(axes).T


def expected_improvement(points: np.ndarray, seen: list[int], values: list[float], width: float = 0.5, noise: float = 1e-4) -> np.ndarray:
    """By how much each point may better the best value seen, under a Gaussian process through those seen."""
    y = np.array(values)
    centre, spread = y.mean(), y.std() or 1.0
    y = (y - centre) / spread

    def near(a, b):
        return np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * width**2))

    known = points[seen]
    inverse = np.linalg.inv(near(known, known) + noise * np.eye(len(seen)))
    across = near(points, known)
    mean = across @ inverse @ y
    deviation = np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", across, inverse, across), 1e-12))
    z = (mean - y.max()) / deviation
    below = 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in z]))
    return spread * deviation * (z * below + np.exp(-z * z / 2) / math.sqrt(2 * math.pi))


def _order(space: dict, every: list[dict], way: str, seed: int, found: dict[int, float]) -> Iterator[int]:
    """Places of the settings to try, ``found`` growing meanwhile."""
    mixed = random.Random(seed).sample(range(len(every)), len(every))
    points = _points(space, every)
    for at in range(len(every)) if way == "grid" else mixed:
        if way == "bayes" and len(found) >= min(5, len(every)):
            break
        if at not in found:
            yield at
    while way == "bayes" and len(found) < len(every):
        useful = {k: v for k, v in found.items() if math.isfinite(v)}
        rest = [k for k in mixed if k not in found]
        if useful:
            gain = expected_improvement(points, list(useful), list(useful.values()))
            rest.sort(key=lambda k: -gain[k])
        yield rest[0]


def sweep(
    spark: SparkSession, path: str, space: dict[str, tuple], trial: Callable[[dict], float | None], way: str = "bayes", cap: int = CAP, seed: int = 42
) -> DataFrame:
    """The trials below ``path`` after at most ``cap`` of them, greatest value first.

    ``trial`` gives a setting's value, which is to be great; one without a value
    (null or not a number) counts as a trial and is never the best. Trials of an
    earlier call count, too: a sweep that was stopped goes on where it was, and
    no setting is tried twice. Expected improvement starts after five settings
    drawn by chance.
    """
    if way not in WAYS:
        raise ValueError(f"unknown way {way}")
    every = settings(space)
    place = {_name(s): k for k, s in enumerate(every)}
    past = trials(spark, path).collect()  # at most ``cap`` rows a call
    found = {place[r["settings"]]: math.nan if r["value"] is None else r["value"] for r in past if r["settings"] in place}
    for at in _order(space, every, way, seed, found):
        if len(found) >= cap:
            break
        value = trial(every[at])
        kept = None if value is None or not math.isfinite(value) else float(value)
        row = spark.createDataFrame([(len(found), _name(every[at]), kept)], _TRIALS)
        row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/trial={at}")
        found[at] = math.nan if kept is None else kept
    return trials(spark, path).orderBy(F.desc_nulls_last("value"), "settings")


def cv_trial(df: DataFrame, features: list[str], tie: str, base: model.Config = model.Config(), metric: str = "auc") -> Callable[[dict], float | None]:  # noqa: B008
    """A trial that gives the mean over folds of the area under the gain curve (or of the rank percentile)."""

    def trial(chosen: dict) -> float | None:
        scored, _ = model.cross_validate(df, features, replace(base, **chosen))
        return model.cv_summary(model.cv_metrics(scored, tie)).first()[f"{metric}_mean"]

    return trial
