"""Positive-unlabeled classification on Spark ML: learners, folds, importances, saved models.

Fitted ensembles score a table in one pass over it for each of their trees'
ensembles; what reaches the driver are models, importances and scaler
statistics, whose size follows from the features and parameters alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import kept
from . import forest
from .boosting import Boosted, Boosting
from .ranking import curve, curve_metrics, mean_std, rank_percentile, ranked
from .raster import inside
from .sampling import valid

#: Names of learners and of the ways to learn from positives and unlabeled rows.
LEARNERS = ("random_forest", "gradient_boosting", "regularised_boosting")
METHODS = ("plain", "pu_bagging", "pu_elkan_noto", "pu_weighted_elkan_noto")
#: Bags that are fitted at a time: a level of a bag's trees is a small job, which leaves cores idle.
AT_ONCE = 4


@dataclass(frozen=True)
class Config:
    """What to fit: a method over a learner. Names are taken in any case; unknown ones raise ValueError.

    ``max_features`` is Spark's subset strategy; ``row_share`` is the share of
    rows that each boosted tree sees; ``balanced`` weighs both labels alike.
    Only regularised boosting takes ``l1``, ``l2``, ``min_weight`` and
    ``column_share``.
    """

    method: str = "pu_bagging"
    learner: str = "random_forest"
    estimators: int = 10
    hold_out: float = 0.1
    trees: int = 50
    depth: int = 8
    min_leaf: int = 1
    max_features: str = "sqrt"
    criterion: str = "gini"
    rate: float = 0.1
    row_share: float = 1.0
    min_gain: float = 0.0
    bins: int = 32
    l1: float = 0.0
    l2: float = 1.0
    min_weight: float = 1.0
    column_share: float = 1.0
    balanced: bool = False
    seed: int = 42

    def __post_init__(self):
        if self.method.lower() not in METHODS:
            raise ValueError(f"unknown method {self.method}")
        if self.learner.lower() not in LEARNERS:
            raise ValueError(f"unknown learner {self.learner}")


def learner(config: Config, seed: int) -> RandomForestClassifier | GBTClassifier | Boosting:
    """The unfitted estimator of a configuration."""
    if config.learner.lower() == "regularised_boosting":
        return Boosting(
            config.trees, config.depth, config.rate, config.l1, config.l2, config.min_gain, config.min_weight, config.row_share,
            config.column_share, config.bins, seed,
        )
    shared = {
        "featuresCol": "features", "labelCol": "label", "weightCol": "w", "seed": seed, "maxDepth": config.depth,
        "minInstancesPerNode": config.min_leaf, "minInfoGain": config.min_gain, "maxBins": config.bins,
        "featureSubsetStrategy": config.max_features,
    }
    if config.learner.lower() == "random_forest":
        return RandomForestClassifier(numTrees=config.trees, impurity=config.criterion, **shared)
    return GBTClassifier(maxIter=config.trees, stepSize=config.rate, subsamplingRate=config.row_share, **shared)


def scaler_statistics(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature (1 where it is 0)."""
    made = [f(F.col(c)) for c in features for f in (F.avg, F.stddev_pop)]
    row = df.agg(*[x.alias(f"_{k}") for k, x in enumerate(made)]).first()
    return {c: (row[2 * k] or 0.0, row[2 * k + 1] or 1.0) for k, c in enumerate(features)}


def scale(df: DataFrame, statistics: dict[str, tuple[float, float]]) -> DataFrame:
    """Features less their mean over their deviation, by statistics of other rows."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in statistics.items()})


@dataclass
class Fitted:
    """Models whose mean probability, over ``share``, is the score; one scaler before them."""

    features: list[str]
    scaler: dict[str, tuple[float, float]]
    models: list = field(default_factory=list)
    share: float = 1.0

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score`` from 0 to 1; null where a feature isn't finite."""
        usable = valid(df, self.features).select("*", F.struct(*self.features).alias("_own"))
        out = _vectors(scale(usable, self.scaler), self.features)
        for k, m in enumerate(self.models):
            out = m.transform(out).withColumn(f"_p{k}", vector_to_array("probability")[1])
            out = out.drop("rawPrediction", "probability", "prediction")
        mean = sum((F.col(f"_p{k}") for k in range(len(self.models))), F.lit(0.0)) / F.lit(len(self.models) * self.share)
        columns = [F.col(f"_own.{c}").alias(c) if c in self.features else F.col(c) for c in df.columns]
        scored = out.select(*columns, F.least(mean, F.lit(1.0)).alias("score"))
        # what can't be scored stays, unscored
        rest = df.where(~_finite(self.features)).withColumn("score", F.lit(None).cast("double"))
        return scored.unionByName(rest)

    def importances(self) -> list[tuple[str, float]]:
        """Each feature's mean importance over the models."""
        found = [m.featureImportances.toArray() for m in self.models]
        return [(c, float(sum(x[k] for x in found) / len(found))) for k, c in enumerate(self.features)]


def _finite(features: list[str]):
    ok = F.lit(True)
    for f in features:
        ok = ok & F.coalesce(~F.isnan(f) & (F.abs(F.col(f)) < F.lit(float("inf"))), F.lit(False))
    return ok


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def _chance(scored: DataFrame) -> DataFrame:
    return scored.withColumn("_p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def fit(train: DataFrame, features: list[str], config: Config = Config(), label: str = "label") -> Fitted:  # noqa: B008
    """Learn from positives (``label`` 1) and unlabeled rows (0) with finite features.

    Raises ValueError without a row of either label. Elkan and Noto's ways hold
    out positives to learn how likely a positive is to be labelled; they raise
    ValueError if none is held out. Rows are dealt over all cores by their
    values and sorted, so what is drawn doesn't depend on the files they came in.
    Bags of forests of few features are grown from counts of rows instead.
    """
    usable = valid(train, features).select(*features, F.col(label).cast("double").alias("label"))
    if config.method.lower() == "pu_bagging" and config.learner.lower() == "random_forest" and forest.fits(len(features), config.bins):
        return _counted(usable, features, config)
    cores = train.sparkSession.sparkContext.defaultParallelism
    usable = usable.repartition(cores, *usable.columns).sortWithinPartitions(*usable.columns)
    statistics = scaler_statistics(usable, features)
    rows = _vectors(scale(usable, statistics), features).select("label", "features").persist()
    try:
        counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        ones, zeros = counts.get(1.0, 0), counts.get(0.0, 0)
        if not ones or not zeros:
            raise ValueError(f"{ones} positives and {zeros} unlabeled rows: both are needed")
        fitted = Fitted(features, statistics)
        even = F.when(F.col("label") == 1, F.lit((ones + zeros) / (2 * ones))).otherwise(F.lit((ones + zeros) / (2 * zeros)))
        weight = even if config.balanced else F.lit(1.0)
        method = config.method.lower()
        if method == "plain":
            fitted.models = [learner(config, config.seed).fit(rows.withColumn("w", weight))]
        elif method == "pu_bagging":
            share = min(1.0, ones / zeros)

            def bagged(k: int):
                drawn = rows.where("label = 0").sample(True, share, config.seed + k)
                bag = rows.where("label = 1").unionByName(drawn).withColumn("w", F.lit(1.0))
                return learner(config, config.seed + k).fit(bag)

            with ThreadPool(AT_ONCE) as pool:
                fitted.models = pool.map(inheritable_thread_target(train.sparkSession)(bagged), range(config.estimators), 1)
        else:
            held = rows.withColumn("_held", (F.col("label") == 1) & (F.rand(config.seed) < config.hold_out)).withColumn("w", weight).persist()
            try:
                first = learner(config, config.seed).fit(held.where("not _held"))
                likely = _chance(first.transform(held.where("_held"))).agg(F.avg("_p")).first()[0]
                if not likely:
                    raise ValueError("no positive was held out, or none of them was recognised: raise hold_out")
                if method == "pu_elkan_noto":
                    fitted.models, fitted.share = [first], likely
                else:
                    fitted.models = [learner(config, config.seed + 1).fit(_weighted(first, held, likely))]
            finally:
                held.unpersist()
        return fitted
    finally:
        rows.unpersist()


def _counted(usable: DataFrame, features: list[str], config: Config) -> Fitted:
    """Bagged forests from the counts of rows; by the six leading digits of the scaler, as sums' last ones follow the order of rows."""
    found = scaler_statistics(usable, features)
    statistics = {c: (float(f"{m:.6g}"), float(f"{s:.6g}")) for c, (m, s) in found.items()}
    bagging = forest.Bagging(
        config.estimators, config.trees, config.depth, config.min_leaf, config.max_features, config.criterion, config.min_gain, config.bins, config.seed
    )
    return Fitted(features, statistics, [bagging.fit(scale(usable, statistics), features)])


def _weighted(first, rows: DataFrame, likely: float) -> DataFrame:
    """Positives once; an unlabeled row both as positive and as negative, by how likely it is one."""
    p = F.least(F.col("_p"), F.lit(1 - 1e-9))
    odds = F.least(F.lit((1 - likely) / likely) * p / (1 - p), F.lit(1.0))
    scored = _chance(first.transform(rows)).withColumn("_w", F.when(F.col("label") == 1, F.lit(1.0)).otherwise(odds))
    sides = F.array(F.struct(F.lit(1.0).alias("y"), F.col("_w").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("_w")).alias("w")))
    both = scored.select("features", F.explode(sides).alias("s")).select("features", F.col("s.y").alias("label"), F.col("s.w").alias("w"))
    return both.where("w > 0")


def save(fitted: Fitted, spark: SparkSession, path: str) -> None:
    """Models, scaler and features below ``path``, which may be in any store that Spark writes to."""
    for k, m in enumerate(fitted.models):
        if isinstance(m, (Boosted, forest.Forest)):
            m.save(spark, f"{path}/model-{k}")
        else:
            m.write().overwrite().save(f"{path}/model-{k}")
    rows = [(k, c, *map(float, fitted.scaler[c])) for k, c in enumerate(fitted.features)]
    spark.createDataFrame(rows, "k int, feature string, mean double, deviation double").coalesce(1).write.mode("overwrite").json(f"{path}/scaler")
    kinds = {GBTClassificationModel: "gradient_boosting", Boosted: "regularised_boosting", forest.Forest: "counted_forest"}
    kind = kinds.get(type(fitted.models[0]), "random_forest")
    spark.createDataFrame([(kind, len(fitted.models), float(fitted.share))], "learner string, models int, share double").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/config")


def load(spark: SparkSession, path: str) -> Fitted:
    """What ``save`` wrote; Spark's error names the part that is missing."""
    config = spark.read.schema("learner string, models int, share double").json(f"{path}/config").first()
    rows = spark.read.schema("k int, feature string, mean double, deviation double").json(f"{path}/scaler").orderBy("k").collect()
    kind = GBTClassificationModel if config["learner"] == "gradient_boosting" else RandomForestClassificationModel
    own = {"regularised_boosting": Boosted, "counted_forest": forest.Forest}.get(config["learner"])
    models = [own.load(spark, p) if own else kind.load(p) for p in (f"{path}/model-{k}" for k in range(config["models"]))]
    return Fitted([r["feature"] for r in rows], {r["feature"]: (r["mean"], r["deviation"]) for r in rows}, models, config["share"])


def folds_of(df: DataFrame, fold: str = "fold") -> list:
    """The folds there are, in order; null is none. They come to the driver, as each gets a model of its own."""
    return [r[fold] for r in df.where(F.col(fold).isNotNull()).select(fold).distinct().orderBy(fold).collect()]


def split(df: DataFrame, k, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Rows of the other folds and rows of fold ``k``; rows without a fold are in neither."""
    return df.where(F.col(fold) != F.lit(k)), df.where(F.col(fold) == F.lit(k))


def cross_validate(
    df: DataFrame, features: list[str], config: Config = Config(), label: str = "label", fold: str = "fold"  # noqa: B008
) -> tuple[DataFrame, DataFrame]:
    """Each fold's rows with the ``score`` of a model of the other folds, and ``fold, feature, importance``.

    The scaler learns from the other folds, too. Without a row of a fold,
    ValueError. The rows are written once, as each fold reads them again, and
    dealt over all cores by their values, however few files they came in; dealt
    in turn, they would be sorted first, and spilled.
    """
    df = kept(df.repartition(df.sparkSession.sparkContext.defaultParallelism, *df.columns), "folds")
    folds = folds_of(df, fold)
    if not folds:
        raise ValueError("no rows to validate on")
    scored, weights = None, []
    for f in folds:
        train, test = split(df, f, fold)
        model = fit(train, features, config, label)
        part = model.score(test)
        scored = part if scored is None else scored.unionByName(part)
        weights += [(f, c, w) for c, w in model.importances()]
    kind = df.schema[fold].dataType.simpleString()
    return scored, df.sparkSession.createDataFrame(weights, f"fold {kind}, feature string, importance double")


def cv_metrics(scored: DataFrame, tie: str, label: str = "label", fold: str = "fold") -> DataFrame:
    """Area under the gain curve, top gains and mean rank percentile of each fold, ranked once."""
    ranks = ranked(scored.select(fold, "score", F.col(label).cast("boolean").alias("_y"), tie), "score", "_y", tie, fold)
    return curve_metrics(curve(ranks, fold), fold).join(rank_percentile(ranks, fold), fold)


def cv_summary(metrics: DataFrame) -> DataFrame:
    """One row: mean and population deviation of the area and the rank percentile, folds without one left out."""
    return mean_std(metrics.select(F.col("auc"), F.col("mean_rank_percentile")), ["auc", "mean_rank_percentile"], [])


def importance_summary(importances: DataFrame) -> DataFrame:
    """Mean and population deviation of each feature's importance over folds, greatest first."""
    found = mean_std(importances, ["importance"], ["feature"])
    return found.orderBy(F.desc("importance_mean"), "feature")


def risk_map(pixels: DataFrame, outlines: DataFrame, model: Fitted) -> DataFrame:
    """``row, col, risk`` of every pixel: scored if all features are finite and an outline touches it, else null.

    Only pixels to be scored reach the model.
    """
    touched = inside(pixels.select("row", "col"), outlines, touched=True).select("row", "col").distinct()
    chosen = valid(pixels, model.features).join(touched, ["row", "col"], "left_semi")
    scored = model.score(chosen).select("row", "col", F.col("score").alias("risk"))
    return pixels.select("row", "col").join(scored, ["row", "col"], "left")


def risk_summary(risk: DataFrame) -> DataFrame:
    """One row: pixels, scored ones, and the least, greatest and mean risk."""
    r = F.col("risk")
    return risk.agg(
        F.count("*").alias("n_pixels"), F.count(r).alias("n_scored"), F.min(r).alias("risk_min"), F.max(r).alias("risk_max"), F.avg(r).alias("risk_mean")
    )
