"""Regressors and leave-one-entity-out validation.

Closed-form models - medians, life priors, nearest neighbours - are fitted for all folds in one job.  Leaving an entity
out takes its counts off those of all values.  Ridges are solved for all folds from sums of products (moments).
Trees need a fit per fold, several at the same time; for large fleets grouped() deals entities to k folds.  Forests that only
predict a fold grow in tasks (forests); MLlib's are those that are saved.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clipped
from ..sources.scratch import kept
from . import forests, moments, neighbours, ranks
from .contracts import ContractError

#: Folds that are fitted at the same time: a fit is many short jobs, which alone leave cores idle.
AT_ONCE = 4
#: Default parameters by model name.
DEFAULTS: dict[str, dict] = {
    "median": {}, "condition_life_prior": {}, "ridge": {"alpha": 10.0}, "knn": {"k": 3},
    "random_forest": {"numTrees": 500, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "maxDepth": 30},
    "hist_gradient_boosting": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 5}, "gradient_boosting": {"maxIter": 200, "stepSize": 0.05, "maxDepth": 3},
    "xgboost": {"maxIter": 500, "stepSize": 0.03, "maxDepth": 3, "subsamplingRate": 0.8}, "lightgbm": {"maxIter": 500, "stepSize": 0.03, "maxDepth": 4, "subsamplingRate": 0.8},
}


def effective_params(name: str, overrides: dict | None = None) -> dict:
    if name not in DEFAULTS:
        raise KeyError(f"unsupported model: {name}")
    return DEFAULTS[name] | (overrides or {})


def grouped(frame: DataFrame, k: int, group: str = "bearing") -> DataFrame:
    """Adds fold: the entities dealt to k folds by hash; without k each entity is its own fold."""
    return frame.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(k)).cast("string") if k else F.col(group).cast("string"))


def check_groups(frame: DataFrame, group: str) -> None:
    if frame.select(group).distinct().limit(2).count() < 2:
        raise ContractError("leaving one out needs two groups")


# Closed forms.

def fold_medians(frame: DataFrame, target: str, group: str = "bearing", within: list[str] = ()) -> DataFrame:
    """For each group (as fold), and value of within, the median of the target over all other groups."""
    return ranks.medians_without(frame, list(within), group, target).withColumnRenamed(group, "fold")


def median_cv(frame: DataFrame, target: str = "rul_seconds", group: str = "bearing") -> DataFrame:
    """Predictions of the median of all other groups' targets."""
    check_groups(frame, group)
    fit = fold_medians(frame, target, group).select(F.col("fold").alias(group), "median")
    return frame.join(fit, group).withColumn("predicted", clipped("median")).drop("median").withColumn("model", F.lit("median"))


def median_fit(frame: DataFrame, target: str) -> DataFrame:
    return ranks.quantiles(frame, [], target, {"median": 0.5})


def median_predict(frame: DataFrame, fit: DataFrame) -> DataFrame:
    return frame.crossJoin(F.broadcast(fit)).withColumn("predicted", clipped("median")).drop("median")  # one row


def life_prior_fit(frame: DataFrame, target: str = "rul_seconds", age: str = "observed_age_seconds") -> DataFrame:
    """condition and life, the median total life; the row of a null condition is over all."""
    rows = frame.withColumn("_life", F.col(age) + F.col(target))
    return ranks.quantiles(rows, ["condition"], "_life", {"life": 0.5}).unionByName(ranks.quantiles(rows, [], "_life", {"life": 0.5}).withColumn("condition", F.lit(None).cast("int")))


def life_prior_predict(frame: DataFrame, fit: DataFrame, age: str = "observed_age_seconds") -> DataFrame:
    every = fit.where("condition IS NULL").select(F.col("life").alias("_all"))
    rows = frame.join(fit.where("condition IS NOT NULL"), "condition", "left").crossJoin(F.broadcast(every))  # one row
    return rows.withColumn("predicted", clipped(F.coalesce("life", "_all") - F.col(age))).drop("life", "_all")


def life_prior_cv(frame: DataFrame, target: str = "rul_seconds", group: str = "bearing", age: str = "observed_age_seconds") -> DataFrame:
    """The life prior of all other groups, for every group in one job."""
    check_groups(frame, group)
    rows = frame.withColumn("_life", F.col(age) + F.col(target))
    by_condition = fold_medians(rows, "_life", group, ["condition"]).select("condition", F.col("fold").alias(group), F.col("median").alias("_own"))
    every = fold_medians(rows, "_life", group).select(F.col("fold").alias(group), F.col("median").alias("_all"))
    out = rows.join(by_condition, ["condition", group], "left").join(every, group)
    return out.withColumn("predicted", clipped(F.coalesce("_own", "_all") - F.col(age))).drop("_own", "_all", "_life").withColumn("model", F.lit("condition_life_prior"))


def scaling(frame: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean and population deviation of each feature; a constant one is divided by 1."""
    return frame.agg(*(c for f in features for c in (F.avg(f).alias(f"m_{f}"), F.when(F.stddev_pop(f) > 0, F.stddev_pop(f)).otherwise(1.0).alias(f"s_{f}"))))


def scaled(frame: DataFrame, scale: DataFrame, features: list[str]) -> DataFrame:
    rows = frame.crossJoin(F.broadcast(scale))  # one row
    return rows.select(*frame.columns, F.array(*((F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}") for f in features)).alias("x"))


def standardised(train: DataFrame, test: DataFrame, features: list[str], target: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(x, y) of the training rows and (x, key) of the test rows, by mean and deviation of the training side."""
    fit = scaling(train, features)
    return scaled(train.withColumn("y", F.col(target).cast("double")), fit, features).select("x", "y"), scaled(test, fit, features).select("x", *key)


def knn_pruning(train: DataFrame, test: DataFrame, features: list[str], target: str, key: list[str], k: int = 3) -> DataFrame:
    """One row: compared, the pairs of blocks that knn_predict() compares, and pairs, all there are."""
    return neighbours.nearest(*standardised(train, test, features, target, key), key, k)[1]


def knn_predict(train: DataFrame, test: DataFrame, features: list[str], target: str, key: list[str], k: int = 3) -> DataFrame:
    """Distance-weighted mean of the k nearest training rows on standardised features; rows at distance 0 take all weight,
    distances that agree to 12 digits go by the target.

    Test rows of equal features have equal answers and are looked up once.  Blocks of rows are compared that the triangle
    inequality can't rule out (neighbours); what is shuffled then is k rows per distinct test row and block."""
    learned, asked = standardised(train, test, features, target, key)
    asked = kept(asked.withColumnRenamed("x", "_x"), "neighbours-test")  # the scale's last digits may differ if it is worked out again
    found, _ = neighbours.nearest(learned, asked.select(F.col("_x").alias("x"), "_x").distinct(), ["_x"], k)
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.round("d", neighbours.DIGITS).alias("r"), "y", "d"))), 1, k)
    best = found.groupBy("_x").agg(first.alias("near"))
    exact = F.filter("near", lambda n: n["d"] == 0)
    plain = F.aggregate(exact, F.lit(0.0), lambda a, n: a + n["y"]) / F.size(exact)
    weighted = F.aggregate("near", F.lit(0.0), lambda a, n: a + n["y"] / F.sqrt(n["d"])) / F.aggregate("near", F.lit(0.0), lambda a, n: a + 1 / F.sqrt(n["d"]))
    best = best.select("_x", F.when(F.size(exact) > 0, plain).otherwise(weighted).alias("predicted"))
    return test.join(asked.join(best, "_x").drop("_x"), key)


# MLlib.

def design(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def ridge(frame: DataFrame, features: list[str], target: str, alpha: float = 10.0) -> Pipeline:
    """Least squares with an even penalty on standardised features, in the form sum of squares + alpha * |w|^2."""
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s")).first()
    if not row["n"]:
        raise ContractError("no training rows")
    fit = LinearRegression(featuresCol="features", labelCol=target, predictionCol="raw", solver="normal", elasticNetParam=0.0, regParam=alpha * (row["s"] or 0.0) / row["n"], standardization=True)
    return Pipeline(stages=[design(features), fit])


def forest(features: list[str], target: str, seed: int = 42, **params) -> Pipeline:
    # rows remember their nodes: deep trees aren't walked from the root, nor sent to executors, in each pass
    return Pipeline(stages=[design(features), RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol="raw", seed=seed, **{"cacheNodeIds": True} | params)])


def boosted(features: list[str], target: str, seed: int = 42, **params) -> Pipeline:
    return Pipeline(stages=[design(features), GBTRegressor(featuresCol="features", labelCol=target, predictionCol="raw", seed=seed, **params)])


def make_model(name: str, frame: DataFrame, features: list[str], target: str, seed: int = 42, **overrides) -> Pipeline:
    """An unfitted MLlib pipeline by name."""
    params = effective_params(name, overrides)
    if name == "ridge":
        return ridge(frame, features, target, **params)
    if name == "random_forest":
        return forest(features, target, seed, **params)
    if name in ("hist_gradient_boosting", "gradient_boosting", "xgboost", "lightgbm"):
        return boosted(features, target, seed, **params)
    raise KeyError(f"{name} isn't an MLlib model")


def predict(fitted, frame: DataFrame) -> DataFrame:
    """frame with predicted, at least 0."""
    return fitted.transform(frame).withColumn("predicted", clipped("raw")).select(*frame.columns, "predicted")


def fit_predict(name: str, train: DataFrame, test: DataFrame, features: list[str], target: str = "rul_seconds", total_life: bool = False, age: str = "observed_age_seconds", seed: int = 42, **overrides) -> DataFrame:
    """test with predicted by the named model; total_life fits age + target and takes the age off again."""
    goal = "_goal"
    rows = train.withColumn(goal, F.col(target) + (F.col(age) if total_life else F.lit(0.0)))
    if name == "median":
        out = median_predict(test, median_fit(rows, goal))
    elif name == "condition_life_prior":
        return life_prior_predict(test, life_prior_fit(train, target, age), age)
    elif name == "knn":
        key = [c for c in ("bearing", "cut_file_index", "file_index") if c in test.columns]
        out = knn_predict(rows, test, features, goal, key, effective_params(name, overrides)["k"])
    elif name == "random_forest" and forests.grows(effective_params(name, overrides)):
        made = forests.predictions(rows, test, features, goal, seed, **effective_params(name, overrides))
        out = made.withColumn("predicted", clipped("raw")).select(*test.columns, "predicted")
    else:
        out = predict(make_model(name, rows, features, goal, seed, **overrides).fit(rows), test)
    return out.withColumn("predicted", clipped(F.col("predicted") - F.col(age))) if total_life else out


def leave_one_out(name: str, frame: DataFrame, features: list[str], target: str = "rul_seconds", group: str = "bearing", folds: int = 0, total_life: bool = False, seed: int = 42, **overrides) -> DataFrame:
    """Predictions of every row by a model that saw none of its fold, with model and held_out_bearing."""
    if name in ("median", "condition_life_prior") and not folds:
        if name == "median" and total_life:
            age = F.col("observed_age_seconds")
            out = median_cv(frame.withColumn("_goal", F.col(target) + age), "_goal", group).drop("_goal").withColumn("predicted", clipped(F.col("predicted") - age))
        else:
            out = (median_cv if name == "median" else life_prior_cv)(frame, target, group)
        return out.withColumn("held_out_bearing", F.col(group))
    rows = grouped(frame, folds, group)
    if name == "ridge":
        out = moments.leave_one_out(rows, [moments.Ridge(name, tuple(features), effective_params(name, overrides)["alpha"], total_life)], target, "fold")
        return out.drop("fold").withColumn("held_out_bearing", F.col(group))
    rows = kept(rows, "folds")
    check_groups(rows, "fold")
    names = sorted(r["fold"] for r in rows.select("fold").distinct().collect())  # one fit each

    def fold(f: str) -> DataFrame:
        return fit_predict(name, rows.where(F.col("fold") != f).drop("fold"), rows.where(F.col("fold") == f).drop("fold"), features, target, total_life, seed=seed, **overrides)

    with ThreadPool(min(AT_ONCE, len(names))) as pool:
        parts = pool.map(inheritable_thread_target(frame.sparkSession)(fold), names)
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("model", F.lit(name)).withColumn("held_out_bearing", F.col(group))


def importances(fitted, features: list[str], frame: DataFrame) -> DataFrame:
    """feature and importance, largest first: of trees their own, of linear models |coefficient| on standardised features."""
    last = fitted.stages[-1]
    spark = frame.sparkSession
    if hasattr(last, "featureImportances"):
        rows = list(zip(features, last.featureImportances.toArray().tolist(), strict=True))
    else:
        spread = frame.agg(*(F.stddev_pop(f).alias(f) for f in features)).first()
        rows = [(f, abs(float(c)) * float(spread[f])) for f, c in zip(features, last.coefficients.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")

