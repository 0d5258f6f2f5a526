"""Regression metrics and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import phm12_accuracy


def metrics(predictions: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """rmse, mae, r2 and phm12 per key in one aggregation; r2 is null for a constant target, phm12 without a positive one."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = y - p
    out = [F.count(F.lit(1)).alias("n_rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"), F.avg(phm12_accuracy(y, p)).alias("phm12")]
    return predictions.groupBy(*keys).agg(*out) if keys else predictions.agg(*out)


def cv_summary(folds: DataFrame, model: str = "model") -> DataFrame:
    """Mean and sample deviation of the fold metrics per model, best mean rmse first."""
    out = [F.count(F.lit(1)).alias("n_folds")]
    for m in ("rmse", "mae", "r2", "phm12"):
        out += [F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}")]
    return folds.groupBy(model).agg(*out).orderBy("mean_rmse", model)


def prefix_summary(folds: DataFrame, model: str = "model") -> DataFrame:
    """The same with median and worst rmse."""
    more = folds.groupBy(model).agg(F.percentile("rmse", F.lit(0.5)).alias("median_rmse"), F.max("rmse").alias("worst_rmse"))
    return cv_summary(folds, model).join(more, model).orderBy("mean_rmse", model)


def monotonic_rate(summary: DataFrame, model: str = "model") -> DataFrame:
    return summary.groupBy(model).agg(F.avg("monotonic_violation_rate").alias("mean_violation_rate"))


def rmse_by_entity(folds: DataFrame, models: list[str], entity: str = "held_out_bearing") -> DataFrame:
    """rmse, one column per model; naming the models spares a pass."""
    return folds.groupBy(entity).pivot("model", models).agg(F.first("rmse"))


def ranked(scores: DataFrame, by: str = "rmse", name: str = "model") -> DataFrame:
    """rank from 1 for the lowest score; scores are one row per model."""
    from pyspark.sql import Window

    return scores.withColumn("rank", F.row_number().over(Window.orderBy(by, name)))


def scoreboard(summaries: DataFrame) -> DataFrame:
    """Finished experiments, best first."""
    return summaries.where("status = 'ok'").orderBy("mean_rmse", "model")


def with_monotonicity(summary: DataFrame, rates: DataFrame) -> DataFrame:
    return summary.join(rates, "model", "left")
