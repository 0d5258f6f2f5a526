"""Experiments: fitted models that can be saved, one experiment end to end, and jobs made of several experiments.

Every result is a DataFrame; closed forms and ridges fit all folds in one job, and all ridges of a suite in the same one; fits
of trees run one after the other.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..functions.expressions import clipped, finite
from . import contracts, datasets, evaluate, models, moments, trajectory

CLOSED = ("median", "condition_life_prior")
#: Baselines that are fitted, with their parameters; ridge takes the given columns too.
BASELINES: list[dict] = [
    {"model": "ridge", "params": {"alpha": 1.0}}, {"model": "random_forest", "params": {"numTrees": 200, "minInstancesPerNode": 3, "featureSubsetStrategy": "all"}},
    {"model": "hist_gradient_boosting", "params": {"maxIter": 250, "stepSize": 0.05}},
]
#: Ranges of a sweep: even on a logarithmic scale, even, whole numbers (by a step if there is one), or one of several.
SEARCH: dict[str, dict[str, tuple]] = {
    "ridge": {"alpha": ("log", 1e-2, 1e3)},
    "random_forest": {"numTrees": ("int", 300, 1000, 100), "maxDepth": ("one", 30, 4, 6, 8, 12), "minInstancesPerNode": ("int", 1, 5), "featureSubsetStrategy": ("one", "sqrt", "0.5", "all")},
    "gradient_boosting": {"maxIter": ("int", 50, 300), "stepSize": ("log", 1e-2, 0.2), "maxDepth": ("int", 2, 5)},
    "xgboost": {"maxIter": ("int", 200, 1000, 100), "maxDepth": ("int", 2, 6), "stepSize": ("log", 0.01, 0.2), "subsamplingRate": ("even", 0.6, 1.0), "featureSubsetStrategy": ("share", 0.6, 1.0), "minInstancesPerNode": ("int", 1, 10)},
    "lightgbm": {"maxIter": ("int", 200, 1000, 100), "stepSize": ("log", 0.01, 0.2), "maxDepth": ("one", 30, 3, 5, 7), "minInstancesPerNode": ("int", 2, 15), "subsamplingRate": ("even", 0.6, 1.0), "featureSubsetStrategy": ("share", 0.6, 1.0)},
}


def design_columns(model: str, features: list[str]) -> list[str]:
    """What a model looks at: the life prior takes condition and age, the median nothing, others the features."""
    return {"condition_life_prior": ["condition", "observed_age_seconds"], "median": []}.get(model, list(features))


def training_matrix(frame: DataFrame, schema: dict, group: str = "bearing") -> tuple[DataFrame, dict[str, list[str]]]:
    """Group, predictors and target of a table that keeps its contract, and the columns by role."""
    roles = contracts.training_contract(frame, schema, group)
    return frame.select(*roles["group"], *roles["predictor"], *roles["target"]), roles


@dataclass
class Fitted:
    """A model with what scoring has to know: a table for closed forms, else a pipeline."""

    name: str
    features: list[str]
    total_life: bool
    model: DataFrame | PipelineModel

    def predict(self, rows: DataFrame, age: str = "observed_age_seconds") -> DataFrame:
        """rows with predicted, at least 0."""
        if self.name == "condition_life_prior":
            return models.life_prior_predict(rows, self.model, age)
        out = models.median_predict(rows, self.model) if self.name == "median" else models.predict(self.model, rows)
        return out.withColumn("predicted", clipped(F.col("predicted") - F.col(age))) if self.total_life else out

    def save(self, path: str) -> None:
        """Writes model and description to a folder that all executors can reach."""
        if self.name in CLOSED:
            self.model.write.mode("overwrite").parquet(f"{path}/model")
            spark = self.model.sparkSession
        else:
            self.model.write().overwrite().save(f"{path}/model")
            spark = SparkSession.active()
        text = json.dumps({"name": self.name, "features": self.features, "total_life": self.total_life})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> Fitted:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    model = spark.read.parquet(f"{path}/model") if about["name"] in CLOSED else PipelineModel.load(f"{path}/model")
    return Fitted(about["name"], about["features"], about["total_life"], model)


def fit(name: str, frame: DataFrame, features: list[str], target: str = "rul_seconds", total_life: bool = False, age: str = "observed_age_seconds", seed: int = 42, **params) -> Fitted:
    """The named model on all rows; total_life fits age + target and takes the age off again."""
    if name == "condition_life_prior":
        return Fitted(name, list(features), False, models.life_prior_fit(frame, target, age))
    rows = frame.withColumn("_goal", F.col(target) + (F.col(age) if total_life else F.lit(0.0)))
    made = models.median_fit(rows, "_goal") if name == "median" else models.make_model(name, rows, features, "_goal", seed, **params).fit(rows)
    return Fitted(name, list(features), total_life, made)


@dataclass
class Experiment:
    """Tables of one experiment."""

    predictions: DataFrame
    folds: DataFrame
    summary: DataFrame
    monotonicity: DataFrame

    def write(self, path: str) -> None:
        for name in ("predictions", "folds", "summary", "monotonicity"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def refuse(name: str, frame: DataFrame, features: list[str], target: str = "rul_seconds", grid: dict | None = None) -> list[str]:
    """The columns a model looks at, if the experiment keeps its contract: none of them, nor any other that was asked for, is
    the target or one that is never a predictor; they are there and finite; there are two entities; and, if grid is given,
    the samples have its fractions and its numbers of entities and rows."""
    used = design_columns(name, features)
    if leaks := sorted({*used, *features} & {*catalog.NEVER_PREDICTORS, target}):
        raise contracts.ContractError(f"never predictors: {', '.join(leaks)}")
    faults = contracts.training_faults(frame, {"default_model_feature_columns": used or [target], "target_column": target, "blocked_predictor_columns": catalog.NEVER_PREDICTORS})
    contracts.assert_empty(faults if used else faults.where("check != 'leak'"), f"experiment {name}")
    if grid:
        contracts.assert_grid(frame, **grid)
    return used


def judged(rows: DataFrame, target: str = "rul_seconds") -> Experiment:
    """Tables of the predictions of one or more models."""
    per_fold = evaluate.metrics(rows, ["model", "held_out_bearing"], target)
    moves = trajectory.monotonicity(rows, value="predicted")
    return Experiment(rows, per_fold, evaluate.with_monotonicity(evaluate.prefix_summary(per_fold), evaluate.monotonic_rate(moves)), moves)


def run_experiment(name: str, frame: DataFrame, features: list[str], target: str = "rul_seconds", folds: int = 0, total_life: bool = False, label: str | None = None, path: str | None = None, grid: dict | None = None, **params) -> Experiment:
    """Contract, design, predictions of held-out entities, fold metrics, summary and monotonicity; written to path if it is given."""
    used = refuse(name, frame, features, target, grid)
    made = judged(models.leave_one_out(name, frame, used, target, folds=folds, total_life=total_life, **params).withColumn("model", F.lit(label or name)), target)
    if path:
        made.write(path)
    return made


def suite(frame: DataFrame, features: list[str], specs: list[dict], target: str = "rul_seconds", folds: int = 0, grid: dict | None = None) -> DataFrame:
    """Summaries of several experiments with status, best first; one that breaks its contract, has no such model or a label that was there has status error and a reason.

    All ridges are solved together, from one pass over the rows."""
    done, failed, ridges, seen = [], [], [], set()
    for spec in specs:
        name, label = spec["model"], spec.get("label") or spec["model"]
        try:
            if label in seen:
                raise contracts.ContractError(f"label {label} is used twice")
            seen.add(label)
            mine, params, life = spec.get("features", features), spec.get("params", {}), spec.get("total_life", False)
            if name == "ridge":
                ridges.append(moments.Ridge(label, tuple(refuse(name, frame, mine, target, grid)), models.effective_params(name, params)["alpha"], life))
            else:
                done.append(run_experiment(name, frame, mine, target, folds, life, label, grid=grid, **params).summary)
        except (contracts.ContractError, KeyError) as e:
            failed.append((label, f"{type(e).__name__}: {e}"[:500]))
    if ridges:
        rows = moments.leave_one_out(models.grouped(frame, folds), ridges, target, "fold").withColumn("held_out_bearing", F.col("bearing"))
        done.append(judged(rows, target).summary)
    out = [s.withColumns({"status": F.lit("ok"), "reason": F.lit(None).cast("string")}) for s in done]
    if failed:
        out.append(frame.sparkSession.createDataFrame([(m, "error", why, None, None) for m, why in failed], "model string, status string, reason string, mean_rmse double, worst_rmse double"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out).orderBy("status", "mean_rmse", "model")  # "error" has no scores


def baselines(frame: DataFrame, target: str = "rul_seconds", features: list[str] = (), folds: int = 0, presets: list[dict] | None = None) -> DataFrame:
    """The scoreboard of the models without parameters and, if there are features, of ridge, forest and boosted trees on them."""
    fitted = (BASELINES if presets is None else presets) if features else []
    return evaluate.scoreboard(suite(frame, list(features), [*({"model": m} for m in CLOSED), *fitted], target, folds))


def feature_ablation(name: str, frame: DataFrame, sets: dict[str, list[str]], target: str = "rul_seconds", folds: int = 0, **params) -> DataFrame:
    """One model on several sets of columns."""
    return suite(frame, [], [{"model": name, "label": label, "features": columns, "params": params} for label, columns in sets.items()], target, folds)


def target_ablation(names: list[str], frame: DataFrame, features: list[str], target: str = "rul_seconds", folds: int = 0) -> DataFrame:
    """Models fitted on the remaining and on the total life; one row per model, with the difference of mean rmse."""
    for m in names:
        refuse(m, frame, features, target)
    specs = [{"model": m, "label": f"{m}:{kind}", "total_life": kind == "total_life"} for m in names for kind in ("direct", "total_life")]
    parts = F.split("model", ":")
    rows = suite(frame, features, specs, target, folds).where("status = 'ok'").select(F.get(parts, F.lit(0)).alias("model"), F.get(parts, F.lit(1)).alias("kind"), "mean_rmse")
    wide = rows.groupBy("model").pivot("kind", ["direct", "total_life"]).agg(F.first("mean_rmse"))
    return wide.withColumn("gain", F.col("direct") - F.col("total_life"))


def candidates(name: str, n: int, seed: int = 42) -> list[dict]:
    """n sets of parameters, drawn from SEARCH."""
    rng, out = random.Random(seed), []
    draw = {
        "log": lambda low, high: math.exp(rng.uniform(math.log(low), math.log(high))), "even": rng.uniform, "share": lambda low, high: f"{rng.uniform(low, high):.4f}",
        "int": lambda low, high, step=1: rng.randrange(low, high + 1, step), "one": lambda *several: rng.choice(several),
    }
    for _ in range(n):
        out.append({key: draw[kind](*ends) for key, (kind, *ends) in SEARCH[name].items()})
    return out


def sweep(name: str, frame: DataFrame, features: list[str], n: int, target: str = "rul_seconds", folds: int = 0, seed: int = 42) -> DataFrame:
    """Candidates with mean and worst rmse over held-out entities, best first; params is JSON."""
    refuse(name, frame, features, target)
    tried = candidates(name, n, seed)
    rows = suite(frame, features, [{"model": name, "label": f"{k}", "params": p} for k, p in enumerate(tried)], target, folds)
    text = F.create_map(*(x for k, p in enumerate(tried) for x in (F.lit(f"{k}"), F.lit(json.dumps(p, sort_keys=True)))))
    return rows.where("status = 'ok'").select(F.col("model").cast("int").alias("candidate"), F.try_element_at(text, F.col("model")).alias("params"), "mean_rmse", "worst_rmse").orderBy("mean_rmse", "candidate")


def split_fit(name: str, frame: DataFrame, features: list[str], learn: str, judge: str, target: str = "rul_seconds", split: str = "split", **params) -> tuple[Fitted, DataFrame]:
    """A fit on one split; and metrics on another with the rows of either that were dropped because a value is missing."""
    one, two = (contracts.select_split(frame, s, split) for s in (learn, judge))
    used = [*design_columns(name, features), target]
    whole = lambda rows: contracts.complete_rows(rows, used)
    fitted = fit(name, whole(one), design_columns(name, features), target, **params)
    bad = reduce(lambda a, b: a | b, (~finite(c) for c in used))
    lost = lambda rows, alias: rows.agg(F.count_if(bad).alias(alias))
    scores = evaluate.metrics(fitted.predict(whole(two)), [], target)
    return fitted, scores.crossJoin(lost(one, "n_dropped_learn")).crossJoin(lost(two, "n_dropped_judge"))  # one row each


def official_holdout(samples: DataFrame, endpoints: DataFrame, truth: DataFrame, names: list[str], features: list[str], target: str = "rul_seconds") -> tuple[DataFrame, DataFrame]:
    """Predictions of models that were fitted on all samples, one row per model and entity; and their metrics with rank and winner."""
    rows = datasets.align(endpoints, truth)
    contracts.assert_unique(rows, ["bearing"], "endpoints")
    made = reduce(lambda a, b: a.unionByName(b), (fit(m, samples, design_columns(m, features), target).predict(rows).select("bearing", target, "predicted", F.lit(m).alias("model")) for m in names))
    scores = evaluate.ranked(evaluate.metrics(made, ["model"], target))
    return made, scores.withColumn("winner", F.col("rank") == 1)


def score_requests(fitted: Fitted, requests: DataFrame) -> DataFrame:
    """Parsed requests with predicted_rul_seconds, status ok or error, and error_message; rows that were rejected aren't scored.

    Rows come with outcome and reason as parsed_requests() gives them."""
    ok = F.col("outcome") == "ok"
    good = fitted.predict(requests.where(ok)).withColumnRenamed("predicted", "predicted_rul_seconds")
    failed = ~finite("predicted_rul_seconds")
    good = good.withColumns({"status": F.when(failed, "error").otherwise("ok"), "error_message": F.when(failed, "no finite prediction")})
    rest = requests.where(~F.coalesce(ok, F.lit(False))).withColumns({"status": F.lit("error"), "error_message": F.col("reason")})
    return good.unionByName(rest, allowMissingColumns=True).drop("outcome", "reason")
