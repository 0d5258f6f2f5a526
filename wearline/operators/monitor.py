"""Reference ranges, drift of logged features, dashboards of the prediction log, and perturbations of requests."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions.expressions import finite
from . import ranks

RATIO_ENDINGS = ("_current_over_early", "_recent_mean_over_early")


def unpivoted(frame: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """feature and value, finite values only."""
    rows = frame.select(*keep, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([*keep], columns, "feature", "value")
    return rows.where(finite("value"))


def reference_ranges(frame: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """feature, p01 and p99 with linear interpolation."""
    return ranks.quantiles(unpivoted(frame, columns), ["feature"], "value", {"p01": low, "p99": high})


def out_of_range(frame: DataFrame, ranges: DataFrame, columns: list[str]) -> DataFrame:
    """feature and share of values outside its range."""
    rows = unpivoted(frame, columns).join(F.broadcast(ranges), "feature")  # a row per feature
    return rows.groupBy("feature").agg(F.avg(((F.col("value") < F.col("p01")) | (F.col("value") > F.col("p99"))).cast("double")).alias("share_outside"))


def sanity(reference: DataFrame, target: str, current: DataFrame, prediction: str) -> DataFrame:
    """Count, mean, sample deviation, least, median and largest of the training target and of predictions."""
    rows = reference.select(F.lit("reference").alias("side"), F.col(target).alias("v")).unionByName(current.select(F.lit("current").alias("side"), F.col(prediction).alias("v")))
    found = rows.groupBy("side").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return ranks.joined([found, ranks.quantiles(rows, ["side"], "v", {"median": 0.5})], ["side"])


def data_summary(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature: rows, missing, moments and quartiles."""
    rows = frame.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "value")
    v = F.when(finite("value"), F.col("value"))
    found = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(v.isNull().cast("long")).alias("n_missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    found = ranks.joined([found, ranks.quantiles(rows.withColumn("value", v), ["feature"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})], ["feature"])
    return found.select("feature", "n_rows", "n_missing", "mean", "std", "min", "p25", "p50", "p75", "max")


def kolmogorov_p(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Tail of the Kolmogorov distribution by its series."""
    e = F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    x = (e + 0.12 + 0.11 / e) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def drift(reference: DataFrame, current: DataFrame, columns: list[str], level: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov per feature: feature, n_reference, n_current, statistic, p_value and drifted.

    Values are counted per side first, and the two distributions are summed up over them in bins of values."""
    tagged = unpivoted(reference, columns).select("feature", "value", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(unpivoted(current, columns).select("feature", "value", F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = tagged.groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = ranks.cumulated(counts, ["feature"], ["a", "b"])
    found = rows.groupBy("feature").agg(F.max("total_a").alias("n_reference"), F.max("total_b").alias("n_current"), F.max(ranks.largest_gap("a", "b")).alias("statistic"))
    p = F.when(F.col("statistic").isNotNull(), kolmogorov_p(F.col("statistic"), F.col("n_reference"), F.col("n_current")))
    return found.withColumn("p_value", p).withColumn("drifted", F.coalesce(F.col("p_value") < level, F.lit(False)))


def drift_share(report: DataFrame) -> DataFrame:
    return report.agg(F.avg(F.col("drifted").cast("double")).alias("share"))


def drift_gate(report: DataFrame, threshold: float = 0.5) -> DataFrame:
    """share and failed; an empty window has share 0 and passes."""
    share = F.coalesce(F.avg(F.when(F.col("n_current") > 0, F.col("drifted").cast("double")).otherwise(0.0)), F.lit(0.0))
    return report.agg(share.alias("share")).withColumn("failed", F.col("share") > threshold)


# Dashboards.

def bucket(at: str, width: str) -> Column:
    return F.window(F.col(at).cast("timestamp"), width)["start"]


def dashboard(log: DataFrame, width: str = "1 hour", at: str = "requested_at") -> DataFrame:
    """Requests, latency median and 95th percentile, and error rate in percent per time bucket."""
    rows = log.groupBy(bucket(at, width).alias("bucket")).agg(F.count(F.lit(1)).alias("requests"), F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("q"), (100 * F.avg((F.col("status") == "error").cast("double"))).alias("error_rate"))
    return rows.select("bucket", "requests", F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p95"), "error_rate")


def throughput(log: DataFrame, at: str = "requested_at") -> DataFrame:
    """Requests a minute over the whole log, of at least one minute."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    minutes = F.greatest((micros(F.max(at)) - micros(F.min(at))) / 60_000_000, F.lit(1.0))
    return log.agg((F.count(F.lit(1)) / minutes).alias("per_minute"))


def active_model(log: DataFrame, at: str = "requested_at") -> DataFrame:
    """The label of the latest request."""
    best = F.max_by(F.concat_ws(" / ", "model_name", "model_version", "model_alias"), F.struct(at, "request_id"))
    return log.agg(best.alias("active_model"))


# Perturbations.

def amplitude_drift(frame: DataFrame, ranges: dict[str, tuple[float, float]], factor: float = 4.0) -> DataFrame:
    """Every ratio column becomes factor times the upper end of its range."""
    return frame.withColumns({c: F.lit(float(ranges[c][1] * factor)) for c in frame.columns if c.endswith(RATIO_ENDINGS)})


def channel_drift(frame: DataFrame) -> DataFrame:
    """Horizontal and vertical columns change places."""
    other = lambda c: c.replace("_horiz", "_vert") if "_horiz" in c else c.replace("_vert", "_horiz")
    return frame.select(*(F.col(other(c) if other(c) in frame.columns else c).alias(c) for c in frame.columns))


def missing_sentinel(frame: DataFrame, columns: list[str], sentinel: float = -999.0) -> DataFrame:
    return frame.withColumns({c: F.lit(sentinel) for c in columns})


def extreme_values(frame: DataFrame, ranges: dict[str, tuple[float, float]], columns: list[str], multiplier: float = 10.0) -> DataFrame:
    return frame.withColumns({c: F.lit(float(ranges[c][1] * multiplier)) for c in columns})


def scenario_report(reference: DataFrame, current: DataFrame, columns: list[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """scenario and drifted share: the current rows as they are and under each perturbation."""
    made = {"none": current, "amplitude": amplitude_drift(current, ranges), "channel": channel_drift(current), "quality": missing_sentinel(current, columns[:3])}
    out = None
    for name, rows in made.items():
        part = drift_share(drift(reference, rows, columns)).withColumn("scenario", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def ranges_of(table: DataFrame) -> dict[str, tuple[float, float]]:
    """The ranges table as a dict: a row per feature."""
    return {r["feature"]: (r["p01"], r["p99"]) for r in table.collect()}


# Requests.

def parsed_requests(requests: DataFrame, body: str, columns: list[str] | None = None) -> DataFrame:
    """Adds outcome (ok or rejected), reason and the columns of a JSON body: missing, extra and non-numeric fields reject it."""
    names = columns or catalog.prefix_columns()
    rows = requests.withColumn("_m", F.from_json(body, "map<string,string>"))
    keys = F.map_keys("_m")
    wanted = F.array(*map(F.lit, names))
    missing, extra = F.array_except(wanted, keys), F.array_except(keys, wanted)
    values = {c: F.try_element_at("_m", F.lit(c)).try_cast("double") for c in names}
    wrong = F.array(*(F.when(~finite(v), F.lit(c)) for c, v in values.items()))
    # lists are sorted only for a message; joining leaves nulls out
    sorted_ = lambda kind, x: F.concat(F.lit(f"{kind} "), F.array_join(F.array_sort(x), ","))
    faulty = reduce(lambda a, b: a | b, (~finite(v) for v in values.values()), F.lit(False))
    reason = F.when(F.col("_m").isNull(), "not a JSON object").when(F.size(missing) > 0, sorted_("missing", missing)).when(F.size(extra) > 0, sorted_("extra", extra)).when(faulty, F.concat(F.lit("not a number "), F.array_join(wrong, ",")))
    rows = rows.withColumn("reason", reason)
    return rows.select(*requests.columns, F.when(F.col("reason").isNull(), "ok").otherwise("rejected").alias("outcome"), "reason", *(F.when(F.col("reason").isNull(), v).alias(c) for c, v in values.items()))


def invalid_requests(columns: list[str] | None = None) -> list[str]:
    """Three bodies that must be rejected: a field missing, one too many, one that is no number."""
    names = columns or catalog.prefix_columns()
    base = dict.fromkeys(names, 1.0)
    return [json.dumps({k: v for k, v in base.items() if k != names[0]}), json.dumps(base | {"unexpected_field": 1.0}), json.dumps(base | {names[0]: "not-a-number"})]


def scored(log: DataFrame, age: str = "observed_age_seconds", life: float = 20_000.0) -> DataFrame:
    """Accepted requests with a prediction by a life prior, at least 0; others with status error."""
    ok = F.col("outcome") == "ok"
    return log.withColumn("predicted_rul_seconds", F.when(ok, F.greatest(F.lit(0.0), F.lit(life) - F.col(age)))).withColumn("status", F.when(ok, "ok").otherwise("error")).withColumnRenamed("reason", "error_message")


