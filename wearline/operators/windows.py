"""Statistics of time windows from states that merge: drift from counts per bin, latency quantiles from sketches.

A reference is cut at values that hold at most one in BINS of its rows between them, or all its values if they are fewer.  How
many values of a window fall between the cuts is all that has to be kept of it, so it can be counted in any order, in parts and
over batches.  The statistic compares both distributions at the cuts; it is below the Kolmogorov-Smirnov statistic by at most
1 / BINS, and equal to it where each of the reference's values is a cut and the window has no others.

Quantiles come from one KLL sketch a minute; hours and days are merged from those.  With SIZE values a level the rank of a
quantile is off by at most RANK_ERROR with a probability of 0.99.  quantile_error() gives how far off the ranks really are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks
from .monitor import bucket, kolmogorov_p, unpivoted

BINS = 100
#: Values a level of a sketch keeps, and the rank error of that with a probability of 0.99.
SIZE, RANK_ERROR = 400, 0.0067


# Drift.

def reference_bins(reference: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """feature, cuts (ascending values) with shares (of rows at or below each), and n_reference; a row per feature."""
    rows = ranks.cumulated(ranks.counted(unpivoted(reference, columns), ["feature"], "value"), ["feature"])
    last = F.expr(f"(below_n + n) * {bins}L div total_n > below_n * {bins}L div total_n")
    each = rows.where(last).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("value", ((F.col("below_n") + F.col("n")) / F.col("total_n")).alias("share")))).alias("c"), F.max("total_n").alias("n_reference"))
    return each.select("feature", F.col("c.value").alias("cuts"), F.col("c.share").alias("shares"), "n_reference")


def bin_counts(rows: DataFrame, bins: DataFrame, columns: list[str], width: str, at: str = "requested_at") -> DataFrame:
    """start, feature, bin (how many cuts are below a value) and n of each window; also for a stream with a watermark."""
    cuts = F.broadcast(bins.select("feature", "cuts"))  # a row per feature
    found = unpivoted(rows, columns, [at]).join(cuts, "feature").withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("value"))))
    return found.groupBy(F.window(F.col(at), width).alias("w"), "feature", "bin").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "feature", "bin", "n")


def window_drift(counts: DataFrame, bins: DataFrame, level: float = 0.05) -> DataFrame:
    """start, feature, n_reference, n_current, statistic, p_value and drifted, from counts per bin."""
    each = counts.groupBy("start", "feature").agg(F.collect_list(F.struct("bin", "n")).alias("b"), F.sum("n").alias("n_current")).join(F.broadcast(bins), "feature")
    below = lambda i: F.aggregate("b", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["bin"] <= i, x["n"]).otherwise(F.lit(0).cast("long")))
    gaps = F.transform("shares", lambda s, i: F.abs(s - below(i) / F.col("n_current")))
    p = kolmogorov_p(F.col("statistic"), F.col("n_reference"), F.col("n_current"))
    return each.withColumn("statistic", F.array_max(gaps)).withColumn("p_value", p).withColumn("drifted", F.col("p_value") < level).select("start", "feature", "n_reference", "n_current", "statistic", "p_value", "drifted")


def drift_by_window(current: DataFrame, bins: DataFrame, columns: list[str], width: str = "1 day", at: str = "requested_at") -> DataFrame:
    """window_drift() of all windows of a table."""
    return window_drift(bin_counts(current, bins, columns, width, at), bins)


# Latency.

def sketched(log: DataFrame, width: str = "1 minute", at: str = "requested_at", size: int = SIZE) -> DataFrame:
    """bucket, requests, errors and the sketch of latency_ms; a row per bucket, also for a stream with a watermark."""
    rows = log if dict(log.dtypes)[at] == "timestamp" else log.withColumn(at, F.col(at).cast("timestamp"))  # a cast would lose the watermark
    found = rows.groupBy(F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "error").alias("errors"), F.kll_sketch_agg_double("latency_ms", F.lit(size)).alias("sketch"))
    return found.select(F.col("w.start").alias("bucket"), "requests", "errors", "sketch")


def rolled_up(sketches: DataFrame, width: str, size: int = SIZE) -> DataFrame:
    """The same for wider buckets, from the sketches alone."""
    return sketches.groupBy(bucket("bucket", width).alias("bucket")).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def quantile_of(share: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(share))


def dashboard_of(sketches: DataFrame) -> DataFrame:
    """bucket, requests, p50, p95 and error rate in percent; quantiles are null where no request has a latency."""
    some = F.kll_sketch_get_n_double("sketch") > 0
    return sketches.select("bucket", "requests", F.when(some, quantile_of(0.5)).alias("p50"), F.when(some, quantile_of(0.95)).alias("p95"), (100 * F.col("errors") / F.col("requests")).alias("error_rate"))


def exact_dashboard(log: DataFrame, width: str = "1 hour", at: str = "requested_at") -> DataFrame:
    """bucket, requests, p50, p95 and error rate with interpolated quantiles over counts of values: no reducer holds a bucket."""
    rows = log.withColumn("bucket", bucket(at, width))
    found = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("requests"), (100 * F.avg((F.col("status") == "error").cast("double"))).alias("error_rate"))
    return ranks.joined([found, ranks.quantiles(rows, ["bucket"], "latency_ms", {"p50": 0.5, "p95": 0.95})], ["bucket"]).select("bucket", "requests", "p50", "p95", "error_rate")


def quantile_error(log: DataFrame, dashboard: DataFrame, width: str, at: str = "requested_at") -> DataFrame:
    """bucket and how far off the ranks of its p50 and p95 are: 0 if the value's own range of ranks holds the wanted one."""
    rows = log.where(F.col("latency_ms").isNotNull()).withColumn("bucket", bucket(at, width)).join(dashboard.select("bucket", "p50", "p95"), "bucket")
    share = lambda q: (F.avg((F.col("latency_ms") < F.col(q)).cast("double")), F.avg((F.col("latency_ms") <= F.col(q)).cast("double")))
    off = lambda q, want: F.greatest(F.lit(0.0), share(q)[0] - want, want - share(q)[1])
    return rows.groupBy("bucket").agg(off("p50", 0.5).alias("off_p50"), off("p95", 0.95).alias("off_p95"))
