"""Exploration: summaries, profiles, correlations and histograms of feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import finite, unbiased_skewness
from . import ranks
from .monitor import unpivoted

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def run_summary(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshots, first and last file, run hours and range of remaining hours."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("snapshots"), F.min("file_index").alias("first_file"), F.max("file_index").alias("last_file"), ((F.max("elapsed_time_seconds") - F.min("elapsed_time_seconds")) / 3600).alias("run_hours"), (F.min("rul_seconds") / 3600).alias("min_rul_hours"), (F.max("rul_seconds") / 3600).alias("max_rul_hours"))


def two_level_counts(frame: DataFrame, keys: list[str], entity: str = "bearing") -> DataFrame:
    """Entities and rows per key, from counts per entity."""
    per = frame.groupBy(*keys, entity).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_entities"), F.sum("n").alias("n_rows"))


def crosstab(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair with margins, which are named All."""
    rows = frame.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return rows.select(F.when(F.col("g").bitwiseAND(2) > 0, "All").otherwise(F.col(a).cast("string")).alias(a), F.when(F.col("g").bitwiseAND(1) > 0, "All").otherwise(F.col(b).cast("string")).alias(b), "n")


def described(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Count, moments, quantiles and bias-corrected skewness per column."""
    rows, names = unpivoted(frame, columns), {f"p{round(100 * q):02d}": q for q in QUANTILES}
    found = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.skewness("value").alias("s"))
    found = ranks.joined([found, ranks.quantiles(rows, ["feature"], "value", names)], ["feature"])
    return found.select("feature", "count", "mean", "std", "min", *names, "max", unbiased_skewness(F.col("s"), F.col("count")).alias("skew"))


def quality_counts(frame: DataFrame, columns: list[str], keys: list[str], target: str = "rul_seconds") -> DataFrame:
    """Missing and infinite cells, rows with missing cells, repeated rows and keys, negative targets."""
    missing = [F.col(c).isNull() for c in columns]
    infinite = [F.coalesce(F.abs(F.col(c).cast("double")) == float("inf"), F.lit(False)) for c in columns]
    add = lambda cs: reduce(lambda a, b: a + b, (c.cast("long") for c in cs))
    one = frame.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(add(missing)).alias("missing_cells"), F.sum(reduce(lambda a, b: a | b, missing).cast("long")).alias("rows_with_missing"), F.sum(add(infinite)).alias("infinite_cells"), F.sum(F.coalesce((F.col(target) < 0).cast("long"), F.lit(0))).alias("negative_targets"))
    again = lambda cols, name: frame.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(name))
    return one.crossJoin(again(frame.columns, "repeated_rows")).crossJoin(again(keys, "repeated_keys"))  # one row each


def correlations(frame: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and r for all pairs of columns in order, in one pass of partial sums; null for a constant column."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    r = lambda i, j: F.try_divide(F.covar_pop(columns[i], columns[j]), F.nullif(F.stddev_pop(columns[i]) * F.stddev_pop(columns[j]), F.lit(0.0)))
    sums = frame.agg(*(r(i, j).alias(f"r_{i}_{j}") for i, j in pairs))
    rows = F.array(*(F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"r_{i}_{j}").alias("r")) for i, j in pairs))
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def correlation_with(frame: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Columns by the size of their correlation with the target."""
    return correlations(frame.select(*columns, target), [*columns, target]).where(F.col("b") == target).select(F.col("a").alias("feature"), "r").orderBy(F.desc(F.abs("r")), "feature")


def strongest_pairs(frame: DataFrame, columns: list[str], n: int = 15) -> DataFrame:
    return correlations(frame, columns).where("r IS NOT NULL").orderBy(F.desc(F.abs("r")), "a", "b").limit(n)


def value_counts(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def box_stats(frame: DataFrame, columns: list[str], group: str) -> DataFrame:
    rows = unpivoted(frame, columns, [group])
    found = rows.groupBy(group, "feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    found = ranks.joined([found, ranks.quantiles(rows, [group, "feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})], [group, "feature"])
    return found.select(group, "feature", "low", "q1", "median", "q3", "high")


def histogram(frame: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin from 0 and n, even bins between the least and the largest value, the last one closed."""
    v = F.col(column).cast("double")
    ends = frame.where(finite(column)).agg(F.min(v).alias("low"), F.max(v).alias("high"))
    rows = frame.where(finite(column)).crossJoin(F.broadcast(ends))  # one row
    width = (F.col("high") - F.col("low")) / bins
    place = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(v - F.col("low"), width)).cast("int")), F.lit(0))
    return rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def profile(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Type, non-null count and distinct values (null counts as one) per column."""
    kinds = F.create_map(*(F.lit(x) for c in columns for x in (c, dict(frame.dtypes)[c])))
    rows = frame.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "feature", "value")
    found = rows.groupBy("feature").agg(F.count("value").alias("non_null"), (F.countDistinct("value") + F.max(F.col("value").isNull().cast("long"))).alias("n_distinct"))
    return found.withColumn("kind", F.try_element_at(kinds, F.col("feature")))


def trimmed(frame: DataFrame, column: str, q: float = 0.995) -> DataFrame:
    """Rows up to the q quantile of a column."""
    limit = ranks.quantiles(frame, [], column, {"_q": q})
    return frame.crossJoin(F.broadcast(limit)).where(F.col(column) <= F.col("_q")).drop("_q")  # one row


def capped(frame: DataFrame, column: str, q: float = 0.995) -> DataFrame:
    limit = ranks.quantiles(frame, [], column, {"_q": q})
    return frame.crossJoin(F.broadcast(limit)).withColumn(column, F.least(column, "_q")).drop("_q")  # one row


def sampled(frame: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """At most n rows, the same for the same keys and seed."""
    return frame.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("split").agg(F.count(F.lit(1)).alias("n_bearings"), F.sum("n_acc").alias("n_acc"), F.sum("n_temp").alias("n_temp"), F.sum("hours").alias("hours"))


def family(columns: list[str], bands: bool) -> list[str]:
    """Columns of the spectral family, or the others."""
    return [c for c in columns if c.startswith("fft_band_") == bands]

