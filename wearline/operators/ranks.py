"""Ranks, quantiles and lookups by rank over counts of distinct values.

Values are counted first, so a value that very many rows share is one row.  Each key's values are then dealt to bins of
even numbers of values; sums run within a bin, and a bin's start is the sum of the bins before it.  So a key of any size, also
the only key, is spread over BINS tasks, and no task or buffer holds all of its values.

Counts are written before bins are made, so that what they come from is worked out once.  So are the split points: they depend
on the order in which parts of the counts meet, and rows and the starts of bins have to agree on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

BINS = 64


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value and n of distinct values that aren't null."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def with_bins(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds bin: how many of the key's split points are below the value."""
    splits = counts.groupBy(*keys).agg(F.percentile_approx("value", F.array(*(F.lit(i / BINS) for i in range(1, BINS))), F.lit(20 * BINS)).alias("_splits"))
    splits = kept(splits, "splits")  # at most BINS numbers per key; worked out again they may differ
    rows = counts.join(splits, keys) if keys else counts.crossJoin(F.broadcast(splits))  # one row
    return rows.withColumn("bin", F.size(F.filter("_splits", lambda s: s < F.col("value")))).drop("_splits")


def bin_starts(rows: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """keys, bin, and per weight the sum of the bins before (start_) and of all bins (total_); at most BINS rows per key."""
    sums = rows.groupBy(*keys, "bin").agg(*(F.sum(w).alias(w) for w in weights))
    every = Window.partitionBy(*keys)
    before = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "bin", *(F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"start_{w}") for w in weights), *(F.sum(w).over(every).alias(f"total_{w}") for w in weights))


def cumulated(counts: DataFrame, keys: list[str], weights: list[str] = ("n",)) -> DataFrame:
    """counts with bin and, per weight, below_ (the sum over smaller values of the key) and total_."""
    rows = with_bins(kept(counts, "counts"), keys)
    within = Window.partitionBy(*keys, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_in_{w}": F.coalesce(F.sum(w).over(within), F.lit(0)) for w in weights}).join(bin_starts(rows, keys, list(weights)), [*keys, "bin"])
    return rows.withColumns({f"below_{w}": F.col(f"start_{w}") + F.col(f"_in_{w}") for w in weights}).drop(*(f"{p}_{w}" for w in weights for p in ("_in", "start")))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, by name, the quantiles of a column with linear interpolation; keys without values are left out."""
    found = cumulated(counted(rows, keys, value), keys)
    place = {name: (F.col("total_n") - 1) * F.lit(float(q)) for name, q in shares.items()}
    at = lambda p: F.max(F.when((F.col("below_n") <= p) & (p < F.col("below_n") + F.col("n")), F.col("value")))
    ends = [x for name, p in place.items() for x in (at(F.floor(p)).alias(f"_low_{name}"), at(F.ceil(p)).alias(f"_high_{name}"), F.max(p - F.floor(p)).alias(f"_part_{name}"))]
    low, high, part = (lambda name, k=k: F.col(f"_{k}_{name}") for k in ("low", "high", "part"))
    return found.groupBy(*keys).agg(*ends).select(*keys, *((low(n) * (1 - part(n)) + high(n) * part(n)).alias(n) for n in shares))


def at_places(ranked: DataFrame, wanted: DataFrame, keys: list[str], place: str) -> DataFrame:
    """wanted with value, the one that holds the 0-based place among the key's values; ranked comes from cumulated().

    Both sides are sorted by place within a bin, and each place takes the last value that starts at or before it."""
    starts = ranked.groupBy(*keys, "bin").agg(F.min("below_n").alias("start"))
    starts = starts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "bin"))).alias("_starts"))  # at most BINS
    asked = wanted.join(starts, keys) if keys else wanted.crossJoin(F.broadcast(starts))  # one row
    mine = F.filter("_starts", lambda s: s["start"] <= F.col(place))
    asked = asked.withColumn("bin", F.element_at(mine, -1)["bin"]).drop("_starts")
    both = asked.withColumns({"_place": F.col(place).cast("long"), "_kind": F.lit(1), "_value": F.lit(None).cast(ranked.schema["value"].dataType)}).unionByName(
        ranked.select(*keys, "bin", F.col("below_n").cast("long").alias("_place"), F.lit(0).alias("_kind"), F.col("value").alias("_value")), allowMissingColumns=True)
    last = F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys, "bin").orderBy("_place", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("value", last).where("_kind = 1").select(*wanted.columns, "value")


def medians_without(rows: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """keys, group, median and n_train: for each group the median of the value over all rows of the other groups.

    A group's own values shift ranks: those of them that come before the wanted one are counted, and the value is looked up at
    the rank in all rows.  So the work is that of one sort and a few rows per group, not of values times groups."""
    own = kept(counted(rows, [*keys, group], value).withColumnRenamed("n", "own"), "own")
    ranked = kept(cumulated(own.groupBy(*keys, "value").agg(F.sum("own").alias("n")), keys), "ranked")
    mine = Window.partitionBy(*keys, group)
    own = own.join(ranked.select(*keys, "value", "n", "below_n", "total_n"), [*keys, "value"])
    own = own.withColumn("_before", F.coalesce(F.sum("own").over(mine.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # values of others before a group's own copies of a value; equal ones of others come first
    own = own.withColumn("_others", F.col("below_n") - F.col("_before") + F.col("n") - F.col("own")).withColumn("n_train", F.col("total_n") - F.sum("own").over(mine))
    own = own.where("n_train > 0")
    middle = {"_low": F.floor((F.col("n_train") - 1) / 2), "_high": F.ceil((F.col("n_train") - 1) / 2)}
    place = own.groupBy(*keys, group, "n_train").agg(*(F.sum(F.when(F.col("_others") <= r, F.col("own")).otherwise(0)).alias(name) for name, r in middle.items()))
    place = place.withColumns({name: F.col(name) + r for name, r in middle.items()})
    asked = place.select(*keys, group, "n_train", F.explode(F.array("_low", "_high")).alias("place"))
    return at_places(ranked, asked, keys, "place").groupBy(*keys, group).agg(F.avg("value").alias("median"), F.max("n_train").alias("n_train"))


def largest_gap(a: str, b: str):
    """Column: how far apart the shares of two weights at or below a value are."""
    share = lambda w: F.try_divide((F.col(f"below_{w}") + F.col(w)).cast("double"), F.col(f"total_{w}"))
    return F.abs(share(a) - share(b))


def joined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables of one row per key side by side."""
    return reduce(lambda x, y: x.join(y, keys, "left"), parts)
