"""Prefix samples and health-indicator samples.

All columns of a prefix depend on rows up to its cut alone, and on few of them: the first and the last ones.  A row is
passed on only to the cuts that look at it, and each (entity, cut) is one aggregation; rows are numbered cell by cell, so no
task holds a whole trajectory, and there is no join of trajectories with prefixes.  Health samples work their indicator out at every row and pick the cuts afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions.expressions import window_slope
from . import blocks
from .signal import with_totals
from .trajectory import by, with_context, with_position


def cut_position(n: Column, fraction: Column, least: int = 1) -> Column:
    """0-based row of a cut: (n - 1) * fraction, half to even, held within [least, n - 2]."""
    return F.greatest(F.lit(least), F.least(n - 2, F.rint((n - 1) * fraction).cast("int")))


def check_fractions(fractions) -> None:
    if not fractions or list(fractions) != sorted(set(fractions)) or not all(0 < f < 1 for f in fractions):
        raise ValueError("cut fractions must ascend within (0, 1)")


def at_cuts(rows: DataFrame, fractions, least: int, entity: str) -> DataFrame:
    """The rows at the cuts of each trajectory with cut_fraction; of fractions that meet at a row the first one stays.
    Every row compares its own position with the few cuts, so nothing is shuffled beyond the window."""
    check_fractions(fractions)
    n = F.count(F.lit(1)).over(Window.partitionBy(entity))
    cuts = F.array(*(F.struct(F.lit(float(f)).alias("f"), (cut_position(F.col("_n"), F.lit(float(f)), least) + 1).alias("at")) for f in fractions))
    hit = F.get(F.filter("_cuts", lambda c: c["at"] == F.col("position")), F.lit(0))
    return rows.withColumn("_n", n).withColumn("_cuts", cuts).withColumn("cut_fraction", hit["f"]).where(F.col("cut_fraction").isNotNull()).drop("_n", "_cuts")


def enough_rows(frame: DataFrame, least: int, entity: str) -> DataFrame:
    """frame, failing the job for an entity of fewer rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(entity))
    return frame.withColumn("_size", n).withColumn("_ok", F.when(F.col("_size") >= least, True).otherwise(F.raise_error(F.lit(f"a trajectory needs at least {least} rows")).cast("boolean"))).where("_ok").drop("_size", "_ok")


def features_at(rows: DataFrame, cuts: list[tuple[float, Column]], keep: list[str], early: int, recent: int, entity: str = "bearing", order: str = "file_index") -> DataFrame:
    """One row per entity and cut with the prefix predictors, cut_fraction, file_index and the kept columns of the row at the cut.

    rows has position; cuts are fractions and the places of their cuts.  A row goes to the cuts at or after it of whose first early or last
    recent rows it is one; of cuts that meet at a row the first one stays.  Plain comparisons, which Spark compiles, not functions over an array."""
    rows = rows.withColumns({f"_at_{i}": at.cast("long") for i, (_, at) in enumerate(cuts)})
    at = [F.col(f"_at_{i}") for i in range(len(cuts))]
    new = lambda i: reduce(lambda a, x: a & (at[i] != x), at[:i], F.col("position") <= at[i])
    near = lambda i: (F.col("position") > at[i] - recent) | (F.col("position") <= early)
    mine = F.array(*(F.when(new(i) & near(i), F.struct(F.lit(float(f)).alias("f"), at[i].alias("at"))) for i, (f, _) in enumerate(cuts)))
    rows = rows.select(entity, order, "position", *keep, *catalog.SOURCES, F.explode(mine).alias("_cut")).where("_cut IS NOT NULL")
    at, hours = F.col("_cut.at"), F.col("position") * (catalog.INTERVAL_SECONDS / 3600)
    here = lambda c: F.max(F.when(F.col("position") == at, F.col(c)))
    near = lambda c: F.when(F.col("position") > at - recent, F.col(c))
    # at most early rows; six percentiles would keep a map of values each
    first = F.collect_list(F.when(F.col("position") <= early, F.struct(*(F.col(s).cast("double").alias(s) for s in catalog.SOURCES))))
    made = [first.alias("_first"), *(here(c).alias(c) for c in (order, *keep))]
    for s in catalog.SOURCES:
        made += [here(s).alias(f"_c_{s}"), F.avg(near(s)).alias(f"_m_{s}"), F.coalesce(F.regr_slope(near(s), hours), F.lit(0.0)).alias(f"{s}_recent_slope_per_hour")]
    found = rows.groupBy(entity, F.col("_cut.f").alias("cut_fraction"), at.alias("_at")).agg(*made)
    ranked = lambda s: F.array_sort(F.filter(F.transform("_first", lambda x: x[s]), lambda v: v.isNotNull()))
    found = found.withColumns({f"_r_{s}": ranked(s) for s in catalog.SOURCES}).drop("_first")
    middle = lambda s, up: F.get(f"_r_{s}", F.floor((F.size(f"_r_{s}") - 1 + up) / 2).cast("int"))
    scale = lambda s: F.greatest(F.abs((middle(s, 0) + middle(s, 1)) / 2), F.lit(1e-8))
    new = {"observed_age_seconds": F.col(order) * float(catalog.INTERVAL_SECONDS)}
    for s in catalog.SOURCES:
        new |= {f"{s}_current_over_early": F.col(f"_c_{s}") / scale(s), f"{s}_recent_mean_over_early": F.col(f"_m_{s}") / scale(s)}
    return with_context(found.withColumns(new))


def positions(frame: DataFrame, least: int, entity: str) -> DataFrame:
    """Adds position and _n, the length of the trajectory, by counts per cell; fails the job for an entity of fewer rows than least."""
    rows = blocks.positioned(frame, entity).drop("_last")
    return rows.withColumn("_n", F.when(F.col("_n") >= least, F.col("_n")).otherwise(F.raise_error(F.lit(f"a trajectory needs at least {least} rows")).cast("bigint")))


def prefix_samples(frame: DataFrame, fractions=catalog.CUT_FRACTIONS, early: int = catalog.EARLY_ROWS, recent: int = catalog.RECENT_ROWS) -> DataFrame:
    """Training samples at the cuts, with the target and total_life_seconds, which is never a predictor."""
    check_fractions(fractions)
    cuts = [(f, cut_position(F.col("_n"), F.lit(float(f))) + 1) for f in fractions]
    rows = features_at(positions(frame, 4, "bearing"), cuts, ["condition", "rul_seconds"], early, recent)
    return rows.select("condition", "bearing", "cut_fraction", F.col("file_index").alias("cut_file_index"), *catalog.prefix_columns(), "rul_seconds", (F.col("observed_age_seconds") + F.col("rul_seconds")).alias("total_life_seconds"))


def prefix_endpoints(frame: DataFrame, early: int = catalog.EARLY_ROWS, recent: int = catalog.RECENT_ROWS) -> DataFrame:
    """One inference row per entity, at its last file; the target must not be there."""
    if "rul_seconds" in frame.columns:
        raise ValueError("endpoint features must not see rul_seconds")
    rows = features_at(positions(frame, 2, "bearing"), [(1.0, F.col("_n"))], ["condition"], early, recent)
    return rows.select("condition", "bearing", F.col("file_index").alias("cut_file_index"), *catalog.prefix_columns())


def with_health(frame: DataFrame, healthy: int = catalog.HEALTHY_ROWS, recent: int = catalog.RECENT_ROWS, clip: float = catalog.ROBUST_CLIP, entity: str = "bearing", order: str = "file_index") -> DataFrame:
    """Adds robust deviations from the healthy first rows and the health indicator with its statistics.  Valid from the
    healthy window on, where cuts lie: the baseline is then the same for all prefixes of an entity."""
    rows = with_context(with_totals(with_position(frame, entity, order)))
    whole = Window.partitionBy(entity)
    first = lambda x: F.when(F.col("position") <= healthy, x)
    signals = catalog.HEALTH_SIGNALS
    rows = rows.withColumns({f"_m_{s}": F.percentile(first(F.col(s)), F.lit(0.5)).over(whole) for s in signals} | {f"_d_{s}": F.stddev_pop(first(F.col(s))).over(whole) for s in signals})
    rows = rows.withColumns({f"_a_{s}": F.percentile(first(F.abs(F.col(s) - F.col(f"_m_{s}"))), F.lit(0.5)).over(whole) for s in signals})
    scale = lambda s: F.greatest(1.4826 * F.col(f"_a_{s}"), 0.10 * F.col(f"_d_{s}"), 0.01 * F.abs(F.col(f"_m_{s}")), F.lit(1e-8))
    rows = rows.withColumns({f"{s}_robust_z_current": F.least(F.abs(F.col(s) - F.col(f"_m_{s}")) / scale(s), F.lit(clip)) for s in signals})
    ranked = F.array_sort(F.array(*(F.log1p(f"{s}_robust_z_current") for s in signals)))
    low, high = (len(signals) - 1) // 2, len(signals) // 2
    rows = rows.withColumn("hi_current", (F.get(ranked, F.lit(low)) + F.get(ranked, F.lit(high))) / 2)
    near, past = by(entity, order).rowsBetween(-(recent - 1), 0), by(entity, order).rowsBetween(Window.unboundedPreceding, 0)
    hi, hours = F.col("hi_current"), F.col("position") * (catalog.INTERVAL_SECONDS / 3600)
    new = {
        "observed_age_seconds": F.col(order) * float(catalog.INTERVAL_SECONDS), "hi_recent_mean": F.avg(hi).over(near), "hi_recent_std": F.coalesce(F.stddev_pop(hi).over(near), F.lit(0.0)), "hi_recent_max": F.max(hi).over(near),
        "hi_recent_slope_per_hour": window_slope(hi, hours, near), "hi_full_mean": F.avg(hi).over(past), "hi_full_max": F.max(hi).over(past), "hi_full_slope_per_hour": window_slope(hi, hours, past),
    }
    rows = rows.withColumns(new | {f"{s}_robust_z_recent_mean": F.avg(f"{s}_robust_z_current").over(near) for s in signals})
    return rows.drop(*(f"_{k}_{s}" for k in "mda" for s in signals))


def health_samples(frame: DataFrame, fractions=catalog.CUT_FRACTIONS, healthy: int = catalog.HEALTHY_ROWS, recent: int = catalog.RECENT_ROWS, clip: float = catalog.ROBUST_CLIP) -> DataFrame:
    """Health-indicator samples at the cuts, none before the healthy window ends."""
    if healthy < 2 or recent < 2:
        raise ValueError("windows must have at least 2 rows")
    rows = at_cuts(with_health(enough_rows(frame, healthy + 3, "bearing"), healthy, recent, clip), fractions, healthy, "bearing")
    return rows.select("condition", "bearing", "cut_fraction", F.col("file_index").alias("cut_file_index"), *catalog.health_columns(), "rul_seconds")
