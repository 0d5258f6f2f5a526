"""Ordered windows over trajectories, no look into the future.  Rolling columns and centred medians work block by block (blocks)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog
from . import blocks, sliding


def by(entity: str = "bearing", order: str = "file_index"):
    return Window.partitionBy(entity).orderBy(order)


def with_position(frame: DataFrame, entity: str = "bearing", order: str = "file_index") -> DataFrame:
    """Adds position, from 1, in the order of the trajectory."""
    return frame.withColumn("position", F.row_number().over(by(entity, order)))


def with_identity(frame: DataFrame) -> DataFrame:
    """Adds elapsed_time_seconds, which starts at 0 for file 1."""
    return frame.withColumn("elapsed_time_seconds", (F.col("file_index") - 1) * catalog.INTERVAL_SECONDS)


def with_rul(frame: DataFrame, entity: str = "bearing") -> DataFrame:
    """Labels a full run: seconds up to the last file of the entity."""
    if "_last" in frame.columns:  # with_temporal() has counted already
        rows = frame
    else:
        ends = frame.groupBy(F.col(entity).alias("_entity")).agg(F.max("file_index").alias("_last"))
        rows = frame.join(ends, F.col(entity).eqNullSafe(F.col("_entity"))).drop("_entity")
    return rows.withColumn("rul_seconds", ((F.col("_last") - F.col("file_index")) * catalog.INTERVAL_SECONDS).cast("double")).drop("_last")


def with_context(frame: DataFrame) -> DataFrame:
    """Adds speed and load of the condition; an unknown condition fails the job."""
    dim = F.broadcast(catalog.conditions(frame.sparkSession))  # three rows
    rows = frame.drop(*catalog.CONTEXT).join(dim, "condition", "left")
    checked = lambda c: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit("unknown operating condition: "), F.coalesce(F.col("condition").cast("string"), F.lit("null")))).cast("double"))
    return rows.withColumns({c: checked(c) for c in catalog.CONTEXT})


def with_temporal(frame: DataFrame, sources: list[str] | None = None, windows: tuple[int, ...] = catalog.ROLLING_WINDOWS, entity: str = "bearing", order: str = "file_index", last: bool = False, digits: int | None = None) -> DataFrame:
    """Adds position, and rolling mean, population deviation and slope per second over the last rows of each trajectory; repeated
    places in its order fail the job.  Null values are left out; without any the mean is null, deviation and slope are 0.

    _last, the last place of the entity, stays if frame has it or last is true.  With digits all doubles are rounded, in the
    same pass: rounding some eighty columns by decimals in Spark costs more than the windows."""
    columns = list(sources or catalog.SOURCES)
    rows = frame if "position" in frame.columns else blocks.positioned(frame, entity, order).drop(*(() if last else ("_last",)), "_n")
    keep, kinds = rows.columns, dict(rows.dtypes)
    numbers = {c: c if kinds[c] == "double" else f"_y_{c}" for c in columns}
    cut = blocks.haloed(rows, max(windows) - 1).withColumns({y: F.col(c).cast("double") for c, y in numbers.items() if y != c}).repartition(entity, "_block").sortWithinPartitions(entity, "_block", "position", order)
    names = [f"{c}_roll_{kind}_{n}" for c in columns for n in windows for kind in catalog.ROLLING_STATS]
    step = float(catalog.INTERVAL_SECONDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in sliding.appended(batches, list(numbers.values()), windows, entity, order, step, keep):
            made = made.rename_columns([*keep, *names])
            yield made if digits is None else sliding.rounded(made, digits)

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)])
    return cut.mapInArrow(run, schema)


def last_rows(frame: DataFrame, entity: str = "bearing", order: str = "file_index") -> DataFrame:
    """The last row of each entity, by one aggregation that keeps a row per task and entity."""
    packed = frame.groupBy(entity).agg(F.max_by(F.struct(*frame.columns), F.col(order)).alias("r"))
    return packed.select("r.*")


def longest_per_group(frame: DataFrame, group: str = "condition", entity: str = "bearing") -> DataFrame:
    """The entity with most rows in each group; ties go to the larger name."""
    sizes = frame.groupBy(group, entity).agg(F.count(F.lit(1)).alias("n_rows"))
    best = sizes.groupBy(group).agg(F.max(F.struct("n_rows", entity)).alias("m"))
    return best.select(group, F.col(f"m.{entity}").alias(entity), "m.n_rows")


def thinned(frame: DataFrame, step: int, entity: str = "bearing", order: str = "file_index") -> DataFrame:
    """Every step-th row of each trajectory, from the first."""
    return with_position(frame, entity, order).where((F.col("position") - 1) % step == 0).drop("position")


def picked(frame: DataFrame, entity: str = "bearing", order: str = "file_index") -> DataFrame:
    """First, middle and last row of each trajectory, with place."""
    rows = with_position(frame, entity, order).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(entity)))
    places = F.array_distinct(F.array(F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("start").alias("place")), F.struct((F.floor(F.col("n") / 2) + 1).cast("bigint").alias("at"), F.lit("middle").alias("place")), F.struct(F.col("n").alias("at"), F.lit("end").alias("place"))))
    return rows.withColumn("p", F.explode(F.filter(places, lambda p: p["at"] == F.col("position")))).withColumn("place", F.col("p.place")).drop("p", "n", "position")


def centred_median(frame: DataFrame, value: str, widest: int = 101, entity: str = "bearing", order: str = "file_index") -> DataFrame:
    """Adds smooth, the median over a centred window of max(5, min(widest, n // 30)) rows; an even width reaches one row
    further back.  Neighbours come from one bounded frame inside a block with its halo, of which each entity takes its part."""
    half = widest // 2 + 1
    around = Window.partitionBy(entity, "_block").orderBy("position").rowsBetween(-half, half)
    rows = blocks.haloed(blocks.positioned(frame, entity, order).drop("_last"), half, half)
    rows = rows.withColumn("_w", F.greatest(F.lit(5), F.least(F.lit(widest), F.floor(F.col("_n") / 30).cast("int"))))
    rows = rows.withColumn("_near", F.collect_list(F.struct("position", F.col(value).alias("v"))).over(around)).where(~F.col("_halo"))
    low, high = F.col("position") - F.floor(F.col("_w") / 2), F.col("position") + F.floor((F.col("_w") - 1) / 2)
    kept = F.array_sort(F.transform(F.filter("_near", lambda x: (x["position"] >= low) & (x["position"] <= high) & x["v"].isNotNull()), lambda x: x["v"]))
    rows = rows.withColumn("_kept", kept)
    m = F.size("_kept")
    middle = (F.get("_kept", F.floor((m - 1) / 2).cast("int")) + F.get("_kept", F.floor(m / 2).cast("int"))) / 2
    return rows.withColumn("smooth", middle).drop("_n", "_w", "_near", "_kept", "position", "_block", "_halo")


def monotonicity(predictions: DataFrame, model: str = "model", entity: str = "held_out_bearing", age: str = "observed_age_seconds", value: str = "prediction_rul_seconds") -> DataFrame:
    """Per model and entity how often a prediction rises with age."""
    before = F.lag(value).over(Window.partitionBy(model, entity).orderBy(age))
    rows = predictions.withColumn("_before", before)
    up, n = F.sum(F.when(F.col(value) - F.col("_before") > 1e-9, 1).otherwise(0)), F.count("_before")
    return rows.groupBy(model, entity).agg(up.alias("monotonic_violations"), n.alias("monotonic_comparisons"), F.coalesce(F.try_divide(up.cast("double"), n), F.lit(0.0)).alias("monotonic_violation_rate"))
