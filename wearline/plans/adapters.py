"""Tables of the test data seen as trajectories, waveforms, samples and prediction logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def value_columns() -> dict[str, str]:
    """The 24 snapshot columns as SQL over an event's value and id."""
    v, e = "value", "event_id"
    out = {
        "rms_horiz": f"{v} / 97", "rms_vert": f"{v} / 83 + 0.1", "kurtosis_horiz": f"({v} - 100) / 53.1", "kurtosis_vert": f"abs({v} - 100) / 53.1",
        "skewness_horiz": f"{v} / 199 - 0.5", "skewness_vert": f"0.5 - {v} / 251", "crest_factor_horiz": f"3 + ({e} % 11) / 10.0E0", "crest_factor_vert": f"3 + ({e} % 13) / 10.0E0",
    }
    out |= {f"fft_band_{i}_horiz": f"{v} * {i + 1} / 101 + {e} % {i + 3}" for i in range(catalog.N_BANDS)}
    out |= {f"fft_band_{i}_vert": f"{v} * {i + 1} / 127 + {e} % {i + 4}" for i in range(catalog.N_BANDS)}
    return {c: out[c] for c in catalog.signal_columns()}


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run to failure per user of events, one snapshot per event in order of time; already dealt by bearing."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    rows = events.withColumn("bearing", F.concat(F.lit("B"), F.col("user_id").cast("string"))).withColumn("condition", (F.col("user_id") % 3 + 1).cast("int"))
    order = Window.partitionBy("bearing").orderBy("ts", "event_id")
    rows = rows.withColumn("file_index", F.row_number().over(order)).withColumn("split", F.lit("Training_set"))
    return rows.select("split", "condition", "bearing", "file_index", *(F.expr(x).cast("double").alias(c) for c, x in value_columns().items()))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max("file_index").over(Window.partitionBy("bearing"))
    rows = trajectories(spark, sf_dir).withColumn("rul_seconds", ((last - F.col("file_index")) * catalog.INTERVAL_SECONDS).cast("double"))
    return rows.withColumn("elapsed_time_seconds", ((F.col("file_index") - 1) * catalog.INTERVAL_SECONDS).cast("long"))


def truncated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first 60 percent of every run as a test split, and the complete runs."""
    whole = trajectories(spark, sf_dir)
    n = F.count(F.lit(1)).over(Window.partitionBy("bearing"))
    test = whole.withColumn("_n", n).where(F.col("file_index") <= F.floor(0.6 * F.col("_n"))).drop("_n")
    return test.withColumn("split", F.lit("Test_set")), whole.withColumn("split", F.lit("Validation_Set"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3 + 1).cast("int").alias("condition"), F.col("embedding").cast("array<double>").alias("wave"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_discount").cast("double").alias("l_discount"))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: error events failed, the value is the latency."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").cast("string").alias("request_id"), F.col("ts").alias("requested_at"), F.lit("rul").alias("model_name"), F.get_json_object("props", "$.k").alias("model_version"), F.lit("champion").alias("model_alias"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").cast("double").alias("latency_ms"), "user_id", "props",
    )


# The same in SQL.

def sql_trajectories() -> str:
    cols = ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for c, x in value_columns().items())
    return f"""e AS (SELECT event_id, ts, user_id, COALESCE(CAST(value AS DOUBLE), 0) AS value FROM events),
    traj0 AS (SELECT 'Training_set' AS split, CAST(user_id % 3 + 1 AS INTEGER) AS condition, 'B' || user_id AS bearing, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS file_index, {cols} FROM e),
    traj AS (SELECT *, CAST((max(file_index) OVER (PARTITION BY bearing) - file_index) * 10 AS DOUBLE) AS rul_seconds, CAST((file_index - 1) * 10 AS BIGINT) AS elapsed_time_seconds, count(*) OVER (PARTITION BY bearing) AS n FROM traj0)"""


SQL_CONTEXT = "CASE condition WHEN 1 THEN 1800.0 WHEN 2 THEN 1650.0 WHEN 3 THEN 1500.0 END AS rotation_speed_rpm, CASE condition WHEN 1 THEN 4000.0 WHEN 2 THEN 4200.0 WHEN 3 THEN 5000.0 END AS radial_load_n"
SQL_LOG = "log AS (SELECT CAST(event_id AS VARCHAR) AS request_id, ts AS requested_at, json_extract_string(props, '$.k') AS model_version, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CAST(value AS DOUBLE) AS latency_ms, user_id, props FROM events)"
