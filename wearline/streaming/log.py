"""The prediction log as a stream: dashboards, trailing windows, scoring, and drift per batch and per window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiments, windows
from ..operators.monitor import drift, drift_share, parsed_requests, scored


def log_stream(spark: SparkSession, path: str, schema, at: str = "requested_at", files_per_batch: int = 10) -> DataFrame:
    """Parquet files as they arrive; event time as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def dashboard(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes", at: str = "requested_at") -> DataFrame:
    """Requests, latency quantiles and error rate of closed tumbling windows."""
    rows = stream.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("requests"), F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("q"), (100 * F.avg((F.col("status") == "error").cast("double"))).alias("error_rate"))
    return rows.select(F.col("window.start").alias("bucket"), "requests", F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p95"), "error_rate")


def trailing(stream: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes", at: str = "requested_at", key: str = "request_id") -> DataFrame:
    """Ok requests of sliding windows, each request once."""
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return once.where("status = 'ok'").groupBy(F.window(at, size, slide)).agg(F.count(F.lit(1)).alias("requests"), F.avg("latency_ms").alias("mean_latency")).select(F.col("window.start").alias("start"), "requests", "mean_latency")


def scoring(stream: DataFrame, body: str, columns: list[str], at: str = "requested_at", late: str = "10 minutes", key: str = "request_id", **model) -> DataFrame:
    """Requests once each, validated and scored, as rows of the log."""
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return scored(parsed_requests(once, body, columns), **model)


def drift_per_batch(stream: DataFrame, reference: DataFrame, columns: list[str], out: str, checkpoint: str):
    """Appends the drifted share of each batch to out; a batch that is run again writes the same folder again."""

    def one(batch: DataFrame, number: int) -> None:
        share = drift_share(drift(reference, batch, columns)).withColumn("batch", F.lit(number))
        share.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def drift_by_window(stream: DataFrame, bins: DataFrame, columns: list[str], out: str, checkpoint: str, width: str = "1 day", late: str = "10 minutes", at: str = "requested_at"):
    """Appends the drift of each closed window to out.

    The state is a count per open window, feature and bin of the reference.  All bins of a window close in the same batch, so
    its statistic is that of all its rows, however they were dealt to batches; a batch that is run again writes the same folder."""

    def one(batch: DataFrame, number: int) -> None:
        windows.window_drift(batch, bins).write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts = windows.bin_counts(stream.withWatermark(at, late), bins, columns, width, at)
    return counts.writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def latency_sketches(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes", at: str = "requested_at") -> DataFrame:
    """Requests, errors and the latency sketch of closed windows, for windows.rolled_up(); the state is a sketch per open window."""
    return windows.sketched(stream.withWatermark(at, late), width, at)


def model_scoring(stream: DataFrame, model: str, body: str, fields: dict[str, str], out: str, rejected: str, checkpoint: str, at: str = "requested_at", late: str = "10 minutes", key: str = "request_id"):
    """Scores requests, each once, by the model saved in a folder: scored rows go to out, rejected ones with their error to
    rejected.  fields names the columns that the fields of a body become.

    Both sinks write a folder per batch, one after the other, and a batch that is run again - after a failure in between, or
    from an older checkpoint - replaces what it wrote, so neither has rows twice or lacks any."""
    fitted = experiments.load(stream.sparkSession, model)

    def one(batch: DataFrame, number: int) -> None:
        # kept while it is scored: filters on the outcome would parse each body again, and each side would ask the state again
        parsed = parsed_requests(batch, body, list(fields)).withColumnsRenamed(fields).persist()
        made = experiments.score_requests(fitted, parsed).withColumn("batch", F.lit(number)).persist()
        try:
            for rows, folder in ((made.where("status = 'ok'"), out), (made.where("status <> 'ok'"), rejected)):
                rows.write.mode("overwrite").parquet(f"{folder}/number={number}")
        finally:
            made.unpersist()
            parsed.unpersist()

    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_to_end(df: DataFrame, out: str, checkpoint: str) -> None:
    """Appends all that is there to a Parquet table, then stops."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
