"""Feature tables and the prediction log as tables, with their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import ContractError, request_faults
from . import versions


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, only the named columns; missing ones are an error before any data is read."""
    rows = spark.read.parquet(path)
    if columns is None:
        return rows
    if missing := sorted({*columns} - {*rows.columns}):
        raise ContractError(f"missing columns: {missing}")
    return rows.select(*columns)


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def stored_features(table: DataFrame, split: str | None = None, dataset_version: str | None = None) -> DataFrame:
    """A feature table by split and version, in order; the version filter holds only where the column exists."""
    rows = table.where(F.col("split") == split) if split else table
    if dataset_version and "dataset_version" in table.columns:
        rows = rows.where(F.col("dataset_version") == dataset_version)
    return rows.orderBy("bearing", "file_index")


def publish(df: DataFrame, name: str) -> None:
    """Replaces table name after checks: rows, and the unique key (split, bearing, file_index) without nulls; written aside, then swapped.
    df is worked out once: the checks are counts of the rows written aside.  The table before it is renamed and dropped last, so
    that a failure in between loses nothing; sources.versions has no moment without a table."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}_staging")
    counts = versions.write_checked(df, lambda rows: rows.write.mode("overwrite").saveAsTable(f"{name}_staging"))
    if faults := versions.faults_of(counts):
        spark.sql(f"DROP TABLE {name}_staging")
        raise ContractError("; ".join(faults))
    spark.sql(f"DROP TABLE IF EXISTS {name}_before")
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}_before")
    spark.sql(f"ALTER TABLE {name}_staging RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}_before")


def append_predictions(log: DataFrame, path: str, quarantine: str | None = None) -> None:
    """Appends rows that may be logged.  Other rows go to the quarantine folder with their fault; without one any such row is an error and nothing is written."""
    checked = request_faults(log)
    if quarantine:
        checked.where("fault IS NOT NULL").write.mode("append").parquet(quarantine)
        checked = checked.where("fault IS NULL")
    elif bad := checked.where("fault IS NOT NULL").select("request_id", "fault").limit(5).collect():
        raise ContractError(str(bad))
    checked.drop("fault").withColumn("requested_date", F.to_date("requested_at")).write.mode("append").partitionBy("requested_date").parquet(path)


def trailing(log: DataFrame, asof: Column, interval: str, columns: list[str]) -> DataFrame:
    """Columns of ok rows within the interval before asof."""
    return log.where((F.col("status") == "ok") & (F.col("requested_at") >= asof - F.expr(f"INTERVAL {interval}"))).select(*columns)
