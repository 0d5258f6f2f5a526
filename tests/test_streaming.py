import pytest
from pyspark.sql import functions as F

from wearline.operators import monitor
from wearline.streaming import log


@pytest.fixture
def events(spark, tmp_path):
    rows = [(str(i % 190), 1_700_000_000 + 60 * i, "error" if i % 7 == 0 else "ok", float(i % 50), '{"k": %d}' % i if i % 5 else '{"q": 1}') for i in range(200)]
    df = spark.createDataFrame(rows, "request_id string, s long, status string, latency_ms double, body string").withColumn("requested_at", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    return df, f"{tmp_path}/in/*", tmp_path


def done(spark, df, folder, name):
    log.run_to_end(df, f"{folder}/{name}", f"{folder}/{name}-state")
    return spark.read.parquet(f"{folder}/{name}")


def test_closed_windows_equal_the_batch(spark, events):
    df, path, folder = events
    got = {r.bucket: r for r in done(spark, log.dashboard(log.log_stream(spark, path, df.schema), "30 minutes"), folder, "dash").collect()}
    want = {r.bucket: r for r in monitor.dashboard(df, "30 minutes").collect()}
    assert got and set(got) < set(want) | set(got)
    for k, r in got.items():
        assert (r.requests, r.p50, r.error_rate) == pytest.approx((want[k].requests, want[k].p50, want[k].error_rate))


def test_scoring_takes_each_request_once(spark, events):
    df, path, folder = events
    rows = done(spark, log.scoring(log.log_stream(spark, path, df.schema).drop("status"), "body", ["k"], late="1 day", age="k", life=100.0), folder, "scored")
    assert rows.count() == 190 and rows.where("status = 'error'").count() == 38


def test_trailing_windows(spark, events):
    df, path, folder = events
    rows = done(spark, log.trailing(log.log_stream(spark, path, df.schema), "1 hour", "30 minutes"), folder, "trail")
    assert rows.count() > 0 and rows.agg(F.max("requests")).first()[0] <= 60


def test_drift_per_batch(spark, events):
    df, path, folder = events
    log.drift_per_batch(log.log_stream(spark, path, df.schema), df, ["latency_ms"], f"{folder}/drift", f"{folder}/drift-state").start().awaitTermination()
    assert [r.share for r in spark.read.parquet(f"{folder}/drift").collect()] == [0.0]
