"""Time windows from states that merge, and stream scoring by a saved model."""

import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import datasets, experiments, windows
from wearline.streaming import log

SCHEMA = "request_id string, s long, status string, latency_ms double"


def requests(spark, n=600, seed=0, step=97):
    rng = np.random.default_rng(seed)
    value = np.round(rng.normal(50, 10, n) + np.arange(n) / 20, 1)
    rows = [(str(i), 1_700_000_000 + step * i, "error" if i % 9 == 0 else "ok", float(v) if i % 31 else None) for i, v in enumerate(value)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("requested_at", F.timestamp_seconds("s")).drop("s")


def split_files(df, folder, parts):
    """Files of rows in order of time."""
    rows = df.withColumn("part", F.floor(F.col("request_id").cast("int") / (df.count() / parts)).cast("int")).collect()
    spark = df.sparkSession
    for k in range(parts):
        spark.createDataFrame([r[:-1] for r in rows if r.part == k], df.schema).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    return f"{folder}/in/*"


def test_statistic_is_that_of_two_samples_at_the_cuts(spark):
    rng = np.random.default_rng(2)
    ref, cur = np.round(rng.normal(size=900), 1), np.round(rng.normal(0.3, 1.3, 400), 1)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").withColumn("requested_at", F.lit("2024-01-01 05:00:00").cast("timestamp"))
    bins = windows.reference_bins(frame(ref), ["v"])
    b, row = bins.first(), windows.drift_by_window(frame(cur), bins, ["v"]).first()
    assert b.n_reference == 900 and len(b.cuts) <= windows.BINS and b.cuts == sorted(b.cuts)
    assert b.shares == pytest.approx([(ref <= c).mean() for c in b.cuts])
    gaps = [abs((ref <= c).mean() - (cur <= c).mean()) for c in b.cuts]
    assert (row.n_current, row.statistic) == (400, pytest.approx(max(gaps)))
    whole = max(abs((ref <= c).mean() - (cur <= c).mean()) for c in np.unique(np.r_[ref, cur]))
    assert 0 <= whole - row.statistic <= 1 / windows.BINS


def test_few_values_are_cut_at_each(spark):
    df = spark.createDataFrame([(float(i % 5),) for i in range(50)], "v double")
    assert windows.reference_bins(df, ["v"]).first().cuts == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("per_batch", [1, 3, 100])
def test_drift_of_windows_does_not_depend_on_batches(spark, tmp_path, per_batch):
    df = requests(spark)
    path = split_files(df, tmp_path, 8)
    bins = windows.reference_bins(df.where("request_id % 2 = 0"), ["latency_ms"])
    log.drift_by_window(log.log_stream(spark, path, df.schema, files_per_batch=per_batch), bins, ["latency_ms"], f"{tmp_path}/out", f"{tmp_path}/state", "3 hours").start().awaitTermination()
    got = {r.start: (r.n_current, r.statistic) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.start: (r.n_current, r.statistic) for r in windows.drift_by_window(df, bins, ["latency_ms"], "3 hours").collect()}
    assert len(got) == 5 and got == {k: pytest.approx(want[k]) for k in got}


def test_minutes_merge_to_days_within_the_stated_error(spark):
    rng = np.random.default_rng(5)
    n = 40_000
    rows = [(str(i), 1_700_000_000 + int(t), "ok", float(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 86_400, n), rng.lognormal(3, 1, n), strict=True))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("requested_at", F.timestamp_seconds("s"))
    minutes = windows.sketched(df)
    days = windows.dashboard_of(windows.rolled_up(windows.rolled_up(minutes, "1 hour"), "1 day"))
    off = windows.quantile_error(df, days, "1 day").collect()
    assert len(off) == 2 and all(max(r.off_p50, r.off_p95) <= windows.RANK_ERROR for r in off)
    exact = {r.bucket: r for r in windows.exact_dashboard(df, "1 day").collect()}
    for r in days.collect():
        assert r.requests == exact[r.bucket].requests and r.p50 == pytest.approx(exact[r.bucket].p50, rel=0.05)
    size = windows.rolled_up(minutes, "1 day").select(F.max(F.length("sketch"))).first()[0]
    assert size < 20_000  # bytes of a state, whatever the number of rows


def test_buckets_without_latency(spark):
    df = requests(spark).withColumn("latency_ms", F.lit(None).cast("double"))
    row = windows.dashboard_of(windows.rolled_up(windows.sketched(df), "1 day")).first()
    assert row.p50 is None and row.requests > 0


def test_sketches_of_a_stream(spark, tmp_path):
    df = requests(spark)
    path = split_files(df, tmp_path, 4)
    log.run_to_end(log.latency_sketches(log.log_stream(spark, path, df.schema, files_per_batch=1)), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r.bucket: r.requests for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.bucket: r.requests for r in windows.sketched(df).collect()}
    assert len(got) > 500 and got == {k: want[k] for k in got}


def bodies(spark, n=60):
    rows = [(f"r{i % 50}", 1_700_000_000 + i, json.dumps({"k": i % 50} if i % 50 % 7 else {"q": 1})) for i in range(n)]  # the last ten come twice
    return spark.createDataFrame(rows, "request_id string, s long, body string").withColumn("requested_at", F.timestamp_seconds("s")).drop("s")


def test_a_saved_pipeline_scores_a_stream_into_two_tables(spark, tmp_path):
    train = spark.createDataFrame([(f"B{i % 4}", float(i), 500.0 - 3 * i) for i in range(40)], "bearing string, observed_age_seconds double, rul_seconds double")
    fitted = experiments.fit("ridge", train, ["observed_age_seconds"], alpha=0.1)
    fitted.save(f"{tmp_path}/model")
    df = bodies(spark)
    path = f"{tmp_path}/in/*"
    for k in range(3):
        df.where(f"int(substr(request_id, 2)) % 3 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    out, bad, state = (f"{tmp_path}/{x}" for x in ("out", "bad", "state"))
    run = lambda: log.model_scoring(log.log_stream(spark, path, df.schema, files_per_batch=1), f"{tmp_path}/model", "body", {"k": "observed_age_seconds"}, out, bad, state, late="1 day").start().awaitTermination()
    run()
    tables = lambda: tuple(sorted((r.request_id, r.status, r.predicted_rul_seconds) for r in spark.read.parquet(x).collect()) for x in (out, bad))
    first = tables()
    assert len(first[0]) == 42 and len(first[1]) == 8 and {s for _, s, _ in first[1]} == {"error"}
    want = {r.k: r.predicted for r in fitted.predict(spark.range(50).select(F.col("id").alias("k"), F.col("id").cast("double").alias("observed_age_seconds"))).collect()}
    assert {i: p for i, _, p in first[0]} == {f"r{k}": pytest.approx(want[k]) for k in range(50) if k % 7}
    # the last batch lost one table and its commit: it runs again, under the same number
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    for k in range(1, last + 1):
        for name in (str(k), f".{k}.crc"):
            (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    for k in range(2, last + 1):
        for name in (str(k), f".{k}.crc"):
            (tmp_path / "state" / "offsets" / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "bad" / "number=1")
    run()
    assert tables() == first


def test_run_table_counts_all_snapshots(spark):
    rng = np.random.default_rng(0)
    rows = [(b, f, p, float(v)) for b, n in (("A", 7), ("B", 1)) for f in range(1, n + 1) for p, v in enumerate(rng.normal(size=64))]
    df = spark.createDataFrame([*rows, ("A", 4, 64, None)], "bearing string, file_index int, position int, v double")
    got = {(r.bearing, r.file_index): r for r in datasets.run_table(df, {"h": "v"}, 3, 6400.0, [0.0, 1000.0, 3200.0]).collect()}
    assert set(got) == {("A", 1), ("A", 4), ("A", 7), ("B", 1)}
    assert (got["A", 4].elapsed_seconds, got["A", 4].rul_seconds, got["A", 4].rul_hours) == (30, 30, pytest.approx(30 / 3600))
    x = np.array([v for b, f, _, v in rows if (b, f) == ("A", 4)])
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    power[0] = 0
    f = np.fft.rfftfreq(64, 1 / 6400)
    assert got["A", 4].h_dominant_frequency == f[power.argmax()] and got["A", 4].h_std == pytest.approx(x.std(ddof=1))
    assert got["A", 4].h_ratio_0 == pytest.approx(power[f < 1000].sum() / power.sum())


def test_baselines_with_features(spark):
    rows = [(b % 2 + 1, f"B{b}", 100.0 * i, float(b + i), 100.0 * (9 - i) + 10.0 * b) for b in range(4) for i in range(8)]
    df = spark.createDataFrame(rows, "condition int, bearing string, observed_age_seconds double, x double, rul_seconds double")
    small = [p | {"params": p["params"] | {k: 3 for k in ("numTrees", "maxIter") if k in p["params"]}} for p in experiments.BASELINES]
    got = experiments.baselines(df, features=["x", "observed_age_seconds"], folds=2, presets=small).collect()
    assert {r.model for r in got} == {"median", "condition_life_prior", "ridge", "random_forest", "hist_gradient_boosting"} and all(r.status == "ok" for r in got)
