"""Trajectories over several tasks, and windows with the same work a row."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import blocks, datasets, sliding, trajectory


def direct(y, begins, n, step):
    out = []
    for i in range(len(y)):
        low = max(begins[begins <= i].max(), i - n + 1)
        x, v = np.arange(low, i + 1) * step, y[low : i + 1]
        there = ~np.isnan(v)
        x, v = x[there], v[there]
        d = x - x.mean() if len(x) else x
        out.append((v.mean() if len(v) else np.nan, v.std() if len(v) else 0.0, (d @ v) / (d @ d) if len(v) > 1 else 0.0))
    return np.array(out).T


@pytest.mark.parametrize("n", [1, 2, 6, 30])
def test_two_stacks_are_windows(n):
    rng = np.random.default_rng(n)
    begins = np.array([0, 1, 8, 8 + n, 120])
    y = rng.normal(size=(200, 3)) * [1, 1e-3, 50] + [0, 1e6, -3]
    y[rng.random(y.shape) < 0.1] = np.nan
    got = sliding.statistics(y, begins, n, 10.0)
    for j in range(3):
        for a, b in zip(got, direct(y[:, j], begins, n, 10.0), strict=True):
            assert a[:, j] == pytest.approx(b, rel=1e-7, abs=1e-9, nan_ok=True)


def test_a_spike_leaves_no_trace():
    y = 1 + np.random.default_rng(0).normal(size=(400, 1)) * 1e-6
    y[100] = 1e9
    _, deviation, _ = sliding.statistics(y, np.array([0]), 60, 1.0)
    far = np.arange(170, 400)
    assert deviation[far, 0] == pytest.approx([y[i - 59 : i + 1, 0].std() for i in far], rel=1e-6)
    assert deviation[160:, 0].max() < 1e-5 < deviation[159, 0]


def runs(spark, sizes, gaps=False, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for e, n in sizes.items():
        at = np.sort(rng.choice(3 * n + 5, n, replace=False)) + 1 if gaps else np.arange(n) + 1
        rows += [(e, int(i), float(v), "x") for i, v in zip(at, rng.normal(size=n), strict=True)]
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "bearing string, file_index int, v double, extra string").repartition(7)


@pytest.mark.parametrize("gaps", [False, True])
def test_positions_are_row_numbers(spark, monkeypatch, gaps):
    monkeypatch.setattr(blocks, "CELL", 50)
    df = runs(spark, {"a": 700, "b": 1, "c": 60}, gaps)
    got = blocks.positioned(df).toPandas()
    assert len(got) == 761
    for e, mine in got.groupby("bearing"):
        mine = mine.sort_values("file_index")
        assert mine.position.tolist() == list(range(1, len(mine) + 1)) and set(mine._n) == {len(mine)} and set(mine._last) == {mine.file_index.max()}, e


@pytest.mark.parametrize("batch", ["10000", "17"])
def test_rolling_columns_do_not_depend_on_cuts(spark, monkeypatch, batch):
    df = runs(spark, {"a": 900, "b": 3, "c": 61}, True).withColumn("v", F.when(F.col("file_index") % 13 != 0, F.col("v")))
    monkeypatch.setattr(blocks, "CELL", 100)
    monkeypatch.setattr(blocks, "BLOCK", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = trajectory.with_temporal(df, ["v"], (4, 30)).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 964 and set(got.extra) == {"x"}
    for _, mine in got.groupby("bearing"):
        mine = mine.sort_values("file_index")
        for n in (4, 30):
            want = direct(mine.v.to_numpy(), np.array([0]), n, 10.0)
            for k, w in zip(("mean", "std", "slope"), want, strict=True):
                assert mine[f"v_roll_{k}_{n}"].to_numpy(float) == pytest.approx(w, rel=1e-9, abs=1e-12, nan_ok=True)


def test_a_long_machine_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELL", 5000)
    n = 60_000
    df = spark.range(1, n + 1, 1, 6).select(F.lit("long").alias("bearing"), F.col("id").cast("int").alias("file_index"), F.sin("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = trajectory.with_temporal(df, ["v"], (60,)).withColumn("task", F.spark_partition_id())
        tasks = out.groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == n
    row = out.where(f"file_index = {n - 7}").first()
    y = np.sin(np.arange(n - 66, n - 6))
    assert (row.v_roll_mean_60, row.v_roll_std_60) == pytest.approx((y.mean(), y.std()))


def test_no_window_by_entity_alone(spark):
    from wearline import catalog

    df = spark.createDataFrame([("s", 1, "a", i, *[1.0 * i] * 24) for i in range(1, 4)], "split string, condition int, bearing string, file_index int, " + ", ".join(f"{c} double" for c in catalog.signal_columns()))
    for made in (datasets.training_dataset(df), trajectory.centred_median(df, "rms_horiz")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
            assert "_cell" in spec or "_block" in spec, spec
    assert [r.rul_seconds for r in datasets.training_dataset(df).orderBy("file_index").collect()] == [20.0, 10.0, 0.0]


def test_null_machines_and_empty_tables(spark):
    df = runs(spark, {"a": 5}).withColumn("bearing", F.lit(None).cast("string"))
    assert trajectory.with_temporal(df, ["v"], (2,)).count() == 5 and trajectory.centred_median(df, "v").count() == 5
    assert trajectory.with_rul(df).where("rul_seconds = 0").count() == 1
    assert trajectory.with_temporal(df.where("false"), ["v"], (2,)).count() == 0


def test_repeated_places_are_found_across_batches(spark):
    rows = spark.createDataFrame([("a", i // 2 if i > 30 else i, 1.0 * i) for i in range(40)], "bearing string, file_index int, v double")
    with pytest.raises(Exception, match="repeated file_index"):
        trajectory.with_temporal(rows, ["v"], (2,)).collect()
    with pytest.raises(ValueError, match="window reaches"):
        blocks.haloed(blocks.positioned(rows), blocks.BLOCK + 1)
