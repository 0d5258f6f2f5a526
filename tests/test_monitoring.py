import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline import catalog
from wearline.operators import contracts, eda, monitor
from wearline.sources import tables

COLS = catalog.prefix_columns()


def normal(spark, n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(shift, 1, (n, len(COLS)))], ", ".join(f"{c} double" for c in COLS))


def test_drift_of_shifted_and_equal_samples(spark):
    ref = normal(spark, 200, 0)
    assert monitor.drift_share(monitor.drift(ref, normal(spark, 50, 1, 5.0), COLS)).first().share > 0.5
    assert monitor.drift_share(monitor.drift(ref, normal(spark, 50, 0), COLS)).first().share < 0.2


def test_statistic_matches_a_direct_one(spark):
    a, b = np.random.default_rng(1).normal(size=30), np.random.default_rng(2).normal(0.5, 1, 20)
    df = lambda x: spark.createDataFrame([(float(v),) for v in x], "x double")
    row = monitor.drift(df(a), df(b), ["x"]).first()
    at = np.r_[a, b]
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in at)
    assert row.statistic == pytest.approx(d) and 0 <= row.p_value <= 1


def test_an_empty_window_passes_the_gate(spark):
    ref = normal(spark, 20, 0)
    row = monitor.drift_gate(monitor.drift(ref, ref.where("false"), COLS)).first()
    assert (row.share, row.failed) == (0.0, False)


def test_ranges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    ranges = monitor.reference_ranges(df, ["x"])
    row = ranges.first()
    assert (row.p01, row.p99) == (1.0, 99.0)
    assert monitor.out_of_range(df, ranges, ["x"]).first().share_outside == pytest.approx(2 / 101)


def test_perturbations(spark):
    df = spark.createDataFrame([tuple(float(i) for i in range(len(COLS)))], ", ".join(f"{c} double" for c in COLS))
    ranges = {c: (0.5, 2.5) for c in COLS}
    row = monitor.amplitude_drift(df, ranges).first()
    changed = [c for c in COLS if row[c] == 10.0 and c.endswith(monitor.RATIO_ENDINGS)]
    assert len(changed) == 12
    before, after = df.first(), monitor.channel_drift(df).first()
    pairs = [c for c in COLS if "_horiz" in c]
    assert len(pairs) == 9 and all(after[c] == before[c.replace("_horiz", "_vert")] and after[c.replace("_horiz", "_vert")] == before[c] for c in pairs)
    row = monitor.missing_sentinel(df, COLS[:2]).first()
    assert [c for c in COLS if row[c] == -999.0] == COLS[:2]
    assert monitor.extreme_values(df, ranges, [COLS[0]]).first()[COLS[0]] == 25.0


def test_requests(spark):
    import json

    good = json.dumps(dict.fromkeys(COLS, 1.0))
    df = spark.createDataFrame([(i, b) for i, b in enumerate([good, *monitor.invalid_requests(), "not json", None])], "id int, body string")
    rows = monitor.parsed_requests(df, "body").orderBy("id").collect()
    assert [r.outcome for r in rows] == ["ok"] + ["rejected"] * 5
    assert rows[1].reason.startswith("missing") and rows[2].reason.startswith("extra") and rows[3].reason.startswith("not a number")
    done = monitor.scored(monitor.parsed_requests(df, "body")).orderBy("id").collect()
    assert done[0].status == "ok" and done[0].predicted_rul_seconds == 19_999.0 and done[1].status == "error"


def log_rows(spark, status="ok", features=1.0):
    return spark.createDataFrame([("r1", "2024-01-01 10:00:00", status, 5.0, *[features] * len(COLS))], "request_id string, requested_at string, status string, latency_ms double, " + ", ".join(f"{c} double" for c in COLS)).withColumn("requested_at", F.col("requested_at").cast("timestamp"))


def test_log_append_and_trailing_window(spark, tmp_path):
    path = f"{tmp_path}/log"
    tables.append_predictions(log_rows(spark), path)
    tables.append_predictions(log_rows(spark, "error", None), path)
    for bad in (log_rows(spark, "other"), log_rows(spark, "ok", None)):
        with pytest.raises(contracts.ContractError):
            tables.append_predictions(bad, path)
    log = spark.read.parquet(path)
    assert log.count() == 2
    asof = F.lit("2024-01-01 11:00:00").cast("timestamp")
    assert tables.trailing(log, asof, "'2' HOUR", COLS).count() == 1
    assert tables.trailing(log, asof, "'10' MINUTE", COLS).count() == 0


def test_exploration(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 2.0, 4.0), ("b", 1, None, float("inf")), ("b", 1, None, float("inf"))], "k string, i int, x double, y double")
    row = eda.quality_counts(df, ["x", "y"], ["k", "i"], "x").first()
    assert (row.missing_cells, row.rows_with_missing, row.infinite_cells, row.repeated_rows, row.repeated_keys) == (2, 2, 2, 1, 1)
    assert eda.correlations(df.where("x IS NOT NULL"), ["x", "y"]).first().r == pytest.approx(1.0)
    assert eda.correlations(df.withColumn("x", F.lit(1.0)).where("k = 'a'"), ["x", "y"]).first().r is None
    assert {(r.k, r.n) for r in eda.value_counts(df, "k").collect()} == {("a", 2), ("b", 2)}
    assert eda.sampled(df, 2, ["k", "i"]).count() == 2
    assert sum(r.n for r in eda.histogram(df, "x", 4).collect()) == 2
    assert eda.capped(df.where("x IS NOT NULL"), "x", 0.5).agg(F.max("x")).first()[0] == 1.5
    profile = {r.feature: (r.non_null, r.n_distinct, r.kind) for r in eda.profile(df, ["k", "x"]).collect()}
    assert profile == {"k": (4, 2, "string"), "x": (2, 3, "double")}
