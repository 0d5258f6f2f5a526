import duckdb
import numpy as np
import pyarrow as pa
import pytest

from wearline import catalog
from wearline.operators import contracts, datasets, prefix, sliding, trajectory
from wearline.plans import queries


def run(n, condition=1, bearing="Bearing1_1", change=None, rul=True, first=0):
    rows = []
    for i in range(n):
        x = float(i if change is None or i < change else i * 1000)
        row = {"split": "Training_set", "condition": condition, "bearing": bearing, "file_index": i + first}
        row |= {s: 1 + k + 0.01 * x for k, s in enumerate(catalog.SOURCES)}
        row |= {c: 0.1 * (i_ + 1) + 0.001 * x for ch in catalog.CHANNELS for i_, c in enumerate(catalog.band_columns(ch))}
        if rul:
            row["rul_seconds"] = float((n - 1 - i) * 10)
        rows.append(row)
    return rows


def frame(spark, *runs):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame([r for x in runs for r in x])).withColumn("condition", __import__("pyspark").sql.functions.col("condition").cast("int"))


def test_catalogues():
    assert len(catalog.signal_columns()) == 24 and len(catalog.temporal_columns()) == 54
    assert len(catalog.prefix_columns()) == 21 and len(catalog.health_columns()) == 27
    assert len(catalog.feature_schema()["default_model_feature_columns"]) == 78
    assert len(catalog.CUT_FRACTIONS) == 12


def test_rolling_columns_and_slopes(spark):
    df = trajectory.with_temporal(frame(spark, run(10)))
    rows = df.orderBy("file_index").collect()
    assert all(c in df.columns for c in catalog.temporal_columns())
    assert rows[0]["rms_horiz_roll_std_6"] == 0 and rows[0]["rms_horiz_roll_slope_6"] == 0
    assert rows[9]["rms_horiz_roll_slope_6"] == pytest.approx(0.001)
    assert rows[9]["rms_horiz_roll_mean_6"] == pytest.approx(np.mean([1 + 0.01 * i for i in range(4, 10)]))


def test_no_window_looks_ahead(spark):
    a, b = (trajectory.with_temporal(frame(spark, run(80, **k))).orderBy("file_index").drop("rul_seconds").collect() for k in ({}, {"change": 50}))
    for x, y in zip(a[:50], b[:50], strict=True):
        assert x == y


def test_no_prefix_looks_ahead(spark):
    cuts = (0.2, 0.4, 0.6, 0.9)
    a, b = (prefix.prefix_samples(frame(spark, run(200, **k)), cuts).orderBy("cut_file_index").drop("rul_seconds", "total_life_seconds").collect() for k in ({}, {"change": 121}))
    assert [x.cut_file_index for x in a] == [40, 80, 119, 179]
    values = lambda row: [v for v in row if isinstance(v, float)]
    for x, y in zip(a[:3], b[:3], strict=True):
        assert values(x) == pytest.approx(values(y), rel=1e-9)
    assert values(a[3]) != pytest.approx(values(b[3]), rel=1e-3)


def test_health_samples_do_not_look_ahead(spark):
    a = prefix.health_samples(frame(spark, run(180)), (0.4, 0.5, 0.6)).orderBy("cut_file_index").drop("rul_seconds").collect()
    b = prefix.health_samples(frame(spark, run(180, change=120)), (0.4, 0.5, 0.6)).orderBy("cut_file_index").drop("rul_seconds").collect()
    assert len(a) == 3
    for x, y in zip(a, b, strict=True):
        assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)], abs=1e-12)


def test_prefix_samples(spark):
    df = prefix.prefix_samples(frame(spark, run(100), run(80, 2, "Bearing2_1")), (0.5, 0.8))
    assert df.count() == 4 and not set(catalog.prefix_columns()) & set(catalog.NEVER_PREDICTORS)
    row = prefix.prefix_samples(frame(spark, run(101)), (0.5,)).first()
    assert (row.cut_file_index, row.observed_age_seconds, row.rul_seconds, row.total_life_seconds) == (50, 500.0, 500.0, 1000.0)
    contracts.verify_samples(df, catalog.prefix_columns(), (0.5, 0.8))


def test_prefix_values_match_a_loop(spark):
    rows = run(70)
    row = prefix.prefix_samples(frame(spark, rows), (0.5,), 60, 20).first()
    x = np.array([r["rms_horiz"] for r in rows])[: row.cut_file_index + 1]
    scale = max(abs(np.median(x[:60])), 1e-8)
    assert row["rms_horiz_current_over_early"] == pytest.approx(x[-1] / scale)
    assert row["rms_horiz_recent_mean_over_early"] == pytest.approx(x[-20:].mean() / scale)
    assert row["rms_horiz_recent_slope_per_hour"] == pytest.approx(0.01 * 360)


def test_fractions_that_meet_keep_the_first(spark):
    rows = prefix.prefix_samples(frame(spark, run(5)), (0.5, 0.55)).collect()
    assert [r.cut_fraction for r in rows] == [0.5]


def test_endpoints(spark):
    df = prefix.prefix_endpoints(frame(spark, run(70, rul=False, first=1), run(70, 3, "Bearing3_1", rul=False, first=1)))
    rows = df.collect()
    assert [r.cut_file_index for r in rows] == [70, 70]
    assert contracts.not_finite(df, catalog.prefix_columns()).where("n_bad > 0").isEmpty()
    with pytest.raises(ValueError):
        prefix.prefix_endpoints(frame(spark, run(70)))


@pytest.mark.parametrize("call", [
    lambda f: prefix.prefix_samples(f(3), (0.5,)), lambda f: prefix.health_samples(f(62), (0.5,)), lambda f: trajectory.with_context(f(5, 9)),
])
def test_short_runs_and_unknown_conditions_fail(spark, call):
    with pytest.raises(Exception, match="at least|unknown operating condition"):
        call(lambda n, c=1: frame(spark, run(n, c))).collect()


@pytest.mark.parametrize("fractions", [(), (0.5, 0.4), (0.0, 0.5), (0.5, 1.0)])
def test_bad_fractions(spark, fractions):
    with pytest.raises(ValueError):
        prefix.check_fractions(fractions)


def test_truncated_labels_and_alignment(spark):
    test, whole = frame(spark, run(2, rul=False, first=1)), frame(spark, run(4, rul=False, first=1))
    truth = datasets.ground_truth(test, whole)
    assert sorted(r.rul_seconds for r in truth.collect()) == [20.0, 30.0]
    end = datasets.endpoint_truth(truth)
    assert end.first().rul_seconds == 20.0
    features = end.select("condition", "bearing", "cut_file_index")
    assert datasets.align(features, end).count() == 1
    with pytest.raises(contracts.ContractError):
        datasets.align(features, end.where("false"))
    with pytest.raises(Exception, match="no complete run"):
        datasets.ground_truth(test, whole.withColumn("bearing", __import__("pyspark").sql.functions.lit("x"))).collect()


def test_monotonicity(spark):
    df = spark.createDataFrame([("m", "a", float(i), p) for i, p in enumerate((900.0, 800.0, 850.0, 700.0))] + [("m", "b", 0.0, 1.0)], "model string, held_out_bearing string, observed_age_seconds double, prediction_rul_seconds double")
    rows = {r.held_out_bearing: r for r in trajectory.monotonicity(df).collect()}
    assert (rows["a"].monotonic_violations, rows["a"].monotonic_comparisons) == (1, 3)
    assert rows["b"].monotonic_violation_rate == 0.0


def test_rounding_in_the_pass_of_windows_is_that_of_sql(spark):
    x = [5e-7, -5e-7, 1.0000015, 2.4999999, None, float("nan"), float("inf"), 1e305, -1e-9]
    got = sliding.rounded(pa.RecordBatch.from_arrays([pa.array(x), pa.array(range(len(x)))], names=["x", "n"]), 6)
    want = duckdb.sql(f"SELECT round(v, 6) + 0.0 FROM (SELECT unnest([{', '.join('NULL' if v is None else f'{v!r}::DOUBLE' if v == v and abs(v) < 1e306 else f'$${v}$$::DOUBLE' for v in x)}]) AS v)").fetchall()
    assert str(got["x"].to_pylist()) == str([w for (w,) in want]) and got["n"].to_pylist() == list(range(len(x)))
    plan = queries.QUERIES["training_dataset"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan  # eighty roundings by decimals took most of the time
