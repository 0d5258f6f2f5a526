"""Ridges from sums of products, and the contract of experiments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline import catalog
from wearline.operators import contracts, experiments, models, moments


def rows_of(spark, n=90, groups=7, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 100, 1e-3] + [5, 1e5, 0]
    y = 3 * x[:, 0] + x[:, 1] / 50 - 1900 + rng.normal(size=n)
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(0, groups, n))  # a hot machine
    data = [(f"B{b}", int(b % 3 + 1), i, *map(float, v), 7.0, float(t), float(10 * i)) for i, (b, v, t) in enumerate(zip(g, x, y, strict=True))]
    return spark.createDataFrame(data, "bearing string, condition int, file_index int, a double, b double, c double, still double, rul_seconds double, observed_age_seconds double").repartition(5)


def by_hand(df, features, alpha, life=False):
    data = df.toPandas().sort_values("file_index")
    out = {}
    for g in data.bearing.unique():
        train, test = data[data.bearing != g], data[data.bearing == g]
        X, y = train[features].to_numpy(), (train.rul_seconds + life * train.observed_age_seconds).to_numpy()
        m, s = X.mean(0), X.std(0)
        s = np.where(s > 0, s, 1)
        Z = (X - m) / s
        w = np.linalg.solve(Z.T @ Z + alpha * np.eye(len(features)), Z.T @ (y - y.mean()))
        p = np.maximum(0, (test[features].to_numpy() - m) / s @ w + y.mean())
        out |= dict(zip(test.file_index, np.maximum(0, p - test.observed_age_seconds) if life else p, strict=True))
    return out


@pytest.mark.parametrize("held", [moments.HELD_BYTES, 1])
def test_all_models_at_once_are_fits_of_each_fold(spark, monkeypatch, held):
    monkeypatch.setattr(moments, "HELD_BYTES", held)  # 1: sums are passed on after each machine of a batch
    df = rows_of(spark)
    asked = [moments.Ridge("all", ("a", "b", "c", "still"), 3.0), moments.Ridge("two", ("c", "a"), 0.5), moments.Ridge("life", ("b",), 10.0, True)]
    got = moments.leave_one_out(df, asked).collect()
    assert len(got) == 3 * df.count()
    for m in asked:
        want = by_hand(df, list(m.features), m.alpha, m.total_life)
        assert {r.file_index: r.predicted for r in got if r.model == m.label} == pytest.approx(want, rel=1e-8, abs=1e-7)


def test_sums_of_products_agree_with_the_library(spark):
    df = rows_of(spark)
    one = {r.file_index: r.predicted for r in models.leave_one_out("ridge", df, ["a", "b"], alpha=2.0).collect()}
    for g in ("B0", "B3"):
        rest, mine = df.where(F.col("bearing") != g), df.where(F.col("bearing") == g)
        for r in models.predict(models.make_model("ridge", rest, ["a", "b"], "rul_seconds", alpha=2.0).fit(rest), mine).collect():
            assert one[r.file_index] == pytest.approx(r.predicted, rel=1e-6, abs=1e-6)


def test_no_penalty_and_constant_columns(spark):
    df = rows_of(spark)
    got = {r.file_index: r.predicted for r in moments.leave_one_out(df, [moments.Ridge("x", ("a", "still"), 0.0)]).collect()}
    assert got == pytest.approx(by_hand(df, ["a"], 0.0), rel=1e-7, abs=1e-6)


def test_rows_that_cannot_be_used_fail(spark):
    df, asked = rows_of(spark), [moments.Ridge("x", ("a",))]
    for bad in (df.where("bearing = 'B0'"), df.where("false"), df.withColumn("a", F.when(F.col("file_index") != 3, F.col("a"))), df.withColumn("a", F.lit(float("inf"))), df.withColumn("bearing", F.when(F.col("file_index") != 3, F.col("bearing")))):
        with pytest.raises(contracts.ContractError):
            moments.leave_one_out(bad, asked)
    with pytest.raises(contracts.ContractError):
        moments.leave_one_out(df, asked * 2)
    twice = df.unionByName(df)
    assert moments.leave_one_out(twice, asked).count() == 2 * df.count()


def test_no_machine_is_fitted_by_itself(spark):
    plan = moments.leave_one_out(rows_of(spark), [moments.Ridge(f"k{k}", ("a", "b"), 1.0 + k) for k in range(30)])._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") <= 4 * 2 and "Cartesian" not in plan  # one for all models, per stage of the plan's text


@pytest.mark.parametrize("column", catalog.NEVER_PREDICTORS)
def test_every_leak_is_refused(spark, column):
    df = rows_of(spark).withColumns({"split": F.lit("Training_set"), "elapsed_time_seconds": F.col("observed_age_seconds") - 10, "cut_fraction": F.lit(0.5), "total_life_seconds": F.col("rul_seconds") + F.col("observed_age_seconds")})
    for features in ([column], ["a", column]):
        for name in ("ridge", "median", "random_forest"):
            with pytest.raises(contracts.ContractError, match=f"never predictors: {column}"):
                experiments.run_experiment(name, df, features)
        row = experiments.suite(df, features, [{"model": "ridge"}]).first()
        assert (row.status, row.reason) == ("error", f"ContractError: never predictors: {column}")
    with pytest.raises(contracts.ContractError):
        experiments.sweep("ridge", df, [column], 2)


def test_suites_take_a_label_once(spark):
    rows = experiments.suite(rows_of(spark), ["a"], [{"model": "ridge"}, {"model": "ridge", "params": {"alpha": 1.0}}]).collect()
    assert sorted((r.model, r.status) for r in rows) == [("ridge", "error"), ("ridge", "ok")]


def test_the_grid_of_samples_is_checked(spark):
    rows = [(b % 2 + 1, f"B{b}", f, int(100 * f), 1000 * f, float(b + f), 100 - 100 * f) for b in range(3) for f in (0.4, 0.6, 0.8)]
    df = spark.createDataFrame(rows, "condition int, bearing string, cut_fraction double, cut_file_index int, observed_age_seconds double, x double, rul_seconds double")
    grid = {"fractions": (0.4, 0.6, 0.8), "entities": 3, "rows": 9}
    assert experiments.run_experiment("ridge", df, ["x"], grid=grid).folds.count() == 3
    for bad, rows in ((grid | {"entities": 4}, df), (grid | {"rows": 8}, df), (grid | {"fractions": (0.4, 0.6)}, df), (grid, df.where("cut_file_index != 60 OR bearing != 'B1'")), (grid, df.drop("cut_fraction")), (grid, df.unionByName(df))):
        with pytest.raises(contracts.ContractError):
            experiments.run_experiment("ridge", rows, ["x"], grid=bad)
