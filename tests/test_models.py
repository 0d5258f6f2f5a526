import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import contracts, evaluate, models


def test_metrics(spark):
    def one(*pairs):
        return evaluate.metrics(spark.createDataFrame([(float(y), float(p)) for y, p in pairs], "actual double, predicted double"), []).first()

    perfect = one((100, 100), (50, 50))
    assert (perfect.rmse, perfect.mae, perfect.r2, perfect.phm12) == (0, 0, 1, 1)
    assert one((100, 110)).phm12 == pytest.approx(0.25)
    assert one((100, 90)).phm12 == pytest.approx(math.sqrt(0.5))
    assert one((100, 90), (0, 5)).phm12 == pytest.approx(math.sqrt(0.5))
    assert one((100, 90)).r2 is None and one((0, 5)).phm12 is None


def test_summaries(spark):
    folds = spark.createDataFrame([("a", "x", 3.0, 1.0, 0.5, 0.1), ("a", "y", 5.0, 1.0, 0.5, 0.1), ("b", "x", 1.0, 1.0, 0.5, 0.1), ("b", "y", 2.0, 1.0, 0.5, 0.1)], "model string, held_out_bearing string, rmse double, mae double, r2 double, phm12 double")
    rows = evaluate.prefix_summary(folds).collect()
    assert rows[0].model == "b" and rows[1].worst_rmse == 5.0 and rows[1].median_rmse == 4.0 and rows[0].n_folds == 2
    assert evaluate.rmse_by_entity(folds, ["a", "b"]).where("held_out_bearing = 'x'").first().a == 3.0
    board = evaluate.scoreboard(evaluate.cv_summary(folds).withColumn("status", F.when(F.col("model") == "a", "skipped").otherwise("ok")))
    assert [r.model for r in board.collect()] == ["b"]


def linear(spark, n=12):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(f"B{i % 3 + 1}", 1, i, float(x), float(z), 2 * float(x) + 5 + float(z) / 10, float(i * 10)) for i, (x, z) in enumerate(rng.uniform(1, 9, (n, 2)))], "bearing string, condition int, file_index int, x double, z double, rul_seconds double, observed_age_seconds double")


def ridge_by_hand(train, test, alpha):
    X, y, T = train[:, :2], train[:, 2], test[:, :2]
    m, s = X.mean(0), X.std(0)
    Z = (X - m) / s
    w = np.linalg.solve(Z.T @ Z + alpha * np.eye(2), Z.T @ (y - y.mean()))
    return np.maximum(0, (T - m) / s @ w + y.mean())


def test_ridge_is_the_closed_form(spark):
    df = linear(spark)
    out = models.leave_one_out("ridge", df, ["x", "z"], alpha=3.0).orderBy("file_index").collect()
    data = np.array([[r.x, r.z, r.rul_seconds] for r in df.orderBy("file_index").collect()])
    for r in out:
        mask = np.arange(len(data)) % 3 == int(r.bearing[1]) - 1
        assert r.predicted == pytest.approx(ridge_by_hand(data[~mask], data[[r.file_index]], 3.0)[0], rel=1e-6)
    assert len(out) == 12


@pytest.mark.parametrize("name", ["median", "condition_life_prior"])
def test_closed_forms_leave_the_entity_out(spark, name):
    df = linear(spark)
    rows = df.collect()
    for r in models.leave_one_out(name, df, []).collect():
        rest = [x for x in rows if x.bearing != r.bearing]
        expected = np.median([x.rul_seconds for x in rest]) if name == "median" else max(0, np.median([x.rul_seconds + x.observed_age_seconds for x in rest]) - r.observed_age_seconds)
        assert r.predicted == pytest.approx(expected)


def test_life_prior_falls_back_to_all(spark):
    train = spark.createDataFrame([(1, 400.0, 600.0), (1, 600.0, 400.0), (2, 400.0, 1600.0)], "condition int, observed_age_seconds double, rul_seconds double")
    test = spark.createDataFrame([(1, 400.0), (2, 400.0), (3, 400.0)], "condition int, observed_age_seconds double")
    rows = {r.condition: r.predicted for r in models.life_prior_predict(test, models.life_prior_fit(train)).collect()}
    assert rows == {1: 600.0, 2: 1600.0, 3: 600.0}


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    X, y, Q = rng.normal(size=(40, 2)), rng.uniform(0, 100, 40), rng.normal(size=(7, 2))
    Q[0] = X[5]
    train = spark.createDataFrame([(i, *map(float, x), float(v)) for i, (x, v) in enumerate(zip(X, y, strict=True))], "id int, a double, b double, y double").repartition(5)
    test = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(Q)], "id int, a double, b double")
    got = {r.id: r.predicted for r in models.knn_predict(train, test, ["a", "b"], "y", ["id"]).collect()}
    m, s = X.mean(0), X.std(0)
    for i, q in enumerate(Q):
        d = np.sqrt((((X - m) / s - (q - m) / s) ** 2).sum(1))
        near = np.argsort(d)[:3]
        expected = y[5] if i == 0 else (y[near] / d[near]).sum() / (1 / d[near]).sum()
        assert got[i] == pytest.approx(expected)


@pytest.mark.parametrize("name,params", [("random_forest", {"numTrees": 5, "maxDepth": 4}), ("gradient_boosting", {"maxIter": 3})])
def test_trees_repeat_and_learn(spark, name, params):
    df = linear(spark, 60)
    run = lambda: sorted((r.file_index, r.predicted) for r in models.leave_one_out(name, df, ["x", "z"], **params).collect())
    first = run()
    assert first == run() and all(p >= 0 for _, p in first)
    rmse = lambda n, **k: evaluate.metrics(models.leave_one_out(n, df, ["x", "z"], **k), [], "rul_seconds").first().rmse
    assert rmse(name, **params) < rmse("median")


def test_grouped_folds_and_total_life(spark):
    df = linear(spark, 30)
    rows = models.leave_one_out("ridge", df, ["x", "z"], total_life=True)
    assert rows.count() == 30
    assert models.grouped(df, 2).groupBy("bearing").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    with pytest.raises(contracts.ContractError):
        models.leave_one_out("median", df.where("bearing = 'B1'"), [])


def test_importances(spark):
    df = linear(spark, 40)
    for name, params in (("ridge", {}), ("random_forest", {"numTrees": 5})):
        fit = models.make_model(name, df, ["x", "z"], "rul_seconds", **params).fit(df)
        assert models.importances(fit, ["x", "z"], df).first().feature == "x"
    with pytest.raises(KeyError):
        models.effective_params("unknown")
    assert models.effective_params("ridge", {"alpha": 1.0}) == {"alpha": 1.0}


def test_training_contract(spark):
    df = linear(spark)
    schema = {"default_model_feature_columns": ["x"], "blocked_predictor_columns": ["bearing"], "target_column": "rul_seconds"}
    assert contracts.training_contract(df, schema) == {"predictor": ["x"], "target": ["rul_seconds"], "group": ["bearing"]}
    spoilt = df.withColumn("x", F.when(F.col("x") > 2, F.lit(float("nan"))).otherwise(F.col("x"))).withColumn("bearing", F.lit(None).cast("string"))
    found = {(r["check"], r["column"]): r["n_bad"] for r in contracts.training_faults(spoilt, schema | {"blocked_predictor_columns": ["x"]}).collect()}
    assert found == {("leak", "x"): 1, ("value", "x"): spoilt.where("isnan(x)").count(), ("null group", "bearing"): spoilt.count(), ("one group", "bearing"): 1}
    for bad, rows in (({"default_model_feature_columns": ["rul_seconds"]}, df), ({"default_model_feature_columns": ["gone"]}, df), ({"default_model_feature_columns": []}, df), ({}, df.withColumn("x", F.lit(float("inf")))), ({}, df.where("bearing = 'B1'"))):
        with pytest.raises(contracts.ContractError):
            contracts.training_contract(rows, schema | bad)


def test_split_preparation(spark):
    df = spark.createDataFrame([("train", "a", 1, 1, 1.0, 5.0), ("train", "a", 2, 1, None, 5.0), ("test", "b", 1, 2, float("inf"), 5.0)], "split string, bearing string, file_index int, condition int, rms_horiz double, rul_seconds double")
    assert contracts.numeric_predictors(df) == ["condition", "rms_horiz"]
    assert contracts.complete_rows(df, ["condition", "rms_horiz"]).count() == 1
    with pytest.raises(contracts.ContractError):
        contracts.select_split(df, "none")
    assert contracts.column_faults(df.columns, ["split", "gone"], ["rul_seconds"], ["file_index"]) == ["missing gone", "forbidden rul_seconds", "leaks file_index"]
    assert contracts.metric_input_faults(df, "rul_seconds", "rms_horiz").first().n_bad == 2


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_whole_queries_take_every_snapshot(spark):
    from wearline.plans import adapters, queries

    rows = adapters.labelled(spark, SMALL).select("condition", "bearing", "file_index", "rul_seconds", *queries.KNN_X).toPandas()
    got = {(r.bearing, r.file_index): r.predicted for r in queries.life_prior_lobo_whole(spark, SMALL).collect()}
    life = rows.file_index * 10.0 + rows.rul_seconds
    want = {}
    for r in rows.itertuples():
        other = rows.bearing != r.bearing
        own = other & (rows.condition == r.condition)
        want[r.bearing, r.file_index] = max(0.0, np.median(life[own if own.any() else other]) - r.file_index * 10.0)
    assert got == pytest.approx(want, abs=1e-6)
    side = rows.bearing.str[1:].astype(int) % 2
    train, test = rows[side == 1], rows[side == 0]
    x, y = train[queries.KNN_X].to_numpy(float), train.rul_seconds.to_numpy(float)
    near = {}
    for r, v in zip(test.itertuples(), test[queries.KNN_X].to_numpy(float), strict=True):
        d = (((v - x) / x.std(0)) ** 2).sum(1)
        at = np.lexsort((y, np.round(d, 12)))[:3]  # distances that agree to 12 digits are ties
        near[r.bearing, r.file_index] = y[at][d[at] == 0].mean() if d[at[0]] == 0 else np.average(y[at], weights=d[at] ** -0.5)
    got = {(r.bearing, r.file_index): r.predicted for r in queries.knn_regression_whole(spark, SMALL).collect()}
    assert got == pytest.approx(near, abs=1e-6)


def test_presets_are_those_of_the_reference():
    trees = {k: v.get("numTrees", v.get("maxIter")) for k, v in models.DEFAULTS.items() if "maxDepth" in v}
    assert trees == {"random_forest": 500, "hist_gradient_boosting": 300, "gradient_boosting": 200, "xgboost": 500, "lightgbm": 500}
