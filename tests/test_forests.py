"""Forests grown in tasks: against trees grown by hand, MLlib's importances, and themselves with rows and nodes dealt otherwise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import contracts, experiments, forests, models
from wearline.plans import queries

COLUMNS = ["a", "b", "c"]


def samples(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"B{i % 6}", i, float(a), float(b), float(c), float(round(40 * a + 10 * b * b + rng.normal(), 3))) for i, (a, b, c) in enumerate(zip(rng.uniform(0, 9, n), rng.integers(0, 5, n), rng.normal(size=n), strict=True))]
    return spark.createDataFrame(rows, "bearing string, file_index int, a double, b double, c double, rul_seconds double")


def by_hand(x, w, y, depth, most, least):
    """Predictions of a tree's own rows."""
    out = np.full(len(y), (w * y).sum() / w.sum())
    spread = lambda k: (w[k] * (y[k] - (w[k] * y[k]).sum() / w[k].sum()) ** 2).sum()
    splits = [(spread(x[:, f] <= v) + spread(x[:, f] > v), f, v) for f in range(x.shape[1]) for v in range(x[:, f].max()) if w[x[:, f] <= v].sum() >= least and w[x[:, f] > v].sum() >= least]
    if depth < most and splits and min(splits)[0] < spread(y == y) - 1e-9:
        _, f, v = min(splits)
        for k in (x[:, f] <= v, x[:, f] > v):
            out[k] = by_hand(x[k], w[k], y[k], depth + 1, most, least)
    return out


@pytest.mark.parametrize("depth,least", [(30, 2), (3, 1), (30, 40)])
def test_a_tree_is_that_grown_by_hand(depth, least):
    rng = np.random.default_rng(depth)
    x, y = rng.integers(0, 12, (160, 3)).astype(np.uint8), rng.normal(size=160)
    plan = forests.Plan(1, depth, least, 3, 7, 0.0, 1.0, tuple(np.arange(11.0) for _ in range(3)))
    w = forests.bag(plan, 0, np.arange(160))
    some = w > 0
    tree = forests.grown(plan, 0, 1, x[some], w[some], y[some])
    assert np.allclose(tree.value[tree.find(x[some])], by_hand(x[some].astype(int), w[some], y[some], 0, depth, least))
    assert np.bincount(tree.find(x[some]), w[some], len(tree.value))[tree.feature < 0].min() >= least


def test_bags_and_sets_of_features():
    plan = forests.Plan(9, 30, 2, 5, 42, 0.0, 1.0, tuple(np.arange(3.0) for _ in range(21)))
    bags = np.array([forests.bag(plan, t, np.arange(20_000)) for t in range(9)])
    assert abs(bags.mean() - 1) < 0.01 and abs(bags.var() - 1) < 0.03 and np.abs(np.corrcoef(bags) - np.eye(9)).max() < 0.03
    sets = forests.chosen(plan, 3, np.arange(1, 9000, dtype=np.uint64))
    assert all(len(set(r)) == 5 for r in sets) and np.abs(np.bincount(sets.ravel()) / len(sets) - 5 / 21).max() < 0.02


def test_rows_and_nodes_may_lie_anywhere(spark, monkeypatch):
    rows = samples(spark)
    rows = rows.unionByName(rows.where("file_index < 50"))  # equal rows, too
    train, test = rows.where("bearing <> 'B0'"), rows.where("bearing = 'B0'").drop("rul_seconds")
    params = {"numTrees": 12, "maxDepth": 30, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"}

    def run(train):
        made = forests.predictions(train, test, COLUMNS, "rul_seconds", 3, **params).select("file_index", "raw").collect()
        return sorted(tuple(r) for r in made), {r["feature"]: r["importance"] for r in forests.importances(train, COLUMNS, "rul_seconds", 3, **params).collect()}

    found, shares = run(train)
    assert len(found) == test.count() and abs(sum(shares.values()) - 1) < 1e-9 and max(shares, key=shares.get) == "a"
    assert run(train.repartition(7)) == (found, shares)
    monkeypatch.setattr(forests, "HELD", 60)  # nodes with more rows are split by all tasks
    monkeypatch.setattr(forests, "PACKED", 16)
    monkeypatch.setattr(forests, "TOGETHER", 2)
    split, parts = run(train)
    assert [f for f, _ in split] == [f for f, _ in found] and np.allclose([v for _, v in split], [v for _, v in found], rtol=1e-9)
    assert all(abs(parts[c] - shares[c]) < 1e-9 for c in COLUMNS)


def test_large_nodes_without_a_split_are_leaves(spark, monkeypatch):
    monkeypatch.setattr(forests, "HELD", 60)
    rows = samples(spark).withColumn("rul_seconds", F.when(F.col("b") < 2, 5.0).otherwise(9.0))
    made = forests.predictions(rows, rows, ["b"], "rul_seconds", numTrees=4, maxDepth=30, minInstancesPerNode=2, featureSubsetStrategy="all")
    assert made.count() == 600 and made.where("abs(raw - rul_seconds) > 1e-6").count() == 0
    made = forests.predictions(rows, rows, COLUMNS, "rul_seconds", numTrees=4, maxDepth=1, featureSubsetStrategy="all")
    assert made.count() == 600 and made.where("abs(raw - rul_seconds) > 1e-6").count() == 0


def test_cuts_are_middles_of_few_values_and_quantiles_of_many(spark):
    rows = spark.range(1000).select("id", F.hash("id").cast("long").alias("_id"), (F.col("id") % 3).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    few, many = forests.cut_points(rows, ["a", "b"], 4, 1000)
    assert few.tolist() == [0.5, 1.5] and np.abs(many - [250, 500, 750]).max() <= 4


def test_faulty_rows_are_refused(spark):
    rows = samples(spark, 30)
    with pytest.raises(contracts.ContractError, match="finite"):
        forests.predictions(rows.withColumn("rul_seconds", F.lit(float("nan"))), rows, COLUMNS, "rul_seconds")
    with pytest.raises(contracts.ContractError, match="no training rows"):
        forests.predictions(rows.where("false"), rows, COLUMNS, "rul_seconds")
    with pytest.raises(Exception, match="nulls or NaN"):
        forests.predictions(rows, rows.withColumn("b", F.lit(None).cast("double")), COLUMNS, "rul_seconds").count()


def test_importances_are_those_of_mllib(spark):
    rows = samples(spark)
    params = {"numTrees": 30, "maxDepth": 6, "featureSubsetStrategy": "all"}
    fit = models.make_model("random_forest", rows, COLUMNS, "rul_seconds", **params).fit(rows)
    theirs = {r["feature"]: r["importance"] for r in models.importances(fit, COLUMNS, rows).collect()}
    ours = {r["feature"]: r["importance"] for r in forests.importances(rows, COLUMNS, "rul_seconds", **params).collect()}
    assert all(abs(ours[c] - theirs[c]) < 0.02 for c in COLUMNS)


def test_folds_and_importances_keep_no_nodes_on_the_driver(spark, monkeypatch):
    def refused(*args, **more):
        raise AssertionError("a forest of MLlib")

    monkeypatch.setattr(models, "forest", refused)
    made = models.leave_one_out("random_forest", samples(spark, 120), COLUMNS, folds=2, numTrees=5)
    assert made.count() == 120 and made.where("predicted IS NULL").count() == 0
    few = models.effective_params("random_forest", {"numTrees": 5})
    monkeypatch.setattr(models, "effective_params", lambda name, overrides=None: few)
    assert queries.QUERIES["feature_importance"](spark, "/root/testdata/sf0.001").count() == 21


def test_baselines_grow_their_forest_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "forest", None)  # MLlib's
    rows = samples(spark, 120).withColumns({"condition": F.lit(1), "observed_age_seconds": F.col("a"), "cut_file_index": F.col("file_index")})
    preset = {"model": "random_forest", "params": {"numTrees": 4, "minInstancesPerNode": 3, "featureSubsetStrategy": "all"}}
    got = {r["model"]: r["mean_rmse"] for r in experiments.baselines(rows, features=COLUMNS, folds=2, presets=[preset]).collect()}
    assert set(got) == {"median", "condition_life_prior", "random_forest"} and got["random_forest"] < got["median"]
