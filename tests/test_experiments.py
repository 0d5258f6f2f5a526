import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import contracts, experiments, models, monitor, ranks, trajectory
from wearline.sources import tables


def samples(spark, n=4, rows=6):
    out = []
    for b in range(n):
        for i in range(rows):
            out.append((b % 2 + 1, f"B{b}", 100.0 * (i + 1), float(b + i), float((b * 7 + i) % 5), 100.0 * (rows - i) + 10.0 * b))
    return spark.createDataFrame(out, "condition int, bearing string, observed_age_seconds double, x double, z double, rul_seconds double")


def values(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=n) * 10, 1)
    x[rng.random(n) < 0.35] = 2.5  # a third of the rows share a value
    return [(f"k{i % 3}", f"g{int(i * i % 7)}", float(v)) for i, v in enumerate(x)] + [("k9", "g0", 1.0)]


def test_quantiles_match_numpy(spark):
    rows = values(spark)
    df = spark.createDataFrame(rows, "k string, g string, v double").union(spark.createDataFrame([("k1", "g1", None)], "k string, g string, v double"))
    shares = {"low": 0.01, "mid": 0.5, "high": 0.93}
    for keys in (["k"], []):
        got = {tuple(r[c] for c in keys): [r[s] for s in shares] for r in ranks.quantiles(df, keys, "v", shares).collect()}
        for key in got:
            mine = [v for k, _, v in rows if not keys or k == key[0]]
            assert got[key] == pytest.approx(np.quantile(mine, list(shares.values())))
    assert ranks.quantiles(df.where("false"), ["k"], "v", shares).count() == 0


def test_below_counts_every_smaller_value(spark):
    rows = values(spark, 2)
    df = spark.createDataFrame(rows, "k string, g string, v double")
    for r in ranks.cumulated(ranks.counted(df, ["k"], "v"), ["k"]).collect():
        mine = [v for k, _, v in rows if k == r.k]
        assert (r.below_n, r.n, r.total_n) == (sum(v < r.value for v in mine), sum(v == r.value for v in mine), len(mine))


def test_medians_without_a_group_match_numpy(spark):
    rows = values(spark, 3, 150)
    df = spark.createDataFrame(rows, "k string, g string, v double")
    for keys in ([], ["k"]):
        for r in ranks.medians_without(df, keys, "g", "v").collect():
            rest = [v for k, g, v in rows if g != r.g and (not keys or k == r.k)]
            assert (r.n_train, r["median"]) == (len(rest), pytest.approx(np.median(rest)))
    assert ranks.medians_without(df.where("g = 'g0'"), [], "g", "v").count() == 0


def test_an_experiment_end_to_end(spark, tmp_path):
    df = samples(spark)
    made = experiments.run_experiment("ridge", df, ["x", "z"], path=f"{tmp_path}/e")
    assert made.predictions.count() == df.count() and made.folds.count() == 4
    row = spark.read.parquet(f"{tmp_path}/e/summary").first()
    assert (row.model, row.n_folds) == ("ridge", 4) and row.mean_rmse > 0 and 0 <= row.mean_violation_rate <= 1
    assert {r.model for r in experiments.baselines(df).collect()} == {"median", "condition_life_prior"}
    with pytest.raises(contracts.ContractError):
        experiments.run_experiment("ridge", df, ["x", "bearing"])
    with pytest.raises(contracts.ContractError):
        experiments.run_experiment("median", df.where("bearing = 'B0'"), [])


def test_suites_keep_what_failed(spark):
    rows = {r.model: r for r in experiments.suite(samples(spark), ["x"], [{"model": "median"}, {"model": "none"}, {"model": "ridge", "label": "leak", "features": ["rul_seconds"]}]).collect()}
    assert rows["median"].status == "ok" and {rows["none"].status, rows["leak"].status} == {"error"} and rows["leak"].reason
    found = experiments.feature_ablation("ridge", samples(spark), {"both": ["x", "z"], "one": ["z"]}).collect()
    assert {r.model for r in found} == {"both", "one"}
    gain = experiments.target_ablation(["median"], samples(spark), []).first()
    assert gain.gain == pytest.approx(gain.direct - gain.total_life) and gain.gain > 0  # life is nearly the same everywhere


def test_total_life_medians_in_one_job_match_fits_per_fold(spark):
    df = samples(spark)
    one = {(r.bearing, r.observed_age_seconds): r.predicted for r in models.leave_one_out("median", df, [], total_life=True).collect()}
    for b in ("B0", "B3"):
        for r in models.fit_predict("median", df.where(F.col("bearing") != b), df.where(F.col("bearing") == b), [], total_life=True).collect():
            assert one[b, r.observed_age_seconds] == pytest.approx(r.predicted)


def test_sweeps_draw_the_same_candidates():
    assert experiments.candidates("random_forest", 3) == experiments.candidates("random_forest", 3)
    for p in experiments.candidates("random_forest", 40):
        assert p["numTrees"] in range(300, 1001, 100) and p["maxDepth"] in (30, 4, 6, 8, 12) and 1 <= p["minInstancesPerNode"] <= 5
    for name, most in (("xgboost", 6), ("lightgbm", 30)):
        for p in experiments.candidates(name, 40):
            assert 200 <= p["maxIter"] <= 1000 and p["maxIter"] % 100 == 0 and p["maxDepth"] <= most and 0.6 <= p["subsamplingRate"] <= 1 and 0.6 <= float(p["featureSubsetStrategy"]) <= 1
    for p in experiments.candidates("gradient_boosting", 20):
        assert 50 <= p["maxIter"] <= 300 and 1e-2 <= p["stepSize"] <= 0.2 and 2 <= p["maxDepth"] <= 5


def test_sweep_ranks_candidates(spark):
    rows = experiments.sweep("ridge", samples(spark), ["x", "z"], 2).collect()
    assert len(rows) == 2 and rows[0].mean_rmse <= rows[1].mean_rmse and "alpha" in rows[0].params


def test_split_fit_counts_dropped_rows(spark):
    df = samples(spark).withColumn("split", F.when(F.col("bearing") < "B2", "train").otherwise("test")).withColumn("x", F.when(F.col("observed_age_seconds") != 200.0, F.col("x")))
    fitted, scores = experiments.split_fit("ridge", df, ["x", "z"], "train", "test")
    row = scores.first()
    assert (row.n_dropped_learn, row.n_dropped_judge, row.n_rows) == (2, 2, 10) and fitted.name == "ridge"


@pytest.mark.parametrize("name", ["median", "condition_life_prior", "ridge"])
def test_saved_models_score_alike(spark, tmp_path, name):
    df = samples(spark)
    fitted = experiments.fit(name, df, ["x", "z"], total_life=name == "ridge")
    fitted.save(f"{tmp_path}/{name}")
    again = experiments.load(spark, f"{tmp_path}/{name}")
    key = lambda rows: sorted((r.bearing, r.observed_age_seconds, round(r.predicted, 6)) for r in rows.collect())
    assert key(fitted.predict(df)) == key(again.predict(df)) and (again.name, again.total_life) == (name, name == "ridge")
    requests = df.withColumn("outcome", F.when(F.col("bearing") == "B1", "rejected").otherwise("ok")).withColumn("reason", F.when(F.col("bearing") == "B1", "missing x"))
    rows = experiments.score_requests(again, requests).collect()
    assert len(rows) == df.count() and all((r.status, r.error_message) == (("error", "missing x") if r.bearing == "B1" else ("ok", None)) for r in rows)
    assert all((r.predicted_rul_seconds is None) == (r.bearing == "B1") for r in rows)


def test_official_holdout_names_a_winner(spark):
    df = samples(spark)
    ends = df.where("observed_age_seconds = 300").withColumn("cut_file_index", F.lit(30))
    made, scores = experiments.official_holdout(df, ends.drop("rul_seconds"), ends.select("condition", "bearing", "cut_file_index", "rul_seconds"), ["median", "condition_life_prior"], [])
    rows = scores.collect()
    assert made.count() == 8 and [r["rank"] for r in rows if r.winner] == [1] and len(rows) == 2


def test_repeated_places_fail(spark):
    rows = spark.createDataFrame([("a", i // 2, 1.0 * i) for i in range(6)], "bearing string, file_index int, v double")
    with pytest.raises(Exception, match="repeated file_index"):
        trajectory.with_temporal(rows, ["v"], (2,)).collect()


def test_bad_log_rows_go_to_quarantine(spark, tmp_path):
    log = spark.createDataFrame([("1", "ok", 1.0), ("2", "odd", 1.0), ("3", "error", None)], "request_id string, status string, rms double").withColumn("requested_at", F.lit("2024-01-01").cast("timestamp"))
    from wearline import catalog

    log = log.withColumns({c: F.lit(1.0) for c in catalog.prefix_columns()})
    tables.append_predictions(log, f"{tmp_path}/log", f"{tmp_path}/bad")
    assert sorted(r.request_id for r in spark.read.parquet(f"{tmp_path}/log").collect()) == ["1", "3"]
    assert [(r.request_id, r.fault) for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == [("2", "unknown status")]
    with pytest.raises(contracts.ContractError):
        tables.append_predictions(log, f"{tmp_path}/log")


def test_drift_statistic_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(size=300), 1), np.round(rng.normal(0.4, 1, 200), 1)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    row = monitor.drift(frame(a), frame(b), ["v"]).first()
    points = np.unique(np.r_[a, b])
    want = max(abs((a <= p).mean() - (b <= p).mean()) for p in points)
    assert (row.n_reference, row.n_current, row.statistic) == (300, 200, pytest.approx(want))
