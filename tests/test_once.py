"""Inputs are worked out once, and sums by machine meet whole."""

import random

import numpy as np
from pyspark.sql import functions as F

from wearline import catalog
from wearline.operators import blocks, datasets, experiments, models, moments, neighbours, prefix, ranks
from wearline.streaming import log


def watched(frame):
    """frame, and a counter of the rows that are worked out."""
    seen = frame.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return frame.mapInArrow(count, frame.schema), seen


def test_quantiles_work_their_input_out_once(spark):
    rows, seen = watched(spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") % 90).cast("double").alias("v")))
    found = {r["k"]: r["m"] for r in ranks.quantiles(rows, ["k"], "v", {"m": 0.5}).collect()}
    assert found == {k: float(np.median([i % 90 for i in range(1000) if i % 7 == k])) for k in range(7)}
    assert seen.value == 1000


def test_medians_without_a_group_work_their_input_out_once(spark):
    rows, seen = watched(spark.range(300).select((F.col("id") % 5).alias("g"), (F.col("id") % 41).cast("double").alias("v")))
    found = {r["g"]: r["median"] for r in ranks.medians_without(rows, [], "g", "v").collect()}
    assert found == {g: float(np.median([i % 41 for i in range(300) if i % 5 != g])) for g in range(5)}
    assert seen.value == 300


def test_ranks_hold_if_split_points_differ_when_they_are_worked_out_again(spark, monkeypatch):
    # on a cluster parts of an approximate percentile meet in any order; here its results move at random each time
    real, moved = F.percentile_approx, F.udf(lambda found: sorted(v + random.uniform(-9, 9) for v in found), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda *args: moved(real(*args)))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.exchange.reuse": "false"}  # the function adds a shuffle, which would be reused
    for name, value in settings.items():
        spark.conf.set(name, value)
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.col("id") % 1000).cast("double").alias("v"))
    try:
        found = ranks.cumulated(ranks.counted(rows, ["k"], "v"), ["k"]).collect()
        middle = {r["k"]: r["m"] for r in ranks.quantiles(rows, ["k"], "v", {"m": 0.5}).collect()}
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert {(r["k"], r["value"]): r["below_n"] for r in found} == {(i % 3, float(i % 1000)): sum(j % 3 == i % 3 and j % 1000 < i % 1000 for j in range(3000)) for i in range(3000)}
    assert middle == {k: float(np.median([i % 1000 for i in range(3000) if i % 3 == k])) for k in range(3)}


def test_sums_of_products_meet_without_a_row_per_product(spark):
    rng = np.random.default_rng(3)
    data = [(f"m{i % 700}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(2800, 2)))]
    frame = spark.createDataFrame(data, "bearing string, a double, b double").repartition(5)
    sums = moments.products(frame, {c: F.col(c) for c in "ab"}, "bearing", np.zeros(2), np.ones(2))
    assert "Generate" not in sums._jdf.queryExecution().optimizedPlan().toString()
    found = sums.collect()
    assert len(found) == 700 and len({r["bearing"] for r in found}) == 700
    for r in found:
        x = np.array([(1.0, a, b) for m, a, b in data if m == r["bearing"]])
        assert np.allclose(r["sums"], (x.T @ x)[np.triu_indices(3)])


def test_folds_of_trees_work_their_input_out_once(spark):
    frame = spark.range(120).select(F.concat(F.lit("B"), F.col("id") % 12).alias("bearing"), F.rand(1).alias("x"), (F.col("id") % 9).cast("double").alias("rul_seconds"))
    rows, seen = watched(frame)
    made = models.leave_one_out("random_forest", rows, ["x"], folds=3, numTrees=3, maxDepth=3)
    assert made.count() == 120 and seen.value == 120


def test_forests_remember_the_nodes_of_rows():
    assert models.forest(["x"], "y").getStages()[1].getCacheNodeIds()


def test_positions_deal_rows_once(spark):
    frame = spark.range(50).select(F.when(F.col("id") % 2 == 0, "a").alias("bearing"), F.col("id").alias("file_index"))
    made = blocks.positioned(frame)
    assert {(r["bearing"], r["file_index"], r["position"]) for r in made.collect()} == {(None if i % 2 else "a", i, i // 2 + 1) for i in range(50)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = blocks.positioned(frame)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 4  # rows, counts by cell, cells by entity, cells to rows


def test_equal_test_rows_are_looked_up_once(spark, monkeypatch):
    train = spark.range(200).select((F.col("id") * 1.5).alias("a"), F.col("id").cast("double").alias("y"))
    test = spark.range(900).select("id", (F.col("id") % 30 + 0.25).alias("a"))
    sizes, nearest = [], neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda learned, asked, *more: sizes.append(asked.count()) or nearest(learned, asked, *more))
    found = {r["id"]: r["predicted"] for r in models.knn_predict(train, test, ["a"], "y", ["id"]).collect()}
    assert sizes == [30] and len(found) == 900
    for i, p in found.items():
        d = sorted((abs(i % 30 + 0.25 - 1.5 * j), j) for j in range(200))[:3]
        assert abs(p - sum(j / x for x, j in d) / sum(1 / x for x, _ in d)) < 1e-9


def test_alignment_works_both_sides_out_once(spark):
    rows = spark.range(40).select((F.col("id") % 3 + 1).cast("int").alias("condition"), F.concat(F.lit("B"), "id").alias("bearing"), F.col("id").alias("cut_file_index"))
    features, seen = watched(rows)
    truth, asked = watched(rows.withColumn("rul_seconds", F.lit(1.0)))
    assert datasets.align(features, truth).count() == 40 and (seen.value, asked.value) == (40, 40)


def test_prefixes_choose_rows_without_functions_over_arrays(spark):
    frame = spark.range(60).select(F.lit("a").alias("bearing"), F.lit(1).alias("condition"), F.col("id").alias("file_index"), F.lit(1.0).alias("rul_seconds"), *(F.lit(1.0).alias(s) for s in catalog.SOURCES))
    made = prefix.prefix_samples(frame, (0.5, 0.501, 0.8))
    assert [(r["cut_fraction"], r["cut_file_index"]) for r in made.orderBy("cut_fraction").collect()] == [(0.5, 30), (0.8, 47)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lambda" in line for line in plan.splitlines() if "Generate explode" in line and "_cut" in line)


def test_a_stream_parses_its_requests_once(spark, tmp_path, monkeypatch):
    sample = spark.range(40).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("rul_seconds"))
    experiments.fit("ridge", sample, ["x"]).save(f"{tmp_path}/model")
    requests = spark.range(30).select(F.col("id").cast("string").alias("request_id"), F.timestamp_seconds(F.col("id") + 1000).alias("requested_at"), F.when(F.col("id") % 5 == 0, "no").otherwise(F.format_string('{"k": %d}', "id")).alias("body"))
    requests.coalesce(1).write.parquet(f"{tmp_path}/in")
    counts, parsed = [], log.parsed_requests

    def counting(*args):
        rows, seen = watched(parsed(*args))
        counts.append(seen)
        return rows

    monkeypatch.setattr(log, "parsed_requests", counting)
    log.model_scoring(log.log_stream(spark, f"{tmp_path}/in", requests.schema), f"{tmp_path}/model", "body", {"k": "x"}, f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/state").start().awaitTermination()
    assert (spark.read.parquet(f"{tmp_path}/out").count(), spark.read.parquet(f"{tmp_path}/bad").count()) == (24, 6)
    assert sum(c.value for c in counts) == 30
