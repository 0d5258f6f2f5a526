import os

import pytest
from pyspark.sql import functions as F

from wearline.operators import digests
from wearline.operators.contracts import ContractError
from wearline.sources import versions

KEY = "split string, bearing string, file_index int, x double, rul_seconds double"


def rows(spark, n, bearings=("a", "b"), shift=0.0):
    return spark.createDataFrame([("s", b, i, float(i) + shift, float(n - i)) for b in bearings for i in range(1, n + 1)], KEY)


def test_versions_are_switched_and_read_by_number(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.published(spark, root) is None
    with pytest.raises(ContractError, match="no version"):
        versions.current(spark, root)
    assert versions.publish(rows(spark, 5), root, finite_columns=["x"]) == 1
    before = versions.current(spark, root)
    assert versions.publish(rows(spark, 7, shift=1.0), root, finite_columns=["x"]) == 2
    assert before.count() == 10 and versions.current(spark, root).count() == 14 and versions.current(spark, root, 1).count() == 10
    assert versions.current(spark, root).columns == ["split", "bearing", "file_index", "x", "rul_seconds"]
    with pytest.raises(ContractError):
        versions.current(spark, root, 3)
    assert versions.expire(spark, root, keep=1) == 1
    assert versions.current(spark, root).count() == 14 and versions.history(spark, root).count() == 2


@pytest.mark.parametrize("spoil, what", [
    (lambda d: d.union(d.limit(1)), "repeated key: 2 rows"), (lambda d: d.where("false"), "no rows"),
    (lambda d: d.withColumn("x", F.when(F.col("file_index") == 2, F.lit(float("nan"))).otherwise(F.col("x"))), "not finite x: 2 rows"),
    (lambda d: d.withColumn("file_index", F.when(F.col("file_index") != 3, F.col("file_index"))), "null file_index: 2 rows"),
    (lambda d: d.withColumn("split", F.when(F.col("bearing") == "a", F.lit("other")).otherwise(F.col("split"))), "breaks purity: 5 rows"),
    (lambda d: d.withColumn("split", F.lit(None).cast("string")), "breaks purity: 10 rows"), (lambda d: d.drop("x"), "missing x"),
])
def test_refused_versions_change_nothing(spark, tmp_path, spoil, what):
    root = str(tmp_path / "t")
    good = rows(spark, 5)
    versions.publish(good, root)
    with pytest.raises(ContractError, match=what):
        versions.publish(spoil(good), root, finite_columns=["x"], rules={"purity": F.col("split") == "s"}, required=["x"])
    assert versions.published(spark, root)["number"] == 1 and versions.current(spark, root).count() == 10


def test_a_writer_that_stops_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.publish(rows(spark, 5), root)
    broken = rows(spark, 6).withColumn("x", F.when(F.col("file_index") == 6, F.raise_error(F.lit("stopped"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stopped"):
        versions.publish(broken, root)
    # rows written, manifest not: what a driver lost between the two steps leaves
    versions.write_checked(rows(spark, 9), lambda r: r.write.parquet(f"{root}/rows/unlisted"))
    assert versions.current(spark, root).count() == 10
    assert versions.expire(spark, root) >= 1 and len(os.listdir(f"{root}/rows")) == 1
    assert versions.publish(rows(spark, 6), root) == 2


def test_one_pass_and_blocks_of_a_long_entity(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    df = rows(spark, 50).coalesce(1).mapInPandas(counted, KEY)
    versions.publish(df, str(tmp_path / "t"), finite_columns=["x"])
    assert reads.value == 100
    text = lambda x: F.concat(F.lit(x), F.col("id") % 1)
    long = spark.range(3 * versions.BLOCK).select(text("s").alias("split"), text("a").alias("bearing"), F.col("id").alias("file_index"))
    laid = versions.laid_out(long, ["split", "bearing", "file_index"])
    assert laid._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert laid.groupBy(F.spark_partition_id()).count().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def differing(spark, tmp_path, left, right, columns=("x",), both=True):
    for name, df in (("l", left), ("r", right)):
        digests.write_tree(df, f"{tmp_path}/{name}", ["bearing"], "file_index", list(columns))
    return digests.differing(spark, f"{tmp_path}/l", f"{tmp_path}/r", ["bearing"], both)


def as_set(found):
    return {(r.bearing, r.node, r.side) for r in found.collect()}


def test_differing_files(spark, tmp_path):
    left = rows(spark, 300)
    right = rows(spark, 310).where("NOT (bearing = 'a' AND file_index = 70)").withColumn("x", F.when((F.col("bearing") == "b") & F.col("file_index").isin(5, 299), None).otherwise(F.col("x")))
    want = {("a", 70, "left"), ("b", 5, "both"), ("b", 299, "both")}
    assert as_set(differing(spark, tmp_path / "1", left, right, both=False)) == want
    found = differing(spark, tmp_path / "2", left, right)
    assert as_set(found) == want | {(b, i, "right") for b in "ab" for i in range(301, 311)}
    info = {r.bearing: (r.n_files, r.n_different, r.n_missing, r.first_apart) for r in digests.summary(spark, f"{tmp_path}/2/l", found, ["bearing"]).collect()}
    assert info == {"a": (300, 0, 1, 70), "b": (300, 2, 0, 5)}


def test_samples_repeats_order_and_zeros(spark, tmp_path):
    schema = "bearing string, file_index int, position int, x double"
    one = [("a", 1, 0, 0.0), ("a", 1, 1, 2.0), ("a", 2, 0, None), ("a", 3, 0, 1.0)]
    two = [("a", 1, 1, 2.0), ("a", 1, 0, -0.0), ("a", 2, 0, float("nan")), ("a", 3, 0, 1.0), ("a", 3, 0, 1.0)]
    left, right = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    assert as_set(differing(spark, tmp_path / "1", left, right, ("position", "x"))) == {("a", 2, "both"), ("a", 3, "both")}
    swapped = spark.createDataFrame([("a", 1, 0, 2.0), ("a", 1, 1, 0.0)], schema)
    assert as_set(differing(spark, tmp_path / "2", left.where("file_index = 1"), swapped, ("position", "x"))) == {("a", 1, "both")}
    assert as_set(differing(spark, tmp_path / "3", left.where("false"), right.where("false"))) == set()
    assert as_set(differing(spark, tmp_path / "4", left.where("false"), right.where("file_index = 1"))) == {("a", 1, "right")}


def test_samples_of_equal_entities_are_not_read(spark, tmp_path):
    left = rows(spark, 200, [f"m{i}" for i in range(20)])
    left.repartitionByRange(20, "bearing").write.parquet(str(tmp_path / "samples"))
    right = left.withColumn("x", F.when((F.col("bearing") == "m7") & (F.col("file_index") == 150), 0.0).otherwise(F.col("x")))
    found = differing(spark, tmp_path, left, right)
    below = digests.samples_of(spark.read.parquet(str(tmp_path / "samples")), found, ["bearing"], "file_index")
    assert [(r.bearing, r.file_index) for r in below.collect()] == [("m7", 150)]
    assert "In(bearing" in (plan := below._jdf.queryExecution().toString()) or "EqualTo(bearing,m7)" in plan
    none = digests.samples_of(left, found.where("false"), ["bearing"], "file_index")
    assert none.count() == 0 and os.path.isdir(tmp_path / "l" / "level=3")
