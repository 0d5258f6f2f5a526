"""Digest trees: which files of two trajectories differ, found from the top and without reading samples of what is equal.

A sample's digest is SHA-256 of its columns as JSON, position included.  A node's digest is the count and the sums of SAMPLE_LANES
32-bit lanes of its samples' digests, so a node needs no list and no order, partial sums meet before the shuffle, and an entity or
file of any size is one row of fixed width.  Level 0 has a node per file, each level above a node per FANOUT of the one below.
Equal nodes have equal samples but for collisions of 128 bits (not a protection against an adversary).

Repeated samples count; null is a value of its own, -0.0 is 0.0; an entity without rows has no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT, LEVELS, SAMPLE_LANES = 64, 3, 4
LANES = [f"d{i}" for i in range(SAMPLE_LANES)]
#: Entities named in a filter that the scan sees; beyond it the join alone finds the samples.
NAMED = 1_024


def units(rows: DataFrame, entity: list[str], index: str, columns: list[str]) -> DataFrame:
    """Nodes of level 0: a row per entity and index over columns (name a sample's position among them)."""
    types = dict(rows.dtypes)
    value = lambda c: (F.col(c) + F.lit(0.0)).alias(c) if types[c] in ("double", "float") else F.col(c)
    digest = F.sha2(F.to_json(F.struct(F.col(index).alias("_index"), *(value(c) for c in columns)), {"ignoreNullFields": "false"}), 256)
    lanes = {lane: F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long") for i, lane in enumerate(LANES)}
    own = rows.withColumn("_digest", digest).select(*entity, F.col(index).cast("long").alias("node"), *(x.alias(lane) for lane, x in lanes.items()))
    return added_up(own.withColumn("n", F.lit(1).cast("long")), entity)


def added_up(nodes: DataFrame, entity: list[str]) -> DataFrame:
    """Lanes stay below 2^32, so a node may have 2^31 children; more are an overflow error, not a wrong digest."""
    return nodes.groupBy(*entity, "node").agg(F.sum("n").alias("n"), *((F.sum(lane) % F.lit(2**32)).alias(lane) for lane in LANES))


def write_tree(rows: DataFrame, path: str, entity: list[str], index: str, columns: list[str]) -> None:
    """Writes levels 0 to LEVELS, a folder each; samples are read once and each level comes from the one below."""
    spark = rows.sparkSession
    units(rows, entity, index, columns).write.mode("overwrite").parquet(f"{path}/level=0")
    for k in range(1, LEVELS + 1):
        below = level(spark, path, k - 1).withColumn("node", F.floor(F.col("node") / FANOUT))
        added_up(below, entity).write.mode("overwrite").parquet(f"{path}/level={k}")


def level(spark: SparkSession, path: str, k: int) -> DataFrame:
    return spark.read.parquet(f"{path}/level={k}")


def differing(spark: SparkSession, left: str, right: str, entity: list[str], both: bool = True) -> DataFrame:
    """entity, node (a file's index) and side (both, left, right) of all files whose digests differ, from two written trees.

    With both=False files that only the right side has are left out: of a truncated run against the complete one, whose whole nodes
    are equal, only the nodes along its end are opened."""
    opened = None
    for k in range(LEVELS, -1, -1):
        one, two = level(spark, left, k), level(spark, right, k)
        if opened is not None:
            parents = opened.select(*entity, F.col("node").alias("_parent")).distinct()
            of = lambda t: t.withColumn("_parent", F.floor(F.col("node") / FANOUT)).join(parents, [*entity, "_parent"], "left_semi").drop("_parent")  # noqa: B023,E731
            one, two = of(one), of(two)
        nodes = lambda t, name: t.select(*entity, "node", F.struct("n", *LANES).alias(name))
        met = nodes(one, "_one").join(nodes(two, "_two"), [*entity, "node"], "full_outer" if both else "left")
        opened = met.where(~F.col("_one").eqNullSafe(F.col("_two")))
    side = F.when(F.col("_one").isNull(), "right").when(F.col("_two").isNull(), "left").otherwise("both")
    return opened.select(*entity, "node", side.alias("side"))


def samples_of(samples: DataFrame, found: DataFrame, entity: list[str], index: str) -> DataFrame:
    """Samples of the files found.  While few entities are found their names reach the scan as a filter; the result is the same without it."""
    first = entity[-1]
    names = [r[0] for r in found.select(first).distinct().limit(NAMED + 1).collect()]
    if None not in names and len(names) <= NAMED:
        samples = samples.where(F.col(first).isin(names)) if names else samples.where(F.lit(False))
    return samples.join(found.select(*entity, F.col("node").alias(index)).distinct(), [*entity, index], "left_semi")


def summary(spark: SparkSession, left: str, found: DataFrame, entity: list[str]) -> DataFrame:
    """Per entity of the left tree: its files, how many differ or are missing on the other side, and the first such."""
    count = lambda s: F.sum((F.col("side") == s).cast("long"))
    apart = found.where("side != 'right'").groupBy(*entity).agg(count("both").alias("n_different"), count("left").alias("n_missing"), F.min("node").alias("first_apart"))
    files = level(spark, left, 0).groupBy(*entity).agg(F.count(F.lit(1)).alias("n_files"))
    return files.join(apart, entity, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_different", "n_missing")})
