"""Connected components of a table of edges by alternating star steps; every step is joins and groupings.

A node of more than HUB edges is dealt over pieces (spread_join()), so no step gathers such a node's edges in one task.
Null ends make no edge; loops and repeated edges count once; other columns are not carried; an empty table gives an
empty table.  Tables of earlier rounds are deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, spread_join, stored

#: Edges of a node (two numbers each) that one task takes.
HUB = 1 << 20


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def star(edges: DataFrame, large: bool, hubs: bool = False) -> DataFrame:
    """Hangs each node's larger (or other) neighbours on the least node in reach."""
    near = both_ways(edges)
    if not large:
        near = near.where("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count(F.lit(1)).alias("degree"))
    joined = spread_join(near, least, ["a"], "degree", HUB) if hubs else near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node that it reaches) of all nodes with an edge."""
    spark, mark = edges.sparkSession, None
    now, path = stored(edges.select("a", "b").where("a != b").distinct(), "edges")
    while True:
        by_node = both_ways(now).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        row = by_node.agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.max("n").alias("most")).first()
        if not row["n"] or (row["n"], row["sum"]) == mark:
            break
        mark, last = (row["n"], row["sum"]), path
        now, path = stored(star(star(now, True, row["most"] > HUB), False, row["most"] > HUB), "edges")
        discarded(spark, last)
    # every edge now hangs a node on the least of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
