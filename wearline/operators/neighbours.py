"""Exact nearest neighbours with pruning.

Rows of equal features keep the k smallest targets, as others can't be among the k nearest.  The training side is cut into
cells around pivots, rows drawn by a hash, and a cell into rings by distance from its pivot.  From the distances of a test row
to the pivots follow a least distance to each ring, by the triangle inequality, and a distance within which k rows must lie.
A block of test rows is compared with the blocks of only those rings that one of its rows can't rule out.  Nothing is
approximate: what is left out can't be among the k nearest, also where distances tie.

Broadcast are the pivots and a row per ring: at most PIVOTS times RINGS.  A block that many test blocks ask for is dealt to
several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Rows in a block, the most pivots and rings of a cell, and test blocks that ask for one training block in one task.
BLOCK_ROWS, PIVOTS, RINGS, ASKED = 2048, 1024, 64, 64
#: Distances that agree to so many digits are ties; bounds give way by SLACK.
DIGITS, SLACK = 12, 1e-9


@dataclass(frozen=True)
class Rings:
    """Pivots, and of each ring of training rows its cell, number, rows, and least and largest distance from the pivot."""

    pivots: np.ndarray
    cell: np.ndarray
    ring: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def wanted(self, x: np.ndarray, k: int) -> np.ndarray:
        """Which rings at least one of the rows x needs."""
        need = np.zeros(len(self.cell), bool)
        for at in range(0, len(x), 64):
            d = distances(x[at : at + 64], self.pivots)[:, self.cell]
            far = d + self.high
            order = np.argsort(far, axis=1, kind="stable")
            enough = np.argmax(np.cumsum(self.rows[order], axis=1) >= min(k, self.rows.sum()), axis=1)
            limit = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], axis=1), axis=1)
            near = np.maximum(0, np.maximum(d - self.high, self.low - d))
            need |= (near <= limit * (1 + SLACK) + SLACK).any(axis=0)
        return need


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    far = np.zeros((len(x), len(to)))
    for j in range(x.shape[1]):
        far += (x[:, j, None] - to[None, :, j]) ** 2
    return np.sqrt(far)


def nearest_of(x: np.ndarray, t: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, squared distance and y of the k nearest rows of t for each row of x; ties by y."""
    far = np.zeros((len(x), len(t)))
    for j in range(x.shape[1]):
        far += (x[:, j, None] - t[None, :, j]) ** 2
    key = np.round(far, DIGITS)
    limit = np.partition(key, min(k, len(t)) - 1, axis=1)[:, min(k, len(t)) - 1]
    row, col = np.nonzero(key <= limit[:, None])
    order = np.lexsort((y[col], key[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], far[row, col][place < k], y[col][place < k]


def of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with cell, the nearest pivot of their x, and far, the distance from it."""
    kinds = rows.schema.simpleString()[7:-1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = of(batch, "x").flatten().to_numpy().reshape(len(batch), -1) if len(batch) else np.zeros((0, pivots.shape[1]))
            cell, far = np.zeros(len(x), np.int32), np.zeros(len(x))
            for at in range(0, len(x), 1024):
                d = distances(x[at : at + 1024], pivots)
                cell[at : at + 1024] = d.argmin(axis=1)
                far[at : at + 1024] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return rows.mapInArrow(assign, f"{kinds}, cell int, far double")


def ringed(train: DataFrame, k: int) -> tuple[DataFrame, Rings]:
    """Training blocks (cell, ring, part, t, y) from rows (x, y), written; and their rings."""
    smallest = F.row_number().over(Window.partitionBy("x").orderBy("y"))
    rows = kept(train.withColumn("_k", smallest).where(F.col("_k") <= k), "neighbours-train")
    n = max(1, min(PIVOTS, -(-rows.count() // BLOCK_ROWS)))
    drawn = [r["x"] for r in rows.where("_k = 1").orderBy(F.xxhash64("x"), "x").limit(n).collect()]  # at most PIVOTS
    if not drawn:
        raise ValueError("no training rows")
    pivots = np.array(drawn, float)
    placed = kept(in_cells(rows.select("x", "y"), pivots), "neighbours-cells")
    shares = F.array(*(F.lit(i / RINGS) for i in range(1, RINGS)))
    splits = F.percentile_approx("far", shares, F.lit(20 * RINGS))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), splits.alias("s")).withColumn("rings", F.least(F.lit(RINGS), F.ceil(F.col("m") / BLOCK_ROWS)).cast("int"))
    # so many of the splits as the cell has rings, evenly
    sizes = sizes.select("cell", F.ceil(F.col("m") / (F.col("rings") * BLOCK_ROWS)).cast("int").alias("parts"), F.array_distinct(F.transform(F.filter(F.sequence(F.lit(0), F.col("rings") - 1), lambda i: i > 0), lambda i: F.get("s", (i * RINGS / F.col("rings") - 1).cast("int")))).alias("s"))
    dealt = placed.join(F.broadcast(sizes), "cell").select("cell", F.size(F.filter("s", lambda v: v < F.col("far"))).alias("ring"), F.pmod(F.xxhash64("x", "y"), F.col("parts").cast("long")).cast("int").alias("part"), "x", "y", "far")
    held = dealt.groupBy("cell", "ring", "part").agg(F.collect_list(F.struct("x", "y")).alias("r"), F.count(F.lit(1)).alias("m"), F.min("far").alias("low"), F.max("far").alias("high"))
    blocks = kept(held.select("cell", "ring", "part", F.flatten("r.x").alias("t"), F.col("r.y").alias("y"), "m", "low", "high"), "neighbours-blocks")
    found = blocks.groupBy("cell", "ring").agg(F.sum("m").alias("m"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("cell", "ring").toPandas()  # at most PIVOTS * RINGS
    return blocks, Rings(pivots, *(found[c].to_numpy() for c in ("cell", "ring", "m", "low", "high")))


def asked(test: DataFrame, key: list[str], rings: Rings, k: int) -> DataFrame:
    """Test blocks, once for each ring they need: id, cell, ring, x and the key columns, from rows (x, key); written."""
    placed = in_cells(test.select("x", *key), rings.pivots)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("long").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("x", *key), F.col("parts")))
    held = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("x", *key)).alias("r"))
    blocks = held.select(F.concat_ws("-", "cell", "part").alias("id"), F.flatten("r.x").alias("x"), *(F.col(f"r.{c}").alias(f"k{i}") for i, c in enumerate(key)))
    kinds = blocks.schema.simpleString()[7:-1]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for i in range(len(batch)):
                need = rings.wanted(of(batch, "x").slice(i, 1).flatten().to_numpy().reshape(-1, rings.pivots.shape[1]), k)
                lists.append([{"cell": int(c), "ring": int(r)} for c, r in zip(rings.cell[need], rings.ring[need], strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.struct([("cell", pa.int32()), ("ring", pa.int32())])))], names=[*batch.schema.names, "need"])

    return kept(blocks.mapInArrow(ask, f"{kinds}, need array<struct<cell:int,ring:int>>"), "neighbours-asked")


def nearest(train: DataFrame, test: DataFrame, key: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """The key columns, d (squared distance) and y of at least the k nearest training rows of each test row, and one row with
    compared, the pairs of blocks that are compared, and pairs, all there are.  Rows have x; training rows have y as well."""
    blocks, rings = ringed(train.select("x", "y"), k)
    wants = asked(test, key, rings, k)
    pairs = wants.select("*", F.inline("need")).drop("need")
    hot = pairs.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("pieces"))  # a row per ring
    one = pairs.join(F.broadcast(hot), ["cell", "ring"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces").cast("long")).cast("int")).drop("pieces")
    two = blocks.select("cell", "ring", "t", "y").join(F.broadcast(hot), ["cell", "ring"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    width, kinds = rings.pivots.shape[1], dict(test.dtypes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x, t = (of(batch, name).slice(i, 1).flatten().to_numpy().reshape(-1, width) for name in ("x", "t"))
                row, far, near = nearest_of(x, t, of(batch, "y").slice(i, 1).flatten().to_numpy(), k)
                yield pa.RecordBatch.from_arrays([*(of(batch, f"k{j}").slice(i, 1).flatten().take(pa.array(row)) for j in range(len(key))), pa.array(far), pa.array(near)], names=[*key, "d", "y"])

    found = one.join(two, ["cell", "ring", "piece"]).mapInArrow(compare, ", ".join([*(f"`{c}` {kinds[c]}" for c in key), "d double, y double"]))
    per_ring = blocks.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("b"))
    compared = pairs.join(F.broadcast(per_ring), ["cell", "ring"]).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("compared"))
    return found, compared.crossJoin(wants.agg(F.count(F.lit(1)).alias("_a")).crossJoin(blocks.agg(F.count(F.lit(1)).alias("_b")))).select("compared", (F.col("_a") * F.col("_b")).alias("pairs"))  # one row each
