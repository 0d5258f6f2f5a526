"""Trajectories cut into blocks of rows, so that one of any length is spread over tasks.

Positions come from counts: rows are counted per cell, a range of the order column; the cells before are summed up; and rows
are numbered inside their cell.  A block is a range of positions.  What looks at neighbours gets them as a halo: rows near a
block's edge go to the block beyond it as well, so a window never has to reach over to another task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a cell in units of the order column, and rows of a block.
CELL, BLOCK = 4096, 4096


def cell_of(order: str):
    return F.coalesce(F.floor(F.col(order).cast("double") / CELL), F.lit(-(1 << 40))).cast("long")


def cells(frame: DataFrame, entity: str, order: str) -> DataFrame:
    """_entity (a struct of the entity), _cell, the rows of the entity in the cells before (_start) and in all (_n), and its last place (_last).

    What one row holds of an entity is a number per cell."""
    counts = frame.select(F.struct(F.col(entity).alias("e")).alias("_entity"), cell_of(order).alias("_cell"), F.col(order).alias("_o")).groupBy("_entity", "_cell").agg(F.count(F.lit(1)).alias("m"), F.max("_o").alias("o"))
    packed = counts.groupBy("_entity").agg(F.array_sort(F.collect_list(F.struct("_cell", "m"))).alias("c"), F.max("o").alias("_last"), F.sum("m").alias("_n"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<_cell:bigint,_start:bigint>>").alias("out"))
    starts = F.aggregate("c", empty, lambda acc, x: F.struct((acc["at"] + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct(x["_cell"].alias("_cell"), acc["at"].alias("_start")))).alias("out")))["out"]
    return packed.select("_entity", "_last", "_n", F.inline(starts))


def positioned(frame: DataFrame, entity: str = "bearing", order: str = "file_index") -> DataFrame:
    """Adds position, from 1 in the order of the trajectory; _n, the trajectory's rows; and _last, its last place.

    The entity is a key inside a struct, where nulls are equal, so the join finds the rows as the window has dealt and sorted them."""
    keys = ["_entity", "_cell"]
    rows = frame.withColumns({"_entity": F.struct(F.col(entity).alias("e")), "_cell": cell_of(order)}).withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    rows = rows.join(cells(frame, entity, order), keys)
    return rows.withColumn("position", (F.col("_start") + F.col("_row")).cast("int")).drop(*keys, "_row", "_start")


def haloed(rows: DataFrame, before: int, after: int = 0) -> DataFrame:
    """Adds _block and _halo: each row in its own block, and once more for a block of which it is among the rows before or after."""
    if max(before, after) > BLOCK:
        raise ValueError(f"a window reaches at most {BLOCK} rows beyond its own")
    at = F.col("position") - 1
    block, place = F.floor(at / BLOCK).cast("int"), at % BLOCK
    one = lambda b, halo: F.struct(b.alias("_block"), F.lit(halo).alias("_halo"))
    every = [one(block, False), F.when(place >= BLOCK - before, one(block + 1, True))] + ([F.when((place < after) & (block > 0), one(block - 1, True))] if after else [])
    return rows.select(*rows.columns, F.inline(F.array_compact(F.array(*every))))
