"""Ridge regressions of every fold, penalty and set of columns from one pass over the rows.

A ridge is a function of sums of products, and those of all entities but one are the total less that entity's own.  So one
job sums the products of all columns per entity, a second one solves each entity's systems - each penalty and set of columns
takes its sub-matrix - and a third one joins the few coefficients of an entity with its rows.  No fold is fitted by itself.

Columns are moved and scaled by mean and deviation over all rows before products are taken, which keeps digits; what is
fitted is standardised by the rows of its own training side, in the form sum of squares + alpha * |w|^2.  A column that is
constant there has weight 0.  Rows with a value that isn't finite or without a group fail the job, as do fewer than two
groups; equal rows count as often as they are there.  Predictions are 0 at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clipped, finite
from ..sources.scratch import kept
from .contracts import ContractError

#: Bytes of sums that a task holds before it passes them on, and groups that are solved at once.
HELD_BYTES, SOLVED = 8 << 20, 256
#: Share of a column's variance below which it counts as constant.
CONSTANT = 1e-12


@dataclass(frozen=True)
class Ridge:
    """One regression: its label, columns and penalty; total_life fits age + target and takes the age off again."""

    label: str
    features: tuple[str, ...]
    alpha: float = 10.0
    total_life: bool = False


def scales(frame: DataFrame, columns: dict[str, Column], group: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (1 of a constant) of each column over all rows: two numbers per column."""
    bad = F.count_if(F.col(group).isNull() | reduce(lambda a, b: a | b, (~finite(c) for c in columns.values())))
    row = frame.agg(F.count(F.lit(1)), bad, F.min(group).eqNullSafe(F.max(group)), *(f(c) for c in columns.values() for f in (F.avg, F.stddev_pop))).first()
    if not row[0] or row[2]:
        raise ContractError("leaving one out needs two groups")
    if row[1]:
        raise ContractError(f"{row[1]} rows have values that aren't finite, or no {group}")
    found = np.array(row[3:], float).reshape(-1, 2)
    return found[:, 0], np.where(found[:, 1] > 0, found[:, 1], 1.0)


def products(frame: DataFrame, columns: dict[str, Column], group: str, mean: np.ndarray, deviation: np.ndarray) -> DataFrame:
    """group and sums: the upper triangle of the sums of products of 1 and all columns, row by row.

    A task adds its rows up and passes on one row per group, or several if its groups are many; those of a group, at most a few
    per task, meet sorted and are added one after the other, so a task holds one group's sums."""
    p = len(columns) + 1
    upper = np.triu_indices(p)
    most = max(1, HELD_BYTES // (8 * len(upper[0])))
    kind = frame.schema[group].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            made = summed(pa.array(list(held), keys_type), np.array(list(held.values())))
            held.clear()
            return made

        keys_type = None
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(group))
            keys_type = keys.type
            x = batch.column(batch.schema.get_field_index("_x")).flatten().to_numpy().reshape(len(batch), p - 1)
            x = np.c_[np.ones(len(x)), (x - mean) / deviation]
            coded = keys.dictionary_encode()
            code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0, True]) if len(order) else np.zeros(1, int)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                mine, name = x[order[a:b]], names[code[order[a]]]
                held[name] = held.get(name, 0) + (mine.T @ mine)[upper]
                if len(held) >= most:
                    yield out()
        if held:
            yield out()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not len(batch):
                continue
            names, rows = batch.column(0), batch.column(1).flatten().to_numpy().reshape(len(batch), len(upper[0]))
            starts = np.flatnonzero(np.r_[True, np.not_equal(names[1:].to_numpy(zero_copy_only=False), names[:-1].to_numpy(zero_copy_only=False))])
            found, first = np.add.reduceat(rows, starts, axis=0), names[0].as_py()
            if held is not None and first == last.as_py():
                found[0] += held
            elif held is not None:
                yield summed(pa.array([last.as_py()], names.type), held[None])
            if len(starts) > 1:
                yield summed(names.take(pa.array(starts[:-1])), found[:-1])
            last, held = names[len(batch) - 1], found[-1].copy()
        if held is not None:
            yield summed(pa.array([last.as_py()], last.type), held[None])

    def summed(names: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
        ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        return pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))], names=[group, "sums"])

    schema = f"`{group}` {kind}, sums array<double>"
    parts = frame.select(group, F.array(*(c.cast("double") for c in columns.values())).alias("_x")).mapInArrow(add, schema)
    return parts.repartition(group).sortWithinPartitions(group).mapInArrow(together, schema)


def solved(t: np.ndarray, at: np.ndarray, goal: int, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of the columns at, from the sums of products t of the training side."""
    n, s = t[0, 0], t[0]
    c = t - np.outer(s, s) / n
    spread = np.sqrt(np.maximum(np.diag(c)[at] / n, 0))
    use = spread > np.sqrt(CONSTANT * np.maximum(1, (s[at] / n) ** 2))
    w = np.zeros(len(at))
    if use.any():
        j, d = at[use], spread[use]
        z, b = c[np.ix_(j, j)] / np.outer(d, d), c[j, goal] / d
        w[use] = (np.linalg.solve(z + alpha * np.eye(len(j)), b) if alpha > 0 else np.linalg.lstsq(z, b, rcond=None)[0]) / d
    return float(s[goal] / n - w @ s[at] / n), w


def left_out(sums: DataFrame, group: str, columns: list[str], mean: np.ndarray, deviation: np.ndarray, models: list[Ridge]) -> DataFrame:
    """group and fits: label, total_life, intercept and the weight of each column, fitted on all other groups."""
    p = len(columns) + 1
    upper = np.triu_indices(p)
    every = sums.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # a number per pair of columns
    total = np.array([r["v"] for r in every])
    place = {c: i + 1 for i, c in enumerate(columns)}
    plan = [(m.label, m.total_life, np.array([place[c] for c in m.features], int), place["_life" if m.total_life else "_direct"], m.alpha) for m in models]
    mean, deviation = np.r_[0.0, mean], np.r_[1.0, deviation]
    kind = pa.list_(pa.struct([("label", pa.string()), ("total_life", pa.bool_()), ("intercept", pa.float64()), ("weights", pa.list_(pa.float64()))]))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SOLVED) for b in batches for at in range(0, len(b), SOLVED)):
            rows = []
            for own in batch.column(1).flatten().to_numpy().reshape(len(batch), -1):
                t = np.zeros((p, p))
                t[upper] = total - own
                t = t + np.triu(t, 1).T
                fits = []
                for label, life, at, goal, alpha in plan:
                    base, w = solved(t, at, goal, alpha)
                    w = w * deviation[goal] / deviation[at]
                    weights = np.zeros(p)
                    weights[at] = w
                    fits.append({"label": label, "total_life": life, "intercept": float(base * deviation[goal] + mean[goal] - w @ mean[at]), "weights": weights[1:].tolist()})
                rows.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[group, "fits"])

    return sums.mapInArrow(fit, f"`{group}` {sums.schema[group].dataType.simpleString()}, fits array<struct<label:string,total_life:boolean,intercept:double,weights:array<double>>>")


def leave_one_out(frame: DataFrame, models: list[Ridge], target: str = "rul_seconds", group: str = "bearing", age: str = "observed_age_seconds") -> DataFrame:
    """The rows with model and predicted, once per model, each by coefficients that saw no row of its group."""
    if len({m.label for m in models}) != len(models):
        raise ContractError("labels of models must differ")
    features = list(dict.fromkeys(c for m in models for c in m.features))
    life = any(m.total_life for m in models)
    columns = {c: F.col(c) for c in features} | {"_direct": F.col(target).cast("double")} | ({"_life": F.col(age) + F.col(target)} if life else {})
    mean, deviation = scales(frame, columns, group)
    sums = kept(products(frame, columns, group, mean, deviation), "products")
    fits = left_out(sums, group, list(columns), mean, deviation, models).withColumnRenamed(group, "_group")
    rows = frame.join(fits, frame[group] == F.col("_group")).drop("_group").withColumn("_fit", F.explode("fits")).drop("fits")
    raw = reduce(lambda a, b: a + b, (F.col(c) * F.get("_fit.weights", F.lit(i)) for i, c in enumerate(features)), F.col("_fit.intercept"))
    predicted = clipped(raw)
    if life:
        predicted = F.when(F.col("_fit.total_life"), clipped(predicted - F.col(age))).otherwise(predicted)
    return rows.withColumn("predicted", predicted).withColumn("model", F.col("_fit.label")).drop("_fit")
