"""Toxicity by non-negative positive-unlabelled learning.

A linear model on hashed words is trained with numpy from confirmed toxic texts and unlabelled ones; no text is learned
from as a clean one.  The risk of the unlabelled part is corrected by the class prior: prior * loss(positives as
1) + max(0, loss(unlabelled as 0) - prior * loss(positives as 0)); where the second term falls below zero a step goes
the other way.  Features are words and words' first bytes, valued by their counts; only those that are clearly more
frequent among positives take part.

Unlabelled are all texts that may be used, whether they have a label or not.  Their statistics, by which features are
chosen, and the risk's gradient are sums over all of them, added up by Spark.  Two bounded samples come to the driver:
about POSITIVES toxic rows, which are all that the model learns from labels, and about START unlabelled rows, from which
only the first weights are fitted; FULL steps over all rows follow.

The prior, unless it is given, is the share of toxic rows among all labelled rows that may be used; this one number is
all that labels of clean texts are counted for.

Labels with null ids or null marks are ignored, repeated ones count as toxic if any is; without usable positives every
score is near 0, without unlabelled rows near 1.  Null and empty texts are scored by the intercept; equal texts get equal scores; long texts
are read whole; extra columns are not carried, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import emit, schema_of, sliced, texts_of, written
from .hashing import PUNCTUATION, SPACES, beginnings

SLOTS = 1 << 18
POSITIVES, START = 2000, 5000
LEAST_COUNT, SCREEN = 3, 3.0
EPOCHS, RATE, DECAY = 300, 0.05, 5e-3
#: Steps over all unlabelled rows and their length, as a part of the step by the diagonal second derivative.
FULL, PART = 12, 0.15
#: Lengths of the words' beginnings that are features, in bytes.
LENGTHS = (4, 5, 6, 7, 8)
PREDICT = 0.7
GAPS = SPACES + PUNCTUATION
AT_ONCE = 2 << 20


def slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct slots of each text in one array, their values, and where each text's end.

    A slot stands for a word or a word's first bytes; its value is the logarithm of one more than its count."""
    h, owner, _ = beginnings(texts, GAPS, LENGTHS)
    both, counts = np.unique(owner * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64), return_counts=True)
    return (both % SLOTS).astype(np.int32), np.log1p(counts).astype(np.float32), np.searchsorted(both, np.arange(len(texts) + 1) * SLOTS)


def word_slots(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, slots (int32) and their values (float32), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, AT_ONCE):
            found, values, ends = slots(texts_of(batch, text))
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())  # noqa: E731, B023
            yield emit(batch, keep, {"slots": cut(found), "counts": cut(values)})

    return df.select(*keep, text).mapInArrow(run, schema_of(df, keep, "slots binary, counts binary"))


class Model:
    """Weights by slot, the intercept and the prior."""

    def __init__(self, weights: np.ndarray, intercept: float, prior: float):
        self.weights, self.intercept, self.prior = weights.astype(np.float32), intercept, prior

    def scores(self, found: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.r_[0.0, np.cumsum(self.weights[found] * values, dtype=np.float64)]
        z = total[ends[1:]] - total[ends[:-1]] + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


Rows = list[tuple[np.ndarray, np.ndarray]]


def stacked(rows: Rows, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the chosen features of rows; number: the column of each slot, or -1."""
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x, _ in rows])
    column, values = (np.concatenate([x[k] for x in rows]) if rows else np.empty(0, np.int32) for k in (0, 1))
    column = number[column]
    return row[column >= 0], column[column >= 0].astype(np.int32), values[column >= 0].astype(np.float64)


def step_of(z: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Derivative of the corrected risk by each row's z, positives first; other way round where the rest is below 0."""
    s, as_zero = 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.logaddexp(0, z)
    if as_zero[n_p:].mean() - prior * as_zero[:n_p].mean() >= 0:
        return np.r_[np.full(n_p, -prior / n_p), s[n_p:] / n_u]
    return np.r_[prior * s[:n_p] / n_p, -s[n_p:] / n_u]


def first_fit(positive: Rows, unlabelled: Rows, number: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch adaptive steps on rows in memory."""
    n_p, n_u, size = len(positive), len(unlabelled), int(number.max()) + 1
    row, column, values = stacked([*positive, *unlabelled], number)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, EPOCHS + 1):
        g = step_of(np.bincount(row, w[column] * values, n_p + n_u) + b, n_p, n_u, prior)
        grad = np.r_[np.bincount(column, g[row] * values, size) + DECAY * prior * w, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def added_up(found: DataFrame, size: int) -> np.ndarray:
    """Sums of the columns a and b by k, from 0 to size - 1."""
    out = np.zeros((size, 2))
    for r in found.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():  # at most a row a feature
        out[r["k"]] = r["a"], r["b"]
    return out


SUMS = "k int, a double, b double"


def as_sums(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    k = np.flatnonzero((a != 0) | (b != 0))
    return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(a[k]), pa.array(b[k])], names=["k", "a", "b"])


def slot_sums(docs: DataFrame, wanted: np.ndarray, text: str) -> np.ndarray:
    """Sums and sums of squares of the wanted slots' values over all rows; last, the number of rows."""
    number = np.full(SLOTS, -1)
    number[wanted] = np.arange(len(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(len(wanted) + 1), np.zeros(len(wanted) + 1)
        for batch in sliced(batches, text, AT_ONCE):
            found, values, _ = slots(texts_of(batch, text))
            column, values = number[found], values.astype(np.float64)
            column, values = column[column >= 0], values[column >= 0]
            a[:-1] += np.bincount(column, values, len(wanted))
            b[:-1] += np.bincount(column, values * values, len(wanted))
            a[-1] += len(batch)
        yield as_sums(a, b)

    return added_up(docs.select(text).mapInArrow(run, SUMS), len(wanted) + 1)


def blocks(docs: DataFrame, number: np.ndarray, text: str) -> DataFrame:
    """The chosen features of all rows, packed: rows, and row, column and value of their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, AT_ONCE):
            found, values, ends = slots(texts_of(batch, text))
            column, row = number[found], np.repeat(np.arange(len(batch), dtype=np.int32), np.diff(ends))
            keep = column >= 0
            packed = [x[keep].tobytes() for x in (row, column.astype(np.int32), values)]
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["rows", "row", "column", "value"])

    return docs.select(text).mapInArrow(run, "rows int, row binary, column binary, value binary")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for n, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield n, *(np.frombuffer(x, kind) for x, kind in zip(packed, (np.int32, np.int32, np.float32), strict=True))


def full_sums(table: DataFrame, w: np.ndarray, b: float) -> np.ndarray:
    """Over all unlabelled rows taken as 0: first and second derivatives of the loss by weight, then by the intercept; last, loss and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
        for n, row, column, value in opened(batches):
            z = np.bincount(row, w[column] * value, n) + b
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            first[:-2] += np.bincount(column, s[row] * value, len(w))
            second[:-2] += np.bincount(column, (s * (1 - s))[row] * value * value, len(w))
            first[-2:] += s.sum(), np.logaddexp(0, z).sum()
            second[-2:] += (s * (1 - s)).sum(), n
        yield as_sums(first, second)

    return added_up(table.mapInArrow(run, SUMS), len(w) + 2)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", prior: float | None = None) -> Model:
    """A model from the toxic labels and the texts of rows for which allowed (a condition on the key) holds."""
    nothing = np.zeros(SLOTS)
    marks = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & allowed).groupBy(key).agg(F.max("toxic").alias("toxic"))
    sizes = marks.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("toxic") == 1).alias("yes")).first()
    prior = min(0.99, sizes["yes"] / max(1, sizes["all"])) if prior is None else prior
    place = lambda salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    usable = docs.select(key, text).where(allowed)
    chosen = F.broadcast(marks.where(F.col("toxic") == 1).where(place("p") < POSITIVES / max(1, sizes["yes"])).select(key))  # about POSITIVES numbers
    pick = lambda rows: [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in sorted(rows.collect(), key=lambda r: (r[key] is not None, r[key] or 0, r["slots"], r["counts"]))]
    positive = pick(word_slots(usable.join(chosen, key), [key], text))
    if not positive:
        return Model(nothing, -30.0, 0.0)
    n_p = len(positive)
    found, values = (np.concatenate([x[k] for x in positive]) for k in (0, 1))
    count = np.bincount(found, minlength=SLOTS)
    wanted = np.flatnonzero(count >= LEAST_COUNT)
    sums = slot_sums(usable, wanted, text)
    total = int(sums[-1, 0])
    if not total:
        return Model(nothing, 30.0, 1.0)
    # features whose mean among positives is over that of unlabelled rows by SCREEN standard errors
    mean_p, mean_u = np.bincount(found, values, SLOTS)[wanted] / n_p, sums[:-1, 0] / total
    spread = sums[:-1, 1] / total - mean_u**2 + 1 / total
    wanted = wanted[mean_p - mean_u > SCREEN * np.sqrt(np.maximum(0, spread) * (1 / n_p + 1 / total))]
    number = np.full(SLOTS, -1)
    number[wanted] = np.arange(len(wanted))
    if not len(wanted):
        return Model(nothing, float(np.log(prior / (1 - prior))), prior)
    table = written(blocks(usable, number, text), "toxicity-blocks")
    some = pick(word_slots(usable.where(place("u") < START / total), [key], text)) or positive
    w, b = first_fit(positive, some, number, prior)
    row, column, values = stacked(positive, number)
    for _ in range(FULL):
        sums, z = full_sums(table, w, b), np.bincount(row, w[column] * values, n_p) + b
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        rest = sums[-1, 0] / total - prior * np.logaddexp(0, z).mean()
        if rest >= 0:
            slope = np.r_[sums[:-2, 0] / total - prior * np.bincount(column, values, len(w)) / n_p, sums[-2, 0] / total - prior]
        else:
            slope = np.r_[prior * np.bincount(column, s[row] * values, len(w)) / n_p - sums[:-2, 0] / total, prior * s.mean() - sums[-2, 0] / total]
        curve = np.r_[sums[:-2, 1], sums[-2, 1]] / total + 1e-4 * prior
        slope[:-1] += DECAY * prior * w
        move = PART * slope / (curve + DECAY * prior)
        w, b = w - np.clip(move[:-1], -0.25, 0.25), b - float(np.clip(move[-1], -0.25, 0.25))
    weights = np.zeros(SLOTS)
    weights[wanted] = w
    return Model(weights, b, prior)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, score (0 to 1) and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, AT_ONCE):
            s = model.scores(*slots(texts_of(batch, text)))
            yield emit(batch, keep, {"score": pa.array(s, pa.float64()), "predicted": pa.array(s >= PREDICT).cast(pa.int32())})

    return docs.select(*keep, text).mapInArrow(run, schema_of(docs, keep, "score double, predicted int"))
