"""Random forests whose trees grow side by side, for predictions of other rows and for importances.

The trees are those of MLlib's regressor: bags drawn with replacement, features in at most `bins` bins cut at quantiles of the
training rows, a random set of features per node, the split of largest gain in variance of which both sides have enough rows,
means in leaves, predictions averaged over trees.  MLlib grows them level by level and keeps every node on the driver; here a
node with at most HELD training rows is finished by one task, from rows of a byte per feature.  Nodes with more are split
first by all tasks together, level by level, from sums per bin; only their splits come to the driver, and rows then go to the
nodes they fall into.  Training rows are held for a node at a time, rows to predict pass by in blocks.

Bags and sets of features are hashes of row, tree and place in the tree, so a tree doesn't depend on how rows or nodes lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import ceil, factorial, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import finite
from ..sources.scratch import kept
from .contracts import ContractError

#: Training rows of a node (as often as they are in its bag) that one task finishes, rows of a packed block, blocks predicted at once.
HELD, PACKED, TOGETHER = 400_000, 512, 128
#: Values that stand for a feature's rows in a task, and rows of such a task.
POINTS, DEALT = 512, 50_000
#: Parts of the forest that are grown at the same time, at least.
PARTS = 64
#: Predictions are whole multiples of 1 / UNIT of the target's range, so their sum is the same in any order.
UNIT = 2.0**36
#: Parameters that a forest here knows; others are MLlib's alone.
KNOWN = {"numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy", "maxBins"}
U = np.uint64


@dataclass(frozen=True)
class Plan:
    """What all trees share; mean and scale move the target to about [-1, 1], cuts are the upper ends of all but the last bin."""

    trees: int
    depth: int
    least: int
    subset: int
    seed: int
    mean: float
    scale: float
    cuts: tuple[np.ndarray, ...]

    @property
    def bins(self) -> int:
        return max(len(c) for c in self.cuts) + 1


def grows(params: dict) -> bool:
    """Whether a forest of these parameters can be grown here."""
    return set(params) <= KNOWN and 2 <= params.get("maxBins", 32) <= 256


def subset_size(strategy: str, n: int) -> int:
    """Features per node, as MLlib counts them."""
    named = {"all": n, "auto": ceil(n / 3), "onethird": ceil(n / 3), "sqrt": ceil(sqrt(n)), "log2": max(1, ceil(log2(n)))}
    if strategy in named:
        return named[strategy]
    return min(n, int(strategy)) if str(strategy).isdigit() else max(1, ceil(float(strategy) * n))


# Random numbers.

def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of x."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def keyed(seed: int, tree: int, kind: int) -> np.ndarray:
    return mixed(mixed(np.array([seed & 0xFFFFFFFF], U) + U(0x9E3779B97F4A7C15)) + np.array([2 * tree + kind], U))


#: Shares of rows that are in a bag at most 0, 1, 2, ... times.
IN_BAG = np.cumsum([np.exp(-1) / factorial(k) for k in range(16)])


def bag(plan: Plan, tree: int, ids: np.ndarray) -> np.ndarray:
    """How often each row is in the tree's bag."""
    drawn = mixed(ids.view(U) ^ keyed(plan.seed, tree, 0)) >> U(11)
    return np.searchsorted(IN_BAG, drawn * 2.0**-53, side="right").astype(float)


def chosen(plan: Plan, tree: int, places: np.ndarray) -> np.ndarray:
    """The features that each node looks at, a row per node, ascending."""
    n = len(plan.cuts)
    if plan.subset >= n:
        return np.broadcast_to(np.arange(n), (len(places), n))
    drawn = mixed(mixed(places ^ keyed(plan.seed, tree, 1))[:, None] + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return np.sort(np.argpartition(drawn, plan.subset - 1, axis=1)[:, : plan.subset], axis=1)


# Trees.

@dataclass
class Tree:
    """Nodes as arrays: feature (-1 of a leaf), last bin that goes left, left child (the right one follows), value and gain."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def find(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        while len(rows := rows[self.feature[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = self.child[at] + (x[rows, self.feature[at]] > self.cut[at])
        return node


def sums(plan: Plan, x: np.ndarray, node: np.ndarray, feature: np.ndarray, w: np.ndarray, wy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and sums of the target per node and bin of the one feature that each node looks at."""
    n = len(feature)
    cell = node * plan.bins + x[np.arange(len(node)), feature[node]]
    return tuple(np.bincount(cell, v, n * plan.bins).reshape(n, plan.bins) for v in (w, wy))


def best(plan: Plan, features: np.ndarray, tables: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none), last bin that goes left and gain of each node, from the sums of its features one after the other."""
    n = len(features)
    rows, feature, cut, score, none = np.arange(n), np.full(n, -1), np.zeros(n, int), np.full(n, -np.inf), np.zeros(n)
    for j, (w, wy) in enumerate(tables):
        left, ys = w.cumsum(axis=1), wy.cumsum(axis=1)
        all_w, all_y = left[:, -1:], ys[:, -1:]
        left, ys = left[:, :-1], ys[:, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.where((left >= plan.least) & (all_w - left >= plan.least), ys**2 / left + (all_y - ys) ** 2 / (all_w - left), -np.inf)
            if not j:
                none = (all_y**2 / all_w)[:, 0]
        at = found.argmax(axis=1)
        better = found[rows, at] > score
        feature[better], cut[better], score[better] = features[better, j], at[better], found[rows, at][better]
    gain = score - none
    feature[~(gain > 1e-12 * none)] = -1  # what rounding leaves of no gain
    return feature, cut, gain


def grown(plan: Plan, tree: int, place: int, x: np.ndarray, w: np.ndarray, y: np.ndarray) -> Tree:
    """The tree below a place (1: the root, children 2 * place and 2 * place + 1) of the rows there."""
    parts, places, node, wy, made = [], np.array([place], U), np.zeros(len(x), int), w * y, 1
    for depth in range(place.bit_length() - 1, plan.depth + 1):
        n = len(places)
        weight, total = np.bincount(node, w, n), np.bincount(node, wy, n)
        feature, cut, gain, child = np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n, int)
        wide = np.flatnonzero(weight >= 2 * plan.least) if depth < plan.depth else np.zeros(0, int)
        if len(wide):
            x, w, wy, node = held(wide, n, x, w, wy, node)
            looked = chosen(plan, tree, places[wide])
            feature[wide], cut[wide], gain[wide] = best(plan, looked, (sums(plan, x, node, looked[:, j], w, wy) for j in range(looked.shape[1])))
        split = np.flatnonzero(feature >= 0)
        child[split] = made + 2 * np.arange(len(split))
        made += 2 * len(split)
        parts.append((feature, cut, child, total / np.maximum(weight, 1), gain))
        if not len(split):
            break
        x, w, wy, node = held(np.searchsorted(wide, split), len(wide), x, w, wy, node)
        node = 2 * node + (x[np.arange(len(x)), feature[split][node]] > cut[split][node])
        places = (2 * places[split][:, None] + np.arange(2, dtype=U)).ravel()
    return Tree(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def held(nodes: np.ndarray, n: int, x: np.ndarray, w: np.ndarray, wy: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of some of n nodes, which are numbered anew."""
    number = np.full(n, -1)
    number[nodes] = np.arange(len(nodes))
    node = number[node]
    stay = node >= 0
    return (x, w, wy, node) if stay.all() else (x[stay], w[stay], wy[stay], node[stay])


# Rows.

def cut_points(train: DataFrame, features: list[str], bins: int, n: int) -> tuple[np.ndarray, ...]:
    """Per feature the middles between its values if they are at most bins, else quantiles of its rows.

    A task sums POINTS values up per feature, of as many rows each; those of a feature meet in one task.  Rows are dealt by _id,
    so the result doesn't depend on how they lay."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        for i in range(len(features) if rows else 0):
            value, count = np.unique(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in rows]), return_counts=True)
            upto = count.cumsum()
            at = np.unique(np.searchsorted(upto, np.arange(1, POINTS + 1) * (upto[-1] / POINTS) - 0.5)) if len(value) > POINTS else np.arange(len(value))
            yield pa.RecordBatch.from_pydict({"feature": np.full(len(at), i, np.int32), "value": value[at], "n": np.diff(np.r_[0, upto[at]])})

    def cut(key, rows):
        import pandas as pd

        upto = rows.groupby("value")["n"].sum().cumsum()
        value = upto.index.to_numpy()
        if len(value) <= bins:
            cuts = value[:-1] + (value[1:] - value[:-1]) / 2
        else:
            cuts = np.unique(value[np.searchsorted(upto.to_numpy(), np.arange(1, bins) * (upto.iloc[-1] / bins))])
        return pd.DataFrame({"feature": [key[0]], "cuts": [cuts]})

    rows = train.select("_id", *(F.col(f).cast("double").alias(f) for f in features)).repartition(1 + n // DEALT, "_id").drop("_id")
    made = rows.mapInArrow(summed, "feature int, value double, n long").groupBy("feature").applyInPandas(cut, "feature int, cuts array<double>").collect()
    return tuple(np.array(r["cuts"], float) for r in sorted(made, key=lambda r: r["feature"]))


def packed(rows: DataFrame, features: list[str], plan: Plan, target: str | None = None) -> DataFrame:
    """Rows in blocks: ids, bins (a byte each) and, of training rows, targets; written, as every part of the forest reads them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            x = np.empty((len(batch), len(features)), np.uint8)
            for i, f in enumerate(features):
                if np.isnan(v := column(f)).any():
                    raise ValueError(f"{f} has nulls or NaN")
                x[:, i] = np.searchsorted(plan.cuts[i], v)
            ids, y = column("_id"), (column("_y") - plan.mean) / plan.scale
            cuts = [slice(a, a + PACKED) for a in range(0, len(batch), PACKED)]
            yield pa.RecordBatch.from_pydict({"ids": [ids[s].tobytes() for s in cuts], "x": [x[s].tobytes() for s in cuts], "y": [y[s].tobytes() if target else b"" for s in cuts]}, pa.schema([(c, pa.binary()) for c in ("ids", "x", "y")]))

    y = F.col(target).cast("double") if target else F.lit(0.0)
    return kept(rows.select("_id", y.alias("_y"), *(F.col(f).cast("double").alias(f) for f in features)).mapInArrow(pack, "ids binary, x binary, y binary"), "blocks")


def unpacked(plan: Plan, blocks: list[tuple]) -> tuple[np.ndarray, ...]:
    ids, x, y = (np.frombuffer(b"".join(c), kind) for c, kind in zip(zip(*blocks, strict=True), (np.int64, np.uint8, float), strict=True))
    return ids, x.reshape(-1, len(plan.cuts)), y


def numbered(train: DataFrame) -> DataFrame:
    """Adds _id, a hash of the row; equal rows are told apart by counting them."""
    plain = [c for c, t in train.dtypes if "map<" not in t and "variant" not in t]
    rows = train.withColumn("_hash", F.xxhash64(*plain))
    again = F.row_number().over(Window.partitionBy("_hash").orderBy("_hash"))
    return rows.withColumn("_id", F.xxhash64("_hash", again)).drop("_hash")


# Nodes with more rows than a task holds.

def shared_levels(blocks: DataFrame, plan: Plan) -> tuple[dict[int, dict[int, tuple]], dict[tuple[int, int], float]]:
    """The splits (feature, bin, gain) of all nodes with more than HELD rows by tree and place, and the values of those that are leaves.

    A task adds up its rows per node, feature and bin; sums of a node meet in one task, which picks the split."""
    tops: dict[int, dict[int, tuple]] = {t: {} for t in range(plan.trees)}
    leaves: dict[tuple[int, int], float] = {}
    open_ = {t: [1] for t in tops}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not blocks:
            return
        ids, x, y = unpacked(plan, blocks)
        for t, at in open_.items():
            w = bag(plan, t, ids)
            top, places = laid_out(tops[t])
            number = np.full(len(places), -1)
            for i, p in enumerate(at):
                number[places.index(p)] = i
            node = number[top.find(x)]
            some = (w > 0) & (node >= 0)
            looked = chosen(plan, t, np.array(at, U))
            tables = [sums(plan, x[some], node[some], looked[:, j], w[some], (w * y)[some]) for j in range(looked.shape[1])]
            made = np.array(tables).transpose(2, 0, 1, 3)  # node, feature, kind, bin
            yield pa.RecordBatch.from_pydict({"tree": np.full(len(at), t, np.int32), "place": np.array(at, np.int64), "part": np.full(len(at), TaskContext.get().partitionId(), np.int32), "sums": pa.array([m.tobytes() for m in made], pa.binary())})

    def pick(key, rows):
        import pandas as pd

        t, p = map(int, key)
        made = sum(np.frombuffer(b) for b in rows.sort_values("part")["sums"]).reshape(plan.subset, 2, 1, plan.bins)
        feature, cut, gain = (v[0] for v in best(plan, chosen(plan, t, np.array([p], U)), ((m[0], m[1]) for m in made)))
        weight, total = made[0].sum(axis=(1, 2))
        left = 0.0, 0.0
        if feature >= 0:
            mine = made[list(chosen(plan, t, np.array([p], U))[0]).index(feature)]
            left = tuple(mine[:, 0, : cut + 1].sum(axis=1))
        return pd.DataFrame([(t, p, feature, cut, gain, weight, total, *left)])

    blocks = blocks.repartition(2 * blocks.sparkSession.sparkContext.defaultParallelism)
    while open_:
        parts = blocks.mapInArrow(count, "tree int, place long, part int, sums binary")
        found = parts.groupBy("tree", "place").applyInPandas(pick, "tree int, place long, feature int, cut int, gain double, weight double, total double, left double, left_total double").collect()
        open_ = {}
        for r in sorted(found, key=lambda r: (r["tree"], r["place"])):
            t, p = r["tree"], r["place"]
            if r["feature"] < 0 or p.bit_length() > plan.depth:
                leaves[t, p] = r["total"] / r["weight"]
                continue
            tops[t][p] = r["feature"], r["cut"], r["gain"]
            for side, weight, total in ((2 * p, r["left"], r["left_total"]), (2 * p + 1, r["weight"] - r["left"], r["total"] - r["left_total"])):
                if weight > HELD and side.bit_length() > plan.depth:
                    leaves[t, side] = total / weight
                elif weight > HELD:
                    open_.setdefault(t, []).append(side)
    return tops, leaves


def laid_out(top: dict[int, tuple]) -> tuple[Tree, list[int]]:
    """Shared splits as a tree, and the place of each of its nodes."""
    places = [1]
    rows = []
    for p in places:  # grows while it is read
        feature, cut, gain = top.get(p, (-1, 0, 0.0))
        rows.append((feature, cut, len(places), 0.0, gain))
        if p in top:
            places += [2 * p, 2 * p + 1]
    return Tree(*(np.array(c) for c in zip(*rows, strict=True))), places


def dealt(blocks: DataFrame, plan: Plan, tops: dict[int, dict[int, tuple]], leaves: dict, train: bool) -> DataFrame:
    """key (tree and place) and the rows of each block that fall there; training rows only if they are in the tree's bag."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for some in (rows[a : a + TOGETHER] for a in range(0, len(rows), TOGETHER)):
                ids, x, y = unpacked(plan, some)
                for t, splits in tops.items():
                    top, places = laid_out(splits)
                    node = top.find(x)
                    if train:
                        node = np.where(bag(plan, t, ids) > 0, node, -1)
                    out = []
                    for i in np.unique(node[node >= 0]):
                        if not train or (t, places[i]) not in leaves:
                            at = np.flatnonzero(node == i)
                            out += [((t << 32) + places[i], *(v[at[a : a + PACKED]].tobytes() if len(v) else b"" for v in (ids, x, y))) for a in range(0, len(at), PACKED)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["key", "ids", "x", "y"])

    return blocks.repartition(2 * blocks.sparkSession.sparkContext.defaultParallelism).mapInArrow(deal, "key long, ids binary, x binary, y binary")


# The forest.

def forest(train: DataFrame, test: DataFrame | None, features: list[str], target: str, seed: int, params: dict) -> tuple[DataFrame, Plan]:
    """Sums over trees of the predictions of test rows by _id, in units, or without test rows gains by tree (as id) and feature."""
    train = kept(numbered(train.select("*")), "training")
    y = F.col(target).cast("double")
    n, bad, mean, low, high = train.agg(F.count(F.lit(1)), F.count_if(~finite(y)), F.avg(y), F.min(y), F.max(y)).first()
    if not n or bad:
        raise ContractError(f"{bad} targets aren't finite" if n else "no training rows")
    trees = params.get("numTrees", 20)
    scale = 2.0 ** ceil(log2(max(high - mean, mean - low) or 1.0))
    mean = round(mean / scale * 2**20) / 2**20 * scale  # its last digits depend on the order of rows
    plan = Plan(trees, params.get("maxDepth", 5), params.get("minInstancesPerNode", 1), subset_size("all" if trees == 1 and params.get("featureSubsetStrategy") == "auto" else params.get("featureSubsetStrategy", "auto"), len(features)),
                seed, mean, scale, cut_points(train, features, min(params.get("maxBins", 32), max(2, n)), n))
    kinds = [(packed(train, features, plan, target), 0), *([(packed(test, features, plan), 1)] if test is not None else [])]
    parts = max(PARTS, 2 * train.sparkSession.sparkContext.defaultParallelism)
    weighs = test is None
    tops: dict[int, dict[int, tuple]] = {}
    leaves: dict[tuple[int, int], float] = {}
    if n > HELD:  # every node has its own rows
        tops, leaves = shared_levels(kinds[0][0], plan)
        rows = [dealt(b, plan, tops, leaves, not kind).withColumn("kind", F.lit(kind)) for b, kind in kinds]
        parts = max(parts, n * trees // 8_000_000)
    else:  # every part of the forest has all rows
        each = max(1, trees // parts)
        rows = [b.withColumn("kind", F.lit(kind)).withColumn("key", F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // each)).cast("array<long>"))) for b, kind in kinds]
    rows = [r.select("key", "kind", "ids", "x", "y") for r in rows]
    rows = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = lambda ids, feature, value: pa.RecordBatch.from_pydict({"id": np.asarray(ids, np.int64), "feature": np.broadcast_to(feature, len(ids)).astype(np.int32), "value": value})
        for key, own in groupby(blocks, lambda r: r[0]):
            todo = [(key >> 32, key & 0xFFFFFFFF)] if tops else [(t, 1) for t in range(key * each, min(trees, (key + 1) * each))]
            made = [constant(leaves[at]) for at in todo if at in leaves]
            for kind, mine in groupby(own, lambda r: r[1]):
                if not kind:
                    ids, x, y = unpacked(plan, [r[2:] for r in mine])
                    order = np.argsort(ids, kind="stable")
                    ids, x, y = ids[order], x[order], y[order]
                    for t, place in todo:
                        w = bag(plan, t, ids)
                        tree = grown(plan, t, place, x[w > 0], w[w > 0], y[w > 0])
                        if weighs:
                            gains = np.bincount(tree.feature + 1, tree.gain, len(features) + 1)[1:]
                            yield out(np.full(len(features), t), np.arange(len(features)), gains)
                        else:
                            made.append(tree)
                    continue
                while some := [r[2:] for _, r in zip(range(TOGETHER), mine)]:  # noqa: B905
                    ids, x, _ = unpacked(plan, some)
                    yield out(ids, -1, sum(np.rint(tree.value[tree.find(x)] * UNIT) for tree in made))

    found = rows.repartition(parts, "key").sortWithinPartitions("key", "kind").mapInArrow(grow, "id long, feature int, value double")
    if weighs and tops:
        top = [(t, f, g) for t, splits in tops.items() for f, _, g in splits.values()]
        found = found.unionByName(train.sparkSession.createDataFrame([(t, int(f), float(g)) for t, f, g in top], "id long, feature int, value double"))
    return found, plan


def constant(value: float) -> Tree:
    return Tree(np.array([-1]), np.zeros(1, int), np.zeros(1, int), np.array([value]), np.zeros(1))


def predictions(train: DataFrame, test: DataFrame, features: list[str], target: str, seed: int = 42, **params) -> DataFrame:
    """test with raw, the mean over the trees of a forest of the training rows."""
    asked = kept(test.withColumn("_id", F.monotonically_increasing_id()), "asked")
    found, plan = forest(train, asked, features, target, seed, params)
    found = found.groupBy(F.col("id").alias("_id")).agg((F.sum("value") / (plan.trees * UNIT) * plan.scale + plan.mean).alias("raw"))
    return kept(asked.join(found, "_id").drop("_id"), "predictions")


def importances(train: DataFrame, features: list[str], target: str, seed: int = 42, **params) -> DataFrame:
    """feature and importance, largest first: shares of each tree's gain, averaged over trees."""
    found, _ = forest(train, None, features, target, seed, params)
    # added up in the order of sizes, whatever tasks they come from
    added = lambda c: F.aggregate(F.array_sort(F.collect_list(c)), F.lit(0.0), lambda a, v: a + v)
    shared = lambda rows, keys: rows.groupBy(*keys).agg(F.collect_list(F.struct("feature", "value")).alias("_all"), added("value").alias("_sum")).select(*keys, F.inline("_all"), "_sum").withColumn("value", F.when(F.col("_sum") > 0, F.col("value") / F.col("_sum")).otherwise(0.0))
    rows = shared(found.groupBy("id", "feature").agg(added("value").alias("value")), ["id"])
    rows = shared(rows.groupBy("feature").agg(added("value").alias("value")), [])
    return rows.select(F.get(F.array(*map(F.lit, features)), F.col("feature")).alias("feature"), F.col("value").alias("importance")).orderBy(F.desc("importance"), "feature")
