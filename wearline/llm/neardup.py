"""MinHash near-dedup with bottom-k sketches from one hash function.

Every text is the set of hashes of its five-word shingles; texts with equal sets are one class.  A class keeps the
KEEP least hashes of its set, its bottom-k sketch.  Of the first INDEX, the values that are rarest in the corpus go
into inverted lists (see postings()).  Classes that share a list are candidates; the union of two sketches estimates
the similarity and drops those far below the limit; the rest is verified on the full sets of both whole texts.

Lists are worked through without writing out their pairs.  First every class is paired with one pivot of its lists,
that of most of them (a hash picks pivots), and verified; the links make components.  Lists that still hold several
components are then compared in cells of bounded size: a task has a cell's sketches, and members with partners that the
estimate leaves go on to be verified in the same cells.  Each pass sends a text once to each cell that needs it.

What can be missed, by the bounds that the tests recompute: of INDEX values, classes at the limit of 75 percent share
27 on average if their sets are of equal size, and 24 if one set holds the other, which is the worst case; fewer than
OVERLAP with a probability below 1e-6 (5e-7) whatever the sizes of lists.  The estimate errs by more than its six
deviations with a probability below 1e-8.  Sets of up to INDEX shingles are never missed.

An empty or null text has no shingles and no links of its own; fewer than five words are one shingle of the whole sequence; rows
with a null id are left apart (component null, kept); rows that share an id count as one document with all their
texts' links: their texts get numbers of their own beyond all ids, and components that share an id are joined afterwards;
repeated rows share a component; the least id of a component stays; a text's length is not limited.
near_duplicates() returns its own columns alone; one_of_each() passes all columns, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, numbered, schema_of, sliced, spread_join, texts_of, written
from .components import components
from .hashing import shingles

WORDS, LIMIT = 5, (75, 100)
#: Least hashes kept, of these looked at for lists, how many of them a pair must share, and pivots of a list.
KEEP, INDEX, OVERLAP, PIVOTS = 128, 32, 11, 6
#: Members and shingles of a block of a list, on average; they bound what a task holds, lists of any length are cut.
BLOCK, BLOCK_SHINGLES = 768, 1 << 20
#: Bits of the filter that texts pass before they are shuffled, in rows of 4 KB: 16 MB at any size of the input.
FILTER_BITS = 1 << 27
#: Bytes of text that a task turns into shingles at once.
AT_ONCE = 2 << 20


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_digest, index (the least INDEX hashes) and sketch (31 bits of the least KEEP) of every row, and
    own, a hash of the text, which tells the texts of an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, AT_ONCE):
            sets = shingles(texts_of(batch, text), WORDS)
            index, sketch = [s[:INDEX] for s in sets], [s[:KEEP] >> 32 for s in sets]
            lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in parts])], pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *parts]), kind))
            yield emit(batch, [key, "own"], {
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "index": lists(index, pa.int64()), "sketch": lists(sketch, pa.int32()),
            })

    return docs.select(key, F.xxhash64(text).alias("own"), text).mapInArrow(run, schema_of(docs, [key], "own bigint, n_shingles bigint, set_digest binary, index array<bigint>, sketch array<int>"))


def postings(classes: DataFrame) -> DataFrame:
    """Each class's values that go into inverted lists: node, n and values.

    Of the least INDEX hashes, ordered from the rarest in the corpus, the first INDEX - OVERLAP + 1: two classes with
    OVERLAP of them in common have one of these in common.  Sets of fewer hashes ask for 75 percent of their own.  A
    value of one class alone counts as rarest and makes no list, so texts that share a common passage and are
    otherwise their own have no list at all."""
    values = classes.select("node", "n", F.explode("index").alias("value"))
    often = written(values.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "values")
    held = F.array_sort(F.collect_list(F.struct("often", "value")))  # at most INDEX values
    rows = spread_join(values, often, ["value"], "often").groupBy("node", "n").agg(held.alias("held"))
    size = F.least(F.col("n"), F.lit(INDEX)).cast("int")
    first = size - F.least(F.lit(OVERLAP), F.ceil(size * LIMIT[0] / LIMIT[1]).cast("int")) + 1
    room = F.greatest(F.lit(0), first - (size - F.size("held")))
    return rows.select("node", "n", F.slice("held", F.lit(1), room)["value"].alias("values")).where(F.size("values") > 0)


def sizes_fit(a: str, b: str):
    """Whether sets of these sizes can be as similar as asked."""
    return F.least(F.col(a), F.col(b)) * LIMIT[1] >= F.greatest(F.col(a), F.col(b)) * LIMIT[0]


def texts_needed(docs: DataFrame, need: DataFrame, key: str, text: str) -> DataFrame:
    """node and text of the rows whose ids are in need.

    A bitmap of hashed ids, of fixed size and so broadcast, drops most other rows before texts are shuffled; the join
    after it is exact, however full the bitmap is."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    rows_of, place = lambda c: F.shiftright(bit(c), 15), lambda c: bit(c).bitwiseAND(F.lit(32767))
    need = need.distinct()
    bitmap = need.groupBy(rows_of("node").alias("row")).agg(F.bitmap_construct_agg(place("node")).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(F.col("place"), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = docs.select(F.col(key).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", rows_of("node")).withColumn("place", place("node"))
    near = rows.join(F.broadcast(bitmap), "row").where(F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("place").bitwiseAND(F.lit(7)))), F.lit(2)) == 1)
    # an inner join: a semi join would be moved below the bitmap
    return near.select("node", "text").join(need.hint("merge"), "node")


def pivot_links(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (a, b) whose full sets are as similar as asked; b is a pivot of a, n the size of a's set.

    Members of a pivot are dealt over blocks; a block has the pivot's text first and keeps its set alone, while the
    members pass by."""
    total = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")), "pivots")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    members = spread_join(pairs.select("a", "b"), total.select("b", "size", blocks.alias("blocks")), ["b"], "size")
    members = members.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.pmod(F.xxhash64("a"), "blocks").cast("int").alias("block"), F.lit(1).alias("place"))
    heads = total.select(F.col("b").alias("node"), F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(0).alias("place"))
    found = written(members.unionByName(heads), "pivot-cells")
    rows = found.join(texts_needed(docs, found.select("node"), key, text).hint("merge"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, head = None, []
        for batch in sliced(batches, "text", AT_ONCE):
            a, b, good = [], [], []
            columns = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("node", "pivot", "block", "place"))
            for node, pivot, block, place, s in zip(*columns, shingles(texts_of(batch, "text"), WORDS), strict=True):
                if (pivot, block) != cell:
                    cell, head = (pivot, block), []
                if not place:
                    head.append(s)  # more than one if rows share the id
                    continue
                a.append(node)
                b.append(pivot)
                good.append(any(similar(s, h) for h in head))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    rows = rows.select("node", "pivot", "block", "place", "text").repartition("pivot", "block").sortWithinPartitions("pivot", "block", "place")
    return rows.mapInArrow(run, "a bigint, b bigint, good boolean").where("good").select("a", "b").distinct()


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sorted sets are as similar as asked."""
    if not len(s) or not len(t) or min(len(s), len(t)) * LIMIT[1] < max(len(s), len(t)) * LIMIT[0]:
        return False
    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return LIMIT[1] * both >= LIMIT[0] * (len(s) + len(t) - both)


def labelled(posted: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Postings with the component of their node; a node without links is its own."""
    if parts is None:
        return posted.withColumn("part", F.col("node"))
    return posted.join(parts.select("node", F.col("component").alias("part")).hint("merge"), "node", "left").withColumn("part", F.coalesce("part", "node"))


def mixed_lists(posted: DataFrame, keys: list[str], *more) -> DataFrame:
    """Lists that hold several components, with their size."""
    return posted.groupBy(*keys).agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("size"), *more).where("low != high").drop("low", "high")


def pivot_pairs(posted: DataFrame) -> DataFrame:
    """For each class, of the PIVOTS pivots of its lists the one that shares most lists with it, if that is in another
    component.  A pivot is the least of a list by a hash of the class alone, so a
    family of near copies has few of them."""
    picks = [F.min_by(F.struct("node", "n", "part"), F.xxhash64(F.lit(k), "node")).alias(f"p{k}") for k in range(PIVOTS)]
    lists = written(mixed_lists(posted, ["value"], *picks).select("value", "size", F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("pivots")), "pivot-lists")
    pairs = spread_join(posted.select("node", "n", "part", "value"), lists, ["value"], "size").withColumn("p", F.explode("pivots"))
    pairs = pairs.select("node", "n", "part", F.col("p.node").alias("pivot"), F.col("p.n").alias("m"), F.col("p.part").alias("other")).where((F.col("part") != F.col("other")) & sizes_fit("n", "m"))
    counts = pairs.groupBy(F.col("node").alias("a"), "n", F.col("pivot").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    return counts.groupBy("a", "n").agg(F.max_by("b", F.struct("lists", "b")).alias("b"))


def cells(posted: DataFrame, sketch: DataFrame) -> DataFrame:
    """Members of the lists that hold several components, with their sketches, in cells of about BLOCK members a side.

    A long list is cut into blocks by a hash of the class, and a cell holds two of them (or one with itself).  below has
    the class's other lists of smaller value, so that a pair is looked at in the first of its common lists alone."""
    lists = written(mixed_lists(posted, ["value"], F.sum("n").alias("total")), "lists")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    rows = spread_join(posted, lists.select("value", "size", blocks.alias("blocks")), ["value"], "size").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("below", F.filter("values", lambda v: v < F.col("value"))).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "part", "n", "below")
    return together(rows.join(sketch.hint("merge"), ["node", "n"]))


def together(rows: DataFrame) -> DataFrame:
    """Rows of a cell one after the other in one task."""
    return rows.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two different sets share, by products of 0/1 matrices over pieces of the shared values."""
    m = len(sets)
    values, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared, out = np.repeat(np.arange(m), [len(s) for s in sets]), often > 1, np.zeros((m, m), np.float32)
    place, keep = (np.cumsum(shared) - 1)[code], shared[code]
    order = np.argsort(place[keep], kind="stable")
    place, owner, step = place[keep][order], owner[keep][order], max(64, (1 << 22) // m)
    for at in range(0, end := int(shared.sum()), step):
        lo, hi = np.searchsorted(place, [at, at + step])
        held = np.zeros((m, min(step, end - at)), np.float32)
        held[owner[lo:hi], place[lo:hi] - at] = 1
        out += held @ held.T
    return out


def possible(n: np.ndarray, sketch: list[np.ndarray]) -> np.ndarray:
    """Pairs whose union sketch doesn't rule the similarity out by six deviations.

    What both sketches cover of the union is drawn from it without replacement; where it is the whole union, nothing is
    left to chance.  Two more values are allowed for, since sketches hold 31 bits of each hash."""
    top = np.array([s[-1] if size > KEEP else np.iinfo(np.int32).max for s, size in zip(sketch, n, strict=True)], np.int64)
    covered = np.stack([np.searchsorted(s, np.minimum(top, t), side="right") for s, t in zip(sketch, top, strict=True)])
    shared = overlaps(sketch)
    union, limit = covered + covered.T - shared, LIMIT[0] / LIMIT[1]
    deviation = np.sqrt(limit * (1 - limit) / union * np.maximum(0, 1 - union * (1 + limit) / (n[:, None] + n[None, :])))
    return shared + 2 >= (limit - 6 * deviation) * union


def in_groups(batches: Iterator[pa.RecordBatch], text: str | None = None) -> Iterator[tuple[tuple, list[tuple[pa.RecordBatch, list | None]]]]:
    """Cell and its rows, in pieces; with text also the shingles of the rows, so that texts are let go piece by piece."""
    last, held = None, []
    for batch in sliced(batches, text, AT_ONCE) if text else batches:
        if not len(batch):
            continue
        keys = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("value", "i", "j")]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        sets = shingles(texts_of(batch, text), WORDS) if text else None
        rows = batch.drop_columns([text]) if text else batch
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            key = tuple(int(k[a]) for k in keys)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append((rows.slice(a, b - a), sets and sets[a:b]))
    if held:
        yield last, held


def column(pieces: list, name: str) -> np.ndarray:
    return np.concatenate([p.column(p.schema.get_field_index(name)).to_numpy() for p, _ in pieces])


def arrays(pieces: list, name: str) -> list[np.ndarray]:
    out = []
    for p, _ in pieces:
        lists = p.column(p.schema.get_field_index(name))
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        out += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


CANDIDATES = pa.schema([("value", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()), ("partners", pa.list_(pa.int64()))])


def candidates(members: DataFrame) -> DataFrame:
    """The members of each cell that have partners there, with the partners of larger place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (value, i, j), pieces in in_groups(batches):
            part, n, block = column(pieces, "part"), column(pieces, "n"), column(pieces, "block")
            small, large = np.minimum.outer(n, n), np.maximum.outer(n, n)
            ask = (part[:, None] != part) & (small * LIMIT[1] >= large * LIMIT[0]) & ((i == j) | (block[:, None] != block))
            if ask.any():
                ask &= overlaps(arrays(pieces, "below")) == 0
            use = np.flatnonzero(ask.any(axis=1))
            if not len(use):
                continue
            node, sketch = column(pieces, "node")[use], arrays(pieces, "sketch")
            good = ask[np.ix_(use, use)] & possible(n[use], [sketch[k] for k in use])
            upper = np.triu(good, 1)
            for k in np.flatnonzero(good.any(axis=1)):
                out.append((value, i, j, int(node[k]), node[upper[k]]))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CANDIDATES, strict=True)], schema=CANDIDATES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CANDIDATES, strict=True)], schema=CANDIDATES)

    return members.mapInArrow(run, "value bigint, i int, j int, node bigint, partners array<bigint>")


def cell_links(found: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Links (a, b) that join what the verified pairs of each cell join; a cell gets each of its texts once."""
    texts = texts_needed(docs, found.select("node"), key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in in_groups(batches, "text"):
            node, sets, partners = column(pieces, "node"), [s for _, held in pieces for s in held], arrays(pieces, "partners")
            size = np.array([len(s) for s in sets])
            ids, code = np.unique(node, return_inverse=True)  # an id that several rows share has several texts
            ask = np.zeros((len(ids), len(ids)), bool)
            for k, p in zip(code, partners, strict=True):
                ask[k, np.searchsorted(ids, p)] = True
            both = overlaps(sets)
            good = (ask | ask.T)[np.ix_(code, code)] & (both > 0) & (LIMIT[1] * both.astype(np.int64) >= LIMIT[0] * (size[:, None] + size - both.astype(np.int64)))
            a, b = np.nonzero(np.triu(good, 1))
            root, links = list(range(len(ids))), []
            for x, y in zip(code[a].tolist(), code[b].tolist(), strict=True):
                ends = []
                for at in (x, y):
                    while root[at] != at:
                        root[at] = root[root[at]]
                        at = root[at]
                    ends.append(at)
                if ends[0] != ends[1]:
                    root[max(ends)] = min(ends)
                    links.append((int(ids[x]), int(ids[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return together(found.join(texts.hint("merge"), "node")).mapInArrow(run, "a bigint, b bigint").distinct()


def class_components(known: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """set_digest, copies (rows), least (the least id among them) and part, the least id of the component; no two texts share an id."""
    classes = written(known.groupBy("set_digest").agg(F.min(key).alias("node"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("index").alias("index"), F.first("sketch").alias("sketch")), "classes")
    posted = written(postings(classes), "postings").withColumn("value", F.explode("values"))
    edges = written(pivot_links(written(pivot_pairs(labelled(posted, None)), "pivot-pairs"), docs, key, text), "links")
    parts = written(components(edges), "parts")
    found = written(candidates(cells(labelled(posted, parts), classes.select("node", "n", "sketch"))), "candidates")
    stars = parts.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts = components(stars.unionByName(cell_links(found, docs, key, text)))
    return classes.select("set_digest", "node", "copies").join(parts.hint("merge"), "node", "left").select("set_digest", "copies", F.col("node").alias("least"), F.coalesce("component", "node").alias("part"))


def renumbered(known: DataFrame, docs: DataFrame, shared: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """known and docs with _id: the id or, of an id with several texts, a number beyond all ids for each text."""
    most = known.agg(F.max(key)).first()[0]
    texts = known.join(shared.select(key), key, "left_semi").groupBy(key, "own").agg(F.count(F.lit(1)).alias("m"))
    # as many rows as texts of such ids, written so that the numbers stay
    names = written(texts.withColumn("_id", F.lit(most).cast("long") + 1 + F.monotonically_increasing_id()), "renumbered")
    as_id = F.coalesce("_id", F.col(key).cast("long")).alias("_id")
    one = spread_join(known, names, [key, "own"], "m", how="left").drop("m")
    two = spread_join(docs.where(F.col(key).isNotNull()).select(key, F.xxhash64(text).alias("own"), text), names, [key, "own"], "m", how="left")
    return one.select(*known.columns, as_id), two.select(as_id, text)


def joined_by_ids(rows: DataFrame, classes: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """classes with the parts of components that share an id joined; a part is then the least of their ids."""
    of = rows.select(key, "set_digest").join(shared.select(key), key, "left_semi").distinct().join(classes.select("set_digest", "part"), "set_digest").select(key, "part").distinct()
    firsts = of.groupBy(key).agg(F.min("part").alias("b"), F.count(F.lit(1)).alias("m"))
    ends = components(spread_join(of, firsts, [key], "m").select(F.col("part").alias("a"), "b"))
    met = classes.join(ends.withColumnRenamed("node", "part"), "part", "left").withColumn("part", F.coalesce("component", "part")).drop("component")
    least = rows.groupBy("set_digest").agg(F.min(key).alias("least"))
    met = written(met.drop("least").join(least, "set_digest"), "joined")
    names = met.groupBy("part").agg(F.min("least").cast("long").alias("name"), F.count(F.lit(1)).alias("m"))
    return spread_join(met, names, ["part"], "m").select("set_digest", "copies", F.col("name").alias("part"))


def without_shingles(rows: DataFrame, known: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Rows without an id, whose component is null, and rows without shingles: the component of the id's other texts, else the id."""
    nameless = rows.where(F.col(key).isNull()).select(key, "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    empty = rows.where(F.col(key).isNotNull() & (F.col("n_shingles") == 0)).select(key, "n_shingles")
    ids = empty.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    other = known.select(key, "set_digest").join(ids.select(key), key, "left_semi").groupBy(key).agg(F.min("set_digest").alias("set_digest"))
    named = ids.join(spread_join(other, classes, ["set_digest"], "copies").select(key, "component_id"), key, "left")
    return nameless.unionByName(spread_join(empty, named, [key], "m").select(key, "n_shingles", F.coalesce("component_id", F.col(key).cast("bigint")).alias("component_id")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = written(sketches(docs, key, text), "sketches")
    linked = F.col(key).isNotNull() & (F.col("n_shingles") > 0)
    known = rows.where(linked)
    shared = written(known.groupBy(key).agg(F.min("set_digest").alias("a"), F.max("set_digest").alias("b")).where("a != b"), "shared-ids")
    if shared.isEmpty():
        classes = class_components(known, docs, key, text)
    else:
        one, two = renumbered(known, docs, shared, key, text)
        classes = joined_by_ids(known, written(class_components(one.drop(key), two, "_id", text), "parts-of-texts"), shared, key)
    classes = classes.select("set_digest", "copies", F.col("part").alias("component_id"))
    out = spread_join(known.select(key, "n_shingles", "set_digest"), classes, ["set_digest"], "copies").select(key, "n_shingles", "component_id")
    out = out.unionByName(without_shingles(rows, known, classes, key))
    return out.select(key, "n_shingles", "component_id", (F.col(key).isNull() | (F.col(key) == F.col("component_id"))).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, all columns; of rows equal in id and text one stays."""
    rows, at = numbered(docs)
    good = near_duplicates(docs.select(key, text), key, text).where("kept").select(F.col(key).alias("id")).distinct()
    rows = rows.withColumn("hash", F.xxhash64(at[text])).join(good.hint("merge"), F.col(at[key]).eqNullSafe(F.col("id")), "left_semi")
    return rows.dropDuplicates([at[key], "hash"]).select(*(F.col(c).alias(name) for name, c in at.items()))


#: The same in SQL: all pairs that share a shingle, on exact words.
ORACLE = """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
          FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
    r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.a = e.a AND r.c < e.b)
    SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n"""
