"""LM scoring with a hierarchical Pitman-Yor model.

Dishes are words and the end of a text.  Contexts are the two words before, the one word before, and none; a context's
restaurant has that of the shorter context as parent, so contexts that end alike share one, and all meet in the
restaurant without context, whose base is even over the known words and one unknown word.  Tables of a restaurant are
the customers of its parent.  Seating is sampled by Gibbs: in each sweep all customers of every dish stand up and are
seated anew by the exact conditional of their number of tables (seating.py).  A text's score is the log10 of the
predictive probabilities averaged over the kept samples.

On Spark: every token goes, packed with others of its chunk of texts, to the bucket of its previous word, so that the
restaurants of one and of two words before lie in one task.  What buckets share is a number per word:

1. Previous words fall into GROUPS groups by hash; the words of each group are seated in one restaurant, and its tables
   by word, summed over groups, are the customers of the restaurant without context, which is seated over all words
   (parts of the words, packed, and totals).
2. Each bucket gets the counts and averaged probabilities of its own words, and its tokens; it seats pairs and triples
   of words over them, and returns sums by text.

Buckets grow in number with the corpus, and the tokens of a previous word with more than BUCKET_TOKENS tokens (at most one in
BUCKET_TOKENS of all tokens is such a word; they come to the driver) are dealt to several tasks: by the word before it, and
those of a pair of words before with more tokens than that by their texts as well.  Such a word still has one restaurant:
its homes, each with whole restaurants of two words before, send their tables by following word in every sweep, one
seating of the word sends probabilities back, and the buckets are told what the homes found.  Where tokens lie doesn't
change a result: numbers are drawn from the keys of dishes and restaurants, and sums are of whole or fixed-point numbers.

Null and empty texts consist of the end alone; rows with repeated ids are scored and counted each; null ids are
learned from like others; extra columns are not carried, whatever their names; texts of any length are read whole;
equal texts have equal scores; an empty table gives an empty table, and one without learnable
rows the even base for every token.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, numbered, sliced, stored, texts_of, written
from .hashing import ODD, mix, words
from .seating import tables

#: Discount and strength without context, after one word, and after two.
DISCOUNT, STRENGTH = (0.85, 0.75, 0.8), (10.0, 5.0, 2.0)
#: Sweeps before the first kept sample, and kept samples.
BURN_IN, SAMPLES = 2, 3
#: Bytes of text packed at once, and most tokens of a bucket on average.
AT_ONCE, BUCKET_TOKENS = 8 << 20, 1_750_000
#: Groups of previous words, at every size; buckets are a multiple.
GROUPS = 32
#: Numbers drawn at once.
BLOCK = 1 << 14
#: Characters of texts whose words are hashed at once.
HASH_AT_ONCE = 1 << 20
#: Scores of tokens are rounded to one in FIXED, so that their sums don't depend on their order.
FIXED = float(1 << 30)
END, START = 1, 0
SEED = 11
LAST = BURN_IN + SAMPLES - 1


class Often:
    """Previous words and pairs of them whose tokens are dealt to several tasks, with the number of these."""

    def __init__(self, found: list[tuple[int, int, int, int]]):
        self.by_kind, self.homes = [], []
        for kind in (0, 1):
            rows = sorted((x, one, parts) for k, x, one, parts in found if k == kind)
            self.by_kind.append((np.array([x for x, _, _ in rows], np.int64), np.array([p for _, _, p in rows], np.int64)))
            for x, one, parts in rows:
                # home, and the restaurants' names in buckets
                key, part = np.full(parts, x, np.int64), np.arange(parts)
                if kind:
                    home = pair_home(key[:1])
                    self.homes.append((int(home[0]), text_part(home.repeat(parts), part).tolist()))
                else:
                    self.homes += [(h, [h]) for h in word_home(key, part).tolist()]
        self.words = self.by_kind[0][0]

    def parts(self, kind: int, keys: np.ndarray) -> np.ndarray:
        known, parts = self.by_kind[kind]
        if not len(known):
            return np.ones(len(keys), np.int64)
        near = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[near] == keys, parts[near], 1)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, one and two words before, and text number of all tokens, each text closed by the end."""
    known, word, one, two, doc = placed(texts)
    return known[word], known[one], known[two], doc


def placed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts, START and END, in order; places among them of all tokens and of one and two words before, and text numbers."""
    parts, counts, at, size = [dictionary(np.empty(0, np.int64))], [np.empty(0, np.int64)], 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= HASH_AT_ONCE or k == len(texts) - 1:
            h, _, ends, _ = words(texts[at : k + 1])
            parts.append(dictionary(np.maximum(h.astype(np.int64), 2)))
            counts.append(np.diff(ends))
            at, size = k + 1, 0
    known, place = merged(*zip(*parts, strict=True))
    counts = np.concatenate(counts)
    known, n = np.r_[START, END, known], len(place) + len(texts)
    count, ends = len(texts), np.r_[0, np.cumsum(counts)]
    doc = np.repeat(np.arange(count, dtype=np.int32), counts + 1)
    # places of START and END are these themselves
    word, last = np.full(n, END, np.int32), np.zeros(n, bool)
    last[ends[1:] + np.arange(count)] = True
    word[~last] = place + 2
    # a text's first token has no word before, its second only one
    begins = ends[:-1] + np.arange(count)
    one, two = np.full(n, START, np.int32), np.full(n, START, np.int32)
    one[1:], two[2:] = word[:-1], word[:-2]
    one[begins] = two[begins] = START
    second = (begins + 1)[begins + 1 < n]
    two[second[doc[second] == doc[second - 1]]] = START
    return known, word, one, two, doc


def spread(key: np.ndarray) -> np.ndarray:
    return mix(key.astype(np.uint64))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(np.uint64) * np.uint64(ODD[0]) + spread(b))


def named(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (joined(key, part) >> np.uint64(1)).astype(np.int64)


def word_home(one: np.ndarray, part: np.ndarray) -> np.ndarray:
    return named(one, part + (1 << 40))


def pair_home(pair: np.ndarray) -> np.ndarray:
    return named(pair, np.full(len(pair), 2 << 40))


def text_part(home: np.ndarray, part: np.ndarray) -> np.ndarray:
    return named(home, part + (3 << 40))


def short(two: np.ndarray) -> np.ndarray:
    """24 bits that tell the words before a word apart."""
    return (spread(two) >> np.uint64(40)).astype(np.uint32)


def pair_keys(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return named(one, two)


def contexts(known: np.ndarray, word: np.ndarray, one: np.ndarray, two: np.ndarray, doc: np.ndarray, often: Often) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of words before or of their parts, and the place of each token's; places of the tokens after frequent words, and their homes."""
    by_word = often.parts(0, known)
    hot = np.flatnonzero((by_word > 1)[one])
    if not len(hot):
        return known, one, hot, known[one[hot]]
    before, t = known[one[hot]], two[hot].astype(np.int64)
    pair = pair_keys(before, t)
    by_pair = often.parts(1, pair)
    of_text = np.add.reduceat(known[word], np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]))
    home = np.where(by_pair > 1, pair_home(pair), word_home(before, (spread(t + 7) % by_word[one[hot]].astype(np.uint64)).astype(np.int64)))
    part = (spread(of_text[doc[hot]]) % by_pair.astype(np.uint64)).astype(np.int64)
    names, place = dictionary(np.where(by_pair > 1, text_part(home, part), home))
    ctx = one.copy()
    ctx[hot] = len(known) + place
    return np.r_[known, names], ctx, hot, home


def frequent(docs: DataFrame, text: str) -> tuple[Often, int]:
    """Previous words and pairs with more tokens than a bucket has, and the number of tokens.

    A chunk leaves out what it has less of than a share; all that is left out of a word is less than half a bucket."""
    row = docs.agg(F.sum(F.length(text)).alias("chars"), F.count("*").alias("n")).first()
    share = BUCKET_TOKENS / 2 / max(1, (row["chars"] or 0) / 2 + 2 * row["n"])

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, _, one, two, _ = placed(texts_of(batch, text))
        n = np.bincount(one, minlength=len(known))
        large = n >= len(one) * share
        words_, at, (bits, of) = np.flatnonzero(large), np.flatnonzero(large[one]), dictionary(short(known).astype(np.int64))
        # a pair has no more tokens than its later word
        pair, n_pair = np.unique(one[at].astype(np.int64) * len(bits) + of[two[at]], return_counts=True)
        pair, n_pair = (x[n_pair >= len(one) * share] for x in (pair, n_pair))
        before = known[pair // len(bits)]
        out = [
            (np.array([2]), np.array([0]), np.array([0]), np.array([len(one)])),
            (np.zeros(len(words_)), known[words_], known[words_], n[words_]),
            (np.ones(len(pair)), pair_keys(before, bits[pair % len(bits)]), before, n_pair),
        ]
        kinds, keys, ones, counts = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(keys, pa.int64()), pa.array(ones, pa.int64()), pa.array(counts, pa.int64())], names=["kind", "key", "one", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, AT_ONCE):
            yield chunk(batch)

    sums = written(docs.select(text).mapInArrow(run, "kind int, key bigint, one bigint, n bigint").groupBy("kind", "key", "one").agg(F.sum("n").alias("n")), "lm-frequent")
    total = sums.where("kind = 2").agg(F.sum("n").alias("n")).first()["n"] or 0
    found = sums.where((F.col("kind") < 2) & (F.col("n") > BUCKET_TOKENS)).select("kind", "key", "one", F.ceil(F.col("n") / BUCKET_TOKENS).alias("parts")).collect()
    return Often([(r["kind"], r["key"], r["one"], r["parts"]) for r in found]), total


# Packed columns.

def packed(*columns: np.ndarray) -> bytes:
    """Columns with their lengths, first bytes of all values first, compressed."""
    raw = []
    for c in columns:
        by_value, by_place = np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize), np.empty((c.dtype.itemsize, len(c)), np.uint8)
        for k in range(c.dtype.itemsize):
            by_place[k] = by_value[:, k]
        raw += [struct.pack("<I", len(c)), by_place]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        (n,) = struct.unpack_from("<I", raw, at)
        width = np.dtype(kind).itemsize
        by_value = np.empty((n, width), np.uint8)
        for k in range(width):
            by_value[:, k] = np.frombuffer(raw, np.uint8, n, at + 4 + k * n)
        out.append(by_value.reshape(-1).view(kind))
        at += 4 + n * width
    return out


def dictionary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, in order, and the place of each value among them."""
    found = pa.array(values).dictionary_encode()
    distinct = found.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(distinct)
    place = np.empty(len(distinct), np.uint32)
    place[order] = np.arange(len(distinct), dtype=np.uint32)
    return distinct[order], place[found.indices.to_numpy(zero_copy_only=False)]


def merged(distinct: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """dictionary() of values that come as several of them."""
    known, at = dictionary(np.concatenate(distinct))
    starts = np.cumsum([0, *map(len, distinct)])
    return known, np.concatenate([at[a : a + len(d)][x] for a, d, x in zip(starts[:-1].tolist(), distinct, places, strict=True)])


def in_order(*columns: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows ordered by columns of numbers from 0 to below a limit, equal ones as they came, and whether each differs from the one before.

    One sort of numbers that hold columns and place, where 63 bits are enough."""
    n = len(columns[0][0])
    bits, new = n.bit_length(), np.ones(n, bool)
    if math.prod(limit for _, limit in columns) << bits < 1 << 63:
        key = np.zeros(n, np.int64)
        for x, limit in columns:
            key *= limit
            key += x
        key <<= bits
        key += np.arange(n, dtype=np.int32 if bits < 32 else np.int64)
        key.sort()
        order = np.empty(n, np.int32 if bits < 32 else np.int64)
        np.bitwise_and(key, (1 << bits) - 1, out=order, dtype=np.int64, casting="unsafe")
        key >>= bits
        new[1:] = key[1:] != key[:-1]
    else:
        order = np.lexsort([x for x, _ in reversed(columns)])
        new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x, _ in columns])
    return order, new


def grouped(*columns: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct combination, in order, and the place of every row's combination among them."""
    order, new = in_order(*columns)
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], place


#: Words; and places of words, groups and training tokens.
SUM_COLUMNS = (np.int64, np.uint32, np.uint8, np.uint32)
TOKEN_COLUMNS = (np.int64, np.uint32, np.int64, np.uint32, np.uint8, np.uint32)
DISH_COLUMNS = (np.int64, np.uint32, np.uint8, np.uint32)


def three(two: np.ndarray) -> np.ndarray:
    """The 24 bits as bytes."""
    return np.ascontiguousarray(two.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3]).reshape(-1)


def unthree(raw: np.ndarray) -> np.ndarray:
    low, middle, high = (raw[k::3].astype(np.uint32) for k in range(3))
    return low | middle << np.uint32(8) | high << np.uint32(16)


def part_of(word: np.ndarray, parts: int) -> np.ndarray:
    return (spread(word + 7) % np.uint64(parts)).astype(np.int64)


def cut_by(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if b > a:
            yield k, slice(a, b)


def dealt_words(docs: DataFrame, often: Often, buckets: int, text: str) -> DataFrame:
    """A row per bucket and chunk: its distinct words by group with the number of training tokens.

    What follows the frequent word k is asked for by bucket buckets + k; rows with a home have dishes after two words."""

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, word, one, two, doc = placed(texts_of(batch, text))
        two = short(known)[two]
        names, ctx, hot, home = contexts(known, word, one, two, doc, often)
        (bucket, at), (group, before) = (((spread(x) % np.uint64(n)).astype(np.int64), y) for x, n, y in ((names, buckets, ctx), (known, GROUPS, one)))
        learned = ~np.array(batch.column(batch.schema.get_field_index("held")).to_pylist(), bool)[doc]
        many, rows = len(known), []
        if len(hot):
            of, w, t = np.searchsorted(often.words, known)[one[hot]], word[hot].astype(np.int64), two[hot]
            asked = np.unique(of * many + w)
            rows += [(buckets + k, None, asked_for(known[asked[s] % many])) for k, s in cut_by(asked // many, len(often.words))]
            home, place = dictionary(home)
            order, new = in_order((place, len(home)), (t, 1 << 24), (w, many))
            first = np.flatnonzero(new)
            n, order = np.add.reduceat(learned[hot][order].astype(np.int64), first), order[first]
            of, w, t, place = of[order], w[order], t[order], place[order]
            rows += [(int(of[s.start]), int(home[k]), packed(*dictionary(known[w[s]]), three(t[s]), n[s].astype(np.uint32))) for k, s in cut_by(place, len(home))]
        key = np.sort((((bucket[at] * GROUPS + group[before]) * many + word) << 1) + learned)
        first = np.flatnonzero(np.r_[True, key[1:] >> 1 != key[:-1] >> 1])
        n, key = np.add.reduceat(key & 1, first).astype(np.uint32), key[first] >> 1
        bucket, group, word = key // many // GROUPS, (key // many % GROUPS).astype(np.uint8), key % many
        first, place = grouped((bucket, buckets), (word, many))
        ends = dict(cut_by(bucket[first], buckets))
        rows += [(k, None, packed(known[word[first[ends[k]]]], (place[s] - ends[k].start).astype(np.uint32), group[s], n[s])) for k, s in cut_by(bucket, buckets)]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)] if rows else [pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["bucket", "home", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, AT_ONCE):
            yield chunk(batch)

    return docs.select(text, "held").mapInArrow(run, "bucket int, home bigint, blob binary")


def asked_for(known: np.ndarray) -> bytes:
    return packed(known, *(np.zeros(0, kind) for kind in SUM_COLUMNS[1:]))


def dealt_tokens(docs: DataFrame, often: Often, buckets: int, key: str, text: str) -> DataFrame:
    """A row per bucket and chunk: its tokens; that of bucket 0 names the chunk's documents."""

    def chunk(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
        known, word, one, two, doc = placed(texts_of(batch, text))
        two = short(known)[two]
        names, ctx, _, _ = contexts(known, word, one, two, doc, often)
        del one
        held = np.array(batch.column(batch.schema.get_field_index("held")).to_pylist(), bool)
        # names by bucket, so that one order is that of buckets and of names
        bucket = (spread(names) % np.uint64(buckets)).astype(np.int64)
        by_name, rank = np.lexsort((names, bucket)), np.empty(len(names), np.uint32)
        rank[by_name] = np.arange(len(names), dtype=np.uint32)
        names, bucket, ctx = names[by_name], bucket[by_name], rank[ctx]
        order, _ = in_order((ctx, len(names)), (word, len(known)))
        word, ctx, two, mark = word[order], ctx[order], two[order], (doc * 2 + ~held[doc])[order].astype(np.uint32)
        del order, doc
        ids, sizes = batch.column(batch.schema.get_field_index(key)).to_pylist(), np.bincount(mark >> 1, minlength=len(held)).tolist()
        bucket = bucket.astype(np.int32)[ctx]
        rows = {0: slice(0, 0)} | dict(cut_by(bucket, buckets))
        used, blobs, lists = sorted(rows), [], []
        for distinct, column, limit in ((names, ctx, len(names)), (known, word, len(known))):
            first, place = grouped((bucket, buckets), (column, limit))
            ends = {0: slice(0, 0)} | dict(cut_by(bucket[first], buckets))
            lists.append((distinct[column[first]], place, ends))
        for k in used:
            columns = [x for distinct, place, ends in lists for x in (distinct[ends[k]], (place[rows[k]] - ends[k].start).astype(np.uint32))]
            blobs.append(packed(*columns, three(two[rows[k]]), mark[rows[k]]))
        rest = [None] * (len(used) - 1)
        return pa.RecordBatch.from_arrays([
            pa.array(used, pa.int32()), pa.array([number] * len(used), pa.int64()), pa.array(blobs, pa.binary()),
            pa.array([ids, *rest], pa.list_(pa.int64())), pa.array([sizes, *rest], pa.list_(pa.int64())), pa.array([held.tolist(), *rest], pa.list_(pa.bool_())),
        ], names=["bucket", "chunk", "blob", "ids", "n_tokens", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        for k, batch in enumerate(sliced(batches, text, AT_ONCE)):
            yield chunk(batch, first + k)

    return docs.select(F.col(key).cast("long").alias(key), text, "held").mapInArrow(run, "bucket int, " + PART)


PART = "chunk bigint, blob binary, ids array<bigint>, n_tokens array<bigint>, held array<boolean>"


def together(rows: DataFrame, buckets: int, *order: str) -> DataFrame:
    """Rows of a bucket one after the other in one task, about a task for each bucket."""
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", *order)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    last, held = None, []
    for batch in batches:
        name = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(batch)] if len(batch) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if name[a] != last and held:
                yield last, held
                held = []
            last = int(name[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


# Restaurants.

class Keyed:
    """Numbers that depend on the key of what they are drawn for and on the step, not on what is drawn beside it."""

    def __init__(self, keys: np.ndarray, step: int):
        self.keys, self.at = keys, step << 16

    def even(self, where=slice(None)) -> np.ndarray:
        """Of (0, 1)."""
        self.at += 1
        return ((mix(self.keys[where] + np.uint64((self.at + SEED * ODD[3]) * ODD[0] & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)

    def standard_gamma(self, shape: np.ndarray) -> np.ndarray:
        """By Marsaglia and Tsang: a cubed normal number, taken or drawn again; most are taken by a test that needs no logarithm."""
        out, begun = np.zeros(len(shape)), self.at
        drawn_ = np.flatnonzero(shape > 0)
        for k in range(0, len(drawn_), BLOCK):
            self.at, open_ = begun, drawn_[k : k + BLOCK]
            a = shape[open_]
            less = np.flatnonzero(a < 1)
            d = np.where(a < 1, a + 1, a) - 1 / 3
            lift = np.exp(np.log(self.even(open_[less])) / a[less])
            small = open_[less]
            while len(open_):
                z = np.sqrt(-2 * np.log(self.even(open_))) * np.cos(2 * np.pi * self.even(open_))
                v = np.maximum(1 + z / np.sqrt(9 * d), 0)
                v, u, square = v * v * v, self.even(open_), z * z
                good = u < 1 - 0.0331 * square * square
                at = np.flatnonzero(~good)
                with np.errstate(divide="ignore"):
                    good[at] = np.log(u[at]) < square[at] / 2 + d[at] - d[at] * v[at] + d[at] * np.log(v[at])
                out[open_[good]] = (d * v)[good]
                open_, d = open_[~good], d[~good]
            out[small] *= lift
        return out


def evens(rng: np.random.Generator | Keyed, rows: np.ndarray) -> np.ndarray:
    return rng.even(rows) if isinstance(rng, Keyed) else rng.random(len(rows))


def sweep(c: np.ndarray, t: np.ndarray, ctx: np.ndarray, n_ctx: int, base: np.ndarray, level: int, rng: np.random.Generator | Keyed, dishes: Keyed | None = None) -> np.ndarray:
    """New numbers of tables of all dishes (c customers, t tables now, in restaurant ctx, over base)."""
    d, s = DISCOUNT[level], STRENGTH[level]
    out = np.minimum(c, 1).astype(np.int64)
    # one customer has one table, so nothing is drawn for it, nor for a restaurant of such dishes
    more = np.flatnonzero(c > 1)
    of, dishes, some = ctx[more], dishes or rng, np.zeros(n_ctx, bool)
    some[of] = True
    y = rng.standard_gamma(np.where(some, s / d + np.bincount(ctx, np.minimum(t, c), n_ctx), 0))
    out[more] = tables(c[more], d * y[of] * base[more], d, 1 - evens(dishes, more), evens(dishes, more))
    return out


def predictive(c: np.ndarray, t: np.ndarray, ctx: np.ndarray, n_ctx: int, base: np.ndarray, level: int) -> np.ndarray:
    """Probability of each dish after its context."""
    d, s = DISCOUNT[level], STRENGTH[level]
    rest, whole, out = s + d * np.bincount(ctx, t, n_ctx), s + np.bincount(ctx, c, n_ctx), np.empty(len(c))
    for at in range(0, len(c), BLOCK):
        rows = slice(at, at + BLOCK)
        of = ctx[rows]
        out[rows] = (np.maximum(c[rows] - d * t[rows], 0) + rest[of] * base[rows]) / whole[of]
    return out


def drawn(c: np.ndarray, t: np.ndarray, ctx: np.ndarray, n_ctx: int, base: np.ndarray, level: int, rng: np.random.Generator | Keyed, dishes: Keyed | None = None, asked: np.ndarray | None = None) -> np.ndarray:
    """A draw of each dish's probability given the seating; restaurants below it are independent given these.

    asked: whether a restaurant's dishes are asked for; those of others are of no use."""
    d, s = DISCOUNT[level], STRENGTH[level]
    shape = np.maximum(c - d * t, 0)
    own = (dishes or rng).standard_gamma(shape if asked is None else shape * asked[ctx])
    rest = rng.standard_gamma(s + d * np.bincount(ctx, t, n_ctx))
    total = np.bincount(ctx, own, n_ctx) + rest
    return ((own + rest[ctx] * base) / total[ctx]).astype(np.float32)


def bucket_words(dealt: DataFrame, buckets: int, parts: int) -> DataFrame:
    """A row per part of the words and bucket: the bucket's words of that part, and their training tokens by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held in by_bucket(batches):
            known, word, group, n = summed([unpacked(x.as_py(), *SUM_COLUMNS) for b in held for x in b.column(1)])[:4]
            part = part_of(known, parts)
            order = np.argsort(part, kind="stable")
            of, rank = part[word], np.empty(len(known), np.int64)
            rank[order] = np.arange(len(known))
            by_part = np.argsort(of, kind="stable")
            own, rows = dict(cut_by(of[by_part], parts)), []
            for k, s in cut_by(part[order], parts):
                at = by_part[own.get(k, slice(0, 0))]
                rows.append((k, packed(known[order[s]], (rank[word[at]] - s.start).astype(np.uint32), group[at].astype(np.uint8), n[at].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([name] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "bucket", "blob"])

    return together(dealt.select("bucket", "blob"), buckets).mapInArrow(run, "part int, bucket int, blob binary")


def summed(opened: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Words, place, group and training tokens of each word in each group that has any, and the places of the words that were handed in."""
    known, place = dictionary(np.concatenate([o[0] for o in opened]))
    starts = np.cumsum([0, *(len(o[0]) for o in opened)])
    word, group, n = (np.concatenate(x) for x in ([place[a : a + len(o[0])][o[1]] for a, o in zip(starts[:-1].tolist(), opened, strict=True)], [o[2] for o in opened], [o[3] for o in opened]))
    rows, at = grouped((word, len(known)), (group, GROUPS))
    n = np.bincount(at, n, len(rows)).astype(np.int64)
    rows, n = rows[n > 0], n[n > 0]
    return known, word[rows].astype(np.int64), group[rows].astype(np.int64), n, place, starts


ENTRY_COLUMNS = (np.int64, np.uint32, np.uint8, np.int64)


def vocabulary(asked: DataFrame, parts: int) -> DataFrame:
    """A row per part of the words: its words, in order, their training tokens by group, and the buckets that asked with the places of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held in by_bucket(batches):
            owner = np.concatenate([b.column(1).to_numpy() for b in held])
            known, word, group, n, place, ends = summed([unpacked(x.as_py(), *SUM_COLUMNS) for b in held for x in b.column(2)])
            sums = packed(known, word.astype(np.uint32), group.astype(np.uint8), n)
            places = packed(*(place[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([sums], pa.binary()), pa.array([owner.tolist()], pa.list_(pa.int32())), pa.array([places], pa.binary())], names=["part", "sums", "buckets", "places"])

    rows = asked.repartition(parts, "part").sortWithinPartitions("part", "bucket")
    return rows.select("part", "bucket", "blob").mapInArrow(run, "part int, sums binary, buckets array<int>, places binary")


def totals(words_: DataFrame, size: int, measure: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """The sum over parts of size numbers that measure makes of a part's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(measure(raw.as_py()).astype(np.int64), pa.int64())], names=["slot", "x"])

    out = np.zeros(size, np.int64)
    for row in words_.select("sums").mapInArrow(run, "slot int, x bigint").groupBy("slot").agg(F.sum("x").alias("x")).collect():
        out[row["slot"]] = row["x"]
    return out


def seats(c: np.ndarray, weights: np.ndarray, keys: np.ndarray, step: int) -> np.ndarray:
    """Tables of dishes without context; the same whenever it is asked again."""
    rng = Keyed(keys, step)
    return tables(c, weights, DISCOUNT[0], rng.even(), rng.even())


def top(words_: DataFrame) -> tuple[DataFrame, int, int]:
    """bucket, part and blob (training tokens and probability without context of the bucket's words of the part); N and V.

    Totals of all parts come to the driver in each sweep, a few numbers a group."""
    d, s, rng = DISCOUNT[0], STRENGTH[0], np.random.default_rng([SEED, 0])

    def by_group(raw: bytes, weights: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        known, word, group, c = unpacked(raw, *ENTRY_COLUMNS)
        return known, word, group, c, seats(c, weights[group], joined(known[word], group.astype(np.int64) + (4 << 40)), k)

    def counted(raw: bytes) -> np.ndarray:
        _, word, group, c = unpacked(raw, *ENTRY_COLUMNS)
        return np.r_[c.sum(), len(np.unique(word)), np.bincount(group, minlength=GROUPS)]

    n, v, *dishes = totals(words_, 2 + GROUPS, counted).tolist()
    opened, kept = np.array(dishes), []
    for k in range(BURN_IN + SAMPLES):
        weights = d * rng.standard_gamma(s / d + opened) / (np.array(dishes) + 1)
        kept.append((k, weights))
        opened = totals(words_, GROUPS, lambda raw, weights=weights, k=k: np.bincount((x := by_group(raw, weights, k))[2], x[4], GROUPS))
    kinds = (np.int64,) * (2 + SAMPLES)

    def customers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for raw in batch.column(1):
                found = [by_group(raw.as_py(), weights, k) for k, weights in kept[BURN_IN:]]
                known, word, _, c, _ = found[0]
                sums.append(packed(known, *(np.bincount(word, x, len(known)).astype(np.int64) for x in (c, *(f[4] for f in found)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.binary()), batch.column(2), batch.column(3)], names=batch.schema.names)

    words_ = written(words_.mapInArrow(customers_of, words_.schema), "lm-top")

    def without(known: np.ndarray, c: list[np.ndarray], weights: list[float], k: int) -> list[np.ndarray]:
        return [seats(x, np.full(len(x), a), joined(known, np.full(len(known), j + (5 << 40))), k) for j, (x, a) in enumerate(zip(c, weights, strict=True))]

    def measured(weights: list[float], k: int) -> np.ndarray:
        def run(raw: bytes) -> np.ndarray:
            known, _, *c = unpacked(raw, *kinds)
            return np.array([x.sum() for x in (*c, *without(known, c, weights, k))])

        return totals(words_, 2 * SAMPLES, run)

    found = np.full(2 * SAMPLES, v)
    for k in range(BURN_IN):
        weights = [d * float(rng.standard_gamma(s / d + x)) / (v + 1) for x in found[SAMPLES:]]
        found = measured(weights, k)
    customers = found[:SAMPLES]
    rest = [(s + d * o) / (v + 1) / (s + c) for o, c in zip(found[SAMPLES:], customers, strict=True)]

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, buckets, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                known, count, *c = unpacked(raw.as_py(), *kinds)
                opened = without(known, c, weights, BURN_IN - 1)
                p = sum((x - d * o) / (s + all_) + r for x, o, all_, r in zip(c, opened, customers, rest, strict=True)) / SAMPLES
                blobs = [packed(count[at], p[at].astype(np.float32)) for at in unpacked(places.as_py(), *[np.uint32] * len(buckets))]
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([part] * len(buckets), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])

    return words_.mapInArrow(reply, "bucket int, chunk bigint, blob binary"), n, v


def sampled(c3: np.ndarray, of3: np.ndarray, n3: int, of2: np.ndarray, ctx2: np.ndarray, n2: int, base: np.ndarray, rng: np.random.Generator | None, keys: tuple | None = None) -> np.ndarray:
    """Averaged probabilities of dishes after two words.

    c3: their customers, of3: their restaurant, of2: the dish after one word that their tables are customers of; ctx2:
    the restaurant of each of those, base: its probability without context; keys: those of restaurants after two words and
    after one, and of the words of dishes after one, from which numbers are drawn if there is no rng."""
    # one customer has one table in every sweep, so only restaurants with dishes of more are seated again
    again = np.zeros(n3, bool)
    again[of3[c3 > 1]] = True
    served = c3 > 0
    use = np.flatnonzero(served & again[of3])
    c, ctx, up = c3[use], (np.cumsum(again) - 1)[of3[use]], of2[use]
    n_again, fixed_ = int(again.sum()), np.bincount(of2, served & ~again[of3], len(ctx2)).astype(np.int64)
    asked = np.zeros(n2, bool)
    asked[ctx2[of2[c3 > 1]]] = True
    if keys:
        r3, r2, own = keys
        d3, d2 = joined(r3[of3[use]], own[up]), joined(r2[ctx2], own)
        r3 = r3[again]

    def by(level: int, step: int) -> list:
        return [Keyed(r3, step), Keyed(d3, step)] if keys and level == 2 else [Keyed(r2, step), Keyed(d2, step)] if keys else [rng]

    t, out = np.ones(len(c), np.int64), np.zeros(len(c3))
    c2 = fixed_ + np.bincount(up, t, len(ctx2)).astype(np.int64)
    t2 = np.minimum(c2, 1)
    for k in range(BURN_IN + SAMPLES):
        p = drawn(c2, t2, ctx2, n2, base, 1, *by(1, 2 * k), asked=asked)
        t = sweep(c, t, ctx, n_again, p[up], 2, *by(2, 2 * k))
        c2 = fixed_ + np.bincount(up, t, len(ctx2)).astype(np.int64)
        t2 = sweep(c2, t2, ctx2, n2, base, 1, *by(1, 2 * k + 1))
        if k >= BURN_IN:
            full = served.astype(np.int32)
            full[use] = t
            out += predictive(c3, full, of3, n3, predictive(c2, t2, ctx2, n2, base, 1).astype(np.float32)[of2], 2)
    return out / SAMPLES


def keys_one(one: np.ndarray) -> np.ndarray:
    return joined(one, np.full(len(one), 6 << 40))


def keys_two(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """From keys of one word."""
    return joined(one, two + np.int64(7 << 40))


# Frequent previous words.

def homes(dealt: DataFrame, size: int) -> DataFrame:
    """A row per home of a frequent word: its dishes after two words with training tokens, by the word two before and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held in by_bucket(batches):
            opened = [unpacked(x.as_py(), *DISH_COLUMNS) for b in held for x in b.column(2)]
            known, word = merged([o[0] for o in opened], [o[1] for o in opened])
            two = unthree(np.concatenate([o[2] for o in opened]))
            rows, place = grouped((two, 1 << 24), (word, len(known)))
            n = np.bincount(place, np.concatenate([o[3] for o in opened]), len(rows)).astype(np.uint32)
            blob = packed(known, word[rows], three(two[rows]), n)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([held[0].column(1)[0].as_py()], pa.int32()), pa.array([blob], pa.binary())], names=["home", "hot", "blob"])

    rows = dealt.where("home is not null").select("home", F.col("bucket").alias("hot"), "blob")
    return rows.repartition(size, "home").sortWithinPartitions("home").mapInArrow(run, "home bigint, hot int, blob binary")


class Home:
    """Whole restaurants of two words before, the later of which is a frequent one."""

    def __init__(self, blob: bytes, one: int):
        self.known, self.of2, two, c = unpacked(blob, *DISH_COLUMNS)
        two, self.c3 = unthree(two).astype(np.int64), c.astype(np.int64)
        restaurants, self.of3 = np.unique(two, return_inverse=True)
        self.n3, self.use = len(restaurants), np.flatnonzero(self.c3)
        self.r3 = keys_two(keys_one(np.full(len(restaurants), one, np.int64)), restaurants)
        self.d3 = joined(self.r3[self.of3], self.known[self.of2])[self.use]

    def swept(self, t: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
        """Tables after sweep k over the probabilities of words after the one word."""
        use = self.use
        return sweep(self.c3[use], t, self.of3[use], self.n3, p[self.of2[use]], 2, Keyed(self.r3, 2 * k), Keyed(self.d3, 2 * k))


STATE = "home bigint, t binary, opened binary, drawn binary, known binary"


def seated(found: DataFrame, told: DataFrame, often: Often, parts: int) -> list[tuple[DataFrame, str]]:
    """Seatings and probabilities after one word of each kept sample, by home; sampled() with its two levels in different tasks."""
    ones, spark = often.words.tolist(), found.sparkSession
    told = told.select(F.col("bucket").alias("hot"), F.lit(0).alias("kind"), "chunk", "blob")

    def sent(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.to_pylist():
                    h = Home(x["blob"], ones[x["hot"]])
                    if k < 0:
                        t, old = np.ones(len(h.use), np.int64), np.zeros(len(h.known), np.uint32)
                    else:
                        t, (old,) = h.swept(unpacked(x["t"], np.uint32)[0].astype(np.int64), unpacked(x["drawn"], np.float32)[0], k), unpacked(x["opened"], np.uint32)
                    n = np.bincount(h.of2[h.use], t, len(h.known)).astype(np.uint32)
                    yield pa.RecordBatch.from_pylist([{"hot": x["hot"], "kind": 1, "chunk": x["home"], "blob": packed(h.known, n, old), "t": packed(t.astype(np.uint32))}], MESSAGE)

        return run

    def answered(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, held in by_bucket(batches):
                rows = [x for b in held for x in b.to_pylist()]
                p = np.concatenate([unpacked(x["blob"], np.int64, np.float32)[1] for x in rows if not x["kind"]])
                rows = [x for x in rows if x["kind"]]
                opened = [unpacked(x.pop("blob"), np.int64, np.uint32, np.uint32) for x in rows]
                known, place = dictionary(np.concatenate([o[0] for o in opened]))
                if len(p) != len(known):
                    raise ValueError("a frequent word's followers differ from those it asked for")
                c, t, base, ctx = np.bincount(place, np.concatenate([o[1] for o in opened]), len(known)).astype(np.int64), np.zeros(len(known), np.int64), np.zeros(len(known)), np.zeros(len(known), np.int64)
                t[place], base[np.lexsort((known, part_of(known, parts)))] = np.concatenate([o[2] for o in opened]), p
                r2 = keys_one(np.array([ones[name]]))
                d2 = joined(r2[ctx], known)
                t = np.minimum(c, 1) if k < 0 else sweep(c, t, ctx, 1, base, 1, Keyed(r2, 2 * k + 1), Keyed(d2, 2 * k + 1))
                mean = predictive(c, t, ctx, 1, base, 1).astype(np.float32) if k >= BURN_IN else np.zeros(len(known), np.float32)
                next_ = drawn(c, t, ctx, 1, base, 1, Keyed(r2, 2 * k + 2), Keyed(d2, 2 * k + 2)) if k < LAST else np.zeros(len(known), np.float32)
                end = 0
                for x, o in zip(rows, opened, strict=True):
                    at, end = place[end : end + len(o[0])], end + len(o[0])
                    yield pa.RecordBatch.from_pylist([{"home": x["chunk"], "t": x["t"], "opened": packed(t[at].astype(np.uint32)), "drawn": packed(next_[at]), "known": packed(mean[at])}], REPLY)

        return run

    states = []
    for k in range(-1, BURN_IN + SAMPLES):
        rows = found.join(states[-1][0].drop("known").hint("merge"), "home") if states else found
        messages = rows.mapInArrow(sent(k), "hot int, kind int, chunk bigint, blob binary, t binary")
        rows = together(told.unionByName(messages, allowMissingColumns=True).withColumnRenamed("hot", "bucket"), len(ones), "kind", "chunk")
        states.append(stored(rows.mapInArrow(answered(k), STATE), "lm-seated"))
        if 0 <= k <= BURN_IN:
            discarded(spark, states.pop(-2)[1])
    return states


MESSAGE = pa.schema([("hot", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary()), ("t", pa.binary())])
REPLY = pa.schema([("home", pa.int64()), ("t", pa.binary()), ("opened", pa.binary()), ("drawn", pa.binary()), ("known", pa.binary())])


def after_frequent(dealt: DataFrame, told: DataFrame, often: Often, buckets: int, parts: int) -> DataFrame:
    """bucket, chunk (name of a frequent word's part) and blob (probabilities of its dishes, in order, or by word)."""
    spark, ones, names = dealt.sparkSession, often.words.tolist(), dict(often.homes)
    # kept by home on executors' disks, so that a sweep shuffles what is sent, not the dishes
    found = homes(dealt, len(names)).repartition(len(names), "home").persist(StorageLevel.DISK_ONLY)
    told = written(told.where(F.col("bucket") >= buckets).withColumn("bucket", F.col("bucket") - buckets), "lm-followers")
    states = seated(found, told, often, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                h = Home(x["blob"], ones[x["hot"]])
                p = np.zeros(len(h.c3))
                for j in range(SAMPLES):
                    full = np.zeros(len(h.c3), np.int64)
                    full[h.use] = unpacked(x[f"t{j}"], np.uint32)[0]
                    p += predictive(h.c3, full, h.of3, h.n3, unpacked(x[f"known{j}"], np.float32)[0][h.of2], 2)
                p = (p / SAMPLES).astype(np.float32)
                whole = names[x["home"]] == [x["home"]]
                blob = packed(np.zeros(0, np.int64) if whole else h.known[h.of2], p)
                to = np.array(names[x["home"]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((spread(to) % np.uint64(buckets)).astype(np.int32)), pa.array(to), pa.array([blob] * len(to), pa.binary())], names=["bucket", "chunk", "blob"])

    rows = found
    for j, (state, _) in enumerate(states):
        rows = rows.join(state.select("home", F.col("t").alias(f"t{j}"), F.col("known").alias(f"known{j}")).hint("merge"), "home")
    out = written(rows.mapInArrow(run, "bucket int, chunk bigint, blob binary"), "lm-after")
    found.unpersist()
    for _, path in states:
        discarded(spark, path)
    return out


class Bucket:
    """A bucket's tokens as dishes, and the counts and probabilities of its words."""

    def __init__(self, batches: list[pa.RecordBatch], parts: int):
        count, p, self.parts, opened, told = [], [], [], [], {}
        batches.reverse()
        while batches:  # each goes as soon as it is opened
            for x in batches.pop().to_pylist():
                blob = x.pop("blob")
                if x["kind"] == 1:
                    opened.append(unpacked(blob, *TOKEN_COLUMNS))
                    self.parts.append({k: x[k] for k in ("chunk", "ids", "n_tokens", "held")})
                elif x["kind"] == 2:
                    told[x["chunk"]] = unpacked(blob, np.int64, np.float32)
                else:
                    for held, new in zip((count, p), unpacked(blob, np.int64, np.float32), strict=True):
                        held.append(new)
        self.sizes = [len(o[5]) for o in opened]
        mark = np.concatenate([o[5] for o in opened])
        self.train, self.doc = (mark & 1).astype(bool), (mark >> 1).astype(np.int32)
        (ctxs, ctx), (words_, word) = (merged([o[i] for o in opened], [o[i + 1] for o in opened]) for i in (0, 2))
        two = unthree(np.concatenate([o[4] for o in opened]))
        del opened, mark, blob
        # replies come by part, and in a part in the order of words
        order = np.lexsort((words_, part_of(words_, parts)))
        if sum(map(len, count)) != len(words_):
            raise ValueError("a bucket's words differ from those it asked for")
        self.count, self.p = np.zeros(len(words_), np.int64), np.zeros(len(words_))
        if len(order):
            self.count[order], self.p[order] = np.concatenate(count), np.concatenate(p)
        self.n_ctx, n_words = len(ctxs), max(1, len(words_))
        rows, self.pair = grouped((ctx, max(1, len(ctxs))), (word, n_words))
        self.ctx2, self.word2 = ctx[rows].astype(np.int64), word[rows].astype(np.int64)
        rows, of3 = grouped((ctx, max(1, len(ctxs))), (two, 1 << 24))
        self.n3, restaurants = len(rows), ctx[rows].astype(np.int64) << 24 | two[rows]
        del ctx, two
        # in a restaurant, words and pairs have the same order
        rows, self.dish = grouped((of3, max(1, self.n3)), (word, n_words))
        self.of3, self.of2 = of3[rows].astype(np.int64), self.pair[rows].astype(np.int64)
        del of3, word, rows
        self.c3 = np.bincount(self.dish[self.train], minlength=len(self.of3))
        # dishes after frequent words are seated at their homes
        self.told = []
        for name, (known, p) in told.items():
            at = np.searchsorted(ctxs, name)
            if at == len(ctxs) or ctxs[at] != name:
                continue  # a part that no text falls into
            s = slice(*np.searchsorted(self.of3, np.searchsorted(restaurants, [at << 24, at + 1 << 24])))
            self.told.append((s, p[np.searchsorted(known, words_[self.word2[self.of2[s]]])] if len(known) else p))
            self.c3[s] = 0
        r2 = keys_one(ctxs)
        self.keys = keys_two(r2[restaurants >> 24], restaurants & 0xFFFFFF), r2, words_[self.word2]

    def probabilities(self) -> np.ndarray:
        p = sampled(self.c3, self.of3, self.n3, self.of2, self.ctx2, self.n_ctx, self.p[self.word2], None, self.keys).astype(np.float32)
        for s, known in self.told:
            p[s] = known
        return p.astype(float)


def fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * FIXED) / FIXED


def scored(docs: DataFrame, learn, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learn: the condition of training rows."""
    docs, at = numbered(docs.select(key, text, (~learn).alias("held")))
    docs = docs.withColumnRenamed("c2", "held")
    name, key, text = key, at[key], at[text]
    often, total = frequent(docs, text)
    buckets = GROUPS * max(1, -(-total // (GROUPS * BUCKET_TOKENS)))
    parts = max(8, math.isqrt(16 * buckets))
    dealt, path = dealt_words(docs, often, buckets, text), None
    if often.homes:
        dealt, path = stored(dealt, "lm-dealt")
    told, n, v = top(written(vocabulary(bucket_words(dealt.where("home is null"), buckets + len(often.words), parts), parts), "lm-words"))
    rows = dealt_tokens(docs, often, buckets, key, text).withColumn("kind", F.lit(1))
    more = told.where(F.col("bucket") < buckets).withColumn("kind", F.lit(0))
    if often.homes:
        more = more.unionByName(after_frequent(dealt, told, often, buckets, parts).withColumn("kind", F.lit(2)))
        discarded(docs.sparkSession, path)

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_bucket(batches):
            if not any((b.column(b.schema.get_field_index("kind")).to_numpy() == 1).any() for b in held):
                continue
            b = Bucket(held, parts)
            score = fixed(np.log10(b.probabilities()))
            base = fixed(np.log10((b.count + 0.5) / (n + 0.5 * (v + 1))))[b.word2]
            known, at, out = (b.count > 0)[b.word2], 0, []
            for part, size in zip(b.parts, b.sizes, strict=True):
                which = b.doc[at : at + size]
                seen = np.flatnonzero(np.bincount(which))
                sums = [np.bincount(which, x)[seen] for x in (score[b.dish[at : at + size]], base[b.pair[at : at + size]], known[b.pair[at : at + size]])]
                out.append(part | {"blob": packed(seen.astype(np.uint32), sums[0], sums[1], sums[2].astype(np.uint32))})
                at += size
            yield pa.RecordBatch.from_pylist(out, pa.schema([("chunk", pa.int64()), ("blob", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))]))
            del b, score, base, known, out, seen, which, sums  # before the next bucket is read

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        named_ = pdf[pdf["ids"].notna()].iloc[0]
        size = len(named_["ids"])
        score, base, known = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        for blob in pdf["blob"]:
            seen, *sums = unpacked(blob, np.uint32, np.float64, np.float64, np.uint32)
            for whole, part in zip((score, base, known), sums, strict=True):
                whole[seen] += part
        ids = pd.array([None if x is None or x != x else int(x) for x in named_["ids"]], "Int64")
        return pd.DataFrame({name: ids, "held_out": np.array(list(named_["held"]), bool), "n_tokens": np.array(list(named_["n_tokens"]), np.int64), "n_known": known, "train_tokens": n, "base_score": base, "score": score})

    out = f"`{name}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    sums = together(more.unionByName(rows, allowMissingColumns=True), buckets, "kind", "chunk").mapInArrow(scoring, PART)
    return sums.groupBy("chunk").applyInPandas(added, out)
