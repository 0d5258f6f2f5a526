"""Secret scans: three fixed rules, and a battery of randomness tests on other tokens.

A run of letters of encodings is cut at inner '=', and where it mixes both base64 alphabets at '+', '/' or at '-', '_'.
A token of LEAST characters or more with digits and letters gets the smallest encoding that holds it (hex, base32,
base36, base62, base64) and a p-value from battery.py: chi-squared, runs and serial correlation against those of
ordinary names of its encoding and length, drawn from the letter pairs of all texts.

Which tokens are reported is settled over all tokens of the table by one step-up procedure with weights in proportion to
length, which holds the share of ordinary tokens among those reported below LEVEL.  Spark counts tokens by the weighted
p-value, rounded up to a twentieth of a power of ten, so the driver sees a bounded table at every size.

A null or empty text has no spans; a text is scanned whole whatever its length; repeated rows are scanned each and
equal texts alike; equal p-values are reported together; extra input columns are not carried, whatever their names; an
empty table gives an empty table.  Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import battery
from .common import emit, schema_of, sliced, texts_of, written

#: The three rules, in the order of their names.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: Tokens that the battery takes: runs of base64 letters, either alphabet.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LEAST, LEVEL = battery.LEAST, 0.05
#: Parts of a run, since '=' pads a token at its end only, and the cuts of a part that mixes the two base64 alphabets.
PART = re.compile(r"[^=]+(?:=+$)?")
CUTS = tuple(re.compile(x) for x in (r"[A-Za-z0-9+/]{20,}=*", r"[A-Za-z0-9_-]{20,}=*", r"[A-Za-z0-9]{20,}=*"))
#: Bins of weighted p-values for a power of ten, and the least p-value told apart.
BINS, TINIEST = 20, 1e-290
TESTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bin", pa.int32())]))
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def pieces(run: str) -> list[tuple[int, int]]:
    """Candidates of a run: its parts between inner '=', and of a part that no encoding holds all that is left by each cut."""
    out: set[tuple[int, int]] = set()
    for m in PART.finditer(run):
        part = m.group()
        if any(c in "+/" for c in part) and any(c in "-_" for c in part):
            out |= {(m.start() + c.start(), m.start() + c.end()) for cut in CUTS for c in cut.finditer(part)}
        else:
            out.add(m.span())
    return sorted((a, b) for a, b in out if b - a >= LEAST)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the fixed rules as (start, kind, end), sorted."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def tested(text: str, profiles: battery.Profiles) -> list[tuple[int, int, float]]:
    """(start, end, p-value) of the tokens that the battery takes."""
    out = []
    for m in TOKEN.finditer(text):
        for a, b in pieces(m.group()):
            if (tail := profiles.tail(m.group()[a:b].rstrip("="))) is not None:
                out.append((m.start() + a, m.start() + b, tail[1]))
    return out


def binned(p: float, length: int) -> int:
    """Number of the bin of p / length; its upper edge is 10 to the number over BINS."""
    return math.ceil(BINS * math.log10(max(p, TINIEST) / length))


def last_bin(counts: list[tuple[int, int, int]]) -> int | None:
    """The step-up rule at LEVEL over (bin, tokens, sum of lengths): the largest bin that is reported, None if none is.

    A token's weighted p-value is p / length times the mean length; it is compared with LEVEL times the share of tokens
    up to its own, so the number of tokens cancels."""
    lengths, rank, last = sum(n for _, _, n in counts), 0, None
    for bin, tokens, _ in sorted(counts):
        rank += tokens
        if 10 ** (bin / BINS) * lengths <= LEVEL * rank:
            last = bin
    return last


def joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans with those that overlap (pieces of different cuts) as one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def letter_pairs(df: DataFrame, text: str = "text") -> np.ndarray:
    """battery.pair_counts() of all texts, summed up by Spark: at most 729 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(729, np.int64)
        for batch in sliced(batches, text):
            total += battery.pair_counts(texts_of(batch, text)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(729), pa.int32()), pa.array(total)], names=["pair", "n"])

    out = np.zeros(729, np.int64)
    for r in df.select(text).mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(27, 27)


def find_secrets(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns and secrets, an array of (kind, start, end) by start, then kind as KINDS lists them."""
    profiles = battery.profiles(letter_pairs(df, text))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            texts = texts_of(batch, text)
            base = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base_spans(t)] for t in texts]
            tests = [[{"start": s, "end": e, "bin": binned(p, e - s)} for s, e, p in tested(t, profiles)] for t in texts]
            yield emit(batch, keys, {"_base": pa.array(base, SPANS), "_tests": pa.array(tests, TESTS)})

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    scanned = df.select(*keys, text).mapInArrow(scan, schema_of(df, keys, f"_base {spans}, _tests array<struct<start:bigint,end:bigint,bin:int>>"))
    scanned = written(scanned, "secrets-tests")
    counts = scanned.select(F.explode("_tests").alias("t")).groupBy("t.bin").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.expr("t.end - t.start")).alias("lengths"))
    last = last_bin([(r.bin, r.tokens, r.lengths) for r in counts.collect()])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, tests in zip(batch.column("_base").to_pylist(), batch.column("_tests").to_pylist(), strict=True):
                random = joined([(t["start"], t["end"]) for t in tests if last is not None and t["bin"] <= last])
                rows.append(sorted(base + [{"kind": "random", "start": s, "end": e} for s, e in random], key=lambda x: (x["start"], KINDS.index(x["kind"]))))
            yield emit(batch, keys, {"secrets": pa.array(rows, SPANS)})

    return scanned.mapInArrow(settle, schema_of(df, keys, f"secrets {spans}"))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select(*keys, *map(of, KINDS), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("secrets")).alias("spans"))
