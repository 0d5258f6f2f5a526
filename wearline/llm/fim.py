"""Fill-in-middle transformation, with cuts between words or lines found in a wavelet matrix over character classes.

A text is a row of units: a word with the spaces before it, or spaces at the end (unit "word"); or a line with its break
(unit "line").  Each character has a class that says whether it is a space, a line break or part of a word, and whether a
word ends before it or begins with it.  A wavelet matrix over the classes of all texts of a slice gives the rank of a class
at a place; sums of ranks count the ends of units up to a place, and bisection on that count finds the end of the k-th.
Both cuts of all texts are found at once.

What a document gets is drawn from the sha256 of "seed:id": two cuts, evenly over 0 to n units, the form and its order.
plain is the text; psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle.  restored() takes the marks
out again: a mark holds no beginning of itself but its first character, so it can't arise where a piece meets a mark, and
a text that holds one stays plain.

A null text counts as empty; empty texts and texts with a mark are plain; a null id counts as the empty text after the
colon; repeated rows get the same result each; texts of any length are handled whole; columns that aren't kept don't
matter, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import emit, schema_of, sliced, texts_of

#: Marks before prefix, suffix and middle.
P, S, M = "<P>", "<S>", "<M>"
SEED, PLAIN_PERCENT, SPM_PERCENT = 42, 50, 80
#: Classes by what they say; a space's class adds 1 after a word and 2 if it breaks the line, a word's 1 where it begins.
SPACE, AFTER_WORD, BREAK, WORD, BEGINS = 0, 1, 2, 4, 1
BITS = 3
#: Per unit the classes at which one ends, and how far behind their place.
ENDS = {"word": ((SPACE + AFTER_WORD, SPACE + BREAK + AFTER_WORD), 0), "line": ((SPACE + BREAK, SPACE + BREAK + AFTER_WORD), 1)}


class WaveletMatrix:
    """Ranks of symbols of a few bits.  Per bit, the highest first, a bit vector of the symbols, which are then parted by it
    in a stable way, with the number of ones before each 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels = bits, []
        for bit in range(bits - 1, -1, -1):
            on = (symbols >> bit & 1).astype(bool)
            packed = np.packbits(on, bitorder="little")
            words = np.r_[packed, np.zeros(16 - len(packed) % 8, np.uint8)].view("<u8")
            before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
            self.levels.append((words, before, int(len(symbols) - before[-1])))
            symbols = np.concatenate([symbols[~on], symbols[on]])

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        rest = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & rest)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before each place."""
        low, high = np.zeros(1, np.int64), at
        for level, (_, _, zeros) in enumerate(self.levels):
            a, b = self.ones(level, low), self.ones(level, high)
            low, high = (zeros + a, zeros + b) if symbol >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return high - low


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The class of each character of all texts, and where each text begins, with the end of the last."""
    starts = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    space = (c == 32) | ((c >= 9) & (c <= 13))
    apart = np.r_[True, space][: len(c)]  # nothing or a space is before
    apart[starts[:-1][starts[:-1] < len(c)]] = True
    return np.where(space, SPACE + AFTER_WORD * ~apart + BREAK * (c == 10), WORD + BEGINS * apart).astype(np.uint8), starts


class Units:
    """The units of many texts: how many each has, and where the k-th of each ends."""

    def __init__(self, texts: list[str], unit: str = "word") -> None:
        symbols, self.starts = classes(texts)
        self.enders, self.shift = ENDS[unit]
        self.matrix = WaveletMatrix(symbols, BITS)
        self.before = self.ended(self.starts)
        self.inner = np.diff(self.before)
        self.length = np.diff(self.starts)
        last = symbols[np.maximum(self.starts[1:] - 1, 0)] if len(symbols) else np.zeros(len(texts), np.uint8)
        closed = np.isin(last, self.enders) & bool(self.shift)  # a line break at the very end ends the last line
        self.n = self.inner + ((self.length > 0) & ~closed)

    def ended(self, at: np.ndarray) -> np.ndarray:
        """Ends of units at places before at: a sum of ranks."""
        return sum(self.matrix.rank(s, at) for s in self.enders)

    def end_of(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Characters of the first k units of each text, by bisection on the number of ends."""
        low, high = self.starts[text], self.starts[text + 1]
        goal = self.before[text] + k
        while np.any(low < high):
            mid = (low + high) >> 1
            enough = self.ended(np.minimum(mid + 1, self.starts[-1])) >= goal
            open_ = low < high
            low, high = np.where(open_ & ~enough, mid + 1, low), np.where(open_ & enough, mid, high)
        cut = low + self.shift - self.starts[text]
        return np.where(k == 0, 0, np.where(k > self.inner[text], self.length[text], cut))


def draws(ids: list, seed: int) -> np.ndarray:
    """Four numbers of 32 bits per id."""
    return np.array([[int(h[i : i + 8], 16) for i in (0, 8, 16, 24)] for h in (hashlib.sha256(f"{seed}:{'' if x is None else x}".encode()).hexdigest() for x in ids)], np.int64).reshape(-1, 4)


def rearranged(texts: list[str], ids: list, unit: str = "word", seed: int = SEED, plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT) -> list[tuple]:
    """(output, form, units, characters of prefix and of middle) per text."""
    units, h = Units(texts, unit), draws(ids, seed)
    form = [0 if not t or any(m in t for m in (P, S, M)) or a % 100 >= plain else 1 if b % 100 < spm else 2 for t, (a, b) in zip(texts, h[:, 2:].tolist(), strict=True)]
    cut = np.flatnonzero(form)
    k = np.sort(h[cut, :2] % (units.n[cut, None] + 1), axis=1)
    one, two = units.end_of(cut, k[:, 0]).tolist(), units.end_of(cut, k[:, 1]).tolist()
    out = [(t, "plain", n, None, None) for t, n in zip(texts, units.n.tolist(), strict=True)]
    for i, a, b in zip(cut.tolist(), one, two, strict=True):
        t = texts[i]
        head, middle, tail = t[:a], t[a:b], t[b:]
        joined = f"{S}{tail}{P}{head}{M}{middle}" if form[i] == 1 else f"{P}{head}{S}{tail}{M}{middle}"
        out[i] = (joined, "spm" if form[i] == 1 else "psm", out[i][2], a, b - a)
    return out


def transform(df: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", unit: str = "word", seed: int = SEED, plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """The kept columns with output, form, n (units), prefix_chars and middle_chars (null if plain).

    plain is the percentage of documents left as they are, spm the percentage of the others with the suffix first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            ids = batch.column(batch.schema.get_field_index("_key")).to_pylist()
            rows = list(zip(*rearranged(texts_of(batch, "_text"), ids, unit, seed, plain, spm), strict=True)) or [()] * 5
            kinds = (pa.large_string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ("output", "form", "n", "prefix_chars", "middle_chars")
            yield emit(batch, keep, {c: pa.array(v, kind) for c, v, kind in zip(names, rows, kinds, strict=True)})

    rows = df.select(*keep, F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, schema_of(df, keep, "output string, form string, n bigint, prefix_chars bigint, middle_chars bigint"))


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that output was made from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    after, until = lambda mark: F.substring_index(output, mark, -1), lambda mark, rest: F.substring_index(rest, mark, 1)
    psm = F.concat(until(S, after(P)), after(M), until(M, after(S)))
    spm = F.concat(until(M, after(P)), after(M), until(P, after(S)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


#: The query in SQL, over the documents table.
ORACLE = f"""
    WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, sha256('{SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    t AS (SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, {', '.join(f"('0x' || h[{8 * i + 1}:{8 * i + 8}])::BIGINT AS h{i + 1}" for i in range(4))} FROM d),
    c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
          CASE WHEN text = '' OR contains(text, '{P}') OR contains(text, '{S}') OR contains(text, '{M}') OR h3 % 100 >= {PLAIN_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM t),
    p AS (SELECT *, COALESCE(array_to_string(u[1:a], ''), '') AS head, COALESCE(array_to_string(u[a + 1:b], ''), '') AS middle, COALESCE(array_to_string(u[b + 1:], ''), '') AS tail FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{P}' || head || '{S}' || tail || '{M}' || middle ELSE '{S}' || tail || '{P}' || head || '{M}' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
