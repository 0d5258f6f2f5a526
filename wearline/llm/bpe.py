"""BPE encoding and decoding with a word-level vocabulary file.

A text is normalised (NFC, lower case), cut at white space, and each piece is cut into words by the file's pattern.
Distinct unseen words of a batch become one flat symbol array; each round looks up the ranks of all neighbouring
pairs by binary search over the sorted pair keys and merges every word's lowest-ranked pair at once.

Edge cases: a null or empty text has no ids and decodes to ""; extra input columns are not carried, whatever their
names; repeated rows are encoded each on its own; of pairs of equal rank in a word all are merged, from the left; an
empty table gives an empty table.  Strings of special tokens in a text become their ids,
as in the library.  A text's length is not limited.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import emit, schema_of, sliced, texts_of

#: Fixed value: how the vocabulary file cuts words; {new} are code points that word_pattern() takes out of both classes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[{new}]]+|[\p{N}--[{new}]]|[[^\s\p{L}\p{N}]||[{new}]]+"
#: Ranges of letters that Unicode 16 adds, and ranges of capitals that Unicode 16 and 17 add with their first small letter.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
CAPITALS_17 = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB),
    (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: Ranges of combining marks, and the second part of the composition U+11935 U+11930, that the library's older NFC takes for plain characters.
PLAIN_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C),
    (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A),
    (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
PLAIN_MARK = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in PLAIN_MARKS) + "])")
SMALL_17 = {c: small + c - a for a, b, small in CAPITALS_17 for c in range(a, b + 1)}
ANY_CAPITAL_17 = re.compile("[" + "".join(map(chr, SMALL_17)) + "]")
#: White space of the pattern; str.split() also cuts at U+001C to U+001F.
SPACE = regex.compile(r"\s+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Pieces remembered by a worker; when full it starts anew, which changes no result.
MEMORY = 200_000
#: Bytes of text encoded at once.
AT_ONCE = 2 << 20
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def word_pattern() -> regex.Pattern:
    """PATTERN with the library's letters and numbers: those that unicodedata knows, and LETTERS_16; the regex module knows more."""
    every = "".join(map(chr, (*range(128, 0xD800), *range(0xE000, sys.maxunicode + 1))))
    known = {c for a, b in LETTERS_16 for c in range(a, b + 1)}
    new = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn" and ord(c) not in known]
    cuts = [k for k in range(1, len(new)) if new[k] != new[k - 1] + 1]
    runs = [f"\\U{new[a]:08x}-\\U{new[b - 1]:08x}" for a, b in zip([0, *cuts], [*cuts, len(new)], strict=True)] if new else [r"\n"]
    return regex.compile(PATTERN.replace("{new}", "".join(runs)), regex.V1)


def composed(text: str) -> str:
    """NFC as the library's table has it: marks that came later stand for themselves, and nothing is ordered or joined across them."""
    if PLAIN_MARK.search(text):
        return "".join(unicodedata.normalize("NFC", part) for part in PLAIN_MARK.split(text))
    return unicodedata.normalize("NFC", text)


def gather(flat: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[ends[k] : ends[k + 1]] of the given slots one after the other, and where each ends."""
    size = ends[slots + 1] - ends[slots]
    stops = np.r_[0, np.cumsum(size)]
    return flat[np.repeat(ends[slots] - stops[:-1], size) + np.arange(stops[-1])], stops


class Vocabulary:
    """Ids, sorted pair keys and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        ids, merges = held["model"]["vocab"], held["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        end = held["model"].get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int64)
        self.last = np.array([ids[x + end] for x in letters], np.int64)
        self.special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        self.names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.base = max(self.names) + 1
        keys = np.array([ids[a] * self.base + ids[b] for a, b in merges], np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = word_pattern()
        self.forget()

    def ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at the given places, NONE where a pair has none or crosses words."""
        after = np.minimum(at + 1, len(symbols) - 1)
        keys = symbols[at] * self.base + symbols[after]
        near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[near] == keys) & (word[at] == word[after]) & (after > at), self.rank[near], NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the (non-empty) words in one array and where each word's end, by merge rounds over all of them."""
        coded = [w.encode("utf-8", "replace") for w in words]
        size = np.array([len(c) for c in coded], np.int64)
        raw = np.frombuffer(b"".join(coded), np.uint8)
        symbols, word = self.inner[raw], np.repeat(np.arange(len(words)), size)
        symbols[np.cumsum(size) - 1] = self.last[raw[np.cumsum(size) - 1]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = self.ranks(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
            if (over := least == NONE).any():
                done.append((word[over], symbols[over]))
                symbols, word, rank, least = symbols[~over], word[~over], rank[~over], least[~over]
            at = np.flatnonzero(rank == least)
            if not len(at):
                break
            # of overlapping equal pairs (aaa) every second one merges, from the left
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            new = at - np.arange(len(at))
            for touched in (new, new[new > 0] - 1):
                rank[touched] = self.ranks(symbols, word, touched)
        if not done:
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.int32), np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]

    def forget(self) -> None:
        """Empties the memory of pieces; special tokens stay, behind a space, which no piece holds."""
        self.slot: dict[str, int] = {f" {x}": k for k, x in enumerate(self.special)}
        self.flat, self.ends = np.array([*self.special.values()], np.int32), np.arange(len(self.special) + 1)

    def learn(self, pieces: list[str]) -> None:
        """Gives unseen pieces a slot each: the ids of slot k are flat[ends[k] : ends[k + 1]]."""
        cut = [self.words.findall(p) for p in pieces]
        distinct = list(dict.fromkeys(w for ws in cut for w in ws))
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        flat, ends = self.merge(distinct)
        flat, stops = gather(flat, ends, np.array([number[w] for ws in cut for w in ws], np.int64))
        length = np.diff(stops[np.r_[0, np.cumsum([len(ws) for ws in cut])]])
        self.slot.update(zip(pieces, range(len(self.slot), len(self.slot) + len(pieces)), strict=True))
        self.flat, self.ends = np.concatenate([self.flat, flat]), np.r_[self.ends, self.ends[-1] + np.cumsum(length)]

    @staticmethod
    def pieces(text: str) -> list[str]:
        if not text.isascii():
            text = composed(text)
            # letter by letter: a whole-text lower() would treat a final sigma apart
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            if ANY_CAPITAL_17.search(text):
                text = text.translate(SMALL_17)
        else:
            text = text.lower()
        return SPACE.split(text) if ODD_SPACE.search(text) else text.split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts in one array, and where each text's end."""
        parts: list[list[str]] = []
        for text in texts:
            if self.cut is None or not self.cut.search(text):
                parts.append(self.pieces(text))
                continue
            own, at = [], 0
            for m in self.cut.finditer(text):
                own += [*self.pieces(text[at : m.start()]), f" {m.group()}"]
                at = m.end()
            parts.append(own + self.pieces(text[at:]))
        seen = set().union(*parts) if parts else set()
        if len(self.slot) + len(seen) > MEMORY:
            self.forget()
        if fresh := [p for p in seen if p not in self.slot]:
            self.learn(fresh)
        per = np.array([len(own) for own in parts], np.int64)
        slots = np.array([k for own in parts for k in map(self.slot.__getitem__, own)], np.int64)
        flat, stops = gather(self.flat, self.ends, slots)
        return flat, stops[np.r_[0, np.cumsum(per)]]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by one space; the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


def encode(df: DataFrame, path: str, keys: list[str], text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The key columns and ids array<int> of every whole text; with decoded, also the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        for batch in sliced(batches, text, AT_ONCE):
            values, offsets = held.encode(texts_of(batch, text))
            more = {ids: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))}
            if decoded:
                more[decoded] = pa.array([held.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
            yield emit(batch, keys, more)

    return df.select(*keys, text).mapInArrow(run, schema_of(df, keys, f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else "")))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that its ids stand for; special tokens stay; null ids decode to ""."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        for whole in batches:
            at = whole.schema.get_field_index(ids)
            step = max(1, (2 << 20) * len(whole) // max(1, whole.column(at).nbytes // 4))
            for k in range(0, len(whole), step):
                batch = whole.slice(k, step)
                lists = batch.column(at)
                ends = np.asarray(lists.offsets)
                values = np.asarray(lists.values)
                texts = ["" if n is None else held.decode(values[ends[i] : ends[i + 1]]) for i, n in enumerate(lists.value_lengths().to_pylist())]
                yield emit(batch, keep, {text: pa.array(texts, pa.string())})

    return df.select(*keep).mapInArrow(run, schema_of(df, keep, f"`{text}` string"))
