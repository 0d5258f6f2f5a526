"""Words and shingles of whole texts as 63-bit hashes, by numpy over many texts at once."""

from __future__ import annotations

import numpy as np

MASK = np.uint64((1 << 63) - 1)
#: Bytes between words, and the same with ASCII punctuation.
SPACES = bytes([32, *range(9, 14)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Odd multipliers of the words of a shingle.
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word; one to one."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD[0]))
#: Bytes of text whose letters are summed at once.
PIECE = 1 << 17
_POWERS = {ODD[1]: np.ones(1, np.uint64), pow(ODD[1], -1, 1 << 64): np.ones(1, np.uint64)}


def powers(n: int, of: int = ODD[1]) -> np.ndarray:
    """The first n powers of an odd number, kept as long as they last."""
    if len(_POWERS[of]) < n:
        _POWERS[of] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, 4096) - 1, of, np.uint64)])
    return _POWERS[of][:n]


def inverses(n: int) -> np.ndarray:
    """The inverses of the first n powers."""
    return powers(n, pow(ODD[1], -1, 1 << 64))


def words(texts: list[str], gaps: bytes = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, and last two bytes as one number, of all words of the texts (A-Z in lower case), where each text's words end
    (with a 0 in front), and the length in bytes."""
    parts = [t.encode("utf-8", "replace").translate(LOWER) for t in texts]
    whole = b"\x20".join([*parts, b""])
    inside = np.ones(256, bool)
    inside[list(gaps)] = False
    raw, solid = np.frombuffer(whole, np.uint8), np.zeros(len(whole) + 2, bool)
    solid[1:-1] = np.frombuffer(whole.translate(inside.tobytes()), bool)
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    begin, end = edge[::2], edge[1::2]
    size = end - begin
    ends = np.r_[0, np.searchsorted(begin, np.cumsum([len(p) + 1 for p in parts]))] if parts else np.zeros(1, np.int64)
    if not len(size):
        return np.empty(0, np.uint64), np.empty(0, np.int64), ends, size
    h, letter = np.empty(len(size), np.uint64), np.where(inside, LETTER, np.uint64(0))
    cuts = [*np.unique(np.searchsorted(begin, np.arange(0, len(raw), PIECE))).tolist(), len(begin)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            # powers count from the piece's begin; an inverse makes them count from the word's
            first, low, high = begin[a:b] - begin[a], begin[a], end[b - 1]
            h[a:b] = np.add.reduceat(letter[raw[low:high]] * powers(high - low), first) * inverses(first[-1] + 1)[first]
    before = np.where(size > 1, raw[np.maximum(end - 2, 0)], 0).astype(np.int64)
    return mix(h + size.astype(np.uint64) * np.uint64(ODD[2])) & MASK, raw[end - 1].astype(np.int64) * 256 + before, ends, size


def beginnings(texts: list[str], gaps: bytes, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and, of those with more bytes, of their first bytes in each of the lengths; the text each
    hash belongs to, and the number of words of each text."""
    parts = [t.encode("utf-8", "replace").translate(LOWER) for t in texts]
    raw = np.frombuffer(b"\x20".join([*parts, b""]), np.uint8)
    inside = np.ones(256, bool)
    inside[list(gaps)] = False
    solid = inside[raw]
    edge = np.diff(np.r_[False, solid, False].astype(np.int8))
    begin = np.flatnonzero(edge == 1)
    size = np.flatnonzero(edge == -1) - begin
    owner = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), begin, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    if not len(size):
        return np.empty(0, np.uint64), owner, n_words
    first = np.r_[0, np.cumsum(size)[:-1]]
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    term = LETTER[raw[solid]] * powers(int(size.max()))[place]
    found, whose = [mix(np.add.reduceat(term, first) + size.astype(np.uint64) * np.uint64(ODD[2]))], [owner]
    for n in lengths:
        long = size > n
        part = np.add.reduceat(np.where(place < n, term, np.uint64(0)), first)[long]
        found.append(mix(part + np.uint64((n + (1 << 32)) * ODD[3] % (1 << 64))))
        whose.append(owner[long])
    return np.concatenate(found) & MASK, np.concatenate(whose), n_words


def shingles(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Each text's distinct hashes of k words in a row, sorted; of fewer words the whole sequence; none of none."""
    h, _, ends, _ = words(texts)
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        s += h[j : len(h) - k + 1 + j] * np.uint64(ODD[j])
    s = (mix(s) & MASK).astype(np.int64)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= k:
            part = np.sort(s[a : b - k + 1])
            out.append(part[np.r_[True, part[1:] != part[:-1]]])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for j in range(a, b):
                short = short * np.uint64(ODD[2]) + h[j]
            out.append((mix(short) & MASK).astype(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out
