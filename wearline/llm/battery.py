"""The battery of randomness tests of secrets.py, and what it says of ordinary tokens and of drawn ones.

A token is told by three statistics over the smallest encoding that holds it: the cube root of chi-squared over its
degrees (are all symbols of the alphabet as frequent), the share of neighbours of different kinds (runs of capitals,
small letters, digits and marks), and the serial correlation of letters (mean over neighbours of the log ratio of how
often text has the pair to how often it would if letters were independent, within +-3).

Each encoding has a null of its own: ordinary() draws names from the corpus's table of letter pairs, word by word, in
the encoding's style (capitals, small, camel, joined by marks), with numbers between words.  profiles() works out the
means and covariances of the statistics at each length, for names and for evenly drawn tokens, from ROWS of each.  The
three tests are combined by the linear discriminant of the two, whose tail among names is the p-value; a token must
also pass each of the three as a drawn one (within PASS deviations).  A token over LONGEST characters is cut into equal
pieces whose scores are added up; no part of it is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: The alphabets, smallest first where several hold a token.
ENCODINGS = (DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_")
PLACES = [{c: i for i, c in enumerate(a)} for a in ENCODINGS]
#: Per mille of the letters a to z in English, for the few pairs that count before the corpus's own.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 1.5, 20, 0.7)
PRIOR_PAIRS, PRIOR_WORD = 1000, 5
LEAST, LONGEST = 20, 128
#: Tokens drawn for each profile, and deviations of a drawn token that pass.
ROWS, PASS = 2000, 3.5
#: Of names: share of words followed by a number, share of its digits followed by one more, weights of digits, styles.
NUMBERS, MORE = 0.3, 0.5
#: A name's own share of letters after which its word ends early is even between 0 and this: some names are of short words.
SHORT = 0.4
DIGIT_SHARES = np.array([0.2, 0.2, 0.15, 0.1, 0.05, 0.08, 0.05, 0.05, 0.06, 0.06])
CAMEL, SMALL = 0.6, 0.2
#: The same of hexadecimal names, which are numbers with short runs of letters.
HEX_NUMBERS, HEX_MORE = 0.8, 0.75
END = 26  # the symbol of all that is no letter


def pair_counts(texts: list[str]) -> np.ndarray:
    """27 x 27 counts of neighbouring letters (either case; END for anything else) of texts, none across two texts."""
    b = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode(), np.uint8) | 32
    code = np.where((b >= 97) & (b <= 122), b - 97, END).astype(np.int64)
    return np.bincount(code[:-1] * 27 + code[1:], minlength=729).reshape(27, 27)


def with_prior(pairs: np.ndarray) -> np.ndarray:
    """Counts with PRIOR_PAIRS pairs of independent English letters in words of PRIOR_WORD, so that every pair is possible."""
    p = np.append(np.array(LETTERS) / sum(LETTERS) * (1 - 1 / PRIOR_WORD), 1 / PRIOR_WORD)
    return pairs + PRIOR_PAIRS * np.outer(p, p)


def associations(pairs: np.ndarray) -> np.ndarray:
    """26 x 26 log ratios of pairs of letters to independent ones, within +-3."""
    p = pairs[:END, :END] / pairs[:END, :END].sum()
    return np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -3, 3)


def symbol_tables(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Kind (0 small, 1 capital, 2 digit, 3 mark) and letter (END if none) of each place of alphabet k."""
    kind = [0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGITS else 3 for c in ENCODINGS[k]]
    return np.array(kind), np.array([ord(c.lower()) - 97 if c.isalpha() else END for c in ENCODINGS[k]])


def ordinary(k: int, pairs: np.ndarray, rows: int, rng: np.random.Generator) -> np.ndarray:
    """rows names of LONGEST symbols in encoding k, as places of its alphabet; pairs as with_prior() gives them."""
    alphabet, places = ENCODINGS[k], PLACES[k]
    inside = np.array([c in places or c.upper() in places for c in LOWER])
    chain = pairs.copy()
    chain[:, :END][:, ~inside] = 0
    chain[END, END] = 0  # after an end comes a word
    steps = np.cumsum(chain / chain.sum(1, keepdims=True), 1)
    small = np.array([places.get(c, places.get(c.upper(), 0)) for c in LOWER])
    capital = np.array([places.get(c.upper(), places.get(c, 0)) for c in LOWER])
    digits = [c for c in DIGITS if c in places]
    shares = DIGIT_SHARES[[int(c) for c in digits]]
    digit, ends = np.array([places[c] for c in digits]), np.cumsum(shares / shares.sum())
    marks = np.array([places[c] for c in alphabet if not c.isalnum()], np.int64)
    mark = marks[rng.integers(0, len(marks), rows)] if len(marks) else None
    style, early = rng.random(rows), SHORT * rng.random(rows)
    numbers, more = (HEX_NUMBERS, HEX_MORE) if len(alphabet) == 16 else (NUMBERS, MORE)
    out = np.zeros((rows, LONGEST), np.int64)
    last, number = np.full(rows, END), np.zeros(rows, bool)
    follow = lambda at: (steps[at] < rng.random(rows)[:, None]).sum(1).clip(0, END)
    for t in range(LONGEST):
        number &= rng.random(rows) < more
        step = follow(last)
        ended = ((step == END) | ((rng.random(rows) < early) & (last != END))) & ~number
        number |= ended & (rng.random(rows) < numbers)
        first = (ended | (last == END)) & ~number
        fresh = follow(np.full(rows, END))
        letter = np.where(ended, fresh, step).clip(0, END - 1)
        big = np.where(style < CAMEL, first, style >= CAMEL + SMALL)
        symbol = np.where(big, capital[letter], small[letter])
        symbol = np.where(number, digit[np.minimum((ends < rng.random(rows)[:, None]).sum(1), len(digit) - 1)], symbol)
        last = np.where(number, END, letter)
        if mark is not None:  # a mark in place of the first letter, which follows it
            joined = ended & ~number & (t > 0)
            symbol, last = np.where(joined, mark, symbol), np.where(joined, END, last)
        out[:, t] = symbol
    return out


def statistics_of(v: np.ndarray, k: int, association: np.ndarray) -> np.ndarray:
    """The three statistics of one token, given as places of alphabet k."""
    kind, letter = symbol_tables(k)
    n, size = len(v), len(ENCODINGS[k])
    x = size / n * float((np.bincount(v, minlength=size) ** 2).sum()) - n
    a, b = letter[v[:-1]], letter[v[1:]]
    both = (a < END) & (b < END)
    return np.array([(max(x, 0.0) / (size - 1)) ** (1 / 3), float((kind[v[1:]] != kind[v[:-1]]).mean()), float(association[a[both], b[both]].sum()) / (n - 1)])


def growing_statistics(v: np.ndarray, k: int, association: np.ndarray) -> np.ndarray:
    """The three statistics of all prefixes of many drawn tokens at once: (length, row, statistic), lengths from 0."""
    kind, letter = symbol_tables(k)
    rows, size, all_rows = len(v), len(ENCODINGS[k]), np.arange(len(v))
    wide = np.zeros((27, 27))
    wide[:END, :END] = association
    counts, squares, switches, linked = np.zeros((rows, size)), np.zeros(rows), np.zeros(rows), np.zeros(rows)
    out = np.zeros((v.shape[1] + 1, rows, 3))
    for t in range(v.shape[1]):
        squares += 2 * counts[all_rows, v[:, t]] + 1
        counts[all_rows, v[:, t]] += 1
        if t:
            switches += kind[v[:, t]] != kind[v[:, t - 1]]
            linked += wide[letter[v[:, t - 1]], letter[v[:, t]]]
        n = t + 1
        out[n] = np.stack([(np.maximum(size / n * squares - n, 0) / (size - 1)) ** (1 / 3), switches / max(1, t), linked / max(1, t)], 1)
    return out


@dataclass
class Profiles:
    """By encoding and length: the discriminant of names (a score of mean 0 and deviation 1 among names), and means and
    deviations of drawn tokens; the table of associations."""

    weights: np.ndarray
    offsets: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    association: np.ndarray

    def tail(self, body: str) -> tuple[int, float] | None:
        """Encoding and p-value of the token being ordinary (1 if it doesn't pass as drawn); None if no encoding holds
        it, it is shorter than LEAST, or it lacks a digit or a letter."""
        k = next((k for k, places in enumerate(PLACES) if all(c in places for c in body)), None)
        if k is None or len(body) < LEAST or not any(c in DIGITS for c in body) or not any(c.isalpha() for c in body):
            return None
        v = np.array([PLACES[k][c] for c in body])
        parts = np.array_split(v, math.ceil(len(v) / LONGEST))
        score, off = 0.0, np.zeros(3)
        for part in parts:
            t, n = statistics_of(part, k, self.association), len(part)
            score += float(self.weights[k, n] @ t - self.offsets[k, n])
            off += (t - self.means[k, n]) / self.deviations[k, n]
        root = math.sqrt(len(parts))
        return k, 1.0 if (abs(off) > PASS * root).any() else 0.5 * math.erfc(score / root / math.sqrt(2))


def profiles(pairs: np.ndarray, seed: int = 0) -> Profiles:
    """From the corpus's counts of pairs; the same counts give the same profiles."""
    pairs = with_prior(pairs)
    association = associations(pairs)
    weights, offsets, means, deviations = (np.zeros((len(ENCODINGS), LONGEST + 1, *s)) for s in ((3,), (), (3,), (3,)))
    for k, alphabet in enumerate(ENCODINGS):
        rng = np.random.default_rng((seed, k))
        names = growing_statistics(ordinary(k, pairs, ROWS, rng), k, association)
        drawn = growing_statistics(rng.integers(0, len(alphabet), (ROWS, LONGEST)), k, association)
        for n in range(LEAST // 2, LONGEST + 1):
            null, other = np.cov(names[n].T) + 1e-9 * np.eye(3), np.cov(drawn[n].T) + 1e-9 * np.eye(3)
            middle = names[n].mean(0)
            w = np.linalg.solve(null + other, drawn[n].mean(0) - middle)
            w /= math.sqrt(w @ null @ w)
            weights[k, n], offsets[k, n], means[k, n], deviations[k, n] = w, w @ middle, drawn[n].mean(0), np.sqrt(np.diag(other))
    return Profiles(weights, offsets, means, deviations, association)
