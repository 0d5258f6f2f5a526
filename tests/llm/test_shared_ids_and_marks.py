"""Near duplicates among rows that share ids, and normal forms as the library has them."""

import unicodedata

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from wearline.llm import bpe, neardup

WORDS = [f"w{i}" for i in range(400)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, own string, _id string")


def text(seed, n=60, change=()):
    words = list(np.random.default_rng(seed).choice(WORDS, n))
    for i in change:
        words[i] = f"x{seed}{i}"
    return " ".join(words)


def components_by_hand(rows):
    """Links between ids by exact sets of all their texts."""
    sets = []
    for i, t in rows:
        w = t.lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                one, two = sorted((find(i), find(j)))
                root[two] = one
    return {i: find(i) for i in root}


def found(spark, rows):
    got = {}
    for r in neardup.near_duplicates(frame(spark, [(i, t, "o", "c") for i, t in rows])).collect():
        assert r.kept == (r.doc_id == r.component_id)
        assert got.setdefault(r.doc_id, r.component_id) == r.component_id, f"{r.doc_id} is in two components"
    return got


def test_texts_of_an_id_tie_components(spark):
    a, b, c = text(1), text(2), text(3)
    rows = [(5, a), (5, b), (7, b), (7, c), (9, c), (11, text(4))]
    assert found(spark, rows) == {5: 5, 7: 5, 9: 5, 11: 11} == components_by_hand(rows)
    kept = neardup.one_of_each(frame(spark, [(i, t, "o", "c") for i, t in rows])).collect()
    assert sorted({r.doc_id for r in kept}) == [5, 11] and len(kept) == 3


@pytest.mark.parametrize("seed", range(3))
def test_shared_ids_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(120):
        change = rng.choice(60, rng.integers(0, 4), replace=False) if rng.random() < 0.6 else ()
        rows.append((int(rng.integers(0, 90)) * 3 - 20, text(int(rng.integers(0, 45)), 60, change) if rng.random() < 0.95 else ""))
    rows += rows[:5]
    assert found(spark, rows) == components_by_hand(rows)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def alike(library, texts):
    held = bpe.vocabulary(path("word_bpe_49k.json"))
    flat, ends = held.encode(texts)
    for t, a, b, want in zip(texts, ends[:-1], ends[1:], library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert flat[a:b].tolist() == want.ids, [hex(ord(c)) for c in t]


def test_marks_of_each_class_in_both_orders(library):
    late = [chr(c) for a, b in bpe.PLAIN_MARKS for c in range(a, b + 1)]
    others = ["̴", "̧", "̣", "́", "ͅ", "̕"]
    alike(library, [f"{x}{y}{z}" for x in ("e", "ᆓ5", "") for m in late for o in others for y, z in ((m, o), (o, m))])
    every = [c for c in map(chr, range(0x80, 0x1F000)) if unicodedata.combining(c)]
    alike(library, [f"a{x}{y}" for x in every for y in ("̴", "̣", "́")] + [f"a{y}{x}" for x in every for y in ("̴", "̣", "́")])


def test_drawn_strings(library):
    rng = np.random.default_rng(0)
    marks = [c for c in map(chr, range(0x80, 0x1F000)) if unicodedata.combining(c)]
    parts = [chr(int(x, 16)) for c in map(chr, range(0x80, 0x12000)) if (d := unicodedata.decomposition(c)) and not d.startswith("<") for x in d.split()]
    pool = np.array([*marks, *parts, *"aeiou AEIOU"])
    drawn = rng.choice(pool, (100_000, 6))
    alike(library, ["".join(row) for row in drawn])
