"""License scans: words of a phrase that follow one another, and a positional index over license templates.

Words are runs of digits, a-z (A-Z count as these) and characters beyond ASCII; places are numbers of words, from 0.
Base phrases are found where their words stand consecutively.  The index finds templates - notices and the texts of
licenses - also where words were changed, left out or put in:

* How many documents hold a word of a template is counted over the whole corpus; a rarer word weighs more (its IDF).
* Of a template's words that a file has, the RARE ones of highest IDF are looked up.  If they have less than MASS of the
  weight of the template's own RARE rarest words, the template is left out.
* Each place of such a word and each posting of it in the template give a relative position, place minus posting.  Where
  words of MASS of the weight agree in it, up to SLACK places, the template may stand there.
* There, the template's key phrases must stand word by word, none of the phrases that tell a relative from it may, and a
  share of at least LEAST of all its words must be near its relative position.  That share is the match's score.

Each label is reported once per document with its best match; a base phrase scores 1.  All words of a text and all places
of a word are looked at; work grows with the text.  A null or empty text, or one without words, has no words and no
labels; repeated rows get the same result each; ties between places go to the higher share, then to the first; texts are
handled whole, however long; columns that aren't kept don't matter, whatever their names; an empty table gives an empty
table.  Words are compared by 63-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import emit, schema_of, sliced, texts_of
from .hashing import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes between words, after A-Z became a-z.
GAPS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
RARE, SLACK, MASS, LEAST = 10, 6, 0.6, 0.6

# Phrases and labels of the base rule.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Labels, wording of public notices and licenses, phrases that must stand there, and phrases that mustn't.
TEMPLATES: list[tuple[str, str, list[str], list[str]]] = [
    ("mit", "Released under the MIT License.", ["mit license"], []),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software.""", ["permission is hereby granted free of charge", "shall be included in all copies"], []),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", ["apache license", "version 2"], []),
    ("apache-2", """you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ["except in compliance with the license", "apache org licenses license 2"], []),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation; either version 2 of the License, or (at your option) any later version.""", ["gnu general public license", "version 2"], []),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2.", ["gnu general public license version 2"], []),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version.""", ["gnu general public license", "version 3"], []),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license version 3"], []),
    ("lgpl-3", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version.""", ["gnu lesser general public license", "version 3"], []),
    ("agpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version.""", ["gnu affero general public license", "version 3"], []),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        ["redistribution and use in source and binary forms", "must retain the above copyright notice"], ["neither the name"]),
    ("bsd-3-clause", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""", ["neither the name", "endorse or promote products derived from this software"], []),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies.""", ["for any purpose with or without fee is hereby granted"], []),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
        this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.""",
        ["permission is granted to anyone to use this software", "redistribute it freely"], []),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
        at http://mozilla.org/MPL/2.0/.""", ["mozilla public license v 2"], []),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", ["free and unencumbered software", "public domain"], []),
    ("cc0", """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under
        copyright law, including all related and neighboring rights, to the extent allowed by law.""", ["dedicated the work to the public domain"], []),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution", "international license"], ["noncommercial", "sharealike", "share alike", "noderivatives"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["creative commons attribution sharealike"], ["noncommercial"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["creative commons attribution noncommercial"], []),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"], []),
]


def in_words(text: str) -> list[str]:
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


class Index:
    """Templates and phrases as numbers of words, and the words' sorted hashes.  Its size is that of the templates."""

    def __init__(self, templates: list[tuple[str, str, list[str], list[str]]] = TEMPLATES, base: list[tuple[str, str]] = BASE) -> None:
        texts = [[in_words(x) for x in (t, *must, *never)] for _, t, must, never in templates]
        phrases = [in_words(x) for x, _ in base]
        every = sorted({w for group in (*texts, phrases) for x in group for w in x})
        hashed = words(every, GAPS)[0]
        order = np.argsort(hashed)
        self.hashes, self.words = hashed[order], [every[i] for i in order.tolist()]
        of = {w: i for i, w in enumerate(self.words)}
        number = lambda x: np.array([of[w] for w in x], np.int64)
        self.base = [(number(x), label) for x, (_, label) in zip(phrases, base, strict=True)]
        self.labels = [label for label, *_ in templates]
        self.templates = [number(x[0]) for x in texts]
        self.must = [[number(p) for p in x[1 : 1 + len(must)]] for x, (_, _, must, _) in zip(texts, templates, strict=True)]
        self.never = [[number(p) for p in x[1 + len(must) :]] for x, (_, _, must, _) in zip(texts, templates, strict=True)]

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of the texts, -1 if no template has it, and where each text's words end, with a 0 in front."""
        h, _, ends, _ = words(texts, GAPS)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1), ends


def standing(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the words of phrase follow one another."""
    at = np.flatnonzero(ids[: len(ids) - len(phrase) + 1] == phrase[0]) if len(ids) >= len(phrase) else np.empty(0, np.int64)
    for k in range(1, len(phrase)):
        at = at[ids[at + k] == phrase[k]]
    return at


def frequencies(df: DataFrame, index: Index, text: str = "text") -> tuple[int, np.ndarray]:
    """How many documents there are, and how many hold each word of the templates.  A row per word comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, np.zeros(len(index.words), np.int64)
        for batch in sliced(batches, "_text"):
            ids, ends = index.numbered(texts_of(batch, "_text"))
            total += len(batch)
            owner = np.repeat(np.arange(len(batch)), np.diff(ends))[ids >= 0]
            held += np.bincount(np.unique(owner * len(held) + ids[ids >= 0]) % len(held), minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[total, held[at]], pa.int64())], names=["word", "n"])

    found = {r["word"]: r["n"] for r in df.select(F.col(text).alias("_text")).mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(-1, 0), np.array([found.get(i, 0) for i in range(len(index.words))], np.int64)


class Scanner:
    """The index with the words' weights: which template words a file is asked for, and where a template's words stand."""

    def __init__(self, index: Index, n_docs: int, held: np.ndarray) -> None:
        self.index = index
        self.weight = np.log((n_docs + 2) / (held + 1))
        self.words_of = [np.unique(t) for t in index.templates]
        self.full = np.array([np.sort(self.weight[u])[::-1][:RARE].sum() for u in self.words_of])
        self.postings = [{w: np.flatnonzero(t == w) for w in u.tolist()} for t, u in zip(index.templates, self.words_of, strict=True)]
        self.member = np.zeros((len(index.templates), len(index.words)), bool)
        for k, u in enumerate(self.words_of):
            self.member[k, u] = True

    def chosen(self, present: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The templates that a file with these words may hold, and the words of highest weight to look up for each."""
        mass = self.member[:, present] * self.weight[present]
        top = np.argsort(-mass, axis=1, kind="stable")[:, :RARE]
        enough = np.flatnonzero(np.take_along_axis(mass, top, axis=1).sum(axis=1) >= MASS * self.full)
        return [(k, present[top[k][self.member[k, present[top[k]]]]]) for k in enough.tolist()]

    def aligned(self, k: int, look: np.ndarray, places: dict[int, np.ndarray]) -> np.ndarray:
        """Relative positions, up to SLACK, in which words of enough weight agree."""
        at, whose = [], []
        for w in look.tolist():
            d = (places[w][:, None] - self.postings[k][w][None, :]).ravel()
            at.append(d)
            whose.append(np.full(len(d), w))
        d, w = np.concatenate(at), np.concatenate(whose)
        out = []
        for shift in (0, SLACK):  # two rows of bins, so that any SLACK places in a row are in one bin of either
            bins = (d + shift) // (2 * SLACK)
            one = np.unique(np.stack([bins, w]), axis=1)
            edge = np.flatnonzero(np.r_[True, one[0][1:] != one[0][:-1]])
            mass = np.add.reduceat(self.weight[one[1]], edge)
            out.append(one[0][edge][mass >= MASS * self.full[k] - 1e-9] * 2 * SLACK - shift)
        return np.unique(np.concatenate(out))

    def share(self, ids: np.ndarray, template: np.ndarray, start: int) -> float:
        """How many of a template's words are near their relative position."""
        near = np.zeros(len(template), bool)
        for s in range(start - SLACK, start + 3 * SLACK):
            low, high = max(0, -s), min(len(template), len(ids) - s)
            if low < high:
                near[low:high] |= ids[s + low : s + high] == template[low:high]
        return float(near.mean())

    def matches(self, ids: np.ndarray) -> list[tuple[str, int, int, float, bool]]:
        """(label, first word, words, score, base) of one document's words, base matches at all their places."""
        out = [(label, int(p), len(phrase), 1.0, True) for phrase, label in self.index.base for p in standing(ids, phrase)]
        known = np.flatnonzero(ids >= 0)
        order = known[np.argsort(ids[known], kind="stable")]
        present, first = np.unique(ids[order], return_index=True)
        picks = self.chosen(present) if len(present) else []
        if not picks:
            return sorted(out)
        places = dict(zip(present.tolist(), np.split(order, first[1:]), strict=True))
        best: dict[str, tuple[float, int, int]] = {}
        for k, look in picks:
            template = self.index.templates[k]
            for start in self.aligned(k, look, places).tolist():
                low, high = max(0, start - SLACK), start + len(template) + 3 * SLACK
                region = ids[low:high]
                if not all(len(standing(region, p)) for p in self.index.must[k]) or any(len(standing(region, p)) for p in self.index.never[k]):
                    continue
                share = self.share(ids, template, start)
                if share >= LEAST:
                    found = (share, -max(0, start), len(template))
                    best[self.index.labels[k]] = max(best.get(self.index.labels[k], found), found)
        return sorted(out + [(label, -at, n, share, False) for label, (share, at, n) in best.items()])


def scan(df: DataFrame, keep: list[str], text: str = "text", index: Index | None = None) -> DataFrame:
    """The kept columns, n_words and matches: an array of (label, first_word, words, score, base).

    The corpus is read twice, first to count in how many documents each word of the templates is."""
    index = index or Index()
    scanner = Scanner(index, *frequencies(df, index, text))
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            ids, ends = index.numbered(texts_of(batch, "_text"))
            ends = np.asarray(ends).tolist()
            rows = [scanner.matches(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield emit(batch, keep, {"n_words": pa.array(np.diff(ends), pa.int64()), "matches": pa.array([[dict(zip(("label", "first_word", "words", "score", "base"), m, strict=True)) for m in r] for r in rows], kind)})

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema_of(df, keep, "n_words bigint, matches array<struct<label:string,first_word:bigint,words:bigint,score:double,base:boolean>>"))


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """Number, first and last place of base matches, base labels, all labels, and the best score (0 without a match)."""
    base = F.filter("matches", lambda m: m["base"])
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    ends = [f(F.transform(base, lambda m: m["first_word"])).alias(n) for f, n in ((F.array_min, "first_word"), (F.array_max, "last_word"))]
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return found.select(*keep, "n_words", F.size(base).cast("long").alias("n_base"), *ends, named(F.transform(base, lambda m: m["label"])).alias("base_labels"), named(F.transform("matches", lambda m: m["label"])).alias("labels"), score.alias("score"))


def label_counts(found: DataFrame) -> DataFrame:
    """How many documents have each label."""
    return found.select(F.explode(F.array_distinct(F.transform("matches", lambda m: m["label"]))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))


def _places(phrase: str) -> str:
    parts = in_words(phrase)
    return f"list_filter(range(0, len(w) - {len(parts) - 1}), lambda i: {' AND '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(parts))})"


#: The base columns of the query in SQL, over the documents table.
ORACLE_BASE = f"""
    WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(COALESCE(text, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') AS raw FROM documents),
    d AS (SELECT doc_id, list_transform(raw, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM t),
    p AS (SELECT doc_id, len(w) AS n_words, {', '.join(f'{_places(x)} AS p{k}' for k, (x, _) in enumerate(BASE))} FROM d),
    q AS (SELECT *, {' || '.join(f'p{k}' for k in range(len(BASE)))} AS every FROM p)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word,
           array_to_string(list_sort(list_distinct(list_filter([{', '.join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(BASE))}], lambda x: x IS NOT NULL))), ',') AS base_labels FROM q"""
