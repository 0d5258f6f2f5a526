"""Fill-in-middle, license scans and the manifest against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import fim, licenses, manifest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n string, form string, g string, h string, _key string"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LINE = re.compile(r"[^\n]*\n|[^\n]+")


def docs(spark, rows):
    """rows of (id, text, source); other columns clash with names that the operators make."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x", "x") for i, t, s in rows], DOCS)


def odd_texts():
    rng = np.random.default_rng(3)
    drawn = ["".join(rng.choice(list("ab \n\t<PSM>é\x0b\x00"), n)) for n in rng.integers(0, 60, 150)]
    return [None, "", " ", "\n", " a", "a ", "a", "😀 ü\n\n z ", "text with <P> inside", "<S", "<M>", "a <S b<", *drawn, " ".join(f"w{i % 997}" for i in range(400_000)), " \n" * 5000]


# 11

def test_ranks_are_those_of_counting():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        x = rng.integers(0, 8, n).astype(np.uint8)
        matrix = fim.WaveletMatrix(x, 3)
        at = np.arange(n + 1)
        for s in range(8):
            assert np.array_equal(matrix.rank(s, at), np.r_[0, np.cumsum(x == s)])


@pytest.mark.parametrize(("unit", "rule"), [("word", TOKEN), ("line", LINE)])
def test_units_end_where_the_pattern_says(unit, rule):
    texts = [t or "" for t in odd_texts()]
    units = fim.Units(texts, unit)
    parts = [rule.findall(t) for t in texts]
    assert units.n.tolist() == [len(p) for p in parts]
    for i, p in enumerate(parts):
        k = np.arange(len(p) + 1)[: 2000 if len(p) > 2000 else None]
        assert units.end_of(np.full(len(k), i), k).tolist() == np.r_[0, np.cumsum([len(x) for x in p])].astype(int)[: len(k)].tolist()


def by_hand(text, key):
    text, h = text or "", hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    parts = TOKEN.findall(text)
    n = len(parts)
    if not text or re.search("<[PSM]>", text) or c % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    head, middle, tail = ("".join(x) for x in (parts[:low], parts[low:high], parts[high:]))
    out = f"<S>{tail}<P>{head}<M>{middle}" if d % 100 < 80 else f"<P>{head}<S>{tail}<M>{middle}"
    return n, "spm" if d % 100 < 80 else "psm", len(head), len(middle), out


def test_fim_is_the_plain_rule_and_comes_back(spark):
    rows = [(i, t, "s") for i, t in enumerate(odd_texts())] + [(None, "a b c", "s"), (7, "a", "s"), (7, "a", "s")]
    made = fim.transform(docs(spark, rows), ["doc_id", "text", "n"][:2], "doc_id")
    got = made.withColumn("back", fim.restored("output", "form")).collect()
    key = lambda x: (str(x[0]), x[1] or "")
    want = sorted(((i, t, *by_hand(t, i)) for i, t, _ in rows), key=key)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == want
    assert all(r.back == (r.text or "") for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs(spark, []), ["doc_id"]).count() == 0


def test_fim_rates(spark):
    rows = docs(spark, [(i, "some words here\nand there", "s") for i in range(400)])
    forms = {r["form"]: r["count"] for r in fim.transform(rows, [], unit="line", plain=100, spm=0).groupBy("form").count().collect()}
    assert forms == {"psm": 400}


# 12

def filler(n, seed=0):
    return " ".join(np.random.default_rng(seed).choice("lorem amet dolor quiet rivers copper moons jolly wizards bridges stone".split(), n))


def changed(text, seed, every):
    """Each every-th word replaced, left out or doubled."""
    rng, out = np.random.default_rng(seed), []
    for i, w in enumerate(text.split()):
        if i % every == every - 1 and w.lower() not in ("license,", "version", "2", "3"):
            kind = rng.integers(3)
            out += [["zzz"], [], [w, w]][kind]
        else:
            out.append(w)
    return " ".join(out)


@pytest.fixture(scope="module")
def index():
    return licenses.Index()


def test_every_template_is_found_alone_and_inside_a_text(spark, index):
    rows = []
    for k, (_, text, _, _) in enumerate(licenses.TEMPLATES):
        rows += [(2 * k, text, "s"), (2 * k + 1, f"{filler(500, k)}\n/* {text.upper()} */\n{filler(300, k + 50)}", "s")]
    rows += [(1000 + i, filler(200, i), "s") for i in range(300)]
    got = {r.doc_id: r for r in licenses.digests(licenses.scan(docs(spark, rows), ["doc_id"]), ["doc_id"]).collect()}
    for k, (label, *_) in enumerate(licenses.TEMPLATES):
        for i in (2 * k, 2 * k + 1):
            assert label in got[i].labels.split(",") and got[i].score == 1.0, (label, got[i])
    assert all(got[i].labels == "" and got[i].score == 0 and got[i].n_base == 0 for i in got if i >= 1000)


def test_changed_texts_are_found_and_relatives_are_told_apart(spark):
    mit, gpl3, gpl2 = licenses.TEMPLATES[1][1], licenses.TEMPLATES[6][1], licenses.TEMPLATES[4][1]
    bsd = next(t for label, t, *_ in licenses.TEMPLATES if label == "bsd-2-clause")
    three = bsd + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    keyless = gpl3.replace("version 3", "version III")
    rows = [(0, filler(90) + " " + mit.replace("without limitation", "but not limited to").replace("sublicense, and/or sell", "sublicense, rent, sell"), "s"), (1, gpl3, "s"), (2, gpl2, "s"), (3, bsd, "s"), (4, three, "s"), (5, keyless, "s"), (6, " ".join(sorted(mit.split())), "s")]
    rows += [(100 + i, filler(100, i), "s") for i in range(300)]
    got = {r.doc_id: r for r in licenses.digests(licenses.scan(docs(spark, rows), ["doc_id"]), ["doc_id"]).collect()}
    assert [got[i].labels for i in range(7)] == ["mit", "gpl-3", "gpl-2", "bsd-2-clause", "bsd-3-clause", "", ""]
    assert 0.8 < got[0].score < 1 and got[5].score == 0


def brute(scanner, ids):
    """Labels by trying every relative position of every template without the index."""
    found = {}
    for k, template in enumerate(scanner.index.templates):
        for start in range(-len(template), len(ids) + 1):
            low, high = max(0, start), start + len(template) + 2 * licenses.SLACK
            region = ids[low:high]
            if all(len(licenses.standing(region, p)) for p in scanner.index.must[k]) and not any(len(licenses.standing(region, p)) for p in scanner.index.never[k]):
                near = np.mean([w in ids[max(0, start + q) : max(0, start + q + 2 * licenses.SLACK)] for q, w in enumerate(template.tolist())])
                if near >= 0.75:
                    found[scanner.index.labels[k]] = max(found.get(scanner.index.labels[k], 0), near)
    return found


def test_the_index_misses_nothing_that_trying_all_positions_finds(index):
    n = np.arange(len(index.words))
    scanner = licenses.Scanner(index, 10_000, 1 + n * 7 % 50)
    texts = []
    for k, (_, text, _, _) in enumerate(licenses.TEMPLATES):
        texts += [f"{filler(20, k)} {changed(text, k, every)} {filler(20, k + 9)}" for every in (8, 12, 1000)]
    ids, ends = index.numbered(texts)
    hits = 0
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        got = {m[0] for m in scanner.matches(ids[a:b])}
        want = set(brute(scanner, ids[a:b]))
        hits += len(want)
        assert want <= got, (want, got)
    assert hits > 40


def test_base_phrases_by_hand(spark):
    rng = np.random.default_rng(5)
    bits = ["under", "the", "MIT", "License", "apache", "version", "2", "cc", "by", "nc", "é", "x-y", "\n", "_"]
    texts = [" ".join(rng.choice(bits, 80)) for _ in range(200)] + ["Apache License, Version 2.0 CC-BY-NC", "under the MIT license", None, "", "--", "cc by nc " * 200_000]
    got = {r.doc_id: r for r in licenses.digests(licenses.scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, "cc by nc", "s")]), ["doc_id"]), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        words = licenses.WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        places = sorted((p, label) for phrase, label in licenses.BASE for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert not places or (r.score == 1.0 and set(r.base_labels.split(",")) <= set(r.labels.split(",")))
    assert got[None].n_base == 1
    assert licenses.scan(docs(spark, []), ["doc_id"]).count() == 0
    counts = {r.label: r.n_docs for r in licenses.label_counts(licenses.scan(docs(spark, [(1, "cc by nc cc by nc", "s"), (2, "cc by nc", "s")]), ["doc_id"])).collect()}
    assert counts == {"cc-by-nc": 2}


# 13

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root and the path of each leaf: (left, right) per level."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for j, at in enumerate(places):
            low = at // 16 * 16
            paths[j].append(("".join(level[low:at]), "".join(level[at + 1 : low + 16])))
        level = [sha(*level[i : i + 16]) for i in range(0, len(level), 16)]
        places = [p // 16 for p in places]
    return level[0], paths


def hashed(row, low=False):
    i, text, lang, source, n = row.doc_id, row.text, row.lang, row.source, row.n_chars
    if low and text is not None:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def by_hand_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row.source, []).append((row.doc_id is not None, row.doc_id or 0, hashed(row), row))
    named = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in named}
    root, tops = tree([trees[s][0] for s in named])
    out = []
    for s, top in zip(named, tops, strict=True):
        for (_, _, leaf, row), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            whole = path + top
            spoilt = zlib.crc32(b"" if row.doc_id is None else str(row.doc_id).encode()) % 5 == 0
            f = hashed(row, spoilt)
            for left, right in whole:
                f = sha(left, f, right)
            out.append((row.doc_id, leaf, trees[s][0], root, sha(*(x for p in whole for x in p)), f, f == root))
    return out


def test_manifest_by_hand(spark):
    sizes = {"hot": 4500, None: 17, "": 1, "b": 16, "B": 257, "é": 33, **{f"s{i}": 2 for i in range(20)}}
    rows, k = [], 0
    for s, n in sizes.items():
        rows += [((k := k + 7) % 100_003, f"Text {k} of É" if k % 3 else None, s) for _ in range(n)]
    rows += [(None, "Null id", "hot"), (None, "Null id 2", "hot"), (5, "", "b"), (5, "Same id", "b"), (5, "Same id", "b")]
    frame = docs(spark, rows)
    got = manifest.manifest(frame).collect()
    want = by_hand_manifest(frame.collect())
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.verified for r in got} == {True, False} and len({r.root for r in got}) == 1


def test_manifest_of_few_rows(spark):
    assert manifest.manifest(docs(spark, [])).count() == 0
    one = manifest.manifest(docs(spark, [(3, "only", "s")])).collect()
    assert len(one) == 1 and one[0].root == one[0].leaf == one[0].subroot and one[0].proof_sha256 == sha("") and one[0].verified


def test_rows_equal_in_all_are_dealt(spark):
    rows = docs(spark, [(None, "x", None)] * 3000).select(F.lit("0").alias("g"), F.lit(None).cast("bigint").alias("id"))
    out, _ = manifest.ranked(rows, "g", ["id"])
    got = out.select("r", "n", F.spark_partition_id().alias("part")).collect()
    assert sorted(r.r for r in got) == list(range(3000)) and {r.n for r in got} == {3000}
