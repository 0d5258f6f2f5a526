"""The operators of the training-data folder against brute force, round trips and held-out checks."""

import glob
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import bpe, components, hashing, lines, media, mixing, neardup, pitman_yor, quality, seating, secrets, toxicity, warc

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix jolly potions under bright copper moons near quiet rivers and old stone bridges".split()


def prose(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice(PROSE, n))


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def odd_texts():
    """Null, empty, blank, ties, copies and a long text."""
    return [None, "", " \n\t ", "one", prose(1), prose(1), "a b c\n" * 400 + prose(2, 3000), "Ünïcödé ñandú ΣΑΣ İ 😀", prose(3)]


def lowered(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


# 1

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string, digest string")


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 999 + "é"
    rows = pages(spark, [(1, "http://a\r\nb%0A", big, "", ""), (2, None, big, "", ""), (3, "u", None, "", ""), (4, "u", "", "", ""), (5, "u", "x" * 999, "", ""), (6, "u", "x" * 999, "", ""), (7, "u", big + "<", "", ""), (None, "u", big, "", "")])
    path = f"{tmp_path}/w"
    warc.write_bundles(warc.revisits(rows), path)
    bundles = spark.read.parquet(path)
    got = {r.page_id: r for r in warc.described(warc.read_bundles(bundles)).collect()}
    assert len(got) == 8 and got[2].record_type == "response" and got[2].refers_to is None
    assert (got[1].record_type, got[1].refers_to, got[None].refers_to) == ("revisit", 2, 2)
    assert got[1].payload_bytes == 1001 and got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert {got[k].record_type for k in (3, 4, 5, 6, 7)} == {"response"} and got[3].payload_bytes == 0
    one = warc.fetch(bundles, spark.createDataFrame([(warc.urn(7),), (warc.urn(1),)], "record_id string")).collect()
    assert {r.page_id for r in one} == {1, 7} and next(r for r in one if r.page_id == 1).url == "http://a\r\nb%0A"
    assert warc.described(warc.read_bundles(bundles.where("false"))).count() == 0


def test_bundles_are_seekable(spark):
    held = warc.Bundle()
    for i in range(40):
        held.add(warc.urn(i), warc.record(i, "u", bytes([65 + i % 26]) * 20_000, hashlib.sha1(b"").hexdigest(), "response", None))
    content = held.closed()
    table = warc.seek_table(content)
    assert len(table) > 1 and sum(t[2] for t in table) == sum(r["length"] for r in held.records)
    last = held.records[-1]
    _, headers, block = next(warc.parse(warc.frame_of(content, table[last["frame"]]), last["offset"], last["length"]))
    assert headers["WARC-Record-ID"] == warc.urn(39) and block.endswith(b"N" * 20)


# 2

def test_rates_are_projected_least_squares(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet((3, 1, 1), 40)
    tokens = rng.integers(10, 500, 40)
    cells = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(tokens, p, strict=True)], "tokens bigint, p_clean double, p_toxic double, p_junk double")
    targets = {"clean": 0.7, "toxic": 0.15, "junk": 0.15}
    fitted = mixing.rate(mixing.fit_rates(cells, targets), [F.col(f"p_{d}") for d in mixing.DOMAINS])
    got = np.array([r.r for r in cells.select(fitted.alias("r")).collect()])
    total = tokens.sum()
    q = (tokens[:, None] * p).sum(0) / total
    w = np.array([0.7, 0.15, 0.15])
    size, r = min(q / w), np.ones(40)
    for _ in range(mixing.STEPS):
        r = np.maximum(0, r - ((p @ (((r * tokens) @ p / total - size * w) / q)) + mixing.RIDGE * (r - 1)) / (1 + mixing.RIDGE))
    assert got == pytest.approx(r, abs=1e-9) and (got >= 0).all()
    assert (got * tokens) @ p / ((got * tokens) @ p).sum() == pytest.approx(w, abs=0.02)


def test_mixing_learns_domains_and_takes_effect(spark):
    texts, marks = [], []
    for i in range(240):
        kind = i % 4
        base = prose(i, 50)
        texts.append(base + " vile vile scum" if kind == 1 else " | ".join(base.split()) if kind == 2 else base)
        marks.append((i, int(kind != 2), int(kind == 1)))
    labels = spark.createDataFrame([*marks[:200], (None, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    frame = docs(spark, texts)
    rows = {r.doc_id: r for r in mixing.mix(frame, labels, ["doc_id"]).collect()}
    assert len(rows) == 240 and all(rows[i][f"p_{('clean', 'toxic', 'junk', 'clean')[i % 4]}"] > 0.9 for i in range(200, 240))
    assert all(r.p_clean + r.p_toxic + r.p_junk == pytest.approx(1, abs=1e-6) for r in rows.values())
    out = mixing.resampled(frame, labels)
    assert out.columns == frame.columns
    kept = Counter(r.doc_id % 4 for r in out.collect())
    assert kept[0] >= 60 and kept[3] >= 60 and kept[1] < 40 and kept[2] < 40
    reached = {r.domain: r for r in mixing.shares(mixing.mix(frame, labels, ["doc_id"])).collect()}
    assert all(abs(reached[d].reached - mixing.TARGETS[d]) < 0.005 and not reached[d].exempt for d in mixing.DOMAINS)


def test_evidence_matches_counts_by_hand(spark):
    texts = [prose(i, 30) + (" Vile, scum!" if i % 3 == 0 else "") for i in range(150)]
    marks = [(i, 1, int(i % 3 == 0)) for i in range(150)]
    frame, labels = docs(spark, texts), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    domain = mixing.domains_of(labels)
    first = {r.doc_id for r in domain.where(mixing.first_half()).collect()}
    weights = mixing.evidence(frame, domain)
    slot = {r.w: r.s for r in spark.createDataFrame([(w,) for w in {*PROSE, "vile", "scum"}], "w string").select("w", mixing.slots_of(F.col("w"))[0].alias("s")).collect()}
    yes, no = (sum(i in first and (i % 3 == 0) == t for i in range(150)) for t in (True, False))
    for w, s in slot.items():
        a, b = (sum(i in first and (i % 3 == 0) == t and any(slot[x] == s for x in re.findall(r"\w+", texts[i].lower())) for i in range(150)) for t in (True, False))
        p, q = (a + 0.5) / (yes + 1), (b + 0.5) / (no + 1)
        clear = a >= mixing.LEAST_ROWS and p > mixing.RATIO * q and p - q > mixing.CLEAR * math.sqrt(p * (1 - p) / yes + q * (1 - q) / no)
        assert weights["toxic"][s] == (pytest.approx(math.log(p / q), abs=1e-3) if clear else 0)
    assert weights["toxic"][slot["vile"]] > 3


def test_scarce_domains_reach_their_shares(spark):
    rows = spark.createDataFrame([(9700, 0.999, 0.0005, 0.0005), (200, 0.001, 0.999, 0.0), (100, 0.001, 0.0, 0.999)], "n_tokens bigint, p_clean double, p_toxic double, p_junk double")
    cells = rows.withColumnRenamed("n_tokens", "tokens")
    targets = {"clean": 0.90, "toxic": 0.05, "junk": 0.05}
    rate = lambda cells: mixing.rate(mixing.fit_rates(cells, targets), [F.col(f"p_{d}") for d in mixing.DOMAINS]) * mixing.lift(mixing.fit_rates(cells, targets), targets)
    got = mixing.shares(rows.withColumn("rate", rate(cells)), targets).collect()
    assert [r.domain for r in got] == list(mixing.DOMAINS) and [r.reached for r in got] == pytest.approx([0.9, 0.05, 0.05], abs=0.005)
    assert [r.asked for r in got] == pytest.approx([0.9, 0.05, 0.05]) and got[2].natural < 0.016
    assert cells.where("p_clean > 0.5").agg(F.min(rate(cells))).first()[0] >= 1 - 1e-9
    few = cells.where("p_junk < 0.5")  # without a junk document its target doesn't inflate others
    assert few.agg(F.max(rate(few))).first()[0] < 4


def test_mixing_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = mixing.mix(docs(spark, odd_texts()), none, ["doc_id"]).collect()
    assert len(rows) == len(odd_texts()) and all(r.rate >= 0 for r in rows)
    assert mixing.mix(docs(spark, []), none, ["doc_id"]).count() == 0


# 3

def test_bpe_equals_the_library(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_path())
    texts = [*odd_texts(), "it's <|endoftext|>end<|startoftext|>", "aaaaaaaaaaaa aaaa  aaa", "x\x1cy\x85z　w"]
    frame = bpe.encode(docs(spark, texts), bpe.default_path(), ["doc_id"], decoded="inside")
    for r in bpe.decode(frame, bpe.default_path()).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == r.inside == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs(spark, []), bpe.default_path(), ["doc_id"]).count() == 0


def test_bpe_knows_the_classes_of_all_characters():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_path())
    held = bpe.Vocabulary(bpe.default_path())
    for low in (*range(0, 0x24000, 0x4000), 0x2C000, 0x30000, 0x3C000, 0xE0000, 0xF0000):
        texts = [f"a{chr(c)}B" for c in range(low, low + 0x4000) if not 0xD800 <= c <= 0xDFFF]
        flat, ends = held.encode(texts)
        wrong = [t for t, a, b, e in zip(texts, ends[:-1], ends[1:], library.encode_batch(texts, add_special_tokens=False), strict=True) if flat[a:b].tolist() != e.ids]
        assert not wrong
        held.forget()


def test_bpe_survives_a_full_memory(monkeypatch):
    held = bpe.Vocabulary(bpe.default_path())
    texts = [prose(i, 30) for i in range(20)]
    whole = held.encode(texts)
    monkeypatch.setattr(bpe, "MEMORY", 5)
    parts = [held.encode([t])[0].tolist() for t in texts]
    assert [x for p in parts for x in p] == whole[0].tolist()


# 4

def test_toxicity_on_held_out_texts(spark):
    rng = np.random.default_rng(5)
    texts, marks = [], []
    for i in range(900):
        toxic = rng.random() < 0.15
        texts.append(prose(i, 40) + (" " + " ".join(rng.choice(["vile,", "scum", "rotten", "louse"], 3)) if toxic else ""))
        marks.append((i, 1, int(toxic)))
    labels, frame = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), docs(spark, texts)
    model = toxicity.train(frame, labels, F.col("doc_id") % 3 != 1)
    rows = toxicity.score(frame, model, ["doc_id"]).collect()
    held = [r for r in rows if r.doc_id % 3 == 1]
    right = sum(r.predicted == marks[r.doc_id][2] for r in held)
    assert right / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_edge_cases(spark):
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs(spark, odd_texts()), none, F.lit(True))
    assert [r.predicted for r in toxicity.score(docs(spark, odd_texts()), model, ["doc_id"]).collect()] == [0] * len(odd_texts())
    assert toxicity.score(docs(spark, []), model, ["doc_id"]).count() == 0


def corrected_risk(w, b, positive, unlabelled, prior):
    """The risk as it is written, and its unlabelled part, text by text."""
    z = lambda rows: np.array([sum(w[k] * x for k, x in zip(*r, strict=True)) + b for r in rows])
    soft = lambda x: np.log1p(np.exp(x))
    rest = soft(z(unlabelled)).mean() - prior * soft(z(positive)).mean()
    return prior * soft(-z(positive)).mean() + max(0, rest), rest


def test_steps_follow_the_corrected_risk():
    rng = np.random.default_rng(1)
    rows = lambda n: [(np.unique(rng.integers(0, 6, 3)), None) for _ in range(n)]
    positive, unlabelled = ([(s, rng.random(len(s))) for s, _ in rows(n)] for n in (8, 20))
    w, prior, number = rng.normal(size=6), 0.3, np.arange(6)
    row, column, values = toxicity.stacked([*positive, *unlabelled], number)
    for b in (0.5, -2.0):
        risk, rest = corrected_risk(w, b, positive, unlabelled, prior)
        assert rest > 0
        g = toxicity.step_of(np.bincount(row, w[column] * values, 28) + b, 8, 20, prior)
        by_hand = [(corrected_risk(w + d, b, positive, unlabelled, prior)[0] - corrected_risk(w - d, b, positive, unlabelled, prior)[0]) / 2e-5 for d in np.eye(6) * 1e-5]
        assert np.bincount(column, g[row] * values, 6) == pytest.approx(by_hand, abs=1e-6)
    z = np.r_[np.full(8, 9.0), np.full(20, -9.0)]  # unlabelled rows taken for clean, positives for toxic: the rest is below 0
    g = toxicity.step_of(z, 8, 20, prior)
    assert (g[:8] > 0).all() and (g[8:] < 0).all()
    w, b = toxicity.first_fit(positive, unlabelled, number, prior)
    assert np.isfinite(w).all() and np.isfinite(b)


def test_sums_over_all_unlabelled_rows(spark):
    texts = [*odd_texts(), *(prose(i, 40) + (" vile scum" if i % 5 == 0 else "") for i in range(60))]
    frame = docs(spark, texts).repartition(3)
    whole = [toxicity.slots([t or ""])[:2] for t in texts]
    wanted = np.unique(np.concatenate([f for f, _ in whole]))[::3]
    got = toxicity.slot_sums(frame, wanted, "text")
    at = {int(k): i for i, k in enumerate(wanted)}
    want = np.zeros((len(wanted) + 1, 2))
    for f, v in whole:
        for k, x in zip(f.tolist(), v.tolist(), strict=True):
            if k in at:
                want[at[k]] += x, x * x
    want[-1, 0] = len(texts)
    assert got == pytest.approx(want, abs=1e-5)
    number = np.full(toxicity.SLOTS, -1)
    number[wanted] = np.arange(len(wanted))
    w, b = np.random.default_rng(0).normal(size=len(wanted)), 0.3
    z = np.array([sum(w[at[k]] * x for k, x in zip(f.tolist(), v.tolist(), strict=True) if k in at) + b for f, v in whole])
    sums = toxicity.full_sums(toxicity.blocks(frame, number, "text"), w, b)
    assert sums[-1] == pytest.approx([np.logaddexp(0, z).sum(), len(texts)], rel=1e-5) and sums[-2, 0] == pytest.approx((1 / (1 + np.exp(-z))).sum(), rel=1e-5)


# 5

def long_windows(own):
    """Place and length of all windows: three lines, or fewer with 50 words."""
    words = [len(WORD.findall(x)) for _, x in own]
    return [(k, n) for k in range(len(own)) for n in (1, 2, 3) if k + n <= len(own) and (n == 3 or sum(words[k : k + n]) >= 50)]


def dedup_by_hand(texts):
    found, first = {}, {}
    for d, t in enumerate(texts):
        own = [(i, x) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        found[d] = own
        for k, n in long_windows(own):
            first.setdefault(tuple(x for _, x in own[k : k + n]), (d, k))
    out = {}
    for d, own in found.items():
        gone = {k + j for k, n in long_windows(own) if first[tuple(x for _, x in own[k : k + n])] != (d, k) for j in range(n)}
        drop = {own[k][0] for k in gone}
        out[d] = ("\n".join(x for i, x in enumerate((texts[d] or "").split("\n")) if i not in drop), len(gone))
    return out


def test_line_dedup_matches_brute_force(spark):
    block = "first line\nsecond line\nthird line\nfourth line"
    texts = [*odd_texts(), block, "start\n\n" + block + "\nend", "same\nsame\nsame\nsame\nsame", block + "\n" + block, "first line\nsecond line", prose(50, 50), "x\n" + prose(50, 50) + "\ny", prose(51, 49), prose(51, 49), prose(52, 25) + "\n\n" + prose(53, 25), "z\n" + prose(52, 25) + "\n" + prose(53, 25)]
    want = dedup_by_hand(texts)
    frame = docs(spark, texts)
    out = lines.dedup_lines(frame)
    assert out.columns == [*frame.columns, "n_lines", "n_removed"]
    for r in out.collect():
        assert ((r.text or ""), r.n_removed) == want[r.doc_id]
    assert lines.dedup_lines(frame).where("doc_id = 0").first().text is None
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_with_repeated_ids(spark):
    block = "p q r\ns t u\nv w x"
    rows = sorted((r.text, r.n_removed) for r in lines.dedup_lines(docs(spark, [block, block, "z\n" + block], [7, 7, 7])).collect())
    assert [n for _, n in rows] in ([0, 0, 3], [3, 3, 0]) and lines.dedup_lines(docs(spark, [block, block], [None, 1])).where("n_removed = 3").count() == 1


# 6

def test_language_model(spark):
    texts = [*odd_texts(), *(prose(i, 80) for i in range(40, 80))]
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = {r.doc_id: r for r in pitman_yor.scored(docs(spark, texts), learn).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    c = Counter()
    for i, t in enumerate(texts):
        if not held[i]:
            c.update([*lowered(t), "\n"])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        tokens, r = [*lowered(t), "\n"], got[i]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_language_model_edge_cases(spark):
    assert pitman_yor.scored(docs(spark, []), F.lit(True)).count() == 0
    rows = pitman_yor.scored(docs(spark, ["a b", None], [None, 3]), F.lit(False)).collect()
    assert len(rows) == 2 and all(r.train_tokens == 0 and np.isfinite(r.score) for r in rows)


def test_tokens_know_the_words_before():
    texts = ["a b c", "", "d", "e f"]
    word, one, two, doc = pitman_yor.tokens(texts)
    h = {w: int(pitman_yor.tokens([w])[0][0]) for w in "abcdef"}
    e, s = pitman_yor.END, pitman_yor.START
    want = [("a", s, s, 0), ("b", "a", s, 0), ("c", "b", "a", 0), (e, "c", "b", 0), (e, s, s, 1), ("d", s, s, 2), (e, "d", s, 2), ("e", s, s, 3), ("f", "e", s, 3), (e, "f", "e", 3)]
    assert list(zip(word.tolist(), one.tolist(), two.tolist(), doc.tolist(), strict=True)) == [tuple(h.get(x, x) for x in row) for row in want]
    assert [len(x) for x in pitman_yor.tokens([])] == [0, 0, 0, 0]


@pytest.mark.parametrize("discount", [0.5, 0.75, 0.8])
def test_tables_follow_stirling_numbers(discount):
    rng, size, n = np.random.default_rng(0), 900, 3000
    logs, t = seating.stirling(discount, size), np.arange(1, size + 1)
    for weight in (1e-3, 0.3, 5, 40, 400):
        for c in (2, 30, 512, size):
            w = logs[c, 1 : c + 1] + t[:c] * np.log(weight)
            w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
            mean = (w * t[:c]).sum()
            spread = math.sqrt((w * t[:c] ** 2).sum() - mean**2)
            got = seating.tables(np.full(n, c), np.full(n, float(weight)), discount, rng.random(n), rng.random(n))
            assert got.min() >= 1 and got.max() <= c
            assert got.mean() == pytest.approx(mean, abs=5 * spread / math.sqrt(n) + 0.03 * mean * (c > seating.EXACT))


def one_by_one(counts, base, discount, strength, sweeps, rng):
    """Mean tables of each dish of a restaurant: customers leave and sit down again one after the other."""
    seats, total = [[1] * c for c in counts], np.zeros(len(counts))
    for k in range(sweeps):
        for w, own in enumerate(seats):
            for _ in range(counts[w]):
                at = rng.choice(len(own), p=np.array(own) / sum(own))
                own[at] -= 1
                if not own[at]:
                    own.pop(at)
                weights = np.array([x - discount for x in own] + [(strength + discount * sum(map(len, seats))) * base[w]])
                at = rng.choice(len(weights), p=weights / weights.sum())
                if at == len(own):
                    own.append(0)
                own[at] += 1
        total += [len(x) for x in seats] if k >= sweeps // 10 else 0
    return total / (sweeps - sweeps // 10)


def test_sweeps_match_seating_one_by_one():
    counts, base = [2, 7, 20], np.array([0.05, 0.6, 0.2])
    want = one_by_one(counts, base, pitman_yor.DISCOUNT[1], pitman_yor.STRENGTH[1], 1500, np.random.default_rng(1))
    rng, c, ctx = np.random.default_rng(2), np.array(counts), np.zeros(3, int)
    t, sums, n = np.ones(3, int), np.zeros(3), 6000
    for _ in range(n):
        t = pitman_yor.sweep(c, t, ctx, 1, base, 1, rng)
        sums += t
    assert sums / n == pytest.approx(want, rel=0.06)


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    n_words, n2, n3 = 30, 4, 9
    base = rng.dirichlet(np.ones(n_words + 1))[:n_words]  # the rest is for words that are not known
    ctx2, word2 = np.repeat(np.arange(n2), n_words), np.tile(np.arange(n_words), n2)
    up = rng.integers(0, n2, n3)
    of3, of2 = np.repeat(np.arange(n3), n_words), (up[:, None] * n_words + np.arange(n_words)).ravel()
    c3 = np.maximum(0, rng.zipf(1.5, n3 * n_words) % 50 - 1)
    p = pitman_yor.sampled(c3, of3, n3, of2, ctx2, n2, base[word2], np.random.default_rng(0))
    sums = np.bincount(of3, p)
    assert (sums < 1).all() and (p > 0).all()
    full = pitman_yor.sampled(c3, of3, n3, of2, ctx2, n2, base[word2] / base.sum(), np.random.default_rng(0))
    assert np.bincount(of3, full) == pytest.approx(np.ones(n3))


def test_language_model_knows_contexts(spark):
    rng = np.random.default_rng(8)
    chain = {w: rng.choice(PROSE, 2).tolist() for w in PROSE}

    def walk(n):
        out = [str(rng.choice(PROSE))]
        while len(out) < n:
            out.append(chain[out[-1]][rng.integers(2)])
        return " ".join(out)

    texts = [walk(60) for _ in range(150)]
    again = [" ".join(rng.choice(PROSE, 60)) for _ in range(4)]
    rows = {r.doc_id: r for r in pitman_yor.scored(docs(spark, [*texts, *again, *again]), (F.col("doc_id") % 5 != 1) & (F.col("doc_id") < 154)).collect()}
    gain = lambda i: (rows[i].score - rows[i].base_score) / rows[i].n_tokens
    held = [gain(i) for i in range(150) if i % 5 == 1]
    assert min(held) > 0.5  # a step has two choices of some twenty
    fresh = pitman_yor.scored(docs(spark, [*texts, *again]), (F.col("doc_id") % 5 != 1) & (F.col("doc_id") < 150)).where("doc_id >= 150").collect()
    alone = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in fresh}
    # a random text that was learned from is told apart from one that was not
    assert all(gain(154 + i) > alone[150 + i] + 0.2 for i in range(4) if (150 + i) % 5 != 1)


# 7

def base_by_hand(text):
    words = WORD.findall(text or "")
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(repeated)


def test_quality_statistics_match_brute_force(spark):
    texts = [*odd_texts(), "a | b # c\na | b # c\n\n\x0b", " ".join(f"w{i % 11}" for i in range(40)), "w " * 9, "w " * 8, prose(9, 20) + " " + prose(9, 20)]
    stats = quality.statistics(docs(spark, texts).select("doc_id", "lang", "source", "text"))
    for r in stats.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_by_hand(texts[r.doc_id])


def test_quality_keeps_clean_rows_and_drops_outliers(spark):
    texts = [prose(i, 60) for i in range(200)] + [re.sub(" ", " # ", prose(i, 60)) for i in range(6)] + ["short text"]
    frame = docs(spark, texts)
    rows = {r.doc_id: r for r in quality.verdicts(quality.statistics(frame.select("doc_id", "lang", "source", "text"))).collect()}
    assert all(rows[i].kept for i in range(200)) and not any(rows[i].kept for i in range(200, 207)) and rows[206].base_failed
    kept = quality.kept_documents(frame)
    assert kept.columns == frame.columns and kept.count() == 200


def test_quality_drops_a_third_of_junk_copies(spark):
    for junk in (re.sub(" ", " # ", prose(1, 60)), prose(5, 300).replace(" ", "\n")):
        frame = docs(spark, [prose(i, 60) for i in range(190)] + [junk] * 110)
        rows = quality.verdicts(quality.statistics(frame.select("doc_id", "lang", "source", "text"))).collect()
        assert not any(r.base_failed for r in rows) and all(r.kept == (r.doc_id < 190) for r in rows)


def test_quality_distance_matches_numpy(spark):
    frame = docs(spark, [prose(i, 30 + i % 50) + " #" * (i % 3) for i in range(120)])
    got = sorted((r.doc_id, r.distance2) for r in quality.verdicts(quality.statistics(frame.select("doc_id", "lang", "source", "text"))).collect())
    s = np.array([base_by_hand(t) for t in [prose(i, 30 + i % 50) + " #" * (i % 3) for i in range(120)]], float)
    x = np.stack([np.log1p(s[:, 1] / s[:, 0]), np.sqrt(s[:, 2] / s[:, 1]), 0 * s[:, 0], np.sqrt(s[:, 4] / s[:, 0])], 1)
    fit = x[(s[:, 0] >= 20) & (100 * s[:, 4] <= 30 * s[:, 0])]
    floor = np.array(list(quality.FLOOR.values()))
    at = lambda v, q: (np.percentile((v * quality.BINS / 4).astype(int), 100 * q) + 0.5) * 4 / quality.BINS
    d2 = lambda v, m, cov: (np.linalg.solve(np.linalg.cholesky(cov), (v - m).T) ** 2).sum(0)
    best = (np.inf,)
    off = np.array([1.4826 * at(np.abs(fit[:, j] - at(fit[:, j], 0.5)), 0.5) for j in range(4)])
    even = np.diag(np.maximum(off, floor) ** 2)
    mid, low = (np.array([at(fit[:, j], q) for j in range(4)]) for q in (0.5, 0.25))
    for m, cov in ((mid, even), (low, even), (fit.mean(0), np.cov(fit.T, bias=True) + np.diag(floor**2))):
        for _ in range(quality.STEPS):
            d = np.minimum(3.999, np.log1p(d2(fit, m, cov)) / 5)
            near = fit[d <= at(d, quality.HALF_SHARE) + 4 / quality.BINS]
            m, cov = near.mean(0), quality.CONSISTENCY * np.cov(near.T, bias=True) + np.diag(floor**2)
        best = min(best, (np.linalg.det(cov), m.tolist(), cov.tolist()))
    # one group, which is its language's and the whole table's as well, so nothing draws it elsewhere
    assert [v for _, v in got] == pytest.approx(d2(x, *map(np.array, best[1:])).tolist(), rel=1e-6, abs=1e-9)


def test_quality_of_small_groups(spark):
    """A junk text alone in its source is judged by its language; clean ones alone in theirs stay."""
    texts = [prose(i, 60) for i in range(150)] + [re.sub(" ", " # ", prose(1, 60))] + [prose(i, 60) for i in range(200, 206)]
    frame = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") < 150, "large").otherwise(F.concat(F.lit("s"), "doc_id")))
    rows = {r.doc_id: r.kept for r in quality.verdicts(quality.statistics(frame.select("doc_id", "lang", "source", "text"))).collect()}
    assert [i for i, kept in rows.items() if not kept] == [150]


def test_quality_edge_cases(spark):
    frame = docs(spark, odd_texts()).withColumn("lang", F.lit(None).cast("string"))
    rows = quality.verdicts(quality.statistics(frame.select("doc_id", "lang", "source", "text"))).collect()
    assert len(rows) == len(odd_texts())
    for r in rows:
        n, _, _, _, repeated = base_by_hand(odd_texts()[r.doc_id])
        assert (not r.base_failed) == (n >= 20 and 100 * repeated <= 30 * n) and r.kept == (r.doc_id in (4, 5, 8))  # 6 repeats its lines
    assert all(r.distance2 is None for r in quality.verdicts(quality.statistics(docs(spark, ["", None]))).collect())
    assert quality.kept_documents(docs(spark, [])).count() == 0


# 8

def test_media_round_trip(spark):
    texts = odd_texts()
    rows = media.described(media.fingerprint(media.store(docs(spark, texts), ["doc_id"])), ["doc_id"]).orderBy("doc_id").collect()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest() and r.media_bytes == len(media.to_wav(payload))
    assert rows[4].feature == rows[5].feature != rows[8].feature
    assert media.fingerprint(media.store(docs(spark, []), ["doc_id"])).count() == 0


def test_peaks_follow_a_tone():
    t = np.arange(4096)
    samples = (128 + 100 * np.sin(2 * np.pi * 40 * t / media.FRAME)).astype(np.uint8)
    time, code, frames = media.pairs(samples)
    assert set(media.peaks(samples).tolist()) == {40} and frames == 31 and (np.diff(time) >= 0).all()
    assert set(code.tolist()) == {40 | 40 << 8 | d << 16 for d in (1, 2, 3)}


# 9

def near_by_hand(texts):
    sets = []
    for t in texts:
        w = lowered(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def variants(n, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    out = []
    for g in range(n):
        base = list(rng.choice(vocabulary, int(rng.integers(4, 160))))
        for _ in range(int(rng.integers(1, 7))):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 18))):
                own[int(rng.integers(0, len(own)))] = "changed" + str(rng.integers(0, 50))
            out.append(" ".join(own))
        if g % 3 == 0:
            out.append(" ".join([*rng.choice(vocabulary, 60), *(f"licence{i}" for i in range(30))]))
    return out


def test_near_duplicates_match_brute_force(spark):
    texts = [*odd_texts(), *variants(60), "A b C d e", "a B c D e", "a b c d"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    want = near_by_hand(texts)
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("block", [3, 768])
def test_cells_find_what_pivots_leave(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "pivot_links", lambda pairs, *_: pairs.where("false").select("a", "b"))
    texts = [*variants(40, 3), *(" ".join([*(f"s{k}" for k in range(90)), *(f"x{i}y{k}" for k in range(i % 40))]) for i in range(60))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == near_by_hand(texts)


def test_overlaps_and_estimate():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(3000, int(k), replace=False)) for k in rng.integers(0, 400, 30)]
    by_hand = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert ((neardup.overlaps(sets) == by_hand) | np.eye(len(sets), dtype=bool)).all()
    whole = [np.sort(rng.choice(1 << 30, 1000, replace=False)) for _ in range(20)]
    near = [np.sort(np.r_[s[rng.permutation(1000)[:858]], rng.choice(1 << 30, 142, replace=False)]) for s in whole]
    found = neardup.possible(np.full(40, 1000), [s[: neardup.KEEP] for s in [*whole, *near]])
    assert found[np.arange(20), np.arange(20, 40)].all() and not found[0, 1]


def test_near_duplicates_edge_cases(spark):
    text = prose(4)
    rows = neardup.near_duplicates(docs(spark, [text, text, "other words in this text here", text, ""], [5, 5, 9, None, 2])).collect()
    assert [(r.component_id, r.kept) for r in rows if r.doc_id == 5] == [(5, True)] * 2 and next(r for r in rows if r.doc_id is None).kept
    frame = docs(spark, [text, text, text + " !", text], [5, 5, 8, None])
    kept = neardup.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "None"]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (35, 2))] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(a != b for a, b in edges if k in (a, b))}


def test_hashes_do_not_depend_on_neighbours():
    texts = [t or "" for t in odd_texts()]
    whole = hashing.shingles(texts)
    for t, s in zip(texts, whole, strict=True):
        assert hashing.shingles([t])[0].tolist() == s.tolist()
        assert len(s) == near_by_hand([t])[0][0]
    assert hashing.words(["Ab É"])[0][0] == hashing.words(["aB x"])[0][0]


# 10

def test_secret_rules(spark):
    key = "AKIA" + "Q" * 16
    texts = [None, "", f"password = 'abc123' {key} AKIA123", "token:token:abcdefgh secret=12345", "0123456789abcdef" * 2 + "A", "API_KEY: x.y-z_1", "paſſword=abcdef", prose(1), "é" * 5 + " secret: longenough"]
    rows = secrets.digests(secrets.find_secrets(docs(spark, texts), ["doc_id"]), ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.n_assign, r.n_access, r.n_hex) for r in rows] == [(0, 0, 0), (0, 0, 0), (1, 1, 0), (0, 0, 0), (0, 0, 1), (1, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0)]
    start = texts[2].index("AKIA")
    assert rows[2].base_sha256 == hashlib.sha256(f"assign:0:18,access:{start}:{start + 20}".encode()).hexdigest()
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[8].spans == "assign:6:24"
    assert secrets.find_secrets(docs(spark, []), ["doc_id"]).count() == 0


def rules_by_hand(text):
    """The three fixed rules without patterns: characters are taken one by one."""
    out = []
    kinds = [("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20)]
    for kind, head, tail, least in kinds:
        at = 0
        while (at := text.find(head, at)) >= 0:
            end = at + len(head)
            while end < len(text) and text[end] in tail:
                end += 1
            if end - at >= max(least, len(head) + 1):
                out.append((at, kind, end))
            at = end if end > at + len(head) else at + 1
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in "0123456789abcdef":
            end += 1
        if end - at >= 24:
            out.append((at, "hex", end))
        at = max(end, at + 1)
    names, value = ("password", "passwd", "secret", "token", "api_key", "apikey"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    fold = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    at = 0
    while at < len(text):
        name = next((n for n in names if fold(text[at : at + len(n)]) == n), None)
        at += 1
        if not name:
            continue
        p = at - 1 + len(name)
        p += text[p : p + 1] in ("'", '"') and p < len(text)
        while text[p : p + 1] == " ":
            p += 1
        if text[p : p + 1] not in (":", "=") or p >= len(text):
            continue
        p += 1
        while text[p : p + 1] == " ":
            p += 1
        p += text[p : p + 1] in ("'", '"') and p < len(text)
        end = p
        while end < len(text) and text[end] in value:
            end += 1
        if end == p:
            continue
        if end - p >= 6:
            out.append((at - 1, "assign", end))
        at = end
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda x: (x[0], order.index(x[1])))


def test_secret_rules_match_brute_force():
    rng = np.random.default_rng(6)
    bits = ["password", "Secret", "API_KEY", "apikey", "token", "AKIA", "AKIA" + "Q1" * 8, "0123456789abcdef", "a", "f", "Z", "9", ":", "=", " ", "'", '"', "_", "-", "é", "abcdef", "."]
    for _ in range(3000):
        text = "".join(rng.choice(bits, int(rng.integers(1, 14))))
        got = [(s, secrets.KINDS[k], e) for s, k, e in secrets.base_spans(text)]
        assert got == rules_by_hand(text), text


# Queries and the pipeline.

@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["op1_warc", "op5_lines", "op9_minhash"])
def test_queries_against_sql(spark, name):
    from wearline.llm.queries import ORACLES, QUERIES

    c = pytest.importorskip("duckdb").connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    assert Counter(tuple(r[k] for k in cols) for r in QUERIES[name](spark, SMALL).collect()) == Counter(want.fetchall())


CLASHES = ["doc", "gone", "lines", "worded", "held", "key", "hash", "id", "rate", "copies", "copy", "group", "levels", "c0", "c1", "C2", "x0", "m0", "_piece", "node", "value"]


def test_stages_pass_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    texts = [prose(i, 60) + "\n" + prose(i + 500, 60) for i in range(24)] + [prose(3, 60) + "\nother " + prose(900, 60), None]
    frame = docs(spark, texts).drop("n_words").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns, name
        rows = out.collect()
        assert len(rows) >= 20 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES), name


def test_very_long_texts(spark):
    """Longer than what a task takes at once: statistics, lines, words and tokens of the whole text."""
    text = (prose(1, 200) + "\n") * 9000  # about 11 MB
    frame = docs(spark, [text, prose(2)])
    n = len(WORD.findall(text))
    assert {r.doc_id: r.n_words for r in quality.statistics(frame.select("doc_id", "lang", "source", "text")).select("doc_id", "n_words").collect()}[0] == n
    assert {r.doc_id: r.n_removed for r in lines.dedup_lines(frame.select("doc_id", "text")).select("doc_id", "n_removed").collect()}[0] == 8999
    assert {r.doc_id: r.n_shingles for r in neardup.sketches(frame).collect()}[0] == 200
    word, _, _, doc = pitman_yor.tokens([text, "a"])
    assert (len(word), int((doc == 0).sum())) == (n + 3, n + 1)
    assert len(secrets.base_spans(text + " AKIA" + "Q" * 16)) == 1
    held = bpe.Vocabulary(bpe.default_path())
    assert len(held.encode([text])[0]) == 9000 * len(held.encode([prose(1, 200)])[0])


def test_nested_sets_are_not_missed():
    """The chance that two classes share too few of the indexed values, where one set holds the other and where sizes are equal."""
    below = lambda p: sum(math.comb(neardup.INDEX, k) * p**k * (1 - p) ** (neardup.INDEX - k) for k in range(neardup.OVERLAP))
    assert below(0.75) < 1e-6 and below(6 / 7) < below(0.75)


def test_nested_texts_match_brute_force(spark):
    rng = np.random.default_rng(9)
    vocabulary, texts = [f"w{i}" for i in range(4000)], []
    for _ in range(12):
        base = list(rng.choice(vocabulary, 800))
        for n in (800, 604, 601, 590):  # shares about 0.75 of the shingles, just above and below
            texts.append(" ".join(base[:n]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == near_by_hand(texts)


def test_joins_deal_hot_keys(spark, monkeypatch):
    from wearline.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(200)], "k int, v int")
    right = spark.createDataFrame([(0, "a", 33), (1, "b", 33), (7, "c", 100), (9, "d", 1)], "k int, w string, n int")
    for how in ("inner", "left"):
        want = Counter(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()))
        assert Counter(map(tuple, common.spread_join(left, right, ["k"], "n", 5, how).select("k", "v", "w").collect())) == want


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    block = "\n".join(prose(i, 12) for i in range(70, 75))
    texts = [prose(i, 60) for i in range(120)] + [prose(5, 60) + f" more{i}" for i in range(3)] + [prose(200, 30) + "\n" + block, prose(201, 30) + "\n" + block, "too short", None]
    frame = docs(spark, texts).drop("n_words")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, out, str(tmp_path))
        made.write.parquet(f"{tmp_path}/stage{k}")
        out = spark.read.parquet(f"{tmp_path}/stage{k}")
        sizes.append(out.count())
        assert name == "bpe encoding" or out.columns == frame.columns
    assert sizes[:3] == [125, 125, 122] and sizes[4] == sizes[3]
    assert len({r.doc_id for r in out.collect()}) >= 120
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[-1]
