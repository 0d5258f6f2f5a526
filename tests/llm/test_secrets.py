"""The randomness battery of secret scans: its statistics, its nulls, its power and its step-up rule."""

import math

import numpy as np
import pytest
from test_llm import PROSE, docs, prose

from wearline.llm import battery, secrets

WORDS = [*PROSE, "handler", "factory", "server", "config", "request", "number", "office", "street", "winter", "letter", "market", "system", "people", "nothing", "water"]


@pytest.fixture(scope="module")
def known():
    rng = np.random.default_rng(1)
    return battery.profiles(battery.pair_counts([" ".join(rng.choice(WORDS, 2000)) for _ in range(20)]))


def draw(rng, k, n):
    return "".join(rng.choice(list(battery.ENCODINGS[k]), n))


def camel(rng, n):
    return "".join(str(w).title() for w in rng.choice(WORDS, n)) + str(rng.integers(0, 10))


def test_pairs_are_those_between_letters():
    got = battery.pair_counts(["ab, BA", "b", ""])
    assert got[0, 1] == 1 and got[1, 0] == 1 and got.sum() == 10  # one mark around and between texts
    assert got[1, battery.END] == 2 and got[0, battery.END] == 1 and got[battery.END, 1] == 2
    assert battery.pair_counts([]).sum() == 1


def test_statistics_by_hand(known):
    token = "0123456789ab" * 2
    v = np.array([battery.PLACES[0][c] for c in token])
    chi, switch, linked = battery.statistics_of(v, 0, known.association)
    counts = np.array([token.count(c) for c in battery.ENCODINGS[0]])
    assert chi**3 * 15 == pytest.approx(((counts - 1.5) ** 2 / 1.5).sum())
    assert switch == pytest.approx(3 / 23) and linked == pytest.approx(2 * known.association[0, 1] / 23)


def test_prefixes_have_the_statistics_of_each(known):
    rng = np.random.default_rng(2)
    for k in range(len(battery.ENCODINGS)):
        v = rng.integers(0, len(battery.ENCODINGS[k]), (3, 40))
        grown = battery.growing_statistics(v, k, known.association)
        for n in (20, 33, 40):
            assert np.allclose(grown[n], [battery.statistics_of(r[:n], k, known.association) for r in v])


@pytest.mark.parametrize("k", range(len(battery.ENCODINGS)))
def test_drawn_tokens_are_told_from_names(known, k):
    """Drawn tokens of 32 symbols have p-values below LEVEL nine times in ten, of 300 nearly always; names of the encoding's
    null seldom, as often as the p-value says or less."""
    rng = np.random.default_rng(k)
    for n, least in ((32, 0.88), (300, 0.97)):
        tails = [t for _ in range(300) if (t := known.tail(draw(rng, k, n))) and t[0] == k]
        assert np.mean([p < secrets.LEVEL for _, p in tails]) >= least
    pairs = battery.with_prior(battery.pair_counts([" ".join(rng.choice(WORDS, 5000))]))
    alphabet = np.array(list(battery.ENCODINGS[k]))
    for n in (28, 48):
        names = ["".join(alphabet[r[:n]]) for r in battery.ordinary(k, pairs, 1500, rng)]
        tails = [t[1] for x in names if (t := known.tail(x))]
        assert np.mean([p < 0.05 for p in tails]) < 0.08 and np.mean([p < 0.001 for p in tails]) < 0.01


def test_names_are_ordinary(known):
    rng = np.random.default_rng(4)
    for n in (4, 5, 6):
        tails = [t[1] for _ in range(500) if (t := known.tail(camel(rng, n)))]
        assert len(tails) > 250 and np.mean([p < secrets.LEVEL for p in tails]) <= secrets.LEVEL
    assert known.tail("getUserNameById2HandlerFactory")[1] > 1e-3  # seven words in 30 letters, most of them not in the texts
    for token in ("a1" * 15, "abcdefghijklmnop0123456789", "aaaaaaaaaaaaaaaaaaaa1", "550e8400-e29b-41d4-a716-446655440000", "thisIsAVeryLongNameOfAVariable2" * 2):
        assert known.tail(token)[1] > 0.01, token
    assert known.tail("internationalisation-committee") is None and known.tail("12345678901234567890") is None


def test_step_up_matches_brute_force():
    """Against the rule written out token by token, with p-values rounded up to their bins."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        tokens = [(int(rng.integers(20, 90)), float(10 ** -rng.uniform(0, 6)) if rng.random() < 0.3 else float(rng.random())) for _ in range(int(rng.integers(1, 60)))]
        bins = [secrets.binned(p, n) for n, p in tokens]
        assert all(p / n <= 10 ** (b / secrets.BINS) * (1 + 1e-9) and 10 ** ((b - 1) / secrets.BINS) < p / n * (1 + 1e-9) for (n, p), b in zip(tokens, bins, strict=True))
        mean, m = sum(n for n, _ in tokens) / len(tokens), len(tokens)
        weighted = sorted(10 ** (b / secrets.BINS) * mean for b in bins)
        reported = max((i for i, w in enumerate(weighted, 1) if w <= secrets.LEVEL * i / m), default=0)
        last = secrets.last_bin([(b, bins.count(b), sum(n for (n, _), c in zip(tokens, bins, strict=True) if c == b)) for b in set(bins)])
        assert sum(last is not None and b <= last for b in bins) == reported
    assert secrets.last_bin([]) is None
    # length counts: of equal p-values the longer token's is taken
    few = [(secrets.binned(0.03, n), 1, n) for n in (30, 90)]
    assert secrets.last_bin(few) == few[1][0] < few[0][0]


def test_false_reports_over_the_whole_table(spark):
    """400 texts of names and 80 drawn tokens: the drawn are found whole, of what is reported at most a tenth are names."""
    rng = np.random.default_rng(6)
    texts = [prose(i, 200) + " " + " ".join(camel(rng, 5) for _ in range(5)) for i in range(400)]
    planted = {i * 5: draw(rng, 2 + i % 6, 40) for i in range(80)}
    texts = [t + " see " + planted[i] + " end" if i in planted else t for i, t in enumerate(texts)]
    rows = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == "random"] for r in secrets.find_secrets(docs(spark, texts), ["doc_id"]).collect()}
    at = {i: (texts[i].index(t), texts[i].index(t) + len(t)) for i, t in planted.items()}
    hits, all_found = sum(at[i] in rows[i] for i in planted), sum(map(len, rows.values()))
    assert hits >= 72 and all_found - hits <= 0.1 * all_found
    again = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == "random"] for r in secrets.find_secrets(docs(spark, texts).repartition(7), ["doc_id"]).collect()}
    assert again == rows  # partitions don't matter


def test_secrets_behind_names_and_paths(known):
    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(40):
        key, url = draw(rng, 5, 38) + "0a", draw(rng, 7, 37) + "_0a"
        for before, value in (("AWS_SECRET_ACCESS_KEY=", key), ("?sig=", key), ("a-path/x_y/", key), ("some/path/", url), ("DB_PASS=", key + "==")):
            found = [(s, e) for s, e, p in secrets.tested("see " + before + value, known) if p < 1e-3]
            hits += any(s <= 4 + len(before) and e == 4 + len(before) + len(value) for s, e in found)
    assert hits > 170
    assert secrets.joined([(5, 9), (1, 3), (8, 12)]) == [[1, 3], [5, 12]]


def test_no_token_part_is_left_out(known):
    """A long token that is drawn in its first or last part only isn't taken for drawn."""
    rng = np.random.default_rng(7)
    name = "".join(str(w) for w in rng.choice(WORDS, 120)) + "1"
    assert known.tail(draw(rng, 3, 60) + name)[1] > secrets.LEVEL and known.tail(name + draw(rng, 3, 60))[1] > secrets.LEVEL
    n, p = 5000, known.tail(draw(rng, 5, 5000))[1]
    assert p < 1e-100 and math.isfinite(secrets.binned(p, n))
