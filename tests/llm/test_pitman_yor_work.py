"""The language model draws no number and sorts no row that its result doesn't need."""

import numpy as np
import pytest

from wearline.llm import hashing, pitman_yor, seating


@pytest.fixture
def evens(monkeypatch):
    """How many numbers are drawn by key."""
    count, even = [], pitman_yor.Keyed.even

    def counted(self, *where):
        out = even(self, *where)
        count.append(len(out))
        return out

    monkeypatch.setattr(pitman_yor.Keyed, "even", counted)
    return count


def test_one_customer_needs_no_number(evens):
    n = 1000
    c, ctx = np.ones(n, np.int64), np.arange(n)
    c[:3] = 2, 5, 9
    restaurants, dishes = pitman_yor.spread(ctx), pitman_yor.spread(ctx + n)
    got = pitman_yor.sweep(c, np.ones(n, np.int64), ctx, n, np.full(n, 0.1), 2, pitman_yor.Keyed(restaurants, 4), pitman_yor.Keyed(dishes, 4))
    assert (got[3:] == 1).all() and (got[:3] <= c[:3]).all()
    assert sum(evens) < 100  # two for each dish of more, a few for its restaurant


def test_leaving_out_changes_no_seating():
    """What is drawn for a dish is the same when dishes and restaurants beside it need nothing."""
    rng, n = np.random.default_rng(3), 400
    c, ctx, base = np.maximum(1, rng.zipf(1.6, n) % 700), np.sort(rng.integers(0, 60, n)), rng.random(n) / 10
    restaurants, dishes = pitman_yor.spread(np.arange(60)), pitman_yor.spread(np.arange(n))
    got = pitman_yor.sweep(c, np.minimum(c, 2), ctx, 60, base, 1, pitman_yor.Keyed(restaurants, 2), pitman_yor.Keyed(dishes, 2))
    d, s = pitman_yor.DISCOUNT[1], pitman_yor.STRENGTH[1]
    y = pitman_yor.Keyed(restaurants, 2).standard_gamma(s / d + np.bincount(ctx, np.minimum(c, 2), 60))
    every = pitman_yor.Keyed(dishes, 2)
    assert (got == seating.tables(c, d * y[ctx] * base, d, 1 - every.even(), every.even())).all()


def test_dishes_seated_together_as_by_number_of_customers():
    rng, n, d = np.random.default_rng(4), 3000, 0.8
    c, a, u = rng.integers(1, seating.EXACT + 1, n), rng.gamma(1, 20, n), rng.random(n)
    logs = seating.stirling(d)
    want = [1 if k == 1 else seating.by_weights((logs[k, 1 : k + 1] + np.arange(1, k + 1) * np.log(x))[None], np.array([y]))[0] for k, x, y in zip(c, a, u, strict=True)]
    assert seating.tables(c, a, d, u, rng.random(n)).tolist() == want


def test_order_by_one_number_and_by_columns():
    rng, n = np.random.default_rng(6), 5000
    columns = [rng.integers(0, 40, n) for _ in range(3)]
    for limit in (40, 1 << 40):  # fits 63 bits, and not
        order, new = pitman_yor.in_order(*((x, limit) for x in columns))
        assert (order == np.lexsort(columns[::-1])).all()
        rows, place = pitman_yor.grouped(*((x, limit) for x in columns))
        assert new.sum() == len(rows) == len({*zip(*map(np.ndarray.tolist, columns), strict=True)})
        assert all((x[rows][place] == x).all() for x in columns)
    assert [len(x) for x in pitman_yor.in_order((np.zeros(0, np.int64), 1))] == [0, 0]


def test_packed_columns_come_back():
    columns = [np.array([1 << 60, -3, 7]), np.arange(5, dtype=np.uint32), np.zeros(0, np.int64), np.array([0.5], np.float32), np.arange(3, dtype=np.uint8)]
    back = pitman_yor.unpacked(pitman_yor.packed(*columns), *(c.dtype.type for c in columns))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, back, strict=True))


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = ["", "A bc  déf " * 30, None or " ", "x" * 300 + " y", "ends here"]
    h, last, ends, size = hashing.words(texts)
    for piece in (1, 7, 64):
        monkeypatch.setattr(hashing, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(hashing.words(texts), (h, last, ends, size), strict=True))
    # the sum over a word's bytes, by hand
    def by_hand(word):
        x = sum(int(hashing.LETTER[b]) * pow(hashing.ODD[1], k, 1 << 64) for k, b in enumerate(word)) + len(word) * hashing.ODD[2]
        return hashing.mix(np.array([x % (1 << 64)], np.uint64))[0] & hashing.MASK

    assert h.tolist() == [int(by_hand(w)) for t in texts for w in t.lower().encode().split()]
