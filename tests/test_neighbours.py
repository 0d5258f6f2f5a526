"""Pruned nearest neighbours against brute force."""

import numpy as np
import pytest

from wearline.operators import models, neighbours


def brute(X, y, Q, k):
    """Per row of Q the sorted (rounded distance, y) of its k nearest."""
    out = []
    for q in Q:
        d = np.round(((X - q) ** 2).sum(1), neighbours.DIGITS)
        at = np.lexsort((y, d))[:k]
        out.append([(float(a), float(b)) for a, b in zip(d[at], y[at], strict=True)])
    return out


def found(spark, X, y, Q, k):
    train = spark.createDataFrame([(list(map(float, x)), float(v)) for x, v in zip(X, y, strict=True)], "x array<double>, y double").repartition(5)
    test = spark.createDataFrame([(list(map(float, q)), i, f"n{i}") for i, q in enumerate(Q)], "x array<double>, id int, name string").repartition(3)
    rows, share = neighbours.nearest(train, test, ["id", "name"], k)
    got = {}
    for r in rows.collect():
        assert r.name == f"n{r.id}"
        got.setdefault(r.id, []).append((round(r.d, neighbours.DIGITS), r.y))
    return [sorted(got.get(i, []))[:k] for i in range(len(Q))], share.first()


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert [y for _, y in g] == [y for _, y in w] and [d for d, _ in g] == pytest.approx([d for d, _ in w], abs=1e-11)


@pytest.mark.parametrize("k", [1, 3, 7])
def test_pruning_leaves_the_nearest(spark, monkeypatch, k):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 25)
    monkeypatch.setattr(neighbours, "ASKED", 2)
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(12, 3)) * 20
    X, Q = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 3)) for n in (600, 90))
    Q[0], Q[1] = X[5], 1e4
    y = rng.integers(0, 50, 600)
    got, share = found(spark, X, y, Q, k)
    same(got, brute(X, y, Q, k))
    assert 0 < share.compared < 0.5 * share.pairs


def test_ties_copies_and_lattices(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    monkeypatch.setattr(neighbours, "RINGS", 4)
    rng = np.random.default_rng(4)
    X = rng.integers(0, 4, (500, 2)).astype(float)
    X[:170] = 1.0  # a third of the rows are equal
    y = rng.integers(0, 30, 500)
    Q = np.r_[rng.integers(0, 4, (40, 2)).astype(float), np.ones((30, 2))]
    got, _ = found(spark, X, y, Q, 4)
    same(got, brute(X, y, Q, 4))


def test_fewer_rows_than_neighbours(spark):
    X, y, Q = np.array([[0.0], [2.0]]), np.array([1.0, 5.0]), np.array([[0.5]])
    got, share = found(spark, X, y, Q, 3)
    same(got, brute(X, y, Q, 3))
    assert share.compared == share.pairs == 1
    with pytest.raises(ValueError, match="no training rows"):
        found(spark, np.zeros((0, 1)), np.zeros(0), Q, 3)


def test_the_share_falls_with_size(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    rng, shares = np.random.default_rng(9), []
    for n in (500, 4000):
        X, Q = rng.normal(size=(n, 2)), rng.normal(size=(n // 4, 2))
        _, share = found(spark, X, rng.normal(size=n), Q, 3)
        shares.append(share.compared / share.pairs)
    assert shares[1] < 0.6 * shares[0]


def test_no_cartesian_product(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i)) for i in range(60)], "id int, a double, b double, y double")
    plan = models.knn_predict(df, df.drop("y"), ["a", "b"], "y", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    row = models.knn_pruning(df, df.drop("y"), ["a", "b"], "y", ["id"]).first()
    assert row.compared <= row.pairs
