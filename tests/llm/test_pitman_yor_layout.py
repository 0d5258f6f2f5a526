"""Scores of the language model don't depend on how many tasks the tokens are dealt to."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import pitman_yor

WORDS = [f"w{i}" for i in range(40)]


def frame(spark):
    rng = np.random.default_rng(5)
    weights = 1 / np.arange(1, len(WORDS) + 1) ** 1.3
    texts = [" ".join(rng.choice(WORDS, rng.integers(0, 60), p=weights / weights.sum())) for _ in range(120)] + [None, "", "w0", "w0 w0 " * 40]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_scores_do_not_depend_on_the_number_of_tasks(spark, monkeypatch):
    docs, learn = frame(spark), F.col("doc_id") % 5 != 1
    whole = {r.doc_id: r for r in pitman_yor.scored(docs, learn).collect()}
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 60)
    often, total = pitman_yor.frequent(docs.select("text"), "text")
    assert total > 32 * 60 and all(len(keys) for keys, _ in often.by_kind)  # more buckets, frequent words and frequent pairs
    assert any(len(names) > 1 for _, names in often.homes)
    parted = {r.doc_id: r for r in pitman_yor.scored(docs.repartition(3), learn).collect()}
    assert len(whole) == 124 and whole == parted


def test_words_spread_over_chunks_are_found(spark, monkeypatch):
    """A word with less than a share of each chunk has many tokens in all."""
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 60)
    rows = [(" ".join(["rare", *(f"x{j}" for j in range(2000))]),) for _ in range(200)]
    often, _ = pitman_yor.frequent(spark.createDataFrame(rows, "text string").repartition(200), "text")
    assert len(often.words) >= 2001 and (often.by_kind[0][1] == 4).all()


@pytest.mark.parametrize("shape", [0.25, 0.9, 1.0, 3.3, 250.0])
def test_keyed_gammas(shape):
    keys, n = pitman_yor.spread(np.arange(40_000)), 40_000
    got = pitman_yor.Keyed(keys, 3).standard_gamma(np.full(n, shape))
    assert got.mean() == pytest.approx(shape, abs=5 * np.sqrt(shape / n))
    want = np.random.default_rng(1).standard_gamma(shape, n)
    for q in (0.05, 0.25, 0.5, 0.75, 0.95):
        assert (got < np.quantile(want, q)).mean() == pytest.approx(q, abs=0.016)
    some = np.arange(0, n, 7)
    assert (pitman_yor.Keyed(keys[some], 3).standard_gamma(np.full(len(some), shape)) == got[some]).all()
    assert (pitman_yor.Keyed(keys, 4).standard_gamma(np.full(n, shape)) != got).all()
    assert (pitman_yor.Keyed(keys, 3).standard_gamma(np.zeros(n)) == 0).all()
