"""Quality verdicts don't depend on how rows meet the numbers of their group."""

import numpy as np
from test_llm import DOCS, prose

from wearline.llm import common, quality


def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        text = prose(i, int(rng.integers(30, 90))) if i % 9 else " ".join("$#%&|" + w for w in prose(i, 40).split())
        source = None if i % 50 == 1 else "hot" if i % 3 else f"s{i % 17}"
        rows.append((i, text, ("en", "de", None)[i % 3 if i % 2 else 0], source, len(text), "clash"))
    return spark.createDataFrame(rows, DOCS).select("doc_id", "lang", "source", "text")


def judged(spark):
    rows = quality.verdicts(quality.statistics(frame(spark))).collect()
    return {r.doc_id: (r.kept, r.base_failed, None if r.distance2 is None else round(r.distance2, 6)) for r in rows}


def test_many_groups_get_the_same_verdicts(spark, monkeypatch):
    few = judged(spark)
    assert len(few) == 400 and any(not k and not b for k, b, _ in few.values())
    monkeypatch.setattr(quality, "FEW_GROUPS", 0)
    monkeypatch.setattr(quality, "spread_join", lambda *a, **k: common.spread_join(*a, rows=10, **k))
    assert judged(spark) == few


def test_joins_of_many_groups_deal_rows(spark, monkeypatch):
    """Beyond FEW_GROUPS the row of all documents is broadcast, and the other joins have a piece in their keys."""
    monkeypatch.setattr(quality, "FEW_GROUPS", 0)
    rows = spark.createDataFrame([("all", 1.0), ("a", 2.0), ("a", 3.0), ("z", 4.0)], "`group` string, v double")
    numbers = spark.createDataFrame([("all", 7), ("a", 8)], "`group` string, k int")
    size = spark.createDataFrame([("all", 4), ("a", 2)], "`group` string, n bigint")
    got = quality.met(rows, numbers, (size, 2), ["group"], "left")
    assert sorted((r.group, r.v, r.k) for r in got.collect()) == sorted([("all", 1.0, 7), ("a", 2.0, 8), ("a", 3.0, 8), ("z", 4.0, None)], key=lambda x: x[:2])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" in plan and "strategy=broadcast" in plan
