import collections
import math

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING
from turnloom.llm import topn
from turnloom.llm.topn import retrieved_items, top_per_group


def brute(rows, n):
    best = collections.defaultdict(dict)
    for g, item, score in rows:
        if item is not None and score is not None and not math.isnan(score):
            best[g][item] = max(score, best[g].get(item, -math.inf))
    return {(g, i + 1, item) for g, items in best.items() for i, (item, _) in enumerate(sorted(items.items(), key=lambda x: (x[1], x[0].encode()), reverse=True)[:n])}


def test_matches_brute_force_with_hot_group(spark, monkeypatch):
    monkeypatch.setattr(topn, "CHUNK", 500)
    rng = np.random.default_rng(1)
    rows = []
    for k in range(6000):
        group = None if k % 50 == 0 else 1 if k % 3 == 0 else int(rng.integers(2, 400))
        item = None if k % 41 == 0 else f"é{int(rng.integers(0, 60))}" if k % 7 == 0 else f"i{int(rng.integers(0, 60))}"
        score = None if k % 37 == 0 else float("nan") if k % 43 == 0 else float(rng.integers(-5, 5)) / 4
        rows += [(group, item, score)] * (1 + (k % 11 == 0))
    df = spark.createDataFrame(rows, "grp long, thing string, val double").repartition(5).withColumns({c: F.lit(1) for c in CLASHING})
    for n in (1, 3):
        got = [(r["grp"], r["place"], r["thing"]) for r in top_per_group(df, group="grp", item="thing", score="val", n=n).collect()]
        assert set(got) == brute(rows, n) and len(got) == len(set(got))
    assert top_per_group(df.limit(0), group="grp", item="thing", score="val").collect() == []


def test_own_dialogue_does_not_count(spark):
    df = spark.createDataFrame([(1, "D::x", ["D::x::0", "E::1", None, "noturn"], [0.9, 0.5, 0.8, 0.1]), (2, None, ["D::1"], [None]), (3, "D", None, None), (4, "D", [], [])], "query_id long, dial_id string, retrieved_topk_ids array<string>, retrieved_scores array<double>")
    assert sorted((r["query_id"], r["graph_id"]) for r in retrieved_items(df).collect()) == [(1, "E::1"), (1, "noturn")]
