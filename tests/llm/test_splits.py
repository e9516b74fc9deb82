import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING
from turnloom.llm import splits
from turnloom.llm.splits import anneal, clean_labels, components, dialogue_keys, keep_together, related_pairs, split_report, split_components


@pytest.mark.parametrize(
    ("dial_id", "domains", "keys"),
    [
        ("MLT0000012.json", ["hotel"], ["mlt:12"]),
        (" mlt 12", None, ["mlt:12"]),
        ("dump_01/Mlt_0000012_v3.json", [], ["mlt:12"]),
        ("MLT0000012.json~4", ["x"], ["mlt:12"]),
        ("MLT0000012 (copy).json", ["x"], ["mlt:12"]),
        ("MLT-0000000.rev2", ["x"], ["mlt:0"]),
        ("XMLT0000012.jsonl", ["x"], ["xmlt:12"]),
        ("SGL0000007.json", ["Hotels ", "taxi", None, "", "taxi"], ["sgl:7|hotel,taxi"]),
        ("SGL-7", None, ["sgl:7|"]),
        ("merged/MLT0000001-MLT0000002.json", ["x"], ["mlt:1", "mlt:2"]),
        ("mlt0000001__mlt0000002.json", ["x"], ["mlt:1", "mlt:2"]),
        ("MLT1 & MLT1", ["x"], ["mlt:1"]),
        ("10_00011_v2", ["x"], ["10_11"]),
        ("raw/9-3.json", ["x"], ["9_3"]),
        ("31_00012#3", ["x"], ["31_12"]),
        ("unknown", ["x"], []),
        ("", ["x"], []),
        (None, ["x"], []),
    ],
)
def test_dialogue_keys(spark, dial_id, domains, keys):
    df = spark.createDataFrame([(dial_id, domains)], "dial_id string, domains array<string>")
    assert df.select(dialogue_keys(F.col("dial_id"), clean_labels(F.col("domains")))).first()[0] == keys


def brute_components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    links = [(f"n{a:03}", f"n{b:03}") for a, b in rng.integers(0, 150, (140, 2))] + [("hub", f"spoke{i:03}") for i in range(200)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("a", "a")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    want = {k: v for k, v in brute_components([x for x in links if x[0] != x[1]]).items()}
    assert got == want


def test_related_pairs(spark, dialogues):
    rows = [(5, "MLT1"), (2, "mlt 01.json"), (9, "MLT0001+MLT3.json"), (7, "MLT3_v2.json"), (1, None), (3, ""), (4, "unknown"), (8, "12_3"), (6, "12-00003")]
    df = dialogues([(r, {"dial_id": i, "domains": ["hotel"]}) for r, i in rows], CLASHING)
    assert sorted(map(tuple, related_pairs(df).collect())) == [(2, 5), (2, 7), (2, 9), (6, 8)]
    assert related_pairs(df.limit(0)).collect() == []
    sgl = dialogues([(1, {"dial_id": "SGL1", "domains": ["hotel"]}), (2, {"dial_id": "sgl 1", "domains": [" HOTELS "]}), (3, {"dial_id": "SGL1", "domains": ["taxi"]})])
    assert sorted(map(tuple, related_pairs(sgl).collect())) == [(1, 2)]


def test_splits_keep_groups_and_shares(spark, dialogues):
    rng = np.random.default_rng(2)
    rows = [(i, {"dial_id": f"MLT{int(rng.integers(0, 900))}" if i % 3 else "MLT5000", "domains": [["hotel"], ["taxi"], ["train", "hotel"], None][i % 4]}) for i in range(1500)]
    df = dialogues(rows, CLASHING)
    got = keep_together(df)
    out = got.collect()
    assert sorted(r["rec_id"] for r in out) == list(range(1500))
    by = collections.defaultdict(set)
    for r in out:
        by[r["component"]].add(r["assigned_split"])
    assert all(len(s) == 1 for s in by.values())
    share = collections.Counter(r["assigned_split"] for r in out)
    assert abs(share["train"] / 1500 - 0.8) < 0.01 and abs(share["dev"] / 1500 - 0.1) < 0.01
    for r in split_report(got).where("label in ('hotel', 'taxi', 'train')").collect():
        assert abs(r["share"] - {"train": 0.8, "dev": 0.1, "test": 0.1}[r["assigned_split"]]) < 0.03
    assert keep_together(df.limit(0)).collect() == []


def test_records_without_ids(spark, dialogues):
    df = dialogues([(None, {"dial_id": "MLT1", "domains": ["hotel"]}), (1, {"dial_id": "MLT1", "domains": ["hotel"]}), (None, {"dial_id": None})])
    got = keep_together(df).collect()
    assert len(got) == 3 and len({r["assigned_split"] for r in got if r["component"] == "mlt:1"}) == 1
    assert related_pairs(df).collect() == []


def test_anneal_beats_the_start():
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 9, (300, 3)).astype(float)
    targets = np.array([0.8, 0.1, 0.1])[:, None] * weights.sum(axis=0)[None, :]
    start = rng.integers(0, 3, 300)
    off = lambda at: sum(np.abs(weights[at == s].sum(axis=0) - targets[s]).sum() for s in range(3))
    assert off(anneal(weights, targets, start, 1)) < 0.1 * off(start)


def test_heat_finds_better_splits(monkeypatch):
    """Few large components: descent gets stuck where warmer chains do not."""
    def total():
        energy = 0.0
        for seed in range(40):
            rng = np.random.default_rng(seed)
            weights = rng.integers(5, 90, (14, 2)).astype(float)
            targets = np.array([0.5, 0.3, 0.2])[:, None] * weights.sum(axis=0)[None, :]
            at = anneal(weights, targets, rng.integers(0, 3, 14), seed, steps=150)
            off = np.stack([weights[at == s].sum(axis=0) for s in range(3)]) - targets
            energy += float((off * off).sum())
        return energy

    warm = total()
    monkeypatch.setattr(splits, "HEAT", 0.0)
    assert warm < 0.8 * total()


def test_large_components_are_searched_too(spark):
    """Forty components of one to ten hundredths of the records each, all of them over the limit."""
    rng = np.random.default_rng(5)
    rows = [(f"c{i:02}", [int(n), int(n * rng.random())]) for i, n in enumerate(rng.integers(20, 200, 40))]
    sizes = spark.createDataFrame(rows, "component string, weights array<bigint>")
    got = {r["component"]: r["split"] for r in split_components(sizes, 1).collect()}
    assert sorted(got) == [c for c, _ in rows]
    for k in range(2):
        total = sum(w[k] for _, w in rows)
        for split, share in splits.SHARES.items():
            assert abs(sum(w[k] for c, w in rows if got[c] == split) - share * total) < 0.01 * total


def test_report_against_the_hashed_start(spark, dialogues):
    df = dialogues([(i, {"dial_id": f"MLT{i % 300}", "domains": [["hotel"], ["taxi"]][i % 2]}) for i in range(1200)])
    report = split_report(keep_together(df)).collect()
    off = {k: sum(abs(r[k] - splits.SHARES[r["assigned_split"]] * (1200 if r["label"] == "" else 600)) for r in report) for k in ("n_records", "n_hashed")}
    assert off["n_records"] < 0.25 * off["n_hashed"] and sum(r["n_hashed"] for r in report) == sum(r["n_records"] for r in report) == 2400


def test_all_labels_are_weighed(spark, dialogues, monkeypatch):
    df = dialogues([(i, {"dial_id": f"MLT{i}", "domains": [f"area {i % 80:02}x"]}) for i in range(800)])
    widths = []

    def watched(sizes, n_labels, shares=None):
        widths.append(n_labels)
        return split_components(sizes, n_labels, shares)

    monkeypatch.setattr(splits, "split_components", watched)
    assert keep_together(df).count() == 800 and widths == [80]
    monkeypatch.setattr(splits, "MOST_LABELS", 79)
    with pytest.raises(ValueError, match="at most 79"):
        keep_together(df)
