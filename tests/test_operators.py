import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.runtime import small
from turnloom.operators import coref, evaluate, graph, pairs, prompts, retrieve, sampling, skew, splits, turns

SLOTS = ["hotel-area", "hotel-name", "hotel-type", "hotel-book day", "restaurant-area", "restaurant-name", "taxi-departure", "taxi-destination", "attraction-name", "train-day"]


@pytest.fixture(scope="module")
def slot_table(spark):
    rows = [(s, f"the {s.split('-')[1]}", f"{s} text", None, f"not like hotel-name in a {s.split('-')[0]}", None, ["x", "y"] if s.endswith("area") else None, None) for s in SLOTS]
    return spark.createDataFrame(rows, "slot string, type_desc string, concise_desc string, question_desc string, contras_desc string, nli_desc string, value array<string>, is_transferable boolean")


# --- skew
def test_attach_equals_a_join(spark):
    keys = [("hot", i) for i in range(900)] + [(f"k{i % 40}", i) for i in range(300)] + [(None, 5), ("lost", 6)]
    rows = spark.createDataFrame(keys, "k string, v int")
    per = spark.createDataFrame([("hot", 1, 900)] + [(f"k{i}", i, 8) for i in range(40)], "k string, w int, _n long")
    weight = {r["k"]: r["w"] for r in per.collect()}
    want = sorted((k, v, weight[k]) for k, v in keys if k in weight)
    assert sorted(map(tuple, skew.attach(rows, per, ["k"]).select("k", "v", "w").collect())) == want
    assert skew.attach(rows.limit(0), per.limit(0), ["k"]).collect() == []


def test_small_tables_are_never_cut(spark):
    assert len(small(spark.range(3), 3)) == 3
    with pytest.raises(ValueError, match="at most 2 rows"):
        small(spark.range(3), 2)


# --- splits
def test_domain_filters(dialogues):
    d = dialogues([(1, {"domains": ["Hotel ", "taxi"], "split": "test"}), (2, {"domains": ["hotel"], "split": "test"}), (3, {"domains": ["police", "hotel"], "split": "train"}), (4, {"domains": None, "split": "dev"}), (5, {"domains": ["train", None, ""], "split": "train"}), (6, {"domains": ["bus"], "split": None})])
    ids = lambda df: sorted(r["rec_id"] for r in df.collect())
    assert ids(splits.allowed_dialogues(d)) == [1, 2, 4, 5]
    assert ids(splits.leave_one_out(d, "hotel")) == [4, 5, 6]
    assert ids(splits.leave_one_out(d, "hotel", part="test")) == [2, 3] and ids(splits.leave_one_out(d, "hotel", part="test", strict=False)) == [1, 2, 3]
    every = {(r["rec_id"], r["left_out"], r["part"]) for r in splits.leave_one_out_all(d).collect()}
    assert (2, "hotel", "test") in every and (1, "hotel", "test") not in every and (5, "hotel", "train") in every and (5, "train", "train") not in every


def test_exact_share(spark):
    rows = spark.range(1000).withColumn("_h", F.lit("clash"))
    got = splits.exact_share(rows.drop("_h"), "id", 0.35)
    assert got.where("chosen").count() == 350
    again = {r["id"] for r in splits.exact_share(rows.drop("_h").repartition(7), "id", 0.35).where("chosen").collect()}
    assert again == {r["id"] for r in got.where("chosen").collect()}
    assert splits.exact_share(spark.range(0), "id", 0.35).collect() == []


def test_id_lists(dialogues, spark):
    d = dialogues([(i, {"dial_id": x}) for i, x in enumerate(["a", "b", "c", None])])
    test, dev = spark.createDataFrame([("a",), ("a",)], "id string"), spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted((r["rec_id"], r["part"]) for r in splits.by_id_lists(d, test, dev).collect()) == [(0, "test"), (1, "dev"), (2, "train"), (3, "train")]


# --- sampling
def test_weighted_sample_follows_weights(spark):
    rows = spark.range(4000).select(F.col("id").alias("g"), F.explode(F.array(*[F.struct(F.lit(x).alias("item"), F.lit(w).alias("w")) for x, w in (("a", 1), ("b", 3))])).alias("s")).select("g", "s.*")
    first = sampling.weighted_sample(rows, ["g"], "item", F.col("w"), 1)
    share = first.where("item = 'b'").count() / 4000
    assert abs(share - 0.75) < 0.03 and first.count() == 4000
    assert sampling.weighted_sample(rows, ["g"], "item", F.col("w"), 9).count() == 8000


def test_negative_slots(spark, slot_table):
    turns_ = spark.createDataFrame([(i, ["taxi-departure", "hotel-area"]) for i in range(300)] + [(500, SLOTS), (501, []), (502, None)], "id int, active array<string>")
    by = collections.defaultdict(list)
    for r in sampling.negative_slots(turns_, slot_table, keys=["id"]).collect():
        by[r["id"]].append(r["slot"])
    confusable = {"taxi-destination", "hotel-name", "attraction-name"}
    assert all(set(by[i]) <= confusable and 1 <= len(by[i]) <= 2 for i in range(300)) and {len(by[i]) for i in range(300)} == {1, 2}
    assert 500 not in by and len(by[501]) == len(by[502]) == 1


def test_ranked_first_and_argmin(spark):
    rows = spark.createDataFrame([(1, 1, 5, "x"), (1, 0, 9, "y"), (1, 0, 2, "z"), (2, 3, 1, "w")], "g int, tier int, rank int, s string")
    assert sorted((r["g"], r["s"]) for r in sampling.ranked_first(rows, ["g"], F.col("tier"), F.col("rank"), ["s"]).collect()) == [(1, "z"), (2, "w")]
    assert sampling.hash_argmin(rows, ["g"], "s", "1").count() == 2


# --- evaluation
@pytest.fixture(scope="module")
def scored(spark):
    rows = [(0, ["a", "b"], ["b", "a"]), (1, ["a"], ["a", "c"]), (2, ["b", "c"], ["b", "b", None]), (3, [], ["a"]), (4, None, None)]
    return evaluate.compared(spark.createDataFrame(rows, "t int, gold array<string>, pred array<string>"))


def test_scores(scored):
    total = {r["slot"]: r for r in evaluate.slot_scores(scored).collect()}
    assert (total[None]["tp"], total[None]["fp"], total[None]["fn"], total[None]["f1"]) == (4, 1, 1, 0.8)
    assert sum(r["tp"] for s, r in total.items() if s) == 4
    acc = evaluate.exact_set_accuracy(scored).first()
    assert (acc["evaluated"], acc["correct"], acc["accuracy"]) == (3, 1, 0.333333)
    assert {r["error_type"]: r["n"] for r in evaluate.error_types(scored).collect()} == {"extra_only": 1, "miss_only": 1}
    assert sorted(map(tuple, evaluate.error_sizes(scored).collect())) == [(0, 1, 1), (1, 0, 1)]
    assert [r["t"] for r in evaluate.error_sample(scored, ["t"]).collect()] == [1, 2]


def test_scores_of_nothing(spark, scored):
    none = scored.limit(0)
    assert evaluate.exact_set_accuracy(none).first()["accuracy"] == 0.0
    assert [tuple(r) for r in evaluate.slot_scores(none).collect()] in ([], [(None, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0)])


def test_goal_accuracy_and_coverage(spark):
    rows = spark.createDataFrame([({"a": "x", "b": "none"}, {"a": "x"}, ["a"], ["b", "a"]), ({"a": "x"}, None, ["a", "b"], ["a"]), (None, {"c": ""}, [], None)], "g map<string,string>, p map<string,string>, gold array<string>, ranked array<string>")
    assert tuple(evaluate.joint_goal_accuracy(rows, "g", "p").first()) == (3, 2, 0.666667)
    assert tuple(evaluate.coverage_at_k(rows, "gold", "ranked", 2).first()) == (2, 1, 0.5)


# --- retrieval
def test_hybrid_score(spark):
    rows = [("g1", 0.80, 0.50, 0.695), ("g2", 0.70, 1.00, 0.850), ("g4", 0.60, -0.20, 0.440)]
    df = spark.createDataFrame(rows, "g string, c double, s double, want double")
    assert all(abs(r["got"] - r["want"]) < 1e-9 for r in df.withColumn("got", retrieve.hybrid_score(F.col("c"), F.col("s"))).collect())


def test_hybrid_retrieval_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=6))
    store = [(f"d{i % 9}::{i}", f"d{i % 9}", [(SLOTS[int(k)], ["change", "confirm"][int(rng.integers(0, 2))], None, None) for k in rng.integers(0, 5, 2)], unit()) for i in range(60)]
    queries = [(i, f"d{i % 12}" if i % 5 else None, SLOTS[int(rng.integers(0, 5))], ["change", "confirm", "other"][i % 3], unit()) for i in range(20)]
    vectors = {s: unit() for s in SLOTS[:5]}
    sims = {(a, b): float(np.dot(vectors[a], vectors[b])) for a in vectors for b in vectors}
    got = collections.defaultdict(list)
    s = spark.createDataFrame(store, "graph_id string, dial_id string, tasklabels array<struct<slot:string,label:string,from_slot:string,from_turn:int>>, vector array<double>")
    q = spark.createDataFrame(queries, "query_id int, dial_id string, slot string, label string, vector array<double>")
    table = spark.createDataFrame([(a, b, v) for (a, b), v in sims.items()], "q_slot string, db_slot string, sim double")
    for r in sorted(retrieve.hybrid_retrieval(q, s, table, block=7).collect(), key=lambda r: (r["query_id"], r["place"])):
        got[r["query_id"]].append((r["graph_id"], r["slot"]))
    for i, dial, slot, label, v in queries:
        ranked = []
        for gid, d, labels, w in store:
            options = [(sims[slot, t[0]], t[0]) for t in labels if t[1] == label]
            if options and (dial is None or d != dial):
                sim, best = max(options, key=lambda x: (x[0], [-ord(c) for c in x[1]]))
                alpha = min(max(0.2 + 0.3 * sim, 0.2), 0.5)
                ranked.append((round((1 - alpha) * float(np.dot(v, w)) + alpha * sim, 9), gid, best))
        assert got[i] == [(g, b) for _, g, b in sorted(ranked, reverse=True)[:3]]


def test_parse_retrieved(spark):
    df = spark.createDataFrame([("d::3::hotel-area",), ("d::x::s",), ("d::3",), ("d::1::a::b",)], "r string")
    assert [tuple(r[0]) for r in df.select(retrieve.parse_retrieved(F.col("r"))).collect()] == [("d", 3, "hotel-area"), ("d", -1, "s"), ("", -1, ""), ("d", 1, "a::b")]


def test_dense_top_slots(spark):
    slots_ = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8])], "slot string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, vector array<double>")
    assert {r["id"]: r["candidates"] for r in retrieve.dense_top_slots(q, slots_, query="id", k=2).collect()} == {1: ["a", "c"], 2: ["b", "c"]}


# --- graphs
@pytest.fixture(scope="module")
def talk(dialogues):
    events = [
        [{"slot": "hotel-area", "label1": "constrain", "curr": "west"}],
        [{"slot": "hotel-type", "label1": "dontcare", "curr": "dontcare"}, {"slot": "restaurant-area", "label1": "constrain", "label2": "refer-clear,refered-slot:hotel-area", "prev": "none", "curr": "west"}],
        [{"slot": "hotel-area", "label1": "change", "prev": "west", "curr": "east"}, {"slot": None, "label1": "change"}],
    ]
    states = [{"hotel-area": "west"}, {"hotel-area": "west", "restaurant-area": "west", "hotel-type": "dontcare"}, {"hotel-area": "east", "restaurant-area": "west", "hotel-type": "dontcare"}]
    return dialogues([(1, {"dial_id": "D1", "turns": [{"system": "s", "user": f"u{i}", "state": s, "events": e, "candidates": ["hotel-name", "restaurant-area", "train-day"]} for i, (s, e) in enumerate(zip(states, events))] + [{"events": []}]})])


def test_graph_store(talk, slot_table):
    rows = {r["turn_no"]: r for r in graph.graph_store(talk, slot_table).collect()}
    assert sorted(rows) == [0, 1, 2] and rows[1]["graph_id"] == "D1::1" and rows[1]["labels_for_retrieval"] == ["dontcare", "refer-clear"]
    assert [tuple(t) for t in rows[1]["tasklabels"]] == [("hotel-type", "dontcare", "", -1), ("restaurant-area", "refer-clear", "hotel-area", 0)]
    rels = collections.Counter(e["rel"] for e in rows[1]["edges"])
    assert rels["activate_slot"] == 2 and rels["refer_to"] == rels["triggers_dontcare"] == 1 and rels["neg_slot"] == rels["value_carry"] == len(rows[1]["neg_slots"])
    for r in rows.values():
        for n in r["neg_slots"]:
            assert (n["neg_type"], n["carry_value"]) in (("void", "none"), ("ghost", "west"), ("ghost", "dontcare")) and n["slot"] not in {t["slot"] for t in r["tasklabels"]}
        keys = [str(e) for e in r["edges"]]
        assert len(keys) == len(set(keys))


def test_edge_lines(talk, slot_table):
    g = graph.graph_store(talk, slot_table).where("turn_no = 1")
    lines = g.select(graph.edge_lines(F.col("edges"), F.lit("hotel-type"), label=F.lit("dontcare"))).first()[0]
    assert lines == ["E1: ctx --activate_slot--> slot(hotel-type)", "E2: label(dontcare) --apply_label--> slot(hotel-type)", "E3: ctx --triggers_dontcare--> label(hotel-type)", "E4: slot(hotel-type) --value_curr--> val(hotel-type=dontcare, role=curr)"]
    ref = g.select(graph.edge_lines(F.col("edges"), F.lit("hotel-area"), ("refer_to",))).first()[0]
    assert ref == ["E1: slot(restaurant-area) --refer_to--> slot(hotel-area)"]


# --- samples and pairs
def test_activation_samples(talk, slot_table):
    by = collections.defaultdict(list)
    for r in sorted(pairs.activation_samples(talk, slot_table).collect(), key=lambda r: (r["turn_no"], r["pos_slot"], r["sample_no"])):
        by[r["turn_no"], r["pos_slot"]].append((r["slot"], r["sample_type"], r["label"]))
    assert by[0, "hotel-area"] == [("hotel-area", "pos", "yes"), ("restaurant-area", "neg_same_type_diff_domain", "no"), ("hotel-name", "neg_same_domain_diff_type", "no")]
    for (turn, pos), rows in by.items():
        gold = {k[1] for k in by if k[0] == turn}
        assert len(rows) == 3 and all(s not in gold for s, _, label in rows if label == "no")
    assert all(not r["slot"].startswith("hotel") for r in pairs.activation_samples(talk, slot_table, held_out="hotel").where("label = 'no'").collect())


def test_preference_pairs(spark, talk, slot_table):
    told = spark.createDataFrame([(1, 2, "hotel-area", "switch"), (1, 0, "hotel-area", "change")], "rec_id bigint, turn_no int, slot string, pred string")
    rows = pairs.preference_pairs(talk, slot_table, told).collect()
    kind = collections.defaultdict(set)
    for r in rows:
        assert r["chosen"] != r["rejected"]
        kind[r["pair_type"]].add((r["turn_no"], r["slot"], r["chosen"], r["rejected"]))
    assert (0, "hotel-area", "CONSTRAIN", "CHANGE") in kind["P_B_label_confusion"] and (1, "restaurant-area", "REF-EXPLICIT", "CONSTRAIN") in kind["P_B_label_confusion"]
    assert kind["P_C_sft_error"] == {(2, "hotel-area", "CHANGE", "SWITCH")}
    assert (1, "hotel-area", "NONE", "CONSTRAIN") in kind["P_A2_memory_interference"] | kind["P_A1_surface_mention"]
    keys = [(r["turn_no"], r["slot"], r["chosen"], r["rejected"]) for r in rows]
    assert len(keys) == len(set(keys))


def test_prompts(talk, slot_table):
    rows = prompts.activation_prompts(pairs.activation_samples(talk, slot_table), talk, slot_table).where("turn_no = 1 and pos_slot = 'hotel-type' and sample_no = 0").collect()
    assert len(rows) == 1 and "[Active so far]\nhotel-area" in rows[0]["prompt"] and "User: u1" in rows[0]["prompt"]
    chat = prompts.chat_messages(talk.sparkSession.createDataFrame([("q", "yes")], "prompt string, label string"), "be brief").first()["messages"]
    assert chat == '[{"role":"system","content":"be brief"},{"role":"user","content":"q"},{"role":"assistant","content":"yes"}]'
    df = talk.sparkSession.createDataFrame([("refer-clear", "west", "hotel-area", 2), ("none", None, None, None), ("odd", "v", "", -1)], "l string, v string, s string, t int")
    out = [r[0] for r in df.select(prompts.reasoning_answer(F.col("l"), F.col("v"), F.col("s"), F.col("t"))).collect()]
    assert out[0].endswith("copy the value of hotel-area from turn 2.\n\nResult: west") and out[1].endswith("Result: none") and "apply odd" in out[2]
    for layout in ("v1", "openai", "alpaca"):
        assert pairs.pair_layout(talk.sparkSession.createDataFrame([("p", "A", "B")], "prompt string, chosen string, rejected string"), layout).count() == 1


# --- references
def test_best_turns(spark, dialogues):
    d = dialogues([(1, {"turns": [{"system": "none", "user": "I need a Train, please"}, {"system": "from where ?", "user": "the station in town"}, {"system": "leaving when", "user": "at noon from town station"}]})])
    texts = spark.createDataFrame([(1, 0, "i need a train please!"), (1, 1, "from where"), (1, 2, "station at noon"), (1, 3, "zzz"), (2, 4, "x")], "rec_id bigint, text_no int, text string")
    assert {r["text_no"]: r["turn_no"] for r in coref.best_turns(texts, d).collect()} == {0: 0, 1: 1, 2: 2, 3: None}


def test_reference_labels(spark, dialogues):
    states = [{"hotel-area": "west"}, {"hotel-area": "west", "restaurant-area": "West"}, {"hotel-area": "west", "restaurant-area": "west", "train-book people": "two"}, {"taxi-book people": "2", "train-book people": "two"}]
    d = dialogues([(1, {"turns": [{"state": s} for s in states]})])
    rows = [(1, 1, "restaurant", "area", "west", 0), (1, 0, "restaurant", "area", "west", -1), (1, 0, "train", "people", "2", -1), (1, 0, "taxi", "day", None, -1), (1, 0, "train", "people", None, 3), (1, 0, "hotel", "stars", "4", 0), (1, None, "hotel", "area", "x", 0), (1, 0, "hotel", "area", "x", -2)]
    a = spark.createDataFrame(rows, "rec_id bigint, turn_no int, domain string, slot_type string, true_value string, source_turn int")
    got = {(r["turn_no"], r["slot"]): r["tags"] for r in coref.reference_labels(a, d).collect()}
    assert got == {(1, "restaurant-area"): ["refer-clear", "refered-slot:hotel-area", "refered-value:west"], (3, "train-book people"): ["refer-clear", "refered-slot:taxi-book people", "refered-value:2"], (0, "taxi-day"): ["refer-implicit"], (0, "train-people"): ["refer-implicit"]}
    assert sorted(r["reason"] for r in coref.missed_annotations(a).collect()) == ["invalid source turn", "no matching turn", "slot type doesn't refer"]


def test_merge_tags(spark):
    events = spark.createDataFrame([(1, 0, "a", "constrain", "confirm", "", "x")], "rec_id bigint, turn_no int, slot string, label1 string, label2 string, prev_val string, curr_val string")
    tags = spark.createDataFrame([(1, 0, "a", ["refer-implicit"], "x", ""), (1, 2, "b", ["refer-clear"], "y", "z")], "rec_id bigint, turn_no int, slot string, tags array<string>, curr_val string, prev_val string")
    assert sorted((r["slot"], r["label1"], tuple(r["label2"]), r["prev_val"], r["curr_val"]) for r in coref.merge_tags(events, tags).collect()) == [("a", "constrain", ("confirm", "refer-implicit"), "", "x"), ("b", "", ("refer-clear",), "z", "y")]


def test_sampling_key_is_finite(spark):
    assert all(math.isfinite(r[0]) and r[0] > 0 for r in spark.range(50).select(sampling.sampling_key(F.lit(2.0), F.col("id").cast("string"))).collect())
    assert turns is not None
