import pytest
from pyspark.sql import functions as F

from turnloom.operators import memory, state, turns

H = [
    {"system": "none", "user": "a cheap hotel in the west", "state": {"hotel-area": "west", "hotel-pricerange": "cheap"}},
    {"system": "how about the acorn guest house ?", "user": "yes please", "state": {"hotel-area": "west", "hotel-pricerange": "cheap", "hotel-name": "acorn guest house"}},
    {"system": "booked . anything else ?", "user": "area does not matter", "state": {"hotel-area": "dontcare", "hotel-pricerange": "cheap", "hotel-name": "acorn guest house"}},
    {"system": "ok", "user": "i need a taxi to the station", "state": {"hotel-area": "dontcare", "hotel-name": "acorn guest house", "taxi-destination": "station"}},
    {"system": "sure", "user": "thanks", "state": {"hotel-area": "dontcare", "hotel-name": "acorn guest house", "taxi-destination": "station"}},
]


@pytest.fixture(scope="module")
def demo(dialogues):
    return dialogues([(1, {"turns": H}), (2, {"turns": None}), (3, {"turns": []}), (4, {"turns": [{}, None]})], ("slot", "value", "now", "was", "_t"))


def test_labels(demo):
    got = [(r["turn_no"], r["slot"], r["label1"], r["label2"], r["prev_val"], r["curr_val"]) for r in state.label_turns(demo).orderBy("turn_no", "slot").collect()]
    assert got == [
        (0, "hotel-area", "constrain", "", "", "west"),
        (0, "hotel-pricerange", "constrain", "", "", "cheap"),
        (1, "hotel-name", "constrain", "confirm", "", "acorn guest house"),
        (2, "hotel-area", "dontcare", "", "west", "dontcare"),
        (3, "taxi-destination", "switch", "", "", "station"),
    ]
    assert {r["turn_no"]: r["tasklabel"] for r in state.turn_labels(demo).where("rec_id = 1").collect()} == {0: "task", 1: "task", 2: "task", 3: "task", 4: "notask"}


def test_delta_dialects(demo):
    at3 = lambda d: sorted((r["slot"], r["kind"]) for r in state.state_deltas(demo, d).where("rec_id = 1 and turn_no = 3").collect())
    assert at3("label") == [("taxi-destination", "added")]
    assert at3("activation") == at3("recheck") == [("hotel-pricerange", "removed"), ("taxi-destination", "added")]
    assert at3("gold") == [("taxi-destination", "added")]
    gold = {r["turn_no"]: (r["is_gold"], r["snapshot"]) for r in state.gold_turns(demo, "hotel").where("rec_id = 1").collect()}
    assert not gold[3][0] and gold[3][1]["hotel-pricerange"] == "cheap"


def test_none_deletes(dialogues):
    df = dialogues([(1, {"turns": [{"state": {"a-b": "x"}}, {"state": {"a-b": "None"}}, {}, {"state": {"a-b": " y "}}]})])
    assert sorted((r["turn_no"], r["value"]) for r in state.cumulative_state(df).collect()) == [(0, "x"), (3, "y")]
    assert sorted((r["turn_no"], r["kind"]) for r in state.state_deltas(df, "gold").collect()) == [(0, "added"), (1, "removed"), (3, "added")]


def test_delta_then_apply_gives_the_next_state(demo):
    folded = state.cumulative_state(demo, deletes=False).where("rec_id = 1 and turn_no = 4")
    assert {r["slot"]: r["value"] for r in folded.collect()} == {"hotel-area": "dontcare", "hotel-pricerange": "cheap", "hotel-name": "acorn guest house", "taxi-destination": "station"}


def test_runs_and_first_valid(dialogues):
    values = ["west", "west", "north", "west", "west", "west"]
    df = dialogues([(1, {"turns": [{"state": {"hotel-area": v}} for v in values]}), (2, {"turns": [{"state": {"hotel-area": "dontcare"}}, {"state": {"hotel-area": "east"}}]})])
    runs = {r["turn_no"]: r["from_turn"] for r in state.run_starts(df).where("rec_id = 1").collect()}
    assert runs == {0: -1, 1: 0, 2: -1, 3: 0, 4: 3, 5: 3}
    assert {r["rec_id"]: r["ref_turn"] for r in state.first_valid_turns(df).collect()} == {1: 0, 2: 1}


def test_contexts(demo):
    k2 = {r["turn_no"]: r["context"] for r in turns.contexts(demo, 2).where("rec_id = 1").collect()}
    assert k2[0] == "[t0][SYS] none\n[t0][USR] a cheap hotel in the west" and k2[4].startswith("[t2][SYS] booked") and k2[4].count("\n") == 5
    empty = {(r["rec_id"], r["turn_no"]): r["context"] for r in turns.contexts(demo, 1, "plain").where("rec_id = 4").collect()}
    assert empty == {(4, 0): "", (4, 1): ""}


def test_round_trip_of_turns(demo):
    rows = turns.turn_table(demo, "system", "user").repartition(7)
    back = {r["rec_id"]: r["turns"] for r in turns.nest_turns(rows, "system", "user").collect()}
    assert [t["user"] for t in back[1]] == [t["user"] for t in H] and len(back[4]) == 2


def test_memory_sees_only_turns_before(dialogues):
    events = [[{"slot": "hotel-area", "label1": "constrain", "curr": "west"}], [{"slot": "hotel-book day", "label1": "constrain", "curr": "wednesday"}, {"slot": "hotel-area", "label1": "change", "curr": "east", "label2": "refer-clear,refered-slot:hotel-book day"}], [{"slot": "taxi-destination", "label1": "switch", "curr": "x"}]]
    df = dialogues([(1, {"turns": [{"system": "s", "user": "u", "events": e} for e in events] + [{"events": None}]})])
    rows = {(r["turn_no"], r["event_no"]): r for r in memory.memory_contexts(df).collect()}
    assert rows[1, 0]["domain_context"] == "- slot=hotel-area, latest_turn=0, action=CONSTRAIN, value=west"
    assert rows[0, 0]["domain_context"] == rows[0, 0]["memory_turns"] == "None"
    assert rows[1, 1]["memory_turns"].startswith("[Memory turn 0-0] (action: CONSTRAIN, value: west)") and rows[1, 1]["ref_slot_memory"] == "[Reference slot] hotel-book day\nNone"
    assert rows[2, 0]["domain_context"] == "No prior activation in target domain. Activated other domains: hotel"
    chain = {(r["turn_no"], r["event_no"]): (r["n_before"], r["last_turn"], r["last_action"]) for r in memory.slot_memories(df).collect()}
    assert chain == {(0, 0): (0, None, None), (1, 0): (0, None, None), (1, 1): (1, 0, "CONSTRAIN"), (2, 0): (0, None, None)}


def test_speaker_pairs(spark):
    said = [(1, 0, "USER", "hi"), (1, 1, "SYSTEM", "what?"), (1, 2, "USER", "a hotel"), (1, 3, "USER", "cheap")]
    df = spark.createDataFrame(said, "d int, at int, who string, text string")
    assert [tuple(r)[1:4] for r in turns.pair_speakers(df, dialogue="d", order="at", speaker="who", text="text").orderBy("turn_no").collect()] == [(0, "none", "hi"), (1, "what?", "a hotel"), (2, "what?", "cheap")]


def test_belief_and_frames(spark):
    meta = spark.createDataFrame([(1, {"hotel": ({"day": "monday", "booked": "[]"}, {"area": "west", "name": "not mentioned"})})], "id int, metadata map<string,struct<book:map<string,string>,semi:map<string,string>>>")
    assert sorted(tuple(r) for r in turns.belief_slots(meta, keys=["id"]).collect()) == [(1, "hotel-area", "west"), (1, "hotel-book day", "monday")]
    frames = spark.createDataFrame([(1, "to Paris or Rome", {"to_city": ["london", "paris", "rome"], "day": ["x", "y"]})], "id int, u string, slot_values map<string,array<string>>")
    pick = lambda p: {r["slot"]: r["value"] for r in turns.frame_values(frames, keys=["id"], utterance="u", pick=p).collect()}
    assert pick("first") == {"to city": "paris", "day": "x"} and pick("last") == {"to city": "rome", "day": "x"}


def test_asof(spark):
    events = spark.createDataFrame([(1, "a", 0, "x"), (1, "a", 2, "y"), (2, "a", 1, "z")], "rec_id int, slot string, turn_no int, label string")
    probes = spark.createDataFrame([(1, "a", 0, "p"), (1, "a", 2, "q"), (1, "a", 3, "r"), (1, "b", 3, "s")], "rec_id int, slot string, turn_no int, tag string")
    got = {r["tag"]: (r["last_turn_no"], r["last_label"]) for r in memory.latest_activation_asof(events, probes, keys=["rec_id", "slot"], carry=["label"]).collect()}
    assert got == {"p": (None, None), "q": (0, "x"), "r": (2, "y"), "s": (None, None)}


def test_results_do_not_depend_on_partitions(demo):
    a = sorted(map(str, state.label_turns(demo).collect()))
    assert a == sorted(map(str, state.label_turns(demo.repartition(5)).collect()))


def test_no_shuffle_for_windows(demo):
    plan = state.label_turns(demo)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert F is not None
