from pyspark.sql import functions as F

from turnloom.operators import corpus

LOG = "name string, log array<struct<text:string,metadata:map<string,struct<book:map<string,string>,semi:map<string,string>>>>>"


def test_logs(spark):
    first = {"hotel": ({"booked": "[]", "day": ""}, {"area": "West", "name": "not mentioned", "stars": "don't care"})}
    second = {"hotel": ({"booked": "[x]", "day": "monday"}, {"area": "east", "name": ""}), "taxi": ({}, {"departure": "not mentioned"})}
    rows = [
        ("A", [("I want a hotel.", {}), ("Where?", first), ("East", {}), ("Done", second)]),
        ("odd", [("x", {})]),
        ("accent", [("é", {}), ("y", {})]),
        ("long", [("w " * 60, {}), ("y", {})]),
        ("none", None),
    ]
    df = spark.createDataFrame(rows, LOG)
    out = corpus.from_logs(df).collect()
    assert [r["dial_id"] for r in out] == ["A"] and out[0]["domains"] == ["hotel"]
    turns = out[0]["turns"]
    assert [(t["system"], t["user"]) for t in turns] == [("none", "i want a hotel ."), ("where ?", "east")]
    assert turns[0]["state"]["slot_values"] == {"hotel-area": "west", "hotel-stars": "dontcare"}
    assert turns[1]["state"]["slot_values"] == {"hotel-book day": "monday", "hotel-area": "east"}
    flags = df.where("name = 'A'").select(corpus.belief_indicators(F.get("log", F.lit(3))["metadata"], [("hotel", ["booked", "day"], ["area", "name"]), ("taxi", [], ["departure"]), ("train", ["people"], ["day"])])).first()[0]
    assert flags == [1, 1, 0, 0, 1, 0, 0, 0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0]
    assert df.where("name = 'A'").select(corpus.active_domains(F.get("log", F.lit(1))["metadata"])).first()[0] == ["hotel"]


def test_frames(spark):
    kind = "dialogue_id string, turns array<struct<speaker:string,utterance:string,frames:array<struct<service:string,state:struct<active_intent:string,slot_values:map<string,array<string>>>>>>>"
    turns = [
        ("USER", "a hotel in Paris, or Rome", [("Hotels_1", ("Find", {"city_name": ["rome", "paris"], "x": []}))]),
        ("SYSTEM", "which day?", []),
        ("SYSTEM", "or night?", None),
        ("USER", "monday", [("Hotels_2", ("NONE", {"city_name": ["oslo"], "day": ["tuesday", "monday"]})), ("Taxi_1", (None, None))]),
    ]
    df = spark.createDataFrame([("D", turns), ("E", None), ("F", [])], kind)
    out = {r["dial_id"]: r for r in corpus.from_frames(df).collect()}
    assert [(t["system"], t["user"], t["state"]["active_intent"]) for t in out["D"]["turns"]] == [("none", "a hotel in Paris, or Rome", "Find"), ("or night?", "monday", None)]
    assert out["D"]["turns"][0]["state"]["slot_values"] == {"hotels-city name": "rome"}
    assert out["D"]["turns"][1]["state"]["slot_values"] == {"hotels-city name": "oslo", "hotels-day": "monday"}
    assert out["D"]["domains"] == ["hotels", "taxi"] and out["F"]["turns"] == []
    last = corpus.from_frames(df, pick="last").where("dial_id = 'D'").first()
    assert last["turns"][0]["state"]["slot_values"]["hotels-city name"] == "paris"


def test_domain_tokens(spark):
    df = spark.createDataFrame([("[hotel_name] at [taxi_phone]", ["hotel", "hotel"]), ("[hotel_name]", ["a", "b"]), ("[hotel_name]", [])], "t string, a array<string>")
    assert [r[0] for r in df.select(corpus.repair_domain_tokens(F.col("t"), F.col("a"))).collect()] == ["[hotel_name] at [hotel_phone]", "[hotel_name]", "[hotel_name]"]
