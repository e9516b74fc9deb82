import json

from pyspark.sql import functions as F

from turnloom.sources import readers, writers
from turnloom.streaming import rolling


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


D = {"dial_id": "a", "domains": ["hotel"], "turns": [{"turn_id": 0, "system": "none", "user": "hi", "state": {"slot_values": {"hotel-area": "west"}}, "taklabels": [{"slot": "hotel-area", "label-1": "constrain", "label-2": ["confirm", "x"]}]}]}


def test_layouts(spark, tmp_path):
    other = {"dialogue_id": "b", "dialog": [{"user": "yo"}]}
    files = {
        "list.json": json.dumps([D, other], indent=1),
        "lines.jsonl": json.dumps(D) + "\n\n" + json.dumps(other) + "\n",
        "dialogs.json": json.dumps({"dialogs": [D, other]}),
        "data.json": json.dumps({"data": [D, other]}, indent=2),
        "keyed.json": json.dumps({"a": {k: v for k, v in D.items() if k != "dial_id"}, "b": other}),
    }
    for name, text in files.items():
        rows = {r["dial_id"]: r for r in readers.read_dialogues(spark, put(tmp_path / name, text)).collect()}
        assert sorted(rows) == ["a", "b"], name
        assert rows["a"]["turns"][0]["state"]["slot_values"] == {"hotel-area": "west"} and rows["b"]["turns"][0]["user"] == "yo"
        assert json.loads(rows["a"]["turns"][0]["taklabels"][0]["label-2"]) == ["confirm", "x"]
    one = readers.read_dialogues(spark, put(tmp_path / "one.json", json.dumps(D))).collect()
    assert [r["dial_id"] for r in one] == ["a"]


def test_small_files(spark, tmp_path):
    assert readers.read_ids(spark, put(tmp_path / "ids.txt", "a\n\n b \n")).count() == 2
    assert [tuple(r) for r in readers.read_pairs(spark, put(tmp_path / "m.pair", "it 's\tits\n")).collect()] == [("it 's", "its")]
    schema = put(tmp_path / "schema.json", json.dumps([{"service_name": "H_1", "slots": [{"name": "city", "is_categorical": False}]}, {"service_name": "R_1", "slots": [{"name": "city"}, {"name": "x"}]}]))
    rows = readers.read_service_schemas(spark, schema)
    assert rows.count() == 3 and [tuple(r) for r in readers.repeated_slots(rows).collect()] == [("city", ["H_1", "R_1"])]
    acts = put(tmp_path / "acts.json", json.dumps({"D1": {"1": {"Hotel-Request": [["Area", "?"]], "Hotel-Inform": [["Stars", "4"]]}, "2": {}}}))
    assert sorted(tuple(r)[1:] for r in readers.read_acts(spark, acts).collect()) == [(1, "hotel", "inform", "stars", "4"), (1, "hotel", "request", "area", None)]
    for s in ("train", "test"):
        put(tmp_path / "corpus" / s / "dialogue_001.json", json.dumps([{"dial_id": s}]))
    assert sorted((r["dial_id"], r["split"]) for r in readers.read_split_files(spark, str(tmp_path / "corpus"), "dial_id string", ("train", "test")).collect()) == [("test", "test"), ("train", "train")]


def test_last_prediction_counts(spark, tmp_path):
    path = put(tmp_path / "p.jsonl", "\n".join(map(json.dumps, [{"dial_id": "a", "turn_id": 1, "slot": "s", "pred": "X"}, {"dial_id": "a", "turn_id": 1, "pred_detail": [{"slot": "s", "pred_action": "Y"}, {"slot": "t", "pred_label": "Z"}]}])))
    assert sorted(tuple(r) for r in readers.read_predictions(spark, path).collect()) == [("a", 1, "s", "Y"), ("a", 1, "t", "Z")]
    path = put(tmp_path / "c.jsonl", "\n".join(map(json.dumps, [{"dial_id": "a", "turn_id": 1, "candidates": ["x"]}, {"dial_id": "a", "turn_id": 1, "candidates": ["y"]}])))
    assert [tuple(r) for r in readers.read_candidates(spark, path).collect()] == [("a", 1, ["y"])]


def test_missing_candidates(spark):
    turns = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("", 0), (None, 0)], "dial_id string, turn_id int")
    cand = spark.createDataFrame([("a", 0, ["x"])], "dial_id string, turn_id int, candidates array<string>")
    assert sorted((r["dial_id"] or "", r["reason"]) for r in readers.missing_candidates(turns, cand).collect()) == [("", "no_dial_id"), ("", "no_dial_id"), ("a", "turn_not_in_candidates"), ("b", "dial_not_in_candidates")]
    assert {(r["dial_id"], r["turn_id"]): r["candidates"] for r in readers.attach_candidates(turns, cand).collect()}["a", 1] == []


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"', "x"), (2, "é", "y"), (3, None, "x")], "id int, t string, part string").repartition(2)
    assert writers.write_lines(df, str(tmp_path / "lines")) == 3 and spark.read.json(str(tmp_path / "lines")).count() == 3
    writers.write_array(df.coalesce(1), str(tmp_path / "array"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*")))
    assert sorted(r["id"] for r in json.loads(text)) == [1, 2, 3]
    writers.write_array(df.limit(0).coalesce(1), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*")) or "[]") == []
    writers.write_table(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).count() == 3
    writers.write_ids(df, "id", str(tmp_path / "ids"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["1", "2", "3"]
    writers.write_parts(df, str(tmp_path / "parts"), ("part",))
    assert spark.read.json(str(tmp_path / "parts" / "part=x")).count() == 2
    writers.write_all(df, {"all": (str(tmp_path / "o1"), lambda d: d), "x": (str(tmp_path / "o2"), lambda d: d.where("part = 'x'"))})
    assert spark.read.json(str(tmp_path / "o2")).count() == 2
    assert writers.derived_paths("d/x.json") == ("d/x_with_refer.json", "d/x_missed_refer.json")


def test_rolling_batch_and_stream_agree(spark, tmp_path):
    rows = [(d, t, f"v{d}{t}, x", [f"slot-{t % 2}"] if t != 3 else []) for d in range(4) for t in range(5)]
    df = spark.createDataFrame(rows, "rec_id bigint, turn_no int, user string, candidates array<string>")
    batch = {(r["key"], r["turn_no"]): r["state"] for r in rolling.rolling_batch(df.repartition(3)).collect()}
    assert batch["1", 4] == {"slot-0": "v14", "slot-1": "v11"}
    source = str(tmp_path / "in")
    for t in range(0, 5, 2):
        df.where(f"turn_no in ({t}, {t + 1})").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = rolling.rolling_stream(stream).writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["key"], r["turn_no"]): r["state"] for r in spark.table("rolled").collect()} == batch


def test_memory_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a", "CHANGE"), (1, 1, "a", "NONE"), (1, 2, "a", "CONFIRM"), (1, 2, "b", "SWITCH")], "rec_id bigint, turn_no int, slot string, action string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    rolling.memory_stream(stream).writeStream.format("memory").queryName("remembered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(tuple(r)[1:] for r in spark.table("remembered").collect()) == [(0, "a", "CHANGE", None, None), (1, "a", "NONE", 0, "CHANGE"), (2, "a", "CONFIRM", 0, "CHANGE"), (2, "b", "SWITCH", None, None)]


def test_batched_predictor(spark):
    seen = []

    def model(prompts):
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), (None,), ("b",)], "p string").coalesce(1)
    assert [r[0] for r in df.select(rolling.batched_predictor(model, 1)(F.col("p"))).collect()] == ["A", None, "B"] and seen == []


def test_dialogues_advance_together(spark, tmp_path):
    rows = [(f"d{i}", t, f"v{i}{t},x", ["hotel-area"] if (i + t) % 3 else []) for i in range(9) for t in range(1 + i % 4)]
    df = spark.createDataFrame(rows, "rec_id string, turn_no int, user string, candidates array<string>")
    log = str(tmp_path / "calls")

    def model(pending):
        with open(log, "a") as f:
            f.write(f"{len(pending)}\n")
        return [rolling.carry_predictor(state, row) for state, row in pending]

    want = {(r["key"], r["turn_no"]): (r["predicted"], r["state"]) for r in rolling.rolling_batch(df).collect()}
    for width in (64, 1):
        open(log, "w").close()
        got = {(r["key"], r["turn_no"]): (r["predicted"], r["state"]) for r in rolling.rolling_together(df, model, width=width).collect()}
        sizes = [int(x) for x in open(log).read().split()]
        assert got == want and sum(sizes) == len(rows) and max(sizes) <= width
        tasks = 4  # the session's shuffle partitions; the longest dialogue has four steps
        assert len(sizes) == len(rows) if width == 1 else len(sizes) <= 4 * tasks
