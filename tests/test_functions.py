import hashlib

import pytest
from pyspark.sql import functions as F

from turnloom.functions import slots as S
from turnloom.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("value", "time"), [("5 pm", "17:00"), ("12 am", "00:00"), ("7:05", "07:05"), ("7.30", "07:30"), ("25:00", "25:00"), ("soon", "soon"), ("17:45", "17:45")])
def test_times(spark, value, time):
    assert one(spark, value, X.normalize_time) == time


@pytest.mark.parametrize(("value", "norm"), [(None, ""), ("007", "7"), ("Two People", "2 people"), ("a&b", "a and b"), ("5pm", "17:00"), ("Acorn-House!", "acorn house"), ("000", "0")])
def test_values(spark, value, norm):
    assert one(spark, value, X.normalize_value) == norm


@pytest.mark.parametrize(
    ("value", "text", "found"),
    [("4", "for 4 people", True), ("4", "at 14:00", False), ("cheap", "a CHEAP one", True), ("guest house", "a guesthouse", True), ("", "x", False), (None, "x", False), ("x", None, False), ("a.c", "abc", False)],
)
def test_value_in_text(spark, value, text, found):
    df = spark.createDataFrame([(value, text)], "v string, t string")
    assert df.select(X.value_in_text(F.col("v"), F.col("t"))).first()[0] is found


@pytest.mark.parametrize(("system", "user", "gate"), [("would you like that one ?", "yes", "CONFIRM"), ("i found two hotels", "the first", "DEIXIS"), ("what day ?", "friday", "SHORT_VALUE"), ("what day ?", "i need friday", "OFF"), ("hello there", "friday", "OFF"), (None, None, "OFF")])
def test_gates(spark, system, user, gate):
    df = spark.createDataFrame([(system, user)], "s string, u string")
    assert df.select(X.gate_type(F.col("s"), F.col("u"))).first()[0] == gate


@pytest.mark.parametrize(
    ("label1", "label2", "labels"),
    [
        ("change", "[]", ("change", "change", "change", "change", "CHANGE")),
        ("constrain", '["confirm"]', ("confirm", "confirm", "confirm", "confirm", "CONFIRM")),
        ("constrain", "refer-implicit", ("confirm", "refer-implicit", "refer-implicit", "refer-implicit", "REF-IMPLICIT")),
        ("constrain", "confirm,refer-implicit", ("confirm", "refer-implicit", "refer-implicit", "refer-implicit", "CONFIRM")),
        ("constrain", "['refer-clear', 'refered-slot:hotel-area']", ("refer-clear", "refer-clear", "refer-clear", "refer-clear", "REF-EXPLICIT")),
        (None, None, ("", "", "", "confirm", "NONE")),
    ],
)
def test_label_dialects(spark, label1, label2, labels):
    df = spark.createDataFrame([(label1, label2)], "a string, b string")
    got = df.select(*[S.resolve_label(F.col("a"), S.label_tokens(F.col("b")), d) for d in ("retrieval-a", "retrieval-b", "graph", "prompt", "memory")]).first()
    assert tuple(got) == labels


def test_slots(spark):
    f = lambda v, g: one(spark, v, g)
    assert f("hotel-book day", S.domain_of) == "hotel" and f("area", S.domain_of) == "" and f("area", S.domain_or_slot) == "area"
    assert f("hotel-book day", S.type_of) == "book day" and f("hotel-area", S.mask_slot) == "[domain]-area"
    assert f("Hotel-book-day", S.canonical_slot) == "hotel-book day"
    assert [f(x, S.canonical_type) for x in ("train-dest", "hotel-book people", "taxi-arrive by", "hotel-price_range")] == ["destination", "people", "arriveby", "pricerange"]
    assert f("refer-clear", S.normalize_action) == "REF-EXPLICIT" and f(None, S.normalize_action) == "NONE" and f("odd", S.normalize_action) == "ODD"


def test_hashes(spark):
    df = spark.createDataFrame([("a", 3)], "k string, n int")
    digest = hashlib.md5(b"s|a|3").hexdigest()
    bucket, unit = df.select(X.hash_bucket(F.lit("s"), F.col("k"), F.col("n").cast("string")), X.hash_unit(F.lit("s"), F.col("k"), F.col("n").cast("string"))).first()
    assert bucket == int(digest, 16) % 1000 and abs(unit - int(digest[:8], 16) / 0xFFFFFFFF) < 1e-12


def test_answers(spark):
    f = lambda v, g: one(spark, v, g)
    assert [f(v, X.last_yes_no) for v in ("no. Yes", "maybe", None)] == ["yes", "no", "no"]
    assert [f(v, X.first_action) for v in ("it is Change", "?", None)] == ["CHANGE", "NONE", "NONE"]
    assert [f(v, X.result_line) for v in ("S1\nResult: two words \nx", "none", None)] == ["two words", "none", "none"]
    assert f("Hotels_1", X.service_domain) == "hotels" and f("see hotel-name at the Hotel", X.mask_domains) == "see [domain]-name at the [domain]"


def test_similarity(spark):
    df = spark.createDataFrame([("The Acorn, house", "the acorn house."), ("acorn", "the acorn house"), ("a b", "b c"), ("", "x")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(X.text_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.95, 0.3333, 0.0]


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("  It's a B&B, call 012-345-6789 at cb2 1tt; 3 4 rooms! ", "it s a bed and breakfast , call 0123456789 at cb2 1tt , 34 rooms !"),
        ("north/south, 12.30 or 5.", "north and south , 12.30 or 5 ."),
        ('the "Old <Inn>" (by@mail)', "the old inn bymail"),
        ("guests' rooms at john's", "guests rooms at john s"),
        ("'quoted'", "quoted"),
        ("1 2 3 a4 5", "123 a4 5"),
        ("b and b, please?", "bed and breakfast , please ?"),
        ("don\u2019t", "don't"),
    ],
)
def test_corpus_text(spark, text, kept):
    assert one(spark, text, X.corpus_text) == kept


def test_corpus_text_replacements(spark):
    assert one(spark, "The centre, the CENTRE.", lambda c: X.corpus_text(c, {"centre": "center"})) == "the center , the center ."
