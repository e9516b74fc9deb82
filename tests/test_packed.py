import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.operators.packed import label_values, tokenize, unpack_values

NAMES = frozenset({("hotel-book", "day"), ("train-book", "people")})


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (None, []),
        ("", []),
        ("   ", []),
        ("[]", []),
        ("( )", []),
        ("a", ["a"]),
        ("a b  c", ["a", "b", "c"]),
        ("a,b, c", ["a", "b", "c"]),
        (" a | b ;c/d + e&f", ["a", "b", "c", "d", "e", "f"]),
        ("a, ,b,,", ["a", "b"]),
        ("x,x", ["x", "x"]),
        ("two words, one", ["two words", "one"]),
        ("two words\t", ["two words"]),
        ("a\nb c\n\nd", ["a", "b c", "d"]),
        ("a，b", ["a", "b"]),
        ('"a, b"', ["a, b"]),
        ('"a, b" c', ["a, b", "c"]),
        ("x 'p; q'  y", ["x", "p; q", "y"]),
        ('["a, b","c"]', ["a, b", "c"]),
        ('["the \\"x\\" y", \'z\']', ['the "x" y', "z"]),
        ('"the ""x"" y"', ['the "x" y']),
        ('["\\u00e9\\n"]', ["é\n"]),
        ("rook's yard, b", ["rook's yard", "b"]),
        ("'rook's yard' | b", ["rook's yard", "b"]),
        ('["it\'s", \'b\']', ["it's", "b"]),
        ("{a / b}", ["a", "b"]),
        ("(a\tb)", ["a", "b"]),
        ("{a}, {b}", ["{a}", "{b}"]),
        ("a, (b, c), d", ["a", "(b, c)", "d"]),
        ('"open, b', ['"open', "b"]),
        ('""', []),
        ("slot:hotel-book day", ["slot:hotel-book day"]),
        ("x slot:hotel-book day y", ["x", "slot:hotel-book day", "y"]),
        ("hotel-book day train-book people", ["hotel-book day", "train-book people"]),
        ("a\\,b, c", ["a,b", "c"]),
    ],
)
def test_tokenize(text, values):
    assert tokenize(text, NAMES) == values


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ,;|'\"\\/+é"), min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=5))
def test_quoted_values_come_back(values):
    packed = ", ".join('"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' for v in values)
    assert tokenize(packed) == values
    assert tokenize(f"[{packed}]") == values


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab ,;|'\"\\/+[](){}\t\n"), max_size=30))
def test_any_text_is_read(text):
    assert all(v and v == v.strip(" ") for v in tokenize(text, NAMES))


def test_rows(spark, dialogues):
    events = [{"slot": "s", "label2": x} for x in (None, "", "a", "a, b", "a|a", "  ")]
    df = dialogues([(1, {"turns": [{"events": None}, {"events": events}, None]}), (2, {"turns": None}), (3, {"turns": []})], ("label_value", "value_no", "_packed", "_place"))
    got = sorted(map(tuple, label_values(df).collect()))
    assert got == [(1, 1, 2, 0, "a"), (1, 1, 3, 0, "a"), (1, 1, 3, 1, "b"), (1, 1, 4, 0, "a"), (1, 1, 4, 1, "a")]
    assert label_values(df.limit(0)).collect() == []


def test_long_fields(spark):
    text = ", ".join(f"value {i}" for i in range(20000))
    df = spark.createDataFrame([(1, text), (2, "x" * 100000)], "id int, t string").withColumn("value", F.lit(0))
    got = unpack_values(df, "t", ["id"]).groupBy("id").agg(F.count("*").alias("n"), F.max("value_no").alias("m")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 20000, 19999), (2, 1, 0)]


def test_hostile_fields_take_linear_time():
    import time

    for text in ("'a" * 200_000, "[" * 200_000 + "]", 'x"' * 200_000, "a'" * 200_000 + " ,b", " '" * 200_000):
        began = time.perf_counter()
        tokenize(text)
        assert time.perf_counter() - began < 8
