import base64
import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING
from turnloom.llm.tokens import DEFAULT_RANKS, PATTERN, BytePairEncoder, decode_corpus, encode_corpus, encoder

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    with open(DEFAULT_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_and_round_trip(text):
    with open(DEFAULT_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)} if not hasattr(test_same_ids_and_round_trip, "e") else None
    if ranks:
        test_same_ids_and_round_trip.e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = encoder().encode(text)
    assert ids == test_same_ids_and_round_trip.e.encode_ordinary(text) and encoder().decode(ids) == text


def test_long_pieces(reference):
    text = "a" * 30000 + "é\U0001f600" * 500 + " " * 5000 + "abcabc" * 3000 + "<|endoftext|> I'm don't I'LL"
    assert encoder().encode(text) == reference.encode_ordinary(text)


def test_corpus(spark, reference):
    texts = [None, "", " ", "Hello, world!\r\n", "x" * 20000, "naïve 你好"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in decode_corpus(encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode_corpus(df.limit(0)).collect() == []


def test_cache_changes_nothing(monkeypatch):
    from turnloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 2)
    small = BytePairEncoder(encoder().ranks)
    text = "one two three one two three four"
    assert small.encode(text) == encoder().encode(text)
