import random

import numpy as np
import pytest

from tests.llm.conftest import CLASHING
from turnloom.llm import canonical
from turnloom.llm.canonical import THRESHOLD, EntryIndex, canonical_slots, canonical_values, edits, forms, reference_forms, similar_entries, stands_for, tokens

LISTS = {
    "hotel-name": ["silver badger arms", "the woven candle guest house", "rustic hazel court", "kestrel's yard hotel", "velvet magpie court", "gilded anchor guest house", "crooked magpie arms"],
    "hotel-area": ["north", "south", "east", "west", "centre"],
    "hotel-stars": ["0", "1", "2", "3", "4", "5"],
    "hotel-book day": ["monday", "tuesday", "wednesday"],
    "hotel-parking": ["yes", "no", "free"],
    "train-departure": ["saint fenbury", "corness", "lamcombe"],
    "restaurant-food": ["austrian", "african", "american"],
}
CASES = [
    ("hotel-name", "Silver  BADGER Arms.", "silver badger arms"),
    ("hotel-name", "silver badger", "silver badger arms"),
    ("hotel-name", "hazel court, rustic", "rustic hazel court"),
    ("hotel-name", "rustichazel court", "rustic hazel court"),
    ("hotel-name", "the uoven candle gst hoouse", "the woven candle guest house"),
    ("hotel-name", "Kestrel's_yard_hötel", "kestrel's yard hotel"),
    ("hotel-name", "tangled mackerel guest house", "unmatched"),
    ("hotel-name", "gilded urchin guest house", "unmatched"),
    ("hotel-area", "the north side", "north"),
    ("hotel-area", "eats", "east"),
    ("hotel-area", "wset", "west"),
    ("hotel-area", "nth", "north"),
    ("hotel-area", "downtown", "centre"),
    ("hotel-area", "see notes", "unmatched"),
    ("hotel-stars", "04 ", "4"),
    ("hotel-stars", "three-star", "3"),
    ("hotel-stars", "0.0", "0"),
    ("hotel-stars", "11", "unmatched"),
    ("hotel-book day", "weds", "wednesday"),
    ("hotel-book day", "tue5day", "tuesday"),
    ("hotel-book day", "next mondya", "monday"),
    ("hotel-parking", "nope", "no"),
    ("hotel-parking", "fre", "free"),
    ("hotel-parking", "??", "unmatched"),
    ("train-departure", "st. fenbury", "saint fenbury"),
    ("train-departure", "from corness railway stn", "corness"),
    ("train-departure", "vropkin", "unmatched"),
    ("restaurant-food", "african-style", "african"),
    ("restaurant-food", "x" * 5000, "unmatched"),
]


def test_values_get_their_entries(spark):
    values = spark.createDataFrame([(s, v) for s, v, _ in CASES], "slot string, value string")
    got = {(r["slot"], r["value"]): r["canonical"] for r in canonical_values(values, LISTS).collect()}
    assert got == {(s, v): c for s, v, c in CASES}


SHORT_CASES = [
    ("restaurant-food", "viet", "vietnamese"),
    ("restaurant-food", "port", "portuguese"),
    ("restaurant-food", "Medi.", "mediterranean"),
    ("restaurant-food", "vgtrn", "vegetarian"),
    ("restaurant-food", "v i e t n a m e s e", "vietnamese"),
    ("restaurant-food", "vi", "unmatched"),
    ("hotel-name", "kestrel", "kestrel guest house"),
]
SHORT_LISTS = {"restaurant-food": ["vietnamese", "portuguese", "mediterranean", "vegetarian"], "hotel-name": ["kestrel guest house", "woven candle guest house", "gilded anchor guest house", "silver fox guest house"]}


def test_short_forms_get_their_entries(spark):
    values = spark.createDataFrame([(s, v) for s, v, _ in SHORT_CASES], "slot string, value string")
    got = {(r["slot"], r["value"]): r["canonical"] for r in canonical_values(values, SHORT_LISTS).collect()}
    assert got == {(s, v): c for s, v, c in SHORT_CASES}


def test_no_pair_below_the_threshold_is_lost():
    rng = random.Random(3)
    lists = LISTS | SHORT_LISTS
    reference = reference_forms(lists)
    index = EntryIndex(reference)
    n = 0
    for _ in range(1500):
        slot, _, entry_form, _, _ = rng.choice(reference)
        words = [w for w in entry_form.split() if rng.random() < 0.8]
        for k, w in enumerate(words):
            kind = rng.random()
            if kind < 0.3:
                words[k] = w[: rng.randint(3, 6)]
            elif kind < 0.6:
                words[k] = w[0] + "".join(c for c in w[1:-1] if c not in "aeiou" or rng.random() < 0.3) + w[-1]
            elif kind < 0.8:
                for _ in range(rng.randint(1, 2)):
                    i = rng.randrange(len(words[k]) + 1)
                    words[k] = words[k][:i] + rng.choice(["", "x", "e"]) + words[k][i + rng.randint(0, 1) :]
        form = rng.choice([" ", " ", ""]).join(words) if rng.random() < 0.9 else " ".join("".join(words))
        if not form.strip():
            continue
        found = {(e, f) for e, f, _, _ in index.below(slot, form, THRESHOLD)}
        for s, e, f, t, generic in reference:
            own = set(tokens(form))
            if s == slot and len(own & set(t)) / len(own | set(t)) < THRESHOLD and stands_for(form, f, frozenset(generic)) is not None:
                assert (e, f) in found, (form, f)
                n += 1
    assert n > 50


def test_cases_and_markers(spark, dialogues):
    lists = spark.createDataFrame([(s, e) for s, e in LISTS.items()] + [("taxi-leaveat", None)], "slot string, value array<string>")
    states = [{"hotel-area": v} for v in ("north", "North", "none", "", None, "not mentioned", "dontcare", "x")] + [{"taxi-leaveat": "noon"}]
    df = dialogues([(1, {"turns": [{"state": s} for s in states] + [{}]}), (2, {"turns": None}), (3, {"turns": []})] + [(i, {"turns": [{"state": {"hotel-area": "NORTH"}}]}) for i in range(10, 400)], CLASHING)
    got = sorted((r["rec_id"], r["turn_no"], r["slot"], r["canonical"]) for r in canonical_slots(df, lists).collect())
    assert got == [(1, 1, "hotel-area", "north"), (1, 7, "hotel-area", "unmatched")] + [(i, 0, "hotel-area", "north") for i in range(10, 400)]
    assert canonical_slots(df.limit(0), lists).collect() == []


def test_join_finds_all_similar_pairs(spark):
    values = ["silver badgr arms", "north", "nroth", "magpie court", "abc", "gilded anchr house"]
    left = [("s", v, f, tokens(f)) for v in values for f in forms(v)]
    right = [("s", e, f, tokens(f), "") for e in LISTS["hotel-name"] + LISTS["hotel-area"] for f in forms(e)]
    want = set()
    for _, _, f, a in left:
        for _, e, g, b, _ in right:
            if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.4:
                want.add((f, e, g))
    found = similar_entries(spark.createDataFrame(left, "slot string, value string, form string, tokens array<string>"), spark.createDataFrame(right, "slot string, entry string, entry_form string, tokens array<string>, generic string"))
    rows = [(r["form"], r["entry"], r["entry_form"]) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(set(rows))


@pytest.mark.parametrize(("a", "b", "n"), [("abc", "abc", 0), ("abc", "acb", 1), ("", "ab", 2), ("kitten", "sitting", 3), ("abcd", "wxyz", 3)])
def test_edits(a, b, n):
    assert edits(a, b, 2) == min(n, 3)


def test_numbers_are_never_close():
    assert stands_for("11", "1", frozenset()) is None and stands_for("1", "1", frozenset()) == 0.0


def test_join_keeps_pairs_at_the_threshold(spark):
    """Against brute force over random token sets, many of them exactly at a threshold."""
    rng = np.random.default_rng(21)
    sets = [sorted({f"t{int(x)}" for x in rng.integers(0, 14, rng.integers(1, 12))}) for _ in range(90)]
    sets += [[f"z{i}" for i in range(7)], [f"t{i}" for i in range(10, 14)] + [f"z{i}" for i in range(3, 7)] + ["y1", "y2"]]
    values = spark.createDataFrame([("s", f"v{i}", f"v{i}", t) for i, t in enumerate(sets)], "slot string, value string, form string, tokens array<string>")
    entries = spark.createDataFrame([("s", f"e{i}", f"e{i}", t, "") for i, t in enumerate(sets)], "slot string, entry string, entry_form string, tokens array<string>, generic string")
    for threshold, p, q in ((0.4, 2, 5), (0.5, 1, 2), (0.75, 3, 4)):
        want = {(f"v{i}", f"e{j}") for i, a in enumerate(sets) for j, b in enumerate(sets) if len(set(a) & set(b)) * q >= len(set(a) | set(b)) * p}
        got = [(r["value"], r["entry"]) for r in canonical.similar_entries(values, entries, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert any(len(set(sets[int(v[1:])]) & set(sets[int(e[1:])])) * q == len(set(sets[int(v[1:])]) | set(sets[int(e[1:])])) * p for v, e in want)


def test_without_synonyms(spark):
    values = spark.createDataFrame([("hotel-pricerange", "budget"), ("hotel-pricerange", "chaep")], "slot string, value string")
    lists = {"hotel-pricerange": ["cheap", "moderate", "expensive"]}
    got = {r["value"]: r["canonical"] for r in canonical.canonical_values(values, lists, synonyms={}).collect()}
    assert got == {"budget": "unmatched", "chaep": "cheap"}
    own = {r["value"]: r["canonical"] for r in canonical.canonical_values(values, lists, synonyms={"pricerange": {"budget": "moderate"}}).collect()}
    assert own["budget"] == "moderate"
