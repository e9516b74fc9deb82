"""Mapping of freely typed values to the entries of reference lists.

The distinct values of each list's rows and the list's entries become sets of
letters and letter pairs, and a prefix-filter set-similarity join brings each
value to its similar entries: tokens are ordered by global rarity, only the
rare prefixes are joined, length and positional filters go before the exact
Jaccard similarity. Short forms and dropped words can be less similar than the
join asks for, so the entries with a word that could be one of the value's are
looked up beside it. An exact check decides whether a similar entry is meant:
word by word, misspellings of an edit or two, words in another order, run
together, cut or abbreviated, but never another word. The best entry is kept,
the rest is reported as ``unmatched``.

Defined results: null values and the ``absent`` markers are no cases; a value
that equals an entry to the letter is no case; slots without a list are left
out; on ties the more similar, then the first entry by code point is kept.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.operators.skew import attach
from turnloom.runtime import small, stored

THRESHOLD = 0.4
ABSENT = ("", "none", "not mentioned", "dontcare")
UNMATCHED = "unmatched"
#: Entries of all lists; the forms and word keys made of them go to every worker. More are refused, not cut.
MOST_ENTRIES = 100_000

#: Words around a value that don't change what it stands for.
CARRIERS = frozenset(
    "a an the any some to from for on in at of us out up down next this please side part range priced type station railway stn town food cuisine style people persons person guests"
    " nights night days day stay star stars morning evening afternoon whole thanks".split()
)
#: What else an entry is called, by the part of the slot after its domain and "book".
ALIASES: dict[str, dict[str, str]] = {
    "pricerange": {"cheaply": "cheap", "budget": "cheap", "low cost": "cheap", "inexpensive": "cheap", "moderately": "moderate", "medium": "moderate", "mid range": "moderate", "upscale": "expensive", "pricey": "expensive", "high end": "expensive", "expensively": "expensive"},
    "area": {"northern": "north", "southern": "south", "eastern": "east", "western": "west", "center": "centre", "central": "centre", "city centre": "centre", "city center": "centre", "town centre": "centre", "town center": "centre", "downtown": "centre", "middle": "centre"},
    "internet": {"y": "yes", "yep": "yes", "yeah": "yes", "true": "yes", "yup": "yes", "n": "no", "nope": "no", "false": "no", "no thanks": "no", "not needed": "no", "complimentary": "free", "free of charge": "free"},
    "type": {"guest house": "guesthouse", "theater": "theatre", "movie theater": "cinema", "movie theatre": "cinema", "movies": "cinema", "pool for swimming": "swimming pool"},
    "day": {"mon": "monday", "tue": "tuesday", "tues": "tuesday", "wed": "wednesday", "weds": "wednesday", "thu": "thursday", "thur": "thursday", "thurs": "thursday", "fri": "friday", "sat": "saturday", "sun": "sunday"},
    "number": {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten".split())},
}
ALIASES["parking"] = ALIASES["internet"]
_LOOKALIKE = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"})


def fold(value: str) -> str:
    """Lower case without accents; anything but letters, digits and apostrophes in words is a blank."""
    text = "".join(c for c in unicodedata.normalize("NFKD", value).casefold() if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w@$']+|_|(?<!\w)'|'(?!\w)", " ", text.replace("’", "'")).replace("'", "").split())


def _number(text: str) -> str:
    """Without leading zeros and a fraction of zeros."""
    return re.sub(r"(?<![\w.])0*(\d+)(?:[.,]0+)?(?![\d])", r"\1", text)


def forms(value: str) -> list[str]:
    """The ways to read a value: folded, with look-alike signs as letters, with and without carrier words."""
    plain = re.sub(r"(?<=\d)(?=[a-z])", " ", fold(_number(value.strip())))
    out = [plain]
    if re.search(r"[a-z][@$\d]|[@$\d][a-z]", fold(value)) and not plain.replace(" ", "").isdigit():
        out.append(" ".join(w.translate(_LOOKALIKE) if re.search("[a-z]", w) else w for w in fold(value).split()))
    if re.search(r"\bst\b", plain):
        out.append(re.sub(r"\bst\b", "saint", plain))
    for text in list(out):
        words = text.split()
        kept = [w for w in words if w not in CARRIERS]
        if kept and len(kept) < len(words):
            out.append(" ".join(kept))
    return list(dict.fromkeys(w for w in out if w))


def tokens(form: str) -> list[str]:
    """Letters with their occurrence number and letter pairs within words, so order of words matters little."""
    seen: dict[str, int] = {}
    out = []
    for c in form.replace(" ", ""):
        seen[c] = seen.get(c, 0) + 1
        out.append(f"{c}{seen[c]}")
    for word in form.split():
        padded = f"^{word}$"
        out += [padded[i : i + 2] for i in range(len(padded) - 1)]
    return list(dict.fromkeys(out))


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return row[-1]


def _allowed(length: int) -> int:
    return 0 if length <= 2 else 1 if length <= 6 else 2


def _shortened(short: str, word: str) -> bool:
    """``short`` is the word's beginning, or the word without some inner letters, vowels for the most part."""
    if not 3 <= len(short) < len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return len(short) >= 4 or len(word) - len(short) <= 2
    if short[-1] != word[-1]:
        return False
    i, dropped = 0, []
    for c in word:
        if i < len(short) and c == short[i]:
            i += 1
        else:
            dropped.append(c)
    return i == len(short) and sum(c not in "aeiou" for c in dropped) <= 1


def stands_for(form: str, entry: str, generic: frozenset[str]) -> float | None:
    """How far the form is from the entry's form, or None if it means something else. ``generic``: words that don't tell entries apart."""
    if form == entry:
        return 0.0
    if entry.isdigit() or form.isdigit():
        return None
    a, b = form.split(), entry.split()
    ja, jb = "".join(a), "".join(b)
    if ja == jb:
        return 0.1
    if len(a) == 1 and len(b) == 1:
        length = max(len(ja), len(jb))
        most = 0 if length < 4 else 1 if length < 9 else 2
        d = edits(ja, jb, most)
        plural = ja in (jb + "s", jb + "es") or jb == ja + "s"
        return float(d) if d <= most else 0.5 if plural else 0.7 if _shortened(ja, jb) else None
    most = 0 if len(jb) < 4 else 1 if len(jb) < 9 else 2 if len(jb) < 18 else 3
    joined = edits(ja, jb, most)
    best = float(joined) + 0.2 if joined <= most else None
    free, total, dropped, matched = list(a), 0.0, 0, 0
    for word in sorted(b, key=len, reverse=True):
        options = []
        for w in free:
            limit = _allowed(max(len(w), len(word)))
            d = edits(w, word, limit)
            if d <= limit:
                options.append((float(d), w))
            elif _shortened(w, word):
                options.append((0.7, w))
        if options:
            d, w = min(options)
            free.remove(w)
            total += d
            matched += word not in generic
        elif word in generic:
            dropped += 1
        else:
            return best
    if free or dropped > 2 or not matched or (dropped and matched < min(2, sum(w not in generic for w in b))) or total > 1 + len(b):
        return best
    score = total + 0.3 * dropped
    return score if best is None else min(best, score)


_FORM = T.ArrayType(T.StructType([T.StructField("form", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))]))


@F.pandas_udf(_FORM)
def _forms(values: pd.Series) -> pd.Series:
    return pd.Series([[{"form": f, "tokens": tokens(f)} for f in forms(v)] for v in values], dtype=object)


def _aliases(slot: str, entries: list[str], synonyms: dict[str, dict[str, str]]) -> dict[str, str]:
    kind = slot.partition("-")[2].removeprefix("book ").strip()
    found = dict(synonyms.get(kind, {}))
    if all(e.isdigit() for e in entries):
        found |= synonyms.get("number", {})
    return {a: e for a, e in found.items() if e in entries}


def reference_forms(lists: dict[str, list[str]], synonyms: dict[str, dict[str, str]] = ALIASES) -> list[tuple[str, str, str, list[str], list[str]]]:
    """(slot, entry, form, tokens, generic words) of every entry and alias; the lists are a fixed small table.

    Generic are the last words several entries share (court, inn) and words met only before one of them (guest house).
    """
    rows = []
    for slot, entries in lists.items():
        split = [fold(e).split() for e in entries]
        last = {w for w, n in Counter(e[-1] for e in split if len(e) > 1).items() if n >= 2}
        before_last = {}
        for e in split:
            if len(e) > 2:
                before_last.setdefault(e[-2], []).append((e[-1], e[-3]))
        compound = {w for w, at in before_last.items() if len({x for x, _ in at}) == 1 and at[0][0] in last and len({y for _, y in at}) >= 3}
        generic = sorted(last | compound | {"the"})
        several = [e for e in entries if " " in e]
        for form, entry in [(f, e) for e in entries for f in forms(e)] + [(fold(a), e) for a, e in _aliases(slot, entries, synonyms).items()]:
            rows.append((slot, entry, form, tokens(form), generic if several else []))
    return list({(r[0], r[1], r[2]): r for r in rows}.values())


def _ordered(df: DataFrame, key: list[str], rarity: DataFrame) -> DataFrame:
    """``key``, ``sorted``: the tokens of each row, rarest first."""
    return df.select(*key, F.explode("tokens").alias("token")).join(rarity, "token").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("sorted"))


def _whole(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction of whole numbers, so that pairs exactly at it are kept."""
    exact = Fraction(str(threshold))
    return exact.numerator, exact.denominator


def _prefix(df: DataFrame, threshold: float) -> Column:
    p, q = _whole(threshold)
    size = F.size("sorted")
    return F.slice("sorted", 1, (size - F.floor((size * p + (q - 1)) / q) + 1).cast("int"))


def similar_entries(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """slot, value, form, entry, entry_form, generic, similarity of all pairs of forms in one slot at or above ``threshold``.

    ``values``: slot, value, form, tokens; ``reference``: slot, entry, entry_form, tokens, generic.
    """
    p, q = _whole(threshold)
    rarity = values.select("slot", "form", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rarity = rarity.join(reference.select(F.explode("tokens").alias("token")).distinct(), "token", "full").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    left = _ordered(values.select("slot", "form", "tokens").distinct(), ["slot", "form"], rarity)
    right = _ordered(reference, ["slot", "entry", "entry_form"], rarity).withColumnRenamed("sorted", "entry_sorted")
    l = left.select("slot", "form", F.size("sorted").alias("size"), "sorted", F.posexplode(_prefix(left, threshold)).alias("at", "token"))
    r = right.withColumnRenamed("entry_sorted", "sorted")
    r = r.select("slot", "entry", "entry_form", F.size("sorted").alias("entry_size"), F.col("sorted").alias("entry_sorted"), F.posexplode(_prefix(r, threshold)).alias("entry_at", "token"))
    both = F.col("size") + F.col("entry_size")  # c common tokens are p/q or more of the union where c (p + q) is p times both or more
    pairs = l.join(r, ["slot", "token"]).where(
        (F.col("entry_size") * q >= F.col("size") * p) & (F.col("size") * q >= F.col("entry_size") * p)
    )
    # a pair meets at each common prefix token; only its first meeting is kept, where the positional bound counts all tokens after it
    first = pairs.where(
        (F.element_at(F.array_intersect(F.slice("sorted", 1, F.col("at") + 1), F.slice("entry_sorted", 1, F.col("entry_at") + 1)), 1) == F.col("token"))
        & (F.least(F.col("size") - F.col("at"), F.col("entry_size") - F.col("entry_at")) * (p + q) >= both * p)
    )
    common = F.size(F.array_intersect("sorted", "entry_sorted"))
    checked = first.withColumn("_common", common).where(F.col("_common") * (p + q) >= both * p).withColumn("similarity", F.col("_common") / (both - F.col("_common")))
    return checked.select("slot", "form", "entry", "entry_form", "similarity").join(values.select("slot", "value", "form"), ["slot", "form"]).join(reference.select("slot", "entry", "entry_form", "generic"), ["slot", "entry", "entry_form"])


def _without(word: str, most: int) -> set[str]:
    """The word and what is left of it without up to ``most`` letters."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def _word_keys(word: str) -> set[str]:
    """Keys of a form's word: it has one in common with any entry's word that it is a misspelling or a short form of."""
    plain = "".join(c for c in word if c not in "aeiou")
    return {f"e{w}" for w in _without(word, _allowed(len(word) + 2))} | {f"b{word[:3]}", f"c{plain}"}


def _entry_keys(word: str) -> set[str]:
    """As :func:`_word_keys`; a short form lacks at most one consonant, a plural has two letters more."""
    plain = "".join(c for c in word if c not in "aeiou")
    return _word_keys(word) | {f"c{w}" for w in _without(plain, 1)} | {f"e{word}s", f"e{word}es"}


def _letters(word: str) -> np.ndarray:
    return np.bincount([ord(c) % 64 for c in word], minlength=64)


class EntryIndex:
    """The entries that :func:`stands_for` can accept for a form, by their words and by their letters."""

    def __init__(self, reference: list[tuple[str, str, str, list[str], list[str]]]):
        self.rows = [(entry, form, frozenset(t), " ".join(generic)) for _, entry, form, t, generic in reference]
        self.by_key: dict[tuple[str, str], set[int]] = {}
        slots: dict[str, list[int]] = {}
        for i, (slot, _, form, _, generic) in enumerate(reference):
            slots.setdefault(slot, []).append(i)
            words = form.split()
            for word in words if len(words) == 1 else [w for w in words if w not in generic]:
                for key in _entry_keys(word):
                    self.by_key.setdefault((slot, key), set()).add(i)
        joined = {s: [self.rows[i][1].replace(" ", "") for i in at] for s, at in slots.items()}
        self.joined = {s: (np.array(at), np.array([0 if len(w) < 4 else 1 if len(w) < 9 else 2 if len(w) < 18 else 3 for w in joined[s]]), np.stack([_letters(w) for w in joined[s]])) for s, at in slots.items()}

    def below(self, slot: str, form: str, threshold: float) -> list[tuple[str, str, str, float]]:
        """entry, entry form, generic, similarity of those less similar than ``threshold``."""
        if slot not in self.joined:
            return []
        met: set[int] = set()
        for word in form.split():
            if len(word) <= self.longest:
                for key in _word_keys(word):
                    met |= self.by_key.get((slot, key), set())
        at, most, letters = self.joined[slot]
        met.update(at[np.abs(letters - _letters(form.replace(" ", ""))).sum(axis=1) <= 2 * most].tolist())
        (p, q), own, out = _whole(threshold), set(tokens(form)) if met else set(), []
        for i in sorted(met):
            entry, entry_form, theirs, generic = self.rows[i]
            if len(own & theirs) * q < len(own | theirs) * p:
                out.append((entry, entry_form, generic, len(own & theirs) / len(own | theirs)))
        return out

    @functools.cached_property
    def longest(self) -> int:
        """A word longer than all entries' words by over two letters is none of them."""
        return max((len(w) for _, form, _, _ in self.rows for w in form.split()), default=0) + 2


def dissimilar_entries(values: DataFrame, reference: list[tuple[str, str, str, list[str], list[str]]], threshold: float = THRESHOLD) -> DataFrame:
    """As :func:`similar_entries` the pairs below ``threshold`` that the check could accept; ``reference`` is a fixed small table."""

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = EntryIndex(reference)
        for pdf in batches:
            rows = [(slot, form, *found) for slot, form in zip(pdf["slot"], pdf["form"]) for found in index.below(slot, form, threshold)]
            if rows:
                yield pd.DataFrame(rows, columns=["slot", "form", "entry", "entry_form", "generic", "similarity"])

    tasks = values.sparkSession.sparkContext.defaultParallelism  # small rows, much work: not to be put into one task
    found = values.select("slot", "form").distinct().repartition(tasks).mapInPandas(look_up, "slot string, form string, entry string, entry_form string, generic string, similarity double")
    return found.join(values.select("slot", "value", "form"), ["slot", "form"])


@F.pandas_udf(T.DoubleType())
def _distance(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, g in batches:
        yield pd.Series([stands_for(form, entry, frozenset(generic.split())) for form, entry, generic in zip(a, b, g)], dtype="float64")


def canonical_values(values: DataFrame, lists: dict[str, list[str]], threshold: float = THRESHOLD, synonyms: dict[str, dict[str, str]] = ALIASES) -> DataFrame:
    """slot, value, canonical of distinct ``values`` (slot, value), ``UNMATCHED`` where no entry is meant; ``synonyms`` may be empty."""
    spark = values.sparkSession
    rows = reference_forms(lists, synonyms)
    reference = spark.createDataFrame([(s, e, f, t, " ".join(g)) for s, e, f, t, g in rows], "slot string, entry string, entry_form string, tokens array<string>, generic string")
    read = values.select("slot", "value", F.explode(_forms("value")).alias("f")).select("slot", "value", "f.form", "f.tokens")
    read = stored(read, "value-forms")
    near = similar_entries(read, reference, threshold).unionByName(dissimilar_entries(read, rows, threshold))
    meant = near.repartition(spark.sparkContext.defaultParallelism).withColumn("distance", _distance("form", "entry_form", "generic")).where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    best = meant.groupBy("slot", "value").agg(F.min_by("entry", F.struct("distance", -F.col("similarity"), "entry")).alias("canonical"))
    return values.join(best, ["slot", "value"], "left").withColumn("canonical", F.coalesce("canonical", F.lit(UNMATCHED)))


def canonical_slots(dialogues: DataFrame, slot_descriptions: DataFrame, threshold: float = THRESHOLD, synonyms: dict[str, dict[str, str]] = ALIASES) -> DataFrame:
    """rec_id, turn_no, slot, value, canonical of every freely typed value in the turns' ``slot_values``."""
    lists: dict[str, list[str]] = {}
    for r in small(slot_descriptions.where("slot is not null").select("slot", F.explode("value").alias("entry")).where("entry is not null"), MOST_ENTRIES):
        lists.setdefault(r["slot"], []).append(r["entry"])
    spark = dialogues.sparkSession
    entries = F.broadcast(spark.createDataFrame([(s, e) for s, l in lists.items() for e in l], "slot string, value string"))
    cells = dialogues.select("rec_id", F.posexplode("turns").alias("turn_no", "_t")).select("rec_id", "turn_no", F.explode("_t.state.slot_values").alias("slot", "value"))
    cells = cells.where(F.col("slot").isin(*lists) & F.col("value").isNotNull() & ~F.col("value").isin(*ABSENT)).join(entries, ["slot", "value"], "left_anti")
    distinct = stored(cells.groupBy("slot", "value").agg(F.count("*").alias("_n")), "distinct-values")
    found = canonical_values(distinct.select("slot", "value"), lists, threshold, synonyms)
    return attach(cells, stored(found.join(distinct, ["slot", "value"]), "canonical-values"), ["slot", "value"])
