"""Several values packed into one text field, one row per value.

A quote-aware finite-state tokenizer reads each text once to learn which
separators occur outside quotes, and once more to cut it:

* separators are ``, ; | + & /`` the full-width comma and semicolon, the
  ideographic comma, tab and line ends; blanks separate only where the text has
  none of these outside quotes;
* a quote opens only where an item begins. Inside double or single quotes a
  doubled quote or a backslash escape stands for the plain character; a quote
  closes only before a separator, a blank, a closing bracket or the end, so
  apostrophes inside words are text;
* one pair of brackets around the whole text is dropped; a separator inside any
  further bracket pair belongs to the value;
* names of two words (``names``) stay one value where blanks separate.

Defined results: null, empty, blank and bracket-only texts give no rows; empty
items aren't counted; equal values are kept; a quote that never closes is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRONG = frozenset(",;|+&/\t\n\r\v\f\u2028\u2029\uff0c\uff1b\u3001")
BLANKS = frozenset(" \u00a0\u2002\u2003\u2007\u2009\u202f\u3000")
CLOSER = {"[": "]", "(": ")", "{": "}"}
CLOSERS = frozenset(CLOSER.values())
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_ENDS = STRONG | BLANKS | CLOSERS
_BLANK = "".join(BLANKS)
_PLAIN = re.compile("[^" + re.escape("".join(STRONG | BLANKS | CLOSERS | frozenset(CLOSER)) + "\"'\\") + "]+")


def _quoted(text: str, at: int, end: int) -> tuple[str, int] | None:
    """The value of the quoted run that opens at ``at`` and the place after it; None if it never closes."""
    quote, out, i = text[at], [], at + 1
    while i < end:
        c = text[i]
        if c == "\\" and i + 1 < end:
            nxt = text[i + 1]
            if nxt == "u" and re.fullmatch("[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                out.append(chr(int(text[i + 2 : i + 6], 16)))
                i += 6
                continue
            out.append(ESCAPES.get(nxt, nxt))
            i += 2
        elif c == quote:
            last = i + 1 >= end or text[i + 1] in _ENDS
            if not last and text[i + 1] == quote:
                out.append(quote)
                i += 2
            elif last:
                return "".join(out), i + 1
            else:
                out.append(c)
                i += 1
        else:
            out.append(c)
            i += 1
    return None


def _last_end(text: str, quote: str, start: int, end: int) -> int:
    """The last place where a quote could close; -1 if none."""
    at = text.rfind(quote, start, end)
    while at >= 0 and at + 1 < end and text[at + 1] not in _ENDS:
        at = text.rfind(quote, start, at)
    return at


def _walk(text: str, start: int, end: int, separators: frozenset[str]) -> Iterator[tuple[str, bool, str]]:
    """(value, was quoted, separator after it) for each item between ``separators``, empty ones too."""
    i, depth, parts, quoted, filled = start, [], [], False, False
    closes = {c: text.rfind(c, start, end) for c in CLOSERS}  # the last place of each, so that no search is repeated
    ends = {q: _last_end(text, q, start, end) for q in "\"'"}
    while i < end:
        c = text[i]
        if depth:
            if depth[-1] == c:
                depth.pop()
            elif c in CLOSER:
                depth.append(CLOSER[c])
            parts.append(c)
            i += 1
        elif c in separators:
            yield "".join(parts).strip(_BLANK), quoted, c
            parts, quoted, filled = [], False, False
            i += 1
        elif c in "\"'" and not filled and not quoted and i < ends[c] and (run := _quoted(text, i, end)):
            parts, quoted, i, filled = [run[0]], True, run[1], bool(run[0].strip(_BLANK))
        elif c in CLOSER and closes[CLOSER[c]] > i:
            depth.append(CLOSER[c])
            parts.append(c)
            filled = True
            i += 1
        elif c == "\\" and i + 1 < end and text[i + 1] in separators:
            parts.append(text[i + 1])
            filled = filled or text[i + 1] not in BLANKS
            i += 2
        else:
            parts.append(c)
            filled = filled or c not in BLANKS
            i += 1
    yield "".join(parts).strip(_BLANK), quoted, ""


def _body(text: str) -> tuple[int, int]:
    """Start and end of the text without outer blanks and without one bracket pair around all of it."""
    start, end = 0, len(text)
    while start < end and text[start] in BLANKS:
        start += 1
    while end > start and text[end - 1] in BLANKS:
        end -= 1
    if end - start >= 2 and CLOSER.get(text[start]) == text[end - 1]:
        depth, i = 0, start
        while i < end:
            c = text[i]
            if c in "\"'" and (i == start + 1 or text[i - 1] in _ENDS or text[i - 1] in CLOSER) and (run := _quoted(text, i, end)):
                i = run[1]
                continue
            depth += (c in CLOSER) - (c in CLOSERS)
            i += 1
            if not depth:
                break
        if i == end and not depth:
            return start + 1, end - 1
    return start, end


def tokenize(text: str | None, names: frozenset[tuple[str, str]] = frozenset()) -> list[str]:
    """The values in ``text``, in order. ``names``: two-word names as (first word, second word)."""
    if not text:
        return []
    if _PLAIN.fullmatch(text):
        return [text]
    start, end = _body(text)
    fine = list(_walk(text, start, end, STRONG | BLANKS))
    if any(separator in STRONG for _, _, separator in fine if separator):
        return [value for value, _, _ in _walk(text, start, end, STRONG) if value]
    out: list[str] = []
    kinds: list[bool] = []
    for value, quoted, _ in fine:
        if not value:
            continue
        if out and not quoted and not kinds[-1] and (re.split("[:=]", out[-1])[-1], value) in names:
            out[-1] += " " + value
        else:
            out.append(value)
            kinds.append(quoted)
    return out


def values_column(names: Iterable[str] = ()) -> object:
    """An Arrow UDF text -> array of values; each distinct text of a batch is tokenized once."""
    pairs = frozenset((a, b) for a, _, b in (n.partition(" ") for n in names) if b)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts)
        done = [tokenize(t, pairs) for t in distinct]
        return pd.Series([done[c] if c >= 0 else [] for c in codes], index=texts.index, dtype=object)

    return split


def unpack_values(df: DataFrame, column: Column | str, keys: list[str], *, names: Iterable[str] = (), ordinal: str = "value_no", value: str = "label_value") -> DataFrame:
    """One row per value of ``column``: ``keys``, the value's place from 0, the value.

    Only ``keys`` are carried, so other columns may have any name. No shuffle:
    scan, Arrow UDF and explode run in one stage.
    """
    packed = F.col(column) if isinstance(column, str) else column
    return (
        df.select(*keys, packed.alias("_packed"))
        .where(F.col("_packed").isNotNull() & (F.col("_packed") != ""))
        .select(*keys, F.posexplode(values_column(names)("_packed")).alias("_place", "_value"))
        .select(*keys, F.col("_place").cast("int").alias(ordinal), F.col("_value").alias(value))
    )


def label_values(dialogues: DataFrame, names: Iterable[str] = ()) -> DataFrame:
    """The values of every ``label-2`` of a dialogue table: rec_id, turn_no, event_no, value_no, label_value."""
    events = dialogues.select("rec_id", F.posexplode("turns").alias("turn_no", "_turn")).select("rec_id", "turn_no", F.posexplode("_turn.taklabels").alias("event_no", "_event"))
    return unpack_values(events.select("rec_id", "turn_no", "event_no", F.col("_event")["label-2"].alias("_label2")), "_label2", ["rec_id", "turn_no", "event_no"], names=names)
