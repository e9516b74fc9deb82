"""Text rules of the dialogue pipeline as Column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as "no value", number words, reply words and phrases the rules look for.
NONE_TOKENS = ("", "none", "notmentioned", "not mentioned", "unknown", "n/a", "na", "null", "nil")
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
DOMAINS = ("hotel", "restaurant", "attraction", "train", "taxi")
CONFIRM_REPLIES = ("yes", "yeah", "yep", "no", "nope", "ok", "okay", "correct", "right", "sure", "fine")
DEIXIS_PHRASES = ("that one", "this one", "the first", "the second", "the other", "it", "there")
OFFER_PHRASES = ("i found", "the closest", "the only", "available", "option", "recommend", "is that ok", "is that okay", "would you like")
QUESTION_WORDS = ("what", "which", "when", "where", "how")
QUESTION_STARTS = ("do you", "would you", "could you", "can you")
INTENT_WORDS = ("want", "need", "looking", "find", "book", "prefer", "instead", "actually", "change", "not")
DONTCARE_SPELLINGS = ("dont care", "dontcare", "don't care", "do not care")


def norm_text(c: Column) -> Column:
    """Blanks collapsed, trimmed, lower case; null gives ''."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def norm_value(c: Column) -> Column:
    """:func:`norm_text` without blanks, hyphens, underscores and colons."""
    return F.regexp_replace(norm_text(c), r"[\s\-_:]", "")


def is_none(c: Column) -> Column:
    return norm_text(c).isin(*NONE_TOKENS) | norm_value(c).isin(*NONE_TOKENS)


def is_dontcare(c: Column) -> Column:
    return norm_value(c) == "dontcare"


def or_default(c: Column, default: str = "none") -> Column:
    """Trimmed text, or the default for null and blank."""
    text = F.trim(c)
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text)


def absent(c: Column) -> Column:
    """Trimmed text, or the marker of a missing value."""
    return or_default(c, "__ABSENT__")


def none_or_empty(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "") | (F.lower(F.trim(c)) == "none")


def as_text(c: Column) -> Column:
    """The value as text; null prints as None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def valid_reference(c: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return ~text.isin("", "none", "dontcare")


def value_in_text(value: Column, text: Column) -> Column:
    """Digits need word boundaries; other values match as they are or without separators."""
    v, t = norm_text(value), norm_text(text)
    digits = F.regexp_like(t, F.concat(F.lit(r"(?<!\d)\b"), v, F.lit(r"\b(?!\d)")))
    plain = F.contains(t, v) | F.contains(norm_value(text), norm_value(value))
    return F.when((v == "") | (t == ""), F.lit(False)).when(v.rlike(r"^[0-9]+$"), digits).otherwise(plain)


def normalize_time(c: Column) -> Column:
    """Hours with optional minutes and am/pm as hh:mm; anything else trimmed in lower case."""
    s = F.lower(F.trim(c))
    shape = r"^\s*(\d{1,2})(?:[:.](\d{2}))?\s*(am|pm)?\s*$"
    hour = F.regexp_extract(s, shape, 1).try_cast("int")
    minute, half = F.regexp_extract(s, shape, 2), F.regexp_extract(s, shape, 3)
    h = F.when((half == "pm") & hour.between(1, 11), hour + 12).when((half == "am") & (hour == 12), F.lit(0)).otherwise(hour)
    clock = F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(F.when(minute == "", F.lit("00")).otherwise(minute), 2, "0"))
    return F.when(s.rlike(shape) & h.between(0, 23), clock).otherwise(s)


def _digits(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*[0-9]+\s*$"), F.regexp_replace(F.trim(c), r"^0+(?=[0-9])", "")).otherwise(c)


def normalize_value(c: Column) -> Column:
    """A value for comparison: numbers without leading zeros, number words as digits, times as hh:mm, no punctuation."""
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    y = F.replace(x, F.lit("&"), F.lit(" and "))
    numbers = F.create_map(*[F.lit(v) for i, w in enumerate(NUMBER_WORDS) for v in (w, str(i))])
    y = F.array_join(F.transform(F.split(y, r"(?U)\s+"), lambda w: F.coalesce(F.element_at(numbers, w), w)), " ")
    timed = (F.contains(y, F.lit("am")) | F.contains(y, F.lit("pm")) | F.contains(y, F.lit(":"))) & (F.length(y) <= 10)
    y = F.when(timed, normalize_time(y)).otherwise(y)
    y = F.trim(F.regexp_replace(F.regexp_replace(y, r"(?U)[^\w\s:/]+", " "), r"(?U)\s+", " "))
    return F.when(x.rlike(r"^[0-9]+$"), _digits(x)).otherwise(_digits(y))


def match_text(c: Column) -> Column:
    """Lower case, punctuation as blanks, blanks collapsed: the form texts are compared in."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(match_text(c), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def text_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0.95 if one holds the other, else the Jaccard similarity of their words."""
    x, y = match_text(a), match_text(b)
    return (
        F.when((x == "") | (y == ""), F.lit(0.0))
        .when(x == y, F.lit(1.0))
        .when(F.contains(y, x) | F.contains(x, y), F.lit(0.95))
        .otherwise(jaccard(token_set(a), token_set(b)))
    )


def word_set(c: Column) -> Column:
    """The distinct runs of a-z and 0-9, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def lexical_similarity(a: Column, b: Column) -> Column:
    """Common words over the root of the product of the set sizes; ``a`` and ``b`` are word sets."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b)))


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^\p{ASCII}*$")


def corpus_text(c: Column, replacements: dict[str, str] | None = None) -> Column:
    """Raw utterances as the corpora keep them.

    Lower case, trimmed; short forms of bed and breakfast written out; curly apostrophes
    straight; semicolons as commas, slashes as "and", hyphens as blanks; double quotes,
    angle and round brackets and at signs dropped; sentence signs set off unless digits
    stand on both sides; a genitive s set off, apostrophes next to blanks or at the ends
    dropped; words replaced by ``replacements``; numbers that follow each other joined.
    """
    steps = [("b&b", "bed and breakfast"), ("b and b", "bed and breakfast"), ("[\u2018\u2019]", "'"), (";", ","), ("/", " and "), ("-", " "), (r'["<>@()]', "")]
    steps += [(rf"(?<![0-9])[{sign}]|[{sign}](?![0-9])", f" {sign} ") for sign in "?.,!"]
    steps += [("'s(?= |$)", " 's"), ("'s(?=[^ ])", " ' s"), ("^'", ""), ("'$", ""), (r"(?U)'\s", " "), (r"(?U)\s'", " ")]
    out = F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    for word, to in (replacements or {}).items():
        out = F.replace(F.concat(F.lit(" "), out, F.lit(" ")), F.lit(f" {word} "), F.lit(f" {to} "))
        out = F.substring(out, F.lit(2), F.length(out) - 2)
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), "^ | $", "")
    return F.regexp_replace(out, r"(?<![^ ])(\d+) (?=\d+(?: |$))", "$1")


def mask_domains(c: Column) -> Column:
    """Domain names as ``[domain]``."""
    names = "|".join(DOMAINS)
    return F.regexp_replace(F.regexp_replace(c, rf"\b({names})-", "[domain]-"), rf"(?i)\b({names})\b", "[domain]")


def mask_slot_references(c: Column) -> Column:
    """References to domain-slot pairs without their domain; null and empty give None."""
    names = "|".join(DOMAINS)
    return F.when(c.isNull() | (c == ""), F.lit("None")).otherwise(F.regexp_replace(c, rf"\b(?:{names})-([a-zA-Z][a-zA-Z ]*[a-zA-Z])\b", "$1"))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1] fixed by the parts: the first eight hexadecimal digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def hash_bucket(*parts: Column) -> Column:
    """The MD5 of the parts as a number, modulo 1000 (2**64 leaves 616)."""
    digest = F.md5(F.concat_ws("|", *parts))
    high, low = (F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))
    return (((high % 1000) * 616 + low % 1000) % 1000).cast("int")


def _phrases(words: tuple[str, ...]) -> str:
    return rf"\b({'|'.join(words)})\b"


def gate_type(system: Column, user: Column) -> Column:
    """How the user's reply leans on the system's turn: CONFIRM, DEIXIS, SHORT_VALUE or OFF."""
    s, u = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (system, user))
    words = F.filter(F.split(u, r"\s+"), lambda w: w != "")
    question = F.contains(s, F.lit("?")) | s.rlike(rf"^\s*({'|'.join(QUESTION_WORDS)})\b") | s.rlike(rf"^\s*({'|'.join(QUESTION_STARTS)})\b")
    offer, deixis, confirm = s.rlike(_phrases(OFFER_PHRASES)), u.rlike(_phrases(DEIXIS_PHRASES)), u.isin(*CONFIRM_REPLIES)
    intent = F.arrays_overlap(words, F.array(*[F.lit(w) for w in INTENT_WORDS]))
    short = (F.size(words) <= 3) & ~confirm & ~deixis & question & ~intent
    return F.when(confirm & (offer | question), "CONFIRM").when(deixis & offer, "DEIXIS").when(short, "SHORT_VALUE").otherwise("OFF")


def last_yes_no(c: Column) -> Column:
    """The last yes or no of a model's answer; no if there is none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b(yes|no)\b"), F.lit(1))
    return F.coalesce(F.get(found, F.size(found) - 1), F.lit("no"))


def first_action(c: Column) -> Column:
    """The first action name of a model's answer; NONE if there is none."""
    names = "CONSTRAIN|CHANGE|SWITCH|DONTCARE|CONFIRM|REF-EXPLICIT|REF-IMPLICIT|NONE"
    found = F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), rf"\b({names})\b", 1)
    return F.when(found == "", F.lit("NONE")).otherwise(found)


def result_line(c: Column) -> Column:
    """What follows ``Result:`` on its line in a model's answer; none if there is no such line."""
    found = F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)result\s*:[ \t]*([^\r\n]*)", 1))
    return F.when(found == "", F.lit("none")).otherwise(found)


def json_list(c: Column) -> Column:
    """An array of texts as JSON with a blank after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ", "), F.lit("]"))


def service_domain(c: Column) -> Column:
    """``Hotels_1`` as ``hotels``."""
    return F.substring_index(F.lower(c), "_", 1)
