"""Slot names, action labels and slot descriptions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other spellings of the actions, and of the slot types.
ACTION_ALIASES = {
    "none": "NONE",
    "constrain": "CONSTRAIN",
    "constraint": "CONSTRAIN",
    "change": "CHANGE",
    "switch": "SWITCH",
    "dontcare": "DONTCARE",
    "don't care": "DONTCARE",
    "do not care": "DONTCARE",
    "confirm": "CONFIRM",
    "ref-explicit": "REF-EXPLICIT",
    "refer-explicit": "REF-EXPLICIT",
    "refer-clear": "REF-EXPLICIT",
    "ref-clear": "REF-EXPLICIT",
    "ref-implicit": "REF-IMPLICIT",
    "refer-implicit": "REF-IMPLICIT",
}
TYPE_SYNONYMS = {
    "dest": "destination",
    "depart": "departure",
    "arrive": "arriveby",
    "arrive by": "arriveby",
    "price": "pricerange",
    "price range": "pricerange",
    "persons": "people",
    "party": "people",
    "group": "people",
}
ACTIVE_ACTIONS = ("CONSTRAIN", "CHANGE", "SWITCH", "DONTCARE", "CONFIRM", "REF-EXPLICIT", "REF-IMPLICIT")
LABEL_TEXTS = {
    "constrain": "the user gives a value for the slot",
    "change": "the user replaces the slot's value",
    "switch": "the user opens a new domain with the slot",
    "dontcare": "the user has no preference for the slot",
    "confirm": "the user accepts a value the system named",
    "refer-clear": "the user refers to the value of a named slot",
    "refer-implicit": "the user refers to a value without naming its slot",
}


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def domain_of(slot: Column) -> Column:
    """The text before the first hyphen; '' without one."""
    return F.when(F.contains(slot, F.lit("-")), F.substring_index(slot, "-", 1)).otherwise(F.lit(""))


def domain_or_slot(slot: Column) -> Column:
    """The text before the first hyphen; the whole name without one."""
    return F.substring_index(F.coalesce(slot, F.lit("")), "-", 1)


def type_of(slot: Column) -> Column:
    """The trimmed text after the first hyphen; the whole name without one."""
    return F.trim(F.regexp_replace(slot, "^[^-]*-", ""))


def mask_slot(slot: Column) -> Column:
    """The slot with its domain hidden."""
    kind = type_of(slot)
    return F.when(kind == "", F.lit("[domain]")).otherwise(F.concat(F.lit("[domain]-"), kind))


def canonical_slot(slot: Column) -> Column:
    """Blanks collapsed, in lower case, hyphens after the first one as blanks."""
    s = F.trim(F.regexp_replace(F.lower(slot), r"\s+", " "))
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^[^-]*-", ""), "-", " "), r"\s+", " "))
    return F.when(F.contains(s, F.lit("-")), F.concat(F.trim(F.substring_index(s, "-", 1)), F.lit("-"), rest)).otherwise(s)


def canonical_type(slot: Column) -> Column:
    """The type without ``book`` and with one spelling for synonyms."""
    tail = F.trim(F.translate(F.regexp_replace(type_of(F.lower(F.trim(slot))), r"^book\s+", ""), "_-", "  "))
    return F.coalesce(_lookup(TYPE_SYNONYMS, tail), F.replace(tail, F.lit(" "), F.lit("")))


def normalize_action(label: Column) -> Column:
    text = F.trim(F.coalesce(label, F.lit("")))
    return F.when(text == "", F.lit("NONE")).otherwise(F.coalesce(_lookup(ACTION_ALIASES, F.lower(text)), F.upper(text)))


def label_tokens(label2: Column, dialect: str = "comma") -> Column:
    """The tokens of a label field by dialect: comma, pipe, or any (comma, semicolon, bar, plus, blank); null gives the empty list.

    A field written as a JSON or bracketed list is taken apart at its commas first.
    """
    text = F.trim(F.coalesce(label2, F.lit("")))
    inner = F.when(text.rlike(r"(?s)^\[.*\]$"), F.regexp_replace(F.regexp_replace(text, r"^\[|\]$", ""), "[\"']", "")).otherwise(text)
    separators = {"comma": ",", "pipe": r"\|", "any": r"[,;|+\s]+"}[dialect]
    parts = F.when(text.rlike(r"(?s)^\[.*\]$") & F.lit(dialect == "pipe"), F.split(inner, ",")).otherwise(F.split(inner, separators))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def resolve_label(label1: Column, tokens: Column, dialect: str) -> Column:
    """The label of an event from its two label fields.

    retrieval-a: clear before confirm; retrieval-b and graph: clear, implicit, confirm;
    prompt: the first token that names a reference, else confirm; memory: explicit
    reference, confirm, implicit reference, else confirm, as actions. Without tokens
    the first label counts.
    """
    some = F.size(tokens) > 0
    clear, implicit = F.array_contains(tokens, "refer-clear"), F.array_contains(tokens, "refer-implicit")
    first = F.trim(F.coalesce(label1, F.lit("")))
    if dialect == "retrieval-a":
        return F.when(some & clear, "refer-clear").when(some, "confirm").otherwise(first)
    if dialect in ("retrieval-b", "graph"):
        return F.when(some & clear, "refer-clear").when(some & implicit, "refer-implicit").when(some, "confirm").otherwise(first)
    if dialect == "prompt":
        named = F.get(F.filter(F.transform(tokens, lambda x: F.when(F.contains(F.lower(x), F.lit("clear")), "refer-clear").when(F.contains(F.lower(x), F.lit("implicit")), "refer-implicit")), lambda x: x.isNotNull()), F.lit(0))
        return F.when(named.isNotNull(), named).when(some, "confirm").otherwise(F.when(first == "", F.lit("confirm")).otherwise(F.lower(first)))
    if dialect == "memory":
        actions = F.transform(tokens, normalize_action)
        has = lambda a: F.array_contains(actions, a)
        return F.when(some & has("REF-EXPLICIT"), "REF-EXPLICIT").when(some & has("CONFIRM"), "CONFIRM").when(some & has("REF-IMPLICIT"), "REF-IMPLICIT").when(some, "CONFIRM").otherwise(normalize_action(label1))
    raise ValueError(dialect)


def tagged_value(tokens: Column, tag: str) -> Column:
    """The rest of the first token that begins with ``tag:``; '' without one."""
    found = F.get(F.filter(tokens, lambda x: F.startswith(x, F.lit(f"{tag}:"))), F.lit(0))
    return F.coalesce(F.trim(F.substring(found, len(tag) + 2, 2**31 - 2)), F.lit(""))


def label_text(label: Column) -> Column:
    return F.coalesce(_lookup(LABEL_TEXTS, F.lower(label)), F.concat(F.lit("the user updates the slot: "), F.coalesce(label, F.lit(""))))


def listed(values: Column, most: int, rest: str | None = None, empty: str = "None") -> Column:
    """Up to ``most`` values joined by commas, ``rest`` after them if there are more; ``empty`` for none."""
    cut = F.slice(values, 1, most)
    shown = cut if rest is None else F.when(F.size(values) > most, F.concat(cut, F.array(F.lit(rest)))).otherwise(cut)
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.lit(empty)).otherwise(F.array_join(shown, ", "))


def value_examples(values: Column, most: int = 10, *, drop_none: bool = False) -> Column:
    kept = F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    if drop_none:
        kept = F.filter(kept, lambda x: ~F.lower(x).isin("none", "dontcare"))
    return listed(kept, most)


def value_candidates(values: Column, kind: Column, most: int = 20) -> Column:
    """The values to choose from, with none last; times get a template, open slots a request for the words used."""
    fixed = F.concat(F.slice(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "none"))), 1, most), F.array(F.lit("none")))
    open_ = F.when(kind.isin("arriveby", "leaveat", "book time"), F.array(F.lit("hh:mm"), F.lit("none"))).otherwise(F.array(F.lit("<as spoken>"), F.lit("none")))
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, fixed).otherwise(open_)


def describe_slots(slot_descriptions: DataFrame) -> DataFrame:
    """The slot table with its domain, type and the texts that prompts, similarity and encoders use."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    values = F.coalesce(F.slice(F.col("value"), 1, 20), F.array().cast("array<string>"))
    fields = [("concise_desc", text("concise_desc")), ("contras_desc", text("contras_desc")), ("nli_desc", text("nli_desc")), ("question_desc", text("question_desc")), ("type_desc", text("type_desc")), ("value", F.array_join(values, " | "))]
    serialized = F.concat_ws("; ", *[F.when(v != "", F.concat(F.lit(f"{name}: "), v)) for name, v in fields])
    return slot_descriptions.select(
        "*",
        domain_of(F.col("slot")).alias("domain"),
        type_of(F.col("slot")).alias("slot_type"),
        serialized.alias("serialized"),
        F.concat_ws(" | ", *[F.when(text(c) != "", text(c)) for c in ("type_desc", "question_desc", "contras_desc")]).alias("pipe_text"),
        F.concat_ws(" ", F.concat(F.lit("TYPE: "), text("type_desc")), F.concat(F.lit("DESC: "), text("concise_desc")), F.concat(F.lit("Q: "), text("question_desc")), F.concat(F.lit("NOT: "), text("contras_desc"))).alias("model_text"),
        F.concat_ws(" ", F.translate("slot", "-", " "), *[F.when(text(c) != "", text(c)) for c in ("concise_desc", "contras_desc", "type_desc")], F.array_join(values, " ")).alias("lexical_text"),
    )
