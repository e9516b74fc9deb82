"""Raw corpora as dialogue tables: turn logs with belief states, and schema-guided frames.

A dialogue is one row before and after, so both are expressions over its arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators.state import _applied

_STATE = "map<string,string>"
_TURN = "array<struct<system:string,user:string,state:struct<active_intent:string,slot_values:map<string,string>>>>"


def belief_values(metadata: Column, *, clean: bool = True) -> Column:
    """The slots and values of a belief state (domain -> book and semi maps), ``book`` slots first; empty and unmentioned ones left out."""
    text = (lambda c: X.corpus_text(c)) if clean else (lambda c: F.lower(F.trim(c)))

    def of_domain(d: Column) -> Column:
        name, parts = d["key"], d["value"]
        booked = F.transform(F.filter(F.map_entries(parts["book"]), lambda e: (e["key"] != "booked") & (F.coalesce(e["value"], F.lit("")) != "")), lambda e: F.struct(F.concat(name, F.lit("-book "), F.lower(F.trim(e["key"]))).alias("key"), text(e["value"]).alias("value")))
        asked = F.filter(F.map_entries(parts["semi"]), lambda e: ~F.coalesce(e["value"], F.lit("")).isin("", "not mentioned"))
        told = F.transform(asked, lambda e: F.struct(F.concat(name, F.lit("-"), F.lower(F.trim(e["key"]))).alias("key"), F.when(e["value"].isin(*X.DONTCARE_SPELLINGS), F.lit("dontcare")).otherwise(text(e["value"])).alias("value")))
        empty = F.array().cast("array<struct<key:string,value:string>>")
        return F.concat(F.coalesce(booked, empty), F.coalesce(told, empty))

    return F.flatten(F.transform(F.map_entries(metadata), of_domain))


def belief_indicators(metadata: Column, layout: list[tuple[str, list[str], list[str]]]) -> Column:
    """0/1 flags of a belief state by ``layout`` (domain, book slots, semi slots): filled book slots, then for each semi slot not mentioned, indifferent, filled, then whether the domain is active."""
    flags: list[Column] = []
    for domain, book, semi in layout:
        parts = F.element_at(metadata, domain)
        flags += [F.coalesce(F.element_at(parts["book"], s), F.lit("")).isin("", "[]") == F.lit(False) for s in book]
        seen = []
        for s in semi:
            v = F.coalesce(F.element_at(parts["semi"], s), F.lit(""))
            indifferent = v.isin(*X.DONTCARE_SPELLINGS)
            three = [v == "not mentioned", indifferent, (v != "") & (v != "not mentioned") & ~indifferent]
            flags += three
            seen += three
        active = F.lit(False)
        for f in seen:
            active = active | f
        flags.append(active)
    return F.array(*[f.cast("int") for f in flags])


def active_domains(metadata: Column) -> Column:
    """The domains with a semi value that says anything, sorted."""
    said = F.filter(F.map_entries(metadata), lambda d: F.exists(F.map_values(d["value"]["semi"]), lambda v: F.coalesce(v, F.lit("")) != ""))
    return F.array_sort(F.transform(said, lambda d: d["key"]))


def from_logs(raw: DataFrame, *, name: str = "name", log: str = "log", most_words: int = 50) -> DataFrame:
    """Turn logs (text, metadata; user and system in turn, the state with the system's) as dial_id, domains, turns.

    Logs of odd length, with texts beyond ``most_words`` words or not in ASCII are left out.
    """
    items = F.col(log)
    size = F.size(items)
    fine = (size > 0) & (size % 2 == 0) & F.forall(items, lambda t: F.coalesce(t["text"], F.lit("")).rlike(r"^\p{ASCII}*$") & (F.size(F.split(F.coalesce(t["text"], F.lit("")), " ")) <= most_words))
    said = lambda i: X.corpus_text(F.get(items, i)["text"])

    def turn(i: Column) -> Column:
        values = belief_values(F.get(items, i * 2 + 1)["metadata"])
        state = F.aggregate(values, F.create_map().cast(_STATE), lambda m, e: _applied(m, F.map_from_arrays(F.array(e["key"]), F.array(e["value"])), False))
        return F.struct(F.when(i == 0, "none").otherwise(said(i * 2 - 1)).alias("system"), said(i * 2).alias("user"), F.struct(F.lit(None).cast("string").alias("active_intent"), F.coalesce(state, F.create_map().cast(_STATE)).alias("slot_values")).alias("state"))

    turns = F.transform(F.sequence(F.lit(0), (size / 2).cast("int") - 1), turn)
    done = raw.where(fine).select(F.col(name).alias("dial_id"), turns.alias("turns"))
    names = F.flatten(F.transform("turns", lambda t: F.transform(F.map_keys(t["state"]["slot_values"]), lambda k: F.substring_index(k, "-", 1))))
    return done.select("dial_id", F.array_sort(F.array_distinct(names)).alias("domains"), "turns")


def from_frames(raw: DataFrame, *, name: str = "dialogue_id", turns: str = "turns", pick: str = "first") -> DataFrame:
    """Schema-guided turns (speaker, utterance, frames with service and state) as dial_id, domains, turns.

    A USER turn takes the SYSTEM text before it; states add up over the dialogue; of a
    slot's values the one the utterance holds counts (first or last), else the first.
    """

    def frame_state(utterance: Column, f: Column) -> Column:
        domain = X.service_domain(f["service"])

        def value(vs: Column) -> Column:
            held = F.filter(vs, lambda v: F.contains(F.lower(F.coalesce(utterance, F.lit(""))), F.lower(v)))
            return F.coalesce(F.get(held, F.lit(0)) if pick == "first" else F.get(held, F.size(held) - 1), F.get(vs, F.lit(0)))

        entries = F.transform(F.map_entries(f["state"]["slot_values"]), lambda e: F.struct(F.concat(domain, F.lit("-"), F.translate(e["key"], "_", " ")).alias("key"), value(e["value"]).alias("value")))
        return F.coalesce(F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())), F.create_map().cast(_STATE))

    def step(acc: Column, t: Column) -> Column:
        speaker = F.upper(t["speaker"])
        frames = F.coalesce(t["frames"], F.array().cast("array<struct<service:string,state:struct<active_intent:string,slot_values:map<string,array<string>>>>>"))
        state = F.aggregate(frames, acc["state"], lambda m, f: _applied(m, frame_state(t["utterance"], f), False))
        intent = F.get(F.filter(F.transform(frames, lambda f: f["state"]["active_intent"]), lambda x: x.isNotNull() & (x != "NONE")), F.lit(0))
        new = F.struct(acc["system"].alias("system"), t["utterance"].alias("user"), F.struct(intent.alias("active_intent"), state.alias("slot_values")).alias("state"))
        user = speaker == "USER"
        return F.struct(
            F.when(speaker == "SYSTEM", t["utterance"]).otherwise(acc["system"]).alias("system"),
            F.when(user, state).otherwise(acc["state"]).alias("state"),
            F.when(user, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit("none").alias("system"), F.create_map().cast(_STATE).alias("state"), F.array().cast(_TURN).alias("out"))
    done = raw.select(F.col(name).alias("dial_id"), F.aggregate(F.col(turns), start, step, lambda acc: acc["out"]).alias("turns"), F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(F.col(turns), lambda t: F.upper(t["speaker"]) == "USER"), lambda t: F.transform(t["frames"], lambda f: X.service_domain(f["service"])))))).alias("domains"))
    return done.select("dial_id", "domains", "turns")


def repair_domain_tokens(text: Column, acts: Column) -> Column:
    """Placeholders of the form ``[domain_slot]`` with the domain of the turn's only act domain (``acts``: array of domains)."""
    known = F.array_distinct(acts)
    only = F.when(F.size(known) == 1, F.get(known, F.lit(0)))
    return F.when(only.isNotNull(), F.regexp_replace(text, F.lit(r"\[[a-z]+_"), F.concat(F.lit("["), only, F.lit("_")))).otherwise(text)
