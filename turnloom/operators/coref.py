"""References to values said elsewhere: which turn an annotation means, and what it refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import slots as S
from turnloom.functions import text as X
from turnloom.operators.turns import turn_table

#: Slot types that may refer to another slot's value.
TARGET_TYPES = ("departure", "area", "destination", "day", "pricerange", "people", "arriveby")


def best_turns(texts: DataFrame, dialogues: DataFrame, *, text: str = "text", text_key: str = "text_no", keys: tuple[str, ...] = ("rec_id",), least: float = 0.5) -> DataFrame:
    """For each text of a dialogue the turn it is: the first whose system or user text equals, holds or is held by it, else the most similar at ``least`` or above.

    keys, text_key, turn_no. Texts meet only the turns of their own dialogue, inside one row of it.
    """
    packed = dialogues.select(*keys, F.arrays_zip(F.col("turns.system").alias("s"), F.col("turns.user").alias("u")).alias("_turns"))
    met = texts.select(*keys, text_key, F.col(text).alias("_text")).join(packed, list(keys))
    wanted = X.match_text(F.col("_text"))

    def side(c: Column) -> Column:
        other = X.match_text(c)
        return (other != "") & ((wanted == other) | F.contains(other, wanted) | F.contains(wanted, other))

    exact = F.transform("_turns", lambda t, i: F.when(side(t["s"]) | side(t["u"]), i))
    first = F.array_min(F.filter(exact, lambda i: i.isNotNull()))
    scored = F.transform("_turns", lambda t, i: F.struct(F.greatest(X.text_similarity(F.col("_text"), t["s"]), X.text_similarity(F.col("_text"), t["u"])).alias("sim"), (-i).alias("back")))
    best = F.array_max(scored)
    return met.select(*keys, text_key, F.coalesce(first, F.when(best["sim"] >= least, -best["back"])).alias("turn_no"))


def turn_values(dialogues: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """keys, turn_no, items: the state's slots with domain, canonical type, value and normalized value, ``book`` slots first, then by name."""
    turns = turn_table(dialogues, "slot_values", keys=keys)
    return turns.select(*keys, "turn_no", value_items(F.col("slot_values")).alias("items"))


def value_items(state: Column) -> Column:
    entry = lambda e: F.struct(
        F.when(F.startswith(S.type_of(e["key"]), F.lit("book")), 0).otherwise(1).alias("rank"),
        e["key"].alias("slot"),
        S.domain_of(F.lower(e["key"])).alias("domain"),
        S.canonical_type(e["key"]).alias("kind"),
        F.coalesce(e["value"], F.lit("")).alias("value"),
        X.normalize_value(e["value"]).alias("norm"),
    )
    return F.array_sort(F.transform(F.map_entries(F.coalesce(state, F.create_map().cast("map<string,string>"))), entry))


def same_value(items: Column, slot: Column, norm: Column, other: Column) -> Column:
    """Another slot with the same value: equal, then containing or contained, then the same with ``other``; null if none."""

    def search(v: Column) -> list[Column]:
        rest = F.filter(items, lambda x: x["slot"] != slot)
        usable = F.coalesce(v, F.lit("")) != ""
        equal = F.get(F.filter(rest, lambda x: usable & (x["norm"] == v)), F.lit(0))
        near = F.get(F.filter(rest, lambda x: usable & (x["norm"] != "") & (F.contains(x["norm"], v) | F.contains(v, x["norm"]))), F.lit(0))
        return [equal, near]

    return F.coalesce(*search(norm), *search(other))


def reference_labels(annotations: DataFrame, dialogues: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Annotations as reference tags on turns: keys, turn_no, slot, tags, curr_val, prev_val.

    ``annotations``: keys, turn_no (the aligned turn), domain, slot_type, true_value,
    source_turn. With a source turn from 0 the aligned turn decides: refer-clear with
    the slot of the same value, refer-implicit without one or without the target slot.
    With -1 the turns from the aligned one on are searched for the first with both;
    else refer-implicit where the slot first occurs, else at the aligned turn.
    Annotations of other types, unaligned ones and other source turns are left out
    (:func:`missed_annotations`). Tags of one slot are merged, sorted.
    """
    kind = F.coalesce(S.canonical_type(F.col("slot_type")), F.lit(""))
    asked = annotations.where(F.col("turn_no").isNotNull() & kind.isin(*TARGET_TYPES) & (F.col("source_turn") >= -1)).select(*keys, F.col("turn_no").alias("_at"), F.lower(F.trim("domain")).alias("_domain"), kind.alias("_kind"), X.normalize_value(F.col("true_value")).alias("_true"), F.col("source_turn").alias("_source"))
    states = dialogues.select(*keys, F.transform("turns.state.slot_values", value_items).alias("_items"))
    met = asked.join(states, list(keys))
    target = lambda items: F.get(F.filter(items, lambda x: (x["domain"] == F.col("_domain")) & (x["kind"] == F.col("_kind"))), F.lit(0))

    def seen(items: Column, i: Column) -> Column:
        t = target(items)
        return F.struct(i.alias("turn_no"), t.alias("target"), F.when(t.isNotNull(), same_value(items, t["slot"], t["norm"], F.col("_true"))).alias("source"))

    looked = met.withColumn("_seen", F.transform("_items", seen))
    here = F.get("_seen", F.col("_at"))
    later = F.filter("_seen", lambda x: x["turn_no"] >= F.col("_at"))
    clear = F.get(F.filter(later, lambda x: x["source"].isNotNull()), F.lit(0))
    occurs = F.get(F.filter(later, lambda x: x["target"].isNotNull()), F.lit(0))
    chosen = F.when(F.col("_source") >= 0, here).otherwise(F.coalesce(clear, occurs, here))
    rows = looked.withColumn("_c", chosen)
    slot = F.coalesce("_c.target.slot", F.concat_ws("-", "_domain", "_kind"))
    tags = F.when(F.col("_c.source").isNotNull(), F.array(F.lit("refer-clear"), F.concat(F.lit("refered-slot:"), "_c.source.slot"), F.concat(F.lit("refered-value:"), "_c.source.value"))).otherwise(F.array(F.lit("refer-implicit")))
    before = F.coalesce(target(F.get("_items", F.col("_c.turn_no") - 1))["value"], F.lit(""))
    tagged = rows.select(*keys, F.col("_c.turn_no").alias("turn_no"), slot.alias("slot"), tags.alias("tags"), F.coalesce("_c.target.value", F.lit("")).alias("curr_val"), before.alias("prev_val"))
    return tagged.groupBy(*keys, "turn_no", "slot").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.max("curr_val").alias("curr_val"), F.max("prev_val").alias("prev_val"))


def missed_annotations(annotations: DataFrame) -> DataFrame:
    """The annotations that can't be placed, with the reason."""
    kind = F.coalesce(S.canonical_type(F.col("slot_type")), F.lit(""))
    reason = F.when(~kind.isin(*TARGET_TYPES), "slot type doesn't refer").when(F.col("turn_no").isNull(), "no matching turn").when(F.col("source_turn").isNull() | (F.col("source_turn") < -1), "invalid source turn")
    return annotations.withColumn("reason", reason).where(F.col("reason").isNotNull())


def merge_tags(events: DataFrame, tagged: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Labelled events (keys, turn_no, slot, label1, label2, prev_val, curr_val) with the reference tags merged in; new slots get an empty first label."""
    on = [*keys, "turn_no", "slot"]
    both = events.join(tagged.select(*on, "tags", F.col("curr_val").alias("_curr"), F.col("prev_val").alias("_prev")), on, "full")
    own = S.label_tokens(F.col("label2"), "pipe")
    return both.select(
        *on,
        F.coalesce("label1", F.lit("")).alias("label1"),
        F.array_sort(F.array_union(own, F.coalesce("tags", F.array().cast("array<string>")))).alias("label2"),
        F.coalesce("prev_val", "_prev").alias("prev_val"),
        F.coalesce("curr_val", "_curr").alias("curr_val"),
    )
