"""What changes between a turn's state and the one before, and what holds so far.

There are four dialects of a change, kept apart on purpose:

* label: added and changed slots, values compared without case and blanks;
* activation: also removed slots, trimmed values, blank means absent;
* recheck: also removed slots, values as text, slots in canonical spelling;
* gold: changes of the cumulative state, in which none deletes a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import slots as S
from turnloom.functions import text as X
from turnloom.operators.turns import shifted, turn_table

_DELTA = "array<struct<slot:string,kind:string,prev_val:string,curr_val:string>>"


def _keys(m: Column) -> Column:
    return F.coalesce(F.map_keys(m), F.array().cast("array<string>"))


def delta(before: Column, now: Column, dialect: str = "label") -> Column:
    """The changed slots as structs of slot, kind (added, changed, removed), prev_val and curr_val, sorted by slot."""
    had = lambda k: F.array_contains(_keys(before), k)
    has = lambda k: F.array_contains(_keys(now), k)
    was = lambda k: F.element_at(before, k)
    is_ = lambda k: F.element_at(now, k)
    slots = _keys(now) if dialect == "label" else F.array_union(_keys(before), _keys(now))
    if dialect == "label":
        changed = lambda k: ~had(k) | (X.norm_text(was(k)) != X.norm_text(is_(k)))
    elif dialect == "activation":
        changed = lambda k: X.absent(was(k)) != X.absent(is_(k))
    else:
        changed = lambda k: ~(was(k).isNull() & is_(k).isNull()) & (X.as_text(was(k)) != X.as_text(is_(k)))
    kind = lambda k: F.when(~had(k), "added").when(~has(k), "removed").otherwise("changed")
    name = (lambda k: S.canonical_slot(k)) if dialect == "recheck" else (lambda k: k)
    rows = F.transform(F.filter(slots, changed), lambda k: F.struct(name(k).alias("slot"), kind(k).alias("kind"), was(k).alias("prev_val"), is_(k).alias("curr_val")))
    return F.coalesce(F.array_sort(rows), F.array().cast(_DELTA))


def state_deltas(dialogues: DataFrame, dialect: str = "label", keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """One row per changed slot: keys, turn_no, slot, kind, prev_val, curr_val."""
    if dialect == "gold":
        folded = cumulative_state_arrays()
        turns = turn_table(dialogues, keys=keys, computed={"now": folded, "was": shifted(folded)})
        rows = delta(F.col("was"), F.col("now"), "activation")
    else:
        turns = turn_table(dialogues, "slot_values", keys=keys, before=("slot_values",))
        rows = delta(F.col("before_slot_values"), F.col("slot_values"), dialect)
    return turns.select(*keys, "turn_no", F.explode(rows).alias("_d")).select(*keys, "turn_no", "_d.*")


def _applied(state: Column, changes: Column, deletes: bool) -> Column:
    """``state`` with the map ``changes`` over it; with ``deletes`` empty and none values remove their slot."""
    changes = F.coalesce(changes, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(state, lambda k, v: ~F.array_contains(F.map_keys(changes), k))
    added = F.map_filter(changes, lambda k, v: ~X.none_or_empty(v)) if deletes else changes
    return F.map_concat(kept, F.transform_values(added, lambda k, v: F.trim(v)) if deletes else added)


def cumulative_state_arrays(*, deletes: bool = True) -> Column:
    """For each turn the state folded over all turns up to it."""
    start = F.array().cast("array<map<string,string>>")
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(
        F.col("turns.state.slot_values"),
        start,
        lambda done, m: F.concat(done, F.array(_applied(F.coalesce(F.element_at(F.when(F.size(done) > 0, done), -1), empty), m, deletes))),
    )


def cumulative_state(dialogues: DataFrame, *, deletes: bool = True, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """One row per slot that holds at a turn: keys, turn_no, slot, value."""
    turns = turn_table(dialogues, keys=keys, computed={"folded": cumulative_state_arrays(deletes=deletes)})
    return turns.select(*keys, "turn_no", F.explode("folded").alias("slot", "value"))


def gold_turns(dialogues: DataFrame, domain: str, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """keys, turn_no, is_gold, snapshot: whether a slot of ``domain`` takes a new value, and the domain's part of the folded state."""
    folded = cumulative_state_arrays()
    part = lambda m: F.map_filter(m, lambda k, v: F.startswith(k, F.lit(f"{domain}-")))
    turns = turn_table(dialogues, keys=keys, computed={"now": folded, "was": shifted(folded)})
    news = F.filter(delta(part(F.col("was")), part(F.col("now")), "activation"), lambda d: ~X.none_or_empty(d["curr_val"]))
    return turns.select(*keys, "turn_no", (F.size(news) > 0).alias("is_gold"), part(F.col("now")).alias("snapshot"))


def filled_snapshots(snapshots: DataFrame, keys: tuple[str, ...] = ("rec_id",), column: str = "snapshot") -> DataFrame:
    """Null snapshots take the last one before them."""
    from pyspark.sql import Window

    return snapshots.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("turn_no")))


def label_turns(dialogues: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """The derived events: keys, turn_no, slot, label1, label2 ('confirm' or ''), prev_val, curr_val.

    switch: the slot opens a domain after others; else dontcare, constrain (added),
    change. confirm: the value is the system's, not the user's, and neither yes nor none.
    """
    turns = turn_table(dialogues, "system", "user", "slot_values", keys=keys, before=("slot_values",))
    domains = lambda m: F.transform(_keys(m), S.domain_or_slot)
    rows = turns.select(*keys, "turn_no", "system", "user", domains(F.col("before_slot_values")).alias("_had"), F.explode(delta(F.col("before_slot_values"), F.col("slot_values"), "label")).alias("_d"))
    slot, value = F.col("_d.slot"), F.coalesce("_d.curr_val", F.lit(""))
    opens = (F.col("_d.kind") == "added") & (F.size("_had") > 0) & ~F.array_contains("_had", S.domain_or_slot(slot))
    label1 = F.when(opens, "switch").when(X.is_dontcare(value), "dontcare").when(F.col("_d.kind") == "added", "constrain").otherwise("change")
    confirmed = (label1 != "dontcare") & ~X.is_none(value) & (X.norm_text(value) != "yes") & ~X.value_in_text(value, F.col("user")) & X.value_in_text(value, F.col("system"))
    return rows.select(*keys, "turn_no", slot.alias("slot"), label1.alias("label1"), F.when(confirmed, "confirm").otherwise("").alias("label2"), F.coalesce("_d.prev_val", F.lit("")).alias("prev_val"), value.alias("curr_val"))


def turn_labels(dialogues: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """keys, turn_no, n_events, tasklabel: notask for turns without derived events."""
    turns = turn_table(dialogues, "slot_values", keys=keys, before=("slot_values",))
    n = F.size(delta(F.col("before_slot_values"), F.col("slot_values"), "label"))
    return turns.select(*keys, "turn_no", n.alias("n_events"), F.when(n == 0, "notask").otherwise("task").alias("tasklabel"))


def activated_so_far(dialogues: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """keys, turn_no, activated: the distinct slots of all events before the turn, sorted."""
    named = F.transform("turns.taklabels", lambda e: F.coalesce(F.transform(e, lambda x: x["slot"]), F.array().cast("array<string>")))
    before = F.transform(named, lambda x, i: F.array_sort(F.filter(F.array_distinct(F.flatten(F.slice(named, F.lit(1), i))), lambda s: s.isNotNull())))
    return turn_table(dialogues, keys=keys, computed={"activated": before})


def run_starts(dialogues: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """For each slot of each turn the start of the latest run of turns before it with the same value; -1 if there is none.

    keys, turn_no, slot, value, from_turn.
    """
    states = F.col("turns.state.slot_values")
    turns = turn_table(dialogues, "slot_values", keys=(*keys, "_states")) if "_states" in keys else turn_table(dialogues.withColumn("_states", states), "slot_values", keys=(*keys, "_states"))
    cells = turns.select(*keys, "turn_no", "_states", F.explode("slot_values").alias("slot", "value")).where(F.col("value").isNotNull() & (F.col("value") != ""))
    return cells.select(*keys, "turn_no", "slot", "value", from_turn(F.col("_states"), F.col("turn_no"), F.col("slot"), F.col("value")).alias("from_turn"))


def from_turn(states: Column, turn_no: Column, slot: Column, value: Column) -> Column:
    """The start of the latest run before ``turn_no`` in which ``slot`` has ``value``."""
    same = F.transform(F.slice(states, F.lit(1), turn_no), lambda m: F.coalesce(F.element_at(m, slot) == value, F.lit(False)))
    starts = F.filter(F.transform(same, lambda x, i: F.when(x & ~F.coalesce(F.get(same, i - 1), F.lit(False)), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(starts), F.lit(-1))


def first_valid_turns(dialogues: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """keys, slot, ref_turn: the first turn in which the slot has a value other than none and dontcare."""
    cells = turn_table(dialogues, "slot_values", keys=keys).select(*keys, "turn_no", F.explode("slot_values").alias("slot", "value"))
    return cells.where(X.valid_reference(F.col("value"))).groupBy(*keys, "slot").agg(F.min("turn_no").alias("ref_turn"))


def observed_values(dialogues: DataFrame) -> DataFrame:
    """slot, n_values, values: the values seen for each slot, by first appearance (record, turn)."""
    cells = turn_table(dialogues, "slot_values").select("rec_id", "turn_no", F.explode("slot_values").alias("slot", "value")).where("value is not null")
    firsts = cells.groupBy("slot", "value").agg(F.min(F.struct("rec_id", "turn_no")).alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"])
    return firsts.groupBy("slot").agg(F.count("*").alias("n_values"), ordered.alias("values"))
