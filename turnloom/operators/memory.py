"""What was said about a slot before: chains, latest activations and the contexts rendered from them.

All contexts of a turn see only turns before it; with the events of a dialogue in
one array these are filters over the array's front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import slots as S
from turnloom.operators.turns import turn_table

_RECORD = "array<struct<turn_no:int,action:string,value:string,ref_slot:string,slot:string>>"


def memory_records() -> Column:
    """All active events of a dialogue, in order: turn_no, action, value, ref_slot, slot."""

    def of_turn(events: Column, turn_no: Column) -> Column:
        read = F.transform(events, lambda e: F.struct(e["slot"].alias("slot"), e["label-1"].alias("label1"), S.label_tokens(e["label-2"]).alias("tokens"), e["curr_val"].alias("value")))
        rows = F.transform(
            read,
            lambda e: F.struct(
                turn_no.cast("int").alias("turn_no"),
                S.resolve_label(e["label1"], e["tokens"], "memory").alias("action"),
                F.trim(F.coalesce(e["value"], F.lit(""))).alias("value"),
                S.tagged_value(e["tokens"], "refered-slot").alias("ref_slot"),
                F.trim(F.coalesce(e["slot"], F.lit(""))).alias("slot"),
            ),
        )
        return F.coalesce(F.filter(rows, lambda r: (r["slot"] != "") & (r["action"] != "NONE")), F.array().cast(_RECORD))

    return F.flatten(F.transform("turns.taklabels", of_turn))


def slot_memories(dialogues: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """For every event of a turn the chain of its slot's earlier activations.

    keys, turn_no, event_no, slot, n_before, last_turn, last_action, last_value (null without memory).
    """
    rows = turn_table(dialogues.withColumn("_records", memory_records()), "taklabels", keys=(*keys, "_records"))
    rows = rows.select(*keys, "turn_no", "_records", F.posexplode("taklabels").alias("event_no", "_e")).withColumn("slot", F.col("_e.slot"))
    chain = F.filter("_records", lambda r: (r["slot"] == F.col("slot")) & (r["turn_no"] < F.col("turn_no")))
    rows = rows.withColumn("_chain", chain).withColumn("_last", F.get("_chain", F.size("_chain") - 1))
    return rows.select(*keys, "turn_no", "event_no", "slot", F.greatest(F.size("_chain"), F.lit(0)).alias("n_before"), F.col("_last.turn_no").alias("last_turn"), F.col("_last.action").alias("last_action"), F.col("_last.value").alias("last_value"))


def latest_by_slot(records: Column, turn_no: Column) -> Column:
    """The latest record of each slot before ``turn_no``, sorted by slot."""
    before = F.filter(records, lambda r: r["turn_no"] < turn_no)
    last = F.filter(before, lambda r, i: ~F.exists(F.slice(before, i + 2, F.size(before)), lambda q: q["slot"] == r["slot"]))
    return F.array_sort(F.transform(last, lambda r: F.struct(r["slot"].alias("slot"), r["turn_no"].alias("turn_no"), r["action"].alias("action"), r["value"].alias("value"))))


def latest_before(records: Column) -> Column:
    """For each turn of a dialogue the latest of its ``records`` of each slot before it: arrays that run along the turns."""
    return F.transform(F.col("turns.turn_id"), lambda _, i: latest_by_slot(records, i))


def domain_context(latest: Column, slot: Column) -> Column:
    """The latest activations of the slot's domain without the slot itself; else the other active domains; else None."""
    domain = S.domain_of(slot)
    own = F.filter(latest, lambda r: (S.domain_of(r["slot"]) == domain) & (r["slot"] != slot) & (domain != ""))
    lines = F.transform(own, lambda r: F.concat(F.lit("- slot="), r["slot"], F.lit(", latest_turn="), r["turn_no"].cast("string"), F.lit(", action="), r["action"], F.when(r["value"] != "", F.concat(F.lit(", value="), r["value"])).otherwise("")))
    others = F.array_sort(F.array_distinct(F.filter(F.transform(latest, lambda r: S.domain_of(r["slot"])), lambda d: (d != domain) & (d != ""))))
    return (
        F.when(F.size(lines) > 0, F.array_join(lines, "\n"))
        .when(F.size(others) > 0, F.concat(F.lit("No prior activation in target domain. Activated other domains: "), F.array_join(others, ", ")))
        .otherwise(F.lit("None"))
    )


def local_turns(lines: Column, turn_no: Column, label: str, *, window: int = 1, meta: Column | None = None) -> Column:
    """The lines of a turn and ``window`` before it under a heading."""
    first = F.greatest(turn_no - window, F.lit(0))
    heading = F.concat(F.lit(f"[{label} "), first.cast("string"), F.lit("-"), turn_no.cast("string"), F.lit("]"), meta if meta is not None else F.lit(""))
    return F.concat_ws("\n", heading, F.array_join(F.filter(F.slice(lines, first + 1, turn_no - first + 1), lambda x: x != ""), "\n"))


def _spoken_lines() -> Column:
    zipped = F.arrays_zip(F.col("turns.system").alias("s"), F.col("turns.user").alias("u"))
    part = lambda tag, i, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("[t"), i.cast("string"), F.lit(f"][{tag}] "), c))
    return F.transform(zipped, lambda t, i: F.concat_ws("\n", part("SYS", i, t["s"]), part("USR", i, t["u"])))


def memory_contexts(dialogues: DataFrame, keys: tuple[str, ...] = ("rec_id",), window: int = 1) -> DataFrame:
    """For every event the five context texts: memory_turns, current_turn, domain_context, ref_slot_memory, target_slot."""
    wide = dialogues.withColumn("_records", memory_records()).withColumn("_lines", _spoken_lines())
    rows = turn_table(wide, "taklabels", keys=(*keys, "_records", "_lines"))
    rows = rows.select(*keys, "turn_no", "_records", "_lines", F.posexplode("taklabels").alias("event_no", "_e"))
    rows = rows.select(*keys, "turn_no", "event_no", "_lines", F.trim(F.coalesce("_e.slot", F.lit(""))).alias("slot"), S.tagged_value(S.label_tokens(F.col("_e")["label-2"]), "refered-slot").alias("ref_slot"), F.filter("_records", lambda r: r["turn_no"] < F.col("turn_no")).alias("_before"))
    meta = lambda r: F.concat(F.lit(" (action: "), r["action"], F.when(r["value"] != "", F.concat(F.lit(", value: "), r["value"])).otherwise(""), F.lit(")"))
    chunks = lambda name, label: F.transform(F.filter("_before", lambda r: r["slot"] == F.col(name)), lambda r: local_turns(F.col("_lines"), r["turn_no"], label, window=window, meta=meta(r)))
    own, ref = chunks("slot", "Memory turn"), chunks("ref_slot", "Ref turn")
    named = F.concat(F.lit("[Reference slot] "), F.col("ref_slot"))
    return rows.select(
        *keys,
        "turn_no",
        "event_no",
        F.when(F.size(own) > 0, F.array_join(own, "\n\n")).otherwise("None").alias("memory_turns"),
        local_turns(F.col("_lines"), F.col("turn_no"), "Current turn", window=window).alias("current_turn"),
        domain_context(latest_by_slot(F.col("_before"), F.col("turn_no")), F.col("slot")).alias("domain_context"),
        F.when(F.col("ref_slot") == "", "None").when(F.size(ref) > 0, F.concat(named, F.lit("\n\n"), F.array_join(ref, "\n\n"))).otherwise(F.concat(named, F.lit("\nNone"))).alias("ref_slot_memory"),
        F.col("slot").alias("target_slot"),
    )


def latest_activation_asof(events: DataFrame, probes: DataFrame, *, keys: list[str], order: str = "turn_no", carry: list[str]) -> DataFrame:
    """Each probe row with the ``carry`` columns of the last event of its ``keys`` strictly before it.

    One shuffle and one sort over the union of both sides; probes keep their other columns.
    """
    from pyspark.sql import Window

    rest = [c for c in probes.columns if c not in (*keys, order)]
    both = events.select(*keys, order, F.lit(0).alias("_probe"), F.struct(F.col(order).alias("at"), *carry).alias("_event"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in rest]).unionByName(
        probes.select(*keys, order, F.lit(1).alias("_probe"), *rest), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_last", F.last("_event", ignorenulls=True).over(w)).where("_probe = 1")
    return found.select(*keys, order, *rest, F.col("_last.at").alias(f"last_{order}"), *[F.col("_last")[c].alias(f"last_{c}") for c in carry])
