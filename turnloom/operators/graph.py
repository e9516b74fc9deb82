"""Turn graphs: nodes and edges of what a turn does to slots, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import slots as S
from turnloom.operators.sampling import negative_slot_array
from turnloom.operators.state import from_turn
from turnloom.operators.turns import computed_once, context_lines, shifted, turn_table

POSITIVE = ("activate_slot", "apply_label", "value_prev", "value_curr", "triggers_dontcare", "refer_to")
NEGATIVE = ("neg_slot", "value_carry")
NODE = "struct<t:string,id:string,slot:string,value:string,role:string>"
EDGE = f"array<struct<src:{NODE},rel:string,dst:{NODE}>>"


def node(t: str, *, id: Column | None = None, slot: Column | None = None, value: Column | None = None, role: str | None = None) -> Column:
    empty = F.lit(None).cast("string")
    return F.struct(F.lit(t).alias("t"), (empty if id is None else id).alias("id"), (empty if slot is None else slot).alias("slot"), (empty if value is None else value).alias("value"), F.lit(role).cast("string").alias("role"))


def edge(src: Column, rel: str, dst: Column) -> Column:
    return F.struct(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))


def _some(value: Column) -> Column:
    return (value != "") & (value != "none")


def task_labels(events: Column, states: Column, turn_no: Column) -> Column:
    """Each event's slot, label, from_slot and from_turn; events without a slot are left out."""

    # one step per level, as what a lambda uses twice is computed twice
    def read(e: Column) -> Column:
        return F.struct(F.trim(e["slot"]).alias("slot"), e["label-1"].alias("label1"), S.label_tokens(e["label-2"]).alias("tokens"), F.trim(F.coalesce(e["curr_val"], F.lit(""))).alias("value"))

    def labelled(e: Column) -> Column:
        told = S.tagged_value(e["tokens"], "refered-value")
        return F.struct(e["slot"].alias("slot"), S.resolve_label(e["label1"], e["tokens"], "graph").alias("label"), S.tagged_value(e["tokens"], "refered-slot").alias("named"), F.when(told != "", told).otherwise(e["value"]).alias("value"))

    def one(e: Column) -> Column:
        source = F.when(e["label"] == "refer-clear", e["named"]).otherwise("")
        turn = F.when((source != "") & (e["value"] != ""), from_turn(states, turn_no, source, e["value"])).otherwise(F.lit(-1))
        return F.struct(e["slot"].alias("slot"), e["label"].alias("label"), source.alias("from_slot"), turn.alias("from_turn"))

    kept = F.filter(events, lambda e: F.trim(F.coalesce(e["slot"], F.lit(""))) != "")
    return F.transform(F.transform(F.transform(kept, read), labelled), one)


def event_edges(events: Column, labels: Column) -> Column:
    """The edges of a turn's events, repeated ones once, in order."""
    kept = F.filter(events, lambda e: F.trim(F.coalesce(e["slot"], F.lit(""))) != "")

    def of(e: Column, tl: Column) -> Column:
        slot, me = tl["slot"], node("slot", id=tl["slot"])
        prev, curr = F.trim(F.coalesce(e["prev_val"], F.lit(""))), F.trim(F.coalesce(e["curr_val"], F.lit("")))
        wanted = F.array(
            edge(node("ctx"), "activate_slot", me),
            edge(node("tl", slot=slot), "apply_label", me),
            F.when(tl["label"] == "dontcare", edge(node("ctx"), "triggers_dontcare", node("tl", slot=slot))),
            F.when((tl["label"] == "refer-clear") & (tl["from_slot"] != ""), edge(me, "refer_to", node("slot", id=tl["from_slot"]))),
            F.when(_some(prev), edge(me, "value_prev", node("val", slot=slot, value=prev, role="prev"))),
            F.when(_some(curr), edge(me, "value_curr", node("val", slot=slot, value=curr, role="curr"))),
        )
        return F.filter(wanted, lambda x: x.isNotNull())

    return F.array_distinct(F.flatten(F.zip_with(kept, labels, of))).cast(EDGE)


def event_values(events: Column) -> Column:
    kept = F.filter(events, lambda e: F.trim(F.coalesce(e["slot"], F.lit(""))) != "")

    def of(e: Column) -> Column:
        both = F.array(*[F.when(_some(F.trim(F.coalesce(e[f"{r}_val"], F.lit("")))), F.struct(F.trim(e["slot"]).alias("slot"), F.trim(e[f"{r}_val"]).alias("value"), F.lit(r).alias("role"))) for r in ("prev", "curr")])
        return F.filter(both, lambda x: x.isNotNull())

    return F.array_distinct(F.flatten(F.transform(kept, of)))


def graph_store(dialogues: DataFrame, slot_descriptions: DataFrame, *, window: int = 2, seed: str = "13", keys: tuple[str, ...] = ("rec_id", "dial_id")) -> DataFrame:
    """One row per turn with events: the turn's graph, with one or two negative slots.

    keys, turn_no, turn_id, graph_id, context, labels_for_retrieval, slots, tasklabels, values, neg_slots, edges.
    """
    states = F.col("turns.state.slot_values")
    known = computed_once(dialogues, _states=states)
    labelled = F.transform(F.col("turns.taklabels"), lambda events, i: task_labels(events, F.col("_states"), i))
    rows = turn_table(known, "taklabels", keys=keys, computed={"text": context_lines(window), "before": shifted(states), "tasklabels": labelled})
    rows = rows.where(F.size("taklabels") > 0)
    rows = computed_once(rows, active=F.array_distinct(F.transform("tasklabels", lambda t: t["slot"])))
    negatives = computed_once(rows, _neg=negative_slot_array(F.col("active"), slot_descriptions, [*keys, "turn_no"], seed))
    carry = lambda s: F.trim(F.coalesce(F.element_at("before", s), F.lit("")))
    neg = F.transform("_neg", lambda s: F.struct(s.alias("slot"), F.when(_some(carry(s)), "ghost").otherwise("void").alias("neg_type"), F.when(_some(carry(s)), carry(s)).otherwise("none").alias("carry_value")))
    done = computed_once(negatives, neg_slots=neg)
    neg_edges = F.flatten(F.transform("neg_slots", lambda x: F.array(edge(node("ctx"), "neg_slot", node("slot", id=x["slot"])), edge(node("slot", id=x["slot"]), "value_carry", node("val", slot=x["slot"], value=x["carry_value"], role="carry"))))).cast(EDGE)
    neg_values = F.transform("neg_slots", lambda x: F.struct(x["slot"].alias("slot"), x["carry_value"].alias("value"), F.lit("carry").alias("role")))
    sources = F.filter(F.transform("tasklabels", lambda t: F.when(t["label"] == "refer-clear", t["from_slot"])), lambda x: x.isNotNull() & (x != ""))
    edges = F.array_distinct(F.concat(event_edges(F.col("taklabels"), F.col("tasklabels")), neg_edges))
    return computed_once(done, edges=edges).select(
        *keys,
        "turn_no",
        "turn_id",
        F.concat_ws("::", F.coalesce("dial_id", F.lit("")), F.col("turn_id").cast("string")).alias("graph_id"),
        F.struct(F.col("text").alias("retrieval_text")).alias("context"),
        F.array_sort(F.array_distinct(F.filter(F.transform("tasklabels", lambda t: t["label"]), lambda x: x != ""))).alias("labels_for_retrieval"),
        F.array_sort(F.array_distinct(F.concat("active", F.transform("neg_slots", lambda x: x["slot"]), sources))).alias("slots"),
        "tasklabels",
        F.array_distinct(F.concat(event_values(F.col("taklabels")), neg_values)).alias("values"),
        "neg_slots",
        "edges",
    )


def belongs_to(e: Column, slot: Column) -> Column:
    """Whether an edge is about the slot; references count at either end."""
    src, dst = e["src"], e["dst"]
    named = lambda n: F.coalesce(n["id"], n["slot"])
    return F.coalesce(named(src) == slot, F.lit(False)) | F.coalesce(named(dst) == slot, F.lit(False))


def node_text(n: Column) -> Column:
    return (
        F.when(n["t"] == "slot", F.concat(F.lit("slot("), n["id"], F.lit(")")))
        .when(n["t"] == "tl", F.concat(F.lit("label("), n["slot"], F.lit(")")))
        .when(n["t"] == "val", F.concat(F.lit("val("), n["slot"], F.lit("="), n["value"], F.lit(", role="), n["role"], F.lit(")")))
        .otherwise("ctx")
    )


def edge_lines(edges: Column, slot: Column, relations: tuple[str, ...] = POSITIVE, label: Column | None = None) -> Column:
    """The slot's edges of the given relations as numbered lines, repeated ones once."""
    kept = F.filter(edges, lambda e: e["rel"].isin(*relations) & belongs_to(e, slot))
    source = lambda e: F.when(e["src"]["t"] == "tl", F.concat(F.lit("label("), label, F.lit(")"))).otherwise(node_text(e["src"])) if label is not None else node_text(e["src"])
    lines = F.array_distinct(F.transform(kept, lambda e: F.concat(source(e), F.lit(" --"), e["rel"], F.lit("--> "), node_text(e["dst"]))))
    return F.transform(lines, lambda x, i: F.concat(F.lit("E"), (i + 1).cast("string"), F.lit(": "), x))


def slot_event(graphs: DataFrame, slot: str) -> DataFrame:
    """Graph rows with what they hold about the slot in column ``slot``: label, from_slot, from_turn, prev, curr, carry, neg_type."""
    first = lambda c, f: F.get(F.filter(c, f), F.lit(0))
    s = F.col(slot)
    tl = first("tasklabels", lambda t: t["slot"] == s)
    value = lambda role: first("values", lambda v: (v["slot"] == s) & (v["role"] == role))["value"]
    return graphs.select("*", tl["label"].alias("label"), tl["from_slot"].alias("from_slot"), tl["from_turn"].alias("from_turn"), value("prev").alias("prev"), value("curr").alias("curr"), value("carry").alias("carry"), first("neg_slots", lambda v: v["slot"] == s)["neg_type"].alias("neg_type"))


def graph_edges(graphs: DataFrame) -> DataFrame:
    """One row per edge: graph_id, edge_no, src, rel, dst."""
    return graphs.select("graph_id", F.posexplode("edges").alias("edge_no", "_e")).select("graph_id", "edge_no", "_e.*")
