"""Texts for models: activation questions, action questions, and graph reasoning samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import slots as S
from turnloom.functions import text as X
from turnloom.operators.graph import edge_lines
from turnloom.operators.turns import context_lines, turn_table

GATE_NOTES = {
    "CONFIRM": "The reply accepts or rejects what the system said; read the system turn only to learn what.",
    "DEIXIS": "The reply points at something; read the system turn only to learn at what.",
    "SHORT_VALUE": "The reply is a bare value; read the system's question only to learn for which slot.",
}
#: How a label works on a slot: (what the context does, what is done to the slot).
LABEL_STEPS = {
    "constrain": ("the context gives a value for the slot", "take the value from the context"),
    "change": ("the context replaces the slot's value", "take the new value from the context"),
    "switch": ("the context opens the slot's domain", "take the value from the context"),
    "dontcare": ("the context leaves the slot open", "mark the slot as indifferent"),
    "confirm": ("the user accepts the system's value", "take the value the system named"),
    "refer-clear": ("the context refers to another slot", "copy the other slot's value"),
    "refer-implicit": ("the context refers to a value without its slot", "infer the value from the history"),
}


def section(title: str, *body: Column) -> Column:
    return F.concat_ws("\n", F.lit(f"[{title}]"), *body)


def activation_prompts(samples: DataFrame, dialogues: DataFrame, slot_descriptions: DataFrame, *, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Activation samples (keys, turn_no, slot, label ..) as question and answer: the sample's columns, gate, prompt.

    The turn's texts and the slots active so far come from the dialogue, slot memory from
    earlier events, and the slot's texts from the slot table (fixed, broadcast).
    """
    from turnloom.operators.state import activated_so_far

    texts = turn_table(dialogues, "system", "user", keys=keys).drop("turn_id").join(activated_so_far(dialogues, keys).drop("turn_id"), [*keys, "turn_no"])
    slots = F.broadcast(S.describe_slots(slot_descriptions).select("slot", "concise_desc", "contras_desc", "value"))
    rows = samples.join(texts, [*keys, "turn_no"]).join(slots, "slot", "left")
    system, user = X.or_default(F.col("system")), X.or_default(F.col("user"))
    gate = X.gate_type(F.col("system"), F.col("user"))
    notes = F.element_at(F.create_map(*[F.lit(x) for pair in GATE_NOTES.items() for x in pair]), gate)
    prompt = F.concat_ws(
        "\n\n",
        section("Turn", F.concat(F.lit("System: "), system), F.concat(F.lit("User: "), user)),
        section("Active so far", S.listed(F.col("activated"), 30, "...")),
        F.concat(F.lit("[Slot]\n"), F.col("slot")),
        section("Values", S.value_examples(F.col("value"))),
        section("Meaning", X.or_default(F.col("concise_desc"), "None"), X.or_default(F.col("contras_desc"), "None")),
        F.concat(F.lit("[Gate]\n"), notes),
        F.lit("Does this turn change the slot? Answer yes or no."),
    )
    return rows.select(*samples.columns, gate.alias("gate"), prompt.alias("prompt"))


def chat_messages(rows: DataFrame, system: str, prompt: str = "prompt", answer: str = "label") -> DataFrame:
    """Question and answer as chat messages in JSON."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.withColumn("messages", F.to_json(F.array(message("system", F.lit(system)), message("user", F.col(prompt)), message("assistant", F.col(answer)))))


def action_prompts(pairs: DataFrame, contexts: DataFrame, slot_descriptions: DataFrame, *, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Preference pairs with their question: the pair's columns, prompt. ``contexts``: keys, turn_no, context."""
    slots = F.broadcast(slot_descriptions.select("slot", F.coalesce("contras_desc", F.lit("")).alias("_contrast"), F.coalesce("type_desc", F.lit("")).alias("_type")))
    rows = pairs.join(contexts.select(*keys, "turn_no", F.col("context").alias("_context")), [*keys, "turn_no"]).join(slots, "slot", "left")
    hidden = lambda c: F.when(F.col("masked"), X.mask_domains(c)).otherwise(c)
    prompt = F.concat_ws("\n\n", section("Dialogue", F.col("_context")), F.concat(F.lit("[Slot]\n"), F.col("target_slot")), section("Meaning", hidden(F.coalesce("_type", F.lit(""))), hidden(F.coalesce("_contrast", F.lit("")))), F.lit("Which action does the turn take on the slot?"))
    return rows.select(*pairs.columns, prompt.alias("prompt"))


def reasoning_answer(label: Column, value: Column, ref_slot: Column, ref_turn: Column) -> Column:
    """The steps from label to value, then the ``Result:`` line."""
    table = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in LABEL_STEPS.items() for x in (k, v[i])]), label)
    copied = F.concat(F.lit("copy the value of "), ref_slot, F.when(ref_turn >= 0, F.concat(F.lit(" from turn "), ref_turn.cast("string"))).otherwise(""))
    what = F.coalesce(table(0), F.concat(F.lit("the context evokes "), label))
    how = F.when((label == "refer-clear") & (F.coalesce(ref_slot, F.lit("")) != ""), copied).otherwise(F.coalesce(table(1), F.concat(F.lit("apply "), label)))
    steps = F.when(label == "none", F.lit("S1: the slot stays as it is.")).otherwise(F.concat(F.lit("S1: "), what, F.lit(".\nS2: "), how, F.lit(".")))
    return F.concat(steps, F.lit("\n\nResult: "), F.when(label == "none", "none").otherwise(F.coalesce(value, F.lit("none"))))


def reasoning_samples(events: DataFrame, graphs: DataFrame, contexts: DataFrame, slot_descriptions: DataFrame, *, k: int = 3, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Graph reasoning samples: each event with its retrieved examples rendered from their graphs.

    ``events``: keys, turn_no, event_no, slot, label, prev_val, curr_val, ref_slot, ref_turn,
    retrieved (array of ``graph_id::slot``); ``graphs``: graph_id, context, edges; ``contexts``:
    keys, turn_no, context. Gives keys, turn_no, event_no, slot, instruction, input, output.
    """
    ids = F.posexplode(F.slice(F.col("retrieved"), 1, k)).alias("_at", "_ret")
    asked = events.select(*keys, "turn_no", "event_no", ids)
    asked = asked.select(*keys, "turn_no", "event_no", "_at", F.array_join(F.slice(F.split("_ret", "::"), 1, 2), "::").alias("graph_id"), F.element_at(F.split("_ret", "::"), -1).alias("_slot"))
    shown = asked.join(graphs.select("graph_id", F.col("context.retrieval_text").alias("_text"), "edges"), "graph_id")
    demo = F.concat_ws("\n", F.concat(F.lit("(example) slot = "), F.col("_slot")), F.col("_text"), F.array_join(edge_lines(F.col("edges"), F.col("_slot")), "\n"))
    demos = shown.groupBy(*keys, "turn_no", "event_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", demo.alias("d")))), lambda x: x["d"]), "\n\n").alias("_demos"))
    slots = F.broadcast(slot_descriptions.select("slot", "value"))
    rows = events.join(contexts.select(*keys, "turn_no", F.col("context").alias("_context")), [*keys, "turn_no"]).join(demos, [*keys, "turn_no", "event_no"], "left").join(slots, "slot", "left")
    candidates = S.value_candidates(F.col("value"), S.type_of(F.col("slot")))
    facts = F.concat_ws(
        "\n",
        F.concat(F.lit("F1 = slot = "), F.col("slot")),
        F.concat(F.lit("F2 = label = "), F.col("label"), F.lit(": "), S.label_text(F.col("label"))),
        F.concat(F.lit("F3 = value before = "), X.or_default(F.col("prev_val"))),
        F.concat(F.lit("F4 = candidates = "), X.json_list(candidates)),
        F.when(F.coalesce("ref_slot", F.lit("")) != "", F.concat(F.lit("F5 = refers to = "), F.col("ref_slot"))),
    )
    text = F.concat_ws("\n\n", F.col("_demos"), section("Dialogue", F.col("_context")), section("Facts", facts))
    return rows.select(*keys, "turn_no", "event_no", "slot", F.lit("Find the slot's value after the turn. End with a line Result: <value>.").alias("instruction"), text.alias("input"), reasoning_answer(F.col("label"), F.col("curr_val"), F.col("ref_slot"), F.col("ref_turn")).alias("output"))


def value_prompts(dialogues: DataFrame, slot_descriptions: DataFrame, *, k: int = 4, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """For each event the question for its value: keys, turn_no, event_no, slot, prompt."""
    rows = turn_table(dialogues, "taklabels", keys=keys, computed={"context": context_lines(k, "spoken")}).select(*keys, "turn_no", "context", F.posexplode("taklabels").alias("event_no", "_e"))
    slots = F.broadcast(slot_descriptions.select("slot", "value"))
    met = rows.select(*keys, "turn_no", "event_no", "context", F.col("_e.slot").alias("slot"), F.col("_e.prev_val").alias("_prev")).join(slots, "slot", "left")
    prompt = F.concat_ws("\n", F.col("context"), F.concat(F.lit("slot: "), F.col("slot")), F.concat(F.lit("before: "), X.or_default(F.col("_prev"))), F.concat(F.lit("choose from: "), X.json_list(S.value_candidates(F.col("value"), S.type_of(F.col("slot"))))))
    return met.select(*keys, "turn_no", "event_no", "slot", prompt.alias("prompt"))
