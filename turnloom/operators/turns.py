"""Dialogues as turn and event tables.

A dialogue's turns are one array, so whatever looks at neighbouring turns is an
expression over that array: no shuffle, no window sort. Field arrays
(``turns.system``) rather than whole turns are read, so a scan prunes to them.
``turn_no`` is the place from 0; ``turn_id`` falls back to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("rec_id", "dial_id", "domains", "source", "split")
FIELDS = {
    "turn_id": "turns.turn_id",
    "system": "turns.system",
    "user": "turns.user",
    "active_intent": "turns.state.active_intent",
    "slot_values": "turns.state.slot_values",
    "taklabels": "turns.taklabels",
    "tasklabel": "turns.tasklabel",
    "candidates": "turns.candidates",
}


def shifted(values: Column, by: int = 1) -> Column:
    """The array moved ``by`` places to the right, null in front, as long as before."""
    return F.transform(values, lambda x, i: F.get(values, i - by))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` behind a generator, so that later uses don't repeat their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def turn_table(dialogues: DataFrame, *fields: str, keys: tuple[str, ...] = ("rec_id",), before: tuple[str, ...] = (), computed: dict[str, Column] | None = None) -> DataFrame:
    """One row per turn: ``keys``, turn_no, turn_id, ``fields``, and ``before_<field>`` of the turn before.

    ``computed`` adds arrays that run along the turns. Null and empty turns give no rows.
    """
    size = F.size("turns")
    arrays = [F.col(FIELDS[f]).alias(f) for f in dict.fromkeys(("turn_id", *fields))]
    arrays += [shifted(F.col(FIELDS[f])).alias(f"before_{f}") for f in before]
    arrays += [c.alias(name) for name, c in (computed or {}).items()]
    rows = dialogues.where(size > 0).select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("turn_no", "_t"))
    names = [*fields, *[f"before_{f}" for f in before], *(computed or {})]
    return rows.select(*keys, "turn_no", F.coalesce("_t.turn_id", "turn_no").alias("turn_id"), *[F.col("_t")[n].alias(n) for n in names])


def event_table(dialogues: DataFrame, *fields: str, keys: tuple[str, ...] = ("rec_id",), before: tuple[str, ...] = (), computed: dict[str, Column] | None = None) -> DataFrame:
    """One row per event of a turn: the turn's columns, event_no, slot, label1, label2, prev_val, curr_val."""
    turns = turn_table(dialogues, *dict.fromkeys((*fields, "taklabels")), keys=keys, before=before, computed=computed)
    rows = turns.select(*[c for c in turns.columns if c != "taklabels" or "taklabels" in fields], F.posexplode("taklabels").alias("event_no", "_e"))
    return rows.select(*[c for c in rows.columns if c != "_e"], F.col("_e.slot").alias("slot"), F.col("_e")["label-1"].alias("label1"), F.col("_e")["label-2"].alias("label2"), F.col("_e.prev_val").alias("prev_val"), F.col("_e.curr_val").alias("curr_val"))


def state_table(dialogues: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """One row per slot of a turn's state: keys, turn_no, slot, value."""
    return turn_table(dialogues, "slot_values", keys=keys).select(*keys, "turn_no", F.explode("slot_values").alias("slot", "value"))


def nest_turns(turns: DataFrame, *fields: str, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Turn rows back into dialogues, in order of turn_no."""
    packed = F.array_sort(F.collect_list(F.struct("turn_no", *fields)))
    return turns.groupBy(*keys).agg(packed.alias("turns"))


def context_lines(k: int, style: str = "tagged") -> Column:
    """For each turn the text of up to ``k`` turns before it and itself.

    tagged: ``[t0][SYS] ..`` lines; spoken: one line, a missing system turn is none;
    plain: lines without tags, blank ones left out.
    """
    system, user = F.col("turns.system"), F.col("turns.user")
    text = lambda c: F.coalesce(c, F.lit(""))
    if style == "tagged":
        line = lambda s, u, i: F.concat(F.lit("[t"), i.cast("string"), F.lit("][SYS] "), text(s), F.lit("\n[t"), i.cast("string"), F.lit("][USR] "), text(u))
        joint = "\n"
    elif style == "spoken":
        line = lambda s, u, i: F.concat(F.lit("system: "), F.when(F.trim(text(s)) == "", F.lit("none")).otherwise(s), F.lit(" user: "), text(u))
        joint = " "
    else:
        line = lambda s, u, i: F.concat_ws("\n", F.nullif(text(s), F.lit("")), F.nullif(text(u), F.lit("")))
        joint = "\n"
    zipped = F.arrays_zip(system.alias("s"), user.alias("u"))
    lines = F.transform(zipped, lambda t, i: line(t["s"], t["u"], i))
    window = lambda i: F.slice(lines, F.greatest(i - k, F.lit(0)) + 1, F.least(i, F.lit(k)) + 1)
    if style == "plain":
        return F.transform(zipped, lambda t, i: F.array_join(F.filter(window(i), lambda x: x != ""), joint))
    return F.transform(zipped, lambda t, i: F.array_join(window(i), joint))


def contexts(dialogues: DataFrame, k: int = 2, style: str = "tagged", keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    return turn_table(dialogues, keys=keys, computed={"context": context_lines(k, style)})


def pair_speakers(utterances: DataFrame, *, dialogue: str, order: str, speaker: str, text: str) -> DataFrame:
    """Alternating utterances as turns: each USER utterance with the last SYSTEM utterance before it, numbered from 0."""
    from pyspark.sql import Window

    w = Window.partitionBy(dialogue).orderBy(order)
    carried = utterances.withColumn("_system", F.last(F.when(F.upper(speaker) == "SYSTEM", F.col(text)), ignorenulls=True).over(w))
    said = carried.where(F.upper(speaker) == "USER")
    fresh = F.lag(F.col("_system")).over(w)
    return said.select(dialogue, (F.row_number().over(w) - 1).alias("turn_no"), F.coalesce("_system", F.lit("none")).alias("system"), F.col(text).alias("user"), fresh.eqNullSafe(F.col("_system")).alias("same_system"))


def carried_domain(dialogues: DataFrame) -> DataFrame:
    """rec_id, turn_no, domain: the first domain (by name) of the state's changes, else the one carried on."""
    from turnloom.functions.slots import domain_of
    from turnloom.operators.state import delta

    state = F.col("turns.state.slot_values")
    changed = F.transform(F.arrays_zip(state.alias("now"), shifted(state).alias("was")), lambda t: F.get(F.array_sort(F.transform(delta(t["was"], t["now"], "label"), lambda d: domain_of(d["slot"]))), F.lit(0)))
    carried = F.transform(changed, lambda x, i: F.coalesce(x, F.get(F.reverse(F.filter(F.slice(changed, F.lit(1), i + 1), lambda y: y.isNotNull())), F.lit(0)), F.lit("none")))
    return turn_table(dialogues, computed={"domain": carried})


def new_domains(dialogues: DataFrame) -> DataFrame:
    """rec_id, turn_no, new_domains: the domains of the state that the turn before didn't have, sorted."""
    from turnloom.functions.slots import domain_or_slot

    names = lambda m: F.coalesce(F.array_distinct(F.transform(F.map_keys(m), domain_or_slot)), F.array().cast("array<string>"))
    turns = turn_table(dialogues, "slot_values", before=("slot_values",))
    return turns.select("rec_id", "turn_no", F.array_sort(F.array_except(names(F.col("slot_values")), names(F.col("before_slot_values")))).alias("new_domains"))


def summaries_before(turns: DataFrame, column: str = "summary", keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Turn rows with the summary of the turn before; None where there is none."""
    from pyspark.sql import Window

    from turnloom.functions.text import or_default

    return turns.withColumn("summary_before", or_default(F.lag(column).over(Window.partitionBy(*keys).orderBy("turn_no")), "None"))


def belief_slots(metadata: DataFrame, *, keys: list[str], column: str = "metadata") -> DataFrame:
    """Belief states nested by domain (``book`` and ``semi`` maps) as rows: keys, slot, value."""
    rows = metadata.select(*keys, F.explode(column).alias("domain", "_m"))
    booked = rows.select(*keys, "domain", F.explode("_m.book").alias("_k", "value")).where("_k <> 'booked'").select(*keys, F.concat("domain", F.lit("-book "), "_k").alias("slot"), "value")
    asked = rows.select(*keys, "domain", F.explode("_m.semi").alias("_k", "value")).select(*keys, F.concat("domain", F.lit("-"), "_k").alias("slot"), "value")
    return booked.unionByName(asked).where(~F.lower(F.trim("value")).isin("", "not mentioned", "none"))


def frame_values(frames: DataFrame, *, keys: list[str], utterance: str, values: str = "slot_values", pick: str = "first") -> DataFrame:
    """Frames with lists of values as rows: keys, slot, and of the values those the utterance holds the first (or last), else the first."""
    rows = frames.select(*keys, F.col(utterance).alias("_u"), F.explode(values).alias("slot", "_v"))
    held = F.filter("_v", lambda v: F.contains(F.lower(F.coalesce("_u", F.lit(""))), F.lower(v)))
    chosen = F.get(held, F.lit(0)) if pick == "first" else F.element_at(F.when(F.size(held) > 0, held), -1)
    return rows.select(*keys, F.translate("slot", "_", " ").alias("slot"), F.coalesce(chosen, F.get("_v", F.lit(0))).alias("value"))


def well_formed(dialogues: DataFrame, most_words: int = 50) -> DataFrame:
    """Dialogues whose utterances are all ASCII and of at most ``most_words`` words."""
    fine = lambda c: F.forall(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")).rlike(r"^\p{ASCII}*$") & (F.size(F.split(F.coalesce(x, F.lit("")), " ")) <= most_words))
    return dialogues.where(fine(F.col("turns.system")) & fine(F.col("turns.user")))
