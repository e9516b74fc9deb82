"""Training samples from labelled turns: activation samples with ranked negatives, and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import slots as S
from turnloom.functions import text as X
from turnloom.operators.memory import latest_before, memory_records
from turnloom.operators.turns import computed_once, context_lines, turn_table
from turnloom.runtime import small

#: The action a model most easily takes for the gold one.
CONFUSED_ACTION = {
    "CHANGE": "CONSTRAIN",
    "CONSTRAIN": "CHANGE",
    "CONFIRM": "CONSTRAIN",
    "SWITCH": "CONSTRAIN",
    "DONTCARE": "NONE",
    "REF-IMPLICIT": "REF-EXPLICIT",
    "REF-EXPLICIT": "CONSTRAIN",
    "NONE": "CONSTRAIN",
}
#: A pair found by several rules keeps the first of these types.
PAIR_TYPES = ("P_B_label_confusion", "P_C_sft_error", "P_A1_surface_mention", "P_A2_memory_interference")
TOP_CANDIDATES = 10


def _universe(slot_descriptions: DataFrame) -> list[str]:
    return sorted(r["slot"] for r in small(slot_descriptions.select("slot").distinct(), 1000))


def activation_samples(dialogues: DataFrame, slot_descriptions: DataFrame, *, held_out: str | None = None, seed: str = "20251218", keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Each active slot of a turn as a positive sample with two negatives.

    keys, turn_no, pos_slot, sample_no, slot, sample_type, label. The first negative has
    the same type in another domain: the best-ranked candidate, else by hash from the
    other slots. The second (both, where there is no first) has the same domain and
    another type: from the first ``TOP_CANDIDATES`` candidates, the other candidates, by
    hash from the rest, at last any other slot by hash. All of it is expressions over one
    row, with the slot table inside them.
    """
    fact = lambda s: F.struct(s.alias("slot"), S.domain_of(s).alias("domain"), S.type_of(s).alias("kind"))
    universe = F.array(*[fact(F.lit(s)) for s in _universe(slot_descriptions)])  # folded to a constant
    turns = turn_table(dialogues, "taklabels", "candidates", keys=keys).where(F.size("taklabels") > 0)
    gold = F.array_distinct(F.filter(F.transform("taklabels", lambda e: e["slot"]), lambda s: s.isNotNull() & (s != "")))
    rows = turns.select(*keys, "turn_no", gold.alias("_gold"), F.coalesce(F.array_distinct(F.filter("candidates", lambda c: c.isNotNull())), F.array().cast("array<string>")).alias("_cand"))
    parts = [F.col(k).cast("string") for k in (*keys, "turn_no")]
    fine = lambda f: ~F.array_contains("_gold", f["slot"]) & (F.lit(True) if held_out is None else f["domain"] != held_out)
    ranked = F.filter(F.transform("_cand", lambda s, i: F.struct(fact(s).alias("fact"), i.alias("at"))), lambda r: fine(r["fact"]))
    rest = F.filter(universe, lambda f: fine(f) & ~F.array_contains("_cand", f["slot"]))
    rows = computed_once(rows, _ranked=ranked, _rest=rest, _fine=F.filter(universe, fine))
    rows = computed_once(rows.select("*", F.explode("_gold").alias("pos_slot")), _own=fact(F.col("pos_slot")))
    other = lambda f: (f["kind"] == F.col("_own.kind")) & (f["domain"] != F.col("_own.domain"))
    alike = lambda f: (f["domain"] == F.col("_own.domain")) & (f["kind"] != F.col("_own.kind"))

    def pool(kind: str, keep, tag: str) -> Column:
        """tier, rank, slot of everything that may be taken, best first."""
        first = F.transform(F.filter("_ranked", lambda r: keep(r["fact"])), lambda r: F.struct(F.when(r["at"] < TOP_CANDIDATES, 0).otherwise(1 if kind == "B" else 0).alias("tier"), F.lpad(r["at"].cast("string"), 32, "0").alias("rank"), r["fact"]["slot"].alias("slot")))
        others = F.transform(F.filter("_rest", keep), lambda f: F.struct(F.lit(2).alias("tier"), F.md5(F.concat_ws("|", F.lit(seed), *parts, F.lit(tag), "pos_slot", f["slot"])).alias("rank"), f["slot"].alias("slot")))
        return F.array_sort(F.concat(first, others))

    anything = F.array_sort(F.transform("_fine", lambda f: F.struct(F.lit(3).alias("tier"), F.md5(F.concat_ws("|", F.lit(seed), *parts, F.lit("any"), "pos_slot", f["slot"])).alias("rank"), f["slot"].alias("slot"))))
    rows = computed_once(rows, _a=F.get(pool("A", other, "negA"), F.lit(0))["slot"], _b=F.transform(pool("B", alike, "negB"), lambda r: r["slot"]))
    ranked_b = F.when(F.size("_b") > 2, F.col("_b")).otherwise(F.concat("_b", F.transform(anything, lambda r: r["slot"])))  # the last resort only where it can be needed
    rows = computed_once(rows, _left=F.filter(F.array_distinct(ranked_b), lambda s: F.coalesce(s != F.col("_a"), F.lit(True))))
    one, two = F.get("_left", F.lit(0)), F.get("_left", F.lit(1))
    sample = lambda s, kind, label: F.struct(s.alias("slot"), F.lit(kind).alias("sample_type"), F.lit(label).alias("label"))
    kind_b = "neg_same_domain_diff_type"
    first = F.when(F.col("_a").isNotNull(), sample(F.col("_a"), "neg_same_type_diff_domain", "no")).when(one.isNotNull(), sample(one, kind_b, "no"))
    second_b = F.when(F.col("_a").isNotNull(), one).otherwise(two)
    second = F.when(second_b.isNotNull(), sample(second_b, kind_b, "no")).when(first.isNotNull(), sample(first["slot"], "neg_fallback_duplicate", "no"))
    samples = F.filter(F.array(sample(F.col("pos_slot"), "pos", "yes"), first, second), lambda x: x.isNotNull())
    return rows.select(*keys, "turn_no", "pos_slot", F.posexplode(samples).alias("sample_no", "_s")).select(*keys, "turn_no", "pos_slot", "sample_no", "_s.*")


def surface_mentions(dialogues: DataFrame, slot_descriptions: DataFrame, *, most: int = 1, least: float = 0.0, window: int = 1, seed: str = "13", keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """The inactive slots whose words are most like the turn's: keys, turn_no, slot, similarity, rank."""
    described = small(S.describe_slots(slot_descriptions).select("slot", X.word_set(F.col("lexical_text")).alias("words")), 1000)
    turns = turn_table(dialogues, "taklabels", keys=keys, computed={"text": context_lines(window, "plain")})
    parts = [F.col(k).cast("string") for k in (*keys, "turn_no")]
    active = F.coalesce(F.transform("taklabels", lambda e: e["slot"]), F.array().cast("array<string>"))
    rows = turns.select(*keys, "turn_no", active.alias("_active"), X.word_set(F.col("text")).alias("_words"))
    scored = [
        F.when(
            ~F.coalesce(F.array_contains("_active", r["slot"]), F.lit(False)),
            F.struct((-F.round(X.lexical_similarity(F.array(*[F.lit(w) for w in r["words"]]), F.col("_words")), 9)).alias("down"), X.hash_unit(F.lit(seed), F.lit("surface"), *parts, F.lit(r["slot"])).alias("hash"), F.lit(r["slot"]).alias("slot")),
        )
        for r in described
    ]
    best = F.slice(F.array_sort(F.filter(F.array(*scored), lambda x: x.isNotNull())), 1, most)
    out = rows.select(*keys, "turn_no", F.posexplode(best).alias("_at", "_s"))
    return out.select(*keys, "turn_no", F.col("_s.slot").alias("slot"), (-F.col("_s.down")).alias("similarity"), (F.col("_at") + 1).alias("rank")).where(F.col("similarity") >= least)


def preference_pairs(
    dialogues: DataFrame,
    slot_descriptions: DataFrame,
    predictions: DataFrame | None = None,
    *,
    seed: str = "13",
    mask_share: float = 0.3,
    most_surface: int = 1,
    least_surface: float = 0.0,
    most_memory: int = 2,
    keys: tuple[str, ...] = ("rec_id",),
) -> DataFrame:
    """Pairs of a right and a wrong action: keys, turn_no, slot, target_slot, chosen, rejected, pair_type, value, ref_slot, masked, reason.

    Gold actions against the one they are confused with; against a wrong prediction
    (``predictions``: keys, turn_no, slot, pred); NONE for inactive slots that the turn
    seems to mention, or that have a memory. A pair found twice keeps its first type.
    """
    records = computed_once(dialogues, _records=memory_records())
    parts = [F.col(k).cast("string") for k in (*keys, "turn_no")]
    turns = turn_table(records, "taklabels", keys=keys, computed={"_latest": latest_before(F.col("_records"))}).withColumn("masked", X.hash_unit(F.lit(seed), F.lit("mask"), *parts) < mask_share)
    events = turns.select(*keys, "turn_no", "masked", F.posexplode("taklabels").alias("_no", "_e"))
    tokens = S.label_tokens(F.col("_e")["label-2"])
    gold = events.select(*keys, "turn_no", "masked", "_no", F.trim("_e.slot").alias("slot"), S.resolve_label(F.col("_e")["label-1"], tokens, "memory").alias("chosen"), F.trim(F.coalesce("_e.curr_val", F.lit(""))).alias("value"), S.tagged_value(tokens, "refered-slot").alias("ref_slot")).where(F.col("slot") != "")
    last = F.max(F.struct("_no", "masked", "chosen", "value", "ref_slot")).alias("_g")  # of several events of one slot the last counts
    gold = gold.groupBy(*keys, "turn_no", "slot").agg(last).select(*keys, "turn_no", "slot", "_g.masked", "_g.chosen", "_g.value", "_g.ref_slot").where(F.col("chosen").isin(*S.ACTIVE_ACTIONS))
    wrong = F.element_at(F.create_map(*[F.lit(x) for pair in CONFUSED_ACTION.items() for x in pair]), F.col("chosen"))
    columns = [*keys, "turn_no", "slot", "chosen", "rejected", "pair_type", "value", "ref_slot", "masked", "reason"]
    confused = gold.withColumn("rejected", wrong).withColumn("pair_type", F.lit(PAIR_TYPES[0])).withColumn("reason", F.concat(F.lit("taken for "), F.col("rejected"))).select(*columns)
    found = confused
    if predictions is not None:
        told = predictions.select(*keys, "turn_no", "slot", S.normalize_action(F.col("pred")).alias("rejected"))
        missed = gold.join(told, [*keys, "turn_no", "slot"]).where((F.col("rejected") != F.col("chosen")) & (F.col("rejected") != wrong))
        found = found.unionByName(missed.withColumn("pair_type", F.lit(PAIR_TYPES[1])).withColumn("reason", F.lit("wrong prediction")).select(*columns))
    mentioned = surface_mentions(dialogues, slot_descriptions, most=most_surface, least=least_surface, seed=seed, keys=keys).withColumn("masked", X.hash_unit(F.lit(seed), F.lit("mask"), *parts) < mask_share)
    empty = {"value": F.lit(""), "ref_slot": F.lit("")}
    found = found.unionByName(mentioned.withColumns({**empty, "chosen": F.lit("NONE"), "rejected": F.lit("CONSTRAIN"), "pair_type": F.lit(PAIR_TYPES[2]), "reason": F.lit("inactive slot most like the context")}).select(*columns))
    universe = F.array(*[F.lit(s) for s in _universe(slot_descriptions)])
    active = F.coalesce(F.transform("taklabels", lambda e: F.trim(e["slot"])), F.array().cast("array<string>"))
    idle = F.filter("_latest", lambda r: F.array_contains(universe, r["slot"]) & ~F.coalesce(F.array_contains(active, r["slot"]), F.lit(False)))
    remembered = turns.select(*keys, "turn_no", "masked", F.explode(F.slice(idle, 1, most_memory)).alias("_m")).withColumns({**empty, "slot": F.col("_m.slot"), "chosen": F.lit("NONE"), "rejected": F.col("_m.action"), "pair_type": F.lit(PAIR_TYPES[3]), "reason": F.lit("inactive slot with a memory")})
    found = found.unionByName(remembered.select(*columns)).where(F.col("chosen") != F.col("rejected"))
    order = F.array_position(F.array(*[F.lit(t) for t in PAIR_TYPES]), F.col("pair_type"))
    once = found.groupBy(*keys, "turn_no", "slot", "chosen", "rejected").agg(F.min(F.struct(order.alias("o"), "pair_type", "value", "ref_slot", "masked", "reason")).alias("_p"))
    out = once.select(*keys, "turn_no", "slot", "chosen", "rejected", "_p.pair_type", "_p.value", "_p.ref_slot", "_p.masked", "_p.reason")
    return out.withColumn("target_slot", F.when(F.col("masked"), S.mask_slot(F.col("slot"))).otherwise(F.col("slot")))


def pair_layout(pairs: DataFrame, layout: str = "openai", *, prompt: str = "prompt", system: str = "You label what a dialogue turn does to a slot.") -> DataFrame:
    """Preference pairs as training rows: v1 (prompt, chosen, rejected), openai (conversations as roles), alpaca (instruction, input, chosen, rejected)."""
    if layout == "v1":
        return pairs.select(prompt, "chosen", "rejected")
    if layout == "alpaca":
        return pairs.select(F.lit(system).alias("instruction"), F.col(prompt).alias("input"), "chosen", "rejected")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return pairs.select(F.array(message("system", F.lit(system)), message("user", F.col(prompt))).alias("messages"), message("assistant", F.col("chosen")).alias("chosen"), message("assistant", F.col("rejected")).alias("rejected"))
