"""Scoring predicted against gold sets, labels and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _set(c: str) -> Column:
    return F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()))


def compared(rows: DataFrame, gold: str = "gold", pred: str = "pred", *, skip_empty_gold: bool = True, skipped: Column | None = None) -> DataFrame:
    """The rows that count, with tp_slots, missing and extra. Rows without gold (or, else, without both) don't count, nor do ``skipped`` ones."""
    kept = rows.withColumn(gold, _set(gold)).withColumn(pred, _set(pred))
    kept = kept.where(F.size(gold) > 0 if skip_empty_gold else (F.size(gold) > 0) | (F.size(pred) > 0))
    if skipped is not None:
        kept = kept.where(~F.coalesce(skipped, F.lit(False)))
    return kept.select("*", F.array_intersect(gold, pred).alias("tp_slots"), F.array_sort(F.array_except(gold, pred)).alias("missing"), F.array_sort(F.array_except(pred, gold)).alias("extra"))


def scores(tp: Column, fp: Column, fn: Column, digits: int = 6) -> list[Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.bround(p, digits).alias("precision"), F.bround(r, digits).alias("recall"), F.bround(f, digits).alias("f1")]


def slot_scores(counted: DataFrame) -> DataFrame:
    """slot (null: all together), n_gold, n_pred, tp, fp, fn, precision, recall, f1, in one pass by grouping sets."""

    def tagged(column: str, kind: str) -> Column:
        return F.transform(column, lambda s: F.struct(s.alias("slot"), F.lit(kind).alias("kind")))

    hits = counted.select(F.explode(F.concat(tagged("tp_slots", "tp"), tagged("extra", "fp"), tagged("missing", "fn"))).alias("h")).select("h.*")
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    sums = hits.groupingSets([["slot"], []], "slot").agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("slot", (tp + fn).alias("n_gold"), (tp + fp).alias("n_pred"), "tp", "fp", "fn", *scores(tp, fp, fn))


def exact_set_accuracy(counted: DataFrame) -> DataFrame:
    """evaluated, correct, accuracy of the rows whose sets agree."""
    right = (F.size("missing") == 0) & (F.size("extra") == 0)
    return counted.agg(F.count("*").alias("evaluated"), F.count(F.when(right, 1)).alias("correct")).withColumn("accuracy", F.coalesce(F.bround(F.try_divide(F.col("correct").cast("double"), F.col("evaluated")), 6), F.lit(0.0)))


def error_type() -> Column:
    return F.when((F.size("missing") > 0) & (F.size("extra") == 0), "miss_only").when((F.size("missing") == 0) & (F.size("extra") > 0), "extra_only").when(F.size("missing") > 0, "miss_and_extra")


def error_types(counted: DataFrame) -> DataFrame:
    return counted.withColumn("error_type", error_type()).where("error_type is not null").groupBy("error_type").agg(F.count("*").alias("n"))


def error_sizes(counted: DataFrame) -> DataFrame:
    """n_missing, n_extra, n of the rows in error."""
    return counted.where(error_type().isNotNull()).groupBy(F.size("missing").alias("n_missing"), F.size("extra").alias("n_extra")).agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent keys, ties by key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(n)


def error_sample(counted: DataFrame, keys: list[str], n: int = 200) -> DataFrame:
    """The first ``n`` rows in error, by ``keys``."""
    return counted.where(error_type().isNotNull()).select(*keys, "missing", "extra").orderBy(*keys).limit(n)


def label_accuracy(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    right = F.coalesce(F.col(gold) == F.col(pred), F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.count(F.when(right, 1)).alias("correct")).withColumn("accuracy", F.coalesce(F.bround(F.try_divide(F.col("correct").cast("double"), F.col("n")), 6), F.lit(0.0)))


def coverage_at_k(rows: DataFrame, gold: str, ranked: str, k: int) -> DataFrame:
    """The share of rows with gold whose gold is all among the first ``k``."""
    counted = rows.withColumn("_g", _set(gold)).where(F.size("_g") > 0)
    whole = F.size(F.array_except("_g", F.slice(F.coalesce(F.col(ranked), F.array().cast("array<string>")), 1, k))) == 0
    return counted.agg(F.count("*").alias("n"), F.count(F.when(whole, 1)).alias("covered")).withColumn("coverage", F.coalesce(F.bround(F.try_divide(F.col("covered").cast("double"), F.col("n")), 6), F.lit(0.0)))


def joint_goal_accuracy(rows: DataFrame, gold_state: str, pred_state: str, counted: Column | None = None) -> DataFrame:
    """The share of (counted) turns whose predicted state is the gold state, none-values aside."""
    from turnloom.functions.text import none_or_empty

    entries = lambda c: F.array_sort(F.map_entries(F.map_filter(F.coalesce(F.col(c), F.create_map().cast("map<string,string>")), lambda k, v: ~none_or_empty(v))))
    kept = rows if counted is None else rows.where(counted)
    hit = entries(gold_state) == entries(pred_state)
    return kept.agg(F.count("*").alias("n_turns"), F.count(F.when(hit, 1)).alias("n_hits")).withColumn("jga", F.coalesce(F.bround(F.try_divide(F.col("n_hits").cast("double"), F.col("n_turns")), 6), F.lit(0.0)))


def activation_recheck(dialogues: DataFrame, predictions: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Turns with a prediction (keys, turn_no, pred) beside the slots whose state value changed in the prediction's domain: ready for :func:`compared`."""
    from turnloom.functions.slots import canonical_slot, domain_of
    from turnloom.operators.state import delta
    from turnloom.operators.turns import turn_table

    turns = turn_table(dialogues, "slot_values", keys=keys, before=("slot_values",))
    told = predictions.where(F.size("pred") > 0).select(*keys, "turn_no", F.transform("pred", canonical_slot).alias("pred"))
    changed = F.transform(delta(F.col("before_slot_values"), F.col("slot_values"), "recheck"), lambda d: d["slot"])
    both = turns.select(*keys, "turn_no", changed.alias("_changed")).join(told, [*keys, "turn_no"])
    domain = F.get(F.filter(F.transform("pred", domain_of), lambda d: d != ""), F.lit(0))
    return both.select(*keys, "turn_no", F.array_distinct(F.when(domain.isNull(), F.col("_changed")).otherwise(F.filter("_changed", lambda s: domain_of(s) == domain))).alias("gold"), "pred")
