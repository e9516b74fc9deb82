"""Choosing dialogues: domains allowed, leave-one-domain-out, lists of ids, hash-keyed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as X

ALLOWED = ("restaurant", "attraction", "hotel", "train", "taxi")
BLOCKED = ("hospital", "police")


def domain_set(domains: Column) -> Column:
    """Distinct domains in lower case, trimmed, without blanks; null gives the empty set."""
    plain = F.transform(domains, lambda d: F.lower(F.trim(d)))
    return F.coalesce(F.array_distinct(F.filter(plain, lambda d: d.isNotNull() & (d != ""))), F.array().cast("array<string>"))


def _names(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def allowed_dialogues(dialogues: DataFrame, allowed: tuple[str, ...] = ALLOWED, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """Without dialogues that touch a blocked or an unknown domain."""
    d = domain_set(F.col("domains"))
    return dialogues.where(~F.arrays_overlap(d, _names(blocked)) & (F.size(F.array_except(d, _names((*allowed, *blocked)))) == 0))


def leave_one_out(dialogues: DataFrame, left_out: str, *, part: str = "train", strict: bool = True, targets: tuple[str, ...] = ALLOWED) -> DataFrame:
    """train and dev: dialogues without the domain; test: with it, strict: and with no other target domain."""
    d = domain_set(F.col("domains"))
    if part != "test":
        return dialogues.where(~F.array_contains(d, left_out))
    if strict:
        return dialogues.where(F.array_intersect(d, _names(targets)) == F.array(F.lit(left_out)))
    return dialogues.where(F.array_contains(d, left_out))


def leave_one_out_all(dialogues: DataFrame, targets: tuple[str, ...] = ALLOWED, split: str = "split") -> DataFrame:
    """Every dialogue under each left-out domain it serves, as train, dev or test; one scan, no shuffle."""
    d = domain_set(F.col("domains"))
    each = dialogues.withColumn("left_out", F.explode(_names(targets)))
    within = F.array_contains(d, F.col("left_out"))
    alone = within & (F.size(F.array_intersect(d, _names(targets))) == 1)
    part = F.when(F.col(split).isin("train", "dev") & ~within, F.col(split)).when((F.col(split) == "test") & alone, "test")
    return each.withColumn("part", part).where(F.col("part").isNotNull())


def by_id_lists(dialogues: DataFrame, test_ids: DataFrame, dev_ids: DataFrame, key: str = "dial_id") -> DataFrame:
    """``part``: test if in the test list, else dev if in the dev list, else train."""
    test = test_ids.select(F.col(test_ids.columns[0]).alias(key)).distinct().withColumn("_test", F.lit(True))
    dev = dev_ids.select(F.col(dev_ids.columns[0]).alias(key)).distinct().withColumn("_dev", F.lit(True))
    both = dialogues.join(test, key, "left").join(dev, key, "left")
    return both.withColumn("part", F.when(F.col("_test"), "test").when(F.col("_dev"), "dev").otherwise("train")).drop("_test", "_dev")


def masked_turns(turns: DataFrame, keys: list[str], share: float = 0.3, seed: str = "20251218") -> DataFrame:
    """Turn rows with ``masked``: a fixed choice of the given share by hash."""
    return turns.withColumn("masked", X.hash_bucket(F.lit(seed), F.lit("mask"), *[F.col(k).cast("string") for k in keys]) < int(share * 1000))


def exact_share(rows: DataFrame, key: str, share: float, seed: str = "13") -> DataFrame:
    """``chosen`` for exactly round-half-even(share x rows) rows, those with the smallest hashes.

    The threshold hash is found by counting hash ranges, then ranking inside the one
    range it falls in, so no task sorts the whole table.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))).withColumn("_r", F.substring("_h", 1, 4))
    ranges = hashed.groupBy("_r").agg(F.count("*").alias("_n"))  # at most 65,536
    whole = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limits = ranges.withColumn("_before", before).withColumn("_wanted", F.bround(F.sum("_n").over(whole) * F.lit(share)).cast("long"))
    placed = hashed.join(F.broadcast(limits), "_r")
    edge = (F.col("_before") < F.col("_wanted")) & (F.col("_before") + F.col("_n") > F.col("_wanted"))
    sure = placed.where(~edge).select(*rows.columns, (F.col("_before") < F.col("_wanted")).alias("chosen"))
    ranked = placed.where(edge).withColumn("_k", F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)))
    return sure.unionByName(ranked.select(*rows.columns, (F.col("_k") + F.col("_before") <= F.col("_wanted")).alias("chosen")))
