"""Deterministic choices keyed by hashes: the same rows are chosen whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import slots as S
from turnloom.functions import text as X
from turnloom.runtime import small

#: Slot types that are easily taken for each other, and slots that homonyms of taxi places evoke.
CONFUSABLE = {
    "departure": ("destination",),
    "destination": ("departure",),
    "leaveat": ("arriveby",),
    "arriveby": ("leaveat",),
    "area": ("name",),
    "name": ("area", "type"),
    "type": ("name",),
}
TAXI_HOMONYMS = ("hotel-name", "attraction-name")
CONFUSION_BOOST = 3.0
#: How often a model wrongly activated the slot; used as sampling weights.
SLOT_WEIGHTS = {
    "attraction-area": 43,
    "attraction-type": 18,
    "attraction-name": 4,
    "hotel-type": 133,
    "hotel-pricerange": 125,
    "hotel-area": 85,
    "hotel-name": 65,
    "hotel-stars": 55,
    "hotel-internet": 34,
    "hotel-parking": 24,
    "hotel-book day": 23,
    "hotel-book people": 18,
    "hotel-book stay": 17,
    "restaurant-name": 53,
    "restaurant-area": 28,
    "restaurant-food": 26,
    "restaurant-book people": 15,
    "restaurant-pricerange": 14,
    "restaurant-book day": 13,
    "restaurant-book time": 11,
    "taxi-departure": 24,
    "taxi-destination": 23,
    "taxi-arriveby": 12,
    "taxi-leaveat": 7,
    "train-leaveat": 37,
    "train-departure": 32,
    "train-book people": 32,
    "train-arriveby": 29,
    "train-destination": 28,
    "train-day": 19,
}


def slot_weight(slot: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SLOT_WEIGHTS.items() for x in pair]), slot), F.lit(1))


def sampling_key(weight: Column, *parts: Column) -> Column:
    """Exponential keys: the k smallest are a weighted sample without replacement."""
    unit = (X.hash_unit(*parts) * 4294967295.0 + 0.5) / 4294967296.0
    return -F.ln(unit) / weight


def weighted_sample(rows: DataFrame, group: list[str], item: str, weight: Column, k: Column | int, seed: str = "13") -> DataFrame:
    """Up to ``k`` rows of each group, drawn by weight; the window's group limit keeps k rows per task before the shuffle."""
    key = sampling_key(weight, F.lit(seed), *[F.col(g).cast("string") for g in group], F.col(item).cast("string"))
    ranked = rows.withColumn("_key", key).withColumn("pick_no", F.row_number().over(Window.partitionBy(*group).orderBy("_key", item)))
    return ranked.where(F.col("pick_no") <= k).drop("_key")


def hash_argmin(rows: DataFrame, group: list[str], item: str, seed: str) -> DataFrame:
    """The item of each group with the smallest MD5."""
    key = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(g).cast("string") for g in group], F.col(item)))
    return rows.groupBy(*group).agg(F.min_by(item, key).alias(item))


def ranked_first(rows: DataFrame, group: list[str], tier: Column, rank: Column, carry: list[str]) -> DataFrame:
    """The best row of each group: lowest tier, then lowest rank."""
    best = F.min(F.struct(tier.alias("tier"), rank.alias("rank"), *[F.col(c) for c in carry])).alias("_b")
    return rows.groupBy(*group).agg(best).select(*group, "_b.tier", *[F.col("_b")[c].alias(c) for c in carry])


def bernoulli(share: float, *parts: Column) -> Column:
    """A fixed choice of about ``share`` of all rows by hash."""
    return X.hash_unit(*parts) < share


def negative_candidates(active: Column, slots: DataFrame, keys: list[str], seed: str = "13") -> Column:
    """The inactive slots as structs of tier, key and slot, the one to take first in front.

    Confusable slots come first, then slots of the active slots' domains (those confusable
    weighted ``CONFUSION_BOOST``), then any; within a tier by weighted hash keys. The slot
    table (fixed, tens of rows) travels in the expression, so nothing is shuffled.
    """
    universe = sorted(r["slot"] for r in small(slots.select("slot").distinct(), 1000))
    split = {s: s.split("-", 1) for s in universe if "-" in s}
    enemies = {s: [e for e in universe if e in split and split[e][0] == d and split[e][1] in CONFUSABLE.get(k, ())] for s, (d, k) in split.items()}
    homonyms = {s: [h for h in TAXI_HOMONYMS if h in universe] for s in ("taxi-departure", "taxi-destination") if s in universe}
    empty = F.array().cast("array<string>")
    act = F.filter(F.coalesce(active, empty), lambda a: a.isNotNull())
    domains = F.array_distinct(F.transform(act, S.domain_of))
    parts = [F.col(k).cast("string") for k in keys]

    def named(table: dict[str, list[str]], s: str) -> Column:
        sources = [a for a, es in table.items() if s in es]
        return F.arrays_overlap(act, F.array(*[F.lit(a) for a in sources])) if sources else F.lit(False)

    rows = []
    for s in universe:
        enemy = named(enemies, s)
        first = enemy | named(homonyms, s)
        same = F.array_contains(domains, split.get(s, [""])[0])
        tier = F.when(first, 0).when(same, 1).otherwise(2)
        weight = F.lit(float(SLOT_WEIGHTS.get(s, 1))) * F.when(enemy & ~first, CONFUSION_BOOST).otherwise(1.0)
        rows.append(F.when(~F.array_contains(act, s), F.struct(tier.alias("tier"), sampling_key(weight, F.lit(seed), *parts, F.lit(s)).alias("key"), F.lit(s).alias("slot"))))
    return F.array_sort(F.filter(F.array(*rows), lambda r: r.isNotNull()))


def negative_slot_array(active: Column, slots: DataFrame, keys: list[str], seed: str = "13") -> Column:
    """One or two inactive slots, by hash; a slot of no related kind only where there is no other."""
    pool = negative_candidates(active, slots, keys, seed)
    usable = F.filter(pool, lambda r: r["tier"] < 2)
    count = F.when(X.hash_unit(F.lit(seed), F.lit("count"), *[F.col(k).cast("string") for k in keys]) < 0.5, 1).otherwise(2)
    return F.transform(F.when(F.size(usable) > 0, F.slice(usable, F.lit(1), count)).otherwise(F.slice(pool, 1, 1)), lambda r: r["slot"])


def negative_slots(turns: DataFrame, slots: DataFrame, *, keys: list[str], active: str = "active", seed: str = "13") -> DataFrame:
    """The negative slots of each turn: keys, slot, pick_no."""
    return turns.select(*keys, F.posexplode(negative_slot_array(F.col(active), slots, keys, seed)).alias("_at", "slot")).select(*keys, "slot", (F.col("_at") + 1).alias("pick_no"))
