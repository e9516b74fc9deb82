"""Train, validation and test splits that keep related records together.

Relatedness: the ids of a record name one or more dialogues (:func:`dialogue_keys`).
Keys met in one record are linked; components of keys come from alternating
large-star and small-star steps, each written to the shared folder, over links
between keys only (a record with one key needs none), so a dialogue delivered a
million times is one key, not a million links.

Splits: component swap search. Components start from a hashed assignment and are
then moved or exchanged to lower the deviation of each split's records and of
its records per label from the wanted shares. Components are spread over blocks
of bounded size, every block anneals on its own (several chains, the best is
kept), what remains over all blocks is handed out anew for the next round, and
the best round is kept. Components with over 1/GIANTS of all records, so at most
GIANTS of them, are a block of their own: in every round they are searched first,
against what the other blocks left open in the round before. Whole components
never break.

Defined results: a record without an id of its own is in no pair but gets a split; a null, empty or unreadable id names nothing, so the record is
a component of its own; blank, null and repeated labels don't count; an empty
table gives an empty result; repeated records count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.skew import attach
from turnloom.runtime import small, stored

SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}
#: Corpora that number their dialogues anew for each set of domains.
PER_DOMAIN_MARKS = ("sgl",)
#: Letters before digits in an id that mark a delivery, copy or version, not a corpus.
OTHER_MARKS = ("v", "ver", "version", "rev", "copy", "json", "jsonl", "dump", "part", "take", "raw", "merged", "delivery", "batch")
BLOCK = 4000
GIANTS = 500
ROUNDS = 3
CHAINS = 3
STEPS = 500
#: Moves and exchanges drawn in a step.
PROPOSED = 128
#: Heat of the second chain, as a part of the start's deviation for each component; the third has twice that.
HEAT = 0.05
#: All labels are weighed; a table with more than these is refused.
MOST_LABELS = 1000


def clean_labels(labels: Column) -> Column:
    """Lower case, trimmed, without a plural s, blanks and nulls, distinct and sorted; null labels give the empty list."""
    plain = F.transform(labels, lambda x: F.regexp_replace(F.lower(F.trim(x)), "(?<=[a-z]{3})s$", ""))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(plain, lambda x: x.isNotNull() & (x != "")))), F.array().cast("array<string>"))


def dialogue_keys(dial_id: Column, labels: Column, per_domain: tuple[str, ...] = PER_DOMAIN_MARKS) -> Column:
    """The dialogues an id names, each as mark:number, or file_index where it has no letters; with the labels for ``per_domain`` marks."""
    base = F.regexp_replace(F.lower(F.trim(dial_id)), r"^.*[/\\]", "")
    marked = F.filter(F.regexp_extract_all(base, F.lit(r"[a-z]+[ _-]*[0-9]+"), F.lit(0)), lambda x: ~F.regexp_extract(x, "^[a-z]+", 0).isin(*OTHER_MARKS))
    marked = F.transform(marked, lambda x: F.concat(F.regexp_extract(x, "^[a-z]+", 0), F.lit(":"), F.regexp_extract(x, "0*([0-9]+)$", 1)))
    if per_domain:
        marked = F.transform(marked, lambda x: F.when(F.substring_index(x, ":", 1).isin(*per_domain), F.concat(x, F.lit("|"), F.array_join(labels, ","))).otherwise(x))
    numbered = F.transform(
        F.regexp_extract_all(base, F.lit(r"(?<![0-9a-z])[0-9]+[_-][0-9]+(?![0-9])"), F.lit(0)),
        lambda x: F.concat(F.regexp_extract(x, "^0*([0-9]+)", 1), F.lit("_"), F.regexp_extract(x, "0*([0-9]+)$", 1)),
    )
    return F.coalesce(F.array_distinct(F.when(F.size(marked) > 0, marked).otherwise(numbered)), F.array().cast("array<string>"))


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (columns a, b, any order); root is the component's least node."""
    edges = stored(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_n")), "least-neighbours")
        large = attach(both.where(F.col("b") > F.col("a")), least, ["a"]).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = stored(large, "large-star")
        small_side = stored(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("_n")), "small-sides")
        small = attach(large, small_side, ["b"]).select(F.col("m").alias("m"), F.explode(F.array("a", "b")).alias("v")).where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def related_records(records: DataFrame, *, record: str = "rec_id", dial_id: str = "dial_id", labels: str = "domains") -> DataFrame:
    """record, component, labels of all records; ``component`` is a key, or the record itself where its id names nothing."""
    cleaned = records.select(F.col(record).alias("record"), F.col(dial_id).cast("string").alias("_id"), clean_labels(F.col(labels)).alias("labels"))
    keyed = stored(cleaned.select("record", "labels", dialogue_keys(F.col("_id"), F.col("labels")).alias("keys")), "record-keys")
    many = keyed.where(F.size("keys") > 1).select(F.explode(F.slice("keys", 2, 2**31 - 2)).alias("b"), F.col("keys")[0].alias("a"))
    roots = components(many)
    first = keyed.select("record", "labels", F.get("keys", F.lit(0)).alias("node"))
    counts = first.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("_n"))
    merged = stored(counts.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"), "_n"), "key-roots")
    named = attach(first.where(F.col("node").isNotNull()), merged, ["node"]).select("record", "component", "labels")
    alone = first.where(F.col("node").isNull()).select("record", F.concat(F.lit("record:"), F.coalesce(F.col("record").cast("string"), F.lit("null"))).alias("component"), "labels")
    return named.unionByName(alone)


def kept_pairs(assigned: DataFrame, *, record: str = "rec_id") -> DataFrame:
    """For each component of two or more records of :func:`keep_together` its smallest record (a) with each other (b)."""
    grouped = stored(assigned.select(F.col(record).alias("record"), "component"), "assigned-records")
    groups = grouped.groupBy("component").agg(F.min("record").alias("least"), F.count("*").alias("_n")).where("_n > 1")
    kept = attach(grouped, stored(groups, "components"), ["component"])
    return kept.where(F.col("record") != F.col("least")).select(F.col("least").alias(f"{record}_a"), F.col("record").alias(f"{record}_b"))


def related_pairs(records: DataFrame, *, record: str = "rec_id", **columns: str) -> DataFrame:
    """:func:`kept_pairs` of the records given to splits by :func:`keep_together`."""
    return kept_pairs(keep_together(records, record=record, **columns), record=record)


def anneal(weights: np.ndarray, targets: np.ndarray, start: np.ndarray, seed: int, chains: int = CHAINS, steps: int = STEPS) -> np.ndarray:
    """A split for each row of ``weights`` (components x dimensions) with sums close to ``targets`` (splits x dimensions).

    Every step draws some moves and exchanges and takes one of them, or none, by the heat: the likelier the more it gains.
    """
    n, splits = len(weights), len(targets)
    scale = 1.0 / (targets.sum(axis=0) + 1.0)
    off = np.stack([weights[start == s].sum(axis=0) for s in range(splits)]) - targets
    best, best_energy = start, float((off * off * scale).sum())
    for chain in range(chains):
        rng = np.random.default_rng(seed + chain)
        at = start.copy()
        off = np.stack([weights[at == s].sum(axis=0) for s in range(splits)]) - targets
        energy = float((off * off * scale).sum())
        hot = HEAT * chain * energy / max(1, n)  # the first chain only descends
        for step in range(steps):
            k = min(PROPOSED, 4 * n)
            i, j = rng.integers(0, n, k), rng.integers(0, n, k)
            swap = rng.random(k) < 0.5
            to = np.where(swap, at[j], rng.integers(0, splits, k))
            ok = np.flatnonzero((to != at[i]) & (i != j) | ((n == 1) & ~swap & (to != at[i])))
            if not len(ok):
                continue
            i, j, to, swap = i[ok], j[ok], to[ok], swap[ok]
            moved = weights[i] - np.where(swap[:, None], weights[j], 0.0)
            gain = (moved * (2 * off[to] + moved) * scale).sum(axis=1) + (moved * (moved - 2 * off[at[i]]) * scale).sum(axis=1)
            heat = hot * (1 - step / steps) ** 3
            p = int((gain - heat * rng.gumbel(size=len(gain))).argmin()) if heat > 0 else int(gain.argmin())
            if gain[p] < (heat * rng.gumbel() if heat > 0 else 0):
                a, s = int(i[p]), int(to[p])
                off[at[a]] -= moved[p]
                off[s] += moved[p]
                if swap[p]:
                    at[int(j[p])] = at[a]
                at[a] = s
                energy += float(gain[p])
                if energy < best_energy * (1 - 1e-9):
                    best, best_energy = at.copy(), energy
    return best


def _hashed(unit: np.ndarray, shares: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(np.cumsum(shares), unit, side="right"), len(shares) - 1)


def _unit(component: str) -> Column:
    """The place from 0 to 1 of a component in the hashed start."""
    return F.pmod(F.xxhash64(F.lit("start"), component), F.lit(1_000_003)) / 1_000_003.0


def split_components(sizes: DataFrame, n_labels: int, shares: dict[str, float] | None = None) -> DataFrame:
    """component, split for ``sizes``: component, weights (records, then records per label). Read repeatedly: hand in a stored table."""
    shares = shares or SHARES
    names, wanted = list(shares), np.array(list(shares.values()), dtype=float)
    wanted = wanted / wanted.sum()
    width = 1 + n_labels
    spark = sizes.sparkSession
    sums = [F.sum(F.col("weights")[k]).alias(f"s{k}") for k in range(width)]
    row = sizes.agg(F.count("*").alias("n"), *sums).first()
    if not row["n"]:
        return sizes.select("component", F.lit(None).cast("string").alias("split"))
    total = np.array([float(row[f"s{k}"]) for k in range(width)])
    goal = wanted[:, None] * total[None, :]
    big = F.col("weights")[0] > total[0] / GIANTS
    giants = sizes.where(big).withColumn("_unit", _unit("component")).orderBy("component").limit(GIANTS).collect()
    heavy = np.array([g["weights"] for g in giants], dtype=float).reshape(len(giants), width)
    at = _hashed(np.array([g["_unit"] for g in giants], dtype=float), wanted)
    others = sizes.where(~big)
    blocks = max(1, int(np.ceil((row["n"] - len(giants)) / BLOCK)))
    rest = total - heavy.sum(axis=0)
    best, best_at, best_energy, debt = None, at, np.inf, np.zeros_like(goal)
    got = wanted[:, None] * rest[None, :]
    for attempt in range(ROUNDS):
        if giants:
            at = anneal(heavy, goal - got, at, 7_000_000 + attempt * 100)
        placed = np.stack([heavy[at == s].sum(axis=0) for s in range(len(names))])
        left = goal - placed
        done = None
        if rest[0] > 0:
            share_left = np.where(rest[None, :] > 0, left / np.maximum(rest[None, :], 1e-9), wanted[:, None])
            extra = debt / blocks

            def run(pdf: pd.DataFrame) -> pd.DataFrame:  # sent out within this round, so the names below are this round's
                ratio = share_left
                pdf = pdf.sort_values("component", kind="stable")
                weights = np.stack(pdf["weights"].to_numpy()).astype(float)
                targets = ratio * weights.sum(axis=0)[None, :] - extra
                seed = int(pdf["_block"].iloc[0]) * 1000 + attempt * 100
                first = _hashed(pdf["_unit"].to_numpy(), np.clip(ratio[:, 0], 0, None) / max(1e-9, np.clip(ratio[:, 0], 0, None).sum()))
                return pd.DataFrame({"component": pdf["component"], "split": [names[s] for s in anneal(weights, targets, first, seed)], "weights": pdf["weights"]})

            salted = others.withColumn("_block", F.pmod(F.xxhash64("component", F.lit(attempt)), F.lit(blocks)).cast("int")).withColumn("_unit", _unit("component"))
            tasks = min(blocks, 4 * spark.sparkContext.defaultParallelism)  # a few small rows are much work, so they aren't put into one task
            done = stored(salted.repartition(tasks, "_block").groupBy("_block").applyInPandas(run, "component string, split string, weights array<bigint>"), "assigned")
            got = np.zeros_like(left)
            for r in done.groupBy("split").agg(*sums).collect():  # one row per split
                got[names.index(r["split"])] = [float(r[f"s{k}"]) for k in range(width)]
            debt = debt + got - left
        off = got + placed - goal
        energy = float((off * off / (total + 1)).sum())
        if energy < best_energy:
            best, best_at, best_energy = done, at, energy
        if np.abs(off).max() < 1:
            break
    giant_rows = spark.createDataFrame([(g["component"], names[s]) for g, s in zip(giants, best_at)], "component string, split string")
    return giant_rows if best is None else best.select("component", "split").unionByName(giant_rows)


def keep_together(records: DataFrame, shares: dict[str, float] | None = None, *, record: str = "rec_id", **columns: str) -> DataFrame:
    """``record``, component, assigned split of every record; all records of a component share one split."""
    grouped = stored(related_records(records, record=record, **columns), "related")
    labels = [r["l"] for r in small(grouped.select(F.explode("labels").alias("l")).groupBy("l").count().orderBy(F.col("count").desc(), "l"), MOST_LABELS)]
    weights = F.array(F.count("*"), *[F.sum(F.array_contains("labels", l).cast("long")) for l in labels])
    sizes = stored(grouped.groupBy("component").agg(weights.alias("weights"), F.count("*").alias("_n")), "component-sizes")
    split = split_components(sizes.select("component", "weights"), len(labels), shares)
    per_key = stored(split.join(sizes.select("component", "_n"), "component"), "component-splits")
    return attach(grouped.select("record", "component", "labels"), per_key, ["component"]).select(F.col("record").alias(record), "component", "labels", F.col("split").alias("assigned_split"))


def split_report(assigned: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Records per label ('' = all) and split, with the share of the label's records, and the records the hashed start gives the split."""
    shares = shares or SHARES
    limits = np.cumsum(list(shares.values())) / sum(shares.values())
    start = F.lit(list(shares)[-1])
    for name, limit in reversed(list(zip(shares, limits[:-1]))):
        start = F.when(_unit("component") < float(limit), name).otherwise(start)
    both = assigned.select("labels", F.explode(F.array(F.struct(F.col("assigned_split").alias("split"), F.lit(1).alias("now")), F.struct(start.alias("split"), F.lit(0).alias("now")))).alias("x"))
    counts = both.select("x.split", "x.now", F.explode(F.concat(F.array(F.lit("")), F.col("labels"))).alias("label")).groupBy("label", F.col("split").alias("assigned_split")).agg(F.sum(F.col("now").cast("long")).alias("n_records"), F.sum((1 - F.col("now")).cast("long")).alias("n_hashed"))
    return counts.withColumn("share", F.col("n_records") / F.sum("n_records").over(Window.partitionBy("label")))
