"""Filling fixed-capacity containers with items of varying length.

A configuration linear program over the histogram of lengths: each variable is
a configuration (how many items of each length share one container), the cover
constraints ask that all items are placed, the number of containers is least.

:func:`cover` solves it by multiplicative weights. A length's price falls with
the part of its items covered so far. In every round a knapsack dynamic program
prices all configurations at once: prices divided by the worth of the best one
are a dual solution, which bounds the program from below, and tracing it back
gives configurations within ``SLACK`` of the best, the least covered lengths
first. Rounds go on until cover and dual bound are within ``NEAR``.

:func:`rounded` makes the fractional cover whole: configurations get the whole
numbers their running sum passes, a length that has run out is replaced by the
next shorter one left, and room that stays is filled by a bounded knapsack over
what is left. Items no configuration reached are filled the same way; the plan
tells how many containers those are. Of two orders of rounding the better is kept.

Only the histogram reaches the driver, at most ``capacity`` rows whatever the
corpus; rounds and configurations depend on it alone. The items learn their
container from their rank among the items of equal length, which is counted in
hashed slices, so a length shared by a third of all rows is no hot group.

Defined results: items longer than the capacity are split into full pieces and
one rest, shorter items stay whole; items of length 0 or null get no place;
repeated rows are separate items; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.tokens import DEFAULT_RANKS, count_column
from turnloom.runtime import stored

CAPACITY = 4096
SLICES = 128
#: Configurations added between two pricings, and pricings in which they come to about one cover.
BATCH = 100
PASSES = 40
#: Covers added at most; the gap to the dual bound falls with their number.
COVERS = 6
#: How fast a length's price falls with its cover.
RATE = 1.0
#: A configuration is used if it is worth this much less than the best at most.
SLACK = 0.05
#: The rounds end when the cover is this near to the dual bound.
NEAR = 0.01
#: Part of the first prices that goes by size alone.
SHARED = 0.03
#: Containers of the rounded plan with more room than this part are filled anew.
MENDED = 0.02
TILTS = (0.05, 1.0, 3.0)


def knapsack(sizes: np.ndarray, counts: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size to take (at most ``counts``) for the greatest total worth within ``capacity``."""
    most = np.minimum(counts, capacity // sizes)
    best = np.zeros(capacity + 1)
    bundles: list[tuple[int, int]] = []
    taken: list[np.ndarray] = []
    for k in np.flatnonzero(most > 0):
        left, bundle = int(most[k]), 1
        while left > 0:
            n = min(bundle, left)
            width, value = int(sizes[k]) * n, float(worth[k]) * n
            with_it = best[: capacity + 1 - width] + value
            better = with_it > best[width:] + 1e-12
            if better.any():
                best[width:][better] = with_it[better]
                bundles.append((int(k), n))
                row = np.zeros(capacity + 1, dtype=bool)
                row[width:] = better
                taken.append(np.packbits(row))
            left -= n
            bundle *= 2
    chosen, room = np.zeros(len(sizes), dtype=np.int64), capacity
    for (k, n), row in zip(reversed(bundles), reversed(taken)):
        if row[room >> 3] >> (7 - (room & 7)) & 1:
            chosen[k] += n
            room -= int(sizes[k]) * n
    return chosen


def priced(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest worth within each room from 0 to ``capacity``; ``sizes`` descend, any number of each may be taken."""
    best = np.zeros(capacity + 1)
    first = len(sizes) - np.searchsorted(sizes[::-1], np.arange(capacity + 1), side="right")
    for room in range(int(sizes[-1]), capacity + 1):
        k = first[room]
        best[room] = max(best[room - 1], (best[room - sizes[k:]] + worth[k:]).max())
    return best


def first_prices(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """A dual solution to begin with: for the best limit, items that leave less room than it count 1, shorter ones than it 0, the rest by size."""
    limits = np.concatenate([[0], sizes[2 * sizes <= capacity]])
    worth = lambda limit: np.where(sizes > capacity - limit, 1.0, np.where(sizes < limit, 0.0, sizes / capacity))
    return worth(max(limits, key=lambda limit: (float((worth(limit) * counts).sum()), -limit)))


@dataclass
class Cover:
    """A fractional cover: (size number, items of it) of each configuration, its amount, and bounds of the program."""

    configurations: list[tuple[tuple[int, int], ...]] = field(default_factory=list)
    amounts: list[float] = field(default_factory=list)
    containers: float = 0.0
    bound: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def cover(sizes: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rate: float = RATE, covers: int = COVERS) -> Cover:
    """The configuration program of ``sizes`` (descending) solved by multiplicative weights."""
    n, by_size = counts.astype(float), sizes / capacity
    first = len(sizes) - np.searchsorted(sizes[::-1], np.arange(capacity + 1), side="right")
    covered, amounts, out = np.zeros(len(sizes)), {}, Cover()
    start = first_prices(sizes, counts, capacity)
    out.bound = float((n * start).sum())
    start = (1 - SHARED) * start + SHARED * by_size  # a price of nothing could never rise
    amount = out.bound / (PASSES * BATCH)
    used = 0.0
    for _ in range(covers * PASSES):
        weights = start * np.exp(-rate * (covered - covered.mean()))
        best = priced(sizes, weights, capacity)
        weights, best = weights / best[capacity], best / best[capacity]
        out.bound = max(out.bound, float((n * weights).sum()))  # no configuration is worth over 1 now: a dual solution
        held = weights + best[capacity - sizes]  # worth of the best configuration that has the size
        good = np.flatnonzero(held >= 1 - SLACK)
        for _ in range(BATCH):
            k = int(good[covered[good].argmin()])
            room, slack, config = capacity, SLACK - (1 - held[k]), {}
            while True:
                config[k] = config.get(k, 0) + 1
                room -= int(sizes[k])
                covered[k] += amount / n[k]
                top = best[room]
                while True:
                    j = first[room]
                    worth = weights[j:] + best[room - sizes[j:]]
                    near = np.flatnonzero(worth >= top - max(slack, 0.0) / 2 - 1e-12)
                    if len(near) or j >= len(sizes):
                        break
                    room -= 1  # the best within this room leaves a part of it empty
                if not len(near):
                    break
                i = int(near[covered[j:][near].argmin()])
                if top <= slack and covered[j + i] * PASSES * BATCH > used / amount:
                    break  # rather leave the room empty than cover what is covered
                slack -= top - worth[i]
                k = j + i
            key = tuple(sorted(config.items()))
            amounts[key] = amounts.get(key, 0.0) + amount
            used += amount
        if covered.min() > 0 and used / covered.min() <= out.bound * (1 + NEAR):
            break
    scale = 1 / covered.min() if covered.min() > 0 else 1.0
    out.configurations, out.amounts = list(amounts), [a * scale for a in amounts.values()]
    out.containers, out.weights = used * scale, weights
    return out


@dataclass
class Plan:
    """(items of each size, number of containers), exactly the histogram; ``by_program`` containers come from configurations of the program."""

    steps: list[tuple[dict[int, int], int]] = field(default_factory=list)
    by_program: int = 0
    containers: int = 0
    bound: float = 0.0
    fractional: float = 0.0


def rounded(sizes: np.ndarray, counts: np.ndarray, solution: Cover, order: list[int], capacity: int = CAPACITY) -> Plan:
    """Whole containers for all items along the fractional ``solution``, its configurations taken in ``order``."""
    plan = Plan(bound=solution.bound, fractional=solution.containers)
    left = counts.copy()

    def add(chosen: dict[int, int], times: int) -> int:
        """The items wanted, the next shorter ones where they have run out, and what fills the room; as often as they last."""
        take = np.zeros(len(sizes), dtype=np.int64)
        for k, wanted in sorted(chosen.items()):
            while wanted:
                got = min(wanted, int(left[k] - take[k]))
                take[k] += got
                wanted -= got
                if wanted:
                    more = np.flatnonzero(left[k + 1 :] > take[k + 1 :])
                    if not len(more):
                        break
                    k += 1 + int(more[0])
        room = capacity - int((take * sizes).sum())
        fits = np.flatnonzero((sizes <= room) & (left > take))
        if len(fits):
            take[fits] += knapsack(sizes[fits], (left - take)[fits], sizes[fits] / capacity, room)
        some = np.flatnonzero(take)
        if not len(some):
            return 0
        times = min(times, int((left[some] // take[some]).min()))
        left[some] -= take[some] * times
        plan.steps.append(({int(sizes[k]): int(take[k]) for k in some}, times))
        plan.containers += times
        return times

    passed = 0.0
    for place in order:
        config, amount = solution.configurations[place], solution.amounts[place]
        times = int(np.floor(passed + amount + 1e-9)) - int(np.floor(passed + 1e-9))
        passed += amount
        while times > 0 and (done := add(dict(config), times)):
            times -= done
            plan.by_program += done
    while left.any():
        add({k: int(v) for k, v in enumerate(knapsack(sizes, left, solution.weights, capacity)) if v}, int(left.max()))
    return plan


def mended(sizes: np.ndarray, plan: Plan, capacity: int = CAPACITY) -> Plan:
    """Containers with over MENDED of room are emptied and filled anew, larger items first in different degrees, if that saves some."""
    place = {int(s): k for k, s in enumerate(sizes)}
    filled = [sum(s * n for s, n in config.items()) for config, _ in plan.steps]
    kept = [step for step, f in zip(plan.steps, filled) if f >= capacity * (1 - MENDED)]
    loose = [step for step, f in zip(plan.steps, filled) if f < capacity * (1 - MENDED)]
    items = np.zeros(len(sizes), dtype=np.int64)
    for config, times in loose:
        for s, n in config.items():
            items[place[s]] += n * times
    best, n_loose = loose, sum(t for _, t in loose)
    for tilt in TILTS if n_loose > 1 else ():
        worth, left, steps = sizes / capacity * (1 + tilt * sizes / capacity), items.copy(), []
        while left.any():
            chosen = knapsack(sizes, left, worth, capacity)
            some = np.flatnonzero(chosen)
            times = int((left[some] // chosen[some]).min())
            left[some] -= chosen[some] * times
            steps.append(({int(sizes[k]): int(chosen[k]) for k in some}, times))
        if sum(t for _, t in steps) < sum(t for _, t in best):
            best = steps
    return Plan(kept + best, plan.by_program - (n_loose if best is not loose else 0), plan.containers - n_loose + sum(t for _, t in best), plan.bound, plan.fractional)


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan of containers for ``histogram`` (items of each size up to ``capacity``): the better of two orders of rounding, mended."""
    sizes = np.array(sorted((s for s, n in histogram.items() if n > 0), reverse=True), dtype=np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    if not len(sizes):
        return Plan()
    solution = cover(sizes, counts, capacity)
    as_found = list(range(len(solution.amounts)))
    plans = [rounded(sizes, counts, solution, order, capacity) for order in (as_found, sorted(as_found, key=lambda i: solution.configurations[i]))]
    return min((mended(sizes, p, capacity) for p in plans), key=lambda p: p.containers)


def fill_containers(items: DataFrame, *, id_column: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """``id_column``, piece_no, first_token, n_tokens, container_id, place for every piece of every item.

    ``items`` is read twice (histogram, placing): hand in a stored table.
    """
    return _placed(items, id_column, size, capacity)[0]


def _placed(items: DataFrame, id_column: str, size: str, capacity: int) -> tuple[DataFrame, Plan]:
    n, whole = F.col("_size"), F.lit(capacity)
    pieces = (
        items.select(F.col(id_column).alias("_id"), F.col(size).cast("long").alias("_size"))
        .where(n > 0)
        .select("_id", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / whole) - 1)).alias("piece_no"))
        .select("_id", "piece_no", (F.col("piece_no") * whole).alias("first_token"), F.least(whole.cast("long"), n - F.col("piece_no") * whole).alias("_part"))
        .withColumn("_slice", F.pmod(F.xxhash64("_id", "piece_no"), F.lit(SLICES)).cast("int"))
    )
    slices = stored(pieces.groupBy("_part", "_slice").agg(F.count("*").alias("_n")), "length-slices")
    histogram = {r["_part"]: r["n"] for r in slices.groupBy("_part").agg(F.sum("_n").alias("n")).collect()}
    plan = configurations(histogram, capacity)

    base, next_rank, rows = 0, dict.fromkeys(histogram, 0), []
    for config, times in plan.steps:
        place = 0
        for part in sorted(config, reverse=True):
            rows.append((part, next_rank[part], base, config[part], place))
            next_rank[part] += config[part] * times
            place += config[part]
        base += times
    rows.sort()
    starts = pd.DataFrame(rows, columns=["part", "rank", "base", "each", "place"], dtype="int64")
    ranks_of = {int(p): (g["rank"].to_numpy(), g["base"].to_numpy(), g["each"].to_numpy(), g["place"].to_numpy()) for p, g in starts.groupby("part")}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            container, place = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            parts, ranks = batch.column("n_tokens").to_numpy(), batch.column("_rank").to_numpy()
            order = np.argsort(parts, kind="stable")
            edges = np.flatnonzero(np.diff(parts[order], prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1], edges[1:]):
                at = order[lo:hi]
                first, bases, each, slot = ranks_of[int(parts[at[0]])]
                k = np.searchsorted(first, ranks[at], side="right") - 1
                over = ranks[at] - first[k]
                container[at] = bases[k] + over // each[k]
                place[at] = slot[k] + over % each[k]
            kept = [batch.column(c) for c in ("_id", "piece_no", "first_token", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(container), pa.array(place)], names=["_id", "piece_no", "first_token", "n_tokens", "container_id", "place"])

    offsets = slices.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = pieces.withColumn("_at", F.row_number().over(Window.partitionBy("_part", "_slice").orderBy("_id", "piece_no")) - 1).join(offsets, ["_part", "_slice"])
    kind = items.schema[id_column].dataType
    out = ranked.select("_id", F.col("piece_no").cast("int").alias("piece_no"), "first_token", F.col("_part").alias("n_tokens"), (F.col("_at") + F.col("_before")).cast("long").alias("_rank"))
    schema = f"_id {kind.simpleString()}, piece_no int, first_token long, n_tokens long, container_id long, place long"
    placed_rows = out.mapInArrow(placed, schema)
    return placed_rows.select(F.col("_id").alias(id_column), "piece_no", "first_token", "n_tokens", "container_id", F.col("place").cast("int").alias("place")), plan


def _sized(documents: DataFrame, id_column: str, text: str, path: str) -> DataFrame:
    counted = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(id_column), count_column(path)(F.col(text)).alias("n_tokens"))
    return stored(counted, "token-counts")


def documents_in_containers(documents: DataFrame, *, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = DEFAULT_RANKS) -> DataFrame:
    """:func:`fill_containers` over the token counts of ``text``; texts are encoded once."""
    return fill_containers(_sized(documents, id_column, text, path), id_column=id_column, capacity=capacity)


def container_report(documents: DataFrame, *, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = DEFAULT_RANKS) -> DataFrame:
    """One row: containers and tokens of the placed pieces, containers that come from the program, its fractional value and the dual bound."""
    placed, plan = _placed(_sized(documents, id_column, text, path), id_column, "n_tokens", capacity)
    each = placed.groupBy("container_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    counted = each.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), F.max("tokens").alias("fullest"))
    return counted.select("*", F.lit(plan.by_program).cast("long").alias("n_by_program"), F.lit(plan.fractional).alias("fractional"), F.lit(plan.bound).alias("dual_bound"))
