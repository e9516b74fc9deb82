"""The N best items of every group, whatever the group's size.

Each partition first reduces what it holds: an item counts once per group with
its highest score, and the N-th best of these is a lower bound for the group's
N-th best anywhere, so rows under it leave before the shuffle. The survivors
carry their bound; behind one shuffle on the group each row meets the highest
bound of its group, rows below it are dropped, and the rest is ranked. A group
that holds a third of all rows arrives as N rows per partition.

Order: score descending, then item descending by code point. Defined results:
null items, null or NaN scores don't count; a null group is a group; groups
without a row that counts have no result; repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows reduced at once in a worker; bounds its memory, never changes results.
CHUNK = 300_000


def _reduce(table: pa.Table, n: int) -> pa.Table:
    """Columns g, item, score, bound: the local n best of every group, the bound being the n-th best score (null if fewer)."""
    best = table.select(["g", "item", "score"]).group_by(["g", "item"], use_threads=False).aggregate([("score", "max")]).rename_columns(["g", "item", "score"])
    codes = best["g"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    score = best["score"].to_numpy()

    def nth(codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in its group of each row of ``order``, and the starts of the groups."""
        sorted_codes = codes[order]
        starts = np.flatnonzero(np.diff(sorted_codes, prepend=-1))
        sizes = np.diff(np.append(starts, len(order)))
        return np.arange(len(order)) - np.repeat(starts, sizes), sorted_codes

    order = np.lexsort((-score, codes))
    place, sorted_codes = nth(codes, order)
    bound = np.full(int(codes.max()) + 1 if len(codes) else 0, -np.inf)
    bound[sorted_codes[place == n - 1]] = score[order][place == n - 1]
    keep = np.flatnonzero(score >= bound[codes])
    best, codes, score = best.take(pa.array(keep)), codes[keep], score[keep]
    names = best["item"].combine_chunks().dictionary_encode()
    ranks = np.empty(len(names.dictionary), dtype=np.int64)
    ranks[pc.sort_indices(names.dictionary.cast(pa.binary())).to_numpy()] = np.arange(len(names.dictionary))
    order = np.lexsort((-ranks[names.indices.to_numpy()], -score, codes))
    place, sorted_codes = nth(codes, order)
    kept = order[place < n]
    limits = bound[codes[kept]]
    return best.take(pa.array(kept)).append_column("bound", pa.array(limits, mask=np.isneginf(limits)))


def top_per_group(df: DataFrame, *, group: str, item: str, score: str, n: int = 3, place: str = "place") -> DataFrame:
    """``group``, ``place`` (1 to n), ``item``, ``score``; other columns of ``df`` aren't carried."""
    kind = df.schema[group].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= CHUNK:
                reduced = _reduce(pa.concat_tables(t.select(["g", "item", "score"]) for t in held), n)
                if reduced.num_rows > CHUNK // 3:  # many small groups: nothing to gain from holding them
                    yield from reduced.to_batches()
                    held, rows = [], 0
                else:
                    held, rows = [reduced], reduced.num_rows
        if rows:
            yield from _reduce(pa.concat_tables(t.select(["g", "item", "score"]) for t in held), n).to_batches()

    clean = df.select(F.col(group).alias("g"), F.col(item).cast("string").alias("item"), F.col(score).cast("double").alias("score"))
    clean = clean.where(F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    survivors = clean.mapInArrow(local, f"g {kind}, item string, score double, bound double")
    limit = F.max("bound").over(Window.partitionBy("g"))
    bounded = survivors.withColumn("limit", limit).where(F.col("limit").isNull() | (F.col("score") >= F.col("limit")))
    once = bounded.groupBy("g", "item").agg(F.max("score").alias("score"))
    ranked = once.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy(F.col("score").desc(), F.col("item").desc())))
    return ranked.where(F.col("at") <= n).select(F.col("g").alias(group), F.col("at").cast("int").alias(place), F.col("item").alias(item), F.col("score").alias(score))


def retrieved_items(query_turns: DataFrame) -> DataFrame:
    """query_id, graph_id, score of every hit that isn't on the query's own dialogue."""
    hits = query_turns.select("query_id", "dial_id", F.explode(F.arrays_zip("retrieved_topk_ids", "retrieved_scores")).alias("hit"))
    hits = hits.select("query_id", "dial_id", F.col("hit.retrieved_topk_ids").alias("graph_id"), F.col("hit.retrieved_scores").alias("score"))
    own = F.coalesce(F.col("graph_id") == F.concat("dial_id", F.lit("::"), F.substring_index("graph_id", "::", -1)), F.lit(False))
    return hits.where(F.col("graph_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & ~own).select("query_id", "graph_id", "score")
