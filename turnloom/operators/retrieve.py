"""Similar stored turns for query turns: same label, hybrid of context and slot similarity.

The query and the stored turns meet on the label only, and a label's bucket can
hold a large part of the store. So the store is cut into blocks of bounded size,
each block scores all queries of its label with matrix products in Arrow batches
and keeps its k best, and the blocks' winners are ranked per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.runtime import small

WIDTH = 64
BLOCK = 4096
#: Query events of a label that meet a block of the store at once.
ASKED = 16_384
#: Scores computed at once in a worker.
SCORES = 512 * 4096


def _frame(columns: list[str], parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    """Columns put together; texts stay objects, as empty columns of pandas' own text type don't cross to Arrow."""
    arrays = [np.concatenate([p[i] for p in parts]) for i in range(len(columns))]
    return pd.DataFrame({c: pd.Series(a, dtype=object if a.dtype.kind not in "iufb" else a.dtype) for c, a in zip(columns, arrays)})


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clip_alpha(similarity: Column) -> Column:
    """The weight of the slot similarity: 0.2 + 0.3 s within 0.2 and 0.5."""
    return F.least(F.greatest(F.lit(0.2) + F.lit(0.3) * similarity, F.lit(0.2)), F.lit(0.5))


def hybrid_score(context: Column, slot: Column) -> Column:
    alpha = clip_alpha(slot)
    return (1 - alpha) * context + alpha * slot


def hash_encoder(width: int = WIDTH) -> object:
    """The default encoder, an Arrow UDF text -> unit vector: signed feature hashing of words; a model's encoder has the same shape."""
    import re
    import zlib

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, float]] = {}
        for texts in batches:
            out = np.zeros((len(texts), width), dtype=np.float32)
            for i, t in enumerate(texts):
                for w in re.findall(r"\w+", (t or "").lower()):
                    at = known.get(w)
                    if at is None:
                        h = zlib.crc32(w.encode())
                        at = known[w] = (h % width, 1.0 if h >> 16 & 1 else -1.0)
                    out[i, at[0]] += at[1]
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.Series(list(out / np.where(norm == 0, 1, norm)))

    return encode


def slot_similarities(slots: DataFrame, *, slot: str = "slot", vector: str = "vector") -> DataFrame:
    """q_slot, db_slot, sim of all pairs of the slot table, a fixed table of tens of rows."""
    q = slots.select(F.col(slot).alias("q_slot"), F.col(vector).alias("_q"))
    d = slots.select(F.col(slot).alias("db_slot"), F.col(vector).alias("_d"))
    return q.join(F.broadcast(d)).select("q_slot", "db_slot", dot(F.col("_q"), F.col("_d")).alias("sim"))


def best_slots(store: DataFrame, similarities: DataFrame, *, cross_domain: bool = False) -> DataFrame:
    """graph_id, label, q_slot, best_slot, best_sim: the stored turn's slot of that label most similar to the query slot.

    ``store``: graph_id, tasklabels; ties go to the first slot by name. ``cross_domain``:
    only slots of another domain than the query slot's count.
    """
    from turnloom.functions.slots import domain_of

    events = store.select("graph_id", F.explode("tasklabels").alias("e")).select("graph_id", F.col("e.label").alias("label"), F.col("e.slot").alias("db_slot")).where("label is not null and db_slot is not null")
    met = events.join(F.broadcast(similarities), "db_slot")
    if cross_domain:
        met = met.where(domain_of(F.col("q_slot")) != domain_of(F.col("db_slot")))
    best = F.min(F.struct((-F.col("sim")).alias("s"), F.col("db_slot").alias("slot")))
    return met.groupBy("graph_id", "label", "q_slot").agg(best.alias("b")).select("graph_id", "label", "q_slot", F.col("b.slot").alias("best_slot"), (-F.col("b.s")).alias("best_sim"))


def nearest_in_bucket(queries: DataFrame, store: DataFrame, *, query: str, item: str, bucket: str, vector: str, group: str, k: int = 3, block: int = BLOCK) -> DataFrame:
    """For each query the ``k`` nearest items of its bucket by dot product, not of its own ``group``: query, item, score, place.

    Items are dealt into blocks of about ``block`` rows; a query is sent to each block
    of its bucket, which answers with its k best. Order: score, then item, descending.
    """
    counts = store.groupBy(bucket).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    dealt = store.join(counts, bucket).select(F.col(bucket).alias("_bucket"), F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int").alias("_block"), F.col(item).alias("_item"), F.col(vector).alias("_v"), F.col(group).cast("string").alias("_group"))
    asked = queries.join(counts, bucket).select(F.col(bucket).alias("_bucket"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.col(query).alias("_query"), F.col(vector).alias("_v"), F.col(group).cast("string").alias("_group"))
    q_type, i_type = queries.schema[query].dataType.simpleString(), store.schema[item].dataType.simpleString()

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["_query", "_item", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        right = right.sort_values("_item", ascending=False, kind="stable").reset_index(drop=True)
        items = np.stack([np.asarray(v, dtype=np.float64) for v in right["_v"]])
        groups, names, out = right["_group"].to_numpy(dtype=object), right["_item"].to_numpy(), []
        for at in range(0, len(left), 512):
            part = left.iloc[at : at + 512]
            scores = np.stack([np.asarray(v, dtype=np.float64) for v in part["_v"]]) @ items.T
            own = part["_group"].to_numpy(dtype=object)[:, None]
            scores[(own == groups[None, :]) & pd.notna(own)] = -np.inf
            scores = np.round(scores, 9)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(part)), top.shape[1])
            picked = scores[rows, top.ravel()]
            fine = np.isfinite(picked)
            out.append((part["_query"].to_numpy()[rows[fine]], names[top.ravel()[fine]], picked[fine]))
        return _frame(columns, out)

    local = asked.groupBy("_bucket", "_block").cogroup(dealt.groupBy("_bucket", "_block")).applyInPandas(score, f"_query {q_type}, _item {i_type}, score double")
    place = F.row_number().over(Window.partitionBy("_query").orderBy(F.col("score").desc(), F.col("_item").desc()))
    return local.withColumn("place", place).where(F.col("place") <= k).select(F.col("_query").alias(query), F.col("_item").alias(item), "score", "place")


def hybrid_retrieval(queries: DataFrame, store: DataFrame, similarities: DataFrame, *, k: int = 3, cross_domain: bool = False, block: int = BLOCK) -> DataFrame:
    """For each query event the ``k`` stored turns of its label with the best hybrid score: query_id, place, graph_id, slot, score, ret_id.

    ``queries``: query_id, dial_id, slot, label, vector; ``store``: graph_id, dial_id,
    tasklabels, vector. Turns of the query's own dialogue don't count (a query without
    a dialogue excludes none). A stored turn goes to one block of each of its labels,
    once for every ``ASKED`` queries of the label; the slot similarities, a fixed table of slots times slots, travel with the function,
    which finds each turn's most similar slot (:func:`best_slots`) for all query slots at once.
    """
    from turnloom.functions.slots import domain_of

    table = similarities.where(domain_of(F.col("q_slot")) != domain_of(F.col("db_slot"))) if cross_domain else similarities
    known = {(r["q_slot"], r["db_slot"]): float(r["sim"]) for r in small(table, 1_000_000)}
    q_slots, db_slots = sorted({q for q, _ in known}), sorted({d for _, d in known})
    sims = np.array([[known.get((q, d), -np.inf) for d in db_slots] for q in q_slots]).reshape(len(q_slots), len(db_slots))
    q_at, db_at = {s: i for i, s in enumerate(q_slots)}, {s: i for i, s in enumerate(db_slots)}

    labelled = store.select("graph_id", F.col("dial_id").alias("_group"), F.col("vector").alias("_v"), F.explode("tasklabels").alias("_e")).where("_e.label is not null and _e.slot is not null")
    held = labelled.groupBy("graph_id", F.col("_e.label").alias("label")).agg(F.first("_group").alias("_group"), F.first("_v").alias("_v"), F.collect_set("_e.slot").alias("_slots"))
    asking = queries.where(F.col("slot").isin(*q_slots))
    parts = asking.groupBy("label").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("_parts"))
    counts = held.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).join(parts, "label")
    dealt = held.join(counts, "label").withColumn("_block", F.pmod(F.xxhash64("graph_id"), F.col("_blocks")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")).drop("_blocks", "_parts")
    asked = asking.select("query_id", F.col("dial_id").alias("_group"), "slot", "label", F.col("vector").alias("_v")).join(counts, "label").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")).drop("_blocks", "_parts")
    q_type = queries.schema["query_id"].dataType.simpleString()
    columns = ["query_id", "graph_id", "slot", "score"]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        right = right.sort_values("graph_id", ascending=False, kind="stable").reset_index(drop=True)
        items = np.stack([np.asarray(v, dtype=np.float64) for v in right["_v"]])
        has = np.zeros((len(right), len(db_slots)), dtype=bool)
        for i, names in enumerate(right["_slots"]):
            has[i, [db_at[s] for s in names if s in db_at]] = True
        number = {g: i for i, g in enumerate(right["_group"].dropna().unique()) if g != ""}
        groups = right["_group"].map(number).fillna(-1).to_numpy(dtype=np.int64)
        ids, out, step = right["graph_id"].to_numpy(dtype=object), [], max(1, SCORES // len(right))
        for name, asking in left.groupby("slot", sort=True):
            offered = np.where(has, sims[q_at[name]][None, :], -np.inf)
            best = offered.argmax(axis=1)
            sim = offered[np.arange(len(right)), best]
            valid = np.isfinite(sim)
            alpha = np.clip(0.2 + 0.3 * np.where(valid, sim, 0.0), 0.2, 0.5)
            for at in range(0, len(asking), step):
                part = asking.iloc[at : at + step]
                context = np.stack([np.asarray(v, dtype=np.float64) for v in part["_v"]]) @ items.T
                scores = np.round(np.where(valid, (1 - alpha) * context + alpha * np.where(valid, sim, 0.0), -np.inf), 9)
                scores[part["_group"].map(number).fillna(-2).to_numpy(dtype=np.int64)[:, None] == groups[None, :]] = -np.inf
                rows, top, got = np.arange(len(part)), [], []
                for _ in range(min(k, len(right))):  # the first of the best, as a stable sort has them
                    top.append(scores.argmax(axis=1))
                    got.append(scores[rows, top[-1]])
                    scores[rows, top[-1]] = -np.inf
                rows, cols, reached = np.repeat(rows, len(top)), np.stack(top, axis=1).ravel(), np.stack(got, axis=1).ravel()
                fine = np.isfinite(reached)
                rows, cols, reached = rows[fine], cols[fine], reached[fine]
                out.append((part["query_id"].to_numpy()[rows], ids[cols], np.array(db_slots, dtype=object)[best[cols]], reached))
        return _frame(columns, out)

    local = asked.groupBy("label", "_block", "_part").cogroup(dealt.groupBy("label", "_block", "_part")).applyInPandas(score, f"query_id {q_type}, graph_id string, slot string, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("graph_id").desc()))
    return local.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "graph_id", "slot", "score", F.concat_ws("::", "graph_id", "slot").alias("ret_id"))


def parse_retrieved(ret_id: Column) -> Column:
    """``dialogue::turn::slot`` as a struct; fewer parts give empty texts and turn -1."""
    parts = F.split(ret_id, "::")
    whole = F.size(parts) >= 3
    return F.struct(F.when(whole, parts[0]).otherwise("").alias("dial_id"), F.coalesce(F.when(whole, parts[1].try_cast("int")), F.lit(-1)).alias("turn_id"), F.when(whole, F.array_join(F.slice(parts, 3, 2**31 - 4), "::")).otherwise("").alias("slot"))


def dense_top_slots(queries: DataFrame, slots: DataFrame, *, query: str, vector: str = "vector", slot: str = "slot", k: int = 10) -> DataFrame:
    """The ``k`` slots nearest to each query, best first: query, candidates. The slot table is fixed, so it travels inside the plan."""
    rows = sorted(small(slots.select(slot, F.transform(vector, lambda x: x.cast("double")).alias("v")), 1000), key=lambda r: r[slot])
    names, matrix = np.array([r[slot] for r in rows], dtype=object), np.array([r["v"] for r in rows], dtype=np.float64)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(vectors) or not len(names):
            return pd.Series([[] for _ in vectors], dtype=object)
        scores = np.round(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) @ matrix.T, 9)
        return pd.Series([list(names[o[:k]]) for o in np.argsort(-scores, axis=1, kind="stable")], dtype=object)

    return queries.select(query, nearest(F.col(vector)).alias("candidates"))
