"""Queries of the operators for training data, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.canonical import UNMATCHED, canonical_slots
from turnloom.llm.containers import container_report, documents_in_containers
from turnloom.llm.overlaps import overlap_classes, overlap_report, overlapping_records
from turnloom.llm.splits import keep_together, related_pairs, split_report
from turnloom.llm.subjects import subject_areas, subject_report
from turnloom.llm.tokens import encode_corpus
from turnloom.llm.topn import retrieved_items, top_per_group
from turnloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_pairs(table(spark, sf_dir, "dialogue"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_together(table(spark, sf_dir, "dialogue")).select("rec_id", "component", "assigned_split")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_report(keep_together(table(spark, sf_dir, "dialogue")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_slots(table(spark, sf_dir, "dialogue"), table(spark, sf_dir, "slot_descriptions")).select("rec_id", "turn_no", "slot", "canonical")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values, distinct values and unmatched values of each slot."""
    found = canonical_slots(table(spark, sf_dir, "dialogue"), table(spark, sf_dir, "slot_descriptions"))
    unmatched = F.col("canonical") == UNMATCHED
    return found.groupBy("slot").agg(F.count("*").alias("n_values"), F.count_distinct("value").alias("n_distinct"), F.sum(unmatched.cast("long")).alias("n_unmatched"), F.count_distinct(F.when(unmatched, F.col("value"))).alias("n_distinct_unmatched"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlapping_records(table(spark, sf_dir, "dialogue"))
    return pairs.select(F.least("train_rec", "eval_rec").alias("rec_id_a"), F.greatest("train_rec", "eval_rec").alias("rec_id_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "dialogue"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_classes(table(spark, sf_dir, "dialogue"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_per_group(retrieved_items(table(spark, sf_dir, "query_turns")), group="query_id", item="graph_id", score="score", n=3)
    return best.select("query_id", "place", "graph_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_in_containers(table(spark, sf_dir, "documents"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_report(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples"), table(spark, sf_dir, "subject_areas"), source="source")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples"), table(spark, sf_dir, "subject_areas"), source="source")


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_report": p1_report, "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_report": p3_report, "p3_classes": p3_classes, "p4_found": p4_found, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_report": p7_report, "p8_found": p8_found, "p8_report": p8_report}

SQL: dict[str, str] = {
    "p4_found": """
WITH hits AS (
  SELECT query_id, dial_id, unnest(retrieved_topk_ids) AS graph_id, unnest(retrieved_scores) AS score FROM query_turns
), once AS (
  SELECT query_id, graph_id, max(score) AS score FROM hits
  WHERE graph_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
    AND regexp_extract(graph_id, '^(.*)::', 1) IS DISTINCT FROM dial_id
  GROUP BY query_id, graph_id
)
SELECT query_id, CAST(place AS INTEGER) AS place, graph_id FROM (
  SELECT query_id, graph_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, graph_id DESC) AS place FROM once
) WHERE place <= 3""",
}
