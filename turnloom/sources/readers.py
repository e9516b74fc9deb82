"""Reading the pipeline's files into typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "struct<slot:string,`label-1`:string,`label-2`:string,prev_val:string,curr_val:string>"
TURN = f"struct<turn_id:int,system:string,user:string,state:struct<active_intent:string,slot_values:map<string,string>>,taklabels:array<{EVENT}>,tasklabel:string,candidates:array<string>>"
DIALOGUE = f"dial_id string, domains array<string>, turns array<{TURN}>"
CANDIDATES = "dial_id string, turn_id int, domains array<string>, candidates array<string>"
PREDICTIONS = "dial_id string, turn_id int, slot string, pred string, pred_action string, pred_label string, pred_detail array<struct<slot:string,pred:string,pred_action:string,pred_label:string>>"
_CORRUPT = "_corrupt_record"


def first_sign(spark: SparkSession, path: str) -> str:
    """The first sign of a file that isn't blank; '' for empty files. Reads the head of one partition."""
    row = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return row[0][0].lstrip("﻿ \t")[:1] if row else ""


def read_json(spark: SparkSession, path: str, schema: str, *, layout: str = "auto") -> DataFrame:
    """JSON lines (blank lines ignored) or one JSON document per file; ``auto`` looks at the first sign.

    A document may be a list of rows or one row.
    """
    if layout == "auto":
        layout = "array" if first_sign(spark, path) == "[" else "lines"
    return spark.read.schema(schema).option("multiLine", layout != "lines").json(path)


def read_dialogues(spark: SparkSession, path: str, *, layout: str = "auto") -> DataFrame:
    """Dialogues from lines, a list, ``{"dialogs": []}``, ``{"data": []}``, ``{id: dialogue}`` or one dialogue: dial_id, domains, turns.

    ``label-2`` written as a list stays text (its JSON). Other spellings of the id
    (dialogue_id, dialog_id) and of the turns (dialog) count where the first is missing.
    """
    sign = first_sign(spark, path)
    if layout == "lines" or (layout == "auto" and sign == "{" and spark.read.text(path).where(F.trim("value") != "").limit(2).where(F.trim("value").rlike(r"^\{.*\}$")).count() == 2):
        return _named(spark.read.schema(_loose()).json(path))
    if layout == "auto" and sign == "[":
        return _named(spark.read.schema(_loose()).option("multiLine", True).json(path))
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    lists = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.dialogs", "$.data")])
    keyed = F.try_variant_get("v", "$", "map<string,variant>")
    single = F.try_variant_get("v", "$.turns", "array<variant>").isNotNull() | F.try_variant_get("v", "$.dialog", "array<variant>").isNotNull()
    entries = F.when(lists.isNotNull(), F.transform(lists, lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))).when(single, F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("v").alias("value")))).otherwise(F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    rows = whole.select(F.explode(entries).alias("e")).select(F.col("e.key").alias("_key"), F.from_json(F.to_json("e.value"), _loose()).alias("d"))
    return _named(rows.select("_key", "d.*"))


def _loose() -> T.StructType:
    return T._parse_datatype_string(f"dial_id string, dialogue_id string, dialog_id string, domains array<string>, turns array<{TURN}>, dialog array<{TURN}>")


def _named(rows: DataFrame) -> DataFrame:
    key = [F.col("_key")] if "_key" in rows.columns else []
    ids = [F.nullif(F.col(c), F.lit("")) for c in ("dial_id", "dialogue_id", "dialog_id")]
    return rows.select(F.coalesce(*ids, *key).alias("dial_id"), "domains", F.coalesce("turns", "dialog").alias("turns"))


def read_split_files(spark: SparkSession, root: str, schema: str, splits: tuple[str, ...] = ("train", "dev", "test"), pattern: str = "dialogue*.json") -> DataFrame:
    """``root/<split>/dialogue*.json`` with ``split`` and ``file``."""
    parts = [spark.read.schema(schema).option("multiLine", True).json(f"{root.rstrip('/')}/{s}/{pattern}").select("*", F.col("_metadata.file_name").alias("file")).withColumn("split", F.lit(s)) for s in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated replacements: source, target."""
    return spark.read.schema("source string, target string").option("sep", "\t").csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, blank lines ignored."""
    return spark.read.text(path).select(F.trim("value").alias("dial_id")).where("dial_id <> ''")


def read_service_schemas(spark: SparkSession, path: str) -> DataFrame:
    """Service schemas as rows: service, slot, description, is_categorical, possible_values."""
    schema = "service_name string, slots array<struct<name:string,description:string,is_categorical:boolean,possible_values:array<string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.col("service_name").alias("service"), F.explode("slots").alias("s")).select("service", F.col("s.name").alias("slot"), F.col("s.description").alias("description"), F.col("s.is_categorical").alias("is_categorical"), F.col("s.possible_values").alias("possible_values"))


def repeated_slots(schemas: DataFrame) -> DataFrame:
    """Slots that several services declare: slot, services."""
    return schemas.groupBy("slot").agg(F.array_sort(F.collect_set("service")).alias("services")).where(F.size("services") > 1)


def read_acts(spark: SparkSession, path: str) -> DataFrame:
    """Dialogue acts from ``{dialogue: {turn: {"Domain-Act": [[name, value]]}}}``: dialogue, act_no, domain, act, name, value (null for requests)."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("dialogue", "turns"))
    turns = rows.select("dialogue", F.explode("turns").alias("act_no", "acts")).select("dialogue", F.col("act_no").try_cast("int").alias("act_no"), F.explode(F.from_json("acts", "map<string,array<array<string>>>")).alias("kind", "pairs"))
    each = turns.select("dialogue", "act_no", F.lower(F.substring_index("kind", "-", 1)).alias("domain"), F.lower(F.substring_index("kind", "-", -1)).alias("act"), F.explode("pairs").alias("p"))
    return each.select("dialogue", "act_no", "domain", "act", F.lower(F.get("p", F.lit(0))).alias("name"), F.when(F.col("act") != "request", F.get("p", F.lit(1))).alias("value"))


def read_predictions(spark: SparkSession, path: str, *, layout: str = "auto") -> DataFrame:
    """Predictions as flat rows or as ``pred_detail`` lists: dial_id, turn_id, slot, pred; the last of a key counts."""
    rows = read_json(spark, path, PREDICTIONS, layout=layout).withColumn("_at", F.monotonically_increasing_id())
    flat = rows.where("slot is not null").select("dial_id", "turn_id", "slot", F.coalesce("pred_action", "pred_label", "pred").alias("pred"), "_at", F.lit(-1).alias("_pos"))
    nested = rows.select("dial_id", "turn_id", "_at", F.posexplode("pred_detail").alias("_pos", "d")).select("dial_id", "turn_id", F.col("d.slot").alias("slot"), F.coalesce("d.pred_action", "d.pred_label", "d.pred").alias("pred"), "_at", "_pos")
    return last_per_key(flat.unionByName(nested), ["dial_id", "turn_id", "slot"], ["_at", "_pos"])


def read_candidates(spark: SparkSession, path: str, *, layout: str = "auto") -> DataFrame:
    """Ranked candidates: dial_id, turn_id, candidates; the last of a key counts."""
    rows = read_json(spark, path, CANDIDATES, layout=layout).withColumn("_at", F.monotonically_increasing_id())
    return last_per_key(rows.select("dial_id", "turn_id", "candidates", "_at"), ["dial_id", "turn_id"], ["_at"])


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def attach_candidates(turns: DataFrame, candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Turn rows with their candidates; the empty list where there are none."""
    on = keys or ["dial_id", "turn_id"]
    return turns.join(candidates.select(*on, "candidates"), on, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def missing_candidates(turns: DataFrame, candidates: DataFrame) -> DataFrame:
    """Turn keys without candidates, with the reason: no dialogue id, dialogue unknown, turn unknown."""
    known = candidates.select("dial_id").distinct().withColumn("_known", F.lit(True))
    lost = turns.select("dial_id", "turn_id").join(candidates.select("dial_id", "turn_id"), ["dial_id", "turn_id"], "left_anti").join(known, "dial_id", "left")
    reason = F.when(F.coalesce("dial_id", F.lit("")) == "", "no_dial_id").when(F.col("_known").isNull(), "dial_not_in_candidates").otherwise("turn_not_in_candidates")
    return lost.select("dial_id", "turn_id", reason.alias("reason"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "turn_no") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
