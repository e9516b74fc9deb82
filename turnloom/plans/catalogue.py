"""Queries of the core library over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import slots as S
from turnloom.functions import text as X
from turnloom.operators import coref, corpus, evaluate, graph, memory, pairs, prompts, retrieve, sampling, splits, state, turns
from turnloom.operators.packed import label_values
from turnloom.plans import sql as Q
from turnloom.plans import sql_samples as M
from turnloom.runtime import small, spread, table
from turnloom.sources import readers
from turnloom.streaming import rolling

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dialogue")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "slot_descriptions")


def of_dialogues(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, sf_dir: f(dialogues(spark, sf_dir)))


def joined(c: str, by: str = "|") -> F.Column:
    return F.array_join(c, by).alias(c)


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = small(slots(spark, sf_dir).select("slot").where("slot like '% %'"), 1000)
    return label_values(dialogues(spark, sf_dir), [r["slot"] for r in names])


# --- turns and contexts
of_dialogues("turn_pairs", Q.TURN_PAIRS, lambda d: turns.turn_table(d, "system", "user"))
of_dialogues("event_rows", Q.EVENT_ROWS, lambda d: turns.event_table(d).select("rec_id", "turn_no", "event_no", "slot", "label1", "label2", "prev_val", "curr_val"))
of_dialogues("state_rows", Q.STATE_ROWS, turns.state_table)
of_dialogues("context_window_k2", Q.CONTEXT_K2, lambda d: turns.contexts(d, 2).select("rec_id", "turn_no", "context"))
of_dialogues("context_window_k4", Q.CONTEXT_K4, lambda d: turns.contexts(d, 4, "spoken").select("rec_id", "turn_no", "context"))
of_dialogues("context_window_k1", Q.CONTEXT_K1, lambda d: turns.contexts(d, 1, "plain").select("rec_id", "turn_no", "context"))
of_dialogues("new_domains", Q.NEW_DOMAINS, lambda d: turns.new_domains(d).select("rec_id", "turn_no", joined("new_domains")))
of_dialogues("carried_domain", Q.CARRIED_DOMAIN, lambda d: turns.carried_domain(d).select("rec_id", "turn_no", "domain"))
of_dialogues("well_formed", Q.WELL_FORMED, lambda d: turns.well_formed(d).select("rec_id"))


@query("speaker_pairs", Q.SPEAKER_PAIRS)
def speaker_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.turn_table(dialogues(spark, sf_dir), "system", "user")
    said = rows.select("rec_id", F.explode(F.array(F.struct((F.col("turn_no") * 2).alias("place"), F.lit("SYSTEM").alias("speaker"), F.col("system").alias("text")), F.struct((F.col("turn_no") * 2 + 1).alias("place"), F.lit("USER").alias("speaker"), F.col("user").alias("text")))).alias("u")).select("rec_id", "u.*")
    return turns.pair_speakers(said, dialogue="rec_id", order="place", speaker="speaker", text="text").select("rec_id", "turn_no", "system", "user")


@query("renested_turns", Q.RENESTED)
def renested_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.turn_table(dialogues(spark, sf_dir), "system", "user")
    nested = turns.nest_turns(rows, "system", "user")
    return nested.select("rec_id", F.size("turns").alias("n_turns"), F.md5(F.array_join(F.transform("turns", lambda t: F.coalesce(t["user"], F.lit(""))), "\n")).alias("user_md5"))


# --- states, labels, memory
for _dialect in ("label", "activation", "recheck", "gold"):
    of_dialogues(f"state_delta_{_dialect}", Q.DELTAS[_dialect], lambda d, dialect=_dialect: state.state_deltas(d, dialect))
of_dialogues("cumulative_state", Q.CUMULATIVE, state.cumulative_state)
of_dialogues("gold_turns_hotel", Q.GOLD_TURNS, lambda d: state.gold_turns(d, "hotel").select("rec_id", "turn_no", "is_gold"))
of_dialogues("l1_labels", Q.L1_LABELS, state.label_turns)
of_dialogues("l1_label_counts", Q.L1_COUNTS, lambda d: state.label_turns(d).groupBy(S.domain_or_slot(F.col("slot")).alias("domain"), "label1", "label2").agg(F.count("*").alias("n")))
of_dialogues("turn_labels", Q.TURN_LABELS, state.turn_labels)
of_dialogues("activated_so_far", Q.ACTIVATED, lambda d: state.activated_so_far(d).select("rec_id", "turn_no", joined("activated")))
of_dialogues("run_start_turn", Q.RUN_STARTS, state.run_starts)
of_dialogues("first_valid_turn", Q.FIRST_VALID, state.first_valid_turns)
of_dialogues("ontology_values", Q.ONTOLOGY, lambda d: state.observed_values(d).select("slot", "n_values", joined("values")))
of_dialogues("slot_memory", Q.SLOT_MEMORY, memory.slot_memories)
of_dialogues("memory_contexts", M.MEMORY_CONTEXTS, memory.memory_contexts)
of_dialogues(
    "label_resolution",
    Q.LABEL_RESOLUTION,
    lambda d: turns.event_table(d).select("rec_id", "turn_no", "event_no", *[S.resolve_label(F.col("label1"), S.label_tokens(F.col("label2"), "any" if k == "prompt" else "comma"), k).alias(k.replace("-", "_")) for k in ("retrieval-a", "retrieval-b", "graph", "prompt", "memory")]),
)
of_dialogues("label_tokens_pipe", Q.TOKENS_PIPE, lambda d: turns.event_table(d).select("rec_id", "turn_no", "event_no", F.array_join(S.label_tokens(F.col("label2"), "pipe"), "~").alias("tokens")))


@query("memory_asof", Q.MEMORY_ASOF)
def memory_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every slot of a turn's state before the turn."""
    d = dialogues(spark, sf_dir)
    last = turns.event_table(d).where("slot is not null").groupBy("rec_id", "slot", "turn_no").agg(F.max_by("label1", "event_no").alias("label1"))
    return memory.latest_activation_asof(last, turns.state_table(d).select("rec_id", "slot", "turn_no"), keys=["rec_id", "slot"], carry=["label1"])


# --- texts
of_dialogues("gate_types", Q.GATES, lambda d: turns.turn_table(d, "system", "user").select("rec_id", "turn_no", X.gate_type(F.col("system"), F.col("user")).alias("gate")))
of_dialogues("normalize_values", M.NORMALIZE_VALUES, lambda d: turns.state_table(d).select("slot", "value").where("value is not null").distinct().select("slot", "value", X.normalize_value(F.col("value")).alias("norm")))
of_dialogues("value_mentions", Q.VALUE_MENTIONS, lambda d: turns.turn_table(d, "user", "slot_values").select("rec_id", "turn_no", "user", F.explode("slot_values").alias("slot", "value")).where(X.value_in_text(F.col("value"), F.col("user"))).select("rec_id", "turn_no", "slot"))
of_dialogues("hash_mask", Q.HASH_MASK, lambda d: splits.masked_turns(turns.turn_table(d), ["rec_id", "turn_no"]).select("rec_id", "turn_no", "masked"))
of_dialogues("hash_unit", Q.HASH_UNIT, lambda d: d.select("rec_id", F.round(X.hash_unit(F.lit("13"), F.col("rec_id").cast("string")), 9).alias("unit")))
of_dialogues("corpus_text", M.CORPUS_TEXT, lambda d: turns.turn_table(d, "user").select("rec_id", "turn_no", X.corpus_text(F.col("user"), {"centre": "center"}).alias("text")))


@query("slot_names", Q.SLOT_NAMES)
def slot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("slot")
    return slots(spark, sf_dir).select("slot", S.domain_of(s).alias("domain"), S.type_of(s).alias("slot_type"), S.mask_slot(s).alias("masked"), S.canonical_slot(s).alias("canonical"), S.canonical_type(s).alias("kind"))


@query("slot_texts", M.SLOT_TEXTS)
def slot_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.describe_slots(slots(spark, sf_dir)).select("slot", "serialized", "pipe_text", "model_text", S.value_examples(F.col("value")).alias("examples"), X.json_list(S.value_candidates(F.col("value"), F.col("slot_type"))).alias("candidates"))


# --- splits and samples
of_dialogues("allowed_dialogues", Q.ALLOWED, lambda d: splits.allowed_dialogues(d).select("rec_id"))
of_dialogues("loo_train", Q.LOO_TRAIN, lambda d: splits.leave_one_out(d, "hotel").select("rec_id"))
of_dialogues("loo_split_strict", Q.LOO_STRICT, lambda d: splits.leave_one_out(d, "hotel", part="test").select("rec_id"))
of_dialogues("loo_split_loose", Q.LOO_LOOSE, lambda d: splits.leave_one_out(d, "hotel", part="test", strict=False).select("rec_id"))
of_dialogues("loo_all", Q.LOO_ALL, lambda d: splits.leave_one_out_all(d).select("rec_id", "left_out", "part"))
of_dialogues("id_list_split", Q.ID_LISTS, lambda d: splits.by_id_lists(d, d.where("split = 'test'").select("dial_id"), d.where("split = 'dev'").select("dial_id")).select("rec_id", "part"))
of_dialogues("hash_split", Q.HASH_SPLIT, lambda d: splits.exact_share(d.select("rec_id"), "rec_id", 0.35))


@query("weighted_sample", Q.WEIGHTED)
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    return sampling.weighted_sample(parts, ["p_brand"], "p_partkey", F.col("p_size"), 3).select("p_brand", "p_partkey", F.col("pick_no").cast("long").alias("pick_no"))


@query("argmin_hash_pick", Q.ARGMIN)
def argmin_hash_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_argmin(table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").cast("string").alias("p_partkey")), ["p_brand"], "p_partkey", "13")


@query("ranked_negatives", Q.RANKED)
def ranked_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order its first line by tier (returned, open, other), then price."""
    tier = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_linestatus") == "O", 1).otherwise(2)
    found = sampling.ranked_first(table(spark, sf_dir, "lineitem"), ["l_orderkey"], tier, -F.col("l_extendedprice").cast("double"), ["l_linenumber"])
    return found.select("l_orderkey", F.col("tier").cast("long").alias("tier"), F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("negative_slots", M.NEGATIVE_SLOTS)
def negative_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.turn_table(dialogues(spark, sf_dir), "taklabels").where(F.size("taklabels") > 0).select("rec_id", "turn_no", F.transform("taklabels", lambda e: e["slot"]).alias("active"))
    return sampling.negative_slots(rows, slots(spark, sf_dir), keys=["rec_id", "turn_no"])


# --- evaluation: the first two candidates stand for predictions
def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.turn_table(dialogues(spark, sf_dir), "taklabels", "candidates")
    return rows.select("rec_id", "turn_no", F.transform("taklabels", lambda e: e["slot"]).alias("gold"), F.slice("candidates", 1, 2).alias("pred"), "candidates")


query("slot_scores", Q.SLOT_SCORES)(lambda spark, sf_dir: evaluate.slot_scores(evaluate.compared(predicted(spark, sf_dir))))
query("exact_set_accuracy", Q.EXACT_SET)(lambda spark, sf_dir: evaluate.exact_set_accuracy(evaluate.compared(predicted(spark, sf_dir))))
query("error_types", Q.ERROR_TYPES)(lambda spark, sf_dir: evaluate.error_types(evaluate.compared(predicted(spark, sf_dir))))
query("error_sizes", Q.ERROR_SIZES)(lambda spark, sf_dir: evaluate.error_sizes(evaluate.compared(predicted(spark, sf_dir))))
query("error_sample", Q.ERROR_SAMPLE)(lambda spark, sf_dir: evaluate.error_sample(evaluate.compared(predicted(spark, sf_dir)), ["rec_id", "turn_no"], 200).select("rec_id", "turn_no", joined("missing"), joined("extra")))
query("coverage_at_k", Q.COVERAGE)(lambda spark, sf_dir: evaluate.coverage_at_k(predicted(spark, sf_dir), "gold", "candidates", 3))


@query("top_missing_slots", Q.TOP_MISSING)
def top_missing_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = evaluate.compared(predicted(spark, sf_dir))
    return evaluate.most_common(counted.select(F.explode("missing").alias("slot")), "slot", 10)


@query("label_accuracy", Q.LABEL_ACCURACY)
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored first labels against those derived from the states."""
    d = dialogues(spark, sf_dir)
    gold = turns.event_table(d).where("slot is not null").groupBy("rec_id", "turn_no", "slot").agg(F.max_by("label1", "event_no").alias("gold"))
    return evaluate.label_accuracy(gold.join(state.label_turns(d).select("rec_id", "turn_no", "slot", F.col("label1").alias("pred")), ["rec_id", "turn_no", "slot"], "left"), "gold", "pred")


@query("joint_goal_accuracy", Q.JGA)
def joint_goal_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the turn before, taken as a prediction."""
    return evaluate.joint_goal_accuracy(turns.turn_table(dialogues(spark, sf_dir), "slot_values", before=("slot_values",)), "slot_values", "before_slot_values")


@query("activation_recheck", Q.RECHECK)
def activation_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dialogues(spark, sf_dir)
    return evaluate.exact_set_accuracy(evaluate.compared(evaluate.activation_recheck(d, predicted(spark, sf_dir).select("rec_id", "turn_no", "pred")), skip_empty_gold=False))


# --- candidates
def turn_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.turn_table(dialogues(spark, sf_dir), keys=("rec_id", "dial_id")).select("rec_id", "dial_id", "turn_id")


def stored_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "graph_store").select("dial_id", "turn_id", F.col("slots").alias("candidates"))


query("candidate_attach", Q.CANDIDATE_ATTACH)(lambda spark, sf_dir: readers.attach_candidates(turn_keys(spark, sf_dir), stored_slots(spark, sf_dir)).select("rec_id", "turn_id", joined("candidates")))
query("missing_keys", Q.MISSING_KEYS)(lambda spark, sf_dir: readers.missing_candidates(turn_keys(spark, sf_dir), stored_slots(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n")))


# --- retrieval
@query("knn_label_topk", Q.KNN)
def knn_label_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 50, against all rows of its label."""
    e = table(spark, sf_dir, "embeddings")
    found = retrieve.nearest_in_bucket(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id").withColumn("own", F.col("query_id")), e.withColumn("own", F.col("vec_id")), query="query_id", item="vec_id", bucket="label", vector="embedding", group="own")
    return found.select("query_id", F.col("place").cast("int").alias("place"), "vec_id", F.round("score", 5).alias("score"))


def encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    encode = retrieve.hash_encoder()
    vectors = S.describe_slots(slots(spark, sf_dir)).select("slot", encode("serialized").alias("vector"))
    store = table(spark, sf_dir, "graph_store").select("graph_id", "dial_id", "tasklabels", encode("context.retrieval_text").alias("vector"))
    events = turns.event_table(dialogues(spark, sf_dir), keys=("rec_id", "dial_id"), computed={"context": turns.context_lines(2)})
    label = S.resolve_label(F.col("label1"), S.label_tokens(F.col("label2")), "retrieval-b")
    return events.select(F.concat_ws("::", "rec_id", "turn_no", "event_no").alias("query_id"), "dial_id", "slot", label.alias("label"), encode("context").alias("vector")), store, vectors


@query("hybrid_retrieval")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the events of every record whose id is divisible by 50, against the whole store."""
    q, store, vectors = encoded(spark, sf_dir)
    mine = q.where(F.substring_index("query_id", "::", 1).cast("long") % 50 == 0)
    return retrieve.hybrid_retrieval(mine, store, retrieve.slot_similarities(vectors)).select("query_id", "place", "graph_id", "slot", F.round("score", 6).alias("score"))


query("slot_similarity")(lambda spark, sf_dir: retrieve.slot_similarities(encoded(spark, sf_dir)[2]).select("q_slot", "db_slot", F.round("sim", 6).alias("sim")))
query("best_slot_tables")(lambda spark, sf_dir: (lambda q, store, v: retrieve.best_slots(store, retrieve.slot_similarities(v), cross_domain=True))(*encoded(spark, sf_dir)).select("graph_id", "label", "q_slot", "best_slot", F.round("best_sim", 6).alias("best_sim")))
query("dense_topk_candidates")(lambda spark, sf_dir: (lambda q, store, v: retrieve.dense_top_slots(q, v, query="query_id"))(*encoded(spark, sf_dir)).select("query_id", joined("candidates")))


@query("parsed_retrieved", Q.PARSED_RETRIEVED)
def parsed_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of ``graph::slot`` ids made of the store's turns and slots."""
    rows = table(spark, sf_dir, "graph_store").select("graph_id", F.explode("slots").alias("s"))
    return rows.select("graph_id", "s", retrieve.parse_retrieved(F.concat_ws("::", "graph_id", "s")).alias("p")).select("graph_id", F.col("p.dial_id").alias("dial_id"), F.col("p.turn_id").alias("turn_id"), F.col("p.slot").alias("slot"))


# --- graphs, samples, references
of_dialogues(
    "edge_build",
    Q.EDGES,
    lambda d: turns.turn_table(d.withColumn("_s", F.col("turns.state.slot_values")), "taklabels", keys=("rec_id", "_s"))
    .select("rec_id", "turn_no", F.explode(graph.event_edges(F.col("taklabels"), graph.task_labels(F.col("taklabels"), F.col("_s"), F.col("turn_no")))).alias("e"))
    .select("rec_id", "turn_no", F.col("e.rel").alias("rel"), F.coalesce("e.src.id", "e.src.slot", "e.src.t").alias("src"), F.coalesce("e.dst.id", "e.dst.slot").alias("dst"), F.coalesce("e.dst.value", F.lit("")).alias("value")),
)
query("graph_store_build", M.GRAPH_STORE)(lambda spark, sf_dir: graph.graph_store(spread(dialogues(spark, sf_dir)), slots(spark, sf_dir)).select("rec_id", "turn_no", "graph_id", joined("labels_for_retrieval"), joined("slots"), F.size("edges").alias("n_edges")))


@query("edge_filter", M.EDGE_FILTER)
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered edge lines of every slot of every stored turn graph."""
    g = graph.graph_store(spread(dialogues(spark, sf_dir)), slots(spark, sf_dir))
    rows = g.select("rec_id", "turn_no", "edges", "tasklabels", F.explode("slots").alias("slot"))
    label = F.get(F.filter("tasklabels", lambda t: t["slot"] == F.col("slot")), F.lit(0))["label"]
    return rows.select("rec_id", "turn_no", "slot", F.array_join(graph.edge_lines(F.col("edges"), F.col("slot"), (*graph.POSITIVE, *graph.NEGATIVE), F.coalesce(label, F.lit("none"))), "\n").alias("lines"))


query("slot_events_of_graphs", M.SLOT_EVENTS)(lambda spark, sf_dir: graph.slot_event(graph.graph_store(dialogues(spark, sf_dir), slots(spark, sf_dir)).withColumn("slot", F.explode("slots")), "slot").select("rec_id", "turn_no", "slot", "label", "from_slot", "from_turn", "prev", "curr", "carry", "neg_type"))
query("activation_samples", M.ACTIVATION_SAMPLES)(lambda spark, sf_dir: pairs.activation_samples(spread(dialogues(spark, sf_dir)), slots(spark, sf_dir)))
query("surface_mentions", M.SURFACE_MENTIONS)(lambda spark, sf_dir: pairs.surface_mentions(spread(dialogues(spark, sf_dir)), slots(spark, sf_dir)))
query("preference_pairs", M.PREFERENCE_PAIRS)(lambda spark, sf_dir: pairs.preference_pairs(spread(dialogues(spark, sf_dir)), slots(spark, sf_dir)))


@query("lexical_similarity", M.LEXICAL_SIMILARITY)
def lexical_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inactive slots whose words are at least a fifth like the turn's."""
    found = pairs.surface_mentions(dialogues(spark, sf_dir), slots(spark, sf_dir), most=1000, least=0.2)
    return found.select("rec_id", "turn_no", "slot", "similarity")


query("pair_dedupe", M.PAIR_DEDUPE)(lambda spark, sf_dir: pairs.preference_pairs(dialogues(spark, sf_dir), slots(spark, sf_dir)).groupBy("pair_type", "chosen", "rejected").agg(F.count("*").alias("n_pairs"), F.count_distinct("rec_id").alias("n_records")))


@query("domain_memory_latest", M.LATEST_MEMORY)
def domain_memory_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slot's latest activation before every turn."""
    known = turns.computed_once(dialogues(spark, sf_dir), _records=memory.memory_records())
    rows = turns.turn_table(known, computed={"latest": memory.latest_before(F.col("_records"))})
    return rows.select("rec_id", "turn_no", F.explode("latest").alias("m")).select("rec_id", "turn_no", "m.slot", F.col("m.turn_no").alias("last_turn"), "m.action", "m.value")


@query("pair_layouts", M.PAIR_LAYOUTS)
def pair_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = spread(dialogues(spark, sf_dir)), slots(spark, sf_dir)
    asked = prompts.action_prompts(pairs.preference_pairs(d, s), turns.contexts(d, 1), s)
    return pairs.pair_layout(asked, "openai").select(F.to_json("messages").alias("messages"), F.to_json("chosen").alias("chosen"), F.to_json("rejected").alias("rejected"))


@query("render_prompt", M.RENDER_PROMPT)
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = spread(dialogues(spark, sf_dir)), slots(spark, sf_dir)
    return prompts.activation_prompts(pairs.activation_samples(d, s), d, s).select("rec_id", "turn_no", "pos_slot", "sample_no", "gate", "prompt", "label")


query("value_prompts", M.VALUE_PROMPTS)(lambda spark, sf_dir: prompts.value_prompts(dialogues(spark, sf_dir), slots(spark, sf_dir)))


@query("reasoning_samples")
def reasoning_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all events, each with its examples from the whole store."""
    d, s = dialogues(spark, sf_dir), slots(spark, sf_dir)
    q, store, vectors = encoded(spark, sf_dir)
    found = retrieve.hybrid_retrieval(q, store, retrieve.slot_similarities(vectors), block=32_768).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws("::", "graph_id", "slot").alias("r")))), lambda x: x["r"]).alias("retrieved"))
    tokens = S.label_tokens(F.col("label2"))
    rows = turns.event_table(d).withColumn("query_id", F.concat_ws("::", "rec_id", "turn_no", "event_no")).join(found, "query_id", "left")
    events = rows.select("rec_id", "turn_no", "event_no", "slot", S.resolve_label(F.col("label1"), tokens, "prompt").alias("label"), "prev_val", "curr_val", S.tagged_value(tokens, "refered-slot").alias("ref_slot"), F.lit(-1).alias("ref_turn"), F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"))
    g = graph.graph_store(d, s).select("graph_id", "context", "edges").dropDuplicates(["graph_id"])
    return prompts.reasoning_samples(events, g, turns.contexts(d, 4, "spoken"), s)


@query("best_text_match", M.BEST_TEXT_MATCH)
def best_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn each user text belongs to, found by its words."""
    d = dialogues(spark, sf_dir)
    return coref.best_turns(turns.turn_table(d, "user").select("rec_id", F.col("turn_no").alias("text_no"), F.col("user").alias("text")), d)


@query("reference_labels")
def reference_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event that carries a source turn taken as an annotation."""
    d = dialogues(spark, sf_dir)
    rows = turns.event_table(d).select("rec_id", "turn_no", S.domain_of(F.col("slot")).alias("domain"), F.col("slot").alias("slot_type"), F.col("curr_val").alias("true_value"), F.coalesce(S.tagged_value(S.label_tokens(F.col("label2"), "any"), "src-turn").try_cast("int"), F.lit(-1)).alias("source_turn"))
    return coref.reference_labels(rows, d).select("rec_id", "turn_no", "slot", joined("tags"), "prev_val", "curr_val")


@query("rolling_predict", M.ROLLING)
def rolling_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_batch(turns.turn_table(dialogues(spark, sf_dir), "user", "candidates")).select("key", "turn_no", F.array_join(F.transform(F.map_entries("predicted"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("predicted"), F.size("state").alias("n_slots"))


@query("rolling_cooperative", M.ROLLING)
def rolling_cooperative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one model call for a step of many dialogues."""

    def model(pending: list) -> list:
        return [rolling.carry_predictor(state, row) for state, row in pending]

    done = rolling.rolling_together(turns.turn_table(dialogues(spark, sf_dir), "user", "candidates"), model)
    return done.select("key", "turn_no", F.array_join(F.transform(F.map_entries("predicted"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("predicted"), F.size("state").alias("n_slots"))


# --- corpora: the dialogue table taken apart as raw logs and frames
of_dialogues("summary_before", M.SUMMARY_BEFORE, lambda d: turns.summaries_before(turns.turn_table(d, "user"), "user").select("rec_id", "turn_no", "summary_before"))
of_dialogues("masked_text", M.MASKED_TEXT, lambda d: turns.turn_table(d, "user").select("rec_id", "turn_no", X.mask_domains(F.col("user")).alias("masked")))
of_dialogues("snapshot_fill", M.SNAPSHOTS, lambda d: state.filled_snapshots(turns.turn_table(d, "active_intent", "tasklabel").select("rec_id", "turn_no", F.when(F.col("tasklabel") != "notask", F.col("active_intent")).alias("snapshot"))))


def belief(slot_values: F.Column) -> F.Column:
    """The hotel slots of a state as a belief state by domain."""
    part = lambda begin, keep: F.transform_keys(F.map_filter(slot_values, keep), lambda k, v: F.substring(k, begin, 2**31 - 1))
    booked = lambda k, v: F.startswith(k, F.lit("hotel-book "))
    return F.create_map(F.lit("hotel"), F.struct(part(12, booked).alias("book"), part(7, lambda k, v: F.startswith(k, F.lit("hotel-")) & ~booked(k, v)).alias("semi")))


@query("belief_rows", M.BELIEF_ROWS)
def belief_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.turn_table(dialogues(spark, sf_dir), "slot_values").where("slot_values is not null")
    return turns.belief_slots(rows.select("rec_id", "turn_no", belief(F.col("slot_values")).alias("metadata")), keys=["rec_id", "turn_no"])


@query("frame_rows", M.FRAME_ROWS)
def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slot with two values to choose from by the user's text."""
    rows = turns.turn_table(dialogues(spark, sf_dir), "user", "slot_values")
    lists = F.transform_values("slot_values", lambda k, v: F.array(F.lit("centre"), v))
    return turns.frame_values(rows.select("rec_id", "turn_no", "user", lists.alias("slot_values")), keys=["rec_id", "turn_no"], utterance="user")


@query("corpus_from_logs", M.FROM_LOGS)
def corpus_from_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as logs (user texts, then system texts with the state), read back as dialogues."""
    d = dialogues(spark, sf_dir).where(F.size("turns") > 0)
    system, user, states = F.col("turns.system"), F.col("turns.user"), F.col("turns.state.slot_values")
    empty = F.create_map().cast("map<string,string>")
    item = lambda text, m: F.struct(text.alias("text"), belief(F.coalesce(m, empty)).alias("metadata"))
    log = F.flatten(F.transform(user, lambda u, i: F.array(item(u, empty), item(F.coalesce(F.get(system, i + 1), F.lit("")), F.get(states, i)))))
    done = corpus.from_logs(d.select(F.col("rec_id").cast("string").alias("name"), log.alias("log")))
    return done.select("dial_id", F.posexplode("turns").alias("turn_no", "t")).select("dial_id", "turn_no", "t.system", "t.user", F.size("t.state.slot_values").alias("n_slots"))
