"""SQL of the queries that build samples, graphs and texts. Fixed values are written out here, so a wrong list in the library shows."""

from __future__ import annotations

from turnloom.plans.sql import _MEMORY, _TL, _TOKENED, EVENTS, TURNS

_KEPT = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"  # distinct, in order


def distinct(items: str) -> str:
    return _KEPT.format(l=f"({items})")


def domain(x: str) -> str:
    return f"CASE WHEN contains({x}, '-') THEN split_part({x}, '-', 1) ELSE '' END"


def kind(x: str) -> str:
    return f"trim(regexp_replace({x}, '^[^-]*-', ''))"


def unit(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT / 4294967295.0::DOUBLE)"


def tagged(tk: str, tag: str) -> str:
    return f"coalesce(trim(substr(list_filter({tk}, lambda x: starts_with(x, '{tag}:'))[1], {len(tag) + 2})), '')"


def or_default(x: str, default: str = "none") -> str:
    return f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN '{default}' ELSE trim({x}) END"


def json_list(x: str) -> str:
    return f"'[' || array_to_string(list_transform({x}, lambda x: '\"' || replace(replace(x, '\\', '\\\\'), '\"', '\\\"') || '\"'), ', ') || ']'"


def candidates(values: str, slot_type: str) -> str:
    named = f"list_filter({values}, lambda x: x IS NOT NULL AND x <> 'none')"
    return f"CASE WHEN len({values}) > 0 THEN {distinct(named)}[1:20] || ['none'] WHEN {slot_type} IN ('arriveby', 'leaveat', 'book time') THEN ['hh:mm', 'none'] ELSE ['<as spoken>', 'none'] END"


_EXAMPLES = distinct("list_filter(list_transform(value, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '')")
_FIELD = "trim(coalesce({c}, ''))"
_DESCRIBED = f"""ds AS (SELECT slot, value, {kind("slot")} AS slot_type, {", ".join(f"{_FIELD.format(c=c)} AS {c[0]}" for c in ("type_desc", "concise_desc", "question_desc", "nli_desc"))}, trim(coalesce(contras_desc, '')) AS w,
  array_to_string(coalesce(value, [])[1:20], ' | ') AS vs, array_to_string(coalesce(value, [])[1:20], ' ') AS vb, {_EXAMPLES} AS ex FROM slot_descriptions)"""
_LISTED_VALUES = "CASE WHEN coalesce(len(ex), 0) = 0 THEN 'None' ELSE array_to_string(ex[1:10], ', ') END"
SLOT_TEXTS = f"""WITH {_DESCRIBED} SELECT slot,
  concat_ws('; ', CASE WHEN c <> '' THEN 'concise_desc: ' || c END, CASE WHEN w <> '' THEN 'contras_desc: ' || w END, CASE WHEN n <> '' THEN 'nli_desc: ' || n END, CASE WHEN q <> '' THEN 'question_desc: ' || q END, CASE WHEN t <> '' THEN 'type_desc: ' || t END, CASE WHEN vs <> '' THEN 'value: ' || vs END) AS serialized,
  concat_ws(' | ', CASE WHEN t <> '' THEN t END, CASE WHEN q <> '' THEN q END, CASE WHEN w <> '' THEN w END) AS pipe_text,
  'TYPE: ' || t || ' DESC: ' || c || ' Q: ' || q || ' NOT: ' || w AS model_text, {_LISTED_VALUES} AS examples, {json_list(candidates("value", "slot_type"))} AS candidates FROM ds"""
_SPOKEN = "array_to_string(list_transform(range(greatest(turn_no - 4, 0), turn_no + 1), lambda j: 'system: ' || CASE WHEN trim(coalesce(turns[j + 1].system, '')) = '' THEN 'none' ELSE turns[j + 1].system END || ' user: ' || coalesce(turns[j + 1].user, '')), ' ')"
VALUE_PROMPTS = f"""WITH {EVENTS}, p AS (SELECT rec_id, turn_no, event_no, {_SPOKEN} AS context, ev.slot AS slot, ev.prev_val AS pv FROM e)
SELECT p.rec_id, p.turn_no, p.event_no, p.slot, concat_ws(chr(10), context, 'slot: ' || p.slot, 'before: ' || {or_default("pv")}, 'choose from: ' || {json_list(candidates("d.value", kind("p.slot")))}) AS prompt FROM p LEFT JOIN slot_descriptions d ON p.slot = d.slot"""

# --- activation samples
_GOLD = distinct("list_filter(list_transform(u.taklabels, lambda x: x.slot), lambda x: x IS NOT NULL AND x <> '')")
_CAND = distinct("list_filter(coalesce(u.candidates, []), lambda x: x IS NOT NULL)")
_KEYED = "md5(concat_ws('|', '20251218', rec_id, turn_no, '{tag}', pos_slot, slot))"
_SAMPLES = f"""g AS (SELECT rec_id, turn_no, {_GOLD} AS gold, {_CAND} AS cand FROM t WHERE len(u.taklabels) > 0),
p AS (SELECT *, unnest(gold) AS pos_slot FROM g), us AS (SELECT DISTINCT slot FROM slot_descriptions),
o AS (SELECT rec_id, turn_no, pos_slot, cand[i + 1] AS slot, i AS seen, gold FROM (SELECT *, unnest(range(len(cand))) AS i FROM p)
  UNION ALL SELECT rec_id, turn_no, pos_slot, slot, NULL, gold FROM p, us WHERE NOT list_contains(cand, slot)),
f AS (SELECT *, {domain("slot")} = {domain("pos_slot")} AS same_d, {kind("slot")} = {kind("pos_slot")} AS same_k FROM o WHERE NOT list_contains(gold, slot)),
a AS (SELECT rec_id, turn_no, pos_slot, arg_min(slot, (CASE WHEN seen IS NULL THEN 2 ELSE 0 END, CASE WHEN seen IS NULL THEN {_KEYED.format(tag="negA")} ELSE lpad(CAST(seen AS VARCHAR), 32, '0') END, slot)) AS a FROM f WHERE same_k AND NOT same_d GROUP BY ALL),
b0 AS (SELECT rec_id, turn_no, pos_slot, slot, CASE WHEN seen IS NULL THEN 2 WHEN seen < 10 THEN 0 ELSE 1 END AS tier, CASE WHEN seen IS NULL THEN {_KEYED.format(tag="negB")} ELSE lpad(CAST(seen AS VARCHAR), 32, '0') END AS rank FROM f WHERE same_d AND NOT same_k),
bn AS (SELECT rec_id, turn_no, pos_slot, count(*) AS n FROM b0 GROUP BY ALL),
b1 AS (SELECT * FROM b0 UNION ALL SELECT p.rec_id, p.turn_no, p.pos_slot, us.slot, 3, md5(concat_ws('|', '20251218', p.rec_id, p.turn_no, 'any', p.pos_slot, us.slot)) FROM p CROSS JOIN us LEFT JOIN bn USING (rec_id, turn_no, pos_slot) WHERE NOT list_contains(gold, us.slot) AND coalesce(bn.n, 0) <= 2),
b2 AS (SELECT rec_id, turn_no, pos_slot, slot, min((tier, rank)) AS place FROM b1 GROUP BY ALL),
b AS (SELECT b2.rec_id, b2.turn_no, b2.pos_slot, list(b2.slot ORDER BY place, b2.slot) AS l FROM b2 LEFT JOIN a USING (rec_id, turn_no, pos_slot) WHERE b2.slot IS DISTINCT FROM a.a GROUP BY ALL),
s AS (SELECT p.rec_id, p.turn_no, p.pos_slot, a.a, b.l[1] AS b1, b.l[2] AS b2 FROM p LEFT JOIN a USING (rec_id, turn_no, pos_slot) LEFT JOIN b USING (rec_id, turn_no, pos_slot)),
x AS (SELECT rec_id, turn_no, pos_slot, coalesce(a, b1) AS n1, CASE WHEN a IS NOT NULL THEN 'neg_same_type_diff_domain' ELSE 'neg_same_domain_diff_type' END AS k1, CASE WHEN a IS NOT NULL THEN b1 ELSE b2 END AS n2 FROM s),
samples AS (SELECT rec_id, turn_no, pos_slot, 0 AS sample_no, pos_slot AS slot, 'pos' AS sample_type, 'yes' AS label FROM x
  UNION ALL SELECT rec_id, turn_no, pos_slot, 1, n1, k1, 'no' FROM x WHERE n1 IS NOT NULL
  UNION ALL SELECT rec_id, turn_no, pos_slot, 2, coalesce(n2, n1), CASE WHEN n2 IS NOT NULL THEN 'neg_same_domain_diff_type' ELSE 'neg_fallback_duplicate' END, 'no' FROM x WHERE n1 IS NOT NULL)"""
ACTIVATION_SAMPLES = f"WITH {TURNS}, {_SAMPLES} SELECT rec_id, turn_no, pos_slot, CAST(sample_no AS INTEGER) AS sample_no, slot, sample_type, label FROM samples"

_GATED = """q AS (SELECT rec_id, turn_no, u, turns, lower(trim(coalesce(u.system, ''))) AS s, lower(trim(coalesce(u.user, ''))) AS r FROM t), h AS (
  SELECT *, list_filter(string_split_regex(r, '\\s+'), lambda x: x <> '') AS w,
    contains(s, '?') OR regexp_matches(s, '^\\s*(what|which|when|where|how)\\b') OR regexp_matches(s, '^\\s*(do you|would you|could you|can you)\\b') AS asked,
    regexp_matches(s, '\\b(i found|the closest|the only|available|option|recommend|is that ok|is that okay|would you like)\\b') AS offer, regexp_matches(r, '\\b(that one|this one|the first|the second|the other|it|there)\\b') AS points,
    r IN ('yes', 'yeah', 'yep', 'no', 'nope', 'ok', 'okay', 'correct', 'right', 'sure', 'fine') AS reply FROM q),
gates AS (SELECT *, CASE WHEN reply AND (offer OR asked) THEN 'CONFIRM' WHEN points AND offer THEN 'DEIXIS'
  WHEN len(w) <= 3 AND NOT reply AND NOT points AND asked AND NOT list_has_any(w, ['want', 'need', 'looking', 'find', 'book', 'prefer', 'instead', 'actually', 'change', 'not']) THEN 'SHORT_VALUE' ELSE 'OFF' END AS gate,
  list_sort(list_distinct(list_filter(flatten(list_transform(turns[1:turn_no], lambda x: coalesce(list_transform(x.taklabels, lambda y: y.slot), []))), lambda z: z IS NOT NULL))) AS activated FROM h)"""
_NOTES = """CASE gate WHEN 'CONFIRM' THEN 'The reply accepts or rejects what the system said; read the system turn only to learn what.'
  WHEN 'DEIXIS' THEN 'The reply points at something; read the system turn only to learn at what.' WHEN 'SHORT_VALUE' THEN 'The reply is a bare value; read the system''s question only to learn for which slot.' END"""
RENDER_PROMPT = f"""WITH {TURNS}, {_SAMPLES}, {_GATED}, {_DESCRIBED}
SELECT m.rec_id, m.turn_no, m.pos_slot, CAST(m.sample_no AS INTEGER) AS sample_no, gate, concat_ws(chr(10) || chr(10),
  '[Turn]' || chr(10) || 'System: ' || {or_default("h.u.system")} || chr(10) || 'User: ' || {or_default("h.u.user")},
  '[Active so far]' || chr(10) || CASE WHEN coalesce(len(activated), 0) = 0 THEN 'None' WHEN len(activated) > 30 THEN array_to_string(activated[1:30] || ['...'], ', ') ELSE array_to_string(activated, ', ') END,
  '[Slot]' || chr(10) || m.slot, '[Values]' || chr(10) || {_LISTED_VALUES}, '[Meaning]' || chr(10) || CASE WHEN coalesce(c, '') = '' THEN 'None' ELSE c END || chr(10) || CASE WHEN coalesce(ds.w, '') = '' THEN 'None' ELSE ds.w END,
  '[Gate]' || chr(10) || {_NOTES}, 'Does this turn change the slot? Answer yes or no.') AS prompt, m.label
FROM samples m JOIN gates h ON m.rec_id = h.rec_id AND m.turn_no = h.turn_no LEFT JOIN ds ON m.slot = ds.slot"""

# --- surface mentions, memories, preference pairs
_PLAIN = "array_to_string(list_filter(flatten(list_transform(range(greatest(turn_no - 1, 0), turn_no + 1), lambda j: [coalesce(turns[j + 1].system, ''), coalesce(turns[j + 1].user, '')])), lambda x: x <> ''), chr(10))"
_WORDS = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
_SURFACE = f"""{_DESCRIBED}, lex AS (SELECT slot, {_WORDS.format(x="concat_ws(' ', replace(slot, '-', ' '), CASE WHEN c <> '' THEN c END, CASE WHEN w <> '' THEN w END, CASE WHEN t <> '' THEN t END, vb)")} AS lw FROM ds),
tw AS (SELECT rec_id, turn_no, coalesce(list_transform(u.taklabels, lambda x: x.slot), []) AS active, {_WORDS.format(x=_PLAIN)} AS words FROM t),
sim AS (SELECT rec_id, turn_no, slot, CASE WHEN len(lw) = 0 OR len(words) = 0 THEN 0.0 ELSE round(len(list_intersect(lw, words)) / sqrt(len(lw) * len(words)), 9) END AS similarity, {unit("'13'", "'surface'", "rec_id", "turn_no", "slot")} AS h FROM tw, lex WHERE NOT coalesce(list_contains(active, slot), false)),
surface AS (SELECT rec_id, turn_no, slot, similarity FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, turn_no ORDER BY similarity DESC, h, slot) AS k FROM sim) WHERE k = 1)"""
SURFACE_MENTIONS = f"WITH {TURNS}, {_SURFACE} SELECT rec_id, turn_no, slot, similarity, CAST(1 AS INTEGER) AS rank FROM surface"
LEXICAL_SIMILARITY = f"WITH {TURNS}, {_SURFACE} SELECT rec_id, turn_no, slot, similarity FROM sim WHERE similarity >= 0.2"
_RECORDS = f"""{_TOKENED}, rec AS (SELECT rec_id, turn_no, event_no, trim(coalesce(slot, '')) AS slot, value, tk, {_MEMORY} AS action FROM a), act AS (SELECT * FROM rec WHERE slot <> '' AND action <> 'NONE'),
latest AS (SELECT t.rec_id, t.turn_no, r.slot, max_by(r.turn_no, (r.turn_no, r.event_no)) AS last_at, max_by(r.action, (r.turn_no, r.event_no)) AS action, max_by(r.value, (r.turn_no, r.event_no)) AS value FROM t JOIN act r ON t.rec_id = r.rec_id AND r.turn_no < t.turn_no GROUP BY ALL)"""
LATEST_MEMORY = f"WITH {EVENTS}, {_RECORDS} SELECT rec_id, turn_no, slot, last_at AS last_turn, action, value FROM latest"
_RAW_PAIRS = f"""{_SURFACE}, {_RECORDS},
gold AS (SELECT rec_id, turn_no, slot, max_by(action, event_no) AS chosen, max_by(value, event_no) AS value, max_by({tagged("tk", "refered-slot")}, event_no) AS ref_slot FROM rec WHERE slot <> '' GROUP BY ALL),
pb AS (SELECT rec_id, turn_no, slot, chosen, CASE chosen WHEN 'CHANGE' THEN 'CONSTRAIN' WHEN 'CONSTRAIN' THEN 'CHANGE' WHEN 'CONFIRM' THEN 'CONSTRAIN' WHEN 'SWITCH' THEN 'CONSTRAIN' WHEN 'DONTCARE' THEN 'NONE' WHEN 'REF-IMPLICIT' THEN 'REF-EXPLICIT' ELSE 'CONSTRAIN' END AS rejected, value, ref_slot
  FROM gold WHERE chosen IN ('CONSTRAIN', 'CHANGE', 'SWITCH', 'DONTCARE', 'CONFIRM', 'REF-EXPLICIT', 'REF-IMPLICIT')),
idle AS (SELECT l.rec_id, l.turn_no, l.slot, l.action, row_number() OVER (PARTITION BY l.rec_id, l.turn_no ORDER BY l.slot) AS k FROM latest l JOIN t ON l.rec_id = t.rec_id AND l.turn_no = t.turn_no
  WHERE l.slot IN (SELECT slot FROM slot_descriptions) AND NOT coalesce(list_contains(list_transform(t.u.taklabels, lambda x: trim(x.slot)), l.slot), false)),
raw AS (SELECT rec_id, turn_no, slot, chosen, rejected, 1 AS o, 'P_B_label_confusion' AS pair_type, value, ref_slot, 'taken for ' || rejected AS reason FROM pb
  UNION ALL SELECT rec_id, turn_no, slot, 'NONE', 'CONSTRAIN', 3, 'P_A1_surface_mention', '', '', 'inactive slot most like the context' FROM surface
  UNION ALL SELECT rec_id, turn_no, slot, 'NONE', action, 4, 'P_A2_memory_interference', '', '', 'inactive slot with a memory' FROM idle WHERE k <= 2),
one AS (SELECT *, {unit("'13'", "'mask'", "rec_id", "turn_no")} < 0.3 AS masked, row_number() OVER (PARTITION BY rec_id, turn_no, slot, chosen, rejected ORDER BY o) AS k FROM raw WHERE chosen <> rejected)"""
PREFERENCE_PAIRS = f"""WITH {EVENTS}, {_RAW_PAIRS} SELECT rec_id, turn_no, slot, CASE WHEN NOT masked THEN slot WHEN {kind("slot")} = '' THEN '[domain]' ELSE '[domain]-' || {kind("slot")} END AS target_slot, chosen, rejected, pair_type, value, ref_slot, masked, reason FROM one WHERE k = 1"""
PAIR_DEDUPE = f"WITH {EVENTS}, {_RAW_PAIRS} SELECT pair_type, chosen, rejected, count(*) AS n_pairs, count(DISTINCT rec_id) AS n_records FROM one WHERE k = 1 GROUP BY ALL"

_LINES = "list_transform(range(greatest({at} - 1, 0), {at} + 1), lambda j: concat_ws(chr(10), CASE WHEN coalesce(turns[j + 1].system, '') <> '' THEN '[t' || j || '][SYS] ' || turns[j + 1].system END, CASE WHEN coalesce(turns[j + 1].user, '') <> '' THEN '[t' || j || '][USR] ' || turns[j + 1].user END))"


def local(label: str, at: str, meta: str = "''") -> str:
    return f"'[{label} ' || greatest({at} - 1, 0) || '-' || {at} || ']' || {meta} || chr(10) || array_to_string(list_filter({_LINES.format(at=at)}, lambda x: x <> ''), chr(10))"


_META = "' (action: ' || r.action || CASE WHEN r.value <> '' THEN ', value: ' || r.value ELSE '' END || ')'"
MEMORY_CONTEXTS = f"""WITH {EVENTS}, {_RECORDS}, ev0 AS (SELECT r.rec_id, r.turn_no, r.event_no, r.slot, {tagged("r.tk", "refered-slot")} AS ref_slot, t.turns FROM rec r JOIN t ON r.rec_id = t.rec_id AND r.turn_no = t.turn_no),
own AS (SELECT v.rec_id, v.turn_no, v.event_no, string_agg({local("Memory turn", "r.turn_no", _META)}, chr(10) || chr(10) ORDER BY r.turn_no, r.event_no) AS txt FROM ev0 v JOIN act r ON v.rec_id = r.rec_id AND r.turn_no < v.turn_no AND r.slot = v.slot GROUP BY ALL),
ref AS (SELECT v.rec_id, v.turn_no, v.event_no, string_agg({local("Ref turn", "r.turn_no", _META)}, chr(10) || chr(10) ORDER BY r.turn_no, r.event_no) AS txt FROM ev0 v JOIN act r ON v.rec_id = r.rec_id AND r.turn_no < v.turn_no AND r.slot = v.ref_slot GROUP BY ALL),
dom AS (SELECT v.rec_id, v.turn_no, v.event_no, string_agg('- slot=' || l.slot || ', latest_turn=' || l.last_at || ', action=' || l.action || CASE WHEN l.value <> '' THEN ', value=' || l.value ELSE '' END, chr(10) ORDER BY l.slot) FILTER ({domain("l.slot")} = {domain("v.slot")} AND l.slot <> v.slot AND {domain("v.slot")} <> '') AS mine,
  array_to_string(list_sort(list_distinct(list({domain("l.slot")}) FILTER ({domain("l.slot")} <> {domain("v.slot")} AND {domain("l.slot")} <> ''))), ', ') AS others FROM ev0 v JOIN latest l ON v.rec_id = l.rec_id AND v.turn_no = l.turn_no GROUP BY ALL)
SELECT v.rec_id, v.turn_no, v.event_no, coalesce(own.txt, 'None') AS memory_turns, {local("Current turn", "v.turn_no")} AS current_turn,
  CASE WHEN dom.mine IS NOT NULL THEN dom.mine WHEN coalesce(dom.others, '') <> '' THEN 'No prior activation in target domain. Activated other domains: ' || dom.others ELSE 'None' END AS domain_context,
  CASE WHEN v.ref_slot = '' THEN 'None' WHEN ref.txt IS NOT NULL THEN '[Reference slot] ' || v.ref_slot || chr(10) || chr(10) || ref.txt ELSE '[Reference slot] ' || v.ref_slot || chr(10) || 'None' END AS ref_slot_memory, v.slot AS target_slot
FROM ev0 v LEFT JOIN own USING (rec_id, turn_no, event_no) LEFT JOIN ref USING (rec_id, turn_no, event_no) LEFT JOIN dom USING (rec_id, turn_no, event_no)"""

# --- negative slots and graphs
_WEIGHTS = """wt(slot, wgt) AS (VALUES ('attraction-area', 43), ('attraction-type', 18), ('attraction-name', 4), ('hotel-type', 133), ('hotel-pricerange', 125), ('hotel-area', 85), ('hotel-name', 65), ('hotel-stars', 55), ('hotel-internet', 34), ('hotel-parking', 24),
  ('hotel-book day', 23), ('hotel-book people', 18), ('hotel-book stay', 17), ('restaurant-name', 53), ('restaurant-area', 28), ('restaurant-food', 26), ('restaurant-book people', 15), ('restaurant-pricerange', 14), ('restaurant-book day', 13), ('restaurant-book time', 11),
  ('taxi-departure', 24), ('taxi-destination', 23), ('taxi-arriveby', 12), ('taxi-leaveat', 7), ('train-leaveat', 37), ('train-departure', 32), ('train-book people', 32), ('train-arriveby', 29), ('train-destination', 28), ('train-day', 19))"""
_ENEMY = """(({a_kind} = 'departure' AND {s_kind} = 'destination') OR ({a_kind} = 'destination' AND {s_kind} = 'departure') OR ({a_kind} = 'leaveat' AND {s_kind} = 'arriveby') OR ({a_kind} = 'arriveby' AND {s_kind} = 'leaveat')
  OR ({a_kind} = 'area' AND {s_kind} = 'name') OR ({a_kind} = 'name' AND {s_kind} IN ('area', 'type')) OR ({a_kind} = 'type' AND {s_kind} = 'name'))"""
_AFTER = "substr({x}, strpos({x}, '-') + 1)"


def negatives(rows: str, keys: str) -> str:
    """Tables ``neg``: the slots taken for each row of ``rows`` (id columns in ``keys``, active)."""
    first = f"""len(list_filter(active, lambda z: (contains(z, '-') AND contains(us.slot, '-') AND list_contains(universe, z) AND split_part(z, '-', 1) = split_part(us.slot, '-', 1) AND {_ENEMY.format(a_kind=_AFTER.format(x="z"), s_kind=_AFTER.format(x="us.slot"))})
      OR (us.slot IN ('hotel-name', 'attraction-name') AND z IN ('taxi-departure', 'taxi-destination') AND list_contains(universe, z)))) > 0"""
    return f"""{_WEIGHTS}, us AS (SELECT DISTINCT slot FROM slot_descriptions), uu AS (SELECT list(slot) AS universe FROM slot_descriptions), pool AS (SELECT {keys}, us.slot, CASE WHEN {first} THEN 0 WHEN list_contains(list_transform(active, lambda z: {domain("z")}), {domain("us.slot")}) THEN 1 ELSE 2 END AS tier,
    -ln(({unit("'13'", keys, "us.slot")} * 4294967295.0 + 0.5) / 4294967296.0) / coalesce(wgt, 1) AS key FROM {rows} CROSS JOIN us CROSS JOIN uu LEFT JOIN wt ON us.slot = wt.slot WHERE NOT list_contains(active, us.slot)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY tier, key, slot) AS k, count(*) FILTER (tier < 2) OVER (PARTITION BY {keys}) AS usable FROM pool),
  neg AS (SELECT * FROM ranked WHERE (usable > 0 AND tier < 2 AND k <= CASE WHEN {unit("'13'", "'count'", keys)} < 0.5 THEN 1 ELSE 2 END) OR (usable = 0 AND k = 1))"""


NEGATIVE_SLOTS = f"""WITH {TURNS}, n AS (SELECT rec_id, turn_no, list_filter(list_transform(u.taklabels, lambda x: x.slot), lambda x: x IS NOT NULL) AS active FROM t WHERE len(u.taklabels) > 0), {negatives("n", "rec_id, turn_no")}
SELECT rec_id, turn_no, slot, CAST(k AS INTEGER) AS pick_no FROM neg"""
_GRAPHS = f"""{EVENTS}, {_TL.replace("g AS (", "tl AS (")}, tn AS (SELECT rec_id, dial_id, turn_no, coalesce(u.turn_id, turn_no) AS turn_id, b, turns FROM t WHERE len(u.taklabels) > 0),
al AS (SELECT rec_id, turn_no, list(slot ORDER BY event_no) AS act FROM tl GROUP BY ALL), n AS (SELECT tn.*, coalesce(al.act, []) AS active FROM tn LEFT JOIN al USING (rec_id, turn_no)), {negatives("n", "rec_id, dial_id, turn_no")},
nv AS (SELECT n.rec_id, n.turn_no, neg.slot, neg.k, trim(coalesce(n.b.state.slot_values[neg.slot], '')) AS carried FROM neg JOIN n ON n.rec_id = neg.rec_id AND n.turn_no = neg.turn_no),
nc AS (SELECT *, CASE WHEN carried NOT IN ('', 'none') THEN carried ELSE 'none' END AS carry, CASE WHEN carried NOT IN ('', 'none') THEN 'ghost' ELSE 'void' END AS neg_type FROM nv),
lines AS (
  SELECT rec_id, turn_no, event_no * 10 AS o, 'activate_slot' AS rel, slot AS a, slot AS b, 'ctx' AS src, 'slot(' || slot || ')' AS dst FROM tl
  UNION ALL SELECT rec_id, turn_no, event_no * 10 + 1, 'apply_label', slot, slot, NULL, 'slot(' || slot || ')' FROM tl
  UNION ALL SELECT rec_id, turn_no, event_no * 10 + 2, 'triggers_dontcare', slot, slot, 'ctx', 'label(' || slot || ')' FROM tl WHERE label = 'dontcare'
  UNION ALL SELECT rec_id, turn_no, event_no * 10 + 3, 'refer_to', slot, ref, 'slot(' || slot || ')', 'slot(' || ref || ')' FROM tl WHERE label = 'refer-clear' AND ref <> ''
  UNION ALL SELECT rec_id, turn_no, event_no * 10 + 4, 'value_prev', slot, slot, 'slot(' || slot || ')', 'val(' || slot || '=' || pv || ', role=prev)' FROM tl WHERE pv NOT IN ('', 'none')
  UNION ALL SELECT rec_id, turn_no, event_no * 10 + 5, 'value_curr', slot, slot, 'slot(' || slot || ')', 'val(' || slot || '=' || cv || ', role=curr)' FROM tl WHERE cv NOT IN ('', 'none')
  UNION ALL SELECT rec_id, turn_no, 1000000 + k * 10, 'neg_slot', slot, slot, 'ctx', 'slot(' || slot || ')' FROM nc
  UNION ALL SELECT rec_id, turn_no, 1000000 + k * 10 + 1, 'value_carry', slot, slot, 'slot(' || slot || ')', 'val(' || slot || '=' || carry || ', role=carry)' FROM nc),
sl AS (SELECT rec_id, turn_no, slot FROM tl UNION SELECT rec_id, turn_no, slot FROM nc UNION SELECT rec_id, turn_no, ref FROM tl WHERE label = 'refer-clear' AND ref <> ''),
first_tl AS (SELECT rec_id, turn_no, slot, arg_min(label, event_no) AS label, arg_min(CASE WHEN label = 'refer-clear' THEN ref ELSE '' END, event_no) AS from_slot, arg_min(tk, event_no) AS tk, arg_min(cv, event_no) AS cv FROM tl GROUP BY ALL)"""
GRAPH_STORE = f"""WITH {_GRAPHS}, ls AS (SELECT rec_id, turn_no, string_agg(DISTINCT label, '|' ORDER BY label) AS ll FROM tl WHERE label <> '' GROUP BY ALL), ss AS (SELECT rec_id, turn_no, string_agg(slot, '|' ORDER BY slot) AS sl FROM sl GROUP BY ALL),
es AS (SELECT rec_id, turn_no, count(DISTINCT (rel, a, b, coalesce(src, ''), dst)) AS n FROM lines GROUP BY ALL)
SELECT n.rec_id, n.turn_no, coalesce(dial_id, '') || '::' || turn_id AS graph_id, coalesce(ll, '') AS labels_for_retrieval, coalesce(sl, '') AS slots, CAST(coalesce(es.n, 0) AS INTEGER) AS n_edges
FROM n LEFT JOIN ls USING (rec_id, turn_no) LEFT JOIN ss USING (rec_id, turn_no) LEFT JOIN es USING (rec_id, turn_no)"""
EDGE_FILTER = f"""WITH {_GRAPHS}, q AS (SELECT sl.rec_id, sl.turn_no, sl.slot, coalesce(l.src, 'label(' || coalesce(f.label, 'none') || ')') || ' --' || l.rel || '--> ' || l.dst AS line, min(l.o) AS o
  FROM sl JOIN lines l ON sl.rec_id = l.rec_id AND sl.turn_no = l.turn_no AND (l.a = sl.slot OR l.b = sl.slot) LEFT JOIN first_tl f ON f.rec_id = sl.rec_id AND f.turn_no = sl.turn_no AND f.slot = sl.slot GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, turn_no, slot ORDER BY o) AS k FROM q)
SELECT sl.rec_id, sl.turn_no, sl.slot, coalesce(string_agg('E' || k || ': ' || line, chr(10) ORDER BY k), '') AS lines FROM sl LEFT JOIN r USING (rec_id, turn_no, slot) GROUP BY ALL"""
_RUN = """(SELECT max(x.i) FROM (SELECT unnest(range(f.turn_no)) AS i) x WHERE coalesce(n.turns[x.i + 1].state.slot_values[f.from_slot] = f.wanted, false) AND NOT coalesce(x.i > 0 AND n.turns[x.i].state.slot_values[f.from_slot] = f.wanted, false))"""
SLOT_EVENTS = f"""WITH {_GRAPHS}, fw AS (SELECT *, CASE WHEN {tagged("tk", "refered-value")} <> '' THEN {tagged("tk", "refered-value")} ELSE cv END AS wanted FROM first_tl),
ft AS (SELECT f.*, CASE WHEN from_slot <> '' AND wanted <> '' THEN coalesce({_RUN}, -1) ELSE -1 END AS from_turn FROM fw f JOIN n ON f.rec_id = n.rec_id AND f.turn_no = n.turn_no),
vp AS (SELECT rec_id, turn_no, slot, arg_min(pv, event_no) FILTER (pv NOT IN ('', 'none')) AS prev, arg_min(cv, event_no) FILTER (cv NOT IN ('', 'none')) AS curr FROM tl GROUP BY ALL)
SELECT sl.rec_id, sl.turn_no, sl.slot, ft.label, ft.from_slot, CAST(ft.from_turn AS INTEGER) AS from_turn, vp.prev, vp.curr, nc.carry, nc.neg_type
FROM sl LEFT JOIN ft USING (rec_id, turn_no, slot) LEFT JOIN vp USING (rec_id, turn_no, slot) LEFT JOIN nc USING (rec_id, turn_no, slot)"""

# --- texts
_MATCH = "trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\\pL\\pM\\pN_\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_SET = "list_distinct(list_filter(string_split({x}, ' '), lambda z: z <> ''))"


def similar(x: str, y: str) -> str:
    return f"""CASE WHEN {x} = '' OR {y} = '' THEN 0.0 WHEN {x} = {y} THEN 1.0 WHEN contains({y}, {x}) OR contains({x}, {y}) THEN 0.95
      ELSE len(list_intersect({_SET.format(x=x)}, {_SET.format(x=y)}))::DOUBLE / len(list_distinct({_SET.format(x=x)} || {_SET.format(x=y)})) END"""


BEST_TEXT_MATCH = f"""WITH {TURNS}, m AS (SELECT rec_id, turn_no, {_MATCH.format(x="u.system")} AS s, {_MATCH.format(x="u.user")} AS r FROM t),
p AS (SELECT a.rec_id, a.turn_no AS text_no, b.turn_no, (b.s <> '' AND (a.r = b.s OR contains(b.s, a.r) OR contains(a.r, b.s))) OR (b.r <> '' AND (a.r = b.r OR contains(b.r, a.r) OR contains(a.r, b.r))) AS fits,
  greatest({similar("a.r", "b.s")}, {similar("a.r", "b.r")}) AS sim FROM m a JOIN m b ON a.rec_id = b.rec_id)
SELECT rec_id, text_no, coalesce(min(turn_no) FILTER (fits), CASE WHEN max(sim) >= 0.5 THEN max_by(turn_no, (sim, -turn_no)) END) AS turn_no FROM p GROUP BY ALL"""
_NUMBERS = "CASE z " + " ".join(f"WHEN '{w}' THEN '{i}'" for i, w in enumerate("zero one two three four five six seven eight nine ten".split())) + " ELSE z END"
_SHAPE = "^\\s*(\\d{1,2})(?:[:.](\\d{2}))?\\s*(am|pm)?\\s*$"
_HOUR = "CASE WHEN half = 'pm' AND hour BETWEEN 1 AND 11 THEN hour + 12 WHEN half = 'am' AND hour = 12 THEN 0 ELSE hour END"
NORMALIZE_VALUES = f"""WITH {TURNS}, v AS (SELECT DISTINCT x.key AS slot, x.value AS value FROM (SELECT unnest(map_entries(u.state.slot_values)) AS x FROM t) WHERE x.value IS NOT NULL),
a AS (SELECT *, lower(trim(value)) AS x, array_to_string(list_transform(string_split_regex(replace(lower(trim(value)), '&', ' and '), '\\s+'), lambda z: {_NUMBERS}), ' ') AS y FROM v),
b AS (SELECT *, (contains(y, 'am') OR contains(y, 'pm') OR contains(y, ':')) AND length(y) <= 10 AS timed, trim(y) AS ty FROM a),
c AS (SELECT *, regexp_matches(ty, '{_SHAPE}') AS shaped, TRY_CAST(regexp_extract(ty, '{_SHAPE}', 1) AS INTEGER) AS hour, regexp_extract(ty, '{_SHAPE}', 2) AS minute, regexp_extract(ty, '{_SHAPE}', 3) AS half FROM b),
d AS (SELECT *, CASE WHEN NOT timed THEN y WHEN shaped AND {_HOUR} BETWEEN 0 AND 23 THEN lpad(CAST({_HOUR} AS VARCHAR), 2, '0') || ':' || CASE WHEN minute = '' THEN '00' ELSE lpad(minute, 2, '0') END ELSE ty END AS z FROM c),
f AS (SELECT *, trim(regexp_replace(regexp_replace(z, '[^\\pL\\pM\\pN_\\s:/]+', ' ', 'g'), '\\s+', ' ', 'g')) AS w FROM d)
SELECT slot, value, CASE WHEN regexp_full_match(x, '[0-9]+') THEN regexp_replace(x, '^0+([0-9])', '\\1') WHEN regexp_full_match(w, '\\s*[0-9]+\\s*') THEN regexp_replace(trim(w), '^0+([0-9])', '\\1') ELSE w END AS norm FROM f"""
ROLLING = f"""WITH {TURNS}, w AS (SELECT rec_id, turn_no, trim(string_split(coalesce(u.user, ''), ',')[1]) AS words, u.candidates[1] AS slot FROM t),
c AS (SELECT *, words <> '' AND slot IS NOT NULL AS told FROM w),
o AS (SELECT w.rec_id, w.turn_no, count(DISTINCT p.slot) AS n FROM w JOIN (SELECT * FROM c WHERE told) p ON p.rec_id = w.rec_id AND p.turn_no <= w.turn_no GROUP BY ALL)
SELECT CAST(c.rec_id AS VARCHAR) AS key, c.turn_no, CASE WHEN told THEN c.slot || '=' || words ELSE '' END AS predicted, CAST(coalesce(o.n, 0) AS INTEGER) AS n_slots FROM c LEFT JOIN o USING (rec_id, turn_no)"""


def _corpus(x: str, word: str = "centre", to: str = "centre") -> str:
    """The corpus form of texts without lookaround: signs between digits are set aside while the others are set off."""
    x = f"replace(replace(trim(lower({x})), 'b&b', 'bed and breakfast'), 'b and b', 'bed and breakfast')"
    x = f"regexp_replace(replace(replace(replace(regexp_replace({x}, '[‘’]', '''', 'g'), ';', ','), '/', ' and '), '-', ' '), '[\"<>@()]', '', 'g')"
    for at, sign in enumerate("?.,!"):
        for _ in range(2):
            x = f"regexp_replace({x}, '([0-9])[{sign}]([0-9])', '\\1' || chr({at + 1}) || '\\2', 'g')"
        x = f"replace(replace({x}, '{sign}', ' {sign} '), chr({at + 1}), '{sign}')"
    x = f"regexp_replace(regexp_replace({x}, '''s( |$)', ' ''s\\1', 'g'), '''s([^ ])', ' '' s\\1', 'g')"
    x = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^''', ''), '''$', ''), '''\\s', ' ', 'g'), '\\s''', ' ', 'g')"
    x = f"trim(regexp_replace(replace(' ' || {x} || ' ', ' {word} ', ' {to} '), '\\s+', ' ', 'g'))"
    for _ in range(4):
        x = f"regexp_replace({x}, '(^| )([0-9]+) ([0-9]+)( |$)', '\\1\\2\\3\\4', 'g')"
    return x


CORPUS_TEXT = f"WITH {TURNS} SELECT rec_id, turn_no, {_corpus('u.user', to='center')} AS text FROM t"
SUMMARY_BEFORE = f"WITH {TURNS} SELECT rec_id, turn_no, {or_default('lag(u.user) OVER (PARTITION BY rec_id ORDER BY turn_no)', 'None')} AS summary_before FROM t"
MASKED_TEXT = f"WITH {TURNS} SELECT rec_id, turn_no, regexp_replace(regexp_replace(u.user, '\\b(hotel|restaurant|attraction|train|taxi)-', '[domain]-', 'g'), '\\b(hotel|restaurant|attraction|train|taxi)\\b', '[domain]', 'gi') AS masked FROM t"
SNAPSHOTS = f"WITH {TURNS} SELECT rec_id, turn_no, last_value(CASE WHEN u.tasklabel <> 'notask' THEN u.state.active_intent END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY turn_no) AS snapshot FROM t"
BELIEF_ROWS = f"WITH {TURNS}, s AS (SELECT rec_id, turn_no, x.key AS slot, x.value AS value FROM (SELECT rec_id, turn_no, unnest(map_entries(u.state.slot_values)) AS x FROM t)) SELECT rec_id, turn_no, slot, value FROM s WHERE slot LIKE 'hotel-%' AND lower(trim(value)) NOT IN ('', 'not mentioned', 'none')"
FRAME_ROWS = f"WITH {TURNS}, s AS (SELECT rec_id, turn_no, coalesce(lower(u.user), '') AS said, x.key AS slot, x.value AS value FROM (SELECT rec_id, turn_no, u, unnest(map_entries(u.state.slot_values)) AS x FROM t)) SELECT rec_id, turn_no, replace(slot, '_', ' ') AS slot, CASE WHEN NOT contains(said, 'centre') AND value IS NOT NULL AND contains(said, lower(value)) THEN value ELSE 'centre' END AS value FROM s"
FROM_LOGS = f"""WITH {TURNS}, bad AS (SELECT DISTINCT rec_id FROM (SELECT rec_id, coalesce(u.user, '') AS x FROM t UNION ALL SELECT rec_id, coalesce(u.system, '') FROM t WHERE turn_no > 0) WHERE NOT (regexp_full_match(x, '[\\x00-\\x7F]*', 's') AND len(string_split(x, ' ')) <= 50))
SELECT CAST(rec_id AS VARCHAR) AS dial_id, turn_no, CASE WHEN turn_no = 0 THEN 'none' ELSE {_corpus("coalesce(u.system, '')")} END AS system, {_corpus("u.user")} AS user,
  CAST(len(list_filter(coalesce(map_entries(u.state.slot_values), []), lambda e: starts_with(e.key, 'hotel-') AND coalesce(e.value, '') <> '' AND (starts_with(e.key, 'hotel-book ') OR e.value <> 'not mentioned'))) AS INTEGER) AS n_slots FROM t WHERE rec_id NOT IN (SELECT rec_id FROM bad)"""
_HIDDEN = "CASE WHEN masked THEN regexp_replace(regexp_replace({x}, '\\b(hotel|restaurant|attraction|train|taxi)-', '[domain]-', 'g'), '\\b(hotel|restaurant|attraction|train|taxi)\\b', '[domain]', 'gi') ELSE {x} END"
_TWO = "array_to_string(list_transform(range(greatest(t.turn_no - 1, 0), t.turn_no + 1), lambda j: '[t' || j || '][SYS] ' || coalesce(t.turns[j + 1].system, '') || chr(10) || '[t' || j || '][USR] ' || coalesce(t.turns[j + 1].user, '')), chr(10))"
PAIR_LAYOUTS = f"""WITH {EVENTS}, {_RAW_PAIRS}, x AS (SELECT one.*, {_TWO} AS context, CASE WHEN NOT masked THEN one.slot WHEN {kind("one.slot")} = '' THEN '[domain]' ELSE '[domain]-' || {kind("one.slot")} END AS target_slot, sd.slot IS NOT NULL AS described, coalesce(sd.type_desc, '') AS td, coalesce(sd.contras_desc, '') AS cd
  FROM one JOIN t ON one.rec_id = t.rec_id AND one.turn_no = t.turn_no LEFT JOIN slot_descriptions sd ON one.slot = sd.slot WHERE k = 1),
p AS (SELECT *, '[Dialogue]' || chr(10) || context || chr(10) || chr(10) || '[Slot]' || chr(10) || target_slot || chr(10) || chr(10) || '[Meaning]' || chr(10) || {_HIDDEN.format(x="td")} || chr(10) || {_HIDDEN.format(x="cd")} || chr(10) || chr(10) || 'Which action does the turn take on the slot?' AS prompt FROM x)
SELECT CAST(to_json([{{'role': 'system', 'content': 'You label what a dialogue turn does to a slot.'}}, {{'role': 'user', 'content': prompt}}]) AS VARCHAR) AS messages, CAST(to_json({{'role': 'assistant', 'content': chosen}}) AS VARCHAR) AS chosen, CAST(to_json({{'role': 'assistant', 'content': rejected}}) AS VARCHAR) AS rejected FROM p"""
