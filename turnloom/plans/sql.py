"""The SQL of the catalogue's queries, for a second engine over the same tables."""

from __future__ import annotations

from turnloom.functions import slots as S
from turnloom.functions import text as X

#: One row per turn: u is the turn, b the one before, i its place.
TURNS = """t AS (
  SELECT rec_id, dial_id, turns, CAST(i AS INTEGER) AS turn_no, turns[i + 1] AS u, CASE WHEN i > 0 THEN turns[i] END AS b
  FROM (SELECT rec_id, dial_id, turns, unnest(range(len(turns))) AS i FROM dialogue)
)"""
EVENTS = TURNS + """, e AS (
  SELECT rec_id, turn_no, turns, u, CAST(j AS INTEGER) AS event_no, u.taklabels[j + 1] AS ev
  FROM (SELECT *, unnest(range(len(u.taklabels))) AS j FROM t)
)"""
STATES = TURNS + """, s AS (
  SELECT rec_id, turn_no, x.key AS slot, x.value AS value FROM (SELECT rec_id, turn_no, unnest(map_entries(u.state.slot_values)) AS x FROM t)
)"""


def norm(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')))"


def norm_value(x: str) -> str:
    return f"regexp_replace({norm(x)}, '[\\s\\-_:]', '', 'g')"


def absent(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN '__ABSENT__' ELSE trim({x}) END"


def listed(words: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def is_none(x: str) -> str:
    return f"({norm(x)} IN {listed(X.NONE_TOKENS)} OR {norm_value(x)} IN {listed(X.NONE_TOKENS)})"


def none_or_empty(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) = '' OR lower(trim({x})) = 'none')"


def has(m: str, k: str) -> str:
    return f"coalesce(list_contains(map_keys({m}), {k}), false)"


def mentioned(value: str, text: str) -> str:
    v, t = norm(value), norm(text)
    return f"""CASE WHEN {v} = '' OR {t} = '' THEN false
      WHEN regexp_full_match({v}, '[0-9]+') THEN regexp_matches({t}, '\\b' || {v} || '\\b')
      ELSE contains({t}, {v}) OR contains({norm_value(text)}, {norm_value(value)}) END"""


def domain_or_slot(x: str) -> str:
    return f"split_part(coalesce({x}, ''), '-', 1)"


TURN_PAIRS = f"WITH {TURNS} SELECT rec_id, turn_no, coalesce(u.turn_id, turn_no) AS turn_id, u.system AS system, u.user AS user FROM t"
EVENT_ROWS = f"""WITH {EVENTS} SELECT rec_id, turn_no, event_no, ev.slot AS slot, ev."label-1" AS label1, ev."label-2" AS label2, ev.prev_val AS prev_val, ev.curr_val AS curr_val FROM e"""
STATE_ROWS = f"WITH {STATES} SELECT rec_id, turn_no, slot, value FROM s"
CONTEXT_K2 = f"""WITH {TURNS} SELECT rec_id, turn_no, array_to_string(list_transform(range(greatest(turn_no - 2, 0), turn_no + 1),
  lambda j: '[t' || j || '][SYS] ' || coalesce(turns[j + 1].system, '') || chr(10) || '[t' || j || '][USR] ' || coalesce(turns[j + 1].user, '')), chr(10)) AS context FROM t"""
CONTEXT_K4 = f"""WITH {TURNS} SELECT rec_id, turn_no, array_to_string(list_transform(range(greatest(turn_no - 4, 0), turn_no + 1),
  lambda j: 'system: ' || CASE WHEN trim(coalesce(turns[j + 1].system, '')) = '' THEN 'none' ELSE turns[j + 1].system END || ' user: ' || coalesce(turns[j + 1].user, '')), ' ') AS context FROM t"""
CONTEXT_K1 = f"""WITH {TURNS} SELECT rec_id, turn_no, array_to_string(list_filter(flatten(list_transform(range(greatest(turn_no - 1, 0), turn_no + 1),
  lambda j: [coalesce(turns[j + 1].system, ''), coalesce(turns[j + 1].user, '')])), lambda x: x <> ''), chr(10)) AS context FROM t"""
_DOMAINS = "list_distinct(list_transform(map_keys({m}), lambda k: split_part(k, '-', 1)))"
NEW_DOMAINS = f"""WITH {TURNS} SELECT rec_id, turn_no, coalesce(array_to_string(list_sort(list_filter({_DOMAINS.format(m="u.state.slot_values")},
  lambda d: NOT coalesce(list_contains({_DOMAINS.format(m="b.state.slot_values")}, d), false))), '|'), '') AS new_domains FROM t"""
SPEAKER_PAIRS = f"""WITH {TURNS} SELECT rec_id, turn_no, coalesce(last_value(u.system IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY turn_no), 'none') AS system, u.user AS user FROM t"""
RENESTED = """SELECT rec_id, CAST(len(turns) AS INTEGER) AS n_turns, md5(array_to_string(list_transform(turns, lambda t: coalesce(t.user, '')), chr(10))) AS user_md5 FROM dialogue WHERE len(turns) > 0"""
WELL_FORMED = r"""WITH w AS (SELECT rec_id, list_transform(coalesce(turns, []), lambda t: coalesce(t.system, '')) || list_transform(coalesce(turns, []), lambda t: coalesce(t.user, '')) AS said FROM dialogue)
SELECT rec_id FROM w WHERE len(list_filter(said, lambda x: NOT (regexp_full_match(x, '[\x00-\x7F]*', 's') AND len(string_split(x, ' ')) <= 50))) = 0"""

_LABEL_DELTA = f"""SELECT rec_id, turn_no, slot, CASE WHEN had THEN 'changed' ELSE 'added' END AS kind, prev_val, curr_val FROM (
    SELECT rec_id, turn_no, x.key AS slot, x.value AS curr_val, {has("b.state.slot_values", "x.key")} AS had, b.state.slot_values[x.key] AS prev_val
    FROM (SELECT *, unnest(map_entries(u.state.slot_values)) AS x FROM t))
  WHERE NOT had OR {norm("prev_val")} <> {norm("curr_val")}"""
_BOTH_KEYS = f"""k AS (
  SELECT rec_id, turn_no, k AS slot, {has("b.state.slot_values", "k")} AS had, {has("u.state.slot_values", "k")} AS has, b.state.slot_values[k] AS prev_val, u.state.slot_values[k] AS curr_val
  FROM (SELECT *, unnest(list_distinct(coalesce(map_keys(b.state.slot_values), []) || coalesce(map_keys(u.state.slot_values), []))) AS k FROM t)
)"""
_KIND = "CASE WHEN NOT had THEN 'added' WHEN NOT has THEN 'removed' ELSE 'changed' END AS kind"
_FOLD = f"""f AS (
  SELECT rec_id, slot, turn_no, eff AS curr_val, lag(eff) OVER w AS prev_val, lead(turn_no) OVER w AS until
  FROM (SELECT rec_id, slot, turn_no, CASE WHEN {none_or_empty("value")} THEN NULL ELSE trim(value) END AS eff FROM s)
  WINDOW w AS (PARTITION BY rec_id, slot ORDER BY turn_no)
)"""
DELTAS = {
    "label": f"WITH {TURNS} {_LABEL_DELTA}",
    "activation": f"WITH {TURNS}, {_BOTH_KEYS} SELECT rec_id, turn_no, slot, {_KIND}, prev_val, curr_val FROM k WHERE {absent('prev_val')} <> {absent('curr_val')}",
    "recheck": f"""WITH {TURNS}, {_BOTH_KEYS} SELECT rec_id, turn_no, slot, {_KIND}, prev_val, curr_val FROM k
      WHERE NOT (prev_val IS NULL AND curr_val IS NULL) AND coalesce(prev_val, 'None') <> coalesce(curr_val, 'None')""",
    "gold": f"""WITH {STATES}, {_FOLD} SELECT rec_id, turn_no, slot, CASE WHEN prev_val IS NULL THEN 'added' WHEN curr_val IS NULL THEN 'removed' ELSE 'changed' END AS kind, prev_val, curr_val
      FROM f WHERE prev_val IS DISTINCT FROM curr_val""",
}
CUMULATIVE = f"""WITH {STATES}, {_FOLD} SELECT t.rec_id, t.turn_no, f.slot, f.curr_val AS value FROM t JOIN f ON t.rec_id = f.rec_id AND t.turn_no >= f.turn_no AND (f.until IS NULL OR t.turn_no < f.until) WHERE f.curr_val IS NOT NULL"""
GOLD_TURNS = f"""WITH {STATES}, {_FOLD}, g AS (SELECT DISTINCT rec_id, turn_no FROM f WHERE prev_val IS DISTINCT FROM curr_val AND curr_val IS NOT NULL AND slot LIKE 'hotel-%')
SELECT t.rec_id, t.turn_no, g.rec_id IS NOT NULL AS is_gold FROM t LEFT JOIN g ON t.rec_id = g.rec_id AND t.turn_no = g.turn_no"""
CARRIED_DOMAIN = f"""WITH {TURNS}, d AS ({_LABEL_DELTA}), m AS (SELECT rec_id, turn_no, min(CASE WHEN contains(slot, '-') THEN split_part(slot, '-', 1) ELSE '' END) AS domain FROM d GROUP BY ALL)
SELECT t.rec_id, t.turn_no, coalesce(last_value(m.domain IGNORE NULLS) OVER (PARTITION BY t.rec_id ORDER BY t.turn_no), 'none') AS domain FROM t LEFT JOIN m ON t.rec_id = m.rec_id AND t.turn_no = m.turn_no"""
_L1 = f"""d AS ({_LABEL_DELTA}), l AS (
  SELECT d.rec_id, d.turn_no, d.slot, t.u.system AS sys, t.u.user AS usr, coalesce(d.prev_val, '') AS prev_val, coalesce(d.curr_val, '') AS curr_val,
    CASE WHEN kind = 'added' AND len(map_keys(t.b.state.slot_values)) > 0 AND NOT list_contains(list_transform(map_keys(t.b.state.slot_values), lambda k: split_part(k, '-', 1)), split_part(d.slot, '-', 1)) THEN 'switch'
         WHEN {norm_value("d.curr_val")} = 'dontcare' THEN 'dontcare' WHEN kind = 'added' THEN 'constrain' ELSE 'change' END AS label1
  FROM d JOIN t ON d.rec_id = t.rec_id AND d.turn_no = t.turn_no
), o AS (
  SELECT rec_id, turn_no, slot, label1, CASE WHEN label1 <> 'dontcare' AND NOT {is_none("curr_val")} AND {norm("curr_val")} <> 'yes'
    AND NOT ({mentioned("curr_val", "usr")}) AND ({mentioned("curr_val", "sys")}) THEN 'confirm' ELSE '' END AS label2, prev_val, curr_val FROM l
)"""
L1_LABELS = f"WITH {TURNS}, {_L1} SELECT * FROM o"
L1_COUNTS = f"WITH {TURNS}, {_L1} SELECT split_part(slot, '-', 1) AS domain, label1, label2, count(*) AS n FROM o GROUP BY ALL"
TURN_LABELS = f"""WITH {TURNS}, d AS ({_LABEL_DELTA}), c AS (SELECT rec_id, turn_no, count(*) AS n FROM d GROUP BY ALL)
SELECT t.rec_id, t.turn_no, CAST(coalesce(c.n, 0) AS INTEGER) AS n_events, CASE WHEN c.n IS NULL THEN 'notask' ELSE 'task' END AS tasklabel FROM t LEFT JOIN c ON t.rec_id = c.rec_id AND t.turn_no = c.turn_no"""
ACTIVATED = f"""WITH {TURNS} SELECT rec_id, turn_no, coalesce(array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(turns[1:turn_no], lambda x: coalesce(list_transform(x.taklabels, lambda y: y.slot), []))), lambda z: z IS NOT NULL))), '|'), '') AS activated FROM t"""
RUN_STARTS = f"""WITH {STATES}, c AS (SELECT * FROM s WHERE value IS NOT NULL AND value <> ''), r AS (
  SELECT *, turn_no - row_number() OVER (PARTITION BY rec_id, slot, value ORDER BY turn_no) AS run FROM c
), st AS (SELECT *, min(turn_no) OVER (PARTITION BY rec_id, slot, value, run) AS began FROM r)
SELECT rec_id, turn_no, slot, value, CAST(coalesce(lag(began) OVER (PARTITION BY rec_id, slot, value ORDER BY turn_no), -1) AS INTEGER) AS from_turn FROM st"""
FIRST_VALID = f"WITH {STATES} SELECT rec_id, slot, min(turn_no) AS ref_turn FROM s WHERE lower(trim(coalesce(value, ''))) NOT IN ('', 'none', 'dontcare') GROUP BY ALL"
ONTOLOGY = f"""WITH {STATES}, f AS (SELECT slot, value, min((rec_id, turn_no)) AS first FROM s WHERE value IS NOT NULL GROUP BY ALL)
SELECT slot, count(*) AS n_values, string_agg(value, '|' ORDER BY first, value) AS "values" FROM f GROUP BY slot"""


def tokens(x: str, separators: str = ",") -> str:
    text = f"trim(coalesce({x}, ''))"
    inner = f"""CASE WHEN regexp_full_match({text}, '\\[.*\\]', 's') THEN regexp_replace(regexp_replace({text}, '^\\[|\\]$', '', 'g'), '["'']', '', 'g') ELSE {text} END"""
    if separators == "pipe":
        parts = f"CASE WHEN regexp_full_match({text}, '\\[.*\\]', 's') THEN string_split({inner}, ',') ELSE string_split({inner}, '|') END"
    else:
        parts = f"string_split_regex({inner}, '{separators}')"
    return f"list_filter(list_transform({parts}, lambda x: trim(x)), lambda x: x <> '')"


def action(x: str) -> str:
    cases = " ".join(f"WHEN '{a.replace(chr(39), chr(39) * 2)}' THEN '{b}'" for a, b in S.ACTION_ALIASES.items())
    return f"CASE WHEN trim(coalesce({x}, '')) = '' THEN 'NONE' ELSE CASE lower(trim({x})) {cases} ELSE upper(trim({x})) END END"


_MEMORY = f"""CASE WHEN len(tk) = 0 THEN {action("l1")} WHEN list_contains(ac, 'REF-EXPLICIT') THEN 'REF-EXPLICIT' WHEN list_contains(ac, 'CONFIRM') THEN 'CONFIRM'
  WHEN list_contains(ac, 'REF-IMPLICIT') THEN 'REF-IMPLICIT' ELSE 'CONFIRM' END"""
_TOKENED = f"""k AS (SELECT rec_id, turn_no, event_no, ev.slot AS slot, ev."label-1" AS l1, trim(coalesce(ev.curr_val, '')) AS value, {tokens('ev."label-2"')} AS tk, {tokens('ev."label-2"', "[,;|+\\s]+")} AS any_tk FROM e),
a AS (SELECT *, list_transform(tk, lambda x: {action("x")}) AS ac, list_filter(list_transform(any_tk, lambda x: CASE WHEN contains(lower(x), 'clear') THEN 'refer-clear' WHEN contains(lower(x), 'implicit') THEN 'refer-implicit' END), lambda y: y IS NOT NULL)[1] AS named FROM k)"""
LABEL_RESOLUTION = f"""WITH {EVENTS}, {_TOKENED} SELECT rec_id, turn_no, event_no,
  CASE WHEN len(tk) = 0 THEN trim(coalesce(l1, '')) WHEN list_contains(tk, 'refer-clear') THEN 'refer-clear' ELSE 'confirm' END AS retrieval_a,
  CASE WHEN len(tk) = 0 THEN trim(coalesce(l1, '')) WHEN list_contains(tk, 'refer-clear') THEN 'refer-clear' WHEN list_contains(tk, 'refer-implicit') THEN 'refer-implicit' ELSE 'confirm' END AS retrieval_b,
  CASE WHEN len(tk) = 0 THEN trim(coalesce(l1, '')) WHEN list_contains(tk, 'refer-clear') THEN 'refer-clear' WHEN list_contains(tk, 'refer-implicit') THEN 'refer-implicit' ELSE 'confirm' END AS graph,
  CASE WHEN named IS NOT NULL THEN named WHEN len(any_tk) > 0 THEN 'confirm' WHEN trim(coalesce(l1, '')) = '' THEN 'confirm' ELSE lower(trim(l1)) END AS prompt,
  {_MEMORY} AS memory FROM a"""
TOKENS_PIPE = f"""WITH {EVENTS} SELECT rec_id, turn_no, event_no, coalesce(array_to_string({tokens('ev."label-2"', "pipe")}, '~'), '') AS tokens FROM e"""
SLOT_MEMORY = f"""WITH {EVENTS}, {_TOKENED}, m AS (SELECT rec_id, turn_no, event_no, slot, value, {_MEMORY} AS action FROM a), r AS (SELECT * FROM m WHERE action <> 'NONE' AND trim(coalesce(slot, '')) <> '')
SELECT m.rec_id, m.turn_no, m.event_no, m.slot, CAST(count(r.rec_id) AS INTEGER) AS n_before, max_by(r.turn_no, (r.turn_no, r.event_no)) AS last_turn, max_by(r.action, (r.turn_no, r.event_no)) AS last_action, max_by(r.value, (r.turn_no, r.event_no)) AS last_value
FROM m LEFT JOIN r ON m.rec_id = r.rec_id AND r.turn_no < m.turn_no AND trim(r.slot) = m.slot GROUP BY m.rec_id, m.turn_no, m.event_no, m.slot"""
MEMORY_ASOF = f"""WITH {EVENTS}, s AS (SELECT rec_id, turn_no, x.key AS slot FROM (SELECT rec_id, turn_no, unnest(map_entries(u.state.slot_values)) AS x FROM t)),
l AS (SELECT rec_id, ev.slot AS slot, turn_no, max_by(ev."label-1", event_no) AS label1 FROM e WHERE ev.slot IS NOT NULL GROUP BY ALL)
SELECT s.rec_id, s.slot, s.turn_no, max(l.turn_no) AS last_turn_no, max_by(l.label1, l.turn_no) AS last_label1 FROM s LEFT JOIN l ON s.rec_id = l.rec_id AND s.slot = l.slot AND l.turn_no < s.turn_no GROUP BY ALL"""


def phrases(words: tuple[str, ...]) -> str:
    return "\\b(" + "|".join(words) + ")\\b"


GATES = f"""WITH {TURNS}, g AS (SELECT rec_id, turn_no, lower(trim(coalesce(u.system, ''))) AS s, lower(trim(coalesce(u.user, ''))) AS r FROM t), h AS (
  SELECT *, list_filter(string_split_regex(r, '\\s+'), lambda x: x <> '') AS w,
    contains(s, '?') OR regexp_matches(s, '^\\s*({"|".join(X.QUESTION_WORDS)})\\b') OR regexp_matches(s, '^\\s*({"|".join(X.QUESTION_STARTS)})\\b') AS q,
    regexp_matches(s, '{phrases(X.OFFER_PHRASES)}') AS o, regexp_matches(r, '{phrases(X.DEIXIS_PHRASES)}') AS d, r IN {listed(X.CONFIRM_REPLIES)} AS c FROM g)
SELECT rec_id, turn_no, CASE WHEN c AND (o OR q) THEN 'CONFIRM' WHEN d AND o THEN 'DEIXIS'
  WHEN len(w) <= 3 AND NOT c AND NOT d AND q AND NOT list_has_any(w, [{", ".join("'" + w + "'" for w in X.INTENT_WORDS)}]) THEN 'SHORT_VALUE' ELSE 'OFF' END AS gate FROM h"""
VALUE_MENTIONS = f"WITH {STATES} SELECT s.rec_id, s.turn_no, s.slot FROM s JOIN t ON s.rec_id = t.rec_id AND s.turn_no = t.turn_no WHERE {mentioned('s.value', 't.u.user')}"
_BUCKET = "CAST(((('0x' || substr(md5({k}), 1, 16))::UBIGINT % 1000) * 616 + ('0x' || substr(md5({k}), 17, 16))::UBIGINT % 1000) % 1000 AS INTEGER)"
HASH_MASK = f"WITH {TURNS} SELECT rec_id, turn_no, {_BUCKET.format(k=chr(39) + '20251218|mask|' + chr(39) + ' || rec_id || ' + chr(39) + '|' + chr(39) + ' || turn_no')} < 300 AS masked FROM t"
HASH_UNIT = "SELECT rec_id, round(('0x' || substr(md5('13|' || rec_id), 1, 8))::UBIGINT / 4294967295.0::DOUBLE, 9) AS unit FROM dialogue"
_TYPE = "trim(regexp_replace(slot, '^[^-]*-', ''))"
_TAIL = f"trim(translate(regexp_replace(trim(regexp_replace(lower(trim(slot)), '^[^-]*-', '')), '^book\\s+', ''), '_-', '  '))"
SLOT_NAMES = f"""SELECT slot, CASE WHEN contains(slot, '-') THEN split_part(slot, '-', 1) ELSE '' END AS domain, {_TYPE} AS slot_type, '[domain]-' || {_TYPE} AS masked, lower(slot) AS canonical,
  CASE {_TAIL} {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.TYPE_SYNONYMS.items())} ELSE replace({_TAIL}, ' ', '') END AS kind FROM slot_descriptions"""

_SETS = "p AS (SELECT *, coalesce(list_distinct(list_filter(list_transform(domains, lambda d: lower(trim(d))), lambda d: d IS NOT NULL AND d <> '')), []) AS ds FROM dialogue)"
_TARGETS = "['restaurant', 'attraction', 'hotel', 'train', 'taxi']"
ALLOWED = f"WITH {_SETS} SELECT rec_id FROM p WHERE NOT list_has_any(ds, ['hospital', 'police']) AND len(list_filter(ds, lambda d: NOT list_contains({_TARGETS}, d))) = 0"
LOO_TRAIN = f"WITH {_SETS} SELECT rec_id FROM p WHERE NOT list_contains(ds, 'hotel')"
LOO_STRICT = f"WITH {_SETS} SELECT rec_id FROM p WHERE list_contains(ds, 'hotel') AND len(list_filter(ds, lambda d: list_contains({_TARGETS}, d))) = 1"
LOO_LOOSE = f"WITH {_SETS} SELECT rec_id FROM p WHERE list_contains(ds, 'hotel')"
LOO_ALL = f"""WITH {_SETS}, x AS (SELECT rec_id, split, ds, unnest({_TARGETS}) AS left_out FROM p)
SELECT rec_id, left_out, split AS part FROM x WHERE (split IN ('train', 'dev') AND NOT list_contains(ds, left_out)) OR (split = 'test' AND list_contains(ds, left_out) AND len(list_filter(ds, lambda d: list_contains({_TARGETS}, d))) = 1)"""
ID_LISTS = "SELECT rec_id, CASE WHEN dial_id IN (SELECT dial_id FROM dialogue WHERE split = 'test' AND dial_id IS NOT NULL) THEN 'test' WHEN dial_id IN (SELECT dial_id FROM dialogue WHERE split = 'dev' AND dial_id IS NOT NULL) THEN 'dev' ELSE 'train' END AS part FROM dialogue"
HASH_SPLIT = "SELECT rec_id, row_number() OVER (ORDER BY md5('13|' || rec_id), rec_id) <= round_even((SELECT count(*) FROM dialogue) * 0.35, 0) AS chosen FROM dialogue"
_UNIT = "((('0x' || substr(md5('13|' || p_brand || '|' || p_partkey), 1, 8))::UBIGINT / 4294967295.0::DOUBLE) * 4294967295.0 + 0.5) / 4294967296.0"
WEIGHTED = f"SELECT * FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY -ln({_UNIT}) / p_size, p_partkey) AS pick_no FROM part) WHERE pick_no <= 3"
ARGMIN = "SELECT p_brand, min_by(CAST(p_partkey AS VARCHAR), md5('13|' || p_brand || '|' || p_partkey)) AS p_partkey FROM part GROUP BY p_brand"
RANKED = """SELECT l_orderkey, CAST(tier AS BIGINT) AS tier, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, -price, l_linenumber) AS k FROM (
    SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS price, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS tier FROM lineitem)) WHERE k = 1"""

_COMPARED = TURNS + """, c0 AS (
  SELECT rec_id, turn_no, list_distinct(list_filter(coalesce(list_transform(u.taklabels, lambda x: x.slot), []), lambda x: x IS NOT NULL)) AS gold, list_distinct(list_filter(coalesce(u.candidates[1:2], []), lambda x: x IS NOT NULL)) AS pred, coalesce(u.candidates, []) AS candidates FROM t
), c AS (
  SELECT *, list_filter(gold, lambda x: list_contains(pred, x)) AS tp, list_sort(list_filter(gold, lambda x: NOT list_contains(pred, x))) AS missing, list_sort(list_filter(pred, lambda x: NOT list_contains(gold, x))) AS extra FROM c0 WHERE len(gold) > 0
)"""
_PRF = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS r"""
SLOT_SCORES = f"""WITH {_COMPARED}, h AS (SELECT unnest(tp) AS slot, 'tp' AS kind FROM c UNION ALL SELECT unnest(extra), 'fp' FROM c UNION ALL SELECT unnest(missing), 'fn' FROM c),
n AS (SELECT slot, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn FROM h GROUP BY GROUPING SETS ((slot), ())), q AS (SELECT *, {_PRF} FROM n)
SELECT slot, tp + fn AS n_gold, tp + fp AS n_pred, tp, fp, fn, round_even(p, 6) AS precision, round_even(r, 6) AS recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END, 6) AS f1 FROM q"""
EXACT_SET = f"""WITH {_COMPARED}, n AS (SELECT count(*) AS evaluated, count(*) FILTER (len(missing) = 0 AND len(extra) = 0) AS correct FROM c) SELECT evaluated, correct, coalesce(round_even(correct::DOUBLE / evaluated, 6), 0.0) AS accuracy FROM n"""
_TYPED = "CASE WHEN len(missing) > 0 AND len(extra) = 0 THEN 'miss_only' WHEN len(missing) = 0 AND len(extra) > 0 THEN 'extra_only' WHEN len(missing) > 0 THEN 'miss_and_extra' END"
ERROR_TYPES = f"WITH {_COMPARED} SELECT error_type, count(*) AS n FROM (SELECT {_TYPED} AS error_type FROM c) WHERE error_type IS NOT NULL GROUP BY ALL"
ERROR_SIZES = f"WITH {_COMPARED} SELECT CAST(len(missing) AS INTEGER) AS n_missing, CAST(len(extra) AS INTEGER) AS n_extra, count(*) AS n FROM c WHERE len(missing) + len(extra) > 0 GROUP BY ALL"
ERROR_SAMPLE = f"WITH {_COMPARED} SELECT rec_id, turn_no, coalesce(array_to_string(missing, '|'), '') AS missing, coalesce(array_to_string(extra, '|'), '') AS extra FROM c WHERE len(missing) + len(extra) > 0 ORDER BY rec_id, turn_no LIMIT 200"
TOP_MISSING = f"WITH {_COMPARED} SELECT slot, count(*) AS n FROM (SELECT unnest(missing) AS slot FROM c) GROUP BY slot ORDER BY n DESC, slot LIMIT 10"
COVERAGE = f"""WITH {_COMPARED}, n AS (SELECT count(*) AS n, count(*) FILTER (len(list_filter(gold, lambda x: NOT list_contains(candidates[1:3], x))) = 0) AS covered FROM c) SELECT n, covered, coalesce(round_even(covered::DOUBLE / n, 6), 0.0) AS coverage FROM n"""
LABEL_ACCURACY = f"""WITH {EVENTS}, {_L1}, g AS (SELECT rec_id, turn_no, ev.slot AS slot, max_by(ev."label-1", event_no) AS gold FROM e WHERE ev.slot IS NOT NULL GROUP BY ALL),
n AS (SELECT count(*) AS n, count(*) FILTER (g.gold = o.label1) AS correct FROM g LEFT JOIN o ON g.rec_id = o.rec_id AND g.turn_no = o.turn_no AND g.slot = o.slot) SELECT n, correct, coalesce(round_even(correct::DOUBLE / n, 6), 0.0) AS accuracy FROM n"""


def entries(m: str) -> str:
    return f"list_sort(list_filter(coalesce(map_entries({m}), []), lambda x: NOT {none_or_empty('x.value')}))"


JGA = f"""WITH {TURNS}, n AS (SELECT count(*) AS n_turns, count(*) FILTER ({entries("u.state.slot_values")} = {entries("b.state.slot_values")}) AS n_hits FROM t) SELECT n_turns, n_hits, coalesce(round_even(n_hits::DOUBLE / n_turns, 6), 0.0) AS jga FROM n"""
RECHECK = f"""WITH {TURNS}, {_BOTH_KEYS}, g AS (SELECT rec_id, turn_no, list(slot) AS changed FROM k WHERE NOT (prev_val IS NULL AND curr_val IS NULL) AND coalesce(prev_val, 'None') <> coalesce(curr_val, 'None') GROUP BY ALL),
p AS (SELECT t.rec_id, t.turn_no, list_distinct(list_transform(u.candidates[1:2], lambda x: lower(x))) AS pred, split_part(u.candidates[1], '-', 1) AS dom, coalesce(g.changed, []) AS changed FROM t LEFT JOIN g ON t.rec_id = g.rec_id AND t.turn_no = g.turn_no WHERE len(u.candidates) > 0),
q AS (SELECT list_sort(pred) AS pred, list_sort(list_filter(changed, lambda x: split_part(x, '-', 1) = dom)) AS gold FROM p),
n AS (SELECT count(*) AS evaluated, count(*) FILTER (gold = pred) AS correct FROM q) SELECT evaluated, correct, coalesce(round_even(correct::DOUBLE / evaluated, 6), 0.0) AS accuracy FROM n"""
CANDIDATE_ATTACH = f"""WITH {TURNS}, k AS (SELECT rec_id, dial_id, coalesce(u.turn_id, turn_no) AS turn_id FROM t) SELECT k.rec_id, k.turn_id, coalesce(array_to_string(g.slots, '|'), '') AS candidates FROM k LEFT JOIN graph_store g ON k.dial_id = g.dial_id AND k.turn_id = g.turn_id"""
MISSING_KEYS = f"""WITH {TURNS}, k AS (SELECT dial_id, coalesce(u.turn_id, turn_no) AS turn_id FROM t), l AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM graph_store g WHERE g.dial_id = k.dial_id AND g.turn_id = k.turn_id))
SELECT CASE WHEN coalesce(dial_id, '') = '' THEN 'no_dial_id' WHEN dial_id NOT IN (SELECT dial_id FROM graph_store) THEN 'dial_not_in_candidates' ELSE 'turn_not_in_candidates' END AS reason, count(*) AS n FROM l GROUP BY ALL"""
KNN = """WITH p AS (SELECT q.vec_id AS query_id, i.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 9) AS score FROM embeddings q JOIN embeddings i ON q.label = i.label AND q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS place, vec_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS place FROM p) WHERE place <= 3"""
PARSED_RETRIEVED = "SELECT graph_id, dial_id, turn_id, unnest(slots) AS slot FROM graph_store"
_TL = f"""k AS (SELECT rec_id, turn_no, event_no, trim(ev.slot) AS slot, trim(coalesce(ev."label-1", '')) AS l1, trim(coalesce(ev.prev_val, '')) AS pv, trim(coalesce(ev.curr_val, '')) AS cv, {tokens('ev."label-2"')} AS tk FROM e WHERE trim(coalesce(ev.slot, '')) <> ''),
g AS (SELECT *, CASE WHEN len(tk) = 0 THEN l1 WHEN list_contains(tk, 'refer-clear') THEN 'refer-clear' WHEN list_contains(tk, 'refer-implicit') THEN 'refer-implicit' ELSE 'confirm' END AS label,
  coalesce(trim(substr(list_filter(tk, lambda x: starts_with(x, 'refered-slot:'))[1], 14)), '') AS ref FROM k)"""
EDGES = f"""WITH {EVENTS}, {_TL} SELECT DISTINCT rec_id, turn_no, rel, src, dst, value FROM (
  SELECT rec_id, turn_no, 'activate_slot' AS rel, 'ctx' AS src, slot AS dst, '' AS value FROM g
  UNION ALL SELECT rec_id, turn_no, 'apply_label', slot, slot, '' FROM g
  UNION ALL SELECT rec_id, turn_no, 'triggers_dontcare', 'ctx', slot, '' FROM g WHERE label = 'dontcare'
  UNION ALL SELECT rec_id, turn_no, 'refer_to', slot, ref, '' FROM g WHERE label = 'refer-clear' AND ref <> ''
  UNION ALL SELECT rec_id, turn_no, 'value_prev', slot, slot, pv FROM g WHERE pv NOT IN ('', 'none')
  UNION ALL SELECT rec_id, turn_no, 'value_curr', slot, slot, cv FROM g WHERE cv NOT IN ('', 'none'))"""
