"""All core queries by name, with SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailbed.functions.text import ENTITY, action_kind, entities, is_blank, parent_key, parse_candidates, path_stem, path_suffix, signed, thousands
from trailbed.operators import arms as A
from trailbed.operators import audit, cohort, context, evaluation, scoring, selection, stats
from trailbed.operators import entities as names
from trailbed.operators.candidates import latest_candidates, long_candidates, long_scores
from trailbed.operators.flatten import BLOCKS, INPUT, MESSAGES, PARTS, TABLES, TOOLS, found_rows, session_groups, session_tables
from trailbed.operators.positions import anchor_share, anchors, distinct_positions, latest_blocks, messages, positions
from trailbed.session import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def sql(text: str) -> Callable[[Query], Query]:
    """Registers a query with its SQL; the common views below may be used in it."""

    def register(f: Query) -> Query:
        used, todo = [], [text]
        while todo:  # views that the text, or a view it uses, names
            t = todo.pop()
            for name, view in VIEWS.items():
                if name in t and name not in used:
                    used.append(name)
                    todo.append(view)
        views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in used)
        body = text.strip()
        if views:
            body = f"WITH {views}, {body[5:]}" if body.startswith("WITH ") else f"WITH {views} {body}"
        ORACLE[f.__name__] = body
        return query(f)

    return register


# Views of the SQL side, each the counterpart of one operator.
VIEWS = {
    "v_blocks": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, msg_idx, block_idx ORDER BY block_id DESC) AS rn FROM blocks) WHERE rn = 1",
    "v_pos": "SELECT *, sid || ':' || msg_idx || ':' || block_idx AS key FROM (SELECT DISTINCT * FROM positions)",
    "v_anchor": "SELECT * FROM v_pos WHERE has_real_thinking AND regexp_replace(coalesce(real_thinking_summary, ''), '\\s', '', 'g') <> ''",
    "v_cand": "SELECT key, candidates, provider FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(len(candidates), -1) DESC, coalesce(array_to_string(candidates, chr(1)), '') DESC, coalesce(provider, '') DESC) AS rn FROM candidates WHERE key IS NOT NULL) WHERE rn = 1",
    "v_lcand": "SELECT key, provider, CAST(i - 1 AS INT) AS cand_idx, candidates[i] AS r FROM (SELECT *, unnest(range(1, len(candidates) + 1)) AS i FROM v_cand)",
    "v_scores": "SELECT key, base, CAST(i - 1 AS INT) AS cand_idx, results[i].r AS r, results[i].s_suff AS s_suff, results[i].s_nat AS s_nat, coalesce(len(results[i].leak), 0) > 0 AS leaked FROM (SELECT *, unnest(range(1, len(results) + 1)) AS i FROM scores)",
    "v_best": "SELECT key, cand_idx, r, s_suff FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(s_suff, -1e9) DESC, cand_idx) AS rn FROM v_scores WHERE NOT leaked) WHERE rn = 1",
    "v_parts": "SELECT session_id, msg_idx, block_idx, CASE type WHEN 'text' THEN '[' || coalesce(role, '') || '] ' || coalesce(content, '') WHEN 'tool_use' THEN '[' || coalesce(role, '') || ' 调用 ' || coalesce(name, '?') || '] ' || left(coalesce(input, '{}'), 400) WHEN 'tool_result' THEN '[工具返回] ' || left(coalesce(content, ''), 800) END AS part FROM v_blocks WHERE type IN ('text', 'tool_use', 'tool_result')",
}


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return latest_blocks(table(spark, d, "blocks"))


def _given(spark: SparkSession, d: str) -> DataFrame:
    return distinct_positions(table(spark, d, "positions"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return latest_candidates(table(spark, d, "candidates"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return long_scores(table(spark, d, "scores"))


def _contexts(spark: SparkSession, d: str, max_chars: int, **how: object) -> DataFrame:
    """(sid, msg_idx, context) of the given positions."""
    at = _given(spark, d).select(F.col("sid").alias("session_id"), "msg_idx")
    return context.contexts(context.rendered(_blocks(spark, d), **how), at, max_chars).withColumnRenamed("session_id", "sid")


# Nested records (problem 4)


TREE_SQL = """
WITH o AS (SELECT line_no, raw AS j FROM raw_sessions WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
tree AS (SELECT o.line_no, t.type, t.fullkey, t.atom FROM o, json_tree(o.j) t WHERE starts_with(t.fullkey, '$.messages[')),
k AS (SELECT *, CAST(regexp_extract(fullkey, '^\\$\\.messages\\[(\\d+)\\]', 1) AS INT) AS msg_idx, regexp_replace(fullkey, '^\\$\\.messages\\[\\d+\\]', '') AS k1 FROM tree),
b AS (SELECT *, CAST(regexp_extract(k1, '^\\.content\\[(\\d+)\\]', 1) AS INT) AS block_idx, regexp_replace(k1, '^\\.content\\[\\d+\\]', '') AS k2 FROM k WHERE regexp_matches(k1, '^\\.content\\[\\d+\\]')),
ty AS (SELECT line_no, msg_idx, block_idx, json_extract_string(atom, '$') AS block_type FROM b WHERE k2 = '.type' AND type = 'VARCHAR'),
c AS (SELECT *, CAST(regexp_extract(k2, '^\\.content\\[(\\d+)\\]$', 1) AS INT) AS part_idx FROM b JOIN ty USING (line_no, msg_idx, block_idx) WHERE block_type = 'tool_result' AND regexp_matches(k2, '^\\.content\\[\\d+\\]$'))
"""
_SCALAR_SQL = "CASE WHEN json_type({0}, '$.{1}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string({0}, '$.{1}') END AS {2}"
_MESSAGES_SQL = """
WITH o AS (SELECT line_no, raw::JSON AS j FROM raw_sessions WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
m AS (SELECT line_no, CAST(i AS INT) AS msg_idx, json_extract(j, '$.messages[' || i || ']') AS m FROM (SELECT *, unnest(range(0, json_array_length(j, '$.messages')::BIGINT)) AS i FROM o WHERE json_type(j, '$.messages') = 'ARRAY')),
b AS (SELECT line_no, msg_idx, CAST(i AS INT) AS block_idx, json_extract(m, '$.content[' || i || ']') AS b FROM (SELECT *, unnest(range(0, json_array_length(m, '$.content')::BIGINT)) AS i FROM m WHERE json_type(m, '$.content') = 'ARRAY')),
c AS (SELECT line_no, msg_idx, block_idx, CAST(i AS INT) AS part_idx, json_extract(b, '$.content[' || i || ']') AS c FROM (SELECT *, unnest(range(0, json_array_length(b, '$.content')::BIGINT)) AS i FROM b WHERE json_type(b) = 'OBJECT' AND json_extract_string(b, '$.type') = 'tool_result' AND json_type(b, '$.content') = 'ARRAY'))
"""


def _members(row: str, names: list[str]) -> str:
    return ", ".join(_SCALAR_SQL.format(row, n, {"id": "call_id"}.get(n, n)) for n in names)


def _flat(spark: SparkSession, d: str, name: str) -> DataFrame:
    only = [TABLES[name]] if name in TABLES else None
    return session_tables(session_groups(table(spark, d, "raw_sessions"), only))[name].withColumnRenamed("id", "line_no")


@sql(TREE_SQL + """
SELECT line_no, msg_idx, -1 AS block_idx, -1 AS part_idx, '' AS path FROM k WHERE k1 = ''
UNION ALL SELECT line_no, msg_idx, block_idx, -1, '' FROM b WHERE k2 = '' AND type = 'OBJECT'
UNION ALL SELECT line_no, msg_idx, block_idx, part_idx, '' FROM c WHERE type = 'OBJECT'
UNION ALL SELECT line_no, msg_idx, block_idx, -1, CASE WHEN k2 = '.input' THEN '$' ELSE regexp_replace(replace(k2[7:], '"', ''), '^\\.', '') END
FROM b JOIN ty USING (line_no, msg_idx, block_idx) WHERE block_type = 'tool_use' AND type NOT IN ('OBJECT', 'ARRAY') AND regexp_matches(k2, '^\\.input($|[.\\[])')""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return found_rows(session_groups(table(spark, d, "raw_sessions"), [MESSAGES, BLOCKS, PARTS, INPUT], keys=True))


@sql(_MESSAGES_SQL + f"SELECT line_no, msg_idx, {_members('m', ['role', 'content'])} FROM m")
def p4_messages(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "messages")


@sql(_MESSAGES_SQL + f"SELECT line_no, msg_idx, block_idx, {_members('b', ['type', 'name', 'text', 'thinking', 'content', 'tool_use_id', 'id'])} FROM b WHERE json_type(b) = 'OBJECT'")
def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "blocks")


@sql(_MESSAGES_SQL + f"SELECT line_no, msg_idx, block_idx, part_idx, {_members('c', ['type', 'text'])} FROM c WHERE json_type(c) = 'OBJECT'")
def p4_parts(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "parts")


_INPUT_PATH = "CASE WHEN k2 = '.input' THEN '$' ELSE regexp_replace(replace(k2[7:], '\"', ''), '^\\.', '') END"


@sql(TREE_SQL + f""", nm AS (SELECT line_no, msg_idx, block_idx, json_extract_string(atom, '$') AS tool_name FROM b WHERE k2 = '.name' AND type NOT IN ('OBJECT', 'ARRAY', 'NULL'))
SELECT line_no, msg_idx, block_idx, {_INPUT_PATH} AS path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
CASE WHEN type <> 'NULL' THEN json_extract_string(atom, '$') END AS value, tool_name
FROM b JOIN ty USING (line_no, msg_idx, block_idx) LEFT JOIN nm USING (line_no, msg_idx, block_idx) WHERE block_type = 'tool_use' AND type NOT IN ('OBJECT', 'ARRAY') AND regexp_matches(k2, '^\\.input($|[.\\[])')""")
def p4_inputs(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "inputs")


@sql("WITH o AS (SELECT line_no, raw::JSON AS j FROM raw_sessions WHERE json_valid(raw) AND json_type(raw) = 'OBJECT') SELECT line_no, " + ", ".join(_SCALAR_SQL.format("j", n, n) for n in ("session_id", "system")) + " FROM o")
def p4_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "sessions")


def _elements_sql(member: str, names: list[str]) -> str:
    return f"""WITH o AS (SELECT line_no, raw::JSON AS j FROM raw_sessions WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
e AS (SELECT line_no, CAST(i AS INT) AS {member.rstrip("s")}_idx, json_extract(j, '$.{member}[' || i || ']') AS e FROM (SELECT *, unnest(range(0, json_array_length(j, '$.{member}')::BIGINT)) AS i FROM o WHERE json_type(j, '$.{member}') = 'ARRAY'))
SELECT line_no, {member.rstrip("s")}_idx, {_members("e", names)} FROM e WHERE json_type(e) = 'OBJECT'"""


@sql(_elements_sql("system", ["type", "text"]))
def p4_system(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "system")


@sql(_elements_sql("tools", ["name"]))
def p4_tools(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "tools")


@query
def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "members")


# Positions


POSITIONS_SQL = """
WITH own AS (SELECT * FROM v_blocks WHERE role = 'assistant' AND type IN ('tool_use', 'thinking')),
m AS (SELECT session_id, msg_idx, min(block_idx) FILTER (type = 'tool_use') AS first_call,
      arg_max(coalesce(content, ''), block_idx) FILTER (type = 'thinking') AS thinking FROM own GROUP BY ALL),
p AS (SELECT o.session_id || ':' || o.msg_idx || ':' || o.block_idx AS key, o.session_id AS sid, o.msg_idx, o.block_idx,
      CASE WHEN o.block_idx = m.first_call THEN left(m.thinking, 2000) END AS real_thinking_summary,
      coalesce(o.name, '?') AS action_name, left(coalesce(o.input, '{}'), 1500) AS action_input, o.msg_idx AS n_prior_msgs
      FROM own o JOIN m USING (session_id, msg_idx) WHERE o.type = 'tool_use')
"""
_IS_REAL = "regexp_replace(coalesce(real_thinking_summary, ''), '\\s', '', 'g') <> ''"


@sql(POSITIONS_SQL + f"SELECT *, real_thinking_summary IS NOT NULL AS has_thinking_block, {_IS_REAL} AS has_real_thinking FROM p")
def positions_extracted(spark: SparkSession, d: str) -> DataFrame:
    return positions(_blocks(spark, d))


@sql(POSITIONS_SQL + f"SELECT action_name, count(*) AS n_positions, round(avg(CAST({_IS_REAL} AS DOUBLE)), 6) AS anchored_share FROM p GROUP BY action_name")
def anchor_share_by_action(spark: SparkSession, d: str) -> DataFrame:
    return anchor_share(positions(_blocks(spark, d)))


QUERIES["anchor_share"], ORACLE["anchor_share"] = QUERIES["anchor_share_by_action"], ORACLE["anchor_share_by_action"]


@sql("SELECT key, regexp_replace(key, ':[^:]*$', '') AS short_key, action_name FROM v_pos")
def position_keys(spark: SparkSession, d: str) -> DataFrame:
    return _given(spark, d).select("key", parent_key(F.col("key")).alias("short_key"), "action_name")


@sql("SELECT rec_id, session_id, CAST(i - 1 AS INT) AS msg_idx, messages[i].role AS role, messages[i].content AS content FROM (SELECT *, unnest(range(1, len(messages) + 1)) AS i FROM sessions)")
def session_messages(spark: SparkSession, d: str) -> DataFrame:
    return messages(table(spark, d, "sessions"))


@sql("SELECT key, length(real_thinking_summary) AS n_chars FROM v_anchor")
def anchor_rows(spark: SparkSession, d: str) -> DataFrame:
    return anchors(_given(spark, d)).select("key", F.length("real_thinking_summary").cast("long").alias("n_chars"))


# Contexts and prompts


def _context_sql(n: int, parts: str = "v_parts") -> str:
    return f"""
WITH msg AS (SELECT session_id, msg_idx, string_agg(part, chr(10) ORDER BY block_idx) AS text FROM {parts} GROUP BY ALL),
spot AS (SELECT DISTINCT sid, msg_idx FROM v_pos)
SELECT a.sid, a.msg_idx, right(coalesce(string_agg(m.text, chr(10) ORDER BY m.msg_idx), ''), {n}) AS context
FROM spot a LEFT JOIN msg m ON m.session_id = a.sid AND m.msg_idx < a.msg_idx GROUP BY a.sid, a.msg_idx"""


_LONG_PARTS = "(SELECT session_id, msg_idx, block_idx, CASE type WHEN 'text' THEN '[' || coalesce(role, '') || '] ' || coalesce(content, '') WHEN 'tool_use' THEN '[' || coalesce(role, '') || ' 调用 ' || coalesce(name, '?') || '] ' || left(coalesce(input, '{}'), 600) WHEN 'tool_result' THEN '[工具返回] ' || left(coalesce(content, ''), 1200) END AS part FROM v_blocks WHERE type IN ('text', 'tool_use', 'tool_result'))"


@sql(_context_sql(9000))
def context_9000(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d, 9000)


@sql(_context_sql(24000, _LONG_PARTS))
def context_24000(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d, 24000, call_cap=600, result_cap=1200)


@sql(_context_sql(60000, "(SELECT session_id, msg_idx, block_idx, CASE type WHEN 'tool_use' THEN coalesce(input, '{}') ELSE coalesce(content, '') END AS part FROM v_blocks WHERE type IN ('text', 'tool_use', 'tool_result'))"))
def context_untagged(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d, 60000, call_cap=None, result_cap=None, tagged=False)


_KINDS_SQL = "CASE action_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in __import__("trailbed.functions.text", fromlist=["x"]).ACTION_KINDS.items()) + " ELSE '调用某个工具' END"
_ACTION_SQL = "'调用工具 ' || coalesce(action_name, '?') || ',参数: ' || left(coalesce(action_input, '{}'), 400)"


@sql(f"SELECT key, {_ACTION_SQL} AS action, {_KINDS_SQL} AS kind FROM v_pos")
def action_texts(spark: SparkSession, d: str) -> DataFrame:
    return _given(spark, d).select("key", context.action_text(F.col("action_name"), F.col("action_input")).alias("action"), action_kind(F.col("action_name")).alias("kind"))


def _prompts(spark: SparkSession, d: str, template: str, max_chars: int, action_cap: int = 400, **how: object) -> DataFrame:
    rows = _given(spark, d).join(_contexts(spark, d, max_chars, **how), ["sid", "msg_idx"])
    return rows.select("key", context.prompts(template, F.col("context"), action_kind(F.col("action_name")), context.action_text(F.col("action_name"), F.col("action_input"), action_cap)).alias("prompt"))


def _prompts_sql(template: str, max_chars: int = 9000, parts: str = "v_parts", action: str = _ACTION_SQL) -> str:
    fill = f"replace(replace(replace(replace('{template}', '{{n}}', '4'), '{{kind}}', {_KINDS_SQL}), '{{action}}', {action}), '{{context}}', context)"
    return _context_sql(max_chars, parts).replace("SELECT a.sid", ", c AS (SELECT a.sid", 1) + f") SELECT key, {fill} AS prompt FROM v_pos JOIN c USING (sid, msg_idx)"


@sql(_prompts_sql(context.COARSE))
def prompts_coarse(spark: SparkSession, d: str) -> DataFrame:
    """Without the action, which only its kind stands for; of the last 9,000 characters, as long as the reference's."""
    return _prompts(spark, d, context.COARSE, 9000)


@sql(_prompts_sql(context.FULL))
def prompts_full(spark: SparkSession, d: str) -> DataFrame:
    """With the action; of the last 9,000 characters, as long as the reference's for texts that know the action."""
    return _prompts(spark, d, context.FULL, 9000)


QUERIES["prompts_coarse_9000"], ORACLE["prompts_coarse_9000"] = QUERIES["prompts_coarse"], ORACLE["prompts_coarse"]


@sql(_prompts_sql(context.FULL, 24000, _LONG_PARTS, _ACTION_SQL.replace("400", "1500")))
def prompts_full_24000(spark: SparkSession, d: str) -> DataFrame:
    """The action with its whole extracted input, as in the reference."""
    return _prompts(spark, d, context.FULL, 24000, 1500, call_cap=600, result_cap=1200)


# Candidates and entities


@sql("SELECT key, provider, cand_idx, r FROM v_lcand")
def candidate_rows(spark: SparkSession, d: str) -> DataFrame:
    return long_candidates(_candidates(spark, d))


@sql("""
WITH raw AS (SELECT key, array_to_string(candidates, '###') AS raw FROM v_cand),
x AS (SELECT key, unnest(string_split(coalesce(raw, ''), '###')) AS t FROM raw),
y AS (SELECT key, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM x)
SELECT key, count(*) FILTER (length(t) >= 15) AS n, coalesce(string_agg(left(replace(t, chr(10), ' '), 600), '|' ORDER BY left(replace(t, chr(10), ' '), 600)) FILTER (length(t) >= 15), '') AS texts FROM y GROUP BY key""")
def candidate_parse(spark: SparkSession, d: str) -> DataFrame:
    got = _candidates(spark, d).select("key", parse_candidates(F.array_join("candidates", "###")).alias("c"))
    return got.select("key", F.size("c").cast("long").alias("n"), F.array_join(F.array_sort("c"), "|").alias("texts"))


def _ents_sql(c: str) -> str:
    pattern = ENTITY.replace("'", "''")
    return f"list_filter(list_distinct(list_transform(regexp_extract_all(coalesce({c}, ''), '{pattern}'), lambda x: lower(trim(x)))), lambda x: x NOT IN ('tool_use', 'tool_result', 'assistant', 'user_id', 'session_id'))"


@sql(f"SELECT key, array_to_string(list_sort({_ents_sql('action_input')}), '|') AS entities FROM v_pos")
def action_entities(spark: SparkSession, d: str) -> DataFrame:
    return _given(spark, d).select("key", F.array_join(F.array_sort(entities(F.col("action_input"))), "|").alias("entities"))


_UNTAGGED = "SELECT session_id, msg_idx, CASE type WHEN 'tool_use' THEN coalesce(input, '{}') ELSE coalesce(content, '') END AS part FROM v_blocks WHERE type IN ('text', 'tool_use', 'tool_result')"
SECRETS_SQL = f"""
WITH seen AS (SELECT session_id, entity, min(msg_idx) AS seen_at FROM (SELECT session_id, msg_idx, unnest({_ents_sql('part')}) AS entity FROM ({_UNTAGGED})) GROUP BY ALL),
own AS (SELECT key, sid, msg_idx, unnest({_ents_sql("action_name || ' ' || action_input")}) AS entity FROM v_pos),
secret AS (SELECT DISTINCT key, own.entity FROM own LEFT JOIN seen ON seen.session_id = own.sid AND seen.entity = own.entity WHERE seen_at IS NULL OR seen_at >= own.msg_idx)
"""


def _secrets(spark: SparkSession, d: str) -> DataFrame:
    parts = context.rendered(_blocks(spark, d), None, None, tagged=False)
    return names.secrets(_given(spark, d), names.first_seen(parts)).distinct()


@sql(SECRETS_SQL + "SELECT key, entity FROM secret")
def secret_set(spark: SparkSession, d: str) -> DataFrame:
    return _secrets(spark, d)


LEAKS_SQL = SECRETS_SQL + f""", hit AS (SELECT c.key, cand_idx, entity FROM (SELECT key, cand_idx, unnest({_ents_sql('r')}) AS entity FROM v_lcand) c JOIN secret USING (key, entity)),
leak AS (SELECT c.key, c.cand_idx, coalesce(string_agg(entity, '|' ORDER BY entity), '') AS leak FROM v_lcand c LEFT JOIN hit h ON h.key = c.key AND h.cand_idx = c.cand_idx GROUP BY ALL)
"""


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return names.leaks(long_candidates(_candidates(spark, d)), _secrets(spark, d))


@sql(LEAKS_SQL + "SELECT * FROM leak")
def leak_gate(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).withColumn("leak", F.array_join("leak", "|"))


@sql(LEAKS_SQL + """SELECT count(*) AS n, count(*) FILTER (leak <> '') AS n_leaked, count(*) FILTER (coalesce(s_suff >= 3, false)) AS n_by_score,
count(*) FILTER (coalesce(s_suff >= 3, false) AND leak = '') AS n_by_score_clean FROM leak LEFT JOIN v_scores USING (key, cand_idx)""")
def leak_report(spark: SparkSession, d: str) -> DataFrame:
    return names.leak_report(_leaks(spark, d), _scores(spark, d))


@sql(SECRETS_SQL + f""", texts AS (SELECT key, 'first' AS kind, r AS text, s_suff AS score FROM v_lcand LEFT JOIN v_scores USING (key, cand_idx, r) WHERE cand_idx = 0 UNION ALL SELECT key, 'second', r, s_suff FROM v_lcand LEFT JOIN v_scores USING (key, cand_idx, r) WHERE cand_idx = 1
UNION ALL SELECT key, 'real', real_thinking_summary, NULL FROM v_anchor),
t AS (SELECT row_number() OVER () AS id, * FROM texts WHERE key IN (SELECT key FROM secret)),
hit AS (SELECT DISTINCT id FROM (SELECT id, key, unnest({_ents_sql('text')}) AS entity FROM t) JOIN secret USING (key, entity))
SELECT kind, count(*) AS n, count(*) FILTER (id IN (SELECT id FROM hit)) AS n_leaked, round(avg((id IN (SELECT id FROM hit))::INT::DOUBLE), 6) AS leak_rate, count(*) FILTER (coalesce(score >= 3, false)) AS n_by_score,
count(*) FILTER (coalesce(score >= 3, false) AND id NOT IN (SELECT id FROM hit)) AS n_by_score_clean FROM t GROUP BY kind""")
def leak_report_columns(spark: SparkSession, d: str) -> DataFrame:
    """The leak report of several text columns at once: two candidates and the recorded reasoning, over positions that have a secret name."""
    both = long_candidates(_candidates(spark, d)).filter("cand_idx < 2").join(_scores(spark, d).select("key", "cand_idx", "r", F.col("s_suff").alias("score")), ["key", "cand_idx", "r"], "left")
    texts = both.select("key", F.when(F.col("cand_idx") == 0, "first").otherwise("second").alias("kind"), F.col("r").alias("text"), "score")
    real = anchors(_given(spark, d)).select("key", F.lit("real").alias("kind"), F.col("real_thinking_summary").alias("text"), F.lit(None).cast("double").alias("score"))
    return names.leak_report_columns(texts.unionByName(real), _secrets(spark, d))


# Ledger, cohorts and samples


@sql("SELECT key, sid, msg_idx, block_idx FROM v_pos WHERE key NOT IN (SELECT key FROM candidates WHERE key IS NOT NULL)")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    return cohort.pending(_given(spark, d), table(spark, d, "candidates")).select("key", "sid", "msg_idx", "block_idx")


@sql("SELECT session_id, count(*) AS n_blocks FROM v_blocks WHERE session_id IN (SELECT sid FROM v_anchor) GROUP BY session_id")
def needed_sessions(spark: SparkSession, d: str) -> DataFrame:
    need = anchors(_given(spark, d)).select(F.col("sid").alias("session_id"))
    return _blocks(spark, d).join(need, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("n_blocks"))


@sql("SELECT sid, count(*) AS n_anchors FROM v_anchor GROUP BY sid ORDER BY n_anchors DESC, sid LIMIT 300")
def cohort_top_sessions(spark: SparkSession, d: str) -> DataFrame:
    return cohort.top_sessions(anchors(_given(spark, d)))


@sql("WITH top AS (SELECT sid FROM v_anchor GROUP BY sid ORDER BY count(*) DESC, sid LIMIT 300) SELECT key, action_name FROM v_pos WHERE sid IN (SELECT sid FROM top)")
def cohort_positions(spark: SparkSession, d: str) -> DataFrame:
    given = _given(spark, d)
    return cohort.of_sessions(given, cohort.top_sessions(anchors(given))).select("key", "action_name")


@sql("SELECT key FROM v_pos WHERE key NOT IN (SELECT key FROM candidates WHERE key IS NOT NULL) ORDER BY sid, msg_idx, block_idx LIMIT 500")
def first_pending(spark: SparkSession, d: str) -> DataFrame:
    return cohort.first_rows(cohort.pending(_given(spark, d), table(spark, d, "candidates")), 500, "sid", "msg_idx", "block_idx").select("key")


@sql("SELECT key FROM v_anchor ORDER BY md5('7:' || key), key LIMIT 500")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = anchors(_given(spark, d))
    return cohort.first_rows(rows, 500, cohort.seeded_order(F.col("key"), 7), "key").select("key")


@sql("SELECT CAST(CAST('0x' || substr(md5(key), 1, 7) AS BIGINT) % 4 AS INT) AS shard, count(*) AS n FROM v_pos GROUP BY 1")
def shard_partition(spark: SparkSession, d: str) -> DataFrame:
    rows = _given(spark, d).select("key")
    parts = [rows.filter(cohort.in_shard(F.col("key"), i, 4)).withColumn("shard", F.lit(i)) for i in range(4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("shard").agg(F.count("*").alias("n"))


@sql("WITH p AS (SELECT regexp_replace(key, ':[^:]*$', '') AS short_key, arg_max(action_name, block_idx) AS action_name FROM v_pos GROUP BY 1) SELECT DISTINCT key, short_key, action_name FROM (SELECT key, regexp_replace(key, ':[^:]*$', '') AS short_key FROM v_cand) JOIN p USING (short_key)")
def short_key_actions(spark: SparkSession, d: str) -> DataFrame:
    """Candidate keys joined with positions on (session, message) alone; of several calls in a message the last one counts."""
    return cohort.by_short_key(_candidates(spark, d).select("key"), _given(spark, d), "action_name")


_FIXED_TOOLS = ["Read", "Grep", "Glob", "Edit", "Write"]  # Fixed values


@sql(f"SELECT sid, count(*) AS n_calls, count(*) FILTER (action_name IN ({', '.join(repr(t) for t in _FIXED_TOOLS)})) AS n_file_calls, count(DISTINCT action_name) AS n_tools FROM v_pos GROUP BY sid")
def tool_map_sums(spark: SparkSession, d: str) -> DataFrame:
    """Per session a map of tool to number of calls, its values summed up in all and over a fixed list of keys."""
    per = evaluation.count_map(_given(spark, d), "sid", "action_name")
    return per.select("sid", evaluation.sum_values(F.col("counts")).alias("n_calls"), evaluation.sum_of(F.col("counts"), _FIXED_TOOLS).alias("n_file_calls"), F.size("counts").cast("long").alias("n_tools"))


_CALLS_SQL = _MESSAGES_SQL + """, known AS (SELECT DISTINCT line_no, json_extract_string(t, '$.name') AS name FROM (SELECT line_no, json_extract(j, '$.tools[' || i || ']') AS t FROM (SELECT *, unnest(range(0, json_array_length(j, '$.tools')::BIGINT)) AS i FROM o WHERE json_type(j, '$.tools') = 'ARRAY')) WHERE json_type(t, '$.name') = 'VARCHAR'),
enough AS (SELECT line_no, count(*) AS n_tools FROM known GROUP BY line_no HAVING count(*) >= 2),
call AS (SELECT line_no, msg_idx, block_idx, json_extract_string(b, '$.name') AS name FROM b JOIN m USING (line_no, msg_idx) WHERE json_extract_string(m, '$.role') = 'assistant' AND json_type(b) = 'OBJECT' AND json_extract_string(b, '$.type') = 'tool_use' AND json_type(b, '$.name') = 'VARCHAR'),
own AS (SELECT line_no, msg_idx, min(block_idx) AS block_idx FROM call JOIN known USING (line_no, name) GROUP BY ALL),
eligible AS (SELECT line_no AS session, msg_idx, block_idx, name, n_tools FROM own JOIN call USING (line_no, msg_idx, block_idx) JOIN enough USING (line_no))
"""


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    flat = session_groups(table(spark, d, "raw_sessions"), [BLOCKS, TOOLS])
    named = (F.col("kind") == "object") & (F.col("kinds")["name"] == "string")
    calls = flat.filter((F.col("grp") == BLOCKS) & named & (F.col("vals")["type"] == "tool_use") & (F.col("up")["role"] == "assistant"))
    calls = calls.select(F.col("id").alias("session"), F.col("ords")[0].alias("msg_idx"), F.col("ords")[1].alias("block_idx"), F.col("vals")["name"].alias("name"))
    tools = flat.filter((F.col("grp") == TOOLS) & named).select(F.col("id").alias("session"), F.col("vals")["name"].alias("name"))
    return evaluation.eligible_calls(calls, tools)


@sql(_CALLS_SQL + "SELECT * FROM eligible")
def eligible_calls(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation cases of whole records: of each assistant message the first call of a tool that its session lists."""
    return _eligible(spark, d)


@sql(_CALLS_SQL + "SELECT * FROM eligible ORDER BY session, msg_idx LIMIT 400")
def first_cases(spark: SparkSession, d: str) -> DataFrame:
    """The first 400 cases in the order of records and messages."""
    return cohort.first_rows(_eligible(spark, d), 400, "session", "msg_idx")


@sql("SELECT key, regexp_extract(path, '([^/]+?)([.][^./]+)?$', 1) AS stem, regexp_extract(path, '([^/]+?)([.][^./]+)?$', 2) AS suffix FROM (SELECT key, regexp_extract(action_input, '\"(?:file_path|path)\"\\s*:\\s*\"([^\"\\\\]+)\"', 1) AS path FROM v_pos) WHERE path <> ''")
def action_files(spark: SparkSession, d: str) -> DataFrame:
    """Stem and suffix of the file an action names."""
    path = F.regexp_extract("action_input", r'"(?:file_path|path)"\s*:\s*"([^"\\]+)"', 1)
    return _given(spark, d).select("key", path.alias("path")).filter("path <> ''").select("key", path_stem(F.col("path")).alias("stem"), path_suffix(F.col("path")).alias("suffix"))


# Selection and statistics


@sql("SELECT key, cand_idx, r, s_suff FROM v_best")
def best_of_group(spark: SparkSession, d: str) -> DataFrame:
    return selection.best_of_group(_scores(spark, d))


@sql("WITH g AS (SELECT key, count(*) AS n, count(*) FILTER (leaked) AS bad FROM v_scores GROUP BY key) SELECT count(*) AS positions, CAST(coalesce(sum(bad), 0) AS BIGINT) AS leaked_candidates, count(*) FILTER (n = bad) AS all_leaked, count(*) FILTER (n > bad) AS selected FROM g")
def selection_funnel(spark: SparkSession, d: str) -> DataFrame:
    return selection.funnel(_scores(spark, d))


@sql("SELECT key, cand_idx, s_suff, s_nat, coalesce(s_suff >= 1.0 AND s_nat >= -2.5, false) AS passed FROM v_scores")
def dual_verdict(spark: SparkSession, d: str) -> DataFrame:
    return selection.dual_verdict(_scores(spark, d)).select("key", "cand_idx", "s_suff", "s_nat", "passed")


@sql("SELECT key, cand_idx, coalesce(s_suff >= 3.0 AND s_nat >= -2.8, false) AS passed FROM v_scores")
def dual_verdict_strict(spark: SparkSession, d: str) -> DataFrame:
    return selection.dual_verdict(_scores(spark, d), 3.0, -2.8).select("key", "cand_idx", "passed")


@sql("""WITH s AS (SELECT s_suff AS v, row_number() OVER (ORDER BY key || ':' || lpad(CAST(cand_idx AS VARCHAR), 4, '0')) AS i, count(*) OVER () AS total FROM v_scores WHERE s_suff IS NOT NULL),
p AS (SELECT CAST(unnest(range(1, 11)) AS INT) AS point)
SELECT point, CAST(total * point // 10 AS BIGINT) AS n, round(median(v), 6) AS median FROM p JOIN s ON i <= total * point // 10 GROUP BY point, total""")
def running_medians(spark: SparkSession, d: str) -> DataFrame:
    """The median score of the first tenth, two tenths, … of all scores by key."""
    rows = _scores(spark, d).withColumn("place", F.concat_ws(":", "key", F.lpad(F.col("cand_idx").cast("string"), 4, "0")))
    return stats.running_medians(rows, "place", "s_suff")


@sql("WITH c AS (SELECT * FROM v_scores WHERE NOT leaked AND s_suff IS NOT NULL), b AS (SELECT median(s) AS m FROM (SELECT max(s_suff) AS s FROM c GROUP BY key)), o AS (SELECT median(s_suff) AS m FROM c) SELECT round(b.m, 6) AS median_best, round(o.m, 6) AS median_single, round(b.m - o.m, 6) AS gain FROM b, o")
def best_minus_single_median(spark: SparkSession, d: str) -> DataFrame:
    return selection.best_minus_single(_scores(spark, d))


@sql("SELECT leaked, round(median(s_suff), 6) AS median_s_suff, round(median(s_nat), 6) AS median_s_nat FROM v_scores GROUP BY leaked")
def score_medians(spark: SparkSession, d: str) -> DataFrame:
    return stats.medians(_scores(spark, d), ["s_suff", "s_nat"], ["leaked"])


@sql("WITH s AS (SELECT s_suff AS v, row_number() OVER (ORDER BY s_suff) - 1 AS i, count(*) OVER () AS n FROM v_scores WHERE s_suff IS NOT NULL), q AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS q) SELECT q, round(v, 6) AS value FROM q JOIN s ON i = floor(n * q)")
def index_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.index_quantiles(_scores(spark, d), "s_suff")


@sql("WITH t AS (SELECT unnest([0, 1, 2, 3, 5])::DOUBLE AS threshold) SELECT threshold, count(*) AS n, count(*) FILTER (s_suff >= threshold) AS n_pass, round(avg((s_suff >= threshold)::INT::DOUBLE), 6) AS share FROM v_scores, t WHERE s_suff IS NOT NULL GROUP BY threshold")
def threshold_funnel(spark: SparkSession, d: str) -> DataFrame:
    return stats.pass_rates(_scores(spark, d), "s_suff", [0, 1, 2, 3, 5])


@sql("WITH t AS (SELECT unnest([-2, -1.5, -1.2, -1])::DOUBLE AS threshold), v AS (SELECT base / greatest(length(action_input), 1) AS b FROM scores JOIN v_pos USING (key)) SELECT threshold, count(*) AS n, count(*) FILTER (b <= threshold) AS n_pass, round(avg((b <= threshold)::INT::DOUBLE), 6) AS share FROM v, t WHERE b IS NOT NULL GROUP BY threshold")
def position_value_funnel(spark: SparkSession, d: str) -> DataFrame:
    value = table(spark, d, "scores").join(_given(spark, d), "key").select((F.col("base") / F.greatest(F.length("action_input"), F.lit(1))).alias("b"))
    return stats.pass_rates(value, "b", [-2, -1.5, -1.2, -1], at_least=False)


@sql("WITH a AS (SELECT key, s_suff FROM v_scores WHERE cand_idx = 0), b AS (SELECT key, s_suff FROM v_scores WHERE cand_idx = 1) SELECT count(*) AS n, round(avg(CASE WHEN a.s_suff IS NOT NULL AND b.s_suff IS NOT NULL THEN (a.s_suff > b.s_suff)::INT::DOUBLE END), 6) AS win_rate FROM a JOIN b USING (key)")
def win_rate(spark: SparkSession, d: str) -> DataFrame:
    pair = _scores(spark, d).groupBy("key").agg(F.max(F.when(F.col("cand_idx") == 0, F.col("s_suff"))).alias("a"), F.max(F.when(F.col("cand_idx") == 1, F.col("s_suff"))).alias("b"), F.max("cand_idx").alias("k"))
    return pair.filter("k >= 1").agg(F.count("*").alias("n"), stats.win_rate(F.col("a"), F.col("b")).alias("win_rate"))


@sql("SELECT CAST(CASE WHEN s_suff = 20 THEN 19 ELSE floor((s_suff + 20) / 2) END AS INT) AS bin, count(*) AS n FROM v_scores WHERE s_suff BETWEEN -20 AND 20 GROUP BY 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_scores(spark, d), "s_suff", -20, 20, 20)


# Controls


@sql("WITH l AS (SELECT sid, arg_max(key, msg_idx * 100000 + block_idx) AS last_key, arg_max(real_thinking_summary, msg_idx * 100000 + block_idx) AS future FROM v_anchor GROUP BY sid) SELECT key, future FROM v_anchor JOIN l USING (sid) WHERE key <> last_key")
def future_negative(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_future(anchors(_given(spark, d))).select("key", "future")


@sql("WITH f AS (SELECT sid, arg_min(real_thinking_summary, key) AS lend FROM v_anchor GROUP BY sid), r AS (SELECT sid, coalesce(lead(lend) OVER (ORDER BY sid), CASE WHEN count(*) OVER () > 1 THEN first_value(lend) OVER (ORDER BY sid) END) AS other FROM f) SELECT key, other FROM v_anchor JOIN r USING (sid)")
def mismatch_negative(spark: SparkSession, d: str) -> DataFrame:
    return scoring.mismatched(anchors(_given(spark, d))).select("key", "other")


@sql("""WITH a AS (SELECT sid, key, real_thinking_summary AS t, row_number() OVER (PARTITION BY sid ORDER BY md5('11:' || key), key) - 1 AS place, count(*) OVER (PARTITION BY sid) AS m FROM v_anchor),
s AS (SELECT sid, m, md5('11:' || sid) AS h FROM (SELECT DISTINCT sid, m FROM a)),
r AS (SELECT sid, coalesce(lead(sid) OVER (ORDER BY h), first_value(sid) OVER (ORDER BY h)) AS lender FROM s)
SELECT a.key, l.t AS other FROM a JOIN r USING (sid) LEFT JOIN s ON s.sid = lender AND lender <> a.sid LEFT JOIN a l ON l.sid = s.sid AND l.place = CAST('0x' || substr(md5(a.key), 1, 7) AS BIGINT) % s.m""")
def random_control(spark: SparkSession, d: str) -> DataFrame:
    """Each anchor with a text of another session, drawn by a seed."""
    return scoring.random_control(anchors(_given(spark, d))).select("key", "other")


# Arms and turns


ARMS_SQL = """
WITH msg AS (SELECT session_id, msg_idx, bool_or(type = 'thinking' AND regexp_replace(coalesce(content, ''), '\\s', '', 'g') <> '') AS has, min(block_idx) FILTER (type = 'tool_use') AS call FROM v_blocks WHERE role = 'assistant' GROUP BY ALL),
fill AS (SELECT m.session_id, m.msg_idx, b.r AS chosen, coalesce(b.r, c.candidates[1]) AS dense FROM msg m
  LEFT JOIN v_best b ON b.key = m.session_id || ':' || m.msg_idx || ':' || m.call LEFT JOIN v_cand c ON c.key = m.session_id || ':' || m.msg_idx || ':' || m.call WHERE NOT has AND call IS NOT NULL),
x AS (SELECT v.*, chosen, dense FROM v_blocks v LEFT JOIN fill USING (session_id, msg_idx)),
arms AS (
  SELECT 'B_minus' AS arm, session_id, msg_idx, block_idx, role, type, name, content, input, false AS filled FROM x WHERE type <> 'thinking' OR role <> 'assistant'
  UNION ALL SELECT 'B', session_id, msg_idx, block_idx, role, type, name, content, input, false FROM x
  UNION ALL SELECT 'R', session_id, msg_idx, block_idx, role, type, name, content, input, false FROM x WHERE NOT (type = 'thinking' AND chosen IS NOT NULL)
  UNION ALL SELECT 'R_dense', session_id, msg_idx, block_idx, role, type, name, content, input, false FROM x WHERE NOT (type = 'thinking' AND dense IS NOT NULL)
  UNION ALL SELECT 'R', session_id, msg_idx, -1, 'assistant', 'thinking', NULL, chosen, NULL, true FROM fill WHERE chosen IS NOT NULL
  UNION ALL SELECT 'R_dense', session_id, msg_idx, -1, 'assistant', 'thinking', NULL, dense, NULL, true FROM fill WHERE dense IS NOT NULL)
"""


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return A.arm_blocks(_blocks(spark, d), selection.best_of_group(_scores(spark, d)), _candidates(spark, d))


@sql(ARMS_SQL + "SELECT * FROM arms")
def arms_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d)


@sql(ARMS_SQL + "SELECT arm, count(*) AS n_blocks, count(*) FILTER (type = 'thinking') AS n_thinking, count(*) FILTER (filled) AS n_filled FROM arms GROUP BY arm")
def arm_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.arm_counts(_arms(spark, d))


_TURNS_SQL = """, ch AS (SELECT *, CASE WHEN who IS DISTINCT FROM lag(who) OVER (PARTITION BY {s} ORDER BY msg_idx) THEN 1 ELSE 0 END AS c FROM t),
g AS (SELECT *, sum(c) OVER (PARTITION BY {s} ORDER BY msg_idx) AS turn FROM ch),
merged AS (SELECT {s}, CAST(turn AS BIGINT) AS turn, max(who) AS who, string_agg(value, chr(10) ORDER BY msg_idx) AS value FROM g GROUP BY {s}, turn)
SELECT * FROM merged UNION ALL SELECT {s}, 0, 'human', '(continue)' FROM merged WHERE turn = 1 AND who = 'gpt'"""


@sql("WITH t AS (SELECT rec_id, CAST(i - 1 AS INT) AS msg_idx, CASE WHEN messages[i].role = 'user' THEN 'human' ELSE 'gpt' END AS who, coalesce(messages[i].content, '') AS value FROM (SELECT *, unnest(range(1, len(messages) + 1)) AS i FROM sessions))" + _TURNS_SQL.format(s="rec_id"))
def sharegpt_records(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(table(spark, d, "sessions")).select("rec_id", "msg_idx", F.when(F.col("role") == "user", "human").otherwise("gpt").alias("who"), F.coalesce("content", F.lit("")).alias("value"))
    return A.merged_turns(rows, "rec_id")


@sql("""
WITH s AS (SELECT session_id, msg_idx, block_idx, role, CASE type WHEN 'text' THEN content WHEN 'thinking' THEN CASE WHEN regexp_replace(coalesce(content, ''), '\\s', '', 'g') <> '' THEN '<thinking>' || chr(10) || regexp_replace(content, '^\\s+|\\s+$', '', 'g') || chr(10) || '</thinking>' END
  WHEN 'tool_use' THEN '<tool_use name="' || coalesce(name, '?') || '">' || chr(10) || coalesce(input, '{}') || chr(10) || '</tool_use>' WHEN 'tool_result' THEN '<tool_result>' || chr(10) || coalesce(content, '') || chr(10) || '</tool_result>' END AS value FROM v_blocks),
t AS (SELECT session_id, msg_idx, CASE WHEN max(role) = 'assistant' THEN 'gpt' ELSE 'human' END AS who, string_agg(value, chr(10) ORDER BY block_idx) AS value FROM s WHERE value IS NOT NULL AND value <> '' GROUP BY session_id, msg_idx)""" + _TURNS_SQL.format(s="session_id"))
def sharegpt_blocks(spark: SparkSession, d: str) -> DataFrame:
    return A.merged_turns(A.block_turns(_blocks(spark, d)), "session_id")


# The system text of each record comes as turn -1.
_SYSTEM_SQL = "left(CASE WHEN json_valid(system) AND json_type(CASE WHEN json_valid(system) THEN system END) = 'ARRAY' THEN coalesce(array_to_string(list_transform(list_filter(CAST(CASE WHEN json_valid(system) THEN system END AS JSON[]), lambda x: json_type(x) = 'OBJECT'), lambda x: coalesce(json_extract_string(x, '$.text'), '')), chr(10)), '') ELSE coalesce(system, '') END, 8000)"


@sql(ORACLE["sharegpt_records"] + f" UNION ALL SELECT rec_id, -1, 'system', {_SYSTEM_SQL} FROM sessions")
def sharegpt_records_system(spark: SparkSession, d: str) -> DataFrame:
    return A.with_system(sharegpt_records(spark, d), table(spark, d, "sessions"), "rec_id")


_ARM_TURNS_SQL = """, s AS (SELECT arm, session_id, msg_idx, block_idx, role, CASE type WHEN 'text' THEN content WHEN 'thinking' THEN CASE WHEN regexp_replace(coalesce(content, ''), '\\s', '', 'g') <> '' THEN '<thinking>' || chr(10) || regexp_replace(content, '^\\s+|\\s+$', '', 'g') || chr(10) || '</thinking>' END
  WHEN 'tool_use' THEN '<tool_use name="' || coalesce(name, '?') || '">' || chr(10) || coalesce(input, '{}') || chr(10) || '</tool_use>' WHEN 'tool_result' THEN '<tool_result>' || chr(10) || coalesce(content, '') || chr(10) || '</tool_result>' END AS value FROM arms),
t AS (SELECT arm, session_id, msg_idx, CASE WHEN max(role) = 'assistant' THEN 'gpt' ELSE 'human' END AS who, string_agg(value, chr(10) ORDER BY block_idx) AS value FROM s WHERE value IS NOT NULL AND value <> '' GROUP BY ALL)"""


@sql(ARMS_SQL + _ARM_TURNS_SQL + _TURNS_SQL.format(s="arm, session_id") + f""" UNION ALL SELECT arm, session_id, -1, 'system', {_SYSTEM_SQL} FROM (SELECT DISTINCT session_id FROM v_blocks) CROSS JOIN (SELECT unnest(['B_minus', 'B', 'R', 'R_dense']) AS arm) LEFT JOIN (SELECT session_id, arg_max(system, rec_id) AS system FROM sessions WHERE system IS NOT NULL GROUP BY session_id) USING (session_id)""")
def sharegpt_arms(spark: SparkSession, d: str) -> DataFrame:
    """The four arms as alternating turns, each session with the system text of its latest record that has one."""
    system = table(spark, d, "sessions").filter("system IS NOT NULL").groupBy("session_id").agg(F.max_by("system", "rec_id").alias("system"))
    sessions = _blocks(spark, d).select("session_id").distinct().join(system, "session_id", "left")
    records = sessions.withColumn("arm", F.explode(F.array(*map(F.lit, A.ARMS))))
    return A.with_system(A.merged_turns(A.block_turns(_arms(spark, d)), "arm", "session_id"), records, "arm", "session_id")


# Scores by the stand-in


def _score_rows(spark: SparkSession, d: str, max_chars: int) -> DataFrame:
    rows = long_candidates(_candidates(spark, d)).join(_given(spark, d), "key").join(_contexts(spark, d, max_chars), ["sid", "msg_idx"])
    return rows.select("key", "cand_idx", "context", context.action_text(F.col("action_name"), F.col("action_input")).alias("action"), "r")


_TOK = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"


def _lp_sql(rows: str, ids: str) -> str:
    """Stand-in log-probability in SQL; rows has ids, prefix, target."""
    return f"""(SELECT {ids}, sum(ln((coalesce(c, 0) + 1) / (np + 10000.0))) AS logprob, count(*) AS n_tok FROM (
  SELECT {ids}, np, t, (SELECT count(*) FROM unnest(pt) u(w) WHERE w = t) AS c FROM (SELECT {ids}, {_TOK.format('prefix')} AS pt, len({_TOK.format('prefix')}) AS np, unnest({_TOK.format('target')}) AS t FROM {rows})) GROUP BY {ids})"""


def _stand_in_sql(max_chars: int) -> str:
    return _context_sql(max_chars).replace("SELECT a.sid", ", ctx AS (SELECT a.sid", 1) + f"""),
rows AS (SELECT l.key, l.cand_idx, l.r, c.context, {_ACTION_SQL} AS action FROM v_lcand l JOIN v_pos USING (key) JOIN ctx c USING (sid, msg_idx)),
b0 AS (SELECT DISTINCT key, context AS prefix, action AS target FROM rows), s0 AS (SELECT key, cand_idx, context || chr(10) || r AS prefix, action AS target FROM rows), n0 AS (SELECT key, cand_idx, context AS prefix, r AS target FROM rows)
SELECT s.key, s.cand_idx, round(b.logprob, 6) AS base, round(s.logprob - b.logprob, 6) AS s_suff, round(n.logprob / n.n_tok, 6) AS s_nat
FROM {_lp_sql('s0', 'key, cand_idx')} s JOIN {_lp_sql('n0', 'key, cand_idx')} n USING (key, cand_idx) JOIN {_lp_sql('b0', 'key')} b USING (key)"""


def _stand_in(spark: SparkSession, d: str, max_chars: int) -> DataFrame:
    got = scoring.score_rationales(_score_rows(spark, d, max_chars), scoring.stand_in())
    return got.select("key", "cand_idx", *[F.round(c, 6).alias(c) for c in ("base", "s_suff", "s_nat")])


@sql(_stand_in_sql(9000))
def stand_in_scores(spark: SparkSession, d: str) -> DataFrame:
    return _stand_in(spark, d, 9000)


QUERIES["stand_in_scores_9000"], ORACLE["stand_in_scores_9000"] = QUERIES["stand_in_scores"], ORACLE["stand_in_scores"]


def _with_contexts(max_chars: int, parts: str = "v_parts") -> str:
    return _context_sql(max_chars, parts).replace("SELECT a.sid", ", ctx AS (SELECT a.sid", 1) + ")"


def _sums(tag: str) -> str:
    return f"coalesce(sum(logprob) FILTER (tag = '{tag}'), 0) / greatest(coalesce(sum(n_tok) FILTER (tag = '{tag}'), 0), 1)"


@sql(_with_contexts(9000) + f""", rows AS (SELECT row_number() OVER () AS id, * FROM v_pos JOIN ctx USING (sid, msg_idx)),
sp AS (SELECT id, 'think' AS tag, context AS prefix, left(real_thinking_summary, 800) AS target FROM rows WHERE {_IS_REAL} UNION ALL SELECT id, 'action', context, {_ACTION_SQL} FROM rows)
SELECT round(exp(-{_sums('think')}), 6) AS think_ppl, (SELECT count(*) FROM sp WHERE tag = 'think') AS think_spans, round({_sums('action')}, 6) AS action_lp_per_tok, (SELECT count(*) FROM sp WHERE tag = 'action') AS action_spans FROM {_lp_sql('sp', 'id, tag')}""")
def intrinsic_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _given(spark, d).join(_contexts(spark, d, 9000), ["sid", "msg_idx"])
    think = rows.filter(~is_blank(F.col("real_thinking_summary"))).select(F.lit("think").alias("tag"), F.col("context").alias("prefix"), F.left("real_thinking_summary", F.lit(800)).alias("target"))
    act = rows.select(F.lit("action").alias("tag"), F.col("context").alias("prefix"), context.action_text(F.col("action_name"), F.col("action_input")).alias("target"))
    return evaluation.intrinsic(think.unionByName(act), scoring.stand_in())


def _top1(spark: SparkSession, d: str) -> DataFrame:
    cases, tools = evaluation.tool_cases(_given(spark, d))
    return evaluation.action_top1(cases, tools, _contexts(spark, d, 9000), scoring.stand_in())


_TOP1_SQL = _with_contexts(9000) + f""", tools AS (SELECT sid, list_sort(list_distinct(list(action_name))) AS tools FROM v_pos GROUP BY sid HAVING count(DISTINCT action_name) >= 2),
cases AS (SELECT sid, msg_idx, arg_min(key, block_idx) AS key, arg_min(action_name, block_idx) AS action_name FROM v_pos GROUP BY sid, msg_idx),
pr AS (SELECT key, action_name, CAST(i AS INT) AS i, tools[i] AS tool, context AS prefix, tools[i] AS target FROM (SELECT key, action_name, tools, context, unnest(range(1, len(tools) + 1)) AS i FROM cases JOIN tools USING (sid) JOIN ctx USING (sid, msg_idx))),
g AS (SELECT key, action_name, tool, row_number() OVER (PARTITION BY key ORDER BY round(logprob / greatest(n_tok, 1), 9) DESC, i) AS k FROM {_lp_sql('pr', 'key, action_name, i, tool')}),
top1 AS (SELECT key, action_name, tool AS guess, tool = action_name AS correct FROM g WHERE k = 1)
"""


@sql(_TOP1_SQL + "SELECT * FROM top1")
def action_top1(spark: SparkSession, d: str) -> DataFrame:
    return _top1(spark, d)


@sql(_TOP1_SQL + "SELECT action_name AS tool, count(*) AS n, round(avg(correct::INT::DOUBLE), 6) AS acc FROM top1 GROUP BY action_name ORDER BY n DESC, tool LIMIT 8")
def per_tool_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.accuracy(_top1(spark, d))


_RING_SQL = ORACLE["mismatch_negative"].split("SELECT key, other FROM")[0]
_RING_SQL = _RING_SQL[_RING_SQL.index("f AS (SELECT sid, arg_min") :]


def _suff_sql(texts: dict[str, str]) -> str:
    """CTEs b (base by key) and s (key, ci, suff, nat) over rows ``a`` (key, context, action) with a text in each of the named columns."""
    long = " UNION ALL ".join(f"SELECT key, {i} AS ci, context, action, {t} AS r FROM a WHERE {t} IS NOT NULL" for i, t in enumerate(texts.values()))
    return f""", long AS ({long}), sx AS (SELECT key, ci, context || chr(10) || r AS prefix, action AS target FROM long), nx AS (SELECT key, ci, context AS prefix, r AS target FROM long), bx AS (SELECT key, context AS prefix, action AS target FROM a),
s AS (SELECT x.key, x.ci, b.logprob AS base, x.logprob - b.logprob AS suff, n.logprob / n.n_tok AS nat FROM {_lp_sql('sx', 'key, ci')} x JOIN {_lp_sql('bx', 'key')} b USING (key) LEFT JOIN {_lp_sql('nx', 'key, ci')} n ON n.key = x.key AND n.ci = x.ci)"""


@sql(_with_contexts(24000, _LONG_PARTS) + f", {_RING_SQL.strip()}, a AS (SELECT key, context, {_ACTION_SQL} AS action, real_thinking_summary AS own, other FROM v_anchor JOIN r USING (sid) JOIN ctx USING (sid, msg_idx))" + _suff_sql({"own": "own", "other": "other"}) + """,
pair AS (SELECT key, max(suff) FILTER (ci = 0) AS own, max(suff) FILTER (ci = 1) AS other FROM s GROUP BY key)
SELECT count(*) AS n, round(median(own), 6) AS median_own, round(median(other), 6) AS median_other, round(avg(CASE WHEN own IS NOT NULL AND other IS NOT NULL THEN (own > other)::INT::DOUBLE END), 6) AS win_rate FROM pair""")
def ruler_validation(spark: SparkSession, d: str) -> DataFrame:
    """Sufficiency of each anchor's own reasoning against another session's, by the stand-in."""
    a = scoring.mismatched(anchors(_given(spark, d))).join(_contexts(spark, d, 24000, call_cap=600, result_cap=1200), ["sid", "msg_idx"])
    action = context.action_text(F.col("action_name"), F.col("action_input")).alias("action")
    long = a.select("key", "context", action, F.posexplode(F.array("real_thinking_summary", "other")).alias("cand_idx", "r")).filter("r IS NOT NULL")
    s = scoring.score_rationales(long, scoring.stand_in())
    pair = materialize(s.groupBy("key").agg(F.max(F.when(F.col("cand_idx") == 0, F.col("s_suff"))).alias("own"), F.max(F.when(F.col("cand_idx") == 1, F.col("s_suff"))).alias("other")), "ruler")
    return pair.agg(F.count("*").alias("n"), stats.win_rate(F.col("own"), F.col("other")).alias("win_rate")).join(stats.medians(pair, ["own", "other"]))  # one row with one row


_LAST_SQL = "l AS (SELECT sid, arg_max(key, msg_idx * 100000 + block_idx) AS last_key, arg_max(real_thinking_summary, msg_idx * 100000 + block_idx) AS future FROM v_anchor GROUP BY sid), fut AS (SELECT key, future FROM v_anchor JOIN l USING (sid) WHERE key <> last_key)"
_DRAWN_SQL = ORACLE["random_control"][ORACLE["random_control"].index("a AS (SELECT sid, key, real_thinking_summary AS t") :].replace("a AS (SELECT sid, key", "an AS (SELECT sid, key", 1).replace("SELECT DISTINCT sid, m FROM a)", "SELECT DISTINCT sid, m FROM an)").replace("s AS (SELECT sid, m, md5", "se AS (SELECT sid, m, md5", 1).replace("FROM s)", "FROM se)", 1)
_DRAWN_SQL = _DRAWN_SQL[: _DRAWN_SQL.index("SELECT a.key, l.t AS other")] + ", dr AS (SELECT x.key, y.t AS other FROM an x JOIN r USING (sid) LEFT JOIN se ON se.sid = lender AND lender <> x.sid LEFT JOIN an y ON y.sid = se.sid AND y.place = CAST('0x' || substr(md5(x.key), 1, 7) AS BIGINT) % se.m)"
_RATES_SQL = ", ".join(f"round(avg((s{i} >= 3)::INT::DOUBLE), 6) AS pass_{n}" for i, n in enumerate(("own", "future", "random"))) + ", " + ", ".join(f"round(avg((round(n0, 9) > round(n{i}, 9))::INT::DOUBLE), 6) AS nat_wins_{n}" for i, n in ((1, "future"), (2, "random")))


@sql(_with_contexts(12000) + f", {_LAST_SQL}, {_DRAWN_SQL}, a AS (SELECT key, context, {_ACTION_SQL} AS action, real_thinking_summary AS own, future, other FROM v_anchor JOIN ctx USING (sid, msg_idx) JOIN fut USING (key) JOIN dr USING (key))" + _suff_sql({n: n for n in ("own", "future", "other")}) + f""",
wide AS (SELECT key, max(base) AS base, {', '.join(f'max(suff) FILTER (ci = {i}) AS s{i}, max(nat) FILTER (ci = {i}) AS n{i}' for i in range(3))} FROM s GROUP BY key)
SELECT count(*) AS n, {_RATES_SQL}, {', '.join(f'round(quantile_cont(base, {q / 100}), 6) AS base_q{q}' for q in (25, 50, 75))} FROM wide""")
def dual_calibration(spark: SparkSession, d: str) -> DataFrame:
    a = anchors(_given(spark, d)).join(_contexts(spark, d, 12000), ["sid", "msg_idx"])
    return scoring.dual_calibration(a.withColumn("action", context.action_text(F.col("action_name"), F.col("action_input"))), scoring.stand_in())


@sql("WITH t AS (SELECT key, sid, action_name AS action, base AS base_lp, CAST(len(list_filter(regexp_split_to_array(action_input, '\\s+'), lambda x: x <> '')) AS INT) AS ntok FROM scores JOIN v_pos USING (key) WHERE base IS NOT NULL) SELECT *, round(base_lp / greatest(ntok, 1), 12) AS base_per_tok FROM t")
def position_value(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.position_value(_given(spark, d), table(spark, d, "scores"))


@sql("SELECT coalesce(provider, '?') AS provider, count(*) AS n, round(avg((s_suff >= 0)::INT::DOUBLE), 6) AS pass_0, round(avg((s_suff >= 1)::INT::DOUBLE), 6) AS pass_1, round(avg((s_suff >= 3)::INT::DOUBLE), 6) AS pass_3, round(median(s_suff), 6) AS median_suff FROM v_scores JOIN v_cand USING (key) WHERE s_suff IS NOT NULL GROUP BY 1")
def provider_yield(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.provider_yield(_scores(spark, d), _candidates(spark, d))


@sql("WITH t AS (SELECT rec_id, coalesce(list_sort(list_distinct(list_filter(list_transform(tools, lambda t: t.name), lambda n: n IS NOT NULL))), []) AS n FROM sessions) SELECT rec_id, CAST(len(n) AS BIGINT) AS n_tools, array_to_string(n, ',') AS tools FROM t")
def session_tools(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.session_tools(table(spark, d, "sessions"))


# Datasheet, cost and audit


@sql("""
WITH turn AS (SELECT session_id, msg_idx, count(*) FILTER (type = 'thinking') AS n, count(*) FILTER (type = 'thinking' AND regexp_replace(coalesce(content, ''), '\\s', '', 'g') = '') AS e FROM v_blocks WHERE role = 'assistant' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx DESC) AS k FROM turn)
SELECT CASE WHEN k = 1 THEN 'last' WHEN k = 2 THEN 'second_last' WHEN k <= 5 THEN '3rd_to_5th' ELSE 'earlier' END AS place, count(*) AS turns, CAST(sum(n) AS BIGINT) AS thinking_blocks, CAST(sum(e) AS BIGINT) AS empty_blocks,
round(sum(e) / greatest(sum(n), 1), 6) AS empty_rate, round(100.0 * (sum(n) - sum(e)) / count(*), 6) AS nonempty_per_100_turns FROM r GROUP BY 1""")
def density_by_place(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.density(_blocks(spark, d))


@sql("WITH p AS (SELECT session_id, bool_or(type = 'thinking' AND regexp_replace(coalesce(content, ''), '\\s', '', 'g') <> '') AS h FROM v_blocks GROUP BY session_id) SELECT count(*) AS n_sessions, round(avg((NOT h)::INT::DOUBLE), 6) AS share_without FROM p")
def sessions_without_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.sessions_without_reasoning(_blocks(spark, d))


@sql("SELECT coalesce(model, '?') AS model, count(*) AS n_records, count(DISTINCT session_id) AS n_sessions, CAST(sum(coalesce(length(system), 0)) AS BIGINT) AS system_chars FROM sessions GROUP BY 1")
def records_by_model(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").groupBy(F.coalesce("model", F.lit("?")).alias("model")).agg(
        F.count("*").alias("n_records"), F.count_distinct("session_id").alias("n_sessions"), F.sum(F.coalesce(F.length("system"), F.lit(0))).alias("system_chars")
    )


@sql("WITH t AS (SELECT CAST(length(action_input) // 4 AS BIGINT) AS i, CAST(coalesce(length(real_thinking_summary), 0) // 4 AS BIGINT) AS o FROM v_pos) SELECT count(*) AS n, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round((sum(i) * 0.209 + sum(o) * 0.31) / 1e6, 6) AS usd, round((sum(i) * 0.209 + sum(o) * 0.31) / 1e6 / count(*), 9) AS usd_per_row, round((sum(i) * 0.209 + sum(o) * 0.31) / 1e6 / count(*) * 40000, 6) AS usd_projected FROM t")
def cost_projection(spark: SparkSession, d: str) -> DataFrame:
    quarter = lambda c: F.floor(F.coalesce(F.length(c), F.lit(0)) / 4)
    rows = _given(spark, d).select(quarter("action_input").alias("i"), quarter("real_thinking_summary").alias("o"))
    return evaluation.cost(rows, "i", "o")


# What a text would state: claim, number as written, tolerance and whether it is relative. Fixed values.
CLAIMS = [("positions", "1.4k", 0.05, True), ("anchored percent", "22%", 0.05, False), ("candidate keys", "300", 0.0, True), ("sessions", "1.2k", 0.01, True)]
_CLAIMS_SQL = ", ".join(f"('{c}', '{t}', {tol}, {str(rel).lower()})" for c, t, tol, rel in CLAIMS)


@sql(f"""
WITH m AS (SELECT 'positions' AS claim, count(*)::DOUBLE AS value FROM v_pos UNION ALL SELECT 'anchored percent', 100 * avg(has_real_thinking::INT::DOUBLE) FROM v_pos UNION ALL SELECT 'candidate keys', count(*)::DOUBLE FROM v_cand),
c AS (SELECT * FROM (VALUES {_CLAIMS_SQL}) AS t(claim, stated, tol, rel)),
n AS (SELECT c.claim, stated, tol, rel, CASE WHEN stated LIKE '%k' THEN 1000 ELSE 1 END * CAST(regexp_replace(stated, '[%k]', '') AS DOUBLE) AS number, value FROM c LEFT JOIN m USING (claim))
SELECT claim, stated, number, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'missing' WHEN abs(number - value) <= CASE WHEN NOT regexp_matches(stated, '[%k]') THEN 0 WHEN rel THEN tol * abs(number) ELSE tol END THEN 'ok' ELSE 'differs' END AS verdict FROM n""")
def claims_tolerance(spark: SparkSession, d: str) -> DataFrame:
    given = _given(spark, d)
    share = given.agg(F.count("*").cast("double").alias("positions"), (100 * F.avg(F.col("has_real_thinking").cast("double"))).alias("anchored percent"))
    metrics = share.unpivot([], ["positions", "anchored percent"], "claim", "value").unionByName(_candidates(spark, d).agg(F.count("*").cast("double").alias("value")).select(F.lit("candidate keys").alias("claim"), "value"))
    claims = spark.createDataFrame(CLAIMS, "claim string, stated string, tolerance double, relative boolean")
    return audit.verify_claims(claims, metrics)


@sql("SELECT action_name, format('{:,}', count(*)) AS n_stated, printf('%+.1f', count(*) - 100.5) AS beyond_100 FROM v_pos GROUP BY action_name")
def stated_forms(spark: SparkSession, d: str) -> DataFrame:
    """Counts as a text states them: with thousands separators, and as a signed difference."""
    n = _given(spark, d).groupBy("action_name").agg(F.count("*").alias("n"))
    return n.select("action_name", thousands(F.col("n")).alias("n_stated"), signed(F.col("n") - F.lit(100.5), 1).alias("beyond_100"))


_LINES_SQL = "SELECT doc_id, CAST(i - 1 AS INT) AS line_no, l[i] AS line FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"


@sql(f"""WITH c AS (SELECT doc_id, line_no, list_transform(string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x)) AS c FROM ({_LINES_SQL}) WHERE starts_with(ltrim(line), '|'))
SELECT doc_id, line_no, c[1] AS claim, c[2] AS description, regexp_extract(coalesce(c[3], ''), '`([^`]+)`', 1) AS source FROM c WHERE regexp_matches(c[1], '[0-9]')""")
def markdown_table_rows(spark: SparkSession, d: str) -> DataFrame:
    return audit.table_rows(table(spark, d, "documents"), "doc_id", "text")


@sql("SELECT doc_id, count(*) FILTER (NOT regexp_matches(line, '^\\s*(?:#|%|//)') AND trim(line) <> '') AS n_code_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY doc_id HAVING count(*) FILTER (NOT regexp_matches(line, '^\\s*(?:#|%|//)') AND trim(line) <> '') > 0")
def code_line_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.code_lines(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_code_lines"))


@sql(f"""WITH l AS ({_LINES_SQL} WHERE lower(trim(source)) = 'code_file')
SELECT * FROM (SELECT doc_id, line_no, unnest(list_filter(regexp_extract_all(line, '[0-9A-Za-z_.]+'), lambda x: regexp_full_match(x, '[0-9]+\\.?[0-9]*'))) AS number FROM l WHERE NOT regexp_matches(line, '^\\s*(?:#|%|//)') AND trim(line) <> '') WHERE number NOT IN ('0', '1', '2')""")
def number_literals(spark: SparkSession, d: str) -> DataFrame:
    code = table(spark, d, "documents").filter("lower(trim(source)) = 'code_file'")
    return audit.number_literals(code, "doc_id", "text", ["0", "1", "2"])


@sql("SELECT doc_id, CAST(len(regexp_extract_all(text, 'TODO|FIXME|TBD|XXX|\\?\\?')) AS INT) AS n_marks FROM documents WHERE text IS NOT NULL")
def placeholder_marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", audit.placeholders(F.col("text")).alias("n_marks"))
