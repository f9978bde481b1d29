"""Queries of the text operators by name, and SQL where it can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailbed.llm.credentials import find_secrets, redact_secrets
from trailbed.llm.eval_leaks import leak_report
from trailbed.llm.near_duplicates import NearDuplicates, record_text
from trailbed.llm.packing import fill_report, pack, packing_faults, token_counts
from trailbed.llm.personal import find_personal, given_names, redact_personal, texts_of, train
from trailbed.llm.shared_spans import shared_shares, shared_spans
from trailbed.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return find_secrets(table(spark, d, "blocks")).select("block_id", "field", "secret").distinct()


@query
def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_secrets(table(spark, d, "blocks"))


def _personal(spark: SparkSession, d: str, run: Callable) -> DataFrame:
    model = train(spark, given_names(table(spark, d, "given_names")))
    return run(texts_of(table(spark, d, "blocks"), table(spark, d, "sessions")), model)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, find_personal).select("tab", "row_id", "kind", "val").distinct()


@query
def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, redact_personal)


def _near_duplicates(spark: SparkSession, d: str) -> NearDuplicates:
    sessions = table(spark, d, "sessions").filter(F.size("messages") > 0)
    return NearDuplicates(sessions.select("rec_id", record_text().alias("text")))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _near_duplicates(spark, d).pairs()


@query
def p3_degrees(spark: SparkSession, d: str) -> DataFrame:
    return _near_duplicates(spark, d).degrees()


@query
def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near_duplicates(spark, d).groups()


@query
def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents")), table(spark, d, "pack_specs"))


@query
def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p5_containers(spark, d), table(spark, d, "pack_specs"))


@query
def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per spec: tokens and documents not placed exactly once, containers over capacity, documents split without need, and whether at most 2 % is unused."""
    counts, specs = token_counts(table(spark, d, "documents")), table(spark, d, "pack_specs")
    return packing_faults(counts, specs, p5_containers(spark, d))


ORACLE["p5_invariants"] = "SELECT DISTINCT CAST(spec_id AS INT) AS spec_id, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS split_in_vain, true AS well_filled FROM pack_specs"


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


@query
def p6_edited(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with up to two edits within 50 folded characters."""
    found = leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=2)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"))


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shared_shares(table(spark, d, "documents"))


# All windows of 320 characters of whole texts, those of two documents or more, and their runs.
SPANS_SQL = """
WITH w AS (SELECT doc_id, p, hash(substr(text, p + 1, 320)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 319)) AS p FROM documents WHERE length(text) >= 320)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
r AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM s)),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 320 THEN 0 ELSE 1 END AS n FROM r)),
runs AS (SELECT doc_id, min(p) AS span_start, max(p) + 320 AS span_end FROM g GROUP BY doc_id, run)
"""
# Folding as far as SQL has it: canonical composition, full-width signs and case; other compatibility forms stand in no given table.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def _folded(c: str) -> str:
    return f"regexp_replace(lower(translate(nfc_normalize({c}), '{_WIDE[0]}', '{_WIDE[1]}')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


ORACLE["p6_found"] = f"""
WITH d AS (SELECT doc_id, {_folded('text')} AS t FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_folded('passage')} AS t FROM eval_items WHERE passage IS NOT NULL),
w AS (SELECT DISTINCT item_id, hash(substr(t, p, 50)) AS h FROM (SELECT item_id, t, unnest(range(1, length(t) - 48)) AS p FROM i)),
x AS (SELECT doc_id, hash(substr(t, p, 50)) AS h FROM (SELECT doc_id, t, unnest(range(1, length(t) - 48)) AS p FROM d))
SELECT DISTINCT doc_id, item_id FROM x JOIN w USING (h)"""
ORACLE["p7_found"] = SPANS_SQL + "SELECT doc_id, CAST(span_start AS BIGINT) AS span_start, CAST(span_end AS BIGINT) AS span_end FROM runs"
ORACLE["p7_shares"] = SPANS_SQL + """, x AS (SELECT doc_id, count(*) AS n, CAST(sum(span_end - span_start) AS BIGINT) AS shared FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, coalesce(n, 0) AS n_spans, coalesce(shared, 0) AS shared_chars, round(coalesce(shared / length(text), 0.0), 6) AS shared_share FROM documents d LEFT JOIN x USING (doc_id)"""

# Every pair of records by the number of 9-character sequences they have in common.
PAIRS_SQL = """
WITH t AS (SELECT rec_id, trim(regexp_replace(lower(coalesce(system, '') || ' ' || array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), ' ')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS text FROM sessions WHERE len(messages) > 0),
g AS (SELECT DISTINCT rec_id, hash(substr(text, i, 9)) AS h FROM (SELECT rec_id, text, unnest(range(1, length(text) - 7)) AS i FROM t)),
n AS (SELECT rec_id, count(*) AS n FROM g GROUP BY rec_id),
x AS (SELECT a.rec_id AS rec_a, b.rec_id AS rec_b, count(*) AS c FROM g a JOIN g b ON a.h = b.h AND a.rec_id < b.rec_id GROUP BY ALL),
pairs AS (SELECT rec_a, rec_b FROM x JOIN n na ON na.rec_id = rec_a JOIN n nb ON nb.rec_id = rec_b WHERE c >= 0.6 * (na.n + nb.n - c)),
class AS (SELECT rec_id, text, min(rec_id) OVER (PARTITION BY text) AS class_id FROM t)
"""
ORACLE["p3_found"] = PAIRS_SQL + "SELECT rec_a, rec_b FROM pairs"
ORACLE["p3_degrees"] = PAIRS_SQL + """, e AS (SELECT a.class_id AS x, b.class_id AS y FROM pairs JOIN class a ON a.rec_id = rec_a JOIN class b ON b.rec_id = rec_b WHERE a.class_id <> b.class_id),
d AS (SELECT x, count(DISTINCT y) AS n FROM (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) GROUP BY x)
SELECT rec_id, class_id, coalesce(n, 0) AS n_links FROM class LEFT JOIN d ON x = class_id"""
ORACLE["p3_groups"] = """WITH RECURSIVE """ + PAIRS_SQL.strip()[5:] + """, e AS (SELECT rec_a AS x, rec_b AS y FROM pairs UNION ALL SELECT rec_b, rec_a FROM pairs),
reach AS (SELECT rec_id AS x, rec_id AS y FROM t UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
label AS (SELECT x AS rec_id, min(y) AS group_id FROM reach GROUP BY x)
SELECT rec_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM label"""
