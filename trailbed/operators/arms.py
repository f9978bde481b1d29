"""Training arms from one cohort of sessions, and their conversion to alternating turns.

Arms: B_minus without any thinking; B as recorded; R with the selected rationale where a message acts without recorded
thinking; R_dense with the selected rationale or else the first candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailbed.functions.text import is_blank, position_key, strip_ws

ARMS = ("B_minus", "B", "R", "R_dense")
STRIDE = 256  # messages per block


def strip_thinking(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["type"] != "thinking")


def insert_thinking(blocks: Column, block: Column) -> Column:
    """The given thinking block first, any other removed."""
    return F.concat(F.array(block), strip_thinking(blocks))


def arm_blocks(blocks: DataFrame, best: DataFrame, candidates: DataFrame) -> DataFrame:
    """(arm, session_id, msg_idx, block_idx, role, type, name, content, input, filled): the blocks of all four arms.

    A filled thinking block has block_idx -1. A message is filled if it is an assistant's, has no non-blank thinking and
    its first tool call has a rationale (best: key, r; candidates: key, candidates).
    """
    b = blocks.select("session_id", "msg_idx", "block_idx", "role", "type", "name", "content", "input")
    thinking = F.col("type") == "thinking"
    msg = b.filter(F.col("role") == "assistant").groupBy("session_id", "msg_idx").agg(
        F.max(thinking & ~is_blank(F.col("content"))).alias("has"), F.min(F.when(F.col("type") == "tool_use", F.col("block_idx"))).alias("call")
    )
    lacking = msg.filter(~F.col("has") & F.col("call").isNotNull()).select("session_id", "msg_idx", position_key(F.col("session_id"), F.col("msg_idx"), F.col("call")).alias("key"))
    first = candidates.select("key", F.try_element_at("candidates", F.lit(1)).alias("spare"))
    fill = lacking.join(best.select("key", F.col("r").alias("chosen")), "key", "left").join(first, "key", "left").select("session_id", "msg_idx", "chosen", F.coalesce("chosen", "spare").alias("dense"))
    marked = b.join(fill, ["session_id", "msg_idx"], "left")
    keep = {
        "B_minus": ~thinking | (F.col("role") != "assistant"),
        "B": F.lit(True),
        "R": ~(thinking & F.col("chosen").isNotNull()),
        "R_dense": ~(thinking & F.col("dense").isNotNull()),
    }
    arms = F.explode(F.filter(F.array(*[F.when(keep[a], F.lit(a)) for a in ARMS]), lambda x: x.isNotNull())).alias("arm")
    kept = marked.select(arms, "session_id", "msg_idx", "block_idx", "role", "type", "name", "content", "input", F.lit(False).alias("filled"))
    new = fill.select("session_id", "msg_idx", F.explode(F.array(F.struct(F.lit("R").alias("arm"), F.col("chosen").alias("t")), F.struct(F.lit("R_dense").alias("arm"), F.col("dense").alias("t")))).alias("f")).filter("f.t IS NOT NULL")
    null = F.lit(None).cast("string")
    added = new.select(F.col("f.arm").alias("arm"), "session_id", "msg_idx", F.lit(-1).alias("block_idx"), F.lit("assistant").alias("role"), F.lit("thinking").alias("type"), null.alias("name"), F.col("f.t").alias("content"), null.alias("input"), F.lit(True).alias("filled"))
    return kept.unionByName(added)


def arm_counts(arms: DataFrame) -> DataFrame:
    return arms.groupBy("arm").agg(
        F.count("*").alias("n_blocks"), F.count_if(F.col("type") == "thinking").alias("n_thinking"), F.count_if("filled").alias("n_filled")
    )


def turn_value(kind: Column, name: Column, content: Column, given: Column) -> Column:
    """A block as it stands in a turn; null or blank texts and thinking are dropped later."""
    return (
        F.when(kind == "text", content)
        .when((kind == "thinking") & ~is_blank(content), F.concat(F.lit("<thinking>\n"), strip_ws(content), F.lit("\n</thinking>")))
        .when(kind == "tool_use", F.concat(F.lit('<tool_use name="'), F.coalesce(name, F.lit("?")), F.lit('">\n'), F.coalesce(given, F.lit("{}")), F.lit("\n</tool_use>")))
        .when(kind == "tool_result", F.concat(F.lit("<tool_result>\n"), F.coalesce(content, F.lit("")), F.lit("\n</tool_result>")))
    )


def block_turns(blocks: DataFrame) -> DataFrame:
    """([arm,] session_id, msg_idx, who, value): one row per message with something to show; any role but assistant is human."""
    key = [c for c in ("arm", "session_id", "msg_idx") if c in blocks.columns]
    value = turn_value(F.col("type"), F.col("name"), F.col("content"), F.col("input"))
    shown = blocks.withColumn("value", value).filter("value IS NOT NULL AND value <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "value"))), lambda x: x["value"]), "\n")
    return shown.groupBy(*key).agg(joined.alias("value"), F.max("role").alias("role")).select(
        *key, F.when(F.col("role") == "assistant", "gpt").otherwise("human").alias("who"), "value"
    )


def merged_turns(turns: DataFrame, *session: str, opening: str = "(continue)") -> DataFrame:
    """(*session, turn, who, value): neighbours of one speaker joined by newline, so speakers alternate, a human first.

    turns: *session, msg_idx, who, value, msg_idx unique in its session. Where an assistant begins, a turn 0 with ``opening`` is put before it.
    Runs are numbered without the texts and in two levels (blocks of messages, then within them), so a runaway session is spread over many tasks.
    """
    marks = turns.select(*session, "msg_idx", "who", F.floor(F.col("msg_idx") / STRIDE).alias("far"))
    inner = Window.partitionBy(*session, "far").orderBy("msg_idx")
    own = F.coalesce((F.col("who") != F.lag("who").over(inner)).cast("long"), F.lit(0))  # a block's first turn is compared below
    marks = marks.withColumn("own", own).withColumn("inner", F.sum("own").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = marks.groupBy(*session, "far").agg(F.sum("own").alias("changes"), F.min_by("who", "msg_idx").alias("first"), F.max_by("who", "msg_idx").alias("last"))
    outer = Window.partitionBy(*session).orderBy("far")  # a row per block of messages
    blocks = blocks.withColumn("opens", F.coalesce((F.col("first") != F.lag("last").over(outer)).cast("long"), F.lit(1)))
    start = F.sum("opens").over(outer) + F.coalesce(F.sum("changes").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = marks.join(blocks.select(*session, "far", start.alias("start")), [*session, "far"]).select(*session, "msg_idx", (F.col("start") + F.col("inner")).alias("run"))
    run = turns.join(runs, [*session, "msg_idx"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "value"))), lambda x: x["value"]), "\n")
    merged = run.groupBy(*session, "run").agg(F.max("who").alias("who"), text.alias("value"))
    opens = merged.filter("run = 1 AND who = 'gpt'").select(*session, F.lit(0).cast("long").alias("turn"), F.lit("human").alias("who"), F.lit(opening).alias("value"))
    return merged.select(*session, F.col("run").alias("turn"), "who", "value").unionByName(opens)


def system_text(system: Column, cap: int = 8000) -> Column:
    """A system prompt as text: of a JSON array the objects' texts joined by newline, any other as it is, null as empty; at most ``cap`` characters."""
    listed = F.when(F.trim(system).startswith("[") & F.trim(system).endswith("]"), F.from_json(system, "array<string>", {"allowSingleQuotes": "false"}))
    objects = F.filter(listed, lambda x: F.ltrim(x).startswith("{"))
    joined = F.array_join(F.transform(objects, lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))), "\n")
    text = F.when(F.size(objects) > 0, joined).when(system.rlike(r"^\s*\[\s*\]\s*$"), "").otherwise(F.coalesce(system, F.lit("")))
    return F.left(text, F.lit(cap))


def with_system(turns: DataFrame, records: DataFrame, *session: str) -> DataFrame:
    """The turns and, of each of ``records`` (*session, system), a row of turn -1 by ``system`` with its system text, empty if it has none."""
    head = records.select(*session, F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("who"), system_text(F.col("system")).alias("value"))
    return turns.unionByName(head)
