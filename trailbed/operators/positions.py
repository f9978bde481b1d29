"""Action positions: every tool call of an assistant message, with the reasoning recorded before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailbed.functions.text import is_blank, position_key


def latest_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks without repeated deliveries: of each (session_id, msg_idx, block_idx) the row with the greatest block_id.

    Ranked within the whole key, so one runaway session is spread over many tasks; each task drops lower rows before the shuffle.
    """
    newest = Window.partitionBy("session_id", "msg_idx", "block_idx").orderBy(F.desc("block_id"))
    rest = [c for c in blocks.columns if c not in ("session_id", "msg_idx", "block_idx")]
    return blocks.withColumn("rank", F.row_number().over(newest)).filter("rank = 1").select("session_id", "msg_idx", "block_idx", *rest)


def positions(blocks: DataFrame, input_cap: int = 1500, summary_cap: int = 2000) -> DataFrame:
    """One row per tool call of an assistant message.

    The message's last thinking block goes to its first tool call; later calls of the message have none. An empty
    thinking block counts as a thinking block, not as real reasoning; a missing name is '?', a missing input '{}'.
    """
    own = blocks.filter((F.col("role") == "assistant") & F.col("type").isin("tool_use", "thinking"))
    call = F.col("type") == "tool_use"
    per_message = own.groupBy("session_id", "msg_idx").agg(
        F.min(F.when(call, F.col("block_idx"))).alias("first_call"),
        F.max_by(F.when(~call, F.coalesce("content", F.lit(""))), F.when(~call, F.col("block_idx"))).alias("thinking"),
    )
    summary = F.when(F.col("block_idx") == F.col("first_call"), F.left("thinking", F.lit(summary_cap)))
    return own.filter(call).join(per_message, ["session_id", "msg_idx"]).select(
        position_key(F.col("session_id"), F.col("msg_idx"), F.col("block_idx")).alias("key"),
        F.col("session_id").alias("sid"), "msg_idx", "block_idx",
        summary.isNotNull().alias("has_thinking_block"),
        (~is_blank(summary)).alias("has_real_thinking"),
        summary.alias("real_thinking_summary"),
        F.coalesce("name", F.lit("?")).alias("action_name"),
        F.left(F.coalesce("input", F.lit("{}")), F.lit(input_cap)).alias("action_input"),
        F.col("msg_idx").alias("n_prior_msgs"),
    )


def anchors(positions: DataFrame) -> DataFrame:
    """Positions with recorded, non-empty reasoning."""
    return positions.filter(F.col("has_real_thinking") & ~is_blank(F.col("real_thinking_summary")))


def anchor_share(positions: DataFrame) -> DataFrame:
    """Per action the number of positions and the share of them with recorded reasoning."""
    return positions.groupBy("action_name").agg(
        F.count("*").alias("n_positions"), F.round(F.avg(F.col("has_real_thinking").cast("double")), 6).alias("anchored_share")
    )


def distinct_positions(positions: DataFrame) -> DataFrame:
    """Given position rows without exact repeats, with their key."""
    return positions.distinct().withColumn("key", position_key(F.col("sid"), F.col("msg_idx"), F.col("block_idx")))


def messages(sessions: DataFrame) -> DataFrame:
    """Messages of text-only session records with their ordinal; null and empty message lists give nothing."""
    return sessions.select("rec_id", "session_id", F.posexplode("messages").alias("msg_idx", "m")).select("rec_id", "session_id", "msg_idx", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
