"""Positions of sessions that arrive as a stream of raw lines.

A position depends on one record only, so the stream needs no state but the keys already seen, which a watermark on the
time of receipt bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailbed.functions.text import position_key
from trailbed.operators.flatten import FLAT, INPUT, _flatten  # noqa: F401 - FLAT documents the columns

RAW = "line_no long, raw string, received_at timestamp"


def raw_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of (line_no, raw, received_at) as they are added to a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def calls_stream(lines: DataFrame) -> DataFrame:
    """(line_no, msg_idx, block_idx, name) of every tool call in a stream of raw lines."""
    source = lines.select(F.col("line_no").alias("id"), "raw").dropna()
    flat = source.mapInPandas(lambda it: _flatten(it, frozenset([INPUT]), ("type", "role", "name")), FLAT)
    call = (F.col("grp") == "messages[].content[]") & (F.col("vals")["type"] == "tool_use")
    return flat.filter(call).select(F.col("id").alias("line_no"), F.col("ords")[0].alias("msg_idx"), F.col("ords")[1].alias("block_idx"), F.coalesce(F.col("vals")["name"], F.lit("?")).alias("name"))


def positions_stream(blocks: DataFrame, delay: str = "7 days") -> DataFrame:
    """Tool calls of a stream of flat blocks, repeated deliveries within ``delay`` of receipt dropped."""
    own = blocks.filter("role = 'assistant' AND type = 'tool_use'").withWatermark("ingested_at", delay)
    once = own.dropDuplicatesWithinWatermark(["session_id", "msg_idx", "block_idx"])
    return once.select(position_key(F.col("session_id"), F.col("msg_idx"), F.col("block_idx")).alias("key"), "session_id", "msg_idx", "block_idx", F.coalesce("name", F.lit("?")).alias("action_name"), "ingested_at")


def hourly_calls(blocks: DataFrame, delay: str = "1 day") -> DataFrame:
    """Calls per tool and hour of receipt in a stream of flat blocks; rows later than ``delay`` are left out."""
    own = blocks.filter("type = 'tool_use'").withWatermark("ingested_at", delay)
    return own.groupBy(F.window("ingested_at", "1 hour"), F.coalesce("name", F.lit("?")).alias("name")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "name", "n")
