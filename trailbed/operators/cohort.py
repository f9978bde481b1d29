"""Cohorts, limits, samples, shards and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailbed.functions.text import parent_key


def top_sessions(anchors: DataFrame, n: int = 300) -> DataFrame:
    """The n sessions with most anchors, ties by session id."""
    return anchors.groupBy("sid").agg(F.count("*").alias("n_anchors")).orderBy(F.desc("n_anchors"), "sid").limit(n)


def of_sessions(positions: DataFrame, sessions: DataFrame) -> DataFrame:
    return positions.join(sessions.select("sid"), "sid", "left_semi")


def pending(work: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key is not done yet; running it again after all is done gives nothing."""
    return work.join(done.select(key).dropna().distinct(), key, "left_anti")


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def in_shard(key: Column, shard: int, shards: int) -> Column:
    """A fixed hash places each key in exactly one of ``shards``: the first 28 bits of its MD5, which any engine has."""
    return F.pmod(md5_number(key), F.lit(shards)) == shard


def md5_number(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("long")


def seeded_order(key: Column, seed: int) -> Column:
    """Sort key of a shuffle that a seed repeats exactly."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))


def by_short_key(work: DataFrame, positions: DataFrame, *columns: str) -> DataFrame:
    """(key, short_key, *columns): distinct keys of ``work`` joined with positions (sid, msg_idx, block_idx) on the key without its last part; of several calls in a message the last counts."""
    last = positions.withColumn("short_key", parent_key(F.col("key"))).groupBy("short_key").agg(F.max_by(F.struct(*columns), "block_idx").alias("p"))
    return work.select("key", parent_key(F.col("key")).alias("short_key")).distinct().join(last, "short_key").select("key", "short_key", "p.*")
