"""Keys that hold so many rows that they must not meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(rows: DataFrame, share: int = 64, most: int = 10_000) -> DataFrame:
    """(k): the keys most frequent among one row in ``share`` of (k, x), at most ``most`` of them, so they may be broadcast.

    A guide to where rows are joined, not to what is found: a key that is missed, or listed in vain, changes no result.
    """
    seen = rows.filter(F.pmod(F.xxhash64("x", F.lit(1)), F.lit(share)) == 0).groupBy("k").agg(F.count("*").alias("seen"))
    return seen.filter("seen > 1").orderBy(F.desc("seen"), "k").limit(most).select("k")


def join_hot(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows joined with ``facts``, which has at most one row per key: rows of hot keys where they are, with a broadcast of at most 10,000 facts, others by a shuffle on the key."""
    hot = F.broadcast(hot.select(F.col("k").alias(key)))
    few = F.broadcast(facts.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_anti").join(facts, key).unionByName(rows.join(few, key))
