"""Candidate and score sets: deduplication and their long forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_candidates(candidates: DataFrame) -> DataFrame:
    """One row per key. Keys given twice keep the longest list, then the greatest text: a fixed order where files have none."""
    joined = F.coalesce(F.array_join("candidates", "\u0001"), F.lit(""))
    rank = F.struct(F.coalesce(F.size("candidates"), F.lit(-1)), joined, F.coalesce("provider", F.lit("")))
    return candidates.filter("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("candidates", "provider"), rank).alias("r")).select("key", "r.*")


def long_candidates(candidates: DataFrame) -> DataFrame:
    """(key, provider, cand_idx, r), empty and null lists without rows."""
    return candidates.select("key", "provider", F.posexplode("candidates").alias("cand_idx", "r"))


def long_scores(scores: DataFrame) -> DataFrame:
    """(key, base, cand_idx, r, s_suff, s_nat, leaked); a null leak list counts as clean."""
    return scores.select("key", "base", F.posexplode("results").alias("cand_idx", "x")).select(
        "key", "base", "cand_idx", F.col("x.r").alias("r"), F.col("x.s_suff").alias("s_suff"), F.col("x.s_nat").alias("s_nat"), (F.coalesce(F.size("x.leak"), F.lit(0)) > 0).alias("leaked")
    )
