"""Within-group selection of rationales and the verdicts on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailbed.operators.stats import medians

NO_SCORE = -1e9


def dual_verdict(scores: DataFrame, least_suff: float = 1.0, least_nat: float = -2.5) -> DataFrame:
    """Long scores with ``passed``: both scores reach their thresholds; a missing score fails."""
    return scores.withColumn("passed", F.coalesce((F.col("s_suff") >= least_suff) & (F.col("s_nat") >= least_nat), F.lit(False)))


def best_of_group(scores: DataFrame) -> DataFrame:
    """Per key the clean candidate of greatest s_suff, the first among equals; keys whose candidates all leak have no row."""
    rank = F.struct(F.coalesce("s_suff", F.lit(NO_SCORE)), -F.col("cand_idx"))
    return scores.filter("NOT leaked").groupBy("key").agg(F.max_by(F.struct("cand_idx", "r", "s_suff"), rank).alias("b")).select("key", "b.*")


def funnel(scores: DataFrame) -> DataFrame:
    """One row: positions, leaked candidates, positions lost because all leaked, positions selected."""
    per = scores.groupBy("key").agg(F.count("*").alias("n"), F.count_if("leaked").alias("bad"))
    return per.agg(
        F.count("*").alias("positions"), F.coalesce(F.sum("bad"), F.lit(0)).alias("leaked_candidates"),
        F.count_if(F.col("n") == F.col("bad")).alias("all_leaked"), F.count_if(F.col("n") > F.col("bad")).alias("selected"),
    )


def best_minus_single(scores: DataFrame) -> DataFrame:
    """Median of each group's best clean score less the median of all clean scores."""
    clean = scores.filter("NOT leaked AND s_suff IS NOT NULL")
    best = clean.groupBy("key").agg(F.max("s_suff").alias("best")).select("best", F.lit(None).cast("double").alias("single"))
    both = best.unionByName(clean.select(F.lit(None).cast("double").alias("best"), F.col("s_suff").alias("single")))
    return medians(both, ["best", "single"]).select("median_best", "median_single", F.round(F.col("median_best") - F.col("median_single"), 6).alias("gain"))
