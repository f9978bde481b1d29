"""Foreknowledge: names in a rationale that its action has but nothing before the action shows.

Nothing is rendered for this. Names are taken out of every block once, their first message per session is a hash
aggregation, and a position's secret names are those without an earlier one: an equi-join on (session, name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailbed.functions.text import entities


def first_seen(parts: DataFrame) -> DataFrame:
    """(session_id, entity, msg_idx): the first message of the session that shows the name."""
    named = parts.select("session_id", "msg_idx", F.explode(entities(F.col("part"))).alias("entity"))
    return named.groupBy("session_id", "entity").agg(F.min("msg_idx").alias("seen_at"))


def secrets(positions: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, entity): names of the action (tool name and input) that no earlier message of the session shows."""
    own = positions.select("key", F.col("sid").alias("session_id"), "msg_idx", F.explode(entities(F.concat_ws(" ", "action_name", "action_input"))).alias("entity"))
    return own.join(seen, ["session_id", "entity"], "left").filter("seen_at IS NULL OR seen_at >= msg_idx").select("key", "entity")


def leaks(candidates: DataFrame, secret: DataFrame) -> DataFrame:
    """(key, cand_idx, leak) for each candidate text (key, cand_idx, r): its secret names in order, an empty array if there are none."""
    named = candidates.select("key", "cand_idx", F.explode(entities(F.col("r"))).alias("entity"))
    hit = named.join(secret, ["key", "entity"]).groupBy("key", "cand_idx").agg(F.array_sort(F.collect_set("entity")).alias("leak"))
    return candidates.select("key", "cand_idx").join(hit, ["key", "cand_idx"], "left").select("key", "cand_idx", F.coalesce("leak", F.array().cast("array<string>")).alias("leak"))


def leak_report(leak: DataFrame, scores: DataFrame, threshold: float = 3.0) -> DataFrame:
    """One row: candidates, those that leak, those accepted by score alone and by score without leak."""
    both = leak.join(scores.select("key", "cand_idx", "s_suff"), ["key", "cand_idx"], "left")
    clean, good = F.size("leak") == 0, F.coalesce(F.col("s_suff") >= threshold, F.lit(False))
    return both.agg(
        F.count("*").alias("n"), F.count_if(~clean).alias("n_leaked"), F.count_if(good).alias("n_by_score"), F.count_if(good & clean).alias("n_by_score_clean")
    )


def leak_report_columns(texts: DataFrame, secret: DataFrame, threshold: float = 3.0) -> DataFrame:
    """texts: key, kind, text, score. Per kind, over keys with a secret name: texts, those that leak and their share, those accepted by score alone and by score without leak."""
    rows = texts.join(secret.select("key").distinct(), "key", "left_semi")
    rows = rows.withColumn("names", entities(F.col("text")))
    own = secret.groupBy("key").agg(F.collect_set("entity").alias("own"))  # names of one action
    leaked = F.arrays_overlap("names", "own")
    good = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return rows.join(own, "key").groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(leaked).alias("n_leaked"), F.round(F.avg(leaked.cast("double")), 6).alias("leak_rate"), F.count_if(good).alias("n_by_score"), F.count_if(good & ~leaked).alias("n_by_score_clean")
    )
