"""Scores of a target given a prefix, behind one small interface.

A scorer is a function of a DataFrame. To rows with ``prefix`` and ``target`` it adds ``logprob`` and ``n_tok``; to rows with ``prefix`` and
an array ``targets`` it adds ``scored``, an array of (logprob, n_tok), so one prefix is read once for several targets. Language
models are reached through ``trailbed.sources.models``; the stand-in here is a smoothed unigram model of the prefix. It makes
the operators around it testable and does not stand for any model's numbers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailbed.operators.cohort import md5_number, seeded_order
from trailbed.operators.stats import quartiles
from trailbed.session import materialize

Scorer = Callable[[DataFrame], DataFrame]

_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def _tokens(text: str | None) -> list[str]:
    return [t for t in _SPACE.split(text or "") if t]


def stand_in(vocabulary: int = 10_000) -> Scorer:
    """Sum over the target's tokens of ln((count in the prefix + 1) / (prefix length + vocabulary)); Arrow batches, one pass over each prefix."""

    @F.pandas_udf("array<struct<logprob double, n_tok int>>")
    def each(prefix: pd.Series, targets: pd.Series) -> pd.Series:
        out = []
        for p, given in zip(prefix, targets, strict=True):
            seen = Counter(_tokens(p))
            size = float(seen.total() + vocabulary)
            rows = []
            for t in given:
                own = _tokens(t)
                rows.append({"logprob": sum(math.log((seen[w] + 1) / size) for w in own) if own else 0.0, "n_tok": len(own)})
            out.append(rows)
        return pd.Series(out)

    def score(rows: DataFrame) -> DataFrame:
        if "targets" in rows.columns:
            return rows.withColumn("scored", each("prefix", "targets"))
        one = rows.withColumn("scored", each("prefix", F.array("target")))
        return one.withColumns({"logprob": F.col("scored")[0]["logprob"], "n_tok": F.col("scored")[0]["n_tok"]}).drop("scored")

    return score


def sufficiency(with_reason: Column, base: Column) -> Column:
    """log P(action | context, rationale) - log P(action | context)."""
    return with_reason - base


def naturalness(logprob: Column, n_tok: Column) -> Column:
    """log P(rationale | context) per token; null without tokens."""
    return F.when(n_tok > 0, logprob / n_tok)


def score_rationales(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """rows: key, cand_idx, context, action, r. Adds base, s_suff and s_nat. Row by row: the context is read once for the action and the rationale, and nothing is shuffled."""
    plain = scorer(rows.select("key", "cand_idx", "r", "action", F.col("context").alias("prefix"), F.array("action", "r").alias("targets")))
    plain = plain.select("key", "cand_idx", F.concat_ws("\n", "prefix", "r").alias("prefix"), F.col("action").alias("target"), F.col("scored").alias("plain"))
    base, own = F.col("plain")[0]["logprob"], F.col("plain")[1]
    return scorer(plain).select("key", "cand_idx", base.alias("base"), sufficiency(F.col("logprob"), base).alias("s_suff"), naturalness(own["logprob"], own["n_tok"]).alias("s_nat"))


def _ring(sessions: DataFrame, order: str, *columns: str) -> DataFrame:
    """(sid, next): of each session the next one in ``order`` as a struct of sid and ``columns``, the first after the last; null if it is alone.

    Sessions are ranged by the order; only a range is sorted by one task, and the last of a range takes the first of the next.
    """
    parts = max(2, sessions.sparkSession.sparkContext.defaultParallelism)
    ranged = materialize(sessions.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "ring")
    item = F.struct("sid", *columns)
    heads = ranged.groupBy("part").agg(F.min_by(item, order).alias("head"))
    by_part = Window.orderBy("part")  # a row per range
    heads = heads.select("part", F.coalesce(F.lead("head").over(by_part), F.first("head").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    linked = ranged.withColumn("next", F.lead(item).over(Window.partitionBy("part").orderBy(order))).join(F.broadcast(heads), "part")  # a row per range
    following = F.coalesce("next", "after")
    return linked.select("sid", F.when(following["sid"] != F.col("sid"), following).alias("next"))


def mismatched(anchors: DataFrame, text: str = "real_thinking_summary", bucket_sessions: int = 10_000) -> DataFrame:
    """Each anchor with the first text (by key) of the next session as ``other``; null if there is no other session.

    Sessions form a ring in the order of their ids. ``bucket_sessions`` is kept for callers of old; ranges now follow the number of cores.
    """
    firsts = anchors.groupBy("sid").agg(F.min_by(text, "key").alias("lend"))
    return anchors.join(_ring(firsts, "sid", "lend").select("sid", F.col("next.lend").alias("other")), "sid")


def random_control(anchors: DataFrame, text: str = "real_thinking_summary", seed: int = 11) -> DataFrame:
    """Each anchor with a text of another session as ``other``, drawn by a seed; null if there is no other session.

    Sessions form a ring in the order of a seeded hash; an anchor takes from the next session the text whose place in seeded order is the
    anchor's own hash modulo that session's number of texts. Places are counted in two levels (256 buckets of the hash), so a runaway
    session is spread over many tasks.
    """
    drawn = anchors.select("sid", "key", F.col(text).alias("other"), seeded_order(F.col("key"), seed).alias("h")).withColumn("far", F.substring("h", 1, 2))
    blocks = drawn.groupBy("sid", "far").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("sid").orderBy("far").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("sid", "far").orderBy("h", "key")) - 1
    placed = drawn.select("sid", "far", place.alias("inner"), "key").join(blocks.select("sid", "far", before.alias("before")), ["sid", "far"]).select("key", (F.col("before") + F.col("inner")).alias("place"))
    sessions = blocks.groupBy("sid").agg(F.sum("m").alias("m")).withColumn("h", seeded_order(F.col("sid"), seed))
    ring = _ring(sessions, "h", "m").select("sid", F.col("next.sid").alias("lender"), F.col("next.m").alias("m"))
    wanted = anchors.join(ring, "sid").withColumn("place", F.pmod(md5_number(F.col("key")), F.col("m")))
    lent = drawn.select(F.col("sid").alias("lender"), "key", "other").join(placed, "key").drop("key")
    return wanted.join(lent, ["lender", "place"], "left").drop("lender", "place", "m")


def with_future(anchors: DataFrame, text: str = "real_thinking_summary") -> DataFrame:
    """Each anchor but the last of its session with the session's last text as ``future``."""
    last = anchors.groupBy("sid").agg(F.max_by(F.struct("key", F.col(text).alias("future")), F.struct("msg_idx", "block_idx")).alias("z"))
    return anchors.join(last.select("sid", F.col("z.key").alias("last_key"), F.col("z.future").alias("future")), "sid").filter("key <> last_key").drop("last_key")


def dual_calibration(anchors: DataFrame, scorer: Scorer, threshold: float = 3.0) -> DataFrame:
    """One row on anchors (key, sid, msg_idx, block_idx, context, action, real_thinking_summary): pass rates of the own, the
    session's last and another session's text, how often the own text is the more natural one, and the base's quartiles.
    """
    text = "real_thinking_summary"
    anchors = materialize(anchors, "anchors")  # three controls are drawn from it
    future = with_future(anchors, text).select("key", "future")
    rows = random_control(anchors, text).join(future, "key")
    long = rows.select("key", "context", "action", F.posexplode(F.array(text, "future", "other")).alias("cand_idx", "r")).filter("r IS NOT NULL")
    s = score_rationales(long, scorer)
    of = lambda c, i: F.max(F.when(F.col("cand_idx") == i, F.col(c)))
    names = ("own", "future", "random")
    wide = materialize(s.groupBy("key").agg(F.max("base").alias("base"), *[of(c, i).alias(f"{k}_{n}") for i, n in enumerate(names) for c, k in (("s_suff", "suff"), ("s_nat", "nat"))]), "controls")
    rate = lambda c: F.round(F.avg((F.col(c) >= threshold).cast("double")), 6)
    wins = lambda n: F.round(F.avg((F.round("nat_own", 9) > F.round(f"nat_{n}", 9)).cast("double")), 6)
    rates = wide.agg(
        F.count("*").alias("n"), *[rate(f"suff_{n}").alias(f"pass_{n}") for n in names], wins("future").alias("nat_wins_future"), wins("random").alias("nat_wins_random"),
    )
    quarters = quartiles(wide, "base").toDF(*[f"base_q{q}" for q in (25, 50, 75)])
    return rates.join(quarters)  # one row with one row
