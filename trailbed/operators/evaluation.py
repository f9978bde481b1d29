"""Evaluation and datasheet measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailbed.functions.text import is_blank
from trailbed.operators.scoring import Scorer
from trailbed.operators.stats import medians, perplexity


def intrinsic(spans: DataFrame, scorer: Scorer) -> DataFrame:
    """spans: tag ('think' or 'action'), prefix, target. One row: perplexity of thinking, log-probability per action token."""
    s = scorer(spans)
    think, act = F.col("tag") == "think", F.col("tag") == "action"
    return s.agg(
        perplexity(F.when(think, F.col("logprob")), F.when(think, F.col("n_tok"))).alias("think_ppl"), F.count_if(think).alias("think_spans"),
        F.round(F.coalesce(F.sum(F.when(act, F.col("logprob"))), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(F.when(act, F.col("n_tok"))), F.lit(0)), F.lit(1)), 6).alias("action_lp_per_tok"), F.count_if(act).alias("action_spans"),
    )


def tool_cases(positions: DataFrame, least_tools: int = 2) -> tuple[DataFrame, DataFrame]:
    """(cases, tools): the first call of each assistant message in sessions with ``least_tools`` tools or more, and those tools in order.

    For positions without their sessions' lists of tools: the tools are those that occur. ``eligible_calls`` takes the lists.
    """
    tools = positions.groupBy("sid").agg(F.array_sort(F.collect_set("action_name")).alias("tools")).filter(F.size("tools") >= least_tools)
    first = positions.groupBy("sid", "msg_idx").agg(F.min_by(F.struct("key", "action_name"), "block_idx").alias("c")).select("sid", "msg_idx", "c.*")
    return first.join(tools.select("sid"), "sid", "left_semi"), tools


def eligible_calls(calls: DataFrame, tools: DataFrame, least_tools: int = 2) -> DataFrame:
    """(session, msg_idx, block_idx, name, n_tools): of each message the first call whose tool is among its session's own tools.

    calls: session, msg_idx, block_idx, name; tools: session, name. Sessions with fewer than ``least_tools`` distinct tools have none.
    """
    known = tools.select("session", "name").dropna().distinct()
    enough = known.groupBy("session").agg(F.count("*").alias("n_tools")).filter(F.col("n_tools") >= least_tools)
    own = calls.join(known, ["session", "name"]).groupBy("session", "msg_idx").agg(F.min_by(F.struct("block_idx", "name"), "block_idx").alias("c"))
    return own.join(enough, "session").select("session", "msg_idx", "c.*", "n_tools")


def action_top1(cases: DataFrame, tools: DataFrame, contexts: DataFrame, scorer: Scorer) -> DataFrame:
    """(key, action_name, guess, correct): the tool whose name scores best per token, the first in order among equals.

    tools: sid and the array ``tools`` in order. A case is one row with its context once, whatever the number of tools.
    """
    rows = cases.join(contexts, ["sid", "msg_idx"]).join(tools, "sid").select("key", "action_name", "tools", F.col("context").alias("prefix"), F.col("tools").alias("targets"))
    scored = scorer(rows)
    per = F.transform("scored", lambda x, i: F.struct(F.round(x["logprob"] / F.greatest(x["n_tok"], F.lit(1)), 9).alias("s"), (-i).alias("at")))
    return scored.select("key", "action_name", F.get("tools", -F.array_max(per)["at"]).alias("guess")).withColumn("correct", F.col("guess") == F.col("action_name"))


def accuracy(top1: DataFrame, most: int = 8) -> DataFrame:
    """Per tool, the ``most`` frequent ones, by name among equals: n and acc."""
    return top1.groupBy(F.col("action_name").alias("tool")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("acc")).orderBy(F.desc("n"), "tool").limit(most)


def density(blocks: DataFrame) -> DataFrame:
    """Reasoning density by an assistant turn's place from the session's end: (place, turns, thinking_blocks, empty, nonempty_per_100_turns).

    A turn's place is counted from per-session totals in blocks of turns, so a runaway session is not one task's work.
    """
    a = blocks.filter("role = 'assistant'")
    think = F.col("type") == "thinking"
    turn = a.groupBy("session_id", "msg_idx").agg(F.count_if(think).alias("n"), F.count_if(think & is_blank(F.col("content"))).alias("empty"))
    turn = turn.withColumn("far", F.floor(F.col("msg_idx") / 256))
    later = turn.groupBy("session_id", "far").agg(F.count("*").alias("m"))
    after = F.coalesce(F.sum("m").over(Window.partitionBy("session_id").orderBy(F.desc("far")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("session_id", "far").orderBy(F.desc("msg_idx")))
    placed = turn.withColumn("inner", inner).join(later.select("session_id", "far", after.alias("after")), ["session_id", "far"]).withColumn("rank", F.col("after") + F.col("inner"))
    place = F.when(F.col("rank") == 1, "last").when(F.col("rank") == 2, "second_last").when(F.col("rank") <= 5, "3rd_to_5th").otherwise("earlier")
    return placed.groupBy(place.alias("place")).agg(
        F.count("*").alias("turns"), F.sum("n").alias("thinking_blocks"), F.sum("empty").alias("empty_blocks"),
        F.round(F.sum("empty") / F.greatest(F.sum("n"), F.lit(1)), 6).alias("empty_rate"), F.round(100.0 * (F.sum("n") - F.sum("empty")) / F.count("*"), 6).alias("nonempty_per_100_turns"),
    )


def sessions_without_reasoning(blocks: DataFrame) -> DataFrame:
    """One row: sessions, and the share of them without any non-blank thinking."""
    per = blocks.groupBy("session_id").agg(F.max((F.col("type") == "thinking") & ~is_blank(F.col("content"))).alias("has"))
    return per.agg(F.count("*").alias("n_sessions"), F.round(F.avg((~F.col("has")).cast("double")), 6).alias("share_without"))


def cost(rows: DataFrame, tokens_in: str, tokens_out: str, usd_in: float = 0.209, usd_out: float = 0.31, targets: int = 40_000) -> DataFrame:
    """One row: tokens, price at the given USD per million tokens, price per row and for ``targets`` rows."""
    usd = (F.coalesce(F.sum(tokens_in), F.lit(0)) * usd_in + F.coalesce(F.sum(tokens_out), F.lit(0)) * usd_out) / 1e6
    each = usd / F.greatest(F.count("*"), F.lit(1))
    return rows.agg(F.count("*").alias("n"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"), F.round(usd, 6).alias("usd"), F.round(each, 9).alias("usd_per_row"), F.round(each * targets, 6).alias("usd_projected"))


def position_value(positions: DataFrame, scores: DataFrame) -> DataFrame:
    """(key, sid, action, base_lp, ntok, base_per_tok), the least likely actions first."""
    n = F.size(F.filter(F.split("action_input", r"\s+"), lambda x: x != ""))
    rows = positions.join(scores.select("key", F.col("base").alias("base_lp")), "key").filter("base_lp IS NOT NULL").withColumn("ntok", n)
    return rows.select("key", "sid", F.col("action_name").alias("action"), "base_lp", "ntok", F.round(F.col("base_lp") / F.greatest("ntok", F.lit(1)), 12).alias("base_per_tok")).orderBy("base_per_tok", "key")


def provider_yield(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per provider: scored texts, shares at or above 0, 1 and 3, the median score."""
    rows = scores.join(candidates.select("key", F.coalesce("provider", F.lit("?")).alias("provider")), "key").filter("s_suff IS NOT NULL")
    rates = rows.groupBy("provider").agg(F.count("*").alias("n"), *[F.round(F.avg((F.col("s_suff") >= t).cast("double")), 6).alias(f"pass_{t}") for t in (0, 1, 3)])
    return rates.join(medians(rows, ["s_suff"], ["provider"]).withColumnRenamed("median_s_suff", "median_suff"), "provider")


def session_tools(sessions: DataFrame) -> DataFrame:
    """(rec_id, n_tools, tools): distinct tool names in order; null lists count as empty."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform("tools", lambda t: t["name"]), lambda n: n.isNotNull())))
    names = F.coalesce(names, F.array().cast("array<string>"))
    return sessions.select("rec_id", F.size(names).cast("long").alias("n_tools"), F.array_join(names, ",").alias("tools"))


def count_map(rows: DataFrame, by: str, name: str) -> DataFrame:
    """(by, counts): how often each name occurs, as a map; names are counted before they are put together, so a map holds distinct names only."""
    each = rows.groupBy(by, name).agg(F.count("*").alias("n"))
    return each.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(name, "n"))).alias("counts"))


def sum_values(counts: Column) -> Column:
    """The sum over all values of a map."""
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x)


def sum_of(counts: Column, keys: list[str]) -> Column:
    """The sum over a fixed list of keys; absent ones count nothing."""
    return sum((F.coalesce(F.try_element_at(counts, F.lit(k)), F.lit(0).cast("long")) for k in keys), F.lit(0).cast("long"))
