"""The text a model would see before an action: the last characters of all that came earlier in its session.

A session's rendered parts form one stream of characters. The stream is cut at multiples of the window's length, so
each piece is bounded however long the session; a context is the join of at most two pieces. Offsets are prefix sums
taken in two levels (blocks of messages, then within them), so that one runaway session is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailbed.session import materialize


def rendered(blocks: DataFrame, call_cap: int | None = 400, result_cap: int | None = 800, tagged: bool = True) -> DataFrame:
    """(session_id, msg_idx, block_idx, part): texts, calls and results as lines; thinking is never shown."""
    content = F.coalesce("content", F.lit(""))
    cut = lambda c, n: c if n is None else F.left(c, F.lit(n))
    call = cut(F.coalesce("input", F.lit("{}")), call_cap)
    role = F.coalesce("role", F.lit(""))
    if tagged:
        part = (
            F.when(F.col("type") == "text", F.concat(F.lit("["), role, F.lit("] "), content))
            .when(F.col("type") == "tool_use", F.concat(F.lit("["), role, F.lit(" 调用 "), F.coalesce("name", F.lit("?")), F.lit("] "), call))
            .when(F.col("type") == "tool_result", F.concat(F.lit("[工具返回] "), cut(content, result_cap)))
        )
    else:
        part = F.when(F.col("type") == "tool_use", call).when(F.col("type") == "text", content).when(F.col("type") == "tool_result", cut(content, result_cap))
    return blocks.select("session_id", "msg_idx", "block_idx", part.alias("part")).filter("part IS NOT NULL")


def contexts(parts: DataFrame, at: DataFrame, max_chars: int = 9000, stride: int = 256) -> DataFrame:
    """(session_id, msg_idx, context) for the distinct messages in ``at``: parts of earlier messages by newline, the last ``max_chars`` of them.

    A message without earlier parts has an empty context. ``stride`` is the number of messages per first-level block.
    """
    n = F.lit(max_chars)
    line = F.concat(F.lit("\n"), F.col("part"))
    # Written once: the offsets below need the sizes several times, the texts once.
    sized = materialize(parts.withColumn("size", F.length("part") + 1).withColumn("far", F.floor(F.col("msg_idx") / stride)), "parts")
    blocks = sized.groupBy("session_id", "far").agg(F.sum("size").alias("block_size"))
    before = F.sum("block_size").over(Window.partitionBy("session_id").orderBy("far").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("session_id", "far", F.coalesce(before, F.lit(0)).alias("block_start"), F.col("block_size"))
    within = Window.partitionBy("session_id", "far").orderBy("msg_idx", "block_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(blocks, ["session_id", "far"]).withColumn("start", F.col("block_start") + F.col("inner"))
    k = F.explode(F.sequence(F.floor(F.col("start") / n), F.floor((F.col("start") + F.col("size") - 1) / n))).alias("k")
    low = F.greatest(F.lit(0), F.col("k") * n - F.col("start"))
    piece = F.substring(line, (low + 1).cast("int"), F.least(n, F.col("start") + F.col("size") - F.greatest("start", F.col("k") * n)).cast("int"))
    cut = placed.select("session_id", "start", line.alias("line"), "part", "size", k).select(
        "session_id", "k", "start", F.left(piece, (F.least(F.col("start") + F.col("size"), (F.col("k") + 1) * n) - F.greatest("start", F.col("k") * n)).cast("int")).alias("piece")
    )
    pieces = cut.groupBy("session_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "").alias("text"))
    # Where each wanted message ends: all earlier parts of its block, or all earlier blocks. Only sizes are needed for this.
    none = F.lit(0).cast("long")
    spots = materialize(at.select("session_id", "msg_idx").distinct().withColumn("far", F.floor(F.col("msg_idx") / stride)), "spots")
    own = sized.groupBy("session_id", "far", "msg_idx").agg(F.sum("size").alias("own"), F.lit(False).alias("wanted"))
    both = own.unionByName(spots.select("session_id", "far", "msg_idx", none.alias("own"), F.lit(True).alias("wanted")))
    ends = both.groupBy("session_id", "far", "msg_idx").agg(F.sum("own").alias("own"), F.max("wanted").alias("wanted"))
    upto = Window.partitionBy("session_id", "far").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("inner", F.coalesce(F.sum("own").over(upto), F.lit(0))).filter("wanted")
    sums = own.groupBy("session_id", "far").agg(F.sum("own").alias("block_size"))
    levels = sums.unionByName(spots.select("session_id", "far", none.alias("block_size")).distinct()).groupBy("session_id", "far").agg(F.sum("block_size").alias("block_size"))
    levels = levels.select("session_id", "far", F.coalesce(before, F.lit(0)).alias("block_start"))
    wanted = ends.join(levels, ["session_id", "far"]).select("session_id", "msg_idx", (F.col("block_start") + F.col("inner")).alias("end"))
    # Each piece with the one before it; a context lies within the two. Only pieces are shuffled, contexts come out of the last join.
    pairs = pieces.join(pieces.select("session_id", (F.col("k") + 1).alias("k"), F.col("text").alias("prev")), ["session_id", "k"], "left")
    found = wanted.withColumn("k", F.floor((F.col("end") - 1) / n)).join(pairs, ["session_id", "k"], "left")
    base = (F.col("k") - F.col("prev").isNotNull().cast("int")) * n
    shown = F.left(F.concat(F.coalesce("prev", F.lit("")), F.col("text")), (F.col("end") - base).cast("int"))
    # The stream begins with a newline that is no part of the context.
    context = F.right(F.when(base == 0, F.substring(shown, 2, 2**31 - 1)).otherwise(shown), n)
    return found.select("session_id", "msg_idx", F.when(F.col("end") > 0, context).otherwise("").alias("context"))


def action_text(name: Column, given: Column, cap: int = 400) -> Column:
    return F.concat(F.lit("调用工具 "), F.coalesce(name, F.lit("?")), F.lit(",参数: "), F.left(F.coalesce(given, F.lit("{}")), F.lit(cap)))


COARSE = "{context}\n\n下一步动作的类型：{kind}。请用第一人称写出 {n} 个不同的想法，每个以 ### 开头。"
FULL = "{context}\n\n下一步动作：{action}。请用第一人称写出 {n} 个不同的想法，每个以 ### 开头，不要提到上文没有的名称。"


def prompts(template: str, context: Column, kind: Column, action: Column, n: int = 4) -> Column:
    """A template filled by replacement, so signs in the texts have no meaning."""
    out = F.lit(template)
    for name, value in (("{n}", F.lit(str(n))), ("{kind}", kind), ("{action}", action), ("{context}", context)):
        out = F.replace(out, F.lit(name), value)
    return out
