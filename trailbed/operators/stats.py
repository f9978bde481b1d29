"""Statistics of the evaluation: exact medians, index quantiles, funnels, win rates, histograms, perplexity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailbed.session import materialize

SALTS = 32


def at_ranks(values: DataFrame, ranks: Callable[[Column], list[tuple[Column, Column]]], bins: int = 4096) -> DataFrame:
    """(g, q, value): of each group ``g`` of (g, v, n), n counting equal values, the values at the ranks from 0 that ``ranks`` gives as (q, rank) of the group's total.

    Running counts are taken in two levels: over equal-width bins of a group's range, then over the distinct values of the
    bin a rank falls in. So no task sorts or holds all values of a group.
    """
    span = values.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    place = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    # A group's values are joined with its span in SALTS parts, so that a hot group is spread over as many tasks.
    each = span.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    binned = values.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(each, ["g", "salt"]).drop("salt").withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), place)).otherwise(F.lit(0)).cast("int"))
    level = binned.groupBy("g", "bin").agg(F.sum("n").alias("m"), F.first("total").alias("total"))
    upto = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows of a group
    level = level.withColumn("under", F.coalesce(F.sum("m").over(upto), F.lit(0)))
    wanted = F.explode(F.array(*[F.struct(q.alias("q"), r.cast("long").alias("rank")) for q, r in ranks(F.col("total"))])).alias("w")
    hit = level.select("g", "bin", "m", "under", wanted).select("g", "bin", "m", "under", "w.*").filter((F.col("rank") >= F.col("under")) & (F.col("rank") < F.col("under") + F.col("m")))
    inner = binned.select("g", "bin", "v", "n").join(hit.select("g", "bin", "q", "rank", "under"), ["g", "bin"])
    run = F.sum("n").over(Window.partitionBy("g", "q").orderBy("v"))
    return inner.withColumn("upto", F.col("under") + run).filter("rank < upto").groupBy("g", "q").agg(F.min("v").alias("value"))


def counted(df: DataFrame, column: str, group: Column) -> DataFrame:
    """(g, v, n): the distinct values of a column by group, without nulls and NaN."""
    return df.select(group.alias("g"), F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)").groupBy("g", "v").agg(F.count("*").alias("n"))


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exact medians (the mean of the middle two) without nulls; null where there is no value. One row without ``by``, also for no rows.

    All columns go through one pass as (group, column, value).
    """
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    long = df.select(key.alias("key"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("key", "x.*")
    values = counted(long, "v", F.struct("key", "c"))
    middle = at_ranks(values, lambda n: [(F.lit(0), F.floor((n - 1) / 2)), (F.lit(1), F.floor(n / 2))]).groupBy("g").agg(F.avg("value").alias("m"))
    of = [F.round(F.max(F.when(F.col("g.c") == c, F.col("m"))), 6).alias(f"median_{c}") for c in columns]
    if not by:
        return middle.agg(*of)
    wide = middle.groupBy(F.col("g.key").alias("key")).agg(*of)
    return df.select(*by).distinct().withColumn("key", key).join(wide, "key", "left").drop("key")


def index_quantiles(df: DataFrame, column: str, at: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(q, value) with value = sorted[int(n * q)], nulls left out; no rows for no values."""
    got = at_ranks(counted(df, column, F.lit(0)), lambda n: [(F.lit(float(q)), F.floor(n * q)) for q in at])
    return got.select("q", F.round("value", 6).alias("value"))


def quartiles(df: DataFrame, column: str) -> DataFrame:
    """One row with q25, q50 and q75 of the non-null values, linear between neighbours; null where there is no value."""
    at = (0.25, 0.5, 0.75)
    place = lambda n, q: (n - 1) * F.lit(q)
    ends = lambda n: [(F.struct(F.lit(q).alias("q"), F.lit(i).alias("side"), (place(n, q) - F.floor(place(n, q))).alias("part")), (F.floor, F.ceil)[i](place(n, q))) for q in at for i in (0, 1)]
    got = at_ranks(counted(df, column, F.lit(0)), ends).select("q.*", "value")
    share = F.when(F.col("side") == 1, F.col("part")).otherwise(1 - F.col("part"))
    return got.agg(*[F.round(F.sum(F.when(F.col("q") == q, share * F.col("value"))), 6).alias(f"q{int(100 * q)}") for q in at])


def running_medians(df: DataFrame, order: str, column: str, points: int = 10) -> DataFrame:
    """(point, n, median): the median of the first n of all rows by a unique ``order``, at ``points`` evenly spaced places, nulls of the column left out.

    Rows are placed among the points by quantiles of their order, so nothing is sorted as a whole; each row counts at no more than
    ``points`` places.
    """
    rows = df.select(F.col(order).alias("o"), F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND o IS NOT NULL")
    total = rows.agg(F.count("*").alias("n"))
    ranked = numbered(rows, "o")
    cut = rows.sparkSession.range(1, points + 1).select(F.col("id").cast("int").alias("point"))
    ends = cut.join(F.broadcast(total)).select("point", F.floor(F.col("n") * F.col("point") / points).alias("n")).filter("n > 0")  # one row
    marks = ends.agg(F.collect_list(F.struct("point", "n")).alias("ends"))
    long = ranked.join(F.broadcast(marks)).select("v", F.explode(F.filter("ends", lambda e: e["n"] > F.col("rank"))).alias("e"))  # one row of ``points`` marks
    got = medians(long.select(F.col("e.point").alias("point"), F.col("e.n").alias("n"), "v"), ["v"], ["point", "n"])
    return got.select("point", "n", F.col("median_v").alias("median"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """The rows with ``rank``, their place from 0 by a unique ``order``; ranges of the order are counted by themselves and their counts summed up."""
    parts = rows.sparkSession.sparkContext.defaultParallelism
    ranged = materialize(rows.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    inner = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("inner", inner).join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("rank", F.col("before") + F.col("inner")).drop("inner", "before", "part")


def pass_rates(df: DataFrame, column: str, thresholds: Sequence[float], at_least: bool = True) -> DataFrame:
    """(threshold, n, n_pass, share) over the non-null values, one pass over the data."""
    c = F.col(column)
    cuts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    hit = (c >= F.col("threshold")) if at_least else (c <= F.col("threshold"))
    return df.filter(c.isNotNull()).select(column, cuts).groupBy("threshold").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("n_pass"), F.round(F.avg(hit.cast("double")), 6).alias("share")
    )


def win_rate(a: Column, b: Column) -> Column:
    """Share of pairs with a > b; pairs with a null are left out."""
    return F.round(F.avg(F.when(a.isNotNull() & b.isNotNull(), (a > b).cast("double"))), 6)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins, the last closed, values outside left out, empty bins absent."""
    c = F.col(column)
    width = (high - low) / bins
    k = F.when(c == high, F.lit(bins - 1)).otherwise(F.floor((c - low) / width)).cast("int")
    return df.filter((c >= low) & (c <= high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def perplexity(logprob: Column, tokens: Column) -> Column:
    """exp(-sum / sum); 1 where there are no tokens."""
    return F.round(F.exp(-F.coalesce(F.sum(logprob), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(tokens), F.lit(0)), F.lit(1))), 6)
