"""Near-duplicate records with small edits (problem 3).

Method: meet-in-the-middle ball hashing. A record's fingerprint is a vector of ``slots`` min-hash
values of its character 9-grams; the distance of two fingerprints is the number of slots that differ.
Two fingerprints at a distance of at most ``2 * blanks``, counted as symmetric difference of their sets
of (slot, value), meet at their intersection, which lies ``blanks`` from either. So each emits all
variants within half the radius, that is with ``blanks`` slots left out, and equal variants meet.
``tables`` independent fingerprints make a miss unlikely: a pair at the similarity 0.6 is found with
probability 1 - (1 - P)^tables, P = P(Binomial(slots, 0.6) >= slots - blanks); with the defaults
(5 slots, 1 blank, 17 tables) 0.999, at 0.65 0.9999, at 0.7 and more within 1e-6 of 1.

Steps: fingerprint in one pass; records of equal text stand as one class; shuffle on variants; drop
lone variants; pair within a variant, in blocks, so that a hot variant is spread over many tasks;
deduplicate the pairs; drop those whose bit sketches are far beyond the threshold; verify the rest
exactly. Verification sends each text once per cell of pairs, not once per pair. Pairs of classes are
expanded to members only where the caller asks for all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailbed.llm.codes import U32, U64, gram_hashes, lay, mix64, slices
from trailbed.llm.hot import hot_keys
from trailbed.session import discard, materialize, spread

GRAM = 9


def record_text(system: str | Column = "system", messages: str | Column = "messages") -> Column:
    """System and contents joined by a space, lower-cased, runs of other than letters and digits as one space."""
    system, messages = (F.col(x) if isinstance(x, str) else x for x in (system, messages))
    parts = F.concat(F.array(F.coalesce(system, F.lit(""))), F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))))
    return F.trim(F.regexp_replace(F.lower(F.array_join(parts, " ")), r"[^\p{L}\p{N}]+", " "))


def _fingerprints(batches: Iterator[pd.DataFrame], tables: int, slots: int, blanks: int) -> Iterator[pd.DataFrame]:
    n = tables * slots
    rng = np.random.default_rng(20240917)
    factors = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(U32) | U32(1)
    salts = mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    variants = [(t, left) for t in range(tables) for left in combinations(range(slots), blanks)]
    for pdf in batches:
        texts, ids = pdf["text"].tolist(), pdf["rec_id"].to_numpy()
        for lo, hi in slices(texts, 1 << 19):
            codes, starts, lengths = lay(texts[lo:hi])
            m = hi - lo
            count = np.maximum(lengths - GRAM + 1, 0)
            hashes = gram_hashes(codes, GRAM)
            # Positions whose gram lies within one text.
            doc = np.repeat(np.arange(m), count)
            pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[doc]
            x = (hashes[pos] >> U64(32)).astype(U32)
            has = np.flatnonzero(count)
            least = np.full((n, m), 0xFFFFFFFF, dtype=U32)
            if len(has):
                offsets = (np.cumsum(count) - count)[has]
                for j in range(n):
                    least[j, has] = np.minimum.reduceat(x * factors[j], offsets)
            z = mix64(least.T.astype(U64) + salts)
            total = z.reshape(m, tables, slots).sum(axis=2, dtype=U64)
            keys = np.empty((m, len(variants)), dtype=U64)
            for k, (t, left) in enumerate(variants):
                rest = total[:, t].copy()
                for s in left:
                    rest -= z[:, t * slots + s]
                keys[:, k] = mix64(rest + U64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
            bits = ((z[:, :, None] >> np.array([7, 21, 43], dtype=U64)) & U64(1)).astype(np.uint8).reshape(m, -1)
            sketch = np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.int64)
            digest = np.frombuffer(b"".join(blake2b(t.encode("utf-8", "replace"), digest_size=16).digest() for t in texts[lo:hi]), dtype=np.int64).reshape(m, 2)
            yield pd.DataFrame({
                "rec_id": ids[lo:hi], "text": texts[lo:hi], "n_grams": count,
                "d0": digest[:, 0], "d1": digest[:, 1],
                "variants": list(keys.view(np.int64)), "sketch": list(sketch),
            })


FINGERPRINT = "rec_id long, text string, n_grams long, d0 long, d1 long, variants array<long>, sketch array<long>"


def pairs_within(df: DataFrame, key: str, item: str, block: int = 1000) -> DataFrame:
    """All unordered pairs of ``item`` that share a ``key`` (columns a < b; a pair comes once per shared key).

    Keys held by one row are dropped before the join. A key with more than ``block`` rows is split: its rows fall
    into n blocks by hash, and each pair of blocks is joined by itself, so no task holds more than 2 * block of its rows.
    Hot keys are counted by a hash aggregation, whose sums leave each task as one row per key; only the other keys'
    rows come together to be counted. Nulls in either column give no pair.
    """
    rows = df.select(F.col(key).alias("k"), F.col(item).alias("x")).dropna()
    # Both are written once, as the join below reads them four times.
    hot = F.broadcast(materialize(hot_keys(rows), "hot"))  # at most 10,000 keys
    heavy = rows.join(hot, "k", "left_semi")
    sizes = F.broadcast(materialize(heavy.groupBy("k").agg(F.count("*").alias("n")), "hot-sizes"))  # as many rows as hot keys
    light = rows.join(hot, "k", "left_anti").withColumn("n", F.count("*").over(Window.partitionBy("k")))
    counted = (
        light.unionByName(heavy.join(sizes, "k"))
        .filter("n > 1")
        .withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    )
    left = counted.select("k", F.col("x").alias("l"), F.col("own").alias("p"), F.explode(F.sequence("own", F.col("parts") - 1)).alias("q"))
    right = counted.select("k", F.col("x").alias("r"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("p"), F.col("own").alias("q"))
    return (
        left.join(right, ["k", "p", "q"])
        .filter("(p < q AND l <> r) OR l < r")
        .select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))
    )


def _verify(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """left: the texts of a cell; right: its pairs."""
    texts, ids = left["text"].tolist(), left["id"].tolist()
    sets: dict[int, np.ndarray] = {}
    for lo, hi in slices(texts):
        codes, starts, lengths = lay(texts[lo:hi])
        h = gram_hashes(codes, GRAM)
        for i, s, n in zip(ids[lo:hi], starts, lengths, strict=True):
            x = np.sort(h[s : s + max(0, n - GRAM + 1)])
            sets[i] = x[np.append(True, x[1:] != x[:-1])] if len(x) else x
    a, b, out = right["a"].to_numpy(), right["b"].to_numpy(), np.zeros(len(right))
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = sets[i], sets[j]
        if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x):
            both = np.concatenate([x, y])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            out[k] = shared / (len(x) + len(y) - shared)
    keep = out >= threshold
    return pd.DataFrame({"a": a[keep], "b": b[keep], "jaccard": out[keep]})


def _sketch_limit(threshold: float, bits: int, sigmas: float = 5.0) -> int:
    """Sketch bits that may differ: beyond it a pair at the threshold falls with odds of about one in a million.

    Three bits are taken of each slot; those of one slot differ together, which widens the spread.
    """
    n = bits / 3
    differ = n * (1 - threshold)
    return int(1.5 * differ + sigmas * (2.25 * differ * threshold + 0.75 * differ) ** 0.5)


class NearDuplicates:
    """The stages over one table of records (rec_id, text); see the module.

    classes: (rec_id, rep) for every record, rep being the least rec_id with the same text.
    links: (a, b, jaccard) for each pair of representatives at or above the threshold; texts differ.

    Null texts take no part; texts shorter than 9 characters have no grams and link to nothing, nor do
    equal ones among them; rec_id should be unique; extra columns are ignored.
    """

    def __init__(self, records: DataFrame, threshold: float = 0.6, tables: int = 17, slots: int = 5, blanks: int = 1, cell_chars: int = 2_000_000):
        texts = spread(records.select("rec_id", "text").dropna())
        docs = materialize(texts.mapInPandas(lambda it: _fingerprints(it, tables, slots, blanks), FINGERPRINT), "p3-fingerprints")
        reps = docs.groupBy("d0", "d1").agg(F.min("rec_id").alias("rep"))
        self.classes = materialize(docs.select("rec_id", "n_grams", "d0", "d1").join(reps, ["d0", "d1"]).select("rec_id", "rep", "n_grams"), "p3-classes")
        copies = self.classes.filter("rec_id <> rep").select("rec_id")
        single = docs.filter("n_grams > 0").join(copies, "rec_id", "left_anti")
        variants = single.select("rec_id", F.explode("variants").alias("variant"))
        found = pairs_within(variants, "variant", "rec_id").distinct()
        sketch = docs.select("rec_id", "sketch")
        bits = tables * slots * 3
        apart = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(-(-bits // 64))), F.lit(0))
        near = (
            found.join(sketch.select(F.col("rec_id").alias("a"), F.col("sketch").alias("sa")), "a")
            .join(sketch.select(F.col("rec_id").alias("b"), F.col("sketch").alias("sb")), "b")
            .filter(apart <= _sketch_limit(threshold, bits))
            .select("a", "b")
        )
        self.links = materialize(self._verified(docs, materialize(near, "p3-candidates"), threshold, cell_chars), "p3-links")

    @staticmethod
    def _verified(docs: DataFrame, near: DataFrame, threshold: float, cell_chars: int) -> DataFrame:
        # A record's leader is its least partner; records of one leader mostly pair with each other, so they share cells.
        leader = (
            near.select(F.col("a").alias("id"), F.col("a").alias("l")).unionByName(near.select(F.col("b").alias("id"), F.col("a").alias("l")))
            .groupBy("id").agg(F.min("l").alias("leader"))
            .join(docs.select(F.col("rec_id").alias("id"), (F.col("n_grams") + 200).alias("n")), "id")
        )
        leader = materialize(leader, "p3-leaders")
        sizes = leader.groupBy("leader").agg(F.sum("n").alias("size"))
        total = sizes.agg(F.sum("size")).first()[0] or 0
        many = max(1, int(total // (cell_chars // 4)))
        group = F.when(F.col("size") <= cell_chars // 4, F.pmod(F.xxhash64("leader"), F.lit(many)).cast("long")).otherwise(
            F.xxhash64("leader", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / (cell_chars // 4))))
        )
        groups = leader.join(sizes, "leader").select("id", group.alias("g"))
        cells = materialize(
            near.join(groups.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a")
            .join(groups.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
            .select(F.xxhash64("ga", "gb").alias("cell"), "a", "b"),
            "p3-cells",
        )
        needed = cells.select("cell", F.col("a").alias("id")).unionByName(cells.select("cell", F.col("b").alias("id"))).distinct()
        texts = needed.join(docs.select(F.col("rec_id").alias("id"), "text"), "id").select(F.col("cell").alias("at"), "id", "text")
        return texts.groupBy("at").cogroup(cells.groupBy("cell")).applyInPandas(lambda x, y: _verify(x, y, threshold), "a long, b long, jaccard double")

    def pairs(self) -> DataFrame:
        """(rec_a, rec_b) for all pairs of records, copies expanded: as many rows as there are such pairs."""
        members = self.classes.select("rec_id", "rep")
        across = (
            self.links.select("a", "b")
            .join(members.select(F.col("rep").alias("a"), F.col("rec_id").alias("x")), "a")
            .join(members.select(F.col("rep").alias("b"), F.col("rec_id").alias("y")), "b")
            .select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))
        )
        within = pairs_within(self.classes.filter("n_grams > 0"), "rep", "rec_id").toDF("rec_a", "rec_b")
        return across.unionByName(within)

    def degrees(self) -> DataFrame:
        """One row per record: rec_id, class_id (its representative) and n_links, links to different texts."""
        ends = self.links.select(F.col("a").alias("rep")).unionByName(self.links.select(F.col("b").alias("rep")))
        n = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
        return self.classes.join(n, "rep", "left").select("rec_id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def groups(self) -> DataFrame:
        """One row per record: rec_id, group_id (least rec_id reachable over links) and group_size."""
        label = components(self.links.select("a", "b"))
        whole = self.classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("rec_id", F.coalesce("label", "rep").alias("group_id"))
        size = whole.groupBy("group_id").agg(F.count("*").alias("group_size"))
        return whole.join(size, "group_id").select("rec_id", "group_id", "group_size")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of (a, b): (id, label), label being the least id of the component.

    Large-star and small-star steps in turn; each round's edges are a table in the shared folder, and the driver sees
    only their number and checksum. Raises if the edges are not stable within ``rounds`` rounds, so no split group is returned.
    """
    edges = materialize(edges.filter("a <> b").distinct(), "cc-0")
    before = None
    for k in range(1, rounds + 1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: each node's lesser neighbours and itself point to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges, old = materialize(small, f"cc-{k}"), edges
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    top = edges.groupBy("a").agg(F.min("b").alias("b"))
    return top.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(top.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
