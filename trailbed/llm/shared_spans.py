"""Long exact spans shared between documents (problem 7).

Method: content-defined chunking with a gear rolling hash, chunks deduplicated by digest.

A cut is set wherever the gear hash of the last 32 characters is the least within some window
of ``(span - 32) // 2`` positions. Such cuts depend on nearby text only, so they move with it
through insertions, and any ``span`` characters hold two cuts fixed by those characters alone:
the first, ``c1``, is the window's anchor. Every stretch of ``span`` characters (a window)
therefore belongs to the chunk that begins at its anchor, in every document alike:

1. Each document is cut; a row per chunk carries its digest, the windows anchored at it and the
   digest of all the text those windows cover (its context).
2. Rows are grouped by digest. A chunk of one document only is dropped. Where every occurrence
   has the same context, all its windows are shared; nothing is compared.
3. Where contexts differ (the ends of copied stretches), each occurrence lists its windows, kept
   only if all chunks inside are shared, and the windows are grouped by digest in turn.
4. Shared windows become maximal runs.

The result is exact but for 64-bit digests, which take in the length. All steps
are hash aggregations and equi-joins: work is linear in the text however many copies a chunk
has. A hot digest is summed up before the shuffle, and its rows are joined where they are, with a
broadcast of at most 10,000 digests. No pairs of documents are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailbed.llm.codes import U32, U64, Spans, lay, slices
from trailbed.llm.hot import hot_keys, join_hot
from trailbed.session import materialize, spread

GEAR = 32
TOP = np.uint32(0xFFFFFFFF)


def gear_hash(codes: np.ndarray) -> np.ndarray:
    """At each position the gear hash (h = 2h + value of the character) of the last 32 characters."""
    h = codes * U32(0x9E3779B1)
    h ^= h >> U32(15)
    h *= U32(0x85EBCA77)
    h ^= h >> U32(13)
    width = 1
    while width < GEAR:
        moved = h.copy()
        moved[width:] += h[:-width] << U32(width)
        h = moved
        width *= 2
    return h


def _sliding(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """out[j] = min or max of a[j : j + width]; beyond the end the last values repeat."""
    pick = np.minimum if least else np.maximum
    out, done = a.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[:-step] = pick(out[:-step], out[step:])
        done += step
    return out


class Cuts:
    """Cuts and anchors of several documents laid end to end."""

    def __init__(self, texts: list[str], span: int):
        self.span, self.window = span, (span - GEAR) // 2
        pad = self.window + GEAR
        self.codes, self.starts, self.lengths = lay(texts, pad)
        n = len(self.codes)
        h = gear_hash(self.codes)
        off = np.ones(n, dtype=bool)
        for s, m in zip(self.starts, self.lengths, strict=True):
            off[s + GEAR - 1 : s + m] = False
        h[off] = TOP
        at = np.arange(n, dtype=U64)
        packed = _sliding(h.astype(U64) << U64(32) | at, self.window, True)
        self.first = (packed & U64(TOP)).astype(np.int64)  # leftmost least position of the window beginning here
        least = (packed >> U64(32)).astype(U32)
        behind = np.full(n, 0, dtype=U32)
        behind[self.window - 1 :] = _sliding(least, self.window, False)[: n - self.window + 1] if n >= self.window else 0
        head = min(n, self.window - 1)
        behind[:head] = np.maximum.accumulate(least[:head])
        self.cut = np.flatnonzero((behind == h) & ~off)
        self.h = h
        self.doc_of_cut = np.searchsorted(self.starts, self.cut, side="right") - 1

    def window_starts(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, documents) of all starts of ``span`` characters within a document."""
        count = np.maximum(self.lengths - self.span + 1, 0)
        doc = np.repeat(np.arange(len(count)), count)
        return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.starts[doc], doc

    def last(self) -> np.ndarray:
        """Rightmost least position of the window beginning at each position."""
        n = len(self.h)
        back = U64(TOP) - np.arange(n, dtype=U64)
        packed = _sliding(self.h.astype(U64) << U64(32) | back, self.window, True)
        return (U64(TOP) - (packed & U64(TOP))).astype(np.int64)


def _chunks(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy()
        for lo, hi in slices(texts, 1 << 19):
            c = Cuts(texts[lo:hi], span)
            if not len(c.cut):
                continue
            spans = Spans(c.codes)
            pos, doc = c.window_starts()
            anchor = c.first[pos + GEAR - 1]
            new = np.flatnonzero(np.diff(anchor, prepend=-1))
            lo_p, hi_p = pos[new], pos[np.append(new[1:], len(pos)) - 1] if len(pos) else pos[new]
            where = np.searchsorted(c.cut, anchor[new])
            n = len(c.cut)
            first_p, windows, context = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, U64)
            first_p[where], windows[where] = lo_p, hi_p - lo_p + 1
            context[where] = spans.hash(lo_p, hi_p + span)
            begin = c.cut + 1
            has_next = np.append(c.doc_of_cut[1:] == c.doc_of_cut[:-1], False)
            end = np.append(begin[1:], 0)
            k = np.flatnonzero(has_next)
            base = c.starts[c.doc_of_cut[k]]
            yield pd.DataFrame({
                "digest": spans.hash(begin[k], end[k]).view(np.int64),
                "context": context[k].view(np.int64),
                "doc_id": ids[lo:hi][c.doc_of_cut[k]],
                "cut": (c.cut[k] - base).astype(np.int32),
                "first_start": np.where(windows[k] > 0, first_p[k] - base, -1).astype(np.int32),
                "n_windows": windows[k].astype(np.int32),
            })


CHUNKS = "digest long, context long, doc_id long, cut int, first_start int, n_windows int"


def chunks(documents: DataFrame, span: int = 320) -> DataFrame:
    """The chunks of every document of at least ``span`` characters (doc_id, text)."""
    long_enough = documents.select("doc_id", "text").filter((F.length("text") >= span) & F.col("doc_id").isNotNull())
    return spread(long_enough).mapInPandas(lambda it: _chunks(it, span), CHUNKS)


def _edge_windows(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy()
        shared, open_ = pdf["shared"].tolist(), pdf["open"].tolist()
        for lo, hi in slices(texts, 1 << 19):
            c = Cuts(texts[lo:hi], span)
            n = len(c.codes)
            alone = np.zeros(n + 1, dtype=np.int64)  # cuts whose chunk stands in one document only
            alone[c.cut + 1] = 1
            edge = np.zeros(n, dtype=bool)
            for i in range(lo, hi):
                s = c.starts[i - lo]
                alone[s + np.asarray(shared[i], dtype=np.int64) + 1] = 0
                edge[s + np.asarray(open_[i], dtype=np.int64)] = True
            alone = np.cumsum(alone)
            pos, doc = c.window_starts()
            c1 = c.first[pos + GEAR - 1]
            keep = edge[c1]
            pos, doc, c1 = pos[keep], doc[keep], c1[keep]
            c2 = c.last()[pos + span - c.window]
            keep = alone[c2] == alone[c1]
            pos, doc = pos[keep], doc[keep]
            if len(pos):
                yield pd.DataFrame({
                    "digest": Spans(c.codes).hash(pos, pos + span).view(np.int64),
                    "doc_id": ids[lo:hi][doc],
                    "start": (pos - c.starts[doc]).astype(np.int32),
                })


def shared_spans(documents: DataFrame, span: int = 320) -> DataFrame:
    """Maximal runs of shared characters: (doc_id, span_start, span_end), ends exclusive.

    A character is shared if it lies in a stretch of at least ``span`` characters that also
    stands in a row of another ``doc_id``. Null texts and texts shorter than ``span`` give no
    row, nor do rows without doc_id; equal texts under two ids give one run over the whole text; a stretch repeated only
    within one document is not shared; several rows of one ``doc_id`` count as one document each
    with its own offsets, so ids should be unique. Other columns are ignored.
    """
    if span < 2 * GEAR:
        raise ValueError(f"span must be at least {2 * GEAR}")
    cut = materialize(chunks(documents, span), "p7-chunks")
    # The documents first: a digest seen in one of them only, as most are, carries nothing else through the shuffle.
    common = cut.groupBy("digest").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).filter("d0 <> d1").select("digest")
    hot = materialize(hot_keys(cut.select(F.col("digest").alias("k"), F.xxhash64("doc_id", "cut").alias("x"))), "p7-hot")
    found = materialize(join_hot(cut, common, "digest", hot), "p7-shared")
    groups = found.groupBy("digest").agg(F.min("context").alias("c0"), F.max("context").alias("c1"), F.min("n_windows").alias("w"))
    groups = groups.select("digest", ((F.col("c0") == F.col("c1")) & (F.col("w") > 0)).alias("same"))
    seen = join_hot(found.drop("context"), groups, "digest", hot)
    inner = seen.filter("same").select("doc_id", F.col("first_start").alias("a"), (F.col("first_start") + F.col("n_windows") - 1 + span).alias("b"))
    edges = (
        seen.groupBy("doc_id")
        .agg(F.collect_list("cut").alias("shared"), F.collect_list(F.when(~F.col("same") & (F.col("n_windows") > 0), F.col("cut"))).alias("open"))
        .filter(F.size("open") > 0)
    )
    windows = materialize(
        documents.select("doc_id", "text").filter(F.length("text") >= span).join(edges, "doc_id")
        .mapInPandas(lambda it: _edge_windows(it, span), "digest long, doc_id long, start int"),
        "p7-edges",
    )
    twice = windows.groupBy("digest").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).filter("d0 <> d1").select("digest")
    hot = materialize(hot_keys(windows.select(F.col("digest").alias("k"), F.xxhash64("doc_id", "start").alias("x"))), "p7-hot")
    outer = join_hot(windows, twice, "digest", hot).select("doc_id", F.col("start").alias("a"), (F.col("start") + span).alias("b"))
    return merge_runs(inner.unionByName(outer))


def merge_runs(spans: DataFrame) -> DataFrame:
    """Overlapping or touching [a, b) of a doc_id joined into maximal runs."""
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("fresh", (F.coalesce(F.col("a") > reach, F.lit(True))).cast("int"))
        .withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "run")
        .agg(F.min("a").cast("long").alias("span_start"), F.max("b").cast("long").alias("span_end"))
        .select("doc_id", "span_start", "span_end")
    )


def shared_shares(documents: DataFrame, span: int = 320) -> DataFrame:
    """For every document, also those that share nothing: its length, its shared characters and their share.

    The share of a null or empty text is 0.
    """
    runs = shared_spans(documents, span).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"), F.count("*").alias("n_spans"))
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return documents.select("doc_id", n.alias("n_chars")).join(runs, "doc_id", "left").select(
        "doc_id", "n_chars",
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("shared", F.lit(0)).alias("shared_chars"),
        F.round(F.coalesce(F.col("shared") / F.col("n_chars"), F.lit(0.0)), 6).alias("shared_share"),
    )
