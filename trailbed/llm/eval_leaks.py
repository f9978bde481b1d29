"""Evaluation passages that leak into documents (problem 6).

Method: q-gram lemma filtering. A stretch of ``window`` characters of a passage that stands in a
document with at most ``edits`` edits shares at least ``window - q + 1 - q * edits`` q-grams with it,
all on diagonals (document position minus passage position) at most ``edits`` apart. So:

1. Both texts are folded (NFKC, lower case, letters and digits only).
2. The passages' q-grams are looked up at every position of the document.
3. Hits are counted in diagonal bands of ``2 * (edits + 1)`` that overlap by half, so any ``edits + 1``
   neighbouring diagonals lie in one, within ``window + edits`` successive positions; bands that meet
   the bound are kept.
4. A kept band is verified by an alignment confined to it, in its furthest-reaching form: for every start
   in the passage at once, how far each diagonal gets with 0, 1, … ``edits`` edits.

One way serves all budgets; without edits the alignment is the run of equal characters on a diagonal.
Documents are only mapped over: nothing is shuffled. The held-out items are fixed and small; they are
broadcast in blocks of at most ``block_chars`` characters, so one block's index is bounded however many
items there are, and further blocks are further passes. A worker builds a block's index once.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailbed.llm.codes import U32, code_points, gram_hashes, slices
from trailbed.session import spread

_KEEP = bytes(i for i in range(128) if chr(i).isalnum())
_DROP = bytes(i for i in range(128) if not chr(i).isalnum())
_LOWER = bytes(ord(chr(i).lower()) if i < 128 else i for i in range(256))
_alnum: list[np.ndarray] = []


def fold(text: str) -> np.ndarray:
    """Code points of the text in NFKC and lower case without anything but letters and digits."""
    if text.isascii():
        return np.frombuffer(text.encode().translate(_LOWER, _DROP), dtype=np.uint8).astype(U32)
    if not _alnum:
        _alnum.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000))
    codes = code_points(unicodedata.normalize("NFKC", text).lower())
    return codes[_alnum[0][codes]]


class Index:
    """q-grams of folded passages with their places."""

    def __init__(self, items: list[tuple[int, str]], window: int, edits: int):
        # The largest q that still leaves the lemma a bound of about half the window's q-grams.
        self.q = max(3, (window + 1) // (2 * (edits + 1)))
        self.window, self.edits = window, edits
        self.least = window - self.q + 1 - self.q * edits
        if self.least < 1:
            raise ValueError("too many edits for this window")
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.passages = [fold(t) for _, t in items]
        grams, where, place = [], [], []
        for n, p in enumerate(self.passages):
            if len(p) >= window:
                g = gram_hashes(p, self.q)
                grams.append(g), where.append(np.full(len(g), n)), place.append(np.arange(len(g)))
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.where = (np.concatenate(where) if where else np.zeros(0, int))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, int))[order]
        self.grams, self.begin, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.grams >> np.uint64(42)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, place in the item) of every q-gram that a passage has too."""
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.bits[h >> np.uint64(42)])
        if not len(at) or not len(self.grams):
            return (np.zeros(0, np.int64),) * 3
        k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        same = self.grams[k] == h[at]
        at, k = at[same], k[same]
        n = self.count[k]
        pick = np.repeat(self.begin[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.where[pick], self.place[pick]


def bands(index: Index, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(item, first diagonal) of the bands in which some stretch meets the lemma's bound, one row each."""
    e = index.edits
    wide, need, found = 2 * (e + 1), index.least, []
    for shift in (0, e + 1):
        low = (at - place + shift) // wide * wide - shift
        order = np.lexsort((at, low, item))
        i, b, p = item[order], low[order], at[order]
        # Several hits of one position in a band count once.
        new = np.ones(len(p), dtype=bool)
        new[1:] = (i[1:] != i[:-1]) | (b[1:] != b[:-1]) | (p[1:] != p[:-1])
        i, b, p = i[new], b[new], p[new]
        if len(p) < need:
            continue
        first, last = slice(0, len(p) - need + 1), slice(need - 1, None)
        good = (i[last] == i[first]) & (b[last] == b[first]) & (p[last] - p[first] <= index.window + e - index.q)
        found.append(np.stack([i[first][good], b[first][good]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def reaches(doc: np.ndarray, passage: np.ndarray, low: int, edits: int) -> Iterator[np.ndarray]:
    """For 0, 1, … ``edits`` edits: how many characters of the passage from each of its places on are aligned with the document.

    The alignment begins anywhere in the document and keeps to the diagonals low .. low + 2 * edits + 1.
    """
    n, diagonals = len(passage), low + np.arange(2 * (edits + 1))
    starts = np.arange(n + 1)
    spot = diagonals[:, None] + starts[:n]
    inside = (spot >= 0) & (spot < len(doc))
    equal = np.zeros(spot.shape, dtype=bool)
    equal[inside] = (doc[np.clip(spot, 0, max(0, len(doc) - 1))] == passage)[inside] if len(doc) else False
    # Where each diagonal's run of equal characters through a place ends.
    stop = np.where(equal, n, starts[:n])
    stop = np.concatenate([np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1], np.full((len(diagonals), 1), n)], axis=1)
    valid = (diagonals[:, None] + starts >= 0) & (diagonals[:, None] + starts <= len(doc))
    row = np.arange(len(diagonals))[:, None]
    reach = np.where(valid, stop[row, starts], -1)
    yield reach.max(axis=0) - starts
    for _ in range(edits):
        may = (reach >= 0) & (reach < n)
        changed = np.where(may & inside[row, np.clip(reach, 0, n - 1)], reach + 1, -1)
        left_out = np.full_like(reach, -1)
        left_out[:-1] = np.where(may, reach + 1, -1)[1:]
        put_in = np.full_like(reach, -1)
        put_in[1:] = np.where((reach >= 0) & (diagonals[:, None] + reach < len(doc)), reach, -1)[:-1]
        best = np.maximum(np.maximum(reach, changed), np.maximum(left_out, put_in))
        reach = np.where(best >= 0, stop[row, np.maximum(best, 0)], -1)
        yield reach.max(axis=0) - starts


def aligned(doc: np.ndarray, passage: np.ndarray, low: int, window: int, edits: int) -> tuple[int, int] | None:
    """(fewest edits, longest stretch with them) that align ``window`` characters or more of the passage within a band; None if ``edits`` are too few."""
    for k, far in enumerate(reaches(doc, passage, low, edits)):
        if far.max() >= window:
            return k, int(far.max())
    return None


_indexes: dict[tuple, Index] = {}


def _index(key: tuple, items: list[tuple[int, str]], window: int, edits: int) -> Index:
    if key not in _indexes:
        if len(_indexes) > 1:
            _indexes.clear()
        _indexes[key] = Index(items, window, edits)
    return _indexes[key]


def _leaks(batches: Iterator[pd.DataFrame], block: Broadcast, window: int, edits: int) -> Iterator[pd.DataFrame]:
    name, items = block.value
    index = _index((name, window, edits), items, window, edits)
    for pdf in batches:
        texts, ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
        out = []
        for lo, hi in slices(texts):
            folded = [fold(t) for t in texts[lo:hi]]
            lengths = np.array([len(f) for f in folded], dtype=np.int64)
            gap = np.zeros(index.q, dtype=U32)
            codes = np.concatenate([x for f in folded for x in (f, gap)])
            starts = np.cumsum(lengths + index.q) - lengths - index.q
            at, item, place = index.hits(codes)
            if not len(at):
                continue
            doc = np.searchsorted(starts, at, side="right") - 1
            # Documents with too few hits in all can't hold a region.
            enough = np.bincount(doc, minlength=len(starts)) >= index.least
            keep = enough[doc]
            at, item, place, doc = at[keep], item[keep], place[keep], doc[keep]
            edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-2)) if len(doc) else []
            for s, t in zip(edges[:-1], edges[1:], strict=True):
                d = int(doc[s])
                best: dict[int, tuple[int, int]] = {}
                for i, low in bands(index, at[s:t] - starts[d], item[s:t], place[s:t]).tolist():
                    if (x := aligned(folded[d], index.passages[i], low, window, edits)) is not None:
                        best[i] = min(best.get(i, (x[0], 0)), (x[0], -x[1]))
                out += [(ids[lo + d], int(index.ids[i]), x, -n) for i, (x, n) in best.items()]
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "edits", "evidence"])


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The held-out items in blocks of at most ``block_chars`` characters (one longer passage stands alone)."""
    block, total = [], 0
    for row in items.select("item_id", "passage").filter("item_id IS NOT NULL AND passage IS NOT NULL").orderBy("item_id").toLocalIterator():
        if block and total + len(row.passage) > block_chars:
            yield block
            block, total = [], 0
        block.append((row.item_id, row.passage))
        total += len(row.passage)
    if block:
        yield block


def leak_report(documents: DataFrame, items: DataFrame, window: int = 50, edits: int = 0, block_chars: int = 4_000_000) -> DataFrame:
    """Documents that hold ``window`` successive characters of a passage, with at most ``edits`` edits.

    Columns doc_id, item_id, edits (the fewest that do) and evidence (the longest stretch of the passage aligned with
    them, in folded characters). Null, blank or shorter texts and passages give nothing; equal
    rows count once per doc_id and item_id; other columns are ignored; empty tables give an empty result.
    """
    # NFKC turns one character into at most 18.
    texts = spread(documents.select("doc_id", "text").filter((F.length("text") * 18 >= window) & F.col("doc_id").isNotNull()))
    found = None
    for block in item_blocks(items, block_chars):
        sent = documents.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))
        part = texts.mapInPandas(lambda it, sent=sent: _leaks(it, sent, window, edits), "doc_id long, item_id long, edits int, evidence int")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int, evidence int")
    return found
