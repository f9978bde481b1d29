"""Personal information inside free text (problem 2).

Method: candidate gradient boosting. Generators of high recall propose overlapping spans (pii_candidates); boosted trees
judge each by features of its format and context; thresholds calibrated on rows kept from training select the
redactions, the likeliest span winning where several overlap.

The trees of each kind are fitted in a task of their own on a bounded number of labelled rows (pii_training); everything else covers all rows. The
fitted model is a few thousand numbers and two word lists of bounded size, sent to each executor once; rows are mapped over once, without a shuffle.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailbed.llm.boosting import Trees, best_cut, fit, platt
from trailbed.llm.packing import TOKENIZERS, VOCABULARY
from trailbed.llm.pii_candidates import KINDS, N_FEATURES, Lexicon, Span, candidates, features
from trailbed.llm.pii_training import GIVEN, Maker
from trailbed.session import spread


class Judge(NamedTuple):
    """The trees of one kind, Platt scaling and the threshold."""

    trees: Trees
    slope: float
    shift: float
    threshold: float

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.shift, -30, 30)))


class Model(NamedTuple):
    judges: tuple[Judge, ...]  # by kind
    lexicon: Lexicon


def given_names(names: DataFrame, most: int = 100_000) -> frozenset[str]:
    """The helping list of given names, lower-cased; a list beyond ``most`` is refused rather than sent to every task."""
    found = [r[0] for r in names.select(F.lower("given_name")).dropna().distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} given names")
    return frozenset(found)


def word_ranks(folder: str = TOKENIZERS, least: int = 3) -> dict[str, tuple[float, float]]:
    """log2 of the ranks of words in a public tokenizer's vocabulary, (lower case, capitalised), 17 where it is no entry.

    Early ranks are common words. The vocabulary is a file of fixed size (50,256 entries); its path is a parameter.
    """
    ranks: dict[str, list[float]] = {}
    with open(f"{folder}/{VOCABULARY}", "rb") as f:
        for line in f:
            token, rank = line.split()
            word = base64.b64decode(token)
            if len(word) > least and word[:1] == b" " and word[1:].isalpha() and (low := word[1:].lower()) and word[2:] == low[1:]:
                ranks.setdefault(low.decode(), [17.0, 17.0])[word[1:] != low] = round(math.log2(int(rank) + 1), 2)
    return {w: (a, b) for w, (a, b) in ranks.items()}


def common_words(ranks: dict[str, tuple[float, float]], most: int = 12_000) -> list[str]:
    """Words more common in lower case than capitalised, the likeliest ``most``, in alphabetical order."""
    return sorted(sorted((w for w, (a, b) in ranks.items() if a < b), key=lambda w: (ranks[w], w))[:most])


def wordy_names(given: list[str], words: list[str]) -> list[str]:
    known = set(words)
    return sorted({g for g in [*GIVEN, *given] if g.lower() in known}) or ["Mark"]


def _labelled(i: int, seed: int, given: list[str], ranks: dict[str, tuple[float, float]], words: list[str], wordy: list[str]) -> Iterator[tuple[float, list[float], int, int]]:
    """(label, features, kind, fold) of the candidates of made row ``i``; a row's candidates share a fold."""
    text, marks = Maker(seed * 1_000_003 + i, given, words, wordy).row()
    true = set(marks)
    # A third of the names is held back, so that the trees do not lean on the list alone.
    known = Lexicon(frozenset(g.lower() for k, g in enumerate([*GIVEN, *given]) if (k + i) % 3), ranks)
    for s in candidates(text):
        yield float((s.kind, s.begin, s.end) in true), features(text, s, known), s.kind, int(i % 5 == 0)


_fitted: dict[tuple, Model] = {}


def train(spark: SparkSession, given: frozenset[str], n_rows: int = 12_000, trees: int = 90, depth: int = 6, seed: int = 7, folder: str = TOKENIZERS) -> Model:
    """Fit on ``n_rows`` labelled rows, a fifth of them kept for calibration; both counts are bounds, whatever the data.

    The fit depends on nothing but the arguments and the vocabulary in ``folder``, so a process keeps each model it has fitted.
    """
    if (known := (given, n_rows, trees, depth, seed, folder)) in _fitted:
        return _fitted[known]
    parts = min(8, spark.sparkContext.defaultParallelism)
    ranks = word_ranks(folder)
    names, words = sorted(n.title() for n in given), common_words(ranks)
    wordy = wordy_names(names, words)

    def made(ids: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in ids:
            rows = [r for i in pdf["id"].tolist() for r in _labelled(i, seed, names, ranks, words, wordy)]
            yield pd.DataFrame(rows, columns=["label", "x", "kind", "fold"])

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, kept = np.array(pdf["x"].tolist()), pdf["label"].to_numpy(), pdf["fold"].to_numpy() == 1
        t = fit(x[~kept], y[~kept], trees, depth, seed=seed)
        m = t.margin(x[kept])
        slope, shift = platt(m, y[kept])
        cut = best_cut(1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30))), y[kept])
        return pd.DataFrame({"kind": pdf["kind"].iloc[:1], "feature": [t.feature.ravel().tolist()], "cut": [t.cut.ravel().tolist()], "leaf": [t.leaf.ravel().tolist()], "base": [t.shift], "slope": [slope], "shift": [shift], "threshold": [cut]})

    rows = spark.range(0, n_rows, 1, 2 * parts).mapInPandas(made, "label double, x array<double>, kind int, fold int")
    shape = "kind int, feature array<long>, cut array<double>, leaf array<double>, base double, slope double, shift double, threshold double"
    of = {r.kind: r for r in rows.groupBy("kind").applyInPandas(fitted, shape).collect()}  # one row per kind, thousands of numbers
    size = (trees, 2 ** (depth + 1) - 1)
    judges = tuple(
        Judge(Trees(*(np.array(of[k][c]).reshape(size) for c in ("feature", "cut", "leaf")), of[k].base), of[k].slope, of[k].shift, of[k].threshold) for k in range(len(KINDS))
    )
    _fitted[known] = model = Model(judges, Lexicon(given | frozenset(g.lower() for g in GIVEN), ranks))
    return model


def select(spans: list[Span], chance: np.ndarray, threshold: list[float]) -> list[tuple[Span, float]]:
    """Spans above their kind's threshold, best first, longer first among equals, without overlaps; in order of place."""
    good = [i for i, s in enumerate(spans) if chance[i] >= threshold[s.kind]]
    good.sort(key=lambda i: (-round(float(chance[i]), 3), spans[i].begin - spans[i].end, spans[i].begin))
    begins: list[int] = []
    chosen: list[tuple[Span, float]] = []  # in order of place, as ``begins``
    for i in good:
        s = spans[i]
        k = bisect_left(begins, s.begin)
        if (k == 0 or chosen[k - 1][0].end <= s.begin) and (k == len(begins) or s.end <= begins[k]):
            begins.insert(k, s.begin)
            chosen.insert(k, (s, float(chance[i])))
    return chosen


def judge(texts: list[str | None], model: Model, at_once: int = 20_000) -> list[list[tuple[Span, float]]]:
    """The chosen spans of each text; features are made and judged for ``at_once`` candidates at a time, so a long text takes no more memory."""
    spans = [candidates(t) if t else [] for t in texts]
    flat = [(t, s) for t, own in zip(texts, spans, strict=True) for s in own]
    p = np.zeros(len(flat))
    for lo in range(0, len(flat), at_once):
        part = flat[lo : lo + at_once]
        x = np.array([features(t, s, model.lexicon) for t, s in part], dtype=np.float64).reshape(-1, N_FEATURES)
        kinds = np.array([s.kind for _, s in part])
        for k, own in enumerate(model.judges):
            on = np.flatnonzero(kinds == k)
            p[lo + on] = own.chance(x[on])
    threshold = [j.threshold for j in model.judges]
    out, at = [], 0
    for own in spans:
        out.append(select(own, p[at : at + len(own)], threshold) if own else [])
        at += len(own)
    return out


FOUND = "tab string, row_id long, kind string, begin int, end int, chance double, val string"
REDACTED = "tab string, row_id long, text string, n_items int"


def _rows(batches: Iterator[pd.DataFrame], sent: Broadcast, redact: bool) -> Iterator[pd.DataFrame]:
    model = sent.value
    names = ["tab", "row_id", "text", "n_items"] if redact else ["tab", "row_id", "kind", "begin", "end", "chance", "val"]
    for whole in batches:
        for lo in range(0, len(whole), 2000):
            pdf = whole.iloc[lo : lo + 2000]
            texts, out = pdf["text"].tolist(), []
            for tab, i, text, found in zip(pdf["tab"].tolist(), pdf["row_id"].tolist(), texts, judge(texts, model), strict=True):
                if redact:
                    parts, at = [], 0
                    for s, _ in found:
                        parts += [text[at : s.begin], f"[{KINDS[s.kind].upper()}]"]
                        at = s.end
                    out.append((tab, i, text if text is None else "".join([*parts, text[at:]]), len(found)))
                else:
                    out += [(tab, i, KINDS[s.kind], s.begin, s.end, p, text[s.begin : s.end]) for s, p in found]
            yield pd.DataFrame(out, columns=names)


def texts_of(blocks: DataFrame, sessions: DataFrame) -> DataFrame:
    """(tab, row_id, text) of the two fields that hold free text."""
    return blocks.select(F.lit("blocks").alias("tab"), F.col("block_id").cast("long").alias("row_id"), F.col("content").alias("text")).unionByName(
        sessions.select(F.lit("sessions").alias("tab"), F.col("rec_id").cast("long").alias("row_id"), F.col("system").alias("text"))
    )


def find_personal(texts: DataFrame, model: Model) -> DataFrame:
    """One row per item found in (tab, row_id, text); see FOUND. Null, empty and blank texts give none; repeated rows each give theirs."""
    sent = texts.sparkSession.sparkContext.broadcast(model)  # trees, and word lists of bounded size
    return spread(texts.select("tab", "row_id", "text").filter("text IS NOT NULL AND text <> ''")).mapInPandas(lambda it: _rows(it, sent, False), FOUND)


def redact_personal(texts: DataFrame, model: Model) -> DataFrame:
    """Every row with its items replaced by [KIND] and all else as it was; null stays null. Columns: see REDACTED."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    return spread(texts.select("tab", "row_id", "text")).mapInPandas(lambda it: _rows(it, sent, True), REDACTED)
