"""Filling containers of fixed token capacity with documents (problem 5).

Method: cost-balanced packing. A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention does.
Pieces are assigned in descending length, each to the sequence of lowest cost that still has room for it.

Documents are split only if they exceed the capacity, into full pieces and a rest. Pieces fall by hash into shards of
a bounded number of containers, so no task sees more than a shard; a shard opens only as many sequences as its tokens
fill to the brim, and what finds no room moves on, to be packed again with the leftovers of other shards in shards of
the same bound. The last round opens sequences for all that is left.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailbed.session import materialize, spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def _encoder(folder: str):
    if folder not in _encoders:
        import tiktoken

        with open(f"{folder}/{VOCABULARY}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[folder] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[folder]


def _count(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    encode = _encoder(folder).encode_ordinary
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(encode(t)) for t in pdf["text"]]})


def token_counts(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of the whole texts by the public tokenizer in ``folder``; null and empty texts have no tokens and give no row."""
    texts = spread(documents.select("doc_id", "text").filter("text IS NOT NULL AND text <> '' AND doc_id IS NOT NULL"))
    return texts.mapInPandas(lambda it: _count(it, folder), "doc_id long, n_tokens int")


def assign(lengths: np.ndarray, capacity: int, sequences: int, linear: float, quadratic: float, grow: bool) -> np.ndarray:
    """Sequence of each piece, -1 where none has room and none may be opened. Lengths come in descending order."""
    room = np.full(sequences, capacity, dtype=np.int64)
    cost = np.zeros(sequences)
    out = np.full(len(lengths), -1, dtype=np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = np.flatnonzero(room >= n)
        if len(fits):
            k = int(fits[cost[fits].argmin()])
        elif grow:
            k = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        else:
            continue
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n
        out[i] = k
    return out


def _pack_shard(pdf: pd.DataFrame, linear: float, quadratic: float, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    capacity = int(pdf["capacity"].iloc[0])
    lengths = pdf["n_tokens"].to_numpy()
    total = int(lengths.sum())
    sequences = max(1, -(-total // capacity)) if last else total // capacity
    return pdf.assign(seq=assign(lengths, capacity, sequences, linear, quadratic, last))


def _packer(linear: float, quadratic: float, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack_one(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_shard(pdf, linear, quadratic, last)

    return pack_one


PIECE = "spec_id int, capacity int, doc_id long, piece int, first_token int, n_tokens int"


def pack(counts: DataFrame, specs: DataFrame, linear: float = 1.0, quadratic: float = 1e-3, shard: int = 256, rounds: int = 3) -> DataFrame:
    """For each spec (spec_id, capacity) by itself the container of every piece.

    counts: (doc_id, n_tokens). Result: spec_id, doc_id, piece, first_token, n_tokens, container (a string unique within
    its spec). A document of at most ``capacity`` tokens is one piece; documents without tokens and specs without a
    positive capacity give nothing; doc_id should be unique; other columns are ignored. ``shard`` is the number of
    containers a task fills at once.
    """
    specs = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity").cast("int").alias("capacity")).filter("capacity > 0").distinct()
    # A spec is a handful of numbers given by the user; each document is repeated once per spec.
    given = [(r.spec_id, r.capacity) for r in specs.orderBy("spec_id", "capacity").toLocalIterator()]
    if not given:
        return counts.sparkSession.createDataFrame([], "spec_id int, doc_id long, piece int, first_token int, n_tokens int, container string")
    each = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("int").alias("capacity")) for s, c in given])).alias("s")
    counts = materialize(counts.select("doc_id", "n_tokens").filter("n_tokens > 0"), "p5-counts")
    pieces = (
        counts.select("doc_id", "n_tokens", each).select("s.*", "doc_id", "n_tokens")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int"))))
        .withColumn("first_token", F.col("piece") * F.col("capacity"))
        .withColumn("n_tokens", F.least("capacity", F.col("n_tokens") - F.col("first_token")))
        .select("spec_id", "capacity", "doc_id", "piece", "first_token", "n_tokens")
    )
    done = None
    for k in range(rounds):
        last = k == rounds - 1
        shards = {r.spec_id: max(1, round(r.total / r.capacity / shard)) for r in pieces.groupBy("spec_id", "capacity").agg(F.sum("n_tokens").alias("total")).collect()}
        if not shards:
            break
        many = F.create_map(*[x for s, n in shards.items() for x in (F.lit(s), F.lit(n))])
        packed = materialize(
            pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(k)), many[F.col("spec_id")]).cast("int"))
            .groupBy("spec_id", "shard")
            .applyInPandas(_packer(linear, quadratic, last), PIECE + ", shard int, seq long"),
            f"p5-round{k}",
        )
        part = packed.filter("seq >= 0").select("spec_id", "doc_id", "piece", "first_token", "n_tokens", F.concat_ws("-", F.lit(k), "shard", "seq").alias("container"))
        done = part if done is None else done.unionByName(part)
        pieces = packed.filter("seq < 0").drop("shard", "seq")
    return done if done is not None else pieces.select("spec_id", "doc_id", "piece", "first_token", "n_tokens", F.lit("").alias("container"))


def fill_report(packed: DataFrame, specs: DataFrame, linear: float = 1.0, quadratic: float = 1e-3) -> DataFrame:
    """Per spec: containers, the fewest that could hold all tokens, the share of space left over and the spread of costs."""
    n = F.col("n_tokens").cast("double")
    boxes = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("tokens"), F.sum(linear * n + quadratic * n * n).alias("cost"))
    specs = specs.select(F.col("spec_id").cast("int").alias("spec_id"), "capacity").distinct()
    return boxes.join(specs, "spec_id").groupBy("spec_id", "capacity").agg(
        F.count("*").alias("containers"),
        F.ceil(F.sum("tokens") / F.col("capacity")).alias("fewest"),
        F.round(1 - F.sum("tokens") / (F.count("*") * F.col("capacity")), 6).alias("unused"),
        F.round(F.stddev_pop("cost") / F.avg("cost"), 6).alias("cost_spread"),
    )


def packing_faults(counts: DataFrame, specs: DataFrame, packed: DataFrame, most_unused: float = 0.02) -> DataFrame:
    """Per spec what must be none: documents whose tokens are not placed exactly once, containers over capacity, documents split though they fit; and whether at most ``most_unused`` of the space is left over."""
    specs = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity").cast("int").alias("capacity")).filter("capacity > 0").distinct()
    per_doc = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"), F.count_distinct("first_token").alias("starts"), F.max(F.col("first_token") + F.col("n_tokens")).alias("last"))
    wanted = counts.filter("n_tokens > 0").select("doc_id", "n_tokens").crossJoin(F.broadcast(specs))  # a handful of specs
    n = F.col("n_tokens")
    right = (F.col("placed") == n) & (F.col("starts") == F.col("pieces")) & (F.col("last") == n)
    docs = wanted.join(per_doc, ["spec_id", "doc_id"], "full").groupBy("spec_id").agg(
        F.count_if(~F.coalesce(right, F.lit(False))).alias("misplaced"), F.count_if((n <= F.col("capacity")) & (F.col("pieces") > 1)).alias("split_in_vain")
    )
    boxes = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("tokens")).join(F.broadcast(specs), "spec_id").groupBy("spec_id").agg(
        F.count_if(F.col("tokens") > F.col("capacity")).alias("over_capacity"), (1 - F.sum("tokens") / F.sum("capacity") <= most_unused).alias("well_filled")
    )
    return docs.join(boxes, "spec_id").select("spec_id", "misplaced", "over_capacity", "split_in_vain", "well_filled")
