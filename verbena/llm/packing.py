"""Packing into optimal length buckets.

Every document gets its token count from a public byte-level BPE vocabulary.  The global histogram of
lengths goes to the driver, one row per distinct length: d distinct lengths need at least d * d / 2 tokens in the
corpus, so it grows with the square root of the corpus at most, and never beyond the longest document.
There dynamic programming chooses the bucket boundaries that minimise padding.  Inside each bucket documents form batches of
``token_budget // boundary`` rows, each padded to the boundary.

Batches are formed without a global sort: a bucket is dealt by hash into shards of about
``shard_rows`` rows, rows are numbered in each shard, and shard sizes (one row per shard) give the
offsets.  So numbers run through a whole bucket and only its last batch can be short.

Defined results: a null or empty text has 0 tokens and is packed in the first bucket; repeated rows and
null ids are packed as often as they occur; a document longer than the budget is a batch of its own; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, materialize, q

# The published pre-tokenisation pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Tokens never span a change from non-space to space, nor the last space before a non-space.
_PIECE = re.compile(r"\s+(?!\S)|\s?\S+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # space to Python, not to the pattern
_CACHE_WORDS = 400_000


@dataclass(frozen=True)
class Params:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    buckets: int = 16
    token_budget: int = 65_536
    shard_rows: int = 50_000


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a ``tiktoken`` rank file; loaded once per worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class PieceCounts(dict):
    """Token counts of pieces that came at least twice; forgets everything when full."""

    def __init__(self, vocabulary: str):
        self.encode = encoding(vocabulary).encode_ordinary
        self.once: set[str] = set()
        self.rest: list[str] = []

    def __missing__(self, piece: str) -> int:
        if len(piece) > 40 or piece in self.once:
            n = len(self.encode(piece))
            if len(piece) <= 40:
                if len(self) >= _CACHE_WORDS:
                    self.clear()
                self[piece] = n
            return n
        if len(self.once) >= 2 * _CACHE_WORDS:
            self.once.clear()
        self.once.add(piece)
        if piece[0] == " " and not piece[-1].isspace():
            self.rest.append(piece)  # encoded with the text's other new pieces, in one call
            return 0
        return len(self.encode(piece))


@lru_cache(maxsize=2)
def piece_counts(vocabulary: str) -> PieceCounts:
    return PieceCounts(vocabulary)


def count_tokens(text: str | None, counts: PieceCounts) -> int:
    """Tokens of the whole text, as the tokenizer itself gives."""
    if not text:
        return 0
    if _ODD_SPACE.search(text):
        return len(counts.encode(text))
    n = sum(map(counts.__getitem__, _PIECE.findall(text)))
    if counts.rest:
        n += len(counts.encode("".join(counts.rest)))
        counts.rest.clear()
    return n


def token_count(text, vocabulary: str):
    """Column function: tokens of a text."""

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = piece_counts(vocabulary)
        memo = Memo(lambda t: count_tokens(t, counts))
        for texts in batches:
            yield pd.Series([memo(t) for t in texts], dtype="int64")

    return tokens(text)


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds that minimise sum(bound - length) over all documents.

    ``cost[j]`` is the least padded size of the first j lengths.  Padded size is a Monge cost, so the best
    split points do not go back as j grows and each layer takes O(lengths log lengths).
    """
    n = len(lengths)
    if n == 0:
        return []
    total = np.r_[0, np.cumsum(counts, dtype=np.float64)]
    top = np.r_[0, lengths].astype(np.float64)
    cost = np.where(np.arange(n + 1) == 0, 0.0, np.inf)
    splits = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        todo = [(1, n, 0, n)]
        while todo:
            a, z, lo, hi = todo.pop()
            if a > z:
                continue
            j = (a + z) // 2
            i = np.arange(lo, min(hi, j - 1) + 1)
            c = cost[i] + top[j] * (total[j] - total[i])
            k = int(np.argmin(c))
            new[j], cut[j] = c[k], i[k]
            todo += [(a, j - 1, lo, int(i[k])), (j + 1, z, int(i[k]), hi)]
        splits.append(cut)
        cost = np.minimum(new, np.inf)
    out, j = [], n
    for cut in reversed(splits):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def length_histogram(counted: DataFrame, n_col: str) -> tuple[np.ndarray, np.ndarray]:
    rows = counted.groupBy(F.col(n_col).alias("length")).agg(F.count("*").alias("n")).toPandas().sort_values("length")
    return rows["length"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket (its boundary), batch and position in the batch,
    both from 0, and ``padding``."""
    counted = materialize(docs.select(F.col(q(id_col)).alias("doc_id"), token_count(F.col(q(text_col)), p.vocabulary).alias("n_tokens")), "lengths")
    lengths, counts = length_histogram(counted, "n_tokens")
    bounds = optimal_boundaries(lengths, counts, p.buckets)
    if not bounds:
        none = F.lit(None).cast("long")
        return counted.select("doc_id", "n_tokens", *(none.alias(c) for c in ("bucket", "batch", "position", "padding")))
    ends = np.searchsorted(lengths, bounds, side="right")
    rows = np.diff(np.r_[0, np.cumsum(counts)[ends - 1]])
    pick = lambda values: F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), F.col("b"))
    b = sum((F.col("n_tokens") > v).cast("int") for v in bounds[:-1]) + 1 if len(bounds) > 1 else F.lit(1)
    x = counted.withColumn("b", b).withColumn("bucket", pick(bounds)).withColumn("capacity", pick([max(1, p.token_budget // max(1, v)) for v in bounds]))
    x = x.withColumn("salt", F.monotonically_increasing_id())
    shard = F.pmod(F.xxhash64("doc_id", "salt"), pick([max(1, -(-int(r) // p.shard_rows)) for r in rows]))
    sharded = materialize(x.withColumn("shard", shard), "shards")
    sizes = sharded.groupBy("b", "shard").agg(F.count("*").alias("size"))
    offsets = sizes.select("b", "shard", (F.sum("size").over(Window.partitionBy("b").orderBy("shard")) - F.col("size")).alias("before"))
    number = F.row_number().over(Window.partitionBy("b", "shard").orderBy("n_tokens", "doc_id", "salt"))
    placed = sharded.withColumn("k", number).join(offsets, ["b", "shard"]).withColumn("k", F.col("k") + F.col("before") - 1)
    return placed.select("doc_id", "n_tokens", "bucket", F.floor(F.col("k") / F.col("capacity")).alias("batch"), F.pmod("k", F.col("capacity")).alias("position"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))
