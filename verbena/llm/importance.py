"""Importance resampling towards a target distribution of hashed n-grams.

Each document's words and word pairs are counted by hash bucket.  The sparse document-by-bucket matrix is persisted once, in
the shared folder, as blocks of compressed sparse rows (row pointers, bucket numbers, counts).  Its column sums,
and those of the target texts' matrix, are the two distributions; a bucket's gain is the log ratio of its smoothed shares.
The product of the matrix with the gains gives each document's weight, and Gumbel noise made of a hash of its id turns the
weights into a draw without replacement: the highest sums are drawn.

Only the two rows of column sums, ``buckets`` numbers each, ever reach the driver.  Ranks are global without a global task: the
eligible rows are dealt by ranges of (score, id), numbered where they lie, and each range adds the sizes of the ranges before it.
A block is bounded by its entries, and a long text is hashed part by part.

Defined results: a null or empty text has no features, weight 0 and no rank; a null id is hashed as '' and comes after
other ids of its score; rows with one id are ranked one by one, by fewer features first; without target texts, or
in an empty table, the sums are 0 and the gains those of smoothing alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, q
from .divergence import pieces

_WORD = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ROW_BITS = 33  # of monotonically_increasing_id, below the partition's number


@dataclass(frozen=True)
class Params:
    buckets: int = 10_000
    percent: int = 25
    min_words: int = 20
    seed: int = 7
    block_entries: int = 65_536
    block_docs: int = 1_024


def features(text: bytes, buckets: int) -> tuple[int, np.ndarray]:
    """Words of a text, and its features by bucket: every word, and every two words joined by a blank."""
    n, last, row = 0, None, np.zeros(buckets, np.int64)
    for part in pieces(text.translate(_WORD)):
        words = part.split()
        if not words:
            continue
        single = list(map(crc32, words))
        follow = list(map(crc32, [b" " + w for w in islice(words, 1, None)], single))  # a checksum goes on where one stopped
        if last is not None:
            follow.append(crc32(b" " + words[0], last))
        row += np.bincount(np.array(single + follow, np.int64) % buckets, minlength=buckets)
        n, last = n + len(words), single[-1]
    return n, row


def _narrow(most: int) -> type:
    """The unsigned kind that holds numbers up to ``most``."""
    return next(kind for kind in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(kind).max)


def _packed(batches: Iterator[pa.RecordBatch], p: Params, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    ids, words, ends, columns, counts = [], [], [0], [], []

    def block() -> pa.RecordBatch:
        n = np.concatenate(counts)
        parts = [[ids], [words], [np.array(ends, np.int64).tobytes()], [np.concatenate(columns).astype(_narrow(p.buckets - 1)).tobytes()], [n.astype(_narrow(n.max(initial=0))).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(parts, schema, strict=True)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, row = features(text, p.buckets)
            at = np.flatnonzero(row)
            ids.append(doc_id)
            words.append(n)
            ends.append(ends[-1] + len(at))
            columns.append(at)
            counts.append(row[at])
            if ends[-1] >= p.block_entries or len(ids) >= p.block_docs:
                yield block()
                ids, words, ends, columns, counts = [], [], [0], [], []
    if ids:
        yield block()


def csr_blocks(docs: DataFrame, id_col: str, text_col: str, p: Params = Params()) -> DataFrame:
    """The matrix as rows (doc_ids, n_words, ends, columns, counts), persisted in the shared folder.

    ``ends`` holds int64 row pointers, ``columns`` bucket numbers in ascending order by document and ``counts``
    their features, both as unsigned integers no wider than a block needs.
    """
    x = docs.select(F.col(q(id_col)), F.coalesce(F.col(q(text_col)).cast("string"), F.lit("")).cast("binary"))
    binary = [T.StructField(c, T.BinaryType()) for c in ("ends", "columns", "counts")]
    kinds = T.StructType([T.StructField("doc_ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("n_words", T.ArrayType(T.LongType())), *binary])
    schema = to_arrow_schema(kinds)
    return materialize(x.mapInArrow(lambda batches: _packed(batches, p, schema), kinds), "csr")


def _csr(batch: pa.RecordBatch, k: int, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ends, columns and counts of row ``k``, the last three columns of ``batch``."""
    ends, columns, counts = (batch.column(c)[k].as_buffer() for c in (-3, -2, -1))
    at = np.frombuffer(columns, _narrow(p.buckets - 1))
    width = len(counts) // max(1, len(at))
    return np.frombuffer(ends, np.int64), at, np.frombuffer(counts, f"u{width or 1}").astype(np.int64)


def column_sums(blocks: DataFrame, p: Params = Params()) -> np.ndarray:
    """Features by bucket over all blocks, summed per task and then by bucket; ``p.buckets`` rows at most come back."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                _, columns, counts = _csr(batch, k, p)
                total += np.bincount(columns, counts, p.buckets).astype(np.int64)  # a block's sums are exact as doubles
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    each = blocks.select("ends", "columns", "counts").mapInArrow(summed, "bucket int, n long")
    rows = each.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(p.buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain, in thousandths of a nat."""
    m, s, t = len(source), float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (s + m) / ((source + 1.0) * (t + m)))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray, p: Params = Params()) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains of a document's features."""
    kinds = T.StructType([T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    schema = to_arrow_schema(kinds)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ends, columns, counts = _csr(batch, k, p)
                along = lambda x: np.diff(np.r_[0, np.cumsum(x)][ends])
                n = along(counts)
                weight = np.where(n > 0, along(gain[columns] * counts) // np.maximum(n, 1), 0)
                arrays = [batch.column(0)[k].values, batch.column(1)[k].values, pa.array(n), pa.array(weight)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return blocks.mapInArrow(product, kinds)


def noise(doc_id: Column, seed: int) -> Column:
    """Floored thousandths of a Gumbel variate, fixed by ``seed`` and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, their place from 1 in the order of all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("place", _ROW_BITS)
    sizes = laid.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row a range
    placed = laid.withColumn("part", part).join(F.broadcast(before), "part")
    return placed.withColumn("place", F.col("place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("before") + 1).drop("part", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "item_id", target_text_col: str = "text", p: Params = Params()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the rank of a document that is not drawn is null."""
    blocks = csr_blocks(docs, id_col, text_col, p)
    gain = gains(column_sums(blocks, p), column_sums(csr_blocks(target, target_id_col, target_text_col, p), p))
    scored = materialize(weights(blocks, gain, p).withColumn("score", F.col("weight") + noise(F.col("doc_id"), p.seed)), "scored")
    able = F.col("n_words") >= p.min_words
    drawn = p.percent * scored.where(able).count() // 100
    ranked = numbered(scored.where(able), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"))
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, F.when(F.col("place") <= drawn, F.col("place")).alias("rank")).unionByName(scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))


ORACLE_SQL = r"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS k),
a AS (SELECT true AS own, row_number() OVER () AS i, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT own, i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM a),
f AS (SELECT own, i, unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]))) AS f FROM w),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
y AS (SELECT f, list_transform(range(0, length(h) // 2), lambda j: ('0x' || h[2 * j + 1 : 2 * j + 2])::BIGINT) AS y FROM u),
b AS (SELECT f, xor(list_reduce(y, lambda c, x: xor(c >> 8, k[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b FROM y, k),
n AS (SELECT own, i, b, count(*) AS n FROM f JOIN b USING (f) GROUP BY 1, 2, 3),
s AS (SELECT b, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM n GROUP BY 1),
g AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS g FROM s),
e AS (SELECT i, sum(n)::BIGINT AS n, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM n JOIN g USING (b) WHERE own GROUP BY 1),
x AS (SELECT w.doc_id, len(w) >= 20 AS able, coalesce(e.n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('7:' || w.doc_id)[1:8])::BIGINT AS h FROM w LEFT JOIN e USING (i) WHERE own),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY able) AS of FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * of // 100 THEN r END AS rank FROM r"""
