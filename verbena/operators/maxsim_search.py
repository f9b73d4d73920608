"""Late interaction for query sets of any size, with bounds that leave most blocks unscored and lose none.

A token vector of length one is sketched by one byte a dimension; the sketch's distance from the vector, its slack, is
known.  So a query token's product with the sketch, give or take the slack, bounds the product with the vector, and the sums over a
query's tokens of the best upper and lower bounds in a block bound the block's score.  A tile holds some thousand query tokens and streams
sketches past them.  A query's k-th best lower bound is a threshold that k blocks reach; blocks whose upper bound
stays below it can't be among its best, and only the others are scored, by the expressions of ``retrieval``.

A block of any size is one run of sketch rows, each of bounded size; what a tile holds of it is a number a query token.
A query's tokens are held together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from verbena.functions import vectors as V
from verbena.operators.vector_index import _slices
from verbena.shared import materialize

BLOCK = ("provider", "subject_kind", "subject_id", "block_id", "dim")
_SKETCH = "dim int, goes_on boolean, blocks array<long>, sizes array<int>, codes binary, scales array<double>, slacks array<double>"
_BOUNDED = "query_no long, block_no long, least double, most double"


@dataclass(frozen=True)
class Params:
    sketch_bytes: int = 1 << 18
    tile_tokens: int = 4_096


def _sketched(batches: Iterator[pa.RecordBatch], p: Params, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tokens (block_no, dim, embedding) sorted by (dim, block) as sketches of whole blocks, or of one part of a larger one."""
    pack: list[tuple[int, list]] = []
    here, own, cut = (None, None), [], False  # dim and block, the block's tokens so far, whether a part of it has gone

    def sketch(runs: list[tuple[int, list]], goes_on: bool) -> pa.RecordBatch:
        x = np.array([v for _, vectors in runs for v in vectors])
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        if not norms.all():
            raise ValueError("embedding rows must have a non-zero norm")
        x /= norms
        scales = np.abs(x).max(axis=1) / 127
        codes = np.rint(x / scales[:, None]).astype(np.int8)
        slacks = np.linalg.norm(x - codes * scales[:, None], axis=1) + 1e-6 + x.shape[1] * 1.2e-7  # and the rounding of products
        columns = [[x.shape[1]], [goes_on], [[b for b, _ in runs]], [[len(v) for _, v in runs]], [codes.tobytes()], [scales], [slacks]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def closed(most: int) -> Iterator[pa.RecordBatch]:
        """The block ends: its rest is a part, or it joins the pack."""
        nonlocal own
        if cut:
            yield sketch([(here[1], own)], True)
        elif own:
            if pack and sum(len(v) for _, v in pack) + len(own) > most:
                yield sketch(pack, False)
                pack.clear()
            pack.append((here[1], own))
        own = []

    for batch in batches:
        for block, dim, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _slices(batch.column(2)), strict=True):
            most = max(1, p.sketch_bytes // dim)
            if (dim, block) != here:
                yield from closed(most)
                if pack and dim != here[0]:
                    yield sketch(pack, False)
                    pack.clear()
                here, cut = (dim, block), False
            elif len(own) == most:
                yield sketch([(block, own)], cut)
                own, cut = [], True
            own.append(x)
    yield from closed(0)
    if pack:
        yield sketch(pack, False)


def sketches(tokens: DataFrame, p: Params = Params()) -> DataFrame:
    """Sketches of tokens (block_no, dim, embedding), in the shared folder."""
    schema = to_arrow_schema(T.StructType.fromDDL(_SKETCH))
    x = tokens.select("block_no", "dim", F.col("embedding").cast("array<double>").alias("embedding"))
    laid = x.repartition("block_no").sortWithinPartitions("dim", "block_no")
    return materialize(laid.mapInArrow(lambda batches: _sketched(batches, p, schema), _SKETCH), "sketches")


class Bounds:
    """A tile's queries and their ``k`` best lower bounds so far."""

    def __init__(self, ids: list[int], tokens: list[np.ndarray], k: int):
        self.ids, self.k, self.first = np.array(ids, np.int64), k, np.r_[0, np.cumsum([len(t) for t in tokens])[:-1]]
        x = np.concatenate(tokens)
        self.x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        self.best = np.full((len(ids), k), -np.inf)
        self.open, self.most, self.least = None, None, None  # a large block, and its tokens' best bounds so far

    def near(self, codes: np.ndarray, scales: np.ndarray) -> np.ndarray:
        return (self.x @ codes.astype(np.float32).T) * scales.astype(np.float32)

    def meet(self, blocks: list[int], sizes: list[int], goes_on: bool, codes: np.ndarray, scales: np.ndarray, slacks: np.ndarray) -> Iterator[tuple]:
        near, at = self.near(codes, scales), np.r_[0, np.cumsum(sizes)[:-1]]
        most, least = np.maximum.reduceat(near + slacks, at, axis=1), np.maximum.reduceat(near - slacks, at, axis=1)
        if len(blocks) > 1:
            yield from self.close()
            yield self.judged(blocks, most, least)
        elif goes_on and self.open == blocks[0]:
            self.most, self.least = np.maximum(self.most, most), np.maximum(self.least, least)
        else:
            yield from self.close()
            self.open, self.most, self.least = blocks[0], most, least

    def close(self) -> Iterator[tuple]:
        if self.open is not None:
            yield self.judged([self.open], self.most, self.least)
            self.open = None

    def judged(self, blocks: list[int], most: np.ndarray, least: np.ndarray) -> tuple:
        """query_no, block_no, lower and upper bound of the pairs that the bounds so far leave."""
        most, least = (np.add.reduceat(b.astype(np.float64), self.first, axis=0) for b in (most, least))
        new = np.sort(np.hstack([self.best, least]), axis=1)[:, -self.k :]
        self.best = new
        q, b = np.nonzero(most >= new[:, :1])
        return self.ids[q], np.array(blocks, np.int64)[b], least[q, b], most[q, b]


_TILE = ("dim", "a", "b")


def _bounded(batches: Iterator[pa.RecordBatch], k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of tiles, each with its queries first (``sketch`` false), then its sketches in the order of blocks."""
    here, ids, tokens, tile = None, [], [], None

    def out(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for columns in found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        where = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
        scales, slacks, vectors = (_slices(batch.column(c)) for c in (8, 9, 10))
        for n, (*at, is_sketch) in enumerate(where):
            if at != here:
                if tile:
                    yield from out(tile.close())
                here, ids, tokens, tile = at, [], [], None
            blocks = batch.column(5)[n].as_py()
            if not is_sketch:
                ids.append(blocks[0])
                tokens.append(vectors[n].reshape(-1, at[0]))
            elif ids:
                tile = tile or Bounds(ids, tokens, k)
                codes = np.frombuffer(batch.column(7)[n].as_buffer(), np.int8).reshape(-1, at[0])
                yield from out(tile.meet(blocks, batch.column(6)[n].as_py(), batch.column(4)[n].as_py(), codes, scales[n], slacks[n]))
    if tile:
        yield from out(tile.close())


def survivors(queries: DataFrame, sketched: DataFrame, top_k: int, p: Params = Params()) -> DataFrame:
    """(query_no, block_no) of all blocks that may be among a query's ``top_k``.

    ``queries`` (query_no, query_token, query) has a row a token.  Each query goes to one tile a part of the sketches, each sketch to
    one tile a group of queries; what tiles leave over is held against the k-th best lower bound of all tiles.
    """
    spark = queries.sparkSession
    whole = queries.withColumn("dim", F.size("query")).groupBy("query_no", "dim").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("query_token", F.col("query").cast("array<double>").alias("x")))), lambda t: t["x"])).alias("vectors"))
    groups = max(1, math.ceil(queries.count() / p.tile_tokens))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.array().cast("array<double>")
    asked = whole.select("dim", F.pmod(F.xxhash64("query_no"), F.lit(groups)).cast("int").alias("a"), every(parts).alias("b"), F.lit(False).alias("sketch"), F.lit(False).alias("goes_on"), F.array("query_no").alias("blocks"), F.array().cast("array<int>").alias("sizes"), F.lit(None).cast("binary").alias("codes"), none.alias("scales"), none.alias("slacks"), "vectors")
    part = F.pmod(F.xxhash64(F.element_at("blocks", 1)), F.lit(parts)).cast("int")  # the parts of a large block share their block, so they go one way
    dealt = sketched.select("dim", every(groups).alias("a"), part.alias("b"), F.lit(True).alias("sketch"), "goes_on", "blocks", "sizes", "codes", "scales", "slacks", none.alias("vectors"))
    rows = asked.unionByName(dealt).repartition(*_TILE).sortWithinPartitions(*_TILE, "sketch", F.element_at("blocks", 1), "goes_on")
    schema = to_arrow_schema(T.StructType.fromDDL(_BOUNDED))
    found = materialize(rows.mapInArrow(lambda batches: _bounded(batches, top_k, schema), _BOUNDED), "bounds")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("least"), "block_no"))).where(F.col("rank") <= top_k)
    reached = best.groupBy("query_no").agg(F.when(F.count("*") >= top_k, F.min("least")).otherwise(F.lit(float("-inf"))).alias("reached"))
    return found.join(reached, "query_no").where(F.col("most") >= F.col("reached")).select("query_no", "block_no")


def scored(pairs: DataFrame) -> DataFrame:
    """Blocks by query from (query_id, query_token, query, query_norm, a block's keys, token_index, token, embedding, norm), one row a pair of tokens.

    A product is at once aggregated to the best of its query token and block, before anything is shuffled; ties go to the
    smaller index.
    """
    zero = F.raise_error(F.lit("embedding rows must have a non-zero norm")).cast("double")
    s = F.when(F.col("norm") == 0, zero).otherwise(V.dot(F.col("embedding"), F.col("query")) / F.col("norm") / F.col("query_norm"))
    each = pairs.select("query_id", "query_token", *BLOCK, F.struct(s.alias("s"), (-F.col("token_index")).alias("i"), F.col("token").alias("t")).alias("x"))
    best = each.groupBy("query_id", "query_token", *BLOCK).agg(F.max("x").alias("x"), F.count("*").alias("n"))
    chosen = F.array_sort(F.collect_list(F.struct("query_token", "x")))
    total = best.groupBy("query_id", *BLOCK).agg(F.sum("x.s").alias("score"), F.count("*").alias("query_token_count"), F.max("n").alias("candidate_token_count"), chosen.alias("chosen"))
    picked = lambda f: F.transform("chosen", f)
    return total.select(
        "query_id", *BLOCK, "score", (F.col("score") / F.col("query_token_count")).alias("score_mean"), F.col("score").alias("score_sum"), "query_token_count", "candidate_token_count",
        F.array_join(picked(lambda c: (-c["x"]["i"]).cast("string")), ",").alias("best_token_index"), F.array_join(picked(lambda c: F.coalesce(c["x"]["t"], F.lit(""))), "").alias("best_token"),
    )


def ranked(found: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "provider", "subject_kind", "subject_id", "block_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def pairs_left(rows: DataFrame, queries: DataFrame, top_k: int, p: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens with ``block_no``, queries with ``query_no``, pairs to score), each in the shared folder."""
    blocks = materialize(rows.select(*BLOCK).distinct().withColumn("block_no", F.monotonically_increasing_id()), "blocks")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in BLOCK]
    laid = materialize(rows.alias("r").join(blocks.alias("b"), same).select("r.*", "b.block_no"), "tokens")
    numbers = materialize(queries.select("query_id").distinct().withColumn("query_no", F.monotonically_increasing_id()), "queries")
    asked = materialize(queries.join(numbers, "query_id"), "asked")
    return laid, asked, materialize(survivors(asked, sketches(laid, p), top_k, p), "pairs")


def search(rows: DataFrame, queries: DataFrame, top_k: int, p: Params = Params()) -> DataFrame:
    """``retrieval.late_interaction_search_block`` by bounds: rows are token vectors with all columns, queries have a row a token."""
    laid, asked, pairs = pairs_left(rows, queries, top_k, p)
    met = pairs.join(asked.withColumn("query_norm", V.norm(F.col("query"))), "query_no").withColumn("query_dim", F.size("query"))
    met = met.join(laid.withColumn("norm", V.norm(F.col("embedding"))), "block_no").where(F.col("dim") == F.col("query_dim"))
    return ranked(scored(met), top_k)
