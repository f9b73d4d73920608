"""Vector search for query sets of any size: tiles of queries by blocks of rows, and an inverted file of centroids.

Rows lie in blocks of bounded size.  A tile holds some thousand queries and streams its blocks past them; what a query's best
scores so far rule out goes at once, and Spark merges what tiles leave over.  Neither side is broadcast.  Products of
matrices only choose candidates: each candidate's score is summed again element after element, as the expressions in
``functions.vectors`` do, so equal vectors have equal scores wherever they lie.

The inverted file deals rows to the nearest of its centroids.  Cells have any size: their blocks are bounded, and a large cell has many.
``search`` probes the cells nearest to a query.  In exact mode it goes on, eight times as many cells a round, with those
whose bound (distance of the centroid less radius of the cell) the query's k-th best score does not rule out,
until none is left.  In approximate mode it stops after ``probes`` cells; ``build`` chooses them for a wanted recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from verbena import contracts as C
from verbena.functions import vectors as V
from verbena.shared import materialize, scratch

KEYS = ("subject_id", "subject_kind", "provider")


@dataclass(frozen=True)
class Params:
    block_floats: int = 1 << 16  # of a block of rows
    block_rows: int = 4_096
    tile_queries: int = 8_192
    step_queries: int = 512  # queries that meet a block in one product
    sample_rows: int = 65_536  # rows that centroids are learned from
    centroid_floats: int = 1 << 22  # of all centroids, which every task holds
    iterations: int = 10
    first_probes: int = 8
    recall: float = 0.95
    recall_queries: int = 256
    seed: int = 1


# --- blocks and tiles

_BLOCK = "dim int, cell int, shard int, ids array<long>, subject_id array<string>, subject_kind array<string>, provider array<string>, vectors array<double>"
_FOUND = "query_no long, row_id long, subject_id string, subject_kind string, provider string, score double"


def _slices(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a batch's column as arrays of doubles."""
    flat, at = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    return [flat[a:z] for a, z in zip(at, at[1:])]


def _packed(batches: Iterator[pa.RecordBatch], p: Params, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (dim, cell, shard, row_id, keys, embedding) as blocks, in their order; a block's rows are in the order of their keys."""
    held: list[tuple] = []
    here = None

    def block() -> pa.RecordBatch:
        held.sort(key=lambda r: r[:4])
        columns = [[here[0]], [here[1]], [here[2]], [[r[3] for r in held]], *([[r[k] for r in held]] for k in range(3)), [np.concatenate([r[4] for r in held])]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        where = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
        rows = zip(*(batch.column(k).to_pylist() for k in range(4, 7)), batch.column(3).to_pylist(), _slices(batch.column(7)), strict=True)
        for at, row in zip(where, rows, strict=True):
            if held and (at != here or len(held) >= min(p.block_rows, max(1, p.block_floats // max(1, here[0])))):
                yield block()
                held = []
            here = at
            held.append(row)
    if held:
        yield block()


def blocks_of(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """Blocks of ``rows`` (dim, cell, shard, row_id, keys, embedding) in the order in which they lie."""
    x = rows.select("dim", "cell", "shard", "row_id", *(F.coalesce(c, F.lit("")).alias(c) for c in KEYS), F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = T.StructType.fromDDL(_BLOCK)
    schema = to_arrow_schema(kinds)
    return x.mapInArrow(lambda batches: _packed(batches, p, schema), kinds)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums along rows, element after element."""
    return np.cumsum(x, axis=1)[:, -1]


class Queries:
    """A tile's queries, and their ``k`` best ranks so far; a rank is a score, turned so that larger is better."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray], metric: str, k: int):
        self.ids, self.x, self.metric, self.k = np.array(ids, np.int64), np.array(vectors), metric, k
        self.norms = np.sqrt(_sums(self.x * self.x))
        self.best = np.full((len(ids), k), -np.inf)

    def near(self, some: slice, rows: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, float]:
        """Ranks of all pairs by one product, and how far they may be off."""
        dots = self.x[some] @ rows.T
        size = float(self.norms[some].max() * max(1e-300, norms.max()))
        if self.metric == "l2":
            span = float(self.norms[some].max() + norms.max()) ** 2
            return 2 * dots - self.norms[some][:, None] ** 2 - norms**2, 1e-9 * span
        if self.metric == "inner_product":
            return dots, 1e-9 * size
        with np.errstate(divide="ignore", invalid="ignore"):
            near = dots / (self.norms[some][:, None] * norms)
        near[:, norms == 0] = np.inf if self.metric == "cosine" else -np.inf
        return near - (self.metric == "cosine_distance"), 1e-9

    def scores(self, q: np.ndarray, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
        if self.metric == "l2":
            return np.sqrt(_sums((rows - self.x[q]) ** 2))
        dots = _sums(rows * self.x[q])
        if self.metric == "inner_product":
            return dots
        n = norms * self.norms[q]
        cosine = np.where(n == 0, np.nan, dots / np.where(n == 0, 1, n))
        return cosine if self.metric == "cosine" else 1.0 - cosine

    def ranks(self, scores: np.ndarray) -> np.ndarray:
        if self.metric in ("l2", "cosine_distance"):
            return np.where(np.isnan(scores), -np.inf, -scores)
        return np.where(np.isnan(scores), np.inf, scores)

    def meet(self, rows: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, rows and scores of the pairs of one block that may be among the ``k`` best of a query, ``k`` a query at most."""
        norms = np.sqrt(_sums(rows * rows))
        for a in range(0, len(self.ids), step):
            some = slice(a, a + step)
            near, off = self.near(some, rows, norms)
            least = self.best[some, 0]
            least = -(least**2) if self.metric == "l2" else least  # ``near`` is squared there
            if near.shape[1] > self.k:
                least = np.maximum(least, np.partition(near, -self.k, axis=1)[:, -self.k])
            q, r = np.nonzero(near >= (least - 2 * off)[:, None])
            q = q + a
            score = self.scores(q, rows[r], norms[r])
            rank = self.ranks(score)
            order = np.lexsort((r, -rank, q))
            q, r, score, rank = q[order], r[order], score[order], rank[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            kept = (place < self.k) & (rank >= self.best[q, 0])
            new = np.full((len(self.best[some]), self.k), -np.inf)
            new[q[kept] - a, place[kept]] = rank[kept]
            self.best[some] = np.sort(np.hstack([self.best[some], new]), axis=1)[:, self.k :]
            yield q[kept], r[kept], score[kept]


def _scored(batches: Iterator[pa.RecordBatch], metric: str, k: int, p: Params, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of tiles, each with its queries first (``block`` false), then its blocks."""
    here, ids, vectors, tile = None, [], [], None
    for batch in batches:
        where = list(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True))
        many = _slices(batch.column(9))
        for n, (*at, block) in enumerate(where):
            if at != here:
                here, ids, vectors, tile = at, [], [], None
            if not block:
                ids.append(batch.column(5)[n].values[0].as_py())
                vectors.append(many[n])
                continue
            if not ids:
                continue
            tile = tile or Queries(ids, vectors, metric, k)
            names = [batch.column(c)[n].values for c in range(5, 9)]
            for q, r, score in tile.meet(many[n].reshape(-1, at[0]), p.step_queries):
                took = pa.array(r)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([pa.array(tile.ids[q]), *(x.take(took) for x in names), pa.array(score)], schema, strict=True)], schema=schema)


_TILE = ("dim", "a", "b", "c")


def score_tiles(queries: DataFrame, blocks: DataFrame, metric: str, k: int, p: Params = Params()) -> DataFrame:
    """What is left of (query_no, row, score) after each tile.

    ``queries`` (dim, a, b, c, query_no, query) and ``blocks`` (dim, a, b, c and a block's columns) meet where dim, a, b and c
    are equal; a tile should get ``p.tile_queries`` queries at most, and any number of blocks.
    """
    names = F.array().cast("array<string>")
    asked = queries.select(*_TILE, F.lit(False).alias("block"), F.array("query_no").alias("ids"), *(names.alias(c) for c in KEYS), F.col("query").cast("array<double>").alias("vectors"))
    dealt = asked.unionByName(blocks.select(*_TILE, F.lit(True).alias("block"), "ids", *KEYS, "vectors"))
    schema = to_arrow_schema(T.StructType.fromDDL(_FOUND))
    return dealt.repartition(*_TILE).sortWithinPartitions(*_TILE, "block").mapInArrow(lambda batches: _scored(batches, metric, k, p, schema), _FOUND)


def best(found: DataFrame, metric: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_no").orderBy(F.asc("score") if V.METRICS[metric][1] else F.desc("score"), *KEYS, "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def numbered_rows(rows: DataFrame) -> DataFrame:
    """``rows`` in the shared folder with ``row_id``."""
    return materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "vectors")


def numbered_queries(queries: DataFrame) -> DataFrame:
    return materialize(queries.select("query_id", "query").withColumn("query_no", F.monotonically_increasing_id()), "queries")


def _answers(top: DataFrame, asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Ranked pairs with the query's id and all of the row's columns."""
    pairs = top.select("query_no", "row_id", "score", "rank").join(asked.select("query_no", "query_id"), "query_no")
    return pairs.join(rows, "row_id").select("query_id", *(c for c in rows.columns if c != "row_id"), "score", "rank")


def search_tiles(rows: DataFrame, queries: DataFrame, metric: str, top_k: int, p: Params = Params()) -> DataFrame:
    """Each query's ``top_k`` among all ``rows`` (keys, dim, embedding and more) of its width, by tiles.

    Queries are dealt into groups of about half a tile, blocks into as many parts as there should be tasks; each
    block goes to one tile a group, each query to one tile a part.
    """
    laid, asked = numbered_rows(rows), numbered_queries(queries)
    groups = max(1, math.ceil(asked.count() / (p.tile_queries // 2)))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups)
    blocks = blocks_of(laid.select("dim", F.lit(0).alias("cell"), F.lit(0).alias("shard"), "row_id", *KEYS, "embedding"), p)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt_q = asked.select(F.size("query").alias("dim"), F.pmod(F.xxhash64("query_no"), F.lit(groups)).cast("int").alias("a"), every(parts).alias("b"), F.lit(0).alias("c"), "query_no", "query")
    dealt_b = blocks.select("dim", every(groups).alias("a"), F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(parts)).cast("int").alias("b"), F.lit(0).alias("c"), "ids", *KEYS, "vectors")
    return _answers(best(score_tiles(dealt_q, dealt_b, metric, top_k, p), metric, top_k), asked, laid)


# --- the inverted file


@dataclass(frozen=True)
class Cells:
    """Centroids with their rows' number and greatest distance: what every task gets."""

    centroids: np.ndarray
    counts: np.ndarray
    radii: np.ndarray
    metric: str
    dim: int


@dataclass(frozen=True)
class VectorIndex:
    """Rows with ``row_id`` and ``cell``, blocks by cell, the cells, and the number that approximate mode probes."""

    rows: DataFrame
    blocks: DataFrame
    cells: Cells
    probes: int
    path: str


def _space(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Where cells are laid out: unit vectors for cosines (zero stays zero), else the vectors as they are."""
    if not metric.startswith("cosine"):
        return vectors
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(n == 0, 1, n)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T
    return np.sqrt(np.maximum(square, 0))


def learn_centroids(rows: DataFrame, n: int, dim: int, metric: str, p: Params = Params()) -> np.ndarray:
    """Centroids of a bounded sample of ``rows`` (row_id, embedding), of ``n`` rows in all, by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cells = max(1, min(math.isqrt(n), p.centroid_floats // dim, p.sample_rows))
    sample = rows.where(F.pmod(F.xxhash64("row_id"), F.lit(max(1, math.ceil(n / p.sample_rows)))) == 0)
    x = F.col("embedding").cast("array<double>")
    if metric.startswith("cosine"):
        sample, x = sample.where(V.norm(x) > 0), F.transform(x, lambda v: v / V.norm(x))
    data = sample.select(array_to_vector(x).alias("features"))
    if not data.take(1):
        return np.zeros((1, dim))
    return np.array(KMeans(k=cells, seed=p.seed, maxIter=p.iterations, initMode="random").fit(data).clusterCenters()).reshape(-1, dim)


def _assigned(rows: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    """row_id, cell, distance of each row (row_id, embedding)."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _space(np.array(_slices(batch.column(1))), metric)
            cells, gaps = [], []
            for a in range(0, len(x), 1024):
                d = _distances(x[a : a + 1024], centroids)
                cells.append(d.argmin(1))
                gaps.append(d.min(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(gaps))], names=["row_id", "cell", "distance"])

    return rows.select("row_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(nearest, "row_id long, cell int, distance double")


def build(rows: DataFrame, dimensions: int, metric: str = "cosine", path: str | None = None, top_k: int = 10, p: Params = Params()) -> VectorIndex:
    """An inverted file over all ``rows`` (keys, dim, embedding and more) of one width, written to ``path`` or the shared folder.

    ``probes`` is set by a bounded set of rows as queries: so many of the nearest cells hold ``p.recall`` of their true ``top_k``.
    """
    spark, path = rows.sparkSession, path or scratch(rows.sparkSession, "index")
    laid = numbered_rows(rows.where((F.col("dim") == dimensions) & F.col("embedding").isNotNull()))
    n = laid.count()
    centroids = learn_centroids(laid.select("row_id", "embedding"), n, dimensions, metric, p)
    placed = materialize(_assigned(laid, centroids, metric), "cells")
    met = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))  # a row a cell: bounded as the centroids are
    size = min(p.block_rows, max(1, p.block_floats // dimensions))
    shards = met.select("cell", F.ceil(F.col("n") / size).cast("int").alias("shards"))
    laid.join(placed.select("row_id", "cell"), "row_id").write.parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    dealt = stored.join(F.broadcast(shards), "cell").withColumn("shard", F.pmod(F.xxhash64("row_id"), F.col("shards")).cast("int"))
    blocks_of(dealt.repartition("cell", "shard").sortWithinPartitions("cell", "shard"), p).write.parquet(f"{path}/blocks")
    cells = {r["cell"]: r for r in met.collect()}
    meta = [(k, [float(v) for v in c], int(cells[k]["n"]) if k in cells else 0, float(cells[k]["radius"]) if k in cells else 0.0, metric, dimensions) for k, c in enumerate(centroids)]
    spark.createDataFrame(meta, "cell int, centroid array<double>, n long, radius double, metric string, dim int").write.parquet(f"{path}/centroids")
    probes = _wanted_probes(stored, n, centroids, metric, top_k, p)
    spark.createDataFrame([(probes,)], "probes int").write.parquet(f"{path}/probes")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    meta = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    of = lambda c: np.array([r[c] for r in meta])
    probes = spark.read.parquet(f"{path}/probes").first()["probes"]
    cells = Cells(of("centroid"), of("n"), of("radius"), meta[0]["metric"], meta[0]["dim"])
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/blocks"), cells, probes, path)


def _wanted_probes(stored: DataFrame, n: int, centroids: np.ndarray, metric: str, top_k: int, p: Params) -> int:
    some = stored.where(F.pmod(F.xxhash64("row_id", F.lit(p.seed)), F.lit(max(1, math.ceil(n / p.recall_queries)))) == 0).limit(2 * p.recall_queries)
    asked = some.select(F.col("row_id").alias("query_id"), F.col("embedding").alias("query"))
    asked = asked.where(V.norm(F.col("query")) > 0) if metric.startswith("cosine") else asked
    held = materialize(asked, "asked")
    found = search_tiles(stored.drop("row_id").withColumn("own_cell", F.col("cell")), held, metric, top_k, p).select("query_id", "own_cell").collect()
    places, order = [], {r["query_id"]: _order(np.array([r["query"]], np.float64), centroids, metric)[0] for r in held.collect()}
    for r in found:
        places.append(int(np.flatnonzero(order[r["query_id"]] == r["own_cell"])[0]))
    return int(np.quantile(places, p.recall, method="higher")) + 1 if places else 1


def _order(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """Cells from the best on, for each query."""
    if metric == "inner_product":
        return np.argsort(-(x @ centroids.T), axis=1, kind="stable")
    return np.argsort(_distances(_space(x, metric), centroids), axis=1, kind="stable")


def _bounds(x: np.ndarray, cells: Cells) -> np.ndarray:
    """The best rank (see ``Queries``) that a row of each cell can have, for each query, with room for rounding."""
    if cells.metric == "inner_product":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x @ cells.centroids.T + n * cells.radii + 1e-9 * (1 + n * (cells.radii + np.linalg.norm(cells.centroids, axis=1)))
    unit = _space(x, cells.metric)
    least = np.maximum(_distances(unit, cells.centroids) - cells.radii - 1e-6 * (1 + np.linalg.norm(unit, axis=1, keepdims=True) + cells.radii), 0)
    if cells.metric == "l2":
        return -least
    cosine = 1 - least**2 / 2
    return cosine + 1e-9 if cells.metric == "cosine" else cosine - 1 + 1e-9


def _probed(batches: Iterator[pa.RecordBatch], cells: Cells, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
    """(query_no, query, cell) for the cells at places lo to hi in each query's order, unless ``least``, its k-th best rank so far, rules them out."""
    full = np.flatnonzero(cells.counts > 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        x, least = np.array(_slices(batch.column(1))), batch.column(2).to_numpy(zero_copy_only=False)
        for a in range(0, len(x), 1024):
            some = x[a : a + 1024]
            order = _order(some, cells.centroids[full], cells.metric)[:, lo:hi]
            room = np.take_along_axis(_bounds(some, cells)[:, full], order, axis=1) >= least[a : a + 1024, None]
            if cells.metric == "cosine":  # a zero vector's NaN ranks first; it can be where the radius reaches the origin
                room |= (cells.radii[full] >= np.linalg.norm(cells.centroids[full], axis=1) - 1e-6)[order]
            q, at = np.nonzero(room)
            took = pa.array(q + a)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), pa.array(full[order[q, at]], pa.int32())], names=["query_no", "query", "cell"])


def search(index: VectorIndex, queries: DataFrame, top_k: int = 10, exact: bool = True, probes: int | None = None, p: Params = Params()) -> DataFrame:
    """For each row (query_id, query) the ``top_k`` rows of the index: all of their columns, ``score`` and ``rank``.

    Exact mode answers as a search over all rows does.  Approximate mode looks at each query's ``probes`` nearest cells.
    """
    cells = index.cells
    rules = [("query_id must be non-missing", F.col("query_id").isNull()), ("embedding must be a finite vector of the index's width", ~F.coalesce((F.size("query") == cells.dim) & V.finite(F.col("query")), F.lit(False)))]
    if cells.metric.startswith("cosine"):
        rules.append(("cosine search needs a non-zero query", F.forall("query", lambda x: x == 0)))
    C.check(queries, rules, "queries")
    asked = numbered_queries(queries)
    ascending = V.METRICS[cells.metric][1]
    open_queries = asked.select("query_no", F.col("query").cast("array<double>").alias("query"), F.lit(float("-inf")).alias("least"))
    lo, hi, top = 0, min(p.first_probes, len(cells.radii)) if exact else (probes or index.probes), None
    while lo < int((cells.counts > 0).sum()):
        some = materialize(open_queries.mapInArrow(lambda b, lo=lo, hi=hi: _probed(b, cells, lo, hi), "query_no long, query array<double>, cell int"), "probed")
        load = some.groupBy("cell").agg(F.ceil(F.count("*") / (p.tile_queries // 2)).cast("int").alias("slices"))  # a row a cell
        shards = index.blocks.groupBy("cell").agg((F.max("shard") + 1).alias("shards"))
        q = some.join(F.broadcast(load), "cell").join(F.broadcast(shards), "cell")
        q = q.select(F.lit(cells.dim).alias("dim"), F.col("cell").alias("a"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("b"), F.pmod(F.xxhash64("query_no"), F.col("slices")).cast("int").alias("c"), "query_no", "query")
        b = index.blocks.join(F.broadcast(load), "cell").select("dim", F.col("cell").alias("a"), F.col("shard").alias("b"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("c"), "ids", *KEYS, "vectors")
        found = score_tiles(q, b, cells.metric, top_k, p)
        top = materialize(best(found if top is None else found.unionByName(top.drop("rank")), cells.metric, top_k), "top")
        if not exact:
            break
        lo, hi = hi, 8 * hi
        rank = F.when(F.isnan("score"), float("-inf" if ascending else "inf")).otherwise(-F.col("score") if ascending else F.col("score"))
        full = top.groupBy("query_no").agg(F.when(F.count("*") >= top_k, F.min(rank)).otherwise(float("-inf")).alias("least"))
        open_queries = asked.select("query_no", F.col("query").cast("array<double>").alias("query")).join(full, "query_no", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    if top is None:
        top = asked.sparkSession.createDataFrame([], _FOUND + ", rank int")
    return _answers(top, asked, index.rows.drop("cell"))
