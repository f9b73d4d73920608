"""Dense search, late-interaction search and the materialised embedding index."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena import contracts as C
from verbena.functions import vectors as V
from verbena.operators import maxsim_search, vector_index
from verbena.shared import materialize

#: Doubles of query vectors (1 MB) up to which they are broadcast; beyond, queries and rows meet in tiles.
MAX_BROADCAST_DOUBLES = 1 << 17


def check_embeddings(rows: DataFrame) -> None:
    C.columns(rows, ["subject_id", "subject_kind", "provider", "dim", "embedding"], "embeddings")
    C.check(rows, [*C.required_text("subject_id", "subject_kind", "provider"), ("embedding length must equal dim", F.size("embedding") != F.col("dim")), ("embedding must be finite", ~V.finite(F.col("embedding")))], "embeddings")


def check_widths(rows: DataFrame) -> DataFrame:
    """``rows``; an embedding whose length is not its ``dim``, or that is not finite, is an error where it is read."""
    good = F.coalesce((F.size("embedding") == F.col("dim")) & V.finite(F.col("embedding")), F.lit(False))
    held = F.when(good | F.col("embedding").isNull(), F.col("embedding")).otherwise(F.raise_error(F.lit("embeddings must be finite and as long as dim")).cast(rows.schema["embedding"].dataType))
    return rows.withColumn("embedding", held)


def _scope(rows: DataFrame, dim: int, provider: str | None, subject_kind: str | None) -> DataFrame:
    x = rows.where((F.col("dim") == dim) & F.col("embedding").isNotNull())
    x = x.where(F.col("provider") == provider) if provider is not None else x
    return check_widths(x.where(F.col("subject_kind") == subject_kind) if subject_kind is not None else x)


@C.takes_tables
def embedding_search(rows: DataFrame, query: list[float], provider: str | None = None, subject_kind: str | None = None, top_k: int = 10, metric: str = "cosine") -> DataFrame:
    """The ``top_k`` rows by one of four metrics; ties by subject, kind and provider."""
    if metric not in V.METRICS:
        raise C.ContractError(f"metric must be one of {', '.join(V.METRICS)}")
    if not query or not all(map(math.isfinite, query)):
        raise C.ContractError("embedding must be a non-empty finite vector")
    if metric.startswith("cosine") and not any(query):
        raise C.ContractError("cosine search needs a non-zero query")
    score, ascending = V.METRICS[metric]
    x = _scope(rows, len(query), provider, subject_kind).withColumn("score", score(F.col("embedding"), F.array(*map(F.lit, map(float, query)))))
    return x.orderBy(F.asc("score") if ascending else F.desc("score"), "subject_id", "subject_kind", "provider").limit(top_k)


@C.takes_tables
def embedding_search_block(rows: DataFrame, queries: DataFrame, provider: str | None = None, subject_kind: str | None = None, top_k: int = 10, metric: str = "cosine", alike: bool = False) -> DataFrame:
    """For each row (query_id, query) the ``top_k`` rows by one of four metrics, as ``embedding_search`` ranks them.

    Few queries are broadcast, and each partition keeps its own ``top_k`` of a query before rows are dealt by query.
    Beyond ``MAX_BROADCAST_DOUBLES`` queries and rows meet in tiles and nothing is broadcast.

    ``alike`` is for vectors that many rows or many queries share, with the same answers: see ``_search_alike``.
    """
    if metric not in V.METRICS:
        raise C.ContractError(f"metric must be one of {', '.join(V.METRICS)}")
    rules = [("query_id must be non-missing", F.col("query_id").isNull()), ("embedding must be a non-empty finite vector", ~F.coalesce((F.size("query") > 0) & V.finite(F.col("query")), F.lit(False)))]
    if metric.startswith("cosine"):
        rules.append(("cosine search needs a non-zero query", F.forall("query", lambda x: x == 0)))
    C.check(queries, rules, "queries")
    score, ascending = V.METRICS[metric]
    x = rows.where(F.col("embedding").isNotNull())
    x = x.where(F.col("provider") == provider) if provider is not None else x
    x = x.where(F.col("subject_kind") == subject_kind) if subject_kind is not None else x
    x = check_widths(x)
    if alike:
        return _search_alike(x, queries, metric, top_k)
    if queries.agg(F.coalesce(F.sum(F.size("query")), F.lit(0))).first()[0] > MAX_BROADCAST_DOUBLES:
        return vector_index.search_tiles(x, queries, metric, top_k)
    each = x.join(F.broadcast(queries.select("query_id", "query")), F.col("dim") == F.size("query")).withColumn("score", score(F.col("embedding"), F.col("query"))).drop("query")
    order = Window.partitionBy("query_id").orderBy(F.asc("score") if ascending else F.desc("score"), "subject_id", "subject_kind", "provider")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def _search_alike(rows: DataFrame, queries: DataFrame, metric: str, top_k: int) -> DataFrame:
    """``vector_index.search_tiles`` over distinct vectors.

    Rows with one vector have one score with any query, so only the first ``top_k`` of them by their keys can be among its best;
    queries with one vector have the same answers, which are joined to them.
    """
    order = Window.partitionBy("dim", "embedding").orderBy(*vector_index.KEYS)
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k).drop("place")
    asked = materialize(queries.select("query").distinct().withColumn("query_id", F.monotonically_increasing_id()), "queries")
    of = queries.select("query_id", "query").join(asked.select("query", F.col("query_id").alias("of")), "query").select("query_id", "of")
    found = vector_index.search_tiles(first, asked, metric, top_k).withColumnRenamed("query_id", "of")
    return found.join(of, "of").select("query_id", *(c for c in found.columns if c != "of"))


@C.takes_tables
def materialize_embedding_index(rows: DataFrame, dimensions: int, provider: str | None = None, subject_kind: str | None = None, table: str | None = None) -> DataFrame:
    """One width as a relation of its own, in the shared folder or as ``table``; null embeddings stay.

    Searches over it are exact and take any metric, so it is not bound to one; ``approximate_index`` is the form that is.
    """
    x = rows.where(F.col("dim") == dimensions)
    x = x.where(F.col("provider") == provider) if provider is not None else x
    x = x.where(F.col("subject_kind") == subject_kind) if subject_kind is not None else x
    if table is None:
        return materialize(x, "embedding-index")
    x.write.mode("overwrite").saveAsTable(C.identifier(table, "table"))
    return rows.sparkSession.table(table)


@C.takes_tables
def approximate_index(rows: DataFrame, dimensions: int, provider: str | None = None, subject_kind: str | None = None, metric: str = "cosine", path: str | None = None) -> vector_index.VectorIndex:
    """An inverted file over one width for one metric, see ``vector_index``; ``vector_index.search`` asks it."""
    if metric not in V.METRICS:
        raise C.ContractError(f"metric must be one of {', '.join(V.METRICS)}")
    return vector_index.build(_scope(rows, dimensions, provider, subject_kind), dimensions, metric, path)


@C.takes_tables
def late_interaction_search(rows: DataFrame, query: list[list[float]], provider: str | None = None, subject_kind: str | None = None, top_k: int = 10, candidate_subject_id: list[str] | None = None) -> DataFrame:
    """Blocks of token vectors by the sum, over query tokens, of the best cosine with a block's token.

    Each (row, query token) product is aggregated at once with max_by, so a block is never collected.
    """
    if not query or len({len(t) for t in query}) != 1 or not all(any(t) for t in query):
        raise C.ContractError("query tokens must be non-zero vectors of one width")
    unit = [[x / math.sqrt(sum(v * v for v in t)) for x in t] for t in query]
    x = _scope(rows, len(query[0]), provider, subject_kind)
    x = x.where(F.col("subject_id").isin(candidate_subject_id)) if candidate_subject_id is not None else x
    keys = ["provider", "subject_kind", "subject_id", "block_id", "dim"]
    normed = x.select(*keys, "token_index", "token", "embedding", V.norm(F.col("embedding")).alias("norm"))
    each = normed.select(*keys, "token_index", "token", *(V.unit_dot(F.col("embedding"), F.col("norm"), t).alias(f"s{i}") for i, t in enumerate(unit)))
    best = [F.max(F.struct(F.col(f"s{i}").alias("s"), (-F.col("token_index")).alias("i"), F.col("token").alias("t"))).alias(f"b{i}") for i in range(len(unit))]
    g = each.groupBy(*keys).agg(F.count("*").alias("candidate_token_count"), *best)
    total = sum((F.col(f"b{i}.s") for i in range(1, len(unit))), F.col("b0.s"))
    out = g.select(
        "block_id", "subject_id", "subject_kind", "provider", "dim", total.alias("score"), (total / len(unit)).alias("score_mean"), total.alias("score_sum"), F.lit(len(unit)).alias("query_token_count"), "candidate_token_count",
        F.concat_ws(",", *((-F.col(f"b{i}.i")).cast("string") for i in range(len(unit)))).alias("best_token_index"), F.concat(*(F.coalesce(f"b{i}.t", F.lit("")) for i in range(len(unit)))).alias("best_token"),
    )
    return out.orderBy(F.desc("score"), "provider", "subject_kind", "subject_id", "block_id").limit(top_k)


@C.takes_tables
def late_interaction_search_block(rows: DataFrame, queries: DataFrame, provider: str | None = None, subject_kind: str | None = None, top_k: int = 10) -> DataFrame:
    """For each query the ``top_k`` blocks, as ``late_interaction_search`` ranks them.

    ``queries`` (query_id, query_token, query) has a row a token.  Few queries are broadcast and meet every block; beyond
    ``MAX_BROADCAST_DOUBLES`` nothing is, and bounds choose the blocks that are scored, see ``maxsim_search``.  A query token's
    best token is the one of the smaller index among equals; without the columns, indices and tokens are missing.
    """
    C.columns(queries, ["query_id", "query_token", "query"], "queries")
    rules = [("query_id must be non-missing", F.col("query_id").isNull()), ("query tokens must be finite and non-zero", ~F.coalesce(V.finite(F.col("query")) & F.exists("query", lambda x: x != 0), F.lit(False)))]
    C.check(queries, rules, "queries")
    x = C.with_defaults(rows, {"token_index": T.IntegerType(), "token": T.StringType()}).where(F.col("embedding").isNotNull())
    x = x.where(F.col("provider") == provider) if provider is not None else x
    x = check_widths(x.where(F.col("subject_kind") == subject_kind) if subject_kind is not None else x)
    x = x.select(*maxsim_search.BLOCK, "token_index", "token", "embedding")
    asked = queries.select("query_id", "query_token", "query")
    if queries.agg(F.coalesce(F.sum(F.size("query")), F.lit(0))).first()[0] > MAX_BROADCAST_DOUBLES:
        return maxsim_search.search(x, asked, top_k)
    met = x.withColumn("norm", V.norm(F.col("embedding"))).join(F.broadcast(asked.withColumn("query_norm", V.norm(F.col("query")))), F.col("dim") == F.size("query"))
    return maxsim_search.ranked(maxsim_search.scored(met), top_k)
