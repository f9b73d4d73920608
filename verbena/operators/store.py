"""Writes to a store's tables: rows are validated first, then added if absent, or put in place of their keys.

New rows are found by an anti join and appended, so an insert never rewrites a table.  A replacement writes the
table's next content to the shared folder before it overwrites, since a table can't be read while it is overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbena import contracts as C
from verbena.functions import vectors as V
from verbena.functions.providers import PromptRunner, answers
from verbena.operators import graph, judgments, prompts
from verbena.shared import materialize
from verbena.sources.obo import Obo, read_obo

SUBJECT = ("subject_kind", "provider", "subject_id")


def absent(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that ``stored`` lacks, each once; null equals null."""
    return rows.select(*stored.columns).subtract(stored)


def _append(spark: SparkSession, name: str, rows: DataFrame) -> None:
    rows.select(*spark.table(name).columns).write.insertInto(name)


def _replace(spark: SparkSession, name: str, rows: DataFrame, keys: tuple[str, ...]) -> None:
    merged = materialize(graph.replace_by(spark.table(name), rows, list(keys)), "replaced")
    merged.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)


@C.takes_tables
def write_graph(spark: SparkSession, nodes: DataFrame | None = None, aliases: DataFrame | None = None, edges: DataFrame | None = None, replace: bool = False, index: bool = True, prefix: str = "semantic") -> None:
    """Adds rows that are absent; with ``replace``, the supplied relations' former rows go.

    All inputs are validated and what each table gets is written to the shared folder before any table is touched, so
    the tables change one after the other by plain copies only.  Catalog tables allow no more; a write that was cut off
    can be repeated, since rows that are there already are not added again.  ``versions.Store`` writes all as one transaction.
    """
    graph.init(spark, prefix)
    names = graph.tables(prefix)
    given = {k: graph.conform(v, k) for k, v in (("nodes", nodes), ("aliases", aliases), ("edges", edges)) if v is not None}
    if "nodes" in given and not replace:
        C.unique(graph.insert_absent(spark.table(names["nodes"]), given["nodes"]), ["node_id"], "nodes")
    staged = {k: materialize(rows if replace else absent(spark.table(names[k]), rows), k) for k, rows in given.items()}
    for k, rows in staged.items():
        rows.select(*spark.table(names[k]).columns).write.insertInto(names[k], overwrite=replace)
    if index and aliases is not None:
        index_aliases(spark, prefix)


def write_obo(spark: SparkSession, path: str, family: str, source: str | None = None, replace: bool = False, index: bool = True, include_obsolete: bool = False, prefix: str = "semantic") -> Obo:
    """An OBO file's graph, read and written."""
    found = read_obo(spark, path, family, source, include_obsolete)
    write_graph(spark, found.nodes, found.aliases, found.edges, replace, index, prefix)
    return found


def index_aliases(spark: SparkSession, prefix: str = "semantic") -> DataFrame:
    """Rebuilds the normalized alias table."""
    name = f"{graph.tables(prefix)['aliases'].removesuffix('_aliases')}_alias_index"
    graph.alias_index(spark.table(graph.tables(prefix)["aliases"])).write.mode("overwrite").saveAsTable(name)
    return spark.table(name)


def checked_vectors(rows: DataFrame, relation: str) -> DataFrame:
    x = graph.conform(rows, relation)
    C.check(x, [("embedding length must equal dim", F.size("embedding") != F.col("dim")), ("embedding must be finite", ~V.finite(F.col("embedding")))], relation)
    if len(x.select("dim").distinct().take(2)) > 1:
        raise C.ContractError(f"{relation} must share one dim")
    return x


@C.takes_tables
def write_embeddings(spark: SparkSession, rows: DataFrame, replace: bool = False, prefix: str = "semantic") -> None:
    """Appends vectors of one width; with ``replace``, the same subjects' former vectors go."""
    graph.init(spark, prefix)
    _write_vectors(spark, checked_vectors(rows, "embeddings"), graph.tables(prefix)["embeddings"], replace)


@C.takes_tables
def write_token_embeddings(spark: SparkSession, rows: DataFrame, replace: bool = False, prefix: str = "semantic") -> None:
    """Appends token vectors; offsets come as pairs, half-open and from zero.

    A block is named provider|kind|subject where none is given.  Tokens without an index are numbered from 0 inside their
    block, in the order of their offsets or, without offsets, in that of the rows as they come.
    """
    graph.init(spark, prefix)
    _write_vectors(spark, checked_tokens(rows), graph.tables(prefix)["token_embeddings"], replace)


def checked_tokens(rows: DataFrame) -> DataFrame:
    x = checked_vectors(token_defaults(rows), "token_embeddings")
    both = F.col("start_offset").isNotNull() | F.col("end_offset").isNotNull()
    C.check(x, [("token_index must not be negative", F.col("token_index") < 0), *((m, both & bad) for m, bad in C.offsets("start_offset", "end_offset"))], "token_embeddings")
    return x


def token_defaults(rows: DataFrame) -> DataFrame:
    x = rows if "block_id" in rows.columns else rows.withColumn("block_id", F.lit(None).cast("string"))
    x = x.withColumn("block_id", F.coalesce("block_id", F.concat_ws("|", "provider", "subject_kind", "subject_id")))
    if "token_index" not in x.columns:
        order = [c for c in ("start_offset", "end_offset") if c in x.columns]
        of_block = Window.partitionBy("subject_id", "block_id").orderBy(*order, "_come")
        x = x.withColumn("_come", F.monotonically_increasing_id()).withColumn("token_index", F.row_number().over(of_block) - 1).drop("_come")
    return x


def _write_vectors(spark: SparkSession, rows: DataFrame, name: str, replace: bool) -> None:
    if replace:
        _replace(spark, name, rows, SUBJECT)
    else:
        _append(spark, name, rows)


@C.takes_tables
def record(spark: SparkSession, rows: DataFrame, relation: str, prefix: str = "semantic") -> None:
    """Appends validated mentions or judgments; columns that are missing become null, but a judgment's time is now."""
    graph.init(spark, prefix)
    _append(spark, graph.tables(prefix)[relation], graph.conform(timed(rows, relation), relation))


def timed(rows: DataFrame, relation: str) -> DataFrame:
    now = relation == "judgments" and "recorded_at" not in rows.columns
    return rows.withColumn("recorded_at", F.current_timestamp()) if now else rows


@C.takes_tables
def annotate(spark: SparkSession, documents: DataFrame, id_col: str = "document_id", text_col: str = "text", longest_match: bool = True, store: bool = False, prefix: str = "semantic") -> DataFrame:
    """Mentions in all documents by the store's aliases; with ``store`` they are recorded, too."""
    graph.init(spark, prefix)
    if not spark.catalog.tableExists(f"{prefix}_alias_index"):
        index_aliases(spark, prefix)
    found = graph.annotate(documents, spark.table(f"{prefix}_alias_index"), id_col, text_col, longest_match)
    if store:
        found = materialize(found, "mentions")
        record(spark, found, "mentions", prefix)
    return found


@C.takes_tables
def judge(documents: DataFrame, mentions: DataFrame, runner: PromptRunner, context: DataFrame | None = None, instructions: str = prompts.INSTRUCTIONS, model: str = "semantic-runner", store: bool = False, prefix: str = "semantic") -> DataFrame:
    """Judgments of each document's mentions, one prompt and one response a document.

    A response must hold one result per mention, in text order; a document whose response breaks a rule is refused,
    and with it the whole relation.  ``context`` (document_id, node_id and more) names nodes that a replacement may take.
    Prompts are answered once, and what is read from the answers is written to the shared folder once; the rules are held where a document lies.
    """
    x = prompts.asked(documents, mentions, context, instructions, "inner")
    ids = F.col("m.node_id")
    nodes = ids if context is None else F.concat(ids, F.coalesce("g.node_id", F.array().cast("array<string>")))
    repeated = F.count("*").over(Window.partitionBy("document_id")) > 1
    candidates = F.arrays_zip(F.col("m.mention_id").alias("mention_id"), ids.alias("node_id"))
    calls = x.select(F.col("document_id").alias("call_id"), "prompt", repeated.alias("repeated"), candidates.alias("asked"), nodes.alias("nodes"))
    rows = materialize(judgments.judged_calls(calls, lambda given: answers(given, runner)), "judged")
    bad = rows.where("rule IS NOT NULL").groupBy("call_id").agg(F.min("rule").alias("rule")).take(1)
    if bad:
        raise C.ContractError(f"response for {bad[0]['call_id']}: {judgments.RULES[bad[0]['rule']]}")
    found = judgments.judgment_rows(rows.where("value_json IS NOT NULL"), model)
    if store:
        found = materialize(found, "judgments")
        record(documents.sparkSession, found, "judgments", prefix)
    return found
