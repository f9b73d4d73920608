"""The ontology graph: schemas, insert-if-absent, projection, closure and lexical annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbena import contracts as C
from verbena.functions import text as X
from verbena.shared import materialize

# Relations of a store and their columns (fixed values); required columns end in "!".
SCHEMAS = {
    "nodes": "node_id! STRING, family! STRING, label STRING, description STRING, attrs STRING, trust STRING",
    "aliases": "node_id! STRING, alias! STRING, alias_kind! STRING, source STRING, weight DOUBLE, attrs STRING",
    "edges": "from_id! STRING, predicate! STRING, to_id! STRING, attrs STRING, trust STRING",
    "entailed_edges": "from_id! STRING, predicate! STRING, to_id! STRING",
    "mentions": "document_id STRING, mention_id! STRING, node_id! STRING, span! STRING, start_offset! INT, end_offset! INT, score DOUBLE, method! STRING, attrs STRING, trust STRING",
    "judgments": "judgment_id! STRING, subject_id! STRING, predicate! STRING, object_id STRING, value_json STRING, decision! STRING, confidence DOUBLE, evidence STRING, model STRING, recorded_at TIMESTAMP, attrs STRING",
    "embeddings": "subject_id! STRING, subject_kind! STRING, provider! STRING, text STRING, dim! INT, embedding ARRAY<FLOAT>, attrs STRING",
    "token_embeddings": "block_id! STRING, subject_id! STRING, subject_kind! STRING, provider! STRING, token_index! INT, token STRING, start_offset INT, end_offset INT, dim! INT, embedding ARRAY<FLOAT>, attrs STRING",
}


def tables(prefix: str = "semantic") -> dict[str, str]:
    C.identifier(prefix)
    return {k: f"{prefix}_{k}" for k in SCHEMAS}


def schema_sql(prefix: str = "semantic") -> list[str]:
    """Idempotent DDL of the store."""
    return [f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMAS[k].replace('! ', ' ')}) USING parquet" for k, name in tables(prefix).items()]


def init(spark: SparkSession, prefix: str = "semantic") -> None:
    for statement in schema_sql(prefix):
        spark.sql(statement)


def conform(rows: DataFrame, relation: str) -> DataFrame:
    """``rows`` in the relation's columns and types, validated; repeated rows once."""
    fields = [f.split(" ", 1) for f in SCHEMAS[relation].split(", ")]
    required = [n[:-1] for n, _ in fields if n.endswith("!")]
    C.columns(rows, required, relation)
    out = rows.select(*((F.col(n.rstrip("!")) if n.rstrip("!") in rows.columns else F.lit(None)).cast(t).alias(n.rstrip("!")) for n, t in fields))
    texts = C.required_text(*(n[:-1] for n, t in fields if n.endswith("!") and t == "STRING"))
    C.check(out, [*texts, *((f"{n[:-1]} must be non-missing", F.col(n[:-1]).isNull()) for n, t in fields if n.endswith("!") and t != "STRING")], relation)
    if relation == "nodes":
        C.unique(out.distinct(), ["node_id"], "nodes")
    if relation == "aliases":
        C.check(out, [("weight must be finite", F.isnan("weight") | (F.abs("weight") == float("inf")))], "aliases")
    return out.dropDuplicates()


def insert_absent(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """``stored`` plus the rows it does not have; null equals null."""
    rows = rows.select(*stored.columns).dropDuplicates()
    s = stored.alias("s")
    same = None
    for c in stored.columns:
        e = rows[c].eqNullSafe(F.col(f"s.{c}"))
        same = e if same is None else same & e
    return stored.unionByName(rows.join(s, same, "left_anti"))


def replace_by(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` without the keys of ``rows``, plus ``rows``."""
    return stored.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


@C.takes_tables
def projection(source: DataFrame, from_col: str, predicate: str, to_col: str, attrs: str | None = None, trust: str | None = None) -> DataFrame:
    """An edge-shaped relation in the columns of ``edges``."""
    opt = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    return source.select(F.col(from_col).cast("string").alias("from_id"), F.col(predicate).cast("string").alias("predicate"), F.col(to_col).cast("string").alias("to_id"), opt(attrs).alias("attrs"), opt(trust).alias("trust"))


def projection_sql(source_table: str, from_col: str, predicate: str, to_col: str, target_table: str = "semantic_edges", attrs: str | None = None, trust: str | None = None) -> str:
    for n in (source_table, from_col, predicate, to_col, target_table, *filter(None, (attrs, trust))):
        C.identifier(n, "name")
    return f"CREATE OR REPLACE TEMPORARY VIEW {target_table} AS SELECT {from_col} AS from_id, {predicate} AS predicate, {to_col} AS to_id, {attrs or 'CAST(NULL AS STRING)'} AS attrs, {trust or 'CAST(NULL AS STRING)'} AS trust FROM {source_table}"


_PAIR = ["from_id", "predicate", "to_id"]


def _pairs(edges: DataFrame, transitive_predicates: list[str]) -> DataFrame:
    base = edges.where(F.col("predicate").isin(*transitive_predicates) if transitive_predicates else F.lit(False))
    return base.select(*_PAIR).where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct()


def _compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """Pairs over a pair of ``first`` and one of ``then``."""
    ahead = then.select(F.col("from_id").alias("mid"), F.col("predicate").alias("p"), F.col("to_id").alias("far"))
    return first.join(ahead, (F.col("to_id") == F.col("mid")) & (F.col("predicate") == F.col("p"))).select("from_id", "predicate", F.col("far").alias("to_id")).distinct()


def _mutual(new: DataFrame, known: DataFrame) -> DataFrame:
    """(predicate, node, rep): nodes of ``new`` pairs that ``known`` joins in both directions, each with the least node that they lead to."""
    back = known.where("from_id > to_id").select(F.col("to_id").alias("a"), F.col("predicate").alias("p"), F.col("from_id").alias("b"))
    there = new.where("from_id < to_id").join(back, (F.col("from_id") == F.col("a")) & (F.col("to_id") == F.col("b")) & (F.col("predicate") == F.col("p")))
    turned = new.where("from_id > to_id").select(F.col("to_id").alias("a"), F.col("predicate").alias("p"), F.col("from_id").alias("b"))
    here = known.where("from_id < to_id").join(turned, (F.col("from_id") == F.col("a")) & (F.col("to_id") == F.col("b")) & (F.col("predicate") == F.col("p")))
    both = there.select(*_PAIR).unionByName(here.select(*_PAIR))
    leads = materialize(both.groupBy("predicate", F.col("to_id").alias("node")).agg(F.min("from_id").alias("rep")), "mutual")
    if not leads.take(1):
        return leads
    while True:  # each node's rep may lead on to a smaller one: double the steps until none does
        on = leads.select(F.col("predicate").alias("p"), F.col("node").alias("via"), F.col("rep").alias("end"))
        next_ = materialize(leads.join(on, (F.col("predicate") == F.col("p")) & (F.col("rep") == F.col("via")), "left").select("predicate", "node", F.coalesce("end", "rep").alias("rep"), F.col("end").isNotNull().alias("moved")), "mutual")
        moved, leads = next_.where("moved").take(1), next_.drop("moved")
        if not moved:
            return leads


def _renamed(rows: DataFrame, reps: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (predicate and more) with nodes in ``columns`` replaced by their reps."""
    for c in columns:
        of = reps.select(F.col("predicate").alias("p"), F.col("node").alias("old"), F.col("rep").alias("new"))
        rows = rows.join(of, (F.col("predicate") == F.col("p")) & (F.col(c) == F.col("old")), "left").withColumn(c, F.coalesce("new", c)).drop("p", "old", "new")
    return rows


@C.takes_tables
def closure(edges: DataFrame, transitive_predicates: list[str]) -> DataFrame:
    """All (from_id, predicate, to_id) reachable over one or more edges of the same predicate.

    Doubling: round k holds the pairs that up to 2**k edges join and, apart, those that exactly 2**k edges join.  One
    join of the two gives the next round, so a path of n edges takes log2(n) rounds, and each new pair of a chain is
    made once.  Nodes that are found to lead to each other are one node from then on, so a strongly connected part of m
    nodes is one pair in later rounds and not m**2; its pairs are made once, at the end.  Rounds end when one
    finds no new pair; each is written to the shared folder.
    """
    known = leap = new = materialize(_pairs(edges, transitive_predicates), "closure")
    parts = None  # (predicate, node, rep) of all nodes that are no longer their own
    while True:
        while (met := _mutual(new, known)).take(1):  # again, as renamed pairs may be mutual in turn
            known, leap = (materialize(_renamed(x, met, "from_id", "to_id").distinct(), "closure") for x in (known, leap))
            parts = materialize(met if parts is None else _renamed(parts, met, "rep").unionByName(met), "parts")
            new = known
        new = materialize(_compose(leap, known).join(known, _PAIR, "left_anti").select(*_PAIR), "closure")
        if not new.take(1):
            break
        leap = materialize(_compose(leap, leap), "closure")
        known = known.unionByName(new)
    if parts is None:
        return known
    members = parts.unionByName(parts.select("predicate", F.col("rep").alias("node"), "rep").distinct())
    for c in ("from_id", "to_id"):
        of = members.select(F.col("predicate").alias("p"), F.col("rep").alias("one"), "node")
        known = known.join(of, (F.col("predicate") == F.col("p")) & (F.col(c) == F.col("one")), "left").withColumn(c, F.coalesce("node", c)).select(*_PAIR)
    return known


@C.takes_tables
def closure_insert(closed: DataFrame, edges: DataFrame, transitive_predicates: list[str]) -> DataFrame:
    """The closure after ``edges`` are inserted, from the closure before: equal to a recomputation.

    A new path goes from a new edge's start to a new edge's end over new edges and old pairs between them, and old pairs
    lead to the one and from the other.  So only the ends of new edges are closed anew, and old pairs are read by joins with those.
    """
    old = closed.select(*_PAIR)
    added = materialize(_pairs(edges, transitive_predicates).join(old, _PAIR, "left_anti").select(*_PAIR), "inserted")
    starts = added.select(F.col("predicate").alias("p"), F.col("from_id").alias("end")).distinct()
    ends = added.select(F.col("predicate").alias("p"), F.col("to_id").alias("end")).distinct()
    at = lambda c: (F.col("predicate") == F.col("p")) & (F.col(c) == F.col("end"))
    between = old.join(ends, at("from_id"), "left_semi").join(starts, at("to_id"), "left_semi")
    paths = closure(added.unionByName(between), transitive_predicates).join(starts, at("from_id"), "left_semi").join(ends, at("to_id"), "left_semi")
    paths = materialize(paths.unionByName(added).distinct(), "inserted")
    before = old.join(starts, at("to_id"), "left_semi")
    after = old.join(ends, at("from_id"), "left_semi")
    led = materialize(paths.unionByName(_compose(before, paths)), "inserted")
    new = led.unionByName(_compose(led, after)).distinct().join(old, _PAIR, "left_anti")
    return old.unionByName(materialize(new.select(*_PAIR), "inserted"))


def closure_sql(transitive_predicates: list[str], source_table: str = "semantic_edges", target_table: str = "semantic_entailed_edges") -> str:
    """The closure as one statement.  The host bounds a recursive query's levels and rows and has no recursive UNION
    that drops repeats, so ``closure`` is the form for cycles and large graphs; this one is for acyclic edges."""
    C.identifier(source_table, "source_table")
    C.identifier(target_table, "target_table")
    chosen = ", ".join("'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in transitive_predicates)
    chosen = f"predicate IN ({chosen})" if chosen else "false"
    return (
        f"CREATE OR REPLACE TEMPORARY VIEW {target_table} AS WITH RECURSIVE e AS (SELECT DISTINCT from_id, predicate, to_id FROM {source_table} WHERE {chosen}), "
        "c AS (SELECT from_id, predicate, to_id FROM e UNION ALL SELECT c.from_id, c.predicate, e.to_id FROM c JOIN e ON e.from_id = c.to_id AND e.predicate = c.predicate) "
        "SELECT DISTINCT from_id, predicate, to_id FROM c"
    )


def alias_index(aliases: DataFrame) -> DataFrame:
    """Aliases with normalized text and token count; aliases that normalize to nothing are left out."""
    n = X.normalize(F.col("alias"))
    return aliases.withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("normalized_alias", n).where("normalized_alias <> ''").withColumn("token_count", F.size(F.split("normalized_alias", " ")))


#: Aliases up to which their normalized texts travel with the tasks; beyond, a filter of at most ``X.FILTER_BITS`` bits does.
MAX_BROADCAST_ALIASES = 1_000_000


@C.takes_tables
def annotate(documents: DataFrame, index: DataFrame, id_col: str = "document_id", text_col: str = "text", longest_match: bool = True, ordered: bool = False, max_broadcast: int = MAX_BROADCAST_ALIASES) -> DataFrame:
    """Mentions of indexed aliases in all documents, as one plan, in the columns of ``mentions`` and the alias's own.

    Few aliases travel with the tasks.  Of many only a filter does: it tells which tokens may begin an alias of which length and
    which spans may be aliases, so hardly any other span is made, and the spans meet the index in a join.

    Without ``longest_match`` every match stays; with it a match inside a strictly longer one goes.  ``ordered`` sorts by
    document, start, end (longest first) and node.
    """
    n_aliases, max_n = index.agg(F.count("*"), F.coalesce(F.max("token_count"), F.lit(0))).first()
    few = n_aliases <= max_broadcast
    if few:
        wanted = X.Wanted(r["a"] for r in index.select(F.col("normalized_alias").alias("a")).distinct().collect())
    else:
        wanted = X.alias_filter(index, n_aliases)
    spans = X.ngrams(documents, id_col, text_col, max(1, int(max_n)), wanted)
    side = index.withColumnRenamed("token_count", "alias_tokens")
    side = F.broadcast(side) if few else side
    m = spans.join(side, (F.col("normalized_span") == F.col("normalized_alias")) & (F.col("token_count") == F.col("alias_tokens"))).drop("alias_tokens")
    if longest_match:
        # A match is inside a longer one if, up to its start, some match reaches at least as far; matches of one span go together.
        # This window comes first, so all of them share its shuffle by text and texts are looked through once.
        before = Window.partitionBy("row").orderBy("start_offset", F.desc("end_offset")).rowsBetween(Window.unboundedPreceding, -1)
        m = m.withColumn("reach", F.coalesce(F.max("end_offset").over(before), F.lit(-1)))
        m = m.withColumn("reach", F.min("reach").over(Window.partitionBy("row", "start_offset", "end_offset")))
    best = Window.partitionBy("row", "start_offset", "end_offset", "node_id").orderBy(F.desc_nulls_last("weight"), F.asc_nulls_last("alias_kind"), F.asc_nulls_last("alias"), F.asc_nulls_last("source"))
    m = m.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    several = F.count("*").over(Window.partitionBy("row", "start_offset", "end_offset")) > 1
    span_id = F.concat(F.coalesce(F.col("document_id").cast("string"), F.lit("mention")), F.lit(":"), F.lpad(F.col("ordinal").cast("string"), F.greatest(F.lit(6), F.length(F.col("ordinal").cast("string"))), F.lit("0")))
    m = m.withColumn("mention_id", F.when(several, F.concat(span_id, F.lit(":"), "node_id")).otherwise(span_id))
    if longest_match:
        m = m.where(F.col("reach") < F.col("end_offset"))
    none = F.lit(None).cast("string")
    out = m.select(
        "document_id", "mention_id", "node_id", "span", "start_offset", "end_offset", F.col("weight").alias("score"), F.lit("lexical_alias").alias("method"), none.alias("attrs"), none.alias("trust"),
        "alias", "alias_kind", "source", "normalized_span",
    )
    return out.orderBy("document_id", "start_offset", F.desc("end_offset"), "node_id") if ordered else out


class LexicalAnnotator:
    """The default annotator: mentions by a store's alias index."""

    def ground(self, spark: SparkSession, text: str, document_id: str | None = None, prefix: str = "semantic", longest_match: bool = True) -> DataFrame:
        """Mentions in one text, in text order."""
        index = spark.table(f"{C.identifier(prefix)}_alias_index")
        one = spark.createDataFrame([(document_id, text)], "document_id string, text string")
        return annotate(one, index, longest_match=longest_match, ordered=True)
