"""Queries over the test tables, one per operator, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbena.functions import text as X
from verbena.functions import vectors as V
from verbena.operators import graph, hypotheses, judgments, literature, observations, prompts, releases, retrieval, vector_index
from verbena.plans import session


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts, dealt over all task slots where they lie in fewer files than that (a file may be one split)."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    slots = spark.sparkContext.defaultParallelism
    return d.repartition(slots) if len(d.inputFiles()) < slots else d


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _t(spark, sf_dir, "embeddings")
    return x.select(F.format_string("%09d", F.col("vec_id")).alias("subject_id"), F.lit("node").alias("subject_kind"), F.concat(F.lit("label"), F.col("label")).alias("provider"), F.size("embedding").alias("dim"), "embedding", "vec_id", "label")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(v) for v in _t(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def _search(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = retrieval.embedding_search(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), metric=metric, top_k=10)
        return found.select("vec_id", "label", F.round("score", 6).alias("score"))

    return run


def _search_block(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every vector whose id is divisible by 50 against all vectors."""
        x = _vectors(spark, sf_dir)
        block = x.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        found = retrieval.embedding_search_block(x, block, metric=metric, top_k=10)
        return found.select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))

    return run


def _query_block(x: DataFrame) -> DataFrame:
    return x.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _search_tiles(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The searches of ``search_block``, by tiles."""
        x = _vectors(spark, sf_dir)
        return vector_index.search_tiles(x, _query_block(x), metric, 10).select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))

    return run


def _search_index(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The searches of ``search_block``, by an inverted file in exact mode."""
        x = _vectors(spark, sf_dir)
        found = vector_index.search(retrieval.approximate_index(x, 64, metric=metric), _query_block(x), 10)
        return found.select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))

    return run


def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each query's true ten the inverted file finds in approximate mode."""
    x = _vectors(spark, sf_dir)
    queries = _query_block(x)
    found = vector_index.search(retrieval.approximate_index(x, 64), queries, 10, exact=False)
    true = vector_index.search_tiles(x, queries, "cosine", 10).select("query_id", "vec_id", F.lit(1).alias("true"))
    return found.join(true, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_found"), F.count("true").alias("n_true"))


flagship = _search("cosine")


def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir).withColumn("subject_id", F.concat(F.lit("s"), F.col("label"))).withColumn("provider", F.lit("p"))
    x = x.withColumn("block_id", F.col("subject_id")).withColumn("token_index", F.col("vec_id").cast("int")).withColumn("token", F.concat(F.lit("t"), F.col("vec_id")))
    q = [[float(v) for v in r["embedding"]] for r in _t(spark, sf_dir, "embeddings").where("vec_id IN (0, 1, 2)").orderBy("vec_id").collect()]
    out = retrieval.late_interaction_search(x, q, top_k=10)
    return out.select("block_id", F.round("score", 5).alias("score"), "candidate_token_count", "best_token_index")


def maxsim_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxSim of each label's block against four query tokens."""
    x = _t(spark, sf_dir, "embeddings")
    q = [[float(v) for v in r["embedding"]] for r in x.where("vec_id < 4").orderBy("vec_id").collect()]
    one = x.select("vec_id", "label", F.array("embedding").alias("d"))
    return one.select("vec_id", "label", F.round(V.maxsim(F.array(*(F.array(*map(F.lit, t)) for t in q)), F.col("d")), 5).alias("score"))


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalize(F.col("text")), 256).alias("digest"))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tokens(spread_texts(spark, sf_dir), "doc_id", "text")
    return t.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n_tokens"), F.sum(F.col("start_offset").cast("long")).alias("starts"), F.sum(F.col("end_offset").cast("long")).alias("ends"))


def literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.literal_hits(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", "license").select("doc_id", "h.start_offset", "h.end_offset")


def literal_search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with letters whose lower case is no single letter in many places, searched for three of them."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.translate("text", "anesANES", "İΣẞçİΣẞÇ").alias("text"))
    return X.literal_hits(d, "text", "İσD").select("doc_id", "h.start_offset", "h.end_offset", F.substring("text", F.col("h.start_offset") + 1, F.lit(3)).alias("source_text"))


def sha256_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def benchmark_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items' first three words as aliases."""
    words = F.split(X.normalize(F.col("text")), " ")
    return _t(spark, sf_dir, "benchmark").select(F.concat(F.lit("item:"), "item_id").alias("node_id"), F.array_join(F.slice(words, 1, 3), " ").alias("alias"), F.lit("label").alias("alias_kind"), F.lit("benchmark").alias("source"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("attrs"))


def lexical_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents annotated with the benchmark's first three words as aliases."""
    found = graph.annotate(spread_texts(spark, sf_dir), graph.alias_index(benchmark_aliases(spark, sf_dir)), "doc_id", "text")
    return found.select(F.col("document_id").alias("doc_id"), "node_id", "start_offset", "end_offset")


def lexical_annotation_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lexical_annotation`` as with more aliases than travel with the tasks."""
    found = graph.annotate(spread_texts(spark, sf_dir), graph.alias_index(benchmark_aliases(spark, sf_dir)), "doc_id", "text", max_broadcast=0)
    return found.select(F.col("document_id").alias("doc_id"), "node_id", "start_offset", "end_offset")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    x = c.select(F.concat("conv_id", F.lit("/"), "turn").alias("f"), F.lit("next").alias("p"), F.concat("conv_id", F.lit("/"), F.col("turn") + 1).alias("t"))
    return graph.projection(x, "f", "p", "t")


def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_edges(spark, sf_dir), ["next"])


def _cycles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns that follow each other, back to the first in every third conversation; and edges that join conversations to the next ones."""
    c = _t(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    node = lambda conv, turn: F.concat(conv, F.lit("/"), turn)
    back = last.where("conv_id % 3 = 0").select(node(F.col("conv_id"), F.col("turn") + 1).alias("f"), F.lit("next").alias("p"), node(F.col("conv_id"), F.lit(0)).alias("t"))
    on = last.where("conv_id % 7 < 3").select(node(F.col("conv_id"), F.col("turn") + 1).alias("f"), F.lit("next").alias("p"), node(F.col("conv_id") + 1, F.lit(0)).alias("t"))
    return _edges(spark, sf_dir).unionByName(graph.projection(back, "f", "p", "t")), graph.projection(on, "f", "p", "t")


def graph_closure_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_cycles(spark, sf_dir)[0], ["next"])


def graph_closure_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure kept up to date when conversations are joined."""
    edges, on = _cycles(spark, sf_dir)
    return graph.closure_insert(graph.closure(edges, ["next"]), on, ["next"])


def graph_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges inserted twice are stored once."""
    e = _edges(spark, sf_dir)
    return graph.insert_absent(e.distinct(), e.unionByName(e.withColumn("trust", F.lit("again"))))


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    month = F.date_format("o_orderdate", "yyyy-MM")
    facts = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("G:"), "o_custkey").alias("gene_id"), F.concat(F.lit("D:"), F.col("l_partkey") % 500).alias("disease_id"), month.alias("release_id"), F.lit("p").alias("provider_id"), month.alias("source_version"))
    months = o.groupBy(month.alias("release_id")).agg(F.min(F.to_date("o_orderdate")).alias("effective_date")).select(F.lit("p").alias("provider_id"), "release_id", "effective_date")
    return facts, months


def facts_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, months = _facts(spark, sf_dir)
    out, _ = releases.monarch_query(facts, months, "gene_disease", "p", as_of=months.agg(F.max("effective_date")).first()[0])
    return out.select("gene_id", "disease_id", "predicate", "release_id")


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, months = _facts(spark, sf_dir)
    a, b = months.agg(F.min("release_id"), F.max("release_id")).first()
    return releases.holdout_audit(facts, months, "p", a, b).select("gene_id", "disease_id", "predicate")


def literature_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an append-only log: a user is an article, an event a version, an error a deletion."""
    e = _t(spark, sf_dir, "events")
    articles = e.select(F.lit("p").alias("provider_id"), F.col("user_id").cast("string").alias("article_id"), F.col("user_id").cast("string").alias("pmid"), F.col("event_id").cast("string").alias("version_id"), F.col("event_id").alias("source_ordinal"), (F.col("event_type") == "error").alias("is_deleted"))
    sections = e.select(F.lit("p").alias("provider_id"), F.col("user_id").cast("string").alias("article_id"), F.col("user_id").cast("string").alias("pmid"), F.col("event_id").cast("string").alias("version_id"), F.col("event_id").alias("source_ordinal"), F.col("event_type").alias("section"), F.col("props").alias("text"))
    high = e.agg(F.floor(F.max("event_id") / 2).alias("h")).first()["h"]
    snapshots = spark.createDataFrame([("p", "half", int(high))], "provider_id string, snapshot_id string, high_water_ordinal long")
    return literature.literature_retrieve(articles, sections, snapshots, '"', "p", "half").select("article_id", "version_id", "start_offset", "end_offset", "source_text")


def observation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of each document, every third broken on purpose, by reason."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("source_text"), "doc_id")
    k = F.col("doc_id") % 3
    obs = d.select(
        "document_id", F.when(k == 1, "HP:12").otherwise("HP:0001250").alias("hpo_id"), F.lit(0).alias("start_offset"), F.lit(4).alias("end_offset"), F.when(k == 2, F.lit("zzzz")).otherwise(F.substring("source_text", 1, 4)).alias("source_text"),
        F.lit("present").alias("context_status"), F.lit("m").alias("method"), F.lit("p").alias("provider_id"), F.lit("1").alias("provider_version"), F.lit(0.5).alias("confidence"), F.lit("accepted").alias("status"),
    )
    bad = observations.violations(d.select("document_id", "source_text"), obs)
    return bad.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def pack_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as association edges, classified by role."""
    o = _t(spark, sf_dir, "orders")
    x = o.select(
        "o_orderkey", F.concat(F.lit("S:"), "o_custkey").alias("s"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.concat(F.lit("O:"), "o_orderkey")).alias("t"), F.lit("biolink:p").alias("p"),
        F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "P", "maybe").alias("neg"),
        F.when(F.col("o_custkey") % 2 == 0, "biolink:Gene").otherwise("biolink:Disease").alias("sc"), F.when(F.col("o_custkey") % 3 == 0, "biolink:Gene").otherwise("biolink:Disease").alias("oc"),
    )
    n = releases.negation_status(F.col("neg"))
    return x.select(F.col("o_orderkey"), n.alias("negation_status"), releases.role_status(F.col("s"), F.col("t"), F.col("p"), n, F.col("sc"), F.col("oc"), "biolink:Gene", "biolink:Disease").alias("role_status"))


def model_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per order, one candidate per line; every seventh order's confidences are out of range."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    x = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", (F.row_number().over(w) - 1).alias("position"))
    x = x.withColumns({"call_id": F.col("l_orderkey"), "mention_id": F.concat_ws("/", "l_orderkey", "position"), "node_id": F.concat(F.lit("part:"), "l_partkey"), "supplier": F.concat(F.lit("supplier:"), "l_suppkey")})
    decision = F.when(F.col("l_returnflag") == "R", "replace").when(F.col("l_returnflag") == "A", "keep").otherwise("drop")
    item = F.struct("position", "mention_id", decision.alias("decision"), F.when(F.col("l_orderkey") % 7 == 0, 2.0).otherwise(0.5).alias("confidence"), F.when(F.col("l_returnflag") == "R", F.col("supplier")).alias("replacement_node_id"))
    responses = x.groupBy("call_id").agg(F.array_sort(F.collect_list(item)).alias("i")).select("call_id", F.concat(F.lit("Results: "), F.to_json(F.struct(F.col("i").alias("judgments")))).alias("response"))
    found = judgments.judgments(responses, x, "m", x.select("call_id", F.col("supplier").alias("node_id")))
    return found.select("judgment_id", "subject_id", "object_id", "decision", "confidence")


def hypothesis_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hypotheses that their lines support, contradict or surround; the first broken rule of each."""
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    fixed = {n: F.lit("x") for n in hypotheses.COLUMNS} | {n: F.lit(None).cast("string") for n in hypotheses.OPTIONAL} | {"proposal_type": F.lit("candidate"), "proposer_type": F.lit("model"), "reviewed_at": F.lit(None).cast("timestamp"), "recorded_at": F.col("o_orderdate").cast("timestamp")}
    made = fixed | {
        "hypothesis_id": F.col("o_orderkey").cast("string"), "judgment": F.when(k == 0, "abstain").when(k.isin(1, 4), "supports").when(k == 2, "contradicts").when(k == 3, "insufficient_evidence").otherwise("maybe"),
        "review_status": F.when(k == 0, "abstained").otherwise("proposed"), "confidence": F.when(k != 0, F.col("o_totalprice") / 400000.0), "inheritance_id": F.when(c % 10 != 0, "i"),
        "contradiction": F.when(c % 2 == 0, "c"), "missing_evidence": F.when(c % 3 == 0, "m"),
    }
    role = F.when(F.col("l_returnflag") == "R", "contradiction").when(F.col("l_returnflag") == "A", "support").otherwise("context")
    cited = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("hypothesis_id"), role.alias("evidence_role"))
    rows = _t(spark, sf_dir, "orders").select(*(made[n].alias(n) for n in hypotheses.COLUMNS))
    return hypotheses.violations(rows, cited).select("hypothesis_id", "reason")


def judgment_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt an order, with its lines as mentions."""
    documents = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), F.concat(F.lit("order "), "o_orderkey").alias("text"))
    m = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey").alias("mention_id"), F.concat(F.lit("P:"), "l_partkey").alias("node_id"), F.col("l_linenumber").cast("int").alias("start_offset"))
    return prompts.judgment_prompts(documents, m).select("document_id", F.sha2("prompt", 256).alias("digest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"search_{m}": _search(m) for m in V.METRICS} | {f"search_block_{m}": _search_block(m) for m in V.METRICS}
    out |= {f"search_tiles_{m}": _search_tiles(m) for m in V.METRICS} | {f"search_index_{m}": _search_index(m) for m in V.METRICS}
    named = (index_recall, late_interaction, maxsim_blocks, normalized_text, text_tokens, literal_search, literal_search_folded, sha256_receipts, lexical_annotation, lexical_annotation_filtered, graph_closure, graph_closure_cycles, graph_closure_insert, graph_insert, facts_as_of, holdout, literature_snapshot, observation_violations, pack_roles, model_judgments, hypothesis_violations, judgment_prompts)
    return out | {f.__name__: f for f in (*named, *session.QUERIES)}


_QUERY = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_SCORES = {
    "cosine": ("list_cosine_similarity(e.embedding::DOUBLE[], q)", "DESC"),
    "cosine_distance": ("1 - list_cosine_similarity(e.embedding::DOUBLE[], q)", "ASC"),
    "l2": ("list_distance(e.embedding::DOUBLE[], q)", "ASC"),
    "inner_product": ("list_dot_product(e.embedding::DOUBLE[], q)", "DESC"),
}
_WORDS = "list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
_FACTS = """
WITH f AS (SELECT DISTINCT 'G:' || o_custkey AS gene_id, 'D:' || (l_partkey % 500) AS disease_id, strftime(o_orderdate, '%Y-%m') AS release_id
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT min(strftime(o_orderdate, '%Y-%m')) AS a, max(strftime(o_orderdate, '%Y-%m')) AS b FROM orders)"""


_CYCLES = """
WITH RECURSIVE l AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1),
e AS (SELECT conv_id || '/' || turn AS f, conv_id || '/' || (turn + 1) AS t FROM conversations UNION SELECT conv_id || '/' || (turn + 1), conv_id || '/0' FROM l WHERE conv_id % 3 = 0 {more}),
c AS (SELECT f, t FROM e UNION SELECT c.f, e.t FROM c JOIN e ON c.t = e.f)
SELECT f AS from_id, 'next' AS predicate, t AS to_id FROM c"""


def oracle_sql() -> dict[str, str]:
    out = {
        f"search_{m}": f"SELECT vec_id, label, round({s}, 6) AS score FROM embeddings e, (SELECT {_QUERY} AS q) ORDER BY {s} {d}, vec_id LIMIT 10" for m, (s, d) in _SCORES.items()
    }
    out |= {
        f"{how}_{m}": f"""
WITH b AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, vec_id, label, round({s}, 6) AS score FROM embeddings e, b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {s} {d}, vec_id) <= 10""" for how in ("search_block", "search_tiles", "search_index") for m, (s, d) in _SCORES.items()
    }
    return out | session.oracle_sql() | {
        "late_interaction": """
WITH q AS (SELECT vec_id AS qi, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (0, 1, 2)),
s AS (SELECT label, vec_id, qi, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q),
b AS (SELECT label, qi, max(s) AS best, arg_min(vec_id, (-s, vec_id)) AS best_id, count(*) AS n FROM s GROUP BY 1, 2)
SELECT 's' || label AS block_id, round(sum(best), 5) AS score, max(n) AS candidate_token_count, string_agg(best_id::VARCHAR, ',' ORDER BY qi) AS best_token_index
FROM b GROUP BY label ORDER BY sum(best) DESC, block_id LIMIT 10""",
        "maxsim_blocks": """
SELECT e.vec_id, e.label, round((SELECT sum(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) FROM embeddings q WHERE q.vec_id < 4), 5) AS score FROM embeddings e""",
        "normalized_text": "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents",
        "text_tokens": """
WITH p AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS t, string_split_regex(text, '[A-Za-z0-9]+') AS g FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, t, g FROM p),
v AS (SELECT doc_id, i, length(t[i]) AS n, length(g[i]) AS m FROM u),
w AS (SELECT doc_id, n, sum(n + m) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM v)
SELECT doc_id, count(*) AS n_tokens, sum(e - n)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM w GROUP BY 1""",
        "literal_search": """
WITH p AS (SELECT doc_id, string_split(lower(text), 'license') AS g FROM documents WHERE contains(lower(text), 'license')),
u AS (SELECT doc_id, unnest(range(1, len(g))) AS i, g FROM p),
w AS (SELECT doc_id, (sum(length(g[i]) + 7) OVER (PARTITION BY doc_id ORDER BY i))::INTEGER AS e FROM u)
SELECT doc_id, e - 7 AS start_offset, e AS end_offset FROM w""",
        "literal_search_folded": """
WITH d AS (SELECT doc_id, translate(text, 'anesANES', 'İΣẞçİΣẞÇ') AS text FROM documents),
p AS (SELECT doc_id, text, string_split(lower(text), 'iσd') AS g FROM d WHERE contains(lower(text), 'iσd')),
u AS (SELECT doc_id, text, unnest(range(1, len(g))) AS i, g FROM p),
w AS (SELECT doc_id, text, (sum(length(g[i]) + 3) OVER (PARTITION BY doc_id ORDER BY i))::INTEGER AS e FROM u)
SELECT doc_id, e - 3 AS start_offset, e AS end_offset, text[e - 2 : e] AS source_text FROM w""",
        "sha256_receipts": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        **dict.fromkeys(("lexical_annotation", "lexical_annotation_filtered"), f"""
WITH a AS (SELECT DISTINCT 'item:' || item_id AS node_id, array_to_string(({_WORDS})[1:3], ' ') AS alias FROM benchmark),
p AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS t, string_split_regex(text, '[A-Za-z0-9]+') AS g FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, t, g FROM p),
v AS (SELECT doc_id, i, lower(t[i]) AS w, length(t[i]) AS n, length(g[i]) AS m FROM u),
k AS (SELECT doc_id, i, w, n, sum(n + m) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM v),
s AS (SELECT doc_id, e - n AS start_offset, lead(e, 2) OVER o AS end_offset, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS alias FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, node_id, start_offset::INTEGER AS start_offset, end_offset::INTEGER AS end_offset FROM s JOIN a USING (alias)"""),
        "graph_closure": """
WITH RECURSIVE e AS (SELECT DISTINCT conv_id || '/' || turn AS f, conv_id || '/' || (turn + 1) AS t FROM conversations),
c AS (SELECT f, t FROM e UNION SELECT c.f, e.t FROM c JOIN e ON c.t = e.f)
SELECT f AS from_id, 'next' AS predicate, t AS to_id FROM c""",
        "graph_closure_cycles": _CYCLES.format(more=""),
        "graph_closure_insert": _CYCLES.format(more="UNION SELECT conv_id || '/' || (turn + 1), (conv_id + 1) || '/0' FROM l WHERE conv_id % 7 < 3"),
        "graph_insert": """
WITH e AS (SELECT DISTINCT conv_id || '/' || turn AS from_id, 'next' AS predicate, conv_id || '/' || (turn + 1) AS to_id FROM conversations)
SELECT *, NULL::VARCHAR AS attrs, NULL::VARCHAR AS trust FROM e UNION ALL SELECT *, NULL::VARCHAR, 'again' FROM e""",
        "facts_as_of": _FACTS + "\nSELECT gene_id, disease_id, 'biolink:associated_with' AS predicate, release_id FROM f WHERE release_id = (SELECT b FROM m)",
        "holdout": _FACTS + "\nSELECT gene_id, disease_id, 'biolink:associated_with' AS predicate FROM f WHERE release_id = (SELECT b FROM m) AND NOT EXISTS (SELECT 1 FROM f t WHERE t.release_id = (SELECT a FROM m) AND t.gene_id = f.gene_id AND t.disease_id = f.disease_id)",
        "literature_snapshot": """
WITH h AS (SELECT floor(max(event_id) / 2)::BIGINT AS h FROM events),
v AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id <= (SELECT h FROM h) GROUP BY 1),
x AS (SELECT e.user_id, e.event_id, string_split(e.props, '"') AS g FROM events e JOIN v USING (event_id) WHERE e.event_type <> 'error' AND contains(e.props, '"')),
u AS (SELECT user_id, event_id, unnest(range(1, len(g))) AS i, g FROM x),
w AS (SELECT user_id, event_id, (sum(length(g[i]) + 1) OVER (PARTITION BY event_id ORDER BY i))::INTEGER AS e FROM u)
SELECT user_id::VARCHAR AS article_id, event_id::VARCHAR AS version_id, e - 1 AS start_offset, e AS end_offset, '"' AS source_text FROM w""",
        "observation_violations": """
SELECT CASE WHEN length(text) = 0 AND doc_id % 3 <> 2 THEN 'source_text must be non-missing and non-empty text' WHEN doc_id % 3 = 1 THEN 'hpo_id must look like HP:0000000'
            WHEN length(text) < 4 THEN 'span must lie inside the document' WHEN doc_id % 3 = 2 THEN 'span must reproduce source_text' ELSE 'accepted' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
        "pack_roles": """
SELECT o_orderkey, n AS negation_status, CASE WHEN o_orderkey % 11 = 0 THEN 'missing_endpoint' WHEN n = 'negated' THEN 'negated' WHEN n = 'malformed' THEN 'malformed_negation'
  WHEN o_custkey % 2 = 0 AND o_custkey % 3 <> 0 THEN 'supported_subject_to_object' WHEN o_custkey % 2 <> 0 AND o_custkey % 3 = 0 THEN 'supported_object_to_subject' ELSE 'unsupported_orientation' END AS role_status
FROM (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'negated' WHEN 'P' THEN 'malformed' ELSE 'not_provided' END AS n FROM orders)""",
        "model_judgments": """
WITH x AS (SELECT *, l_orderkey || '/' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1) AS subject_id FROM lineitem WHERE l_orderkey % 7 <> 0)
SELECT 'judgment:' || subject_id AS judgment_id, subject_id, CASE l_returnflag WHEN 'R' THEN 'supplier:' || l_suppkey WHEN 'A' THEN 'part:' || l_partkey END AS object_id,
  CASE l_returnflag WHEN 'R' THEN 'replace' WHEN 'A' THEN 'keep' ELSE 'drop' END AS decision, 0.5::DOUBLE AS confidence FROM x""",
        "hypothesis_violations": """
WITH h AS (SELECT o_orderkey % 6 AS k, o_custkey AS c, o_totalprice / 400000.0 AS p, o_orderkey FROM orders),
s AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS support, bool_or(l_returnflag = 'R') AS contradiction, bool_or(l_returnflag = 'N') AS context FROM lineitem GROUP BY 1)
SELECT o_orderkey::VARCHAR AS hypothesis_id, CASE WHEN k = 5 THEN 'judgment has a value outside its list' WHEN k <> 0 AND NOT p BETWEEN 0 AND 1 THEN 'confidence must lie in [0, 1] unless the judgment abstains'
  WHEN k <> 0 AND c % 10 = 0 THEN 'an inheritance_id or a mechanism_text is needed unless the judgment abstains' WHEN k = 3 AND c % 3 <> 0 THEN 'insufficient evidence needs its missing_evidence named'
  WHEN k = 2 AND c % 2 <> 0 THEN 'a contradicting judgment needs its contradiction named' WHEN k = 0 AND l_orderkey IS NOT NULL THEN 'abstaining hypotheses have no source spans'
  WHEN k <> 0 AND l_orderkey IS NULL THEN 'a source span is needed unless the judgment abstains'
  WHEN k IN (1, 4) AND NOT support OR k = 2 AND NOT contradiction OR k = 3 AND NOT context THEN 'no cited span has the evidence roles that the judgment needs' END AS reason
FROM h LEFT JOIN s ON l_orderkey = o_orderkey""",
        "judgment_prompts": f"""
WITH m AS (SELECT l_orderkey, l_linenumber AS n, concat_ws('/', l_linenumber, l_partkey, l_suppkey) AS i, l_partkey AS p FROM lineitem),
j AS (SELECT l_orderkey, string_agg('{{"mention_id":"' || i || '","node_id":"P:' || p || '","start_offset":' || n || '}}', ',' ORDER BY n, i) AS c FROM m GROUP BY 1)
SELECT o_orderkey::VARCHAR AS document_id, sha256('{prompts.INSTRUCTIONS}' || chr(10) || chr(10) || 'TEXT:' || chr(10) || 'order ' || o_orderkey || chr(10) || chr(10) || 'CANDIDATES_JSON:' || chr(10) || '[' || coalesce(c, '') || ']'
  || chr(10) || chr(10) || 'GRAPH_CONTEXT_JSON:' || chr(10) || '[]') AS digest FROM orders LEFT JOIN j ON l_orderkey = o_orderkey""",
    }
