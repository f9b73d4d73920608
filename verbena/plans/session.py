"""A session over flattened source records and reviewed contributions, as queries with equivalent SQL.

An order is a record: its lines are entries of one section with a name, a description and some references, its customer
is the disease term.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbena.functions import vectors as V
from verbena.functions.providers import FunctionEmbedding, FunctionRunner
from verbena.operators import contributions, evidence, graph, hypotheses, maxsim_search, observations, prompts, releases, retrieval, store, versions
from verbena.operators.judgments import read_json
from verbena.shared import scratch


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    x = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", (F.row_number().over(w) - 1).alias("n"))
    at = F.concat(F.lit("/pathophysiology/"), "n")
    leaf = lambda path, value: F.struct(F.lit(path).alias("leaf"), value.alias("value"))
    pairs = [leaf("/name", F.concat(F.lit("part "), "l_partkey")), leaf("/description", F.concat(F.lit("supplied by "), "l_suppkey"))]
    cited = [[leaf(f"/evidence/{i}/reference", F.concat(F.lit("PMID:"), F.col("l_partkey") * 10 + i)), leaf(f"/evidence/{i}/supports", F.col("l_returnflag"))] for i in range(2)]
    k = F.col("l_partkey") % 3
    leaves = F.when(k == 0, F.array(*pairs)).when(k == 1, F.array(*pairs, *cited[0])).otherwise(F.array(*pairs, *cited[0], *cited[1]))
    lines = x.select(F.col("l_orderkey").cast("string").alias("source_id"), at.alias("at"), F.explode(leaves).alias("f")).select("source_id", F.concat("at", "f.leaf").alias("field_path"), "f.value")
    terms = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("source_id"), F.lit("/disease_term/term/id").alias("field_path"), F.concat(F.lit("C:"), "o_custkey").alias("value"))
    return lines.unionByName(terms).select(F.lit("p").alias("provider_id"), F.lit("r1").alias("release_id"), "source_id", F.lit("rc").alias("receipt_id"), F.concat_ws("#", "source_id", "field_path").alias("source_row_id"), "field_path", "value")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("C:"), "c_custkey").alias("node_id"), F.col("c_name").alias("label"), (F.col("c_custkey") % 7 == 0).alias("is_obsolete"), F.lit("q").alias("provider_id"), F.lit("r2").alias("release_id"), F.lit("rd").alias("receipt_id"))


def _scores(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Each mechanism takes the vector that its part's number names; the query is vector 0."""
    e = _t(spark, sf_dir, "embeddings")
    query = [float(v) for v in e.where("vec_id = 0").first()["embedding"]]
    part = F.regexp_extract("mechanism", "[0-9]+", 0).cast("long") % 50
    few = F.broadcast(e.where("vec_id < 50").select(F.col("vec_id").alias("v"), "embedding"))  # fifty rows
    return evidence.mechanism_scores(found.join(few, part == F.col("v")), query)


def session_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.source_receipts(_fields(spark, sf_dir), _terms(spark, sf_dir))


def session_replaced_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _terms(spark, sf_dir)
    gone = _t(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.concat(F.lit("C:"), "c_custkey").alias("node_id"), F.lit("replaced_by").alias("tag"), F.concat(F.lit("C:"), F.col("c_custkey") + 1).alias("value"))
    return evidence.replaced_terms(t, gone)


def session_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.mechanisms(_fields(spark, sf_dir)).select("field_prefix", "mechanism", "description", "source_row_id")


def session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, evidence.mechanisms(_fields(spark, sf_dir))).select("source_row_id", F.round("cosine", 6).alias("cosine"))


def session_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    return evidence.mechanism_evidence(evidence.mechanisms(f), f).select("source_row_id", "mechanism", "field_path", "reference")


def session_cited_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    m = evidence.mechanisms(f)
    return evidence.cited_references(m, _scores(spark, sf_dir, m), evidence.mechanism_evidence(m, f)).select("mechanism", F.round("cosine", 6).alias("cosine"), "cited_references")


def session_best_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    m = evidence.mechanisms(f)
    return evidence.best_cited(m, _scores(spark, sf_dir, m), evidence.mechanism_evidence(m, f), f)


def digit_counts(texts: Sequence[str]) -> list[list[int]]:
    """A stand-in for an encoder that SQL can follow."""
    return [[t.count(str(d)) for d in range(10)] for t in texts]


def _session(spark: SparkSession, sf_dir: str) -> evidence.MechanismSession:
    """Customers' names as questions to the mechanisms."""
    questions = _t(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("question_id"), F.col("c_name").alias("question"))
    return evidence.mechanism_session(_fields(spark, sf_dir), questions, FunctionEmbedding("digits", digit_counts), top_k=5)


def session_ranked_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).ranked.select("question_id", "rank", "score", "mechanism", "source_row_id", "cited_references")


def session_best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).best.select("question_id", "mechanism", "reference", "supports", "field_path", "source_row_id")


def hypothesis_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as links into their order's fields: some name a row, some a part of the value, some what is not there."""
    f = _t(spark, sf_dir, "orders").select(
        F.lit("p").alias("provider_id"), F.lit("r").alias("release_id"), F.col("o_orderkey").cast("string").alias("source_id"), F.concat(F.lit("row"), "o_orderkey").alias("source_row_id"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("/shared")).otherwise(F.concat(F.lit("/order/"), "o_orderkey")).alias("field_path"), F.lit("rc").alias("receipt_id"), F.concat(F.lit("customer "), "o_custkey", F.lit(" of "), "o_orderpriority").alias("value"),
    )
    k = F.col("l_linenumber") + F.col("l_partkey")
    links = _t(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("hypothesis_id"), F.lit("orders").alias("source_relation"), F.when(F.col("l_orderkey") % 5 == 0, F.lit("/shared")).otherwise(F.concat(F.lit("/order/"), "l_orderkey")).alias("field_path"),
        F.when(k % 4 == 1, "customer ").when(k % 4 == 2, "o").when(k % 4 == 3, "nothing").alias("text"), F.lit("c").alias("citation"), F.when(F.col("l_returnflag") == "R", "contradiction").when(F.col("l_returnflag") == "A", "support").otherwise("hearsay").alias("evidence_role"),
        F.when(k % 3 != 0, F.concat(F.lit("row"), "l_orderkey")).alias("source_row_id"),
    )
    found = hypotheses.resolved_links(links, f.select(*hypotheses.FIELD_COLUMNS))
    good = F.col("reason").isNull()
    return found.select("hypothesis_id", "reason", *(F.when(good, F.col(c)).alias(c) for c in ("source_record_id", "start_offset", "end_offset", "source_span")))


def contribution_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hypotheses whose lines are their sources: why each can't become a contribution."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = _t(spark, sf_dir, "orders").select(
        k.cast("string").alias("hypothesis_id"), F.when(k % 4 == 0, "proposed").when(k % 4 == 1, "accepted").when(k % 4 == 2, "revised").alias("review_status"), F.when(c % 3 == 0, "contradicts").when(c % 9 != 1, "supports").alias("judgment"),
        F.when(c % 5 == 0, "m").alias("missing_evidence"), F.when(k % 7 == 0, "c").alias("contradiction"),
    )
    cited = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("hypothesis_id"), F.when(F.col("l_returnflag") == "A", "support").otherwise("context").alias("evidence_role"))
    return contributions.gate_violations(rows, cited)


def store_replaced_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors written to a store in versions, every fiftieth replaced by its double; the last version."""
    x = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("subject_id"), F.lit("node").alias("subject_kind"), F.lit("p").alias("provider"), F.size("embedding").alias("dim"), "embedding", "vec_id")
    s = versions.Store(spark, scratch(spark, "store"), buckets=16)
    s.write_embeddings(x)
    s.write_embeddings(x.where("vec_id % 50 = 0").withColumn("embedding", F.transform("embedding", lambda v: v * 2)), replace=True)
    return s.table("embeddings").select(F.col("subject_id").cast("long").alias("vec_id"), F.round(V.dot(F.col("embedding"), F.col("embedding")), 5).alias("square"))


def store_graph_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a graph that is written, written again with customers, and then replaced; rows by version and relation."""
    n = _t(spark, sf_dir, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("node_id"), F.lit("nation").alias("family"), F.col("n_name").alias("label"), "n_regionkey")
    c = _t(spark, sf_dir, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node_id"), F.lit("customer").alias("family"), F.col("c_name").alias("label"), "c_nationkey")
    alias = lambda x: x.select("node_id", F.col("label").alias("alias"), F.lit("label").alias("alias_kind"))
    edges = c.select(F.col("node_id").alias("from_id"), F.lit("in").alias("predicate"), F.concat(F.lit("N:"), "c_nationkey").alias("to_id"))
    s = versions.Store(spark, scratch(spark, "store"), buckets=4)
    s.write_graph(n, alias(n))
    s.write_graph(n.drop("n_regionkey").unionByName(c.drop("c_nationkey")), alias(n).unionByName(alias(c)), edges)
    s.write_graph(c.where("c_nationkey % 2 = 0"), replace=True)
    counts = [s.table(r, v).agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), F.lit(r).alias("relation"), "n") for v in s.versions() for r in ("nodes", "aliases", "alias_index", "edges")]
    return reduce(DataFrame.unionByName, counts)


def store_recorded_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of lines, recorded in two versions; what is missing takes its default."""
    li = _t(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("subject_id"), F.when(F.col("l_returnflag") == "R", "drop").otherwise("keep").alias("decision"), "l_returnflag")
    rows = li.select(F.concat(F.lit("judgment:"), "subject_id").alias("judgment_id"), "subject_id", F.lit("grounds").alias("predicate"), "decision", "l_returnflag")
    s = versions.Store(spark, scratch(spark, "store"), buckets=8)
    s.record(rows.where("l_returnflag = 'R'").drop("l_returnflag"), "judgments")
    s.record(rows.where("l_returnflag <> 'R'").drop("l_returnflag"), "judgments")
    return s.table("judgments").select("judgment_id", "subject_id", "decision", "model", F.col("recorded_at").isNotNull().alias("timed"))


def facts_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized facts of known releases, each once."""
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    month = F.date_format("o_orderdate", "yyyy-MM")
    facts = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("D:"), F.col("l_partkey") % 500).alias("disease_id"), F.concat(F.lit("P:"), F.col("l_suppkey")).alias("phenotype_id"), month.alias("release_id"), F.lit("p").alias("provider_id"), month.alias("source_version"))
    months = o.groupBy(month.alias("release_id")).agg(F.min(F.to_date("o_orderdate")).alias("effective_date")).select(F.lit("p").alias("provider_id"), "release_id", "effective_date")
    return releases.monarch_import(facts, months, "disease_phenotype").select("disease_id", "phenotype_id", "predicate", "release_id")


def session_disease_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.disease_terms(_fields(spark, sf_dir), _terms(spark, sf_dir)).groupBy("disease_id", "term_label", "record_release", "term_release").agg(F.count("*").alias("n"))


def maxsim_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxSim of blocks of eight vectors against four query tokens."""
    x = _t(spark, sf_dir, "embeddings")
    q = [[float(v) for v in r["embedding"]] for r in x.where("vec_id < 4").orderBy("vec_id").collect()]
    blocks = x.groupBy(F.floor(F.col("vec_id") / 8).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]).alias("d"))
    return blocks.select("block", F.round(V.maxsim(F.array(*(F.array(*map(F.lit, t)) for t in q)), F.col("d")), 5).alias("score"))


def late_interaction_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, with the two after it, as a query against all blocks of eight vectors."""
    x = _t(spark, sf_dir, "embeddings")
    queries = x.where("vec_id % 50 < 3").select((F.col("vec_id") - F.col("vec_id") % 50).alias("query_id"), (F.col("vec_id") % 50).alias("query_token"), F.col("embedding").alias("query"))
    rows = x.select(F.lit("p").alias("provider"), F.lit("node").alias("subject_kind"), F.format_string("%09d", F.floor(F.col("vec_id") / 8)).alias("subject_id"), F.floor(F.col("vec_id") / 8).alias("block_id"), F.size("embedding").alias("dim"), "embedding")
    return retrieval.late_interaction_search_block(rows, queries, top_k=10).select("query_id", "block_id", F.round("score", 5).alias("score"), "candidate_token_count")


def late_interaction_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches of ``late_interaction_block`` by bounds, with the tokens that make the scores."""
    x = _t(spark, sf_dir, "embeddings")
    queries = x.where("vec_id % 50 < 3").select((F.col("vec_id") - F.col("vec_id") % 50).alias("query_id"), (F.col("vec_id") % 50).alias("query_token"), F.col("embedding").alias("query"))
    block = F.floor(F.col("vec_id") / 8)
    rows = x.select(F.lit("p").alias("provider"), F.lit("node").alias("subject_kind"), F.format_string("%09d", block).alias("subject_id"), block.alias("block_id"), F.size("embedding").alias("dim"), (F.col("vec_id") % 8).cast("int").alias("token_index"), F.concat(F.lit("<"), "vec_id", F.lit(">")).alias("token"), "embedding")
    found = maxsim_search.search(rows, queries, 10)
    return found.select("query_id", "block_id", F.round("score", 5).alias("score"), F.round("score_mean", 5).alias("score_mean"), "query_token_count", "candidate_token_count", "best_token_index", "best_token")


def observation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One context after the other, known and unknown ones, and whether the contract takes it."""
    d = _t(spark, sf_dir, "documents").where("length(text) > 3").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("source_text"), "doc_id")
    names = (*observations.CONTEXTS, "historical", "family")
    obs = d.select(
        "document_id", F.lit("HP:0001250").alias("hpo_id"), F.lit(0).alias("start_offset"), F.lit(4).alias("end_offset"), F.substring("source_text", 1, 4).alias("source_text"), F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int")).alias("context_status"),
        F.lit("m").alias("method"), F.lit("p").alias("provider_id"), F.lit("1").alias("provider_version"), F.lit(0.5).alias("confidence"), F.lit("accepted").alias("status"),
    )
    bad = observations.violations(d.select("document_id", "source_text"), obs)
    return bad.groupBy("context_status", F.col("reason").isNull().alias("taken")).agg(F.count("*").alias("n"))


def negation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ("true", " TRUE ", "false", "t", "1", "f", "0", "", "yes")
    x = _t(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, words)), (F.col("o_orderkey") % len(words) + 1).cast("int")).alias("w"))
    return x.select("o_orderkey", releases.negation_status(F.col("w")).alias("negation_status"))


def lexical_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention with its identity and its span as written."""
    from verbena.plans.queries import benchmark_aliases, spread_texts

    found = graph.annotate(spread_texts(spark, sf_dir), graph.alias_index(benchmark_aliases(spark, sf_dir)), "doc_id", "text")
    return found.select(F.col("document_id").alias("doc_id"), "mention_id", F.sha2("span", 256).alias("span_sha256"), "score", "method")


def keep_or_drop(asked: Sequence[str]) -> list[str]:
    """A stand-in for a model: keeps the candidates of a prompt at even places and drops the others."""
    out = []
    for prompt in asked:
        listed = read_json(prompt.split("CANDIDATES_JSON:\n", 1)[1].split("\n\nGRAPH_CONTEXT_JSON:", 1)[0])
        results = [f'{{"mention_id": "{c["mention_id"]}", "decision": "{"drop" if i % 2 else "keep"}", "confidence": 0.25}}' for i, c in enumerate(listed)]
        out.append("Results: [" + ", ".join(results) + "]")
    return out


def judged_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, responses and judgments of every order's lines."""
    documents = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), F.concat(F.lit("order "), "o_orderkey").alias("text"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    x = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.row_number().over(w) - 1).alias("n"))
    mentions = x.select(F.col("l_orderkey").cast("string").alias("document_id"), F.concat_ws("/", "l_orderkey", "n").alias("mention_id"), F.concat(F.lit("P:"), "l_partkey").alias("node_id"), F.col("n").alias("start_offset"))
    found = store.judge(documents, mentions, FunctionRunner(keep_or_drop), instructions=prompts.INSTRUCTIONS, model="stand-in")
    return found.select("judgment_id", "object_id", "decision", "confidence", "model")


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "N", "support").otherwise("context")
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("hypothesis_id"), F.concat(F.lit("PMID:"), "l_partkey", F.lit(";")).alias("citation"), F.concat(F.lit("s"), "l_suppkey").alias("source_span"), role.alias("evidence_role"))


def _first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the part and supplier of their first line."""
    first = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m"))
    return _t(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("m.l_partkey").alias("part"), F.col("m.l_suppkey").alias("supplier"))


def contribution_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as new terms and revised definitions."""
    x, k = _first_line(spark, sf_dir), F.col("k") % 5
    text = F.concat(F.lit("see PMID:"), F.coalesce(F.col("part").cast("string"), F.lit("none")), F.lit("; and more"))
    new = k.isin(0, 1)
    payloads = x.select(
        F.col("k").cast("string").alias("hypothesis_id"), F.when(new, "new_term").when(k.isin(2, 3), "revise_definition").otherwise("other").alias("contribution_type"), F.when(new & (F.col("c") % 4 != 0), "label").alias("Label"),
        F.when(new, text).alias("description"), F.when(k == 0, "MONDO:1").when(k == 1, "one").alias("parent"), F.when(k.isin(2, 3), "MONDO:2").alias("term"), F.when(k.isin(2, 3), text).alias("suggested_revision"),
        F.when(k == 2, "0000-0001-2345-678X").when(k == 3, "0000").alias("orcid"),
    )
    return contributions.mondo_violations(payloads, _cited(spark, sf_dir)).select("hypothesis_id", "reason")


def contribution_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as disease records with one entry and one quoted evidence."""
    x, k = _first_line(spark, sf_dir), F.col("k") % 6
    item = F.struct(
        F.concat(F.lit("PMID:"), "part", F.lit(";")).alias("reference"), F.when(k == 1, "REFUTE").otherwise("SUPPORT").alias("supports"), F.when(k == 2, "LAB").otherwise("IN_VITRO").alias("evidence_source"), F.lit("BACKGROUND").alias("quote_role"),
        F.concat(F.lit("s"), "supplier").alias("snippet"), F.when(k != 3, "because").alias("explanation"),
    )
    entry = F.struct(F.lit("entry").alias("name"), F.when(k == 4, "PLANET").otherwise("TISSUE").alias("biological_scale"), F.lit("d").alias("description"), F.array(item).alias("evidence"))
    disease = F.struct(F.when(k == 5, "D:1").otherwise("MONDO:7").alias("id"), F.lit("l").alias("label"))
    payloads = x.where("part IS NOT NULL").select(F.col("k").cast("string").alias("hypothesis_id"), F.lit("n").alias("name"), disease.alias("disease_term"), F.array(entry).alias("pathophysiology"))
    return contributions.dismech_violations(payloads, _cited(spark, sf_dir)).select("hypothesis_id", "reason")


def contribution_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as associations between a part and a supplier."""
    x, k = _first_line(spark, sf_dir), F.col("k") % 7
    payloads = x.where("part IS NOT NULL").select(
        F.col("k").cast("string").alias("hypothesis_id"), F.when(k == 1, "gene 1").otherwise(F.concat(F.lit("G:"), "part")).alias("subject"), F.when(k == 2, "biolink:is").otherwise("biolink:causes").alias("predicate"), F.concat(F.lit("D:"), "supplier").alias("object"),
        F.when(k == 3, "source").otherwise("infores:x").alias("primary_knowledge_source"), F.lit("prediction").alias("knowledge_level"), F.when(k == 4, "robot").otherwise("manual_agent").alias("agent_type"),
        F.array(F.lit("PMID:0;"), F.concat(F.lit("PMID:"), "part", F.lit(";"))).alias("publications"), F.when(k == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("ECO:1"))).alias("has_evidence"),
    )
    return contributions.monarch_violations(payloads, _cited(spark, sf_dir)).select("hypothesis_id", "reason")


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    session_receipts, session_replaced_terms, session_mechanisms, session_scores, session_evidence, session_cited_references, session_best_cited, session_disease_terms, maxsim_token_blocks, late_interaction_block, late_interaction_pruned,
    session_ranked_mechanisms, session_best_evidence, hypothesis_links, contribution_gates, store_replaced_vectors, store_graph_versions, store_recorded_judgments, facts_import,
    observation_contexts, negation_words, lexical_mentions, judged_mentions, contribution_terms, contribution_records, contribution_associations,
)

_FIELDS = """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS n FROM lineitem),
k AS (SELECT *, unnest(range(0, (l_partkey % 3)::BIGINT)) AS i FROM l),
f AS (
  SELECT l_orderkey::VARCHAR AS source_id, '/pathophysiology/' || n || '/name' AS field_path, 'part ' || l_partkey AS value FROM l
  UNION ALL SELECT l_orderkey::VARCHAR, '/pathophysiology/' || n || '/description', 'supplied by ' || l_suppkey FROM l
  UNION ALL SELECT l_orderkey::VARCHAR, '/pathophysiology/' || n || '/evidence/' || i || '/reference', 'PMID:' || (l_partkey * 10 + i) FROM k
  UNION ALL SELECT l_orderkey::VARCHAR, '/pathophysiology/' || n || '/evidence/' || i || '/supports', l_returnflag FROM k
  UNION ALL SELECT o_orderkey::VARCHAR, '/disease_term/term/id', 'C:' || o_custkey FROM orders),
t AS (SELECT 'C:' || c_custkey AS node_id, c_name AS label, c_custkey % 7 = 0 AS is_obsolete, c_custkey FROM customer),
m AS (SELECT regexp_extract(d.field_path, '^(/pathophysiology/[0-9]+)/', 1) AS field_prefix, b.value AS mechanism, d.value AS description, d.source_id, d.source_id || '#' || d.field_path AS source_row_id
      FROM f d JOIN f b ON b.source_id = d.source_id AND b.field_path = regexp_replace(d.field_path, '/description$', '/name') WHERE regexp_matches(d.field_path, '^/pathophysiology/[0-9]+/description$')),
s AS (SELECT source_row_id, list_dot_product(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS cosine FROM m JOIN embeddings e ON e.vec_id = TRY_CAST(substr(mechanism, 6) AS BIGINT) % 50),
v AS (SELECT m.source_row_id, m.mechanism, e.source_id, e.field_path, e.value AS reference FROM m JOIN f e ON e.source_id = m.source_id AND regexp_extract(e.field_path, '^(/pathophysiology/[0-9]+)/evidence/[0-9]+/reference$', 1) = m.field_prefix)
"""
_ASKED = _FIELDS + """
, z AS (SELECT source_row_id, count(*) AS c FROM v GROUP BY 1),
d AS (SELECT m.*, list_transform(range(10), lambda d: (length(description) - length(replace(description, d::VARCHAR, '')))::DOUBLE) AS e, '{"provider_id":"p","release_id":"r1","source_id":"' || source_id || '","source_row_id":"' || source_row_id || '"}' AS subject_id FROM m),
q AS (SELECT c_custkey::VARCHAR AS question_id, list_transform(range(10), lambda d: (length(c_name) - length(replace(c_name, d::VARCHAR, '')))::DOUBLE) AS q FROM customer WHERE c_custkey % 50 = 0),
x AS (SELECT question_id, list_dot_product(e, q) AS score, mechanism, d.source_row_id, c, (row_number() OVER (PARTITION BY question_id ORDER BY list_dot_product(e, q) DESC, subject_id))::INTEGER AS r FROM d CROSS JOIN q LEFT JOIN z USING (source_row_id))
"""
_CITED = """
WITH x AS (SELECT o_orderkey AS k, o_custkey AS c, p[1] AS part, p[2] AS supplier FROM orders LEFT JOIN (SELECT l_orderkey, min([l_partkey, l_suppkey]) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
s AS (SELECT DISTINCT l_orderkey AS k, 'PMID:' || l_partkey || ';' AS citation, 's' || l_suppkey AS span FROM lineitem WHERE l_returnflag = 'N')
"""


def oracle_sql() -> dict[str, str]:
    outside = "has a value outside its list"
    return {
        "session_receipts": _FIELDS + "SELECT 'p' AS provider_id, 'r1' AS release_id, 'rc' AS receipt_id, count(*) AS rows FROM f UNION ALL SELECT 'q', 'r2', 'rd', count(*) FROM t",
        "session_replaced_terms": _FIELDS + "SELECT node_id, label, is_obsolete, CASE WHEN is_obsolete THEN 'C:' || (c_custkey + 1) END AS replaced_by FROM t",
        "session_mechanisms": _FIELDS + "SELECT field_prefix, mechanism, description, source_row_id FROM m",
        "session_scores": _FIELDS + "SELECT source_row_id, round(cosine, 6) AS cosine FROM s",
        "session_evidence": _FIELDS + "SELECT source_row_id, mechanism, field_path, reference FROM v",
        "session_cited_references": _FIELDS + "SELECT m.mechanism, round(s.cosine, 6) AS cosine, count(v.reference) AS cited_references FROM s JOIN m USING (source_row_id) LEFT JOIN v USING (source_row_id) GROUP BY m.mechanism, s.cosine",
        "session_best_cited": _FIELDS + """
, best AS (SELECT m.source_row_id FROM s JOIN m USING (source_row_id) WHERE EXISTS (SELECT 1 FROM v WHERE v.source_row_id = m.source_row_id) ORDER BY s.cosine DESC, m.source_id, m.source_row_id LIMIT 1)
SELECT v.mechanism, v.reference, u.value AS supports, v.field_path FROM v JOIN best USING (source_row_id) LEFT JOIN f u ON u.source_id = v.source_id AND u.field_path = regexp_replace(v.field_path, '/reference$', '/supports')""",
        "session_disease_terms": _FIELDS + "SELECT f.value AS disease_id, t.label AS term_label, 'r1' AS record_release, 'r2' AS term_release, count(*) AS n FROM f JOIN t ON t.node_id = f.value WHERE f.field_path = '/disease_term/term/id' GROUP BY 1, 2",
        "maxsim_token_blocks": """
WITH s AS (SELECT e.vec_id // 8 AS block, q.vec_id AS qi, max(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS best FROM embeddings e, embeddings q WHERE q.vec_id < 4 GROUP BY 1, 2)
SELECT block, round(sum(best), 5) AS score FROM s GROUP BY 1""",
        "late_interaction_block": """
WITH q AS (SELECT vec_id - vec_id % 50 AS query_id, vec_id % 50 AS t, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 < 3),
b AS (SELECT query_id, t, vec_id // 8 AS block_id, max(list_cosine_similarity(embedding::DOUBLE[], q)) AS s, count(*) AS n FROM embeddings, q GROUP BY 1, 2, 3),
x AS (SELECT query_id, block_id, sum(s) AS score, max(n) AS n FROM b GROUP BY 1, 2)
SELECT query_id, block_id, round(score, 5) AS score, n AS candidate_token_count FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, block_id) <= 10""",
        "session_ranked_mechanisms": _ASKED + """
SELECT question_id, r AS rank, score, mechanism, source_row_id, coalesce(c, 0) AS cited_references FROM x WHERE r <= 5""",
        "session_best_evidence": _ASKED + """
, y AS (SELECT * FROM x WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY r) = 1)
SELECT question_id, y.mechanism, v.reference, s.value AS supports, v.field_path, y.source_row_id FROM y JOIN v USING (source_row_id) LEFT JOIN f s ON s.source_id = v.source_id AND s.field_path = regexp_replace(v.field_path, '/reference$', '/supports')""",
        "hypothesis_links": """
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '/shared' ELSE '/order/' || o_orderkey END AS path, 'customer ' || o_custkey || ' of ' || o_orderpriority AS value FROM orders),
n AS (SELECT path, count(*) AS n FROM f GROUP BY 1),
l AS (SELECT *, concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS id, l_linenumber + l_partkey AS k FROM lineitem),
m AS (SELECT id, l_returnflag AS flag, CASE k % 4 WHEN 1 THEN 'customer ' WHEN 2 THEN 'o' WHEN 3 THEN 'nothing' END AS t, value, f.o_orderkey, CASE WHEN k % 3 <> 0 THEN 1 ELSE n.n END AS n FROM l JOIN f ON o_orderkey = l_orderkey JOIN n USING (path)),
r AS (SELECT *, CASE WHEN flag NOT IN ('R', 'A') THEN 'evidence_role has a value outside its list' WHEN n <> 1 THEN 'field_path must resolve to exactly one source field'
  WHEN t IS NOT NULL AND len(string_split(value, t)) <> 2 THEN 'text must occur exactly once in the source field' END AS reason FROM m)
SELECT id AS hypothesis_id, reason, CASE WHEN reason IS NULL THEN 'row' || o_orderkey END AS source_record_id, CASE WHEN reason IS NULL THEN CASE WHEN t IS NULL THEN 0 ELSE strpos(value, t) - 1 END END::INTEGER AS start_offset,
  CASE WHEN reason IS NULL THEN CASE WHEN t IS NULL THEN length(value) ELSE strpos(value, t) - 1 + length(t) END END::INTEGER AS end_offset, CASE WHEN reason IS NULL THEN coalesce(t, value) END AS source_span FROM r""",
        "contribution_gates": """
SELECT o_orderkey::VARCHAR AS hypothesis_id, CASE WHEN o_orderkey % 4 IN (0, 3) THEN 'the hypothesis is neither accepted nor revised' WHEN o_custkey % 3 = 0 OR o_custkey % 9 = 1 THEN 'the judgment does not support it'
  WHEN o_custkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'missing evidence or a contradiction is open' WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') THEN 'no supporting span is cited' END AS reason FROM orders""",
        "store_replaced_vectors": "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * CASE WHEN vec_id % 50 = 0 THEN 4 ELSE 1 END, 5) AS square FROM embeddings",
        "store_graph_versions": """
WITH n AS (SELECT count(*) AS n FROM nation), c AS (SELECT count(*) AS c, count(*) FILTER (c_nationkey % 2 = 0) AS e FROM customer),
x AS (SELECT unnest([1, 2, 3]) AS version), y AS (SELECT unnest(['nodes', 'aliases', 'alias_index', 'edges']) AS relation)
SELECT version::INTEGER AS version, relation, (CASE WHEN version = 3 AND relation = 'nodes' THEN e WHEN relation = 'edges' THEN CASE WHEN version = 1 THEN 0 ELSE c END WHEN version = 1 THEN n ELSE n + c END)::BIGINT AS n FROM n, c, x, y""",
        "store_recorded_judgments": """
SELECT 'judgment:' || i AS judgment_id, i AS subject_id, CASE l_returnflag WHEN 'R' THEN 'drop' ELSE 'keep' END AS decision, NULL::VARCHAR AS model, true AS timed
FROM (SELECT DISTINCT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i, l_returnflag FROM lineitem)""",
        "facts_import": """
SELECT DISTINCT 'D:' || (l_partkey % 500) AS disease_id, 'P:' || l_suppkey AS phenotype_id, 'biolink:has_phenotype' AS predicate, strftime(o_orderdate, '%Y-%m') AS release_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "late_interaction_pruned": """
WITH q AS (SELECT vec_id - vec_id % 50 AS query_id, vec_id % 50 AS t, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 < 3),
b AS (SELECT query_id, t, vec_id // 8 AS block_id, max(list_cosine_similarity(embedding::DOUBLE[], q)) AS s, arg_max(vec_id, (list_cosine_similarity(embedding::DOUBLE[], q), -vec_id)) AS v, count(*) AS n FROM embeddings, q GROUP BY 1, 2, 3),
x AS (SELECT query_id, block_id, sum(s) AS score, max(n) AS n, count(*) AS m, string_agg((v % 8)::VARCHAR, ',' ORDER BY t) AS i, string_agg('<' || v || '>', '' ORDER BY t) AS w FROM b GROUP BY 1, 2)
SELECT query_id, block_id, round(score, 5) AS score, round(score / m, 5) AS score_mean, m AS query_token_count, n AS candidate_token_count, i AS best_token_index, w AS best_token
FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, block_id) <= 10""",
        "observation_contexts": """
SELECT ['present', 'absent/negated', 'family_history', 'uncertain', 'conflict', 'unsupported', 'historical', 'family'][doc_id % 8 + 1] AS context_status, doc_id % 8 < 6 AS taken, count(*) AS n FROM documents WHERE length(text) > 3 GROUP BY 1, 2""",
        "negation_words": "SELECT o_orderkey, ['negated', 'negated', 'not_negated', 'malformed', 'malformed', 'malformed', 'malformed', 'not_provided', 'malformed'][o_orderkey % 9 + 1] AS negation_status FROM orders",
        "lexical_mentions": """
WITH a AS (SELECT DISTINCT 'item:' || item_id AS node_id, array_to_string((list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))[1:3], ' ') AS alias FROM benchmark),
p AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9]+') AS t, string_split_regex(text, '[A-Za-z0-9]+') AS g FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, t, g FROM p),
v AS (SELECT doc_id, i, lower(t[i]) AS w, length(t[i]) AS n, length(g[i]) AS m FROM u),
k AS (SELECT doc_id, i, w, n, sum(n + m) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM v),
s AS (SELECT doc_id, i, e - n AS a, lead(e, 2) OVER o AS z, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS alias FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
x AS (SELECT *, count(*) OVER (PARTITION BY doc_id, i) AS c FROM s JOIN a USING (alias))
SELECT doc_id, doc_id || ':' || lpad((3 * i)::VARCHAR, 6, '0') || CASE WHEN c > 1 THEN ':' || node_id ELSE '' END AS mention_id, sha256(substr(text, (x.a + 1)::BIGINT, (z - x.a)::BIGINT)) AS span_sha256, 1.0::DOUBLE AS score, 'lexical_alias' AS method
FROM x JOIN p USING (doc_id)""",
        "judged_mentions": """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS n FROM lineitem)
SELECT 'judgment:' || l_orderkey || '/' || n AS judgment_id, CASE WHEN n % 2 = 0 THEN 'P:' || l_partkey END AS object_id, CASE WHEN n % 2 = 0 THEN 'keep' ELSE 'drop' END AS decision, 0.25::DOUBLE AS confidence, 'stand-in' AS model FROM l""",
        "contribution_terms": _CITED + f"""
, c AS (SELECT x.*, x.k % 5 AS r, EXISTS (SELECT 1 FROM s WHERE s.k = x.k AND contains('see PMID:' || coalesce(x.part::VARCHAR, 'none') || '; and more', s.citation)) AS cited FROM x)
SELECT k::VARCHAR AS hypothesis_id, CASE WHEN r = 4 THEN 'contribution_type {outside}' WHEN r < 2 AND c % 4 = 0 THEN 'new_term needs Label' WHEN r = 1 THEN 'parent must hold a MONDO identifier'
  WHEN NOT cited THEN 'the text must hold a supporting citation' WHEN r = 3 THEN 'orcid must be four groups of an ORCID' END AS reason FROM c""",
        "contribution_records": _CITED + f"""
, c AS (SELECT x.*, x.k % 6 AS r, EXISTS (SELECT 1 FROM s WHERE s.k = x.k AND s.citation = 'PMID:' || x.part || ';' AND s.span = 's' || x.supplier) AS cited FROM x WHERE part IS NOT NULL)
SELECT k::VARCHAR AS hypothesis_id, CASE WHEN r = 5 THEN 'disease_term needs an id that is MONDO: and digits' WHEN r = 4 THEN 'biological_scale {outside}' WHEN r = 3 THEN 'evidence explanation needs text' WHEN r = 1 THEN 'evidence must be of the kind SUPPORT'
  WHEN r = 2 THEN 'evidence_source {outside}' WHEN NOT cited THEN 'reference and snippet must be one cited support' END AS reason FROM c""",
        "contribution_associations": _CITED + f"""
, c AS (SELECT x.*, x.k % 7 AS r, EXISTS (SELECT 1 FROM s WHERE s.k = x.k AND s.citation = 'PMID:' || x.part || ';') AS cited FROM x WHERE part IS NOT NULL)
SELECT k::VARCHAR AS hypothesis_id, CASE WHEN r = 1 THEN 'subject must be a CURIE' WHEN r = 2 THEN 'predicate {outside}' WHEN r = 3 THEN 'primary_knowledge_source needs the prefix infores' WHEN r = 4 THEN 'agent_type {outside}'
  WHEN NOT cited THEN 'publications must hold a supporting citation' WHEN r = 5 THEN 'has_evidence must be CURIEs' END AS reason FROM c""",
    }
