"""From a source record's fields to ranked mechanisms and the citations that the source itself gives for them.

``fields`` are flattened records (provider_id, release_id, source_id, receipt_id, source_row_id, field_path, value).
Sibling fields and evidence are found by equal keys: the prefix of a path is a column, so no path pattern is ever built
from data and every join is an equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbena.functions import vectors as V
from verbena.functions.providers import EmbeddingProvider, embedding_batch
from verbena.operators import retrieval
from verbena.shared import materialize

RELEASE = ("provider_id", "release_id", "source_id")
ROW = (*RELEASE, "source_row_id")


def source_receipts(*relations: DataFrame) -> DataFrame:
    """Rows by provider, release and receipt over all relations."""
    keys = ["provider_id", "release_id", "receipt_id"]
    rows = [r.groupBy(*keys).agg(F.count("*").alias("rows")) for r in relations]  # each is small before they meet
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy(*keys).agg(F.sum("rows").alias("rows"))


def replaced_terms(terms: DataFrame, obsolescence: DataFrame) -> DataFrame:
    """Terms with what replaces them; a term that nothing replaces stays."""
    by = obsolescence.where("tag = 'replaced_by'").select("node_id", F.col("value").alias("replaced_by"))
    return terms.join(by, "node_id", "left").select("node_id", "label", "is_obsolete", "replaced_by")


def _with_prefix(fields: DataFrame, pattern: str) -> DataFrame:
    """Fields whose path matches ``pattern``, with its first group as ``field_prefix``."""
    return fields.where(F.col("field_path").rlike(pattern)).withColumn("field_prefix", F.regexp_extract("field_path", pattern, 1))


def mechanisms(fields: DataFrame, section: str = "pathophysiology") -> DataFrame:
    """Descriptions of a section's entries, each with its sibling name."""
    at = lambda leaf: _with_prefix(fields, f"^(/{section}/[0-9]+)/{leaf}$")
    names = at("name").select(*RELEASE, "field_prefix", F.col("value").alias("mechanism"))
    return at("description").join(names, [*RELEASE, "field_prefix"]).select("field_prefix", "mechanism", F.col("value").alias("description"), *RELEASE, "receipt_id", "source_row_id")


def mechanism_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """Each row's inner product with one query vector (a literal, so nothing is joined)."""
    return vectors.select(*ROW, V.dot(F.col("embedding"), F.array(*map(F.lit, map(float, query)))).alias("cosine"))


def mechanism_evidence(found: DataFrame, fields: DataFrame, section: str = "pathophysiology") -> DataFrame:
    """References that the source cites for each mechanism."""
    cited = _with_prefix(fields, f"^(/{section}/[0-9]+)/evidence/[0-9]+/reference$").select(*RELEASE, "field_prefix", "field_path", F.col("value").alias("reference"))
    return found.select(*ROW, "mechanism", "field_prefix").join(cited, [*RELEASE, "field_prefix"]).select(*ROW, "mechanism", "field_prefix", "field_path", "reference")


def cited_references(found: DataFrame, scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """Scored mechanisms with how many references they have; those without any count zero.

    References are counted before they meet the scores, so a much cited mechanism is one row there.
    """
    n = evidence.groupBy(*ROW).agg(F.count("reference").alias("n"))
    x = scores.join(found.select(*ROW, "mechanism"), list(ROW)).join(n, list(ROW), "left")
    return x.groupBy("mechanism", "cosine").agg(F.sum(F.coalesce("n", F.lit(0))).alias("cited_references"))


def best_cited(found: DataFrame, scores: DataFrame, evidence: DataFrame, fields: DataFrame) -> DataFrame:
    """The evidence of the best mechanism that has any, and what each reference is said to do; ties by row keys."""
    ranked = scores.join(found.select(*ROW), list(ROW)).join(evidence, list(ROW), "left_semi")
    best = ranked.orderBy(F.desc("cosine"), *ROW).limit(1).select(*ROW)
    says = fields.where(F.endswith("field_path", F.lit("/supports"))).select(*RELEASE, F.regexp_replace("field_path", "/supports$", "/reference").alias("field_path"), F.col("value").alias("supports"))
    return evidence.join(F.broadcast(best), list(ROW)).join(says, [*RELEASE, "field_path"], "left").select("mechanism", "reference", "supports", "field_path")


def entries(fields: DataFrame, section: str = "pathophysiology") -> DataFrame:
    """``mechanisms`` with ``cited_references`` and ``n_evidence``, how many references and evidence fields each has.

    All fields of an entry meet in one shuffle, so fields are read once.
    """
    x = _with_prefix(fields, f"^(/{section}/[0-9]+)/(?:name|description|evidence/[0-9]+/reference)$").dropna(subset=list(RELEASE))
    name, text = F.endswith("field_path", F.lit("name")), F.endswith("field_path", F.lit("description"))
    at = x.groupBy("source_id", "field_prefix", "provider_id", "release_id").agg(  # sorted by what tells most first
        F.collect_list(F.when(name, F.struct("value"))).alias("names"), F.collect_list(F.when(text, F.struct("value", "receipt_id", "source_row_id"))).alias("texts"),
        F.count(F.when(~name & ~text, F.col("value"))).alias("cited_references"), F.count_if(~name & ~text).alias("n_evidence"),
    )
    one = at.withColumn("names", F.explode("names")).withColumn("texts", F.explode("texts"))
    return one.select("field_prefix", F.col("names.value").alias("mechanism"), F.col("texts.value").alias("description"), *RELEASE, "texts.receipt_id", "texts.source_row_id", "cited_references", "n_evidence")


#: Sources up to which the keys of those that a session found travel with the tasks that look for its evidence.
MAX_BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class MechanismSession:
    """``ranked``: each question's best mechanisms with the number of their references; ``best``: the evidence of the best one that has any.

    ``vectors``: all mechanisms that may be an answer, see ``mechanism_session``; ``asked`` (query_id, query).
    """

    fields: DataFrame
    vectors: DataFrame
    asked: DataFrame
    top_k: int
    section: str

    def _answers(self, rows: DataFrame, most: int) -> DataFrame:
        top = retrieval.embedding_search_block(rows, self.asked, metric="inner_product", top_k=most, alike=True)
        return top.select(F.col("query_id").alias("question_id"), "rank", "score", "mechanism", "description", *ROW, "field_prefix", "cited_references")

    @cached_property
    def ranked(self) -> DataFrame:
        return self._answers(self.vectors, self.top_k).drop("field_prefix")

    @cached_property
    def best(self) -> DataFrame:
        first = materialize(self._answers(self.vectors.where("n_evidence > 0"), 1).select("question_id", "mechanism", *ROW, "field_prefix"), "first")
        sources, near = first.select(*RELEASE).distinct(), self.fields.select(*RELEASE, "field_path", "value")
        if sources.count() <= MAX_BROADCAST_SOURCES:  # other sources' paths need not be matched then
            near = materialize(near.join(F.broadcast(sources), list(RELEASE), "left_semi"), "sources")
        cited = _with_prefix(near, f"^(/{self.section}/[0-9]+)/evidence/[0-9]+/reference$").withColumnRenamed("value", "reference")
        says = near.where(F.endswith("field_path", F.lit("/supports"))).select(*RELEASE, F.regexp_replace("field_path", "/supports$", "/reference").alias("field_path"), F.col("value").alias("supports"))
        met = first.join(cited, [*RELEASE, "field_prefix"]).join(says, [*RELEASE, "field_path"], "left")
        return met.select("question_id", "mechanism", "reference", "supports", "field_path", *ROW)


def mechanism_session(fields: DataFrame, questions: DataFrame, provider: EmbeddingProvider, top_k: int = 10, section: str = "pathophysiology") -> MechanismSession:
    """Mechanisms for a set of questions (question_id, question), ranked by the inner product of the provider's vectors.

    Descriptions and questions go through the provider batch by batch; each text is embedded once.  Ties go by the row
    keys as JSON.  Questions without text get no answer.

    Mechanisms with one description have one score, so only the first ``top_k`` of them by their keys can be answers, and the
    first ones with evidence; no others are embedded or searched.
    """
    found = entries(fields, section).where("description IS NOT NULL").withColumn("subject_id", F.to_json(F.struct(*ROW)))
    order = Window.partitionBy("description", F.col("n_evidence") > 0).orderBy("subject_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(1, top_k)).drop("place", "receipt_id")
    found = materialize(found, "mechanisms")
    parts = int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few short texts would else go to one task, and a provider may be slow
    texts = embedding_batch(found.select("description").repartition(parts, "description").distinct(), provider, "description", "description", "mechanism").drop("subject_id").withColumnRenamed("text", "description")
    vectors = materialize(found.join(texts, "description"), "vectors")
    asked = embedding_batch(questions, provider, "question_id", "question", "question")
    asked = materialize(asked.select(F.col("subject_id").alias("query_id"), F.col("embedding").alias("query")), "questions")
    return MechanismSession(fields, vectors, asked, top_k, section)


def disease_terms(fields: DataFrame, terms: DataFrame) -> DataFrame:
    """Disease identifiers of records with their ontology label; both releases and receipts stay visible."""
    d = fields.where("field_path = '/disease_term/term/id'").select(F.col("value").alias("disease_id"), F.col("release_id").alias("record_release"), F.col("receipt_id").alias("record_receipt"))
    t = terms.select(F.col("node_id").alias("disease_id"), F.col("label").alias("term_label"), F.col("release_id").alias("term_release"), F.col("receipt_id").alias("term_receipt"))
    return d.join(t, "disease_id")
