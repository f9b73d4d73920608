"""The training-data operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, compression, decontam, divergence, importance, licenses, packing, quotation, secrets, simhash, token_counts, toxicity, warc
from .common import table


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link_quotes(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents", "doc_id", "text")))


def op4_toxicity_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op5_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.verdicts(compression.compression_bands(table(spark, sf_dir, "documents", "doc_id", "text")))


def op7_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_pairs(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents", "lang", "source", "text"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain patterns' counts alone, as SQL can count them."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain quality rules alone, as SQL can count them."""
    return op6_compression_bands(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = (
    op1_quotation_linking, op2_length_buckets, op3_secret_scan, op4_toxicity_viterbi, op5_attention_scores,
    op6_compression_bands, op7_license_alignment, op8_simhash_pivots, op9_containment_search, op10_warc_revisits,
    op11_source_divergence, op12_importance_resampling, op13_token_counts, secret_base_counts, quality_base_counts,
)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def llm_oracle_sql() -> dict[str, str]:
    return {
        "op9_containment_search": decontam.ORACLE_SQL, "op10_warc_revisits": warc.ORACLE_SQL, "secret_base_counts": secrets.BASE_SQL, "quality_base_counts": compression.BASE_SQL,
        "op11_source_divergence": divergence.ORACLE_SQL, "op12_importance_resampling": importance.ORACLE_SQL,
    }
