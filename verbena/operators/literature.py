"""Append-only literature snapshots: the articles visible at a cutoff, and literal passages in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena import contracts as C
from verbena.functions import text as X

VERSION_KEY = ["provider_id", "article_id", "pmid", "version_id", "source_ordinal"]


def last_events(articles: DataFrame) -> DataFrame:
    """The last event of each article (partial aggregation, no window)."""
    rest = [c for c in articles.columns if c not in ("provider_id", "article_id")]
    last = articles.groupBy("provider_id", "article_id").agg(F.max_by(F.struct(*rest), "source_ordinal").alias("v"))
    return last.select("provider_id", "article_id", *(F.col(f"v.{c}").alias(c) for c in rest))


def visible_versions(articles: DataFrame, high_water_ordinal: int) -> DataFrame:
    """The last event of each article up to the cutoff, without deleted ones."""
    return last_events(articles.where(F.col("source_ordinal") <= high_water_ordinal)).where(~F.col("is_deleted"))


def literature_snapshot_catalog(snapshots: DataFrame) -> DataFrame:
    """Snapshots by provider and id with their cutoff; ``effective_at`` is optional."""
    x = _snapshot_columns(snapshots)
    C.check_relations(_snapshots(x))
    return x


def _snapshot_columns(snapshots: DataFrame) -> DataFrame:
    C.columns(snapshots, ["provider_id", "snapshot_id", "high_water_ordinal"], "snapshots")
    x = C.with_defaults(snapshots, {"effective_at": T.TimestampType()}).select("provider_id", "snapshot_id", "high_water_ordinal", "effective_at")
    C.typed(x, ["high_water_ordinal"], (T.NumericType,), "snapshots")
    C.typed(x, ["effective_at"], (T.TimestampType,), "snapshots")
    return x


def _snapshots(x: DataFrame) -> C.Relation:
    cut = F.col("high_water_ordinal").cast("double")
    rules = [*C.required_text("provider_id", "snapshot_id"), ("high_water_ordinal must be a finite whole number", ~F.coalesce((cut == F.floor(cut)) & (F.abs(cut) < float("inf")), F.lit(False)))]
    return C.Relation(x, "snapshots", rules, [["provider_id", "snapshot_id"]])


@C.takes_tables
def literature_retrieve(articles: DataFrame, sections: DataFrame, snapshots: DataFrame, query: str, provider_id: str, snapshot_id: str, section_names: list[str] | None = None) -> DataFrame:
    """Exact spans of ``query``, in either case, in the sections of the snapshot's visible articles."""
    if not query:
        raise C.ContractError("query must be non-empty text")
    C.columns(articles, [*VERSION_KEY, "is_deleted"], "articles")
    C.columns(sections, [*VERSION_KEY, "section", "text"], "sections")
    snapshots = _snapshot_columns(snapshots)
    once = lambda c: (f"{c} must be present", F.col(c).isNull())
    C.check_relations(
        _snapshots(snapshots),
        C.Relation(sections, "sections", [*C.required_text("provider_id", "article_id", "pmid", "version_id", "section", "text"), once("source_ordinal")], needed=[("version", VERSION_KEY, "sections must bind a supplied article version")]),
        C.Relation(
            articles, "articles", [*C.required_text("provider_id", "article_id", "pmid", "version_id"), once("source_ordinal"), once("is_deleted")],
            [["provider_id", "article_id", "version_id"], ["provider_id", "article_id", "source_ordinal"]], [("version", VERSION_KEY)],
        ),
    )
    s = snapshots.where((F.col("provider_id") == provider_id) & (F.col("snapshot_id") == snapshot_id)).take(2)
    if len(s) != 1:
        raise C.ContractError("snapshot must be known, once")
    x = C.with_defaults(sections, {"subsection": T.StringType(), "source_entity_ordinal": T.IntegerType()}).where(F.col("provider_id") == provider_id)
    x = x.where(F.col("section").isin(section_names)) if section_names is not None else x
    x = x.join(visible_versions(articles.where(F.col("provider_id") == provider_id), s[0]["high_water_ordinal"]).select(*VERSION_KEY), VERSION_KEY, "left_semi")
    x = X.literal_hits(x, "text", query)
    return x.select(
        "provider_id", F.lit(snapshot_id).alias("snapshot_id"), F.lit(s[0]["high_water_ordinal"]).alias("high_water_ordinal"), F.lit(s[0]["effective_at"]).cast("timestamp").alias("effective_at"), "article_id", "pmid", "version_id", "source_ordinal", "section",
        "h.start_offset", "h.end_offset", F.substring("text", F.col("h.start_offset") + 1, F.col("h.end_offset") - F.col("h.start_offset")).alias("source_text"), F.col("text").alias("section_text"), "subsection", "source_entity_ordinal",
    )
