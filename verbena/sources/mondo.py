"""A disease ontology release as eight relations that all carry the release's receipt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena import contracts as C
from verbena.sources import receipts as R
from verbena.sources.obo import parse_obo

# Mapping predicates and tags of obsolete terms (fixed values).
MAPPINGS = ("skos:exactMatch", "skos:closeMatch", "skos:broadMatch", "skos:narrowMatch", "skos:relatedMatch")
OBSOLETE_TAGS = ("is_obsolete", "replaced_by", "consider")


def mondo_import(path: str, release: DataFrame, source_id: str | None = None, source_uri: str | None = None, sha256: str | None = None) -> dict[str, DataFrame]:
    """release, artifact, terms, synonyms, mappings, obsolescence, edges and tags of the one selected release.

    Obsolete terms stay, other ontologies' terms go; a tag's ``source_row_id`` is source#term:ordinal.  The bytes
    must match their receipt before anything is parsed; a term identifier that two stanzas share is refused.
    """
    spark = release.sparkSession
    artifact = R.artifact(release, source_id, source_uri, sha256)
    R.admit(spark, path, artifact["sha256"])
    graph = parse_obo(R.verified_text(spark, path, artifact["sha256"]), "MONDO", artifact["source_id"], include_obsolete=True)
    own = lambda df, c="node_id": df.where(F.startswith(c, F.lit("MONDO:")))
    terms = own(graph.nodes)
    C.unique(terms, ["node_id"], "Mondo identifiers")
    tags = own(graph.tags).withColumn("source_row_id", F.concat(F.lit(artifact["source_id"] + "#"), "node_id", F.lit(":"), F.col("tag_ordinal").cast("string")))
    gone = tags.where("tag = 'is_obsolete' AND lower(value) = 'true'").select("node_id").distinct().withColumn("is_obsolete", F.lit(True))
    predicate = F.split("value", " ")[0]
    return {
        "release": release,
        "artifact": R.stamp(spark.range(1), artifact).drop("id"),
        "terms": R.stamp(terms.join(gone, "node_id", "left").withColumn("is_obsolete", F.coalesce("is_obsolete", F.lit(False))), artifact),
        "synonyms": R.stamp(own(graph.aliases), artifact),
        "mappings": R.stamp(tags.where((F.col("tag") == "xref") | ((F.col("tag") == "property_value") & predicate.isin(*MAPPINGS) & F.contains("value", F.lit(" ")))), artifact),
        "obsolescence": R.stamp(tags.where(F.col("tag").isin(*OBSOLETE_TAGS)), artifact),
        "edges": R.stamp(own(graph.edges, "from_id"), artifact),
        "tags": R.stamp(tags, artifact),
    }
