"""A knowledge pack's edges and nodes as release-bound views, one for each pair of roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena import contracts as C
from verbena.operators import releases as R

# Relations of a pack, role names and categories of its views, and an endpoint's columns by suffix (fixed values).
RELATIONS = ("denormalized_edges", "nodes", "node_has_phenotype", "information_content")
ROLES = {
    "gene_disease": (("gene", "biolink:Gene"), ("disease", "biolink:Disease")),
    "disease_phenotype": (("disease", "biolink:Disease"), ("phenotype", "biolink:PhenotypicFeature")),
    "gene_phenotype": (("gene", "biolink:Gene"), ("phenotype", "biolink:PhenotypicFeature")),
}
# Columns of a pack's relations by kind: text, lists of text, numbers (fixed values).
TEXT, TEXTS, NUMBER = "text", "list of text", "number"
CONTRACT = {
    "denormalized_edges": {
        TEXT: (
            "id predicate category agent_type knowledge_level primary_knowledge_source file_source provided_by disease_context_qualifier original_predicate frequency_qualifier onset_qualifier "
            "sex_qualifier object_aspect_qualifier species_context_qualifier stage_qualifier qualifier object_specialization_qualifier negated subject object original_subject original_object grouping_key "
            "subject_label subject_category subject_namespace subject_taxon object_label object_category object_namespace object_taxon"
        ),
        TEXTS: "aggregator_knowledge_source has_evidence publications qualifiers subject_closure object_closure", NUMBER: "evidence_count",
    },
    "nodes": {TEXT: "id category name namespace", TEXTS: "xref synonym"},
    "information_content": {TEXT: "term", NUMBER: "ic"},
    "node_has_phenotype": {TEXT: "id", TEXTS: "has_phenotype has_phenotype_label has_phenotype_closure has_phenotype_closure_label", NUMBER: "has_phenotype_count"},
}
ENDPOINT = {"id": "", "label": "_label", "category": "_category", "namespace": "_namespace", "closure": "_closure", "taxon": "_taxon"}


def _is(kind: str, t: T.DataType) -> bool:
    if kind == TEXTS:
        return isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType)
    return isinstance(t, T.StringType if kind == TEXT else T.NumericType)


def check_pack(pack: dict[str, DataFrame]) -> None:
    """All four relations with all their columns in the contracted kinds; more columns may follow."""
    if missing := [r for r in RELATIONS if r not in pack]:
        raise C.ContractError(f"the pack is missing {', '.join(missing)}")
    for relation, kinds in CONTRACT.items():
        wanted = [(c, kind) for kind, names in kinds.items() for c in names.split()]
        C.columns(pack[relation], [c for c, _ in wanted], relation)
        if wrong := [f"{c} ({kind})" for c, kind in wanted if not _is(kind, pack[relation].schema[c].dataType)]:
            raise C.ContractError(f"{relation} has columns of other types: {', '.join(wrong)}")


def attached_pack(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The relations of a pack kept as a database of its own, which must not be the current one; it is only read."""
    C.identifier(database, "database")
    if database.lower() == spark.catalog.currentDatabase().lower():
        raise C.ContractError("a pack must not be the current database")
    return {r: spark.table(f"{database}.{r}") for r in RELATIONS if spark.catalog.tableExists(f"{database}.{r}")}


def role_view(associations: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Every association with its role status; role columns are filled only where the orientation is supported."""
    negation = R.negation_status(F.col("negated").cast("string"))
    status = R.role_status(F.col("subject"), F.col("object"), F.col("predicate"), negation, F.col("subject_category"), F.col("object_category"), first[1], second[1])
    x = associations.withColumns({"negation_status": negation, "association_status": status})
    forward, backward = F.col("association_status") == "supported_subject_to_object", F.col("association_status") == "supported_object_to_subject"
    sides = {f"{role}_{suffix}": (a + tail, b + tail) for (role, _), (a, b) in ((first, ("subject", "object")), (second, ("object", "subject"))) for suffix, tail in ENDPOINT.items()}
    return x.withColumns(
        {name: F.when(forward, F.col(a)).when(backward, F.col(b)) for name, (a, b) in sides.items()}
        | {"edge_id": F.col("id"), "source_subject": F.col("subject"), "source_object": F.col("object"), "source_direction": F.when(forward, "subject_to_object").when(backward, "object_to_subject")}
    )


@C.takes_tables
def project_pack(spark: SparkSession, pack: dict, releases: DataFrame, provider_id: str, release_id: str, prefix: str = "semantic_monarch") -> DataFrame:
    """Registers seven temporary views and returns their names; nothing is registered unless all of the pack is valid.

    ``pack`` holds the relations by name (see ``attached_pack``).
    """
    C.identifier(prefix)
    if not provider_id or not release_id or release_id.lower() == "latest":
        raise C.ContractError("release_id must name one exact release")
    check_pack(pack)
    catalog = R.monarch_release_catalog(releases)
    if len(catalog.where((F.col("provider_id") == provider_id) & (F.col("release_id") == release_id)).take(2)) != 1:
        raise C.ContractError("provider_id and release_id must identify exactly one release")
    bound = {k: pack[k].withColumns({"provider_id": F.lit(provider_id), "release_id": F.lit(release_id)}) for k in RELATIONS}
    views = {"associations": bound["denormalized_edges"]} | {k: role_view(bound["denormalized_edges"], *v) for k, v in ROLES.items()} | {k: bound[k] for k in RELATIONS[1:]}
    for name, df in views.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
    return spark.createDataFrame([(k, f"{prefix}_{k}", provider_id, release_id) for k in views], "relation string, view_name string, provider_id string, release_id string")
