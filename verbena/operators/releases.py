"""Release catalogs, as-of selection, release-bound facts, holdout audits and pack roles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena import contracts as C
from verbena.shared import materialize

# Role columns of each fact relation, and the predicate it takes when none is given (fixed values).
RELATIONS = {
    "gene_phenotype": (("gene_id", "phenotype_id"), "biolink:has_phenotype"),
    "gene_disease": (("gene_id", "disease_id"), "biolink:associated_with"),
    "disease_phenotype": (("disease_id", "phenotype_id"), "biolink:has_phenotype"),
}

#: Releases up to which a catalog is broadcast; beyond, facts meet it in a shuffle.
MAX_BROADCAST_RELEASES = 100_000


@C.takes_tables
def monarch_release_catalog(releases: DataFrame) -> DataFrame:
    C.columns(releases, ["provider_id", "release_id"], "releases")
    x = C.with_defaults(releases, {"effective_date": T.DateType(), "source_ordinal": T.DoubleType()})
    C.typed(x, ["effective_date"], (T.DateType, T.TimestampType), "releases")
    C.typed(x, ["source_ordinal"], (T.NumericType,), "releases")
    rules = [*C.required_text("provider_id", "release_id"), ("release_id must not be 'latest'", F.lower("release_id") == "latest"), ("a release needs a date or an ordinal", F.col("effective_date").isNull() & F.col("source_ordinal").isNull())]
    C.check_relations(C.Relation(x, "releases", rules, [["provider_id", "release_id"]]))
    return x


@C.takes_tables
def source_release_catalog(releases: DataFrame) -> DataFrame:
    C.columns(releases, ["provider_id", "release_id", "available_at", "receipt_id"], "releases")
    C.typed(releases, ["available_at"], (T.TimestampType,), "releases")
    rules = [*C.required_text("provider_id", "release_id", "receipt_id"), ("available_at must be present", F.col("available_at").isNull())]
    C.check_relations(C.Relation(releases, "releases", rules, [["provider_id", "release_id"], ["provider_id", "available_at"]]))
    return releases


def select_release(catalog: DataFrame, provider_id: str, release_id: str | None = None, as_of=None, as_of_ordinal: float | None = None, time_col: str = "effective_date"):
    """The one row that exactly one selector names: an id, the last at or before a time, or an ordinal."""
    if sum(v is not None for v in (release_id, as_of, as_of_ordinal)) != 1:
        raise C.ContractError("exactly one of release_id, as_of and as_of_ordinal must be given")
    x = catalog.where(F.col("provider_id") == provider_id)
    if release_id is not None:
        if release_id.lower() == "latest":
            raise C.ContractError("release_id must name a release, not 'latest'")
        x = x.where(F.col("release_id") == release_id)
    elif as_of is not None:
        is_date = isinstance(catalog.schema[time_col].dataType, T.DateType)
        if not isinstance(as_of, dt.date) or isinstance(as_of, dt.datetime) == is_date:
            raise C.ContractError(f"as_of must have the type of {time_col}")
        x = x.where(F.col(time_col) <= F.lit(as_of)).orderBy(F.desc(time_col), F.desc("release_id")).limit(1)
    else:
        x = x.where(F.col("source_ordinal") <= as_of_ordinal).orderBy(F.desc("source_ordinal"), F.desc("release_id")).limit(1)
    rows = x.take(1)
    if not rows:
        raise C.ContractError("no release matches the selection")
    return rows[0]


@C.takes_tables
def source_release_select(releases: DataFrame, provider_id: str, release_id: str | None = None, as_of=None):
    return select_release(source_release_catalog(releases), provider_id, release_id, as_of, time_col="available_at")


def _projected(facts: DataFrame, relation: str) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """The relation's columns with its default predicate, and the rules of a row; repeated rows still repeat."""
    roles, predicate = RELATIONS[relation]
    C.columns(facts, [*roles, "release_id", "provider_id", "source_version"], "facts")
    x = C.with_defaults(facts, {"predicate": T.StringType(), "attrs": T.StringType()})
    x = x.select(*roles, F.coalesce("predicate", F.lit(predicate)).alias("predicate"), "release_id", "provider_id", "source_version", "attrs")
    return x, C.required_text(*roles, "predicate", "release_id", "provider_id", "source_version")


def normalize_facts(facts: DataFrame, relation: str) -> DataFrame:
    x, rules = _projected(facts, relation)
    C.check(x, rules, "facts")
    return x.dropDuplicates()


def _met(facts: DataFrame, releases: DataFrame, relation: str) -> tuple[DataFrame, list[tuple[str, Column]], DataFrame]:
    """Facts beside their release, the rules of both, and the catalog."""
    catalog = monarch_release_catalog(releases)
    x, rules = _projected(facts, relation)
    known = catalog.select(F.col("provider_id").alias("kp"), F.col("release_id").alias("kr"), F.lit(True).alias("known"))
    known = F.broadcast(known) if known.count() <= MAX_BROADCAST_RELEASES else known
    met = x.join(known, (F.col("provider_id") == F.col("kp")) & (F.col("release_id") == F.col("kr")), "left")
    return met, [*rules, ("facts name a release that the catalog does not have", F.col("known").isNull())], catalog


def admitted_facts(facts: DataFrame, releases: DataFrame, relation: str) -> tuple[DataFrame, DataFrame]:
    """(facts, release catalog), both valid.  All rules and the catalog's releases are held against the facts in one
    aggregation without a shuffle of them; repeated rows still repeat, so a caller can narrow them down first."""
    met, rules, catalog = _met(facts, releases, relation)
    C.check(met, rules, "facts")
    return met.drop("kp", "kr", "known"), catalog


def selected_facts(facts: DataFrame, releases: DataFrame, relation: str, provider_id: str, *selections: dict) -> tuple[DataFrame, list]:
    """(distinct facts of the selected releases, the releases' catalog rows) in one pass over ``facts``.

    All facts are held against the rules while those of the selected releases are written to the shared folder; what a
    broken rule leaves there is not given back.
    """
    met, rules, catalog = _met(facts, releases, relation)
    chosen = [select_release(catalog, provider_id, **s) for s in selections]
    seen, verify = C.observed(met, rules, "facts")
    own = seen.where((F.col("provider_id") == provider_id) & F.col("release_id").isin(*(r["release_id"] for r in chosen)))
    kept = materialize(own.drop("kp", "kr", "known").dropDuplicates(), "facts")
    verify()
    return kept, chosen


@C.takes_tables
def monarch_import(facts: DataFrame, releases: DataFrame, relation: str, table: str | None = None, replace: bool = False) -> DataFrame:
    """Normalized facts of known releases; with ``table`` they are appended to it, or put in its place."""
    rows = admitted_facts(facts, releases, relation)[0].dropDuplicates()
    if table is not None:
        rows.write.mode("overwrite" if replace else "append").saveAsTable(C.identifier(table, "table"))
    return rows


@C.takes_tables
def monarch_query(facts: DataFrame, releases: DataFrame, relation: str, provider_id: str, release_id: str | None = None, as_of=None, as_of_ordinal=None):
    """(facts of the selected release, the release's catalog row)."""
    found, (chosen,) = selected_facts(facts, releases, relation, provider_id, {"release_id": release_id, "as_of": as_of, "as_of_ordinal": as_of_ordinal})
    return found, chosen


@C.takes_tables
def holdout_audit(facts: DataFrame, releases: DataFrame, provider_id: str, train_release_id: str, holdout_release_id: str) -> DataFrame:
    """Facts of the holdout release whose gene, disease and predicate the training release lacks."""
    if train_release_id == holdout_release_id:
        raise C.ContractError("training and holdout releases must differ")
    x, _ = selected_facts(facts, releases, "gene_disease", provider_id, {"release_id": train_release_id}, {"release_id": holdout_release_id})
    train, held = (x.where(F.col("release_id") == n) for n in (train_release_id, holdout_release_id))
    keys = ["gene_id", "disease_id", "predicate"]
    return held.join(train.select(*keys).distinct(), keys, "left_anti").select(*held.columns)


def negation_status(negated: Column) -> Column:
    v = F.lower(F.trim(negated))
    return F.when(negated.isNull() | (v == ""), "not_provided").when(v == "false", "not_negated").when(v == "true", "negated").otherwise("malformed")


def role_status(subject: Column, obj: Column, predicate: Column, negation: Column, subject_category: Column, object_category: Column, first: str, second: str) -> Column:
    """Why an association edge can or cannot fill a relation's two roles; the first case that holds."""
    empty = lambda c: c.isNull() | (F.trim(c) == "")
    shaped = lambda c: F.startswith(c, F.lit("biolink:"))
    return (
        F.when(empty(subject) | empty(obj), "missing_endpoint").when(empty(predicate), "missing_predicate").when(negation == "negated", "negated").when(negation == "malformed", "malformed_negation")
        .when(empty(subject_category) | empty(object_category), "missing_role_category").when(~shaped(subject_category) | ~shaped(object_category), "malformed_role_category")
        .when((subject_category == first) & (object_category == second), "supported_subject_to_object").when((subject_category == second) & (object_category == first), "supported_object_to_subject")
        .otherwise("unsupported_orientation")
    )
