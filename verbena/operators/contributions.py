"""Reviewed hypotheses as contributions to public resources: a gate, three payload contracts and pinned schemas.

Payloads are relations, one row per contribution (or association), so any number is checked in one plan.  A payload's
citations meet the support that its hypothesis cites in a semi-join; nothing is gathered by hypothesis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena import contracts as C
from verbena.functions.text import nonblank
from verbena.operators import hypotheses as H

# Fields and accepted values of each target, and the schemas they follow (fixed values).
MONDO_FIELDS = ("contribution_type", "Label", "description", "parent", "synonyms", "synonym-type", "children", "orcid", "website_url", "additional_information", "term", "suggested_revision")
MONDO_TYPES = {
    "new_term": (("Label", "description", "parent"), ("synonyms", "synonym-type", "children", "orcid", "website_url", "additional_information")),
    "revise_definition": (("term", "suggested_revision", "orcid"), ()),
}
EVIDENCE_SOURCES = ("HUMAN_CLINICAL", "MODEL_ORGANISM", "IN_VITRO", "COMPUTATIONAL", "OTHER")
QUOTE_ROLES = ("PRIMARY_RESULT", "BACKGROUND", "REVIEW_SYNTHESIS")
SCALES = ("MOLECULAR", "CELLULAR", "TISSUE", "ORGANISM")
DISMECH_EVIDENCE = ("reference", "supports", "evidence_source", "quote_role", "snippet", "explanation")
MONARCH_TEXT = ("subject", "predicate", "object", "primary_knowledge_source", "knowledge_level", "agent_type")
PREDICATES = ("biolink:causes", "biolink:contributes_to", "biolink:gene_associated_with_condition", "biolink:has_phenotype")
KNOWLEDGE_LEVELS = ("knowledge_assertion", "logical_entailment", "prediction", "statistical_association")
AGENT_TYPES = ("manual_agent", "automated_agent", "data_analysis_pipeline", "computational_model", "text_mining_agent", "image_processing_agent", "manual_validation_of_automated_agent")
CURIE = r"^[A-Za-z][A-Za-z0-9_.-]*:\S+$"
SCHEMAS = (
    ("mondo", "https://github.com/monarch-initiative/mondo", "bcff665c1db253380ef14f06fc390bc0b66420d0", ".github/ISSUE_TEMPLATE/03add-term.yml"),
    ("mondo", "https://github.com/monarch-initiative/mondo", "bcff665c1db253380ef14f06fc390bc0b66420d0", ".github/ISSUE_TEMPLATE/06revise-textual-definition.md"),
    ("dismech", "https://github.com/monarch-initiative/dismech", "3e6cb8631b383355d9b590e5930a38f1813f9094", "src/dismech/schema/dismech.yaml"),
    ("monarch", "https://github.com/biolink/biolink-model", "v4.4.6; monarch-ingest 289efde68e817beeced342a5c80ba91cf0d53116", "biolink-model.yaml; KGX edge TSV"),
)

SCOPES = {
    "mondo": "fields of the pinned issue templates and a supporting citation", "dismech": "pinned disease, pathophysiology and evidence fields with their values",
    "monarch": "pinned association predicates and provenance values",
}

Rules = list[tuple[str, Column]]


def schema(spark: SparkSession, target: str) -> DataFrame:
    """The pinned schemas of a target; the target's own checks are still due before a submission, which is not made here."""
    rows = [(*s, f"{SCOPES[target]}; the target's own review comes after, and nothing is submitted") for s in SCHEMAS if s[0] == target]
    return spark.createDataFrame(rows, "target string, schema_uri string, schema_revision string, schema_path string, validation_scope string")


def gate_violations(hypotheses: DataFrame, sources: DataFrame) -> DataFrame:
    """(hypothesis_id, reason): why a hypothesis cannot become a contribution, null if it can."""
    support = sources.where("evidence_role = 'support'").select(F.col("hypothesis_id").alias("s_id")).distinct()
    x = hypotheses.join(support, F.col("hypothesis_id") == F.col("s_id"), "left")
    rules = [
        ("the hypothesis is neither accepted nor revised", ~F.coalesce(F.col("review_status").isin("accepted", "revised"), F.lit(False))), ("the judgment does not support it", ~F.coalesce(F.col("judgment") == "supports", F.lit(False))),
        ("missing evidence or a contradiction is open", F.col("missing_evidence").isNotNull() | F.col("contradiction").isNotNull()), ("no supporting span is cited", F.col("s_id").isNull()),
    ]
    return x.select("hypothesis_id", _first(rules).alias("reason"))


def _first(rules: Rules) -> Column:
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(m)) for m, bad in rules))


def _not_in(c: Column, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(c.isin(*values), F.lit(False))


def _lacks(c: Column, pattern: str) -> Column:
    return ~F.coalesce(c.rlike(pattern), F.lit(False))


def _numbered(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("payload_row", F.monotonically_increasing_id())


def _support(sources: DataFrame) -> DataFrame:
    return sources.where("evidence_role = 'support'").select(F.col("hypothesis_id").alias("s_id"), F.col("citation").alias("s_citation"), F.col("source_span").alias("s_span")).distinct()


def _with_flag(x: DataFrame, met: DataFrame, name: str) -> DataFrame:
    """``x`` with whether its row is in ``met``, rows (payload_row)."""
    return x.join(met.select("payload_row").distinct().withColumn(name, F.lit(True)), "payload_row", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def mondo_violations(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """``payloads`` (hypothesis_id and fields of MONDO_FIELDS; an absent field is null) with ``reason``."""
    C.columns(payloads, ["hypothesis_id", "contribution_type"], "payloads")
    extra = [c for c in payloads.columns if c not in ("hypothesis_id", *MONDO_FIELDS)]
    if extra:
        raise C.ContractError(f"Mondo payload has unexpected fields: {', '.join(extra)}")
    given = payloads.columns
    x = _numbered(payloads).withColumns({f: F.lit(None).cast("string") for f in MONDO_FIELDS if f not in given})
    is_ = lambda t: F.col("contribution_type") == t
    text = F.when(is_("new_term"), F.col("description")).otherwise(F.col("suggested_revision"))
    s = _support(sources)
    cited = x.select("payload_row", "hypothesis_id", text.alias("t")).join(s, (F.col("hypothesis_id") == F.col("s_id")) & F.contains("t", F.col("s_citation")), "left_semi")
    x = _with_flag(x, cited, "cited")
    col = lambda f: F.col(f"`{f}`")
    rules: Rules = [("contribution_type has a value outside its list", _not_in(F.col("contribution_type"), tuple(MONDO_TYPES)))]
    for t, (needed, allowed) in MONDO_TYPES.items():
        rules += [(f"{t} needs {f}", is_(t) & ~nonblank(col(f))) for f in needed]
        rules += [(f"{t} has no {f}", is_(t) & col(f).isNotNull()) for f in MONDO_FIELDS[1:] if f not in (*needed, *allowed)]
    rules += [
        ("parent must hold a MONDO identifier", is_("new_term") & _lacks(F.col("parent"), "MONDO:[0-9]+")), ("term must hold a MONDO identifier", is_("revise_definition") & _lacks(F.col("term"), "MONDO:[0-9]+")),
        ("the text must hold a supporting citation", ~F.col("cited")), ("orcid must be four groups of an ORCID", F.col("orcid").isNotNull() & _lacks(F.col("orcid"), "^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9X]{4}$")),
    ]
    return x.select(*(col(c) for c in given), _first(rules).alias("reason"))


def dismech_violations(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """``payloads`` (hypothesis_id, name, disease_term struct<id,label>, pathophysiology array of entries) with ``reason``.

    An entry has name, biological_scale, description and evidence, an array of structs of DISMECH_EVIDENCE (and
    reference_title, directness).  Each reference and snippet must be one support that the hypothesis cites.
    """
    C.columns(payloads, ["hypothesis_id", "name", "disease_term", "pathophysiology"], "payloads")
    x = _numbered(payloads)
    entries, evidence = F.col("pathophysiology"), F.flatten(F.transform("pathophysiology", lambda e: e["evidence"]))
    pairs = x.select("payload_row", "hypothesis_id", F.explode(evidence).alias("e"))
    s = _support(sources)
    lost = pairs.join(s, (F.col("hypothesis_id") == F.col("s_id")) & (F.col("e.reference") == F.col("s_citation")) & (F.col("e.snippet") == F.col("s_span")), "left_anti")
    x = _with_flag(x, lost, "unmatched")
    any_entry = lambda bad: F.exists(entries, lambda e: F.coalesce(bad(e), F.lit(True)))
    any_evidence = lambda bad: F.exists(evidence, lambda e: F.coalesce(bad(e), F.lit(True)))
    rules: Rules = [
        ("name needs text", ~nonblank(F.col("name"))), ("disease_term needs an id that is MONDO: and digits", _lacks(F.col("disease_term.id"), "^MONDO:[0-9]+$")), ("disease_term label needs text", ~nonblank(F.col("disease_term.label"))),
        ("pathophysiology must not be empty", F.coalesce(F.size(entries) < 1, F.lit(True))),
        *((f"pathophysiology {f} needs text", any_entry(lambda e, f=f: ~nonblank(e[f]))) for f in ("name", "description")),
        ("biological_scale has a value outside its list", any_entry(lambda e: _not_in(e["biological_scale"], SCALES))), ("pathophysiology evidence must not be empty", any_entry(lambda e: F.size(e["evidence"]) < 1)),
        *((f"evidence {f} needs text", any_evidence(lambda e, f=f: ~nonblank(e[f]))) for f in DISMECH_EVIDENCE),
        ("evidence must be of the kind SUPPORT", any_evidence(lambda e: e["supports"] != "SUPPORT")), ("evidence_source has a value outside its list", any_evidence(lambda e: _not_in(e["evidence_source"], EVIDENCE_SOURCES))),
        ("quote_role has a value outside its list", any_evidence(lambda e: _not_in(e["quote_role"], QUOTE_ROLES))), ("reference and snippet must be one cited support", F.col("unmatched")),
    ]
    return x.select(*payloads.columns, _first(rules).alias("reason"))


def monarch_violations(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Associations (hypothesis_id, MONARCH_TEXT, arrays publications and has_evidence) with ``reason``."""
    C.columns(payloads, ["hypothesis_id", *MONARCH_TEXT, "publications", "has_evidence"], "payloads")
    x = _numbered(payloads)
    cited = x.select("payload_row", "hypothesis_id", F.explode("publications").alias("p")).join(_support(sources), (F.col("hypothesis_id") == F.col("s_id")) & (F.col("p") == F.col("s_citation")), "left_semi")
    x = _with_flag(x, cited, "cited")
    rules: Rules = [
        *((f"{c} needs text", ~nonblank(F.col(c))) for c in MONARCH_TEXT), *((f"{c} must be a CURIE", _lacks(F.col(c), CURIE)) for c in ("subject", "object")), ("predicate has a value outside its list", _not_in(F.col("predicate"), PREDICATES)),
        ("primary_knowledge_source needs the prefix infores", _lacks(F.col("primary_knowledge_source"), "^infores:[A-Za-z0-9_.-]+$")), ("knowledge_level has a value outside its list", _not_in(F.col("knowledge_level"), KNOWLEDGE_LEVELS)),
        ("agent_type has a value outside its list", _not_in(F.col("agent_type"), AGENT_TYPES)), ("publications must hold a supporting citation", ~F.col("cited")),
        ("has_evidence must be CURIEs", ~F.coalesce((F.size("has_evidence") > 0) & F.forall("has_evidence", lambda e: F.coalesce(e.rlike(CURIE), F.lit(False))), F.lit(False))),
    ]
    return x.select(*payloads.columns, _first(rules).alias("reason"))


VALIDATORS = {"mondo": mondo_violations, "dismech": dismech_violations, "monarch": monarch_violations}


@C.takes_tables
def contribution(hypotheses: DataFrame, sources: DataFrame, source_fields: DataFrame, payloads: DataFrame, target: str) -> dict[str, DataFrame]:
    """hypothesis, sources, payload and schema of valid contributions; one broken rule refuses all of them."""
    if target not in VALIDATORS:
        raise C.ContractError(f"target must be one of {', '.join(VALIDATORS)}")
    hypotheses, sources = H.hypotheses(hypotheses, sources, source_fields)
    chosen = payloads.select("hypothesis_id").distinct()
    C.contained(chosen, hypotheses, ["hypothesis_id"], "a payload names no given hypothesis_id")
    gate = gate_violations(hypotheses.join(chosen, "hypothesis_id", "left_semi"), sources)
    for found in (gate, VALIDATORS[target](payloads, sources)):
        bad = found.where("reason IS NOT NULL").select("reason").take(1)
        if bad:
            raise C.ContractError(f"contribution: {bad[0]['reason']}")
    own = lambda df: df.join(chosen, "hypothesis_id", "left_semi")
    return {"hypothesis": own(hypotheses), "sources": own(sources), "payload": payloads, "schema": schema(payloads.sparkSession, target)}
