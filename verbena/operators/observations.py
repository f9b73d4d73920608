"""Phenotype observations that must quote their document exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena import contracts as C

# The observation contract's columns and contexts (fixed values).
COLUMNS = ("document_id", "hpo_id", "start_offset", "end_offset", "source_text", "context_status", "method", "provider_id", "provider_version", "confidence", "status")
CONTEXTS = ("present", "absent/negated", "family_history", "uncertain", "conflict", "unsupported")


def hpo_observation_contract() -> tuple[str, ...]:
    return COLUMNS


def violations(documents: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations with ``reason``: the first rule each breaks, null if none."""
    d = documents.select(F.col("document_id").alias("d_id"), F.col("source_text").alias("d_text"))
    x = observations.join(d, F.col("document_id") == F.col("d_id"), "left")
    quoted = F.substring("d_text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    rules = [
        *C.required_text("document_id", "hpo_id", "source_text", "method", "provider_id", "provider_version"),
        ("hpo_id must look like HP:0000000", ~F.col("hpo_id").rlike("^HP:[0-9]{7}$")), ("context_status is unknown", ~F.col("context_status").isin(*CONTEXTS)), ("status must be accepted", F.coalesce(F.col("status") != "accepted", F.lit(True))),
        ("confidence must be from 0 to 1", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))), *C.offsets("start_offset", "end_offset"),
        ("document_id must be a supplied document", F.col("d_id").isNull()), ("span must lie inside the document", F.col("end_offset") > F.length("d_text")), ("span must reproduce source_text", ~F.coalesce(quoted == F.col("source_text"), F.lit(False))),
    ]
    reason = F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(m)) for m, bad in rules))
    return x.withColumn("reason", reason).drop("d_id", "d_text")


@C.takes_tables
def hpo_observations(documents: DataFrame, observations: DataFrame) -> DataFrame:
    """The observations in contract columns; raises with the reason if any breaks a rule."""
    C.columns(documents, ["document_id", "source_text"], "documents")
    C.columns(observations, COLUMNS, "observations")
    C.unique(documents, ["document_id"], "documents")
    bad = violations(documents, observations).where("reason IS NOT NULL").select("reason").take(1)
    if bad:
        raise C.ContractError(f"observations: {bad[0]['reason']}")
    return observations.select(*COLUMNS)


@C.takes_tables
def hpo_proband_present(observations: DataFrame) -> DataFrame:
    """Accepted observations of the proband itself, in contract columns; unknown contexts and other states are refused."""
    C.columns(observations, COLUMNS, "observations")
    rules = [("context_status is unknown", ~F.coalesce(F.col("context_status").isin(*CONTEXTS), F.lit(False))), ("status must be accepted", ~F.coalesce(F.col("status") == "accepted", F.lit(False)))]
    C.check(observations, rules, "observations")
    return observations.where("context_status = 'present'").select(*COLUMNS)
