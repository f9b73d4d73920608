"""Source bytes bound to SHA-256 receipts, and records flattened to JSON pointers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena import contracts as C
from verbena.functions.text import pointer_escape
from verbena.operators.releases import source_release_catalog


def admit(spark: SparkSession, path: str, sha256: str) -> bytes:
    """The bytes of one source file, once their digest equals the receipt; nothing is parsed before."""
    if not re.fullmatch("[0-9a-f]{64}", sha256 or ""):
        raise C.ContractError("sha256 must be 64 lower-case hex digits")
    rows = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("digest")).take(2)
    if len(rows) != 1:
        raise C.ContractError("a source must be one file")
    if rows[0]["digest"] != sha256:
        raise C.ContractError("source bytes do not match their SHA-256 receipt")
    return bytes(rows[0]["content"])


def verified_text(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """(file, value) of one text whose bytes are held against their receipt in the read that parses them."""
    x = spark.read.format("binaryFile").load(path)
    good = F.sha2("content", 256) == sha256
    text = F.when(good, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.lit("source bytes do not match their SHA-256 receipt")))
    return x.select(F.col("path").alias("file"), text.alias("value"))


def artifact(release: DataFrame, source_id: str | None, source_uri: str | None, sha256: str | None) -> dict:
    """The seven receipt values of the one selected release; given values come before the release's own."""
    chosen = release.take(2)
    if len(chosen) != 1:
        raise C.ContractError("release must be exactly one row")
    source_release_catalog(release)
    row = chosen[0].asDict()
    out = {n: row[n] for n in ("provider_id", "release_id", "available_at", "receipt_id")}
    for name, given in (("source_id", source_id), ("source_uri", source_uri), ("sha256", sha256)):
        out[name] = row.get(name) if given is None else given
        if not out[name]:
            raise C.ContractError(f"{name} is required")
    return out


def stamp(rows: DataFrame, artifact: dict) -> DataFrame:
    """The artifact's seven columns on every row."""
    names = ("provider_id", "release_id", "available_at", "receipt_id", "source_id", "source_uri", "sha256")
    return rows.select("*", *(F.lit(artifact[n]).alias(n) for n in names))


# Names of scalar types in flattened records (fixed values).
TYPE_NAMES = {str: "character", int: "integer", float: "double", bool: "logical", type(None): "null"}


def flatten(value, pointer: str = "") -> list[tuple[str, str, str | None]]:
    """(field_path, value_type, value) of each scalar at its JSON pointer; empty containers give nothing."""
    if isinstance(value, dict):
        return [r for k, v in value.items() for r in flatten(v, f"{pointer}/{pointer_escape(str(k))}")]
    if isinstance(value, list):
        return [r for i, v in enumerate(value) for r in flatten(v, f"{pointer}/{i}")]
    text = None if value is None else str(value).upper() if isinstance(value, bool) else str(value)
    return [(pointer, TYPE_NAMES.get(type(value), "character"), text)]


def dismech_import(path: str, release: DataFrame, source_id: str | None = None, source_uri: str | None = None, sha256: str | None = None) -> dict[str, DataFrame]:
    """release, artifact, records (name and verbatim text) and fields (one row per scalar) of one disease record.

    A record is one document; its bytes match their receipt before anything is parsed.
    """
    spark = release.sparkSession
    a = artifact(release, source_id, source_uri, sha256)
    fields = yaml_fields(spark, path, a["sha256"], a["source_id"])
    name = fields.where("field_path = '/name' AND value_type = 'character' AND value <> ''").take(1)
    if not name:
        raise C.ContractError("a disease record must have a name")
    records = verified_text(spark, path, a["sha256"]).select(F.lit(name[0]["value"]).alias("name"), F.col("value").alias("yaml_text"))
    return {"release": release, "artifact": stamp(spark.range(1), a).drop("id"), "records": stamp(records, a), "fields": stamp(fields, a)}


def yaml_fields(spark: SparkSession, path: str, sha256: str, source_id: str) -> DataFrame:
    """A YAML record as one row per scalar."""
    import yaml

    record = yaml.safe_load(admit(spark, path, sha256))
    if not isinstance(record, dict):
        raise C.ContractError("a record must be a YAML mapping")
    rows = [(*r, f"{source_id}#{r[0]}") for r in flatten(record)]
    if len({r[0] for r in rows}) != len(rows):
        raise C.ContractError("field paths must be unique")
    return spark.createDataFrame(rows, "field_path string, value_type string, value string, source_row_id string")
