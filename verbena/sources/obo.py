"""OBO files as nodes, aliases, edges and verbatim tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STANZA = ["file", "stanza"]
QUOTED = r'^[^"]*"((?:[^"\\]|\\.)*)"'


@dataclass
class Obo:
    nodes: DataFrame
    aliases: DataFrame
    edges: DataFrame
    tags: DataFrame


def _trimmed(c: str) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def _quoted(line: Column) -> Column:
    """What the first pair of quotes holds, the line itself if they never close, null without any."""
    inside = F.when(F.regexp_like(line, F.lit(QUOTED)), F.regexp_extract(line, QUOTED, 1)).otherwise(line)
    return F.when(F.contains(line, F.lit('"')), F.replace(inside, F.lit('\\"'), F.lit('"')))


def read_obo(spark: SparkSession, path: str, family: str, source: str | None = None, include_obsolete: bool = False) -> Obo:
    """``[Term]`` stanzas of an OBO file.  A blank line or any line that starts with ``[`` ends a stanza."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return parse_obo(texts, family, source or path.rstrip("/").rsplit("/", 1)[-1], include_obsolete)


def parse_obo(texts: DataFrame, family: str, source: str, include_obsolete: bool = False) -> Obo:
    """``texts`` has ``file`` and ``value``, the whole text of each.

    An ontology file is one document; stanza numbers are running sums over its lines.  Each stanza with an id is one
    node, so an id that two stanzas share is two nodes.  A term is obsolete if its first ``is_obsolete`` says so.
    """
    lines = texts.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    w = Window.partitionBy("file").orderBy("at")
    lines = lines.withColumn("trimmed", _trimmed("line"))
    edge = (F.col("trimmed") == "") | F.startswith("trimmed", F.lit("["))
    x = lines.withColumn("stanza", F.sum(edge.cast("int")).over(w)).withColumn("kind", F.max(F.when(edge, F.col("trimmed"))).over(Window.partitionBy(*STANZA)))
    body = x.where((F.col("kind") == "[Term]") & ~edge)
    # A line without a colon is a tag and its own value.
    tag, value = F.regexp_replace("trimmed", ":.*$", ""), F.regexp_replace("trimmed", "^[^:]+: *", "")
    tags = body.select(*STANZA, "at", tag.alias("tag"), value.alias("value"), F.col("line").alias("source_text"), F.row_number().over(Window.partitionBy(*STANZA).orderBy("at")).cast("int").alias("tag_ordinal"))
    first = lambda t, c: F.min_by(F.when(F.col("tag") == t, c), F.when(F.col("tag") == t, F.col("at")))
    heads = tags.groupBy(*STANZA).agg(first("id", F.col("value")).alias("node_id"), first("name", F.col("value")).alias("label"), first("def", _quoted(F.col("source_text"))).alias("description"), first("is_obsolete", F.lower("value")).alias("gone"))
    heads = heads.where("node_id <> ''")
    heads = heads if include_obsolete else heads.where("gone IS NULL OR gone <> 'true'")
    tags = tags.join(heads.select(*STANZA, "node_id"), STANZA)
    none = F.lit(None).cast("string")
    rest = F.split(F.lower(F.regexp_replace("source_text", QUOTED + r"\s*", "")), r"\s+")[0]
    kind = F.when(rest.isin("", "[]"), "synonym").otherwise(F.concat(F.lit("synonym:"), rest))

    def alias(t: str, kind: Column, text: Column, weight: float) -> DataFrame:
        return tags.where(F.col("tag") == t).select("node_id", text.alias("alias"), kind.alias("alias_kind"), F.lit(source).alias("source"), F.lit(weight).alias("weight"), none.alias("attrs"))

    labels = heads.select("node_id", F.col("label").alias("alias"), F.lit("label").alias("alias_kind"), F.lit(source).alias("source"), F.lit(1.0).alias("weight"), none.alias("attrs"))
    aliases = labels.unionByName(alias("alt_id", F.lit("alt_id"), F.col("value"), 1.0)).unionByName(alias("synonym", kind, _quoted(F.col("source_text")), 0.95)).where("alias <> ''")
    target = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s*[!{].*$", "")), r"\s+")[0]
    is_a = tags.where("tag = 'is_a'").select("node_id", F.lit("is_a").alias("predicate"), target("value").alias("to_id"))
    bits = F.split(F.regexp_replace("value", r"\s*!.*$", ""), r"\s+")
    related = tags.where("tag = 'relationship'").select("node_id", bits[0].alias("predicate"), target(F.get(bits, F.lit(1))).alias("to_id"))
    edges = is_a.unionByName(related).where("to_id <> ''").select(F.col("node_id").alias("from_id"), "predicate", "to_id", none.alias("attrs"), none.alias("trust"))
    return Obo(heads.select("node_id", F.lit(family).alias("family"), "label", "description", none.alias("attrs"), none.alias("trust")), aliases, edges, tags.select("node_id", "tag_ordinal", "tag", "value", "source_text"))
