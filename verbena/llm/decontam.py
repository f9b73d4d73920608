"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

The question is one of containment, not resemblance: does a long document hold at least
``threshold`` of a short item's word shingles?  Item shingles are put in one seeded random order (the
MinHash order) and each item's sketch is its first few shingles in that order.  Items are partitioned
by size (powers of two) and a partition's sketch has ``floor((1 - threshold) * largest size) + spare``
members, which is more shingles than a matching document may miss: every match shares sketch members,
so the search loses none.  Documents that hit a sketch as often as a match must, all rows of one
document id taken together, are candidates.  Exact shingle containment, on the shingle texts, then decides.

A phrase that many items share would make every document that holds it a candidate of all of them.  Two things
keep that down: shingles of more than ``common_items`` items come last in the order, and a sketch has
``spare`` members more than a match may miss, so a pair is a candidate only if it shares that many more.

Text is lower-cased and every run of characters that are neither letters nor digits is one blank, so
punctuation and line breaks inside a passage do not hide it.  A text of fewer than ``shingle`` words
is one shingle; a text without words has none and neither matches nor is matched.

Defined results: null texts count as empty; repeated items with one id and repeated documents with one
id count once for a pair, as the union of the rows' shingles; null ids are ids like any other; empty tables give an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, q


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    threshold: float = 0.8
    #: Sketch members beyond those that a match may miss.
    spare: int = 3
    #: Shingles of more items than this come last in the sketch order.
    common_items: int = 8
    #: Sketch rows up to which they are broadcast (16 bytes each); beyond, the join is a shuffle.
    broadcast_rows: int = 1_000_000


def words(text: Column) -> Column:
    """Letters and digits in lower case, cut at everything else; one empty word if there are none."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def has_words(w: Column) -> Column:
    return F.get(w, F.lit(0)) != ""


def shingle_hashes(w: Column, k: int) -> Column:
    """64-bit hashes of the word shingles; the whole sequence if it is shorter, none if it is empty."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
    return F.when(has_words(w), F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(w: Column, k: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
    return F.when(has_words(w), F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))


def sketches(items: DataFrame, p: Params) -> DataFrame:
    """(item, least, h): each item's sketch members and how many of them a match shares at least.

    ``items`` has ``item`` and ``w``, its words.
    """
    own = materialize(items.select("item", F.explode(shingle_hashes(F.col("w"), p.shingle)).alias("h")).distinct(), "shingles")
    common = own.groupBy("h").agg((F.count("*") > p.common_items).alias("common"))
    order = F.struct("common", F.xxhash64("h", F.lit(17)).alias("o"), "h")
    sized = own.join(common, "h").groupBy("item").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(order)).alias("s"))
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1  # of the item's size partition
    kept = F.least(F.floor(largest * (1 - p.threshold) + 1e-9) + p.spare, F.col("n")).cast("int")
    missed = F.col("n") - F.ceil(F.col("n") * p.threshold - 1e-9)
    return sized.select("item", (kept - missed).alias("least"), F.explode(F.slice("s", 1, kept)["h"]).alias("h"))


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", p: Params = Params()) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of the pairs at or over the threshold."""
    items = materialize(items.select(F.col(q(item_col)).alias("item"), words(F.col(q(item_text_col))).alias("w")).where(has_words(F.col("w"))), "items")
    sketch = materialize(sketches(items, p), "sketches")
    by_hash = sketch.select("h").distinct()
    n_keys = by_hash.count()
    docs = docs.select(F.col(q(id_col)).alias("doc"), F.col(q(text_col)).alias("text"))

    # Words are a column of their own: inside a lambda the expression would be evaluated per shingle.
    hashed = docs.select("doc", words(F.col("text")).alias("w")).select("doc", shingle_hashes(F.col("w"), p.shingle).alias("hs"))
    # explode_outer: for a plain explode the optimizer adds a size filter and evaluates the words anew in it.
    rows = hashed.select("doc", F.explode_outer("hs").alias("h"))
    side = F.broadcast(by_hash) if n_keys <= p.broadcast_rows else by_hash
    hits = rows.join(side, "h", "left_semi").distinct()
    # Candidates: pairs of a document and an item whose sketch it hits often enough.
    met = hits.join(sketch, "h").groupBy("doc", "item").agg(F.count("*").alias("k"), F.first("least").alias("least"))
    pairs = materialize(met.where("k >= least").select("doc", "item"), "candidates")

    item_shingles = items.select("item", F.explode(shingle_texts(F.col("w"), p.shingle)).alias("s")).distinct()
    sizes = item_shingles.groupBy("item").agg(F.count("*").alias("n_item"))
    found = docs.join(pairs.select(F.col("doc").alias("d")).distinct(), F.col("doc").eqNullSafe(F.col("d")), "left_semi")
    doc_shingles = found.select("doc", words(F.col("text")).alias("w")).select("doc", F.explode_outer(shingle_texts(F.col("w"), p.shingle)).alias("s"))
    # Only shingles that some item has go on, so the exact check moves what overlaps and no more.
    n_shingles = item_shingles.select("s").distinct()
    small = F.broadcast(n_shingles) if n_keys * 8 <= p.broadcast_rows else n_shingles
    overlap = doc_shingles.join(small, "s", "left_semi").distinct()
    joined = overlap.join(item_shingles, "s").join(pairs.select(F.col("doc").alias("pd"), F.col("item").alias("pi")), F.col("doc").eqNullSafe(F.col("pd")) & F.col("item").eqNullSafe(F.col("pi")), "left_semi")
    shared = joined.groupBy("doc", "item").agg(F.count("*").alias("n_shared"))
    out = shared.join(sizes.withColumnRenamed("item", "i"), F.col("item").eqNullSafe(F.col("i")))
    share = F.col("n_shared") / F.col("n_item")
    return out.where(share >= p.threshold - 1e-12).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_item", "n_shared", share.alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params(), **names) -> DataFrame:
    """The documents that hold no item, all columns kept.

    Ids name documents: every row with a matched id goes (rows with a null id by their own text's
    union, as above).
    """
    (bad,) = fresh(docs, "bad_id")
    ids = contaminated_pairs(docs, items, id_col, text_col, p=p, **names).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(ids, F.col(q(id_col)).eqNullSafe(F.col(bad)), "left_anti").select(*(F.col(q(c)) for c in docs.columns))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) > 0
), bs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0
), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) WHERE n_shared / n_item >= 0.8
"""
