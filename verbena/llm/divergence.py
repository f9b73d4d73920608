"""Source divergence audit: how far apart the sources of a language lie, and which terms set one apart.

A group is a (lang, source) pair.  Terms are runs of letters and non-ASCII characters, A-Z in lower case.  A language
keeps the terms that enough of its documents hold; each group, and each language, gives each kept term a smoothed share
of ``scale``.  Two groups differ by the sum, over kept terms, of the differences of their shares.

Tiling: kept terms are dealt into chunks by hash and numbered inside a chunk, so a group's counts are one packed row
(term numbers, counts) a chunk.  The groups of a language are dealt into blocks.  Each packed row is replicated to the tiles
(block by block) that its group takes part in; a tile is one run of sorted rows, read as a stream, chunk after
chunk, into the submatrix of its pairs.  A tile holds one chunk of ``2 * block_groups`` groups at most, whatever the size of the
corpus or vocabulary.  Terms that no group of a tile has in a chunk are never spelt out: all of them add the same difference.

Counting is bounded by a flush of the counters; a hot group is spread over all tasks that read it and its counts are
summed by term.  Shares are exact integers at any count.

Defined results: null text, lang and source count as ''; rows with one id are documents each; a group without terms gives each
kept term the same share; a language without kept terms has distances of 0 and no term rows; a language with one source has
no pairs; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, q

_TERM = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PIECE = 1 << 20


@dataclass(frozen=True)
class Params:
    min_docs: int = 30
    smoothing: int = 5
    scale: int = 1_000_000_000
    top_terms: int = 50
    chunk_terms: int = 16_384
    block_groups: int = 128
    least_blocks: int = 4
    flush_entries: int = 400_000
    flush_bytes: int = 64 << 20
    broadcast_groups: int = 100_000


def pieces(text: bytes, size: int = _PIECE) -> Iterator[bytes]:
    """``text`` in parts of some ``size`` bytes that end between words."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _counted(batches: Iterator[pa.RecordBatch], p: Params, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Counts of occurrences and of documents by group and term; a group's row without a term says that it occurs."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    entries = read = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            for a in range(0, len(terms), 50_000):
                part = terms[a : a + 50_000]
                columns = [[lang] * len(part), [source] * len(part), part, [n[t] for t in part], [docs[t] for t in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, mine = len(n), set()
            for part in pieces(text.translate(_TERM)):
                words = part.split()
                n.update(words)
                mine.update(words)
            docs.update(mine)
            entries, read = entries + len(n) - before, read + len(text)
            if entries >= p.flush_entries or read >= p.flush_bytes:
                yield from flushed()
                entries = read = 0
    yield from flushed()


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str, p: Params) -> DataFrame:
    """lang, source, term, n, docs: one row a group and term, and one with a null term a group."""
    x = docs.select(*(F.coalesce(F.col(q(c)).cast("string"), F.lit("")) for c in (lang_col, source_col)), F.coalesce(F.col(q(text_col)).cast("string"), F.lit("")).cast("binary"))
    kinds = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
    counted = x.mapInArrow(lambda batches: _counted(batches, p, schema), kinds)
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column, p: Params) -> Column:
    """1 + floor(scale * (n + smoothing) / (total + smoothing * kept)) in decimals, which do not overflow."""
    top = F.lit(p.scale).cast("decimal(12,0)") * (n + p.smoothing).cast("decimal(19,0)")
    return F.call_function("div", top, (total + p.smoothing * kept).cast("decimal(19,0)")) + 1


def shares(n: np.ndarray, total: int, kept: int, p: Params) -> np.ndarray:
    """``share`` of an array of counts."""
    below, top = total + p.smoothing * kept, n + p.smoothing
    out = np.empty(len(n), np.int64)
    fits = top < (1 << 63) // p.scale
    out[fits] = top[fits] * p.scale // below + 1
    out[~fits] = [int(c) * p.scale // below + 1 for c in top[~fits]]
    return out


class Tile:
    """The pairs of two blocks of one language, summed chunk by chunk."""

    def __init__(self, low: int, high: int, p: Params):
        self.low, self.high, self.p, self.place, self.names, self.sides, self.totals = low, high, p, {}, [], [], []
        self.kept, self.met, self.sums = 0, 0, None

    def group(self, source: str, block: int, total: int, kept: int) -> None:
        self.place[source] = len(self.names)
        self.names.append(source)
        self.sides.append(block)
        self.totals.append(total)
        self.kept = kept

    def begin(self) -> None:
        self.left, self.right = ([k for k, s in enumerate(self.sides) if s == side] for side in (self.low, self.high))
        none = np.zeros(1, np.int64)
        self.base = np.array([shares(none, t, self.kept, self.p)[0] if self.kept else 0 for t in self.totals], np.int64)
        self.sums = np.zeros((len(self.left), len(self.right)), np.int64)

    def chunk(self, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
        terms = np.unique(np.concatenate([t for _, t, _ in rows]))
        x = np.repeat(self.base[:, None], len(terms), axis=1)
        for source, t, n in rows:
            k = self.place[source]
            x[k, np.searchsorted(terms, t)] = shares(n, self.totals[k], self.kept, self.p)
        right = x[self.right]
        for i, k in enumerate(self.left):
            self.sums[i] += np.abs(right - x[k]).sum(axis=1)
        self.met += len(terms)

    def pairs(self) -> Iterator[tuple[str, str, int]]:
        gap = np.abs(self.base[self.left][:, None] - self.base[self.right][None, :])
        value = self.sums + gap * (self.kept - self.met)
        for i, a in enumerate(self.left):
            for j, b in enumerate(self.right):
                if a != b:
                    yield self.names[a], self.names[b], int(value[i, j])
                    if self.low != self.high:
                        yield self.names[b], self.names[a], int(value[i, j])


_TILED = "lang string, low int, high int, chunk int, source string, block int, total long, kept long, terms array<int>, counts array<long>"


def _tiled(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Tiles one after the other from rows sorted by (lang, low, high, chunk); a tile's groups come first, as chunk -1."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True))
            for k, key in enumerate(keys):
                yield *key, batch.column(8)[k].values, batch.column(9)[k].values

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    for (lang, low, high), own in groupby(rows(), key=lambda r: r[:3]):
        tile = Tile(low, high, p)
        for chunk, part in groupby(own, key=lambda r: r[3]):
            if chunk < 0:
                for r in part:
                    tile.group(*r[4:8])
                tile.begin()
            else:
                tile.chunk([(r[4], r[8].to_numpy(), r[9].to_numpy()) for r in part])
        out = list(tile.pairs())
        for a in range(0, len(out), 50_000):
            source, item, value = zip(*out[a : a + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([lang] * len(source), source, item, value), schema, strict=True)], schema=schema)


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language by its distance.  Part ``term``: the ``top_terms`` kept terms that the group has
    and gives a larger share than its language does, by that difference.  Ranks run from 1 by value, largest
    first, then by item in the order of UTF-8.
    """
    counts = materialize(term_counts(docs, lang_col, source_col, text_col, p), "terms")
    of_lang = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("lang_n")).where(F.col("df") >= p.min_docs)
    kept = materialize(of_lang.select("lang", "term", "lang_n"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    chunks = max(1, math.ceil((langs.agg(F.max("kept")).first()[0] or 0) / p.chunk_terms))
    number = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    numbered = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")).withColumn("at", number)
    met = materialize(counts.where("n > 0").select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "met")

    totals = met.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lang_total"))), "groups")
    n_groups, most = groups.groupBy("lang").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()

    blocks = max(p.least_blocks, math.ceil(most / p.block_groups))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block")
    packed = met.groupBy("lang", "source", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("x"))
    packed = packed.select("lang", "chunk", "source", block, F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("kept"), F.col("x.at").alias("terms"), F.col("x.n").alias("counts"))
    heads = groups.select("lang", F.lit(-1).alias("chunk"), "source", block, "total", "kept", F.array().cast("array<int>").alias("terms"), F.array().cast("array<long>").alias("counts"))
    dealt = heads.unionByName(packed).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).select(*(f.split(" ")[0] for f in _TILED.split(", ")))
    tiles = dealt.repartition("lang", "low", "high").sortWithinPartitions("lang", "low", "high", "chunk", "source")
    pairs = tiles.mapInArrow(lambda batches: _tiled(batches, p), "lang string, source string, item string, value long")

    side = F.broadcast(groups) if n_groups <= p.broadcast_groups else groups
    each = met.join(side, ["lang", "source"])
    above = each.withColumn("value", share(F.col("n"), F.col("total"), F.col("kept"), p) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), p)).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = above.select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", rank).where(F.col("rank") <= p.top_terms)
    out = lambda x, part: x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs.withColumn("rank", rank), "pair").unionByName(out(terms, "term"))


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w,
    row_number() OVER () AS i FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, i, unnest(w) AS term FROM d),
v AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY 1, 2, 3),
k AS (SELECT lang, count(*) AS v FROM v GROUP BY 1),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(total, 0) + 5 * k.v) AS p
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(k.v)) AS q FROM c JOIN k USING (lang) GROUP BY 1, 2),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50"""
