"""SimHash near-duplicates with pivot distance tables.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles.  Fingerprints
link when they differ in few bits; classes are the connected components of those links.

How links are found, exactly and without comparing all pairs:

1. Equal fingerprints collapse to one node with the smallest id (partial aggregation, so a text that
   a third of all rows share is one row before anything is joined).
2. Bits fall into ``blocks`` groups (as many as keep buckets small for the number of fingerprints, see
   ``choose_blocks``).  Two fingerprints within ``max_bits`` agree on at least
   ``blocks - max_bits`` groups, so each goes to one bucket per choice of that many groups and every
   link is found in some bucket.  Buckets beyond ``bucket_rows`` are cut into parts and each pair of
   parts is a task of its own, so no task gathers an unbounded bucket.
3. Inside a bucket a table holds the Hamming distances to many reference fingerprints (pivots).  By
   the triangle inequality a pair whose distances to any one pivot differ by more than ``max_bits``
   cannot link and is discarded; the rest is verified by exact distance.  Links come from nowhere else.
4. A bucket passes on a spanning forest of its links, never all pairs of a group.
5. Components come from alternating large-star and small-star joins, each round written to the
   shared folder.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like
any other; a row whose id is null gets the smallest non-null id of its component (null if none);
repeated rows are returned as often as they came; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, fresh, materialize, q, words_lower

SEED = 42


@dataclass(frozen=True)
class Params:
    shingle: int = 4
    max_bits: int = 4
    blocks: int | None = None  # None: by the number of fingerprints
    bucket_mean: int = 8
    pivots: int = 32
    bucket_rows: int = 4096
    partitions: int | None = None
    #: Classes up to which their ids are broadcast (16 bytes each); beyond, the join is a shuffle.
    broadcast_rows: int = 1_000_000


def fingerprint(text: str | None, k: int = 4) -> int:
    """SimHash of the word shingles of ``text``: unsigned, bit set if set in over half the hashes."""
    w = words_lower(text)
    if not w:
        return 0
    n = max(1, len(w) - k + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(b" ".join(w[i : i + k]), SEED) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash_column(text, k: int = 4):
    """Column function: the fingerprint of a text as a signed long, which keeps all 64 bits."""

    @F.pandas_udf(T.LongType())
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo(lambda t: fingerprint(t, k))
        for texts in batches:
            yield pd.Series(np.array([memo(t) for t in texts], dtype=np.uint64).view(np.int64))

    return simhash(text)


def choose_blocks(n: int, max_bits: int, bucket_mean: int) -> int:
    """The fewest groups of bits for which ``n`` random fingerprints fill a bucket with ``bucket_mean`` at most.

    A key has the bits of all groups but ``max_bits``: 21 of 64 for six groups and four bits (up to 16 million
    fingerprints at a mean of 8), 27 for seven (a thousand million), 32 for eight.
    """
    blocks = max_bits + 2
    while blocks < 4 * max_bits + 4 and n > bucket_mean << (64 * (blocks - max_bits) // blocks):
        blocks += 1
    return blocks


def block_keys(blocks: int, max_bits: int) -> list[tuple[int, int]]:
    """(number, mask) of each choice of groups that must agree."""
    if blocks <= max_bits:
        raise ValueError("blocks must exceed max_bits")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    return [(n, sum(masks[i] for i in c)) for n, c in enumerate(combinations(range(blocks), blocks - max_bits))]


def pivot_table(fps: np.ndarray, pivots: int) -> np.ndarray:
    """Hamming distances of each fingerprint to ``pivots`` fixed reference fingerprints."""
    refs = np.random.default_rng(SEED).integers(0, 1 << 64, pivots, dtype=np.uint64, endpoint=False)
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def _close(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs (a[i], b[i]) link: survivors of the pivot table, verified."""
    alive = np.arange(len(a))
    for lo in range(0, ta.shape[1], 8):  # few coordinates at a time: most pairs go early
        alive = alive[np.abs(ta[alive, lo : lo + 8] - tb[alive, lo : lo + 8]).max(axis=1) <= bits] if len(alive) else alive
    return alive[np.bitwise_count(a[alive] ^ b[alive]) <= bits]


def _forest(n: int, i: np.ndarray, j: np.ndarray, parent: list[int]) -> list[tuple[int, int]]:
    """Those of the links (i, j) that join two trees of ``parent``."""
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        rx, ry = x, y
        while parent[rx] != rx:
            parent[rx] = parent[parent[rx]]
            rx = parent[rx]
        while parent[ry] != ry:
            parent[ry] = parent[parent[ry]]
            ry = parent[ry]
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def bucket_links(fps: np.ndarray, pivots: int, bits: int, block: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of the links inside one bucket."""
    d = pivot_table(fps, pivots)
    order = np.argsort(d[:, 0], kind="stable")
    fps, d = fps[order], d[order]
    n, parent, out = len(fps), list(range(len(fps))), []
    ends = np.searchsorted(d[:, 0], d[:, 0] + bits, side="right")  # sorted by the first pivot: a window suffices
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        for clo in range(lo, int(ends[hi - 1]), block):
            chi = min(int(ends[hi - 1]), clo + block)
            alive = np.ones((hi - lo, chi - clo), bool)
            for p in range(min(8, pivots)):
                alive &= np.abs(d[lo:hi, p, None] - d[None, clo:chi, p]) <= bits
            i, j = np.nonzero(alive)
            i, j = i + lo, j + clo
            i, j = i[i < j], j[i < j]
            if len(i):
                s = _close(fps[i], fps[j], d[i], d[j], bits)
                out += _forest(n, i[s], j[s], parent)
    return [(int(fps[i]), int(fps[j])) for i, j in out]


def _links(batches: Iterator[pd.DataFrame], p: Params) -> Iterator[pd.DataFrame]:
    """Links of buckets that arrive one after the other, sorted by key."""

    def emit(pairs: list) -> pd.DataFrame:
        a = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": a.min(axis=1), "b": a.max(axis=1)}) if len(a) else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

    rest = None
    for batch in batches:
        x = batch[["k", "v", "part", "fp"]].to_numpy()
        x = x if rest is None else np.concatenate([rest, x])
        if not len(x):
            continue
        new = np.r_[True, (x[1:, :3] != x[:-1, :3]).any(axis=1)]
        last = int(np.flatnonzero(new)[-1])
        rest = x[last:]
        if last:
            yield emit(_batch_links(x[:last], new[:last], p))
    if rest is not None:
        yield emit(_batch_links(rest, np.r_[True, np.zeros(len(rest) - 1, bool)], p))


def _batch_links(x: np.ndarray, new: np.ndarray, p: Params) -> list[tuple[int, int]]:
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(x)])
    fps, out = x[:, 3].astype(np.int64).view(np.uint64), []
    small = sizes <= 16
    # Small buckets, all at once: each row against the k-th after it while the bucket lasts.
    left = np.repeat(starts + sizes, sizes) - np.arange(len(x)) - 1
    left[~np.repeat(small, sizes)] = 0
    some = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if len(some):
        table = np.zeros((len(x), p.pivots), np.int8)
        table[some] = pivot_table(fps[some], p.pivots)
    for k in range(1, 16):
        i = np.flatnonzero(left >= k)
        if not len(i):
            break
        s = i[_close(fps[i], fps[i + k], table[i], table[i + k], p.max_bits)]
        out += zip(fps[s].tolist(), fps[s + k].tolist(), strict=True)
    for at, n in zip(starts[~small], sizes[~small], strict=True):
        out += bucket_links(np.unique(fps[at : at + n]), p.pivots, p.max_bits)
    return out


def fingerprint_links(nodes: DataFrame, p: Params = Params()) -> DataFrame:
    """Links (a < b) whose components are those of all fingerprint pairs within ``max_bits``.

    ``nodes`` has the distinct fingerprints in column ``fp``.
    """
    blocks = p.blocks or choose_blocks(nodes.count(), p.max_bits, p.bucket_mean)
    keys = F.array(*(F.struct(F.lit(n).cast("long").alias("k"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("v")) for n, m in block_keys(blocks, p.max_bits)))
    keyed = nodes.select("fp", F.explode(keys).alias("kv")).select("kv.k", "kv.v", "fp")
    large = keyed.groupBy("k", "v").count().where(F.col("count") > p.bucket_rows)
    parts = F.ceil(F.col("count") / (p.bucket_rows // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("long")
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j.cast("long"), F.col("own")) * F.col("parts") + F.greatest(j.cast("long"), F.col("own"))))
    split = keyed.join(large.withColumn("parts", parts), ["k", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("own", own).select("k", "v", "fp", other.alias("part"))
    n = [p.partitions] if p.partitions else []
    dealt = split.repartition(*n, "k", "v", "part").sortWithinPartitions("k", "v", "part")
    found = dealt.mapInPandas(lambda it: _links(it, p), "a long, b long")
    return found.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node of each component of the edges (a, b).

    Large-star and small-star turn about until nothing changes.  Each star needs the smallest
    neighbour of a node (partial aggregation) and one join back to the edges, so a hub is split by
    adaptive skew handling instead of gathered.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: each node's smaller neighbours and itself point to the smallest of them.
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct("m", "a"), F.struct("m", F.col("b").alias("a")))).alias("e"))
        now = materialize(small.select(F.col("e.m").alias("a"), F.col("e.a").alias("b")).where("a <> b").distinct(), "edges")
        # Stable once counts and sums stay and every edge hangs directly from a root.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def fingerprint_classes(ids: DataFrame, p: Params = Params()) -> DataFrame:
    """(fp, class_id) of each distinct fingerprint of ``ids``, which has columns ``id`` and ``fp``."""
    nodes = materialize(ids.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    roots = components(fingerprint_links(nodes.select("fp"), p))
    joined = materialize(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "root"), "rooted")
    # Only fingerprints with links have a root; most roots are few rows, so they are sent to every task after a count.
    best = joined.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("class_id"))
    best = F.broadcast(best) if best.count() <= p.broadcast_rows else best
    return joined.join(best, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (signed long) and ``component_id``."""
    ids = materialize(docs.select(F.col(q(id_col)).alias("id"), simhash_column(F.col(q(text_col)), p.shingle).alias("fp")), "simhash")
    classes = fingerprint_classes(ids, p)
    return ids.join(classes, "fp").select(F.col("id").alias("doc_id"), "fp", F.col("class_id").alias("component_id"))


def hex_digits(fp):
    """16 lower-case hex digits of a signed long column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """The documents that head their class, all columns kept.

    The document with the class's smallest id stays.  Of rows that repeat that id the first as read
    stays; in a class whose ids are all null one row of each fingerprint stays.
    """
    n, fp = fresh(docs, "row_number", "fingerprint")
    numbered = docs.withColumn(n, F.monotonically_increasing_id())
    numbered = materialize(numbered.withColumn(fp, simhash_column(F.col(q(text_col)), p.shingle)), "simhash")
    ids = numbered.select(F.col(n).alias("n"), F.col(q(id_col)).alias("id"), F.col(fp).alias("fp"))
    heads = ids.join(fingerprint_classes(ids, p), "fp").where(F.col("id").eqNullSafe(F.col("class_id")))
    first = heads.groupBy("id", F.when(F.col("id").isNull(), F.col("fp"))).agg(F.min("n").alias(n)).select(n)
    return numbered.join(first, n, "left_semi").select(*(F.col(q(c)) for c in docs.columns))
