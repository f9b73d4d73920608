"""Token counts as a tokenizer's own library gives them, with overlap resynchronisation for huge documents.

The tokenizer is a ``tokenizers`` JSON file with byte-level BPE and its usual pre-tokenizer.  Its pattern reads a text from left to
right and never looks back, so after a place at which it must begin a new piece, nothing before that place
matters.  Such a place is stable: the character before it is a letter, digit or mark and the one at it is of another class that
the pattern's alternatives cannot join, and no added token's string lies across it.  Classes count only where
old and new editions of Unicode agree.

A document of more than ``huge_chars`` characters is cut into chunks with overlaps; chunks, not documents, are the rows that tasks get, and chunks of
equal documents are encoded once.  Each chunk is encoded with offsets and reports, for both of its overlaps, the stable
places at which one of its tokens ends and the number of tokens before them.  Neighbours are spliced at the
first place that both report.  Where they share none, the document goes into another round with chunks and overlaps twice
as wide, up to the whole text, so the count is always that of the whole text.

Other documents are cut at blanks, which are stable, and pieces that came before are not encoded again; a document
with an added token's string is encoded as it is.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are counted each; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, materialize, q

_PIECE = re.compile(r"\s+(?!\S)|\s?\S+")  # never across a change from other characters to blanks, nor after the last blank of a run
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # space to Python, not to the pattern
_LONG_PIECE = 40
#: Classes (before, after) between which the pattern always begins a new piece: letters, numbers, marks, blanks.
_TURNS = {"LN", "LM", "LS", "NL", "NM", "NS", "MN", "MS"}


@dataclass(frozen=True)
class Params:
    vocabulary: str = "byte_bpe_50k.json"  # a path, or the name of a public file, which executors look up themselves
    limit: int = 1024
    huge_chars: int = 16_384
    overlap_chars: int = 512
    cache_pieces: int = 500_000


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str):
    """The tokenizer and its added strings; loaded once per worker.  Other kinds of tokenizers are refused."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    if not os.path.isabs(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    t = tokenizers.Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    added = [a for a in t.get_added_tokens_decoder().values()]
    plain = isinstance(t.pre_tokenizer, tokenizers.pre_tokenizers.ByteLevel) and t.pre_tokenizer.use_regex and not t.pre_tokenizer.add_prefix_space and t.normalizer is None
    if not plain or not isinstance(t.model, tokenizers.models.BPE) or any(a.lstrip or a.rstrip or a.single_word for a in added):
        raise ValueError("the tokenizer must be byte-level BPE with the usual pattern, no normalizer and plain added tokens")
    return t, tuple(a.content for a in added)


@lru_cache(maxsize=65_536)
def char_class(c: str) -> str:
    """L, N, M (any other visible mark), S (blank), or ? where editions of Unicode or of blanks differ."""
    if c in " \t\n\r":
        return "S"
    old, new = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
    if c.isspace() or old[0] != new[0] or new[0] in "ZC":
        return "?"
    return new[0] if new[0] in "LN" else "M"


def stable_places(text: str, a: int, z: int, added: tuple[str, ...]) -> list[int]:
    """The stable places x, a <= x < z: a piece always begins at ``text[x]``."""
    out = []
    for x in range(max(a, 1), min(z, len(text))):
        if char_class(text[x - 1]) + char_class(text[x]) in _TURNS and not any(text.find(s, max(0, x - len(s) + 1), x + len(s) - 1) >= 0 for s in added):
            out.append(x)
    return out


class Counter:
    """Tokens of texts, piece by piece; forgets its pieces when it holds too many."""

    def __init__(self, p: Params):
        self.t, self.added = tokenizer(p.vocabulary)
        self.size, self.pieces = p.cache_pieces, {}

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if _ODD_SPACE.search(text) or any(s in text for s in self.added):
            return self.encoded([text])[0]
        found = _PIECE.findall(text)
        try:
            return sum(map(self.pieces.__getitem__, found))
        except KeyError:
            pass
        new = {x for x in found if x not in self.pieces}
        if len(self.pieces) + len(new) > self.size:
            self.pieces.clear()
            new = set(found)
        counts = dict(zip(new, self.encoded(list(new)), strict=True))
        n = sum(counts[x] if x in counts else self.pieces[x] for x in found)
        self.pieces.update((x, c) for x, c in counts.items() if len(x) <= _LONG_PIECE)
        return n


@lru_cache(maxsize=2)
def counter(p: Params) -> Counter:
    return Counter(p)


def token_count(text, p: Params = Params()):
    """Column function: tokens of a text, encoded as a whole."""

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo(counter(p))
        for texts in batches:
            yield pd.Series([memo(t) for t in texts], dtype="int64")

    return tokens(text)


def _cut(batches: Iterator[pa.RecordBatch], core: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks (key, part, parts, low, text); part k covers [k * core - overlap, (k + 1) * core + overlap)."""
    for batch in batches:
        for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts = max(1, (len(text) - 1) // core + 1)
            for a in range(0, parts, 64):
                some = range(a, min(a + 64, parts))
                low = [max(0, k * core - overlap) for k in some]
                high = [len(text) if k == parts - 1 else (k + 1) * core + overlap for k in some]
                yield pa.RecordBatch.from_pydict({
                    "key": [key] * len(some), "part": pa.array(some, pa.int32()), "parts": pa.array([parts] * len(some), pa.int32()), "low": pa.array(low, pa.int64()),
                    "text": [text[i:j] for i, j in zip(low, high, strict=True)],
                })


def ends_of(text: str, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (start, end) of a text's tokens, with offsets of code points."""
    t, _ = tokenizer(p.vocabulary)
    at = np.array(t.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def common_places(text: str, low: int, place: int, overlap: int, starts: np.ndarray, ends: np.ndarray, added: tuple[str, ...]) -> tuple[list[int], list[int]]:
    """Stable places of the overlap around ``place`` (in the document) at which a token ends, and the tokens before them.

    Places nearer to the overlap's ends than an added token, or what the pattern looks ahead, are left out.
    """
    margin = 4 + max(map(len, added), default=0)
    stable = np.array(stable_places(text, place - overlap + margin - low, place + overlap - margin - low, added), np.int64)
    before = np.searchsorted(ends, stable, side="right")  # ends never go back
    fits = (before > 0) & (ends[np.maximum(before, 1) - 1] == stable) & ((before == len(ends)) | (starts[np.minimum(before, len(ends) - 1)] >= stable))
    return (stable[fits] + low).tolist(), before[fits].tolist()


_MARKS = "key string, place int, is_left boolean, at array<long>, tokens array<long>"


def _encode(batches: Iterator[pa.RecordBatch], core: int, overlap: int, p: Params) -> Iterator[pa.RecordBatch]:
    """Two rows a chunk: what it reports of its overlap with the chunk before (if any), and with the one after, or its tokens if it is the last."""
    _, added = tokenizer(p.vocabulary)
    schema = pa.schema([("key", pa.string()), ("place", pa.int32()), ("is_left", pa.bool_()), ("at", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
    for batch in batches:
        rows = []
        for key, part, parts, low, text in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "parts", "low", "text")), strict=True):
            starts, ends = ends_of(text, p)
            if part:
                rows.append((key, part, False, *common_places(text, low, part * core, overlap, starts, ends, added)))
            if part < parts - 1:
                rows.append((key, part + 1, True, *common_places(text, low, (part + 1) * core, overlap, starts, ends, added)))
            else:
                rows.append((key, parts, True, [-1], [len(ends)]))
                rows.append((key, parts, False, [-1], [0]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)


def spliced_counts(texts: DataFrame, p: Params = Params()) -> DataFrame:
    """key, n_tokens of each distinct text; ``texts`` (key, text) may repeat.  A key stands for one text."""
    core, overlap, done = p.huge_chars, p.overlap_chars, []
    while True:
        cut = texts.select("key", "text").mapInArrow(lambda b, c=core, o=overlap: _cut(b, c, o), "key string, part int, parts int, low long, text string")
        chunks = cut.dropDuplicates(["key", "part"])
        marks = chunks.mapInArrow(lambda b, c=core, o=overlap: _encode(b, c, o, p), _MARKS)
        side = lambda left: F.max(F.when(F.col("is_left") == left, F.struct("at", "tokens")))
        met = marks.groupBy("key", "place").agg(side(True).alias("l"), side(False).alias("r")).withColumn("x", F.array_min(F.array_intersect("l.at", "r.at")))
        tokens = lambda s: F.element_at(f"{s}.tokens", F.array_position(F.col(f"{s}.at"), F.col("x")).cast("int"))
        joined = met.select("key", F.when(F.col("x").isNotNull(), tokens("l") - tokens("r")).alias("n"))
        found = materialize(joined.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.count_if(F.col("n").isNull()).alias("apart")), "spliced")
        done.append(found.where("apart = 0").select("key", "n_tokens"))
        if not found.where("apart > 0").take(1):
            break
        texts = texts.join(found.where("apart > 0").select("key"), "key", "left_semi")
        core, overlap = 2 * core, 2 * overlap
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every document."""
    text = F.coalesce(F.col(q(text_col)).cast("string"), F.lit(""))
    x = docs.select(F.col(q(id_col)).alias("doc_id"), text.alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    huge = x.where(F.length("text") > p.huge_chars).select("doc_id", F.sha2("text", 256).alias("key"), size, "text")
    small = x.where(F.length("text") <= p.huge_chars).select("doc_id", size, token_count(F.col("text"), p).alias("n_tokens"))
    long = huge.select("doc_id", "key", "n_bytes").join(spliced_counts(huge, p), "key").select("doc_id", "n_bytes", "n_tokens")
    return small.unionByName(long).withColumn("over_limit", F.col("n_tokens") > p.limit)
