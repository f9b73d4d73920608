"""Quality rules by compression bands.

zstandard ratios (compressed bytes over bytes) of the whole text and of its fixed-size chunks are held
against limits that depend on the length: below the lower limit text repeats itself, above the
upper one it is noise (encoded data, random characters); so it is where compression saves nothing on what the
frequencies of its bytes give.  Chunks cover every byte: the last one is the text's last
``chunk`` bytes and counts for those bytes that no chunk before it has; a text of no more than ``chunk``
bytes is one chunk.  A text is rejected by its chunks when more than ``chunk_share`` of its bytes lie in
chunks beyond the limits.  Plain counts of words, symbols and repeats come with it.

Defined results: a null or empty text has no words, ratio null and the verdict ``empty``; repeated rows
are judged alike; texts of any length are compressed whole; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, q

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits by length: ``below[i]`` bytes take ``low[i]``, ``high[i]`` and ``plain[i]``; the last ones have no bound.

    ``plain`` holds the ratio against what coding each byte by its frequency alone would take: noise of any alphabet comes out
    above 1, as there is nothing else to save, and prose below.

    Measured at level 3 over the distinct prose of the sf0.1 texts and over random base64, base32, hex, letters and digits, in
    lines, in words of fixed and of changing length and in pairs.  Ratios: the largest of prose is 0.75 below 512
    bytes, 0.70, 0.59, 0.52 and 0.48 below 1024 to 8192; the least of base64 in lines or words 0.83, 0.76, 0.74, 0.73, 0.73, of base32
    0.69, 0.65, 0.64, 0.63, 0.62, of letters 0.67, 0.62, 0.60, 0.59, 0.59.  Against the bytes' frequencies: prose at most
    0.975 from 4096 bytes on, 0.929 from 8192 on and 0.979 in chunks, noise at least 1.009, 1.002 and 1.017.
    So from 4096 bytes on every kind of noise is told apart; below, hex, digits and noise in pairs are not, below 2048 letters, below
    1024 base32; below 256 bytes nothing is, and below 128 there is no upper limit.  A lower limit lies well below the
    least ratio of prose (0.54, 0.42, 0.38).
    """

    level: int = 3
    below: tuple[int, ...] = (128, 256, 512, 1024, 2048, 4096, 8192, 32768)
    low: tuple[float, ...] = (0.40, 0.42, 0.40, 0.36, 0.32, 0.30, 0.28, 0.26, 0.24)
    high: tuple[float, ...] = (math.inf, 1.0, 0.80, 0.73, 0.62, 0.57, 0.57, 0.57, 0.57)
    plain: tuple[float, ...] = (math.inf,) * 6 + (0.99, 0.97, 0.97)
    chunk: int = 4096
    chunk_low: float = 0.20
    chunk_high: float = 0.57
    chunk_plain: float = 1.0
    chunk_share: float = 0.5


FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_chunks", "n_repetitive_chunks", "n_noisy_chunks")]
    + [T.StructField("ratio", T.DoubleType()), T.StructField("plain", T.DoubleType()), T.StructField("verdict", T.StringType())]
)


def repeat_words(words: list) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    v = len(ids)
    if v < 2_000_000:
        key = (w[:-2] * v + w[1:-1]) * v + w[2:]
    else:
        _, pair = np.unique(w[:-2] * v + w[1:-1], return_inverse=True)
        key = pair * v + w[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 2, bool)
    for k in range(3):
        cover[k : k + n] |= twice
    return int(cover.sum())


def plain_ratio(b: bytes) -> float:
    """Bytes that coding each byte by its frequency would take, over bytes."""
    n = np.bincount(np.frombuffer(b, np.uint8))
    share = n[n > 0] / len(b)
    return float(-(share * np.log2(share)).sum() / 8)


def chunks(b: bytes, size: int) -> list[tuple[int, bytes]]:
    """(bytes it stands for, chunk); the last one reaches back, so all have ``size`` bytes."""
    n = len(b)
    ends = [*range(size, n, size), n]
    return [(end - before, b[end - size : end]) for before, end in zip([0, *ends], ends, strict=False)]


def chunk_ratios(b: bytes, size: int, compress) -> list[tuple[int, float]]:
    """(bytes it stands for, ratio) of each chunk."""
    return [(k, len(compress(part)) / size) for k, part in chunks(b, size)]


def measure(text: str | None, bands: Bands, compress) -> tuple:
    """The values of ``FIELDS`` for one text."""
    if not text:
        return (0,) * 9 + (None, None, "empty")
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.split(None, 1)]
    n, i = len(b), bisect.bisect_right(bands.below, len(b))
    ratio, plain = len(compress(b)) / n, plain_ratio(b)
    whole = n <= bands.chunk
    parts = [(n, ratio, plain)] if whole else [(k, len(compress(part)) / bands.chunk, plain_ratio(part)) for k, part in chunks(b, bands.chunk)]
    low, high, most = (bands.low[i], bands.high[i], bands.plain[i]) if whole else (bands.chunk_low, bands.chunk_high, bands.chunk_plain)
    dull, wild = [k for k, x, _ in parts if x < low], [k for k, x, f in parts if x > high or x > most * f]
    if ratio < bands.low[i] or sum(dull) > bands.chunk_share * n:
        verdict = "repetitive"
    elif ratio > bands.high[i] or ratio > bands.plain[i] * plain or sum(wild) > bands.chunk_share * n:
        verdict = "incompressible"
    else:
        verdict = "kept"
    counts = (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), n, len(parts), len(dull), len(wild))
    return (*counts, ratio, plain, verdict)


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document: ``doc_id`` and the fields of ``FIELDS``."""

    @F.pandas_udf(FIELDS)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compress = zstandard.ZstdCompressor(level=bands.level).compress
        memo = Memo(lambda t: measure(t, bands, compress))
        for texts in batches:
            yield pd.DataFrame([memo(t) for t in texts], columns=FIELDS.names)

    return docs.select(F.col(q(id_col)).alias("doc_id"), measured(F.col(q(text_col))).alias("m")).select("doc_id", "m.*")


def verdicts(measured: DataFrame) -> DataFrame:
    """The plain rules first (too few words, too many repeated windows), then the bands' verdict."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("verdict") == "kept")).alias("kept"), "ratio", "plain", "verdict", "n_chunks", "n_repetitive_chunks", "n_noisy_chunks",
    )


BASE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT r, i, w[i:i + 2] AS v FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
t AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, v) AS c FROM g) WHERE c > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n.dup, 0) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""
