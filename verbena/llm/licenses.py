"""License scans: winnowed fingerprints pick candidates, banded alignment confirms and measures them.

Templates are cut into words; the hashes of their word k-grams are winnowed (the smallest of each
window of neighbours is kept) and go to an inverted index from gram to (template, place).  A text is
probed with all of its grams, so every stretch that holds a kept gram is a candidate; around the diagonal
of each, a banded alignment with the whole template reports how many template words are matched in order
and which span they cover.  What accepted stretches leave free is aligned again.

Templates are few and given as a parameter, so the index travels with the task; texts are never
shuffled.  Grams of templates shorter than k words are the whole template.

Defined results: a null or empty text has no hits; repeated rows give repeated hits; spans are zero-based,
half-open, in code points; texts of any length are scanned whole.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, q
from .license_texts import TEMPLATES

_WORD = re.compile(r"[^\W_]+")
HIT = T.ArrayType(T.StructType([T.StructField("template", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("matched", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("coverage", T.DoubleType())]))


@dataclass(frozen=True)
class Params:
    gram: int = 3
    window: int = 4
    band: float = 0.15
    min_band: int = 6
    min_coverage: float = 0.8


def winnow(hashes: list[int], window: int) -> list[int]:
    """Places of the smallest hash of each window, the rightmost of equal ones."""
    window = min(window, len(hashes))
    return sorted({min(range(i, i + window), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - window + 1)})


def align(template: list[int], words: list[int], offset: int, band: int) -> list[tuple[int, int]]:
    """Matched (template place, word place) pairs of the best alignment that stays within ``band`` of
    the diagonal word place = template place + offset.  A match counts 2, a gap or a change -1; the text
    around the alignment is free."""
    m, n = len(template), len(words)
    width = 2 * band + 1
    low = -(10**9)
    score = [[0] * width] + [[low] * width for _ in range(m)]
    move = [[0] * width for _ in range(m + 1)]  # 1 both, 2 template only, 3 text only
    for i in range(1, m + 1):
        above, row, moves, t = score[i - 1], score[i], move[i], template[i - 1]
        for b in range(width):
            j = i + offset - band + b  # words[:j] are used
            if j < 0 or j > n:
                continue
            best, how = low, 0
            if j >= 1 and above[b] > low:
                best, how = above[b] + (2 if words[j - 1] == t else -1), 1
            if b + 1 < width and above[b + 1] - 1 > best:
                best, how = above[b + 1] - 1, 2
            if b and row[b - 1] - 1 > best:
                best, how = row[b - 1] - 1, 3
            row[b], moves[b] = best, how
    b = max(range(width), key=lambda x: (score[m][x], -abs(x - band)))
    i, out = m, []
    while i > 0 and move[i][b]:
        how = move[i][b]
        j = i + offset - band + b
        if how == 1:
            if words[j - 1] == template[i - 1]:
                out.append((i - 1, j - 1))
            i -= 1
        elif how == 2:
            i, b = i - 1, b + 1
        else:
            b -= 1
    return out[::-1]


class Scanner:
    """Templates, their vocabulary and the inverted index of their winnowed grams."""

    def __init__(self, templates: dict[str, str], p: Params):
        self.p, self.names = p, list(templates)
        self.ids: dict[str, int] = {}
        self.words = [[self.ids.setdefault(w, len(self.ids) + 1) for w in _WORD.findall(t.lower())] for t in templates.values()]
        self.base = len(self.ids) + 1
        index: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for n, w in enumerate(self.words):
            k = min(p.gram, len(w))
            grams = [self.key(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []
            hashes = [xxhash.xxh64_intdigest(g.to_bytes(16, "little"), 42) for g in grams]
            for at in winnow(hashes, p.window) if grams else []:
                index.setdefault((k, grams[at]), []).append((n, at))
        self.index = {k: {g: v for (kk, g), v in index.items() if kk == k} for k in {k for k, _ in index}}
        self.keys = {k: np.array(sorted(d), np.int64) for k, d in self.index.items()}

    def key(self, gram: list[int]) -> int:
        out = 0
        for g in gram:
            out = out * self.base + g
        return out

    def stretches(self, t: list[int], ids: np.ndarray, diagonals: set[int], band: int) -> list[tuple[int, int, int]]:
        """(matched, first word, last word) of stretches that share no word, the fullest first.

        The words around every diagonal are aligned, then again what an accepted stretch leaves of them,
        until nothing left reaches the coverage.
        """
        need, most = self.p.min_coverage * len(t), np.bincount(t, minlength=self.base)
        best: list[tuple[int, int, int, int, int, int]] = []
        taken: list[tuple[int, int]] = []

        def tried(d: int, lo: int, hi: int) -> None:
            part = ids[lo:hi]
            if np.minimum(np.bincount(part, minlength=self.base), most)[1:].sum() < need:  # no order of these words has enough
                return
            pairs = align(t, part.tolist(), d - lo, band)
            if pairs and len(pairs) >= need:
                x, y = lo + pairs[0][1], lo + pairs[-1][1]
                heapq.heappush(best, (-len(pairs), y - x, x, d, lo, hi))

        for d in diagonals:
            tried(d, max(0, d - band), min(len(ids), d + len(t) + band))
        out = []
        while best:
            matched, size, x, d, lo, hi = heapq.heappop(best)
            at = bisect.bisect_left(taken, (x, x))
            if (at == 0 or taken[at - 1][1] < x) and (at == len(taken) or taken[at][0] > x + size):
                taken.insert(at, (x, x + size))
                out.append((-matched, x, x + size))
            at = max(0, bisect.bisect_left(taken, (lo, lo)) - 1)
            while lo < hi:  # the free words of lo:hi
                while at < len(taken) and taken[at][1] < lo:
                    at += 1
                stop = min(hi, taken[at][0]) if at < len(taken) else hi
                if stop > lo:
                    tried(d, lo, stop)
                lo = max(stop, taken[at][1] + 1) if at < len(taken) else hi
        return out

    def scan(self, text: str | None) -> list[tuple]:
        """(template, start, end, matched, words, coverage) of each confirmed stretch, by start."""
        if not text:
            return []
        tokens = _WORD.findall(text.lower())
        ids = np.fromiter((self.ids.get(w, 0) for w in tokens), np.int64, len(tokens))
        hits: dict[int, set[int]] = {}
        for k, keys in self.keys.items():
            if len(ids) < k:
                continue
            grams = np.zeros(len(ids) - k + 1, np.int64)
            whole = np.ones(len(grams), bool)
            for j in range(k):
                part = ids[j : j + len(grams)]
                grams = grams * self.base + part
                whole &= part > 0
            places = np.flatnonzero(whole)
            for at in places[np.isin(grams[places], keys)].tolist():
                for n, place in self.index[k][int(grams[at])]:
                    hits.setdefault(n, set()).add(at - place)
        if not hits:
            return []
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        if len(spans) != len(tokens):  # lower-casing made or took a character: find words as they were cut
            low = _lowered(text)
            spans = [(low[m.start()], low[m.end() - 1] + 1) for m in _WORD.finditer(text.lower())]
        out = []
        for n, diagonals in hits.items():
            t = self.words[n]
            band = max(self.p.min_band, int(self.p.band * len(t)))
            for matched, x, y in self.stretches(t, ids, diagonals, band):
                out.append((self.names[n], spans[x][0], spans[y][1], matched, len(t), matched / len(t)))
        return sorted(out, key=lambda r: (r[1], r[2], r[0]))


def _lowered(text: str) -> list[int]:
    """The place in ``text`` of each character of its lower-cased form."""
    return [i for i, ch in enumerate(text) for _ in ch.lower()]


_SCANNERS: dict = {}


def scanner(templates: dict[str, str], p: Params) -> Scanner:
    key = (tuple(templates.items()), p)
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(templates, p)
    return _SCANNERS[key]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, p: Params = Params()) -> DataFrame:
    """One row per confirmed stretch: doc_id, license, start, end, matched_words, license_words, coverage."""
    templates = templates if templates is not None else TEMPLATES

    @F.pandas_udf(HIT)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo(scanner(templates, p).scan)
        for texts in batches:
            yield pd.Series([[dict(zip(("template", "start", "end", "matched", "words", "coverage"), h, strict=True)) for h in memo(t)] for t in texts])

    x = docs.select(F.col(q(id_col)).alias("doc_id"), hits(F.col(q(text_col))).alias("hits")).select("doc_id", F.explode_outer("hits").alias("h")).where("h IS NOT NULL")
    return x.select("doc_id", F.col("h.template").alias("license"), F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("h.matched").alias("matched_words"), F.col("h.words").alias("license_words"), F.col("h.coverage").alias("coverage"))
