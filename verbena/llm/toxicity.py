"""Toxicity scores behind a noisy-channel deobfuscator.

Writers hide words by look-alike characters (``1d10t``), by blanks or marks between letters
(``i d i o t``, ``i.d.i.o.t``, ``i/d/i/o/t``), also marks that take no room, and by repeating letters (``idiooot``).  A text is read as a lattice of
characters: each observed character was written for one of several letters, a run of equal letters
stands for one or two of them, and single letters with blanks or marks between them may be one word.
Viterbi decoding picks the letters that a character language model finds most likely, less what the
channel charges for each change.  Marks inside a word (``1d10t-like``, ``id.iot``) end one word and begin the next, or
stand for nothing.  Words that offer no choice are their own best path and pass as they
are.  A logistic model then scores the restored text.

Trained here: the language model (character trigrams counted over every training text) and the
logistic model (labelled rows outside the held-out fold; at most ``max_labelled``, chosen by id hash, one text each).
Features are all words and character n-grams that tell enough about the labels (``min_g2``).  Scores see the text alone.

Defined results: a null or empty text scores as a text without features (the model's prior); without
labels of both kinds every score is the share of toxic labels (0 if there are none) capped below 0.5;
several labels of one document count as toxic if any is; of texts that share a labelled id one is learned from (that
with the smallest hash); labels or documents with null ids are not used for training; repeated rows score alike; texts
and words of any length are decoded and scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, held_out, materialize, q

# Look-alikes and the letters they may stand for (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "§": "s", "*": "aeiou",
}
_ONE = r"(?:[^\W_]|[@$!|+(<€£§*])"
_BETWEEN = r"[ ._\-/,]"
_CHAIN = re.compile(rf"(?<![\w@$!|+<€£§*])(?:{_ONE})(?:{_BETWEEN}{{1,3}}{_ONE}){{2,}}(?![\w@$|+<€£§*])")
_UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"  # marks that take no room: soft hyphen, zero-width blanks and joiners
_TOKEN = re.compile(r"[\w@$!|+(<€£§*'’-]+(?:\.[\w@$!|+(<€£§*'’-]+)*")
_INNER = "'’-_."
_MARKS = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")  # runs of a symbol at the edges are decoration
_EDGE = "^"
_RUN = re.compile(r"(.)\1\1")


@dataclass(frozen=True)
class Params:
    folds: int = 5
    max_labelled: int = 10_000
    ngram: tuple[int, ...] = (4, 5)
    epochs: int = 12
    l2: float = 1e-5
    change_cost: float = 1.5
    join_cost: float = 0.7
    partitions: int = 12
    min_g2: float = 10.0


@dataclass
class CharModel:
    """Log-probabilities of a letter after two others, smoothed towards shorter contexts.

    Letters outside ``letters`` are one class there; ``rare`` has each one's log-probability inside it.
    """

    letters: str
    logp: np.ndarray
    index: dict = field(default_factory=dict)
    rare: dict = field(default_factory=dict)
    rarest: float = 0.0

    @classmethod
    def fit(cls, letters: str, counts: np.ndarray, rare: dict[str, int] | None = None) -> CharModel:
        """``letters[0]`` is the word edge, ``letters[1]`` stands for all others, which ``rare`` counts."""
        one = counts.sum(axis=(0, 1)) + 0.5
        one /= one.sum()
        two = counts.sum(axis=0)
        two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
        three = (counts + 5 * two[None]) / (counts.sum(axis=2, keepdims=True) + 5)
        total = sum(rare.values()) + 0.5 * len(rare) + 0.5 if rare else 0.0
        own = {ch: float(np.log((n + 0.5) / total)) for ch, n in (rare or {}).items()}
        return cls(letters, np.log(three).astype(np.float32), {ch: i for i, ch in enumerate(letters)}, own, float(np.log(0.5 / total)) if rare else 0.0)

    def place(self, ch: str) -> int:
        return self.index.get(ch, 1)

    def inside(self, ch: str) -> float:
        """Log-probability of a letter inside its class."""
        return self.rare.get(ch, self.rarest)


def char_model(docs: DataFrame, text_col: str = "text", alphabet: int = 96) -> CharModel:
    """The character model of all lower-cased words of ``docs``, word edges included.

    Batches add up their own counts and Spark adds those up.  Contexts are kept for ``alphabet`` letters: all that the channel
    may restore, whatever the scripts of the corpus, then the most frequent.  All others, of which there are 65,536 at most,
    share one place in contexts and have their own frequency inside it, so what reaches the driver is bounded by
    alphabet ** 3 and by that, not by the texts.
    """

    def count(batches):
        for batch in batches:
            total: dict[int, int] = {}
            for text in batch["t"]:
                if not text:
                    continue
                # Letters of the Basic Multilingual Plane as codes; anything else is a word edge (0).
                s = np.frombuffer(f" {text.lower()} ".encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.int64)
                s = np.where(_is_letter()[s], s, 0)
                s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]  # one edge between words
                key = (np.r_[0, s[:-2]] << 32) | (s[:-1] << 16) | s[1:]
                u, n = np.unique(np.where(s[:-1] == 0, s[1:], key), return_counts=True)  # nothing before an edge matters
                for k, c in zip(u.tolist(), n.tolist(), strict=True):
                    total[k] = total.get(k, 0) + c
            yield pd.DataFrame({"g": pd.Series(list(total), dtype="int64"), "n": pd.Series(list(total.values()), dtype="int64")})

    rows = docs.select(F.col(q(text_col)).alias("t")).mapInPandas(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    rows = materialize(rows, "trigrams")
    by_letter = rows.groupBy(F.col("g").bitwiseAND(F.lit(0xFFFF)).alias("ch")).agg(F.sum("n").alias("n")).where("ch > 0").toPandas().sort_values(["n", "ch"], ascending=[False, True])
    seen = dict(zip(by_letter["ch"].tolist(), by_letter["n"].tolist(), strict=True))
    restored = sorted({ord(ch) for letters in LOOKALIKES.values() for ch in letters})
    codes = sorted([*restored, *(ch for ch in seen if ch not in restored)][: alphabet - 2])
    kept = set(codes)
    rare = {chr(ch): n for ch, n in seen.items() if ch not in kept}
    place = np.ones(1 << 16, np.int64)
    place[0] = 0
    place[codes] = np.arange(2, len(codes) + 2)
    size = len(codes) + 2

    def places(batches):
        for batch in batches:
            g = batch["g"].to_numpy()
            yield pd.DataFrame({"k": (place[g >> 32] * size + place[g >> 16 & 0xFFFF]) * size + place[g & 0xFFFF], "n": batch["n"]})

    placed = rows.mapInPandas(places, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size**3)
    counts[placed["k"].to_numpy(np.int64)] = placed["n"].to_numpy(np.float64)
    return CharModel.fit(_EDGE + "?" + "".join(map(chr, codes)), counts.reshape(size, size, size), rare)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def lattice(observed: str) -> list[list[tuple[str, float]]] | None:
    """For each position the strings it may stand for and their costs (in units of Params); None if there is no choice.

    A mark inside the word stands for a word edge, or for nothing.
    """
    out: list[list[tuple[str, float]]] = []
    choice, i = False, 0
    while i < len(observed):
        ch = observed[i]
        j = i
        while j < len(observed) and observed[j] == ch:
            j += 1
        n = j - i
        if ch in LOOKALIKES:
            out += [[(x, 1.0) for x in LOOKALIKES[ch]]] * (n if n < 3 else 1)
            choice = True
        elif ch in _INNER:
            out.append([(_EDGE, 0.0), ("", 1.0)])
            choice = True
        elif n >= 3:
            out.append([(ch, 1.0), (ch * 2, 1.0)])
            choice = True
        else:
            out += [[(ch, 0.0)]] * n
        i = j
    return out if choice else None


def viterbi(steps: list[list[tuple[str, float]]], m: CharModel, cost: float) -> tuple[str, float]:
    """The most likely letters of a lattice and their log-probability, edges included.

    States are the last two letters; each step keeps where its states came from, so time and memory grow with the
    lattice and nothing else.
    """
    logp, place = m.logp, m.place
    states: dict[tuple[int, int], float] = {(0, 0): 0.0}
    back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for options in [*steps, [(_EDGE, 0.0)]]:
        new: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for state, score in states.items():
            for letters, units in options:
                (x, y), s = state, score - cost * units
                for ch in letters:
                    z = place(ch)
                    if y or z:  # edges in a row are one
                        s += float(logp[x if y else 0, y, z])
                    if z == 1:
                        s += m.inside(ch)
                    x, y = y, z
                if (x, y) not in new or s > new[x, y]:
                    new[x, y] = s
                    came[x, y] = state, letters
        states = new
        back.append(came)
    state = max(states, key=lambda k: (states[k], k))
    total, out = states[state], []
    for came in reversed(back):
        state, letters = came[state]
        out.append(letters)
    return "".join(out[:0:-1]), total


def log_prob(word: str, m: CharModel) -> float:
    return viterbi([[(ch, 0.0)] for ch in word], m, 0.0)[1]


class Restorer(dict):
    """Restored form of each token; forgets everything when full."""

    def __init__(self, m: CharModel, p: Params):
        self.m, self.p = m, p

    def __missing__(self, token: str) -> str:
        plain = token.isalpha() and not _RUN.search(token)  # a lattice without choices
        best = token if plain else self.decoded(_MARKS.sub("", token).strip("'’-."))
        if len(token) <= 40:
            if len(self) > 300_000:
                self.clear()
            self[token] = best
        return best

    def decoded(self, core: str) -> str:
        """The likeliest reading; a bracket or symbol at an edge may be punctuation instead of a letter."""
        if not any(map(str.isalpha, core)) or not (steps := lattice(core)):
            return core.strip("'’-?(<*+!|_.")
        bare = core.lstrip("(<*+_").rstrip("!(<|*+_")
        best, s = viterbi(steps, self.m, self.p.change_cost)
        if bare != core:
            other = lattice(bare) or [[(ch, 0.0)] for ch in bare]
            text, t = viterbi(other, self.m, self.p.change_cost)
            if t - self.p.change_cost >= s:
                best = text
        return best.replace(_EDGE, " ")

    def chain(self, match: re.Match) -> str:
        """Single characters with separators: one word if that is likelier than words of one letter."""
        letters = re.sub(_BETWEEN, "", match[0])
        steps = lattice(letters) or [[(ch, 0.0)] for ch in letters]
        word, joined = viterbi(steps, self.m, self.p.change_cost)
        apart = sum(max(log_prob(x, self.m) for x in (LOOKALIKES.get(ch, ch))) for ch in letters)
        return f" {word} " if joined - self.p.join_cost * len(letters) > apart else match[0]


def restore(text: str, r: Restorer) -> list[str]:
    """The words of the restored text."""
    low = text.lower()
    for mark in _UNSEEN:
        if mark in low:
            low = low.replace(mark, "")
    return " ".join(map(r.__getitem__, _TOKEN.findall(_CHAIN.sub(r.chain, low)))).split()


def features(words: list[str], sizes: tuple[int, ...]) -> list[str]:
    """What a text holds: its words and their character n-grams, word edges marked by < and >."""
    out: set[str] = set()
    for word in set(words):
        if word:
            w = f"<{word}>"
            out.add(w)
            for n in sizes:
                out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return sorted(out)


@dataclass
class Model:
    chars: CharModel
    weights: dict[str, float]
    bias: float
    params: Params

    def scorer(self):
        """The scoring function; made once per worker, with an automaton that finds the features."""
        if not hasattr(self, "_scorer"):
            found = ahocorasick.Automaton()
            for n, f in enumerate(self.weights):
                found.add_word(f, n)
            found.make_automaton()
            r, values, empty = Restorer(self.chars, self.params), list(self.weights.values()), not self.weights

            def score(text: str | None) -> float:
                if not text or empty:
                    return logistic(self.bias)
                marked = "<" + "><".join(restore(text, r)) + ">"
                return logistic(self.bias + sum(values[n] for n in sorted({n for _, n in found.iter(marked)})))

            self._scorer = score
        return self._scorer

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_scorer"}


def logistic(z: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def fit_logistic(rows: list[list[int]], y: np.ndarray, n_features: int, p: Params) -> tuple[np.ndarray, float]:
    """Sparse logistic regression by AdaGrad over binary features, in a fixed order of rows."""
    n, toxic = len(rows), float(y.sum())
    w, g2 = np.zeros(n_features), np.full(n_features, 1e-2)
    if toxic in (0.0, float(n)):
        share = min(toxic / n if n else 0.0, 0.49)
        return w, float(np.log((share + 1e-4) / (1 - share + 1e-4)))
    bias, b2 = float(np.log(toxic / (n - toxic))), 1e-2
    arrays = [np.array(r, np.int64) for r in rows]
    rng = np.random.default_rng(7)
    for _ in range(p.epochs):
        for i in rng.permutation(n):
            r = arrays[i]
            e = 1.0 / (1.0 + np.exp(-np.clip(w[r].sum() + bias, -30, 30))) - y[i]
            g = e + p.l2 * w[r]
            g2[r] += g * g
            w[r] -= 0.3 * g / np.sqrt(g2[r])
            b2 += e * e
            bias -= 0.1 * e / np.sqrt(b2)
    return w, bias


def g_squared(t, c, n_toxic: int, n_clean: int):
    """Column: how much a feature's presence in t toxic and c clean rows tells (log-likelihood ratio)."""
    n = float(n_toxic + n_clean)

    def part(seen, present, rows):
        return F.when(seen > 0, 2 * seen * F.log(seen * n / (present * rows))).otherwise(0.0)

    return part(t, t + c, n_toxic) + part(c, t + c, n_clean) + part(n_toxic - t, n - t - c, n_toxic) + part(n_clean - c, n - t - c, n_clean)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> Model:
    """Train on ``docs`` (all texts for the character model) and ``labels`` (doc_id, toxic)."""
    chars = char_model(docs, text_col)
    lab = labels.select(F.col("doc_id").alias("lid"), F.col("toxic").alias("toxic")).where("lid IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("lid"), p.folds))
    lab = lab.groupBy("lid").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("lid"), "lid").limit(p.max_labelled)  # the documented bound
    texts = docs.select(F.col(q(id_col)).alias("id"), F.col(q(text_col)).alias("text")).where("id IS NOT NULL").join(F.broadcast(lab), F.col("id") == F.col("lid"))
    # One text of an id; as a partial aggregation, so an id that very many rows share is one row of each task.
    texts = texts.groupBy("id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    def featured(batches):
        r = Restorer(shared.value, p)
        for batch in batches:
            yield pd.DataFrame({"toxic": (batch["toxic"] > 0).astype("int64"), "f": [features(restore(t, r), p.ngram) if t else [] for t in batch["text"]]})

    rows = materialize(texts.select("toxic", "text").repartition(p.partitions).mapInPandas(featured, "toxic long, f array<string>"), "features")
    both = {int(r["toxic"]): int(r["n"]) for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = both.get(1, 0), both.get(0, 0)
    names: list[str] = []
    if n_toxic and n_clean:
        seen = rows.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").cast("double").alias("t"), F.count("*").cast("double").alias("n")).where("n >= 3")
        told = seen.withColumn("g", g_squared(F.col("t"), F.col("n") - F.col("t"), n_toxic, n_clean)).where(F.col("g") >= p.min_g2)
        names = sorted(r["f"] for r in told.select("f").collect())  # bounded by the labelled texts
    number = {f: i for i, f in enumerate(names)}

    def chosen(batches):
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "f": [[number[x] for x in f if x in number] for f in batch["f"]]})

    data = rows.mapInPandas(chosen, "toxic long, f array<int>").toPandas()
    data["f"] = [sorted(map(int, f)) for f in data["f"]]
    data = data.assign(key=data["f"].map(str)).sort_values(["toxic", "key"])  # the same order, however tasks were dealt
    weights, bias = fit_logistic(data["f"].tolist(), data["toxic"].to_numpy(float), len(names), p)
    return Model(chars, {f: float(w) for f, w in zip(names, weights, strict=True) if w}, bias, p)


def score_column(spark, model: Model, text):
    """Column function: toxicity of a text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo(shared.value.scorer())
        for texts in batches:
            yield pd.Series([memo(t) for t in texts], dtype="float64")

    return toxicity(text)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, p)
    x = docs.select(F.col(q(id_col)).alias("doc_id"), score_column(docs.sparkSession, model, F.col(q(text_col))).alias("score"))
    return x.select("doc_id", held_out(F.col("doc_id"), p.folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """The documents that score below 0.5, all columns kept."""
    model = fit(docs, labels, id_col, text_col, p)
    return docs.where(score_column(docs.sparkSession, model, F.col(q(text_col))) < 0.5)
