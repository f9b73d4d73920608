"""Text scores of a causal self-attention model over subword ids, trained in numpy.

Words ``[^\\x20\\x09-\\x0D]+`` in lower case (A-Z only) are cut into the ids of a public byte-level BPE
vocabulary, each word as it reads after a blank; one end token closes a text.  The ``head`` most frequent
ids are classes of their own, all others share one class and are told apart inside it by smoothed
counts, so probabilities sum to one over the whole vocabulary.

The model: embeddings of class and position, one causal attention head, a residual sum, a softmax in
two steps (first a group of about the square root of all classes, then a class inside it).
Training gathers from every training document: word counts, class bigrams, and windows side by side
that cover all of its text, so each id is a target once.  Embeddings start from the singular vectors of
the bigram table; then come ``rounds`` of local Adam passes, each over its share of the windows, so all rounds
together are one pass over all text.  Windows lie in blocks in the shared folder and are trained on where a task reads
them, never shuffled; parameters of all tasks (``max_trainers`` at most) are averaged in ``averages`` groups on
executors first, so the driver receives that many sets.

Scoring: a text is cut into windows of ``width`` ids that overlap by ``overlap``; each id is scored
once, in the first window that has it beyond the overlap, and windows of many texts go through the
masked attention as one batch.  Words are coded by their place in the list of distinct words of about a
million characters of text, so all but the lookup of a word runs on arrays.  The probability of a word is a mixture: ``1 - mix`` times the attention
model's for its ids, plus ``mix`` times its share among all training tokens, so words seen often
need not be spelled out.  Both parts sum to one at
most, so the score is the log10 probability of the text under one model.  Counts of the ``frequent`` most
frequent words are looked up where the text is; each other word leaves its log-probabilities by
spelling there, which meet its count in a join.  ``mix`` is learned: of
``mixes``, that one under which the training texts of fold 1 are likeliest when the shares leave out
the text that is scored.  The held-out fold has no part in it.

Beside the model's score stands a unigram base with the same lookup and the same join, on the word's
XXH64, which many texts with one hot word cannot skew, since hot words are frequent ones.

Defined results: a null text counts as empty (its one token is the end); without training texts counts
are zero and the model is uniform; repeated rows score alike; null ids are in no training fold's way
(they count as the text ''); texts of any length are scored whole.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, materialize, q
from .packing import encoding


@dataclass(frozen=True)
class Params:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    folds: int = 10
    head: int = 1022
    dim: int = 32
    width: int = 48
    overlap: int = 16
    rounds: int = 4
    batch: int = 192
    rate: float = 6e-3
    block_windows: int = 32
    max_trainers: int = 1024
    averages: int = 4
    frequent: int = 50_000
    alpha: float = 0.1
    mixes: tuple[float, ...] = (0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98)


def keep_memory() -> None:
    """Has the allocator keep what arrays free for those that follow.

    It asks the system for new pages for each array above the largest one freed so far (32 MB at most), and touching new pages cost a third of training.
    """
    np.empty(31 << 20, np.uint8)


class WordIds:
    """Subword ids of words, one list after the other; forgets everything when full."""

    def __init__(self, vocabulary: str, held: int = 300_000):
        tokenizer = encoding(vocabulary)
        self.encode, self.held = tokenizer.encode_ordinary, held
        self.n_bytes = np.zeros(tokenizer.n_vocab, np.int64)
        for token in tokenizer.token_byte_values():
            self.n_bytes[tokenizer.encode_single_token(token)] = len(token)
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids, self.begin, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __getitem__(self, word: bytes) -> list[int]:
        return self.cut([word])[0].tolist()

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has.  They are encoded as one text, since no piece goes on over a blank, unless
        white space beyond ASCII meets it."""
        texts = [" " + as_text(w) for w in words]
        alone = [i for i, t in enumerate(texts) if t[1].isspace() or t[-1].isspace()]
        apart = {i: self.encode(texts[i]) for i in alone}
        for i in alone:
            texts[i] = ""
        ids = np.array(self.encode("".join(texts)), np.int32)
        length = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        size = np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(length), "right"), prepend=0)
        if alone:
            begin = np.cumsum(size)[alone]
            size[alone] = [len(x) for x in apart.values()]
            ids = np.insert(ids, np.repeat(begin, size[alone]), np.fromiter(chain.from_iterable(apart.values()), np.int32))
        return ids, size

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one word after the other, and how many each has."""
        place = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new) and self.at and (len(self.at) + len(new) > self.held or len(self.ids) > 8 * self.held):
            self.forget()
            new = np.arange(len(words))
        if len(new):
            unknown = [words[i] for i in new.tolist()]
            ids, size = self.encoded(unknown)
            place[new] = np.arange(len(self.size), len(self.size) + len(new))
            self.at.update(zip(unknown, place[new].tolist(), strict=True))
            self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(size) - size]
            self.ids, self.size = np.r_[self.ids, ids], np.r_[self.size, size]
        size = self.size[place]
        return self.ids[np.arange(size.sum()) + np.repeat(self.begin[place] - np.cumsum(size) + size, size)], size


_IDS: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    return _IDS.setdefault(vocabulary, WordIds(vocabulary))


def as_text(word: bytes) -> str:
    return word.decode("utf-8", "replace")


def distinct_words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts, the place in that list of each word of the texts, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    coded = pc.dictionary_encode(split.flatten())
    words, code = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    length = np.diff(split.offsets.to_numpy())
    if b"" in words:  # stands before and after blanks at the ends of a text
        none = words.index(b"")
        del words[none]
        length = length - np.bincount(np.repeat(np.arange(len(length)), length)[code == none], minlength=len(length))
        code = code[code != none]
        code = code - (code > none)
    return words, code, length


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts exp(z - shift) in the place of rows of logits; gives the shifts (0, or one a row) and the sums of rows."""
    shift = np.zeros(1, z.dtype)
    if len(z) and not (z.max() < 60 and z.min() > -60):
        shift = z.max(axis=1)
        z -= shift[:, None]
    np.exp(z, out=z)
    return shift, z @ np.ones(z.shape[1], z.dtype)


def own_less_all(x: np.ndarray, weights: np.ndarray, bias: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log-softmax of the logits of rows ``x`` at the columns ``own``."""
    z = x @ weights
    z += bias
    mine = z.ravel().take(np.arange(0, z.size, z.shape[1]) + own)
    shift, total = exponentials(z)
    mine -= np.log(total)
    mine -= shift
    return mine


@dataclass
class Network:
    """Parameters by name and the group of each class; class ``n - 1`` begins and ends a text."""

    w: dict[str, np.ndarray]
    group: np.ndarray

    @cached_property
    def members(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.group == k) for k in range(self.group.max() + 1)]

    @cached_property
    def place(self) -> np.ndarray:
        """Of each class inside its group."""
        place = np.zeros(len(self.group), np.int64)
        for m in self.members:
            place[m] = np.arange(len(m))
        return place

    @classmethod
    def start(cls, bigrams: np.ndarray, p: Params) -> Network:
        """Embeddings and output weights whose product is the best low-rank fit to log P(next | this) - log P(next)."""
        n, rng = len(bigrams), np.random.default_rng(11)
        c = bigrams + 0.0
        one = (c.sum(axis=0) + p.alpha) / (c.sum() + p.alpha * n)
        two = (c + 10 * one) / (c.sum(axis=1, keepdims=True) + 10)
        weight = np.sqrt(c.sum(axis=1) + 1)[:, None]
        u, s, vt = np.linalg.svd((np.log(two) - np.log(one)) * weight, full_matrices=False)
        d = min(p.dim, len(s))
        e, out = np.zeros((n, p.dim)), np.zeros((p.dim, n))
        e[:, :d], out[:d] = u[:, :d] * np.sqrt(s[:d]) / weight, np.sqrt(s[:d])[:, None] * vt[:d]
        scale = np.sqrt((np.abs(out).mean() + 1e-6) / (np.abs(e).mean() + 1e-6))
        w = {"E": e * scale, "U": out / scale, "b": np.log(one), "P": np.zeros((p.width, p.dim)), "Wo": np.zeros((p.dim, p.dim))}
        group = np.zeros(n, np.int64)
        halves = [np.arange(n)]
        while len(halves) ** 2 < n:  # cut at the middle of the widest direction, so groups hold classes that follow alike
            cuts = [h[np.argsort(out[np.argmax(out[:, h].var(axis=1)), h], kind="stable")] for h in halves]
            halves = [part for h in cuts for part in (h[: len(h) // 2], h[len(h) // 2 :]) if len(part)]
        for k, h in enumerate(halves):
            group[h] = k
        w["c"] = np.log(np.array([one[h].sum() for h in halves]))
        w["G"] = np.stack([w["U"][:, h] @ one[h] / one[h].sum() for h in halves], axis=1)
        size = np.abs(w["E"]).mean() + 1e-3
        for k in ("Wq", "Wk", "Wv"):
            w[k] = rng.normal(0, 1 / np.sqrt(p.dim), (p.dim, p.dim)) / (np.sqrt(size) if k != "Wv" else 1)
        return cls({k: v.astype(np.float32) for k, v in w.items()}, group)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By class and by position, side by side: query, key, value times ``Wo``, embedding.  Those of an input are sums of two rows."""
        w, dim = self.w, self.w["E"].shape[1]
        maps = np.concatenate([w["Wq"] / dim**0.5, w["Wk"], w["Wv"] @ w["Wo"], np.eye(dim, dtype=w["Wq"].dtype)], axis=1)
        return w["E"] @ maps, w["P"] @ maps

    def hidden(self, x: np.ndarray, skip: int = 0, tables: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """Activations for inputs of shape (windows, positions), the states last; attention logits stay within 40 of zero.

        The first ``skip`` positions are only attended to: queries and later activations leave them out.
        """
        by_class, by_position = tables or self.tables()
        rows = by_class.take(x, axis=0)
        rows += by_position[: x.shape[1]]
        (n, size), dim = x.shape, rows.shape[2] // 4
        q, k, v, h0 = (rows[..., i * dim : (i + 1) * dim] for i in range(4))
        e = q[:, skip:] @ k.transpose(0, 2, 1)
        if e.size and not (e.max() < 40 and e.min() > -40):
            np.clip(e, -40, 40, out=e)
        np.exp(e, out=e)
        e *= np.tri(size - skip, size, skip, e.dtype)  # no position sees a later one
        total = (e.reshape(-1, size) @ np.ones(size, e.dtype)).reshape(n, size - skip, 1)
        c = e @ v
        c /= total
        return rows, e, total, c, c + h0[:, skip:]

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probability of classes y after hidden states h (rows)."""
        w, g = self.w, self.group.take(y)
        out = own_less_all(h, w["G"], w["c"], g)
        rows = np.argsort(g.astype(np.int16), kind="stable")
        near, own, inside = h.take(rows, axis=0), self.place.take(y.take(rows)), np.empty(len(y), out.dtype)
        ends = np.cumsum(np.bincount(g, minlength=len(self.members))).tolist()
        for a, b, m in zip([0, *ends], ends, self.members, strict=False):
            if a < b:
                inside[a:b] = own_less_all(near[a:b], w["U"][:, m], w["b"][m], own[a:b])
        out[rows] += inside
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, attended: int = 48) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of y (-1: no target).  Attention goes over ``attended`` windows at once, which a cache holds."""
        w, dim, tables = self.w, self.w["E"].shape[1], self.tables()
        parts = [self.hidden(x[i : i + attended], 0, tables) for i in range(0, len(x), attended)]
        h = np.concatenate([p[-1] for p in parts])
        flat = lambda t: t.reshape(-1, t.shape[-1])
        at = np.flatnonzero(y >= 0)
        of = self.group.take(y.ravel().take(at))
        order = np.argsort(of.astype(np.int16), kind="stable")  # by group
        at, of = at.take(order), of.take(order)
        rows, y = flat(h).take(at, axis=0), y.ravel().take(at)
        g, share = {k: np.zeros_like(w[k]) for k in ("U", "b")}, 1 / max(1, len(y))

        def step(x, weights, bias, own):
            """Gradients of weights, bias and x where class ``own`` was right."""
            dz = x @ weights
            dz += bias
            dz *= (share / exponentials(dz)[1])[:, None]
            dz.reshape(-1)[np.arange(0, dz.size, dz.shape[1]) + own] -= share
            return x.T @ dz, np.ones(len(dz), dz.dtype) @ dz, dz @ weights.T

        g["G"], g["c"], d = step(rows, w["G"], w["c"], of)
        ends, own = np.cumsum(np.bincount(of, minlength=len(self.members))).tolist(), self.place.take(y)
        for a, b, m in zip([0, *ends], ends, self.members, strict=False):
            if a < b:
                g["U"][:, m], g["b"][m], more = step(rows[a:b], w["U"][:, m], w["b"][m], own[a:b])
                d[a:b] += more
        dh = np.zeros_like(h)
        flat(dh)[at] = d
        maps = np.concatenate([w["Wq"] / dim**0.5, w["Wk"], w["Wv"] @ w["Wo"]], axis=1)
        dmaps, dx = np.zeros_like(maps), np.empty_like(dh)
        for k, (rows, e, total, c, _) in enumerate(parts):
            at = slice(k * attended, k * attended + len(rows))
            q, k, v, h0 = (rows[..., i * dim : (i + 1) * dim] for i in range(4))
            dc = dh[at] / total
            de = dc @ v.transpose(0, 2, 1)
            c *= dc
            de -= (flat(c) @ np.ones(dim, c.dtype)).reshape(total.shape)  # the sum of de * e / total over what a position attends to
            de *= e
            each = np.concatenate([de @ k, de.transpose(0, 2, 1) @ q, e.transpose(0, 2, 1) @ dc], axis=2)  # of queries, keys and values
            dmaps += flat(h0).T @ flat(each)
            np.matmul(flat(each), maps.T, out=flat(dx[at]))
        dx += dh
        g["Wq"], g["Wk"], mixed = dmaps[:, :dim] / dim**0.5, dmaps[:, dim : 2 * dim], dmaps[:, 2 * dim :]
        g["Wv"], g["Wo"] = mixed @ w["Wo"].T, w["Wv"].T @ mixed
        order = np.argsort(x.astype(np.int16 if len(self.group) < 1 << 15 else np.int64), axis=None, kind="stable")
        seen = x.ravel()[order]
        starts = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]])
        g["E"] = np.zeros_like(w["E"])
        g["E"][seen[starts]] = np.add.reduceat(flat(dx).take(order, axis=0), starts, axis=0)
        g["P"] = np.zeros_like(w["P"])
        g["P"][: x.shape[1]] = dx.sum(axis=0)
        return g


def bounded_counts(batches: Iterator[pd.DataFrame], held: int = 200_000) -> Iterator[pd.DataFrame]:
    """Counts of the words of column ``text``, handed on when ``held`` distinct ones have come together."""
    c: dict[bytes, int] = defaultdict(int)

    def rows() -> pd.DataFrame:
        return pd.DataFrame({"word": [as_text(w) for w in c], "h": pd.Series([word_hash(w) for w in c], dtype="int64"), "c": pd.Series(list(c.values()), dtype="int64")})

    for batch in batches:
        for part in slices(list(batch["text"])):
            words, code, _ = distinct_words(part)
            for w, n in zip(words, np.bincount(code, minlength=len(words)).tolist(), strict=True):
                c[w] += n
            if len(c) >= held:
                yield rows()
                c.clear()
    if c:  # a frame without rows has no column types
        yield rows()


def packed_rows(table: np.ndarray) -> list[bytes]:
    """Each row of a table of counts as its nonzero places and their counts."""
    out = []
    for row in table:
        at = np.flatnonzero(row)
        out.append(np.concatenate([at, row[at]]).tobytes())
    return out


def added_up(pickled: pd.Series, size: int) -> np.ndarray:
    row = np.zeros(size, np.int64)
    for part in pickled:
        at, n = np.frombuffer(part, np.int64).reshape(2, -1)
        row[at] += n
    return row


def unpacked(batches: Iterator[pd.DataFrame], held: type, p: Params) -> Iterator[np.ndarray]:
    """Windows out of the blocks of column ``w``, sixteen training batches at once."""
    for batch in batches:
        rows = np.frombuffer(b"".join(batch["w"]), held).reshape(-1, p.width + 1)
        for i in range(0, len(rows), 16 * p.batch):
            yield rows[i : i + 16 * p.batch].astype(np.int64)


def train_pass(net: Network, windows: Iterator[np.ndarray], p: Params) -> int:
    """One Adam pass over windows of inputs and targets in one array (start token first, -1 after the end)."""
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    s = {k: np.zeros_like(v) for k, v in net.w.items()}
    t = seen = 0
    for block in windows:
        for at in range(0, len(block), p.batch):
            b = block[at : at + p.batch]
            g = net.gradients(np.maximum(b[:, :-1], 0), b[:, 1:])
            t, seen = t + 1, seen + len(b)
            for k, v in g.items():
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                net.w[k] -= np.float32(p.rate) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + np.float32(1e-8))
    return seen


def covering(y: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Windows of inputs and targets (start token first, -1 after the end) that hold each id of texts once as a target.

    ``y``: the end, then all texts, each closed by the end; ``length``: of each text.
    """
    begin, windows = np.cumsum(length) - length, -(-length // width)
    k = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (np.repeat(begin, windows) + k * width)[:, None] + np.arange(width + 1)
    return np.where(at <= np.repeat(begin + length, windows)[:, None], y[np.minimum(at, len(y) - 1)], -1)


def average(n: pd.Series, w: pd.Series) -> pd.DataFrame:
    """The mean of pickled parameters, weighted by n, as one row."""
    total, mean = int(n.sum()), {}
    for part, pickled in zip(n.tolist(), w, strict=True):
        for k, v in pickle.loads(pickled).items():
            mean[k] = mean.get(k, 0) + v * np.float32(part / total)
    return pd.DataFrame({"n": [total], "w": [pickle.dumps(mean)]})


@dataclass
class Model:
    net: Network
    classes: np.ndarray  # class of each id
    tail: np.ndarray  # natural log-probability of an id inside its class
    frequent: dict[bytes, int]  # counts of frequent words
    n_train: int  # all training tokens
    v_train: int  # distinct ones
    docs: int  # training texts, the count of the end token
    params: Params
    mix: float = 0.5  # weight of the shares

    @cached_property
    def n_frequent(self) -> int:
        return sum(self.frequent.values()) + self.docs

    @property
    def weight(self) -> float:
        """Of the shares; nothing without training texts."""
        return self.mix if self.n_train else 0.0

    @property
    def denominator(self) -> float:
        return self.n_train + self.params.alpha * (self.v_train + 1)


def slices(texts: list[str | None], size: int = 1_000_000) -> Iterator[list[str | None]]:
    """Runs of texts with about ``size`` characters at most, or one longer text."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text or "") > size:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text or "") + 1
    if part:
        yield part


#: Stands for the end of a text among its words; no word can hold a blank.
END = b" "


@dataclass
class Coded:
    """Texts as codes into the list of their distinct words; code 0 is the end, which closes each text."""

    words: list[bytes]
    code: np.ndarray
    begin: np.ndarray  # of each text in ``code``
    length: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Coded:
        words, code, length = distinct_words(texts)
        end = np.cumsum(length + 1)
        codes, word = np.zeros(len(code) + len(length), np.int64), np.ones(len(code) + len(length), bool)
        word[end - 1] = False
        codes[word] = code + 1
        return cls([END, *words], codes, end - length - 1, length + 1)

    def values(self, of: dict[bytes, float], end: float, default: float) -> np.ndarray:
        """A number for each distinct word."""
        return np.array([end, *(of.get(w, default) for w in self.words[1:])], float)

    def pieces(self, classes: np.ndarray, tail: np.ndarray, end: int, ids: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes and tails of the subwords of all texts, where each word begins and how many it has."""
        flat, size = ids.cut(self.words[1:])
        size = np.r_[1, size]
        each, tails = np.r_[end, classes[flat]], np.r_[np.float32(0), tail[flat]]
        n = size[self.code]
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[self.code] - first, n)
        return each[at], tails[at], first, n


def spelled(coded: Coded, model: Model, ids: WordIds, windows_at_once: int = 768, attended: int = 64) -> np.ndarray:
    """Natural log-probability that the attention model gives to each word and end."""
    p, net, tables = model.params, model.net, model.net.tables()
    y, tails, first, n = coded.pieces(model.classes, model.tail, len(net.group) - 1, ids)
    x = np.r_[y[-1], y[:-1]]  # each text begins with the class that ended the one before
    length = np.add.reduceat(n, coded.begin)
    begin, step = np.cumsum(length) - length, p.width - p.overlap
    windows = 1 + np.maximum(0, -((p.width - length) // step))
    k = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start, stop = np.repeat(begin, windows) + k * step, np.repeat(begin + length, windows)
    along, out = np.arange(p.width), tails.astype(np.float64)
    for skip, chosen in ((0, np.flatnonzero(k == 0)), (p.overlap, np.flatnonzero(k > 0))):
        for i in range(0, len(chosen), windows_at_once):
            b = chosen[i : i + windows_at_once]
            at = start[b, None] + along
            inputs, at = x[np.minimum(at, len(x) - 1)], at[:, skip:]
            new = at < stop[b, None]
            h = np.concatenate([net.hidden(inputs[j : j + attended], skip, tables)[-1] for j in range(0, len(inputs), attended)])
            out[at[new]] += net.log_probs(h[new], y[at[new]])
    return np.add.reduceat(out, first)


def shares(coded: Coded, model: Model, left_out: bool = False) -> np.ndarray:
    """Natural log of each word's and end's share among training tokens, without its own text's if ``left_out``.

    Words beyond the frequent ones have NaN; their counts are in a table.
    """
    c = coded.values(model.frequent, model.docs, np.nan)[coded.code]
    total = np.full(len(coded.begin), float(model.n_train))
    if left_out:
        text = np.repeat(np.arange(len(coded.begin)), coded.length)
        _, back, own = np.unique(text * len(coded.words) + coded.code, return_inverse=True, return_counts=True)
        c, total = np.maximum(0, c - own[back]), total - coded.length
    with np.errstate(divide="ignore"):
        return np.log(c / np.repeat(np.maximum(1, total), coded.length))


def mixed(spelling: np.ndarray, known: np.ndarray, mix: float, coded: Coded) -> np.ndarray:
    """log10 probability of each text, without its words of unknown share, by spelling and by share."""
    with np.errstate(divide="ignore"):
        each = np.logaddexp(spelling + np.log1p(-mix), known + np.log(mix))
    return np.add.reduceat(np.where(np.isnan(known), 0, each), coded.begin) / np.log(10)


def score_coded(coded: Coded, model: Model, ids: WordIds, spelling: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each text, without its words beyond the frequent ones."""
    spelling = spelled(coded, model, ids) if spelling is None else spelling
    return mixed(spelling, shares(coded, model), model.weight, coded)


def rare_words(coded: Coded, rare: np.ndarray, spelling: np.ndarray) -> tuple[list[np.ndarray], ...]:
    """Of each text: hashes of its distinct words at the places ``rare``, how often each is there, where its log-probabilities by
    spelling begin (from 1), and those of all."""
    n = len(coded.begin)
    text = np.repeat(np.arange(n), coded.length)[rare]
    key = text * len(coded.words) + coded.code[rare]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    stop, (of, code) = np.cumsum(np.bincount(text, minlength=n)), np.divmod(key[first], len(coded.words))
    codes, back = np.unique(code, return_inverse=True)
    h = np.fromiter((word_hash(coded.words[c]) for c in codes.tolist()), np.int64, len(codes))[back]
    ends = np.searchsorted(of, np.arange(1, n))
    begin = first - np.r_[0, stop[:-1]][of] + 1
    return *(np.split(x, ends) for x in (h, np.diff(first, append=len(key)), begin)), np.split(spelling[rare][order], stop[:-1])


def each_rare():
    """Column: a row for each rare word of a text with h, k and its log-probabilities by spelling ``each``."""
    return F.inline(F.transform(F.arrays_zip("h", "k", "b"), lambda x: F.struct(x["h"].alias("h"), x["k"].alias("k"), F.slice("s", x["b"], x["k"]).alias("each"))))


def log_mixed(s, share, mix: float):
    """Column: log of ``1 - mix`` times exp(``s``) plus ``mix`` times ``share``."""
    if not mix:
        return s
    a, b = s + float(np.log1p(-mix)), F.log(share) + float(np.log(mix))
    return F.when(share > 0, F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))).otherwise(a)


def rare_sum(spelling, share, mix: float):
    """Column: log10 probability of the places of a word that has these log-probabilities by spelling."""
    return F.aggregate(spelling, F.lit(0.0), lambda t, s: t + log_mixed(s, share, mix)) / float(np.log(10))


def learn_mix(train: DataFrame, model: Model, counts: DataFrame) -> float:
    """The mix that suits texts (column ``text``) of the training set best; ``len(mixes)`` sums a task reach the driver."""
    p = model.params
    shared = train.sparkSession.sparkContext.broadcast(model)

    def sums(batches):
        """Sums over frequent words by mix (k >= 0), and the rare words of each text (k = -1)."""
        keep_memory()
        m, ids, total = shared.value, word_ids(p.vocabulary), np.zeros(len(p.mixes))
        for batch in batches:
            copies = Counter(t or "" for t in batch["text"])
            for part in slices(list(copies)):
                coded, times = Coded.of(part), [copies[t] for t in part]
                spelling, known = spelled(coded, m, ids), shares(coded, m, left_out=True)
                total += [mixed(spelling, known, mix, coded) @ times for mix in p.mixes]
                h, k, b, s = rare_words(coded, np.isnan(known), spelling)
                yield pd.DataFrame({"mix": -1, "sum": 0.0, "times": times, "left": m.n_train - coded.length, "h": h, "k": k, "b": b, "s": s})
        yield pd.DataFrame({"mix": range(len(total)), "sum": total, "times": 0, "left": 0, "h": None, "k": None, "b": None, "s": None})

    rows = materialize(train.mapInPandas(sums, "mix int, sum double, times long, left long, h array<long>, k array<int>, b array<int>, s array<double>"), "mixes")
    met = rows.where("mix < 0").select("times", "left", each_rare()).join(counts, "h", "left")
    share = F.greatest(F.lit(0), F.coalesce("c", F.lit(0)) - F.col("k")) / F.greatest(F.lit(1), F.col("left"))
    rare = met.select("times", "each", share.alias("share")).agg(*(F.sum(F.col("times") * rare_sum(F.col("each"), F.col("share"), mix)).alias(f"m{k}") for k, mix in enumerate(p.mixes))).first()
    found = rows.where("mix >= 0").groupBy("mix").agg(F.sum("sum").alias("sum")).toPandas()
    if not len(found):
        return model.mix
    found["sum"] += [rare[k] or 0.0 for k in found["mix"]]
    return p.mixes[int(found.sort_values(["sum", "mix"])["mix"].iloc[-1])]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> tuple[Model, DataFrame]:
    """The model and the table (h, c) of all training words' counts."""
    spark = docs.sparkSession
    train = docs.select(F.col(q(id_col)).alias("id"), F.col(q(text_col)).alias("text")).where(~held_out(F.col("id"), p.folds))
    tuning, train = train.where(fold(F.col("id"), p.folds) == 1).select("text"), train.select("text")

    words = materialize(train.mapInPandas(bounded_counts, "word string, h long, c long").groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c")), "words")
    n_docs = train.count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = words.orderBy(F.desc("c"), "h").limit(p.frequent).toPandas()
    frequent = {w.encode(): int(c) for w, c in zip(top["word"], top["c"], strict=True)}

    size = encoding(p.vocabulary).n_vocab

    def id_counts(batches):
        ids, total = word_ids(p.vocabulary), np.zeros(size, np.int64)
        for batch in batches:
            flat, n = ids.cut([w.encode() for w in batch["word"]])
            total += np.bincount(flat, np.repeat(batch["c"], n), size).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"i": seen, "n": total[seen]})

    seen = words.mapInPandas(id_counts, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    n = np.zeros(size)
    n[seen["i"].to_numpy(np.int64)] = seen["n"].to_numpy(float)
    head = np.lexsort((np.arange(size), -n))[: p.head]
    classes, tail = np.full(size, p.head, np.int64), np.zeros(size, np.float32)
    classes[head] = np.arange(len(head))
    rest = classes == p.head
    tail[rest] = np.log((n[rest] + p.alpha) / (n[rest].sum() + p.alpha * rest.sum()))
    n_classes, end = p.head + 2, p.head + 1
    held = np.int16 if n_classes < 1 << 15 else np.int32

    def gather(batches):
        """The windows of all texts in blocks (k = -1) and, at the end, the task's class bigrams by first class (k >= 0)."""
        keep_memory()
        ids, table = word_ids(p.vocabulary), np.zeros(n_classes * n_classes, np.int64)
        for batch in batches:
            for part in slices(list(batch["text"])):
                coded = Coded.of(part)
                y, _, _, n = coded.pieces(classes, tail, end, ids)
                y = np.r_[end, y]  # each text begins with the end before it
                follows = y[:-1] * n_classes + y[1:]
                for i in range(0, len(follows), 1 << 20):
                    table += np.bincount(follows[i : i + (1 << 20)], minlength=len(table))
                rows = covering(y, np.add.reduceat(n, coded.begin), p.width).astype(held)
                rows = rows[np.random.default_rng(len(rows)).permutation(len(rows))]  # neighbours in a text are not neighbours in training
                blocks = [rows[i : i + p.block_windows].tobytes() for i in range(0, len(rows), p.block_windows)]
                yield pd.DataFrame({"k": np.full(len(blocks), -1), "w": blocks})
        yield pd.DataFrame({"k": range(n_classes), "w": packed_rows(table.reshape(n_classes, n_classes))})

    gathered = materialize(train.mapInPandas(gather, "k long, w binary"), "gathered")
    sums = gathered.where("k >= 0").groupBy("k").applyInPandas(lambda g: pd.DataFrame({"k": g["k"][:1], "w": packed_rows(added_up(g["w"], n_classes)[None])}), "k long, w binary")
    table = np.zeros((n_classes, n_classes))
    for r in sums.toPandas().itertuples():  # a row a class
        table[r.k] = added_up(pd.Series([r.w]), n_classes)
    net = Network.start(table, p)

    blocks = gathered.where("k < 0").select("w", F.pmod(F.xxhash64("w"), F.lit(p.rounds)).alias("round"))
    for n_round in range(p.rounds if n_docs else 0):
        shared = spark.sparkContext.broadcast(net)

        def local(batches, shared=shared):
            keep_memory()
            own = Network({k: v.copy() for k, v in shared.value.w.items()}, shared.value.group)
            seen = train_pass(own, unpacked(batches, held, p), p)
            yield pd.DataFrame({"n": [seen], "w": [pickle.dumps(own.w)]})

        parts = blocks.where(F.col("round") == n_round).select("w").coalesce(p.max_trainers).mapInPandas(local, "n long, w binary").where("n > 0").withColumn("g", F.spark_partition_id() % p.averages)
        groups = parts.groupBy("g").applyInPandas(lambda g: average(g["n"], g["w"]), "n long, w binary").toPandas()  # ``averages`` rows at most
        if len(groups):
            net = Network(pickle.loads(average(groups["n"], groups["w"])["w"][0]), net.group)
    n_train = int(total["n"]) + n_docs
    model = Model(net, classes, tail, frequent, n_train, int(total["v"]) + (n_docs > 0), n_docs, p)
    counts = words.select("h", "c")
    return replace(model, mix=learn_mix(tuning, model, counts)), counts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, counts = fit(docs, id_col, text_col, p)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        keep_memory()
        m, ids = shared.value, word_ids(p.vocabulary)
        common = {w: float(np.log10(c + p.alpha)) for w, c in m.frequent.items()}
        for batch in batches:
            rows: dict[str, tuple] = {}
            for part in slices(list(dict.fromkeys(t or "" for t in batch["text"]))):
                coded = Coded.of(part)
                base = coded.values(common, float(np.log10(m.docs + p.alpha)), np.nan)[coded.code]
                rare = np.isnan(base)
                known = np.add.reduceat(~rare & ((coded.code > 0) | (m.docs > 0)), coded.begin, dtype=np.int64)
                sums = np.add.reduceat(np.where(rare, 0, base), coded.begin)
                spelling = spelled(coded, m, ids)
                found = rare_words(coded, rare, spelling)
                each = zip(part, coded.length.tolist(), known.tolist(), sums.tolist(), score_coded(coded, m, ids, spelling).tolist(), *found, strict=True)
                rows |= {t: tuple(values) for t, *values in each}
            out = pd.DataFrame([rows[t or ""] for t in batch["text"]], columns=["n_tokens", "known", "sum", "score", "h", "k", "b", "s"])
            out.insert(0, "id", batch["id"].array)
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    mapped = docs.select(F.col(q(id_col)).alias("id"), F.col(q(text_col)).alias("text")).mapInPandas(scored, f"id {kind}, n_tokens long, known long, sum double, score double, h array<long>, k array<int>, b array<int>, s array<double>")
    rows = materialize(mapped.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", each_rare())
    c = F.coalesce("c", F.lit(0))
    share = c / F.lit(max(1, model.n_train))
    met = rare.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(c + p.alpha)).alias("rare_base"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("kn"), F.sum(rare_sum(F.col("each"), share, model.weight)).alias("rare"),
    )
    out = rows.drop("h", "k", "b", "s").join(met, "row", "left")
    base = F.col("sum") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(model.denominator))
    return out.select(
        F.col("id").alias("doc_id"), held_out(F.col("id"), p.folds).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("kn", F.lit(0))).alias("n_known"),
        F.lit(model.n_train).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("rare", F.lit(0.0))).alias("score"),
    )
