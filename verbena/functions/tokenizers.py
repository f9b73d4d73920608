"""Texts as the token ids of a model container's vocabulary, and back.

Two kinds of vocabulary: byte-level pieces merged by rank behind a pre-tokenizer, with control tokens found whole in the
text; and characters merged by score, blanks written as U+2581, with bytes for what the vocabulary lacks.  A worker
keeps a vocabulary until its file changes, and the ids of pieces that come again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from verbena.contracts import ContractError
from verbena.sources.gguf import ARRAY, STRING, Container, Cursor, container

# Parts of the error texts below are what callers of these functions look for.

# Token types, the sign for a blank, and the published pre-tokenization pattern (fixed values).
CONTROL, USER_DEFINED, BYTE = 3, 4, 6
BLANK = "▁"
PRETOKEN = regex.compile(
    r"'(?:[sSdDmMtT]|[lL][lL]|[vV][eE]|[rR][eE])|[^\r\n\p{Alphabetic}\p{N}]?\p{Alphabetic}+|\p{N}{1,3}"
    r"| ?[^\p{White_Space}\p{Alphabetic}\p{N}]+[\r\n]*|\p{White_Space}*[\r\n]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
ARCHITECTURES = {("gpt2", "lfm2"): "bytes", ("gpt2", "lfm2moe"): "bytes", ("llama", "gemma-embedding"): "characters"}

Pair = Callable[[object, object], tuple[tuple, object] | None]


def merged(symbols: list, pair: Pair) -> list:
    """``symbols`` after merging neighbours, the pair with the least key first, the leftmost of equal keys.

    ``pair`` gives the key and result of two neighbours, or None.  A heap entry is out of date once either of its
    symbols has changed.
    """
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    heap: list[tuple] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(symbols) and (found := pair(symbols[i], symbols[after[i]])) is not None:
            heapq.heappush(heap, (found[0], i, after[i], symbols[i], symbols[after[i]], found[1]))

    for i in range(len(symbols)):
        offer(i)
    while heap:
        _, i, j, left, right, result = heapq.heappop(heap)
        if symbols[i] != left or after[i] != j or symbols[j] != right:
            continue
        symbols[i], symbols[j] = result, None
        after[i] = after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [s for s in symbols if s is not None]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or one from U+0100 on in their order."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Vocabulary:
    """Tokens, types and special ids of a container; subclasses cut texts and join tokens."""

    def __init__(self, c: Container):
        self.c = c
        self.tokens = list(self.items("tokenizer.ggml.tokens", STRING))
        n = len(self.tokens)
        if not n:
            raise ContractError("the tokenizer holds no tokens")
        for i, t in enumerate(self.tokens):
            if not t:
                raise ContractError(f"empty or invalid UTF-8 token at id {i}")
        self.types = [int(t) for t in self.items("tokenizer.ggml.token_type", 5, n)]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.bos, self.eos = self.special("bos"), self.special("eos")
        self.cache: dict[str, list[int]] = {}

    def items(self, key: str, kind: int, n: int | None = None) -> Iterator[str]:
        v = self.c.values.get(key)
        if v is None or v.kind != ARRAY or v.item != kind or (n is not None and v.length != n):
            raise ContractError(f"invalid or missing {key}")
        return (text for _, text in self.c.array(key))

    def special(self, name: str) -> int:
        key = f"tokenizer.ggml.{name}_token_id"
        v = self.c.values.get(key)
        if v is None or v.kind not in (4, 5) or (i := int(self.c.text(v.kind, v.at))) < 0:
            raise ContractError(f"invalid or missing {key}")
        if i >= len(self.tokens):
            raise ContractError(f"{key} outside vocabulary")
        return i

    def flag(self, name: str, default: bool) -> bool:
        v = self.c.values.get(name)
        if v is None:
            return default
        if v.kind != 7:
            raise ContractError(f"invalid {name}")
        return self.c.text(v.kind, v.at) == "true"

    def kept(self, piece: str, make: Callable[[str], list[int]]) -> list[int]:
        """The ids of a piece, remembered if it is short; everything is forgotten when there is too much."""
        found = self.cache.get(piece)
        if found is None:
            found = make(piece)
            if len(piece) <= 40:
                if len(self.cache) >= 200_000:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def check(self, ids: Sequence) -> list[int]:
        out = []
        for i in ids:
            if i is None or i != i:
                raise ContractError("NULL token id")
            if not 0 <= i < len(self.tokens):
                raise ContractError("a token id lies outside what the vocabulary holds")
            out.append(int(i))
        return out


class ByteVocabulary(Vocabulary):
    """Bytes written as characters, merged by rank inside pre-tokens; control and user-defined tokens are whole."""

    def __init__(self, c: Container):
        super().__init__(c)
        self.characters = byte_characters()
        for b, ch in enumerate(self.characters):
            if ch not in self.ids:
                raise ContractError(f"the vocabulary has no token for byte {b}")
        self.byte_ids = [self.ids[ch] for ch in self.characters]
        self.bytes = {ch: b for b, ch in enumerate(self.characters)}
        self.merges: dict[tuple[int, int], tuple[tuple, int]] = {}
        for rank, m in enumerate(self.items("tokenizer.ggml.merges", STRING)):
            left, blank, right = m.partition(" ")
            if not blank:
                raise ContractError(f"the merge of rank {rank} is not two parts")
            if left not in self.ids or right not in self.ids:
                raise ContractError(f"merge operands outside vocabulary at rank {rank}")
            if left + right not in self.ids:
                raise ContractError(f"what the merge of rank {rank} makes is no token")
            self.merges[self.ids[left], self.ids[right]] = ((rank,), self.ids[left + right])
        whole = sorted({t for t, k in zip(self.tokens, self.types, strict=True) if k in (CONTROL, USER_DEFINED)}, key=lambda t: -len(t.encode()))
        self.whole = regex.compile("|".join(map(regex.escape, whole))) if whole else None  # the longest is tried first

    def piece(self, text: str) -> list[int]:
        return merged([self.byte_ids[b] for b in text.encode()], lambda a, b: self.merges.get((a, b)))

    def plain(self, text: str) -> Iterator[int]:
        for p in PRETOKEN.findall(text):
            yield from self.kept(p, self.piece)

    def encode(self, text: str, add_special: bool) -> list[int]:
        out, at = [self.bos] if add_special else [], 0
        for m in self.whole.finditer(text) if self.whole else ():
            out += self.plain(text[at : m.start()])
            out.append(self.ids[m[0]])
            at = m.end()
        out += self.plain(text[at:])
        return out

    def decode(self, ids: Sequence) -> str:
        text = "".join(self.tokens[i] for i in self.check(ids))
        return bytes(self.bytes[ch] for ch in text if ch in self.bytes).decode("utf-8", "replace")


class CharacterVocabulary(Vocabulary):
    """Characters merged by score; equal scores from the left, and of equal priorities the negative zero first."""

    def __init__(self, c: Container):
        super().__init__(c)
        n = len(self.tokens)
        self.scores = [float(s) for s in self.items("tokenizer.ggml.scores", 6, n)]
        for i, s in enumerate(self.scores):
            if not math.isfinite(s):
                raise ContractError(f"non-finite tokenizer score at id {i}")
        self.unknown = self.special("unknown")
        self.add_bos, self.add_eos = (self.flag(f"tokenizer.ggml.add_{k}_token", True) for k in ("bos", "eos"))
        self.byte_of = {i: int(t[3:5], 16) for i, (t, k) in enumerate(zip(self.tokens, self.types, strict=True)) if k == BYTE and regex.fullmatch("<0x[0-9A-Fa-f]{2}>", t)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}

    def pair(self, a: str, b: str) -> tuple[tuple, str] | None:
        i = self.ids.get(a + b)
        if i is None:
            return None
        priority = -self.scores[i]
        return (priority, math.copysign(1, priority)), a + b

    def encode(self, text: str, add_special: bool) -> list[int]:
        out = [self.bos] if add_special and self.add_bos else []
        for s in merged(list(text.replace(" ", BLANK)), self.pair):
            out += [self.ids[s]] if s in self.ids else [self.byte_ids.get(b, self.unknown) for b in s.encode()]
        return [*out, self.eos] if add_special and self.add_eos else out

    def decode(self, ids: Sequence) -> str:
        out = bytearray()
        for i in self.check(ids):
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif self.types[i] != CONTROL:
                out += self.tokens[i].replace(BLANK, " ").encode()
        return out.decode("utf-8", "replace")


def _text_of(c: Container, key: str) -> str | None:
    v = c.values.get(key)
    return Cursor(c.data, v.at).string() if v is not None and v.kind == STRING else None


@lru_cache(maxsize=4)
def _vocabulary(c: Container) -> Vocabulary:
    kind = ARCHITECTURES.get((_text_of(c, "tokenizer.ggml.model"), _text_of(c, "general.architecture")))
    if kind is None or kind == "bytes" and _text_of(c, "tokenizer.ggml.pre") != "lfm2":
        raise ContractError("unsupported GGUF tokenizer model/architecture")
    return (ByteVocabulary if kind == "bytes" else CharacterVocabulary)(c)


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of the container at ``path``."""
    return _vocabulary(container(path))


@pandas_udf(T.ArrayType(T.IntegerType()))
def semantic_tokenize(path: pd.Series, text: pd.Series, add_special: pd.Series) -> pd.Series:
    rows = zip(path, text, add_special, strict=True)
    return pd.Series([None if p is None or t is None or s is None else np.array(vocabulary(p).encode(t, bool(s)), np.int32) for p, t, s in rows], dtype=object)


@pandas_udf(T.StringType())
def semantic_detokenize(path: pd.Series, ids: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or i is None else vocabulary(p).decode(list(i)) for p, i in zip(path, ids, strict=True)], dtype=object)


def register(spark: SparkSession) -> None:
    """Both functions under their SQL names; files may change, so Spark must not fold or share the calls."""
    spark.udf.register("semantic_tokenize", semantic_tokenize.asNondeterministic())
    spark.udf.register("semantic_detokenize", semantic_detokenize.asNondeterministic())
