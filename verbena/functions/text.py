"""Text functions as Catalyst expressions; token rows, whose offsets are running sums, in Arrow batches.  Offsets are zero-based, half-open, in code points."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_RUN = re.compile("[A-Za-z0-9]+")
# The letters whose lower case is not one letter by itself: dotted capital I, and capital sigma at a word's end.
_ODD_UPPER, _ODD_LOWER = "\u0130\u03a3", "i\u03c3"
_ODD = str.maketrans(_ODD_UPPER, _ODD_LOWER)


def fold(text: Column) -> Column:
    """Lower case letter by letter, so that offsets stay: the host's own form makes two letters of one and looks at a word's end for another."""
    return F.lower(F.translate(text, _ODD_UPPER, _ODD_LOWER))


def folded(text: str) -> str:
    """``fold`` of one text."""
    return text.translate(_ODD).lower()


def normalize(text: Column) -> Column:
    """Lower case, every run of other characters than ASCII letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


SPAN = T.StructType([T.StructField("token_index", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("normalized", T.StringType()), T.StructField("start_offset", T.IntegerType()), T.StructField("end_offset", T.IntegerType())])


def token_spans(text: Column) -> Column:
    """array<struct<token_index,token,normalized,start_offset,end_offset>> of the alphanumeric runs; null for null."""

    @F.pandas_udf(T.ArrayType(SPAN))
    def spans(texts: pd.Series) -> pd.Series:
        found = lambda t: [(i, m[0], m[0].lower(), m.start(), m.end()) for i, m in enumerate(_RUN.finditer(t), 1)]
        return pd.Series([None if t is None else [dict(zip(SPAN.names, x, strict=True)) for x in found(t)] for t in texts], dtype=object)

    return spans(text)


def _token_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows, texts = (batch.column(k) for k in range(3))
        at, n, token, start, end = [], [], [], [], []

        def made() -> pa.RecordBatch:
            take = pa.array(at, pa.int64())
            arrays = [ids.take(take), rows.take(take), pa.array(n, pa.int32()), pa.array(token, pa.string()), pa.array([t.lower() for t in token], pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)

        for k, text in enumerate(texts.to_pylist()):
            for i, m in enumerate(_RUN.finditer(text or ""), 1):
                at.append(k)
                n.append(i)
                token.append(m[0])
                start.append(m.start())
                end.append(m.end())
                if len(at) == size:
                    yield made()
                    for column in (at, n, token, start, end):
                        column.clear()
        if at:
            yield made()


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per token: document_id, row (a number of the text), token_index from 1, token, normalized, start_offset, end_offset.

    Texts are cut where they lie, batch by batch; no token is shuffled.
    """
    x = df.select(F.col(id_col).alias("document_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    kinds = T.StructType([x.schema["document_id"], x.schema["row"], *(T.StructField(c, t) for c, t in (("token_index", T.IntegerType()), ("token", T.StringType()), ("normalized", T.StringType()), ("start_offset", T.IntegerType()), ("end_offset", T.IntegerType())))])
    schema = to_arrow_schema(kinds)
    return x.mapInArrow(lambda batches: _token_rows(batches, schema, 50_000), kinds)


def spans_before(i: int, n: int, max_n: int) -> int:
    """How many spans of up to ``max_n`` of ``n`` tokens begin before token ``i`` (from 0)."""
    full = min(i, max(0, n - max_n + 1))  # tokens with room for the longest span
    return full * max_n + (i - full) * (2 * n - full - i + 1) // 2


class Wanted:
    """Normalized spans that are looked for: their own, by the first token."""

    def __init__(self, spans: Iterable[str]):
        self.spans = frozenset(spans)
        self.lengths: dict[str, list[int]] = {}
        for n, first in sorted({(w.count(" ") + 1, w.split(" ", 1)[0]) for w in self.spans}):
            self.lengths.setdefault(first, []).append(n)

    def beginnings(self, max_n: int) -> Callable[[str], Sequence[int] | None]:
        """Token counts of the spans that may begin with a token."""
        return self.lengths.get

    def has(self, span: str) -> bool:
        return span in self.spans


class Every:
    """All spans."""

    def beginnings(self, max_n: int) -> Callable[[str], Sequence[int] | None]:
        every = range(1, max_n + 1)
        return lambda token: every

    def has(self, span: str) -> bool:
        return True


#: Bits of a filter at most (32 MB), and of a part of it, which is what tasks combine.
FILTER_BITS, _PART_BITS = 1 << 28, 1 << 18
_HASHES = 5
_KNOWN_TOKENS = 500_000


class Filter:
    """A Bloom filter of spans, and of first tokens with the number of tokens after them; what it denies is not there."""

    def __init__(self, bits: int, data: Broadcast | None = None):
        """``bits`` is a power of two."""
        self.bits, self.data = bits, data

    def places(self, key: str) -> Iterator[int]:
        h = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))
        step, last = h >> 32 | 1, self.bits - 1
        for _ in range(_HASHES):
            yield h & last
            h += step

    def has(self, span: str) -> bool:
        return self._held(f"0 {span}")

    def _held(self, key: str) -> bool:
        data = self.data.value
        return all(data[p >> 3] >> (p & 7) & 1 for p in self.places(key))

    def beginnings(self, max_n: int) -> Callable[[str], Sequence[int] | None]:
        """Most tokens are denied by one look for the token alone; tokens that came before are not looked for again."""
        held = self._held

        class Known(dict):
            def __missing__(self, token: str) -> Sequence[int]:
                if len(self) >= _KNOWN_TOKENS:
                    self.clear()
                found = self[token] = tuple(n for n in range(1, max_n + 1) if held(f"{n} {token}")) if held(f"? {token}") else ()
                return found

        return Known().__getitem__


def alias_filter(index: DataFrame, n: int) -> Filter:
    """A filter of all aliases (normalized_alias, token_count), wrong for less than one per cent of what it lacks up to eight million; tasks set
    bits and the parts of the filter, 1,024 at most, are combined before they come back."""
    made = Filter(min(FILTER_BITS, 1 << max(18, (30 * max(1, n)).bit_length())))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for alias, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = alias.split(" ", 1)[0]
                for key in (f"0 {alias}", f"? {first}", f"{size} {first}"):
                    for p in made.places(key):
                        part = parts.setdefault(p // _PART_BITS, np.zeros(_PART_BITS // 8, np.uint8))
                        part[p % _PART_BITS >> 3] |= 1 << (p & 7)
        for k, part in parts.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "bits": pa.array([part.tobytes()])})

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held[k] | np.frombuffer(bits, np.uint8) if k in held else np.frombuffer(bits, np.uint8)
        for k, part in held.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "bits": pa.array([part.tobytes()])})

    keys = index.select("normalized_alias", "token_count").distinct()
    rows = keys.mapInArrow(set_bits, "part int, bits binary").repartition("part").mapInArrow(combined, "part int, bits binary").collect()
    data = np.zeros(made.bits // 8, np.uint8)
    for r in rows:
        at = r["part"] * _PART_BITS // 8
        data[at : at + _PART_BITS // 8] |= np.frombuffer(r["bits"], np.uint8)
    return Filter(made.bits, index.sparkSession.sparkContext.broadcast(data.tobytes()))


def ngrams(df: DataFrame, id_col: str, text_col: str, max_n: int, wanted: Wanted | Filter | Every | frozenset[str] | None = None) -> DataFrame:
    """Spans of 1 to ``max_n`` tokens: document_id, row, normalized_span, token_count, start_offset, end_offset, span, ordinal.

    ``ordinal`` numbers all spans of a text from 1, by first token and length.  With ``wanted`` only spans that it has are
    made, and of tokens only those looked at that begin one.
    """
    wanted = Every() if wanted is None else Wanted(wanted) if isinstance(wanted, frozenset) else wanted
    x = df.select(F.col(id_col).alias("document_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    kinds = T.StructType([x.schema["document_id"], x.schema["row"], *(T.StructField(c, t) for c, t in (("normalized_span", T.StringType()), ("token_count", T.IntegerType()), ("start_offset", T.IntegerType()), ("end_offset", T.IntegerType()), ("span", T.StringType()), ("ordinal", T.LongType())))])
    schema = to_arrow_schema(kinds)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.beginnings(max_n)
        for batch in batches:
            out: list[tuple] = []

            def made(batch=batch, out=out) -> pa.RecordBatch:
                at, *rest = zip(*out, strict=True)
                take = pa.array(at, pa.int64())
                arrays = [batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, rest)]
                return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(arrays, schema, strict=True)], schema=schema)

            for k, text in enumerate(batch.column(2).to_pylist()):
                if not text:
                    continue
                words = _RUN.findall(text)
                low = [w.lower() for w in words]
                begins = [(i, sizes) for i, w in enumerate(low) if (sizes := known(w))]
                if not begins:
                    continue
                places = [m.span() for m in _RUN.finditer(text)]
                for i, sizes in begins:
                    for n in sizes:
                        if i + n > len(low):
                            break
                        joined = " ".join(low[i : i + n])
                        if wanted.has(joined):
                            a, z = places[i][0], places[i + n - 1][1]
                            out.append((k, joined, n, a, z, text[a:z], spans_before(i, len(low), max_n) + n))
                    if len(out) >= 20_000:
                        yield made()
                        out.clear()
            if out:
                yield made()

    return x.mapInArrow(spans, kinds)


HIT = T.StructType([T.StructField("start_offset", T.IntegerType()), T.StructField("end_offset", T.IntegerType())])


def literal_spans(text: Column, query: str) -> Column:
    """array<struct<start_offset,end_offset>> of the case-insensitive, non-overlapping occurrences; null for null.

    Both are folded letter by letter, so a place in the folded text is that place in the text.  Linear in text and hits.
    """
    wanted = re.compile(re.escape(folded(query)))

    @F.arrow_udf(T.ArrayType(HIT))
    def spans(texts: pa.Array) -> pa.Array:
        starts, upto = [], [0]
        for t in texts.to_pylist():
            starts += [m.start() for m in wanted.finditer(folded(t))] if t else []
            upto.append(len(starts))
        at = pa.array(starts, pa.int32())
        hits = pa.StructArray.from_arrays([at, pc.add(at, pa.scalar(len(query), pa.int32()))], names=HIT.names)
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), hits, mask=texts.is_null())

    return spans(text)


def literal_hits(rows: DataFrame, text_col: str, query: str) -> DataFrame:
    """``rows`` with ``h``, once for each occurrence; only texts that have one leave the JVM."""
    return rows.where(F.contains(fold(F.col(text_col)), F.lit(folded(query)))).withColumn("h", F.explode(literal_spans(F.col(text_col), query)))


def occurs_once(text: Column, part: Column) -> Column:
    """True if ``part`` occurs exactly once; overlapping occurrences count."""
    at = F.instr(text, part)
    rest = F.substring(text, at + 1, F.length(text))
    return (at > 0) & (F.instr(rest, part) == 0)


def nonblank(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")) > 0, F.lit(False))


def pointer_escape(key: str) -> str:
    """A key as a JSON pointer token."""
    return key.replace("~", "~0").replace("/", "~1")
