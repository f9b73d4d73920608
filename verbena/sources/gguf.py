"""GGUF model containers as relations: header, metadata, array elements and tensors.

A container is read where it is used, through a memory map, so only pages that are touched leave the disk; its path
must be one that executors see.  Everything that the file states about itself (counts, lengths, offsets, alignment,
names) is checked before the first row.  Each relation is a table function in SQL (``SELECT * FROM gguf_tensors(path)``,
also lateral) and a view of the data source ``gguf``.
"""

from __future__ import annotations

import mmap
import os
import stat
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import prod

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from verbena.contracts import ContractError

# Parts of the error texts below are what callers of these functions look for.

# Value types by number, and struct codes of the scalar ones (fixed values).
VALUE_TYPES = ("uint8", "int8", "uint16", "int16", "uint32", "int32", "float32", "bool", "string", "array", "uint64", "int64", "float64")
CODES = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
STRING, ARRAY = 8, 9

# Tensor types by number: name, values in a block, bytes of a block (fixed values).
TENSOR_TYPES = {
    0: ("f32", 1, 4), 1: ("f16", 1, 2), 2: ("q4_0", 32, 18), 3: ("q4_1", 32, 20), 6: ("q5_0", 32, 22), 7: ("q5_1", 32, 24),
    8: ("q8_0", 32, 34), 9: ("q8_1", 32, 36), 10: ("q2_K", 256, 84), 11: ("q3_K", 256, 110), 12: ("q4_K", 256, 144),
    13: ("q5_K", 256, 176), 14: ("q6_K", 256, 210), 15: ("q8_K", 256, 292), 16: ("iq2_xxs", 256, 66), 17: ("iq2_xs", 256, 74),
    18: ("iq3_xxs", 256, 98), 19: ("iq1_s", 256, 50), 20: ("iq4_nl", 32, 18), 21: ("iq3_s", 256, 110), 22: ("iq2_s", 256, 82),
    23: ("iq4_xs", 256, 136), 24: ("i8", 1, 1), 25: ("i16", 1, 2), 26: ("i32", 1, 4), 27: ("i64", 1, 8), 28: ("f64", 1, 8),
    29: ("iq1_m", 256, 56), 30: ("bf16", 1, 2), 34: ("tq1_0", 256, 54), 35: ("tq2_0", 256, 66), 39: ("mxfp4", 32, 17),
    40: ("nvfp4", 64, 36), 41: ("q1_0", 128, 18), 42: ("q2_0", 64, 18),
}

MAX_DIMS, MAX_NESTING = 4, 4

SCHEMAS = {
    "header": "version int, tensor_count long, metadata_count long, alignment long, data_offset long, file_bytes long, tensor_bytes long",
    "metadata": "ordinal long, key string, value_type string, array_type string, array_length long, value string",
    "array": "array_index long, value string",
    "tensors": "tensor_index long, name string, ggml_type string, ggml_type_id long, dims array<long>, n_elements long, file_offset long, n_bytes long",
}


@dataclass(frozen=True)
class Value:
    kind: int
    at: int  # of the scalar, or of an array's first element
    item: int | None = None  # element type of an array
    length: int | None = None


@dataclass(frozen=True)
class Tensor:
    name: str
    kind: int
    dims: tuple[int, ...]
    at: int
    n_bytes: int | None

    @property
    def n_elements(self) -> int:
        return prod(self.dims)


class Cursor:
    """Reads forward through a container's bytes and refuses to pass their end."""

    def __init__(self, data, at: int = 0):
        self.data, self.at = data, at

    def skip(self, n: int, what: str = "payload") -> int:
        if n > len(self.data) - self.at:
            raise ContractError(f"{what} overruns the file")
        began, self.at = self.at, self.at + n
        return began

    def number(self, code: str):
        return struct.unpack_from(f"<{code}", self.data, self.skip(struct.calcsize(f"<{code}")))[0]

    def string(self) -> str:
        n = self.number("Q")
        began = self.skip(n, f"string of {n} bytes")
        try:
            return self.data[began : began + n].decode("utf-8", "strict")
        except UnicodeDecodeError as e:
            raise ContractError("string is not valid UTF-8") from e

    def value(self, kind: int, depth: int = 0) -> Value:
        """Passes over one value; strings inside it are checked as they come."""
        if kind == ARRAY:
            if depth >= MAX_NESTING:
                raise ContractError(f"an array is nested in more than {MAX_NESTING} others")
            item, length = self.number("I"), self.number("Q")
            began = self.at
            if item in CODES:
                self.skip(struct.calcsize(f"<{CODES[item]}") * length, f"array of {length} elements")
            else:
                if length > len(self.data) - self.at:
                    raise ContractError(f"an array states {length} elements, more than the file can hold")
                for _ in range(length):
                    self.value(item, depth + 1)
            return Value(kind, began, item, length)
        began = self.at
        if kind == STRING:
            self.string()
        elif kind in CODES:
            self.number(CODES[kind])
        else:
            raise ContractError(f"value has unknown type {kind}")
        return Value(kind, began)


class Container:
    """One open file: ``values`` by key and ``tensors`` by name, both in the file's order."""

    def __init__(self, path: str):
        if not isinstance(path, str):
            raise ContractError("GGUF path must be a non-NULL string")
        if "\0" in path:
            raise ContractError("GGUF path must not contain NUL")
        try:
            with open(path, "rb") as f:
                if not stat.S_ISREG(os.fstat(f.fileno()).st_mode):
                    raise ContractError(f"'{path}' is not a regular file")
                self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""
        except IsADirectoryError as e:
            raise ContractError(f"'{path}' is not a regular file") from e
        except OSError as e:
            raise ContractError(f"cannot open '{path}'") from e
        c = Cursor(self.data)
        if self.data[:4] != b"GGUF":
            raise ContractError(f"'{path}' does not start with the GGUF magic")
        c.skip(4)
        self.version = c.number("I")
        if self.version not in (2, 3):
            raise ContractError(f"GGUF version {self.version} is not supported")
        n_tensors, n_values = c.number("Q"), c.number("Q")
        # A tensor takes 24 bytes at least and a value 13, so no count drives a loop past the file's size.
        if n_tensors * 24 + n_values * 13 > len(self.data) - c.at:
            raise ContractError("header counts exceed what the file can hold")
        self.values: dict[str, Value] = {}
        for _ in range(n_values):
            key = c.string()
            if key in self.values:
                raise ContractError(f"duplicate metadata key '{key}'")
            self.values[key] = c.value(c.number("I"))
        self.alignment = self._alignment()
        listed = [self._tensor(c) for _ in range(n_tensors)]
        self.data_offset = -(-c.at // self.alignment) * self.alignment
        self.tensors: dict[str, Tensor] = {}
        for t in listed:
            self._place(t)

    def _alignment(self) -> int:
        v = self.values.get("general.alignment")
        if v is None:
            return 32
        if v.kind != 4:
            raise ContractError("general.alignment has another type than uint32")
        n = Cursor(self.data, v.at).number("I")
        if n == 0 or n & (n - 1):
            raise ContractError(f"alignment {n} is not a power of two")
        return n

    def _tensor(self, c: Cursor) -> Tensor:
        name, rank = c.string(), c.number("I")
        if rank > MAX_DIMS:
            raise ContractError(f"tensor '{name}' has {rank} dimensions")
        dims = tuple(c.number("Q") for _ in range(rank))
        if prod(dims) >= 1 << 63:
            raise ContractError(f"the elements of tensor '{name}' are too many to count")
        kind, at = c.number("I"), c.number("Q")
        n_bytes = None
        if kind in TENSOR_TYPES:
            label, block, size = TENSOR_TYPES[kind]
            if prod(dims) % block:
                raise ContractError(f"tensor '{name}': {prod(dims)} elements is not a multiple of the {label} block")
            n_bytes = prod(dims) // block * size
        return Tensor(name, kind, dims, at, n_bytes)

    def _place(self, t: Tensor) -> None:
        if t.name in self.tensors:
            raise ContractError(f"duplicate tensor '{t.name}'")
        if t.at % self.alignment:
            raise ContractError(f"tensor '{t.name}': offset is not aligned")
        at = self.data_offset + t.at
        if at + (t.n_bytes or 0) > max(len(self.data), self.data_offset if not t.n_bytes else 0):
            raise ContractError(f"tensor '{t.name}': payload overruns the file")
        self.tensors[t.name] = Tensor(t.name, t.kind, t.dims, at, t.n_bytes)

    def text(self, kind: int, at: int) -> str | None:
        """A scalar as text: nine significant digits for single precision, seventeen for double."""
        c = Cursor(self.data, at)
        if kind == STRING:
            return c.string()
        if kind == ARRAY:
            return None
        v = c.number(CODES[kind])
        return f"{v:.9g}" if kind == 6 else f"{v:.17g}" if kind == 12 else str(v).lower()

    def header(self) -> Iterator[tuple]:
        yield self.version, len(self.tensors), len(self.values), self.alignment, self.data_offset, len(self.data), sum(t.n_bytes or 0 for t in self.tensors.values())

    def metadata(self) -> Iterator[tuple]:
        for n, (key, v) in enumerate(self.values.items()):
            item = None if v.item is None else VALUE_TYPES[v.item] if v.item < len(VALUE_TYPES) else None
            yield n, key, VALUE_TYPES[v.kind], item, v.length, self.text(v.kind, v.at)

    def array(self, key: str) -> Iterator[tuple]:
        if not isinstance(key, str):
            raise ContractError("metadata key must be a non-NULL string")
        v = self.values.get(key)
        if v is None or v.kind != ARRAY:
            raise ContractError(f"metadata key '{key}' is not an array")
        c = Cursor(self.data, v.at)
        for i in range(v.length):
            at = c.at
            c.value(v.item, 1)
            yield i, self.text(v.item, at)

    def tensor_rows(self) -> Iterator[tuple]:
        for n, t in enumerate(self.tensors.values()):
            yield n, t.name, TENSOR_TYPES.get(t.kind, (None,))[0], t.kind, list(t.dims), t.n_elements, t.at, t.n_bytes

    def rows(self, view: str, key: str | None = None) -> Iterator[tuple]:
        return self.array(key) if view == "array" else {"header": self.header, "metadata": self.metadata, "tensors": self.tensor_rows}[view]()


@lru_cache(maxsize=8)
def _kept(path: str, size: int, changed: int) -> Container:
    return Container(path)


def container(path: str) -> Container:
    """The container at ``path``, kept in this worker until the file changes."""
    try:
        s = os.stat(path)
    except (OSError, ValueError, TypeError):
        return Container(path)
    return _kept(path, s.st_size, s.st_mtime_ns)


class _Reader(DataSourceReader):
    def __init__(self, path: str, view: str, key: str | None):
        self.path, self.view, self.key = path, view, key

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from container(self.path).rows(self.view, self.key)


class GgufSource(DataSource):
    """``spark.read.format("gguf").option("view", ...).load(path)``; the view ``array`` also takes ``key``."""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        view = self.options.get("view", "header")
        if view not in SCHEMAS:
            raise ContractError(f"view must be one of {', '.join(SCHEMAS)}")
        if view == "array":
            next(container(self.options.get("path")).array(self.options.get("key")), None)
        return SCHEMAS[view]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("path"), self.options.get("view", "header"), self.options.get("key"))


class _Header:
    def eval(self, path: str):
        yield from container(path).header()


class _Metadata:
    def eval(self, path: str):
        yield from container(path).metadata()


class _Array:
    def eval(self, path: str, key: str):
        yield from container(path).array(key)


class _Tensors:
    def eval(self, path: str):
        yield from container(path).tensor_rows()


def register(spark: SparkSession) -> None:
    """The data source ``gguf`` and the four table functions."""
    spark.dataSource.register(GgufSource)
    for name, view, handler in (("gguf_header", "header", _Header), ("gguf_metadata", "metadata", _Metadata), ("gguf_metadata_array", "array", _Array), ("gguf_tensors", "tensors", _Tensors)):
        spark.udtf.register(name, udtf(handler, returnType=SCHEMAS[view]))
