"""Block-quantized tensors: decoding, slices and matrix-vector products as SQL functions.

Each decoder takes the bytes of whole blocks as an array of shape (blocks, bytes) and gives (blocks, values) in
single precision.  A slice decodes only the blocks that it touches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from verbena.contracts import ContractError
from verbena.sources.gguf import TENSOR_TYPES, Container, Tensor, container

# Parts of the error texts below are what callers of these functions look for.

F32 = np.float32
FLOATS = ArrayType(FloatType())


def _f16(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b).view("<f2").astype(F32)


def _bf16(b: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(b).view("<u2").astype(np.uint32) << 16).view(F32)


def _spread(q: np.ndarray, shifts: tuple[int, ...], mask: int) -> np.ndarray:
    """Bit fields of bytes: one more axis before the last, by shift."""
    return (q[..., None, :] >> np.array(shifts, np.uint8)[:, None]) & mask


def _grouped(q: np.ndarray, scale: np.ndarray, less: np.ndarray | None = None) -> np.ndarray:
    """q * scale - less, with one scale for each of equal runs of a block."""
    y = q.reshape(len(q), scale.shape[1], -1).astype(F32) * scale[..., None]
    return (y if less is None else y - less[..., None]).reshape(len(q), -1)


def _q8_0(b: np.ndarray) -> np.ndarray:
    return _grouped(b[:, 2:].view(np.int8), _f16(b[:, :2]))


def _q2_k(b: np.ndarray) -> np.ndarray:
    scales, q = b[:, :16], b[:, 16:80].reshape(-1, 2, 32)
    d, m = _f16(b[:, 80:82]), _f16(b[:, 82:84])
    return _grouped(_spread(q, (0, 2, 4, 6), 3).reshape(len(b), -1), d * (scales & 15), m * (scales >> 4))


def _q3_k(b: np.ndarray) -> np.ndarray:
    high, q, s = b[:, :32], b[:, 32:96].reshape(-1, 2, 32), b[:, 96:108]
    low = np.concatenate([s[:, :8] & 15, s[:, :8] >> 4], axis=1)
    top = _spread(s[:, 8:], (0, 2, 4, 6), 3).reshape(len(b), 16)
    scales = (low | top << 4).astype(np.int8) - 32
    bits = _spread(high, tuple(range(8)), 1).reshape(len(b), -1).astype(np.int8)
    return _grouped(_spread(q, (0, 2, 4, 6), 3).reshape(len(b), -1).astype(np.int8) - 4 * (1 - bits), _f16(b[:, 108:110]) * scales)


def _six_bits(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight scales and eight minima packed into twelve bytes."""
    low, mid, high = s[:, :4], s[:, 4:8], s[:, 8:]
    return np.concatenate([low & 63, high & 15 | low >> 6 << 4], axis=1), np.concatenate([mid & 63, high >> 4 | mid >> 6 << 4], axis=1)


def _q4_k(b: np.ndarray) -> np.ndarray:
    scale, least = _six_bits(b[:, 4:16])
    q = _spread(b[:, 16:].reshape(-1, 4, 32), (0, 4), 15).reshape(len(b), -1)
    return _grouped(q, _f16(b[:, :2]) * scale, _f16(b[:, 2:4]) * least)


def _q5_k(b: np.ndarray) -> np.ndarray:
    scale, least = _six_bits(b[:, 4:16])
    q = _spread(b[:, 48:].reshape(-1, 4, 32), (0, 4), 15).reshape(len(b), -1)
    fifth = _spread(b[:, 16:48], tuple(range(8)), 1).reshape(len(b), -1)
    return _grouped(q | fifth << 4, _f16(b[:, :2]) * scale, _f16(b[:, 2:4]) * least)


def _q6_k(b: np.ndarray) -> np.ndarray:
    low = _spread(b[:, :128].reshape(-1, 2, 64), (0, 4), 15).reshape(len(b), -1)
    high = _spread(b[:, 128:192].reshape(-1, 2, 32), (0, 2, 4, 6), 3).reshape(len(b), -1)
    return _grouped((low | high << 4).astype(np.int8) - 32, _f16(b[:, 208:]) * b[:, 192:208].view(np.int8))


def _q8_k(b: np.ndarray) -> np.ndarray:
    return _grouped(b[:, 4:260].view(np.int8), np.ascontiguousarray(b[:, :4]).view("<f4"))


#: Decoders by tensor type.
DECODERS = {
    0: lambda b: np.ascontiguousarray(b).view("<f4"), 1: _f16, 30: _bf16, 8: _q8_0, 10: _q2_k, 11: _q3_k, 12: _q4_k, 13: _q5_k, 14: _q6_k, 15: _q8_k,
}


def find(c: Container, name: str) -> Tensor:
    if "\0" in name:
        raise ContractError("tensor name must not contain NUL")
    t = c.tensors.get(name)
    if t is None:
        raise ContractError(f"tensor not found: '{name}'")
    if t.kind not in DECODERS:
        raise ContractError(f"unsupported quant type {t.kind}")
    block = TENSOR_TYPES[t.kind][1]
    if t.dims and t.dims[0] % block:
        raise ContractError(f"row of {t.dims[0]} is not a multiple of the block of {block}")
    return t


def decoded(c: Container, t: Tensor, first: int, count: int) -> np.ndarray:
    """``count`` values from ``first`` on."""
    if first < 0 or count < 0 or first + count > t.n_elements:
        raise ContractError("element range out of bounds")
    if not count:
        return np.zeros(0, F32)
    _, block, size = TENSOR_TYPES[t.kind]
    low, high = first // block, -(-(first + count) // block)
    b = np.frombuffer(c.data, np.uint8, (high - low) * size, t.at + low * size).reshape(-1, size)
    return DECODERS[t.kind](b).reshape(-1)[first - low * block : first - low * block + count]


def as_q8_0(x: np.ndarray) -> np.ndarray:
    """Activations as signed bytes under one half-precision scale for each 32, decoded again; halves go away from zero."""
    runs = x.reshape(-1, 32)
    scale = np.abs(runs).max(axis=1, keepdims=True) / F32(127)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        held, step = scale.astype(np.float16).astype(F32), np.where(scale > 0, F32(1) / scale, F32(0))
        q = runs * step
    if not (np.isfinite(held).all() and np.isfinite(q).all()):
        raise ContractError("activation scale out of range")
    return (np.trunc(q + np.copysign(F32(0.5), q)) * held).reshape(-1)


def as_q8_k(x: np.ndarray) -> np.ndarray:
    """Activations as signed bytes under one scale for each 256, decoded again; halves go to even."""
    runs = x.reshape(-1, 256)
    most = np.take_along_axis(runs, np.abs(runs).argmax(axis=1)[:, None], axis=1)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        step = np.where(most != 0, F32(-127) / most, F32(0))
        scale = np.where(step != 0, F32(1) / step, F32(0))
        q = runs * step
    if not (np.isfinite(step).all() and np.isfinite(scale).all() and np.isfinite(q).all()):
        raise ContractError("activation scale out of range")
    return (np.minimum(np.rint(q), 127) * scale).reshape(-1)


def matvec(c: Container, t: Tensor, x: np.ndarray, rows_at_once: int = 4096) -> np.ndarray:
    """The tensor, leading dimensions flattened, times x; x takes the weights' own precision first."""
    if len(t.dims) < 2 or len(x) != t.dims[0]:
        raise ContractError("matvec requires rank >= 2 and x length equal to dim[0]")
    if not np.isfinite(x).all():
        raise ContractError("x must contain finite values")
    x = as_q8_0(x) if t.kind == 8 else as_q8_k(x) if TENSOR_TYPES[t.kind][1] == 256 else x
    width, out = t.dims[0], []
    for r in range(0, t.n_elements // width, rows_at_once):
        n = min(rows_at_once, t.n_elements // width - r)
        out.append(decoded(c, t, r * width, n * width).reshape(n, width).astype(np.float64) @ x.astype(np.float64))
    return np.concatenate(out).astype(F32) if out else np.zeros(0, F32)


@pandas_udf(FLOATS)
def gguf_tensor_values(path: pd.Series, tensor: pd.Series, first: pd.Series, count: pd.Series) -> pd.Series:
    def one(row):
        if any(pd.isna(v) for v in row):
            return None
        c = container(row[0])
        return decoded(c, find(c, row[1]), int(row[2]), int(row[3]))

    return pd.Series([one(r) for r in zip(path, tensor, first, count, strict=True)], dtype=object)


@pandas_udf(FLOATS)
def gguf_tensor_matvec(path: pd.Series, tensor: pd.Series, x: pd.Series) -> pd.Series:
    def one(p, name, v):
        if p is None or name is None or v is None:
            return None
        c = container(p)
        t, given = find(c, name), v.tolist() if isinstance(v, np.ndarray) else list(v)
        if any(e is None for e in given):
            raise ContractError("x must not contain NULL elements")
        return matvec(c, t, np.array(given, F32))

    return pd.Series([one(*r) for r in zip(path, tensor, x, strict=True)], dtype=object)


def register(spark: SparkSession) -> None:
    """Both functions under their SQL names; files may change, so Spark must not fold or share the calls."""
    spark.udf.register("gguf_tensor_values", gguf_tensor_values.asNondeterministic())
    spark.udf.register("gguf_tensor_matvec", gguf_tensor_matvec.asNondeterministic())
