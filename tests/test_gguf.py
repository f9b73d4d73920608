import struct

import numpy as np
import pytest
from gguf_writer import written

from verbena.contracts import ContractError
from verbena.functions import quant
from verbena.sources import gguf

VALUES = [
    ("general.architecture", 8, "fixture"), ("general.alignment", 4, 64), ("general.name", 8, "Ünïcode ✓ model"), ("t.u8", 0, 255), ("t.i8", 1, -128), ("t.u16", 2, 65535),
    ("t.i16", 3, -32768), ("t.u32", 4, 2**32 - 1), ("t.i32", 5, -(2**31)), ("t.f32", 6, 0.1), ("t.bool", 7, True), ("t.u64", 10, 2**64 - 1), ("t.i64", 11, -(2**63)),
    ("t.f64", 12, 2.5e-300), ("t.tokens", 9, (8, ["<s>", "▁hello", "", "✓"])), ("t.scores", 9, (6, [0, -1.5, 3.25])), ("t.empty", 9, (5, [])), ("t.nested", 9, (9, [(5, [1]), (5, [2, 3])])),
]
Q8 = np.float16(1).tobytes() + bytes(range(32))
TENSORS = [("w.f32", 0, (4, 2), np.arange(8, dtype="<f4").tobytes()), ("w.q8_0", 8, (32,), Q8), ("w.future", 99, (7,), b"")]


@pytest.fixture
def model(tmp_path):
    path = tmp_path / "valid.gguf"
    path.write_bytes(written(values=VALUES, tensors=TENSORS, alignment=64))
    return str(path)


def test_views(spark, model):
    gguf.register(spark)
    h = spark.sql(f"SELECT * FROM gguf_header('{model}')").first()
    assert (h["version"], h["tensor_count"], h["metadata_count"], h["alignment"], h["data_offset"] % 64, h["tensor_bytes"]) == (3, 3, 18, 64, 0, 66)
    rows = spark.read.format("gguf").option("view", "metadata").load(model).orderBy("ordinal").collect()
    assert [r["key"] for r in rows] == [k for k, _, _ in VALUES]
    got = {r["key"]: r["value"] for r in rows}
    assert (got["t.f32"], got["t.f64"], got["t.u64"], got["t.i64"], got["t.bool"], got["general.name"]) == ("0.100000001", "2.5e-300", str(2**64 - 1), str(-(2**63)), "true", "Ünïcode ✓ model")
    assert {(r["key"], r["array_type"], r["array_length"]) for r in rows if r["value"] is None} == {("t.empty", "int32", 0), ("t.nested", "array", 2), ("t.scores", "float32", 3), ("t.tokens", "string", 4)}
    array = lambda key: [r["value"] for r in spark.sql(f"SELECT * FROM gguf_metadata_array('{model}', '{key}') ORDER BY array_index").collect()]
    assert array("t.tokens") == ["<s>", "▁hello", "", "✓"] and array("t.scores") == ["0", "-1.5", "3.25"] and array("t.empty") == [] and array("t.nested") == [None, None]
    tensors = spark.sql(f"SELECT * FROM gguf_tensors('{model}') ORDER BY tensor_index").collect()
    assert [(t["name"], t["ggml_type"], t["ggml_type_id"], t["dims"], t["n_elements"], t["n_bytes"]) for t in tensors] == [("w.f32", "f32", 0, [4, 2], 8, 32), ("w.q8_0", "q8_0", 8, [32], 32, 34), ("w.future", None, 99, [7], 7, None)]
    with pytest.raises(Exception, match="is not an array"):
        spark.read.format("gguf").option("view", "array").option("key", "missing").load(model)


def test_broken_containers(tmp_path):
    def broken(data: bytes, message: str):
        path = tmp_path / "x.gguf"
        path.write_bytes(data)
        with pytest.raises(ContractError, match=message):
            gguf.Container(str(path))

    whole = written(values=VALUES, tensors=TENSORS, alignment=64)
    broken(b"", "magic")
    broken(b"GGUG" + whole[4:], "magic")
    broken(written(version=1), "GGUF version 1 is not supported")
    broken(written()[:20], "overruns the file")
    broken(b"GGUF" + struct.pack("<IQQ", 3, 2**60, 2**60), "header counts exceed")
    broken(written(values=[("a", 0, 1), ("a", 0, 2)]), "duplicate metadata key 'a'")
    broken(written(tensors=[("w", 0, (1,), b"\0" * 4)] * 2), "duplicate tensor 'w'")
    broken(written(tensors=[("w", 0, (1, 1, 1, 1, 1), b"\0" * 4)]), "has 5 dimensions")
    broken(written(values=[("general.alignment", 4, 24)]), "is not a power of two")
    broken(written(tensors=[("w", 8, (33,), b"\0" * 34)]), "is not a multiple of the q8_0 block")
    broken(written(tensors=[("w", 0, (100,), b"\0" * 32)]), "payload overruns the file")
    broken(written(values=[("a", 9, (9, [(9, [(9, [(9, [(0, [1])])])])]))]), "nested")
    broken(b"GGUF" + struct.pack("<IQQQ", 3, 0, 1, 1) + b"a" + struct.pack("<IQ", 77, 0), "unknown type 77")
    broken(b"GGUF" + struct.pack("<IQQQ", 3, 0, 1, 100) + b"a" * 20, "string of 100 bytes overruns")
    broken(b"GGUF" + struct.pack("<IQQQ", 3, 0, 1, 1) + b"\xff" + struct.pack("<IQ", 0, 0), "not valid UTF-8")
    for n in range(0, len(whole), 7):  # cut anywhere, a container opens or is refused
        (tmp_path / "x.gguf").write_bytes(whole[:n])
        try:
            gguf.Container(str(tmp_path / "x.gguf"))
        except ContractError:
            pass


def scalar_decode(kind: int, b: bytes) -> list[float]:
    """One block, value by value, from the published layouts."""
    half = lambda at: float(np.frombuffer(b, "<f2", 1, at)[0])
    out = []
    for i in range(256):
        h, r = divmod(i, 128)  # half and place in it
        j, l = divmod(r, 32)
        if kind == 10:
            s, q = b[i // 16], b[16 + 32 * h + l] >> 2 * j & 3
            out.append(half(80) * (s & 15) * q - half(82) * (s >> 4))
        elif kind == 11:
            n = i // 16
            s = (b[96 + n] & 15 if n < 8 else b[96 + n - 8] >> 4) | (b[104 + n % 4] >> 2 * (n // 4) & 3) << 4
            q = (b[32 + 32 * h + l] >> 2 * j & 3) - (0 if b[l] >> (4 * h + j) & 1 else 4)
            out.append(half(108) * (s - 32) * q)
        elif kind in (12, 13):
            n, s = i // 32, b[4:16]
            scale, least = (s[n] & 63, s[n + 4] & 63) if n < 4 else (s[n + 4] & 15 | s[n - 4] >> 6 << 4, s[n + 4] >> 4 | s[n] >> 6 << 4)
            q = b[(16 if kind == 12 else 48) + 32 * (n // 2) + i % 32] >> 4 * (n % 2) & 15
            q |= (b[16 + i % 32] >> n & 1) << 4 if kind == 13 else 0
            out.append(half(0) * scale * q - half(2) * least)
        elif kind == 14:
            low = b[64 * h + r % 64] >> 4 * (r // 64) & 15
            high = b[128 + 32 * h + l] >> 2 * j & 3
            out.append(half(208) * int(np.int8(np.uint8(b[192 + i // 16]))) * ((low | high << 4) - 32))
        elif kind == 15:
            out.append(float(np.frombuffer(b, "<f4", 1)[0]) * int(np.int8(np.uint8(b[4 + i]))))
    return out


@pytest.mark.parametrize("kind", [10, 11, 12, 13, 14, 15])
def test_block_decoders(kind):
    rng = np.random.default_rng(kind)
    b = rng.integers(0, 256, (3, gguf.TENSOR_TYPES[kind][2]), dtype=np.uint8)
    for at in {10: (80, 82), 11: (108,), 12: (0, 2), 13: (0, 2), 14: (208,), 15: ()}[kind]:
        b[:, at : at + 2] = rng.normal(size=(3, 1)).astype("<f2").view(np.uint8)
    if kind == 15:
        b[:, :4] = rng.normal(size=(3, 1)).astype("<f4").view(np.uint8)
    got = quant.DECODERS[kind](b)
    assert got.dtype == np.float32 and np.allclose(got, [scalar_decode(kind, row.tobytes()) for row in b], rtol=1e-5, atol=1e-5)


def test_values_and_products(spark, model, tmp_path):
    quant.register(spark)
    one = lambda e: spark.sql(f"SELECT {e} AS v").first()["v"]
    assert one(f"gguf_tensor_values('{model}', 'w.f32', 2, 5)") == [2, 3, 4, 5, 6]
    assert one(f"gguf_tensor_values('{model}', 'w.q8_0', 0, 32)") == list(range(32))
    assert one(f"gguf_tensor_values('{model}', 'w.f32', 8, 0)") == []
    assert one(f"gguf_tensor_values('{model}', 'w.f32', cast(null as bigint), 1)") is None
    assert one(f"gguf_tensor_matvec('{model}', 'w.f32', array(1F, 2F, 3F, 4F))") == [20, 60]
    assert one(f"gguf_tensor_matvec('{model}', 'w.f32', cast(null as array<float>))") is None
    for call, message in (("values('{}', 'missing', 0, 1)", "tensor not found"), ("values('{}', 'w.future', 0, 1)", "unsupported quant type"), ("values('{}', 'w.f32', 7, 2)", "out of bounds"),
                          ("matvec('{}', 'w.q8_0', array(1F))", "requires rank >= 2"), ("matvec('{}', 'w.f32', array(1F, 2F, 3F))", "equal to dim"), ("matvec('{}', 'w.f32', array(1F, null, 3F, 4F))", "NULL|finite")):
        with pytest.raises(Exception, match=message):
            one("gguf_tensor_" + call.format(model))
    path = tmp_path / "quant.gguf"
    rng = np.random.default_rng(5)
    kinds = [0, 1, 30, 8, 10, 11, 12, 13, 14, 15]
    path.write_bytes(written(tensors=[(f"w.{k}", k, (512, 7), rng.integers(0, 60, 512 * 7 // gguf.TENSOR_TYPES[k][1] * gguf.TENSOR_TYPES[k][2], dtype=np.uint8).tobytes()) for k in kinds]))
    c = gguf.container(str(path))
    x = rng.normal(size=512).astype(np.float32)
    for k in kinds:
        t = quant.find(c, f"w.{k}")
        assert quant.matvec(c, t, np.zeros(512, np.float32)).tolist() == [0] * 7
        exact = quant.decoded(c, t, 0, 512 * 7).reshape(7, 512).astype(float) @ x
        assert np.abs(quant.matvec(c, t, x, rows_at_once=3) - exact).max() <= 0.02 * np.abs(quant.decoded(c, t, 0, 512 * 7)).max() * np.abs(x).sum()
    for k, v in ((8, 1e30), (15, 1e-40)):
        with pytest.raises(ContractError, match="scale out of range"):
            quant.matvec(c, quant.find(c, f"w.{k}"), np.full(512, v, np.float32))
