"""Containers for tests."""

import struct
from itertools import pairwise

from verbena.sources.gguf import ARRAY, CODES, STRING


def written(version: int = 3, values: list[tuple] = (), tensors: list[tuple] = (), alignment: int = 32) -> bytes:
    """A container's bytes from (key, type, value) and (name, type, dims, payload); an array's value is (type, items)."""

    def text(s: str) -> bytes:
        return struct.pack("<Q", len(s.encode())) + s.encode()

    def value(kind: int, v) -> bytes:
        if kind == ARRAY:
            return struct.pack("<IQ", v[0], len(v[1])) + b"".join(value(v[0], x) for x in v[1])
        return text(v) if kind == STRING else struct.pack(f"<{CODES[kind]}", v)

    sizes = [0]
    for *_, payload in tensors:
        sizes.append(-(-(sizes[-1] + len(payload)) // alignment) * alignment)
    head = b"GGUF" + struct.pack("<IQQ", version, len(tensors), len(values))
    head += b"".join(text(k) + struct.pack("<I", t) + value(t, v) for k, t, v in values)
    for (name, kind, dims, _), at in zip(tensors, sizes, strict=False):
        head += text(name) + struct.pack(f"<I{len(dims)}QIQ", len(dims), *dims, kind, at)
    head += bytes(-len(head) % alignment)
    return head + b"".join(payload.ljust(end - began, b"\0") for (*_, payload), (began, end) in zip(tensors, pairwise(sizes), strict=True))
