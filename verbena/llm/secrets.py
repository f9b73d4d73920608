"""Secret scans with structural confirmation.

Three plain patterns (``assign``, ``access``, ``hex``) give the base spans.  On top of those,
base64 and hex candidates are decoded and their structure is parsed; only what parses to the last
byte is reported:

* ``pem``      a ``PRIVATE KEY`` block whose body is a well-formed key (or a declared encrypted one)
* ``der``      bare base64 or hex (also with colons) that is an ASN.1 private key, nested lengths checked
* ``openssh``  bare base64 or hex that is an ``openssh-key-v1`` container, length-prefixed fields checked
* ``jwt``      a signed token: JSON header with ``alg``, JSON payload, signature length as ``alg`` asks

Base64 may be wrapped by line ends, also such as are written out as ``\\n``, with indentation or quote marks after
them.  Lines that follow on each other are joined and decoded once, however many of them may begin a key.

Defined results: a null text counts as empty (no spans); repeated rows are scanned alike; spans are
zero-based, half-open, in code points; texts of any length are scanned whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import q

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "openssh", "jwt")
MAX_DEPTH = 24

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
# First characters that a DER sequence (0x30), an OpenSSH container or a JSON object can have in base64.
_START = r"(?:M[A-Za-z0-9+/_-]|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/_-]{22,}"
_B64 = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nr]))" + _START)  # at a word's start, or after a line end that is written out
_B64_NEXT = re.compile(_START)  # right after a key
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
# Between two lines of base64: line ends, written out or not, then blanks and quote marks.
_BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t>]*(?=[A-Za-z0-9+/_-])")
_HEXSTART = r"(?:30|(?i:6f70656e7373682d6b65792d763100))[0-9A-Fa-f]{30,}"
_HEXRUN = re.compile(r"(?<![0-9A-Fa-f])" + _HEXSTART)
_HEX_NEXT = re.compile(_HEXSTART)
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:30|(?i:6f))(?::\s{0,16}[0-9A-Fa-f]{2}(?![0-9A-Fa-f])){15,}")
_PAIR = re.compile(r"[0-9A-Fa-f]{2}")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])(e[w-z][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]+)")

# Signature bytes that the registered algorithms give (fixed values of RFC 7518 and RFC 8037).
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}


def _b64(s: str) -> bytes | None:
    try:
        return base64.b64decode(s.replace("-", "+").replace("_", "/") + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _header(b: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the ASN.1 value at ``at``."""
    if at + 2 > len(b):
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(b):
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
    return tag, at, at + n


def _nested(b: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """The values that fill ``b[start:end]`` exactly, with all constructed ones inside well formed."""
    out = []
    while start < end:
        h = _header(b, start)
        if h is None or h[2] > end or depth > MAX_DEPTH:
            return None
        if h[0] & 0x20 and _nested(b, h[1], h[2], depth + 1) is None:
            return None
        out.append(h)
        start = h[2]
    return out


def der_key_length(b: bytes, at: int = 0) -> int:
    """Bytes that an ASN.1 private key at place ``at`` of ``b`` takes; 0 if there is none.

    Known layouts: PKCS#1, DSA and SEC1 (version, then numbers or an octet string), PKCS#8
    (version, algorithm, octet string) and encrypted PKCS#8 (algorithm, octet string).
    """
    top = _header(b, at)
    if top is None or top[0] != 0x30 or top[2] > len(b):
        return 0
    first = _header(b, top[1])
    if first is None or first[2] > top[2] or first[0] not in (2, 0x30) or b[first[1] : first[1] + 1] not in (b"\0", b"\1", b"\6"):
        return 0  # neither a version nor an algorithm: nothing after it need be read
    inner = _nested(b, top[1], top[2])
    if not inner or len(inner) < 2:
        return 0
    tags = [t for t, _, _ in inner]
    version = tags[0] == 2 and inner[0][2] - inner[0][1] == 1 and b[inner[0][1]] <= 1
    if version and (tags[1] == 4 or tags[1:3] == [0x30, 4] or len(tags) >= 6 and all(t == 2 for t in tags[:6])):
        return top[2] - at
    if tags == [0x30, 4]:
        algorithm = _nested(b, inner[0][1], inner[0][2])
        if algorithm and algorithm[0][0] == 6 and inner[1][2] - inner[1][1] >= 8:
            return top[2] - at
    return 0


def openssh_key_length(b: bytes, at: int = 0) -> int:
    """Bytes that an ``openssh-key-v1`` container at place ``at`` takes; 0 if there is none."""
    if not b.startswith(b"openssh-key-v1\0", at):
        return 0
    start, at = at, at + 15

    def field() -> bool:
        nonlocal at
        if at + 4 > len(b):
            return False
        at += 4 + int.from_bytes(b[at : at + 4], "big")
        return at <= len(b)

    if not (field() and field() and field()) or at + 4 > len(b):  # cipher, key derivation, its options
        return 0
    keys = int.from_bytes(b[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64 or not all(field() for _ in range(keys + 1)):  # public keys, private part
        return 0
    return at - start


def _pem(label: str, body: str) -> bool:
    """Whether the lines between the marks of a block are a well-formed key."""
    body = body.replace("\\r", "").replace("\\n", "\n")
    lines = [x.strip(" \t>") for x in body.splitlines()]  # with the marks of a quoted mail
    encrypted = any(x.startswith("DEK-Info:") for x in lines)
    b = _b64("".join(x for x in lines if ":" not in x).replace(" ", "").rstrip("="))
    if not b:
        return False
    if encrypted:
        return len(b) % 8 == 0
    return len(b) == (openssh_key_length(b) if "OPENSSH" in label else der_key_length(b))


def _pem_blocks(text: str) -> list[tuple[int, int]]:
    """Start and end of confirmed blocks; an end mark closes the last begin mark with its label, so each mark is seen once."""
    out, opened = [], {}
    for m in _PEM.finditer(text):
        if m[1] == "BEGIN":
            opened[m[2]] = m
        elif (begin := opened.pop(m[2], None)) and _pem(m[2], text[begin.end() : m.start()]):
            out.append((begin.start(), m.end()))
    return out


def _jwt(m: re.Match) -> bool:
    try:
        header, payload = (json.loads(_b64(m[k]) or b"") for k in (1, 2))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(alg := header.get("alg"), str):
        return False
    signature = _b64(m[3])
    return signature is not None and (len(signature) == _SIGNATURE[alg] if alg in _SIGNATURE else alg[:2] in ("RS", "PS") and len(signature) >= 128)


def _key(b: bytes | None, at: int = 0) -> tuple[int, int]:
    """Kind and bytes of the key at place ``at`` of ``b``; no bytes if there is none."""
    if not b:
        return 4, 0
    if (n := der_key_length(b, at)) >= 24:
        return 4, n
    return 5, openssh_key_length(b, at)


class _Run:
    """Lines of base64 from a place on, joined, with their places; each of the four ways to read them is decoded once."""

    def __init__(self, text: str, at: int):
        self.text, self.starts, self.places, parts, n = text, [], [], [], 0
        while m := _LINE.match(text, at):
            self.starts.append(n)
            self.places.append(m.start())
            parts.append(m[0])
            n, self.end = n + len(m[0]), m.end()
            gap = _BREAK.match(text, m.end())
            if not gap:
                break
            at = gap.end()
        self.joined, self.read = "".join(parts), {}

    def key(self, at: int) -> tuple[int, int]:
        """Kind and end of the key that begins at place ``at`` of the text; the end is ``at`` if there is none."""
        k = bisect.bisect_right(self.places, at) - 1
        from_ = self.starts[k] + at - self.places[k]
        way = from_ % 4
        if way not in self.read:
            part = self.joined[way:]
            self.read[way] = _b64(part[: len(part) - (len(part) % 4 == 1)])
        kind, n = _key(self.read[way], (from_ - way) // 4 * 3)
        if not n:
            return kind, at
        last = from_ + -(-n * 8 // 6) - 1
        k = bisect.bisect_right(self.starts, last) - 1
        end = self.places[k] + last - self.starts[k] + 1
        while self.text[end : end + 1] == "=":
            end += 1
        return kind, end


def _b64_keys(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of keys in base64; after a key the scan goes on at its end, else after the first line."""
    out, m, run = [], _B64.search(text), None
    while m:
        if run is None or m.start() >= run.end:
            run = _Run(text, m.start())
        kind, end = run.key(m.start())
        if end > m.start():
            out.append((m.start(), kind, end))
            m = _B64_NEXT.match(text, end) or _B64.search(text, end)
        else:
            m = _B64.search(text, m.end())
    return out


def _colon_keys(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of keys in hex with colons between the bytes."""
    out = []
    for m in _COLONS.finditer(text):
        pairs = list(_PAIR.finditer(text, m.start(), m.end()))
        kind, n = _key(bytes.fromhex("".join(p[0] for p in pairs)))
        if n:
            out.append((m.start(), kind, pairs[n - 1].end()))
    return out


def _hex_keys(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of keys in hex."""
    out, m = [], _HEXRUN.search(text)
    while m:
        kind, n = _key(bytes.fromhex(m[0][: len(m[0]) & ~1]))
        end = m.start() + 2 * n
        if n:
            out.append((m.start(), kind, end))
        m = n and _HEX_NEXT.match(text, end) or _HEXRUN.search(text, end if n else m.end())
    return out


def _inside(at: int, blocks: list[tuple[int, int]]) -> bool:
    k = bisect.bisect_right(blocks, at, key=lambda block: block[0]) - 1
    return k >= 0 and at < blocks[k][1]


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of ``text``, by start, then by kind in the order of ``KINDS``, then by end."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    blocks = sorted(_pem_blocks(text)) if "-----BEGIN" in text else []
    found += [(a, 3, z) for a, z in blocks]
    found += [k for k in _b64_keys(text) if not _inside(k[0], blocks)]
    found += _hex_keys(text)
    found += _colon_keys(text) if "30:" in text or "6f:" in text.lower() else []
    if any(h in text for h in ("ew", "ex", "ey", "ez")) and "." in text:  # how a header may begin
        found += [(m.start(), 6, m.end()) for m in _JWT.finditer(text) if _jwt(m)]
    return [(KINDS[k], a, z) for a, k, z in sorted(set(found))]


@F.pandas_udf(SPANS)
def secret_spans(texts: pd.Series) -> pd.Series:
    """Column function: the spans of each text."""
    return pd.Series([[{"kind": k, "start": a, "end": z} for k, a, z in scan(t)] for t in texts])


def redact(text: str | None, mark: str = "<SECRET>") -> str | None:
    """``text`` with each maximal stretch of overlapping spans replaced by ``mark``."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    end = -1
    for _, a, z in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[at:a] if a >= at else "", mark]
        end = max(end, z)
        at = end
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def redacted(texts: pd.Series) -> pd.Series:
    """Column function: each text without its secrets; null stays null."""
    return pd.Series([redact(t) for t in texts], dtype=object)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``found``, the array of confirmed spans."""
    return docs.select(F.col(q(id_col)).alias("doc_id"), secret_spans(F.col(q(text_col))).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``find_secrets`` gives."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


_EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_NAMES = "|".join(map(_EITHER, ("password", "passwd", "secret", "token"))) + f"|{_EITHER('api')}_?{_EITHER('key')}"
BASE_SQL = f"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '({_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 24)) AS n_hex
FROM documents
"""
