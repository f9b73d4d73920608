"""WARC archives with revisit resolution.

``write_captures`` writes one response record per page; ``read_records`` reads archives back;
``deduplicate`` shuffles only headers by payload digest, joins each repeat to the first capture of its
payload and writes new archives in which repeats are revisit records with fresh headers.

Archives are WARC/1.1 files, one gzip member each.  Spark's text writer makes them: a record is one line and the line
separator is the ``CRLF CRLF`` that ends a record, so any file system that Spark writes to will do and a
lost executor's tasks are written again under Spark's commit protocol.  Reading takes ``Content-Length``
as the only guide, so payloads may hold anything, blank lines and record headers included, and holds the bytes of a
response against their digest.  A file is bounded by ``file_bytes`` of payload: records of up to ``small_bytes`` are written
``file_bytes / small_bytes`` to a file, larger ones apart from them, as many to a file as the largest allows.  One text
is at most 2 GB in Spark, so a record is, too.

Gzip members hold a file each, not a record: Spark's writers make no member by record, so readers that seek
need an index of decompressed offsets.

Defined results: a null payload counts as empty; null url or id give records without that header;
repeated ids with equal payloads keep one response (the first as archived), the others revisit it;
payloads of fewer than ``min_bytes`` bytes are always responses; an empty table gives empty archives.
"""

from __future__ import annotations

import base64
import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, q, scratch

CRLF = "\r\n"
SEPARATOR = CRLF + CRLF
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Params:
    min_bytes: int = 0
    file_bytes: int = 256 << 20
    small_bytes: int = 128 << 10
    date: str = "2020-01-01T00:00:00Z"
    content_type: str = "text/html; charset=utf-8"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the payload's SHA-1, without padding (20 bytes fill 32 digits)."""
    digest = F.sha1(payload)
    parts = [F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 10).cast("long") for k in range(4)]
    return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(v, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for v in parts for i in range(8)))


def record_id(*seed: Column) -> Column:
    """A name-based identifier: equal seeds give equal ids, so a retried task writes the same record."""
    h = F.md5(F.concat_ws("/", *(F.coalesce(s.cast("string"), F.lit("")) for s in seed)))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)])), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; control characters cannot break the line."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", " "), F.lit(CRLF)), F.lit(""))


def record(kind: Column, headers: list[tuple[str, Column]], payload: Column) -> Column:
    body = F.coalesce(payload, F.lit(""))
    lines = [_header("WARC-Type", kind), *(_header(n, v) for n, v in headers), _header("Content-Length", F.octet_length(body))]
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit(CRLF), body)


def _write(records: DataFrame, path: str, largest: int, p: Params) -> None:
    """The column ``value`` as archives; ``largest`` bytes bound each record."""
    per_file = max(1, p.file_bytes // largest)
    records.select("value").write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", p: Params = Params()) -> dict[str, int]:
    """One response record per page, small ones below ``path/small``, others below ``path/large``.

    Returns the bytes that bound each folder's records.  ``Capture-Order`` numbers the records of this write.
    """
    html = F.coalesce(F.col(q(html_col)).cast("string"), F.lit(""))
    order = F.monotonically_increasing_id()
    x = pages.select(F.col(q(id_col)).cast("string").alias("id"), F.col(q(url_col)).cast("string").alias("url"), html.alias("html"), order.alias("n"))
    headers = [
        ("WARC-Record-ID", record_id(F.lit("capture"), F.col("n"))), ("WARC-Date", F.lit(p.date)), ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html")))), ("Page-ID", F.col("id")), ("Capture-Order", F.col("n")), ("Content-Type", F.lit(p.content_type)),
    ]
    size = F.octet_length("html") + 2 * F.coalesce(F.octet_length("url"), F.lit(0)) + 1024  # with room for the headers
    largest = x.agg(F.max(size)).first()[0] or 1024
    folders = {"small": min(largest, p.small_bytes)} | ({"large": largest} if largest > p.small_bytes else {})
    for folder, bound in folders.items():
        part = x if len(folders) == 1 else x.where(size <= p.small_bytes if folder == "small" else size > p.small_bytes)
        _write(part.select(record(F.lit("response"), headers, F.col("html")).alias("value")), f"{path}/{folder}", bound, p)
    return folders


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)[1:]
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield headers, data[start:stop]
        at = stop + 4


# Column of the parsed relation: header that fills it.
HEADERS = {
    "record_id": "WARC-Record-ID", "type": "WARC-Type", "url": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "page": "Page-ID", "n": "Capture-Order",
    "refers_to_id": "WARC-Refers-To", "refers_to_page": "Refers-To-Page-ID", "date": "WARC-Date", "full_bytes": "Payload-Length",
}


def read_records(spark: SparkSession, path: str, payload: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """The records below ``path``: the columns of ``HEADERS``, ``n_bytes``, ``actual`` (the digest of the
    bytes read) and, if asked for, ``payload``."""
    fields = [pa.field(c, pa.string()) for c in HEADERS] + [pa.field("n_bytes", pa.int64()), pa.field("actual", pa.string())] + ([pa.field("payload", pa.string())] if payload else [])
    names = [f.name for f in fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for data in batch.column(0):
                out: list[tuple] = []
                size = 0
                content = data.as_buffer().to_pybytes()
                for h, block in parse(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                    actual = base64.b32encode(hashlib.sha1(block).digest()).decode()
                    if h.get("WARC-Type") == "response" and h.get("WARC-Payload-Digest", f"sha1:{actual}") != f"sha1:{actual}":
                        raise ValueError(f"payload of {h.get('WARC-Record-ID')} does not have its digest")
                    out.append((*(h.get(k) for k in HEADERS.values()), len(block), actual, *([block.decode("utf-8", "surrogatepass")] if payload else [])))
                    size += len(block) if payload else 200
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], names)

    kinds = {"n_bytes": "long"}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(rows, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def write_deduplicated(spark: SparkSession, captures: str, path: str, folders: dict[str, int], p: Params = Params()) -> None:
    """Archives at ``path`` in which repeats of a payload are revisit records of its first capture.

    ``folders`` are those of ``captures``, with the bytes that bound their records.

    Only headers are shuffled by digest.  The first capture (smallest page id, then archive order) comes
    from a partial aggregation; the join back is on the digest, where adaptive skew handling can split
    a payload that very many records share.
    """
    headers = read_records(spark, captures, payload=False).select("record_id", "page", "url", "digest", "n_bytes", "n")
    number = F.expr("try_cast(page AS decimal(38,0))")
    rank = F.struct(number.isNull().alias("a"), number.alias("b"), F.col("page").alias("c"), F.col("n").cast("long").alias("d"))
    firsts = headers.where(F.col("n_bytes") >= p.min_bytes).groupBy("digest", "n_bytes").agg(F.min_by(F.struct("record_id", "page", "url", "n"), rank).alias("first"))
    linked = headers.join(firsts, ["digest", "n_bytes"]).where(F.col("first.record_id") != F.col("record_id"))
    repeats = linked.select(F.col("record_id").alias("rid"), "first")
    if len(folders) > 1:
        repeats = materialize(repeats, "revisits")
    revisit = F.col("rid").isNotNull()
    only = lambda c: F.when(revisit, c)
    fresh_headers = [
        ("WARC-Record-ID", record_id(F.lit("deduplicated"), F.col("n"))), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.col("digest")),
        ("Page-ID", F.col("page")), ("Capture-Order", F.col("n")), ("Payload-Length", F.col("n_bytes")), ("WARC-Profile", only(F.lit(PROFILE))),
        ("WARC-Refers-To", only(record_id(F.lit("deduplicated"), F.col("first.n")))), ("WARC-Refers-To-Target-URI", only(F.col("first.url"))), ("Refers-To-Page-ID", only(F.col("first.page"))),
        ("Content-Type", F.lit(p.content_type)),
    ]
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    stored = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    for folder, bound in folders.items():
        x = read_records(spark, f"{captures}/{folder}").join(repeats, F.col("record_id") == F.col("rid"), "left")
        _write(x.select(record(kind, fresh_headers, stored).alias("value")), f"{path}/{folder}", bound, p)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", p: Params = Params(), path: str | None = None) -> DataFrame:
    """Write captures, write the deduplicated archives, read those back: one row per page."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    folders = write_captures(pages, f"{path}/captures", id_col, url_col, html_col, p)
    write_deduplicated(spark, f"{path}/captures", f"{path}/deduplicated", folders, p)
    kind = pages.schema[id_col].dataType
    back = read_records(spark, f"{path}/deduplicated", payload=False)
    return back.select(
        F.col("page").cast(kind).alias("page_id"), F.col("full_bytes").cast("long").alias("payload_bytes"), F.substring("digest", 6, 32).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to_page").cast(kind).alias("refers_to"), "url", F.col("n_bytes").alias("stored_bytes"),
    )


_DIGITS = ", ".join(f"substr('{BASE32}', ((('0x' || substr(d, {1 + 10 * k}, 10))::BIGINT >> {35 - 5 * i}) & 31)::INTEGER + 1, 1)" for k in range(4) for i in range(8))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
x AS (SELECT page_id, url, octet_length(encode(html)) AS n, concat({_DIGITS}) AS g FROM p),
f AS (SELECT g, n, min(page_id) AS least FROM x GROUP BY 1, 2)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to, url, CASE WHEN page_id = least THEN n ELSE 0 END AS stored_bytes
FROM x JOIN f USING (g, n)
"""
