"""WARC records over a content-addressed archive.

A page's payload is stored once, under its SHA-256; every record's exact headers are stored apart. The first page (least
id) of a payload is a response, later ones are revisits that name it; payloads below `MIN_PAYLOAD` bytes are always
responses. Reading joins headers and payloads again, rebuilds each record byte by byte, parses it as WARC and holds it
against its digest and lengths.

A payload that a third of all pages share is summed up where it lies before anything is shuffled: the shuffle gets one
copy per task. Only headers are joined with the first pages. Digests of very many pages are broadcast, a bounded number;
payloads too where they are small, as only these have many responses.

Defined results: null html is empty; a null url is an empty target; of equal payloads with equal least ids all pages of
that id are responses; pages with a null id come last and revisit a page with an id, if there is one, else all are
responses; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, table, written

MIN_PAYLOAD = 100
DATE = "2000-01-01T00:00:00Z"  # of all records: a fixed value, for equal archives from equal pages
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_head(page_id: int | None, url: str | None, kind: str, digest: str, size: int, refers_to: int | None) -> bytes:
    """Everything of a record before its payload: WARC headers, blank line, HTTP headers. A revisit's block is its HTTP
    headers alone, which give the full payload's length."""
    http = HTTP % size
    length = len(http) + (size if kind == "response" else 0)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record; raises ValueError if its lengths don't fit."""
    top, _, block = data.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    if version != "WARC/1.1" or block[size:] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    http, _, body = block[:size].partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_payload: int = MIN_PAYLOAD) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads), both written in the shared folder: headers(page_id, record_type, digest, size, head) and
    payloads(digest, payload, copies), where each payload is there once."""
    body = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    payloads = written(rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first"), F.count("*").alias("copies")), "warc-payloads")
    shared = payloads.where((F.col("copies") > 1) & F.col("first").isNotNull()).select("digest", "first", "copies")
    each = written(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size")), "warc-pages")
    each = join_hot(each, shared, "digest", "copies")
    revisit = (F.col("size") >= min_payload) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    each = each.select("page_id", "url", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = {c: b.column(c).to_pylist() for c in b.schema.names}
            heads = [record_head(*x) for x in zip(*(got[c] for c in ("page_id", "url", "record_type", "digest", "size", "refers_to")), strict=True)]
            yield pa.record_batch([b.column("page_id"), b.column("digest"), b.column("record_type"), pa.array(heads, pa.binary())], names=["page_id", "digest", "record_type", "head"])

    headers = written(each.mapInArrow(run, "page_id long, digest string, record_type string, head binary"), "warc-headers")
    return headers, payloads.select("digest", "payload", "copies")


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """The original records, record(page_id, digest, data): headers joined with payloads; a revisit has none of its own."""
    end = F.lit(b"\r\n\r\n")
    responses = headers.where(F.col("record_type") == "response")
    full = join_hot(responses, payloads, "digest", "copies", "inner", F.octet_length("payload") < MIN_PAYLOAD).select("page_id", "digest", F.concat("head", "payload", end).alias("data"))
    return full.union(headers.where(F.col("record_type") != "response").select("page_id", "digest", F.concat("head", end).alias("data")))


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, each parsed and verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells: list[list] = [[] for _ in range(5)]
            for data in b.column("data").to_pylist():
                warc, http, body = parse_record(data)
                number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
                kind, digest, size = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
                if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                    raise ValueError(f"record {warc['WARC-Record-ID']} doesn't fit its digest")
                for c, v in zip(cells, (number(warc["WARC-Record-ID"]), size, digest, kind, number(warc.get("WARC-Refers-To"))), strict=True):
                    c.append(v)
            kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return records(headers, payloads).mapInArrow(run, SCHEMA)


def op10_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(*write_archive(table(spark, sf_dir, "pages")))


OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
