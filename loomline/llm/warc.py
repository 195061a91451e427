"""WARC archives: written with segmented records, read back by segment reassembly.

Writing is a text write whose rows are records and whose line separator is the
blank line that ends a record, so any store that Spark writes to will do. A
payload longer than a segment is cut into a first record and continuation
records; bodies are framed as chunked transfer coding.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.session import materialise, shared_folder

SEGMENT_BYTES = 8192  # largest block of one record
FRAME_BYTES = 4096  # largest chunk of the transfer coding
FILE_RECORDS = 4000  # records of one archive, which bounds an archive to about 32 MB before compression
MIN_REVISIT = 100  # shorter payloads are never replaced by a revisit
DATE = "2024-01-01T00:00:00Z"  # fixed value: the tables have no fetch time

RECORDS = "origin string, number int, total long, kind string, page_id long, digest string, refers_to long, block binary"


def chunked(body: bytes, size: int = FRAME_BYTES) -> bytes:
    """Chunked transfer framing of a body."""
    parts = []
    for at in range(0, len(body), size):
        part = body[at:at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body of a chunked message; ValueError where the framing is broken or bytes are missing."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is missing")
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if framed[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is not closed")
        parts.append(framed[at:at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the blank line that ends it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def _uri(url: str | None) -> str | None:
    """A header value cannot hold line ends."""
    return None if url is None else " ".join(url.split())


def _page_records(row: dict, segment: int) -> Iterator[bytes]:
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", _uri(row["url"])), ("X-Page-ID", row["page_id"])]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if row["record_type"] == "revisit":
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *shared, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("X-Refers-To-Page", row["refers_to"]), ("Content-Type", "application/http;msgtype=response")], head + b"\r\n")
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"])
    origin = f"<urn:uuid:{uuid.uuid4()}>"
    parts = [block[at:at + segment] for at in range(0, len(block), segment)]
    many = len(parts) > 1
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *shared, ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1 if many else None)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *shared, ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part)


def _to_records(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                for record in _page_records(row, segment):
                    out.append(record)
                    size += len(record)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) under ``path``, longer ones in segments.

    Among rows with equal payloads of at least 100 bytes those with the smallest
    page_id are responses and the rest revisits of it. A null html is an empty
    payload, a null url or page_id a missing header; a row without page_id
    is a revisit only if another row of its group has one. Other columns are ignored.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    first = base.where(F.length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    # Only digests that repeat are met again.
    first = materialise(first.select(F.col("digest").alias("first_digest"), "first_id"), "warc_first")
    known = base.join(first, F.col("digest") == F.col("first_digest"), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = known.select("page_id", "url", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                        F.when(again, F.col("first_id")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"))
    records = rows.mapInArrow(_to_records(segment), "value binary")
    # A cast from binary keeps the bytes as they are, and the text writer writes them so.
    records.select(F.col("value").cast("string").alias("value")).write.mode("errorifexists").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", str(FILE_RECORDS)).option("compression", "gzip").text(path)


def _parse(archive: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        block = archive[end + 4:end + 4 + size]
        if len(block) != size or archive[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        at = end + 8 + size
        number = lambda k: int(headers[k]) if k in headers else None
        kind = headers["warc-type"]
        if kind in ("response", "revisit", "continuation"):
            yield (headers.get("warc-segment-origin-id", headers["warc-record-id"]), number("warc-segment-number") or 1, number("warc-segment-total-length"), kind,
                   number("x-page-id"), headers.get("warc-payload-digest", "").removeprefix("sha256:"), number("x-refers-to-page"), block)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    for batch in batches:
        for archive in batch.column(0):
            rows, size = [], 0
            for row in _parse(gzip.decompress(archive.as_py())):
                rows.append(row)
                size += len(row[-1])
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every response, revisit and continuation record of the archives under ``path``, with its block."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_read, RECORDS)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            parts = row["parts"]
            block = b"".join(p["block"] for p in parts)
            total, fault, payload = max((p["total"] for p in parts if p["total"] is not None), default=None), None, b""
            if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
                fault = "segments are missing or repeated"
            elif len(parts) > 1 and total != len(block):
                fault = f"total length is {total}, segments hold {len(block)}"
            elif row["kind"] == "response":
                head, _, body = block.partition(b"\r\n\r\n")
                try:
                    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                except ValueError as exc:
                    fault = str(exc)
                else:
                    if row["digest"] and hashlib.sha256(payload).hexdigest() != row["digest"]:
                        fault = "payload has another digest"
            out.append((row["page_id"], row["kind"], row["digest"], row["refers_to"], len(parts), None if row["kind"] == "revisit" or fault else payload, fault))
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types],
                                         names=["page_id", "record_type", "digest", "refers_to", "segments", "payload", "fault"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per captured page: page_id, record_type, digest, refers_to, segments, payload, fault.

    Continuation records are grouped with their origin, ordered by segment
    number, checked against the total length and the payload digest, and freed
    of their transfer framing. A capture that fails a check keeps its row, with
    the reason in ``fault`` and no payload. A revisit has no payload of its own.
    A group holds the segments of one capture, so it is as large as one page.
    """
    records = read_records(spark, path)
    # A kind of "continuation" alone means that the first segment is lost.
    head = F.min(F.when(F.col("kind") != "continuation", F.struct("kind", "page_id", "digest", "refers_to")))
    parts = F.array_sort(F.collect_list(F.struct("number", "total", "block")))
    whole = records.groupBy("origin").agg(head.alias("head"), F.min("page_id").alias("any_page"), parts.alias("parts"))
    flat = whole.select(F.coalesce("head.page_id", "any_page").alias("page_id"), F.coalesce("head.kind", F.lit("response")).alias("kind"), F.coalesce("head.digest", F.lit("")).alias("digest"), "head.refers_to", "parts")
    return flat.mapInArrow(_whole, "page_id long, record_type string, digest string, refers_to long, segments int, payload binary, fault string")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and describe each capture.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to,
    fault. A revisit takes its length from the response it refers to.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/loomline/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    back = read_archives(spark, path).select("page_id", "record_type", "digest", "refers_to", F.length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha"), "fault")
    back = materialise(back, "warc_back")
    lengths = back.where("record_type = 'response' and n is not null").groupBy(F.col("digest").alias("of_digest")).agg(F.max("n").alias("of_n"))
    whole = back.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.coalesce("sha", "digest").alias("payload_digest"), "record_type", "refers_to", "fault")
    seen = back.where("record_type = 'revisit'").join(lengths, F.col("digest") == F.col("of_digest"), "left").select(
        "page_id", F.col("of_n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "fault")
    return whole.unionByName(seen)


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to, CAST(NULL AS VARCHAR) AS fault
FROM f
"""
