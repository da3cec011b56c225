"""WARC archives: writing captures, reading records, and assembling them into one nested row per capture.

A capture is three records, each naming the response in WARC-Concurrent-To: the request, the response (or a
revisit, when an equal payload is kept elsewhere), and metadata that hold the page's id. Files are gzipped
and hold whole captures, and each file a bounded number of them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import give_back, store

#: Captures in a file.
CAPTURES_A_FILE = 2000
#: Rows of `originals` up to which they are sent to every task; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Bytes of payload in one batch of read records.
BATCH_BYTES = 8 << 20

_CRLF = "\r\n"
_HEX_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # digits of base 32 as conv() writes them
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(text):
    """Column: the SHA-1 of a string's UTF-8 bytes in upper-case base 32 (32 letters and digits)."""
    digest = F.sha1(text.cast("binary"))
    fives = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*fives)), _HEX_DIGITS, _BASE32)


def originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(digest, original): payloads that several pages share, with the largest page_id among them."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", payload_digest(html).alias("digest"), F.octet_length(html).alias("bytes"))
    return (
        rows.where(F.col("bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "original")
    )


def _record(kind, record_id, fields, content_type, block):
    head = [F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), kind, F.lit(f"{_CRLF}WARC-Record-ID: <urn:uuid:"), record_id, F.lit(">" + _CRLF)]
    tail = [F.lit(f"Content-Type: {content_type}{_CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(_CRLF * 2), block]
    return F.concat(*head, *fields, *tail)


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Write a capture for every row of `pages` (page_id, url, html) to gzipped WARC files in `path`.

    Of rows with equal payloads of `least_bytes` or more, that with the largest page_id is a response and
    the others are revisits of it, without the payload; rows that also share that page_id are responses
    each. Null html counts as empty, a null url as empty, a null page_id is less than any. Line ends in
    urls are escaped. Other columns are not read.
    """
    known = store(originals(pages, least_bytes), "originals")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id",
        F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        html.alias("html"),
        payload_digest(html).alias("digest"),
    ).join(known, "digest", "left")
    rows = rows.select(
        "*",
        (F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))).alias("again"),
        *[F.expr("uuid()").alias(c) for c in ("response_id", "request_id", "metadata_id")],
    )
    common = [F.lit("WARC-Target-URI: "), F.col("url"), F.lit(f"{_CRLF}WARC-Date: {date}{_CRLF}")]
    concurrent = [*common, F.lit("WARC-Concurrent-To: <urn:uuid:"), F.col("response_id"), F.lit(">" + _CRLF)]
    digest = [F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(_CRLF)]
    revisit = F.when(F.col("again"), F.lit(f"WARC-Profile: {_PROFILE}{_CRLF}")).otherwise("")
    length = F.octet_length("html").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), length, F.lit(_CRLF * 2))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    records = [
        _record(F.lit("request"), F.col("request_id"), concurrent, "application/http;msgtype=request", F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1" + _CRLF * 2))),
        _record(F.when(F.col("again"), "revisit").otherwise("response"), F.col("response_id"), [*common, *digest, revisit], "application/http;msgtype=response", F.concat(http, F.when(F.col("again"), "").otherwise(F.col("html")))),
        _record(F.lit("metadata"), F.col("metadata_id"), concurrent, "application/warc-fields", F.concat(F.lit("page_id: "), page, F.lit(_CRLF))),
    ]
    value = F.concat_ws(_CRLF * 2, *records)
    options = {"lineSep": _CRLF * 2, "compression": "gzip", "maxRecordsPerFile": str(CAPTURES_A_FILE)}
    rows.select(value.alias("value")).write.options(**options).text(path)


_FIELDS = {
    "WARC-Record-ID": "record_id",
    "WARC-Type": "type",
    "WARC-Target-URI": "uri",
    "WARC-Date": "date",
    "WARC-Concurrent-To": "concurrent_to",
    "WARC-Payload-Digest": "payload_digest",
    "WARC-Profile": "profile",
    "Content-Type": "content_type",
}

RECORDS = T.StructType(
    [T.StructField(c, T.StringType()) for c in _FIELDS.values()]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha1", T.StringType()), T.StructField("block", T.BinaryType())]
)


def parse(stream):
    """Records of an open archive: (fields by lower-case name, block). Lengths decide, not what blocks hold."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends within a record")
        yield fields, block


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """RECORDS' values but for the block. A revisit's payload is elsewhere: its length is the one HTTP states."""
    size = digest = None
    if fields.get("warc-type") in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if fields["warc-type"] == "response":
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            stated = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(stated[0]) if stated else None
    return (*[fields.get(name.lower()) for name in _FIELDS], size, digest)


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Every record of the archives (*.gz, or plain) in `path`; see RECORDS. Without `blocks`, those of metadata alone."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        kinds = [f.dataType for f in RECORDS]
        arrow = [pa.int64() if isinstance(k, T.LongType) else pa.binary() if isinstance(k, T.BinaryType) else pa.string() for k in kinds]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)], names=RECORDS.names)

        for files in batches:
            for name, content in zip(*[c.to_pylist() if i == 0 else c for i, c in enumerate(files.columns)]):
                raw = io.BytesIO(content.as_buffer())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if name.endswith(".gz") else raw
                rows, held = [], 0
                for fields, block in parse(stream):
                    kept = block if blocks or fields.get("warc-type") == "metadata" else None
                    rows.append((*_row(fields, block), kept))
                    held += len(kept or b"") + 500
                    if held > BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)
        give_back()

    return files.mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, type, the response's columns, and its request and metadata as nested rows.

    Requests and metadata belong to the response or revisit that they name in concurrent_to. A capture
    without them has null and an empty list; records that name no capture are left out.
    """
    nested = F.struct("record_id", "uri", "date", "block")
    captures = records.where("type in ('response', 'revisit')").drop("concurrent_to")
    others = (
        records.where("type in ('request', 'metadata') and concurrent_to is not null")
        .groupBy(F.col("concurrent_to").alias("record_id"))
        .agg(
            F.min(F.when(F.col("type") == "request", nested)).alias("request"),
            F.collect_list(F.when(F.col("type") == "metadata", nested)).alias("metadata"),
        )
    )
    joined = captures.join(others, "record_id", "left")
    return joined.withColumn("metadata", F.coalesce("metadata", F.array().cast(others.schema["metadata"].dataType)))


def page_captures(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of assembled captures.

    The digest and length of a response are those of the payload as read. A revisit refers to the response
    whose payload has the digest that it names, and takes the length from there.
    """
    field = F.regexp_extract(F.col("metadata")[0]["block"].cast("string"), "page_id: *(-?[0-9]+)", 1)
    rows = captures.select(
        F.when(field != "", field).cast("long").alias("page_id"),
        F.coalesce("payload_sha1", F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "payload_bytes",
        F.col("type").alias("record_type"),
    )
    rows = store(rows, "captures")
    kept = rows.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.max("payload_bytes").alias("bytes"))
    again = rows.where("record_type = 'revisit'").join(kept, "payload_digest", "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        again.select("page_id", F.coalesce("bytes", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("original").alias("refers_to"))
        .union(rows.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*out))
    )
