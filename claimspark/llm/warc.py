"""WARC archives of page tables, and their captures put together again.

Every page is one capture of three records: a request, a response (or a revisit, if an earlier page
holds the same payload) and metadata. Response and metadata name the request in
``WARC-Concurrent-To``; that identifier joins them after reading.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.session import scratch_path

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of one file, which bounds what a reading task holds at a time.
FILE_RECORDS = 1536
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "date string, named_digest string, payload_bytes long, payload_digest string, "
    "fields map<string,string>, payload binary"
)


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: ten hex digits are eight symbols."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    hexed = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), digits, BASE32)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with ``payload``, ``payload_digest``, ``payload_bytes`` and ``first_page``.

    ``first_page`` is the smallest ``page_id`` with the same payload where that is another page's
    and the payload has at least ``min_bytes``, else null. Groups are counted over digests, so
    payloads cross one shuffle, by page. A null ``page_id`` comes after all others; if no page of
    a payload has an id, each is a response.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    light = rows.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest", "payload_bytes")
    key = ["payload_digest", "payload_bytes"]
    firsts = light.groupBy(*key).agg(F.min("page_id").alias("first_page"), F.count("*").alias("_n")).filter("_n > 1")
    # A digest may hold a third of the pages: a sort-merge join, which Spark splits where it is skewed.
    later = light.hint("merge").join(firsts.drop("_n"), key)
    later = later.filter("page_id is null or page_id > first_page").distinct()
    same = F.col("p.page_id").eqNullSafe(F.col("l.page_id")) & (F.col("p.payload_digest") == F.col("l.payload_digest"))
    joined = rows.alias("p").join(later.hint("merge").alias("l"), same, "left")
    return joined.select("p.*", "l.first_page")


def _record(kind: str, identifier: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    lines = [
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: <"), identifier, F.lit(f">{CRLF}"),
        *headers, F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block,
    ]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write_warc(pages: DataFrame, path: str, date: str, min_bytes: int = 0) -> None:
    """Write one capture per row of ``pages`` (``page_id, url, html``) as WARC 1.1 files.

    A null ``html`` is an empty payload, a null ``url`` leaves the target out, line breaks in a URL
    are percent-encoded, equal rows are written each, other columns are ignored. An empty table
    gives no records.
    """
    rows = with_revisits(pages, min_bytes)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    named = lambda p: F.concat(F.lit("urn:page:"), p, F.lit(":"), "payload_digest")
    rows = rows.select(
        "payload", "payload_bytes", "payload_digest", "page_id", "first_page",
        F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("uri"),
        named(page).alias("own"),
        named(F.col("first_page").cast("string")).alias("first"),
        # Copies of a row are captures of their own.
        F.concat(F.lit("urn:capture:"), page, F.lit(":"), F.monotonically_increasing_id().cast("string")).alias("tx"),
    )
    common = [_header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", F.col("uri"))]
    joined = [_header("WARC-Concurrent-To", F.concat(F.lit("<"), "tx", F.lit(">")))]
    digest = [_header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest"))]
    seen = F.col("first_page").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    refers = [_header("WARC-Refers-To", F.concat(F.lit("<"), "first", F.lit(">"))), _header("WARC-Profile", F.lit(PROFILE))]
    get = F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    fields = F.concat(
        _header("page-id", F.col("page_id").cast("string")),
        _header("payload-bytes", F.col("payload_bytes").cast("string")),
        _header("refers-to-page", F.col("first_page").cast("string")),
    )
    exchange = "application/http;msgtype="
    revisit = _record("revisit", F.col("own"), common + joined + digest + refers, exchange + "response", http)
    whole = F.concat(http, "payload")
    response = _record("response", F.col("own"), common + joined + digest, exchange + "response", whole)
    records = F.array(
        _record("request", F.col("tx"), common, exchange + "request", get),
        F.when(seen, revisit).otherwise(response),
        _record("metadata", F.concat("tx", F.lit(":metadata")), common + joined, "application/warc-fields", fields),
    )
    # The text sink writes strings as they are and ends each with the two line ends of a record.
    writer = rows.select(F.explode(records).alias("value")).write.mode("overwrite")
    writer.options(lineSep=CRLF + CRLF, maxRecordsPerFile=FILE_RECORDS, compression="gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n"))
    return {k.decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, sep, v in pairs if sep}


def parse_records(content: bytes, with_payload: bool = True) -> Iterator[tuple]:
    """The records of one archive, found by their declared lengths alone."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        head = _fields(content[at:end])
        start = end + 4
        at = start + int(head["Content-Length"])
        block, kind = content[start:at], head["WARC-Type"]
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at += 4
        payload, own = None, {}
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
        elif kind == "metadata":
            own = _fields(block)
        name = lambda key: head[key].strip("<>") if key in head else None
        yield (
            name("WARC-Record-ID"), kind, name("WARC-Concurrent-To"), name("WARC-Refers-To"),
            head.get("WARC-Target-URI"), head.get("WARC-Date"),
            head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
            None if payload is None else len(payload),
            None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            own, payload if with_payload else None,
        )


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``path``."""
    columns = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                # Archives are read gzipped, as written here, and plain.
                plain = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                found = pd.DataFrame(list(parse_records(plain, with_payload)), columns=columns)
                yield found.astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, RECORD_SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, request, response, metadata``.

    Records meet by the identifier of the request: their ``WARC-Concurrent-To``, or the request's
    own. ``response`` also holds revisits; a missing part is null.
    """
    key = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    part = F.struct(*[c for c in records.columns if c not in ("concurrent_to", "fields")], F.map_entries("fields").alias("fields"))
    kinds = {"request": ["request"], "response": ["response", "revisit"], "metadata": ["metadata"]}
    parts = [F.max(F.when(F.col("record_type").isin(kinds[k]), part)).alias(k) for k in kinds]
    return records.groupBy(key).agg(*parts)


def archived_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder, read the archives back and describe each page.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Length and digest of
    a response come from its archived payload, those of a revisit from its record's header and its
    metadata record, as it holds no payload.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, date, min_bytes)
    whole = captures(read_records(spark, path, with_payload=False))
    field = lambda name: F.map_from_entries("metadata.fields")[name].cast("long")
    return whole.select(
        field("page-id").alias("page_id"),
        F.coalesce("response.payload_bytes", field("payload-bytes")).alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.named_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.record_type") == "revisit", field("refers-to-page")).alias("refers_to"),
    )
