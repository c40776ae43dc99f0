"""Web archives: captures as WARC records in files, read back and assembled into one nested row a capture.

Every page becomes a request, a response and a metadata record; the other two name the response in
WARC-Concurrent-To. Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest id is a
response, the others are revisits without payload that name it in WARC-Refers-To. Files are written by Spark's text
writer, whose line separator is the end of a WARC record, so writing and reading work on any file system Spark knows,
and a lost executor costs a task. Files hold about ``FILE_BYTES`` of records each, and are parsed by Content-Length.

Reading joins capture, request and metadata through the concurrent-to identifiers; only what a caller selects of a
record crosses the shuffle. Duplicate targets are found from digests, so no payload is shuffled to find them.

Defined results: null html is an empty payload, a null url an empty one, a null page_id stays null and never wins over
another. Every row is a capture of its own, also one that repeats another: pages are written with a row number first,
which is part of their record ids, and of equal rows one is the response. A group without any page_id has a response
like any other, and its revisits refer to a page without id. Other columns are ignored. White space and control
characters of an url are percent-encoded in headers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import slices, small, written

LEAST_REVISIT = 1000
FILE_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def cleaned(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    for code in (*range(0x21), 0x7F):
        if code in (0x09, 0x0A, 0x0D, 0x20, 0x7F, 0):
            url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    payload = F.coalesce("html", F.lit(""))
    return pages.select("page_id", url.alias("url"), payload.alias("payload")).withColumns({
        "sha1": F.sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long")})


def numbered(pages: DataFrame) -> DataFrame:
    """``cleaned`` pages written with a ``row`` number, unique and the same wherever they are read."""
    return written(cleaned(pages).withColumn("row", F.monotonically_increasing_id()), "pages")


def record_id(row: Column, url: Column, sha1: Column, kind: str) -> Column:
    """A name-based urn of a row's record."""
    h = F.md5(F.concat_ws("|", row.cast("string"), sha1, F.lit(kind), url).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def revisits(rows: DataFrame) -> DataFrame:
    """The ``row`` of rows that revisit, with the record id and url of their response."""
    least = F.col("payload_bytes") >= LEAST_REVISIT
    slim = written(rows.filter(least).select("row", "page_id", "url", "sha1", F.sha2(F.col("payload").cast("binary"), 256).alias("digest")),
                   "payload-digests")
    groups = slim.groupBy("digest").agg(F.max(F.struct("page_id", "row", "url", "sha1")).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    others = slim.join(groups, "digest").filter(F.col("row") != F.col("kept.row"))
    target = record_id(F.col("kept.row"), F.col("kept.url"), F.col("kept.sha1"), "response")
    return others.select("row", target.alias("refers_to"), F.col("kept.url").alias("refers_url"))


def headed(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record: its headers, an empty line, its block; null headers are left out."""
    lines = [F.lit("WARC/1.1")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def records(rows: DataFrame, doubles: DataFrame) -> DataFrame:
    """One column ``record``: three records of each of ``cleaned`` rows."""
    width = F.octet_length("refers_to") + F.octet_length("refers_url") + 48
    size = doubles.agg(F.coalesce(F.sum(width), F.lit(0)).alias("n")).first()["n"]
    joined = rows.join(small(doubles, size, 1), "row", "left")
    row, page, url, sha1 = (F.col(c) for c in ("row", "page_id", "url", "sha1"))
    again = F.col("refers_to").isNotNull()
    own = record_id(row, url, sha1, "response")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    host = F.coalesce(F.regexp_extract(url, r"^\w+://([^/?#]*)", 1), F.lit(""))
    path = F.regexp_extract(url, r"^\w+://[^/?#]*([^#]*)", 1)
    request = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)),
                       F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    fields = F.concat_ws("", F.concat(F.lit("page-id: "), page.cast("string"), F.lit(CRLF)), F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF)))
    shared = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url)]
    capture = headed([
        ("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", own), *shared,
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        ("WARC-Profile", F.when(again, F.lit(PROFILE))), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Refers-To-Target-URI", F.col("refers_url")), ("Content-Type", F.lit("application/http;msgtype=response")),
    ], F.when(again, head).otherwise(F.concat(head, F.col("payload"))))
    asked = headed([
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id(row, url, sha1, "request")), *shared,
        ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))], request)
    about = headed([
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id(row, url, sha1, "metadata")), *shared,
        ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], fields)
    return joined.select(F.explode(F.array(asked, capture, about)).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Gzipped WARC files of all pages under ``path``."""
    rows = numbered(pages)
    doubles = written(revisits(rows), "revisits")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("bytes")).first()
    each = max(1, FILE_BYTES * size["n"] // max(1, size["bytes"] + 1000 * size["n"]))
    records(rows, doubles).write.option("lineSep", CRLF * 2).option("compression", "gzip").option(
        "maxRecordsPerFile", 3 * each).text(path)


FIELDS = ("record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "content_type string, stated_digest string, page_id long, block binary, payload binary, payload_digest string, payload_bytes long")


def parsed(data: bytes) -> Iterator[tuple]:
    """The records of an archive, cut by their stated lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        named = {k.strip().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines[1:])}
        length = int(named[b"content-length"])
        block, at = data[end + 4:end + 4 + length], end + 4 + length + 4
        kind, page_id, payload = named[b"warc-type"], None, None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
        elif kind == "metadata":
            fields = dict(line.split(b": ", 1) for line in block.split(b"\r\n") if b": " in line)
            page_id = int(fields[b"page-id"]) if b"page-id" in fields else None
        yield (
            named[b"warc-record-id"], kind, named.get(b"warc-concurrent-to"), named.get(b"warc-refers-to"),
            named.get(b"warc-target-uri"), named.get(b"warc-date"), named.get(b"content-type"), named.get(b"warc-payload-digest"),
            page_id, block, payload, None if payload is None else hashlib.sha1(payload).hexdigest(),
            None if payload is None else len(payload))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, with the SHA-1 and size of each payload as read."""
    names = [field.split()[0] for field in FIELDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[field.split()[1]]) for name, field in zip(names, FIELDS.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, FILE_BYTES):
                for content in one.column("content"):
                    raw, data = content.as_py(), b""
                    while raw:  # gzip members follow one another
                        member = zlib.decompressobj(31)
                        data += member.decompress(raw)
                        raw = member.unused_data
                    rows = list(parsed(data))
                    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, FIELDS)


def assembled(found: DataFrame, *fields: str) -> DataFrame:
    """One row for each capture: its record as ``capture``, and the nested ``request`` and ``metadata`` concurrent to it.

    ``fields`` are those of each nested record, all by default. Of several requests or metadata records of one capture
    that with the smallest id is taken; without one the field is null."""
    fields = fields or tuple(found.columns)
    nested = F.struct(*dict.fromkeys(("record_id", *fields)))
    captures = found.filter(F.col("record_type").isin("response", "revisit")).select("record_id", nested.alias("capture"))
    captures = captures.groupBy("record_id").agg(F.min("capture").alias("capture"))
    for kind in ("request", "metadata"):
        side = found.filter((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        side = side.select(F.col("concurrent_to").alias("record_id"), nested.alias(kind)).groupBy("record_id").agg(F.min(kind).alias(kind))
        captures = captures.join(side, "record_id", "left")
    return captures


def digests(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take payload facts from their response."""
    own = captures.select(
        "record_id", F.col("metadata.page_id").alias("page_id"), "capture.payload_bytes", "capture.payload_digest",
        "capture.record_type", F.col("capture.refers_to").alias("to"))
    own = written(own, "captures")
    there = own.filter("record_type = 'response'").select(
        F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"),
        F.col("payload_digest").alias("d"))
    joined = own.filter("record_type = 'revisit'").join(there, "to")
    again = joined.select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
    first = own.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again)
