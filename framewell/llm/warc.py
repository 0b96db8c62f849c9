"""WARC archives: write, read back, and resolve revisits by payload digest.

Headers (page, payload size, digest) are stored, and only they are shuffled by digest: of equal payloads of at least
``revisit_bytes`` the one with the smallest page id is the original, and the others become revisit records that refer to it.
A map-side minimum per digest goes before that shuffle, so a digest that a third of all pages share costs a row per task.
The originals that have revisits go to the pages in place: they are broadcast if they are few, and only beyond that bound
do payloads move. Payloads are then written with fresh headers where they were read, each page once.

A record is a gzip member of its own, so a reader can seek to it; the line ends behind it are a member too. Archives are
text output whose line separator is that second member, so any file system that Spark writes to will do. They are read
as whole files, so their size before compression is kept near ``archive_mb``; archives of one member, and plain ones, are
read too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm.shared import BATCH_ROWS, small_batches, small_join, stash

READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: The first bytes of a gzipped file.
GZIP = b"\x1f\x8b"


@dataclass(frozen=True)
class Warc:
    """``date`` stands in every fresh header. Records of more than ``archive_mb`` make larger files."""

    revisit_bytes: int = 100
    archive_mb: int = 16
    date: str = "2020-01-01T00:00:00Z"


def payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def headers(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest`` of pages (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"), F.sha2(payload(), 256).alias("payload_digest"))


def originals(found: DataFrame, conf: Warc) -> DataFrame:
    """Of headers, the digests that more than one record has, and the page whose response the others refer to: payload_digest, original."""
    long = found.filter(F.col("payload_bytes") >= conf.revisit_bytes)
    grouped = long.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    return grouped.filter("n > 1 AND original IS NOT NULL").drop("n")


def member(raw: bytes) -> bytes:
    """A gzip member; the same bytes give the same member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


#: Bytes that are unpacked at once; what lies behind a member's end is copied, so they are few.
PIECE = 1 << 14


def unpacked(raw: memoryview) -> memoryview:
    """The content of all members of a gzipped archive."""
    out, at, unpack, open_ = [], 0, zlib.decompressobj(31), False
    while at < len(raw):
        piece = raw[at : at + PIECE]
        out.append(unpack.decompress(piece))
        at += len(piece)
        open_ = not unpack.eof
        if unpack.eof:
            at -= len(unpack.unused_data)
            unpack = zlib.decompressobj(31)
    if open_:
        raise ValueError("the archive ends within a member")
    return memoryview(b"".join(out))


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"value": pa.array([member(x.as_buffer()) for x in batch.column(0)], pa.binary())})


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_archives(pages: DataFrame, path: str, conf: Warc = Warc()) -> None:
    """Write a deduplicated archive of ``pages`` (page_id, url, html) to ``path``: a record per row, revisits without payload.

    A null html is an empty payload, a null or blank url is written as ``unknown:``, line breaks in it are dropped, and a
    null page_id gives a record without page id, which never is an original. Payloads under ``revisit_bytes`` are always
    responses, as are repeated rows of the page that is the original.
    """
    found = stash(headers(pages))
    first = stash(originals(found, conf))
    size, n = found.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count("*")).first()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.nullif(F.regexp_replace("url", r"[\x00-\x20]+", ""), F.lit("")), F.lit("unknown:")).alias("url"), F.coalesce("html", F.lit("")).alias("body"))
    rows = small_join(rows.withColumn("payload_digest", F.sha2(F.encode("body", "UTF-8"), 256)), first, ["payload_digest"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    rows = rows.withColumn("refers_to", F.when(revisit, F.col("original")))
    each = max(1, (conf.archive_mb << 20) // max(1, size // max(1, n) + 500))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    is_revisit = F.col("refers_to").isNotNull()
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("body"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _uuid(F.lit("record"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "payload_digest")),
        line("WARC-Date", F.lit(conf.date)),
        line("WARC-Target-URI", F.col("url")),
        F.when(F.col("page_id").isNotNull(), line("WARC-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.octet_length("body").cast("string")),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _uuid(F.lit("record"), F.col("refers_to").cast("string"), "payload_digest")), line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    with small_batches(pages.sparkSession, BATCH_ROWS):
        packed = rows.select(F.encode(record, "UTF-8").alias("value")).mapInArrow(_members, "value binary")
        between = member(b"\r\n\r\n").decode("latin-1")
        packed.select(F.col("value").cast("string")).write.options(maxRecordsPerFile=each, encoding="ISO-8859-1").text(path, lineSep=between)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: see :data:`READ`. Sizes and digests of responses are taken from the
    payload itself and must agree with the header; those of revisits are what the header says of the payload that they
    stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            for raw in batch.column(0):
                data = memoryview(raw.as_buffer())
                if bytes(data[:2]) == GZIP:
                    data = unpacked(data)
                rows: list[tuple] = []
                at = held = 0
                while at < len(data):
                    row, size, at = _record(data, at)
                    rows.append(row)
                    held += size
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, READ)


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def _record(data: memoryview, at: int) -> tuple[tuple, int, int]:
    """The record at ``at``, its payload's size, and where the next begins."""
    head, end = bytes(data[at : at + 4096]), -1
    while (end := head.find(b"\r\n\r\n")) < 0:
        if len(head) >= len(data) - at:
            raise ValueError(f"no end of a record's header at byte {at}")
        head = bytes(data[at : at + 2 * len(head)])
    version, *lines = head[:end].decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at byte {at}")
    fields = dict(x.split(": ", 1) for x in lines)
    start, size = at + end + 4, int(fields["Content-Length"])
    body = bytes(data[start : start + size])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if bytes(data[start + size : start + size + 4]) != b"\r\n\r\n" or kind == "response" and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"a damaged record at byte {at}")
    page, original = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
    length = size if kind == "response" else int(fields["WARC-Payload-Length"])
    return (page and int(page), fields["WARC-Target-URI"], kind, length, digest, original and int(original), body if kind == "response" else None), size, start + size + 4
