"""WARC: write captures as archives, read them back, assemble transactions.

Every page becomes a transaction of three records: ``request``, ``response`` (or
``revisit``) and ``metadata``. Request and metadata name the response record in
``WARC-Concurrent-To``. Payloads that occur again are stored once: the capture with the
largest page_id keeps the payload, the others are ``revisit`` records that refer to it.

Records are made by Spark expressions and written by Spark's text writer (its line
separator is the blank lines that end a WARC record), so commits survive lost executors
and any Hadoop file system works. Reading uses the ``binaryFile`` source; a file holds at most one
write partition, so its size is bounded by the partition size. It is decompressed and parsed as a stream, record by record, and rows leave in
batches of bounded size.

Broken archives: a record that ends early, a header block without an end, and bytes between records that begin no record give rows with
``problem`` set and no payload, length or digest, and what follows is read on from the next line that begins a record; such rows are no part of
transactions. Header lines may lack the blank after the colon and may be continued on the next line; names are compared in lower case;
a record without a valid length, or with one over 2^31 - 1 bytes (the most that a value holds), is a problem too.

Defined cases: null html is an empty payload; null url leaves out the target URI; null
page_id is kept as null (such a page is a revisit if another page with a number has its
payload); rows that agree in page_id, url and html are one capture written several times
and come back as often; pages of any length are stored whole; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, named, settle

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
CRLF = "\r\n"
RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "capture_date string, payload_bytes long, payload_digest string, header_digest string, "
    "fields string, payload binary, problem string"
)
CHUNK = 1 << 16
MOST_BYTES = (1 << 31) - 1  # of a block: the most that one value of a column holds
BATCH_BYTES = 16 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary or string column."""
    digest = F.sha1(data)
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _urn(kind: str, *parts: str) -> Column:
    h = F.md5(F.to_json(F.struct(F.lit(kind).alias("k"), *(F.col(p).alias(f"p{i}") for i, p in enumerate(parts)))))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two line ends that close it; null headers are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines, length), F.lit(CRLF * 2), block)


def plan_captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Columns page_id, url, html, digest, capture (record id) and, for revisits, the
    record id ``original``. Payloads under ``least_bytes`` are never deduplicated."""
    base = pages.select(
        named("page_id").alias("page_id"),
        F.regexp_replace(F.regexp_replace(named("url"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(named("html"), F.lit("")).alias("html"),
    ).withColumn("digest", base32_sha1(F.encode("html", "utf-8")))
    small = base.filter(F.octet_length("html") >= least_bytes).select("page_id", "url", "digest")
    repeated = settle(
        small.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("page_id", "url")).alias("last"))
        .filter("copies > 1")
        .select("digest", F.col("last.page_id").alias("last_id"), _urn("response", "last.page_id", "last.url", "digest").alias("original"))
    )
    # Both sides of this join are plain shuffles, so AQE can split a digest that many pages share.
    joined = base.join(repeated, "digest", "left").withColumn("capture", _urn("response", "page_id", "url", "digest"))
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id")) & (F.octet_length("html") >= least_bytes)
    return joined.select("page_id", "url", "html", "digest", "capture", F.when(again, F.col("original")).alias("original"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write gzip-compressed WARC files below ``path``; the three records of a capture stand together."""
    c = plan_captures(pages, least_bytes)
    when = ("WARC-Date", F.lit(date))
    uri = ("WARC-Target-URI", F.col("url"))
    is_revisit = F.col("original").isNotNull()
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("html").cast("string"),
        F.lit(CRLF * 2),
    )
    response = _record(
        [
            ("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", F.col("capture")),
            when,
            uri,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.col("original")),
            ("WARC-Profile", F.when(is_revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(head, F.when(is_revisit, F.lit("")).otherwise(F.col("html"))),
    )
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", _urn("request", "capture")),
            ("WARC-Concurrent-To", F.col("capture")),
            when,
            uri,
            ("Content-Type", F.lit("application/http;msgtype=request")),
        ],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}")),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", _urn("metadata", "capture")),
            ("WARC-Concurrent-To", F.col("capture")),
            when,
            uri,
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)),
    )
    c.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option("lineSep", CRLF * 2).option(
        "maxRecordsPerFile", 30_000
    ).text(path, compression="gzip")


class Stream:
    """Bytes of a file object with a look ahead. What a damaged compressed file lacks is the end of the stream."""

    def __init__(self, file):
        self.file, self.held, self.ended, self.damaged = file, bytearray(), False, False

    def _more(self, size: int) -> bool:
        if not self.ended:
            try:
                got = self.file.read1(size)  # what stands before the damage still comes
            except (EOFError, OSError, zlib.error):
                got, self.damaged = b"", True
            self.ended = not got
            self.held += got
        return not self.ended

    def line(self) -> bytes:
        """The next line with its end; b"" at the end of the stream."""
        seen = 0
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more(CHUNK):
                end = len(self.held) - 1
                break
        out = bytes(self.held[: end + 1])
        del self.held[: end + 1]
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) < size and self._more(CHUNK):  # whatever size the header names, only what is there is held
            pass
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def parse_archive(file) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers with lower-case names, block, problem) of each record of an archive (bytes or a file object)."""
    stream = Stream(io.BytesIO(file) if isinstance(file, (bytes, bytearray)) else file)
    line, lost = stream.line(), False
    while line:
        if not line.startswith(b"WARC/"):
            if line.strip() and not lost:
                lost = True
                yield {}, b"", "bytes outside of records"
            line = stream.line()
            continue
        lost = False
        headers: dict[str, str] = {}
        name, whole = None, False
        while line := stream.line():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if not text:
                whole = True
                break
            if text[0] in " \t" and name:
                headers[name] = f"{headers[name]} {text.strip()}"
            elif ":" in text:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                headers[name] = value.strip()
        length = headers.get("content-length", "")
        digits = length.lstrip("0") if length.isascii() and length.isdigit() else None
        if not whole or digits is None or len(digits) > 10 or int(digits or 0) > MOST_BYTES:
            yield headers, b"", "header block without an end" if not whole else "no length" if digits is None else "length over 2 GB"
            line = stream.line()
            continue
        size = int(digits or 0)
        block = stream.take(size)
        yield headers, block, None if len(block) == size else "ends early"
        line = stream.line()
    if stream.damaged:
        yield {}, b"", "compressed data is damaged"


def _row(h: dict[str, str], block: bytes, problem: str | None, payloads: bool) -> tuple:
    kind = h.get("warc-type")
    body = block.partition(b"\r\n\r\n")[2] if kind == "response" and not problem else None
    fields = None
    if kind == "metadata" and not problem:
        lines = block.decode("utf-8", "replace").splitlines()
        fields = json.dumps({k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)})
    return (
        h.get("warc-record-id"),
        kind,
        h.get("warc-concurrent-to"),
        h.get("warc-refers-to"),
        h.get("warc-target-uri"),
        h.get("warc-date"),
        None if body is None else len(body),
        None if body is None else base64.b32encode(hashlib.sha1(body).digest()).decode(),
        h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        fields,
        body if payloads else None,
        problem or (None if h.get("warc-record-id") and kind else "no record id or type"),
    )


def read_records(spark, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``path`` (*.gz, *.warc). Length and digest of a response are computed from the bytes
    read; ``payloads=False`` leaves the payload column null."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        rows, held = [], 0
        for batch in batches:
            for content in batch.column("content"):
                file = io.BytesIO(content.as_buffer())
                packed = file.read(2) == b"\x1f\x8b"
                file.seek(0)
                for record in parse_archive(gzip.GzipFile(fileobj=file) if packed else file):
                    rows.append(_row(*record, payloads))
                    held += 512 + len(record[1]) * payloads
                    if held > BATCH_BYTES:
                        yield pack(rows)
                        rows, held = [], 0
        if rows:
            yield pack(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,warc}").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response or revisit joined with its request and its metadata
    through their concurrent-to identifiers. A capture written n times gives n rows; records with a problem are left out."""
    records = records.filter("problem is null")
    main = records.filter("record_type in ('response', 'revisit')")
    main = main.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("times"),
        F.first(F.struct("record_type", "refers_to", "target_uri", "capture_date", "payload_bytes", "payload_digest", "header_digest", "payload")).alias("response"),
    )

    def beside(kind: str) -> DataFrame:
        own = records.filter(F.col("record_type") == kind)
        return own.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.first(F.struct(F.col("record_id").alias("id"), "target_uri", "fields")).alias(kind))

    joined = main.join(beside("request"), "record_id", "left").join(beside("metadata"), "record_id", "left")
    return joined.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times", "time")


def resolve(captures: DataFrame) -> DataFrame:
    """Add, for each capture, page_id, payload length and digest (of the original for revisits)
    and the original's page_id."""
    page = F.expr("try_cast(get_json_object(metadata.fields, '$.page-id') as bigint)")
    rows = captures.select("*", page.alias("page_id"), F.col("response.refers_to").alias("original"))
    originals = (
        rows.filter("response.record_type = 'response'")
        .groupBy(F.col("record_id").alias("original"))
        .agg(F.first("page_id").alias("original_page"), F.first("response.payload_bytes").alias("original_bytes"), F.first("response.payload_digest").alias("original_digest"))
    )
    # Only revisits look for an original; the others would all meet at the null key.
    revisits = rows.filter("original is not null").join(originals, "original", "left")
    return revisits.unionByName(rows.filter("original is null"), allowMissingColumns=True)


def roundtrip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, read back, assemble: the digest columns of every page."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    records = settle(read_records(spark, path, payloads=False))
    return resolve(settle(assemble(records))).select(
        "page_id",
        F.coalesce("response.payload_bytes", "original_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "original_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.record_type") == "revisit", F.col("original_page")).alias("refers_to"),
    )
