"""WARC archives: written, read back, and assembled to one nested row for each capture.

Writing: a capture is three records, request, response and metadata; request and metadata name the
response in WARC-Concurrent-To. Of captures with equal payloads of at least `least_bytes` bytes, the one with
the smallest id is the response, the others revisit it: their record holds the HTTP head only and
names the response in WARC-Refers-To. Equal payloads are found by SHA-1 and length; the smallest id is an
aggregate joined back, so a payload that a third of the captures share is never one group. Archives are
gzip files of Spark's text writer with the records' closing line ends as separator, at most
`RECORDS` records each; that sets the size of files and bounds nothing else.

Reading: a gzip archive comes through Spark's text reader, cut at the same line ends, and its records are parsed as
a stream of such rows; so no archive is held whole, and memory goes with the longest record. An uncompressed archive,
which that reader would split, is one row of the binary reader. Transactions are assembled by joining records on the response's identifier: their own for responses and revisits, the
concurrent-to identifier for others, where one that names a request leads on to what the request names.

Nulls and oddities: a null page is an empty payload. A null URL has no WARC-Target-URI; control
characters in a URL are percent-encoded. A null id counts as the largest, and reads back null. Rows that
repeat an id are captures of their own: record identifiers hold the row's number in the input. Requests and metadata
whose response is missing make a row without one. Extra columns are ignored. An empty table makes no archive rows. A
very long page is a record like others, whole. An archive that ends within a record is an error.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.batches import pieces

RECORDS = 15_000
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = uuid.UUID("6f1d3c52-8a0b-5d56-9a77-2f1f2f7d9b10")
_CONTROL = re.compile(rb"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    """Base32 of the SHA-1, upper case, as archives write it after `sha1:`."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(kind: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAME, f'{kind} {row}')}>"


def record(kind: str, id: str, date: str, block: bytes, content_type: str, url: bytes | None, **fields: str | None) -> bytes:
    """One record without its closing line ends; a field's name has underscores for hyphens."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + id.encode(), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _CONTROL.sub(lambda m: b"%%%02X" % m[0][0], url))
    head += [f"WARC-{k.replace('_', '-')}: {v}".encode() for k, v in fields.items() if v is not None]
    head += [b"Content-Type: " + content_type.encode(), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block


def _records(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                out = []
                for page, row, url, html, first in zip(*(part.column(k).to_pylist() for k in ("id", "row", "url", "html", "first")), strict=True):
                    own, digest = _id("response", row), "sha1:" + payload_digest(html)
                    host = re.match(rb"[^:]*://([^/?#]*)", url or b"")
                    get = b"GET " + _CONTROL.sub(b"%20", url or b"/") + b" HTTP/1.1\r\nHost: " + _CONTROL.sub(b"", host[1] if host else b"") + b"\r\n\r\n"
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
                    out.append(record("request", _id("request", row), date, get, "application/http;msgtype=request", url, Concurrent_To=own))
                    if first == row:
                        out.append(record("response", own, date, http + html, "application/http;msgtype=response", url, Payload_Digest=digest))
                    else:
                        out.append(record("revisit", own, date, http, "application/http;msgtype=response", url, Payload_Digest=digest, Profile=REVISIT, Refers_To=_id("response", first)))
                    about = ("" if page is None else f"page: {page}\r\n") + f"payload-length: {len(html)}\r\n"
                    out.append(record("metadata", _id("metadata", row), date, about.encode(), "application/warc-fields", url, Concurrent_To=own))
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the captures of `pages`, a stored table, to gzip archives under `path`."""
    rows = pages.select(F.col(id).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(url).cast("binary").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html"))
    order = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "row")
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min(order).alias("least"))
    rows = rows.join(first, ["digest", "bytes"], "left").select("id", "row", "url", "html", F.coalesce("least.row", "row").alias("first"))
    text = rows.mapInArrow(_records(date), "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def parse(stream: Rows | io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an uncompressed archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        name = ""
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and name:  # a folded field goes on
                fields[name] = f"{fields[name]} {line.strip().decode('utf-8', 'replace')}".strip()
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            fields.setdefault(name, value.strip())
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("an archive ends within a record")
        yield fields, block


_RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
_RECORD_SQL = "record_id string, type string, url string, date string, concurrent_to string, refers_to string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


class Rows:
    """An archive as a stream, from its parts between separators: these are put back, but for one after the last part."""

    def __init__(self, rows: Iterator[bytes]) -> None:
        self.rows, self.held, self.at = rows, b"", 0
        self.coming = next(rows, None)

    def _more(self) -> bool:
        if self.coming is None:
            return False
        row, self.coming = self.coming, next(self.rows, None)
        self.held, self.at = self.held[self.at :] + row + (b"" if self.coming is None else END.encode()), 0
        return True

    def readline(self) -> bytes:
        while not (end := self.held.find(b"\n", self.at) + 1) and self._more():
            pass
        end = end or len(self.held)
        line, self.at = self.held[self.at : end], end
        return line

    def read(self, size: int) -> bytes:
        parts, left = [], size
        while left and (self.at < len(self.held) or self._more()):
            parts.append(self.held[self.at : self.at + left])
            self.at += len(parts[-1])
            left -= len(parts[-1])
        return b"".join(parts)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows | io.BufferedIOBase]:
    for batch in batches:
        for content in batch.column("content"):
            yield io.BytesIO(content.as_py())


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows | io.BufferedIOBase]:
    parts = (part for batch in batches for part in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), strict=True))
    for _, rows in groupby(parts, itemgetter(0)):
        yield Rows(part for _, part in rows)


def _read(archives, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in archives(batches):
            rows, held = [], 0
            for fields, block in parse(stream):
                kind, payload, about = fields.get("warc-type", ""), block, None
                size, digest = None, None
                if fields.get("content-type", "").startswith("application/http"):
                    payload = block[block.index(END.encode()) + 4 :] if END.encode() in block else b""
                elif fields.get("content-type", "") == "application/warc-fields":
                    about = [tuple(x.strip() for x in line.partition(":")[::2]) for line in block.decode("utf-8", "replace").splitlines() if ":" in line]
                if kind == "revisit":
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                else:
                    size, digest = len(payload), payload_digest(payload)
                if kind == "response" and (said := fields.get("warc-payload-digest", "")).startswith("sha1:") and said != f"sha1:{digest}":
                    raise ValueError(f"the payload of {fields.get('warc-record-id')} doesn't have its digest")
                rows.append((fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), size, digest, about, payload if with_payload else None))
                held += len(payload) if with_payload else 64
                if held > 4 << 20 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives (*.gz, *.warc) under `path`."""
    # Files of one task come one after another, each in order; a hash of its path tells where the next begins.
    parts = spark.read.format("text").option("lineSep", END).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    parts = parts.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("part"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").option("recursiveFileLookup", "true").load(path).select("content")
    return parts.mapInArrow(_read(_streamed, with_payload), _RECORD_SQL).unionByName(plain.mapInArrow(_read(_whole, with_payload), _RECORD_SQL))


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: capture_id, response, request (structs) and metadata (an array of structs)."""
    asks = records.where("type = 'request' and concurrent_to is not null").groupBy(F.col("record_id").alias("concurrent_to")).agg(F.min("concurrent_to").alias("onward"))
    main = F.col("type").isin("response", "revisit", "resource")
    # Records that name none are spread by their own identifier, which names no request.
    rows = records.withColumn("named", F.coalesce("concurrent_to", "record_id")).join(asks.withColumnRenamed("concurrent_to", "named"), "named", "left")
    rows = rows.withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.coalesce("onward", "named")))
    whole = F.struct("record_id", "type", "url", "date", "refers_to", "payload_bytes", "payload_digest", "fields", "payload")
    return rows.groupBy("capture_id").agg(
        F.first(F.when(main, whole), ignorenulls=True).alias("response"),
        F.first(F.when(F.col("type") == "request", whole), ignorenulls=True).alias("request"),
        F.collect_list(F.when(F.col("type") == "metadata", whole)).alias("metadata"),
    )


def captured_pages(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of each capture with a response."""
    about = lambda name: F.try_element_at(F.get("metadata", F.lit(0))["fields"], F.lit(name)).cast("long")
    flat = captures.where("response is not null").select("capture_id", about("page").alias("page_id"), F.coalesce("response.payload_bytes", about("payload-length")).alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"), F.col("response.url").alias("url"))
    named = flat.where("record_type = 'response'").select(F.col("capture_id").alias("named"), F.col("page_id").alias("of"))
    # Captures that refer to none are spread by their own identifier.
    out = flat.withColumn("named", F.coalesce("target", "capture_id")).join(named, "named", "left")
    return out.withColumn("refers_to", F.when(F.col("target").isNotNull(), F.col("of"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
