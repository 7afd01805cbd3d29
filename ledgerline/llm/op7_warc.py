"""WARC archives: writing with segmentation and chunked transfer framing, reading with segment reassembly.

Payloads are framed as a chunked HTTP response. A block longer than SEGMENT bytes is cut into a first record and
continuation records, which name the first as their origin, carry a segment number and, in the last, the total length.
The reader parses whole archive files, groups the segments by origin, orders them by number, verifies numbers and total
length, decodes the framing and resolves revisits through the response that they refer to. Spark writes and reads the
files, so they can be in any store that Spark reaches.

Defined cases: a null html counts as empty; a null page id is kept as a null id and never referred to, but revisits an equal
payload that has an id; rows with the same page id and payload are each a response if the id is the largest; very long
payloads are cut into segments, and joined in one task; an empty table gives an empty archive; a record that is broken,
incomplete or has numbers that are none gives a null payload, never a wrong one, and what a truncated archive lacks is
left out; further columns, whatever their names, are not archived.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, slices, written

SEGMENT = 65_536
CHUNK = 8_192
LEAST = 1_000
RECORDS_A_FILE = 8_000
LONGEST_LINE = 2**20
_NUMBER = re.compile(r"-?[0-9]{1,18}")

RECORD = "page_id long, url string, type string, record_id string, origin_id string, segment int, total long, digest string, refers_to long, block binary"
PAGE = "page_id long, url string, type string, digest string, refers_to long, payload binary"


_SIZE = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;.*)?$", re.S)


def chunked(payload: bytes) -> bytes:
    """An HTTP response with the payload in chunked transfer framing."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), CHUNK) if (c := payload[i : i + CHUNK])]
    return b"".join([head, *parts, b"0\r\n\r\n"])


def unframed(block: bytes) -> bytes | None:
    """The payload of an HTTP response, plain or chunked; None if it is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") != b"chunked":
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = _SIZE.match(body, at, end) if end >= 0 else None
        if not size:
            return None
        n = int(size[1], 16)
        if n and body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    """Without the two line ends that close a record."""
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + b"\r\n\r\n" + block


def page_records(number: int, page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None) -> Iterator[bytes]:
    url = None if url is None else "".join(url.split())
    own = f"<urn:page:{number}>"
    fields = {"WARC-Record-ID": own, "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": page_id}
    if refers_to is not None:
        yield record("revisit", fields | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": refers_to}, b"")
        return
    block = chunked((html or "").encode("utf-8", "replace"))
    if len(block) <= SEGMENT:
        yield record("response", fields, block)
        return
    cuts = range(0, len(block), SEGMENT)
    for k, at in enumerate(cuts, 1):
        part = block[at : at + SEGMENT]
        if k == 1:
            yield record("response", fields | {"WARC-Segment-Number": 1}, part)
        else:
            total = len(block) if k == len(cuts) else None
            yield record("continuation", {"WARC-Record-ID": f"<urn:page:{number}:{k}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": total}, part)


def write(pages: DataFrame, path: str) -> None:
    """A folder of .gz archives; of equal payloads of LEAST bytes or more, the one with the largest id is stored."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"digest": F.sha1("html"), "n": F.octet_length("html"), "number": F.monotonically_increasing_id()})
    copies = rows.filter(F.col("n") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    # small payloads are never revisits; each has a key of its own, so that many alike, such as empty ones, don't meet in one task
    key = F.when(F.col("n") >= LEAST, F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("number").cast("string")))
    marked = rows.withColumn("key", key).join(copies.withColumnRenamed("digest", "key"), "key", "left").select("number", "page_id", "url", F.when(F.coalesce(F.col("first") == F.col("page_id"), F.col("first").isNull()), F.col("html")).alias("html"), "digest", F.when(~F.coalesce(F.col("first") == F.col("page_id"), F.lit(False)), F.col("first")).alias("refers_to"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [r for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in page_records(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # the text writer puts the line separator, here the close of a record, after each row
    marked.mapInArrow(make, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def parse(archive: BinaryIO) -> Iterator[tuple]:
    """The records of one archive, as rows of RECORD, one after the other; what isn't a record is passed over, and a record that
    the file doesn't hold whole, or whose numbers aren't numbers, has no block."""
    try:
        while line := archive.readline(LONGEST_LINE):
            if line.startswith(b"WARC/1."):
                yield _record(archive)
    except (EOFError, OSError, zlib.error):
        return


def _record(archive: BinaryIO) -> tuple:
    f: dict[str, str] = {}
    whole = True
    try:
        while (line := archive.readline(LONGEST_LINE).rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            f[k.strip().lower()] = v.strip()
    except (EOFError, OSError, zlib.error):
        whole = False
    bad = [k for k in ("content-length", "x-page-id", "warc-segment-number", "warc-segment-total-length", "x-refers-to-page-id") if k in f and not _NUMBER.fullmatch(f[k])]
    number = lambda k: int(f[k]) if k in f and k not in bad else None
    n, block = number("content-length"), None
    if whole and n is not None:
        try:
            block = archive.read(n)
        except (EOFError, OSError, zlib.error):
            block = None
    sound = block is not None and len(block) == n and not bad
    return (number("x-page-id"), f.get("warc-target-uri"), f.get("warc-type"), f.get("warc-record-id"), f.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), f.get("warc-payload-digest", "").removeprefix("sha1:"), number("x-refers-to-page-id"), block if sound else None)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 * 2**20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1] or b"") + 200
        if size > most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in ddl.split(", ")])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    schema = _arrow(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for content in b.column(0) for r in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))))
        yield from _batches(rows, schema)

    return spark.read.format("binaryFile").load(path).filter("length > 0").select("content").mapInArrow(run, RECORD)


def joined(segments: list[tuple[int, int | None, bytes | None]]) -> bytes | None:
    """The block of ordered (number, total length, bytes); None if a segment lacks, repeats or the length differs."""
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)) or any(s[2] is None for s in segments):
        return None
    block = b"".join(s[2] for s in segments)
    return block if segments[-1][1] == len(block) else None


def reassemble(records: DataFrame) -> DataFrame:
    """One row for each page, of records that are whole or in segments; see PAGE."""
    schema = _arrow(PAGE)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in slices(batches):
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield (r[0], r[1], r[2], r[7], r[8], unframed(r[9]) if r[9] and r[2] == "response" else None)

        yield from _batches(rows(), schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list[tuple]) -> tuple:
            block = joined([(r[5], r[6], r[9]) for r in group])
            head = group[0]
            return (head[0], head[1], "response", head[7], head[8], None if block is None else unframed(block))

        def rows() -> Iterator[tuple]:
            held: list[tuple] = []
            for b in slices(batches):
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and (held[0][4] or held[0][3]) != (r[4] or r[3]):
                        yield done(held)
                        held = []
                    held.append(r)
            if held:
                yield done(held)

        yield from _batches(rows(), schema)

    segmented = records.filter(F.col("segment").isNotNull())
    origin = F.coalesce("origin_id", "record_id")
    ordered = segmented.repartition(origin).sortWithinPartitions(origin, "segment")
    return records.filter(F.col("segment").isNull()).mapInArrow(whole, PAGE).unionByName(ordered.mapInArrow(parts, PAGE))


def resolve(pages: DataFrame) -> DataFrame:
    """pages: as reassembled, with payload_bytes and payload_digest. A revisit takes those of its response."""
    found = pages.select("page_id", "url", F.col("type").alias("record_type"), "refers_to", "payload_bytes", "payload_digest", "digest")
    stored = found.filter("record_type = 'response'")
    known = stored.filter(F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = found.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(known, ["refers_to", "digest"], "left").withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("digest")))
    return stored.unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def query(pages: DataFrame) -> DataFrame:
    folder = shared_folder(pages.sparkSession, "warc")
    write(pages, folder)
    return resolve(written(reassemble(read_records(pages.sparkSession, folder)).select("page_id", "url", "type", "digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))))


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as top from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id is distinct from top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id is distinct from top then top end as refers_to
from m
"""
