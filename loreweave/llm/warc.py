"""WARC archives: written by Spark's text writer, read back with boundary-chain verification.

Writing. A page is a response record, or, if an equal payload of at least ``LEAST`` bytes has a smaller page_id, a
revisit record without payload that refers to it. The record separator of the format is the line separator of the
writer, so archives come from ordinary tasks; they are gzip files of at most ``PER_FILE`` records in the shared folder.

Reading. Payloads may hold the magic line, even whole false records, so a magic alone proves nothing. Each task
streams its archives as segments between magics and emits for every magic the offset of the successor that its
header claims; a url may end in the magic, so a header that is cut in its target line takes the next segment too.
Pointer jumping from offset 0 of each archive (reached offsets and jumps double per round) leaves
the offsets on the chain; all other candidates are dropped.

Edge cases: null html is an empty payload; payloads below ``LEAST`` bytes are all responses; a null page_id is written
as ``null`` and ranks behind all others; rows that repeat page_id and payload are equal records of the same type; null
urls give an empty target, control characters and blanks in urls become ``%20``; a broken header or an offset without
a record ends the chain there; no pages give no records. Other columns of the input are ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import column_bytes
from .common import shared_path, small, stage

LEAST = 100
PER_FILE = 1000
#: Fixed values of the format.
MAGIC, GAP = b"WARC/1.0\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def classify(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, size, digest, first): ``first`` is the response that a revisit refers to, else null."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha2("payload", 256))
    groups = p.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n"))
    shared = small(stage(groups.filter("n > 1").select("digest", "low"), "warc-shared"))
    return p.join(shared, "digest", "left").select(
        "page_id", "url", "payload", "size", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("low")), F.col("low")).alias("first")
    )


def record(page_id: Column, url: Column, payload: Column, size: Column, digest: Column, first: Column) -> Column:
    """The text of one record, without the gap that ends it."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    target = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(first.isNull(), F.concat(http, payload)).otherwise(http)
    kind = F.when(first.isNull(), F.lit("WARC-Type: response\r\n")).otherwise(
        F.concat(F.lit("WARC-Type: revisit\r\nWARC-Refers-To: "), urn(first), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))
    )
    return F.concat(
        F.lit("WARC/1.0\r\n"), kind, F.lit("WARC-Record-ID: "), urn(page_id), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), digest, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    c = classify(pages, least)
    text = c.select(record(*(F.col(x) for x in ("page_id", "url", "payload", "size", "digest", "first"))).alias("value"))
    text.write.option("lineSep", GAP.decode()).option("maxRecordsPerFile", PER_FILE).option("compression", "gzip").text(path)


#: The only value of a header that may end in the magic.
TARGET = b"WARC-Target-URI:"
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*(.*?)[ \t]*\r\n")


def fields(head: bytes) -> dict[str, str] | None:
    """Header fields by lower-case name; None if a line is not a field."""
    out, at = {}, 0
    while at < len(head):
        m = _FIELD.match(head, at)
        if not m:
            return None
        out[m[1].decode().lower()] = m[2].decode("utf-8", "replace")
        at = m.end()
    return out


class Candidate:
    """A magic and what follows; takes bytes until the claimed length is full."""

    def __init__(self, file: str, offset: int, after: bytes):
        self.file, self.offset, self.next = file, offset, -1
        self.type = self.page = self.refers = self.stated = None
        self.size, self.hash, self.left = None, hashlib.sha256(), 0
        cut = GAP not in after and after.rpartition(b"\r\n")[2].startswith(TARGET)
        self.cut = after if cut else None
        if not cut:
            self.begin(after)

    @property
    def open(self) -> bool:
        return self.left > 0 or self.cut is not None

    def begin(self, after: bytes) -> None:
        head, gap, body = after.partition(GAP)
        named = fields(head + b"\r\n") if gap else None
        length = (named or {}).get("content-length", "")
        if not length.isascii() or not length.isdigit() or "warc-type" not in named:
            return
        self.type, self.left = named["warc-type"], int(length)
        self.next = self.offset + len(MAGIC) + len(head) + len(GAP) + self.left + len(GAP)
        self.page = self.number(named.get("warc-record-id", ""))
        self.refers = self.number(named.get("warc-refers-to", ""))
        self.stated = named.get("warc-payload-digest", "").removeprefix("sha256:")
        http, gap, _ = body[: self.left].partition(GAP)
        sent = fields(http.partition(b"\r\n")[2] + b"\r\n") if gap else None
        if sent and sent.get("content-length", "").isdigit():
            self.size = int(sent["content-length"])
        self.left -= len(http) + len(gap)
        self.feed(body[len(http) + len(gap) :])

    @staticmethod
    def number(urn: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d{1,19})>", urn)
        return int(m[1]) if m else None

    def feed(self, data: bytes) -> None:
        if self.cut is not None:
            after, self.cut = self.cut + data, None
            self.begin(after)
        elif self.left > 0:
            self.hash.update(data[: self.left])
            self.left -= len(data)

    def row(self) -> dict:
        whole = self.next >= 0 and self.left <= 0
        return {
            "file": self.file, "offset": self.offset, "next": self.next if whole else -1, "record_type": self.type, "page_id": self.page,
            "refers_to": self.refers, "payload_bytes": self.size, "stated": self.stated, "digest": self.hash.hexdigest(),
        }


ROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("next", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()),
    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("stated", pa.string()), ("digest", pa.string()),
])


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ROW for every magic. Segments arrive in file order; an archive lies in one task, as gzip cannot be split."""
    file, offset, open_, done = None, 0, [], []
    for b in batches:
        data, bounds = column_bytes(b.column("value"))
        for i, name in enumerate(b.column("file").to_pylist()):
            segment = data[bounds[i] : bounds[i + 1]].tobytes()
            if name != file:
                done += open_
                file, offset, open_ = name, len(segment), []
                continue
            for c in open_:
                c.feed(MAGIC + segment)
            open_.append(Candidate(file, offset, segment))
            offset += len(MAGIC) + len(segment)
            done += [c for c in open_ if not c.open]
            open_ = [c for c in open_ if c.open]
        if done:
            yield pa.RecordBatch.from_pylist([c.row() for c in done], ROW)
            done = []
    if done or open_:
        yield pa.RecordBatch.from_pylist([c.row() for c in done + open_], ROW)


def on_chain(found: DataFrame) -> DataFrame:
    """(file, offset) reachable from offset 0 of each archive. After k rounds all within 2**k steps are reached."""
    jump = found.select("file", F.col("offset").alias("at"), F.col("next").alias("to"))
    here = found.select("file", F.col("offset").alias("to"))
    jump = stage(jump.join(here, ["file", "to"]), "warc-jump")
    reached = stage(found.filter("offset = 0").select("file", F.col("offset").alias("at")), "warc-reached")
    n = reached.count()
    while True:
        step = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = stage(reached.union(step).distinct(), "warc-reached")
        before, n = n, reached.count()
        if n == before:
            return reached
        second = jump.select("file", F.col("at").alias("to"), F.col("to").alias("end"))
        jump = stage(jump.join(second, ["file", "to"]).select("file", "at", F.col("end").alias("to")), "warc-jump")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and digest_ok of every true record."""
    segments = spark.read.option("lineSep", MAGIC.decode()).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    schema = "file string, offset bigint, next bigint, record_type string, page_id bigint, refers_to bigint, payload_bytes bigint, stated string, digest string"
    found = stage(segments.mapInArrow(candidates, schema), "warc-candidates")
    true = found.join(on_chain(found).withColumnRenamed("at", "offset"), ["file", "offset"], "left_semi")
    revisit = F.col("record_type") == "revisit"
    return true.select(
        "page_id", "payload_bytes", F.when(revisit, F.col("stated")).otherwise(F.col("digest")).alias("payload_digest"), "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"), (revisit | (F.col("digest") == F.col("stated"))).alias("digest_ok"),
    )


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession, path)
