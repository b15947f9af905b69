"""WARC archives: writing with revisit records, and a splittable reader.

Writing. Records are gzip members, one each. Spark's text writer, with its commit protocol, writes the raw bytes:
a member's last byte is the high byte of its length and zero below 16 MB, so members go without it and the writer's
row separator, a zero byte, completes them; a larger record is followed by an empty member, which ends in zero.

Reading. Tasks get byte ranges of the archives. A task scans its range for gzip's magic bytes and tries to inflate
at each candidate; it is a record if WARC headers come out. A task owns the records that start inside its range and
reads on beyond the end to finish the last. After a record the next candidate is where its member ended.

Defined results: null payloads count as empty; records with equal payloads of at least ``min_revisit`` bytes have
one response, that with the smallest id, and the others revisit it (repeated ids revisit nothing else: equal ids
are each a response); a page without id is a response without one (its record is named by the digest of its payload
and url) and is read back with a null id; an empty table writes no record; corrupt bytes between members are skipped;
pages tie in nothing but their ids; a long payload is one record, whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeframe.llm.common import utf8

MAGIC = b"\x1f\x8b\x08"
MIN_REVISIT = 100
#: Bytes of a range that a task reads at a time, and of a range by default.
READ_AT_ONCE, RANGE = 4 << 20, 32 << 20
#: Parts that each repeated payload's entry is copied to, so that no payload's records meet in one task.
SALTS = 16
#: Fixed value: the date that all records carry, for archives that can be made again byte by byte.
DATE = "2024-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, page_id: str = "page_id", payload: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, uri (if any), payload bytes, digest and refers_to (null for responses)."""
    body = pages.select(F.col(page_id).cast("long").alias("page_id"), (F.col("url").cast("string") if "url" in pages.columns else F.lit("")).alias("uri"), utf8(payload).alias("payload"))
    body = body.withColumn("digest", F.sha2("payload", 256))
    first = body.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = body.withColumn("salt", F.pmod(F.xxhash64("page_id", "uri"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, ["digest", "salt"], "left")
    return joined.select("page_id", "uri", "payload", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def record(page_id: int | None, uri: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit holds the HTTP headers only, and so the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri)
    name = f"urn:page:{page_id}" if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{digest} {uri}").urn
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


EMPTY_MEMBER = _member(b"")


def write(pages: DataFrame, path: str, **options) -> None:
    """Writes one record for each row of ``pages`` (see ``with_revisits``) to archives under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                rows = batch.slice(begin, 256)
                out = []
                for page_id, uri, payload, digest, refers_to in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    data = _member(record(page_id, uri or "", payload, digest, refers_to))
                    out.append((data if data[-1] == 0 else data + EMPTY_MEMBER)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = with_revisits(pages, **options).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


class Range:
    """Bytes of a file, read forward in bounded pieces, from the start of a range to as far as its last record goes."""

    def __init__(self, file, start: int, size: int):
        self.file, self.size = file, size
        self.begin, self.data = start, b""  # data begins at ``begin`` of the file
        self.at = start

    def more(self) -> bool:
        """Reads on; what lies before ``at`` is let go, so each byte is moved about once."""
        end = self.begin + len(self.data)
        if end >= self.size:
            return False
        self.file.seek(end)
        got = self.file.read(min(READ_AT_ONCE, self.size - end))
        self.data, self.begin = self.data[self.at - self.begin :] + got, self.at
        return bool(got)

    def find(self, end: int) -> int | None:
        """Where the next magic starts before ``end``."""
        while True:
            i = self.data.find(MAGIC, self.at - self.begin)
            if i >= 0:
                return self.begin + i if self.begin + i < end else None
            self.at = max(self.at, self.begin + len(self.data) - len(MAGIC) + 1)
            if self.at >= end or not self.more():
                return None

    def inflate(self) -> tuple[bytes, int] | None:
        """The member at ``at`` and where it ends; None if there is none. Anything but WARC headers is given up early."""
        unpack, out, used, checked = zlib.decompressobj(31), [], 0, False
        try:
            while True:
                low = self.at - self.begin + used
                piece = self.data[low : low + (1 << 16)]
                if not piece:
                    if not self.more():
                        return None
                    continue
                out.append(unpack.decompress(piece))
                used += len(piece) - len(unpack.unused_data)
                if not checked and sum(map(len, out)) >= 8:
                    if not b"".join(out).startswith(b"WARC/"):
                        return None
                    checked = True
                if unpack.eof:
                    return b"".join(out), self.at + used
        except zlib.error:
            return None


def headers(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and what follows them."""
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, rest


RECORD = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("uri", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())]
    + [T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())]
)


def parse(data: bytes) -> dict | None:
    """A record's fields; a response's digest and length are those of the payload that was read."""
    if not data.startswith(b"WARC/"):
        return None
    fields, block = headers(data)
    number = lambda name: int(x[1]) if (x := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    http, payload = headers(block[: int(fields.get("content-length", 0))])
    kind = fields.get("warc-type", "")
    if kind == "response":
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    else:
        digest, size, payload = fields.get("warc-payload-digest", "").rpartition(":")[2], int(http.get("content-length", 0)), None
    return {
        "page_id": number("warc-record-id"), "uri": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("warc-refers-to"),
        "payload_digest": digest, "payload_bytes": size, "payload": payload,
    }


def records_in(file, start: int, end: int, size: int) -> Iterator[dict]:
    """The records of a file that start in [start, end)."""
    span = Range(file, start, size)
    while (at := span.find(end)) is not None:
        span.at = at
        got = span.inflate()
        span.at = at + 1 if got is None else got[1]
        if got is None:
            continue
        if (fields := parse(got[0])) is not None:
            yield fields


def read(spark: SparkSession, path: str, range_bytes: int = RANGE, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``, read in ranges of ``range_bytes``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.where("length > 0").select("path", "length", F.explode(starts).alias("start"))
    ranges = ranges.repartition(max(1, ranges.count()))  # a range is a task's work, so a lost one costs little
    schema = RECORD if payloads else T.StructType(RECORD.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        arrow = pa.schema([pa.field(f.name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema.fields])
        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["path"])
                held, size = [], 0
                with store.open_input_file(name) as file:
                    for fields in records_in(file, row["start"], min(row["start"] + range_bytes, row["length"]), row["length"]):
                        held.append({k: v for k, v in fields.items() if payloads or k != "payload"})
                        size += fields["payload_bytes"] if payloads else 200
                        if size > READ_AT_ONCE:
                            yield pa.RecordBatch.from_pylist(held, arrow)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    return ranges.mapInArrow(run, schema)
