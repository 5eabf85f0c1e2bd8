"""WARC archives: writing payload records with revisits, and reading them back from segments.

Writing: one task streams its pages into gzip members, one member a record. A block over ``segment_bytes`` is cut:
the first part is the record itself (segment 1), the others are ``continuation`` records that name it as origin;
the last gives the total length. The body travels in chunked framing, as servers send it.

Reading: whole records are decoded where they lie. Segments are grouped by origin, ordered by number, checked
(numbers 1..k, total length) and joined before the framing is taken off.

Null body: empty payload. Null id: the record is written with id ``null`` and read back as null. Repeated ids and
repeated rows: each row is a record of its own. Of equal payloads the largest id is the response; rows that share
that largest id are all responses; a null id is the smallest. Empty table: no record, no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 4 << 10
# files hold so many records at most, so a file is at most RECORDS_PER_FILE * SEGMENT_BYTES unpacked
RECORDS_PER_FILE = 2048
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
END = b"\r\n\r\n"

SEGMENT = "origin string, segment int, total_length long, record_type string, page_id long, refers_to long, digest string, length long, block binary"
PAYLOAD = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, complete boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer framing of a body."""
    parts = []
    for i in range(0, len(body), size):
        piece = body[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    parts.append(b"0\r\n\r\n")
    return b"".join(parts)


def dechunked(data: bytes) -> bytes | None:
    """The body inside chunked framing; None where the framing is broken or cut short."""
    parts, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            return None
        size_text = data[at:line].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size_text):
            return None
        size = int(size_text, 16)
        begin = line + 2
        if size == 0:
            return b"".join(parts)
        if data[begin + size : begin + size + 2] != b"\r\n":
            return None
        parts.append(data[begin : begin + size])
        at = begin + size + 2


def classify(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, body, record_type and refers_to: which rows carry the payload and which point to another.

    Only digests and ids are aggregated (partly before the exchange); the join by digest can be split where a
    payload is frequent.
    """
    body = F.encode(F.coalesce(pages[body_col], F.lit("")), "UTF-8")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), body.alias("body"))
    rows = rows.withColumn("key", F.unhex(F.sha1("body")))
    first = rows.select("key", "page_id").groupBy("key").agg(F.max("page_id").alias("top"))
    named = rows.join(first, "key")
    revisit = (F.length("body") >= min_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return named.select(
        "page_id",
        "body",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("top")).alias("refers_to"),
    )


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member. Blocks are far under 16 MiB, so the member's last byte (the top byte of its size) is zero;
    it is left off here and written by Spark as the line separator."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(head.encode() + block + END) + packer.flush()
    return member[:-1]


def _records(page_id, uid, body: bytes, kind: str, refers, segment_bytes: int) -> Iterator[bytes]:
    name = "null" if page_id is None else str(page_id)
    record_id = f"<urn:page:{name}:{uid}>"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", f"urn:page:{name}"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(body)}")]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", f"urn:page:{refers}"), ("X-Payload-Length", str(len(body)))]
        yield _record(fields, HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(body)
    if len(block) <= segment_bytes:
        yield _record(fields, block)
        return
    parts = range(0, len(block), segment_bytes)
    for k, at in enumerate(parts, 1):
        segment = [("WARC-Segment-Number", str(k))]
        if k == len(parts):
            segment.append(("WARC-Segment-Total-Length", str(len(block))))
        if k == 1:
            head = fields + segment
        else:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{name}:{uid}:{k}>"), ("WARC-Segment-Origin-ID", record_id), *segment]
        yield _record(head, block[at : at + segment_bytes])


def write(classified: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write the rows of `classify` as gzip WARC files under `path`, which Spark's file system opens."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[bytes] = []
            for page, uid, body, kind, refers in zip(batch.page_id, batch.uid, batch.body, batch.record_type, batch.refers_to):
                out.extend(_records(None if pd.isna(page) else int(page), uid, bytes(body), kind, None if pd.isna(refers) else int(refers), segment_bytes))
                if sum(map(len, out[-64:])) > 8 << 20 or len(out) > 4096:
                    yield pd.DataFrame({"value": out})
                    out = []
            yield pd.DataFrame({"value": out})

    # the number keeps the records of repeated ids apart; all segments of a record are written by one task
    numbered = classified.withColumn("uid", F.monotonically_increasing_id())
    packed = numbered.mapInPandas(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).mode("errorifexists").text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of one archive file."""
    data = gzip.GzipFile(fileobj=io.BytesIO(content)).read() if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        head = data.find(END, at)
        if head < 0:
            raise ValueError("archive ends inside a record header")
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = head + len(END)
        end = begin + int(fields["content-length"])
        if data[end : end + 4] != END:
            raise ValueError("archive ends inside a record block")
        yield fields, data[begin:end]
        at = end + 4


def _page(uri: str | None) -> int | None:
    name = (uri or "").rpartition(":")[2]
    return int(name) if re.fullmatch(r"-?\d+", name) else None


def segments(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """Records read from the archives: those in one piece, or the segments of the others."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                rows = []
                for f, block in parse(bytes(content)):
                    number = f.get("warc-segment-number")
                    if (number is None) != whole:
                        continue
                    total, length = f.get("warc-segment-total-length"), f.get("x-payload-length")
                    rows.append((
                        f.get("warc-segment-origin-id", f["warc-record-id"]), number and int(number), total and int(total), f["warc-type"], _page(f.get("warc-target-uri")),
                        _page(f.get("warc-refers-to-target-uri")), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, length and int(length), block,
                    ))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in SEGMENT.split(", ")]).astype({"segment": "Int32", "total_length": "Int64", "page_id": "Int64", "refers_to": "Int64", "length": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(read, SEGMENT)


def reassemble(parts: DataFrame) -> DataFrame:
    """One row per segmented record. The group is one record's own segments, so its bound is that record's size."""
    first = F.col("segment") == 1
    only = {c: F.max(F.when(first, F.col(c))).alias(c) for c in ("record_type", "page_id", "refers_to", "digest", "length")}
    grouped = parts.groupBy("origin").agg(
        *only.values(),
        F.max("total_length").alias("total_length"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["block"]))
    in_order = numbers == F.sequence(F.lit(1), F.size("parts"))
    return grouped.select("record_type", "page_id", "refers_to", "digest", "length", joined.alias("block"), (in_order & F.col("total_length").eqNullSafe(F.octet_length(joined))).alias("whole"))


def decode(records: DataFrame) -> DataFrame:
    """Payload of each record; ``complete`` is false where segments, length, framing or digest do not fit."""

    def take_off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payload, size, digest, complete = [], [], [], []
            for kind, d, n, block, whole in zip(batch.record_type, batch.digest, batch.length, batch.block, batch.whole):
                head, _, framed = bytes(block).partition(END)
                if kind == "revisit":
                    payload.append(None)
                    size.append(n)
                    digest.append(d)
                    complete.append(bool(whole))
                    continue
                body = dechunked(framed) if b"transfer-encoding: chunked" in head.lower() else framed
                own = None if body is None else base32_sha1(body)
                payload.append(body)
                size.append(None if body is None else len(body))
                digest.append(own or d)
                complete.append(bool(whole) and own is not None and (d is None or own == d))
            yield pd.DataFrame({"page_id": batch.page_id.astype("Int64"), "record_type": batch.record_type, "refers_to": batch.refers_to.astype("Int64"), "payload_digest": digest, "payload_bytes": pd.array(size, "Int64"), "payload": payload, "complete": complete})

    return records.select("page_id", "record_type", "refers_to", "digest", "length", "block", "whole").mapInPandas(take_off, PAYLOAD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of all records under `path` (see PAYLOAD)."""
    single = segments(spark, path, whole=True).withColumn("whole", F.lit(True))
    joined = reassemble(segments(spark, path, whole=False))
    return decode(single.select(*joined.columns)).unionByName(decode(joined))


