"""WARC archives compressed by Zstandard with one dictionary, and their reader.

An archive starts with a skippable frame that holds the dictionary (itself
compressed), then has one frame for each record.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docverify.llm.files import read_stream, write_once
from docverify.plans.storage import new_path, written

#: Magic number of the frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: The dictionary is made from about so many pages of at most so many characters.
SAMPLE_PAGES, SAMPLE_CHARS = 1_000, 16_000
#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: Bytes of records in an archive, about.
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 16 << 10
#: Archives that a reading task takes at most, where there are more than shuffle partitions.
FILES_PER_TASK = 8
DATE = "2024-01-31T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_BREAK = b"\r\n"
_PLAIN_URI = re.compile(r"[\x00-\x20\x7f<>]")


def _record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", record_id)
    if not found:
        raise ValueError(f"record id {record_id!r} isn't a page's")
    return int(found[1]) if found[1] else None


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response with the payload, or a revisit with the HTTP head only."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    uri = _PLAIN_URI.sub(lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return _BREAK.join(x.encode() for x in lines) + 2 * _BREAK + block + 2 * _BREAK


def _headers(data: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in data.split(_BREAK):
        name, colon, value = line.partition(b":")
        if not colon or name != name.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        found[name.decode("ascii").lower()] = value.strip().decode("utf-8")
    return found


def parse(data: bytes) -> dict:
    """The record's fields; raises where a header, a length or a digest is wrong."""
    head, found, rest = data.partition(2 * _BREAK)
    version, _, fields = head.partition(_BREAK)
    if not found or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC record")
    h = _headers(fields)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ValueError(f"the record has no {name}")
    size = int(h["content-length"])
    if len(rest) != size + 4 or rest[size:] != 2 * _BREAK:
        raise ValueError(f"the block has {len(rest) - 4} bytes, not {size}")
    block, kind = rest[:size], h["warc-type"]
    if h.get("warc-block-digest") not in (None, "sha256:" + hashlib.sha256(block).hexdigest()):
        raise ValueError("the block's digest is wrong")
    http, _, payload = block.partition(2 * _BREAK)
    status, _, http_fields = http.partition(_BREAK)
    if not status.startswith(b"HTTP/"):
        raise ValueError("the block isn't an HTTP message")
    length = int(_headers(http_fields)["content-length"])
    digest = h["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload's length or digest is wrong")
    if kind == "revisit" and payload:
        raise ValueError("a revisit has a payload")
    return {
        "page_id": _page_of(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": kind,
        "refers_to": _page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None,
        "payload_digest": digest, "payload_bytes": length, "payload": payload if kind == "response" else None,
    }


def read_records(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time."""
    lead = stream.read(8)
    if len(lead) != 8 or struct.unpack("<II", lead)[0] != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't start with a dictionary")
    size = struct.unpack("<II", lead)[1]
    packed = stream.read(size)
    if len(packed) != size:
        raise ValueError("the dictionary is cut off")
    raw = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    data = b""
    while data := data or stream.read(READ_BYTES):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not data and not (data := stream.read(READ_BYTES)):
                raise ValueError("the last frame is cut off")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def train_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from about SAMPLE_PAGES pages; empty where they are too few to train one."""
    usable = pages.select(F.col(html_col).alias("html")).where(
        F.col("html").isNotNull() & (F.length("html").between(1, SAMPLE_CHARS))
    )
    share = min(1.0, SAMPLE_PAGES / max(usable.count(), 1))
    sample = usable.where(F.pmod(F.xxhash64("html"), F.lit(1 << 32)) < int(share * (1 << 32))).distinct().collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(r["html"].encode() for r in sample)).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row to archives in folder; returns their list (file, records, bytes).

    Of rows whose payloads are equal (length and SHA-256) and have at least
    REVISIT_BYTES bytes, those with the smallest id are responses and the
    others revisit it; a null id is never the smallest, unless there is no
    other, and then all are responses. Null html is an empty payload, null
    urls are replaced by the page's URN; repeated rows give repeated records.
    An empty table gives no archive; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    narrow = written(keyed.select("page_id", "digest", "size").where(F.col("size") >= REVISIT_BYTES), "warc-digests")
    first = narrow.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    again = (
        narrow.join(first.where("n > 1 and refers_to is not null").drop("n"), ["digest", "size"])
        .where("page_id is null or page_id > refers_to")
        .select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to")
        .distinct()
    )
    ready = keyed.join(
        again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left"
    ).select("page_id", "url", "html", "digest", "refers_to")
    dictionary = train_dictionary(rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        settings = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=settings)
        packed = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
        lead = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
        frames, size = [], 0

        def closed() -> pa.RecordBatch:
            # the name is this attempt's own: another attempt may get its rows in another order, and only the winner's list is kept
            name = f"pages-{task:08d}-{number:06d}-{uuid.uuid4().hex[:12]}.warc.zst"
            return pa.RecordBatch.from_pylist(
                [{"file": name, "records": len(frames), "bytes": write_once(folder, name, [lead, *frames])}]
            )

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = record(page_id, url, html.encode("utf-8"), digest, refers_to)
                frames.append(packer.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    frames, size, number = [], 0, number + 1
        if frames:
            yield closed()

    return written(ready.mapInArrow(write, "file string, records long, bytes long"), "warc-archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the listed archives: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    Archives are read side by side, in as many tasks as there are archives, and
    at most FILES_PER_TASK in a task where they outnumber the shuffle
    partitions. Raises where a header, a length, a digest or the number of
    records is wrong. An empty list gives no rows.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for name, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, many = [], 0, 0
                with read_stream(folder, name) as f:
                    for raw in read_records(f):
                        rows.append(parse(raw))
                        size, many = size + len(raw), many + 1
                        if size >= ARCHIVE_BYTES // 4:
                            yield out(rows)
                            rows, size = [], 0
                if many != want:
                    raise ValueError(f"{name} has {many} records, not {want}")
                if rows:
                    yield out(rows)

    spark, many = archives.sparkSession, archives.count()
    tasks = max(1, min(many, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-many // FILES_PER_TASK))))
    return archives.select("file", "records").repartition(tasks).mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Records written to the shared folder and read back, without their payloads; one row per input row."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
