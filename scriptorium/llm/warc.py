"""WARC archives in seekable Zstandard bundles.

Writing: each task turns its rows into WARC/1.1 records, groups records into independent
Zstandard frames of about ``FRAME_BYTES``, and closes a bundle with a seek table in a
skippable frame (the published seekable format), so any frame can be read alone. A map
from record identifier to bundle, frame and offset within the frame is returned as rows.
Bundles are written under a name of their own attempt; the map, which a written table
fixes, names the bundles of the attempts that succeeded, so lost executors and repeated
tasks leave at worst an orphan file.

Reading: a bundle's seek table gives the frames, each frame is decompressed alone, and
records are parsed by their own lengths.

Deduplication: of records with equal payloads of at least ``least`` bytes, the one with
the largest page_id is a response and the others are revisits that name it. Payloads are
compared by SHA-1, as WARC does. Digests are aggregated without payloads (the largest
page_id of a digest, pre-aggregated per task); payloads then move once, by page_id, so no
group of equal payloads, however large, is in one task.

Defined cases: null html is an empty payload; a null page_id is written as identifier
"null" and is a response only if no equal payload has an id; rows that repeat a page_id
with equal payload are equal responses; an empty table gives an empty result; other
columns are ignored (url may be null).
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
_SEEKABLE = 0x8F92EAB1
_SKIPPABLE = 0x184D2A5E
_DATE = "2024-01-01T00:00:00Z"
_URL = re.compile(r"[\x00-\x20\x7f]")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        *([] if url is None else ["WARC-Target-URI: " + _URL.sub(lambda m: "%%%02X" % ord(m[0]), url)]),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[7:7] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Frames of records, and at the end the seek table."""

    def __init__(self, out):
        self.out, self.frames, self.pending, self.size = out, [], [], 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        at = (len(self.frames), self.size)
        self.pending.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.pending:
            packed = self.zip.compress(b"".join(self.pending))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE))
        self.out.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, packed size, size) of each frame, from the footer of a bundle."""
    source.seek(0, io.SEEK_END)
    end = source.tell()
    source.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(end - 9 - count * width)
    raw, frames, at = source.read(count * width), [], 0
    for k in range(count):
        packed, size = struct.unpack_from("<II", raw, k * width)
        frames.append((at, packed, size))
        at += packed
    return frames


def read_frame(source, frame: tuple[int, int, int]) -> bytes:
    source.seek(frame[0])
    data = zstandard.ZstdDecompressor().decompressobj().decompress(source.read(frame[1]))
    if len(data) != frame[2]:
        raise ValueError("damaged frame")
    return data


def parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at ``at``."""
    split = data.index(b"\r\n\r\n", at)
    lines = data[at:split].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start = split + 4
    end = start + int(headers["Content-Length"])
    return headers, data[start:end], end + 4


def _open(path: str, write: bool):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(inner, compression=None)
    return system.open_input_file(inner)


def _page_id(text: str):
    return None if text == "<urn:page:null>" else int(text[10:-1])


def plan_records(df: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: null for a response, else the response's page_id."""
    slim = df.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digests = slim.select("page_id", F.sha1(F.col("html").cast("binary")).alias("_sc_digest"), F.octet_length("html").alias("_sc_bytes"))
    largest = digests.where(F.col("_sc_bytes") >= least).groupBy("_sc_digest").agg(F.max("page_id").alias("_sc_last"), F.count("*").alias("_sc_n"))
    largest = largest.where("_sc_n > 1")
    again = digests.join(largest, "_sc_digest").where("_sc_last is not null and not (page_id <=> _sc_last)").select("page_id", F.col("_sc_last").alias("refers_to"), "_sc_digest")
    again = again.dropDuplicates()
    a, b = slim.alias("a"), again.alias("b")
    return a.join(b, F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.sha1(F.col("a.html").cast("binary")) == F.col("b._sc_digest")), "left").select("a.page_id", "a.url", "a.html", "b.refers_to")


INDEX = "page_id long, record_id string, bundle string, frame int, offset long"


def write_archives(df: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for each page below ``folder``; the map of records, one row each."""
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64())])

    def write(batches):
        bundle = name = None
        for whole in batches:
            for batch in common.pieces(whole, "html"):
                rows = []
                for page_id, url, html, refers in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to"))):
                    if bundle is None:
                        name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                        bundle = Bundle(_open(name, True))
                    payload = html.encode()
                    frame, offset = bundle.add(record(page_id, url, payload, digest32(payload), refers))
                    rows.append((page_id, record_id(page_id), name, frame, offset))
                    if bundle.written > BUNDLE_BYTES:
                        bundle.close()
                        bundle = None
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        if bundle is not None:
            bundle.close()

    return common.written(plan_records(df, least).mapInArrow(write, INDEX), "warc-index")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all bundles that ``index`` names, a frame at a time."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
    frames = index.select("bundle", "frame").distinct()

    def read(batches):
        opened, source, table = None, None, None
        for batch in batches:
            for name, k in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame"))):
                if name != opened:
                    opened, source = name, _open(name, False)
                    table = seek_table(source)
                data, at, rows = read_frame(source, table[k]), 0, []
                while at < len(data):
                    headers, block, at = parse(data, at)
                    revisit = headers["WARC-Type"] == "revisit"
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and (len(payload) != length or digest32(payload) != digest):
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                    rows.append((_page_id(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), length, digest, headers["WARC-Type"], _page_id(headers["WARC-Refers-To"]) if revisit else None, payload.decode() if payloads and not revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    spark = index.sparkSession
    ordered = frames.repartition(common.shuffle_partitions(spark), "bundle", "frame").sortWithinPartitions("bundle", "frame")
    return ordered.mapInArrow(read, RECORDS)


def read_record(index_row) -> tuple[dict, bytes]:
    """One record by its row of the map: one seek, one frame."""
    source = _open(index_row["bundle"], False)
    headers, block, _ = parse(read_frame(source, seek_table(source)[index_row["frame"]]), index_row["offset"])
    return headers, block


def query(spark, sf_dir):
    index = write_archives(common.pages(spark, sf_dir), common.new_path(spark, "warc"))
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, ('0x' || substr(h, 1, 10))::BIGINT AS p0, ('0x' || substr(h, 11, 10))::BIGINT AS p1,
    ('0x' || substr(h, 21, 10))::BIGINT AS p2, ('0x' || substr(h, 31, 10))::BIGINT AS p3 FROM d
)
SELECT page_id, payload_bytes,
  {" || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (p{k} >> {s}) % 32 + 1, 1)" for k in range(4) for s in range(35, -1, -5))} AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY h)
"""
