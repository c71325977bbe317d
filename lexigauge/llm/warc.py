"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Writing: every task streams its rows into archive files of bounded size in a shared folder; a file's name is new for each
attempt, and only files in the manifest count, so a lost or repeated task leaves no half file in the result. Reading:
members are inflated step by step, records framed by Content-Length and checked against their digests, without ever
holding a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.llm.common import light, staged

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_TYPE = "application/http; msgtype=response"
#: Own prefix of record ids; the date of records whose pages have none.
ID_PREFIX, NO_DATE = "urn:page:", "1970-01-01T00:00:00Z"
#: Bytes after which a task begins the next archive; bytes read at once; rows of a table that may be broadcast.
ARCHIVE_BYTES, BLOCK, BROADCAST_ROWS = 64 << 20, 1 << 18, 100_000


def _digest(sha1: hashlib._Hash) -> str:
    return base64.b32encode(sha1.digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with the payload, or a revisit with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID_PREFIX}{page_id if page_id is not None else f'none:{uuid.uuid4()}'}>",
        f"WARC-Date: {NO_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{_digest(hashlib.sha1(payload))}",
        f"WARC-Block-Digest: sha1:{_digest(hashlib.sha1(block))}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Type: {RESPONSE_TYPE}", f"Content-Length: {len(block)}"])
    return VERSION + b"\r\n" + head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Record:
    """One record as its bytes arrive; it keeps headers and digests, never the block."""

    def __init__(self) -> None:
        self.head, self.http = bytearray(), bytearray()
        self.fields: dict[str, str] | None = None
        self.left, self.tail = 0, b""
        self.block, self.payload, self.payload_bytes, self.in_payload = hashlib.sha1(), hashlib.sha1(), 0, False

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            data = bytes(self.head[end + 4 :])
            first, *lines = bytes(self.head[:end]).decode().split("\r\n")
            if first.encode() != VERSION:
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            self.fields = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)}
            self.left = int(self.fields["content-length"])
        block, self.tail = data[: self.left], self.tail + data[self.left :]
        self.left -= len(block)
        self.block.update(block)
        if not self.in_payload:
            self.http += block
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return
            self.in_payload, block = True, bytes(self.http[end + 4 :])
            del self.http[end:]
        self.payload.update(block)
        self.payload_bytes += len(block)

    def row(self) -> dict:
        """What the record says, checked. A revisit states its payload's length and digest without holding it."""
        f = self.fields or {}
        stated, full = f.get("warc-payload-digest", "").removeprefix("sha1:"), int(re.search(r"(?i)content-length: (\d+)", self.http.decode())[1])
        revisit = f.get("warc-type") == "revisit"
        whole = not self.left and self.tail == b"\r\n\r\n" and f.get("warc-block-digest") == "sha1:" + _digest(self.block)
        held = self.payload_bytes == 0 if revisit else (self.payload_bytes == full and stated == _digest(self.payload))
        number = lambda key: int(x[1]) if (x := re.fullmatch(f"<{ID_PREFIX}(-?[0-9]+)>", f.get(key, ""))) else None
        return {"page_id": number("warc-record-id"), "url": f.get("warc-target-uri"), "payload_bytes": full, "payload_digest": stated, "record_type": f.get("warc-type"), "refers_to": number("warc-refers-to"), "verified": bool(whole and held)}


def records(stream) -> Iterator[dict]:
    """The records of an archive, in order; each gzip member is one record."""
    data = stream.read(BLOCK)
    while data:
        member, one = zlib.decompressobj(wbits=31), Record()
        while not member.eof:
            data = data or stream.read(BLOCK)
            got = member.decompress(data, BLOCK)
            if not (data or got or member.eof):
                raise EOFError("the archive ends inside a member")
            one.feed(got)
            data = member.unused_data if member.eof else member.unconsumed_tail
        yield one.row()
        data = data or stream.read(BLOCK)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_warc(pages: DataFrame, folder: str, minimum: int = 0, level: int = 3) -> DataFrame:
    """Write columns page_id, url, html as archives in ``folder`` and return the manifest: path, records, bytes.

    Payload: html in UTF-8 (null: empty). Of the rows with equal payloads of at least ``minimum`` bytes the one with the
    largest page_id becomes the response and the others revisit it; rows that repeat that page_id are responses too.
    Shorter payloads are all responses. Rows whose page_id is null are responses. White space and control characters in
    urls are percent-encoded; a null url is written as an empty one. Other columns are not read. An empty table gives an
    empty manifest. ``folder`` must be one that all executors share.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    mark = F.when(F.length(payload) >= minimum, F.unhex(F.sha2(payload, 256)))
    rows = pages.select("page_id", "url", payload.alias("payload"), mark.alias("mark"))
    shared = rows.where("mark is not null and page_id is not null").groupBy("mark").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", "first")
    shared = staged(shared, "shared-payloads")
    small = shared.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(shared) if small else shared, "mark", "left").select("page_id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        out, path, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, body, first in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                page_id, first = page_id.as_py(), first.as_py()
                pack = zlib.compressobj(level, wbits=31)
                raw = record(page_id, url.as_py(), body.as_py(), first, page_id is not None and first is not None and page_id != first)
                raw = pack.compress(raw) + pack.flush()
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return staged(rows.mapInArrow(light(write), "path string, records long, bytes long"), "manifest")


def read_warc(manifest: DataFrame, folder: str, partitions: int) -> DataFrame:
    """Read the archives that the manifest names, one task per ``partitions`` of them, each file as a stream.

    Return page_id, url, payload_bytes, payload_digest (bare base32 SHA-1, both of the full payload), record_type,
    refers_to, verified (framing, block digest and payload digest hold). A row per record: pages without an id or url come
    back with a null id and an empty url, rows that repeat each come back, payloads of any length stream through. An empty
    manifest gives an empty result. Records of pages without an id have random ids of their own; pages that repeat an id
    share one, since nothing tells them apart.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _open(folder)
        for frame in frames:
            for path in frame["path"]:
                with system.open_input_stream(path, compression=None) as stream:
                    rows: list[dict] = []
                    for row in records(stream):
                        rows.append(row)
                        if len(rows) == 4096:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    return manifest.select("path").repartition(partitions).mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean")


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})
