"""WARC archives: a writer with one gzip member per record, and a splittable reader.

Of pages with equal payloads the one with the smallest page_id becomes a response, the others revisits of it.
The reader cuts archives into byte ranges. A task looks for the gzip magic in its range, takes a place for a
record only if the member there decodes to a WARC header, reads on from record to record, and owns those that
start inside its range, also where they end beyond it.

Null html counts as empty, null urls and page_ids are kept (a null page_id is never the smallest, unless all
of a group are null: then all are responses). Rows that repeat the smallest page_id of their payload are all
responses. An empty table gives no archives and no records. Other columns of the pages are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, shared_dir

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1\r\n"
#: An archive ends with the record that passes this size; the reader's ranges; most tasks that read.
ARCHIVE_BYTES, RANGE_BYTES, READ_TASKS = 256 << 20, 4 << 20, 20_000
_READ_AT_ONCE, _LOOKED_AT_AT_ONCE = 1 << 20, 1 << 13
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def _page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; with refers_to a revisit, which has no payload."""
    block = b"" if refers_to is not None else _HTTP % len(payload) + payload
    lines = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Target-URI": re.sub(r"[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or ""),
        "X-Url": json.dumps(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": len(payload),
        **({} if refers_to is None else {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n"
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(head + block + b"\r\n\r\n") + packed.flush()


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the archives into `folder` (seen by all executors) and returns path, bytes and records of each.

    Each attempt of a task writes files of its own names; the result lists those of attempts that ended well."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    same = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    marked = rows.join(same.where("n > 1").select("sha1", "first"), "sha1", "left")
    refers_to = F.when(F.col("first") != F.coalesce("page_id", F.col("first") + 1), F.col("first"))
    marked = marked.select("page_id", "url", "payload", "sha1", refers_to.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        out, path, size, count = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((path, pa.string()), (size, pa.int64()), (count, pa.int64()))], names=["path", "bytes", "records"])

        for batch in batches:
            for page_id, url, body, sha1, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    path, out = f"{folder}/{name}", files.open_output_stream(f"{root}/{name}", compression=None)
                made = record(page_id, url, body, base64.b32encode(bytes.fromhex(sha1)).decode(), refers)
                out.write(made)
                size, count = size + len(made), count + 1
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    files, root = _opened(folder)
    files.create_dir(root, recursive=True)
    return settled(marked.mapInArrow(run, "path string, bytes long, records long"))


class _Window:
    """A file read forwards, with the last part kept for a second look."""

    def __init__(self, file):
        self.file, self.at, self.held = file, 0, b""

    def from_(self, place: int) -> bytes:
        """Some bytes from `place` on: at least as many as the magic has, but at the file's end."""
        if not self.at <= place <= self.at + len(self.held) - len(MAGIC):
            self.file.seek(place)
            self.at, self.held = place, self.file.read(_READ_AT_ONCE)
        return self.held[place - self.at : place - self.at + _LOOKED_AT_AT_ONCE]


def _member(window: _Window, place: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at `place` and where that ends; None if there is none. A member that begins as a
    record but breaks off or does not decode is an error: its record would be lost in silence."""
    decoded, out, at = zlib.decompressobj(31), bytearray(), place
    try:
        while not decoded.eof:
            part = window.from_(at)
            if not part:
                break
            out += decoded.decompress(part)
            at += len(part)
            if not out.startswith(b"WARC/1.") and len(out) >= 7:
                return None
    except zlib.error as e:
        if out.startswith(b"WARC/1."):
            raise ValueError(f"the record at byte {place} is damaged") from e
        return None
    if not out.startswith(b"WARC/1."):
        return None
    if not decoded.eof:
        raise ValueError(f"the record at byte {place} breaks off")
    return bytes(out), at - len(decoded.unused_data)


def records_in(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records whose gzip members start in [start, end) of a file of `size` bytes."""
    window, place = _Window(file), start
    while place < min(end, size):
        part = window.from_(place)
        found = part.find(MAGIC)
        if found < 0:
            place += max(1, len(part) - len(MAGIC) + 1)  # a magic may begin in the last bytes
        elif place + found >= end:
            return
        elif got := _member(window, place + found):
            yield got[0]
            place = got[1]
        else:
            place += found + 1


def parsed(raw: bytes) -> dict:
    """A record's fields; a payload that does not fit its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(lines["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if lines["WARC-Type"] == "response" else None
    digest = lines["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and sha1_base32(payload) != digest:
        raise ValueError(f"{lines['WARC-Record-ID']}: the payload does not fit its digest")
    return {
        "page_id": _page_of(lines["WARC-Record-ID"]), "url": json.loads(lines["X-Url"]), "record_type": lines["WARC-Type"], "refers_to": _page_of(lines.get("WARC-Refers-To")),
        "payload": payload, "payload_bytes": int(lines["X-Payload-Length"]) if payload is None else len(payload), "payload_digest": digest,
    }


def read(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of archives given by path and bytes. Without `payloads` these are checked but not returned."""
    ranges = archives.select("path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {range_bytes}L)")).alias("start"))
    tasks = archives.select(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, inner = _opened(path)
                with files.open_input_file(inner) as file:
                    rows = []
                    for raw in records_in(file, size, start, start + range_bytes):
                        rows.append(parsed(raw) | ({} if payloads else {"payload": None}))
                        if len(rows) >= 256:
                            yield made(rows)
                            rows = []
                    yield made(rows)

    return ranges.repartition(int(min(max(tasks, 1), READ_TASKS))).mapInArrow(run, RECORDS)


def through_archives(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """The records of all pages, written to archives in the shared folder and read back."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder, min_revisit_bytes), payloads=False)
