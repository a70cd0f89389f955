"""WARC archives as seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each with some whole records, closed by the
seek table of the seekable format: a skippable frame that lists the frames' sizes and ends in a fixed
footer. Readers that know no seek table read a bundle as one stream. The index maps a record's id to
bundle, frame and offset within the frame's plain bytes, so one record costs one frame.

Equal payloads are stored once: the page with the smallest page_id is the response, all others are
revisits that name it. The narrow digests decide this; the pages themselves move once, by page.

Rules: a null html is an empty payload; a null page_id is larger than any other; rows that share the
smallest page_id of a payload are all responses; urls may be null or hold anything, as they are
percent-encoded in headers; further columns are ignored; no pages give no bundles and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_dir
from .common import pin, written
from .token_files import open_place, publish

# Plain bytes after which a frame is closed.
FRAME = 1_000_000
LAST_ID = (1 << 63) - 1

# Fixed values of the seekable format: the skippable frame's and the footer's magic number.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

RECORD = "page_id long, bundle string, frame int, offset int, length int"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, when: str) -> bytes:
    """One WARC/1.1 record; a revisit has the response's headers and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                     f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])


def parse(plain: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a place of a frame, and where the next one begins."""
    end = plain.index(b"\r\n\r\n", at)
    head = _headers(plain[at:end])
    body = plain[end + 4 : end + 4 + int(head["Content-Length"])]
    cut = body.index(b"\r\n\r\n")
    page = head["WARC-Record-ID"][len("<urn:page:") : -1]
    refers = head.get("WARC-Refers-To")
    found = {
        "page_id": int(page) if page else None, "url": unquote(head["WARC-Target-URI"]), "record_type": head["WARC-Type"],
        "payload_bytes": int(_headers(body[:cut])["Content-Length"]), "payload": body[cut + 4 :],
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None,
    }
    return found, end + 4 + len(body) + 4


class BundleWriter:
    """Puts records into frames and writes the seek table at the end."""

    def __init__(self, out):
        self.out, self.sizes, self.plain = out, [], bytearray()
        self.pack = zstandard.ZstdCompressor(level=3)

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame of the record and its offset there."""
        if self.plain and len(self.plain) + len(data) > FRAME:
            self._close_frame()
        place = len(self.sizes), len(self.plain)
        self.plain += data
        return place

    def _close_frame(self) -> None:
        packed = self.pack.compress(bytes(self.plain))
        self.out.write(packed)
        self.sizes.append((len(packed), len(self.plain)))
        self.plain = bytearray()

    def close(self) -> None:
        if self.plain:
            self._close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))


class Bundle:
    """Random access to a bundle's frames by its seek table."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        sizes = struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int) -> dict:
        return parse(self.frame(frame), offset)[0]

    def records(self) -> Iterator[dict]:
        for i in range(len(self.frames)):
            plain, at = self.frame(i), 0
            while at < len(plain):
                found, at = parse(plain, at)
                yield found


def with_responses(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, url, html, refers_to): the page that a page's payload was first seen on."""
    pages = pages.select(F.coalesce("page_id", F.lit(LAST_ID)).alias("page_id"), "url", "html",
                         F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    seen = pages.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes).select("page_id", "digest")
    first = written(seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                    .filter("n > 1").select("digest", "first"), "first-seen")
    again = seen.join(first, "digest").filter("page_id > first").distinct()
    return pages.join(again.select("page_id", "digest", F.col("first").alias("refers_to")), ["page_id", "digest"], "left")


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0, when: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page into bundles under `folder`; returns the index of all records."""
    pin(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        fs, base = open_place(folder)
        fs.create_dir(base, recursive=True)
        name = f"bundle-{TaskContext.get().partitionId():06d}.warc.zst"
        index: list[tuple] = []

        def write(out) -> None:
            writer = BundleWriter(out)
            batch = first
            while batch is not None:
                for i in range(batch.num_rows):
                    row = {c: batch[c][i].as_py() for c in ("page_id", "url", "html", "refers_to")}
                    page = None if row["page_id"] == LAST_ID else row["page_id"]
                    data = record(page, row["url"], (row["html"] or "").encode("utf-8", "surrogatepass"), row["refers_to"], when)
                    index.append((page, name, *writer.add(data), len(data)))
                batch = next(batches, None)
            writer.close()

        publish(fs, f"{base}/{name}", write)
        for at in range(0, len(index), 10_000):
            columns = list(zip(*index[at : at + 10_000], strict=True))
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                                   *[pa.array(c, pa.int32()) for c in columns[2:]]], ["page_id", "bundle", "frame", "offset", "length"])

    rows = with_responses(pages, least_bytes).select("page_id", "url", "html", "refers_to")
    return written(rows.mapInArrow(run, RECORD), "warc-index")


def read_bundles(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """All records of the bundles: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    bundles = index.select("bundle").distinct()
    bundles = bundles.repartition(max(1, bundles.count()), "bundle")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if payload:
        schema, kinds, names = schema + ", payload binary", [*kinds, pa.binary()], [*names, "payload"]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_place(folder)
        for batch in batches:
            for name in batch["bundle"].to_pylist():
                rows = []
                for found in Bundle(fs, f"{base}/{name}").records():
                    rows.append(found)
                    if len(rows) == 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return bundles.mapInArrow(run, schema)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to a new folder of bundles and return what these hold."""
    folder = scratch_dir(pages.sparkSession, "warc")
    return read_bundles(write_bundles(pages, folder, least_bytes), folder)
