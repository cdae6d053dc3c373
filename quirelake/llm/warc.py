"""WARC archives as a chunked record table.

A record's payload never exists as one value on the reading side: archives are streamed and come out as rows
(record id, chunk number, bytes), and SHA-1, CRC and length are carried from chunk to chunk; the last row of a
record holds its digest.  Archives are gzip members, one for each record, written by tasks into the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import _rows
from .work import new_path, stored

FILES = "path string, records long, payload_bytes long"
CHUNKS = "path string, record_no long, record_id string, record_type string, target_uri string, page_id long, refers_to long, digest_claimed string, chunk_no long, last boolean, length_so_far long, digest string, payload binary"
DIGESTS = "page_id long, payload_digest string, payload_bytes long"
VERSION = b"WARC/1.1"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            payload = memoryview(html.as_buffer()) if html.is_valid else b""
            out.append((page, base32_sha1(hashlib.sha1(payload).digest()), len(payload)))
        yield _rows(out, DIGESTS)


def header(fields: list[tuple[str, object]]) -> bytes:
    """A record's header block; line breaks in a value would end it and become spaces."""
    lines = [VERSION] + [f"{k}: {' '.join(str(v).splitlines())}".encode() for k, v in fields if v is not None]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def write_record(out, fields: list[tuple[str, object]], payload, chunk: int, level: int) -> None:
    """One gzip member, fed chunk by chunk."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out.write(pack.compress(header([*fields, ("Content-Length", len(payload))])))
    for at in range(0, len(payload), chunk):
        out.write(pack.compress(payload[at : at + chunk]))
    out.write(pack.compress(b"\r\n\r\n"))
    out.write(pack.flush())


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _write(folder: str, date: str, chunk: int, level: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        out, path, records, size, done = None, "", 0, 0, []
        for batch in batches:
            names = batch.schema.names
            for row in zip(*(batch.column(i).to_pylist() if names[i] != "html" else batch.column(i) for i in range(batch.num_columns))):
                x = dict(zip(names, row))
                if out is None:
                    # a name of its own for each attempt: a task that is run again leaves only unlisted files behind
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, records, size = store.open_output_stream(path, compression=None), 0, 0
                payload = memoryview(x["html"].as_buffer()) if x["html"].is_valid else memoryview(b"")
                revisit = x["refers_to"] is not None
                fields = [
                    ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:x-page:{'null' if x['page_id'] is None else x['page_id']}>"), ("WARC-Date", date), ("WARC-Target-URI", x["url"]),
                    ("WARC-Payload-Digest", f"sha1:{x['payload_digest']}"), ("WARC-Refers-To", f"<urn:x-page:{x['refers_to']}>" if revisit else None), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
                    ("X-Payload-Length", len(payload)), ("Content-Type", "text/html; charset=utf-8"),
                ]
                write_record(out, fields, memoryview(b"") if revisit else payload, chunk, level)
                records, size = records + 1, size + (0 if revisit else len(payload))
                if size >= file_bytes:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            yield _rows(done, FILES)

    return run


class _Members:
    """The bytes of a file of gzip members, a bounded piece at a time."""

    def __init__(self, raw, chunk: int):
        self.raw, self.chunk, self.unpack, self.rest, self.buffer = raw, chunk, None, b"", bytearray()

    def _more(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.raw.read(self.chunk)
                if not self.rest and self.unpack is None:
                    return False
            ended = not self.rest  # what the last input held may still be coming out
            if self.unpack is None:
                self.unpack = zlib.decompressobj(31)
            got = self.unpack.decompress(self.rest, self.chunk)
            if self.unpack.eof:  # the unconsumed tail may repeat the unused data here
                self.rest, self.unpack = self.unpack.unused_data, None
            else:
                self.rest = self.unpack.unconsumed_tail
            if got:
                self.buffer += got
                return True
            if ended:
                return False

    def take(self, n: int) -> bytes:
        """n bytes, or fewer at the end."""
        while len(self.buffer) < n and self._more():
            pass
        got = bytes(self.buffer[:n])
        del self.buffer[:n]
        return got

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (end := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                return None
        return self.take(end + len(mark))


def read_records(raw: io.RawIOBase, chunk: int) -> Iterator[tuple[dict[str, str], int, bool, int, "hashlib._Hash", bytes]]:
    """(header, chunk number, last, bytes so far, running SHA-1, bytes) of each chunk of each record."""
    stream = _Members(raw, chunk)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left, seen, number, digest = int(fields["content-length"]), 0, 0, hashlib.sha1()
        while True:
            piece = stream.take(min(chunk, left))
            if len(piece) < min(chunk, left):
                raise ValueError("a WARC record ends early")
            left, seen = left - len(piece), seen + len(piece)
            digest.update(piece)
            yield fields, number, left == 0, seen, digest, piece
            if left == 0:
                break
            number += 1
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is not closed")


def _page(value: str | None) -> int | None:
    text = (value or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _read(chunk: int, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, _ = _filesystem(batch.column(1)[0].as_py())
                rows, size, record = [], 0, -1
                with store.open_input_stream(path, compression=None) as raw:
                    for fields, number, last, seen, digest, piece in read_records(raw, chunk):
                        record += number == 0
                        claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        rows.append(
                            (path, record, fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), _page(fields.get("warc-record-id")), _page(fields.get("warc-refers-to")), claimed, number, last, seen, base32_sha1(digest.digest()) if last else None, piece if with_payload else None)
                        )
                        size += 300 + len(piece) * with_payload
                        if size > 4 << 20:
                            yield _rows(rows, CHUNKS)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows, CHUNKS)

    return run


def revisit_plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to: which page each equal payload of ``min_bytes`` or more revisits.

    Only digests are shuffled; the largest page_id of each digest is joined back on page and digest, and pages are not.
    """
    marked = pages.select("page_id", "html").mapInArrow(_digests, DIGESTS)
    kept = stored(marked.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "original"), "repeated-payloads")
    again = stored(marked.where(F.col("payload_bytes") >= min_bytes).join(kept, "payload_digest").where("page_id < original").select("page_id", "payload_digest", F.col("original").alias("refers_to")).distinct(), "revisits")
    digested = pages.select("page_id", "url", "html").mapInArrow(_with_digest, "page_id long, url string, html string, payload_digest string")
    return digested.join(again, ["page_id", "payload_digest"], "left")


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [base32_sha1(hashlib.sha1(memoryview(x.as_buffer()) if x.is_valid else b"").digest()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "payload_digest"])


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", chunk: int = 1 << 16, level: int = 1, file_bytes: int = 64 << 20) -> DataFrame:
    """Write every row of ``pages(page_id, url, html)`` as a record and return the table of files (path, records, payload_bytes).

    Each task writes its own gzip archives; a file counts only if its task's row arrives here.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    store, base = _filesystem(folder)
    store.create_dir(base, recursive=True)
    return stored(revisit_plan(pages, min_bytes).mapInArrow(_write(folder, date, chunk, level, file_bytes), FILES), "archives").withColumn("folder", F.lit(folder))


def read_archives(files: DataFrame, chunk: int = 1 << 16, with_payload: bool = True) -> DataFrame:
    """The chunked record table of archives: a row for each chunk; the last of a record carries its digest."""
    n = max(1, files.count())
    return files.select("path", "folder").repartition(min(n, 10_000), "path").mapInArrow(_read(chunk, with_payload), CHUNKS)


def warc_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to; a row per page.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is a response and
    the others revisit it; smaller payloads are all responses.  Digests and lengths of responses are computed from
    the chunks read; a revisit has no payload of its own and takes them from the response it refers to, named by page
    and digest.  A null html is empty; a null page_id or url is written without it and is always a response; rows
    repeated under one page_id are planned one by one by payload, equal ones are all responses or all revisits; other columns are ignored; an empty table gives no rows.
    """
    chunks = stored(read_archives(write_archives(pages, min_bytes=min_bytes), with_payload=False).where("last").drop("payload", "target_uri"), "records")
    own = chunks.where("record_type = 'response'").select("page_id", F.col("length_so_far").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    full = own.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = chunks.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.col("digest_claimed").alias("payload_digest")).join(full, ["refers_to", "payload_digest"])
    return own.unionByName(revisits.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
