"""WARC archives as chunked record tables.

Writing: each task streams records into gzip WARC files (one member for each
record) in a shared folder and returns a manifest row for each finished file.
File names are unique to the attempt, and only manifest files are read, so a
task that is run again leaves no doubled records. Of records with equal
payloads (from ``min_revisit_bytes`` up) that with the largest id is a
response; the others become revisit records without the payload.

Reading: an archive becomes rows of (record, chunk number) with at most
``chunk_bytes`` of payload each. Digest and length so far go along with each
chunk; no task holds a whole record, file or archive. The last chunk of a
record carries its full digest, which must equal the declared one.

Defined cases: a null payload is an empty one; an empty payload has one empty
chunk; rows with a null id are records too, below all ids; repeated rows with
the largest id are all responses; a null URL is replaced by the record's own
id; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bound_batches, scratch_path, written

CHUNK_BYTES = 1 << 20
#: A new file is begun beyond this size, as archive tools expect.
FILE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
MANIFEST = "file string, records long, bytes long"
CHUNKS = "file string, record_id string, target_uri string, warc_type string, refers_to string, chunk_no long, data binary, bytes_so_far long, digest_so_far string, payload_bytes long, is_last boolean"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def with_record_types(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_revisit_bytes: int = 0) -> DataFrame:
    """id, url, payload, digest (hex), warc_type, refers_to.

    The largest id of each repeated payload comes from an aggregate with a
    map-side step; a payload that fills a third of the table is split by the
    skew handling of the join that follows.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= min_revisit_bytes
    first = rows.where(long_enough).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(written(first, "warc-first"), "digest", "left")
    again = long_enough & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select("id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("warc_type"), F.when(again, F.col("first")).alias("refers_to"))


def _names(record_id: object) -> str:
    return f"<{_ID}{'' if record_id is None else record_id}>"


def _headers(kind: str, record_id: object, url: str | None, digest: str, refers_to: object, n: int, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    uri = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else _names(record_id)[1:-1]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_names(record_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_names(refers_to)}"]
    lines.append(f"Content-Length: {len(http) + (n if kind == 'response' else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class _Archive:
    """One WARC file, written record by record and chunk by chunk."""

    def __init__(self, fs: pa.fs.FileSystem, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        self.out = fs.open_output_stream(self.path, compression=None)
        self.records = self.bytes = 0

    def put(self, head: bytes, payload: memoryview) -> None:
        member = zlib.compressobj(3, zlib.DEFLATED, 31)
        self._write(member.compress(head))
        for at in range(0, len(payload), CHUNK_BYTES):
            self._write(member.compress(payload[at : at + CHUNK_BYTES]))
        self._write(member.compress(b"\r\n\r\n") + member.flush())
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> dict[str, list]:
        self.out.close()
        return {"file": [self.path], "records": [self.records], "bytes": [self.bytes]}


def write_archives(records: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of with_record_types; returns the manifest table."""
    bound_batches(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        archive = None
        for b in batches:
            ids, urls, kinds, refers, digests = (b.column(c).to_pylist() for c in ("id", "url", "warc_type", "refers_to", "digest"))
            payloads = b.column("payload")
            for i in range(b.num_rows):
                archive = archive or _Archive(fs, path)
                buffer = payloads[i].as_buffer()
                payload = memoryview(buffer if kinds[i] == "response" else b"")
                archive.put(_headers(kinds[i], ids[i], urls[i], base32_sha1(bytes.fromhex(digests[i])), refers[i], buffer.size, date), payload)
                if archive.bytes >= file_bytes:
                    yield pa.RecordBatch.from_pydict(archive.close(), schema)
                    archive = None
        if archive:
            yield pa.RecordBatch.from_pydict(archive.close(), schema)

    return written(records.mapInArrow(write, MANIFEST), "warc-manifest")


class _Stream:
    """Bytes of a gzip file of many members, with a bounded buffer."""

    def __init__(self, raw, piece: int):
        self.raw, self.piece, self.buf = raw, piece, bytearray()
        self.member, self.left = zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while True:
            data = self.left or self.raw.read(self.piece)
            if not data:
                return False
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            got = self.member.decompress(data, self.piece)
            self.left = self.member.unconsumed_tail or (self.member.unused_data if self.member.eof else b"")
            if got:
                self.buf += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with mark; None at the end of the file."""
        while (at := self.buf.find(mark)) < 0:
            if not self._more():
                if self.buf.strip():
                    raise ValueError("a WARC record is cut off")
                return None
        out = bytes(self.buf[: at + len(mark)])
        del self.buf[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        """Between 1 and n bytes."""
        if not self.buf and not self._more():
            raise ValueError("a WARC record is cut off")
        out = bytes(self.buf[:n])
        del self.buf[: len(out)]
        return out


def _field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def record_chunks(raw, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """The chunk rows of one archive, without its file name."""
    s = _Stream(raw, min(chunk_bytes, 1 << 18))
    while (head := s.until(b"\r\n\r\n")) is not None:
        kind, record = _field(head, b"WARC-Type"), _field(head, b"WARC-Record-ID") or ""
        refers, declared = _field(head, b"WARC-Refers-To"), (_field(head, b"WARC-Payload-Digest") or "").rpartition(":")[2]
        uri, length = _field(head, b"WARC-Target-URI"), int(_field(head, b"Content-Length") or 0)
        bare = lambda x: x.strip("<>").removeprefix(_ID) if x else None
        http = s.until(b"\r\n\r\n") or b""
        whole, left = int(_field(http, b"Content-Length") or 0), length - len(http)
        if kind == "revisit":
            yield bare(record), uri, kind, bare(refers), 0, b"", 0, declared, whole, True
        else:
            sha, done, number, held = hashlib.sha1(), 0, 0, bytearray()
            while True:
                while left and len(held) < chunk_bytes:
                    got = s.take(min(left, chunk_bytes - len(held)))
                    held += got
                    left -= len(got)
                sha.update(held)
                done += len(held)
                digest = base32_sha1(sha.digest())
                yield bare(record), uri, kind, bare(refers), number, bytes(held) if with_data else None, done, digest, whole, not left
                number += 1
                held.clear()
                if not left:
                    break
            if digest != declared or done != whole:
                raise ValueError(f"record {record}: payload differs from its declared digest or length")
        if s.until(b"\r\n\r\n") is None:
            raise ValueError("a WARC record is cut off")


def read_chunks(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Chunk rows of all archives in the manifest."""
    files = manifest.select("file")
    tasks = max(1, files.count())
    names = [x.partition(" ")[0] for x in CHUNKS.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[x.partition(" ")[2]]) for n, x in zip(names, CHUNKS.split(", "), strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column("file").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as raw:
                    for r in record_chunks(raw, chunk_bytes, with_data):
                        rows.append((path, *r))
                        size += 200 + len(r[5] or b"")
                        if size >= 4 * CHUNK_BYTES:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema)

    return files.repartition(tasks).mapInArrow(read, CHUNKS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page and read the archives back: one row for each page."""
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(with_record_types(pages), folder)
    last = read_chunks(manifest, folder, with_data=False).where("is_last")
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return last.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest_so_far").alias("payload_digest"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))
