"""Event files of training runs: framed, checksummed records of varint messages.

A record is its length (8 bytes), a masked CRC-32C of these, the message, and a
masked CRC-32C of the message, all little-endian. A message holds the time (1,
double), the step (2), and values (5), each with a tag (1) and a scalar (2,
float) or a histogram (5: min, max, num, sum, sum of squares as doubles 1 to 5,
right limits 6 and counts 7 as packed doubles).

Files are read as rows of Spark's binary source, so they may lie in any store,
and parsed in the tasks that got them. A file that ends inside a record, as
after a killed run, gives the records before; a checksum that does not fit is
an error. Folders are named model/run_id/flag.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reflected CRC-32C polynomial and the mask's constant.
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (_POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


_TABLE = _crc_table()


def masked_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _TABLE[(c ^ b) & 255] ^ c >> 8
    c ^= 0xFFFFFFFF
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(message: bytes) -> bytes:
    head = struct.pack("<Q", len(message))
    return head + struct.pack("<I", masked_crc(head)) + message + struct.pack("<I", masked_crc(message))


def frames(data: bytes, path: str = "") -> Iterator[bytes]:
    """The messages of whole records."""
    at = 0
    while at + 12 <= len(data):
        head = data[at : at + 8]
        (size,), (check,) = struct.unpack("<Q", head), struct.unpack_from("<I", data, at + 8)
        if masked_crc(head) != check:
            raise ValueError(f"{path}: the length at byte {at} does not fit its checksum")
        if at + 16 + size > len(data):
            return
        message = data[at + 12 : at + 12 + size]
        if masked_crc(message) != struct.unpack_from("<I", data, at + 12 + size)[0]:
            raise ValueError(f"{path}: the message at byte {at + 12} does not fit its checksum")
        yield message
        at += 16 + size


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, data: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(data)) if kind == 2 else b"") + data


def _double(number: int, x: float) -> bytes:
    return _field(number, 1, struct.pack("<d", x))


def message_of(wall_time: float, step: int, tag: str | None = None, value: float | None = None, limits: list[float] | None = None, counts: list[float] | None = None) -> bytes:
    out = _double(1, wall_time) + _field(2, 0, _varint(step))
    if tag is None:
        return out + _field(3, 2, b"brain.Event:2")
    one = _field(1, 2, tag.encode())
    if limits is not None:
        n = sum(counts)
        histo = _double(1, limits[0] if limits else 0.0) + _double(2, limits[-1] if limits else 0.0) + _double(3, n) + _double(4, 0.0) + _double(5, 0.0)
        one += _field(5, 2, histo + _field(6, 2, struct.pack(f"<{len(limits)}d", *limits)) + _field(7, 2, struct.pack(f"<{len(counts)}d", *counts)))
    else:
        one += _field(2, 5, struct.pack("<f", value))
    return out + _field(5, 2, _field(1, 2, one))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value): integers of varints, bytes of all others."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            size = varint()
        if size is None:
            raise ValueError(f"field {key >> 3} is of the unknown kind {kind}")
        yield key >> 3, data[at : at + size]
        at += size


def _doubles(data: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(data) // 8}d", data))


def values_of(message: bytes) -> Iterator[tuple[float, int, str, float | None, list[float] | None, list[float] | None]]:
    """wall_time, step, tag, value, limits, counts of each value."""
    top = list(fields(message))
    of = {k: v for k, v in top if k in (1, 2)}
    wall_time, step = struct.unpack("<d", of[1])[0] if 1 in of else 0.0, of.get(2, 0)
    step -= (1 << 64) * (step >> 63)
    for value in (v for k, s in top if k == 5 for n, v in fields(s) if n == 1):
        one = dict(fields(value))
        if 2 in one:
            yield wall_time, step, one[1].decode(), struct.unpack("<f", one[2])[0], None, None
        elif 5 in one:
            histo: dict[int, list[float]] = {6: [], 7: []}
            for k, v in fields(one[5]):
                if k in histo:
                    histo[k] += _doubles(v)  # packed, or one by one
            yield wall_time, step, one[1].decode(), None, histo[6], histo[7]


_EVENTS = pa.schema([("path", pa.string()), ("wall_time", pa.float64()), ("step", pa.int64()), ("tag", pa.string()), ("value", pa.float64()), ("limits", pa.list_(pa.float64())), ("counts", pa.list_(pa.float64()))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _EVENTS, strict=True)], schema=_EVENTS)

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows: list[tuple] = []
            for message in frames(content.as_py(), path):
                rows += [(path, *v) for v in values_of(message)]
                if len(rows) >= 4_096:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)


def read_events(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """model, run_id, flag, wall_time, step, tag, value, limits, counts of all
    event files below folder/model/run_id/flag. Scalars have no limits and
    counts, histograms no value."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    rows = files.select("path", "content").mapInArrow(_parse, "path string, wall_time double, step long, tag string, value double, limits array<double>, counts array<double>")
    part = lambda i: F.url_decode(F.element_at(F.split("path", "/"), i))
    return rows.select(part(-4).alias("model"), part(-3).alias("run_id"), part(-2).alias("flag"), *[c for c in rows.columns if c != "path"])


def scalars(events: DataFrame) -> DataFrame:
    """The metric log (model, run_id, flag, epoch, tag, value, wall_time)."""
    return events.where("limits is null").select("model", "run_id", "flag", F.col("step").alias("epoch"), "tag", "value", "wall_time")


def histograms(events: DataFrame, tags: list[str] | None = None) -> DataFrame:
    rows = events.where("limits is not null")
    rows = rows if tags is None else rows.where(F.col("tag").isin(tags))
    return rows.select("model", "run_id", "flag", "tag", "step", "limits", "counts")


def write_events(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (model, run_id, flag, wall_time, step, tag, and value or
    limits and counts) as event files, one for each run, in order of time.
    Returns path, n of what was written.

    A file is written under another name and then moved, so a task that runs
    twice leaves one whole file.
    """
    by = [F.col(c).cast("string").alias(c) for c in ("model", "run_id", "flag")]
    named = rows.select(F.concat_ws("/", *[F.url_encode(c) for c in by]).alias("run"), "wall_time", "step", "tag", "value", "limits", "counts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        now, out, temporary, n = None, None, "", 0

        def closed() -> pa.RecordBatch:
            out.close()
            fs.move(temporary, f"{top}/{now}/events.out")
            return pa.RecordBatch.from_pydict({"path": [f"{now}/events.out"], "n": [n]})

        for batch in batches:
            for run, *event in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if run != now:
                    if out:
                        yield closed()
                    now, n, temporary = run, 0, f"{top}/{run}/.events-{uuid.uuid4().hex}"
                    fs.create_dir(f"{top}/{run}", recursive=True)
                    out = fs.open_output_stream(temporary)
                    out.write(frame(message_of(event[0], 0)))
                out.write(frame(message_of(*event)))
                n += 1
        if out:
            yield closed()

    return named.repartition("run").sortWithinPartitions("run", "wall_time", "step", "tag").mapInArrow(write, "path string, n long")
