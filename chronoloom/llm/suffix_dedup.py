"""Removal of long repeated byte strings by a distributed, sparse suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else in the input. Sorting every suffix would multiply the input, so suffixes
are thinned out first, without loss:

1. Every window of ``length`` bytes picks an anchor in itself: the position
   with the smallest hash of 8 bytes whose 96-byte k-gram still lies in the
   window. Equal windows pick the same place, so a repeated window has an
   anchor whose k-gram is repeated. K-grams are counted (with a map-side step)
   and only anchors of repeated ones stay.
2. The stretch of text around each remaining anchor, all the windows that
   picked it, is dealt out by range of the leading bytes of its suffix, with
   splitters from a bounded sample, so equal strings never straddle a boundary.
   A k-gram with more than ``crowd`` anchors is dealt on by digests of whole
   windows instead, which spreads it over all buckets.
3. Buckets sort the windows by multikey quicksort (leading word, then digest)
   and compare neighbours byte by byte; equal neighbours are repeats.
4. Ranges of repeats are joined to their texts, united and cut out.

Texts that occur more than once repeat entirely; only one of them takes part
in 2 and 3. Texts are told apart by 128-bit hashes.

Defined cases: null is an empty text; texts shorter than ``length`` stay whole;
rows with equal texts, repeated rows and rows with null ids are all judged by
their text; matches never cross texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import bound_batches, written

KGRAM = 96
_BASE, _BASE2 = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: Texts are worked on in slices of so many bytes, which bounds a task's memory.
_SLICE = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = have = (np.cumprod(up), np.cumprod(down))
    return have


class Digests:
    """Digests of substrings of a buffer, from prefix sums modulo 2**64."""

    def __init__(self, buf: np.ndarray, base: int = _BASE):
        up, self.down = _power(len(buf) + 1, base)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, n: int) -> np.ndarray:
        x = (self.sums[start + n] - self.sums[start]) * self.down[start]
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)


def _words_at(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as an unsigned integer (unaligned view)."""
    return np.ndarray((max(0, len(buf) - 7),), "<u8", buf.data, 0, (1,))


def anchors(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) over the windows of one buffer."""
    span, n = length - KGRAM + 1, len(buf) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    h = _words_at(buf)[: n + span - 1] * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    bits = np.uint64(max(1, len(h).bit_length()))
    v = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(v) // span)
    wide = np.full(blocks * span, np.uint64(2**64 - 1))
    wide[: len(v)] = v
    wide = wide.reshape(blocks, span)
    right = np.minimum.accumulate(wide, 1).ravel()
    left = np.minimum.accumulate(wide[:, ::-1], 1)[:, ::-1].ravel()
    at = (np.minimum(left[:n], right[span - 1 : span - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.append(first[1:], n) - 1


def kgram_keys(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Order-preserving in the leading three bytes, then a hash of the k-gram."""
    lead = (buf[at].astype(np.uint64) << np.uint64(56)) | (buf[at + 1].astype(np.uint64) << np.uint64(48)) | (buf[at + 2].astype(np.uint64) << np.uint64(40))
    return ((lead | (Digests(buf).of(at, KGRAM) >> np.uint64(24))) ^ np.uint64(1 << 63)).view(np.int64)


def pieces(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """A text in slices that overlap so that each window lies in one."""
    for at in range(0, max(1, len(text) - length + 1), _SLICE):
        yield at, np.frombuffer(text[at : at + _SLICE + length - 1], np.uint8)


def _bytes(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """kg, k1, at: each anchor of each text; equal texts in one task once."""
    schema = pa.schema([("kg", pa.int64()), ("k1", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out, held = [], 0
            for k1, k2, t in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text"), strict=True):
                if (k1, k2) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add((k1, k2))
                for begin, buf in pieces(_bytes(t), length):
                    at, _, _ = anchors(buf, length)
                    out.append((kgram_keys(buf, at), np.full(len(at), k1, np.int64), at + begin))
                    held += len(at)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)
                    out, held = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    # distinct: the same text in two tasks is one text
    return texts.select("k1", "k2", "text").mapInArrow(run, "kg long, k1 long, at long")


def stretches(texts: DataFrame, splitters: np.ndarray, length: int) -> DataFrame:
    """The suffix rows: bucket, kg, k1, k2, start and the bytes that all the
    windows of a remaining anchor cover; crowded anchors give window digests."""
    shared = texts.sparkSession.sparkContext.broadcast(splitters)  # bounded by the sample
    schema = pa.schema([("bucket", pa.int32()), ("kg", pa.int64()), ("second", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("part", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for b in batches:
            rows, held = [], 0
            for k1, k2, t, at, crowded in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text"), b.column("at"), b.column("crowded"), strict=True):
                text, at = _bytes(t), np.sort(at.values.to_numpy())
                crowded = np.sort(crowded.values.to_numpy())
                for begin, buf in pieces(text, length):
                    a, lo, hi = anchors(buf, length)
                    keep = np.isin(a + begin, at)
                    busy = np.isin(a + begin, crowded)
                    a, lo, hi, busy = a[keep], lo[keep], hi[keep], busy[keep]
                    if not len(a):
                        continue
                    keys = kgram_keys(buf, a)
                    raw = buf.tobytes()
                    for key, g, x, y, many in zip(keys.tolist(), np.searchsorted(cuts, keys).tolist(), lo.tolist(), hi.tolist(), busy.tolist(), strict=True):
                        if many:
                            w = np.arange(x, y + 1)
                            one, two = Digests(buf).of(w, length).view(np.int64), Digests(buf, _BASE2).of(w, length).view(np.int64)
                            rows += [(int(p % (len(cuts) + 1)), int(p), int(q), k1, k2, begin + int(s), None) for p, q, s in zip(one, two, w, strict=True)]
                            held += 60 * len(w)
                        else:
                            rows.append((g, key, 0, k1, k2, begin + x, raw[x : y + length]))
                            held += y + length - x + 60
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts.select("k1", "k2", "text", "at", "crowded").mapInArrow(run, "bucket int, kg long, second long, k1 long, k2 long, start long, part binary")


def multikey_order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: sort by the first key, then only within ties by the
    next. Returns the order and, for each place, whether it ties with the
    place before in all keys."""
    order = np.argsort(keys[0], kind="quicksort")
    tied = np.concatenate([[False], keys[0][order][1:] == keys[0][order][:-1]])
    for key in keys[1:]:
        inside = tied | np.append(tied[1:], False)
        at = np.flatnonzero(inside)
        group = np.cumsum(~tied)[at]
        sub = order[at]
        again = np.lexsort((key[sub], group))
        order[at] = sub[again]
        group, value = group[again], key[order[at]]
        tied = np.zeros(len(order), bool)
        tied[at[1:]] = (group[1:] == group[:-1]) & (value[1:] == value[:-1]) & (at[1:] == at[:-1] + 1)
    return order, tied


def repeated_windows(parts: list[bytes], length: int) -> np.ndarray:
    """For the windows of all parts, laid end to end: which are repeated."""
    sizes = np.array([len(p) for p in parts], np.int64)
    buf = np.frombuffer(b"".join(parts), np.uint8)
    counts = sizes - length + 1
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    w = np.arange(counts.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    word = _words_at(buf)
    digest, at, a = np.empty(len(w), np.uint64), 0, 0
    for b in [*(np.flatnonzero(np.diff(begin // _SLICE)) + 1).tolist(), len(parts)]:
        if b > a:  # parts of one slice
            piece = Digests(buf[begin[a] : begin[b - 1] + sizes[b - 1]])
            n = int(counts[a:b].sum())
            digest[at : at + n] = piece.of(w[at : at + n] - begin[a], length)
            at, a = at + n, b
    order, tied = multikey_order([word[w], digest])
    del digest
    at = np.flatnonzero(tied)
    same = np.ones(len(at), bool)
    for off in [*range(8, length - 7, 8), length - 8]:  # byte by byte, eight at a time
        same &= word[w[order[at]] + off] == word[w[order[at - 1]] + off]
    at = at[same]
    out = np.zeros(len(w), bool)
    out[order[at]] = True
    out[order[at - 1]] = True
    return out


def _ranges(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1 + length).tolist(), strict=True))


def repeats(rows: DataFrame, length: int, tasks: int) -> DataFrame:
    """k1, k2, start, stop: ranges of bytes that repeated windows cover."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def solve(held: list[tuple]) -> pa.RecordBatch:
        out = []
        whole = [r for r in held if r[5] is not None]
        if whole:
            hit, at = repeated_windows([r[5] for r in whole], length), 0
            for _, _, k1, k2, start, part in whole:
                n = len(part) - length + 1
                out += [(k1, k2, start + a, start + b) for a, b in _ranges(hit[at : at + n], length)]
                at += n
        single = sorted(r[:5] for r in held if r[5] is None)
        for i, r in enumerate(single):
            if (i and single[i - 1][:2] == r[:2]) or (i + 1 < len(single) and single[i + 1][:2] == r[:2]):
                out.append((r[2], r[3], r[4], r[4] + length))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for g, *r in zip(*columns, strict=True):
                if g != bucket and held:
                    yield solve(held)
                    held = []
                bucket = g
                held.append(tuple(r))
        if held:
            yield solve(held)

    return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "k1 long, k2 long, start long, stop long")


def _cut(spark: SparkSession):
    @F.pandas_udf("n_removed bigint, n_spans bigint, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            out = []
            for t, sp in zip(texts, spans, strict=True):
                if t is None or sp is None:
                    out.append((0, 0, None))
                    continue
                gone, n, kept, at = 0, 0, [], 0
                for a, b in sorted((x["start"], x["stop"]) for x in sp):
                    if a > at or not n:
                        kept.append(t[at:a])
                        n += 1
                        gone += b - a
                        at = b
                    elif b > at:
                        gone += b - at
                        at = b
                kept.append(t[at:])
                out.append((gone, n, b"".join(kept)))
            yield pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    return cut.asNondeterministic()


def dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", crowd: int = 50_000, bucket_bytes: int = 3 << 20) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (remaining bytes) for each row."""
    spark = docs.sparkSession
    bound_batches(spark)
    if length < KGRAM + 16:
        raise ValueError(f"length must be at least {KGRAM + 16}")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit("second"), "text"))
    long_enough = base.where(F.octet_length("text") >= length)
    copies = long_enough.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    copies = written(copies.select("k1", "k2", "first"), "copies")
    found = written(anchor_rows(long_enough, length), "anchors")
    # the same text in two tasks gives equal rows: count texts and places once
    counts = found.groupBy("kg").agg(F.count("*").alias("n"), F.min(F.struct("k1", "at")).alias("lo"), F.max(F.struct("k1", "at")).alias("hi")).where("lo != hi").select("kg", "n")
    counts = written(counts, "kgrams")
    left = found.join(counts, "kg").groupBy("k1").agg(F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("n") > crowd, F.col("at"))).alias("crowded"))
    left = written(left, "left")
    total = counts.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total * 3 * length // (2 * bucket_bytes)))
    sample = counts.where("n <= {}".format(crowd)).where(F.rand(7) < min(1.0, 40_000 / max(1, counts.count()))).select("kg", "n").limit(80_000).collect()
    splitters = _splitters([tuple(r) for r in sample], buckets)
    one = copies.groupBy("k1").agg(F.min("first").alias("first"))
    left = left.join(one, "k1", "left")
    joined = long_enough.join(left, "k1").where(F.col("first").isNull() | (F.col("id") == F.col("first")))
    tasks = max(1, min(len(splitters) + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (len(splitters) + 1) // 4)))
    ranges = written(repeats(stretches(joined, splitters, length), length, tasks), "ranges")
    spans = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = spans.join(copies.select("k1", "k2", F.lit(True).alias("copied")), ["k1", "k2"], "full")
    spans = written(spans, "spans")
    rows = base.join(spans, ["k1", "k2"], "left")
    part = F.col("copied").isNull() & F.col("spans").isNotNull()
    rows = rows.withColumn("c", _cut(spark)(F.when(part, F.col("text")), F.when(part, F.col("spans"))))
    n = F.octet_length("text").cast("long")
    gone = F.col("copied").isNotNull()
    return rows.select(
        "id",
        n.alias("n_bytes"),
        F.when(gone, n).otherwise(F.col("c.n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.col("c.n_spans")).cast("long").alias("n_spans"),
        F.when(gone, F.lit(b"")).when(part, F.col("c.kept")).otherwise(F.col("text")).alias("kept"),
    )


def _splitters(sample: list[tuple[int, int]], buckets: int) -> np.ndarray:
    if not sample or buckets < 2:
        return np.zeros(0, np.int64)
    sample.sort()
    load = np.cumsum([n for _, n in sample])
    want = np.arange(1, buckets) * load[-1] / buckets
    return np.unique(np.array([k for k, _ in sample], np.int64)[np.minimum(np.searchsorted(load, want), len(load) - 1)])


def dedup_report(docs: DataFrame) -> DataFrame:
    return dedup(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """The same by a table of all strings; for small inputs."""
    seen: dict[bytes, int] = {}
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
