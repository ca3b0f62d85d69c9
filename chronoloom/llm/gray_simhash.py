"""SimHash near-duplicates by a hierarchical index in Gray order.

Every text becomes one 64-bit fingerprint of its word shingles. Distinct
fingerprints are then linked at a few differing bits. Where two differ in at
most d bits and the 64 bits are cut into s segments, at least s - d segments
are equal; so for each choice of s - d segments there is one order in which
these bits come first. In each order fingerprints are range-sorted by the Gray
rank of the reordered bits, which brings those that share leading bits, and
differ in few of the next ones, together.

Sorted runs are packed into blocks of bounded size, each with its index: a node
over FAN consecutive children holds the mask of the bits that all of them
share and their pattern; masks grow downwards, so the differences of two nodes
under both masks accumulate on the way down, and as soon as they exceed d, or
touch the leading bits, the whole groups are pruned. Runs of one leading
pattern that go over a block's end are joined part with part, so a crowded
pattern is spread over many tasks. Links leave a task as a spanning forest, not
as all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bound_batches, settings, written
from chronoloom.llm.components import components

#: Rows in a block, and children of an index node.
BLOCK, FAN = 8_192, 8

#: Pairs of nodes that are expanded together.
AT_ONCE = 1 << 15

#: Hashes counted together, over as many texts as they fill.
HASHES = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of so many words, in pieces of bounded length."""
    found = text.translate(_LOWER).split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    del found
    run = min(words, len(ends))
    starts, ends = starts[: len(starts) - run + 1], ends[run - 1 :]
    one = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHES):
        s, e = starts[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist()
        yield np.fromiter((one(joined[a:b], seed) for a, b in zip(s, e, strict=True)), np.uint64, len(s))


def bit_counts(hashes: np.ndarray, lengths: list[int]) -> np.ndarray:
    """How many hashes of each text have each bit set: one row for each text.
    Eight bits are counted at once, a byte each, over at most 255 hashes."""
    counts = np.asarray(lengths, np.int64)
    out = np.zeros((len(counts), 64), np.int64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    first = (np.cumsum(counts) - counts)[some]
    pieces = -(-counts[some] // 255)
    piece_first = np.cumsum(pieces) - pieces
    starts = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(piece_first, pieces))
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        lanes = sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[some, bit::8] = np.add.reduceat(lanes, piece_first, axis=0)
    return out


def _majority(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Fingerprints as longs: a bit is set where over half the hashes set it."""
    bits = (2 * counts > totals[:, None]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.zeros(batch.num_rows, np.int64)
        held: list[np.ndarray] = []
        rows: list[int] = []

        def count() -> None:
            lengths = [len(h) for h in held]
            prints[rows] = _majority(bit_counts(np.concatenate(held), lengths), np.array(lengths))
            held.clear()
            rows.clear()

        for i, text in enumerate(batch.column("text")):
            pieces = shingle_hashes(text.as_py() or b"", words, seed)
            hashes = next(pieces, None)
            if hashes is None:
                continue
            if len(hashes) == HASHES:  # a very long text is counted piece by piece
                total, counts = HASHES, bit_counts(hashes, [HASHES])
                for more in pieces:
                    total, counts = total + len(more), counts + bit_counts(more, [len(more)])
                prints[i] = _majority(counts, np.array([total]))[0]
                continue
            held.append(hashes)
            rows.append(i)
            if sum(map(len, held)) >= HASHES:
                count()
        if held:
            count()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.int64())], names=["id", "print"])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 4, seed: int = 42) -> DataFrame:
    """id, print (the 64 bits as a long; 0 for a text without words)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(partial(_fingerprints, words=words, seed=seed), f"id {dict(texts.dtypes)['id']}, print long")


class BitOrder:
    """One order of the 64 bits: the chosen segments first, then the others."""

    def __init__(self, segments: int, chosen: tuple[int, ...]):
        edges = [64 * i // segments for i in range(segments + 1)]
        order = [*chosen, *(i for i in range(segments) if i not in chosen)]
        self.fields = [(64 - edges[i + 1], edges[i + 1] - edges[i]) for i in order]
        self.lead = sum(width for _, width in self.fields[: len(chosen)])

    def arrange(self, prints: np.ndarray) -> np.ndarray:
        out = np.zeros_like(prints)
        for shift, width in self.fields:
            out = (out << np.uint64(width)) | ((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1))
        return out

    def restore(self, codes: np.ndarray) -> np.ndarray:
        out, left = np.zeros_like(codes), 64
        for shift, width in self.fields:
            left -= width
            out |= ((codes >> np.uint64(left)) & np.uint64((1 << width) - 1)) << np.uint64(shift)
        return out


def bit_orders(segments: int, bits: int) -> list[BitOrder]:
    return [BitOrder(segments, c) for c in combinations(range(segments), segments - bits)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(s))
    return codes


def gray_code(ranks: np.ndarray) -> np.ndarray:
    return ranks ^ (ranks >> np.uint64(1))


#: A long with the same order as an unsigned rank.
_SIGN = np.uint64(1 << 63)


class GrayIndex:
    """Codes in Gray order, and above them nodes of the bits they share."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1]
            at = np.arange(0, len(pattern), FAN)
            first = np.repeat(pattern[at], np.diff([*at, len(pattern)]))
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ first), at)
            self.levels.append((pattern[at] & shared, shared))


def near_pairs(x: GrayIndex, y: GrayIndex, bits: int, lead: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of codes that differ in at most so many bits, none of
    them leading; within one index, x is y, every pair once. Depth first, so
    that what waits stays small."""
    leading = np.uint64(((1 << lead) - 1) << (64 - lead))
    top = max(len(x.levels), len(y.levels)) - 1
    todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, a, b = todo.pop()
        (pa_, ma), (pb, mb) = (z.levels[min(level, len(z.levels) - 1)] for z in (x, y))
        apart = (pa_[a] ^ pb[b]) & ma[a] & mb[b]
        ok = (np.bitwise_count(apart) <= bits) & ((apart & leading) == 0)
        if not level:
            ok &= (a < b) if x is y else True
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if not level:
            yield a, b
            continue
        grow_x, grow_y = level < len(x.levels), level < len(y.levels)
        for at in range(0, len(a), AT_ONCE):
            ca, cb = a[at : at + AT_ONCE, None], b[at : at + AT_ONCE, None]
            kids = np.arange(FAN)
            i = np.repeat(ca * FAN + kids, FAN if grow_y else 1, axis=1) if grow_x else np.repeat(ca, FAN, axis=1)
            j = np.tile(cb * FAN + kids, (1, FAN if grow_x else 1)) if grow_y else np.repeat(cb, FAN, axis=1)
            i, j = i.ravel(), j.ravel()
            there = (i < len(x.levels[min(level - 1, len(x.levels) - 1)][0])) & (j < len(y.levels[min(level - 1, len(y.levels) - 1)][0]))
            if x is y:
                there &= i <= j
            todo.append((level - 1, i[there], j[there]))


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked positions the smaller label, through to the roots."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _forest(order: BitOrder, codes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between fingerprints that hold the labels together."""
    moved = np.flatnonzero(label != np.arange(len(label)))
    prints = order.restore(codes).view(np.int64)
    return prints[moved], prints[label[moved]]


def _ranked(batches: Iterator[pa.RecordBatch], orders: list[BitOrder]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy().astype(np.int64).view(np.uint64)
        for n, order in enumerate(orders):
            ranks = (gray_rank(order.arrange(prints)) ^ _SIGN).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranks), n, np.int32)), pa.array(ranks)], names=["ord", "rank"])


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ord", pa.int32()), ("lead", pa.int64()), ("part", pa.int64()), ("pattern", pa.int64()), ("mask", pa.int64()), ("codes", pa.binary())])
_FOUND_SQL = "a long, b long, ord int, lead long, part long, pattern long, mask long, codes binary"


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(a), f.type) for f in list(_FOUND)[2:]]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], schema=_FOUND)


def _blocks(batches: Iterator[pa.RecordBatch], orders: list[BitOrder], bits: int, block: int) -> Iterator[pa.RecordBatch]:
    """Links within each block of sorted ranks; and, for the patterns at a
    block's two ends, which may go on in other blocks, their codes as a part."""
    task, made = TaskContext.get().partitionId(), 0

    def close(n: int, ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal made
        order, codes = orders[n], gray_code(ranks)
        index, label = GrayIndex(codes), np.arange(len(codes))
        for i, j in near_pairs(index, index, bits, order.lead):
            unite(label, i, j)
        yield _links(*_forest(order, codes, label))
        lead = (ranks >> np.uint64(64 - order.lead)).astype(np.int64)
        for at in sorted({int(lead[0]), int(lead[-1])}):
            made += 1
            part = codes[lead == at]
            pattern, mask = (z.view(np.int64) for z in GrayIndex(part).levels[-1])
            cells = [[None], [None], [n], [at], [(task << 32) + made], pattern, mask, [part.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _FOUND, strict=True)], schema=_FOUND)

    held, now = np.empty(0, np.uint64), None
    for batch in batches:
        order, ranks = batch.column("ord").to_numpy(), batch.column("rank").to_numpy().view(np.uint64) ^ _SIGN
        for n in np.unique(order):
            if now is not None and n != now and len(held):
                yield from close(now, held)
                held = held[:0]
            now, held = int(n), np.concatenate([held, ranks[order == n]])
            while len(held) >= block:
                yield from close(now, held[:block])
                held = held[block:]
    if len(held):
        yield from close(now, held)


def _between(batches: Iterator[pa.RecordBatch], orders: list[BitOrder], bits: int) -> Iterator[pa.RecordBatch]:
    """Links between two parts of one leading pattern."""
    for batch in batches:
        for n, x, y in zip(*[batch.column(c).to_pylist() for c in ("ord", "x", "y")], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            label = np.arange(len(x) + len(y))
            for i, j in near_pairs(GrayIndex(x), GrayIndex(y), bits, orders[n].lead):
                unite(label, i, j + len(x))
            a, b = _forest(orders[n], np.concatenate([x, y]), label)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(prints: DataFrame, bits: int = 4, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect exactly the distinct values of print that
    pairs of at most so many differing bits connect.

    segments: how many the bits are cut into. More of them mean more orders and
    fewer fingerprints under one pattern; by default as few as keep a pattern's
    expected share within a block. Links are the same whatever it is.
    """
    if segments is None:
        rows = prints.count()
        segments = next((s for s in range(bits + 1, bits + 4) if rows >> bit_orders(s, bits)[0].lead <= block), bits + 3)
    orders = bit_orders(segments, bits)
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = prints.select("print").mapInArrow(partial(_ranked, orders=orders), "ord int, rank long")
    ranked = ranked.repartitionByRange(parts, "ord", "rank").sortWithinPartitions("ord", "rank")
    found = written(ranked.mapInArrow(partial(_blocks, orders=orders, bits=bits, block=block), _FOUND_SQL), "gray-blocks")
    parted = found.where("part is not null").select("ord", "lead", "part", "pattern", "mask", "codes")
    several = parted.groupBy("ord", "lead").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    parted = written(parted.join(several, ["ord", "lead"]), "parts")
    other = parted.select("ord", "lead", F.col("part").alias("_part"), F.col("pattern").alias("_pattern"), F.col("mask").alias("_mask"), F.col("codes").alias("y"))
    pairs = parted.withColumnRenamed("codes", "x").join(other, ["ord", "lead"])
    pairs = pairs.where(f"part < _part and bit_count((pattern ^ _pattern) & mask & _mask) <= {bits}").select("ord", "x", "y")
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}):
        across = written(pairs.repartition(parts).mapInArrow(partial(_between, orders=orders, bits=bits), "a long, b long"), "across")
    return found.where("a is not null").select("a", "b").unionByName(across)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, words: int = 4) -> DataFrame:
    """Every row's id, print and component_id, the smallest id that links of
    at most so many differing bits reach.

    A null text and one without words have fingerprint 0, linked like any
    other; one of fewer words is one shingle. Equal fingerprints are linked,
    ties and repeated rows with them; rows with one id are rows each. A null id
    is never the smallest; where a group has no other, component_id is null.
    No rows give no rows; other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = written(rows.groupBy("print").agg(F.min("id").alias("least")), "distinct-prints")
    labels = components(written(links(distinct, bits), "gray-links"))
    placed = distinct.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("comp", F.coalesce("comp", "print"))
    placed = written(placed, "placed")
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    return rows.join(written(placed.join(least, "comp").select("print", "component_id"), "groups"), "print")


def near_report(docs: DataFrame) -> DataFrame:
    rows = near_groups(docs)
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return rows.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")
