"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers. A block of rows stores each attribute,
shifted to be non-negative, as bit slices: slice b of attribute d is a bitmap
with a bit for every row. A query's score is a weighted sum of attributes, so
slices are added as bitmaps with carry-save adders (attributes of negative
weight enter complemented, which keeps every addend non-negative; constants
are put back at the end). The k best rows are taken from the most significant
score slice downward with the usual sure / tied bitmaps, and rows tied at the
boundary are resolved exactly by id. Every row is indexed and every score is
exact, so recall is 1.

Blocks of ``block_rows`` rows are indexed once and written; each block of
``block_queries`` queries then meets each index: a stated query set against all
rows, in blocks. Vectors with a component beyond WIDE in size are dealt to
blocks of their own, of ``wide_rows`` rows, whose slices are as many as their
numbers need; their scores are computed in whole numbers of any size.

Defined cases: vectors that are null or hold a null, NaN or infinite component
take no part, nor do null ids; a missing trailing component counts as 0; rows
that share the query's id count as its own row; repeated candidate rows rank
one by one; of repeated query ids the greatest vector asks; fewer candidates
than k give fewer rows; an empty table gives an empty result. Any finite
component is allowed; ranks are exact, and a score that a long cannot hold is
given as the largest or smallest long.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import settings, written

#: Components up to this size give scores that fit a long with up to 2**18
#: dimensions at the scale 256.
WIDE = 2.0**14


def _slices(values: np.ndarray, words: int) -> list[np.ndarray]:
    """Bit slices of non-negative integers [rows, dims] as [dims, words]."""
    out = []
    for b in range(max(1, int(values.max(initial=0)).bit_length())):
        bits = np.packbits(((values >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        wide = np.zeros((bits.shape[0], words * 8), np.uint8)
        wide[:, : bits.shape[1]] = bits
        out.append(wide.view("<u8"))
    return out


class SliceIndex:
    """Bit slices of one block of quantised vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, v = ids[order], vectors[order]
        self.words = max(1, -(-len(ids) // 64))
        self.low = v.min(0) if len(v) else np.zeros(v.shape[1], v.dtype)
        self.span = (v.max(0) if len(v) else self.low) - self.low
        up = _slices(v - self.low, self.words)
        down = _slices(self.span - (v - self.low), self.words)
        depth = max(len(up), len(down))
        empty = np.zeros((v.shape[1], self.words), "<u8")
        pad = lambda s: np.stack(s + [empty] * (depth - len(s)))
        #: [sign, bit, dim, word]
        self.slices = np.stack([pad(up), pad(down)])
        self.used = self.slices.any(3)
        self.valid = np.zeros(self.words * 64, np.uint8)
        self.valid[: len(ids)] = 1
        self.valid = np.packbits(self.valid, bitorder="little").view("<u8")

    def add(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Score slices, least significant first, and the constant to add."""
        sign, size = (query < 0).astype(np.intp), np.abs(query)
        const = int((query * self.low).sum() - (size * self.span * sign).sum())  # object arrays: any size
        dims = np.arange(len(query))
        columns: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            on = dims[((size >> j) & 1).astype(bool)]
            for b in range(self.slices.shape[1]):
                has = on[self.used[sign[on], b, on]]
                if len(has):
                    columns.setdefault(j + b, []).append(self.slices[sign[has], b, has])
        out, weight = [], 0
        while columns:
            x = np.concatenate(columns.pop(weight)) if weight in columns else np.zeros((1, self.words), "<u8")
            while len(x) > 1:  # carry-save: three slices become a sum and a carry
                n = len(x) // 3
                if n:
                    a, b, c, rest = x[:n], x[n : 2 * n], x[2 * n : 3 * n], x[3 * n :]
                    half = a ^ b
                    carry = (a & b) | (half & c)
                    x = np.concatenate([half ^ c, rest])
                else:
                    carry, x = x[:1] & x[1:], x[:1] ^ x[1:]
                columns.setdefault(weight + 1, []).append(carry)
            out.append(x[0])
            weight += 1
        return out, const

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score), ties to the smaller id, without query_id."""
        slices, const = self.add(query)
        sure, tied = np.zeros_like(self.valid), self.valid.copy()
        a, b = np.searchsorted(self.ids, query_id, "left"), np.searchsorted(self.ids, query_id, "right")
        for r in range(a, b):
            tied[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        count = lambda m: int(np.bitwise_count(m).sum())
        for s in reversed(slices):
            both = sure | (tied & s)
            n = count(both)
            if n > k:
                tied = tied & s
            else:
                sure, tied = both, tied & ~s
            if n == k:
                tied = np.zeros_like(tied)
                break
        rows = self._rows(sure)
        rows = np.concatenate([rows, self._rows(tied)[: max(0, k - len(rows))]])  # rows are in id order
        score = [0] * len(rows)
        for w, s in enumerate(slices):
            bits = (s[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
            score = [x + (int(b) << w) for x, b in zip(score, bits, strict=True)]
        return [(int(self.ids[r]), x + const) for r, x in zip(rows, score, strict=True)]

    @staticmethod
    def _rows(mask: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def usable(vec: Column) -> Column:
    inf = float("inf")
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (x != inf) & (x != -inf))


def quantise(rows: list[np.ndarray], scale: int, dims: int, wide: bool) -> np.ndarray:
    """floor(scale * x) of each component; Python integers where they are wide."""
    out = np.zeros((len(rows), dims), object if wide else np.int64)
    for i, r in enumerate(rows):
        if not wide:
            out[i, : len(r)] = np.floor(r * scale)
        else:  # beyond 2**53 doubles are whole numbers, whose products Python has exactly
            out[i, : len(r)] = [math.floor(x * scale) if abs(x) < 2.0**40 else int(x) * scale for x in r.tolist()]
    return out


def ordered(n: int) -> bytes:
    """Bytes in the order of integers of any size."""
    body = abs(n).to_bytes((abs(n).bit_length() + 7) // 8, "big")
    body = len(body).to_bytes(4, "big") + body
    return b"\x01" + body if n >= 0 else b"\x00" + bytes(255 - c for c in body) + b"\xff"


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
    """Runs of rows of one block: block, ids, vectors."""
    now, ids, rows = None, [], []
    for b in batches:
        for block, i, v in zip(b.column("block").to_pylist(), b.column("id").to_pylist(), _vectors(b.column("v")), strict=True):
            if block != now and ids:
                yield now, ids, rows
                ids, rows = [], []
            now = block
            ids.append(i)
            rows.append(v)
    if ids:
        yield now, ids, rows


def _blocked(rows: DataFrame, blocks: int, wide_blocks: int) -> DataFrame:
    """block, id, v in order of blocks; wide vectors have negative blocks."""
    h = F.xxhash64("id", "v")
    block = F.when(F.col("wide"), -1 - F.pmod(h, F.lit(wide_blocks))).otherwise(F.pmod(h, F.lit(blocks)))
    spread = max(1, min(blocks + wide_blocks, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.select(block.alias("block"), "id", "v").repartition(spread, "block").sortWithinPartitions("block")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 8192, block_queries: int = 1024, wide_rows: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query row."""
    spark = rows.sparkSession
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    base = rows.select(F.col(id_col).alias("id"), vec.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    base = base.withColumn("wide", F.exists("v", lambda x: F.abs(x) > WIDE))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    wide = F.col("wide")
    n, n_wide, dims, asks = base.agg(count(~wide), count(wide), F.coalesce(F.max(F.size("v")), F.lit(0)), count(F.col("q"))).first()
    dims = max(1, dims)
    blocks, wide_blocks = max(1, -(-n // block_rows)), max(1, -(-n_wide // wide_rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, vectors in _groups(batches):
            index = SliceIndex(np.array(ids, np.int64), quantise(vectors, scale, dims, block < 0))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pickle.dumps(index)], pa.large_binary())], names=["block", "index"])

    indexes = written(_blocked(base, blocks, wide_blocks).mapInArrow(build, "block long, index binary"), "slice-indexes")
    queries = base.where("q").groupBy("id").agg(F.max(F.struct("v", "wide")).alias("x")).select("id", "x.v", "x.wide")
    ask_blocks = max(1, -(-asks // block_queries))
    queries = queries.select(F.pmod(F.xxhash64("id"), F.lit(ask_blocks)).alias("ask"), "id", "v", "wide").groupBy("ask").agg(F.collect_list(F.struct("id", "v", "wide")).alias("queries"))
    queries = written(queries, "query-blocks")  # block_queries or about as many vectors in a row
    pairs = indexes.withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ask_blocks - 1).cast("long")))).join(queries, "ask")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("by", pa.binary())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob, asked in zip(b.column("block").to_pylist(), b.column("index"), b.column("queries").to_pylist(), strict=True):
                index, out = pickle.loads(blob.as_py()), []
                for q in asked:
                    vector = quantise([np.array(q["v"])], scale, dims, block < 0 or q["wide"])[0]
                    for i, s in index.top(q["id"], vector, k):
                        out.append((q["id"], i, min(max(s, -(2**63)), 2**63 - 1), ordered(s)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)

    spread = max(1, min((blocks + wide_blocks) * ask_blocks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    with settings(spark, {"spark.sql.parquet.enableVectorizedReader": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
        # indexes are large rows: read and sent to Python one by one
        found = written(pairs.repartition(spread, "block", "ask").mapInArrow(search, "query_id long, vec_id long, score long, by binary"), "found")
    w = Window.partitionBy("query_id").orderBy(F.desc("by"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
