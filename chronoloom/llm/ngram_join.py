"""Exact Jaccard join of word-shingle sets by a universe partition.

Sets of similar size share a size band. Within a band the universe of shingles
is hashed into segments, a set's part in a segment being its segment subset.
Two sets that link differ in at most D = (|R| + |S|) * (1 - t) / (1 + t)
shingles, so all but D segment subsets agree (pigeonhole). A band's
allocation, chosen by estimated cost, gives some segments one-deletion
neighbourhoods (they catch a difference of one shingle and so count twice) and
leaves the others exact; of the exact ones a set is indexed under its D + 1
cheapest subsets, ordered by estimated frequency, the same order for all sets.
Sets that share a signature are candidates and are verified on whole texts.

The estimates come from a bounded sample (about ``sample_docs`` sets of up to
SAMPLED shingles; larger ones get no deletions); they affect cost, never the
result.

Only components of links are wanted, so a signature's sets are not paired with
each other: equal sets are one node, and ``candidates.connect`` verifies
neighbours round by round before it turns to the pairs that are left. A sketch
of 1024 parity bits bounds the difference of two sets from below and rules out
most of those without their texts.

Shingles, signatures and sets are told apart by 64-bit hashes.

Defined cases: null, empty and wordless texts have no shingles and link with
nothing; rows without an id link with nothing and have no component; rows that
share an id are judged by their own texts; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.candidates import connect, shared_by_two
from chronoloom.llm.common import bound_batches, written
from chronoloom.llm.components import relabelled

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits of the filter that tells which texts are candidates: 16 MB at any size.
_FILTER_BITS = 27
#: Parity bits of a set's sketch.
SKETCH = 1024
#: Sets of more shingles are not sampled.
SAMPLED = 2048


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def _mix(x: np.ndarray, k: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * k
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingles of text i are
    hashes[bounds[i]:bounds[i + 1]]."""
    words = [t.translate(_LOWER).split() for t in texts]
    length = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), np.uint64, int(length.sum()))
    count = np.where(length >= size, length - size + 1, np.minimum(length, 1))
    out = np.empty(int(count.sum()), np.uint64)
    place = np.concatenate([[0], np.cumsum(count)])
    begin = np.concatenate([[0], np.cumsum(length)])
    if len(h) >= size:
        acc = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            acc = _mix(acc + h[i : len(h) - size + 1 + i], _A)
        inside = np.arange(len(acc)) + size <= np.repeat(begin[1:], length)[: len(acc)]
        whole = np.repeat(length >= size, count)
        out[whole] = acc[inside]
    for i in np.flatnonzero((length > 0) & (length < size)):
        acc = np.full(1, length[i], np.uint64)
        for x in h[begin[i] : begin[i + 1]]:
            acc = _mix(acc + x, _A)
        out[place[i]] = acc[0]
    for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
        out[a:b].sort()
    first = np.ones(len(out), bool)
    first[1:] = out[1:] != out[:-1]
    first[place[:-1][count > 0]] = True
    return out[first], np.concatenate([[0], np.cumsum(first)])[place]


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of one whole text."""
    return shingle_sets([(text or "").encode("utf-8", "replace")], size)[0]


def describe_sets(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set: node (its hash), least mixed shingle, sketch of parity bits."""
    n = np.diff(bounds)
    node, least = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    some = n > 0
    mixed = _mix(s, _B)
    if some.any():
        node[some] = np.add.reduceat(mixed, bounds[:-1][some])
        least[some] = np.minimum.reduceat(mixed, bounds[:-1][some])
    bit = np.repeat(np.arange(len(n)) * SKETCH, n) + (_mix(s, _C) & np.uint64(SKETCH - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=len(n) * SKETCH) & 1).astype(np.uint8)
    sketch = np.packbits(odd.reshape(len(n), SKETCH), axis=1).view(">i8").astype(np.int64) if len(n) else np.zeros((0, SKETCH // 64), np.int64)
    return _mix(node + n.astype(np.uint64) * _A, _C).view(np.int64), least.view(np.int64), sketch


@dataclass
class Plan:
    """How sets are indexed: threshold per cent, first size of each band, number
    of one-deletion segments of each band, and shingles frequent in the sample."""

    per_cent: int
    bands: np.ndarray
    deletions: dict[int, int]
    frequent: np.ndarray
    counts: np.ndarray

    def most_apart(self, total: int) -> int:
        return total * (100 - self.per_cent) // (100 + self.per_cent)

    def segments(self, band: int) -> int:
        need = self.most_apart(2 * (int(self.bands[band + 1]) - 1)) + 1
        return need + (need + 1) // 2

    def homes(self, n: int) -> list[int]:
        """Bands in which a set of n shingles is indexed: its own, and the next
        if a set there can link with it."""
        own = int(np.searchsorted(self.bands, n, "right")) - 1
        return [own, own + 1] if 100 * n >= self.per_cent * int(self.bands[own + 1]) else [own]

    def rarity(self, s: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(s), np.uint64)
        at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
        return np.where(self.frequent[at] == s, self.counts[at], np.uint64(0))

    def signatures(self, where: np.ndarray, part: np.ndarray, rare: np.ndarray, band: int, deletions: int | None = None) -> np.ndarray:
        """where (32 bits) deals a shingle to a segment, part adds up to the
        segment subset's hash, rare is the shingle's count in the sample."""
        m, n = self.segments(band), len(part)
        k = min(self.deletions.get(band, 0) if deletions is None else deletions, m - 1)
        largest = min(int(self.bands[band + 1]) - 1, 100 * n // self.per_cent)
        apart = self.most_apart(n + largest)
        seg = (where * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(seg)
        seg, part, rare = seg[order], part[order], rare[order]
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        where, length = seg[first], np.diff(np.append(first, n))
        content, freq = np.add.reduceat(part, first), np.minimum.reduceat(rare, first)
        place = np.uint64((band + 1) * int(_C) % (1 << 64))
        name = lambda c, w: _mix(c + (w + np.uint64(1)) * _A + place, _B)
        out = []
        if k:
            near = where < k
            out.append(name(content[near], where[near]))  # the subset itself
            own = np.repeat(np.arange(len(first)), length)
            out.append(name(content[own[seg < k]] - part[seg < k], seg[seg < k]))  # one shingle less
            missing = np.setdiff1d(np.arange(k, dtype=np.uint64), where[near])
            out.append(name(np.zeros(len(missing), np.uint64), missing))
            content, where, freq, length = content[~near], where[~near], freq[~near], length[~near]
        take = max(0, apart - 2 * k) + 1
        if take < len(content):
            cost = (np.minimum(freq, np.uint64(255)) << np.uint64(56)) | ((np.uint64(255) - np.minimum(length, 255).astype(np.uint64)) << np.uint64(48)) | (_mix(content, _A) >> np.uint64(16))
            pick = np.argpartition(cost, take - 1)[:take]
            content, where = content[pick], where[pick]
        elif take > len(content):  # empty subsets are the dearest; fill up by position
            empty = np.setdiff1d(np.arange(k, m, dtype=np.uint64), where)[: take - len(content)]
            content, where = np.concatenate([content, np.zeros(len(empty), np.uint64)]), np.concatenate([where, empty])
        out.append(name(content, where))
        return np.concatenate(out)


def band_starts(per_cent: int) -> np.ndarray:
    """First sizes of the bands; a band spans the threshold's inverse squared."""
    out, x = [0], 1
    while x < 1 << 40:
        out.append(x)
        x = max(x + 1, math.ceil(x * (100 / per_cent) ** 2))
    return np.array(out, np.int64)


def allocate(sample: list[np.ndarray], total: int, per_cent: int) -> Plan:
    """The plan with the lowest estimated cost for each band, from the sample:
    signatures written plus, weighed more, pairs that would be verified."""
    each = np.sort(np.concatenate(sample)) if sample else np.zeros(0, np.uint64)
    values, counts = np.unique(each, return_counts=True)
    often = counts > 1
    plan = Plan(per_cent, band_starts(per_cent), {}, values[often], counts[often].astype(np.uint64))
    scale = total / max(1, len(sample))
    by_band: dict[int, list[np.ndarray]] = {}
    for s in sample:
        for g in plan.homes(len(s)):
            by_band.setdefault(g, []).append(s)
    for g, sets in by_band.items():
        costs = []
        for k in (0, 1, 2):
            sig = np.concatenate([plan.signatures(_mix(s, _C) >> np.uint64(32), _mix(s, _B), plan.rarity(s), g, k) for s in sets])
            _, n = np.unique(sig, return_counts=True)
            costs.append(len(sig) * scale + 5.0 * float((n * (n - 1)).sum()) * scale * scale)
        plan.deletions[g] = int(np.argmin(costs))
    return plan


def _raw(column: pa.Array) -> list[bytes]:
    return [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in column]


def _groups(texts: list[bytes], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of a few MB together."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    yield at, len(texts)


_FACTS = "id long, k long, n long, node long, least long, sketch array<long>, part binary"


def describe(docs: DataFrame, size: int, sample_share: float) -> DataFrame:
    """Of each row: id, k (text hash), n, node, order key and sketch of its
    set; part: the set itself, if sampled."""
    schema = pa.schema([("id", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("least", pa.int64()), ("sketch", pa.list_(pa.int64())), ("part", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = _raw(batch.column("text")), batch.column("sampled").to_pylist()
            for a, b in _groups(texts):
                s, bounds = shingle_sets(texts[a:b], size)
                node, least, sketch = describe_sets(s, bounds)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * (SKETCH // 64), pa.int32()), pa.array(sketch.ravel()))
                part = [s[x:y].tobytes() if keep[a + i] and 0 < y - x <= SAMPLED else None for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("k").slice(a, b - a), pa.array(np.diff(bounds)), pa.array(node), pa.array(least), flat, pa.array(part, pa.binary())], schema=schema)

    share = F.pmod(F.xxhash64(F.lit("sets"), "k"), F.lit(1 << 30)) / float(1 << 30)
    return docs.select("id", "k", F.col("text").cast("binary").alias("text"), (share < sample_share).alias("sampled")).mapInArrow(run, _FACTS)


def index(docs: DataFrame, plan: Plan, size: int) -> DataFrame:
    """sig, id (node): the signatures of each set; equal sets in a task once."""
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # bounded by the sample
    schema = pa.schema([("sig", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, seen = shared.value, set()
        for batch in batches:
            texts = _raw(batch.column("text"))
            for a, b in _groups(texts):
                s, bounds = shingle_sets(texts[a:b], size)
                node, _, _ = describe_sets(s, bounds)
                rare, seg, part = p.rarity(s), _mix(s, _C) >> np.uint64(32), _mix(s, _B)
                sigs, ids = [], []
                for i, x, y in zip(node.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if x == y or i in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()  # a repeat is then indexed again, which is harmless
                    seen.add(i)
                    for g in p.homes(y - x):
                        sigs.append(p.signatures(seg[x:y], part[x:y], rare[x:y], g))
                        ids.append((i, len(sigs[-1])))
                if sigs:
                    names, counts = zip(*ids, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), counts))], schema=schema)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "sig long, id long")


def _filter_of(ids: DataFrame) -> bytes:
    """A fixed-size bitmap of hashed ids; false positives only cost time."""
    h = F.pmod(F.xxhash64("id"), F.lit(1 << _FILTER_BITS))
    parts = ids.groupBy(F.bitmap_bucket_number(h).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits"))
    out = bytearray((1 << _FILTER_BITS) // 8 + 8192)
    for r in parts.where("k > 0").toLocalIterator():  # the value 0 always passes
        at = (r["k"] - 1) * 4096
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


def _maybe(spark: SparkSession, bits: bytes):
    shared = spark.sparkContext.broadcast(np.frombuffer(bits, np.uint8))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        x = h.to_numpy(np.int64) - 1  # bitmap functions place value v at v - 1
        x = np.where(x < 0, 0, x)
        hit = (shared.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1
        return pd.Series((hit == 1) | (h.to_numpy() == 0))

    return maybe


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, per_cent: int, size: int) -> DataFrame:
    """a, b, linked for each pair of nodes, from their whole texts."""
    spark = pairs.sparkSession
    of = nodes.select(F.col("id").alias("a"), F.col("k").alias("ka")), nodes.select(F.col("id").alias("b"), F.col("k").alias("kb"))
    named = written(pairs.join(of[0], "a").join(of[1], "b"), "named")
    keys = named.select(F.explode(F.array("ka", "kb")).alias("id")).distinct()
    maybe = _maybe(spark, _filter_of(keys))
    texts = docs.where(maybe(F.pmod(F.xxhash64("k"), F.lit(1 << _FILTER_BITS)))).select("k", "text")
    texts = written(texts.join(keys.withColumnRenamed("id", "k"), "k", "left_semi").dropDuplicates(["k"]), "texts")
    rows = named.join(texts.select(F.col("k").alias("ka"), F.col("text").alias("ta")), "ka").join(texts.select(F.col("k").alias("kb"), F.col("text").alias("tb")), "kb")

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                r, s = shingle_set(x, size), shingle_set(y, size)
                both = len(np.intersect1d(r, s, assume_unique=True))
                out.append(both > 0 and 100 * both >= per_cent * (len(r) + len(s) - both))
            yield pd.Series(out, dtype=bool)

    return rows.select("a", "b", similar("ta", "tb").alias("linked"))


def join(docs: DataFrame, per_cent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000) -> DataFrame:
    """id, n_shingles, component_id for each row of docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("k"), F.coalesce(text_col, F.lit("")).alias("text"))
    total = base.count()
    facts = written(describe(base, size, min(1.0, sample_docs / max(1, total))), "sets")
    sample = [np.frombuffer(bytes(r[0]), np.uint64) for r in facts.where("part is not null").select("part").limit(2 * sample_docs).collect()]
    plan = allocate(sample, total, per_cent)
    usable = base.where("id is not null and text != ''")
    known = facts.where("id is not null and n > 0")
    nodes = written(known.groupBy(F.col("node").alias("id")).agg(F.min("k").alias("k"), F.min("n").alias("n"), F.min("least").alias("least"), F.min("sketch").alias("sketch")), "nodes")
    shared = written(shared_by_two(written(index(usable, plan, size), "signatures")), "shared")

    def may_link(x, y) -> Column:
        apart = reduce(lambda a, b: a + b, [F.bit_count(F.get(x("sketch"), F.lit(i)).bitwiseXOR(F.get(y("sketch"), F.lit(i)))) for i in range(SKETCH // 64)])
        fits = F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * per_cent
        return fits & (apart * (100 + per_cent) <= (x("n") + y("n")) * (100 - per_cent))

    labels = connect(shared, nodes, [["least"], ["n"], []], may_link, lambda pairs: verify(pairs, nodes, usable, per_cent, size))
    # the smallest id of each component; only nodes with links or copies move
    own = relabelled(known.select("id", "node"), "node", labels)
    smallest = written(own.groupBy("node").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last").select("node", "first"), "smallest")
    out = relabelled(facts.select("id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("node")).alias("node")), "node", labels)
    return out.join(smallest, "node", "left").select("id", "n_shingles", F.coalesce("first", "id").alias("component_id"))


def join_report(docs: DataFrame) -> DataFrame:
    return join(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
