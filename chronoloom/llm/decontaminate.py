"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII
characters. A benchmark window is 13 consecutive words of an item; an item
with fewer words, but not none, is one window. Windows of equal length share a
block shift table: the block of the last two words under a search position
tells how far the position may jump. A jump of 0 sends the position to the
bucket of its suffix hash, and a direct comparison of all words confirms it.
Many positions advance together in numpy lanes.

The benchmark is read in blocks of about ``block_words`` words. One block is
broadcast at a time, however large the benchmark is: before the next block the
documents are written with their hits so far and the last block is destroyed.

Defined cases: null or wordless texts have no words and no hits; items with a
null id or no words take no part; repeated rows are judged alike; rows with
equal item_id are one item; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bound_batches, written

_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LANE = 192
_FOUND = "struct<n_words:bigint,spans:array<struct<a:int,b:int>>,items:array<string>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class _Same:
    """Wu-Manber tables for the windows of one length."""

    def __init__(self, windows: np.ndarray, owners: list[list[int]]):
        self.m = windows.shape[1]
        self.b = min(2, self.m)
        self.bits = int(min(22, max(12, np.ceil(np.log2(max(2, windows.size))) + 3)))
        self.shift = np.full(1 << self.bits, self.m - self.b + 1, np.int16)
        for end in range(self.b - 1, self.m):
            np.minimum.at(self.shift, self.block(windows, end), self.m - 1 - end)
        key = self.suffix(windows.ravel(), np.arange(len(windows)) * self.m + self.m - 1)
        order = np.argsort(key, kind="stable")
        self.windows, self.key, self.owners = windows[order], key[order], [owners[i] for i in order]

    def block(self, rows: np.ndarray, end: int) -> np.ndarray:
        return self._hash(rows[:, end - 1] if self.b == 2 else None, rows[:, end])

    def _hash(self, left, right) -> np.ndarray:
        x = right.astype(np.uint64)
        if left is not None:
            x = x + left.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        return ((x * _MIX) >> np.uint64(64 - self.bits)).astype(np.intp)

    def suffix(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        key = np.zeros(len(ends), np.uint64)
        for back in range(self.m):
            key = (key + ids[ends - back].astype(np.uint64)) * _MIX
            key ^= key >> np.uint64(29)
        return key

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of each occurrence in ids; id 0 matches nothing."""
        n = len(ids)
        if n < self.m:
            return np.zeros(0, np.intp), np.zeros(0, np.intp)
        starts = np.arange(self.m - 1, n, _LANE)
        stops = np.minimum(starts + _LANE, n)
        at, got = starts.copy(), []
        while len(at):
            jump = self.shift[self._hash(ids[at - 1] if self.b == 2 else None, ids[at])]
            if len(hit := at[jump == 0]):
                got.append(hit)
            at = at + np.maximum(jump, 1)
            live = at < stops
            at, stops = at[live], stops[live]
        if not got:
            return np.zeros(0, np.intp), np.zeros(0, np.intp)
        ends = np.concatenate(got)
        key = self.suffix(ids, ends)
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        out_s, out_w = [], []
        while (more := low < high).any():  # buckets with more than one window
            ends, low, high = ends[more], low[more], high[more]
            begin = ends - self.m + 1
            same = (ids[begin[:, None] + np.arange(self.m)] == self.windows[low]).all(1)
            out_s.append(begin[same])
            out_w.append(low[same])
            low = low + 1
        return (np.concatenate(out_s), np.concatenate(out_w)) if out_s else (np.zeros(0, np.intp), np.zeros(0, np.intp))


class Matcher:
    """All windows of one block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocab: dict[bytes, int] = {}
        by_len: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                part = tuple(ids[i : i + window])
                own = by_len.setdefault(len(part), {}).setdefault(part, [])
                if not own or own[-1] != number[name]:
                    own.append(number[name])
        self.same = [_Same(np.array(list(d), np.int64), list(d.values())) for _, d in sorted(by_len.items())]

    def ids(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        get = self.vocab.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def find(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: number of words, hit spans [start, end), item names."""
        each = [self.ids(t) for t in texts]
        gap = np.zeros(1, np.int64)  # no window holds id 0, so none crosses a gap
        flat = np.concatenate([x for e in each for x in (e, gap)]) if each else gap
        first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in each])]).astype(np.intp)
        spans: list[list[tuple[int, int]]] = [[] for _ in each]
        items: list[set[int]] = [set() for _ in each]
        for s in self.same:
            start, win = s.search(flat)
            doc = np.searchsorted(first, start, "right") - 1
            for d, p, w in zip(doc.tolist(), (start - first[doc]).tolist(), win.tolist(), strict=True):
                spans[d].append((p, p + s.m))
                items[d].update(s.owners[w])
        return [(len(e), _union(sp), [self.names[i] for i in sorted(it)]) for e, sp, it in zip(each, spans, items, strict=True)]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size, streamed through the driver."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r["id"], r["text"].encode("utf-8", "replace")))
        size += len(block[-1][1]) // 4 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 1_000_000, out: str = "contamination") -> DataFrame:
    """docs with a struct column ``out``: n_words, spans (hit word ranges,
    end exclusive), items (ids of the items with occurring windows)."""
    spark = docs.sparkSession
    bound_batches(spark)
    result, shared = docs.withColumn(out, F.lit(None).cast(_FOUND)), None
    for block in chain(item_blocks(benchmark, item_id, item_text, block_words), [None]):
        if block is None and shared is not None:
            break  # the extra block is for a benchmark without items
        if shared is not None:
            result = written(result, "hits")
            shared.destroy()
        shared = spark.sparkContext.broadcast(Matcher(block or [], window))  # about block_words words
        result = result.withColumn(out, _searcher(shared)(F.col(text_col), F.col(out)))
    return result


def _searcher(shared):
    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts, before in batches:
            values = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
            rows, part, size = [], [], 0
            for v in values:  # a few MB of text at a time
                part.append(v)
                size += len(v)
                if size > 2_000_000:
                    rows += m.find(part)
                    part, size = [], 0
            rows += m.find(part)
            spans, items = [], []
            for (_, sp, it), old_s, old_i in zip(rows, before["spans"], before["items"], strict=True):
                if old_s is not None and len(old_s):
                    sp = _union(sp + [(x["a"], x["b"]) for x in old_s])
                if old_i is not None and len(old_i):
                    it = sorted(set(it) | set(old_i))
                spans.append([{"a": a, "b": b} for a, b in sp])
                items.append(it)
            yield pd.DataFrame({"n_words": [n for n, _, _ in rows], "spans": spans, "items": items})

    return search.asNondeterministic()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of find_contamination, one row per document."""
    c = find_contamination(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("contamination.spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["b"] - x["a"]).cast("long"))
    return c.select("doc_id", F.col("contamination.n_words").alias("n_words"), hit.alias("n_hit"), F.size("contamination.items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("contamination.items"), ",").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
