"""Document scores of a gated recurrent language model.

Tokens are the words of a lower-cased (A-Z) text and one end token. A GRU in
numpy, trained by truncated backpropagation, predicts the next token through a
class-factored softmax: first the class, then the word within it. Words outside
the short list fall into classes by their last byte, and within such a class
are predicted from exact counts over all training documents, add-0.1, with one
slot for every unseen word. Documents run side by side as lanes, in windows;
the state is carried from window to window, so the score is the log10
probability of the complete document.

Counts come from all training documents: each task sends the distinct words of
a batch of documents with their counts to hash buckets, which answer with the
totals; a frequent word is one row for each batch, so no bucket is hot.

The GRU learns from every token of all training documents. Documents are dealt
to shards of about ``shard_bytes`` by a hash of id and text, and shards to
``rounds`` rounds. In a round every shard trains a copy of the current
parameters on its tokens, and the next parameters are the copies' mean, weighted
by tokens. The mean is taken in whole numbers, so neither the order nor the
partitions of the input matter; sums meet in tasks first, and the driver gets a
fixed number of them. The short list and the classes come from the shards' word
counts (words rarer than one in RARE tokens of a shard are not counted there;
no probability depends on it).

Words are told apart by 64-bit hashes whose low five bits hold the class.

Defined cases: a null or empty text is one end token; a null id counts as ''
for the fold; repeated rows are scored alike, and count as often as they stand
in the table; without training documents all counts are 0 and the model keeps
its first weights; an empty table gives an empty result. Long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bound_batches, crc_mod, one_blas_thread, settings, written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Classes of words outside the short list.
REST = 24
END = np.uint64(31)  # no word has class 31
_BATCH_BYTES = 8 << 20
#: A shard's words that are rarer than one in so many tokens do not compete for
#: the short list.
RARE = 20_000
_FIXED = 1 << 20


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) & ~31 | word[-1] % REST
        return h


_words = _WordHash()


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, text after text, and each text's token count."""
    words = [t.translate(_LOWER).split() for t in texts]
    n = np.array([len(w) + 1 for w in words], np.int64)
    out = np.full(int(n.sum()), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(n) - 1] = False
    out[inside] = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()) - len(texts))
    return out, n


@dataclass
class GatedModel:
    """Parameters of the GRU and of its class-factored output.

    Inputs 0..REST-1 are the classes of other words, then the short list.
    short: sorted hashes; cls and slot: class of each short word and its place
    there; members: by class, rows of word weights."""

    short: np.ndarray
    cls: np.ndarray
    slot: np.ndarray
    sizes: np.ndarray
    p: dict[str, np.ndarray]

    def inputs(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.short, tokens), len(self.short) - 1)
        return np.where(self.short[at] == tokens, at + REST, (tokens & np.uint64(31)).astype(np.int64) % REST)

    def classes(self, x: np.ndarray) -> np.ndarray:
        return np.where(x < REST, x, self.cls[np.maximum(x - REST, 0)])

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        k = h.shape[1]
        g, a = h @ self.p["u"], self.p["x"][x]
        zr = 1 / (1 + np.exp(-(a[:, : 2 * k] + g[:, : 2 * k])))
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
        return n + z * (h - n), (h, g, z, r, n)

    def log_probs(self, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Natural log of P(x | state h), row by row."""
        c = self.classes(x)
        out = _log_softmax_at(h @ self.p["c"].T, self.p["cb"], c)
        for k, rows in _by_class(c, self.sizes):
            out[rows] += _log_softmax_at(h[rows] @ self.p[f"w{k}"].T, self.p[f"b{k}"], self.slot[x[rows] - REST])
        return out


def _log_softmax_at(z: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of z + bias at one column of each row; z is used up."""
    z += bias
    z -= z.max()  # of all rows: their logits lie close together
    picked = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return picked - np.log(z @ np.ones(z.shape[1], z.dtype))


def _softmax_error(z: np.ndarray, bias: np.ndarray, at: np.ndarray, scale: np.float32) -> np.ndarray:
    """Gradient of the scaled cross entropy by z, in place."""
    z += bias
    z -= z.max()
    np.exp(z, out=z)
    z *= (scale / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    z[np.arange(len(z)), at] -= scale
    return z


def _by_class(c: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(c, kind="stable")
    first = np.searchsorted(c[order], np.arange(len(sizes) + 1))
    for k in np.flatnonzero(sizes > 1):
        if first[k + 1] > first[k]:
            yield int(k), order[first[k] : first[k + 1]]


def start_model(words: np.ndarray, freq: np.ndarray, rest: np.ndarray, classes: int, hidden: int, seed: int = 5) -> GatedModel:
    """words: sorted hashes of the short list, the end token among them; freq:
    their counts; rest: counts of other tokens by class. Classes of the short
    list have about equal probability mass."""
    short, freq = words, freq.astype(float)
    order = np.argsort(-freq, kind="stable")
    mass = (np.cumsum(np.sqrt(freq[order])) - np.sqrt(freq[order]) / 2) / np.sqrt(freq).sum()
    cls, slot = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)
    _, dense = np.unique((mass * classes).astype(int), return_inverse=True)
    cls[order] = dense + REST
    sizes = np.bincount(cls, minlength=REST + 1)
    for k in range(REST, len(sizes)):
        own = np.flatnonzero(cls == k)
        slot[own] = np.arange(len(own))
    rng, f = np.random.default_rng(seed), np.float32
    p = {"x": rng.normal(0, 0.1, (REST + len(short), 3 * hidden)).astype(f), "u": rng.normal(0, 0.3 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(f), "c": np.zeros((len(sizes), hidden), f)}
    p["cb"] = np.log(np.bincount(cls, freq, len(sizes)) + np.append(rest[:REST], np.zeros(len(sizes) - REST)) + 0.5).astype(f)
    for k in np.flatnonzero(sizes > 1):
        p[f"w{k}"], p[f"b{k}"] = np.zeros((sizes[k], hidden), f), np.log(freq[cls == k]).astype(f)
    return GatedModel(short, cls, slot, sizes, p)


def model_of(tokens: np.ndarray, short_size: int, classes: int, hidden: int) -> GatedModel:
    """A first model from tokens in memory."""
    values, counts = np.unique(np.append(tokens, END), return_counts=True)
    best = np.sort(np.union1d(np.argsort(-counts, kind="stable")[: short_size - 1], np.flatnonzero(values == END)))
    other = np.ones(len(values), bool)
    other[best] = False
    rest = np.bincount((values[other] & np.uint64(31)).astype(np.int64) % REST, counts[other], REST)
    return start_model(values[best], counts[best], rest, classes, hidden)


def train(model: GatedModel, tokens: np.ndarray, most_lanes: int = 512, window: int = 16, rate: tuple[float, float] = (0.01, 0.0)) -> None:
    """Truncated backpropagation over every token once: gradients within a
    window, state across. rate: at the beginning and at the end."""
    x = model.inputs(np.concatenate([[END], tokens]).astype(np.uint64))
    if len(x) < 2:
        return
    lanes = int(np.clip((len(x) - 1) // 256, 1, most_lanes))
    per = -(-(len(x) - 1) // lanes)
    x = np.resize(x, lanes * per + 1)  # the last lane is filled up from the beginning
    x = x[np.arange(lanes)[:, None] * per + np.arange(per + 1)]
    hidden = model.p["u"].shape[0]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    h, done = np.zeros((lanes, hidden), np.float32), 0
    for at in range(0, per, window):
        grad, h = _window_gradient(model, h, x[:, at : at + window + 1])
        done += 1
        pace = rate[0] + (rate[1] - rate[0]) * at / per + 1e-4
        fix = np.float32(pace * np.sqrt(1 - 0.99**done) / (1 - 0.9**done))
        for k, g in grad.items():
            m, v = moment[k]
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model.p[k] -= fix * m / (np.sqrt(v) + np.float32(1e-6))


def _window_gradient(model: GatedModel, h: np.ndarray, x: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    steps, states = [], []
    for t in range(x.shape[1] - 1):
        h, memo = model.step(h, x[:, t])
        steps.append(memo)
        states.append(h)
    k, n = h.shape[1], len(h)
    flat, target = np.concatenate(states), x[:, 1:].T.ravel()
    scale = np.float32(1 / len(target))
    grad = {}
    c = model.classes(target)
    d = _softmax_error(flat @ model.p["c"].T, model.p["cb"], c, scale)
    grad["c"], grad["cb"], back = d.T @ flat, d.sum(0), d @ model.p["c"]
    for j, rows in _by_class(c, model.sizes):
        some = flat[rows]
        d = _softmax_error(some @ model.p[f"w{j}"].T, model.p[f"b{j}"], model.slot[target[rows] - REST], scale)
        grad[f"w{j}"], grad[f"b{j}"] = d.T @ some, d.sum(0)
        back[rows] += d @ model.p[f"w{j}"]
    gu, gx = np.zeros_like(model.p["u"]), np.zeros_like(model.p["x"])
    dh, rows = np.zeros_like(h), np.empty((len(target), 3 * k), np.float32)
    for t in range(len(steps) - 1, -1, -1):
        old, g, z, r, cand = steps[t]
        dh = dh + back[t * n : (t + 1) * n]
        dn = dh * (1 - z) * (1 - cand * cand)
        dz = dh * (old - cand) * z * (1 - z)
        dr = dn * g[:, 2 * k :] * r * (1 - r)
        np.concatenate([dz, dr, dn], 1, out=rows[t * n : (t + 1) * n])
        dg = np.concatenate([dz, dr, dn * r], 1)
        gu += old.T @ dg
        dh = dh * z + dg @ model.p["u"].T
    read = x[:, :-1].T.ravel()
    order = np.argsort(read, kind="stable")
    first = np.flatnonzero(np.diff(read[order], prepend=-1))
    gx[read[order[first]]] = np.add.reduceat(rows[order], first)
    return grad | {"u": gu, "x": gx}, h


def document_scores(model: GatedModel, tokens: np.ndarray, n: np.ndarray, window: int = 32) -> np.ndarray:
    """log10 P of each document's inputs; documents are lanes, longest first.
    A document starts from the state after an end token."""
    x, out = model.inputs(tokens), np.zeros(len(n))
    order = np.argsort(-n, kind="stable")
    begin = (np.cumsum(n) - n)[order]
    length = n[order]
    end = np.array([np.searchsorted(model.short, END) + REST])
    start, _ = model.step(np.zeros((1, model.p["u"].shape[0]), np.float32), end)
    h = np.repeat(start, len(n), 0)
    at = 0
    while len(n) and at < length[0]:
        states, seen, lane = [], [], []
        for t in range(at, min(at + window, int(length[0]))):
            live = int(np.searchsorted(-length, -t, "left"))  # documents longer than t
            h = h[:live]
            now = x[begin[:live] + t]
            states.append(h)
            seen.append(now)
            lane.append(np.arange(live))
            h, _ = model.step(h, now)
        got = model.log_probs(np.concatenate(states), np.concatenate(seen))
        out += np.bincount(order[np.concatenate(lane)], got, len(n))
        at += window
    return out / np.log(10)


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one blob: a line of names, types and lengths, then the data."""
    head = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in arrays.items())
    return head.encode() + b"\n" + b"".join(a.tobytes() for a in arrays.values())


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    at, out = blob.index(b"\n") + 1, {}
    for part in blob[: at - 1].decode().split(";"):
        name, kind, n = part.split(",")
        out[name] = np.frombuffer(blob, kind, int(n), at)
        at += out[name].nbytes
    return out


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


_PARTS = "bucket int, batch long, blob binary"
_PARTS_SCHEMA = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary())])


def count_and_score(docs: DataFrame, model: GatedModel, buckets: int) -> DataFrame:
    """Rows for word buckets (distinct words of a batch and their training
    counts) and one row for each batch with what its documents need later."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def emit(batch: int, ids: list, held: list[bool], tokens: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        m = shared.value
        score = document_scores(m, tokens, n)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.argsort(tokens, kind="stable")  # buckets are ranges of tokens
        t, d = tokens[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])]))
        tf, t, d = np.diff(np.append(first, len(order))), t[first], d[first]
        word = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        runs, h = np.diff(np.append(word, len(t))), t[word]
        learn = np.add.reduceat(tf * ~np.array(held)[d], word)
        bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        isin = m.short[np.minimum(np.searchsorted(m.short, h), len(m.short) - 1)] == h
        code = np.where(isin, REST, (h & np.uint64(31)).astype(np.int64)).astype(np.uint8)
        rows = [(p, batch, _pack(h=h[a:b], n=_small(learn[a:b]), c=code[a:b])) for p, a, b in zip(bucket[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        names = np.array([0 if i is None else i for i in ids], np.int64)
        info = _pack(ids=names, none=np.array([i is None for i in ids]), held=np.array(held), n=n, score=score, runs=_small(runs), d=_small(d), tf=_small(tf), code=code)
        rows.append((-1 - batch % buckets, batch, info))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTS_SCHEMA, strict=True)], schema=_PARTS_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one_blas_thread()
        number = TaskContext.get().partitionId() << 32
        ids, held, tokens, counts, size = [], [], [], [], 0
        for b in batches:
            texts = [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in b.column("text")]
            names, folds = b.column("id").to_pylist(), b.column("held").to_pylist()
            a = 0
            for i in range(len(texts)):
                size += len(texts[i]) + 64
                if size >= _BATCH_BYTES or i + 1 == len(texts):
                    t, n = token_hashes(texts[a : i + 1])
                    ids += names[a : i + 1]
                    held += folds[a : i + 1]
                    tokens.append(t)
                    counts.append(n)
                    a = i + 1
                if size >= _BATCH_BYTES:
                    yield emit(number, ids, held, np.concatenate(tokens), np.concatenate(counts))
                    number += 1
                    ids, held, tokens, counts, size = [], [], [], [], 0
        if ids:
            yield emit(number, ids, held, np.concatenate(tokens), np.concatenate(counts))

    return docs.select("id", "held", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, _PARTS)


_ANSWERS = "batch long, bucket int, blob binary, n long, v long, rest array<long>"
_ANSWERS_SCHEMA = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("rest", pa.list_(pa.int64()))])


def answer(parts: DataFrame, tasks: int) -> DataFrame:
    """Totals of each word, back to the batches that asked; sums by bucket."""

    def solve(bucket: int, held: list[tuple[int, dict[str, np.ndarray]]]) -> pa.RecordBatch:
        h, n = np.concatenate([x["h"] for _, x in held]), np.concatenate([x["n"].astype(np.int64) for _, x in held])
        values, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(inverse, n, len(values)).astype(np.int64)
        code = np.concatenate([x["c"] for _, x in held])[first]
        known = total > 0
        rest = np.bincount(code[known], 10 * total[known] + 1, REST + 1)[:REST].astype(np.int64)  # tenths: sums do not depend on their order
        rows, at = [], 0
        for batch, x in held:
            rows.append((batch, bucket, _pack(c=_small(total[inverse[at : at + len(x["h"])]])), 0, 0, None))
            at += len(x["h"])
        rows.append((None, bucket, None, int(total.sum()), int(known.sum()), rest.tolist()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ANSWERS_SCHEMA, strict=True)], schema=_ANSWERS_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, batch, blob in zip(b.column("bucket").to_pylist(), b.column("batch").to_pylist(), b.column("blob"), strict=True):
                if bucket < 0:  # a batch's own row passes
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((batch, bucket, blob.as_py(), 0, 0, None), _ANSWERS_SCHEMA, strict=True)], schema=_ANSWERS_SCHEMA)
                    continue
                if bucket != now and held:
                    yield solve(now, held)
                    held = []
                now = bucket
                held.append((batch, _unpack(blob.as_py())))
        if held:
            yield solve(now, held)

    return parts.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _ANSWERS)


_SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def finish(answers: DataFrame, n: int, v: int, rest: list[float], tasks: int) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    all_mass = float(np.log10(n + 0.1 * (v + 1)))
    class_mass = np.append(np.log10(np.array(rest) + 0.1), 0.0)  # and a slot for unseen words

    def solve(info: dict[str, np.ndarray], counts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        c = np.concatenate([x.astype(np.int64) for _, x in sorted(counts, key=lambda y: y[0])])
        word = np.repeat(np.arange(len(c)), info["runs"])
        d, tf, code = info["d"].astype(np.int64), info["tf"].astype(np.int64), info["code"]
        log = np.log10(c + 0.1)
        size = len(info["n"])
        base = np.bincount(d, tf * log[word], size) - info["n"] * all_mass
        known = np.bincount(d, tf * (c > 0)[word], size).astype(np.int64)
        other = np.where(code < REST, log - class_mass[code], 0.0)
        score = info["score"] + np.bincount(d, tf * other[word], size)
        return pa.RecordBatch.from_arrays([pa.array(info["ids"], mask=info["none"]), pa.array(info["held"]), pa.array(info["n"]), pa.array(known), pa.array(np.full(size, n, np.int64)), pa.array(base), pa.array(score)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, info, counts = None, None, []
        for b in batches:
            for batch, bucket, blob in zip(b.column("batch").to_pylist(), b.column("bucket").to_pylist(), b.column("blob"), strict=True):
                if batch != now and info is not None:
                    yield solve(info, counts)
                    info, counts = None, []
                now = batch
                if bucket < 0:
                    info = _unpack(blob.as_py())
                else:
                    counts.append((bucket, _unpack(blob.as_py())["c"]))
        if info is not None:
            yield solve(info, counts)

    rows = answers.where("batch is not null").select("batch", "bucket", "blob")
    return rows.repartition(tasks, "batch").sortWithinPartitions("batch").mapInArrow(run, _SCORES)


def shards(docs: DataFrame, count: int, tasks: int) -> DataFrame:
    """Of each shard: its tokens (32 bits of their hashes), how many, the counts
    of its words and of its tokens by class. docs: id, text."""
    schema = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("classes", pa.list_(pa.int64()))])

    def emit(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        t = np.concatenate(parts)
        values, counts = np.unique(t, return_counts=True)
        often = counts * RARE >= len(t)
        classes = np.bincount((t & np.uint64(31)).astype(np.int64), minlength=32)
        row = (shard, len(t), t.astype(np.uint32).tobytes(), values[often].view(np.int64).tolist(), counts[often].tolist(), classes.tolist())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            ids = b.column("shard").to_numpy()
            texts = [v.as_buffer().to_pybytes() for v in b.column("text")]
            edge = np.append(np.flatnonzero(np.diff(ids, prepend=-1)), len(ids)).tolist()
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                if ids[a] != now and held:
                    yield emit(now, held)
                    held = []
                now = int(ids[a])
                held.append(token_hashes(texts[a:z])[0])
        if held:
            yield emit(now, held)

    rows = docs.withColumn("h", F.xxhash64(F.lit("lm"), "id", "text")).withColumn("shard", F.pmod("h", F.lit(count)))
    rows = rows.select("shard", "h", "id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.repartition(tasks, "shard").sortWithinPartitions("shard", "h", "id").select("shard", "text").mapInArrow(run, "shard long, n long, tokens binary, words array<long>, counts array<long>, classes array<long>")


def _round(rows: DataFrame, model: GatedModel, shard_tokens: int, rate: tuple[float, float]) -> dict[str, np.ndarray] | None:
    """The mean of the copies that the shards train."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size
    names = sorted(model.p)
    low = np.uint64(0xFFFFFFFF)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        total = None
        for b in batches:
            for blob in b.column("tokens"):
                m = shared.value
                own = GatedModel(m.short & low, m.cls, m.slot, m.sizes, {k: v.copy() for k, v in m.p.items()})
                order = np.argsort(own.short, kind="stable")
                own.short, own.cls, own.slot = own.short[order], m.cls[order], m.slot[order]
                own.p["x"] = own.p["x"][np.append(np.arange(REST), order + REST)]
                t = np.frombuffer(blob.as_buffer(), np.uint32).astype(np.uint64)
                train(own, t, rate=rate)
                back = np.empty_like(own.p["x"])
                back[np.append(np.arange(REST), order + REST)] = own.p["x"]
                own.p["x"] = back
                weight = max(1, round(256 * len(t) / shard_tokens))
                got = np.concatenate([np.rint(own.p[k].ravel().astype(np.float64) * _FIXED).astype(np.int64) for k in names]) * weight
                total = np.append(got, weight) if total is None else total + np.append(got, weight)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for blob in b.column("sums"):
                v = np.frombuffer(blob.as_buffer(), np.int64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    # shards are large rows: read and sent to Python one by one
    with settings(spark, {"spark.sql.parquet.enableVectorizedReader": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
        sums = rows.select("tokens").mapInArrow(learn, "sums binary").repartition(8).mapInArrow(add, "sums binary").collect()  # at most 8 rows
    shared.destroy()
    if not sums:
        return None
    total = np.sum([np.frombuffer(bytes(r[0]), np.int64) for r in sums], 0)
    mean, at, out = (total[:-1] / (total[-1] * float(_FIXED))).astype(np.float32), 0, {}
    for k in names:
        out[k] = mean[at : at + model.p[k].size].reshape(model.p[k].shape)
        at += model.p[k].size
    return out


def fit(docs: DataFrame, short_size: int, classes: int, hidden: int, rounds: int, shard_bytes: int, rate: float) -> GatedModel:
    """The GRU, from every token of the rows that are not held (id, text, held)."""
    want = docs.where(~F.col("held")).select("id", "text")
    size = want.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    count = rounds * max(1, round(size / (rounds * shard_bytes)))
    tasks = max(1, min(count, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = written(shards(want, count, tasks), "lm-shards")
    words = rows.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    end = int(END)
    best = [(np.int64(r[0]).view(np.uint64), r[1]) for r in words.where(F.col("word") != end).orderBy(F.desc("n"), "word").limit(short_size - 1).collect()]
    seen = rows.agg(*[F.coalesce(F.sum(F.get("classes", F.lit(i))), F.lit(0)) for i in range(32)]).first()
    short = np.array([w for w, _ in best] + [END], np.uint64)
    freq = np.array([n for _, n in best] + [max(1, seen[end])], np.float64)
    rest = np.array(seen[:REST], np.float64) - np.bincount((short[:-1] & np.uint64(31)).astype(np.int64), freq[:-1], REST)[:REST]
    order = np.argsort(short)
    model = start_model(short[order], freq[order], np.maximum(rest, 0), classes, hidden)
    for k in range(rounds):
        mine = rows.where(F.pmod("shard", F.lit(rounds)) == k)
        model.p = _round(mine, model, max(1, sum(seen) // count), (rate * (1 - k / rounds), rate * (1 - (k + 1) / rounds))) or model.p
    return model


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", short_size: int = 1500, classes: int = 28, hidden: int = 16, rounds: int = 4, shard_bytes: int = 6 << 20, rate: float = 0.01, bucket_bytes: int = 24 << 20) -> DataFrame:
    """One row for each document: id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out.alias("held"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    model = fit(base, short_size, classes, hidden, rounds, shard_bytes, rate)
    buckets = max(1, -(-size // bucket_bytes))
    tasks = max(1, min(buckets, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    answers = written(answer(count_and_score(base, model, buckets), tasks), "word-counts")
    sums = answers.where("batch is null").agg(F.sum("n"), F.sum("v"), *[F.sum(F.get("rest", F.lit(i))) for i in range(REST)]).first()
    rest = [(x or 0) / 10 for x in sums[2:]]
    return finish(answers, sums[0] or 0, sums[1] or 0, rest, tasks)


def score_report(docs: DataFrame) -> DataFrame:
    return score_documents(docs, crc_mod(F.col("doc_id"), 10) == 0).withColumnRenamed("id", "doc_id")
