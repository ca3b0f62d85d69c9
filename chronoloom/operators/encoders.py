"""Temporal graph encoders and link predictors (inference).

Neighbour sums are joins and aggregations; dense layers and recurrences are
numpy kernels over Arrow batches. Weights are plain dicts of arrays of fixed
size and travel as broadcast variables.

Sequence tables hold, for each node, its vectors in order of the years:
(node, xs array<array<double>>). Pairs to score are (src, tgt, pos): pos is the
position of the year among n_years.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.lineage import cut, shuffles_dropped
from chronoloom.functions.vectors import lists, map_batches, matrix, summed, width_of
from chronoloom.operators.graph import Enclosed, around, enclosed, induced, k_hop, propagate, role_labels, weighted_by_time

Weights = dict[str, np.ndarray]


def init(seed: int, shapes: dict[str, tuple[int, ...]]) -> Weights:
    """Uniform weights scaled by fan-in; the same for the same seed."""
    rng = np.random.default_rng(seed)
    return {k: rng.uniform(-1, 1, s) / np.sqrt(s[0]) for k, s in sorted(shapes.items())}


def hashed(seed: int, shapes: dict[str, tuple[int, ...]]) -> Weights:
    """As init, with the random numbers of ``functions.hashing``, which SQL can
    repeat: each weight is drawn by seed, name and position."""
    one = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0
    return {k: np.array([2 * one(seed, k, *i) - 1 for i in np.ndindex(s)]).reshape(s) / np.sqrt(s[0]) for k, s in shapes.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def norm_rows(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps)


def _kinds(rows: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def dense(rows: DataFrame, fn: Callable[[np.ndarray, Weights], np.ndarray], weights: Weights, col: str = "x", keys: tuple[str, ...] = ("node",)) -> DataFrame:
    """rows (keys, col) with col replaced by fn of the stacked vectors."""

    def run(batch: pa.RecordBatch, w: Weights) -> Iterator[dict]:
        yield {k: batch.column(k) for k in keys} | {col: lists(fn(matrix(batch.column(col)), w))}

    return map_batches(rows.select(*keys, col), run, weights, f"{_kinds(rows, keys)}, {col} array<double>")


def _spread(features: DataFrame, years: list[int]) -> DataFrame:
    return features.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))


def _zeros(width: int):
    return F.array(*[F.lit(0.0)] * width)


def _received(adj: DataFrame, x: DataFrame, every: DataFrame, width: int) -> DataFrame:
    """every (year, node) with x, what the node receives, zeros from nobody."""
    return every.join(propagate(adj, x, width=width), ["year", "node"], "left").withColumn("x", F.coalesce("x", _zeros(width)))


def reduce_shapes(dims: int, out: int) -> dict[str, tuple[int, ...]]:
    return {"r_w0": (dims, 2 * out), "r_b0": (2 * out,), "r_w1": (2 * out, out), "r_b1": (out,), "r_w2": (out, out), "r_b2": (out,)}


def reduce(features: DataFrame, weights: Weights) -> DataFrame:
    """node, x: wide features through three dense layers, relu between them."""

    def run(x: np.ndarray, p: Weights) -> np.ndarray:
        return relu(relu(x @ p["r_w0"] + p["r_b0"]) @ p["r_w1"] + p["r_b1"]) @ p["r_w2"] + p["r_b2"]

    return dense(features, run, {k: v for k, v in weights.items() if k.startswith("r_")})


def gcn(adj: DataFrame, features: DataFrame, years: list[int], weights: Weights, layers: int = 2) -> DataFrame:
    """year, node, x. Each layer is A_t (X W) + b with relu between layers;
    nodes without edges get the bias. features: node, x (same in each year)."""
    every = _spread(features.select("node"), years)
    h = dense(features, lambda v, p: v @ p["w"], {"w": weights["w0"]})
    for i in range(layers):
        b, rows = weights[f"b{i}"], _received(adj, h, every, weights[f"w{i}"].shape[1])
        if i + 1 < layers:  # one Python process for a task, not one for each step
            h = dense(rows, lambda v, p: relu(v + p["b"]) @ p["w"], {"b": b, "w": weights[f"w{i + 1}"]}, keys=("year", "node"))
    return rows.select("year", "node", F.zip_with("x", F.array(*[F.lit(float(v)) for v in b]), lambda v, c: v + c).alias("x"))


def gat_layer(edges: DataFrame, features: DataFrame, weights: Weights, heads: int, slope: float = 0.2) -> DataFrame:
    """year, node, x: multi-head attention from source to target with self
    loops; heads side by side. features: year, node, x.

    All heads share one join and one aggregation: an edge carries a logit for
    each head, and the sums of a target are columns of all heads. A logit rises
    with the source's part, so a target's largest one is known from the largest
    part among its sources, before any vector moves along an edge."""
    n = weights["w0"].shape[1]
    features = cut(features)
    loops = features.select("year", F.col("node").alias("src"), F.col("node").alias("tgt")).distinct()
    pairs = edges.select("year", "src", "tgt").where("src != tgt").unionByName(loops)

    def project(x: np.ndarray, p: Weights) -> np.ndarray:
        h = [x @ p[f"w{k}"] for k in range(heads)]
        return np.concatenate([*h, *[(v @ p[f"{side}{k}"])[:, None] for side in "ad" for k, v in enumerate(h)]], 1)

    h = cut(dense(features, project, weights, keys=("year", "node")))
    at = lambda k: F.get("x", F.lit(heads * n + k))
    source = h.select("year", F.col("node").alias("src"), F.slice("x", 1, heads * n).alias("h"), *[at(k).alias(f"s{k}") for k in range(heads)])
    target = h.select("year", F.col("node").alias("tgt"), *[at(heads + k).alias(f"d{k}") for k in range(heads)])
    logit = lambda s: F.when(s > 0, s).otherwise(s * slope)
    top = pairs.join(source.drop("h"), ["year", "src"]).groupBy("year", "tgt").agg(*[F.max(f"s{k}").alias(f"m{k}") for k in range(heads)])
    target = cut(target.join(top, ["year", "tgt"]))
    e = pairs.join(source, ["year", "src"]).join(target, ["year", "tgt"]).withColumnRenamed("tgt", "node")
    e = e.withColumns({f"u{k}": F.exp(logit(F.col(f"s{k}") + F.col(f"d{k}")) - logit(F.col(f"m{k}") + F.col(f"d{k}"))) for k in range(heads)})
    sums = e.groupBy("year", "node").agg(*[F.sum(F.col(f"u{i // n}") * F.col("h")[i]).alias(f"v{i}") for i in range(heads * n)], *[F.sum(f"u{k}").alias(f"z{k}") for k in range(heads)])
    return sums.select("year", "node", F.array(*[F.col(f"v{i}") / F.col(f"z{i // n}") for i in range(heads * n)]).alias("x"))


def gat(edges: DataFrame, features: DataFrame, years: list[int], weights: Weights, heads: int = 4) -> DataFrame:
    """Two layers: heads side by side with relu, then one head."""
    first = gat_layer(edges, _spread(features, years), {k[2:]: v for k, v in weights.items() if k.startswith("1_")}, heads)
    first = first.withColumn("x", F.transform("x", lambda v: F.greatest(v, F.lit(0.0))))
    return gat_layer(edges, first, {k[2:]: v for k, v in weights.items() if k.startswith("2_")}, 1)


def sequences(encoded: DataFrame) -> DataFrame:
    """node, xs in order of years."""
    return encoded.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("year", "x"))).alias("s")).select("node", F.transform("s", lambda v: v["x"]).alias("xs"))


def gru_states(x: np.ndarray, p: Weights, prefix: str) -> np.ndarray:
    """[nodes, years, dims] -> [nodes, years, hidden]; gates r, z, n."""
    wi, wh, bi, bh = (p[prefix + k] for k in ("wi", "wh", "bi", "bh"))
    k = wh.shape[0]
    h, out = np.zeros((len(x), k)), []
    for t in range(x.shape[1]):
        a, g = x[:, t] @ wi + bi, h @ wh + bh
        r, z = sigmoid(a[:, :k] + g[:, :k]), sigmoid(a[:, k : 2 * k] + g[:, k : 2 * k])
        n = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
        h = (1 - z) * n + z * h
        out.append(h)
    return np.stack(out, 1)


def bi_gru(x: np.ndarray, p: Weights) -> np.ndarray:
    return np.concatenate([gru_states(x, p, "f_"), gru_states(x[:, ::-1], p, "b_")[:, ::-1]], 2)


def over_years(seqs: DataFrame, fn: Callable[[np.ndarray, Weights], np.ndarray], weights: Weights) -> DataFrame:
    """node, pos, z: fn over the stacked sequences of a batch of nodes."""

    def run(batch: pa.RecordBatch, w: Weights) -> Iterator[dict]:
        xs = batch.column("xs")
        z = fn(matrix(xs.flatten()).reshape(len(xs), len(xs[0]), -1), w)
        n, t, _ = z.shape
        yield {"node": batch.column("node").take(pa.array(np.repeat(np.arange(n), t))), "pos": pa.array(np.tile(np.arange(t, dtype=np.int32), n)), "z": lists(z.reshape(n * t, -1))}

    return map_batches(seqs.select("node", "xs"), run, weights, "node long, pos int, z array<double>")


def gru_shapes(dims: int, hidden: int, prefixes: tuple[str, ...] = ("f_", "b_")) -> dict[str, tuple[int, ...]]:
    return {p + k: s for p in prefixes for k, s in {"wi": (dims, 3 * hidden), "wh": (hidden, 3 * hidden), "bi": (3 * hidden,), "bh": (3 * hidden,)}.items()}


def node_gru(encoded: DataFrame, weights: Weights, bidirectional: bool = True) -> DataFrame:
    """The recurrent encoder over yearly node vectors: node, pos, z."""
    return over_years(sequences(encoded), bi_gru if bidirectional else (lambda x, p: gru_states(x, p, "f_")), weights)


def tna_shapes(dims: int, hidden: int, out: int) -> dict[str, tuple[int, ...]]:
    """Two blocks; each gives vectors of twice its width, which the next takes."""
    shapes = {}
    for i, (n, c) in enumerate(((dims, hidden), (2 * hidden, out)), 1):
        one = {"w": (n, c), "b": (c,), **gru_shapes(c, c), "skip": (3 * c, 2 * c), "skip_b": (2 * c,)}
        shapes |= {f"{i}_{k}": s for k, s in one.items()}
    return shapes


def tna_block(x: np.ndarray, p: Weights) -> np.ndarray:
    """Bias, relu, layer norm; two-way recurrence; skip, leaky relu, layer norm."""
    h = norm_rows(relu(x + p["b"]))
    y = np.concatenate([bi_gru(h, p), h], 2) @ p["skip"] + p["skip_b"]
    return norm_rows(np.where(y >= 0, y, 0.01 * y))


def tna(adj: DataFrame, features: DataFrame, years: list[int], weights: Weights) -> DataFrame:
    """node, pos, z of stacked temporal neighbourhood aggregation: each block
    convolves every year's graph and then runs over the years, and what it
    gives a node in a year is that year's input of the next block."""
    every, x, z = cut(_spread(features.select("node"), years)), features.select("node", "x"), None
    for i in range(1, 1 + sum(k.endswith("_skip") for k in weights)):
        p = {k[2:]: v for k, v in weights.items() if k.startswith(f"{i}_")}
        h = dense(x, lambda v, q: v @ q["w"], {"w": p["w"]}, keys=tuple(c for c in ("year", "node") if c in x.columns))
        z = cut(over_years(sequences(_received(adj, h, every, p["w"].shape[1])), tna_block, p))
        x = z.select("node", F.element_at(F.array(*[F.lit(y) for y in years]), F.col("pos") + 1).alias("year"), F.col("z").alias("x"))
    return z


def evolve(weight: np.ndarray, summary: np.ndarray, p: Weights) -> np.ndarray:
    """The next weight matrix: a matrix GRU fed with the mean node vector."""
    s = np.repeat(summary[:, None], weight.shape[1], 1)
    u = sigmoid(p["wu"] @ s + p["uu"] @ weight + p["bu"])
    r = sigmoid(p["wr"] @ s + p["ur"] @ weight + p["br"])
    h = np.tanh(p["wc"] @ s + p["uc"] @ (r * weight) + p["bc"])
    return (1 - u) * weight + u * h


def egcn_shapes(widths: list[int]) -> dict[str, tuple[int, ...]]:
    """Layers between neighbouring widths."""
    shapes = {}
    for i, (n, c) in enumerate(zip(widths, widths[1:], strict=False), 1):
        shapes |= {f"{i}_{k}": (n, n) for k in ("wu", "uu", "wr", "ur", "wc", "uc")} | {f"{i}_{k}": (n, c) for k in ("bu", "br", "bc", "w")}
    return shapes


def egcn(adj: DataFrame, features: DataFrame, years: list[int], weights: Weights) -> DataFrame:
    """year, node, x. Each layer is relu(A_t X_t W_t + X_t W_t); its W_t evolves
    from year to year by the mean of the vectors that it gets in that year (a
    row of features' width for each year on the driver)."""
    x = _spread(features.select("node", "x"), years)
    for i in range(1, 1 + sum(k.endswith("_w") for k in weights)):
        p = {k[2:]: v for k, v in weights.items() if k.startswith(f"{i}_")}
        x, (n, c), w, by_year = cut(x), p["w"].shape, p["w"], {}
        means = {r["year"]: r for r in summed(x, ["year"], F.lit(1.0), "x", n, F.count("*").alias("n")).collect()}
        for y in years:
            w = by_year[y] = evolve(w, np.array(means[y]["x"]) / means[y]["n"] if y in means else np.zeros(n), p)

        def project(batch: pa.RecordBatch, ws: dict[int, np.ndarray], c: int = c) -> Iterator[dict]:
            v, year = matrix(batch.column("x")), batch.column("year").to_numpy()
            out = np.zeros((len(v), c))
            for y in np.unique(year):
                out[year == y] = v[year == y] @ ws[int(y)]
            yield {"year": batch.column("year"), "node": batch.column("node"), "x": lists(out)}

        h = cut(map_batches(x.select("year", "node", "x"), project, by_year, "year int, node long, x array<double>"))
        both = h.join(propagate(adj, h, width=c).withColumnRenamed("x", "a"), ["year", "node"], "left")
        x = both.select("year", "node", F.transform(F.when(F.col("a").isNull(), F.col("x")).otherwise(F.zip_with("x", "a", lambda s, t: s + t)), lambda v: F.greatest(v, F.lit(0.0))).alias("x"))
    return x


def mlp(x: np.ndarray, p: Weights) -> np.ndarray:
    h = relu(x @ p["w1"] + p["b1"])
    return sigmoid(relu(h @ p["w2"] + p["b2"]) @ p["w3"] + p["b3"])[:, 0]


def mlp_shapes(dims: int, first: int = 256, second: int = 128) -> dict[str, tuple[int, ...]]:
    return {"w1": (dims, first), "b1": (first,), "w2": (first, second), "b2": (second,), "w3": (second, 1), "b3": (1,)}


def gather(pairs: DataFrame, encoded: DataFrame, n_years: int) -> DataFrame:
    """pairs with x = [z_src, z_tgt, pos / n_years]. Pairs whose node or year
    is not encoded drop out; the others keep their columns."""
    u = encoded.select(F.col("node").alias("src"), "pos", F.col("z").alias("zu"))
    v = encoded.select(F.col("node").alias("tgt"), "pos", F.col("z").alias("zv"))
    return pairs.join(u, ["src", "pos"]).join(v, ["tgt", "pos"]).select("src", "tgt", "pos", F.concat("zu", "zv", F.array(F.col("pos") / F.lit(float(n_years)))).alias("x"))


def gather_states(pairs: DataFrame, states: DataFrame, n_years: int) -> DataFrame:
    """As gather, for states (node, zs) with a row a node, such as the cached
    ones: bucketed by node, they join both ends without being shuffled."""
    z = lambda side: F.element_at(side, F.col("pos") + 1)
    rows = pairs.where((F.col("pos") >= 0) & (F.col("pos") < n_years))
    rows = rows.join(states.select(F.col("node").alias("src"), F.col("zs").alias("zu")), "src")
    rows = rows.select(*pairs.columns, z(F.col("zu")).alias("zu"))  # one year's vector goes on to the other end
    rows = rows.join(states.select(F.col("node").alias("tgt"), F.col("zs").alias("zv")), "tgt")
    return rows.select(*pairs.columns, F.concat("zu", z(F.col("zv")), F.array(F.col("pos") / F.lit(float(n_years)))).alias("x"))


def predict(rows: DataFrame, models: list[Weights]) -> DataFrame:
    """src, tgt, pos, model_id, prob: every model on every row, in one pass."""

    def run(batch: pa.RecordBatch, ps: list[Weights]) -> Iterator[dict]:
        x = matrix(batch.column("x"))
        for i, p in enumerate(ps):
            yield {k: batch.column(k) for k in ("src", "tgt", "pos")} | {"model_id": pa.array(np.full(len(x), i, np.int32)), "prob": pa.array(mlp(x, p))}

    return map_batches(rows.select("src", "tgt", "pos", "x"), run, models, "src long, tgt long, pos int, model_id int, prob double")


BN = ("g", "o", "m", "v")


def seal_shapes(dims: int, hidden: int, labels: int, embed: int = 8) -> dict[str, tuple[int, ...]]:
    """Twin encoders s_ (edges alike) and d_ (edges weighted by time), two
    convolutions each, and the predictor p_ on both ends and the time. Each
    batch norm has scale g, offset o and the statistics m and v."""
    one = {"w1": (embed + dims, hidden), "b1": (hidden,), "w2": (hidden, hidden), "b2": (hidden,)} | {f"{k}{i}": (hidden,) for i in (1, 2) for k in BN}
    shapes = {"embed": (labels, embed)} | {f"{side}_{k}": v for side in "sd" for k, v in one.items()}
    head = {"w1": (4 * hidden + 1, 2 * hidden), "b1": (2 * hidden,), "w2": (2 * hidden, hidden), "b2": (hidden,), "w3": (hidden, 1), "b3": (1,)} | {f"{k}1": (2 * hidden,) for k in BN}
    return shapes | {f"p_{k}": v for k, v in head.items()}


def init_seal(seed: int, dims: int, hidden: int, labels: int, embed: int = 8) -> Weights:
    """Drawn weights with neutral batch norms."""
    p = init(seed, seal_shapes(dims, hidden, labels, embed))
    neutral = {"g": 1.0, "o": 0.0, "m": 0.0, "v": 1.0}
    return {k: np.full_like(v, neutral[k[2]]) if k[1] == "_" and k[2] in BN and k[3:] in ("1", "2") else v for k, v in p.items()}


def _batch_norm(x: np.ndarray, p: Weights, at: str, eps: float = 1e-5) -> np.ndarray:
    return (x - p[at.format("m")]) / np.sqrt(p[at.format("v")] + eps) * p[at.format("g")] + p[at.format("o")]


def sparse_conv(h: np.ndarray, src: np.ndarray, tgt: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Messages along edges into targets, a loop of weight 1 at every node,
    weights scaled by the degrees of both ends at the target."""
    degree = np.bincount(tgt, weight, len(h)) + 1
    scaled = weight / np.sqrt(degree[src] * degree[tgt])
    out = h / degree[:, None]
    order = np.argsort(tgt, kind="stable")
    if len(order):
        at = np.flatnonzero(np.diff(tgt[order], prepend=-1))
        out[tgt[order][at]] += np.add.reduceat(scaled[order, None] * h[src[order]], at)
    return out


def _seal_layers(x: np.ndarray, src: np.ndarray, tgt: np.ndarray, weight: np.ndarray, p: Weights, side: str, count: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The inputs of both batch norms, then the encoding. x: after the first
    layer's weights; count: the edges that a row stands for, their weights added up."""
    w = weight if side == "d" else np.ones_like(weight) if count is None else count
    first = sparse_conv(x, src, tgt, w) + p[f"{side}_b1"]
    yield first
    h = relu(_batch_norm(first, p, side + "_{}1"))
    second = sparse_conv(h @ p[f"{side}_w2"], src, tgt, w) + p[f"{side}_b2"]
    yield second
    yield _batch_norm(second, p, side + "_{}2")


class _Block:
    """The subgraphs of a batch of pairs as one graph that is not connected
    between pairs."""

    def __init__(self, n: pd.DataFrame, e: pd.DataFrame, p: Weights):
        ids, node = np.unique(np.concatenate([n["node"], n["a"], n["b"], e["src"], e["tgt"]]), return_inverse=True)
        pairs, pair = np.unique(np.concatenate([n["pair_id"], e["pair_id"]]), return_inverse=True)
        m, k = len(n), len(ids)
        at = pair[:m] * k
        keys = at + node[:m]
        order = np.argsort(keys)
        keys = keys[order]

        def find(wanted: np.ndarray) -> np.ndarray:
            """Rows of pair and node, -1 where the pair does not have it."""
            i = np.minimum(np.searchsorted(keys, wanted), m - 1)
            return np.where(keys[i] == wanted, order[i], -1)

        self.pairs, first = np.unique(pair[:m], return_index=True)
        self.pair_ids = pairs[self.pairs]
        self.a, self.b = find(at[first] + node[m : 2 * m][first]), find(at[first] + node[2 * m : 3 * m][first])
        self.time = n["at"].to_numpy(float)[first]
        src, tgt = find(pair[m:] * k + node[3 * m : 3 * m + len(e)]), find(pair[m:] * k + node[3 * m + len(e) :])
        inside = (src >= 0) & (tgt >= 0)
        self.src, self.tgt, self.weight = src[inside], tgt[inside], e["weight"].to_numpy(float)[inside]
        self.count = np.ones_like(self.weight)
        x = np.zeros((m, 2 * p["s_w1"].shape[1]))
        there = n["x"].notna().to_numpy()
        if there.any():
            x[there] = np.stack(n["x"][there].to_numpy())
        self._start(x, n["label"].to_numpy(int), p)

    @classmethod
    def of_rows(cls, batch: pa.RecordBatch, sub: Enclosed, p: Weights) -> _Block:
        """The same from pairs that have their subgraphs beside them."""
        self, links = cls.__new__(cls), sub.links
        self.pair_ids, self.time, self.a, self.b, self.src, self.tgt = np.asarray(batch.column("pair_id")), np.asarray(batch.column("at"), float), sub.a, sub.b, sub.src, sub.tgt
        self.weight, self.count = (np.asarray(links.field(c).to_numpy(zero_copy_only=False), float)[sub.link_place] for c in ("w", "n"))
        x, place = sub.nodes.field("x"), pa.array(sub.place)
        self._start(matrix(x.take(place)).reshape(len(place), 2 * p["s_w1"].shape[1]), sub.labels(), p)
        return self

    def _start(self, x: np.ndarray, labels: np.ndarray, p: Weights) -> None:
        embed, hidden = p["embed"].shape[1], p["s_w1"].shape[1]
        self.x = {side: (p["embed"] @ p[f"{side}_w1"][:embed])[labels] + x[:, at : at + hidden] for side, at in (("s", 0), ("d", hidden))}

    def layers(self, p: Weights, side: str) -> Iterator[np.ndarray]:
        return _seal_layers(self.x[side], self.src, self.tgt, self.weight, p, side, self.count)

    def head_input(self, p: Weights) -> np.ndarray:
        """[a, b, time] of the pairs, each end static and then weighted by time."""
        z = np.concatenate([list(self.layers(p, side))[2] for side in "sd"], 1)
        z = np.concatenate([z, np.zeros((1, z.shape[1]))])  # an end outside its subgraph
        return np.concatenate([z[self.a], z[self.b], self.time[:, None]], 1) @ p["p_w1"] + p["p_b1"]

    def sums(self, p: Weights, layer: int) -> pd.DataFrame:
        """Counts, sums and sums of squares of what a batch norm gets."""
        seen = {"p_1": self.head_input(p)} if layer == 3 else {f"{side}_{layer}": list(self.layers(p, side))[layer - 1] for side in "sd"}
        return pd.concat([pd.DataFrame({"name": k, "i": np.arange(v.shape[1]), "n": len(v), "s": v.sum(0), "q": (v * v).sum(0)}) for k, v in seen.items()])

    def probs(self, p: Weights) -> np.ndarray:
        h = relu(_batch_norm(self.head_input(p), p, "p_{}1"))
        return sigmoid(relu(h @ p["p_w2"] + p["p_b2"]) @ p["p_w3"] + p["p_b3"])[:, 0]


def _first_layer(features: DataFrame, p: Weights) -> DataFrame:
    """node, x: the features' part of both twins' first layer, side by side, so
    that a subgraph's node carries its hidden values, not its whole vector."""
    embed = p["embed"].shape[1]
    return dense(features, lambda v, q: v @ q["w"], {"w": np.concatenate([p[f"{side}_w1"][embed:] for side in "sd"], 1)})


def _in_batches(pairs: DataFrame, sub: DataFrame, labels: DataFrame, features: DataFrame, pairs_at_once: int):
    """Nodes and edges of subgraphs, grouped by batches of pairs dealt by hash.
    features: of ``_first_layer``; they are joined last, just before the deal."""
    n = max(1, -(-pairs.count() // pairs_at_once))
    batch = F.pmod(F.xxhash64("pair_id"), F.lit(n)).alias("batch")
    nodes = labels.select("pair_id", "node", "label").join(pairs.select("pair_id", "a", "b", "at"), "pair_id").join(features, "node", "left")
    edges = sub.join(pairs.select("pair_id"), "pair_id", "left_semi")
    nodes = nodes.select(batch, *[F.col(c).alias(c) for c in ("pair_id", "node", "label", "x", "a", "b", "at")])
    edges = edges.select(batch, *[F.col(c).alias(c) for c in ("pair_id", "src", "tgt", "weight")])
    return nodes.groupBy("batch").cogroup(edges.groupBy("batch"))


SUMS = "name string, i long, n long, s double, q double"


def _fitted(weights: Weights, sums_of: Callable[[int, Weights], DataFrame]) -> Weights:
    """weights with the means and variances of the batch norms, one after the
    other, as each needs those before it. sums_of: the sums of a layer's norms."""
    p = dict(weights)
    for layer in (1, 2, 3):
        sums = sums_of(layer, p)
        with shuffles_dropped(sums.sparkSession):
            found = sums.groupBy("name", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
        for r in found:
            side, i = r["name"].split("_")
            for k, v in (("m", r["s"] / r["n"]), ("v", max(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2, 0.0))):
                name = f"{side}_{k}{i}"
                p[name] = p[name].copy()
                p[name][r["i"]] = v
    return p


def _frame_sums(pairs: DataFrame, sub: DataFrame, labels: DataFrame, first: DataFrame, p: Weights, layer: int, pairs_at_once: int) -> DataFrame:
    shared = sub.sparkSession.sparkContext.broadcast(p)

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        return _Block(n, e, shared.value).sums(shared.value, layer) if len(n) else pd.DataFrame({c: [] for c in ("name", "i", "n", "s", "q")})

    return _in_batches(pairs, sub, labels, first, pairs_at_once).applyInPandas(run, SUMS)


def seal_statistics(pairs: DataFrame, sub: DataFrame, labels: DataFrame, features: DataFrame, weights: Weights, pairs_at_once: int = 256) -> Weights:
    """weights with the batch norms' means and variances over the subgraphs of
    all pairs, by sums that an aggregation adds up."""
    first = cut(_first_layer(features, weights))
    return _fitted(weights, lambda layer, p: _frame_sums(pairs, sub, labels, first, p, layer, pairs_at_once))


def fitted_scores(pairs: DataFrame, edges: DataFrame, features: DataFrame, weights: Weights, year: int, near: int = 1_024, pairs_at_once: int = 256) -> DataFrame:
    """pair_id, prob: as subgraph_scores of all pairs (pair_id, a, b, at) after
    seal_statistics over all of them, edges weighted from one year.

    A pair's subgraph is made in its row, from lists of its ends, by every pass;
    only pairs of ends with more than ``near`` walks have subgraphs as rows."""
    first = cut(_first_layer(features, weights))
    zeros = _zeros(2 * weights["s_w1"].shape[1])
    every = cut(edges.select(F.explode(F.array("src", "tgt")).alias("node")).unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct().join(first, "node", "left").withColumn("x", F.coalesce("x", zeros)))
    rows, far = around(pairs, edges, year=year, features=every, near=near)
    rows = rows.select("pair_id", "a", "b", "at", "a_nodes", "b_nodes", "a_links", "b_links")
    if far is not None:
        members = cut(k_hop(far, edges, undirected=False))
        sub = cut(weighted_by_time(induced(members, edges), year))
        labels = cut(role_labels(far, members, sub))

    def sums(layer: int, p: Weights) -> DataFrame:
        def run(batch: pa.RecordBatch, q: Weights) -> Iterator[dict]:
            for part, inside in enclosed(batch):
                yield {k: pa.array(v) for k, v in _Block.of_rows(part, inside, q).sums(q, layer).items()}

        out = map_batches(rows, run, p, SUMS)
        return out if far is None else out.unionByName(_frame_sums(far, sub, labels, first, p, layer, pairs_at_once))

    def score(batch: pa.RecordBatch, q: Weights) -> Iterator[dict]:
        for part, inside in enclosed(batch):
            yield {"pair_id": part.column("pair_id"), "prob": pa.array(_Block.of_rows(part, inside, q).probs(q))}

    p = _fitted(weights, sums)
    out = map_batches(rows, score, p, "pair_id long, prob double")
    return out if far is None else out.unionByName(subgraph_scores(far, sub, labels, features, p, pairs_at_once))


def subgraph_scores(pairs: DataFrame, sub: DataFrame, labels: DataFrame, features: DataFrame, weights: Weights, pairs_at_once: int = 256) -> DataFrame:
    """pair_id, prob: twin encoders over each pair's enclosing subgraph, one
    with its edges alike, one with their time weights, role labels embedded
    beside the features; then a predictor on both ends and the pair's time.

    pairs: pair_id, a, b, at; sub: pair_id, src, tgt, weight. A group is the
    subgraphs of about that many pairs, which a task holds as one sparse graph.
    """
    shared = sub.sparkSession.sparkContext.broadcast(weights)

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({"pair_id": [], "prob": []})
        block = _Block(n, e, shared.value)
        return pd.DataFrame({"pair_id": block.pair_ids, "prob": block.probs(shared.value)})

    return _in_batches(pairs, sub, labels, _first_layer(features, weights), pairs_at_once).applyInPandas(run, "pair_id long, prob double")


def positions(years: DataFrame) -> DataFrame:
    """year, pos. Years are few."""
    return years.select("year", (F.row_number().over(Window.partitionBy().orderBy("year")) - 1).cast("int").alias("pos"))
