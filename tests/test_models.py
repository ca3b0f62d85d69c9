"""Whole graph models: gradients, training, stacked encoders, cached encodings,
imputation by blocks, subgraph twins, stores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions.scan import scan
from chronoloom.operators import encoders as N
from chronoloom.operators import graph as G
from chronoloom.operators import graph_training as T
from chronoloom.operators import imputation as I
from chronoloom.operators import scorers as SC
from chronoloom.sources import stores as ST

YEARS, NODES = [2000, 2001, 2002], 7
RNG = np.random.default_rng(0)
X = RNG.normal(size=(NODES, 3))
EDGES = [(y, int(a), int(b), float(RNG.uniform(0.2, 1))) for y in YEARS for a, b in sorted({(int(RNG.integers(NODES)), int(RNG.integers(NODES))) for _ in range(9)})]
SAMPLES = list(dict.fromkeys((int(a), int(b), int(t), int(y)) for a, b, t, y in zip(RNG.integers(0, NODES, 20), RNG.integers(0, NODES, 20), RNG.integers(0, 3, 20), RNG.integers(0, 2, 20), strict=True)))
A = np.zeros((len(YEARS), NODES, NODES))
for _y, _a, _b, _w in EDGES:
    A[YEARS.index(_y), _a, _b] += _w


@pytest.fixture(scope="module")
def graph(spark):
    adj = spark.createDataFrame(EDGES, "year int, src long, tgt long, weight double")
    return adj, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)], "node long, x array<double>"), spark.createDataFrame(SAMPLES, "src long, tgt long, pos int, label int")


def states(p):
    seq = [a @ N.relu(a @ X @ p["g_w0"] + p["g_b0"]) @ p["g_w1"] + p["g_b1"] for a in A]
    return N.bi_gru(np.stack(seq, 1), T.part(p, "r_"))


def loss(p, margin, weight):
    z, y = states(p), np.array([s[3] for s in SAMPLES], float)
    x = np.array([np.concatenate([z[a, t], z[b, t], [t / 3]]) for a, b, t, _ in SAMPLES])
    prob = N.mlp(x, T.part(p, "p_"))
    return -(y * np.log(prob) + (1 - y) * np.log(1 - prob)).mean() + weight * T.pair_loss(prob, y, margin)[0]


def test_gradients_equal_differences(graph):
    adj, x, samples = graph
    p = T.init_model(1, 3, 4, 3, 2, 5, 4)
    with T.GraphModel(adj, x, YEARS) as model:
        grads, ce, margin = model.gradients(model.dealt(samples), p, 0.1, 0.3)
    assert ce + 0.3 * margin == pytest.approx(loss(p, 0.1, 0.3), abs=1e-12)
    for name, g in grads.items():
        for i in np.ndindex(g.shape):
            q = {k: v.copy() for k, v in p.items()}
            q[name][i] += 1e-6
            up = loss(q, 0.1, 0.3)
            q[name][i] -= 2e-6
            assert g[i] == pytest.approx((up - loss(q, 0.1, 0.3)) / 2e-6, abs=1e-7)


def test_training_lowers_the_loss_and_repeats(graph):
    adj, x, samples = graph
    p, seen = T.init_model(2, 3, 4, 3, 2, 5, 4), []
    with T.GraphModel(adj, x, YEARS, batch=8) as model:
        one = model.fit(samples, p, 4, rate=0.05, valid=samples, on_epoch=lambda e, s, w: seen.append((e, s)))
        two = model.fit(samples.repartition(3), p, 4, rate=0.05)
        score = {tuple(r)[:4]: r["prob"] for r in model.score(samples, one.weights).collect()}
        end = model.evaluate(samples, one.weights).first()
    losses = [h["loss"] for h in one.history]
    assert losses[-1] < losses[0] and losses == pytest.approx([h["loss"] for h in two.history])
    assert end["loss"] == pytest.approx(min(s for _, s in seen)) and [e for e, _ in seen] == [0, 1, 2, 3]
    z = states(one.weights)
    for a, b, t, y in SAMPLES:
        assert score[a, b, t, y] == pytest.approx(N.mlp(np.concatenate([z[a, t], z[b, t], [t / 3]])[None], T.part(one.weights, "p_"))[0])


def test_two_tna_blocks_against_numpy(graph):
    adj, x, _ = graph
    w = N.init(3, N.tna_shapes(3, 4, 2))
    h = np.repeat(X[None], 3, 0)
    for i in ("1_", "2_"):
        p = {k[2:]: v for k, v in w.items() if k.startswith(i)}
        h = N.tna_block(np.stack([a @ (v @ p["w"]) for a, v in zip(A, h, strict=True)], 1), p).transpose(1, 0, 2)
    got = {(r["node"], r["pos"]): r["z"] for r in N.tna(adj, x, YEARS, w).collect()}
    assert len(got) == 3 * NODES
    for (n, t), z in got.items():
        assert z == pytest.approx(h[t, n].tolist())


def test_two_evolving_layers_against_numpy(graph):
    adj, x, _ = graph
    weights, h = N.init(4, N.egcn_shapes([3, 4, 2])), np.repeat(X[None], 3, 0)
    for i in ("1_", "2_"):
        p = {k[2:]: v for k, v in weights.items() if k.startswith(i)}
        w, out = p["w"], []
        for a, v in zip(A, h, strict=True):
            w = N.evolve(w, v.mean(0), p)
            out.append(N.relu(a @ (v @ w) + v @ w))
        h = np.stack(out)
    got = {(r["node"], r["year"]): r["x"] for r in N.egcn(adj, x, YEARS, weights).collect()}
    assert len(got) == 3 * NODES
    for (n, y), v in got.items():
        assert v == pytest.approx(h[YEARS.index(y), n].tolist())


def test_wide_vectors_are_summed_in_pieces(spark, graph):
    adj, _, _ = graph
    wide = np.arange(NODES * 150, dtype=float).reshape(NODES, 150)
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "node long, x array<double>")
    for to_src in (True, False):
        got = {(r["year"], r["node"]): r["x"] for r in G.propagate(adj, x, to_src).collect()}
        for (y, n), v in got.items():
            a = A[YEARS.index(y)]
            assert v == pytest.approx(((a if to_src else a.T) @ wide)[n].tolist())


def test_attention_heads_against_numpy(spark):
    edges = spark.createDataFrame([(2000, 0, 1), (2000, 2, 1), (2000, 1, 0)], "year int, src long, tgt long")
    v = np.array([[1.0, -2.0], [0.5, 1.0], [-1.0, 3.0]])
    x = spark.createDataFrame([(2000, i, r.tolist()) for i, r in enumerate(v)], "year int, node long, x array<double>")
    w = N.init(5, {f"{k}{i}": s for i in range(2) for k, s in {"w": (2, 3), "a": (3,), "d": (3,)}.items()})
    got = {r["node"]: r["x"] for r in N.gat_layer(edges, x, w, 2).collect()}
    for node, sources in {0: [1, 0], 1: [0, 2, 1], 2: [2]}.items():
        want = []
        for k in range(2):
            h = v @ w[f"w{k}"]
            logit = h[sources] @ w[f"a{k}"] + h[node] @ w[f"d{k}"]
            e = np.exp(np.where(logit > 0, logit, 0.2 * logit))
            want += (e / e.sum() @ h[sources]).tolist()
        assert got[node] == pytest.approx(want)


def test_cached_encodings_are_not_made_or_shuffled_again(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(50).select(F.col("id").alias("node"), F.array(F.array(F.col("id") * 1.0), F.array(F.lit(2.0))).alias("zs"))

    store = ST.EncodingStore(spark, f"file://{tmp_path}/enc", 3)
    first = store.get("k1", make)
    spark.sql(f"DROP TABLE {first.inputFiles() and 'encodings_' + ST.joint_key(store.path('k1'))[:24]}")  # a new session knows no table
    again = store.get("k1", make)
    assert made == [1] and sorted(r["node"] for r in again.collect()) == list(range(50))
    store.get("k2", make)
    assert made == [1, 1]
    pairs = spark.createDataFrame([(1, 2, 0), (3, 49, 1), (4, 99, 0), (1, 2, 7)], "src long, tgt long, pos int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = N.gather_states(pairs, again, 2)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(src") == 1 and plan.count("Exchange hashpartitioning(tgt") == 1 and "Exchange hashpartitioning(node" not in plan
    assert sorted((r["src"], r["tgt"], r["x"]) for r in rows.collect()) == [(1, 2, [1.0, 2.0, 0.0]), (3, 49, [2.0, 2.0, 0.5])]


def test_keys_tell_tables_and_weights_apart(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    assert ST.rows_key(a) == ST.rows_key(a.repartition(3)) != ST.rows_key(a.distinct())
    assert ST.rows_key(a) == ST.rows_key(a, "a", "b") != ST.rows_key(a, "b", "a")
    w = N.init(1, {"a": (2, 2)})
    assert ST.weights_key(w) == ST.weights_key(N.init(1, {"a": (2, 2)})) != ST.weights_key({"a": w["a"].T})


def test_imputation_by_blocks_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    industries = {i: [f"i{i % 3}", f"i{(i + 1) % 4}" if i % 2 else None] for i in range(40)}
    nodes = spark.createDataFrame([(i, [1.0] if i != 5 else None, a, b) for i, (a, b) in industries.items()], "company_id long, embedding array<double>, industry_1st string, industry_2nd string")
    net = [("i0", "i1"), ("i1", "i2"), ("i0", "i1"), ("i3", "i0")]
    z = rng.normal(size=(40, 2, 3))
    encoded = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "node long, zs array<array<double>>")
    p = N.init(7, N.mlp_shapes(7, 8, 4))
    known = [(a, b, 2000) for a in range(0, 40, 3) for b in range(1, 40, 3)]
    observed = spark.createDataFrame(known, "src long, tgt long, year int")
    want = {}
    for a in range(40):
        for b in range(40):
            if 5 in (a, b) or not any(u in industries[a] and d in industries[b] for u, d in net):
                continue
            for t in range(2):
                want[a, b, 2000 + t] = N.mlp(np.concatenate([z[a, t], z[b, t], [t / 2]])[None], p)[0]
    middle = float(np.median(list(want.values())))
    assert set(known) & {k for k, v in want.items() if v > middle}
    want = {k: v for k, v in want.items() if v > middle and k not in known}
    got = {(r["src"], r["tgt"], r["year"]): r["prob"] for r in I.impute_by_model(nodes, spark.createDataFrame(net, "upstream string, downstream string"), encoded, p, observed, [2000, 2001], middle, block=4).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_subgraph_twins_against_dense_matrices(spark):
    rng = np.random.default_rng(8)
    pairs = [(7, 1, 2, 0.5), (8, 2, 9, 0.25), (9, 4, 4, 0.0)]
    members = [(7, n, n % 3) for n in (1, 2, 3)] + [(8, n, 1) for n in (2, 3)] + [(9, 4, 0)]
    sub = [(7, 1, 2, 0.5), (7, 2, 3, 1.0), (7, 1, 2, 0.25), (7, 3, 11, 1.0), (8, 3, 2, 0.5)]
    x = {n: rng.normal(size=3) for n in (1, 2, 3)}
    p = N.init_seal(9, 3, 4, 6)
    frames = (spark.createDataFrame(pairs, "pair_id long, a long, b long, at double"), spark.createDataFrame(sub, "pair_id long, src long, tgt long, weight double"), spark.createDataFrame(members, "pair_id long, node long, label int"), spark.createDataFrame([(n, v.tolist()) for n, v in x.items()], "node long, x array<double>"))
    p = N.seal_statistics(*frames, p, pairs_at_once=2)

    def convolve(h, a):
        d = 1 / np.sqrt(a.sum(1))
        return (a * d[:, None] * d[None]) @ h

    def outputs(p, inputs=None):
        """Ends of each pair; what the batch norms get is noted in inputs."""
        z = {}
        for pair, *_ in pairs:
            own = [n for q, n, _ in members if q == pair]
            h0 = np.array([np.concatenate([p["embed"][lab], x.get(n, np.zeros(3))]) for q, n, lab in members if q == pair])
            for side in "sd":
                a = np.eye(len(own))
                for q, s, t, w in sub:
                    if q == pair and s in own and t in own:
                        a[own.index(t), own.index(s)] += w if side == "d" else 1.0
                h = convolve(h0 @ p[f"{side}_w1"], a) + p[f"{side}_b1"]
                inputs is not None and inputs.setdefault(f"{side}_1", []).extend(h)
                h = convolve(N.relu(N._batch_norm(h, p, side + "_{}1")) @ p[f"{side}_w2"], a) + p[f"{side}_b2"]
                inputs is not None and inputs.setdefault(f"{side}_2", []).extend(h)
                h = N._batch_norm(h, p, side + "_{}2")
                for n, v in zip(own, h, strict=True):
                    z[pair, n, side] = v
        end = lambda pair, n: np.concatenate([z.get((pair, n, s), np.zeros(4)) for s in "sd"])
        return np.array([np.concatenate([end(q, a), end(q, b), [at]]) for q, a, b, at in pairs]) @ p["p_w1"] + p["p_b1"]

    inputs = {}
    head = outputs(p, inputs)
    for name, rows in {**inputs, "p_1": list(head)}.items():
        side, i = name.split("_")
        assert p[f"{side}_m{i}"] == pytest.approx(np.mean(rows, 0)) and p[f"{side}_v{i}"] == pytest.approx(np.var(rows, 0), abs=1e-9)
    h = N.relu(N._batch_norm(head, p, "p_{}1"))
    want = N.sigmoid(N.relu(h @ p["p_w2"] + p["p_b2"]) @ p["p_w3"] + p["p_b3"])[:, 0]
    got = {r["pair_id"]: r["prob"] for r in N.subgraph_scores(*frames, p, pairs_at_once=2).collect()}
    assert got == {q[0]: pytest.approx(v) for q, v in zip(pairs, want, strict=True)}


@pytest.mark.parametrize("undirected", [True, False])
def test_subgraphs_with_split_hubs_by_brute_force(spark, undirected):
    """A hub of 40 neighbours in lists of four, rows of a node dealt by three."""
    rng = np.random.default_rng(12)
    rows = [(0, n, 2000) for n in range(1, 41)] + [(n, 0, 2001) for n in range(20, 41)] + [(int(a), int(b), 2000 + int(y)) for a, b, y in rng.integers(0, 60, (50, 3))]
    rows.append(rows[0])
    asked = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 41, (12, 2)))]
    edges, pairs = spark.createDataFrame(rows, "src long, tgt long, year int"), spark.createDataFrame(asked, "pair_id long, a long, b long")
    near = {}
    for s, t, _ in rows:
        near.setdefault(t, set()).add(s)
        if undirected:
            near.setdefault(s, set()).add(t)
    want, members = [], {}
    for pair, a, b in asked:
        hops = {a: 0, b: 0}
        for hop in (1, 2):
            for n in [n for n, h in hops.items() if h == hop - 1]:
                for m in near.get(n, ()):
                    hops.setdefault(m, hop)
        members[pair] = set(hops)
        want += [(pair, n, h) for n, h in hops.items()]
    got = G.k_hop(pairs, edges, undirected=undirected, piece=4, share=3)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    inside = sorted((p, s, t, y) for p, m in members.items() for s, t, y in rows if s in m and t in m)
    assert sorted(map(tuple, G.induced(got, edges, piece=4, share=3).collect())) == inside


def test_all_scorers_answer_alike(spark, graph):
    _, x, samples = graph
    edges = spark.createDataFrame([(a, b, y) for y, a, b, _ in EDGES], "src long, tgt long, year int")
    zs = RNG.normal(size=(NODES, 3, 2))
    states = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(zs)], "node long, zs array<array<double>>")
    p, w = N.init(3, N.mlp_shapes(5, 6, 4)), N.init_seal(4, 3, 4, 6)
    got = {(r["model"], r["src"], r["tgt"], r["pos"]): r["prob"] for r in SC.score_all([SC.StateScorer("s", states, p, 3), SC.SubgraphScorer("g", edges, x, w, YEARS)], samples).collect()}
    asked = {s[:3] for s in SAMPLES}
    assert set(got) == {(m, *s) for m in "sg" for s in asked}
    for a, b, t in asked:
        assert got["s", a, b, t] == pytest.approx(N.mlp(np.concatenate([zs[a, t], zs[b, t], [t / 3]])[None], p)[0])
    a, b, t = min(asked)
    pair = spark.createDataFrame([(1, a, b, t / 3)], "pair_id long, a long, b long, at double")
    members = G.k_hop(pair, edges, undirected=False)
    sub = G.induced(members, edges)
    one = N.subgraph_scores(pair, G.weighted_by_time(sub, YEARS[t]), G.role_labels(pair, members, sub), x, w).first()
    assert got["g", a, b, t] == pytest.approx(one["prob"])


def test_best_checkpoint_and_unfinished_ones(spark, tmp_path):
    store = ST.ModelStore(spark, f"file://{tmp_path}/m")
    assert store.best("k") is None
    ws = [N.init(i, {"a": (2, 3), "b": (1,)}) for i in range(3)]
    for epoch, (score, w) in enumerate(zip([0.5, 0.2, 0.2], ws, strict=True)):
        store.save("k", epoch, score, w)
    epoch, score, w = store.best("k")
    assert (epoch, score) == (1, 0.2) and all((w[k] == ws[1][k]).all() for k in w)
    assert store.best("k", least=False)[0] == 0
    (tmp_path / "m/k/epoch=1/_SUCCESS").unlink()
    assert store.best("k")[0] == 2
    store.keep_best("k", 1)
    assert store.checkpoints("k").select("epoch").distinct().count() == 1


def test_ledger_goes_on_where_it_stopped(spark, tmp_path):
    ledger, done = ST.Ledger(spark, f"file://{tmp_path}/l"), []

    def job(mode, seed, fail=False):
        def do():
            if fail:
                raise RuntimeError("killed")
            done.append((mode, seed))
            return spark.createDataFrame([(len(done) / 2,)], "loss double")

        return do

    for seed in (1, 2):
        assert ledger.run(job("fff", seed), mode="fff", seed=seed)
    with pytest.raises(RuntimeError):
        ledger.run(job("tff", 1, True), mode="tff", seed=1)
    for mode in ("fff", "tff"):
        for seed in (1, 2):
            ledger.run(job(mode, seed), mode=mode, seed=seed)
    assert done == [("fff", 1), ("fff", 2), ("tff", 1), ("tff", 2)]
    assert sorted((r["mode"], r["seed"], r["loss"]) for r in ledger.rows("mode", "seed").collect()) == [("fff", 1, 0.5), ("fff", 2, 1.0), ("tff", 1, 1.5), ("tff", 2, 2.0)]


def test_versions_are_swapped_whole(spark, tmp_path):
    table = ST.VersionedTable(spark, f"file://{tmp_path}/v")
    assert table.current() is None
    table.swap(spark.range(3))
    old = table.read()
    table.swap(old.select((F.col("id") + 10).alias("id")), keep_old=True)  # made from the version that it replaces
    assert sorted(r[0] for r in table.read().collect()) == [10, 11, 12] and old.count() == 3
    broken = spark.range(2).select(F.raise_error("no").alias("id"))
    before = table.current()
    with pytest.raises(Exception, match="no"):
        table.swap(broken)
    assert table.current() == before and table.read().count() == 3


@pytest.mark.parametrize("by", [(), ("g",)])
def test_scan_by_brute_force(spark, by):
    rows = [(i % 3, float((i * 37) % 101), i % 2, (i * 7) % 5, i / 2) for i in range(101)]
    df = spark.createDataFrame(rows, "g int, v double, k int, n int, s double")
    got = scan(df, by, [("v", True), ("k", False)], ["n", "s"], ["v"]).collect()
    assert len(got) == 101
    for r in got:
        group = sorted((q for q in rows if not by or q[0] == r["g"]), key=lambda q: (-q[1], q[2]))
        i = next(i for i, q in enumerate(group) if q[1] == r["v"])
        assert (r["upto_n"], r["all_n"]) == (sum(q[3] for q in group[: i + 1]), sum(q[3] for q in group))
        assert (r["upto_s"], r["all_s"]) == (pytest.approx(sum(q[4] for q in group[: i + 1])), pytest.approx(sum(q[4] for q in group)))
        assert r["next_v"] == (group[i + 1][1] if i + 1 < len(group) else None)
    assert scan(df.limit(0), by, [("v", False)], ["n"]).count() == 0
