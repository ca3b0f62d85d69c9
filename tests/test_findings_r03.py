"""Work that has to grow with the input, and the results that go with it."""

import time

import numpy as np
from pyspark.sql import functions as F

from chronoloom.functions.scalars import layer_norm
from chronoloom.operators import edges as E
from chronoloom.operators import encoders as N
from chronoloom.operators import graph as G
from chronoloom.operators import graph_training as T
from chronoloom.operators import imputation as I
from chronoloom.operators import sampling as S
from chronoloom.operators import training as L
from chronoloom.plans import graph_queries as Q


def test_induced_edges_are_looked_for_from_their_lighter_ends(spark, monkeypatch):
    """Pairs of a hub with its 200 targets: a lookup for each pair, not 200."""
    edges = spark.createDataFrame([(0, t, 2000) for t in range(1, 201)] + [(0, 7, 2001), (3, 3, 2000), (9, 3, 1999)], "src long, tgt long, year int")
    members = spark.createDataFrame([(t, n) for t in range(1, 201) for n in (0, t)] + [(300, 3), (300, 9)], "pair_id long, node long")
    looked, real = [], G.expand

    def counting(*args, **options):
        found = real(*args, **options)
        looked.append(found.count())
        return found

    monkeypatch.setattr(G, "expand", counting)
    got = sorted(map(tuple, G.induced(members, edges).collect()))
    assert got == sorted([(t, 0, t, 2000) for t in range(1, 201)] + [(7, 0, 7, 2001), (3, 3, 3, 2000), (300, 3, 3, 2000), (300, 9, 3, 1999)])
    assert sum(looked) < 220


def test_layer_norm_takes_mean_and_scale_once(spark):
    x = np.random.default_rng(1).normal(size=(30, 600))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "node long, x array<double>")
    start = time.monotonic()
    got = {r["node"]: r["y"] for r in rows.select("node", layer_norm(F.col("x")).alias("y")).collect()}
    assert time.monotonic() - start < 30  # the cube of the width took minutes
    want = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)
    assert got.pop(99) is None
    assert np.allclose([got[i] for i in range(30)], want)


INDUSTRIES = {1: ("A", None), 2: ("A", "B"), 3: ("B", "A"), 4: ("C", "A"), 5: ("C", None), 6: ("D", "C"), 7: ("", "D"), 8: (None, None), 9: ("C", "D"), 10: ("B", None)}
VECTORS = {1: [1.0, 0.0, 1.0], 2: [1.0, 1.0, 0.0], 3: [0.0, 0.0, 0.0], 4: [1.0, None, 1.0], 5: [0.5, 0.25, 0.1], 6: [-1.0, 2.0, 0.0], 7: [1.0, 0.1, 0.9], 8: [1.0, 1.0, 1.0], 9: [1.0, 2.0], 10: None}
NETWORK = [("A", "C"), ("A", "D"), ("B", "C"), ("A", "C")]
SEEN = [(1, 5, 2000), (1, 5, 2000), (2, 7, 2001), (2, 7, 2000), (8, 5, 2000), (1, 5, 1990), (2, 5, 2002)]


def _world(spark):
    nodes = spark.createDataFrame([(c, *INDUSTRIES[c], VECTORS[c]) for c in INDUSTRIES], "company_id long, industry_1st string, industry_2nd string, embedding array<double>")
    return nodes, spark.createDataFrame(NETWORK, "upstream string, downstream string"), spark.createDataFrame(SEEN, "src long, tgt long, year int")


def _cosine(u, v):
    if len(u) != len(v) or None in (*u, *v):
        return 0.0
    size = np.sqrt(np.dot(u, u) * np.dot(v, v))
    return max(0.0, float(np.dot(u, v) / size)) if size else 0.0


def _allowed():
    of = {c: {i for i in INDUSTRIES[c] if i} for c in INDUSTRIES if VECTORS[c] is not None}
    return sorted((u, v) for u in of for v in of if any(a in of[u] and b in of[v] for a, b in NETWORK))


def test_candidates_come_out_once_without_a_distinct(spark):
    nodes, network, _ = _world(spark)
    found = I.candidate_pairs(nodes, network, block=2)
    assert "Aggregate [src" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == _allowed()


def test_imputation_by_brute_force_on_odd_vectors(spark):
    """Several industries, zeros, missing components, other lengths, repeats."""
    nodes, network, seen = _world(spark)
    years = [2000, 2001]
    for threshold in (-0.5, 0.0, 0.7):
        want = {(u, v, y): _cosine(VECTORS[u], VECTORS[v]) for u, v in _allowed() for y in years}
        want = {k: p for k, p in want.items() if p > threshold}
        for skip in (True, False):
            got = [(r["src"], r["tgt"], r["year"], r["prob"]) for r in I.impute(nodes, network, seen, years, threshold, skip, block=2).collect()]
            keys = [k for k in want if not (skip and k in SEEN)]
            assert sorted(g[:3] for g in got) == sorted(keys)
            assert all(abs(p - want[s, t, y]) < 1e-6 for s, t, y, p in got)
        asked = spark.createDataFrame([(1, 7, 2001), (1, 7, 2002), (1, 5, 2000), (8, 5, 2000), (2, 5, 2000), (5, 1, 2000)], "src long, tgt long, year int")
        among = {tuple(r)[:3] for r in I.impute_among(asked, nodes, network, seen, years, threshold).collect()}
        assert among == {k for k in want if k not in SEEN} & {tuple(r) for r in asked.collect()}


def test_counts_of_candidates_that_are_not_made(spark):
    nodes, network, seen = _world(spark)
    pairs = _allowed()
    got = {r["year"]: (r["n"], r["n_seen"]) for r in I.count_unobserved(nodes, network, seen, [2000, 2001, 2005]).collect()}
    assert got == {2000: (len(pairs) - 2, 2), 2001: (len(pairs) - 1, 1), 2005: (len(pairs), 0)}
    none = I.totals(nodes, network.where("false"), seen, [2000], 0.2).first()
    assert (none["processed"], none["skipped"], none["saved"]) == (0, 0, 0)


def test_upsert_with_the_replaced_triples_given(spark):
    old = spark.createDataFrame([(1, 2, 2000, "imputation", "m", 0.9), (1, 2, 2000, "imputation", "m", 0.8), (1, 3, 2000, "imputation", "m", 0.1), (1, 2, 2000, "imputation", "k", 0.7)], "src long, tgt long, year int, source string, model string, probability double")
    new = spark.createDataFrame([(1, 2, 2000, 0.4), (5, 6, 2001, 0.6)], "src long, tgt long, year int, prob double")
    plain = sorted(map(tuple, I.upsert(old, new, "m").collect()))
    assert sorted(map(tuple, I.upsert(old, new, "m", replaced=new.where("src = 1")).collect())) == plain


def test_pool_draws_no_more_than_it_needs(spark, monkeypatch):
    """The first draws where they are enough, all where most are known; the same pool either way."""
    asked, real = [], S.random_triples
    monkeypatch.setattr(S, "random_triples", lambda ids, years, n, *more: asked.append(n) or real(ids, years, n, *more))
    for size, wanted, want in ((3_000, 20_000, [23_000]), (100, 9_000, [10_900, 18_000])):
        asked.clear()
        ids = spark.range(size).withColumnRenamed("id", "company_id")
        known = spark.createDataFrame([(0, 1, 2000)], "src long, tgt long, year int")
        known = known if want[0] == want[-1] else ids.select(F.col("company_id").alias("src")).crossJoin(ids.select(F.col("company_id").alias("tgt"))).where("src % 2 = 0").withColumn("year", F.lit(2000))
        got = {tuple(r) for r in S.negative_pool(ids, [2000], known, wanted, 42).select("src", "tgt", "year", "draw").collect()}
        draws, bad = {}, {tuple(r) for r in known.collect()}
        for r in sorted(real(ids, [2000], 2 * wanted, 42).select("draw", "src", "tgt", "year").collect()):
            draws.setdefault(tuple(r)[1:], r["draw"])
        free = sorted((d, *k) for k, d in draws.items() if k not in bad)[:wanted]
        assert got == {(*k, d) for d, *k in free} and asked == want


def test_states_meet_the_second_end_as_one_vector(spark):
    pairs = spark.createDataFrame([(1, 2, 1, 0)], "src long, tgt long, pos int, label int")
    states = spark.createDataFrame([(1, [[1.0], [2.0]]), (2, [[3.0], [4.0]])], "node long, zs array<array<double>>")
    assert N.gather_states(pairs, states, 2).first()["x"] == [2.0, 4.0, 0.5]


def test_edges_among_ids_keep_their_number_of_partitions(spark):
    """Rows of a few bytes: by bytes all of them would come to one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(4000).selectExpr("id % 90 as src", "id % 70 as tgt", "2000 as year")
        rows = E.among(edges, spark.range(80).withColumnRenamed("id", "company_id"))
        sizes = [n for n in rows.rdd.glom().map(len).collect() if n]
        assert len(sizes) == 4 and sum(sizes) == sum(i % 90 < 80 for i in range(4000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_training_encodes_once_an_epoch(spark, monkeypatch):
    """The states that an epoch's gradients need also judge its weights."""
    adj = spark.createDataFrame([(y, s, (s + k) % 9, 0.5) for y in (0, 1) for s in range(9) for k in (1, 3)], "year int, src long, tgt long, weight double")
    x = spark.createDataFrame([(i, [i / 9, 1.0 - i / 5]) for i in range(9)], "node long, x array<double>")
    samples = spark.createDataFrame([(i % 9, (i * 2 + 1) % 9, i % 2, (i // 2) % 2) for i in range(30)], "src long, tgt long, pos int, label int").distinct()
    p, made, real = T.init_model(3, 2, 4, 3, 2, 5, 4), [], T.GraphModel._states

    def counting(model, received, weights):
        made.append(1)
        return real(model, received, weights)

    monkeypatch.setattr(T.GraphModel, "_states", counting)
    with T.GraphModel(adj, x, [0, 1]) as model:
        kept = []
        found = model.fit(samples, p, 2, valid=samples, on_epoch=lambda e, s, w: kept.append({k: v.copy() for k, v in w.items()}))
        assert len(made) == 2
        for seen, w in zip(found.history, kept, strict=True):
            assert abs(seen["valid_loss"] - model.evaluate(samples, w).first()["loss"]) < 1e-9


def test_pairs_of_heads_are_drawn_before_vectors_are_gathered(spark, monkeypatch):
    """The same rows as drawn afterwards, from pairs of which some have no
    vectors; only what is drawn meets the vectors."""
    states = spark.createDataFrame([(i, [[i + y / 10] for y in range(5)]) for i in range(40)], "node long, zs array<array<double>>")
    pairs = spark.range(900).selectExpr("id % 45 as src", "id div 20 as tgt", "cast(id % 7 as int) - 1 as pos", "cast(id % 2 as int) as label")
    rows = lambda df: sorted((r["src"], r["tgt"], r["pos"], r["label"], *r["x"]) for r in df.collect())
    want, met, real = rows(L.bounded_sample(N.gather_states(pairs, states, 5), 60, L.SAMPLED_BY)), [], N.gather_states

    def counting(asked, *args):
        met.append(asked.count())
        return real(asked, *args)

    monkeypatch.setattr(N, "gather_states", counting)
    assert rows(Q._for_heads(pairs, states, 60)) == want and len(want) == met[0] == 60


def test_attention_stores_no_row_of_vectors_for_an_edge(spark, monkeypatch):
    """what is stored has a row for a node and year, never one for an edge."""
    from chronoloom.operators import encoders

    stored = []
    monkeypatch.setattr(encoders, "cut", lambda df: stored.append(df.count()) or df)
    n = 12
    edges = spark.createDataFrame([(2000, a, b) for a in range(n) for b in range(n)], "year int, src long, tgt long")
    features = spark.createDataFrame([(2000, a, [float(a), 1.0]) for a in range(n)], "year int, node long, x array<double>")
    weights = encoders.hashed(1, {"w0": (2, 3), "a0": (3,), "d0": (3,)})
    out = {r["node"]: r["x"] for r in encoders.gat_layer(edges, features, weights, 1).collect()}
    assert max(stored) == n
    h = np.array([[a, 1.0] for a in range(n)]) @ weights["w0"]
    logits = (h @ weights["a0"])[None, :] + (h @ weights["d0"])[:, None]
    logits = np.where(logits > 0, logits, 0.2 * logits)
    u = np.exp(logits - logits.max(1, keepdims=True))
    want = (u / u.sum(1, keepdims=True)) @ h
    np.testing.assert_allclose(np.array([out[a] for a in range(n)]), want)


def test_only_failed_positives_are_tried_further(spark, monkeypatch):
    """a positive whose first attempt is good is drawn once."""
    from chronoloom.operators import sampling

    drawn, picked = [], sampling._picked
    monkeypatch.setattr(sampling, "_picked", lambda draws, *a: drawn.append(draws.count()) or picked(draws, *a))
    pos = spark.createDataFrame([(a, 1000 + a, 2000) for a in range(50)], "src long, tgt long, year int")
    ids = spark.createDataFrame([(a,) for a in range(2000)], "company_id long")
    out = sampling.retried_negatives(pos, ids, pos, 42).collect()
    assert len(out) == 50 and sum(drawn) < 100
