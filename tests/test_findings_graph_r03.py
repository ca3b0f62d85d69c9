"""What subgraphs and their scores move and store, and what they give."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import encoders as N
from chronoloom.operators import graph as G
from chronoloom.operators import scorers as SC


def _brute(rows, pairs, undirected, k=2):
    near = {}
    for s, t in rows:
        near.setdefault(t, set()).add(s)
        if undirected:
            near.setdefault(s, set()).add(t)
    out = []
    for pair, a, b in pairs:
        hops = {a: 0, b: 0}
        for hop in range(1, k + 1):
            for n in [n for n, h in hops.items() if h == hop - 1]:
                for m in near.get(n, ()):
                    hops.setdefault(m, hop)
        out += [(pair, n, h) for n, h in hops.items()]
    return sorted(out)


HUB = [(i, 0) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 12)] + [(3, 3), (40, 41), (40, 41)]
ASKED = [(1, 0, 5), (2, 3, 3), (3, 40, 41), (4, 41, 99), (5, 7, 12), (6, 12, 0), (7, 5, 6), (8, 5, 9)]


@pytest.mark.parametrize("undirected,near,share,k", [(False, 4_096, 2, 2), (True, 5, 2, 3), (True, 0, 4_096, 1)])
def test_k_hop_by_lists_and_by_frontiers(spark, undirected, near, share, k):
    """Near ends by lists, far ends by frontiers, both, and dealt copies."""
    edges = spark.createDataFrame([(s, t, 2000) for s, t in HUB], "src long, tgt long, year int")
    pairs = spark.createDataFrame(ASKED + ASKED[:2], "pair_id long, a long, b long")
    got = G.k_hop(pairs, edges, k, undirected, share=share, near=near)
    assert sorted(map(tuple, got.collect())) == _brute(HUB, ASKED, undirected, k)


def test_members_of_pairs_are_not_shuffled(spark):
    """300 pairs of one target with 200 sources: its list travels, not 60,000 members."""
    edges = spark.createDataFrame([(s, 0, 2000) for s in range(1, 201)], "src long, tgt long, year int")
    pairs = spark.range(300).select(F.col("id").alias("pair_id"), (F.col("id") + 1_000).alias("a"), F.lit(0).cast("long").alias("b"))
    stored = []

    def keep(df):
        df = df.checkpoint()
        stored.append(df.count())
        return df

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    found = G.k_hop(pairs, edges, undirected=False, keep=keep)
    assert found.count() == 300 * 202
    assert max(stored) <= 400


def test_subgraph_nodes_carry_hidden_values_and_step_tables_go(spark, monkeypatch):
    """Vectors of 40 components reach the subgraphs as 2 times 3 hidden values;
    of the tables of the steps nothing is left."""
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(s, t, 2000 + s % 3) for s in range(6) for t in range(10, 16) if (s * t) % 3], "src long, tgt long, year int")
    x = spark.createDataFrame([(n, rng.normal(size=40).tolist()) for n in [*range(5), *range(10, 15)]], "node long, x array<double>")  # some have none
    pairs = spark.createDataFrame([(1, 10, 0), (1, 10, 2), (2, 11, 1), (3, 15, 1), (5, 13, 1)], "src long, tgt long, pos int")
    moved, real = [], N._in_batches
    monkeypatch.setattr(N, "_in_batches", lambda *a: moved.append(a[3].first()["x"]) or real(*a))
    w = N.init_seal(4, 40, 3, 6)
    got = SC.SubgraphScorer("g", edges, x, w, [2000, 2001, 2002]).score(pairs)
    assert [len(v) for v in moved] == [6]
    home = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [d for d in os.listdir(home) if d.startswith("workspace-")]
    vectors = {r["node"]: np.array(r["x"]) for r in x.collect()}
    rows = [tuple(r) for r in edges.collect()]
    for src, tgt, pos, prob in map(tuple, got.collect()):
        nodes = {n for _, n, _ in _brute([(s, t) for s, t, _ in rows], [(0, src, tgt)], False)}
        one = spark.createDataFrame([(0, src, tgt, pos / 3)], "pair_id long, a long, b long, at double")
        sub = [(0, s, t, y) for s, t, y in rows if s in nodes and t in nodes]
        members = spark.createDataFrame([(0, n) for n in nodes], "pair_id long, node long")
        label = {r["node"]: r["label"] for r in G.role_labels(one, members, spark.createDataFrame(sub, "pair_id long, src long, tgt long, year int")).collect()}
        order = sorted(nodes)
        at = {n: i for i, n in enumerate(order)}
        h = np.array([np.concatenate([w["embed"][label[n]], vectors.get(n, np.zeros(40))]) for n in order])
        s, t = (np.array([at[e[i]] for e in sub], int) for i in (1, 2))
        time = np.array([1 / (abs(e[3] - (2000 + pos)) + 1) for e in sub], float)
        z = np.concatenate([list(N._seal_layers(h @ w[f"{k}_w1"], s, t, time, w, k))[2] for k in "sd"], 1)
        v = np.concatenate([z[at[src]], z[at[tgt]], [pos / 3]]) @ w["p_w1"] + w["p_b1"]
        v = N.relu(N._batch_norm(v, w, "p_{}1"))
        assert prob == pytest.approx(N.sigmoid(N.relu(v @ w["p_w2"] + w["p_b2"]) @ w["p_w3"] + w["p_b3"])[0])
