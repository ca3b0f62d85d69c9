"""Batch norms are fitted on the subgraphs of all pairs, made in their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import encoders as N
from chronoloom.operators import graph as G


def test_norms_take_more_than_2000_pairs(spark):
    pairs = spark.range(2_100).select(F.col("id").alias("pair_id"), F.col("id").alias("a"), (-F.col("id") - 1).alias("b"), F.lit(0.5).alias("at"))
    labels = pairs.select("pair_id", F.col("a").alias("node"), F.lit(1).alias("label"))
    x = spark.range(2_100).select(F.col("id").alias("node"), F.array(F.col("id").cast("double")).alias("x"))
    sub = spark.createDataFrame([], "pair_id long, src long, tgt long, weight double")
    w = N.init_seal(1, 1, 2, 6)
    p = N.seal_statistics(pairs, sub, labels, x, w, pairs_at_once=700)
    want = w["embed"][1] @ w["s_w1"][:8] + np.mean(np.arange(2_100)) * w["s_w1"][8] + w["s_b1"]
    assert p["s_m1"] == pytest.approx(want)


@pytest.mark.parametrize("near", [1_024, 6])
def test_scores_in_rows_equal_scores_by_joins(spark, near):
    rng = np.random.default_rng(2)
    edges = spark.createDataFrame([(s, t, 1996 + (s * t + i) % 4) for s in range(8) for t in range(4, 14) for i in range(1 + (s + t) % 2) if (s * t) % 3 == 1 or s == t], "src long, tgt long, year int").localCheckpoint()
    pairs = spark.createDataFrame([(i, a, b, 0.5) for i, (a, b) in enumerate([(1, 4), (2, 5), (5, 11), (4, 4), (7, 13), (77, 5)])], "pair_id long, a long, b long, at double").localCheckpoint()
    x = spark.createDataFrame([(n, rng.normal(size=5).tolist()) for n in range(0, 14, 2)], "node long, x array<double>")
    w = N.init_seal(3, 5, 3, 6)
    members = G.k_hop(pairs, edges, undirected=False).localCheckpoint()
    sub = G.weighted_by_time(G.induced(members, edges), 1998).localCheckpoint()
    labels = G.role_labels(pairs, members, sub).localCheckpoint()
    want = N.subgraph_scores(pairs, sub, labels, x, N.seal_statistics(pairs, sub, labels, x, w)).collect()
    got = N.fitted_scores(pairs, edges, x, w, 1998, near=near).collect()
    assert {r["pair_id"]: r["prob"] for r in got} == {r["pair_id"]: pytest.approx(r["prob"]) for r in want} and len(got) == 6
