"""Labels of subgraphs are made in the rows of their pairs."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import graph as G

# chains, a crossing pair of chains, a loop, repeated edges, a hub, a pair of one node and one without edges
EDGES = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 5), (8, 9), (3, 8), (5, 9), (6, 6), (6, 5), (6, 5), (4, 9), (10, 1), (11, 10), *[(i, 20) for i in range(30, 50)], (20, 4), (31, 9)]
PAIRS = [(1, 4, 5), (2, 5, 9), (3, 6, 6), (4, 3, 9), (5, 20, 4), (6, 99, 1), (7, 2, 20), (8, 9, 4)]


@pytest.mark.parametrize("near,share", [(4_096, 2), (6, 4_096)])
def test_labels_in_rows_equal_labels_by_joins(spark, near, share, monkeypatch):
    edges = spark.createDataFrame([(s, t, 1996 + s % 3) for s, t in EDGES], "src long, tgt long, year int")
    pairs = spark.createDataFrame(PAIRS, "pair_id long, a long, b long")
    members = G.k_hop(pairs, edges, undirected=False)
    want = sorted(map(tuple, G.role_labels(pairs, members, G.induced(members, edges)).collect()))
    assert len({label for *_, label in want}) > 3
    real = G.around
    monkeypatch.setattr(G, "around", lambda *a, **kw: real(*a, **kw, share=share))
    assert sorted(map(tuple, G.subgraph_labels(pairs, edges, near=near).collect())) == want


def test_batches_go_in_parts(spark, monkeypatch):
    pairs = spark.createDataFrame(PAIRS, "pair_id long, a long, b long").coalesce(1)
    edges = spark.createDataFrame([(s, t, 1996) for s, t in EDGES], "src long, tgt long, year int")
    batch = pa.concat_batches(G.around(pairs, edges)[0].toArrow().to_batches())

    def labels():
        return sorted(row for part, sub in G.enclosed(batch) for row in zip(part.column("pair_id").take(pa.array(sub.row)).to_pylist(), sub.node.tolist(), sub.labels().tolist(), strict=True))

    whole = labels()
    monkeypatch.setattr(G, "ELEMENTS", 3)
    assert len(list(G.enclosed(batch))) > 3 and labels() == whole


def test_members_and_links_of_pairs_are_not_stored(spark):
    """300 pairs of one target with 200 sources: 60,600 labels, none stored."""
    edges = spark.createDataFrame([(s, 0, 2000) for s in range(1, 201)], "src long, tgt long, year int")
    pairs = spark.range(300).select(F.col("id").alias("pair_id"), (F.col("id") + 1_000).alias("a"), F.lit(0).cast("long").alias("b"))
    stored = []

    def keep(df):
        df = df.localCheckpoint()
        stored.append(df.count())
        return df

    assert G.subgraph_labels(pairs, edges, keep=keep).count() == 300 * 202
    assert max(stored) <= 700
