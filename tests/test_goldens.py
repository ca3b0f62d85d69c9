"""Small results worked out by hand, and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom import config, schema
from chronoloom.functions import scalars
from chronoloom.operators import edges as E
from chronoloom.operators import encoders as N
from chronoloom.operators import graph as G
from chronoloom.operators import imputation as I
from chronoloom.operators import metrics as M
from chronoloom.operators import runs as R
from chronoloom.operators import sampling as S
from chronoloom.operators import stability as V
from chronoloom.operators import training as L
from chronoloom.sources import files


def scores(spark, pos, neg):
    return spark.createDataFrame([(1, float(p)) for p in pos] + [(0, float(p)) for p in neg], "label int, prob double")


def test_auc_with_a_tie(spark):
    assert M.roc_auc(scores(spark, [0.9, 0.8, 0.2], [0.8, 0.3, 0.1])).first()["auc"] == pytest.approx(6.5 / 9)
    assert M.roc_auc(scores(spark, [0.9], [])).first()["auc"] == 0.5
    assert M.roc_auc(scores(spark, [0.9, float("nan")], [0.1])).first()["auc"] == 1.0


def test_interval(spark):
    rows = spark.createDataFrame([(1, i, 1, p) for i, p in enumerate([0.1, 0.2, 0.3, 0.8, 0.8, 0.9])], "sample_id long, model_id int, label int, prob double")
    r = V.matrix(rows).first()
    assert (r["pi_low"], r["pi_high"]) == (pytest.approx(0.1125), pytest.approx(0.8875))


def test_quantile_is_strictly_below(spark):
    ref = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "prob double")
    assert M.mean_quantile(ref.where("prob = 0.5"), ref).first()[0] == pytest.approx(1 / 3)


def test_degree_buckets(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 1, 2, 5, 5000, 5001)], "d int").select(scalars.bin_index(F.col("d"), V.DEGREE_EDGES, True).alias("b"))
    assert [r["b"] for r in rows.collect()] == [0, 0, 1, 2, 11, None]


@settings(max_examples=5, deadline=None)
@given(a=st.lists(st.integers(0, 20), min_size=1, max_size=12), b=st.lists(st.integers(0, 20), min_size=1, max_size=12))
def test_wasserstein(spark, a, b):
    x, y = (spark.createDataFrame([(v / 20,) for v in s], "prob double") for s in (a, b))
    grid = np.arange(21)
    gap = sum(abs(np.mean(np.array(a) <= g) - np.mean(np.array(b) <= g)) for g in grid[:-1]) / 20
    assert M.wasserstein(x, y).first()[0] == pytest.approx(gap)
    assert M.wasserstein(y, x).first()[0] == pytest.approx(gap)


def test_margin_loss_is_the_mean_over_pairs(spark):
    pos, neg = [0.9, 0.55, 0.5], [0.52, 0.1, 0.5]
    want = np.mean([max(0, 0.1 - (p - n)) for p in pos for n in neg])
    assert M.margin_loss(scores(spark, pos, neg)).first()[0] == pytest.approx(want)


def test_roc_without_collinear_points(spark):
    s = scores(spark, [0.9, 0.8, 0.7], [0.3, 0.2])
    assert M.roc_curve(s).count() == 6
    assert M.roc_curve(s, drop_collinear=True).count() == 3


@pytest.mark.parametrize(("da", "db", "want"), [(0, 1, 2), (1, 1, 3), (0, 2, 4), (1, 2, 5), (2, 2, 5)])
def test_role_label_formula(da, db, want):
    near, far = min(da, db), max(da, db)
    assert min(1 + near + far * (far + 1) // 2, 5) == want


def test_role_labels_on_a_path(spark):
    edges = spark.createDataFrame([(1, 2, 2000), (2, 3, 2000), (3, 4, 2000)], "src long, tgt long, year int")
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, a long, b long")
    members = G.k_hop(pairs, edges)
    labels = {r["node"]: r["label"] for r in G.role_labels(pairs, members, G.induced(members, edges)).collect()}
    assert labels == {1: 2, 2: 2, 3: 5, 4: 5}


def test_adjacency_of_a_node_without_out_edges(spark):
    edges = spark.createDataFrame([(1, 2, 2000), (1, 2, 2000), (1, 3, 2000), (3, 1, 2000)], "src long, tgt long, year int")
    w = {(r["src"], r["tgt"]): r["weight"] for r in G.adjacency(edges).collect()}
    assert w[1, 2] == 0 and w[1, 3] == pytest.approx(1 / 3**0.5) and w[3, 1] == pytest.approx(1 / 3**0.5)


def test_gcn_against_numpy(spark):
    edges = spark.createDataFrame([(1, 2, 2000), (2, 1, 2000), (2, 3, 2000), (3, 2, 2000)], "src long, tgt long, year int")
    x = np.array([[1.0, 2.0], [0.5, -1.0], [3.0, 0.0], [1.0, 1.0]])
    feats = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>")
    w = N.init(0, {"w0": (2, 3), "b0": (3,), "w1": (3, 2), "b1": (2,)})
    a = np.zeros((4, 4))
    a[0, 1] = a[1, 0] = a[1, 2] = a[2, 1] = 1 / 2**0.5
    want = a @ (np.maximum(a @ (x @ w["w0"]) + w["b0"], 0) @ w["w1"]) + w["b1"]
    got = {r["node"]: r["x"] for r in N.gcn(G.adjacency(edges), feats, [2000], w).collect()}
    for i in range(4):
        assert got[i + 1] == pytest.approx(want[i].tolist())


@pytest.mark.parametrize("name", ["gcn_encode", "gat_encode", "tna_encode", "egcn_encode"])
def test_encoders_read_the_last_component(spark, monkeypatch, name):
    from chronoloom.plans import graph_queries as Q

    codes = lambda: {(r["node"], r["year"] if "year" in r else r["pos"], r["component"] if "component" in r else 0): r["value" if "value" in r else "x" if "x" in r else "z"] for r in Q.__dict__[name](spark, "/root/testdata/sf0.001").collect()}
    before, nodes = codes(), Q.T.nodes
    last = F.transform("embedding", lambda v, i: F.when(i == F.size("embedding") - 1, v + 5).otherwise(v))
    monkeypatch.setattr(Q.T, "nodes", lambda s, d: nodes(s, d).withColumn("embedding", last))
    after = codes()
    assert before.keys() == after.keys() and before != after


def test_gru_runs_both_ways():
    p = N.init(1, N.gru_shapes(2, 3))
    x = np.random.default_rng(0).normal(size=(4, 5, 2))
    z = N.bi_gru(x, p)
    assert z.shape == (4, 5, 6)
    assert np.allclose(z[:, :, 3:], N.gru_states(x[:, ::-1], p, "b_")[:, ::-1])


def test_head_learns():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] > 0).astype(float)
    _, losses = L.fit_head(x, y, 1, epochs=15, batch=64)
    assert losses[-1] < losses[0] / 2


def test_matching_weights():
    w = {"module.a": np.zeros((2, 2)), "b": np.zeros(3), "c": np.zeros(1)}
    fit, skipped = L.matching(w, {"a": (2, 2), "b": (4,)})
    assert list(fit) == ["a"] and skipped == 2


def test_restart_keeps_the_backbone():
    p = {"static_w": np.ones((2, 2)), **{f"f_{k}": np.ones(s) for k, s in {"wi": (2, 6), "wh": (2, 6), "bi": (6,)}.items()}}
    q = L.restarted(p, 1)
    assert (q["static_w"] == 1).all() and q["f_bi"].tolist() == [0, 0, 1, 1, 0, 0]
    assert np.allclose(q["f_wh"] @ q["f_wh"].T, np.eye(2))


def test_negatives_are_unknown_and_repeatable(spark):
    ids = spark.createDataFrame([(i,) for i in range(30)], "company_id long")
    known = spark.createDataFrame([(i, j, 2000) for i in range(30) for j in range(0, 30, 2)], "src long, tgt long, year int")
    a = S.negative_pool(ids, [2000], known, 60, 1)
    assert a.join(known, schema.TRIPLE, "left_semi").isEmpty()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, S.negative_pool(ids.repartition(3), [2000], known, 60, 1).collect()))


def test_split_is_disjoint(spark):
    t = spark.range(200).select(F.col("id").alias("src"), (F.col("id") * 3).alias("tgt"), (F.col("id") % 2 + 2000).cast("int").alias("year"))
    split = S.stratified_split(t, 5)
    assert all(r["n_shared"] == 0 for r in S.leakage(split).collect())
    assert {r["split"]: r["n"] for r in S.composition(split).collect()} == {"test": 20, "val": 20, "train": 160}


def test_poisson_bootstrap_keeps_about_all(spark):
    t = spark.range(2000).select(F.col("id").alias("src"), F.col("id").alias("tgt"), F.lit(2000).alias("year"))
    assert 1800 < S.poisson_bootstrap(t, 1).count() < 2200


def test_edgebank_window(spark):
    h = spark.createDataFrame([(1, 2, 1996), (1, 2, 1999)], "src long, tgt long, year int")
    q = spark.createDataFrame([(1, 2, 1998, 1), (1, 2, 1999, 1), (1, 3, 1998, 0)], "src long, tgt long, year int, label int")
    got = {(r["tgt"], r["year"]): r["predicted"] for r in G.edgebank(h, q, 2, 1).collect()}
    assert got == {(2, 1998): 1, (2, 1999): 0, (3, 1998): 0}


def test_interpolation_clamps(spark):
    curve = spark.createDataFrame([(0.2, 1.0), (0.4, 3.0)], "t double, v double")
    points = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.9,)], "t double")
    assert sorted(map(tuple, I.interpolate_at(curve, points, "t", "v").collect())) == [(0.1, 1.0), (0.2, 1.0), (0.3, pytest.approx(2.0)), (0.9, 3.0)]


def test_upsert_takes_the_new_probability(spark):
    old = spark.createDataFrame([(1, 2, 2000, "imputation", 0.9, "m"), (3, 4, 2000, "imputation", 0.2, "m")], "src long, tgt long, year int, source string, probability double, model string")
    new = spark.createDataFrame([(1, 2, 2000, 0.41239)], "src long, tgt long, year int, prob double")
    got = {(r["src"], r["tgt"]): (r["probability"], r["selected"]) for r in I.upsert(old, new, "m").collect()}
    assert got == {(1, 2): (0.4124, False), (3, 4): (0.2, False)}


def test_run_filters(spark):
    log = spark.createDataFrame([("seal", 1, "fff", e, "Monitor/Wasserstein_D", 1.0) for e in (5, 150)] + [("seal", 2, "fff", 5, "Monitor/Wasserstein_D", 1.0)], "model string, run_id long, flag string, epoch long, tag string, value double")
    assert sorted(r["epoch"] for r in R.drop_fine_steps(log, "seal").collect()) == [5, 150]
    assert R.min_max(spark.createDataFrame([(1.0,), (1.0,)], "x double"), ["x"]).first()["x"] == 0.5


def test_year_outside_the_window_raises(spark):
    bad = spark.createDataFrame([(1, 2, 1900)], "src long, tgt long, year int")
    with pytest.raises(Exception, match="study window"):
        schema.require_window(bad).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "src long, tgt long, year int")
    assert E.degrees(none).isEmpty() and G.adjacency(none).isEmpty()
    assert S.stratified_split(none, 1).isEmpty() and S.bootstrap(none, 1).isEmpty()
    assert M.roc_curve(scores(spark, [], [])).isEmpty()


def test_config(tmp_path):
    c = config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}})
    assert c == {"a": {"b": 3, "c": 2}} and config.get_path(c, "a.b") == 3
    assert config.set_path(c, "a.c", "7") == {"a": {"b": 3, "c": 7}}
    with pytest.raises(ValueError):
        config.encoder("os.system")


def test_files(spark, tmp_path):
    (tmp_path / "net.json").write_text('{"x": ["a", ["b", ["c"]]], "y": ["a"]}')
    net = files.industry_network(spark, str(tmp_path / "net.json"))
    assert sorted(map(tuple, net.collect())) == [("x", "a"), ("x", "b"), ("x", "c"), ("y", "a")]
    t = spark.createDataFrame([(1, 2, 2000)], "src long, tgt long, year int")
    files.write_split(t, str(tmp_path / "s"))
    assert files.split_file(spark, str(tmp_path / "s")).collect() == t.collect()


def test_stream(spark, tmp_path):
    from chronoloom.streaming.scoring import scored_batches

    links = spark.createDataFrame([(1, 2, 2000), (1, 3, 2000)], "src long, tgt long, year int")
    links.write.parquet(str(tmp_path / "in"))
    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "company_id long, embedding array<double>")
    q = scored_batches(spark.readStream.schema(links.schema).parquet(str(tmp_path / "in")), nodes, str(tmp_path / "out"), str(tmp_path / "cp"), 0.5)
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("src", "tgt", "prob").collect()] == [(1, 2, 1.0)]


def test_checkpoint_discovery(spark, tmp_path):
    import os

    for i, name in enumerate(["model_2.pt", "model_10.pt", "other.pt", "deep/model_3.pt"]):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
        os.utime(path, (1_700_000_000 + i * (1 if i != 1 else 100),) * 2)
    found = files.checkpoints(spark, str(tmp_path), "*.pt")
    assert sorted((r["path"].rsplit("/", 1)[1], r["number"]) for r in found.collect()) == [("model_10.pt", 10), ("model_2.pt", 2), ("model_3.pt", 3), ("other.pt", None)]
    assert files.newest(found).first()["path"].endswith("model_10.pt")
    assert files.newest(found.where("false")).isEmpty()


def test_summaries_and_metric_log(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1, 0.5)], "model string, epoch int, value double")
    files.write_summary(rows, str(tmp_path / "s"), seed=7)
    assert spark.read.json(str(tmp_path / "s")).first()["_meta"] == '{"seed": 7}'
    for _ in range(2):
        files.append_metrics(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    (tmp_path / "t.json").write_text('{\n "best": 0.4,\n "auc": 0.9\n}')
    assert files.json_results(spark, str(tmp_path / "t.json")).first()["best"] == 0.4


def test_negatives_are_topped_up(spark):
    pool = spark.createDataFrame([(1, 2, 1996), (1, 3, 1996)], "src long, tgt long, year int")
    more = spark.createDataFrame([(1, 2, 1996), (5, 6, 1997), (7, 8, 1998), (9, 9, 1999)], "src long, tgt long, year int")
    assert S.fixed_negatives(pool, 4, 1, more).distinct().count() == 4
    assert S.fixed_negatives(pool, 9, 1, more).count() == 5 and S.fixed_negatives(pool, 1, 1, more).count() == 1
