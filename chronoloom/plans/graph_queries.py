"""Queries over the graph, its encoders and the heads trained on them."""

from pyspark.sql import functions as F

from chronoloom.catalog import query
from chronoloom.functions.lineage import cut, shared_dir
from chronoloom.functions.vectors import width_of
from chronoloom.operators import edges as E
from chronoloom.operators import encoders as N
from chronoloom.operators import graph as G
from chronoloom.operators import graph_training as TR
from chronoloom.operators import imputation as I
from chronoloom.operators import scorers as SC
from chronoloom.operators import training as L
from chronoloom.oracle import key, sql
from chronoloom.plans import encoder_sql as Q
from chronoloom.plans import sampling_queries as S
from chronoloom.plans.metric_queries import rounded
from chronoloom.sources import stores as ST
from chronoloom.sources import tables as T

YEARS = [1996, 1997, 1998, 1999, 2000]


def _pos(spark, d):
    return E.scan_edges(T.nodes(spark, d), T.edges(spark, d))


def _features(spark, d):
    return E.embedded(T.nodes(spark, d)).select(F.col("company_id").alias("node"), F.col("embedding").alias("x"))


_width = width_of


@query(sql("SELECT year, src, count(*) AS degree FROM pos GROUP BY year, src", "pos"))
def out_degree(spark, d):
    return G.out_degrees(_pos(spark, d))


@query(sql("SELECT round(avg(degree), 6) AS mean, median(degree)::DOUBLE AS median, max(degree) AS max, count(*) AS n_nodes FROM (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM pos UNION ALL SELECT tgt FROM pos) GROUP BY node)", "pos"))
def degree_stats(spark, d):
    return rounded(G.degree_summary(_pos(spark, d)), "mean")


LOOPED = """SELECT year, src, tgt, sum(n) AS n FROM (SELECT year, src, tgt, count(*) AS n FROM pos GROUP BY ALL
  UNION ALL SELECT DISTINCT year, node, node, 1 FROM (SELECT year, src AS node FROM pos UNION ALL SELECT year, tgt FROM pos)) GROUP BY ALL"""


@query(sql("SELECT e.year, e.src, e.tgt, round(e.n::DOUBLE / sqrt(a.d::DOUBLE) / sqrt(b.d::DOUBLE), 6) AS weight FROM e JOIN d a ON a.year = e.year AND a.node = e.src JOIN d b ON b.year = e.year AND b.node = e.tgt", "pos", e=LOOPED, d="SELECT year, tgt AS node, sum(n) AS d FROM e GROUP BY ALL"))
def looped_adjacency(spark, d):
    return rounded(G.looped_adjacency(_pos(spark, d)), "weight")


# customers have no out-edges, so some edges are mirrored to give weights
BOTH = "SELECT src, tgt, year FROM pos UNION ALL SELECT tgt, src, year FROM pos WHERE src % 2 = 0"
ADJ = "SELECT e.year, e.src, e.tgt, e.n / sqrt(a.d) * coalesce(1 / sqrt(b.d), 0) AS weight FROM (SELECT year, src, tgt, count(*) AS n FROM both_ways GROUP BY ALL) e JOIN deg a ON a.year = e.year AND a.src = e.src LEFT JOIN deg b ON b.year = e.year AND b.src = e.tgt"
OUT = "SELECT year, src, count(*) AS d FROM both_ways GROUP BY ALL"


def _both(spark, d, p=None):
    p = _pos(spark, d) if p is None else p
    return p.unionByName(p.where("src % 2 = 0").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "year"))


@query(sql("SELECT year, src, tgt, round(weight, 6) AS weight FROM adj", "pos", both_ways=BOTH, deg=OUT, adj=ADJ))
def normalized_adjacency(spark, d):
    return rounded(G.adjacency(_both(spark, d)), "weight")


@query(sql("SELECT year, node, CAST(k AS INTEGER) AS pos, round(sum(weight * e::DOUBLE), 6) AS value FROM (SELECT year, a.src AS node, weight, unnest(range(len(embedding))) AS k, unnest(embedding) AS e FROM adj a JOIN nodes n ON n.company_id = a.tgt WHERE weight <> 0) GROUP BY year, node, k", "pos", both_ways=BOTH, deg=OUT, adj=ADJ))
def message_passing(spark, d):
    """One component of a vector in a row."""
    rows = G.propagate(G.adjacency(_both(spark, d)), _features(spark, d))
    return rows.select("year", "node", F.posexplode("x").alias("pos", "value")).withColumn("value", F.round("value", 6))


def _pairs(spark, d, p=None):
    """Every distinct pair of the positives. p: the positives, if they are stored."""
    return (_pos(spark, d) if p is None else p).select("src", "tgt").distinct().select((F.col("src") * 10_000_000 + F.col("tgt")).alias("pair_id"), F.col("src").alias("a"), F.col("tgt").alias("b"))


def _members(spark, d):
    """Two steps along incoming edges of all years, for every pair."""
    return G.k_hop(_pairs(spark, d), _pos(spark, d), undirected=False)


PAIR = "SELECT src * 10000000 + tgt AS pair_id, src AS a, tgt AS b FROM (SELECT DISTINCT src, tgt FROM pos)"
HOPS = """SELECT pair_id, node, min(hop) AS hop FROM (
  WITH s AS (SELECT DISTINCT tgt AS x, src AS y FROM pos), z AS (SELECT pair_id, a AS node, 0 AS hop FROM pair UNION ALL SELECT pair_id, b, 0 FROM pair),
  o AS (SELECT DISTINCT pair_id, y AS node, 1 AS hop FROM z JOIN s ON x = node) SELECT * FROM z UNION ALL SELECT * FROM o UNION ALL SELECT DISTINCT pair_id, y, 2 FROM o JOIN s ON x = node) GROUP BY pair_id, node"""


@query(sql("SELECT pair_id, node, hop FROM hops", "pos", pair=PAIR, hops=HOPS))
def khop_subgraph(spark, d):
    return _members(spark, d)


@query(sql("SELECT pair_id, t.src, t.tgt, t.year, round(1.0::DOUBLE / (abs(t.year - 1998) + 1), 6) AS weight FROM hops x JOIN pos t ON t.src = x.node JOIN hops y ON y.pair_id = x.pair_id AND y.node = t.tgt".replace("SELECT pair_id", "SELECT x.pair_id"), "pos", pair=PAIR, hops=HOPS))
def temporal_weight(spark, d):
    return rounded(G.weighted_by_time(G.induced(_members(spark, d), _pos(spark, d)), 1998), "weight")


_SUB = "SELECT DISTINCT x.pair_id, t.src, t.tgt FROM hops x JOIN pos t ON t.src = x.node JOIN hops y ON y.pair_id = x.pair_id AND y.node = t.tgt"
_STEP = "SELECT pair_id, src AS x, tgt AS y FROM sub UNION SELECT pair_id, tgt, src FROM sub"
_DIST = "SELECT pair_id, start, node, min(d) AS d FROM ({}) GROUP BY ALL"


def _bfs() -> str:
    """Distances up to five by five joins."""
    layers = ["d0 AS (SELECT pair_id, a AS start, a AS node FROM pair UNION SELECT pair_id, b, b FROM pair)"]
    layers += [f"d{i} AS (SELECT DISTINCT p.pair_id, start, y AS node FROM d{i - 1} p JOIN step s ON s.pair_id = p.pair_id AND s.x = p.node)" for i in range(1, 6)]
    union = " UNION ALL ".join(f"SELECT *, {i} AS d FROM d{i}" for i in range(6))
    return f"SELECT pair_id, start, node, min(d) AS d FROM (WITH {', '.join(layers)} {union}) GROUP BY ALL"


@query(sql("""SELECT h.pair_id, h.node, CAST(CASE WHEN x.d IS NULL OR y.d IS NULL THEN 0 ELSE least(1 + least(x.d, y.d) + greatest(x.d, y.d) * (greatest(x.d, y.d) + 1) // 2, 5) END AS INTEGER) AS label
  FROM hops h JOIN pair p ON p.pair_id = h.pair_id LEFT JOIN dist x ON x.pair_id = h.pair_id AND x.node = h.node AND x.start = p.a LEFT JOIN dist y ON y.pair_id = h.pair_id AND y.node = h.node AND y.start = p.b""", "pos", pair=PAIR, hops=HOPS, sub=_SUB, step=_STEP, dist=_bfs()))  # fmt: skip
def drnl_labels(spark, d):
    p = cut(_pos(spark, d))
    return G.subgraph_labels(cut(_pairs(spark, d, p)), p)


_PAST = """SELECT q.src, q.tgt, q.year, q.label, w, (SELECT count(*) FROM pos h WHERE h.src = q.src AND h.tgt = q.tgt AND h.year BETWEEN q.year - w AND q.year - 1) AS past FROM asked q, (VALUES (2), (4), (8), (16)) v(w)"""
_ASKED = "SELECT src, tgt, year, 1 AS label FROM dp UNION ALL SELECT src, tgt, year, 0 FROM swapped WHERE (src, tgt, year) NOT IN (SELECT src, tgt, year FROM known)"
_CELLS = "SELECT w, t, sum(CAST(past >= t AND label = 1 AS BIGINT))::DOUBLE AS tp, sum(CAST(past >= t AND label = 0 AS BIGINT))::DOUBLE AS fp, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM past, (VALUES (1), (2), (3)) u(t) GROUP BY w, t"


@query(sql("""SELECT w AS window_years, t AS least, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(tp / p, 6) AS recall, round(fp / n, 6) AS fpr, round((1 + tp / p - fp / n) / 2, 6) AS auc,
  round(tp / p * coalesce(tp / nullif(tp + fp, 0), 0) + (1 - tp / p) * p / (p + n), 6) AS ap, round((tp + n - fp) / (p + n), 6) AS acc FROM cells""", "pos", "ext", dp=S.DP, known=S.KNOWN, w=S.W_SQL, swapped=S.SWAP, asked=_ASKED, past=_PAST, cells=_CELLS))  # fmt: skip
def edgebank(spark, d):
    """The baseline table: windows of 2 to 16 years by least counts of 1 to 3,
    over positives and the same pairs in other years."""
    p = _pos(spark, d)
    asked = p.distinct().withColumn("label", F.lit(1)).unionByName(S.time_swap_negatives(spark, d).withColumn("label", F.lit(0)))
    return rounded(G.edgebank_table(p, asked, [2, 4, 8, 16], [1, 2, 3]), "precision", "recall", "fpr", "auc", "ap", "acc")


@query(sql("SELECT company_id AS node, round(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(range(1, len(embedding) + 1), lambda i: i::DOUBLE)) / sqrt(len(embedding) * (len(embedding) + 1) * (2 * len(embedding) + 1) / 6.0::DOUBLE), 6) AS score FROM nodes WHERE embedding IS NOT NULL ORDER BY score DESC, node LIMIT 20", "nodes"))
def topk_nodes(spark, d):
    x = _features(spark, d)
    return G.top_nodes(x, [float(i + 1) for i in range(_width(x))], 20)


HIDDEN = 6


def _encoder_weights(n: int):
    return N.hashed(1, {"w0": (n, n), "b0": (n,), "w1": (n, HIDDEN), "b1": (HIDDEN,)})


def _encoded(spark, d):
    x = _features(spark, d)
    return N.gcn(G.adjacency(_both(spark, d)), x, YEARS, _encoder_weights(_width(x)))


def _components(df, col):
    """One component of a vector in a row."""
    keys = [c for c in df.columns if c != col]
    return df.select(*keys, F.posexplode(col).alias("component", "value")).withColumn("value", F.round("value", 6))


_GRAPH = {"both_ways": BOTH, "deg": OUT, "adj": ADJ}


@query(sql(Q.rows("enc", "year, node", "x"), "pos", **_GRAPH, **Q.gcn(HIDDEN)))
def gcn_encode(spark, d):
    return _components(_encoded(spark, d), "x")


@query(sql(Q.rows("enc", "year, node", "x"), "pos", both_ways=BOTH, **Q.gat(4, HIDDEN)))
def gat_encode(spark, d):
    """Two heads, then one."""
    x = _features(spark, d)
    shapes = {f"1_{k}{h}": s for h in range(2) for k, s in {"w": (_width(x), 4), "a": (4,), "d": (4,)}.items()} | {"2_w0": (8, HIDDEN), "2_a0": (HIDDEN,), "2_d0": (HIDDEN,)}
    return _components(N.gat(_both(spark, d), x, YEARS, N.hashed(3, shapes), heads=2), "x")


@query(sql(Q.rows("states", "node, pos", "z"), "pos", **_GRAPH, **Q.gcn(HIDDEN), **Q.gru(HIDDEN, 4)))
def bigru_encode(spark, d):
    return _components(N.node_gru(_encoded(spark, d), N.hashed(2, N.gru_shapes(HIDDEN, 4))), "z")


@query(sql(Q.rows("states", "node, pos", "z"), "pos", **_GRAPH, **Q.gcn(HIDDEN), **Q.gru(HIDDEN, 4, both=False)))
def unigru_encode(spark, d):
    return _components(N.node_gru(_encoded(spark, d), N.hashed(2, N.gru_shapes(HIDDEN, 4, ("f_",))), bidirectional=False), "z")


@query(sql(Q.rows("(SELECT node, CAST(year - 1996 AS INTEGER) AS pos, x FROM t2)", "node, pos", "x"), "pos", **_GRAPH, **Q.tna(HIDDEN, 4)))
def tna_encode(spark, d):
    """Two stacked blocks."""
    x = _features(spark, d)
    return _components(N.tna(G.adjacency(_both(spark, d)), x, YEARS, N.hashed(4, N.tna_shapes(_width(x), HIDDEN, 4))), "z")


@query(sql(Q.rows("e2", "year, node", "x"), "pos", **_GRAPH, **Q.egcn([Q.DIMS, HIDDEN, 4])))
def egcn_encode(spark, d):
    """Two layers."""
    x = _features(spark, d)
    return _components(N.egcn(G.adjacency(_both(spark, d)), x, YEARS, N.hashed(5, N.egcn_shapes([_width(x), HIDDEN, 4]))), "x")


@query(sql(Q.rows("enc", "year, node", "x"), "pos", **_GRAPH, **Q.reduced_gcn(12, HIDDEN)))
def reduced_gcn_encode(spark, d):
    """Three dense layers before the convolutions."""
    x = _features(spark, d)
    w = N.hashed(8, N.reduce_shapes(_width(x), 12) | {"w0": (12, HIDDEN), "b0": (HIDDEN,), "w1": (HIDDEN, HIDDEN), "b1": (HIDDEN,)})
    return _components(N.gcn(G.adjacency(_both(spark, d)), N.reduce(x, w), YEARS, w), "x")


def _labelled(spark, d):
    return S.labelled_dataset(spark, d).select("src", "tgt", (F.col("year") - YEARS[0]).cast("int").alias("pos"), "label").distinct()


def _states(spark, d, p=None):
    """Encoded nodes from the store, made at the first use. p: the positives, if
    they are stored."""
    adj, x = cut(G.adjacency(_both(spark, d, cut(_pos(spark, d)) if p is None else p))), _features(spark, d)
    w = _encoder_weights(_width(x)) | {f"r_{k}": v for k, v in N.hashed(2, N.gru_shapes(HIDDEN, 4)).items()}
    key = ST.joint_key(ST.rows_key(adj.withColumn("weight", F.round("weight", 9))), ST.rows_key(x), ST.weights_key(w), YEARS)

    def make():
        z = N.node_gru(N.gcn(adj, x, YEARS, w), TR.part(w, "r_"))
        return z.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "z"))).alias("s")).select("node", F.transform("s", lambda v: v["z"]).alias("zs"))

    return ST.EncodingStore(spark).get(key, make)


def _samples(spark, d):
    """Labelled pairs with the positions of their years and encoded features."""
    return N.gather_states(_labelled(spark, d), _states(spark, d), len(YEARS))


_ASKED_PAIRS = f"""SELECT DISTINCT src, tgt, CAST(year - 1996 AS INTEGER) AS pos, label FROM (SELECT src, tgt, year, 1 AS label FROM pos UNION ALL
  SELECT src, tgt, year, 0 FROM (SELECT * FROM pool ORDER BY {key("7", "src", "tgt", "year")} LIMIT {S.NEGATIVES}))"""
_SCORED = "SELECT src, tgt, pos, CAST(model_id AS INTEGER) AS model_id, round(prob, 6) AS prob FROM scored"


def _scored(models: int) -> str:
    return sql(_SCORED, "pos", "ext", dp=S.DP, idx=S.IDX, known=S.KNOWN, draws=S._draws(S.POOL_DRAWS), pool=S.POOL, asked=_ASKED_PAIRS, **_GRAPH, **Q.gcn(HIDDEN), **Q.gru(HIDDEN, 4), **Q.mlp(17, 32, 16, models))


@query(_scored(1))
def predictor_score(spark, d):
    return rounded(N.predict(_samples(spark, d), [N.hashed(10, N.mlp_shapes(17, 32, 16))]), "prob")


@query(_scored(T.MODELS))
def multi_model_inference(spark, d):
    models = [N.hashed(10 + i, N.mlp_shapes(17, 32, 16)) for i in range(T.MODELS)]
    return rounded(N.predict(_samples(spark, d), models), "prob")


EPOCHS = 4


def _trained(spark, d):
    """The model of convolutions, recurrence and predictor, trained on the
    labelled pairs, and its history. Checkpoints go to the store; a model that
    is there is not trained again."""
    adj, x, rows = cut(G.adjacency(_both(spark, d))), _features(spark, d), cut(_labelled(spark, d))
    start = TR.init_model(21, _width(x), 8, HIDDEN, 4, 16, 8)
    key = ST.joint_key("trained", ST.rows_key(rows), ST.rows_key(adj.withColumn("weight", F.round("weight", 9))), ST.rows_key(x), ST.weights_key(start), EPOCHS)
    store, model = ST.ModelStore(spark), TR.GraphModel(adj, x, YEARS)
    train, valid = TR.split_samples(rows, 0.8, 11)
    done = store.best(key)
    if store.checkpoints(key) is None or store.checkpoints(key).agg(F.countDistinct("epoch")).first()[0] < EPOCHS:
        model.fit(train, start, EPOCHS, rate=0.02, valid=valid, on_epoch=lambda e, s, p: store.save(key, e, s, p))
        done = store.best(key)
    return model, done, store.checkpoints(key), train, valid


@query()
def train_encoder(spark, d):
    """epoch, valid_loss of a whole model's training, and which epoch is best."""
    model, (best, _, _), found, _, _ = _trained(spark, d)
    with model:
        return found.groupBy("epoch").agg(F.round(F.max("score"), 5).alias("valid_loss")).withColumn("best", F.col("epoch") == best)


@query()
def evaluate_encoder(spark, d):
    """Loss and rates of the best checkpoint on training and validation pairs."""
    model, (_, _, p), _, train, valid = _trained(spark, d)
    with model:
        both = model.evaluate(train, p).withColumn("part", F.lit("train")).unionByName(model.evaluate(valid, p).withColumn("part", F.lit("valid")))
        return cut(rounded(both, *[c for c in both.columns if c != "part"]))


@query()
def model_imputation(spark, d):
    """Candidates of all years that the trained model puts over its own median
    score of the positives, from cached encodings."""
    model, (_, _, p), _, _, _ = _trained(spark, d)
    with model:
        states = ST.EncodingStore(spark).get(ST.joint_key("encoder", ST.weights_key(p), ST.rows_key(model.input)), lambda: model.encode(p))
    known = _labelled(spark, d).where("label = 1")
    score = N.predict(N.gather_states(known, states, len(YEARS)), [TR.part(p, "p_")])
    threshold = score.agg(F.percentile_approx("prob", 0.5, 10_000)).first()[0] or 0.5
    n = T.nodes(spark, d)
    return rounded(I.impute_by_model(n, T.industry_network(spark, d), states, TR.part(p, "p_"), _pos(spark, d), YEARS, threshold), "prob")


@query()
def seal_score(spark, d):
    """Every distinct pair of the positives, seen from the middle year."""
    p, x = cut(_pos(spark, d)), _features(spark, d)
    pairs = cut(_pairs(spark, d, p).withColumn("at", F.lit(0.5)))
    return rounded(N.fitted_scores(pairs, p, x, N.init_seal(6, _width(x), 8, 6), 1998), "prob")


@query()
def scored_by_all(spark, d):
    """Test pairs scored by a model of states and by one of subgraphs."""
    p, x = cut(_pos(spark, d)), _features(spark, d)
    states = _states(spark, d, p)
    width = states.select(F.max(F.size(F.get("zs", F.lit(0)))).alias("n")).first()["n"] or 1
    models = [SC.StateScorer("states", states, N.init(10, N.mlp_shapes(2 * width + 1, 32, 16)), len(YEARS)), SC.SubgraphScorer("subgraphs", p, x, N.init_seal(6, _width(x), 8, 6), YEARS)]
    pairs = cut(S.S.stratified_split(p, S.SEED).where("split = 'test'").select("src", "tgt", (F.col("year") - YEARS[0]).cast("int").alias("pos")))
    return rounded(SC.score_all(models, pairs), "prob")


def _for_heads(pairs, states, most=None):
    """What heads train on: all pairs of the years that have vectors. most: where
    it is given, so many are drawn before vectors are gathered."""
    inside = pairs.where((F.col("pos") >= 0) & (F.col("pos") < len(YEARS)))
    if most is not None:
        inside = cut(L.bounded_sample(E.among(inside, states, id_col="node"), most, L.SAMPLED_BY))
    return N.gather_states(inside, states, len(YEARS))


def _heads(spark, d, seeds, epochs):
    packs = L.shards(_for_heads(cut(_labelled(spark, d)), _states(spark, d)))
    return L.train_heads(packs, seeds, epochs=epochs).select("seed", "name", "shape", F.round("loss", 6).alias("loss"))


@query()
def train_head(spark, d):
    return _heads(spark, d, [42], 5)


@query()
def bootstrap_train(spark, d):
    """Ten heads, each on its own resample of all labelled pairs, side by side."""
    return _heads(spark, d, list(range(42, 52)), 3)


@query()
def sampling_mode_train(spark, d):
    """mode, seed, loss, n_negatives of heads trained on the negatives of each
    sampling mode: external edges in or out, within industries or anywhere. The
    first run of a mode starts anew, later ones from its weights; runs are kept
    in a ledger, and one that is there is not repeated."""
    pos, ids, n = S._pos(spark, d).distinct(), S._ids(spark, d), T.nodes(spark, d)
    known, states, members = S._known(spark, d), _states(spark, d), E.industry_members(n)
    ledger = ST.Ledger(spark, f"{shared_dir(spark)}/modes-{ST.joint_key(ST.rows_key(pos), ST.rows_key(known), ST.rows_key(states))[:40]}")
    year = (F.col("year") - YEARS[0]).cast("int").alias("pos")
    for mode, (filtered, inside) in sorted(S.S.MODES.items()):
        if all(ledger.has(mode=mode, seed=seed) for seed in (42, 43)):
            continue
        bad = cut(S.S.paired_negatives(pos, ids, known if filtered else pos, S.SEED, members if inside else None).select("new_src", "new_tgt", "year"))
        rows = pos.select("src", "tgt", year, F.lit(1).alias("label")).unionByName(bad.select(F.col("new_src").alias("src"), F.col("new_tgt").alias("tgt"), year, F.lit(0).alias("label")))
        packs, count, donor = L.shards(_for_heads(rows, states)), bad.count(), None
        for seed in (42, 43):
            ledger.run(lambda: cut(L.train_heads(packs, [seed], epochs=3, start=donor)).drop("seed").withColumn("n_negatives", F.lit(count)), mode=mode, seed=seed)  # noqa: B023
            donor = donor or L.weights_of(ledger.rows("mode", "seed").where((F.col("mode") == mode) & (F.col("seed") == seed)).collect())
    return ledger.rows("mode", "seed").groupBy("mode", "seed").agg(F.round(F.max("loss"), 6).alias("loss"), F.max("n_negatives").cast("long").alias("n_negatives"))
