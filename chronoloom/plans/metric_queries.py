"""Queries that evaluate scores and their stability."""

from pyspark.sql import functions as F

from chronoloom.catalog import query
from chronoloom.operators import edges as E
from chronoloom.operators import metrics as M
from chronoloom.operators import stability as V
from chronoloom.oracle import sql
from chronoloom.sources import tables as T


def rounded(df, *cols, places=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


def _ens(spark, d):
    """The ensemble, to six places so that both engines see the same ties."""
    return rounded(M.ensemble(T.scores(spark, d)), "prob")


CONF = """sum(CAST(hit AND label = 1 AS BIGINT))::BIGINT AS tp, sum(CAST(hit AND label <> 1 AS BIGINT))::BIGINT AS fp,
  sum(CAST(NOT hit AND label = 1 AS BIGINT))::BIGINT AS fn, sum(CAST(NOT hit AND label <> 1 AS BIGINT))::BIGINT AS tn"""


def _r(a: str, b: str) -> str:
    return f"round(coalesce(({a})::DOUBLE / nullif({b}, 0), 0), 6)"


RATES = f"""{_r("tp", "tp + fp")} AS precision, {_r("tp", "tp + fn")} AS recall, {_r("2 * tp", "2 * tp + fp + fn")} AS f1, {_r("5 * tp", "5 * tp + 4 * fn + fp")} AS f2, {_r("fp", "fp + tn")} AS fpr"""
CUM = "SELECT t.prob, count(*) FILTER (WHERE s.label = 1 AND s.prob >= t.prob) AS tp, count(*) FILTER (WHERE s.label = 0 AND s.prob >= t.prob) AS fp, count(*) FILTER (WHERE s.label = 1 AND s.prob < t.prob) AS fn, count(*) FILTER (WHERE s.label = 0 AND s.prob < t.prob) AS tn FROM (SELECT DISTINCT prob FROM m0) t, m0 s GROUP BY t.prob"
M0 = "SELECT label, prob FROM scores WHERE model_id = 0"


def _m0(spark, d):
    return T.scores(spark, d).where("model_id = 0").select("label", "prob")


@query(sql(f"SELECT model_id, tp, fp, fn, tn, {RATES} FROM (SELECT model_id, {CONF} FROM (SELECT *, prob > 0.5 AS hit FROM scores) GROUP BY model_id)", "scores"))
def confusion_metrics(spark, d):
    return rounded(M.confusion(T.scores(spark, d), 0.5, True, ("model_id",)), "precision", "recall", "f1", "f2", "fpr")


@query(sql(f"SELECT model_id, {_r('5 * tp', '5 * tp + 4 * fn + fp')} AS f2 FROM (SELECT model_id, {CONF} FROM (SELECT *, prob >= 0.452 AS hit FROM scores) GROUP BY model_id)", "scores"))
def fbeta(spark, d):
    return rounded(M.confusion(T.scores(spark, d), 0.452, False, ("model_id",)).select("model_id", "f2"), "f2")


@query(sql("""SELECT p.model_id, round(sum(CASE WHEN p.prob > n.prob THEN p.c * n.c WHEN p.prob = n.prob THEN p.c * n.c / 2.0::DOUBLE ELSE 0 END)::DOUBLE / sum(p.c * n.c)::DOUBLE, 6) AS auc
  FROM (SELECT model_id, prob, count(*) AS c FROM scores WHERE label = 1 GROUP BY ALL) p JOIN (SELECT model_id, prob, count(*) AS c FROM scores WHERE label = 0 GROUP BY ALL) n USING (model_id) GROUP BY p.model_id""", "scores"))  # fmt: skip
def roc_auc(spark, d):
    return rounded(M.roc_auc(T.scores(spark, d), ("model_id",)), "auc")


@query(sql(f"SELECT CAST('Infinity' AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT prob, {_r('fp', 'fp + tn')}, {_r('tp', 'tp + fn')} FROM c", "scores", m0=M0, c=CUM))
def roc_curve(spark, d):
    return rounded(M.roc_curve(_m0(spark, d)), "fpr", "tpr")


@query(sql(f"SELECT prob AS threshold, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall FROM c UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE", "scores", m0=M0, c=CUM))
def pr_curve(spark, d):
    return rounded(M.pr_curve(_m0(spark, d)), "precision", "recall")


@query(sql("""SELECT round(sum((recall - r0) * (precision + p0) / 2), 6) AS pr_auc FROM (
  SELECT *, lag(recall) OVER (ORDER BY prob DESC NULLS FIRST) AS r0, lag(precision) OVER (ORDER BY prob DESC NULLS FIRST) AS p0 FROM (
    SELECT prob, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall FROM c UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE))""", "scores", m0=M0, c=CUM))  # fmt: skip
def pr_auc(spark, d):
    return rounded(M.pr_auc(_m0(spark, d)), "pr_auc")


YOUDEN = "SELECT prob, tp, fp, fn, tn, round(tp::DOUBLE / (tp + fn) - fp::DOUBLE / (fp + tn), 12) AS j FROM c ORDER BY j DESC, prob DESC LIMIT 1"


@query(sql(f"SELECT prob AS threshold, round(j, 6) AS j, {_r('fp', 'fp + tn')} AS fpr, {_r('tp', 'tp + fn')} AS tpr, {_r('2 * tp', '2 * tp + fp + fn')} AS f1, {_r('5 * tp', '5 * tp + 4 * fn + fp')} AS f2 FROM y", "scores", m0=M0, c=CUM, y=YOUDEN))
def youden(spark, d):
    return rounded(M.youden(_m0(spark, d)), "j", "fpr", "tpr", "f1", "f2")


def _grid(start: int, stop: int, step: int) -> str:
    return f"SELECT t.t, count(*) FILTER (WHERE label = 1 AND prob >= t.t) AS tp, count(*) FILTER (WHERE label = 0 AND prob >= t.t) AS fp, count(*) FILTER (WHERE label = 1 AND prob < t.t) AS fn, count(*) FILTER (WHERE label = 0 AND prob < t.t) AS tn FROM (SELECT i / 1000.0::DOUBLE AS t FROM range({start}, {stop}, {step}) r(i)) t, m0 GROUP BY t.t"


_F = {"f1": "2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0)", "f2": "5.0::DOUBLE * tp / nullif(5 * tp + 4 * fn + fp, 0)"}


@query(sql(f"SELECT 'f1' AS metric, t AS threshold, round(v, 6) AS value FROM (SELECT t, round({_F['f1']}, 12) AS v FROM g ORDER BY v DESC NULLS LAST, t LIMIT 1) UNION ALL SELECT 'f2', t, round(v, 6) FROM (SELECT t, round({_F['f2']}, 12) AS v FROM g ORDER BY v DESC NULLS LAST, t LIMIT 1)", "scores", m0=M0, g=_grid(100, 900, 1)))
def f1_f2_grid(spark, d):
    g = M.grid(spark, 100, 900, 1, 1000)
    a, b = (M.best_on_grid(_m0(spark, d), g, m).select(F.lit(m).alias("metric"), "threshold", "value") for m in ("f1", "f2"))
    return rounded(a.unionByName(b), "value")


@query(sql("SELECT prob AS threshold, round(gap, 6) AS gap FROM (SELECT prob, round(abs(tp::DOUBLE / (tp + fp) - tp::DOUBLE / (tp + fn)), 12) AS gap FROM c ORDER BY gap, prob LIMIT 1)", "scores", m0=M0, c=CUM))
def pr_balance(spark, d):
    return rounded(M.balance_point(_m0(spark, d)), "gap")


@query(sql(f"SELECT t AS threshold, tp, fp, fn, tn, {RATES} FROM g", "scores", m0=M0, g=_grid(50, 950, 5)))
def threshold_metrics_grid(spark, d):
    return rounded(M.sweep(_m0(spark, d), M.grid(spark, 50, 950, 5, 1000)), "precision", "recall", "f1", "f2", "fpr")


_AT = "SELECT method, threshold, count(*) FILTER (WHERE label = 1 AND prob >= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND prob >= threshold) AS fp, count(*) FILTER (WHERE label = 1 AND prob < threshold) AS fn, count(*) FILTER (WHERE label = 0 AND prob < threshold) AS tn FROM n, m0 GROUP BY method, threshold"
_METHODS = f"""SELECT 'youden_j' AS method, prob AS threshold FROM y UNION ALL SELECT 'fixed_0.5', 0.5::DOUBLE UNION ALL SELECT 'fixed_0.452', 0.452::DOUBLE
  UNION ALL SELECT 'f1_max', t FROM (SELECT t FROM g ORDER BY round({_F["f1"]}, 12) DESC NULLS LAST, t LIMIT 1) UNION ALL SELECT 'f2_max', t FROM (SELECT t FROM g ORDER BY round({_F["f2"]}, 12) DESC NULLS LAST, t LIMIT 1)
  UNION ALL SELECT 'prec_rec_balance', prob FROM (SELECT prob FROM c ORDER BY round(abs(tp::DOUBLE / (tp + fp) - tp::DOUBLE / (tp + fn)), 12), prob LIMIT 1)"""


@query(sql(f"SELECT method, threshold, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall, {_r('2 * tp', '2 * tp + fp + fn')} AS f1, {_r('5 * tp', '5 * tp + 4 * fn + fp')} AS f2 FROM a", "scores", m0=M0, c=CUM, y=YOUDEN, g=_grid(100, 900, 1), n=_METHODS, a=_AT))
def threshold_table(spark, d):
    return rounded(M.threshold_table(_m0(spark, d)), "precision", "recall", "f1", "f2")


_CUMBY = "SELECT t.model_id, t.prob, count(*) FILTER (WHERE s.label = 1 AND s.prob >= t.prob) AS tp, count(*) FILTER (WHERE s.label = 0 AND s.prob >= t.prob) AS fp, count(*) FILTER (WHERE s.label = 1) AS p, count(*) FILTER (WHERE s.label = 0) AS n FROM (SELECT DISTINCT model_id, prob FROM scores) t JOIN scores s USING (model_id) GROUP BY t.model_id, t.prob"


@query(sql("SELECT model_id, prob AS threshold, round(j, 6) AS j FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY j DESC, prob DESC) AS rn FROM (SELECT model_id, prob, round(tp::DOUBLE / p - fp::DOUBLE / n, 12) AS j FROM c)) WHERE rn = 1", "scores", c=_CUMBY))
def per_model_thresholds(spark, d):
    return rounded(M.youden(T.scores(spark, d), ("model_id",)).select("model_id", "threshold", "j"), "j")


@query(sql("""SELECT round(avg(t), 6) AS mean, round(stddev_samp(t), 6) AS std, round(median(t), 6) AS median, min(t) AS min, max(t) AS max, round(max(t) - min(t), 6) AS range, count(t) AS n
  FROM (SELECT arg_max(prob, j * 1e6 + prob) AS t FROM (SELECT model_id, prob, round(tp::DOUBLE / p - fp::DOUBLE / n, 12) AS j FROM c) GROUP BY model_id)""", "scores", c=_CUMBY))  # fmt: skip
def threshold_summary(spark, d):
    return rounded(V.summary(M.youden(T.scores(spark, d), ("model_id",)), "threshold"), "mean", "std", "median", "range")


@query(sql("SELECT sample_id, label, prob FROM ensemble", "ensemble"))
def ensemble_mean(spark, d):
    return _ens(spark, d)


@query(sql("SELECT x.model_id AS a, y.model_id AS b, round(corr(x.prob, y.prob), 6) AS r FROM scores x JOIN scores y USING (sample_id) WHERE x.model_id < y.model_id GROUP BY 1, 2", "scores"))
def model_correlation(spark, d):
    return rounded(M.correlations(T.scores(spark, d)), "r")


@query(sql("SELECT round(avg((SELECT count(*) FROM scores s WHERE s.model_id = 0 AND s.prob < r.prob)::DOUBLE / (SELECT count(*) FROM scores WHERE model_id = 0)), 6) AS mean_quantile FROM scores r WHERE r.model_id = 1", "scores"))
def external_quantile(spark, d):
    s = T.scores(spark, d)
    return rounded(M.mean_quantile(s.where("model_id = 1"), s.where("model_id = 0")), "mean_quantile")


@query(sql("""SELECT round(sum(abs(ca / na - cb / nb) * (nx - v)), 6) AS distance FROM (
  SELECT v, lead(v) OVER (ORDER BY v) AS nx, sum(a) OVER (ORDER BY v)::DOUBLE AS ca, sum(b) OVER (ORDER BY v)::DOUBLE AS cb, sum(a) OVER ()::DOUBLE AS na, sum(b) OVER ()::DOUBLE AS nb
  FROM (SELECT prob AS v, count(*) FILTER (WHERE label = 1) AS a, count(*) FILTER (WHERE label = 0) AS b FROM scores WHERE model_id = 0 GROUP BY prob))""", "scores"))  # fmt: skip
def wasserstein(spark, d):
    s = _m0(spark, d)
    return rounded(M.wasserstein(s.where("label = 1"), s.where("label = 0")), "distance")


@query(sql("""SELECT round(-avg(label * greatest(ln(greatest(prob, 1e-300)), -100) + (1 - label) * greatest(ln(greatest(1 - prob, 1e-300)), -100)), 6) AS bce,
  (SELECT round(sum(greatest(0, 0.1::DOUBLE - (p.prob - n.prob)) * p.c * n.c) / sum(p.c * n.c)::DOUBLE, 6) FROM (SELECT prob, count(*) AS c FROM m0 WHERE label = 1 GROUP BY prob) p, (SELECT prob, count(*) AS c FROM m0 WHERE label = 0 GROUP BY prob) n) AS margin_loss FROM m0""", "scores", m0=M0))  # fmt: skip
def bce_margin_loss(spark, d):
    s = _m0(spark, d)
    return rounded(M.bce(s).join(M.margin_loss(s), how="cross"), "bce", "margin_loss")  # one row each


@query(sql("SELECT CAST(least(floor(round(prob * 50, 9)), 49) AS INTEGER) AS bin, count(*) AS n, round(count(*) * 50 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS density FROM m0 GROUP BY 1", "scores", m0=M0))
def score_histogram(spark, d):
    return rounded(M.histogram(_m0(spark, d)), "density")


@query(sql("SELECT prob, round(sum(count(*)) OVER (ORDER BY prob) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS cdf FROM m0 GROUP BY prob", "scores", m0=M0))
def empirical_cdf(spark, d):
    return rounded(M.empirical_cdf(_m0(spark, d)), "cdf")


AUCBY = """SELECT p.model_id, sum(CASE WHEN p.prob > n.prob THEN p.c * n.c WHEN p.prob = n.prob THEN p.c * n.c / 2.0::DOUBLE ELSE 0 END)::DOUBLE / sum(p.c * n.c)::DOUBLE AS v
  FROM (SELECT model_id, prob, count(*) AS c FROM scores WHERE label = 1 GROUP BY ALL) p JOIN (SELECT model_id, prob, count(*) AS c FROM scores WHERE label = 0 GROUP BY ALL) n USING (model_id) GROUP BY p.model_id"""
F1BY = f"SELECT model_id, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS v FROM (SELECT model_id, {CONF} FROM (SELECT *, prob > 0.5 AS hit FROM scores) GROUP BY model_id)"


@query(sql("SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS range FROM (SELECT 'auc' AS metric, v FROM a UNION ALL SELECT 'f1', v FROM f) GROUP BY metric", "scores", a=AUCBY, f=F1BY))
def macro_stability(spark, d):
    return rounded(V.macro(T.scores(spark, d)), "mean", "std", "min", "max", "range")


MAT = "SELECT sample_id, max(label) AS label, round(avg(prob), 6) AS mean_prob, round(stddev_pop(prob), 6) AS std_prob, round(quantile_cont(prob, 0.025::DOUBLE), 6) AS pi_low, round(quantile_cont(prob, 0.975::DOUBLE), 6) AS pi_high, round(quantile_cont(prob, 0.975::DOUBLE) - quantile_cont(prob, 0.025::DOUBLE), 6) AS pi_width FROM scores GROUP BY sample_id"


def _matrix(spark, d):
    return rounded(V.matrix(T.scores(spark, d)), "mean_prob", "std_prob", "pi_low", "pi_high", "pi_width")


@query(sql(MAT, "scores"))
def prediction_intervals(spark, d):
    return _matrix(spark, d)


@query(sql("SELECT round(quantile_cont(std_prob, 0.5::DOUBLE), 6) AS median_std, round(quantile_cont(std_prob, 0.9::DOUBLE), 6) AS p90_std, round(quantile_cont(std_prob, 0.95::DOUBLE), 6) AS p95_std, round(avg(std_prob), 6) AS mean_std, round(avg(CAST(std_prob < 0.05 AS INTEGER)), 6) AS stable_share, round(avg(CAST(std_prob > 0.1 AS INTEGER)), 6) AS unstable_share FROM mat", "scores", mat=MAT))
def micro_stability(spark, d):
    m = V.micro(_matrix(spark, d))
    return rounded(m, *m.columns)


@query(sql("SELECT round(avg(pi_width), 6) AS mean_width, round(quantile_cont(pi_width, 0.5::DOUBLE), 6) AS median_width, round(quantile_cont(pi_width, 0.9::DOUBLE), 6) AS p90_width FROM mat", "scores", mat=MAT))
def interval_widths(spark, d):
    m = V.intervals(_matrix(spark, d))
    return rounded(m, *m.columns)


@query(sql("SELECT sample_id, " + ", ".join(f"max(prob) FILTER (WHERE model_id = {i}) AS model_{i}_prob" for i in range(5)) + " FROM scores GROUP BY sample_id", "scores"))
def prediction_matrix_wide(spark, d):
    return V.wide(T.scores(spark, d), T.MODELS)


@query(sql("SELECT model_id, min(prob) AS min, round(quantile_cont(prob, 0.25::DOUBLE), 6) AS q1, round(quantile_cont(prob, 0.5::DOUBLE), 6) AS median, round(quantile_cont(prob, 0.75::DOUBLE), 6) AS q3, max(prob) AS max FROM scores GROUP BY model_id", "scores"))
def five_numbers(spark, d):
    return rounded(V.five_numbers(T.scores(spark, d), "prob", ("model_id",)), "q1", "median", "q3")


FLAG = "SELECT mat.*, src, tgt, year, std_prob > 0.1 AS high_var, mean_prob BETWEEN 0.3 AND 0.7 AS boundary FROM mat JOIN samples USING (sample_id)"


def _flagged(spark, d):
    return V.flagged(_matrix(spark, d).join(T.samples(spark, d), "sample_id"))


_VAR = "count(*) AS n, count(*) FILTER (WHERE high_var) AS n_high, round(avg(std_prob), 6) AS mean_std, round(quantile_cont(std_prob, 0.5::DOUBLE), 6) AS median_std, round(avg(CAST(high_var AS INTEGER)), 6) AS high_share, count(*) FILTER (WHERE high_var AND label = 1) AS n_high_positive"


@query(sql(f"SELECT year, {_VAR} FROM f GROUP BY year", "scores", "samples", mat=MAT, f=FLAG))
def highvar_by_year(spark, d):
    return rounded(V.variance_by(_flagged(spark, d), "year"), "mean_std", "median_std", "high_share")


@query(sql(f"SELECT year, label, {_VAR} FROM f GROUP BY year, label", "scores", "samples", mat=MAT, f=FLAG))
def highvar_year_label(spark, d):
    return rounded(V.variance_by(_flagged(spark, d), "year", "label"), "mean_std", "median_std", "high_share")


@query(sql("SELECT boundary, count(*) AS n, round(avg(CAST(high_var AS INTEGER)), 6) AS high_share FROM f GROUP BY boundary", "scores", "samples", mat=MAT, f=FLAG))
def boundary_effect(spark, d):
    return rounded(V.boundary_effect(_flagged(spark, d)), "high_share")


DEGS = "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM pos UNION ALL SELECT tgt FROM pos) GROUP BY node"
_BUCKETS = ", ".join(f"({i}, '{b}', {lo}, {hi})" for i, (b, lo, hi) in enumerate(zip(V.DEGREE_LABELS, [-1, *V.DEGREE_EDGES[1:-1]], V.DEGREE_EDGES[1:], strict=True)))


@query(sql(f"""SELECT bin, bucket, count(degree) AS n, count(*) FILTER (WHERE high_var) AS n_high, round(avg(std_prob), 6) AS mean_std, round(avg(CAST(high_var AS INTEGER)), 6) AS high_share
  FROM (VALUES {_BUCKETS}) b(bin, bucket, lo, hi) LEFT JOIN (SELECT f.*, coalesce(degree, 0) AS degree FROM f LEFT JOIN deg ON node = src) x ON degree > lo AND degree <= hi GROUP BY bin, bucket""", "scores", "samples", "pos", mat=MAT, f=FLAG, deg=DEGS))  # fmt: skip
def highvar_by_degree(spark, d):
    rows = V.with_degrees(_flagged(spark, d), E.scan_edges(T.nodes(spark, d), T.edges(spark, d)))
    return rounded(V.by_degree(rows, "src_deg"), "mean_std", "high_share")


@query(sql("""SELECT CAST(b AS INTEGER) AS bin, (b + 0.5::DOUBLE) / 10 AS mid, count(f.sample_id) AS n, count(*) FILTER (WHERE high_var) AS n_high, round(avg(std_prob), 6) AS mean_std, round(avg(label), 6) AS positive_share
  FROM range(0, 10) r(b) LEFT JOIN f ON mean_prob > b / 10.0::DOUBLE AND mean_prob <= (b + 1) / 10.0::DOUBLE GROUP BY b""", "scores", "samples", mat=MAT, f=FLAG))  # fmt: skip
def highvar_by_prob(spark, d):
    return rounded(V.by_probability(_flagged(spark, d)), "mean_std", "positive_share")


@query(sql("""SELECT CAST(b AS INTEGER) AS bin, (b + 0.5::DOUBLE) / 20 AS mid, count(f.sample_id) AS n, count(*) FILTER (WHERE high_var) AS n_high, round(avg(std_prob), 6) AS mean_std, round(avg(label), 6) AS positive_share
  FROM range(0, 20) r(b) LEFT JOIN f ON mean_prob > b / 20.0::DOUBLE AND mean_prob <= (b + 1) / 20.0::DOUBLE GROUP BY b""", "scores", "samples", mat=MAT, f=FLAG))  # fmt: skip
def highvar_by_confidence(spark, d):
    return rounded(V.by_probability(_flagged(spark, d), 20), "mean_std", "positive_share")


_HEAT = "CASE " + " ".join(f"WHEN {{0}} > {a} AND {{0}} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(V.HEAT_EDGES[:-1], V.HEAT_EDGES[1:], strict=True))) + " END"


@query(sql("SELECT CAST(sb AS INTEGER) AS src_bin, " + ", ".join(f"round(avg(CAST(high_var AS INTEGER)) FILTER (WHERE tb = {i}), 6) AS tgt_{i}" for i in range(len(V.HEAT_EDGES) - 1)) + f" FROM (SELECT high_var, {_HEAT.format('a.degree')} AS sb, {_HEAT.format('b.degree')} AS tb FROM f JOIN deg a ON a.node = src JOIN deg b ON b.node = tgt) WHERE sb IS NOT NULL AND tb IS NOT NULL GROUP BY sb", "scores", "samples", "pos", mat=MAT, f=FLAG, deg=DEGS))
def degree_heatmap(spark, d):
    rows = V.with_degrees(_flagged(spark, d), E.scan_edges(T.nodes(spark, d), T.edges(spark, d)))
    h = V.degree_heatmap(rows)
    return rounded(h, *[c for c in h.columns if c != "src_bin"])


@query(sql("SELECT round(avg(s) FILTER (WHERE year <= 1997), 6) AS early, round(avg(s) FILTER (WHERE year >= 1999), 6) AS late FROM (SELECT year, avg(CAST(high_var AS INTEGER)) AS s FROM f GROUP BY year)", "scores", "samples", mat=MAT, f=FLAG))
def year_thirds(spark, d):
    return rounded(V.thirds(_flagged(spark, d)), "early", "late")


_AT = ", ".join(f"({i / 10}::DOUBLE)" for i in range(1, 10))


@query(sql(f"SELECT t AS at, prob AS threshold, fpr, tpr FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(abs(prob - t), 9), prob DESC) AS rn FROM (SELECT prob, {_r('fp', 'fp + tn')} AS fpr, {_r('tp', 'tp + fn')} AS tpr FROM c), (VALUES {_AT}) v(t)) WHERE rn = 1", "scores", m0=M0, c=CUM))
def roc_nearest_point(spark, d):
    return rounded(M.nearest_points(M.roc_curve(_m0(spark, d)), [i / 10 for i in range(1, 10)]), "fpr", "tpr")


@query(sql("SELECT round(min(gap), 6) AS gap FROM (SELECT lead(prob) OVER (ORDER BY prob) - prob AS gap FROM (SELECT DISTINCT prob FROM m0))", "scores", m0=M0))
def least_score_gap(spark, d):
    return rounded(M.least_gap(_m0(spark, d), "prob"), "gap")


@query(sql("SELECT sample_id, model_id, prob, CASE WHEN label = 1 THEN e END AS ensemble FROM (SELECT s.*, n.prob AS e FROM scores s JOIN ensemble n USING (sample_id))", "scores", "ensemble"))
def ensemble_lookup(spark, d):
    """Model scores beside the ensemble's, which is known for positives only."""
    side = _ens(spark, d).where("label = 1").withColumnRenamed("prob", "ensemble")
    return M.with_side(T.scores(spark, d).select("sample_id", "model_id", "prob"), side, ["sample_id"], ["ensemble"])
