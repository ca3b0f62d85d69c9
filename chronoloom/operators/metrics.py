"""Evaluation of scores: confusion, curves, thresholds, distances, losses.

Scores come as rows (label 0/1, prob), possibly with grouping columns (by). NaN
and null scores are left out. Curves group by distinct score first, and sums
along the sorted scores are ``functions.scan``, range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.lineage import cut
from chronoloom.functions.scan import scan


def clean(scores: DataFrame, prob: str = "prob") -> DataFrame:
    return scores.where(F.col(prob).isNotNull() & ~F.isnan(prob))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rates(rows: DataFrame) -> DataFrame:
    """precision, recall, f1, f2 and fpr from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return rows.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn)).withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn)).withColumn("f2", _ratio(5 * tp, 5 * tp + 4 * fn + fp)).withColumn("fpr", _ratio(fp, fp + tn))


def confusion(scores: DataFrame, threshold: float = 0.5, strict: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates at one threshold (prob > or >= threshold)."""
    hit = F.col("prob") > threshold if strict else F.col("prob") >= threshold
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    pos = F.col("label") == 1
    return rates(clean(scores).groupBy(*by).agg(n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & pos).alias("fn"), n(~hit & ~pos).alias("tn")))


def by_score(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """prob, pos, neg: counts of each distinct score."""
    return clean(scores).groupBy(*by, "prob").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") != 1).cast("long")).alias("neg"))


def cumulative(scores: DataFrame, by: tuple[str, ...] = (), ahead: tuple[str, ...] = ()) -> DataFrame:
    """For each distinct score: pos, neg, and tp, fp, fn, tn of prob >= score."""
    d = scan(by_score(scores, by), by, [("prob", True)], ["pos", "neg"], ahead)
    return d.withColumns({"tp": F.col("upto_pos"), "fp": F.col("upto_neg"), "fn": F.col("all_pos") - F.col("upto_pos"), "tn": F.col("all_neg") - F.col("upto_neg")}).drop("upto_pos", "upto_neg", "all_pos", "all_neg")


def roc_auc(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by ranks, ties half; 0.5 with one class only."""
    d = scan(by_score(scores, by), by, [("prob", False)], ["neg"])
    d = d.withColumn("won", F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2))
    return d.groupBy(*by).agg(F.sum("won").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(*by, F.coalesce(F.try_divide(F.col("w"), F.col("p").cast("double") * F.col("n")), F.lit(0.5)).alias("auc"))


def roc_curve(scores: DataFrame, by: tuple[str, ...] = (), drop_collinear: bool = False) -> DataFrame:
    """threshold, fpr, tpr by descending threshold, from (0, 0) at infinity."""
    d = cumulative(scores, by, ("pos", "neg") if drop_collinear else ())
    d = d.withColumns({"threshold": F.col("prob"), "p": F.col("tp") + F.col("fn"), "n": F.col("fp") + F.col("tn")})
    if drop_collinear:
        # the step to the next point is as long as the step to this one
        straight = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
        d = d.where(~F.coalesce(straight, F.lit(False)))
    d = d.select(*by, "threshold", "tp", "fp", "p", "n")
    start = d.groupBy(*by).agg(F.max("p").alias("p"), F.max("n").alias("n")).where("p is not null").select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "p", "n")
    return d.unionByName(start).select(*by, "threshold", _ratio(F.col("fp"), F.col("n")).alias("fpr"), _ratio(F.col("tp"), F.col("p")).alias("tpr"))


def pr_curve(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """threshold, precision, recall; the last point (null, 1, 0) ends it."""
    d = rates(cumulative(scores, by)).select(*by, F.col("prob").alias("threshold"), "precision", "recall")
    end = d.select(*by).distinct() if by else d.limit(1).select()
    return d.unionByName(end.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def pr_auc(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Trapezoids under the precision-recall curve (not average precision).
    The point before a score's has its counts without the score's own; before
    the first lies (1, 0)."""
    d = rates(cumulative(scores, by))
    tp, fp = (F.col("tp") - F.col("pos")).cast("double"), (F.col("fp") - F.col("neg")).cast("double")
    before = F.when(tp + fp == 0, F.lit(1.0)).otherwise(_ratio(tp, tp + fp))
    part = (F.col("recall") - _ratio(tp, F.col("tp") + F.col("fn"))) * (F.col("precision") + before) / 2
    return d.groupBy(*by).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("pr_auc"))


def youden(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The threshold with the largest tpr - fpr; ties to the larger threshold."""
    d = rates(cumulative(scores, by))
    j = F.round(F.col("recall") - F.col("fpr"), 12)
    best = F.max_by(F.struct("prob", j.alias("j"), "fpr", "recall", "f1", "f2"), F.struct(j, F.col("prob")))
    return d.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.prob").alias("threshold"), F.col("b.j").alias("j"), F.col("b.fpr").alias("fpr"), F.col("b.recall").alias("tpr"), F.col("b.f1").alias("f1"), F.col("b.f2").alias("f2"))


def grid(spark, start: int, stop: int, step: int, scale: int) -> DataFrame:
    """threshold: start, start + step, ... below stop, all divided by scale."""
    return spark.range(start, stop, step).select((F.col("id") / F.lit(float(scale))).alias("threshold"))


def sweep(scores: DataFrame, thresholds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rates at each threshold (prob >= threshold). One sort of distinct scores
    and thresholds together with cumulative sums, instead of a theta join."""
    d = by_score(scores, by).withColumn("grid", F.lit(0))
    groups = d.select(*by).distinct() if by else None
    g = thresholds if groups is None else thresholds.join(F.broadcast(groups), how="cross")  # thresholds for each group
    g = g.select(*by, F.col("threshold").alias("prob"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"), F.lit(1).alias("grid"))
    d = scan(d.unionByName(g), by, [("prob", True), ("grid", False)], ["pos", "neg"]).where("grid = 1")
    tp, fp = F.col("upto_pos"), F.col("upto_neg")
    return rates(d.select(*by, F.col("prob").alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.col("all_pos") - tp).alias("fn"), (F.col("all_neg") - fp).alias("tn")))


def best_on_grid(scores: DataFrame, thresholds: DataFrame, metric: str, by: tuple[str, ...] = ()) -> DataFrame:
    """threshold, value: the first threshold with the largest metric above 0;
    0.5 if there is none."""
    d = sweep(scores, thresholds, by)
    top = F.max(F.struct(F.round(metric, 12).alias("v"), (-F.col("threshold")).alias("t")))
    found = d.groupBy(*by).agg(top.alias("b"))
    some = F.col("b.v") > 0
    return found.select(*by, F.when(some, -F.col("b.t")).otherwise(F.lit(0.5)).alias("threshold"), F.when(some, F.col("b.v")).otherwise(F.lit(0.0)).alias("value"))


def balance_point(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The curve's threshold with the smallest |precision - recall| (the first
    in ascending order); 0.5 if that is the end of the curve."""
    d = pr_curve(scores, by).withColumn("gap", F.round(F.abs(F.col("precision") - F.col("recall")), 12))
    first = F.min(F.struct("gap", F.col("threshold").isNull().alias("end"), "threshold"))
    return d.groupBy(*by).agg(first.alias("b")).select(*by, F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"), F.col("b.gap").alias("gap"))


def at_thresholds(scores: DataFrame, named: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """method, threshold and the rates there."""
    t = sweep(scores, named.select("threshold").distinct(), by)
    return named.join(t, "threshold").select(*by, "method", "threshold", "precision", "recall", "f1", "f2")


def threshold_table(scores: DataFrame, fixed: tuple[float, ...] = (0.5, 0.452)) -> DataFrame:
    """Rates at the thresholds of every method and at the fixed ones."""
    spark = scores.sparkSession
    fine = grid(spark, 100, 900, 1, 1000)
    named = youden(scores).select(F.lit("youden_j").alias("method"), "threshold")
    named = named.unionByName(best_on_grid(scores, fine, "f1").select(F.lit("f1_max").alias("method"), "threshold"))
    named = named.unionByName(best_on_grid(scores, fine, "f2").select(F.lit("f2_max").alias("method"), "threshold"))
    named = named.unionByName(balance_point(scores).select(F.lit("prec_rec_balance").alias("method"), "threshold"))
    named = named.unionByName(spark.createDataFrame([(f"fixed_{x:g}", float(x)) for x in fixed], "method string, threshold double"))
    return at_thresholds(scores, named)


def ensemble(scores: DataFrame) -> DataFrame:
    """sample_id, label, prob: the mean over models."""
    return clean(scores).groupBy("sample_id").agg(F.max("label").alias("label"), F.avg("prob").alias("prob"))


def correlations(scores: DataFrame) -> DataFrame:
    """a, b, r: Pearson correlation of each pair of models over samples. Models
    are few: their scores of a sample meet in one row."""
    wide = clean(scores).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("model_id", "prob"))).alias("m"))
    pair = lambda x, y: F.struct(x["model_id"].alias("a"), y["model_id"].alias("b"), x["prob"].alias("x"), y["prob"].alias("y"))
    later = lambda x: F.filter("m", lambda y: y["model_id"] > x["model_id"])
    pairs = wide.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(later(x), lambda y: pair(x, y))))).alias("p")).select("p.*")
    return pairs.groupBy("a", "b").agg(F.corr("x", "y").alias("r"))


def quantile_of(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """prob, quantile: the share of reference scores strictly below."""
    n = clean(reference).groupBy("prob").agg(F.count("*").alias("ref")).withColumn("ask", F.lit(0).cast("long"))
    m = clean(scores).groupBy("prob").agg(F.count("*").alias("ask")).withColumn("ref", F.lit(0).cast("long"))
    d = n.unionByName(m).groupBy("prob").agg(F.sum("ref").alias("ref"), F.sum("ask").alias("ask"))
    d = scan(d, (), [("prob", False)], ["ref"])
    d = d.withColumn("quantile", F.try_divide((F.col("upto_ref") - F.col("ref")).cast("double"), F.col("all_ref")))
    return d.where("ask > 0").select("prob", "quantile", "ask")


def mean_quantile(scores: DataFrame, reference: DataFrame) -> DataFrame:
    return quantile_of(scores, reference).agg(F.try_divide(F.sum(F.col("quantile") * F.col("ask")), F.sum("ask")).alias("mean_quantile"))


def wasserstein(a: DataFrame, b: DataFrame, col: str = "prob") -> DataFrame:
    """Exact first Wasserstein distance of two samples."""
    side = lambda d, x, y: clean(d, col).groupBy(F.col(col).alias("v")).agg(F.count("*").alias(x)).withColumn(y, F.lit(0).cast("long"))
    d = side(a, "na", "nb").unionByName(side(b, "nb", "na")).groupBy("v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    d = scan(d, (), [("v", False)], ["na", "nb"], ["v"])
    gap = F.abs(F.col("upto_na") / F.col("all_na") - F.col("upto_nb") / F.col("all_nb"))
    return d.agg(F.coalesce(F.sum(gap * (F.col("next_v") - F.col("v"))), F.lit(0.0)).alias("distance"))


def bce(scores: DataFrame, floor: float = -100.0) -> DataFrame:
    """Mean binary cross entropy, logarithms clamped from below."""
    log = lambda x: F.greatest(F.when(x > 0, F.ln(x)).otherwise(F.lit(floor)), F.lit(floor))
    y, p = F.col("label"), F.col("prob")
    return clean(scores).agg((-F.avg(y * log(p) + (1 - y) * log(1 - p))).alias("bce"))


def margin_loss(scores: DataFrame, margin: float = 0.1) -> DataFrame:
    """Mean over all positive x negative pairs of max(0, margin - (p - n)).

    In closed form: for each distinct positive score p, counts and sums of the
    negatives above p - margin come from one cumulative pass."""
    d = by_score(scores)
    neg = d.where("neg > 0").select(F.col("prob").alias("at"), "neg", (F.col("prob") * F.col("neg")).alias("s"), F.lit(0).cast("long").alias("pos"), F.lit(1).alias("kind"))
    pos = d.where("pos > 0").select((F.col("prob") - margin).alias("at"), F.lit(0).cast("long").alias("neg"), F.lit(0.0).alias("s"), "pos", F.lit(0).alias("kind"))
    u = scan(neg.unionByName(pos), (), [("at", True), ("kind", True)], ["neg", "s"])
    total = u.agg(F.sum(F.when(F.col("kind") == 0, F.col("pos") * (F.col("upto_s") - F.col("upto_neg") * F.col("at")))).alias("loss"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return total.select(F.coalesce(F.try_divide("loss", F.col("np").cast("double") * F.col("nn")), F.lit(0.0)).alias("margin_loss"))


def histogram(scores: DataFrame, bins: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """bin, n, density over [0, 1] (the last bin takes 1)."""
    b = F.least(F.floor(F.round(F.col("prob") * bins, 9)), F.lit(bins - 1)).cast("int")
    d = clean(scores).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    return d.withColumn("density", F.col("n") * bins / F.sum("n").over(Window.partitionBy(*by)))


def empirical_cdf(scores: DataFrame) -> DataFrame:
    """prob, cdf: share of scores up to each distinct one."""
    d = clean(scores).groupBy("prob").agg(F.count("*").alias("n"))
    return scan(d, (), [("prob", False)], ["n"]).select("prob", (F.col("upto_n") / F.col("all_n")).alias("cdf"))


def nearest_points(curve: DataFrame, wanted: list[float]) -> DataFrame:
    """at, threshold, fpr, tpr: for each wanted threshold the curve's point
    whose threshold is nearest, ties to the greater. One pass over the curve."""
    finite = curve.where("threshold < double('Infinity')")
    best = lambda t: F.min_by(F.struct("threshold", "fpr", "tpr"), F.struct(F.round(F.abs(F.col("threshold") - F.lit(t)), 9), -F.col("threshold")))
    points = finite.agg(F.array(*[F.struct(F.lit(t).alias("at"), best(t).alias("p")) for t in wanted]).alias("x"))
    return points.select(F.explode("x").alias("x")).where("x.p is not null").select("x.at", "x.p.*")


def least_gap(rows: DataFrame, col: str) -> DataFrame:
    """gap: the smallest distance of neighbouring distinct values, as for the
    width of bars. Ranges are sorted one by one; their ends meet afterwards."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.select(F.col(col).alias("x")).where("x is not null").distinct().repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id()))
    inside = dealt.withColumn("gap", F.lead("x").over(Window.partitionBy("part").orderBy("x")) - F.col("x")).select("gap")
    ends = dealt.groupBy("part").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    between = ends.select((F.lead("lo").over(Window.orderBy("lo")) - F.col("hi")).alias("gap"))  # a row for each range
    return inside.unionByName(between).agg(F.min("gap").alias("gap"))


def with_side(rows: DataFrame, side: DataFrame | None, on: list[str], cols: list[str]) -> DataFrame:
    """rows with the columns of an optional side table, null where it has no
    row or is missing."""
    if side is None:
        return rows.select("*", *[F.lit(None).cast("double").alias(c) for c in cols])
    return rows.join(side.select(*on, *cols), on, "left")
