"""Training logs: runs, epochs, durations, histograms of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN_NAME = r"(\d{4}-\d{4})-(f\w{2}|t\w{2})$"


def parse_names(names: DataFrame, col: str = "name") -> DataFrame:
    """name, stamp, flag of run folders that follow the naming rule."""
    rows = names.where(F.col(col).rlike(RUN_NAME))
    return rows.select(col, F.regexp_extract(col, RUN_NAME, 1).alias("stamp"), F.regexp_extract(col, RUN_NAME, 2).alias("flag"))


def epoch_level(log: DataFrame) -> DataFrame:
    return log.where(~F.col("tag").contains("/Batch_"))


def drop_fine_steps(log: DataFrame, model: str, prefix: str = "Monitor/Wasserstein_", limit: int = 100) -> DataFrame:
    """Of one model's tags with the prefix, where a run has steps below and from
    the limit on, only the latter stay."""
    w = Window.partitionBy("model", "run_id", "flag", "tag")
    low, high = F.col("epoch") < limit, F.col("epoch") >= limit
    mixed = F.max(low.cast("int")).over(w) + F.max(high.cast("int")).over(w) == 2
    return log.withColumn("_mixed", (F.col("model") == model) & F.col("tag").startswith(prefix) & mixed).where(~F.col("_mixed") | high).drop("_mixed")


def longest_runs(log: DataFrame) -> DataFrame:
    """model, flag, run_id, n_epochs of the run with most epochs (ties: least id)."""
    n = log.groupBy("model", "flag", "run_id").agg(F.count_distinct("epoch").alias("n_epochs"))
    w = Window.partitionBy("model", "flag").orderBy(F.col("n_epochs").desc(), "run_id")
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def only_longest(log: DataFrame) -> DataFrame:
    return log.join(longest_runs(log).select("model", "flag", "run_id"), ["model", "flag", "run_id"], "left_semi")


def best_epochs(log: DataFrame, criteria: list[str]) -> DataFrame:
    """model, flag, epoch, value, criterion: the best epoch by the first
    criterion tag that the group has (ties: the earlier epoch)."""
    order = F.array_position(F.array(*[F.lit(c) for c in criteria]), F.col("tag"))
    rows = log.where(order > 0).withColumn("level", order)
    w = Window.partitionBy("model", "flag").orderBy("level", F.col("value").desc(), "epoch")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("model", "flag", "epoch", "value", F.col("tag").alias("criterion"))


def at_best_epoch(log: DataFrame, criteria: list[str]) -> DataFrame:
    """All tags of each group at its best epoch (mean over repeats)."""
    best = best_epochs(log, criteria).select("model", "flag", "epoch")
    return log.join(best, ["model", "flag", "epoch"]).groupBy("model", "flag", "epoch", "tag").agg(F.avg("value").alias("value"))


def epoch_stats(log: DataFrame) -> DataFrame:
    """model, flag, tag, epoch: mean, sample std and number of values."""
    return log.groupBy("model", "flag", "tag", "epoch").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))


def epoch_durations(log: DataFrame, longest: float = 86400.0) -> DataFrame:
    """model, flag, mean seconds between a run's consecutive records of a tag;
    gaps of 0 or of a day and more are left out."""
    w = Window.partitionBy("model", "flag", "run_id", "tag").orderBy("wall_time", "epoch")
    d = log.withColumn("gap", F.col("wall_time") - F.lag("wall_time").over(w)).where((F.col("gap") > 0) & (F.col("gap") < longest))
    return d.groupBy("model", "flag").agg(F.avg("gap").alias("mean_seconds"), F.count("*").alias("n_gaps"))


def summary_table(log: DataFrame, tags: list[str]) -> DataFrame:
    """model, flag with the mean of each tag as a column."""
    p = log.groupBy("model", "flag").pivot("tag", tags).agg(F.avg("value"))
    return p.select("model", "flag", *[F.col(f"`{t}`").alias(t.replace("/", "_")) for t in tags])


def min_max(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant one becomes 0.5."""
    ends = rows.agg(*[F.min(c).alias(f"{c}_lo") for c in cols], *[F.max(c).alias(f"{c}_hi") for c in cols])
    d = rows.join(F.broadcast(ends), how="cross")  # one row
    scaled = lambda c: F.when(F.col(f"{c}_hi") == F.col(f"{c}_lo"), F.lit(0.5)).otherwise((F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo")))
    return d.select(*[scaled(c).alias(c) if c in cols else F.col(c) for c in rows.columns])


def trailing(log: DataFrame, size: int = 10, every: int = 10) -> DataFrame:
    """Mean of the last size values of each run and tag, every so many rows."""
    w = Window.partitionBy("model", "flag", "run_id", "tag").orderBy("epoch", "wall_time", "value")
    d = log.withColumn("batch", F.row_number().over(w)).withColumn("mean", F.avg("value").over(w.rowsBetween(1 - size, 0)))
    return d.where(F.col("batch") % every == 0).select("model", "flag", "run_id", "tag", "batch", "mean")


def buffered(log: DataFrame, size: int = 50, every: int = 10) -> DataFrame:
    """Training metrics every so many batches of a run: mean of the last size
    values, and the mean of all so far, as a loss is reported."""
    w = Window.partitionBy("model", "flag", "run_id", "tag").orderBy("epoch", "wall_time", "value")
    d = log.withColumn("batch", F.row_number().over(w)).withColumn("recent", F.avg("value").over(w.rowsBetween(1 - size, 0)))
    d = d.withColumn("so_far", F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where(F.col("batch") % every == 0).select("model", "flag", "run_id", "tag", "batch", "recent", "so_far")


def early_stop(log: DataFrame, patience: int) -> DataFrame:
    """epoch, value, best so far, waited (epochs without gain), stopped."""
    w = Window.partitionBy("model", "flag").orderBy("epoch")
    before = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = log.withColumn("gain", F.coalesce(F.col("value") > before, F.lit(True)).cast("int"))
    d = d.withColumn("island", F.sum("gain").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("best", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy("model", "flag", "island").orderBy("epoch")
    d = d.withColumn("waited", F.row_number().over(v) - 1)
    return d.select("model", "flag", "epoch", "value", "best", "waited", (F.col("waited") >= patience).alias("stopped"))


def composite(rows: DataFrame, quantile: str, auc: str, fallback: str) -> DataFrame:
    """score: half quantile, half AUC; the fallback where either is missing."""
    return rows.withColumn("score", F.coalesce(F.col(quantile) * 0.5 + F.col(auc) * 0.5, F.col(fallback)))


def rebin(hists: DataFrame, by: tuple[str, ...], bins: int = 50, total: float = 5000.0) -> DataFrame:
    """Histograms with any right limits, spread evenly over bins of [0, 1] by
    linear interpolation of their cumulative counts; each sums to total.

    hists: by, limits (array, ascending), counts (array)."""
    upto = F.transform(F.sequence(F.lit(0), F.size("counts")), lambda k: F.aggregate(F.slice("counts", F.lit(1), k), F.lit(0.0), lambda s, x: s + x))
    left = F.concat(F.array(F.lit(0.0)), F.transform("limits", lambda x: x.cast("double")))
    d = hists.withColumn("xs", left).withColumn("cs", upto).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins))))
    x = F.col("bin") / F.lit(float(bins))
    k = F.aggregate("xs", F.lit(0), lambda s, v: s + F.when(v <= x, 1).otherwise(0))
    d = d.withColumn("k", k)
    a, b = F.get("xs", F.col("k") - 1), F.get("xs", F.col("k"))
    ca, cb = F.get("cs", F.col("k") - 1), F.get("cs", F.col("k"))
    cum = F.when(F.col("k") == 0, F.lit(0.0)).when(F.col("k") >= F.size("xs"), F.element_at("cs", -1)).otherwise(ca + (cb - ca) * F.coalesce(F.try_divide(x - a, b - a), F.lit(0.0)))
    w = Window.partitionBy(*by).orderBy("bin")
    d = d.withColumn("cum", cum).withColumn("n", F.greatest(F.col("cum") - F.lag("cum").over(w), F.lit(0.0))).where("bin > 0")
    whole = F.sum("n").over(Window.partitionBy(*by))
    return d.select(*by, (F.col("bin") - 1).alias("bin"), F.coalesce(F.try_divide(F.col("n") * total, whole), F.lit(0.0)).alias("n"))


def histogram_distance(a: DataFrame, b: DataFrame, by: tuple[str, ...] = (), width: float = 0.02) -> DataFrame:
    """First Wasserstein distance of two binned distributions (bin, n)."""
    d = a.select(*by, "bin", F.col("n").alias("x")).join(b.select(*by, "bin", F.col("n").alias("y")), [*by, "bin"], "full").fillna(0.0, ["x", "y"])
    every, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cdf = lambda c: F.coalesce(F.try_divide(F.sum(c).over(upto), F.sum(c).over(every)), F.lit(0.0))
    return d.withColumn("gap", F.abs(cdf("x") - cdf("y"))).groupBy(*by).agg((F.sum("gap") * width).alias("distance"))


def last_events(hists: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The event with the largest step of each group."""
    return hists.groupBy(*by).agg(F.max_by(F.struct("limits", "counts"), "step").alias("h")).select(*by, "h.limits", "h.counts")


def distance_table(hists: DataFrame, external: str, positive: str, negative: str, by: tuple[str, ...] = ("model", "flag")) -> DataFrame:
    """by, w_fp, w_fn, w_pn, delta: distances between the last histograms of
    external, positive and negative scores, and by how much external scores are
    nearer to the positive ones. Groups that lack one, or whose counts are all
    0, are left out. hists: by, tag, step, limits, counts."""
    tags = [external, positive, negative]
    last = last_events(hists.where(F.col("tag").isin(tags)), (*by, "tag"))
    last = last.where(F.aggregate("counts", F.lit(0.0), lambda s, x: s + x) > 0)
    whole = last.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") == 3).drop("n")
    lines = rebin(last.join(whole, list(by)), (*by, "tag"))
    of = lambda t: lines.where(F.col("tag") == t)
    one = lambda a, b, name: histogram_distance(of(a), of(b), by).withColumnRenamed("distance", name)
    d = one(external, positive, "w_fp").join(one(external, negative, "w_fn"), list(by)).join(one(positive, negative, "w_pn"), list(by))
    return d.withColumn("delta", F.col("w_fn") - F.col("w_fp"))


def without_runs(log: DataFrame, *excluded: dict[str, object]) -> DataFrame:
    """The log without single runs, each named by its columns' values."""
    for one in excluded:
        same = None
        for col, value in one.items():
            same = (F.col(col).eqNullSafe(F.lit(value))) if same is None else same & F.col(col).eqNullSafe(F.lit(value))
        log = log.where(~same) if same is not None else log
    return log


def rescaled_durations(durations: DataFrame, log: DataFrame, model: str) -> DataFrame:
    """durations with the mean of one model, whose steps are no epochs, rescaled:
    mean * (largest step / 2) / (mean gap of its steps)."""
    w = Window.partitionBy("model", "flag", "run_id", "tag").orderBy("wall_time", "epoch")
    gaps = log.where(F.col("model") == model).withColumn("step_gap", F.abs(F.col("epoch") - F.lag("epoch").over(w)))
    of = gaps.groupBy("model", "flag").agg(F.max("epoch").alias("top"), F.avg("step_gap").alias("step_gap"))
    rows = durations.join(of, ["model", "flag"], "left")
    scaled = F.col("mean_seconds") * (F.col("top") / 2) / F.nullif(F.col("step_gap"), F.lit(0.0))
    return rows.withColumn("mean_seconds", F.coalesce(scaled, F.col("mean_seconds"))).drop("top", "step_gap")
