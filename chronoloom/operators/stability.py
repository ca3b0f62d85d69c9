"""Stability of several models' scores, and where the variance is high."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.scalars import bin_index
from chronoloom.operators.edges import degrees
from chronoloom.operators.metrics import clean, confusion, roc_auc

DEGREE_EDGES = [0, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000]
DEGREE_LABELS = ["1", "2", "3-5", "6-10", "11-20", "21-50", "51-100", "101-200", "201-500", "501-1000", "1001-2000", "2000+"]


def five_numbers(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return rows.groupBy(*by).agg(q.alias("q")).select(*by, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(["min", "q1", "median", "q3", "max"])])


def summary(rows: DataFrame, value: str, by: tuple[str, ...] = (), sample_std: bool = True) -> DataFrame:
    """mean, std, median, min, max, range, n of a value."""
    std = F.stddev_samp(value) if sample_std else F.stddev_pop(value)
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), std.alias("std"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"), F.count(value).alias("n"))


def macro(scores: DataFrame) -> DataFrame:
    """metric (auc, f1), mean, std (population), min, max, range over models."""
    auc = roc_auc(scores, ("model_id",)).select("model_id", F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    f1 = confusion(scores, 0.5, True, ("model_id",)).select("model_id", F.lit("f1").alias("metric"), F.col("f1").alias("value"))
    return summary(auc.unionByName(f1), "value", ("metric",), sample_std=False).drop("median", "n")


def matrix(scores: DataFrame) -> DataFrame:
    """One row for each sample: mean, population std, 95 % interval, width."""
    q = F.percentile("prob", F.array(F.lit(0.025), F.lit(0.975)))
    d = clean(scores).groupBy("sample_id").agg(F.max("label").alias("label"), F.avg("prob").alias("mean_prob"), F.stddev_pop("prob").alias("std_prob"), q.alias("q"))
    return d.select("sample_id", "label", "mean_prob", "std_prob", F.get("q", F.lit(0)).alias("pi_low"), F.get("q", F.lit(1)).alias("pi_high"), (F.get("q", F.lit(1)) - F.get("q", F.lit(0))).alias("pi_width"))


def wide(scores: DataFrame, models: int) -> DataFrame:
    """The prediction matrix with one column for each model."""
    p = scores.groupBy("sample_id").pivot("model_id", list(range(models))).agg(F.first("prob"))
    return p.select("sample_id", *[F.col(str(i)).alias(f"model_{i}_prob") for i in range(models)])


def long(rows: DataFrame, models: int) -> DataFrame:
    """The reverse of wide."""
    cols = [f"model_{i}_prob" for i in range(models)]
    return rows.unpivot([c for c in rows.columns if c not in cols], cols, "model", "prob").withColumn("model_id", F.regexp_extract("model", r"(\d+)", 1).cast("int")).drop("model")


def micro(rows: DataFrame) -> DataFrame:
    """Of matrix(): median, p90, p95, mean of std; shares below .05, above .1."""
    q = F.percentile("std_prob", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    d = rows.agg(q.alias("q"), F.avg("std_prob").alias("mean_std"), F.avg((F.col("std_prob") < 0.05).cast("double")).alias("stable_share"), F.avg((F.col("std_prob") > 0.1).cast("double")).alias("unstable_share"))
    return d.select(*[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(["median_std", "p90_std", "p95_std"])], "mean_std", "stable_share", "unstable_share")


def intervals(rows: DataFrame) -> DataFrame:
    q = F.percentile("pi_width", F.array(F.lit(0.5), F.lit(0.9)))
    return rows.agg(F.avg("pi_width").alias("mean_width"), q.alias("q")).select("mean_width", F.get("q", F.lit(0)).alias("median_width"), F.get("q", F.lit(1)).alias("p90_width"))


def flagged(rows: DataFrame, high: float = 0.1, low_p: float = 0.3, high_p: float = 0.7) -> DataFrame:
    return rows.withColumn("high_var", F.col("std_prob") > high).withColumn("boundary", F.col("mean_prob").between(low_p, high_p))


def with_degrees(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """src_deg, tgt_deg (0 if unknown), min_deg, max_deg, sum_deg."""
    d = degrees(edges)
    for end in ("src", "tgt"):
        rows = rows.join(d.select(F.col("node").alias(end), F.col("degree").alias(f"{end}_deg")), end, "left").withColumn(f"{end}_deg", F.coalesce(f"{end}_deg", F.lit(0).cast("long")))
    return rows.withColumn("min_deg", F.least("src_deg", "tgt_deg")).withColumn("max_deg", F.greatest("src_deg", "tgt_deg")).withColumn("sum_deg", F.col("src_deg") + F.col("tgt_deg"))


def variance_by(rows: DataFrame, *by: str) -> DataFrame:
    """n, n_high, mean_std, median_std, high_share, n_high_positive by columns."""
    h = F.col("high_var").cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(h).alias("n_high"), F.avg("std_prob").alias("mean_std"), F.percentile("std_prob", F.lit(0.5)).alias("median_std"), F.avg(h.cast("double")).alias("high_share"), F.sum(F.when(F.col("high_var") & (F.col("label") == 1), 1).otherwise(0).cast("long")).alias("n_high_positive"))


def by_degree(rows: DataFrame, col: str) -> DataFrame:
    """Counts and shares by degree bucket; empty buckets stay, beyond the last
    edge a row has none."""
    spark = rows.sparkSession
    bins = spark.createDataFrame(list(enumerate(DEGREE_LABELS)), "bin int, bucket string")
    d = rows.withColumn("bin", bin_index(F.col(col), DEGREE_EDGES, include_lowest=True)).where("bin is not null")
    return F.broadcast(bins).join(variance_by(d, "bin"), "bin", "left").select("bin", "bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("n_high", F.lit(0).cast("long")).alias("n_high"), "mean_std", "high_share")


def by_probability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """By right-closed tenths of mean_prob; exactly 0 falls out, empty ones stay."""
    spark = rows.sparkSession
    edges = [i / bins for i in range(bins + 1)]
    d = rows.withColumn("bin", bin_index(F.col("mean_prob"), edges)).where("bin is not null")
    d = d.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.col("high_var").cast("long")).alias("n_high"), F.avg("std_prob").alias("mean_std"), F.avg(F.col("label").cast("double")).alias("positive_share"))
    ids = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return ids.join(d, "bin", "left").select("bin", ((F.col("bin") + 0.5) / bins).alias("mid"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("n_high", F.lit(0).cast("long")).alias("n_high"), "mean_std", "positive_share")


def boundary_effect(rows: DataFrame) -> DataFrame:
    return rows.groupBy("boundary").agg(F.count("*").alias("n"), F.avg(F.col("high_var").cast("double")).alias("high_share"))


HEAT_EDGES = [0, 1, 2, 5, 10, 20, 50, 100, 500, 5000]


def degree_heatmap(rows: DataFrame) -> DataFrame:
    """src_bin by tgt_bin: share of high variance; bins open on the left."""
    d = rows.withColumn("src_bin", bin_index(F.col("src_deg"), HEAT_EDGES)).withColumn("tgt_bin", bin_index(F.col("tgt_deg"), HEAT_EDGES)).where("src_bin is not null and tgt_bin is not null")
    k = len(HEAT_EDGES) - 1
    p = d.groupBy("src_bin").pivot("tgt_bin", list(range(k))).agg(F.avg(F.col("high_var").cast("double")))
    return p.select("src_bin", *[F.col(str(i)).alias(f"tgt_{i}") for i in range(k)])


def thirds(rows: DataFrame) -> DataFrame:
    """early, late: unweighted means of yearly shares in the first and last
    third of the years."""
    yearly = variance_by(rows, "year").select("year", "high_share")
    ends = yearly.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    d = yearly.join(F.broadcast(ends), how="cross").withColumn("cut", F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / 3)))  # one row
    return d.agg(F.avg(F.when(F.col("year") <= F.col("lo") + F.col("cut"), F.col("high_share"))).alias("early"), F.avg(F.when(F.col("year") >= F.col("hi") - F.col("cut"), F.col("high_share"))).alias("late"))
