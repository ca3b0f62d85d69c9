"""Adapters: logical tables from the star-schema tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom import schema
from chronoloom.functions.hashing import unit

CUSTOMER_BASE = 1_000_000
MODELS = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers and customers as companies with industries and embeddings."""
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    second = lambda prefix, n: F.concat(prefix, ((n + 7) % 25).cast("string"))
    s = table(spark, folder, "supplier")
    up = s.select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n_nationkey"), F.concat(F.lit("S_"), F.col("s_nationkey").cast("string")).alias("industry_1st"), F.when(F.col("s_suppkey") % 2 == 0, second(F.lit("S_"), F.col("s_nationkey"))).alias("industry_2nd"))
    c = table(spark, folder, "customer")
    prefix = F.concat("c_mktsegment", F.lit("_"))
    down = c.select((F.col("c_custkey") + CUSTOMER_BASE).alias("company_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"), F.concat(prefix, F.col("c_nationkey").cast("string")).alias("industry_1st"), F.when(F.col("c_custkey") % 3 == 0, second(prefix, F.col("c_nationkey"))).alias("industry_2nd"))
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = table(spark, folder, "embeddings").agg(F.count("*").alias("n_vec"))
    both = up.unionByName(down).join(nation, "n_nationkey", "left").join(F.broadcast(n), how="cross")  # one row
    both = both.withColumn("vec_id", F.when(F.col("company_id") % 17 != 0, F.col("company_id") % F.col("n_vec")))
    return both.join(vectors, "vec_id", "left").select(*schema.NODES.names)


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as yearly supplier -> customer edges of three sources."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("year"))
    flag = F.col("l_returnflag")
    source = F.when(flag == "A", schema.OBSERVED).when(flag == "R", schema.EXTERNAL).otherwise(schema.IMPUTED)
    rows = line.join(orders, "l_orderkey")
    p = ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 1000) / 1000.0
    return rows.select(F.col("l_suppkey").alias("src"), (F.col("o_custkey") + CUSTOMER_BASE).alias("tgt"), "year", source.alias("source"), F.when(source == schema.IMPUTED, p).alias("probability"), F.when(source == schema.IMPUTED, F.concat(F.lit("m"), (F.col("l_linenumber") % 2).cast("string"))).alias("model"))


def industry_network(spark: SparkSession, folder: str) -> DataFrame:
    """downstream, upstream: a customer industry buys from its nation's suppliers."""
    c = table(spark, folder, "customer").select("c_mktsegment", "c_nationkey").distinct()
    n = F.col("c_nationkey").cast("string")
    return c.select(F.concat("c_mktsegment", F.lit("_"), n).alias("downstream"), F.concat(F.lit("S_"), n).alias("upstream"))


def scores(spark: SparkSession, folder: str, models: int = MODELS) -> DataFrame:
    """sample_id, model_id, label, prob: a long prediction matrix with ties."""
    e = table(spark, folder, "events").select(F.col("event_id").alias("sample_id"), F.col("event_type").isin("purchase", "signup").cast("int").alias("label"))
    rows = e.withColumn("model_id", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    p = F.round(unit("p", F.col("model_id"), F.col("sample_id")) * 0.7 + F.col("label") * 0.3 * unit("q", F.col("sample_id")), 3)
    return rows.select("sample_id", "model_id", "label", p.alias("prob"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """sample_id with an edge's ends and year, for grouping scores."""
    e = table(spark, folder, "events").select(F.col("event_id").alias("sample_id"))
    counts = table(spark, folder, "supplier").agg(F.count("*").alias("ns")).join(table(spark, folder, "customer").agg(F.count("*").alias("nc")), how="cross")  # one row each
    return e.join(F.broadcast(counts), how="cross").select("sample_id", (F.col("sample_id") * 7 % F.col("ns")).alias("src"), (F.col("sample_id") * 13 % F.col("nc") + CUSTOMER_BASE).alias("tgt"), (F.col("sample_id") % 5 + 1996).cast("int").alias("year"))


def metric_log(spark: SparkSession, folder: str) -> DataFrame:
    """model, run_id, flag, epoch, tag, value, wall_time: a training log."""
    e = table(spark, folder, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0
    u = F.col("user_id")
    tag = F.when(F.col("event_id") % 5 == 0, "Test/Epoch_AUC").when(F.col("event_id") % 5 == 1, "Test/Epoch_F1").when(F.col("event_id") % 5 == 2, "Train/Epoch_Loss").when(F.col("event_id") % 5 == 3, "Train/Batch_Loss").otherwise("Monitor/Wasserstein_Diff")
    return e.select(F.col("event_type").alias("model"), (u % 7).alias("run_id"), F.when(u % 2 == 0, "fff").otherwise("tff").alias("flag"), (F.col("event_id") % 200).alias("epoch"), tag.alias("tag"), F.col("value").cast("double").alias("value"), seconds.alias("wall_time"))


def register(spark: SparkSession, folder: str) -> None:
    """The logical tables as temporary views, for spark.sql."""
    for make in (nodes, edges, industry_network, scores, samples, metric_log):
        make(spark, folder).createOrReplaceTempView(f"link_{make.__name__}")
