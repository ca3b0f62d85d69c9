"""Readers and writers of the file formats around the engine.

All of them go through Spark's sources, so a path may lie in any store.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.schema import TRIPLE


def industry_network(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """downstream, upstream from a JSON map of names to (nested) lists of names;
    only: keep one key. The map is a small document, parsed on the driver."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    net = json.loads(text)
    if only is not None and only not in net:
        raise ValueError(f"no industry {only!r}; the first are {', '.join(list(net)[:10])}")

    def flat(x):
        return [y for v in x for y in flat(v)] if isinstance(x, list) else [x]

    rows = sorted({(d, u) for d, ups in net.items() if only in (None, d) for u in flat(ups) if u})
    return spark.createDataFrame(rows, "downstream string, upstream string")


def split_file(spark: SparkSession, path: str) -> DataFrame:
    """(src, tgt, year) from CSV columns source, target, year."""
    rows = spark.read.csv(path, header=True, schema="source long, target long, year int")
    return rows.select(F.col("source").alias("src"), F.col("target").alias("tgt"), "year")


def negatives_file(spark: SparkSession, path: str) -> DataFrame:
    """Predefined negatives as text columns; see operators.edges.known_pairs."""
    return spark.read.csv(path, header=True)


def matrix_file(spark: SparkSession, path: str) -> DataFrame:
    """A wide prediction matrix from CSV, probabilities as doubles."""
    rows = spark.read.csv(path, header=True)
    return rows.select(*[F.col(c).cast("int" if c in ("label", "year") else "long" if c.endswith("idx") or c == "sample_id" else "double").alias(c) for c in rows.columns])


def baseline_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="window int, threshold int, precision double, recall double, fpr double, tpr double, auc double, ap double, acc double, best_threshold double")


def score_lists(rows: DataFrame) -> DataFrame:
    """label, prob from rows with lists of positive and negative scores."""
    pos = rows.select(F.lit(1).alias("label"), F.explode("test_predictions").alias("prob"))
    return pos.unionByName(rows.select(F.lit(0).alias("label"), F.explode("neg_predictions").alias("prob")))


def write_split(triples: DataFrame, path: str) -> None:
    triples.select(F.col("src").alias("source"), F.col("tgt").alias("target"), "year").write.mode("overwrite").option("header", True).csv(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """The edge table, a folder for each year."""
    edges.repartition("year").write.mode("overwrite").partitionBy("year").parquet(path)


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """parquet, csv (with a header) or json."""
    w = rows.write.mode("overwrite")
    {"parquet": w.parquet, "csv": w.option("header", True).csv, "json": w.json}[kind](path)


def write_weights(rows: DataFrame, path: str, prefix: str = "") -> None:
    """Weight rows (name, shape, data), all or those with a name's prefix."""
    rows.where(F.col("name").startswith(prefix)).write.mode("overwrite").parquet(path)


def read_edges(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """Edges of some years: other years' folders are not read."""
    rows = spark.read.parquet(path)
    return rows if years is None else rows.where(F.col("year").isin(years))


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates([*TRIPLE, "source", "model", "probability"])


def checkpoints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, number (the last digits of the file's name), modified of the files
    below a folder; contents are not read. Order by number, or take the newest
    by modified."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    number = F.try_to_number(F.nullif(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d+)\D*$", 1), F.lit("")), F.lit("9999999999999")).cast("long")
    return found.select("path", number.alias("number"), F.col("modificationTime").alias("modified"))


def newest(files: DataFrame) -> DataFrame:
    """The file with the latest time, ties to the greater path; one row."""
    return files.agg(F.max(F.struct("modified", "path")).alias("x")).where("x is not null").select("x.path", "x.modified")


def json_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of result files that are one JSON document each (thresholds, overlaps)."""
    return spark.read.json(path, multiLine=True)


def write_summary(rows: DataFrame, path: str, **meta: object) -> None:
    """Rows of a summary as JSON lines, each with a ``_meta`` of run settings."""
    rows.withColumn("_meta", F.lit(json.dumps(meta, sort_keys=True, default=str))).coalesce(1).write.mode("overwrite").json(path)


def append_metrics(log: DataFrame, path: str) -> None:
    """Metric records (model, run, tag, epoch, value) at the end of a log table."""
    log.write.mode("append").partitionBy("model").parquet(path)
