"""Logical tables, the study window, and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First and last year of the study window (both inside).
WINDOW = (1996, 2000)
OBSERVED, EXTERNAL, IMPUTED = "observed", "external", "imputation"

_TEXT, _ID, _REAL = T.StringType(), T.LongType(), T.DoubleType()
NODES = T.StructType().add("company_id", _ID).add("name", _TEXT).add("country", _TEXT).add("industry_1st", _TEXT).add("industry_2nd", _TEXT).add("embedding", T.ArrayType(_REAL))
EDGES = T.StructType().add("src", _ID).add("tgt", _ID).add("year", T.IntegerType()).add("source", _TEXT).add("probability", _REAL).add("model", _TEXT)
TRIPLE = ["src", "tgt", "year"]


def in_window(col: str = "year", window: tuple[int, int] = WINDOW):
    return F.col(col).between(*window)


def year_violations(edges: DataFrame, window: tuple[int, int] = WINDOW) -> DataFrame:
    """Counts of edges outside the window (or without a year), by year."""
    return edges.where(F.col("year").isNull() | ~in_window("year", window)).groupBy("year").agg(F.count("*").alias("n_edges"))


def require_window(edges: DataFrame, window: tuple[int, int] = WINDOW) -> DataFrame:
    """The edges; reading one outside the window raises."""
    bad = F.col("year").isNull() | ~in_window("year", window)
    return edges.withColumn("year", F.when(bad, F.raise_error(F.concat(F.lit("year outside the study window: "), F.coalesce(F.col("year").cast("string"), F.lit("null")))).cast("int")).otherwise(F.col("year")))


def check_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns, cast; raises if one is missing."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])
