"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's docs. All but the last return the
columns of documents. A column that a stage adds for itself is called
``_found`` or ``_language``; documents has none of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from chronoloom.llm.common import crc_mod, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go, so those with a null text or
    without a letter do. An empty table stays empty."""
    model = language_id.fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
    return language_id.identify(docs, model, out="_language").where("not _language.rejected").drop("_language")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; so do documents left with none.
    Null texts and texts without a word are left alone; rows without an id come
    last, so that their repeats go first."""
    rows = line_dedup.dedup_lines(docs, out="_found")
    left = (F.col("_found.removed") == 0) | (line_dedup.normalised(F.col("text")) != "")
    return rows.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest
    id, once if rows share it. Rows without an id are no near copies of anything."""
    groups = ngram_join.join(docs).where("id is not null").select("id", "component_id").distinct()
    keep = groups.where("id = component_id").select(F.col("id").alias("doc_id"))
    named = docs.where("doc_id is not null")
    again = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = written(again, "shared-ids")
    kept = named.join(keep, "doc_id", "left_semi")
    if not again.isEmpty():  # of rows that share an id the one with the least text stays
        some = kept.join(again, "doc_id", "left_semi")
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        one = some.groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("_found")).select("doc_id", "_found.*")
        kept = kept.join(again, "doc_id", "left_anti").unionByName(one)
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages in a twentieth of their words or
    more go. Null texts have no words and stay."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="_found")
    hit = F.aggregate("_found.spans", F.lit(0), lambda acc, x: acc + x["b"] - x["a"])
    bad = (hit > 0) & (hit * 20 >= F.col("_found.n_words"))
    return found.where(~bad).drop("_found")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("mixing sources", mix_sources),
]

#: Nearest centroids and edit distances of near lines cannot be stated in SQL;
#: tests/llm/test_pipeline.py holds each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "stage")
    return docs
