"""Micro-batch scoring: links that arrive are scored and merged into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoloom.operators.imputation import score_pairs
from chronoloom.schema import TRIPLE


def scored_batches(links: DataFrame, nodes: DataFrame, path: str, checkpoint: str, threshold: float, available_now: bool = True) -> StreamingQuery:
    """Score each batch of a stream of (src, tgt, year) against the static nodes
    and append those above the threshold, a folder for each batch, which a
    repeated batch overwrites."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = score_pairs(batch.select(*TRIPLE).distinct(), nodes).where(F.col("prob") > threshold)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = links.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and mean value by window and type, with a watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
