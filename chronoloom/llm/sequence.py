"""Number the rows of every group in order, without gathering a group.

Rows are range-partitioned by group and order, so a group of any size is cut
into runs that lie in several tasks; a row's number is its place in its run
plus the sizes of the group's earlier runs. Only the runs' sizes are summed in
a window: a group has at most one run for each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import written

#: Rows numbered within a task: monotonically_increasing_id() keeps 33 bits for them.
_IN_TASK = (1 << 33) - 1


def number_rows(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows and idx (long, from 0 in each group), size (long, the group's rows).

    group: columns without nulls; order: sorted ascending, nulls first, and
    rows that are equal in all of it in any order. Rows come from a written
    table, so they are stable however often they are read.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*group, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = dealt.drop("_tie").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK)))
    placed = written(placed, name)
    runs = placed.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.select(*group, "_part", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    placed = placed.join(written(runs, f"{name}-runs"), [*group, "_part"])
    return placed.withColumn("idx", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")
