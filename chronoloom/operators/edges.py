"""Scans, filters, lookups and set operations over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.hashing import pick
from chronoloom.functions.lineage import cut
from chronoloom.functions.scalars import replace_zeros
from chronoloom.schema import EXTERNAL, OBSERVED, TRIPLE, WINDOW, in_window


def embedded(nodes: DataFrame) -> DataFrame:
    """Nodes that have an embedding."""
    return nodes.where(F.col("embedding").isNotNull())


def among(edges: DataFrame, ids: DataFrame, ends: tuple[str, ...] = ("src", "tgt"), id_col: str = "company_id") -> DataFrame:
    """Edges whose ends are all in ids. Both take few bytes in a shuffle and many
    in memory: ids have a number of partitions, which adaptive execution, which
    goes by bytes, does not lower. (The optimizer moves semi joins below a
    repartition of the edges.)"""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for end in ends:
        edges = edges.join(ids.select(F.col(id_col).alias(end)).repartition(parts, end), end, "left_semi")
    return edges


def scan_edges(nodes: DataFrame, edges: DataFrame, source: str | None = OBSERVED, window: tuple[int, int] = WINDOW, limit: int | None = None) -> DataFrame:
    """(src, tgt, year) in the window, both ends embedded, of one source or all."""
    rows = edges.where(in_window("year", window))
    rows = rows if source is None else rows.where(F.col("source") == source)
    rows = among(rows.select(*TRIPLE), embedded(nodes))
    return rows if limit is None else rows.limit(limit)


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: ends counted over the multiset, both directions."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def min_degree(edges: DataFrame, least: int) -> DataFrame:
    """Edges whose ends both have at least that degree; one pass, no core."""
    if least <= 1:
        return edges
    return among(edges, degrees(edges).where(F.col("degree") >= least), id_col="node")


def available_years(edges: DataFrame, window: tuple[int, int] = WINDOW) -> DataFrame:
    return edges.where(in_window("year", window)).select("year").distinct()


def external_only(nodes: DataFrame, edges: DataFrame, least_degree: int = 0) -> DataFrame:
    """External edges that are not observed, whose ends are observed nodes and
    whose year is an observed year."""
    seen = min_degree(scan_edges(nodes, edges, OBSERVED), least_degree)
    ends = seen.select(F.explode(F.array("src", "tgt")).alias("company_id")).distinct()
    rows = scan_edges(nodes, edges, EXTERNAL).distinct().join(seen.distinct(), TRIPLE, "left_anti")
    return among(rows, ends).join(seen.select("year").distinct(), "year", "left_semi").select(*TRIPLE)


def industry_members(nodes: DataFrame) -> DataFrame:
    """industry, company_id of embedded nodes, by either industry."""
    both = F.array_distinct(F.array_compact(F.array("industry_1st", "industry_2nd")))
    return embedded(nodes).select(F.explode(both).alias("industry"), "company_id").where("industry != ''")


def industry_sets(nodes: DataFrame) -> DataFrame:
    """company_id, industries: the sorted industries of each company that has any."""
    return industry_members(nodes).groupBy("company_id").agg(F.array_sort(F.collect_set("industry")).alias("industries"))


def network_matches(edges: DataFrame, nodes: DataFrame, network: DataFrame) -> DataFrame:
    """Edges for which some industry of src may supply some industry of tgt."""
    of = nodes.select("company_id", F.explode(F.array_distinct(F.array_compact(F.array("industry_1st", "industry_2nd")))).alias("industry")).where("industry != ''")
    pairs = edges.select("src", "tgt").distinct()
    pairs = pairs.join(of.select(F.col("company_id").alias("src"), F.col("industry").alias("upstream")), "src")
    pairs = pairs.join(of.select(F.col("company_id").alias("tgt"), F.col("industry").alias("downstream")), "tgt")
    allowed = pairs.join(network, ["upstream", "downstream"], "left_semi").select("src", "tgt").distinct()
    return edges.join(allowed, ["src", "tgt"], "left_semi")


def filled_features(nodes: DataFrame, fill: float) -> DataFrame:
    """Embedded nodes with the zeros of their vectors replaced."""
    return embedded(nodes).withColumn("embedding", replace_zeros(F.col("embedding"), fill))


def dual_source(edges: DataFrame, first: str = EXTERNAL, second: str = OBSERVED) -> DataFrame:
    """Nodes with edges of both sources, either direction, any year."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("company_id"), "source")
    seen = ends.groupBy("company_id").agg(F.max((F.col("source") == first).cast("int")).alias("a"), F.max((F.col("source") == second).cast("int")).alias("b"))
    return seen.where("a = 1 and b = 1").select("company_id")


def store_flags(table, edges: DataFrame) -> DataFrame:
    """The companies of dual_source written as the next version of a stored
    table and read back from it; table: a sources.stores.VersionedTable. Flags
    are always made anew from the edges, so a stale one cannot be trusted."""
    table.swap(dual_source(edges).withColumn("merged", F.lit(True)))
    return table.read()


def dense_index(rows: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """rows with their position from 0 in the order of col (nulls first).

    Ranges are sorted in parallel; only their sizes meet in one task.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # read once: a second evaluation could draw other range bounds
    dealt = cut(rows.repartitionByRange(parts, col).withColumn("_part", F.spark_partition_id()))
    local = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(col)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return local.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_at") - 1).drop("_part", "_at", "_before")  # a row for each partition


def node_index(nodes: DataFrame) -> DataFrame:
    """company_id, idx: dense positions of embedded nodes in id order."""
    return dense_index(embedded(nodes).select("company_id"), "company_id")


def static_graph(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """src_idx, tgt_idx, year: edges on the dense index."""
    index = node_index(nodes)
    rows = triples.join(index.select(F.col("company_id").alias("src"), F.col("idx").alias("src_idx")), "src")
    return rows.join(index.select(F.col("company_id").alias("tgt"), F.col("idx").alias("tgt_idx")), "tgt").select("src_idx", "tgt_idx", "year")


def known_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Predefined negatives whose two companies are known: the first two
    columns and the last one as a triple."""
    cols = rows.columns
    named = rows.select(F.col(cols[0]).cast("long").alias("src"), F.col(cols[1]).cast("long").alias("tgt"), F.col(cols[-1]).cast("int").alias("year"))
    return among(named.where("src is not null and tgt is not null"), nodes)


def nearest_year(wanted: DataFrame, years: DataFrame) -> DataFrame:
    """year, nearest, position: the closest available year, ties to the earlier.

    Years are few; they travel as one array, not as a join of all pairs.
    """
    all_years = years.agg(F.array_sort(F.collect_set("year")).alias("ys"))
    rows = wanted.join(F.broadcast(all_years), how="cross")  # one row
    ranked = F.array_sort(F.transform("ys", lambda y, i: F.struct(F.abs(y - F.col("year")).alias("d"), i.alias("i"), y.alias("y"))))
    return rows.withColumn("best", F.get(ranked, F.lit(0))).select("year", F.col("best.y").alias("nearest"), F.col("best.i").alias("position"))


def clamped(year: Column, years: list[int], seed: int, *parts: Column) -> Column:
    """The year, or one of the allowed years drawn by hash where it is none."""
    return F.when(year.isin(years), year).otherwise(F.get(F.array(*[F.lit(y) for y in years]), F.least(pick(len(years), seed, *parts), F.lit(len(years) - 1)).cast("int")))
