"""Queries over nodes and edges."""

import uuid

from pyspark.sql import functions as F

from chronoloom import schema
from chronoloom.catalog import query
from chronoloom.functions.lineage import shared_dir
from chronoloom.operators import edges as E
from chronoloom.oracle import sql
from chronoloom.sources import tables as T
from chronoloom.sources.stores import VersionedTable

LEAST_DEGREE = 8

FILTERED = """filtered AS (
  SELECT pos.* FROM pos
  JOIN deg a ON a.node = src JOIN deg b ON b.node = tgt WHERE a.degree >= 8 AND b.degree >= 8
)"""
DEG = "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM pos UNION ALL SELECT tgt FROM pos) GROUP BY node"


@query(sql("SELECT company_id, industry_1st, industry_2nd, CAST(len(embedding) AS INTEGER) AS dims FROM nodes WHERE embedding IS NOT NULL", "nodes"))
def nodes_with_embedding(spark, d):
    return E.embedded(T.nodes(spark, d)).select("company_id", "industry_1st", "industry_2nd", F.size("embedding").alias("dims"))


@query(sql("SELECT src, tgt, year FROM pos", "pos"))
def positive_edges(spark, d):
    return E.scan_edges(T.nodes(spark, d), T.edges(spark, d))


@query(sql("SELECT pos.src, pos.tgt, pos.year FROM pos JOIN deg a ON a.node = src JOIN deg b ON b.node = tgt WHERE a.degree >= 8 AND b.degree >= 8", "pos", deg=DEG))
def min_degree_edges(spark, d):
    return E.min_degree(E.scan_edges(T.nodes(spark, d), T.edges(spark, d)), LEAST_DEGREE)


@query(sql("SELECT DISTINCT year FROM edges WHERE year BETWEEN 1996 AND 2000", "edges"))
def available_years(spark, d):
    return E.available_years(T.edges(spark, d))


@query(sql("""SELECT DISTINCT src, tgt, year FROM ext
  WHERE src IN (SELECT src FROM f UNION SELECT tgt FROM f) AND tgt IN (SELECT src FROM f UNION SELECT tgt FROM f)
    AND year IN (SELECT year FROM f) AND (src, tgt, year) NOT IN (SELECT src, tgt, year FROM f)""", "pos", "ext", deg=DEG, f="SELECT pos.* FROM pos JOIN deg a ON a.node = src JOIN deg b ON b.node = tgt WHERE a.degree >= 8 AND b.degree >= 8"))  # fmt: skip
def external_only_edges(spark, d):
    return E.external_only(T.nodes(spark, d), T.edges(spark, d), LEAST_DEGREE)


@query(sql("SELECT industry, company_id FROM members", "members"))
def industry_members(spark, d):
    return E.industry_members(T.nodes(spark, d))


@query(sql("""SELECT src, tgt, year FROM edges WHERE source = 'observed' AND EXISTS (
    SELECT 1 FROM nodes u, nodes v, network n WHERE u.company_id = src AND v.company_id = tgt
      AND n.upstream IN (u.industry_1st, u.industry_2nd) AND n.downstream IN (v.industry_1st, v.industry_2nd))""", "nodes", "edges", "network"))  # fmt: skip
def network_match_edges(spark, d):
    rows = T.edges(spark, d).where(F.col("source") == schema.OBSERVED).select(*schema.TRIPLE)
    return E.network_matches(rows, T.nodes(spark, d), T.industry_network(spark, d))


@query(sql("SELECT company_id, CAST(len(list_filter(embedding, lambda x: x = 0)) AS BIGINT) AS n_zero, round(list_sum(list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0.5 ELSE CAST(x AS DOUBLE) END)), 6) AS total FROM nodes WHERE embedding IS NOT NULL", "nodes"))
def zero_filled_features(spark, d):
    n = E.embedded(T.nodes(spark, d))
    zeros = n.select("company_id", F.size(F.filter("embedding", lambda x: x == 0)).cast("long").alias("n_zero"))
    filled = E.filled_features(n, 0.5).select("company_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
    return zeros.join(filled, "company_id")


@query(sql("SELECT node AS company_id FROM (SELECT src AS node, source FROM edges UNION ALL SELECT tgt, source FROM edges) GROUP BY node HAVING bool_or(source = 'external') AND bool_or(source = 'observed')", "edges"))
def dual_source_nodes(spark, d):
    return E.dual_source(T.edges(spark, d))


@query(sql("SELECT node AS company_id, true AS merged FROM (SELECT src AS node, source FROM edges UNION ALL SELECT tgt, source FROM edges) GROUP BY node HAVING bool_or(source = 'external') AND bool_or(source = 'observed')", "edges"))
def stored_flags(spark, d):
    """Flags written twice, the second version in the first one's place."""
    table = VersionedTable(spark, f"{shared_dir(spark)}/flags-{uuid.uuid4().hex}")
    edges = T.edges(spark, d)
    E.store_flags(table, edges.where("source = 'external'"))
    return E.store_flags(table, edges)


@query(sql("SELECT year, count(*) AS n_edges FROM edges WHERE year IS NULL OR year NOT BETWEEN 1996 AND 2000 GROUP BY year", "edges"))
def year_range_violations(spark, d):
    return schema.year_violations(T.edges(spark, d))


@query(sql("SELECT company_id, row_number() OVER (ORDER BY company_id) - 1 AS idx FROM nodes WHERE embedding IS NOT NULL", "nodes"))
def node_index(spark, d):
    return E.node_index(T.nodes(spark, d))


@query(sql("SELECT a.idx AS src_idx, b.idx AS tgt_idx, year FROM pos JOIN i a ON a.company_id = src JOIN i b ON b.company_id = tgt", "pos", i="SELECT company_id, row_number() OVER (ORDER BY company_id) - 1 AS idx FROM nodes WHERE embedding IS NOT NULL"))
def static_graph(spark, d):
    n = T.nodes(spark, d)
    return E.static_graph(n, E.scan_edges(n, T.edges(spark, d)))


@query(sql("SELECT p_partkey AS src, p_partkey * 3 + 1000000 AS tgt, CAST(1996 + p_size % 5 AS INTEGER) AS year FROM part WHERE p_partkey IN (SELECT company_id FROM nodes) AND p_partkey * 3 + 1000000 IN (SELECT company_id FROM nodes)", "nodes"))
def predefined_negatives(spark, d):
    rows = T.table(spark, d, "part").select(F.col("p_partkey").alias("supplier_id"), (F.col("p_partkey") * 3 + T.CUSTOMER_BASE).alias("customer_id"), "p_name", (F.col("p_size") % 5 + 1996).alias("year"))
    return E.known_pairs(rows, T.nodes(spark, d))


@query(sql("""SELECT w.y AS year, arg_min(a.year, abs(a.year - w.y) * 10000 + a.year) AS nearest,
  CAST(arg_min(a.pos, abs(a.year - w.y) * 10000 + a.year) AS INTEGER) AS position
  FROM (SELECT CAST(y AS INTEGER) AS y FROM range(1990, 2008) r(y)) w, (SELECT year, row_number() OVER (ORDER BY year) - 1 AS pos FROM (SELECT DISTINCT year FROM edges WHERE year BETWEEN 1996 AND 2000)) a GROUP BY w.y""", "edges"))  # fmt: skip
def nearest_year(spark, d):
    wanted = spark.range(1990, 2008).select(F.col("id").cast("int").alias("year"))
    return E.nearest_year(wanted, E.available_years(T.edges(spark, d)))
