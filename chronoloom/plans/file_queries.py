"""Tables written in the formats around the engine and read back."""

import uuid

from pyspark.sql import functions as F

from chronoloom import catalog
from chronoloom.catalog import query
from chronoloom.functions.lineage import shared_dir
from chronoloom.functions.scalars import layer_norm
from chronoloom.operators import edges as E
from chronoloom.operators import encoders as N
from chronoloom.operators import metrics as M
from chronoloom.oracle import sql
from chronoloom.plans import edge_queries, graph_queries, imputation_queries, metric_queries, run_queries, sampling_queries  # noqa: F401 - their SQL
from chronoloom.sources import files
from chronoloom.sources import tables as T


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _sql_of(name: str) -> str:
    return catalog._SQL[name]


@query(sql("SELECT downstream, upstream FROM network", "network"))
def network_file(spark, d):
    """The industry network as one JSON map of names to lists, some nested."""
    n = T.industry_network(spark, d).distinct().groupBy("downstream").agg(F.array_sort(F.collect_list("upstream")).alias("ups"))
    one = F.map_from_entries(F.array_sort(F.collect_list(F.struct("downstream", F.array("ups")))))
    path = _folder(spark, "network")
    n.agg(F.to_json(one).alias("value")).write.text(path)  # one row: industries are few
    return files.industry_network(spark, path)


@query(_sql_of("stratified_split"))
def split_files(spark, d):
    """Each part of the split as CSV."""
    rows, path, out = sampling_queries.stratified_split(spark, d), _folder(spark, "split"), None
    for part in ("train", "val", "test"):
        files.write_split(rows.where(F.col("split") == part), f"{path}/{part}")
        back = files.split_file(spark, f"{path}/{part}").withColumn("split", F.lit(part))
        out = back if out is None else out.unionByName(back)
    return out


@query(sql("SELECT src, tgt, year, count(*) AS n FROM edges WHERE year IN (1997, 1999) AND src IN (SELECT company_id FROM embedded) AND tgt IN (SELECT company_id FROM embedded) GROUP BY ALL", "edges", "embedded"))
def edges_of_years(spark, d):
    """The edge table in folders by year, of which two are read, among the
    embedded companies."""
    path = _folder(spark, "edges")
    files.write_edges(T.edges(spark, d), path)
    rows = E.among(files.read_edges(spark, path, [1997, 1999]), E.embedded(T.nodes(spark, d)))
    return rows.groupBy("src", "tgt", "year").agg(F.count("*").alias("n"))


@query(_sql_of("prediction_matrix_wide"))
def matrix_file(spark, d):
    """The wide prediction matrix as CSV."""
    rows, path = catalog._QUERIES["prediction_matrix_wide"](spark, d), _folder(spark, "matrix")
    files.write_table(rows, path, "csv")
    kinds = dict(rows.dtypes)
    return files.matrix_file(spark, path).select(*[F.col(c).cast(kinds[c]).alias(c) for c in rows.columns])


@query(f'SELECT CAST(window_years AS INTEGER) AS "window", CAST(least AS INTEGER) AS threshold, precision, recall, fpr, recall AS tpr, auc, ap, acc, CAST(least AS DOUBLE) AS best_threshold FROM ({_sql_of("edgebank")})')
def baseline_file(spark, d):
    """The baseline table as CSV."""
    rows, path = graph_queries.edgebank(spark, d), _folder(spark, "baseline")
    named = rows.select(F.col("window_years").alias("window"), F.col("least").alias("threshold"), "precision", "recall", "fpr", F.col("recall").alias("tpr"), "auc", "ap", "acc", F.col("least").cast("double").alias("best_threshold"))
    files.write_table(named, path, "csv")
    return files.baseline_file(spark, path)


@query(sql("SELECT label, prob, count(*) AS n FROM scores WHERE model_id = 0 GROUP BY label, prob", "scores"))
def score_lists_file(spark, d):
    """Lists of positive and negative scores as JSON, a thousand samples a row."""
    s, path = T.scores(spark, d).where("model_id = 0"), _folder(spark, "scores")
    of = lambda label: F.array_sort(F.collect_list(F.when(F.col("label") == label, F.col("prob"))))
    lists = s.groupBy(F.floor(F.col("sample_id") / 1000).alias("part")).agg(of(1).alias("test_predictions"), of(0).alias("neg_predictions"))
    files.write_table(lists, path, "json")
    back = files.score_lists(spark.read.schema("part long, test_predictions array<double>, neg_predictions array<double>").json(path))
    return back.groupBy("label", "prob").agg(F.count("*").alias("n"))


@query(_sql_of("threshold_table"))
def threshold_file(spark, d):
    """The threshold table as JSON with the run's settings."""
    rows, path = catalog._QUERIES["threshold_table"](spark, d), _folder(spark, "thresholds")
    files.write_summary(rows, path, seed=sampling_queries.SEED)
    return spark.read.schema(rows.schema.add("_meta", "string")).json(path).where(F.get_json_object("_meta", "$.seed") == str(sampling_queries.SEED)).drop("_meta")


@query(_sql_of("overlap_sweep"))
def overlap_file(spark, d):
    """The overlap sweep as JSON."""
    rows, path = imputation_queries.overlap_sweep(spark, d), _folder(spark, "overlap")
    files.write_table(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


@query(_sql_of("best_epoch"))
def best_epoch_file(spark, d):
    """The table of best epochs as CSV."""
    rows, path = run_queries.best_epoch(spark, d), _folder(spark, "best")
    files.write_table(rows, path, "csv")
    return spark.read.schema(rows.schema).csv(path, header=True)


@query(sql("SELECT model, tag, count(*) AS n, round(sum(value), 4) AS total FROM log GROUP BY model, tag", "log"))
def appended_log(spark, d):
    """The metric log appended in two parts."""
    log, path = T.metric_log(spark, d), _folder(spark, "log")
    files.append_metrics(log.where("epoch < 100"), path)
    files.append_metrics(log.where("epoch >= 100"), path)
    return spark.read.parquet(path).groupBy("model", "tag").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(sql("SELECT label, count(*) AS n, round(avg(prob), 6) AS mean FROM scores WHERE sample_id % 7 <> 0 AND sample_id % 11 <> 0 GROUP BY label", "scores"))
def scores_without_nan(spark, d):
    """NaN and null scores are left out."""
    s = T.scores(spark, d)
    bad = F.when(F.col("sample_id") % 7 == 0, F.lit(float("nan"))).when(F.col("sample_id") % 11 != 0, F.col("prob"))
    return M.clean(s.withColumn("prob", bad)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("mean"))


@query(sql("SELECT DISTINCT src, tgt, CAST(year - 1996 AS INTEGER) AS pos FROM ext", "ext"))
def known_years_only(spark, d):
    """Pairs of all years that can be gathered: others have no encoding."""
    rows = T.edges(spark, d).where("source = 'external'").select("src", "tgt", (F.col("year") - 1996).cast("int").alias("pos")).distinct()
    return N.gather_states(rows, graph_queries._states(spark, d), len(graph_queries.YEARS)).select("src", "tgt", "pos")


@query(sql("SELECT count(*) AS n_rows, count(DISTINCT (src, tgt, year, source, coalesce(model, ''), coalesce(probability, -1))) AS n_distinct, n_rows - n_distinct AS n_repeated FROM edges", "edges"))
def repeated_edges(spark, d):
    e = T.edges(spark, d)
    return e.agg(F.count("*").alias("n_rows")).join(files.dedup_edges(e).agg(F.count("*").alias("n_distinct")), how="cross").withColumn("n_repeated", F.col("n_rows") - F.col("n_distinct"))  # one row each


@query(sql("SELECT node, CAST(k AS INTEGER) AS component, round(v, 6) AS value FROM (SELECT node, unnest(list_transform(x, lambda v: (v - list_avg(x)) / sqrt(list_var_pop(x) + 1e-5::DOUBLE))) AS v, unnest(range(len(x))) AS k FROM (SELECT company_id AS node, embedding::DOUBLE[] AS x FROM nodes WHERE embedding IS NOT NULL))", "nodes"))
def normed_features(spark, d):
    """Layer norm of every node's vector, a component in a row."""
    x = graph_queries._features(spark, d).select("node", F.transform("x", lambda v: v.cast("double")).alias("x"))
    return x.select("node", F.posexplode(layer_norm(F.col("x"))).alias("component", "value")).withColumn("value", F.round("value", 6))
