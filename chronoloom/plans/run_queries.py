"""Queries over training logs."""

import uuid

from pyspark.sql import functions as F

from chronoloom.catalog import query
from chronoloom.functions.lineage import cut, shared_dir
from chronoloom.functions.scalars import duration_text as duration_text_of
from chronoloom.operators import runs as R
from chronoloom.oracle import sql
from chronoloom.plans.metric_queries import rounded
from chronoloom.sources import event_files as V
from chronoloom.sources import tables as T

TAGS = ["Test/Epoch_AUC", "Test/Epoch_F1", "Train/Epoch_Loss"]
LONGEST = "SELECT model, flag, run_id, n_epochs FROM (SELECT *, row_number() OVER (PARTITION BY model, flag ORDER BY n_epochs DESC, run_id) AS rn FROM (SELECT model, flag, run_id, count(DISTINCT epoch) AS n_epochs FROM log GROUP BY ALL)) WHERE rn = 1"


@query(sql(LONGEST, "log"))
def longest_run(spark, d):
    return R.longest_runs(T.metric_log(spark, d))


BEST = "SELECT model, flag, epoch, value, tag AS criterion FROM (SELECT *, row_number() OVER (PARTITION BY model, flag ORDER BY CASE tag WHEN 'Test/Epoch_AUC' THEN 1 WHEN 'Test/Epoch_F1' THEN 2 END, value DESC, epoch) AS rn FROM log WHERE tag IN ('Test/Epoch_AUC', 'Test/Epoch_F1')) WHERE rn = 1"


@query(sql(BEST, "log"))
def best_epoch(spark, d):
    return R.best_epochs(T.metric_log(spark, d), TAGS[:2])


@query(sql("SELECT l.model, l.flag, l.epoch, l.tag, round(avg(l.value), 6) AS value FROM log l JOIN b ON l.model = b.model AND l.flag = b.flag AND l.epoch = b.epoch GROUP BY ALL", "log", b=BEST))
def metrics_at_best_epoch(spark, d):
    return rounded(R.at_best_epoch(T.metric_log(spark, d), TAGS[:2]), "value")


@query(sql("SELECT model, flag, tag, epoch, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM log WHERE tag NOT LIKE '%/Batch_%' GROUP BY ALL", "log"))
def epoch_mean_std(spark, d):
    return rounded(R.epoch_stats(R.epoch_level(T.metric_log(spark, d))), "mean", "std")


@query(sql("SELECT model, flag, round(avg(gap), 3) AS mean_seconds, count(*) AS n_gaps FROM (SELECT model, flag, wall_time - lag(wall_time) OVER (PARTITION BY model, flag, run_id, tag ORDER BY wall_time, epoch) AS gap FROM log) WHERE gap > 0 AND gap < 86400 GROUP BY ALL", "log"))
def epoch_duration(spark, d):
    return rounded(R.epoch_durations(T.metric_log(spark, d)), "mean_seconds", places=3)


@query(sql("SELECT model, flag, " + ", ".join(f"round(avg(value) FILTER (WHERE tag = '{t}'), 6) AS {t.replace('/', '_')}" for t in TAGS) + " FROM log GROUP BY model, flag", "log"))
def metric_summary_pivot(spark, d):
    s = R.summary_table(T.metric_log(spark, d), TAGS)
    return rounded(s, *s.columns[2:])


@query(sql("SELECT model, flag, run_id, tag, CAST(batch AS INTEGER) AS batch, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER w AS batch, avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean FROM log WINDOW w AS (PARTITION BY model, flag, run_id, tag ORDER BY epoch, wall_time, value)) WHERE batch % 10 = 0", "log"))
def trailing_batch_metrics(spark, d):
    return rounded(R.trailing(T.metric_log(spark, d)), "mean")


CURVE = "SELECT model, flag, epoch, round(avg(value), 6) AS value FROM log WHERE tag = 'Test/Epoch_AUC' GROUP BY ALL"
_TRACE = "SELECT *, max(value) OVER (PARTITION BY model, flag ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best, sum(gain) OVER (PARTITION BY model, flag ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CAST(coalesce(value > max(value) OVER (PARTITION BY model, flag ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS INTEGER) AS gain FROM curve)"


@query(sql("SELECT model, flag, epoch, value, best, CAST(row_number() OVER (PARTITION BY model, flag, island ORDER BY epoch) - 1 AS INTEGER) AS waited, row_number() OVER (PARTITION BY model, flag, island ORDER BY epoch) - 1 >= 5 AS stopped FROM t", "log", curve=CURVE, t=_TRACE))
def early_stop_trace(spark, d):
    curve = T.metric_log(spark, d).where("tag = 'Test/Epoch_AUC'").groupBy("model", "flag", "epoch").agg(F.round(F.avg("value"), 6).alias("value"))
    return R.early_stop(curve, 5)


@query(sql("""SELECT model, tag, count(*) AS n FROM (SELECT *, max(CAST(epoch < 100 AS INTEGER)) OVER w + max(CAST(epoch >= 100 AS INTEGER)) OVER w = 2 AS mixed FROM log WINDOW w AS (PARTITION BY model, run_id, flag, tag))
  WHERE NOT (model = 'click' AND tag LIKE 'Monitor/Wasserstein\\_%' ESCAPE '\\' AND mixed) OR epoch >= 100 GROUP BY model, tag""", "log"))  # fmt: skip
def mixed_step_filter(spark, d):
    return R.drop_fine_steps(T.metric_log(spark, d), "click").groupBy("model", "tag").agg(F.count("*").alias("n"))


@query(sql(r"SELECT name, regexp_extract(name, '(\d{4}-\d{4})-(f\w{2}|t\w{2})$', 1) AS stamp, regexp_extract(name, '(\d{4}-\d{4})-(f\w{2}|t\w{2})$', 2) AS flag FROM n WHERE regexp_matches(name, '(\d{4}-\d{4})-(f\w{2}|t\w{2})$')", n="SELECT DISTINCT concat(lpad(CAST(epoch_us(ts) // 86400000000 % 10000 AS VARCHAR), 4, '0'), '-', lpad(CAST(user_id % 2400 AS VARCHAR), 4, '0'), CASE event_id % 3 WHEN 0 THEN '-fff' WHEN 1 THEN '-tff' ELSE '-zzz' END) AS name FROM events"))
def run_name_parse(spark, d):
    e = T.table(spark, d, "events")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000) % 10000
    tail = F.when(F.col("event_id") % 3 == 0, "-fff").when(F.col("event_id") % 3 == 1, "-tff").otherwise("-zzz")
    names = e.select(F.concat(F.lpad(day.cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("user_id") % 2400).cast("string"), 4, "0"), tail).alias("name")).distinct()
    return R.parse_names(names)


def _hists(spark, d):
    """Histograms of each model's scores by label: 20 right limits."""
    s = T.scores(spark, d)
    bins = s.groupBy("model_id", "label", F.least(F.floor(F.round(F.col("prob") * 20, 9)), F.lit(19)).cast("int").alias("b")).agg(F.count("*").alias("n"))
    full = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")).cast("double"))
    limits = F.array(*[F.lit((i + 1) / 20) for i in range(20)])
    return bins.groupBy("model_id", "label").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m")).select("model_id", "label", limits.alias("limits"), full.alias("counts"), F.lit(1).alias("step"))


H20 = "SELECT model_id, label, CAST(least(floor(round(prob * 20, 9)), 19) AS INTEGER) AS b, count(*) AS n FROM scores GROUP BY ALL"
# 50 even bins from 20 even ones: a bin takes its overlap with each of them
REBIN = """SELECT h.model_id, h.label, CAST(k AS INTEGER) AS bin, sum(h.n * greatest(0, least((k + 1) / 50.0::DOUBLE, (b + 1) / 20.0::DOUBLE) - greatest(k / 50.0::DOUBLE, b / 20.0::DOUBLE)) * 20) * 5000 / max(t.n) AS n
  FROM h, range(0, 50) r(k), (SELECT model_id, label, sum(n) AS n FROM h GROUP BY ALL) t WHERE t.model_id = h.model_id AND t.label = h.label GROUP BY h.model_id, h.label, k"""


@query(sql("SELECT model_id, label, bin, round(n, 6) AS n FROM r50", "scores", h=H20, r50=REBIN))
def hist_rebin(spark, d):
    h = R.last_events(_hists(spark, d), ("model_id", "label"))
    return rounded(R.rebin(h, ("model_id", "label")), "n")


@query(sql("SELECT model_id, round(sum(abs(a - b)) * 0.02, 6) AS distance FROM (SELECT model_id, bin, sum(n) FILTER (WHERE label = 1) / 5000 AS x, sum(n) FILTER (WHERE label = 0) / 5000 AS y, sum(x) OVER (PARTITION BY model_id ORDER BY bin) AS a, sum(y) OVER (PARTITION BY model_id ORDER BY bin) AS b FROM r50 GROUP BY model_id, bin) GROUP BY model_id", "scores", h=H20, r50=REBIN))
def hist_wasserstein(spark, d):
    r = R.rebin(R.last_events(_hists(spark, d), ("model_id", "label")), ("model_id", "label"))
    return rounded(R.histogram_distance(r.where("label = 1"), r.where("label = 0"), ("model_id",)), "distance")


@query(sql("SELECT model, flag, round(coalesce(0.5::DOUBLE * q + 0.5::DOUBLE * a, f), 6) AS score FROM (SELECT model, flag, avg(value) FILTER (WHERE tag = 'Train/Epoch_Loss') AS q, avg(value) FILTER (WHERE tag = 'Test/Epoch_AUC') AS a, avg(value) FILTER (WHERE tag = 'Test/Epoch_F1') AS f FROM log GROUP BY ALL)", "log"))
def composite_score(spark, d):
    s = R.summary_table(T.metric_log(spark, d), TAGS)
    return rounded(R.composite(s, "Train_Epoch_Loss", "Test_Epoch_AUC", "Test_Epoch_F1").select("model", "flag", "score"), "score")


@query("""SELECT user_id, x AS seconds, CASE WHEN x < 60 THEN printf('%.1fs', x) WHEN x < 3600 THEN printf('%dm%02ds', CAST(x AS BIGINT) // 60, CAST(x AS BIGINT) % 60)
  ELSE printf('%dh%02dm', CAST(x AS BIGINT) // 3600, CAST(x AS BIGINT) % 3600 // 60) END AS shown
  FROM (SELECT user_id, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 // (1 + user_id % 3000) AS DOUBLE) AS x FROM events GROUP BY user_id)""")
def duration_text(spark, d):
    """The time of each user's events, by a step that differs by user, as text."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    span = T.table(spark, d, "events").groupBy("user_id").agg((us(F.max("ts")) - us(F.min("ts"))).alias("us"))
    step = F.expr("us div 1000000 div (1 + user_id % 3000)").cast("double")
    return span.select("user_id", step.alias("seconds")).withColumn("shown", duration_text_of(F.col("seconds")))


@query(sql("SELECT model, flag, run_id, tag, CAST(batch AS INTEGER) AS batch, round(recent, 6) AS recent, round(so_far, 6) AS so_far FROM (SELECT *, row_number() OVER w AS batch, avg(value) OVER (w ROWS 49 PRECEDING) AS recent, avg(value) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far FROM log WINDOW w AS (PARTITION BY model, flag, run_id, tag ORDER BY epoch, wall_time, value)) WHERE batch % 10 = 0", "log"))
def buffered_train_metrics(spark, d):
    return rounded(R.buffered(T.metric_log(spark, d)), "recent", "so_far")


TAGGED = {0: "Test/Neg", 1: "Test/Pos"}


def _tagged_hists(spark, d):
    """Histograms of the scores of both labels and of a tenth of the samples,
    which stand for external ones, by model and flag."""
    s = T.scores(spark, d).withColumn("flag", F.when(F.col("sample_id") % 2 == 0, "fff").otherwise("tff"))
    tag = F.when(F.col("sample_id") % 10 < 2, "Test/External").when(F.col("label") == 1, TAGGED[1]).otherwise(TAGGED[0])
    bins = s.groupBy(F.concat(F.lit("m"), "model_id").alias("model"), "flag", tag.alias("tag"), F.least(F.floor(F.round(F.col("prob") * 20, 9)), F.lit(19)).cast("int").alias("b")).agg(F.count("*").alias("n"))
    full = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")).cast("double"))
    limits = F.array(*[F.lit((i + 1) / 20) for i in range(20)])
    rows = bins.groupBy("model", "flag", "tag").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    return rows.select("model", "flag", "tag", F.lit(1).cast("long").alias("step"), limits.alias("limits"), full.alias("counts"))


_TH = """SELECT 'm' || model_id AS model, CASE WHEN sample_id % 2 = 0 THEN 'fff' ELSE 'tff' END AS flag, CASE WHEN sample_id % 10 < 2 THEN 'F' WHEN label = 1 THEN 'P' ELSE 'N' END AS tag,
  CAST(least(floor(round(prob * 20, 9)), 19) AS INTEGER) AS b, count(*) AS n FROM scores GROUP BY ALL"""
_TH50 = """SELECT h.model, h.flag, h.tag, CAST(k AS INTEGER) AS bin, sum(h.n * greatest(0, least((k + 1) / 50.0::DOUBLE, (b + 1) / 20.0::DOUBLE) - greatest(k / 50.0::DOUBLE, b / 20.0::DOUBLE)) * 20) / max(t.n) AS n
  FROM h, range(0, 50) r(k), (SELECT model, flag, tag, sum(n) AS n FROM h GROUP BY ALL) t WHERE t.model = h.model AND t.flag = h.flag AND t.tag = h.tag GROUP BY h.model, h.flag, h.tag, k"""
_THC = "SELECT model, flag, bin, " + ", ".join(f"sum(coalesce(n, 0)) FILTER (tag = '{t}') AS {t.lower()}n" for t in "FPN") + " FROM r50 GROUP BY model, flag, bin"
_THS = "SELECT model, flag, " + ", ".join(f"sum({t}n) OVER (PARTITION BY model, flag ORDER BY bin) AS {t}" for t in "fpn") + " FROM c50"


_TABLE = "SELECT model, flag, round(w_fp, 6) AS w_fp, round(w_fn, 6) AS w_fn, round(w_pn, 6) AS w_pn, round(w_fn - w_fp, 6) AS delta FROM (SELECT model, flag, sum(abs(f - p)) * 0.02 AS w_fp, sum(abs(f - n)) * 0.02 AS w_fn, sum(abs(p - n)) * 0.02 AS w_pn FROM s50 GROUP BY model, flag)"


@query(sql(_TABLE, "scores", h=_TH, r50=_TH50, c50=_THC, s50=_THS))
def wasserstein_table(spark, d):
    return rounded(R.distance_table(_tagged_hists(spark, d), "Test/External", TAGGED[1], TAGGED[0]), "w_fp", "w_fn", "w_pn", "delta")


def _event_files(spark, rows):
    folder = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    cut(V.write_events(rows, folder if "://" in folder else f"file://{folder}"))
    return V.read_events(spark, folder, "events.out")


@query(sql("SELECT model, CAST(run_id AS VARCHAR) AS run_id, flag, epoch, tag, round(CAST(value AS FLOAT)::DOUBLE, 6) AS value, round(wall_time, 6) AS wall_time FROM log", "log"))
def event_file_scalars(spark, d):
    """The metric log written as event files and read back."""
    none = F.lit(None).cast("array<double>")
    rows = T.metric_log(spark, d).select("model", "run_id", "flag", "wall_time", F.col("epoch").alias("step"), "tag", "value", none.alias("limits"), none.alias("counts"))
    return rounded(V.scalars(_event_files(spark, rows)), "value", "wall_time")


@query(sql(_TABLE, "scores", h=_TH, r50=_TH50, c50=_THC, s50=_THS))
def event_file_histograms(spark, d):
    """The distances of histograms written as event files and read back."""
    h = _tagged_hists(spark, d)
    none = F.lit(None).cast("double")
    rows = h.select("model", F.lit("0").alias("run_id"), "flag", F.lit(0.0).alias("wall_time"), "step", "tag", none.alias("value"), "limits", "counts")
    back = V.histograms(_event_files(spark, rows), ["Test/External", *TAGGED.values()])
    return rounded(R.distance_table(back, "Test/External", TAGGED[1], TAGGED[0]), "w_fp", "w_fn", "w_pn", "delta")


_MEANS = "SELECT model, flag, " + ", ".join(f"avg(value) FILTER (WHERE tag = '{t}') AS {t.replace('/', '_')}" for t in TAGS) + " FROM log GROUP BY model, flag"
_SCALED = ", ".join(f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 6) AS {c}" for c in (t.replace("/", "_") for t in TAGS))


@query(sql(f"SELECT model, flag, {_SCALED} FROM m", "log", m=_MEANS))
def metric_summary_scaled(spark, d):
    s = R.summary_table(T.metric_log(spark, d), TAGS)
    return rounded(R.min_max(s, s.columns[2:]), *s.columns[2:])


@query(sql("SELECT model, flag, count(*) AS n FROM log WHERE NOT (model = 'click' AND flag = 'fff' AND run_id = 2) GROUP BY model, flag", "log"))
def run_exclusion(spark, d):
    return R.without_runs(T.metric_log(spark, d), {"model": "click", "flag": "fff", "run_id": 2}).groupBy("model", "flag").agg(F.count("*").alias("n"))


_GAPS = "SELECT model, flag, epoch, wall_time - lag(wall_time) OVER w AS gap, abs(epoch - lag(epoch) OVER w) AS step FROM log WINDOW w AS (PARTITION BY model, flag, run_id, tag ORDER BY wall_time, epoch)"


@query(sql("SELECT model, flag, round(avg(gap) FILTER (WHERE gap > 0 AND gap < 86400) * CASE WHEN model = 'click' THEN max(epoch) / 2.0::DOUBLE / avg(step) ELSE 1 END, 3) AS mean_seconds, count(*) FILTER (WHERE gap > 0 AND gap < 86400) AS n_gaps FROM g GROUP BY model, flag", "log", g=_GAPS))
def epoch_duration_rescaled(spark, d):
    log = T.metric_log(spark, d)
    return rounded(R.rescaled_durations(R.epoch_durations(log), log, "click"), "mean_seconds", places=3)


@query("SELECT strftime(ts, '%m%d-%H%M') AS stamp, count(*) AS n FROM events GROUP BY 1")
def run_stamp(spark, d):
    """The stamp that names a run, of each event's time."""
    return T.table(spark, d, "events").groupBy(F.date_format("ts", "MMdd-HHmm").alias("stamp")).agg(F.count("*").alias("n"))
