"""Queries that build samples."""

from pyspark.sql import functions as F

from chronoloom.catalog import query
from chronoloom.functions.lineage import cut
from chronoloom.operators import edges as E
from chronoloom.operators import sampling as S
from chronoloom.oracle import key, sql, unit
from chronoloom.sources import tables as T

YEARS = [1996, 1997, 1998, 1999, 2000]
SEED = 42


def _pos(spark, d):
    return E.scan_edges(T.nodes(spark, d), T.edges(spark, d))


def _ids(spark, d):
    return E.embedded(T.nodes(spark, d)).select("company_id")


def _known(spark, d, pos=None):
    e = T.edges(spark, d)
    return S.blacklist(E.scan_edges(T.nodes(spark, d), e) if pos is None else pos, E.scan_edges(T.nodes(spark, d), e, "external"))


def _pool(spark, d, pos):
    return S.negative_pool(_ids(spark, d), YEARS, _known(spark, d, pos), 10 * pos.count(), SEED)


def _fixed(spark, d, pos):
    """pos: the distinct positives, stored, so that lines are joined with their
    orders once."""
    return S.fixed_negatives(_pool(spark, d, pos), pos.count(), 7, kept=True)


DP = "SELECT DISTINCT src, tgt, year FROM pos"
H = key("42", "src", "tgt", "year")
IDX = "SELECT company_id, row_number() OVER (ORDER BY company_id) - 1 AS idx, count(*) OVER () AS n FROM embedded"
KNOWN = "SELECT src, tgt, year FROM pos UNION SELECT src, tgt, year FROM ext"
SPLIT = f"""SELECT src, tgt, year, CASE WHEN rn <= floor(round(n * 0.1::DOUBLE, 6)) THEN 'test'
  WHEN rn <= 2 * floor(round(n * 0.1::DOUBLE, 6)) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY {H}) AS rn, count(*) OVER (PARTITION BY year) AS n FROM (SELECT DISTINCT src, tgt, year FROM pos))"""


@query(sql("SELECT year, n, round(inv / sum(inv) OVER (), 6) AS weight, CAST(floor(round(inv / sum(inv) OVER () * 1000, 6)) AS BIGINT) AS copies FROM (SELECT year, n, sum(n) OVER () / CAST(n AS DOUBLE) AS inv FROM (SELECT year, count(*) AS n FROM pos GROUP BY year))", "pos"))
def year_weights(spark, d):
    return S.year_weights(_pos(spark, d)).withColumn("weight", F.round("weight", 6))


@query(sql(f"SELECT src, tgt, year FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY {H}) AS rn FROM dp) WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM dp GROUP BY year))", "pos", dp=DP))
def year_balanced_resample(spark, d):
    return S.balanced_years(_pos(spark, d), SEED)


@query(sql(SPLIT, "pos"))
def stratified_split(spark, d):
    return S.stratified_split(_pos(spark, d), SEED)


@query(sql("SELECT split, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM s GROUP BY split", "pos", s=SPLIT))
def split_composition(spark, d):
    return S.composition(stratified_split(spark, d))


@query(sql("""SELECT 'test' AS a, 'train' AS b, count(*) AS n_shared FROM s x JOIN s y USING (src, tgt, year) WHERE x.split = 'test' AND y.split = 'train'
  UNION ALL SELECT 'test', 'val', count(*) FROM s x JOIN s y USING (src, tgt, year) WHERE x.split = 'test' AND y.split = 'val'
  UNION ALL SELECT 'train', 'val', count(*) FROM s x JOIN s y USING (src, tgt, year) WHERE x.split = 'train' AND y.split = 'val'""", "pos", s=SPLIT))  # fmt: skip
def split_leakage(spark, d):
    return S.leakage(stratified_split(spark, d))


def _draws(n: int | str) -> str:
    pick = lambda size, *p: f"least(CAST(floor({unit(*p)} * {size}) AS BIGINT), {size} - 1)"
    return f"""SELECT draw, a.company_id AS src, b.company_id AS tgt, p.year
  FROM (SELECT draw, {pick("size", "42", "'src'", "draw")} AS i, {pick("size", "42", "'tgt'", "draw")} AS j, CAST(1996 + least(CAST(floor({unit("42", "'year'", "draw")} * 5) AS BIGINT), 4) AS INTEGER) AS year
    FROM range(0, {n}) r(draw), (SELECT count(*) AS size FROM embedded)) p JOIN idx a ON a.idx = p.i JOIN idx b ON b.idx = p.j"""


POOL = """SELECT src, tgt, year, min(draw) AS draw FROM draws WHERE (src, tgt, year) NOT IN (SELECT src, tgt, year FROM known)
  GROUP BY src, tgt, year ORDER BY draw LIMIT (SELECT 10 * count(*) FROM dp)"""
NEGATIVES = "(SELECT count(*) FROM dp)"
POOL_DRAWS = "(SELECT 20 * count(*) FROM dp)"


@query(sql("SELECT src, tgt, year, draw FROM pool", "pos", "ext", dp=DP, idx=IDX, known=KNOWN, draws=_draws(POOL_DRAWS), pool=POOL))
def negative_pool(spark, d):
    """Ten times as many as there are distinct positives."""
    return _pool(spark, d, cut(_pos(spark, d).distinct()))


@query(sql(f"SELECT src, tgt, year FROM pool ORDER BY {key('7', 'src', 'tgt', 'year')} LIMIT {NEGATIVES}", "pos", "ext", dp=DP, idx=IDX, known=KNOWN, draws=_draws(POOL_DRAWS), pool=POOL))
def fixed_negatives(spark, d):
    """One for each distinct positive."""
    return _fixed(spark, d, cut(_pos(spark, d).distinct()))


@query(sql("SELECT src, tgt, year FROM known", "pos", "ext", known=KNOWN))
def blacklist(spark, d):
    return _known(spark, d)


@query(sql("SELECT src, tgt, year FROM draws WHERE (src, tgt, year) NOT IN (SELECT src, tgt, year FROM known) GROUP BY src, tgt, year", "pos", "ext", dp=DP, idx=IDX, known=KNOWN, draws=_draws("(SELECT count(*) FROM dp)")))
def random_negatives(spark, d):
    """As many draws as there are distinct positives."""
    return S.negative_pool(_ids(spark, d), YEARS, _known(spark, d), _pos(spark, d).distinct().count(), SEED, oversample=1.0).select("src", "tgt", "year")


BOOT = f"""SELECT draw, src, tgt, year FROM (SELECT draw, least(CAST(floor({unit("42", "draw")} * size) AS BIGINT), size - 1) AS i FROM range(0, {{n}}) r(draw), (SELECT count(*) AS size FROM dp))
  JOIN (SELECT *, row_number() OVER (ORDER BY year, src, tgt) - 1 AS i FROM dp) USING (i)"""


@query(sql(BOOT.format(n="(SELECT count(*) FROM dp)"), "pos", dp=DP))
def bootstrap_sample(spark, d):
    return S.bootstrap(_pos(spark, d).distinct(), SEED)


_RULE = unit("42", "'rule'", "draw")
_NEAR = f"""SELECT draw, b.src, b.tgt, b.year, rule, CASE WHEN rule LIKE 'industry%' THEN m.company_id ELSE a.company_id END AS new FROM (
    SELECT b.*, f.industry, s.n_in, CASE WHEN f.industry IS NOT NULL AND {_RULE} < 0.2::DOUBLE THEN 'industry_tgt' WHEN f.industry IS NOT NULL AND {_RULE} < 0.5::DOUBLE THEN 'industry_src'
      WHEN {_RULE} < 0.7::DOUBLE THEN 'random_tgt' ELSE 'random_src' END AS rule
    , least(CAST(floor({unit("42", "'any'", "draw")} * size) AS BIGINT), size - 1) AS any_i, least(CAST(floor({unit("42", "'member'", "draw")} * s.n_in) AS BIGINT), s.n_in - 1) AS near_i
    FROM (SELECT * FROM boot, (SELECT count(*) AS size FROM embedded)) b LEFT JOIN (SELECT company_id, min(industry) AS industry FROM members GROUP BY company_id) f ON f.company_id = b.src
    LEFT JOIN (SELECT industry, count(*) AS n_in FROM members GROUP BY industry) s ON s.industry = f.industry) b
  LEFT JOIN (SELECT industry, company_id, row_number() OVER (PARTITION BY industry ORDER BY company_id) - 1 AS pos FROM members) m
    ON m.industry = b.industry AND m.pos = b.near_i
  JOIN idx a ON a.idx = b.any_i"""


@query(sql("""SELECT min(draw) AS draw, src, tgt, year, arg_min(rule, draw) AS rule FROM (
    SELECT draw, CASE WHEN rule LIKE '%src' THEN new ELSE src END AS src, CASE WHEN rule LIKE '%tgt' THEN new ELSE tgt END AS tgt, year, rule FROM near)
  WHERE (src, tgt, year) NOT IN (SELECT src, tgt, year FROM known) GROUP BY src, tgt, year""", "pos", "ext", "members", dp=DP, known=KNOWN, idx=IDX, boot=BOOT.format(n="(SELECT count(*) FROM dp)"), near=_NEAR))  # fmt: skip
def industry_negatives(spark, d):
    """As many draws as there are distinct positives."""
    pos = _pos(spark, d).distinct()
    return S.industry_negatives(pos, E.industry_members(T.nodes(spark, d)), _ids(spark, d), _known(spark, d), pos.count(), SEED)


_TRIES = f"""SELECT p.src AS s, p.tgt AS t, p.year AS y, attempt, CASE WHEN swap THEN a.company_id ELSE p.src END AS src, CASE WHEN swap THEN p.tgt ELSE a.company_id END AS tgt, p.year
  FROM (SELECT src, tgt, year, attempt, {unit("42", "'end'", "src", "tgt", "year", "attempt")} < 0.5::DOUBLE AS swap, least(CAST(floor({unit("42", "'any'", "src", "tgt", "year", "attempt")} * size) AS BIGINT), size - 1) AS i
    FROM dp, range(1, 11) r(attempt), (SELECT count(*) AS size FROM embedded)) p JOIN idx a ON a.idx = p.i"""


@query(sql("""SELECT src, tgt, year, CAST(attempt AS INTEGER) AS attempt FROM (SELECT *, row_number() OVER (PARTITION BY s, t, y ORDER BY attempt) AS rn FROM tries
  WHERE src <> tgt AND (src, tgt, year) NOT IN (SELECT src, tgt, year FROM known)) WHERE rn = 1""", "pos", "ext", dp=DP, idx=IDX, known=KNOWN, tries=_TRIES))  # fmt: skip
def retried_negatives(spark, d):
    return S.retried_negatives(_pos(spark, d), _ids(spark, d), _known(spark, d), SEED)


def _paired(rule: str, near: str) -> dict[str, str]:
    of = ("src", "tgt", "year", "attempt")
    tries = f"""SELECT p.src AS s, p.tgt AS t, p.year AS y, rule, attempt, CASE WHEN rule LIKE '%tgt' THEN p.src ELSE new END AS src, CASE WHEN rule LIKE '%tgt' THEN new ELSE p.tgt END AS tgt, p.year,
    CASE WHEN rule LIKE '%tgt' THEN p.tgt ELSE p.src END AS old, new
  FROM (SELECT p.*, {near} AS new FROM (
      SELECT p.*, attempt, least(CAST(floor({unit("42", "'any'", *of)} * size) AS BIGINT), size - 1) AS any_i, least(CAST(floor({unit("42", "'near'", *of)} * n_in) AS BIGINT), n_in - 1) AS near_i
      FROM (SELECT dp.*, {rule} AS rule, f.industry, s.n_in FROM dp LEFT JOIN (SELECT company_id, min(industry) AS industry FROM members GROUP BY company_id) f ON f.company_id = dp.src
        LEFT JOIN (SELECT industry, count(*) AS n_in FROM members GROUP BY industry) s ON s.industry = f.industry) p, range(1, 21) r(attempt), (SELECT count(*) AS size FROM embedded)) p
    JOIN idx a ON a.idx = p.any_i LEFT JOIN (SELECT industry, company_id, row_number() OVER (PARTITION BY industry ORDER BY company_id) - 1 AS pos FROM members) m ON m.industry = p.industry AND m.pos = p.near_i) p"""
    return {"dp": DP, "known": KNOWN, "idx": IDX, "tries": tries}


_FIRST = """SELECT s AS src, t AS tgt, y AS year, src AS new_src, tgt AS new_tgt, rule, CAST(attempt AS INTEGER) AS attempt FROM (
  SELECT *, row_number() OVER (PARTITION BY s, t, y ORDER BY attempt) AS rn FROM tries WHERE new <> old AND (src, tgt, year) NOT IN (SELECT src, tgt, year FROM known)) WHERE rn = 1"""
_PAIR_RULE = unit("42", "'rule'", "src", "tgt", "year")


@query(sql(_FIRST, "pos", "ext", "members", **_paired(f"CASE WHEN {_PAIR_RULE} < 0.2::DOUBLE THEN 'industry_tgt' WHEN {_PAIR_RULE} < 0.5::DOUBLE THEN 'industry_src' WHEN {_PAIR_RULE} < 0.7::DOUBLE THEN 'random_tgt' ELSE 'random_src' END", "CASE WHEN rule LIKE 'industry%' AND attempt <= 10 THEN m.company_id ELSE a.company_id END")))
def paired_industry_negatives(spark, d):
    """A negative for each positive: within the industry, else from anywhere."""
    return S.paired_negatives(_pos(spark, d), _ids(spark, d), _known(spark, d), SEED, E.industry_members(T.nodes(spark, d)))


@query(sql(_FIRST, "pos", "ext", "members", **_paired(f"CASE WHEN {_PAIR_RULE} < 0.5::DOUBLE THEN 'random_tgt' ELSE 'random_src' END", "a.company_id")))
def paired_random_negatives(spark, d):
    """A negative for each positive: either end, half and half."""
    return S.paired_negatives(_pos(spark, d), _ids(spark, d), _known(spark, d), SEED)


@query(sql(f"""SELECT part, label, count(*) AS n FROM (SELECT split AS part, 1 AS label FROM s UNION ALL
    SELECT CASE WHEN u < nt / n::DOUBLE THEN 'test' WHEN u < (nt + nv) / n::DOUBLE THEN 'val' ELSE 'train' END, 0 FROM (SELECT *, {unit("42", "'part'", "src", "tgt", "year")} AS u FROM fixed),
      (SELECT count(*) FILTER (split = 'test') AS nt, count(*) FILTER (split = 'val') AS nv, count(*) AS n FROM s)
    UNION ALL SELECT 'graph', 1 FROM s WHERE split = 'train') GROUP BY part, label""", "pos", "ext", dp=DP, idx=IDX, known=KNOWN, draws=_draws(POOL_DRAWS), pool=POOL, s=SPLIT, fixed=f"SELECT src, tgt, year FROM pool ORDER BY {key('7', 'src', 'tgt', 'year')} LIMIT {NEGATIVES}"))  # fmt: skip
def loader_sizes(spark, d):
    """Rows of each part and label that a training run loads."""
    pos = cut(_pos(spark, d).distinct())
    parts = S.loaders(T.nodes(spark, d), pos, _fixed(spark, d, pos), SEED)
    rows = parts["full"].select(F.col("split").alias("part"), "label").unionByName(parts["graph"].select(F.lit("graph").alias("part"), F.lit(1).alias("label")))
    return rows.groupBy("part", "label").agg(F.count("*").alias("n"))


@query(sql("SELECT row_number() OVER (ORDER BY year, src, tgt) - 1 AS idx, src, tgt, year FROM dp", "pos", dp=DP))
def ordered_triples(spark, d):
    """Distinct triples with their place by year, source and target."""
    rows = _pos(spark, d).distinct().withColumn("order", F.struct("year", "src", "tgt"))
    return E.dense_index(rows, "order").select(F.col("idx").cast("long").alias("idx"), "src", "tgt", "year")


@query(sql("SELECT src, tgt, year FROM dp ORDER BY year, src, tgt LIMIT 128", "pos", dp=DP))
def toy_subset(spark, d):
    """The toy mode: the first 128 triples."""
    return _pos(spark, d).distinct().orderBy("year", "src", "tgt").limit(128)


@query(sql(f"SELECT src, tgt, year, CASE WHEN year BETWEEN 1996 AND 2000 THEN year ELSE CAST(1996 + least(CAST(floor({unit('42', 'src', 'tgt', 'year')} * 5) AS INTEGER), 4) AS INTEGER) END AS clamped FROM (SELECT DISTINCT src, tgt, year FROM edges)", "nodes", "edges"))
def clamped_years(spark, d):
    rows = T.edges(spark, d).select("src", "tgt", "year").distinct()
    return rows.withColumn("clamped", E.clamped(F.col("year"), YEARS, SEED, F.col("src"), F.col("tgt"), F.col("year")))


W_SQL = "SELECT year, inv / sum(inv) OVER () AS weight FROM (SELECT year, sum(count(*)) OVER () / CAST(count(*) AS DOUBLE) AS inv FROM pos GROUP BY year)"
SWAP = f"""SELECT DISTINCT src, tgt, coalesce(y, z) AS year FROM (
  SELECT src, tgt, year, min(o) FILTER (WHERE c > target) AS y, max(o) AS z FROM (
    SELECT p.src, p.tgt, p.year, w.year AS o, sum(w.weight) OVER (PARTITION BY p.src, p.tgt, p.year ORDER BY w.year) AS c,
      {unit("42", "p.src", "p.tgt", "p.year")} * sum(w.weight) OVER (PARTITION BY p.src, p.tgt, p.year) AS target
    FROM dp p JOIN w ON w.year <> p.year) GROUP BY src, tgt, year)"""


@query(sql("SELECT src, tgt, year FROM swapped WHERE (src, tgt, year) NOT IN (SELECT src, tgt, year FROM known)", "pos", "ext", dp=DP, known=KNOWN, w=W_SQL, swapped=SWAP))
def time_swap_negatives(spark, d):
    pos = _pos(spark, d)
    return S.time_swaps(pos, S.year_weights(pos), _known(spark, d), SEED)


@query(sql(f"SELECT src, tgt, year, 1 AS label, 'positive' AS kind FROM pos UNION ALL SELECT src, tgt, year, 0, 'dynamic' FROM (SELECT * FROM pool ORDER BY {key('7', 'src', 'tgt', 'year')} LIMIT {NEGATIVES})", "pos", "ext", dp=DP, idx=IDX, known=KNOWN, draws=_draws(POOL_DRAWS), pool=POOL))
def labelled_dataset(spark, d):
    return S.labelled(_pos(spark, d), fixed_negatives(spark, d))


@query(sql(f"SELECT src, tgt, year FROM (SELECT DISTINCT src, tgt, year FROM ext) ORDER BY {key('5', 'src', 'tgt', 'year')} LIMIT 5000", "ext"))
def external_subsample(spark, d):
    return S.subsample(E.scan_edges(T.nodes(spark, d), T.edges(spark, d), "external").distinct(), 5000, 5)


@query(sql(f"SELECT src, tgt, year, CASE WHEN {H} IS NOT NULL AND {unit('42', 'src', 'tgt', 'year')} < 0.9::DOUBLE THEN 'train' ELSE 'test' END AS part FROM dp", "pos", dp=DP))
def hash_split(spark, d):
    return S.hash_split(_pos(spark, d).distinct(), 0.9, SEED)


@query(sql(f"SELECT src, tgt, year FROM dp WHERE {unit('42', '0', 'src', 'tgt', 'year')} >= 0.1::DOUBLE", "pos", dp=DP))
def edge_dropout(spark, d):
    return S.drop_edges(_pos(spark, d).distinct(), 0.1, SEED)


@query(sql("""SELECT mode, count(*) FILTER (WHERE NOT (filter_external AND (src, tgt, year) IN (SELECT src, tgt, year FROM ext))) AS n_negatives
  FROM (VALUES ('ftt', false), ('ftf', true), ('fff', false), ('tff', true)) m(mode, filter_external), (SELECT DISTINCT src, tgt, year FROM draws WHERE (src, tgt, year) NOT IN (SELECT src, tgt, year FROM pos)) GROUP BY mode""", "pos", "ext", dp=DP, idx=IDX, draws=_draws("(SELECT count(*) FROM dp)")))  # fmt: skip
def sampling_mode_matrix(spark, d):
    """How many of the same draws, one for each distinct positive, each mode
    admits as negatives."""
    e = T.edges(spark, d)
    rows = S.random_triples(_ids(spark, d), YEARS, _pos(spark, d).distinct().count(), SEED).select("src", "tgt", "year").distinct()
    rows = rows.join(_pos(spark, d).distinct(), ["src", "tgt", "year"], "left_anti")
    ext = E.scan_edges(T.nodes(spark, d), e, "external").distinct().withColumn("external", F.lit(True))
    rows = rows.join(ext, ["src", "tgt", "year"], "left").join(F.broadcast(S.mode_table(spark)), how="cross")  # four modes
    return rows.groupBy("mode").agg(F.sum(F.when(F.col("filter_external") & F.col("external").isNotNull(), 0).otherwise(1).cast("long")).alias("n_negatives"))
