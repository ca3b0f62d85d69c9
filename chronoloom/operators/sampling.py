"""Samples that depend on keys only: splits, negatives, bootstrap, resampling.

Every draw is a hash (``functions.hashing``), so a sample can be rebuilt from
its seed on any cluster, and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.hashing import key, pick, unit
from chronoloom.functions.lineage import cut
from chronoloom.functions.scan import scan
from chronoloom.operators.edges import dense_index, static_graph
from chronoloom.schema import TRIPLE


#: Ranges that an order is cut into before ranks are given.
RANGES = 4096


def smallest(rows: DataFrame, order: Column, place: Column, n: int, kept: bool = False) -> DataFrame:
    """The n rows that come first by order (all, if fewer). place: the order as
    a number in [0, 1), rising with it. Rows are counted by range; whole ranges
    stay, and only the range in which the n-th row falls is put in order. Order
    and place are made again rather than stored. kept: rows are a checkpoint."""
    rows, at = rows if kept else cut(rows), F.floor(place * RANGES).cast("int")
    left, edge = n, None
    for r, have in sorted(map(tuple, rows.groupBy(at.alias("_range")).count().collect())):  # RANGES rows at most
        if have > left:
            edge = r
            break
        left -= have
    if edge is None:
        return rows
    return rows.where(at < edge).unionByName(rows.where(at == edge).orderBy(order).limit(left))


def ranked(rows: DataFrame, by: str, hashed: Column) -> DataFrame:
    """rows with rn, the rank from 1 by hash within by, and n, the group's size.
    hashed: hexadecimal. A range of hashes is ranked at a time, so that a group
    of any size is many small ones."""
    rows = cut(rows.withColumn("_hash", hashed).withColumn("_range", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int")))
    sizes = rows.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_n").over(w))
    local = rows.withColumn("_at", F.row_number().over(Window.partitionBy(by, "_range").orderBy("_hash")))
    return local.join(sizes, [by, "_range"]).withColumn("rn", F.col("_at") + F.col("_before")).drop("_hash", "_range", "_at", "_n", "_before")


def year_weights(triples: DataFrame, copies: int = 1000) -> DataFrame:
    """year, n, weight (inverse frequency, sums to 1), copies (floor)."""
    n = triples.groupBy("year").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    inv = F.sum("n").over(every) / F.col("n")
    n = n.withColumn("inv", inv).withColumn("weight", F.col("inv") / F.sum("inv").over(every))
    return n.select("year", "n", "weight", F.floor(F.round(F.col("weight") * copies, 6)).cast("long").alias("copies"))


def balanced_years(triples: DataFrame, seed: int) -> DataFrame:
    """As many distinct triples of each year as the rarest year has."""
    rows = triples.distinct()
    least = rows.groupBy("year").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    rows = ranked(rows, "year", key(seed, *map(F.col, TRIPLE))).join(F.broadcast(least), how="cross")  # one row
    return rows.where("rn <= least").select(*TRIPLE)


def stratified_split(triples: DataFrame, seed: int, test: float = 0.1, val: float = 0.1) -> DataFrame:
    """Distinct triples with split: test, val or train, by share within years."""
    rows = triples.distinct()
    rows = ranked(rows, "year", key(seed, *map(F.col, TRIPLE)))
    part = lambda share: F.floor(F.round(F.col("n") * share, 6))
    return rows.select(*TRIPLE, F.when(F.col("rn") <= part(test), "test").when(F.col("rn") <= part(test) + part(val), "val").otherwise("train").alias("split"))


def composition(split: DataFrame) -> DataFrame:
    """split, n, share of all rows."""
    n = split.groupBy("split").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def leakage(split: DataFrame) -> DataFrame:
    """a, b, n_shared for each pair of splits (all 0 if they are disjoint)."""
    seen = split.select(*TRIPLE, "split").distinct().groupBy(*TRIPLE).agg(F.collect_set("split").alias("s"))
    pairs = [("test", "train"), ("test", "val"), ("train", "val")]
    one = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.sum((F.array_contains("s", a) & F.array_contains("s", b)).cast("long")), F.lit(0).cast("long")).alias("n_shared"))
    return seen.agg(F.array(*[one(a, b) for a, b in pairs]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def _picked(draws: DataFrame, ids: DataFrame, n: int, col: str, draw: Column) -> DataFrame:
    """draws with the id at a drawn position of ids (idx, company_id)."""
    rows = draws.withColumn("idx", F.least(draw, F.lit(n - 1)))
    return rows.join(ids.select("idx", F.col("company_id").alias(col)), "idx").drop("idx")


def random_triples(ids: DataFrame, years: list[int], n: int, seed: int, self_loops: bool = True) -> DataFrame:
    """n uniform draws (draw, src, tgt, year), not yet distinct."""
    index = dense_index(ids.select("company_id"), "company_id")
    size = ids.count()
    draws = ids.sparkSession.range(n).withColumnRenamed("id", "draw")
    if not size or not years:
        return draws.where("false").select("draw", F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("tgt"), F.lit(0).alias("year"))
    rows = _picked(draws, index, size, "src", pick(size, seed, "src", F.col("draw")))
    rows = _picked(rows, index, size, "tgt", pick(size, seed, "tgt", F.col("draw")))
    rows = rows.withColumn("year", F.get(F.array(*[F.lit(y) for y in years]), pick(len(years), seed, "year", F.col("draw")).cast("int")))
    return rows if self_loops else rows.where("src != tgt")


def negative_pool(ids: DataFrame, years: list[int], known: DataFrame, wanted: int, seed: int, oversample: float = 2.0, self_loops: bool = True) -> DataFrame:
    """Up to wanted distinct triples that are in none of the known ones. The
    draws with the smallest numbers stay, so a larger pool extends a smaller."""
    total, taken = max(1, int(wanted * oversample)), known.select(*TRIPLE).distinct()
    # draws depend on their numbers only: where the first ones give enough, later ones are not needed
    for n in sorted({min(total, wanted + wanted // 10 + 1_000), total}):
        rows = random_triples(ids, years, min(n, int(wanted * oversample)), seed, self_loops)
        rows = cut(rows.groupBy(*TRIPLE).agg(F.min("draw").alias("draw")).join(taken, TRIPLE, "left_anti"))
        if n == total or rows.count() >= wanted:
            return smallest(rows, F.col("draw"), F.col("draw") / total, wanted, kept=True)


def _first_by_hash(rows: DataFrame, n: int, seed: int, kept: bool = False) -> DataFrame:
    h = key(seed, *map(F.col, TRIPLE))
    place = F.conv(F.substring(h, 1, 3), 16, 10).cast("int") / 4096
    if kept:
        share = 1.1 * n / max(1, rows.count()) + 0.01
        if share < 0.5:
            low = cut(rows.where(place < share))
            if low.count() >= n:  # so the first n are among them
                return smallest(low, h, place, n, kept=True)
    return smallest(rows, h, place, n)


def fixed_negatives(pool: DataFrame, n: int, seed: int, more: DataFrame | None = None, kept: bool = False) -> DataFrame:
    """n of the pool without replacement; if it is short, topped up from more,
    triples that are known to be no positives (all, if these are short too).
    kept: the pool is read from a table, so it is not stored again: it is
    hashed once, and only the triples with low hashes are put in order."""
    got = _first_by_hash(pool.select(*TRIPLE), n, seed, kept)
    if more is None:
        return got
    have = got.count()
    if have >= n:
        return got
    rest = more.select(*TRIPLE).distinct().join(pool.select(*TRIPLE), TRIPLE, "left_anti")
    return got.unionByName(_first_by_hash(rest, n - have, seed))


def retried_negatives(positives: DataFrame, ids: DataFrame, known: DataFrame, seed: int, attempts: int = 10) -> DataFrame:
    """src, tgt, year, attempt: for each positive a negative in its year with
    the source or the target replaced by any company, half and half: the first
    of its attempts that is unknown and no self-loop. Positives without one are
    left to ``random_triples``. Only those whose first attempt fails are tried
    further, all at once."""
    size = max(1, ids.count())
    index = cut(dense_index(ids.select("company_id"), "company_id"))
    rows, taken = cut(positives.select(*TRIPLE).distinct()), cut(known.select(*TRIPLE).distinct())

    def tried(some: DataFrame, low: int, high: int) -> DataFrame:
        t = some.withColumn("attempt", F.explode(F.sequence(F.lit(low), F.lit(high))))
        of = [F.col(c) for c in (*TRIPLE, "attempt")]
        t = _picked(t, index, size, "any", pick(size, seed, "any", *of))
        swap = unit(seed, "end", *of) < 0.5
        t = t.select(F.struct(*TRIPLE).alias("of"), "attempt", F.when(swap, F.col("any")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("tgt")).otherwise(F.col("any")).alias("tgt"), "year")
        return t.where("src != tgt").join(taken, TRIPLE, "left_anti")

    first = cut(tried(rows, 1, 1))
    rest = rows.join(first.select("of.*"), TRIPLE, "left_anti")
    later = tried(rest, 2, attempts).groupBy("of").agg(F.min_by(F.struct(*TRIPLE, "attempt"), "attempt").alias("x")).select("x.*")
    return first.select(*TRIPLE, "attempt").unionByName(later)


def blacklist(*sets: DataFrame) -> DataFrame:
    out = sets[0].select(*TRIPLE)
    for s in sets[1:]:
        out = out.unionByName(s.select(*TRIPLE))
    return out.distinct()


def bootstrap(triples: DataFrame, seed: int, n: int | None = None) -> DataFrame:
    """n draws with replacement (as many as there are, by default)."""
    rows = triples.withColumn("order", F.concat_ws("|", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in ("year", "src", "tgt")]))
    index = dense_index(rows, "order").drop("order")
    size = triples.count()
    draws = triples.sparkSession.range(n or size).select(F.col("id").alias("draw"), F.least(pick(max(size, 1), seed, F.col("id")), F.lit(max(size, 1) - 1)).alias("idx"))
    return draws.join(index, "idx").select("draw", *TRIPLE)


def poisson_bootstrap(triples: DataFrame, seed: int) -> DataFrame:
    """Each triple repeated by a Poisson(1) count: no index, no shuffle."""
    u = unit(seed, *map(F.col, TRIPLE))
    cut = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    n = sum(((u >= c).cast("int") for c in cut[1:]), (u >= cut[0]).cast("int"))
    return triples.withColumn("n", n).where("n > 0").select(*TRIPLE, F.explode(F.sequence(F.lit(1), F.col("n")))).select(*TRIPLE)


def placed_members(members: DataFrame) -> DataFrame:
    """industry, company_id, pos (from 0 by company), n_in; an industry of any
    size is placed range by range."""
    d = scan(members.select("industry", "company_id", F.lit(1).cast("long").alias("one")), ("industry",), [("company_id", False)], ["one"])
    return d.select("industry", "company_id", (F.col("upto_one") - 1).alias("pos"), F.col("all_one").alias("n_in"))


def paired_negatives(positives: DataFrame, ids: DataFrame, known: DataFrame, seed: int, members: DataFrame | None = None, attempts: int = 10, shares: tuple[float, float, float] = (0.2, 0.5, 0.7)) -> DataFrame:
    """src, tgt, year of every distinct positive with new_src, new_tgt, rule,
    attempt: its own negative, which is unknown and changes one end.

    With members, the end and the way go by shares as in industry_negatives:
    the first attempts replace it within the source's industry, and where all
    of them fail, or the source has none, as many more take any company. Without
    members, the target or the source, half and half, becomes any company.
    Positives for which every attempt fails are left out. Only those whose first
    attempt fails are tried further, all at once.
    """
    size = max(1, ids.count())
    index = dense_index(ids.select("company_id"), "company_id")
    rows = positives.select(*TRIPLE).distinct()
    u = unit(seed, "rule", *map(F.col, TRIPLE))
    near = lambda rule: F.col(rule).startswith("industry")
    if members is not None:
        first = members.groupBy("company_id").agg(F.min("industry").alias("industry"))
        rows = rows.join(first.withColumnRenamed("company_id", "src"), "src", "left")
        rule = F.when(u < shares[0], "industry_tgt").when(u < shares[1], "industry_src").when(u < shares[2], "random_tgt").otherwise("random_src")
        listed = placed_members(members)
        rows = rows.join(listed.groupBy("industry").agg(F.max("n_in").alias("n_in")), "industry", "left")
    else:
        rule, listed = F.when(u < 0.5, "random_tgt").otherwise("random_src"), None
    rows = cut(rows.withColumn("rule", rule))
    taken = known.select(*TRIPLE).distinct()

    def tried(some: DataFrame, low: int, high: int) -> DataFrame:
        t = some.withColumn("attempt", F.explode(F.sequence(F.lit(low), F.lit(high))))
        of = [F.col(c) for c in (*TRIPLE, "attempt")]
        t = _picked(t, index, size, "any", pick(size, seed, "any", *of))
        new = F.col("any")
        if listed is not None:
            inside = near("rule") & (F.col("attempt") <= attempts) & F.col("n_in").isNotNull()
            t = t.withColumn("pos", F.when(inside, F.least(pick(F.col("n_in"), seed, "near", *of), F.col("n_in") - 1)))
            t = t.join(listed.select("industry", "pos", F.col("company_id").alias("near")), ["industry", "pos"], "left")
            new = F.when(inside, F.col("near")).otherwise(F.when(~(near("rule") & (F.col("attempt") <= attempts)), F.col("any")))
        at_tgt = F.col("rule").endswith("tgt")
        t = t.withColumn("new", new).where(F.col("new").isNotNull() & (F.col("new") != F.when(at_tgt, F.col("tgt")).otherwise(F.col("src"))))
        t = t.select(F.struct(*TRIPLE).alias("of"), "rule", "attempt", F.when(at_tgt, F.col("src")).otherwise(F.col("new")).alias("src"), F.when(at_tgt, F.col("new")).otherwise(F.col("tgt")).alias("tgt"), "year")
        good = t.join(taken, TRIPLE, "left_anti")
        best = good.groupBy("of").agg(F.min_by(F.struct(F.col("src").alias("new_src"), F.col("tgt").alias("new_tgt"), "rule", "attempt"), "attempt").alias("x"))
        return best.select("of.*", "x.*")

    done = cut(tried(rows, 1, 1))
    rest = rows.join(done.select(*TRIPLE), TRIPLE, "left_anti")
    return done.unionByName(tried(rest, 2, 2 * attempts))


def loaders(nodes: DataFrame, edges: DataFrame, negatives: DataFrame, seed: int, external: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a training run needs, by name: graph (the positive training triples
    on the dense index of nodes), train, val and test (src, tgt, year, label), and full.

    negatives: negatives for all parts; each part gets as large a share of them
    as it has of the positives. external: triples that no part may have as
    negatives."""
    split = cut(stratified_split(edges, seed))
    pool = negatives.select(*TRIPLE).distinct()
    pool = pool if external is None else pool.join(external.select(*TRIPLE).distinct(), TRIPLE, "left_anti")
    counts = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(counts.values()))
    at = unit(seed, "part", *map(F.col, TRIPLE))
    edge = [counts.get("test", 0) / total, (counts.get("test", 0) + counts.get("val", 0)) / total]
    drawn = pool.withColumn("split", F.when(at < edge[0], "test").when(at < edge[1], "val").otherwise("train"))
    rows = cut(split.select(*TRIPLE, "split", F.lit(1).alias("label")).unionByName(drawn.select(*TRIPLE, "split", F.lit(0).alias("label"))))
    parts = {name: rows.where(F.col("split") == name).drop("split") for name in ("train", "val", "test")}
    return {"graph": static_graph(nodes, parts["train"].where("label = 1").drop("label")), **parts, "full": rows}


def industry_negatives(positives: DataFrame, members: DataFrame, ids: DataFrame, known: DataFrame, n: int, seed: int, shares: tuple[float, float, float] = (0.2, 0.5, 0.7)) -> DataFrame:
    """draw, src, tgt, year, rule: negatives near a random positive. Below
    shares[0] the target, below shares[1] the source becomes a company of the
    source's industry; below shares[2] the target, else the source becomes any
    company. Sources without industry fall to the random rules. Known triples
    and repeats (all but the first draw) drop out."""
    seeds = bootstrap(positives, seed, n)
    first = members.groupBy("company_id").agg(F.min("industry").alias("industry"))
    rows = seeds.join(first.withColumnRenamed("company_id", "src"), "src", "left")
    u = unit(seed, "rule", F.col("draw"))
    has = F.col("industry").isNotNull()
    rule = F.when(has & (u < shares[0]), "industry_tgt").when(has & (u < shares[1]), "industry_src").when(u < shares[2], "random_tgt").otherwise("random_src")
    rows = rows.withColumn("rule", rule)
    listed = placed_members(members)
    sizes = listed.groupBy("industry").agg(F.max("n_in").alias("n_in"))
    rows = rows.join(sizes, "industry", "left").withColumn("pos", F.when(F.col("rule").startswith("industry"), F.least(pick(F.col("n_in"), seed, "member", F.col("draw")), F.col("n_in") - 1)))
    rows = rows.join(listed.select("industry", "pos", F.col("company_id").alias("near")), ["industry", "pos"], "left")
    size = ids.count()
    index = dense_index(ids.select("company_id"), "company_id")
    rows = _picked(rows, index, max(size, 1), "any", pick(max(size, 1), seed, "any", F.col("draw")))
    new = F.when(F.col("rule").startswith("industry"), F.col("near")).otherwise(F.col("any"))
    rows = rows.select("draw", F.when(F.col("rule").endswith("src"), new).otherwise(F.col("src")).alias("src"), F.when(F.col("rule").endswith("tgt"), new).otherwise(F.col("tgt")).alias("tgt"), "year", "rule")
    rows = rows.join(known.select(*TRIPLE).distinct(), TRIPLE, "left_anti")
    first_draw = rows.groupBy(*TRIPLE).agg(F.min("draw").alias("draw"))
    return rows.join(first_draw, [*TRIPLE, "draw"]).select("draw", *TRIPLE, "rule")


def time_swaps(positives: DataFrame, weights: DataFrame, known: DataFrame, seed: int) -> DataFrame:
    """The same pair in another year, drawn by weight; unknown ones only."""
    w = weights.where("weight > 0").agg(F.array_sort(F.collect_list(F.struct("year", "weight"))).alias("ys"))
    rows = positives.distinct().join(F.broadcast(w), how="cross")  # one row
    others = F.filter("ys", lambda y: y["year"] != F.col("year"))
    rows = rows.withColumn("others", others).withColumn("total", F.aggregate("others", F.lit(0.0), lambda s, y: s + y["weight"]))
    at = unit(seed, *map(F.col, TRIPLE)) * F.col("total")
    upto = F.transform("others", lambda y: F.struct(y["year"].alias("year"), F.aggregate(F.filter("others", lambda z: z["year"] <= y["year"]), F.lit(0.0), lambda s, z: s + z["weight"]).alias("c")))
    rows = rows.withColumn("at", at).withColumn("upto", upto)
    new = F.coalesce(F.get(F.filter("upto", lambda y: y["c"] > F.col("at")), F.lit(0))["year"], F.element_at("others", -1)["year"])
    rows = rows.where(F.size("others") > 0).select("src", "tgt", new.alias("year"))
    return rows.distinct().join(known.select(*TRIPLE).distinct(), TRIPLE, "left_anti")


def labelled(positives: DataFrame, dynamic: DataFrame, predefined: DataFrame | None = None, cap: int | None = None, negatives_only: bool = False) -> DataFrame:
    """src, tgt, year, label, kind: positives, then both kinds of negatives."""
    parts = [] if negatives_only else [(positives, 1, "positive")]
    parts += [(dynamic, 0, "dynamic")] + ([(predefined, 0, "predefined")] if predefined is not None else [])
    out = None
    for rows, label, kind in parts:
        rows = rows.select(*TRIPLE, F.lit(label).alias("label"), F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out if cap is None else out.limit(cap)


def subsample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The n rows with the smallest hashes."""
    return _first_by_hash(rows, n, seed)


def hash_split(rows: DataFrame, share: float, seed: int, out: str = "part") -> DataFrame:
    """A random split by share, without counting."""
    return rows.withColumn(out, F.when(unit(seed, *map(F.col, TRIPLE)) < share, "train").otherwise("test"))


def drop_edges(rows: DataFrame, share: float, seed: int, epoch: int = 0) -> DataFrame:
    """Edge dropout: keeps each edge with probability 1 - share."""
    return rows.where(unit(seed, epoch, *map(F.col, TRIPLE)) >= share)


#: Whether external edges are kept out of negatives, and whether negatives are
#: drawn near industries, by mode.
MODES = {"ftt": (False, True), "ftf": (True, True), "fff": (False, False), "tff": (True, False)}


def mode_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in sorted(MODES.items())], "mode string, filter_external boolean, intra_industry boolean")
