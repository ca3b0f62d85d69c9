"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: sources take their weights' shares of the budget; a source whose
   share would pass its cap stays at the cap and the excess goes to the others
   by weight (water filling, solved in one pass over sources sorted by cap
   per weight).
2. Schedule: slot i has the van der Corput point of i in base 2. Cumulative
   target shares cut [0, 1) into one interval for each source, and the point's
   interval names the slot's source.
3. Ranks: the number of earlier slots of the same source. Counts of van der
   Corput points in an interval have a closed form over the bits of i, so no
   window over a source's slots is needed and a hot source is no hot group.
4. Blocks: a source's documents in hashed order, laid end to end, are cut into
   blocks of equal numbers of words, as many words as the target has for each of
   the source's slots. The slot of rank r takes block r mod (number of blocks);
   r div (number of blocks) is the epoch, and slots beyond the target or the
   allowed epochs take nothing.

Only DataFrame expressions are used. There are about as many slots as words, and
at most 2 ** SLOT_BITS or SOURCE_SLOTS for each source. Every source that is to
take words gets an interval of LEAST_SLOTS slots or more, however small its
share, so that its words come near its target at every size of the input.
Sources are one row each; they, not documents, are ranked in one window.

Defined cases: null text has size 0; a null source comes last and is a source
of its own; sources and documents of size 0 take nothing; repeated rows are
documents of their own; an empty table gives an empty result; equal hashes are
ordered by id and size. The same input gives the same mix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import word_count, written

#: Resolution of interval bounds and van der Corput points.
POINT_BITS = 40
SLOT_BITS = 21
SOURCE_SLOTS = 1024
LEAST_SLOTS = 256
#: Documents in a bucket of a source's hashed order, about, and least number of
#: buckets; prefix sums go over buckets first.
BUCKET_DOCS, LEAST_BUCKETS = 50_000, 2048
_CELL_BITS = 10


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))


def targets(sizes: DataFrame, weights: list[int], budget_share: float, cap_times: int) -> DataFrame:
    """source, rank, source_size, n_docs, weight, cap, target, budget (their sum)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    per = per.withColumn("rank", rank).withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(cap_times)))
    per = per.withColumn("budget", F.sum("source_size").over(every) * F.lit(budget_share))
    # sources below the level at which the rest of the budget is shared are capped
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(by), F.lit(0.0))).withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by), F.lit(0.0)))
    per = per.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("left"))
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("at")))).over(every)["at"])
    per = per.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))))
    return per.withColumn("budget", F.sum("target").over(every)).select("source", "rank", "source_size", "n_docs", "weight", "cap", "target", "budget")


def intervals(plan: DataFrame, slots: int) -> DataFrame:
    """plan with low and high (bounds of a source's points), block (words), the
    number of blocks and how many of the source's slots take words."""
    every, upto = Window.partitionBy(), Window.orderBy("rank")
    share = F.when(F.col("target") > 0, F.greatest(F.col("target") / F.col("budget"), F.lit(LEAST_SLOTS / slots))).otherwise(0.0)
    plan = plan.withColumn("share", share)
    point = lambda w: F.coalesce(F.least(F.round(F.try_divide(F.coalesce(F.sum("share").over(w), F.lit(0.0)), F.sum("share").over(every)) * float(1 << POINT_BITS)).cast("long"), F.lit(1 << POINT_BITS)), F.lit(0).cast("long"))
    last = F.col("rank") == F.count("*").over(every)
    high = F.when(last & (F.col("budget") > 0), F.lit(1 << POINT_BITS)).otherwise(point(upto.rowsBetween(Window.unboundedPreceding, 0)))
    plan = plan.withColumn("low", point(upto.rowsBetween(Window.unboundedPreceding, -1))).withColumn("high", high)
    bits, i = slots.bit_length(), F.lit(slots).cast("long")
    own = points_below(i, van_der_corput(i), F.col("high"), bits) - points_below(i, van_der_corput(i), F.col("low"), bits)
    plan = plan.withColumn("own", own).withColumn("block", F.greatest(F.coalesce(F.ceil(F.try_divide("target", "own")), F.lit(1)), F.lit(1)).cast("long"))
    plan = plan.withColumn("used", F.least("own", F.round(F.col("target") / F.col("block")).cast("long")))
    return plan.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block"))).drop("share", "own")


def van_der_corput(i: Column) -> Column:
    """Bits of i (below 2 ** POINT_BITS) in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(i), POINT_BITS, "0")), 2, 10).cast("long")


def points_below(i: Column, rev: Column, bound: Column, bits: int = SLOT_BITS) -> Column:
    """How many of the first i points lie below bound: for each set bit k of i
    the 2**k indices that share i's higher bits hold points rev' + j * 2**-k."""
    terms = []
    for k in range(bits + 1):
        step = POINT_BITS - k
        offset = rev.bitwiseAND(F.lit((1 << (step - 1)) - 1))
        n = F.least(F.greatest(F.shiftright(bound - offset + F.lit((1 << step) - 1), step), F.lit(0).cast("long")), F.lit(1 << k).cast("long"))
        terms.append(F.when(F.shiftright(i, k).bitwiseAND(F.lit(1).cast("long")) == 1, n).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a + b, terms)


def schedule(spark, plan: DataFrame, slots: int) -> DataFrame:
    """slot, point, source rank, and the slot's rank among its source's slots."""
    cell = POINT_BITS - _CELL_BITS
    ranges = plan.where("high > low").select("rank", "low", "high", F.explode(F.sequence(F.shiftright("low", cell), F.shiftright(F.col("high") - 1, cell))).alias("cell"))
    rows = spark.range(slots).withColumn("point", van_der_corput(F.col("id"))).withColumn("cell", F.shiftright("point", cell))
    rows = rows.join(ranges, "cell").where("point >= low and point < high")
    bits = max(1, slots.bit_length())
    rank = points_below(F.col("id"), F.col("point"), F.col("high"), bits) - points_below(F.col("id"), F.col("point"), F.col("low"), bits)
    return rows.select(F.col("id").alias("slot"), "point", "rank", rank.alias("slot_rank"))


def laid_out(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Documents with their place: offset of the first word in the source's
    hashed order. Sums over buckets of the order come first, so that no window
    holds a whole source."""
    buckets = max(LEAST_BUCKETS, (plan.agg(F.max("n_docs")).first()[0] or 0) // BUCKET_DOCS)
    ranked = sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    ranked = ranked.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    # one wide key: source and bucket
    key = F.struct(F.coalesce("source", F.lit("")), F.col("source").isNull(), "bucket")
    sums = sums.select(key.alias("k"), "base")
    w = Window.partitionBy("k").orderBy("h", "doc_id", "size")
    inside = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = ranked.withColumn("k", key).withColumn("inside", inside).withColumn("n_in", F.row_number().over(w)).join(sums, "k")
    small = plan.select(F.struct(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("s"), "rank", "source_size", "target", "block")
    rows = rows.withColumn("s", F.struct(F.coalesce("source", F.lit("")), F.col("source").isNull())).join(small, "s")
    return rows.select("doc_id", "size", "rank", "source_size", "target", "block", "bucket", "n_in", (F.col("base") + F.col("inside")).alias("start"))


def mix(docs: DataFrame, weights: list[int] = [3, 1, 2], budget_share: float = 1.5, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:  # noqa: B006
    """doc_id, size, source_size, target, taken for each row of docs."""
    spark = docs.sparkSession
    sizes = written(sized(docs, id_col, text_col, source_col), "mix-sizes")
    plan = written(targets(sizes, weights, budget_share, max_epochs), "mix-plan")
    budget, sources = plan.agg(F.coalesce(F.max("budget"), F.lit(0.0)), F.count("*")).first()
    least = SOURCE_SLOTS * max(1, sources)
    slots = min(max(int(budget), least), max(1 << SLOT_BITS, least))
    plan = written(intervals(plan, slots), "mix-intervals")
    ranked = schedule(spark, plan, slots).join(plan.select("rank", "n_blocks", "used"), "rank").where((F.col("slot_rank") < F.col("n_blocks") * max_epochs) & (F.col("slot_rank") < F.col("used")))
    uses = ranked.groupBy("rank", F.pmod("slot_rank", "n_blocks").alias("number")).agg(F.count("*").alias("uses"))
    placed = laid_out(sizes, plan, seed)
    place = F.struct("rank", "bucket", "n_in")
    some = placed.where("size > 0").select(place.alias("place"), "rank", "start", "size", "block", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block")))).alias("number"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("number") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("number") * F.col("block"))
    taken = some.join(uses, ["rank", "number"]).groupBy("place").agg(F.sum(overlap * F.col("uses")).alias("taken"))
    rows = placed.withColumn("place", place).join(taken, "place", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
