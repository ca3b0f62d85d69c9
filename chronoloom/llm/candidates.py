"""From shared signatures to components of verified links, without all pairs.

Rows that share a signature are candidates. In each of the first rounds only
neighbours in a signature's order that are not known to be connected are
verified, so a group of n similar rows costs about n verifications, and
signatures whose rows are all connected drop out. The last round verifies
every pair that still shares a signature without being connected, so that no
link is lost; a cheap necessary condition inside that join (sizes, sketches)
keeps pairs that cannot link from being made at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import passing, written
from chronoloom.llm.components import components, relabelled


#: Rows of one signature that are put in order together, and that meet as many
#: others in one task when all pairs are taken.
SPAN, RUN = 20_000, 2_000


def shared_by_two(rows: DataFrame) -> DataFrame:
    """Distinct rows (sig, id) whose signature another id shares. Signatures
    are found by an aggregation with a map-side step, so none is a hot group."""
    met = rows.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("sig")
    return rows.join(written(met, "met"), "sig").distinct()


def neighbours(rows: DataFrame, order: list[str], keep: list[str], crowded: bool) -> DataFrame:
    """Each row beside the row before it in its signature's order: keep, and
    the same columns with the prefix p_. rows: sig, rows_of_sig and id. Where a
    signature is crowded, with more than SPAN rows, it is dealt into runs, and
    the first rows of its runs are put in order among themselves."""
    order = [c for c in order if c not in keep]

    def beside(part: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order, "id")
        return part.select("sig", *order, *keep, *[F.lag(c).over(w).alias(f"p_{c}") for c in keep])

    if not crowded:
        return beside(rows, "sig").where("p_id is not null")
    near = written(beside(rows.withColumn("_run", F.pmod(F.xxhash64("id"), F.ceil(F.col("rows_of_sig") / SPAN))), "sig", "_run"), "neighbours")
    heads = beside(near.where("p_id is null").select("sig", *order, *keep), "sig")
    return near.unionByName(heads).where("p_id is not null")


def _dealt(rows: DataFrame, run: str, meets: str) -> DataFrame:
    """rows with the run of each, copied for every run of the signature: every
    two runs of a crowded signature meet in a group of their own."""
    runs = F.ceil(F.col("rows_of_sig") / RUN)
    return rows.select("sig", "id", "comp", F.pmod(F.xxhash64("id"), runs).alias(run), F.explode(F.sequence(F.lit(0).cast("long"), runs - 1)).alias(meets))


def connect(
    shared: DataFrame,
    nodes: DataFrame,
    orders: list[list[str]],
    may_link: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    verify: Callable[[DataFrame], DataFrame],
    inline: bool = False,
    at_last: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    only_last: tuple[str, ...] = (),
) -> DataFrame:
    """Labels (node, comp) of the components of all links.

    shared: sig, id; nodes: one row for each id, with the columns that orders
    and may_link use; orders: by which columns a round sorts a signature's
    rows; may_link(x, y) is a cheap condition that every link meets, x and y
    giving the columns of either side; verify(pairs a, b): a, b, linked;
    inline: the nodes' columns are few enough to travel with every row, so that
    neighbours are tested before they become pairs. The last round takes every
    pair that is left, which grows with the square of a signature's rows that
    stay apart; it is spread over tasks by runs. at_last(x, y): a dearer
    condition that every link meets too, tested inside the join of the last
    round, so that pairs that fail it are never made into rows; only_last: the
    nodes' columns that it alone uses.
    """
    links, labels, checked = None, None, None
    nodes = written(nodes.join(shared.select("id").distinct(), "id", "left_semi"), "shared-nodes")
    travel = [c for c in nodes.columns if c not in only_last]
    sides = lambda a, b, test=may_link: test(lambda c: F.col(f"{a}.{c}"), lambda c: F.col(f"{b}.{c}"))
    for step, order in enumerate([*orders, None]):
        with passing() as kept:
            rows = shared.withColumn("comp", F.col("id"))
            rows = rows if labels is None else written(relabelled(rows, "comp", labels), "labelled")
            # a signature whose rows are all connected is done
            left = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows_of_sig"))
            left = written(left.where("lo != hi").select("sig", "rows_of_sig"), "open-signatures")
            crowded = not left.where(F.col("rows_of_sig") > SPAN).isEmpty()
            rows = written(rows.join(left, "sig"), "open")
            shared = rows.select("sig", "id")
            kept.append(shared)
            if order and inline:
                both = rows.join(nodes.select("id", F.struct(*travel).alias("y")), "id").select("*", *[F.col(f"y.{c}").alias(f"o_{c}") for c in order])
                both = neighbours(both, [f"o_{c}" for c in order], ["id", "comp", "y"], crowded).where("p_comp != comp").where(sides("p_y", "y"))
                pairs = both.groupBy(F.least("p_id", "id").alias("a"), F.greatest("p_id", "id").alias("b")).agg(F.count("*").alias("shared"))
            elif order is not None:
                near = neighbours(rows.join(nodes.select("id", *order), "id"), order, ["id", "comp"], crowded).where("p_comp != comp")
                pairs = near.groupBy(F.least("p_id", "id").alias("a"), F.greatest("p_id", "id").alias("b")).agg(F.count("*").alias("shared"))
                pairs = pairs.alias("p").join(nodes.alias("x"), F.col("p.a") == F.col("x.id")).join(nodes.alias("y"), F.col("p.b") == F.col("y.id")).where(sides("x", "y")).select("p.*")
            if order is not None:
                if not step:  # of a row's neighbours the one that it shares most with
                    pairs = pairs.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
            else:
                x, y = (_dealt(rows, run, meets).join(nodes, "id").alias(side) for side, run, meets in (("x", "rx", "ry"), ("y", "ry", "rx")))
                same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("sig", "rx", "ry")]
                fits = sides("x", "y") if at_last is None else sides("x", "y") & sides("x", "y", at_last)
                pairs = x.join(y, same[0] & same[1] & same[2] & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp")) & fits)
                pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
            pairs = pairs.select("a", "b")
            if checked is not None:
                pairs = pairs.join(checked, ["a", "b"], "left_anti")
            pairs = written(pairs, "pairs")
            if pairs.isEmpty():
                continue
            done = written(verify(pairs), "verified")
            kept.append(done)
            checked = done.select("a", "b") if checked is None else checked.unionByName(done.select("a", "b"))
            found = done.where("linked").select("a", "b")
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                labels = written(components(links), "labels")
                kept.append(labels)
    return shared.sparkSession.createDataFrame([], "node long, comp long") if labels is None else labels
