"""Running sums over sorted rows, without a window that one task has to take.

Rows are range-partitioned by group and order and written; a window runs within
each range, and the ranges' totals, one row for each range and group, give what
comes before a range. So a group of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.lineage import cut


def scan(rows: DataFrame, by: Sequence[str], order: Sequence[tuple[str, bool]], sums: Sequence[str], ahead: Sequence[str] = ()) -> DataFrame:
    """rows with upto_<c>, the sum of c up to and with the row, all_<c>, its sum
    over the group, and next_<c> of the row that follows (null after the last).

    order: (column, descending) of numbers without nulls that tell the rows of
    a group apart; sums and ahead: names of columns.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    dealt = cut(rows.repartitionByRange(parts, *by, *sort).withColumn("_range", F.spark_partition_id()))
    local = Window.partitionBy(*by, "_range").orderBy(*sort)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct(*[(-F.col(c) if down else F.col(c)).alias(c) for c, down in order])
    first = F.min_by(F.struct(*[F.col(c) for c in ahead]), key) if ahead else F.lit(None)
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums], first.alias("_first"))
    # one row for each range, in its group
    ranges = _ranges(totals, by, sums, bool(ahead))
    out = dealt.select("*", *[F.sum(c).over(upto).alias(f"_u_{c}") for c in sums], *([F.lead(F.struct(*ahead)).over(local).alias("_lead")] if ahead else []))
    out = out.join(ranges, [*by, "_range"])
    following = F.coalesce("_lead", "_following") if ahead else None
    return out.select(*rows.columns, *[(F.col(f"_u_{c}") + F.col(f"_b_{c}")).alias(f"upto_{c}") for c in sums], *[F.col(f"_a_{c}").alias(f"all_{c}") for c in sums], *[following[c].alias(f"next_{c}") for c in ahead])


def _ranges(totals: DataFrame, by: Sequence[str], sums: Sequence[str], ahead: bool) -> DataFrame:
    """by, _range, _b_<c> before the range, _a_<c> of the group, _following."""
    if not by:
        # as many rows as there are ranges: added up on the driver
        found = sorted(totals.collect(), key=lambda r: r["_range"])
        kinds = {f.name: f.dataType.simpleString() for f in totals.schema}
        zero = {c: 0.0 if kinds[f"_t_{c}"] == "double" else 0 for c in sums}
        run, lines = dict(zero), []
        whole = {c: sum((r[f"_t_{c}"] for r in found if r[f"_t_{c}"] is not None), zero[c]) for c in sums}
        for i, r in enumerate(found):
            follow = found[i + 1]["_first"] if ahead and i + 1 < len(found) else None
            lines.append((r["_range"], *[run[c] for c in sums], *[whole[c] for c in sums], follow))
            run = {c: run[c] + (zero[c] if r[f"_t_{c}"] is None else r[f"_t_{c}"]) for c in sums}
        shape = ", ".join(["_range int", *[f"_b_{c} {kinds[f'_t_{c}']}" for c in sums], *[f"_a_{c} {kinds[f'_t_{c}']}" for c in sums], f"_following {kinds['_first'] if ahead else 'int'}"])
        return totals.sparkSession.createDataFrame(lines, shape)
    order = Window.partitionBy(*by).orderBy("_range")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return totals.select(*by, "_range", *[zero(F.sum(f"_t_{c}").over(before)).alias(f"_b_{c}") for c in sums], *[F.sum(f"_t_{c}").over(whole).alias(f"_a_{c}") for c in sums], F.lead("_first").over(order).alias("_following"))
