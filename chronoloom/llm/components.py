"""Connected components of a link table, without gathering any of it.

Each round hooks every label to its smallest neighbour, shortens the parent
chains by pointer jumping, and contracts the links to the new labels, so that
the table shrinks from round to round. Minima are aggregated with a map-side
step; a label with very many links is split by the joins' skew handling.
Rounds are written tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import passing, written


def _shortened(parent: DataFrame) -> DataFrame:
    """parent(x, p) with p < x: point every x at the root of its chain."""
    while True:
        up = parent.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        step = written(parent.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "jump")
        parent = step.select("x", "p")
        if step.where("moved").isEmpty():
            return parent


def relabelled(rows: DataFrame, col: str, labels: DataFrame) -> DataFrame:
    """rows with col replaced by its label, where it has one."""
    to = labels.select(F.col("node").alias(col), F.col("comp").alias("_comp"))
    return rows.join(to, col, "left").withColumn(col, F.coalesce("_comp", col)).drop("_comp")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp (smallest node reachable) for each node that has a link to
    another node. Links with a null end or equal ends are no links."""
    edges = links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where((F.col(a) != F.col(b))).distinct()
    edges, labels = written(edges, "links"), None
    while not edges.isEmpty():
        with passing() as kept:
            parent = _shortened(written(edges.groupBy("x").agg(F.min("y").alias("p")), "hook"))
            step = parent.select(F.col("x").alias("node"), F.col("p").alias("comp"))
            if labels is None:
                # a node that is nobody's larger end is its own label for now
                labels = step
            else:
                old = labels.select("node", F.col("comp").alias("mid"))
                moved = old.join(step.select(F.col("node").alias("mid"), "comp"), "mid", "left").select("node", F.coalesce("comp", "mid").alias("comp"))
                labels = moved.unionByName(step.join(labels.select("node"), "node", "left_anti"))
            labels = written(labels, "labels")
            edges = relabelled(relabelled(edges, "x", step), "y", step).where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
            edges = written(edges, "links")
            kept += [labels, edges]
    if labels is None:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("comp"))
    roots = labels.select(F.col("comp").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return labels.unionByName(roots)
