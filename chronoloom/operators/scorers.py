"""One interface for all models: ``score(pairs)`` gives pairs a probability.

pairs: src, tgt, pos (the position of the year). Pairs that a model cannot see
(a node or a year that it has not encoded) drop out.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.lineage import Workspace, cut
from chronoloom.operators import encoders as N
from chronoloom.operators import graph as G


class Scorer(Protocol):
    name: str

    def score(self, pairs: DataFrame) -> DataFrame:
        """src, tgt, pos, prob."""
        ...


class StateScorer:
    """A predictor on encoded nodes (node, zs: a vector for each year)."""

    def __init__(self, name: str, states: DataFrame, predictor: N.Weights, n_years: int):
        self.name, self.states, self.predictor, self.n_years = name, states, predictor, n_years

    def score(self, pairs: DataFrame) -> DataFrame:
        rows = N.gather_states(pairs.select("src", "tgt", "pos").distinct(), self.states, self.n_years)
        return N.predict(rows, [self.predictor]).drop("model_id")


class SubgraphScorer:
    """Twin encoders on the subgraph around each pair, seen from its year."""

    def __init__(self, name: str, edges: DataFrame, features: DataFrame, weights: N.Weights, years: list[int], hops: int = 2):
        self.name, self.edges, self.features, self.weights, self.years, self.hops = name, edges, features, weights, years, hops

    def score(self, pairs: DataFrame) -> DataFrame:
        year = F.get(F.array(*[F.lit(y) for y in self.years]), F.col("pos"))
        rows = pairs.select("src", "tgt", "pos").distinct().where((F.col("pos") >= 0) & (F.col("pos") < len(self.years)))
        rows = rows.withColumns({"pair_id": F.xxhash64("src", "tgt", "pos"), "a": F.col("src"), "b": F.col("tgt"), "at": F.col("pos") / F.lit(float(len(self.years))), "at_year": year})
        with Workspace(pairs.sparkSession) as tables:  # only the scores outlive it
            rows, keep = tables.keep(rows), tables.keep
            # all years of a pair share one subgraph
            ends = rows.select(F.xxhash64("a", "b").alias("pair_id"), "a", "b").distinct()
            members = keep(G.k_hop(ends, self.edges, self.hops, undirected=False, keep=keep))
            sub = keep(G.induced(members, self.edges, keep=keep))
            labels = keep(G.role_labels(ends, members, sub, keep=keep))
            tables.drop(members)
            own = rows.select("pair_id", "at_year", F.xxhash64("a", "b").alias("ends"))
            of = lambda d: d.withColumnRenamed("pair_id", "ends").join(own, "ends").drop("ends")
            found = N.subgraph_scores(rows, G.weighted_by_time(of(sub)), of(labels).drop("at_year"), self.features, self.weights)
            return cut(keep(rows.join(found, "pair_id").select("src", "tgt", "pos", "prob")))


def score_all(scorers: list[Scorer], pairs: DataFrame) -> DataFrame:
    """model, src, tgt, pos, prob of every scorer."""
    out = None
    for s in scorers:
        rows = s.score(pairs).select(F.lit(s.name).alias("model"), "src", "tgt", "pos", "prob")
        out = rows if out is None else out.unionByName(rows)
    return out
