"""Degrees, adjacency, message passing and enclosing subgraphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.lineage import cut
from chronoloom.functions.scalars import dot, inverse_sqrt, norm, temporal_weight
from chronoloom.functions.vectors import map_batches, summed, width_of
from chronoloom.operators.edges import degrees


def out_degrees(edges: DataFrame) -> DataFrame:
    """year, src, degree with multiplicity."""
    return edges.groupBy("year", "src").agg(F.count("*").alias("degree"))


def degree_summary(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.avg("degree").alias("mean"), F.percentile("degree", F.lit(0.5)).alias("median"), F.max("degree").alias("max"), F.count("*").alias("n_nodes"))


def adjacency(edges: DataFrame) -> DataFrame:
    """year, src, tgt, weight: d(src)^-1/2 d(tgt)^-1/2 by out-degrees of the
    year, repeated edges added up; an edge into a node without out-edges gets 0."""
    n = edges.groupBy("year", "src", "tgt").agg(F.count("*").alias("n"))
    d = out_degrees(edges)
    rows = n.join(d.withColumnRenamed("degree", "ds"), ["year", "src"]).join(d.select("year", F.col("src").alias("tgt"), F.col("degree").alias("dt")), ["year", "tgt"], "left")
    w = F.col("n") * inverse_sqrt(F.col("ds")) * inverse_sqrt(F.coalesce("dt", F.lit(0)))
    return rows.select("year", "src", "tgt", w.alias("weight"))


def looped_adjacency(edges: DataFrame) -> DataFrame:
    """year, src, tgt, weight of the standard normalisation: a self loop for
    each node of the year, degrees counted at the target."""
    n = edges.groupBy("year", "src", "tgt").agg(F.count("*").alias("n"))
    ends = edges.select("year", F.explode(F.array("src", "tgt")).alias("node")).distinct()
    rows = n.unionByName(ends.select("year", F.col("node").alias("src"), F.col("node").alias("tgt"), F.lit(1).cast("long").alias("n")))
    rows = rows.groupBy("year", "src", "tgt").agg(F.sum("n").alias("n"))
    d = rows.groupBy("year", F.col("tgt").alias("node")).agg(F.sum("n").alias("d"))
    rows = rows.join(d.select("year", F.col("node").alias("src"), F.col("d").alias("ds")), ["year", "src"]).join(d.select("year", F.col("node").alias("tgt"), F.col("d").alias("dt")), ["year", "tgt"])
    return rows.select("year", "src", "tgt", (F.col("n") * inverse_sqrt(F.col("ds")) * inverse_sqrt(F.col("dt"))).alias("weight"))


def propagate(adj: DataFrame, features: DataFrame, to_src: bool = True, width: int | None = None) -> DataFrame:
    """year, node, x: weighted sums of neighbours' vectors. to_src: a source
    receives from its targets; else the other way. features: node, x, and year
    where vectors differ by year; width: their length, if it is known.

    Components are summed as columns, combined on the map side.
    """
    me, other = ("src", "tgt") if to_src else ("tgt", "src")
    on = [c for c in ("year", "node") if c in features.columns]
    sides = features.select(*[F.col(c).alias(other if c == "node" else c) for c in on], "x")
    rows = adj.where("weight != 0").join(sides, [other if c == "node" else c for c in on])
    return summed(rows.withColumn("node", F.col(me)), ["year", "node"], F.col("weight"), "x", width or width_of(features))


#: Neighbours in one piece of a node's list, and frontier rows of one node and
#: piece that go to one task.
PIECE, SHARE = 1_024, 4_096
#: Nodes around an end that travel as one row.
NEAR = 4_096


def neighbour_pieces(step: DataFrame, piece: int = PIECE) -> DataFrame:
    """node, pieces, piece, nexts: each node's neighbours packed into lists of
    about that many, a hub's into several, dealt by hash."""
    sizes = step.groupBy("node").agg(F.ceil(F.count("*") / piece).alias("pieces"))
    dealt = step.join(sizes, "node").withColumn("piece", F.pmod(F.xxhash64("next"), F.col("pieces")))
    return dealt.groupBy("node", "pieces", "piece").agg(F.collect_list("next").alias("nexts"))


def expand(front: DataFrame, pieces: DataFrame, keys: list[str], share: int = SHARE, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """keys, next: the neighbours of every frontier row (keys, node).

    A frontier row meets each piece of its node on its own, and where a node is
    in very many rows, its pieces are copied and the rows dealt among the
    copies. So neither a hub nor a node that everybody is near to comes to one
    task; only the counts of nodes travel to say how much there is to split.
    """
    asked = front.groupBy("node").agg(F.ceil(F.count("*") / share).alias("copies"))
    counts = keep(pieces.select("node", "pieces").distinct().join(asked, "node").where("pieces > 1 or copies > 1"))  # only what is split
    split = front.join(counts, "node", "left").withColumns({"piece": F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1)), "copy": F.pmod(F.xxhash64(*keys), F.coalesce("copies", F.lit(1)))})
    parts = pieces.select("node", "piece", "nexts").join(counts.select("node", "copies"), "node", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)))
    both = split.select(*keys, "node", "piece", "copy").join(parts.select("node", "piece", "copy", "nexts"), ["node", "piece", "copy"])
    return both.select(*keys, F.explode("nexts").alias("next"))


def _frontiers(pairs: DataFrame, pieces: DataFrame, k: int, share: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pair_id, node, hop of pairs whose frontiers advance together."""
    seen = keep(pairs.select("pair_id", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("hop", F.lit(0)))
    front = seen.select("pair_id", "node")
    for hop in range(1, k + 1):
        front = keep(expand(front, pieces, ["pair_id"], share, keep).distinct().withColumnRenamed("next", "node").join(seen, ["pair_id", "node"], "left_anti"))
        seen = seen.unionByName(front.withColumn("hop", F.lit(hop)))
    return seen


def _beside(pairs: DataFrame, lists: DataFrame, copies: DataFrame | None) -> DataFrame:
    """pairs with the lists of both ends: columns a_* and b_* for those of lists
    (node, *). copies: nodes in very many pairs, whose lists are copied and whose
    pairs are dealt among the copies."""
    rows, on, n, names = pairs, ["node"], F.coalesce("copies", F.lit(1)), [c for c in lists.columns if c != "node"]
    if copies is not None:
        lists, on = lists.join(copies, "node", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("copies"), ["node", "copy"]
    for end in ("a", "b"):
        rows = rows.withColumn("node", F.col(end))
        if copies is not None:
            rows = rows.join(copies, "node", "left").withColumn("copy", F.pmod(F.xxhash64("pair_id"), n)).drop("copies")
        # few bytes that lists make long: adaptive execution would take too many of them together
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
        rows = rows.join(lists, on, "left").drop(*on).withColumnsRenamed({c: f"{end}_{c}" for c in names})
    return rows


def _near_both(pairs: DataFrame, lists: DataFrame, copies: DataFrame | None, k: int) -> DataFrame:
    """pair_id, node, hop from the lists (node, h1 to hk) of both ends, merged
    within the pair's row."""
    rows = _beside(pairs, lists, copies)
    none = F.array().cast("array<long>")
    found: list[Column] = [F.array_distinct(F.array("a", "b"))]
    for i in range(1, k + 1):
        new = F.array_union(F.coalesce(f"a_h{i}", none), F.coalesce(f"b_h{i}", none))
        rows = rows.withColumn(f"n{i}", F.array_except(new, F.flatten(F.array(*found))))
        found.append(F.col(f"n{i}"))
    by_hop = F.array(*[F.struct(F.lit(i).alias("hop"), c.alias("nodes")) for i, c in enumerate(found)])
    rows = rows.select("pair_id", F.explode(by_hop).alias("m")).select("pair_id", F.col("m.hop").alias("hop"), F.explode("m.nodes").alias("node"))
    return rows.select("pair_id", "node", "hop")


def _ends(pairs: DataFrame, one: DataFrame, k: int, near: int, share: int) -> DataFrame:
    """node, copies, far: the distinct ends, and whether more than ``near`` walks
    of up to k steps leave them."""
    walks = one.groupBy("node").agg(F.count("*").alias("walks"))
    for _ in range(1, k):
        onward = one.join(walks.withColumnRenamed("node", "next"), "next", "left")
        walks = onward.groupBy("node").agg(F.sum(1 + F.coalesce("walks", F.lit(0))).alias("walks"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.ceil(F.count("*") / share).alias("copies")).join(walks, "node", "left")
    return ends.select("node", "copies", (F.coalesce("walks", F.lit(0)) > near).alias("far"))


def _light(ends: DataFrame) -> DataFrame:
    return ends.where("not far").select(F.col("node").alias("pair_id"), F.col("node").alias("a"), F.col("node").alias("b"))


def _with_end(pairs: DataFrame, far: DataFrame) -> DataFrame:
    """The distinct pairs that have one of the nodes as an end."""
    wide = pairs.join(far.withColumnRenamed("node", "a"), "a", "left_semi").unionByName(pairs.join(far.withColumnRenamed("node", "b"), "b", "left_semi"))
    return wide.select(*pairs.columns).distinct()


def k_hop(pairs: DataFrame, edges: DataFrame, k: int = 2, undirected: bool = True, piece: int = PIECE, share: int = SHARE, near: int = NEAR, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """pair_id, node, hop: nodes within k steps of either end of each pair
    (pair_id, which tells pairs apart, a, b).

    What is near an end is found once for each distinct end, not for each pair,
    and goes to the end's pairs as lists, so that members are never shuffled.
    Pairs with an end that more than ``near`` walks leave go by frontiers
    instead, hubs in pieces. keep: stores the tables of the steps.
    """
    one = edges.select(F.col("tgt").alias("node"), F.col("src").alias("next"))
    if undirected:
        one = one.unionByName(edges.select(F.col("src").alias("node"), F.col("tgt").alias("next")))
    one = keep(one.distinct())
    pieces, pairs = keep(neighbour_pieces(one, piece)), keep(pairs.select("pair_id", "a", "b").distinct())
    ends = keep(_ends(pairs, one, k, near, share))
    lists = _frontiers(_light(ends), pieces, k, share, keep).where("hop > 0").groupBy(F.col("pair_id").alias("node"))
    lists = lists.agg(*[F.collect_list(F.when(F.col("hop") == i, F.col("node"))).alias(f"h{i}") for i in range(1, k + 1)])
    copies, far = ends.where("copies > 1 and not far").select("node", "copies"), ends.where("far").select("node")
    copies = None if copies.isEmpty() else copies
    if far.isEmpty():
        return _near_both(pairs, lists, copies, k)
    wide = keep(_with_end(pairs, far))
    rest = pairs.join(wide.select("pair_id"), "pair_id", "left_anti")
    return _near_both(rest, lists, copies, k).unionByName(_frontiers(wide, pieces, k, share, keep))


def around(pairs: DataFrame, edges: DataFrame, k: int = 2, year: int | None = None, features: DataFrame | None = None, near: int = NEAR, piece: int = PIECE, share: int = SHARE, keep: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, DataFrame | None]:
    """The pairs (pair_id, a, b and more) beside what is within k incoming steps
    of each end, and the pairs that are left because more than ``near`` walks of
    k + 1 steps lead to one of their ends (None: no pair is left).

    a_nodes, b_nodes: (id, x), x from features (node, x); a_links, b_links: (src,
    tgt, n, w), the distinct links into those nodes with their edges and the sum
    of their time weights, seen from the year. The edges of the pair's subgraph
    are those links of both ends that start in one of its nodes. Lists are made
    once for each distinct end; what a pair has is not shuffled.
    """
    weight = temporal_weight(F.col("year"), F.lit(year)) if year is not None else F.lit(1.0)
    links = keep(edges.groupBy("src", "tgt").agg(F.count("*").alias("n"), F.sum(weight).alias("w")))
    one = links.select(F.col("tgt").alias("node"), F.col("src").alias("next"))
    pieces, ends = keep(neighbour_pieces(one, piece)), keep(_ends(pairs, one, k + 1, near, share))
    found = keep(_frontiers(_light(ends), pieces, k, share, keep).select(F.col("pair_id").alias("end"), "node"))
    into = expand(found.withColumn("at", F.col("node")), pieces, ["end", "at"], share, keep).select("end", F.col("next").alias("src"), F.col("at").alias("tgt"))
    into = into.join(links, ["src", "tgt"]).groupBy("end").agg(F.collect_list(F.struct("src", "tgt", "n", "w")).alias("links"))
    nodes = found.withColumn("x", F.lit(None).cast("array<double>")) if features is None else found.join(features, "node", "left")
    nodes = nodes.groupBy("end").agg(F.collect_list(F.struct(F.col("node").alias("id"), "x")).alias("nodes"))
    none = F.array().cast("array<struct<src:bigint,tgt:bigint,n:bigint,w:double>>")
    lists = keep(nodes.join(into, "end", "left").select(F.col("end").alias("node"), "nodes", F.coalesce("links", none).alias("links")))
    copies, far = ends.where("copies > 1 and not far").select("node", "copies"), ends.where("far").select("node")
    copies = None if copies.isEmpty() else copies
    if far.isEmpty():
        return _beside(pairs, lists, copies), None
    wide = keep(_with_end(pairs, far))
    return _beside(pairs.join(wide.select("pair_id"), "pair_id", "left_anti"), lists, copies), wide


def lighter_ends(links: DataFrame) -> DataFrame:
    """node, next (id, out): each distinct link (src, tgt) listed once, at the
    end that has fewer links; out: whether that end is the source. A hub so
    lists only its links to other hubs."""
    n = degrees(links)
    rows = links.join(n.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(n.select(F.col("node").alias("tgt"), F.col("degree").alias("dt")), "tgt")
    out = F.col("ds") <= F.col("dt")
    return rows.select(F.when(out, F.col("src")).otherwise(F.col("tgt")).alias("node"), F.struct(F.when(out, F.col("tgt")).otherwise(F.col("src")).alias("id"), out.alias("out")).alias("next"))


def induced(members: DataFrame, edges: DataFrame, piece: int = PIECE, share: int = SHARE, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """pair_id, src, tgt, year: edges with both ends in the pair's node set.
    Distinct links are looked for from their lighter ends, by pieces of lists as
    in k_hop; years and repeats come back by an equi-join of what is left."""
    links = edges.select("src", "tgt").distinct()
    m = members.select("pair_id", "node")
    found = expand(m.withColumn("at", F.col("node")), keep(neighbour_pieces(lighter_ends(links), piece)), ["pair_id", "at"], share, keep)
    found = found.select("pair_id", "at", F.col("next.id").alias("node"), F.col("next.out").alias("out")).join(m, ["pair_id", "node"], "left_semi").distinct()
    end = lambda out: F.when(out, F.col("at")).otherwise(F.col("node"))
    found = found.select("pair_id", end(F.col("out")).alias("src"), end(~F.col("out")).alias("tgt"))
    return found.join(edges.select("src", "tgt", "year"), ["src", "tgt"]).select("pair_id", "src", "tgt", "year")


def weighted_by_time(rows: DataFrame, year: int | None = None) -> DataFrame:
    """weight: 1 / (years apart + 1), from a fixed year or a column at_year."""
    return rows.withColumn("weight", temporal_weight(F.col("year"), F.lit(year) if year is not None else F.col("at_year")))


def distances(pairs: DataFrame, sub: DataFrame, cutoff: int, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """pair_id, node, end (a or b), d: breadth-first distances in each pair's
    own subgraph, direction ignored, up to the cutoff."""
    step = sub.select("pair_id", F.col("src").alias("node"), F.col("tgt").alias("next")).unionByName(sub.select("pair_id", F.col("tgt").alias("node"), F.col("src").alias("next"))).distinct()
    step = keep(step)
    seen = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("a").alias("node")), F.struct(F.lit("b").alias("end"), F.col("b").alias("node")))).alias("s")).select("pair_id", "s.end", "s.node").withColumn("d", F.lit(0))
    front = seen.select("pair_id", "end", "node")
    for d in range(1, cutoff + 1):
        front = keep(front.join(step, ["pair_id", "node"]).select("pair_id", "end", F.col("next").alias("node")).distinct().join(seen, ["pair_id", "end", "node"], "left_anti"))
        seen = seen.unionByName(front.withColumn("d", F.lit(d)))
    return seen


def role_labels(pairs: DataFrame, members: DataFrame, sub: DataFrame, k: int = 2, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """pair_id, node, label: min(1 + d1 + (d2 (d2 + 1)) div 2, 2k + 1) of the
    distances d1 <= d2 to the pair's ends; 0 where an end cannot be reached."""
    d = distances(pairs, sub, 2 * k + 1, keep).groupBy("pair_id", "node").agg(F.min(F.when(F.col("end") == "a", F.col("d"))).alias("da"), F.min(F.when(F.col("end") == "b", F.col("d"))).alias("db"))
    rows = members.select("pair_id", "node").join(d, ["pair_id", "node"], "left")
    near, far = F.least("da", "db"), F.greatest("da", "db")
    label = F.least(1 + near + F.floor(far * (far + 1) / 2).cast("int"), F.lit(2 * k + 1))
    return rows.select("pair_id", "node", F.when(F.col("da").isNull() | F.col("db").isNull(), F.lit(0)).otherwise(label).alias("label"))


class Enclosed:
    """The subgraphs of a batch of ``around``'s rows as one graph that is not
    connected between pairs: row (of the pair) and node of each member, the first
    place it has in the nodes' lists, a and b (members), src, tgt (members) and
    place of each link."""

    def __init__(self, batch: pa.RecordBatch):
        n = batch.num_rows
        sides = [batch.column(c) for c in ("a_nodes", "b_nodes", "a_links", "b_links")]
        rows = [np.repeat(np.arange(n), np.asarray(c.value_lengths())) for c in sides]
        self.nodes, self.links = (pa.concat_arrays([c.flatten() for c in part]) for part in (sides[:2], sides[2:]))
        member, link = np.concatenate(rows[:2]), np.concatenate(rows[2:])
        ends = [np.asarray(batch.column(c)) for c in ("a", "b")]
        ids, code = np.unique(np.concatenate([np.asarray(self.nodes.field("id")), np.asarray(self.links.field("src")), np.asarray(self.links.field("tgt")), *ends]), return_inverse=True)
        at, src, tgt, a, b = np.split(code, np.cumsum([len(member), len(link), len(link), n]))
        keys, self.place = np.unique(member * len(ids) + at, return_index=True)
        self.row, self.node = member[self.place], ids[at[self.place]]

        def find(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
            wanted = rows * len(ids) + codes
            i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[i] == wanted, i, -1)

        self.a, self.b = find(np.arange(n), a), find(np.arange(n), b)
        src, tgt = find(link, src), find(link, tgt)
        inside = np.flatnonzero((src >= 0) & (tgt >= 0))
        _, first = np.unique(src[inside] * len(keys) + tgt[inside], return_index=True)
        self.link_place = inside[first]
        self.src, self.tgt = src[self.link_place], tgt[self.link_place]

    def distances(self, start: np.ndarray, cutoff: int) -> np.ndarray:
        """Breadth-first distances from each pair's start, direction ignored, -1
        beyond the cutoff."""
        d, u, v = np.full(len(self.node), -1), np.concatenate([self.src, self.tgt]), np.concatenate([self.tgt, self.src])
        d[start] = 0
        for i in range(1, cutoff + 1):
            reached = v[d[u] == i - 1]
            d[reached[d[reached] < 0]] = i
        return d

    def labels(self, k: int = 2) -> np.ndarray:
        """As ``role_labels``."""
        da, db = self.distances(self.a, 2 * k + 1), self.distances(self.b, 2 * k + 1)
        near, far = np.minimum(da, db), np.maximum(da, db)
        return np.where(near < 0, 0, np.minimum(1 + near + far * (far + 1) // 2, 2 * k + 1))


#: Nodes and links of the rows that a kernel takes at once.
ELEMENTS = 1 << 20


def enclosed(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Enclosed]]:
    """The batch in parts of a bounded number of list elements."""
    sizes = np.cumsum(sum(np.asarray(batch.column(c).value_lengths()) for c in ("a_nodes", "b_nodes", "a_links", "b_links")))
    part, at = sizes // ELEMENTS, 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]:
        yield batch.slice(at, end - at), Enclosed(batch.slice(at, end - at))
        at = end


def subgraph_labels(pairs: DataFrame, edges: DataFrame, k: int = 2, near: int = NEAR, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """pair_id, node, label: as ``role_labels`` of the pairs' subgraphs of k
    incoming steps, made within each pair's row."""

    def run(batch: pa.RecordBatch, k: int) -> Iterator[dict]:
        for part, sub in enclosed(batch):
            yield {"pair_id": part.column("pair_id").take(pa.array(sub.row)), "node": pa.array(sub.node), "label": pa.array(sub.labels(k), pa.int32())}

    rows, far = around(pairs, edges, k, near=near, keep=keep)
    out = map_batches(rows.select("pair_id", "a", "b", "a_nodes", "b_nodes", "a_links", "b_links"), run, k, "pair_id long, node long, label int")
    if far is None:
        return out
    members = keep(k_hop(far, edges, k, undirected=False, keep=keep))
    return out.unionByName(role_labels(far, members, induced(members, edges, keep=keep), k, keep))


def edgebank(history: DataFrame, queries: DataFrame, window: int, least: int) -> DataFrame:
    """queries (src, tgt, year, label) with predicted: the pair had at least
    that many edges in the window years before. Counts by pair and year first."""
    n = history.groupBy("src", "tgt", "year").agg(F.count("*").alias("n"))
    rows = n.withColumn("ask", F.lit(0)).select("src", "tgt", "year", "n", "ask").unionByName(queries.select("src", "tgt", "year").distinct().select("src", "tgt", "year", F.lit(0).cast("long").alias("n"), F.lit(1).alias("ask")))
    w = Window.partitionBy("src", "tgt").orderBy("year").rangeBetween(-window, -1)
    seen = rows.withColumn("past", F.coalesce(F.sum("n").over(w), F.lit(0))).where("ask = 1").select("src", "tgt", "year", "past")
    return queries.join(seen, ["src", "tgt", "year"]).withColumn("predicted", (F.col("past") >= least).cast("int"))


def edgebank_table(history: DataFrame, queries: DataFrame, windows: list[int], leasts: list[int]) -> DataFrame:
    """window_years, least, precision, recall, fpr, auc, ap, acc of the baseline
    that predicts a pair seen at least so often in the window before. A single
    operating point has auc (1 + recall - fpr) / 2 and ap recall * precision +
    (1 - recall) * share of positives. All windows share one sort by pair."""
    n = history.groupBy("src", "tgt", "year").agg(F.count("*").alias("n"))
    rows = n.select("src", "tgt", "year", "n", F.lit(None).cast("int").alias("label")).unionByName(queries.select("src", "tgt", "year", F.lit(0).cast("long").alias("n"), F.col("label").cast("int").alias("label")))
    # few bytes and many rows: adaptive execution would take too many of them together
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "tgt")
    by = Window.partitionBy("src", "tgt").orderBy("year")
    past = F.array(*[F.struct(F.lit(w).alias("window_years"), F.coalesce(F.sum("n").over(by.rangeBetween(-w, -1)), F.lit(0)).alias("past")) for w in windows])
    seen = rows.withColumn("past", past).where("label is not null").select("label", F.explode("past").alias("x")).select("label", "x.*")
    counts = seen.groupBy("window_years", "past", "label").agg(F.count("*").alias("n"))  # few rows
    cells = counts.withColumn("least", F.explode(F.array(*[F.lit(t) for t in leasts])))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    yes, pos = F.col("past") >= F.col("least"), F.col("label") == 1
    cells = cells.groupBy("window_years", "least").agg(count(yes & pos).alias("tp"), count(yes & ~pos).alias("fp"), count(pos).alias("p"), count(~pos).alias("m"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, p, m = (F.col(c) for c in ("tp", "fp", "p", "m"))
    r, f, q = ratio(tp, p), ratio(fp, m), ratio(tp, tp + fp)
    return cells.select("window_years", "least", q.alias("precision"), r.alias("recall"), f.alias("fpr"), ((1 + r - f) / 2).alias("auc"), (r * q + (1 - r) * ratio(p, p + m)).alias("ap"), ratio(tp + m - fp, p + m).alias("acc"))


def top_nodes(features: DataFrame, scorer: list[float], k: int) -> DataFrame:
    """node, score of the k nodes with the largest projection on the scorer."""
    s = F.array(*[F.lit(float(v)) for v in scorer])
    return features.withColumn("score", F.round(dot(F.col("x"), s) / norm(s), 6)).select("node", "score").orderBy(F.col("score").desc(), "node").limit(k)
