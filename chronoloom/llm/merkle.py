"""Merkle manifest of a dataset: a tree a partition, and one over their roots.

Leaves get their number in their tree by a range sort. Nodes then meet in
blocks of 2**LEVELS consecutive ones, which is what one step combines: a
partial parent holds the digests of its children by their index until as many
have come as the size of its level says it has, then becomes a child of its own
parent, event by event, up to the block's top. A task first combines the
blocks that it holds whole; the nodes of blocks cut by a task's end, the
frontier, are shuffled by block and combined there. The tops are the next
step's nodes, so a tree of any size takes log(size) / LEVELS steps and no task
holds more than a block. Links from parents back to children give every node
the siblings on its way to the top; joined to the tops' own, they are proofs.

Cases: nulls are leaves' fields like any other (``-``), a null partition is a
tree of its own, the first; rows equal in id and all fields are leaves each,
in any order, rows that share an id only are ordered by their leaf digest; no
rows give no rows; columns beside those named are not looked at. A text is
hashed whole, once, by the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import crc_mod, written
from chronoloom.llm.sequence import number_rows

#: Levels that one step combines; a block has up to 2**LEVELS nodes.
LEVELS = 10
BLOCK = 1 << LEVELS

TREE = ["has_key", "key"]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 over all fields: ``-`` for null, else byte count, ``:``, value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


class Block:
    """Nodes first, first + 1, ... of a level of size nodes, and their tree."""

    def __init__(self, first: int, size: int):
        self.first, self.nodes = first, min(BLOCK, size - first)
        self.height = min(LEVELS, (size - 1).bit_length())
        self.parents: dict[tuple[int, int], dict[int, str]] = {}
        self.top: str | None = None

    def add(self, index: int, value: str) -> None:
        """The digest of one node has come; emit every ancestor that it completes."""
        at = index - self.first
        for level in range(1, self.height + 1):
            below, at = at, at >> 1
            children = self.parents.setdefault((level, at), {})
            children[below & 1] = value
            level_below = -(-self.nodes >> (level - 1))
            if len(children) < min(2, level_below - 2 * at):
                return
            value = digest(children[0] + children.get(1, ""))
        self.top = value

    def proofs(self) -> list[str]:
        """For each node the siblings on its way to the top, its own first."""
        above = [""]
        for level in range(self.height, 0, -1):
            above = [self.parents[level, at].get(1 - side, "") + p for at, p in enumerate(above) for side in sorted(self.parents[level, at])]
        return above


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of nodes with proof and top: set where the task has the whole
    block in one run, else null (the frontier)."""
    block, rows, key, schema = None, [], None, None

    def closed() -> list[tuple]:
        if block is None or block.top is None:
            return [(*r, None, None) for r in rows]
        by_index = block.proofs()
        return [(*r, by_index[r[2] - block.first], block.top) for r in rows]

    done: list[tuple] = []
    for batch in batches:
        schema = batch.schema
        for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (r[0], r[1], r[2] >> LEVELS) != key:
                done += closed()
                key, rows, block = (r[0], r[1], r[2] >> LEVELS), [], Block(r[2] & ~(BLOCK - 1), r[3])
            rows.append(r)
            block.add(r[2], r[4])
            if len(done) >= 4 * BLOCK:
                yield _batch(done, schema)
                done = []
    done += closed()
    if done:
        yield _batch(done, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    schema = schema.append(pa.field("proof", pa.string())).append(pa.field("top", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _step(nodes: DataFrame) -> DataFrame:
    """nodes with proof and top of their block, written."""
    shape = ", ".join(f"`{n}` {t}" for n, t in nodes.dtypes) + ", proof string, top string"
    first = written(nodes.mapInArrow(_combine, shape), "combined")
    frontier = first.where("top is null").drop("proof", "top").withColumn("_block", F.shiftright("idx", LEVELS))
    frontier = frontier.repartition(*TREE, "_block").drop("_block").sortWithinPartitions(*TREE, "idx")
    return first.where("top is not null").unionByName(written(frontier.mapInArrow(_combine, shape), "frontier"))


def prove(leaves: DataFrame) -> DataFrame:
    """leaves (has_key, key, idx, size, digest, then any columns) with proof,
    the siblings' digests up to the root as one string, and root."""
    steps, nodes = [], leaves
    while True:
        steps.append(_step(nodes))
        nodes = steps[-1].where((F.col("size") > BLOCK) & (F.col("idx") % BLOCK == 0))
        nodes = written(nodes.select(*TREE, F.shiftright("idx", LEVELS).alias("idx"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"), F.col("top").alias("digest")), "tops")
        if nodes.isEmpty():
            break
    found = steps.pop().withColumnRenamed("top", "root")
    while steps:
        below = steps.pop().withColumn("_up", F.when(F.col("size") > BLOCK, F.shiftright("idx", LEVELS)))
        above = written(found.select(*TREE, F.col("idx").alias("_up"), F.col("proof").alias("_proof"), F.col("root").alias("_root")), "proofs")
        found = below.join(above, [*TREE, "_up"], "left").withColumns({"proof": F.concat("proof", F.coalesce("_proof", F.lit(""))), "root": F.coalesce("_root", "top")}).drop("_up", "_proof", "_root", "top")
    return found


def fold(value: str, idx: int, size: int, proof: str) -> str:
    """The root that a leaf and its siblings come to."""
    at = 0
    while size > 1:
        other = proof[at : at + 64] if idx & 1 or idx + 1 < size else ""
        value = digest(other + value if idx & 1 else value + other)
        at, idx, size = at + len(other), idx >> 1, (size + 1) >> 1
    return value


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.select(["claim", "idx", "size", "proof", "up_idx", "up_size", "up_proof"])
        roots = [fold(fold(claim, i, n, p), ui, un, up) for claim, i, n, p, ui, un, up in zip(*[c.to_pylist() for c in rows.columns], strict=True)]
        kept = batch.select(["id", "leaf", "subroot", "root", "proof_sha256"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(roots, pa.string())], names=[*kept.schema.names, "folded_root"])


def manifest(rows: DataFrame, id_col: str, key: str, fields: list[str], claims: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row: id, leaf, subroot (of its key's tree), root,
    proof_sha256 and folded_root, what its claimed fields and proof come to.

    claims: fields whose claimed value differs from the manifest's, in terms
    of the columns of rows; without any the rows themselves are checked.
    """
    claimed = [(claims or {}).get(f, F.col(f)) for f in fields]
    leaves = rows.select(F.col(key).isNotNull().alias("has_key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(id_col).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("digest"), leaf_digest(claimed).alias("claim"))
    leaves = number_rows(written(leaves, "leaves"), TREE, ["id", "digest"], "sorted-leaves")
    proved = written(prove(leaves.select(*TREE, "idx", "size", "digest", "id", "claim")), "proved")
    trees = proved.where("idx = 0").select(F.lit(True).alias("has_key"), F.lit("").alias("key"), F.col("has_key").alias("of_has"), F.col("key").alias("of_key"), F.col("root").alias("digest"))
    trees = number_rows(trees, TREE, ["of_has", "of_key"], "sorted-trees")
    trees = prove(trees.select(*TREE, "idx", "size", "digest", "of_has", "of_key"))
    trees = written(trees.select(F.col("of_has").alias("has_key"), F.col("of_key").alias("key"), F.col("idx").alias("up_idx"), F.col("size").alias("up_size"), F.col("proof").alias("up_proof"), F.col("root").alias("_root")), "trees")
    both = proved.withColumnRenamed("root", "subroot").join(trees, TREE)
    both = both.select("id", F.col("digest").alias("leaf"), "subroot", F.col("_root").alias("root"), F.sha2(F.concat("proof", "up_proof"), 256).alias("proof_sha256"), "claim", "idx", "size", "proof", "up_idx", "up_size", "up_proof")
    shape = f"id {dict(leaves.dtypes)['id']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return both.mapInArrow(_folded, shape)


def manifest_report(docs: DataFrame) -> DataFrame:
    """The manifest of documents, a tree a language, checked against rows of
    which those with 7 dividing crc32(doc_id) claim one character more. A null
    id counts as the empty string there."""
    wrong = F.when(crc_mod(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": wrong})
    return found.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))
