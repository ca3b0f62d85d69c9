"""Repair of conversation structure by error-correcting Earley parsing.

The grammar of roles is right-linear (START, AFTER_SYSTEM, AFTER_USER,
AFTER_ASSISTANT below), and its terminals can be met in several ways: keep a
row, give it another role, delete rows before it, or insert a turn that is not
there, each with its cost. A chart has one set of items for every row; an item
is what the grammar still expects and holds the least (cost, audit) of all ways
to come to it. What a completed tail returns to is always the start rule, so an
item needs no origin, and a chart set has at most one item a rule: the parse is
linear in the rows. Among ways of one cost the one with the ASCII-least audit
stays; that is safe, because of two ways over the same rows, one audit can only
begin with the other if it has more inserts and so costs more.

A conversation of any length is parsed in segments of bounded size, each from
every rule that it may have to go on with; segments meet through their least
(cost, audit) from rule to rule. What is held for a whole conversation is the
audit alone, which is one value of the result. Texts are met once more, by
streaming them past the audit, for the hash of the repaired conversation, which
only one task can take, as SHA-256 goes from front to back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bound_batches, written
from chronoloom.llm.sequence import number_rows

#: Rows in a segment.
SEGMENT = 1_024

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)

#: Rule -> (role initial, rule that follows).
EXPECTS = {START: [("s", AFTER_SYSTEM), ("u", AFTER_USER)], AFTER_SYSTEM: [("u", AFTER_USER)], AFTER_USER: [("a", AFTER_ASSISTANT)], AFTER_ASSISTANT: [("u", AFTER_USER)]}
ENDS = (START, AFTER_ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

SPACE = " \t\n\x0b\x0c\r"

#: A row's fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)

Item = tuple[int, str]


def _offer(chart: dict[int, Item], rule: int, item: Item) -> bool:
    if rule in chart and chart[rule] <= item:
        return False
    chart[rule] = item
    return True


def _predict(chart: dict[int, Item]) -> None:
    """Insert productions: go on without a row."""
    todo = list(chart)
    while todo:
        rule = todo.pop()
        cost, audit = chart[rule]
        for initial, after in EXPECTS[rule]:
            if initial in ROLES and _offer(chart, after, (cost + INSERT, audit + "I")):
                todo.append(after)


def parse(rows: list[tuple[str, int]], rule: int) -> dict[int, Item]:
    """rows: (role initial, fault). From a rule, the least (cost, audit) to
    every rule that may be expected after the rows."""
    chart = {rule: (0, "")}
    _predict(chart)
    for initial, fault in rows:
        scanned: dict[int, Item] = {}
        extra = TRUNCATED if fault == CUT else 0
        for expected, (cost, audit) in chart.items():
            _offer(scanned, expected, (cost + DELETE, audit + "D"))
            if fault in (BLANK, DUPLICATE):
                continue
            for wanted, after in EXPECTS[expected]:
                if initial == wanted:
                    _offer(scanned, after, (cost + extra, audit + "K"))
                elif wanted in ROLES:
                    _offer(scanned, after, (cost + extra + REROLE, audit + "R"))
        chart = scanned
        _predict(chart)
    return chart


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _made(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 1_024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_TEXTS, _LONGS = pa.list_(pa.string()), pa.list_(pa.int64())
_SEGMENTS = pa.schema([("has_key", pa.bool_()), ("key", pa.int64()), ("seg", pa.int64()), ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("ways", pa.list_(pa.int32())), ("costs", _LONGS), ("audits", _TEXTS)])
_SEGMENTS_SQL = "has_key boolean, key long, seg long, first string, last string, blank long, duplicate long, truncated long, illegal long, ways array<int>, costs array<long>, audits array<string>"

_LEGAL = ("su", "ua", "au")


def _parse_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's faults and its least (cost, audit) from rule to rule."""

    def summary(at: tuple, rows: list[tuple[str, int]]) -> tuple:
        faults = [f for _, f in rows]
        initials = [i for i, _ in rows]
        illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
        ways, costs, audits = [], [], []
        for rule in EXPECTS if at[2] else (START,):
            for after, (cost, audit) in parse(rows, rule).items():
                ways.append(4 * rule + after)
                costs.append(cost)
                audits.append(audit)
        return (*at, initials[0], initials[-1], *[faults.count(f) for f in (BLANK, DUPLICATE, CUT)], illegal, ways, costs, audits)

    def segments() -> Iterator[tuple]:
        at, rows = None, []
        for *key, initial, fault in _streams(batches):
            if tuple(key) != at:
                if rows:
                    yield summary(at, rows)
                at, rows = tuple(key), []
            rows.append((initial, fault))
        if rows:
            yield summary(at, rows)

    yield from _made(segments(), _SEGMENTS, 64)


_REPAIRS = pa.schema([("has_key", pa.bool_()), ("key", pa.int64()), ("seg", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("piece", pa.string()), ("turns", pa.int64())])
_REPAIRS_SQL = "has_key boolean, key long, seg long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, piece string, turns long"


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation its sums and audit in a row without seg, and the
    audit's piece for each segment, with the number of turns of the repair."""

    def whole(key: tuple, parts: list[tuple]) -> Iterator[tuple]:
        chart, lengths = {START: (0, "")}, {START: ()}
        for part in parts:
            new: dict[int, Item] = {}
            cuts: dict[int, tuple] = {}
            for way, cost, audit in zip(*part[7:], strict=True):
                rule, after = divmod(way, 4)
                if rule in chart and _offer(new, after, (chart[rule][0] + cost, chart[rule][1] + audit)):
                    cuts[after] = (lengths[rule], len(audit))
            chart, lengths = new, cuts
        (cost, audit), end = min((chart[r], r) for r in ENDS if r in chart)
        sums = [sum(p[i] for p in parts) for i in (3, 4, 5, 6)]
        sums[3] += sum(a[2] + b[1] not in _LEGAL for a, b in zip(parts, parts[1:], strict=False))
        yield (*key, None, *sums, cost, audit, None, None)
        at, cut, turns = len(audit), lengths[end], len(audit) - audit.count("D")
        for part in reversed(parts):
            cut, n = cut
            at -= n
            yield (*key, part[0], *[None] * 6, audit[at : at + n], turns)

    def conversations() -> Iterator[tuple]:
        key, parts = None, []
        for has, of, *part in _streams(batches):
            if (has, of) != key:
                if parts:
                    yield from whole(key, parts)
                key, parts = (has, of), []
            parts.append(tuple(part))
        if parts:
            yield from whole(key, parts)

    yield from _made(conversations(), _REPAIRS, 64)


_HASHES = pa.schema([("has_key", pa.bool_()), ("key", pa.int64()), ("repaired_sha256", pa.string())])


class Repaired:
    """The hash of a repaired conversation, fed piece by piece and row by row."""

    def __init__(self):
        self.sha, self.turn, self.turns, self.edits = hashlib.sha256(), 0, 0, iter("")

    def _put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.turn else "") + f"{role}:{text}").encode())
        self.turn += 1

    def _due(self) -> str:
        """Role of the next turn: user and assistant alternate, assistant last."""
        return "assistant" if (self.turns - self.turn) % 2 else "user"

    def piece(self, edits: str, turns: int) -> None:
        self.finish()
        self.edits, self.turns = iter(edits), turns

    def row(self, role: str, text: str) -> None:
        for edit in self.edits:
            if edit != "I":
                if edit != "D":
                    self._put(role if edit == "K" else self._due(), text)
                return
            self._put(self._due(), "")

    def finish(self) -> str:
        for _ in self.edits:
            self._put(self._due(), "")
        return self.sha.hexdigest()


def _hash_repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, segment and number; a segment's piece comes first."""

    def hashes() -> Iterator[tuple]:
        key, repaired = None, Repaired()
        for has, of, _, _, role, text, piece, turns in _streams(batches):
            if (has, of) != key:
                if key is not None:
                    yield (*key, repaired.finish())
                key, repaired = (has, of), Repaired()
            if piece is not None:
                repaired.piece(piece, turns)
            else:
                repaired.row(role, text)
        if key is not None:
            yield (*key, repaired.finish())

    yield from _made(hashes(), _HASHES)


def damage(rows: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text damaged by crc32 of ``conv_id:turn``
    modulo 20; every null is one space, in the key, as role and as text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("_d"))
    d, text = F.col("_d"), F.col("text")
    changed = F.when(d == 1, F.lit("")).when(d == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = rows.where(d != 0).select("conv_id", "turn", F.when(d == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"), "_d")
    return rows.withColumn("_copy", F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_d", "_copy")


def _key(col: str) -> list[Column]:
    return [F.col(col).isNotNull().alias("has_key"), F.coalesce(F.col(col).cast("long"), F.lit(0)).alias("key")]


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text): gaps,
    blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows are taken by turn, nulls first, those of one turn by role and text
    (bytewise), equal ones in any order. A null conv_id is a conversation like
    any other, a null role or text one space. Repeated rows are duplicates of
    the first. No rows give no rows; other columns are not looked at.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    by = ["has_key", "key"]
    placed = rows.select(*_key("conv_id"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    placed = number_rows(placed, by, ["turn", "role", "text"], "turns").withColumn("seg", F.floor(F.col("idx") / segment))

    # the fault of each row; what a text is compared by is its hash
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    facts = placed.select(*by, "seg", "idx", "turn", "role", F.sha2("text", 256).alias("hash"), F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    facts = written(facts, "facts")
    again = facts.groupBy(*by, "role", "hash").agg(F.min("idx").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    facts = facts.join(written(again, "repeated"), [*by, "role", "hash"], "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first") < F.col("idx"), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    facts = facts.select(*by, "seg", "idx", "initial", fault.alias("fault"))

    facts = facts.repartition(*by, "seg").sortWithinPartitions(*by, "seg", "idx").select(*by, "seg", "initial", "fault")
    segments = written(facts.mapInArrow(_parse_segments, _SEGMENTS_SQL), "segments")
    joined = segments.repartition(*by).sortWithinPartitions(*by, "seg").mapInArrow(_join_segments, _REPAIRS_SQL)
    joined = written(joined, "repairs")

    pieces = joined.where("seg is not null").select(*by, "seg", F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "piece", "turns")
    texts = placed.select(*by, "seg", "idx", "role", "text", F.lit(None).cast("string").alias("piece"), F.lit(None).cast("long").alias("turns"))
    both = pieces.unionByName(texts).repartition(*by).sortWithinPartitions(*by, "seg", "idx")
    hashes = both.mapInArrow(_hash_repaired, "has_key boolean, key long, repaired_sha256 string")

    turns = placed.groupBy(*by, "turn").agg(F.lit(1).alias("one")).groupBy(*by).agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = joined.where("seg is null").drop("seg", "piece", "turns").join(hashes, by).join(turns, by)
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(F.when(F.col("has_key"), F.col("key")).alias("conv_id"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *counts, "audit", "repaired_sha256")


def repair_report(rows: DataFrame) -> DataFrame:
    """The repair of damaged conversations, a row for every original conv_id;
    one that has lost all its rows has zeros and an empty audit."""
    found = repair(damage(rows))
    ids = rows.select("conv_id").distinct()
    found = ids.join(found.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})
