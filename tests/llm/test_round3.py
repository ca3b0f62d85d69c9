"""Merkle manifest, Gray-order SimHash and conversation repair: brute force, and
nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronoloom.llm import conversations as C
from chronoloom.llm import gray_simhash as G
from chronoloom.llm import merkle, queries, sequence
from chronoloom.llm.components import components

FOLDER = "/root/testdata/sf0.001"
CLASH = "has_key boolean, key long, idx long, size long, digest string, print long, comp long, proof string, root string, seg long"
DOCS = f"doc_id long, source string, lang string, n_chars long, text string, {CLASH}"
EXTRA = (True, 1, 2, 3, "d", 4, 5, "p", "r", 6)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(300_000))


def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


# --- numbers in groups


def test_numbers_run_through_every_group(spark):
    rows = [(i % 3 > 0, "a" * (i % 3), i // 6) for i in range(200)]
    got = sequence.number_rows(spark.createDataFrame(rows, "g boolean, h string, o int"), ["g", "h"], ["o"], "t").collect()
    for _, part in itertools.groupby(sorted(got, key=lambda r: (r["g"], r["h"], r["idx"])), key=lambda r: r["h"]):
        part = list(part)
        assert [r["idx"] for r in part] == list(range(len(part))) and {r["size"] for r in part} == {len(part)}
        assert [r["o"] for r in part] == sorted(r["o"] for r in part)


# --- Merkle manifest


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def tree(level):
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 2 * 2 : i // 2 * 2 + 2]
            paths[k] += [x for j, x in enumerate(run) if j != i % 2]
            at[k] = i // 2
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for doc, source, lang, n, text in rows:
        groups.setdefault(lang, []).append((doc, H(*map(field, (doc, source, lang, n, text))), n))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    subs, parts = [], []
    for lang in order:
        leaves = sorted(groups[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        sub, paths = tree([x[1] for x in leaves])
        subs.append(sub)
        parts.append((leaves, paths))
    root, ups = tree(subs)
    out = []
    for sub, (leaves, paths), up in zip(subs, parts, ups, strict=True):
        for (doc, leaf, n), path in zip(leaves, paths, strict=True):
            wrong = n is not None and zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 0
            out.append((doc, leaf, sub, root, H(*path, *up), not wrong))
    return sorted(out, key=str)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "verified")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 65])
def test_manifest_by_brute_force(spark, n):
    rows = [(i, f"s{i % 2}", ["en", "de", None, "é"][i * i % 4], i, f"text {i}") for i in range(n)]
    got = sorted((tuple(r[c] for c in MANIFEST) for r in merkle.manifest_report(docs(spark, rows)).collect()), key=str)
    assert got == brute_manifest(rows)


def test_manifest_over_block_edges(spark):
    rows = [(i, "s", "en", 1, "t") for i in range(2 * merkle.BLOCK + 5)]
    got = merkle.manifest_report(docs(spark, rows))
    folded = [r for r in got.collect()]
    assert sorted((tuple(r[c] for c in MANIFEST) for r in folded), key=str) == brute_manifest(rows)
    assert all((r["folded_root"] == r["root"]) == r["verified"] for r in folded)


def test_manifest_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "", 0, ""), (2, "", "", 0, ""), (2, "x", "", 0, ""), (None, "a", "en", 3, "no id"), (14, "a", "en", None, LONG), (7, "ü", "de", -1, "\n")]
    got = merkle.manifest_report(docs(spark, rows))
    assert sorted((tuple(r[c] for c in MANIFEST) for r in got.collect()), key=str) == brute_manifest(rows)
    assert merkle.manifest_report(docs(spark, [])).count() == 0


def test_block_waits_for_all_children():
    b = merkle.Block(0, 5)
    for i in (4, 0, 3, 1):
        b.add(i, H(str(i)))
    assert b.top is None
    b.add(2, H("2"))
    root, paths = tree([H(str(i)) for i in range(5)])
    assert b.top == root and b.proofs() == ["".join(p) for p in paths]
    assert all(merkle.fold(H(str(i)), i, 5, p) == root for i, p in enumerate(b.proofs()))


# --- Gray-order SimHash


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits):
    """The smallest value that each value reaches."""
    label = {v: v for v in values}
    pairs = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= bits]
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


def test_prints_and_groups_by_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["red", "Green", "blue", "the", "of", "x"]) for _ in range(60)) for _ in range(8)]
    texts = [None, "", " \n", "One two", "one TWO", "a b c d", "a b c D e", "É é É é É", LONG, LONG + " tail"]
    for t in base:
        words = t.split()
        texts += [t, t + " end", " ".join([*words[:30], "zz", *words[31:]]), t.upper()]
    rows = [(None if i == 4 else i + 1, "s", "en", 1, t) for i, t in enumerate(texts)] + [(3, "s", "en", 1, base[0])]
    prints = [brute_print(r[4]) for r in rows]
    label = brute_components(sorted(set(prints)), 4)
    least = {}
    for (doc, *_), p in zip(rows, prints, strict=True):
        if doc is not None:
            least[label[p]] = min(doc, least.get(label[p], doc))
    want = sorted(((r[0], f"{p:016x}", least.get(label[p])) for r, p in zip(rows, prints, strict=True)), key=str)
    assert sorted(map(tuple, G.near_report(docs(spark, rows)).collect()), key=str) == want
    assert G.near_report(docs(spark, [])).count() == 0


@pytest.mark.parametrize("segments", [None, 6, 7])
def test_links_over_blocks_by_brute_force(spark, segments):
    """Crowded patterns and blocks of seven rows, so that most links go over a block's end."""
    rng = random.Random(1)
    values = set()
    for center in [0, (1 << 64) - 1, *[rng.getrandbits(64) for _ in range(4)]]:
        for _ in range(30):
            v = center
            for b in rng.sample(range(64), rng.randrange(0, 8)):
                v ^= 1 << b
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = G.links(spark.createDataFrame([(v,) for v in signed], "print long"), 4, segments, block=7)
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in found.collect()]
    label = {r["node"] % (1 << 64): r["comp"] for r in components(found).collect()}
    want = brute_components(sorted(values), 4)
    same = lambda lab: {frozenset(v for v in values if lab.get(v, v) == lab.get(w, w)) for w in values}
    assert same(label) == same(want)
    assert len(pairs) < 20 * len(values)


def test_index_finds_every_near_pair():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    codes[300:] = codes[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    order = np.argsort(G.gray_rank(codes))
    codes = codes[order]
    index = G.GrayIndex(codes)
    got = {(int(a), int(b)) for i, j in G.near_pairs(index, index, 4, 0) for a, b in zip(i, j, strict=True)}
    assert got == {(a, b) for a in range(700) for b in np.flatnonzero(np.bitwise_count(codes[a] ^ codes) <= 4).tolist() if b > a}
    x, y = G.GrayIndex(codes[:33]), G.GrayIndex(codes[33:])
    across = {(int(a), int(b) + 33) for i, j in G.near_pairs(x, y, 4, 0) for a, b in zip(i, j, strict=True)}
    assert across == {(a, b) for a, b in got if a < 33 <= b}


def test_bit_orders_keep_all_bits():
    prints = np.random.default_rng(3).integers(0, 1 << 63, 50, dtype=np.uint64)
    for order in G.bit_orders(6, 4):
        codes = order.arrange(prints)
        assert (order.restore(codes) == prints).all() and (G.gray_code(G.gray_rank(codes)) == codes).all()
    assert len(G.bit_orders(6, 4)) == 15


def test_majority_counts_long_texts_in_pieces():
    hashes = np.random.default_rng(4).integers(0, 1 << 63, 2_000, dtype=np.uint64)
    lengths = [0, 1, 255, 256, 0, 1_000, 488]
    got, at = G.bit_counts(hashes, lengths), 0
    for row, n in zip(got, lengths, strict=True):
        part = hashes[at : at + n]
        assert row.tolist() == [int((part >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
        at += n


# --- conversation repair

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def brute_audit(rows):
    """The least (cost, audit), from the end backwards."""
    never = (10**9, "~")
    best = [[never] * 4 for _ in range(len(rows) + 1)]
    best[-1][0] = best[-1][3] = (0, "")
    for i in range(len(rows), -1, -1):
        for q in range(4) if i < len(rows) else ():
            initial, fault = rows[i]
            ways = [(best[i + 1][q][0] + 2, "D" + best[i + 1][q][1])]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for x, q2 in NEXT[q].items():
                    c, a = best[i + 1][q2]
                    ways += [(c + more, "K" + a)] if x == initial else []
                    ways += [(c + more + 1, "R" + a)] if x in "ua" else []
            best[i][q] = min(ways)
        for _ in range(4):
            for q in range(4):
                for x, q2 in NEXT[q].items():
                    if x in "ua":
                        best[i][q] = min(best[i][q], (best[i][q2][0] + 5, "I" + best[i][q2][1]))
    return best[0][0]


def brute_repair(rows):
    """rows: (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = brute_audit(list(zip(initials, faults, strict=True)))
    turns, out, left = len(audit) - audit.count("D"), [], iter(rows)
    for e in audit:
        role = "assistant" if (turns - len(out)) % 2 else "user"
        _, own, text = ("", "", "") if e == "I" else next(left)
        out += [] if e == "D" else [f"{own if e == 'K' else role}:{text}"]
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


CONV = f"conv_id long, turn long, role string, text string, {CLASH.replace('key long', 'key string')}"
COLS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def talks(spark, rows):
    return spark.createDataFrame([(*r, True, "k", *EXTRA[2:]) for r in rows], CONV)


def by_turn(rows):
    return sorted(((t, r or " ", " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))


@pytest.mark.parametrize("segment", [1, 3, 1024])
def test_repair_by_brute_force(spark, segment):
    rng = random.Random(9)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", ""]), rng.choice(["Yes.", "No!", "cut off", "", f"Well {turn}?", f"So {turn}.", f"And {turn}."])))
    got = {r["conv_id"]: tuple(r[c] for c in COLS) for r in C.repair(talks(spark, rows), segment).collect()}
    assert got == {c: brute_repair(by_turn([r[1:] for r in rows if r[0] == c])) for c in range(60)}


def test_repair_report_by_brute_force(spark):
    rng, kinds, rows = random.Random(3), set(), []
    for conv in [None, *range(40)]:
        rows += [(conv, rng.choice([None, *range(6)]), rng.choice([None, "user", "assistant", "system"]), rng.choice([None, " \n", "Hi. Who?", "é!", "x", LONG])) for _ in range(rng.randrange(1, 8))]
    rows += rows[:9]
    want = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            kinds.add(d)
            text = " " if text is None else text
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            kept += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        want[conv] = brute_repair(by_turn(kept))
    got = {r["conv_id"]: tuple(r[c] for c in COLS) for r in C.repair_report(talks(spark, rows)).collect()}
    assert got == want and {0, 1, 2, 3, 4} <= kinds
    assert C.repair_report(talks(spark, [])).count() == 0


def test_a_conversation_without_rows_left(spark):
    conv = next(i for i in range(10_000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    got = C.repair_report(talks(spark, [(conv, 1, "user", "Hi.")])).collect()
    assert [tuple(r[c] for c in ("conv_id", *COLS)) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_long_conversation(spark):
    rows = spark.range(5_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.format_string("Turn %d.", "id").alias("text"))
    got = C.repair(rows).collect()
    want = brute_repair([(i, "assistant" if i % 3 else "user", f"Turn {i}.") for i in range(5_000)])
    assert [tuple(r[c] for c in COLS) for r in got] == [want]


# --- SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = queries.queries()[name](spark, FOLDER), con.sql(queries.oracle_sql()[name])
    order = list(want.columns)
    assert sorted(got.columns) == sorted(order)
    assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(str, want.fetchall()))
