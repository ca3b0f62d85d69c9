"""The queries that the entry point registers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bitsliced, conversations, decontaminate, gated_lm, gray_simhash, language_id, line_dedup, merkle, mixing, ngram_join, suffix_dedup, surrogates, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.score_report(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", F.col("lines.total").alias("n_lines"), F.col("lines.removed").alias("n_removed"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_report(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a setting of the session. Without it a public one is taken,
    for trials only: whoever knows the key can recompute the replacements."""
    key = spark.conf.get("chronoloom.surrogates.key", "for trials only")
    return surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op12_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_simhash.near_report(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST(concat('0x', substr(hex, 5 * (i // 4) + 1, 5)) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM h
"""

OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS t
  FROM bw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) r(i) WHERE len(w) > 0
), pos AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM dw, (SELECT DISTINCT m FROM win), unnest(range(1, len(w) - m + 2)) r(i)
), hit AS (
  SELECT DISTINCT pos.doc_id, pos.i, pos.m, win.item_id FROM pos JOIN win ON pos.m = win.m AND pos.t = win.t
), word AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM hit) GROUP BY doc_id
), item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), g AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, p.b FROM r JOIN p ON r.seen = p.a
), c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s LEFT JOIN c ON doc_id = node
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: The CRC-32 polynomial and its start and end value.
CRC_TABLE = """t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
)"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text; needs the table t of CRC_TABLE."""
    return f"""CASE WHEN {text} = '' THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))) END"""


def _field(col: str, text: str | None = None) -> str:
    text = f"CAST({text or col} AS VARCHAR)"
    return f"CASE WHEN {col} IS NULL THEN '-' ELSE concat(strlen({text}), ':', {text}) END"


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Nodes of level after level; a climb from each leaf gathers its siblings and folds its claim.
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, d AS (
  SELECT doc_id, lang, sha256(concat({", ".join(map(_field, _FIELDS))})) AS leaf, n_chars IS NOT NULL AND {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 7 = 0 AS wrong,
    sha256(concat({", ".join(_field(c, "(n_chars + 1)" if c == "n_chars" else None) for c in _FIELDS)})) AS forged
  FROM documents, t
), l AS (
  SELECT *, CASE WHEN wrong THEN forged ELSE leaf END AS claim, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
), n AS (
  SELECT lang, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS size FROM l
  UNION ALL
  SELECT a.lang, a.level + 1, a.i // 2, sha256(concat(a.h, a.other)), (a.size + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY i) AS other FROM n) a WHERE a.i % 2 = 0 AND a.size > 1
), s AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS size FROM n WHERE size = 1
), m AS (
  SELECT 0 AS level, i, h, size FROM s
  UNION ALL
  SELECT a.level + 1, a.i // 2, sha256(concat(a.h, a.other)), (a.size + 1) // 2
  FROM (SELECT *, lead(h) OVER (ORDER BY i) AS other FROM m) a WHERE a.i % 2 = 0 AND a.size > 1
), p AS (
  SELECT doc_id, leaf, lang, 0 AS level, i, '' AS proof, claim AS h FROM l
  UNION ALL
  SELECT p.doc_id, p.leaf, p.lang, p.level + 1, p.i // 2, concat(p.proof, o.h),
    sha256(CASE WHEN p.i % 2 = 0 THEN concat(p.h, o.h) ELSE concat(o.h, p.h) END)
  FROM p JOIN n ON n.lang IS NOT DISTINCT FROM p.lang AND n.level = p.level AND n.i = p.i AND n.size > 1
  LEFT JOIN n o ON o.lang IS NOT DISTINCT FROM p.lang AND o.level = p.level AND o.i = xor(p.i, 1)
), q AS (
  SELECT p.doc_id, p.leaf, s.h AS subroot, 0 AS level, s.i, p.proof, p.h
  FROM p JOIN n ON n.lang IS NOT DISTINCT FROM p.lang AND n.level = p.level AND n.size = 1 JOIN s ON s.lang IS NOT DISTINCT FROM p.lang
  UNION ALL
  SELECT q.doc_id, q.leaf, q.subroot, q.level + 1, q.i // 2, concat(q.proof, o.h),
    sha256(CASE WHEN q.i % 2 = 0 THEN concat(q.h, o.h) ELSE concat(o.h, q.h) END)
  FROM q JOIN m ON m.level = q.level AND m.i = q.i AND m.size > 1 LEFT JOIN m o ON o.level = q.level AND o.i = xor(q.i, 1)
)
SELECT doc_id, leaf, subroot, m.h AS root, sha256(proof) AS proof_sha256, q.h AS folded_root, q.h = m.h AS verified
FROM q JOIN m ON m.level = q.level AND m.size = 1
"""

_END = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"


def _least(ways: list[tuple[str, str, str]]) -> str:
    """The least (cost, audit) of (condition, cost, audit)."""
    return "list_min([" + ", ".join(f"CASE WHEN {when} THEN {{'c': {c}, 'a': {a}}} END" for when, c, a in ways) + "])"


def _scan(rule: str, froms: list[tuple[str, str]]) -> str:
    """What the grammar expects after a row that was deleted, kept or given another role."""
    ways = [(f"{rule} IS NOT NULL", f"{rule}.c + 2", f"{rule}.a || 'D'")]
    for of, initial in froms:
        ways.append((f"{of} IS NOT NULL AND fault NOT IN (1, 2) AND initial = '{initial}'", f"{of}.c + 5 * CAST(fault = 3 AS BIGINT)", f"{of}.a || 'K'"))
        if initial != "s":
            ways.append((f"{of} IS NOT NULL AND fault NOT IN (1, 2)", f"{of}.c + 1 + 5 * CAST(fault = 3 AS BIGINT)", f"{of}.a || 'R'"))
    return _least(ways)


#: q0 to q3: the least (cost, audit) with the start, a turn after system, user or assistant to come.
_STEP = f"""SELECT conv_id, i, o0 AS q0, o1 AS q1, {_least([("o2 IS NOT NULL", "o2.c", "o2.a"), ("o0 IS NOT NULL", "o0.c + 5", "o0.a || 'I'"), ("o1 IS NOT NULL", "o1.c + 5", "o1.a || 'I'"), ("o3 IS NOT NULL", "o3.c + 5", "o3.a || 'I'")])} AS q2,
    {_least([("o3 IS NOT NULL", "o3.c", "o3.a"), ("o2 IS NOT NULL", "o2.c + 5", "o2.a || 'I'"), ("o0 IS NOT NULL", "o0.c + 10", "o0.a || 'II'"), ("o1 IS NOT NULL", "o1.c + 10", "o1.a || 'II'")])} AS q3"""
_ITEM = "STRUCT(c BIGINT, a VARCHAR)"

OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS d
  FROM conversations, t
), e AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM k WHERE d <> 0
), f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, role[1] AS initial, {_END} AS stem FROM e
), g AS (
  SELECT *, CASE WHEN stem = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(stem, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    i > 1 AND concat(lag(initial) OVER (PARTITION BY conv_id ORDER BY i), initial) NOT IN ('su', 'ua', 'au') AS illegal
  FROM f
), c AS (
  {_STEP} FROM (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': ''}} AS {_ITEM}) AS o0, CAST(NULL AS {_ITEM}) AS o1, CAST(NULL AS {_ITEM}) AS o2, CAST(NULL AS {_ITEM}) AS o3 FROM g)
  UNION ALL
  {_STEP} FROM (
    SELECT c.conv_id, g.i, {_scan("q0", [])} AS o0, {_scan("q1", [("q0", "s")])} AS o1, {_scan("q2", [("q0", "u"), ("q1", "u"), ("q3", "u")])} AS o2, {_scan("q3", [("q2", "a")])} AS o3
    FROM c JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id AND g.i = c.i + 1)
), z AS (
  SELECT conv_id, arg_max(list_min([q0, q3]), i) AS best FROM c GROUP BY conv_id
), w AS (
  SELECT conv_id, x, substr(best.a, x, 1) AS edit, length(replace(best.a, 'D', '')) AS turns, length(replace(substr(best.a, 1, x), 'I', '')) AS i,
    length(replace(substr(best.a, 1, x), 'D', '')) AS turn
  FROM z, unnest(range(1, length(best.a) + 1)) r(x)
), y AS (
  SELECT w.conv_id, string_agg(concat(CASE WHEN edit = 'K' THEN g.role WHEN (turns - w.turn) % 2 = 0 THEN 'assistant' ELSE 'user' END, ':', CASE WHEN edit <> 'I' THEN g.text END), chr(10) ORDER BY x) AS repaired
  FROM w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i WHERE edit <> 'D' GROUP BY w.conv_id
), h AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM g GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM o.conv_id
"""

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_gated_lm, op3_mix_sources, op4_decontaminate, op5_line_dedup, op6_ngram_join, op7_suffix_dedup, op8_top_k, op9_language_id, op10_surrogates, op11_merkle_manifest, op12_gray_simhash, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_decontaminate": OP4_SQL, "op6_ngram_join": OP6_SQL, "op8_top_k": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op13_conversation_repair": OP13_SQL}
