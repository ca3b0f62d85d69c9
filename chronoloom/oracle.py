"""The adapters of ``sources.tables`` in SQL, as common table expressions."""

from __future__ import annotations

UNIT = "(CAST(concat('0x', substr(md5({}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def unit(*parts: str) -> str:
    """Uniform on [0, 1) from SQL expressions joined by '|'."""
    return UNIT.format("concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")")


def key(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


CTES = {
    "nodes": """nodes AS (
  SELECT company_id, name, industry_1st, industry_2nd, embedding FROM (
    SELECT s_suppkey AS company_id, s_name AS name, 'S_' || s_nationkey AS industry_1st,
      CASE WHEN s_suppkey % 2 = 0 THEN 'S_' || ((s_nationkey + 7) % 25) END AS industry_2nd FROM supplier
    UNION ALL
    SELECT 1000000 + c_custkey, c_name, c_mktsegment || '_' || c_nationkey,
      CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '_' || ((c_nationkey + 7) % 25) END FROM customer
  ) LEFT JOIN embeddings ON company_id % 17 <> 0 AND vec_id = company_id % (SELECT count(*) FROM embeddings)
)""",
    "edges": """edges AS (
  SELECT l_suppkey AS src, 1000000 + o_custkey AS tgt, CAST(year(o_orderdate) AS INTEGER) AS year,
    CASE l_returnflag WHEN 'A' THEN 'observed' WHEN 'R' THEN 'external' ELSE 'imputation' END AS source,
    CASE WHEN l_returnflag NOT IN ('A', 'R') THEN ((l_orderkey * 31 + l_linenumber * 17) % 1000) / 1000.0::DOUBLE END AS probability,
    CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 'm' || (l_linenumber % 2) END AS model
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)""",
    "embedded": "embedded AS (SELECT company_id FROM nodes WHERE embedding IS NOT NULL)",
    "pos": """pos AS (
  SELECT src, tgt, year FROM edges WHERE source = 'observed' AND year BETWEEN 1996 AND 2000
    AND src IN (SELECT company_id FROM embedded) AND tgt IN (SELECT company_id FROM embedded)
)""",
    "ext": """ext AS (
  SELECT src, tgt, year FROM edges WHERE source = 'external' AND year BETWEEN 1996 AND 2000
    AND src IN (SELECT company_id FROM embedded) AND tgt IN (SELECT company_id FROM embedded)
)""",
    "network": "network AS (SELECT DISTINCT c_mktsegment || '_' || c_nationkey AS downstream, 'S_' || c_nationkey AS upstream FROM customer)",
    "members": """members AS (
  SELECT DISTINCT industry, company_id FROM (
    SELECT industry_1st AS industry, company_id FROM nodes WHERE embedding IS NOT NULL
    UNION ALL SELECT industry_2nd, company_id FROM nodes WHERE embedding IS NOT NULL
  ) WHERE industry IS NOT NULL
)""",
    "scores": f"""scores AS (
  SELECT event_id AS sample_id, CAST(m AS INTEGER) AS model_id, label,
    round({unit("'p'", "m", "event_id")} * 0.7::DOUBLE + label * 0.3::DOUBLE * {unit("'q'", "event_id")}, 3) AS prob
  FROM (SELECT event_id, CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS label FROM events), range(0, 5) r(m)
)""",
    "samples": """samples AS (
  SELECT event_id AS sample_id, event_id * 7 % (SELECT count(*) FROM supplier) AS src,
    event_id * 13 % (SELECT count(*) FROM customer) + 1000000 AS tgt, CAST(event_id % 5 + 1996 AS INTEGER) AS year FROM events
)""",
    "log": """log AS (
  SELECT event_type AS model, user_id % 7 AS run_id, CASE WHEN user_id % 2 = 0 THEN 'fff' ELSE 'tff' END AS flag, event_id % 200 AS epoch,
    CASE event_id % 5 WHEN 0 THEN 'Test/Epoch_AUC' WHEN 1 THEN 'Test/Epoch_F1' WHEN 2 THEN 'Train/Epoch_Loss' WHEN 3 THEN 'Train/Batch_Loss' ELSE 'Monitor/Wasserstein_Diff' END AS tag,
    CAST(value AS DOUBLE) AS value, epoch_us(ts) / 1000000.0::DOUBLE AS wall_time
  FROM events
)""",
    "ensemble": "ensemble AS (SELECT sample_id, max(label) AS label, round(avg(prob), 6) AS prob FROM scores GROUP BY sample_id)",
}
_NEEDS = {"embedded": ["nodes"], "pos": ["nodes", "edges", "embedded"], "ext": ["nodes", "edges", "embedded"], "members": ["nodes"], "ensemble": ["scores"]}


def sql(body: str, *names: str, **more: str) -> str:
    """body after the named expressions, their prerequisites, and more."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    # each is used several times further on: evaluated once, not once for each use
    parts = [CTES[n].replace(" AS (", " AS MATERIALIZED (", 1) for n in order] + [f"{k} AS MATERIALIZED ({v})" for k, v in more.items()]
    return f"WITH {', '.join(parts)} {body}"
