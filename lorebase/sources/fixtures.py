"""The knowledge-base tables derived from the TPC-style tables, in SQL that Spark and DuckDB both read.

`{name}` stands for a table; a derivation may use other derivations.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_LINES = """
SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       l_discount, l_returnflag, CAST(l_shipdate AS DATE) AS ship_date FROM {lineitem}
"""

DERIVED = {
    "fx_lines": _LINES,
    "fx_pages": """
SELECT 1000000 + s_suppkey AS id, 'src' AS source_id, 'companies/' || replace(lower(s_name), '#', '-') AS slug, 'company' AS type, s_name AS title,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS display_name, 'Makes ring [[concepts/part-' || CAST(s_suppkey AS STRING) || ']] Source: [[sources/order-' || CAST(s_suppkey AS STRING) || ']]' AS content,
       s_name || ',S' || CAST(s_suppkey % 40 AS STRING) AS alias_csv, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 7 = 1 THEN 'bad ticker' ELSE 'T' || CAST(s_suppkey % 50 AS STRING) END AS ticker,
       CASE WHEN s_suppkey % 4 = 0 THEN 'NYSE' END AS exchange, CASE WHEN s_suppkey % 2 = 0 THEN 'tech' END AS sector,
       CASE s_suppkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
       CASE s_suppkey % 3 WHEN 0 THEN 'stub' WHEN 1 THEN 'candidate_promoted' ELSE 'compiled' END AS entity_state,
       CAST(s_suppkey % 10 AS DOUBLE) / 10 AS completeness_score, DATE '1995-01-01' AS create_date, DATE '1996-06-30' AS update_date, 0 AS deleted FROM {supplier}
UNION ALL SELECT 2000000 + n_nationkey, 'src', 'industries/' || replace(lower(n_name), '_', '-'), 'industry', n_name, n_name, 'An industry.', n_name, NULL, NULL, NULL, 'medium', 'compiled', 0.5, DATE '1995-01-01', DATE '1996-06-30', 0 FROM {nation}
UNION ALL SELECT 3000000 + p_partkey, 'src', 'concepts/part-' || CAST(p_partkey AS STRING), 'concept', p_name || ' ' || p_brand || ' ' || p_type, NULL, p_name || ' is a part of ' || p_brand, p_name || ',' || p_brand, NULL, NULL, NULL,
       CASE p_size % 2 WHEN 0 THEN 'low' ELSE 'medium' END, CASE p_size % 3 WHEN 0 THEN 'stub' WHEN 1 THEN 'candidate_promoted' ELSE 'compiled' END, CAST(p_size % 10 AS DOUBLE) / 10, DATE '1995-01-01', DATE '1996-06-30', CASE WHEN p_size = 50 THEN 1 ELSE 0 END FROM {part}
UNION ALL SELECT 6000000 + o_orderkey, 'src', 'sources/order-' || CAST(o_orderkey AS STRING), 'source', 'Order ' || CAST(o_orderkey AS STRING), NULL, 'Order of ' || o_orderpriority, '', NULL, NULL, NULL, 'medium', 'compiled', 0.0, CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE), 0 FROM {orders}
""",
    "fx_lead_pages": """
SELECT 5000000 + c_custkey AS id, 'src' AS source_id, 'companies/lead-' || CAST(c_custkey AS STRING) AS slug, CASE c_custkey % 11 WHEN 3 THEN 'output' WHEN 5 THEN 'concept' ELSE 'company' END AS type, c_name AS title, CAST(NULL AS STRING) AS display_name,
       CASE WHEN c_custkey % 13 = 0 THEN CAST(NULL AS STRING) WHEN c_custkey % 7 = 0 THEN repeat('Words on the lead. ', 20) ELSE 'A lead.' END AS content, c_name || ',L' || CAST(c_custkey AS STRING) AS alias_csv, CASE WHEN c_nationkey = 4 THEN 'T1' END AS ticker, CAST(NULL AS STRING) AS exchange, CAST(NULL AS STRING) AS sector,
       'low' AS confidence, CASE c_nationkey % 5 WHEN 0 THEN 'compiled' WHEN 1 THEN 'candidate_promoted' ELSE 'stub' END AS entity_state, 0.0 AS completeness_score, DATE '1995-01-01' AS create_date, DATE '1996-06-30' AS update_date, CASE WHEN c_nationkey = 9 THEN 1 ELSE 0 END AS deleted FROM {customer}
""",
    "fx_lead_links": """
SELECT 900000000 + o_orderkey AS id, 6000000 + o_orderkey AS from_page_id, 5000000 + o_custkey AS to_page_id, CASE WHEN o_orderkey % 5 = 0 THEN 'confirms' ELSE 'mention' END AS link_type, 'markdown' AS link_source, CAST(NULL AS STRING) AS origin_field, 0.3 AS weight,
       CAST(o_orderdate AS DATE) AS create_time, CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS deleted FROM {orders} WHERE o_custkey % 5 < 2
UNION ALL SELECT 990000000 + c_custkey, 5000000 + c_custkey, 5000000 + c_custkey, 'cites', 'manual', NULL, 1.0, DATE '1995-01-01', 0 FROM {customer} WHERE c_custkey % 5 = 1
""",
    "fx_lead_theses": """
SELECT 8000000 + c_custkey AS page_id, 5000000 + c_custkey AS target_page_id, 'long' AS direction, 'active' AS status, c_name AS title, 0 AS unresolved_conditions, 1 AS conviction_rank, DATE '2024-01-01' AS update_date FROM {customer} WHERE c_custkey % 6 = 0
""",
    "fx_links": """
SELECT line_id AS id, 6000000 + l_orderkey AS from_page_id, 3000000 + l_partkey AS to_page_id, CASE l_returnflag WHEN 'R' THEN 'contradicts' WHEN 'A' THEN 'confirms' ELSE 'mention' END AS link_type,
       CASE l_linenumber % 4 WHEN 0 THEN 'frontmatter' WHEN 1 THEN 'markdown' WHEN 2 THEN 'extracted' ELSE 'manual' END AS link_source,
       CASE WHEN l_linenumber % 4 = 0 THEN 'primary_entities' WHEN l_quantity > 25 THEN 'facts_block' END AS origin_field,
       CAST(l_linenumber % 4 AS DOUBLE) * 0.3 AS weight, ship_date AS create_time, CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END AS deleted FROM {fx_lines}
""",
    "fx_facts": """
SELECT line_id AS id, 3000000 + l_partkey AS entity_page_id, CASE WHEN l_linenumber % 2 = 1 THEN 'unit_price' ELSE 'gross_margin' END AS metric, 'FY' || CAST(year(ship_date) AS STRING) AS period,
       CASE WHEN l_quantity = 50 THEN NULL WHEN l_linenumber % 2 = 1 THEN floor(l_extendedprice / l_quantity * 100) / 100 ELSE l_discount END AS value_numeric, 6000000 + l_orderkey AS source_page_id,
       ship_date AS valid_from, CASE WHEN l_returnflag = 'R' THEN ship_date + 30 END AS valid_to, CASE WHEN l_linenumber % 4 = 1 THEN 't1' END AS table_id, 0 AS deleted FROM {fx_lines}
""",
    "fx_timeline": """
SELECT o_orderkey AS id, 1000000 + o_custkey % (SELECT count(*) FROM {supplier}) AS entity_page_id, 6000000 + o_orderkey AS source_page_id, CAST(o_orderdate AS DATE) AS event_date,
       CASE o_orderstatus WHEN 'F' THEN 'earnings' WHEN 'O' THEN 'guidance' ELSE 'news' END AS event_type, o_orderpriority AS summary, 0 AS deleted FROM {orders}
""",
    "fx_signals": """
SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'consensus_drift' ELSE 'thesis_validation' END AS signal_type, 1000000 + user_id % (SELECT count(*) FROM {supplier}) AS entity_page_id,
       CASE WHEN user_id % 3 = 0 THEN NULL ELSE 4000000 + user_id END AS thesis_page_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 6000000 + user_id END AS source_page_id,
       CASE WHEN value > 150 THEN 'critical' WHEN value > 75 THEN 'warning' ELSE 'info' END AS severity, ts AS detected_at, 0 AS deleted FROM {events} WHERE event_type = 'error'
""",
    "fx_theses": """
SELECT 4000000 + c_custkey AS page_id, 1000000 + c_custkey % (SELECT count(*) FROM {supplier}) AS target_page_id, CASE WHEN c_acctbal < 0 THEN 'short' ELSE 'long' END AS direction,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'MACHINERY' THEN 'monitoring' ELSE 'closed' END AS status, c_name AS title, c_nationkey % 5 AS unresolved_conditions, c_nationkey AS conviction_rank,
       DATE '2024-01-01' + CAST(c_custkey % 28 AS INT) AS update_date FROM {customer}
""",
    "fx_events": """
SELECT event_id AS id, ts, CASE WHEN user_id % 3 = 0 THEN 'agent:a' ELSE 'system:b' END AS actor, CASE event_type WHEN 'view' THEN 'enrich' WHEN 'purchase' THEN 'page_review' ELSE event_type END AS action,
       1000000 + user_id % (SELECT count(*) FROM {supplier}) AS entity_id, CASE WHEN value > 80 THEN 'fail' ELSE 'pass' END AS status, event_id % 5 + 4 AS stage, value FROM {events}
""",
    "fx_usage": """
SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'embedding' WHEN 'click' THEN 'agent_runtime' ELSE event_type END AS source, 'm' || CAST(user_id % 3 AS STRING) AS model, CAST(floor(value * 10) AS BIGINT) AS tokens_in,
       CAST(floor(value) AS BIGINT) AS tokens_out, user_id AS job_id, ts AS create_time FROM {events}
""",
    "fx_jobs": """
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'agent_run' WHEN 1 THEN 'embed_chunks' ELSE 'enrich_entity' END AS name, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'waiting' ELSE 'active' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) END AS skill, 1000000 + o_custkey % (SELECT count(*) FROM {supplier}) AS target_page_id, CAST(o_orderdate AS DATE) AS create_date FROM {orders}
""",
    "fx_raw_files": """
SELECT doc_id AS id, 'r' || CAST(doc_id AS STRING) AS research_id, source AS research_type, substr(text, 1, 40) AS title, CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'commit' ELSE 'pass' END AS triage_decision,
       CASE WHEN doc_id % 4 = 2 THEN 6000001 + doc_id END AS ingested_page_id, DATE '2024-01-01' + CAST(doc_id % 28 AS INT) AS create_date FROM {documents}
""",
    "fx_chunks": """
SELECT doc_id AS id, 7000000 + doc_id % 50 AS page_id, CAST(floor(doc_id / 50) AS BIGINT) AS chunk_index, text AS chunk_text, CASE WHEN doc_id % 17 = 0 THEN 'compiled_truth' ELSE 'text' END AS chunk_type FROM {documents}
""",
    "fx_tags": """
SELECT c_custkey AS id, 1000000 + c_custkey % (SELECT count(*) FROM {supplier}) AS page_id, c_mktsegment AS tag, CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS deleted FROM {customer}
""",
    "fx_merges": """
SELECT id AS old, id - 1 AS new FROM {fx_pages} WHERE id % 2 = 1 AND type IN ('company', 'concept')
""",
    "fx_table_blocks": """
SELECT 3000000 + p_partkey AS doc_id, 0 AS page_idx, 0 AS block_idx, 'table' AS type, CAST(NULL AS INT) AS level, CAST(NULL AS STRING) AS text, CASE p_partkey % 3
 WHEN 0 THEN '<table><tr><td>Item</td><td>FY24A</td><td>FY25E</td><td>Unit</td></tr><tr><td>GM (%)</td><td>' || CAST(p_size AS STRING) || '%</td><td>n/a</td><td></td></tr><tr><td>Sales</td><td>1,2' || CAST(p_size + 10 AS STRING) || '</td><td>$' || CAST(p_size AS STRING) || ' bn</td><td>USD bn</td></tr></table>'
 WHEN 1 THEN '<table><tr><th>Company</th><th>Metric</th><th>Period</th><th>Value</th></tr><tr><td rowspan="2">[[concepts/part-' || CAST(p_partkey AS STRING) || '|P]]</td><td>Unit Price</td><td>FY26E</td><td>' || CAST(p_size AS STRING) || 'x</td></tr><tr><td>R&amp;D</td><td>current</td><td><b>about</b> ' || CAST(p_size AS STRING) || '</td></tr></table>'
 ELSE '<table></table>' END AS html FROM {part}
UNION ALL SELECT 3000000 + p_partkey, 1, 0, 'table', NULL, NULL, '<table><tr><td colspan="2">A|B</td></tr><tr><td>' || CAST(p_size AS STRING) || '</td></tr></table>' FROM {part}
""",
    "fx_fact_pages": """
SELECT 3000000 + p_partkey AS page_id, 'concept' AS type, 'See [[companies/supplier-' || CAST(p_partkey % 100 AS STRING) || '|confirms: S one]] and [the part](../concepts/part-' || CAST(p_partkey AS STRING) || '.md) (weight ' || CAST(p_size AS STRING) || ' kg) here.' || chr(10) || chr(10)
 || CASE WHEN p_partkey % 7 = 0 THEN '<!-- facts' || chr(10) || 'facts: [' || chr(10) || '-->' ELSE '<!-- facts' || chr(10) || '- entity: companies/supplier-' || CAST(p_partkey % 100 AS STRING) || chr(10) || '  metric: weight' || chr(10) || '  value: ' || CAST(p_size AS STRING) || chr(10) || '  period: 2024  # year' || chr(10) || '  note: |' || chr(10) || '    - not: a record' || chr(10) || '      at all' || chr(10)
 || '- metric: lost' || chr(10) || '  value: 1' || chr(10) || '- entity: concepts/part-' || CAST(p_partkey AS STRING) || chr(10) || '  metric: share' || chr(10) || '  value: ">' || CAST(p_size AS STRING) || '%"' || chr(10) || '  source_quote: "up: ' || CAST(p_size AS STRING) || '"' || chr(10) || '  by: ' || chr(123) || 'who: [a, "b: c",' || chr(10) || '    d], n: 1' || chr(125) || chr(10) || '-->' END AS content,
 chr(123) || '"primary_entities":["concepts/part-' || CAST(p_partkey AS STRING) || '","none"],"research_id":"r' || CAST(p_partkey AS STRING) || '"' || chr(125) AS frontmatter,
 '- entity: companies/supplier-' || CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE '00000000' || CAST(p_partkey % 10 AS STRING) END || chr(10) || '  date: ' || CASE p_partkey % 3 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-05-17' ELSE 'soon' END || chr(10) || '  event_type: ' || CASE p_partkey % 2 WHEN 0 THEN 'news' ELSE 'party' END || chr(10) || '  summary: Part ' || CAST(p_partkey AS STRING) || ' ships' || chr(10) || '  detail: >-' || chr(10) || '    part: ' || CAST(p_size AS STRING) || chr(10) || '    goes out' || chr(10) || '  metadata:' || chr(10) || '  - k: [1, 2]'
 || chr(10) || '- date: 2024-07-01' || chr(10) || '  event_type: guidance' || chr(10) || '  summary: Boost' AS timeline FROM {part}
""",
    "fx_narratives": """
SELECT 6000000 + l_orderkey AS page_id, line_id, 'Supplier [[companies/supplier-' || CAST(l_suppkey AS STRING) || '|confirms: S' || CAST(l_suppkey AS STRING) || ']] ships [[concepts/part-' || CAST(l_partkey AS STRING) || ']] in FY' || CAST(year(ship_date) AS STRING) || '.' AS content FROM {fx_lines}
""",
    "fx_mentions": """
SELECT event_id AS id, 'companies/' || CASE user_id % 7 WHEN 0 THEN 'unknown-' WHEN 1 THEN 'major-' ELSE 'firm-' END || CAST(user_id AS STRING) AS slug, 6000001 + event_id % 997 AS source_page_id, event_type AS alias FROM {events}
""",
    "fx_comments": """
SELECT conv_id * 100 + turn AS id, 1000000 + conv_id % (SELECT count(*) FROM {supplier}) AS page_id, role AS author, text AS content, CASE WHEN turn % 2 = 0 THEN 'narrative_gap' ELSE 'fact_correction' END AS intent,
       DATE '2024-01-01' + CAST(conv_id % 28 AS INT) AS create_date FROM {conversations}
""",
    "fx_cells": """
SELECT line_id AS id, l_linenumber AS row_index, CASE l_linenumber % 6 WHEN 0 THEN '$' || CAST(CAST(l_quantity AS INT) AS STRING) || ' bn' WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '%' WHEN 2 THEN 'n/a'
       WHEN 3 THEN '1,2' || CAST(CAST(l_quantity AS INT) + 10 AS STRING) WHEN 4 THEN CAST(CAST(l_quantity AS INT) AS STRING) || 'x' ELSE '**about** ' || l_returnflag END AS cell,
       CASE l_linenumber % 5 WHEN 0 THEN 'GM (%)' WHEN 1 THEN 'Revenue & other' WHEN 2 THEN 'rev' WHEN 3 THEN 'Unit Price' ELSE 'op_margin' END AS metric_cell,
       CASE l_linenumber % 6 WHEN 0 THEN 'FY' || CAST(year(ship_date) % 10 + 20 AS STRING) || 'E' WHEN 1 THEN '1q' || CAST(year(ship_date) % 10 + 20 AS STRING) || 'a' WHEN 2 THEN 'TTM' WHEN 3 THEN 'h126e' WHEN 4 THEN 'current' ELSE CAST(year(ship_date) AS STRING) END AS period_cell
FROM {fx_lines}
""",
}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table as it is stored, or a derived one as a lazy plan over the base tables it uses."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = DERIVED[name]
    used = dict.fromkeys(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{t: derive(spark, sf_dir, t) for t in used})


def with_derivations(sql: str) -> str:
    """DuckDB SQL with the derivations it uses as common table expressions in front."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for t in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if t not in wanted:
                need(DERIVED[t])
                wanted.append(t)

    need(sql)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{t} AS ({re.sub(r'[{}]', '', DERIVED[t])})" for t in wanted)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    body = ", " + sql[head.end() :] if head else "\n" + sql
    return f"WITH {'RECURSIVE ' if head and head[1] else ''}{ctes}{body}"
