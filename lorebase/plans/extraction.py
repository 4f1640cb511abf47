"""Queries of blocks, tables, fact blocks, timelines, references and sections."""

from pyspark.sql import functions as F

from lorebase.operators import blocks as b
from lorebase.operators import extraction as x
from lorebase.operators import ingest as i
from lorebase.operators import tables as tb
from lorebase.plans.catalog import query

_SIZE = "CAST(p_size AS VARCHAR)"
_KEY = "CAST(p_partkey AS VARCHAR)"


@query("x1_chunk_documents", "documents")
def x1(documents):
    return b.chunk_documents(b.blocks_of_lines(documents))


@query("x1_chunk_pages", "pages")
def x1b(pages):
    return b.chunk_documents(b.blocks_of_html(pages.select(F.col("page_id").alias("doc_id"), "html")))


@query("x3_split_oversized", "documents")
def x3(documents):
    return b.chunk_documents(b.blocks_of_lines(documents), hard_cjk=60, hard_ascii=80)


@query("s4_block_stats", "pages", oracle=r"""
WITH t AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '(?is)<h1\b[^>]*>.*?</h1>')) AS raw FROM pages), h AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
a AS (SELECT page_id AS doc_id, len(regexp_extract_all(html, '(?is)<p\b[^>]*>.*?</p>')) + len(regexp_extract_all(html, '(?is)<li\b[^>]*>.*?</li>')) AS others FROM pages)
SELECT a.doc_id, CAST(1 AS BIGINT) AS pages, CAST(others + coalesce(n, 0) AS BIGINT) AS blocks, CAST(0 AS BIGINT) AS tables, CAST(coalesce(n, 0) AS BIGINT) AS titles FROM a LEFT JOIN h USING (doc_id) WHERE others + coalesce(n, 0) > 0""")
def s4b(pages):
    return b.peek(b.blocks_of_html(pages.select(F.col("page_id").alias("doc_id"), "html"))).drop("first_titles")


def _tables(blocks):
    return tb.extract_tables(blocks)


@query("x5_extract_tables", "fx_table_blocks", oracle=f"""
WITH g AS (SELECT 3000000 + p_partkey AS doc_id, 't1' AS table_id, CASE p_partkey % 3 WHEN 0 THEN [['Item', 'FY24A', 'FY25E', 'Unit'], ['GM (%)', {_SIZE} || '%', 'n/a', ''], ['Sales', '1,2' || CAST(p_size + 10 AS VARCHAR), '$' || {_SIZE} || ' bn', 'USD bn']]
 ELSE [['Company', 'Metric', 'Period', 'Value'], ['[[concepts/part-' || {_KEY} || '|P]]', 'Unit Price', 'FY26E', {_SIZE} || 'x'], ['[[concepts/part-' || {_KEY} || '|P]]', 'R&D', 'current', 'about ' || {_SIZE}]] END AS g FROM part WHERE p_partkey % 3 < 2
 UNION ALL SELECT 3000000 + p_partkey, 't2', [['A|B', 'A|B'], [{_SIZE}, '']] FROM part),
r AS (SELECT doc_id, table_id, unnest(g) AS cells, generate_subscripts(g, 1) AS r FROM g)
SELECT doc_id, table_id, CAST(r - 2 AS INTEGER) AS row_index, CAST(generate_subscripts(cells, 1) - 1 AS INTEGER) AS column_index, unnest(cells) AS cell FROM r""")
def x5(blocks):
    return tb.table_cells(_tables(blocks))


@query("x6_render_table_markdown", "fx_table_blocks", oracle=f"""
SELECT 3000000 + p_partkey AS doc_id, 't2' AS table_id, '| A\\|B | A\\|B |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {_SIZE} || ' |  |' AS raw_markdown, CAST(1 AS INTEGER) AS row_count, CAST(2 AS INTEGER) AS column_count FROM part
UNION ALL SELECT 3000000 + p_partkey, 't1', CASE p_partkey % 3 WHEN 0 THEN '| Item | FY24A | FY25E | Unit |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| GM (%) | ' || {_SIZE} || '% | n/a |  |' || chr(10) || '| Sales | 1,2' || CAST(p_size + 10 AS VARCHAR) || ' | $' || {_SIZE} || ' bn | USD bn |'
 ELSE '| Company | Metric | Period | Value |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| [[concepts/part-' || {_KEY} || '\\|P]] | Unit Price | FY26E | ' || {_SIZE} || 'x |' || chr(10) || '| [[concepts/part-' || {_KEY} || '\\|P]] | R&D | current | about ' || {_SIZE} || ' |' END, 2, 4 FROM part WHERE p_partkey % 3 < 2""")
def x6(blocks):
    return tb.table_markdown(_tables(blocks)).select("doc_id", "table_id", "raw_markdown", "row_count", "column_count")


@query("x10_facts_from_explicit_tables", "fx_table_blocks", oracle=f"""
SELECT 3000000 + p_partkey AS doc_id, 't1' AS table_id, CAST(0 AS INTEGER) AS row_index, 'concepts/part-' || {_KEY} AS entity, 'unit_price' AS metric, 'FY2026E' AS period, CAST(p_size AS DOUBLE) AS value_numeric, CAST(NULL AS VARCHAR) AS value_text, 'x' AS unit, 'r0c3' AS cell_ref, 'Metric > Value' AS header_path FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT 3000000 + p_partkey, 't1', 1, 'concepts/part-' || {_KEY}, 'r_and_d', 'current', NULL, 'about ' || {_SIZE}, NULL, 'r1c3', 'Metric > Value' FROM part WHERE p_partkey % 3 = 1""")
def x10(blocks):
    none = blocks.select("doc_id", F.lit(None).cast("string").alias("entity")).distinct()
    return tb.facts_from_explicit_tables(_tables(blocks), none).select("doc_id", "table_id", "row_index", "entity", "metric", "period", "value_numeric", "value_text", "unit", "cell_ref", "header_path")


@query("x11_facts_from_matrix_tables", "fx_table_blocks", oracle=f"""
WITH f AS (SELECT p_partkey, p_size, unnest([{{'r': 0, 'c': 1}}, {{'r': 1, 'c': 1}}, {{'r': 1, 'c': 2}}]) AS x FROM part WHERE p_partkey % 3 = 0)
SELECT 3000000 + p_partkey AS doc_id, 't1' AS table_id, CAST(x.r AS INTEGER) AS row_index, CAST(x.c AS INTEGER) AS column_index, 'concepts/part-' || {_KEY} AS entity, CASE x.r WHEN 0 THEN 'gross_margin' ELSE 'revenue' END AS metric, CASE x.c WHEN 1 THEN 'FY2024A' ELSE 'FY2025E' END AS period,
 CAST(CASE WHEN x.r = 0 THEN p_size WHEN x.c = 1 THEN CAST('12' || CAST(p_size + 10 AS VARCHAR) AS INTEGER) ELSE p_size END AS DOUBLE) AS value_numeric, CASE x.r WHEN 0 THEN 'pct' ELSE 'usd_bn' END AS unit, CASE x.c WHEN 1 THEN 'FY24A' ELSE 'FY25E' END AS period_header FROM f""")
def x11(blocks):
    own = blocks.select("doc_id", F.concat(F.lit("concepts/part-"), (F.col("doc_id") - 3000000).cast("string")).alias("entity")).distinct()
    return tb.facts_from_matrix_tables(_tables(blocks), own).select("doc_id", "table_id", "row_index", "column_index", "entity", "metric", "period", "value_numeric", "unit", "period_header")


@query("f8_table_artifact", "fx_table_blocks", oracle="SELECT 3000000 + p_partkey AS doc_id, 't2' AS table_id FROM part UNION ALL SELECT 3000000 + p_partkey, 't1' FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 2 = 0")
def f8(blocks):
    even = blocks.select("doc_id").distinct()
    wanted = even.select("doc_id", F.when(F.col("doc_id") % 2 == 1, "t2").alias("table_id"))
    return tb.table_artifact(_tables(blocks), wanted).select("doc_id", "table_id")


@query("x9_parse_fact_blocks", "fx_fact_pages", oracle=f"""
SELECT 3000000 + p_partkey AS page_id, CAST(0 AS INTEGER) AS pos, 'companies/supplier-' || CAST(p_partkey % 100 AS VARCHAR) AS entity, 'weight' AS metric, '2024' AS period, {_SIZE} AS value, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS VARCHAR) AS source_quote FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT 3000000 + p_partkey, 2, 'concepts/part-' || {_KEY}, 'share', NULL, '>' || {_SIZE} || '%', NULL, 'up: ' || {_SIZE} FROM part WHERE p_partkey % 7 <> 0""")
def x9(pages):
    return x.parse_fact_blocks(pages)


@query("x15_validate_proposed_facts", "fx_fact_pages", oracle=f"""
SELECT 3000000 + p_partkey AS page_id, CASE WHEN p_partkey % 5 = 1 THEN 'entity' WHEN p_partkey % 5 = 2 THEN 'schema' WHEN p_partkey % 5 = 3 THEN 'hallucinated' WHEN p_partkey % 5 = 4 THEN 'duplicate' END AS reason, CASE WHEN p_partkey % 5 = 0 THEN 0.7 END::DOUBLE AS confidence FROM part""")
def x15(pages):
    k = (F.col("page_id") - 3000000) % 5
    linked = F.concat(F.lit("companies/supplier-"), ((F.col("page_id") - 3000000) % 100).cast("string"))
    proposed = pages.select(
        "page_id", F.lit(0).alias("pos"), F.when(k == 1, "companies/elsewhere").otherwise(linked).alias("entity"), F.when(k == 2, "comment").otherwise("weight").alias("metric"), F.lit(" 2024 ").alias("period"),
        F.lit("~20%").alias("value"), F.lit("kg").alias("unit"), F.when(k == 3, "the part is blue").otherwise("SEE  [[companies").alias("source_quote"),
    )
    there = pages.where(k == 4).select("page_id", linked.alias("entity"), F.lit("weight").alias("metric"), F.lit("2024").alias("period"))
    return x.judge_proposed_facts(proposed, pages, there).select("page_id", "reason", "confidence")


@query("x16_evidence_context", "fx_fact_pages", oracle=f"""
WITH v AS (SELECT 3000000 + p_partkey AS fact_id, 'See [[companies/supplier-' || CAST(p_partkey % 100 AS VARCHAR) || '|confirms: S one]] and [the part](../concepts/part-' || {_KEY} || '.md) (weight ' || {_SIZE} || ' kg) here.' AS line, p_partkey, p_size FROM part)
SELECT fact_id, CASE WHEN p_partkey % 2 = 1 THEN 'nowhere to be found' ELSE '...' || trim(substr(line, position('(weight ' IN line) + 1 - 20)) END AS context FROM v""")
def x16(pages):
    k = F.col("page_id") - 3000000
    facts = pages.select(F.col("page_id").alias("fact_id"), "page_id", F.when(k % 2 == 1, "nowhere to be found").otherwise(F.regexp_extract("content", r"(weight \d+ kg)", 1)).alias("source_quote"))
    return x.evidence_context(facts, pages, 20)


_HARVEST = f"""h AS (SELECT p_partkey, 3000000 + p_partkey AS page_id, 'companies/supplier-' || CAST(p_partkey % 100 AS VARCHAR) AS slug, 'S one' AS alias, 'confirms' AS link_type, 'markdown' AS source, CAST(NULL AS VARCHAR) AS origin_field FROM part
UNION ALL SELECT p_partkey, 3000000 + p_partkey, 'concepts/part-' || {_KEY}, 'the part', 'mention', 'markdown', NULL FROM part
UNION ALL SELECT p_partkey, 3000000 + p_partkey, 'concepts/part-' || {_KEY}, NULL, 'mention', 'frontmatter', 'primary_entities' FROM part
UNION ALL SELECT p_partkey, 3000000 + p_partkey, unnest(['companies/supplier-' || CAST(p_partkey % 100 AS VARCHAR), 'concepts/part-' || {_KEY}]), NULL, 'mention', 'extracted', 'facts_block' FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT p_partkey, 3000000 + p_partkey, 'companies/supplier-' || CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE '00000000' || CAST(p_partkey % 10 AS VARCHAR) END, NULL, 'mention', 'extracted', 'timeline_block' FROM part)"""


@query("x7_harvest_references", "fx_fact_pages", oracle=f"WITH {_HARVEST} SELECT page_id, slug, alias, link_type, source, origin_field FROM h")
def x7b(pages):
    return x.harvest_references(pages).drop("context")


@query("x8_link_context", "fx_fact_pages", oracle=f"""
WITH l AS (SELECT 3000000 + p_partkey AS page_id, 'companies/supplier-' || CAST(p_partkey % 100 AS VARCHAR) AS slug, 'See [[companies/supplier-' || CAST(p_partkey % 100 AS VARCHAR) || '|confirms: S one]]' AS head, ' and [the part](../concepts/part-' || {_KEY} || '.md) (weight ' || {_SIZE} || ' kg) here.' AS tail, p_partkey, p_size FROM part)
SELECT page_id, slug, trim(head || substr(tail, 1, 30)) AS context FROM l""")
def x8(pages):
    return x.harvest_references(pages, 30).where("link_type = 'confirms'").select("page_id", "slug", "context")


@query("g3_build_typed_links", "fx_fact_pages", "fx_pages", oracle=f"""
WITH {_HARVEST}, r AS (SELECT h.page_id AS from_page_id, p.id AS to_page_id, link_type, source, origin_field, CASE WHEN origin_field LIKE '%_block' THEN 1.2 WHEN origin_field = 'primary_entities' THEN 1.0 WHEN link_type <> 'mention' THEN 1.0 ELSE 0.3 END AS w FROM h JOIN fx_pages p ON p.slug = h.slug AND p.deleted = 0)
SELECT from_page_id, to_page_id, link_type, source, origin_field, count(*) AS occurrences, CAST(max(w) AS DOUBLE) AS weight FROM r WHERE from_page_id <> to_page_id GROUP BY 1, 2, 3, 4, 5""")
def g3b(pages, known):
    refs = x.harvest_references(pages)
    return x.build_typed_links(refs, i.resolve_refs(refs, known.where("type = 'concept' OR slug LIKE 'companies/supplier-%'"))).drop("context")


@query("e21_unresolved_refs", "fx_fact_pages", "fx_pages", oracle=f"WITH {_HARVEST} SELECT slug, count(*) AS mentions, count(DISTINCT page_id) AS pages FROM h WHERE NOT EXISTS (SELECT 1 FROM fx_pages p WHERE p.slug = h.slug AND p.deleted = 0) GROUP BY 1")
def e21(pages, known):
    refs = x.harvest_references(pages)
    entities = known.where("type = 'company'")
    return x.unresolved_references(refs, i.resolve_refs(refs, known), entities.select("id", "title")).drop("suggestions")


@query("x17_parse_timeline", "fx_fact_pages", "fx_pages", oracle="""
WITH e AS (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN DATE '2024-01-01' ELSE DATE '2024-05-17' END AS day, 'companies/supplier-00000000' || CAST(p_partkey % 10 AS VARCHAR) AS slug, CASE p_partkey % 2 WHEN 0 THEN 'news' ELSE 'other' END AS event_type FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 < 2)
SELECT p.id AS entity_page_id, 3000000 + p_partkey AS source_page_id, day AS event_date, event_type, 'Part ' || CAST(p_partkey AS VARCHAR) || ' ships' AS summary, 'part: ' || CAST(p_size AS VARCHAR) || ' goes out' AS detail FROM e JOIN fx_pages p ON p.slug = e.slug AND p.deleted = 0
UNION ALL SELECT NULL, 3000000 + min(p_partkey), DATE '2024-07-01', 'guidance', 'Boost', NULL FROM part""")
def x17(pages, known):
    return x.parse_timeline(pages, known.where("deleted = 0").select("slug", "id"))


@query("x20_repair_sections", "fx_fact_pages", oracle=f"""
SELECT 3000000 + p_partkey AS page_id, '## Definition' || chr(10) || chr(10) || 'Is ' || {_SIZE} || chr(10) || chr(10) || '### Legacy Notes' || chr(10) || chr(10) || 'Old intro' || chr(10) || chr(10) || '### Notes' || chr(10) || chr(10) || 'more' || chr(10) || chr(10) || '## Use In Investment Research' || chr(10) || chr(10) || 'Structural repair placeholder: no additional source-backed detail was present in the legacy narrative for this section.'
 || chr(10) || chr(10) || '## Related Concepts' || chr(10) || chr(10) || 'Structural repair placeholder: no additional source-backed detail was present in the legacy narrative for this section.' || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || 's1' || chr(10) || chr(10) || '## Updates' || chr(10) || chr(10) || 'u1' || chr(10) AS content, true AS changed FROM part""")
def x20(pages):
    size = F.regexp_extract("content", r"weight (\d+) kg", 1)
    old = F.concat(F.lit("Old intro\n\n## Updates\n\nu1\n\n## sources\n\ns1\n\n## Notes\n\nmore\n\n## Definition\n\nIs "), size)
    return x.repair_sections(pages.select("page_id", F.lit("concept").alias("type"), old.alias("content")))


@query("x22_embed", "documents")
def x22(documents):
    return x.embed_chunks(documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("input")), x.hashing_embedder(), "2024-02-01")
