"""Queries of intake and extraction."""

from pyspark.sql import functions as F

from lorebase.functions import text as t
from lorebase.operators import ingest as i
from lorebase.plans.catalog import query
from lorebase.sources.keyed import KeyedTable
from lorebase.sources.shared import shared_folder


@query("s1_load_active_pages", "fx_pages", oracle="SELECT id, slug, type FROM fx_pages WHERE deleted = 0")
def s1(pages):
    return pages.where("deleted = 0").select("id", "slug", "type")


@query("s2_sync_raw_files", "fx_raw_files", oracle="""
WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY research_type ORDER BY create_date DESC, research_id) AS INTEGER) AS rn FROM fx_raw_files)
SELECT research_id, research_type, create_date, rn FROM r WHERE rn <= 20 AND triage_decision <> 'commit'""")
def s2(raw):
    return i.sync_raw_files(raw.select("research_id", "research_type", "create_date"), raw.where("triage_decision = 'commit'"), 20)


@query("s3_pending_raw_files", "fx_raw_files", oracle="""
SELECT id, research_id, create_date FROM fx_raw_files WHERE ingested_page_id IS NULL AND (triage_decision = 'pending' OR (triage_decision = 'processing' AND create_date < DATE '2024-02-01' - 15)) ORDER BY create_date, id LIMIT 100""")
def s3(raw):
    return i.pending_raw_files(raw, "2024-02-01", 15, 100)


@query("s3_expired_leases", "fx_raw_files", oracle="""
WITH l AS (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-02-01 00:00:00' - (id % 60) * INTERVAL 1 MINUTE END AS leased_at FROM fx_raw_files)
SELECT id, research_id, create_date FROM l WHERE ingested_page_id IS NULL AND (triage_decision = 'pending' OR (triage_decision = 'processing' AND coalesce(leased_at < TIMESTAMP '2024-01-31 23:30:00', true))) ORDER BY create_date, id LIMIT 200""")
def s3b(raw):
    taken = F.lit("2024-02-01 00:00:00").cast("timestamp") - F.make_interval(mins=(F.col("id") % 60).cast("int"))
    return i.pending_raw_files(raw.withColumn("leased_at", F.when(F.col("id") % 5 != 0, taken)), "2024-02-01", 15, 200, ttl_minutes=30)


@query("s4_peek_stats", "documents", oracle="SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(len([x FOR x IN string_split(text, chr(10)) IF trim(x) <> '']) AS INTEGER) AS blocks, substr(text, 1, 1500) AS preview FROM documents")
def s4(documents):
    return i.peek_stats(documents)


@query("s5_page_skeleton", "fx_raw_files", oracle=r"""
SELECT research_id, 'sources/' || regexp_replace(concat_ws('-', research_type, research_id), '[^A-Za-z0-9_\-]+', '-', 'g') AS slug, trim(title) AS title, strftime(create_date, '%Y-%m-%d') AS publish_date, 'medium' AS confidence FROM fx_raw_files""")
def s5(raw):
    return i.page_skeleton(raw)


@query("s6_triage", "fx_raw_files", oracle="""
SELECT id, CASE WHEN id % 3 = 0 AND ingested_page_id IS NULL THEN 'brief' ELSE triage_decision END AS triage_decision, id % 3 = 0 AND ingested_page_id IS NULL AS changed FROM fx_raw_files""")
def s6(raw):
    return i.triage(raw, raw.where("id % 3 = 0").select("id", F.lit("brief").alias("decision"))).drop("skip_reason")


@query("s6_triage_events", "fx_raw_files", oracle="SELECT id AS entity_id, CASE WHEN id % 2 = 0 THEN 'triage_pass' ELSE 'triage_commit' END AS action FROM fx_raw_files WHERE ingested_page_id IS NULL AND id % 3 = 0")
def s6b(raw):
    d = raw.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "pass").otherwise("commit").alias("decision"), F.lit("dull").alias("reason"))
    return i.triage_events(i.triage(raw, d), "2024-02-01").select("entity_id", "action")


@query("s2_sync_range", "fx_raw_files", oracle="""
WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY research_type ORDER BY create_date DESC, research_id) AS INTEGER) AS rn FROM fx_raw_files WHERE id % 5 <> 0 AND id % 7 <> 0 AND create_date >= DATE '2024-01-05' AND create_date < DATE '2024-01-20')
SELECT research_id, research_type, create_date, rn FROM r WHERE rn <= 10 AND triage_decision <> 'commit'""")
def s2b(raw):
    up = raw.select("research_id", "research_type", "create_date", F.when(F.col("id") % 5 == 0, "failed").otherwise("completed").alias("parse_status"), F.when(F.col("id") % 7 != 0, "u").alias("markdown_url"))
    return i.sync_raw_files(up, raw.where("triage_decision = 'commit'"), 10, "2024-01-05", "2024-01-20")


@query("s5_page_frontmatter", "fx_raw_files", oracle="""
SELECT research_id, '{"research_id":"' || research_id || '","research_type":"' || research_type || '","publish_date":"' || strftime(create_date, '%Y-%m-%d') || '","original_url":"' || CASE WHEN id % 2 = 0 THEN 'o' ELSE 'u/x.md' END || '","file_type":"md"}' AS frontmatter FROM fx_raw_files""".replace("{", "' || chr(123) || '").replace("}", "' || chr(125) || '"))
def s5b(raw):
    return i.page_frontmatter(raw.select("research_id", "research_type", "create_date", F.when(F.col("id") % 2 == 0, "o").alias("original_url"), F.lit("u/x.md").alias("markdown_url"), F.lit(None).cast("string").alias("file_type")))


def _skipped(raw):
    """Tables after the pages of one kind of raw files were skipped: two start events a page, tags of some."""
    page = F.col("id") + 6000001
    done = raw.where("id % 4 <> 3")
    files = raw.drop("ingested_page_id").withColumns({"skip_reason": F.lit(None).cast("string"), "skipped_at": F.lit(None).cast("timestamp")})
    start = lambda df, file: df.select(F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("a").alias("actor"), F.lit("ingest_start").alias("action"), page.alias("entity_id"), F.to_json(F.struct(file.cast("string").alias("rawFileId"))).alias("payload"))
    tables = {
        "pages": raw.select(page.alias("id"), F.lit("active").alias("status"), F.lit(0).alias("deleted")), "raw_files": files,
        "events": start(done, F.col("id")).unionByName(start(done.where("id % 2 = 0"), F.col("id") + 5)),
        "tags": raw.where("id % 3 = 0").select("id", page.alias("page_id"), F.lit("t").alias("tag"), (F.col("id") % 2).cast("int").alias("deleted")),
    }
    return i.skip_ingested(tables, raw.where("research_type = 'src2'").select(page.alias("id")), "dull", "2024-02-01")


@query("s7_skip_ingested_files", "fx_raw_files", oracle="""
SELECT id, CASE WHEN hit THEN 'pass' ELSE triage_decision END AS triage_decision, CASE WHEN hit THEN 'dull' END AS skip_reason, CASE WHEN hit THEN TIMESTAMP '2024-02-01' END AS skipped_at FROM (SELECT id, triage_decision, research_type = 'src2' AND id % 4 <> 3 AS hit FROM fx_raw_files)""")
def s7c(raw):
    return _skipped(raw)["raw_files"].select("id", "triage_decision", "skip_reason", "skipped_at")


@query("s7_skip_events", "fx_raw_files", oracle="""
SELECT 6000001 + id AS entity_id, '{"reason":"dull",' || CASE WHEN id % 4 <> 3 THEN '"rawFileId":"' || CAST(id AS VARCHAR) || '",' ELSE '' END || '"softDeleted":{"tags":' || CASE WHEN id % 6 = 0 THEN '1' ELSE '0' END || ',"rawData":0,"contentChunks":0}}' AS payload FROM fx_raw_files WHERE research_type = 'src2'""")
def s7d(raw):
    return _skipped(raw)["events"].where("action = 'ingest_skip'").select("entity_id", "payload")


@query("s7_skip_archived_pages", "fx_raw_files", oracle="SELECT 6000001 + id AS id, CASE WHEN research_type = 'src2' THEN 'archived' ELSE 'active' END AS status, CASE WHEN research_type = 'src2' THEN 1 ELSE 0 END AS deleted FROM fx_raw_files")
def s7e(raw):
    return _skipped(raw)["pages"]


@query("s7_skip_raw_files", "fx_pages", "fx_raw_files", "fx_tags", oracle="SELECT id, CASE WHEN ingested_page_id IS NOT NULL AND research_type = 'src2' THEN 'pass' ELSE triage_decision END AS triage_decision FROM fx_raw_files")
def s7b(pages, raw, tags):
    ids = raw.where("research_type = 'src2' AND ingested_page_id IS NOT NULL").select(F.col("ingested_page_id").alias("id"))
    return i.skip_pages({"pages": pages, "tags": tags, "raw_files": raw}, ids, "dull", "2024-02-01")["raw_files"].select("id", "triage_decision")


def _briefs(pages):
    return pages.where("type = 'source'").select("id", F.regexp_replace("slug", "^sources/", "briefs/").alias("slug"), F.lit("brief").alias("type"))


@query("s8_promote_briefs_pages", "fx_pages", "fx_raw_files", "fx_events", oracle="SELECT id, CASE WHEN id % 2 = 0 THEN slug ELSE regexp_replace(slug, '^sources/', 'briefs/') END AS slug, CASE WHEN id % 2 = 0 THEN 'source' ELSE 'brief' END AS type FROM fx_pages WHERE type = 'source'")
def s8b(pages, raw, events):
    b = _briefs(pages)
    return i.promote_briefs(b, raw, events, b.where("id % 2 = 0").select("id"))[0]


@query("s11_write_narratives", "fx_pages", oracle="""
SELECT id, CASE WHEN id % 2 = 0 THEN 'Body ' || title ELSE content END AS content, CASE WHEN id % 2 = 0 THEN '- x' ELSE 'old' END AS timeline, CASE WHEN id % 2 = 0 THEN 'a=2,b=1,c=3' ELSE 'a=1,b=1' END AS frontmatter, CASE WHEN id % 2 = 0 THEN sha256('Body ' || title || chr(10) || '<!-- timeline -->' || chr(10) || '- x') END AS content_hash FROM fx_pages""")
def s11b(pages):
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1"))
    p = pages.select("id", "content", F.lit("old").alias("timeline"), old.alias("frontmatter"))
    n = pages.where("id % 2 = 0").select("id", F.concat(F.lit("Body "), "title", F.lit("\n<!-- timeline -->\n- x")).alias("narrative"), F.create_map(F.lit("a"), F.lit("2"), F.lit("c"), F.lit("3")).alias("frontmatter"))
    out = i.write_narratives(p, n, "write")[0]
    return out.select("id", F.trim("content", F.lit(" \n")).alias("content"), F.trim("timeline", F.lit(" \n")).alias("timeline"), F.array_join(F.transform(F.array_sort(F.map_entries("frontmatter")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("frontmatter"), "content_hash")


@query("f3_explicit_only_gate", "fx_facts", "fx_raw_files", oracle="SELECT id FROM fx_facts WHERE id % 3 = 0 OR NOT (source_page_id % 3 = 0 OR source_page_id % 5 = 0)")
def f3b(facts, raw):
    c = facts.select("id", F.col("source_page_id").alias("page_id"), F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "B").otherwise("C").alias("tier"))
    kind = c.select("page_id").distinct().select("page_id", F.when(F.col("page_id") % 3 == 0, "brief").otherwise("source").alias("type"), F.when(F.col("page_id") % 5 == 0, "meeting_minutes").alias("research_type"))
    return i.explicit_only(c, kind).select("id")


@query("s8_promote_briefs", "fx_pages", oracle="SELECT id, CASE WHEN type = 'source' AND id % 2 = 0 THEN regexp_replace(slug, '^sources/', 'briefs/') ELSE slug END AS slug FROM fx_pages")
def s8(pages):
    return pages.select("id", F.when((F.col("type") == "source") & (F.col("id") % 2 == 0), F.regexp_replace("slug", "^sources/", "briefs/")).otherwise(F.col("slug")).alias("slug"))


@query("s9_upsert", "fx_signals", oracle="""
WITH t AS (SELECT signal_type, entity_page_id, thesis_page_id, min(id) AS id FROM fx_signals WHERE id % 2 = 0 GROUP BY 1, 2, 3), u AS (SELECT signal_type, entity_page_id, thesis_page_id, min(id) AS id FROM fx_signals WHERE id % 2 = 1 GROUP BY 1, 2, 3)
SELECT * FROM t UNION ALL SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.signal_type = u.signal_type AND t.entity_page_id = u.entity_page_id AND t.thesis_page_id IS NOT DISTINCT FROM u.thesis_page_id)""")
def s9(signals):
    keys = ["signal_type", "entity_page_id", "thesis_page_id"]
    target = signals.where("id % 2 = 0").groupBy(*keys).agg(F.min("id").alias("id"))
    return i.upsert(target, signals.where("id % 2 = 1").select(*keys, "id"), keys, ["id"], replace=False)


@query("s9_keyed_upsert", "fx_signals", oracle="""
WITH t AS (SELECT signal_type, entity_page_id, thesis_page_id, min(id) AS id FROM fx_signals WHERE id % 2 = 0 GROUP BY 1, 2, 3), u AS (SELECT signal_type, entity_page_id, thesis_page_id, min(id) AS id FROM fx_signals WHERE id % 2 = 1 GROUP BY 1, 2, 3),
a AS (SELECT * FROM t UNION ALL SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.signal_type = u.signal_type AND t.entity_page_id = u.entity_page_id AND t.thesis_page_id IS NOT DISTINCT FROM u.thesis_page_id))
SELECT signal_type, entity_page_id, thesis_page_id, CASE WHEN id % 3 = 0 THEN -id ELSE id END AS id FROM a""")
def s9b(signals):
    """Rows inserted, inserted again, and replaced in a stored table; each commit comes twice."""
    keys = ["signal_type", "entity_page_id", "thesis_page_id"]
    table = KeyedTable(signals.sparkSession, shared_folder(signals.sparkSession, "signals"), "signal_type string, entity_page_id long, thesis_page_id long, id long", keys, buckets=16)
    for k in (0, 0, 1, 1):
        table.upsert(signals.where(F.col("id") % 2 == k).select(*keys, "id"), ["id"], replace=False, commit=f"part-{k}")
    for _ in range(2):
        table.upsert(table.read().where("id > 0 AND id % 3 = 0").withColumn("id", -F.col("id")), ["id"], replace=True, commit="negated")
    return table.read()


@query("x4_estimate_tokens", "documents", oracle="SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def x4(documents):
    return documents.select("doc_id", t.estimate_tokens(F.col("text")).alias("tokens"))


@query("x7_harvest_links", "fx_narratives", oracle="SELECT page_id, regexp_extract(content, '(companies/supplier-[0-9]+)', 1) AS slug, regexp_extract(content, '\\|([^\\]]*)\\]', 1) AS label FROM fx_narratives UNION ALL SELECT page_id, regexp_extract(content, '(concepts/part-[0-9]+)', 1), '' FROM fx_narratives")
def x7(narratives):
    return i.harvest_links(narratives)


@query("x12_single_entity", "fx_narratives", oracle="SELECT line_id AS page_id, CAST(NULL AS VARCHAR) AS entity FROM fx_narratives WHERE line_id % 2 = 0 UNION ALL SELECT line_id, regexp_extract(content, '(concepts/part-[0-9]+)', 1) FROM fx_narratives WHERE line_id % 2 = 1")
def x12(narratives):
    some = F.when(F.col("line_id") % 2 == 1, F.regexp_replace("content", r"\[\[companies[^\]]*\]\]", "")).otherwise(F.col("content"))
    return i.single_entity(narratives.select(F.col("line_id").alias("page_id"), some.alias("content")))


@query("x13_parse_value_cell", "fx_cells", oracle="""
SELECT id, CASE row_index % 6 WHEN 0 THEN CAST(regexp_extract(cell, '[0-9]+') AS DOUBLE) WHEN 1 THEN CAST(regexp_extract(cell, '[0-9]+') AS DOUBLE) WHEN 3 THEN CAST(replace(cell, ',', '') AS DOUBLE) WHEN 4 THEN CAST(regexp_extract(cell, '[0-9]+') AS DOUBLE) END AS numeric,
 CASE WHEN row_index % 6 = 5 THEN replace(cell, '*', '') END AS text, CASE row_index % 6 WHEN 0 THEN 'usd_bn' WHEN 1 THEN 'pct' WHEN 4 THEN 'x' END AS unit FROM fx_cells""")
def x13(cells):
    v = t.value_cell(F.col("cell"))
    return cells.withColumn("v", v).select("id", F.col("v.numeric").alias("numeric"), F.col("v.text").alias("text"), F.col("v.unit").alias("unit"))


@query("x14_normalize", "fx_cells", oracle="""
SELECT id, CASE metric_cell WHEN 'GM (%)' THEN 'gross_margin' WHEN 'Revenue & other' THEN 'revenue_and_other' WHEN 'rev' THEN 'revenue' WHEN 'Unit Price' THEN 'unit_price' ELSE 'operating_margin' END AS metric,
 CASE row_index % 6 WHEN 0 THEN replace(period_cell, 'FY', 'FY20') WHEN 1 THEN '1Q20' || substr(period_cell, 3, 2) || 'A' WHEN 3 THEN 'H12026E' ELSE period_cell END AS period FROM fx_cells""")
def x14(cells):
    return cells.select("id", t.metric_key(F.col("metric_cell")).alias("metric"), t.period_key(F.col("period_cell")).alias("period"))


@query("x19_visible_text", "fx_narratives", oracle="SELECT line_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\\[\\[([^\\]|]+)\\|([^\\]]+)\\]\\]', '\\2', 'g'), '\\[\\[([^\\]]+)\\]\\]', '\\1', 'g'), '[#>*`|-]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM fx_narratives")
def x19(narratives):
    return narratives.select("line_id", t.visible(F.col("content")).alias("text"))


@query("x21_unembedded_chunks", "fx_chunks", "embeddings", oracle="SELECT id, substr(chunk_text, 1, 4000) AS input FROM fx_chunks c WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = c.id)")
def x21(chunks, embeddings):
    return chunks.join(embeddings.select(F.col("vec_id").alias("id")), "id", "left_anti").select("id", F.substring("chunk_text", 1, 4000).alias("input"))


@query("f2_parse_fact_value", "fx_cells", oracle="""
WITH v AS (SELECT id, CASE row_index % 4 WHEN 0 THEN '>60%' WHEN 1 THEN '12,' || CAST(100 + row_index AS VARCHAR) WHEN 2 THEN CAST(row_index AS VARCHAR) ELSE '10-20' END AS v, row_index % 4 AS k, row_index FROM fx_cells)
SELECT id, CASE k WHEN 1 THEN (12100.0::DOUBLE + row_index) / 100 WHEN 2 THEN CASE WHEN row_index > 1.5 THEN row_index / 100.0::DOUBLE ELSE row_index::DOUBLE END END AS numeric, CASE WHEN k IN (0, 3) THEN v END AS text FROM v""")
def f2(cells):
    k = F.col("row_index") % 4
    v = F.when(k == 0, ">60%").when(k == 1, F.concat(F.lit("12,"), (100 + F.col("row_index")).cast("string"))).when(k == 2, F.col("row_index").cast("string")).otherwise("10-20")
    out = t.fact_value(v, F.lit("gross_margin"), F.lit(None).cast("string"))
    return cells.withColumn("v", out).select("id", F.col("v.numeric").alias("numeric"), F.col("v.text").alias("text"))


_REFS = """r AS (SELECT page_id, regexp_extract(content, '(companies/supplier-[0-9]+)', 1) AS slug, regexp_extract(content, '\\|([^\\]]*)\\]', 1) AS label FROM fx_narratives UNION ALL SELECT page_id, regexp_extract(content, '(concepts/part-[0-9]+)', 1), '' FROM fx_narratives),
s AS (SELECT DISTINCT r.slug, p.id AS page_id FROM r LEFT JOIN fx_pages p ON p.slug = r.slug AND p.deleted = 0)"""


@query("g1_resolve_refs", "fx_narratives", "fx_pages", oracle=f"WITH {_REFS} SELECT slug, page_id, CASE WHEN page_id IS NOT NULL THEN 1 END AS rank FROM s")
def g1(narratives, pages):
    return i.resolve_refs(i.harvest_links(narratives), pages)


@query("g3_build_links", "fx_narratives", "fx_pages", oracle=f"""
WITH {_REFS}, l AS (SELECT r.page_id AS from_page_id, s.page_id AS to_page_id, CASE WHEN starts_with(label, 'confirms:') THEN 'confirms' ELSE 'mention' END AS link_type FROM r JOIN s ON r.slug = s.slug WHERE s.page_id IS NOT NULL AND s.page_id <> r.page_id)
SELECT from_page_id, to_page_id, link_type, count(*) AS occurrences, CAST(CASE WHEN link_type = 'confirms' THEN 1.0 ELSE 0.3 END AS DOUBLE) AS weight FROM l GROUP BY 1, 2, 3""")
def g3(narratives, pages):
    refs = i.harvest_links(narratives)
    return i.build_links(refs, i.resolve_refs(refs, pages))


@query("s7_skip_pages", "fx_pages", "fx_raw_files", oracle="""
SELECT p.id, CAST(CASE WHEN r.id IS NOT NULL THEN 1 ELSE p.deleted END AS INTEGER) AS deleted FROM fx_pages p LEFT JOIN (SELECT DISTINCT ingested_page_id AS id FROM fx_raw_files WHERE research_type = 'src2') r USING (id)""")
def s7(pages, raw):
    gone = raw.where("research_type = 'src2'").select(F.col("ingested_page_id").alias("id")).distinct().withColumn("gone", F.lit(True))
    return pages.join(gone, "id", "left").select("id", F.when(F.col("gone"), 1).otherwise(F.col("deleted")).alias("deleted"))


@query("f3_explicit_only", "fx_facts", "fx_pages", oracle="""
SELECT f.id FROM fx_facts f JOIN fx_pages p ON p.id = f.source_page_id WHERE NOT (p.id % 3 = 0 AND f.table_id IS NULL)""")
def f3(facts, pages):
    kind = pages.select(F.col("id").alias("source_page_id"), F.when(F.col("id") % 3 == 0, "brief").otherwise("source").alias("kind"))
    return facts.join(kind, "source_page_id").where((F.col("kind") != "brief") | F.col("table_id").isNotNull()).select("id")


@query("g14_wikilink_labels", "fx_pages", "fx_raw_files", oracle="""
SELECT p.id, coalesce(nullif(p.display_name, ''), nullif(r.title, ''), nullif(p.title, ''), p.slug) AS label FROM fx_pages p LEFT JOIN (SELECT ingested_page_id AS id, min(title) AS title FROM fx_raw_files WHERE ingested_page_id IS NOT NULL GROUP BY 1) r USING (id) WHERE p.deleted = 0""")
def g14(pages, raw):
    titles = raw.where("ingested_page_id IS NOT NULL").groupBy(F.col("ingested_page_id").alias("id")).agg(F.min("title").alias("raw_title"))
    return pages.where("deleted = 0").join(titles, "id", "left").select("id", F.coalesce(F.expr("nullif(display_name, '')"), F.expr("nullif(raw_title, '')"), F.expr("nullif(title, '')"), "slug").alias("label"))


_DOC = "'Body of ' || slug || chr(10) || '## Sources' || chr(10) || 'a line' || chr(10) || '### Notes' || chr(10) || 'more' || chr(10) || CASE id % 2 WHEN 0 THEN '<!-- timeline -->' ELSE '--- timeline ---' END || chr(10) || '- 2024-01-01 x'"


def _docs(pages):
    return pages.select(F.col("id").alias("page_id"), "slug", F.expr("concat('Body of ', slug, '\n## Sources\na line\n### Notes\nmore\n', if(id % 2 = 0, '<!-- timeline -->', '--- timeline ---'), '\n- 2024-01-01 x')").alias("content"))


@query("x2_split_body", "fx_pages", oracle="""
WITH k AS (SELECT id, content, id % 6 AS k FROM fx_pages)
SELECT id AS page_id, CASE k WHEN 5 THEN '---' || chr(10) || content || '  ' WHEN 4 THEN content || chr(10) || chr(10) || chr(10) || '## After' || chr(10) || 'stays' ELSE content END AS body,
 CASE k WHEN 5 THEN '' WHEN 3 THEN '## History' || chr(10) || '- date: 2024-01-01' ELSE '- date: 2024-01-01' END AS timeline FROM k""")
def x2(pages):
    # a comment, a rule with the word, an open comment, a rule before a heading, a closed comment with text behind it, none
    tail = F.element_at(
        F.array(*map(F.lit, ("\n\n<!-- timeline -->\n\n{}\n", "\n--- Timeline ---\n{}", "\n\n<!-- timeline\n{}\n", "\n\n---\n\n## History\n{}", "\n\n<!-- timeline\n{}\n-->\n\n## After\nstays\n", "  "))),
        (F.col("id") % 6 + 1).cast("int"),
    )
    text = F.concat(F.when(F.col("id") % 6 == 5, "---\n").otherwise(""), "content", F.replace(tail, F.lit("{}"), F.lit("- date: 2024-01-01")))
    return i.split_body(pages.select(F.col("id").alias("page_id"), text.alias("content")))


@query("x18_sections", "fx_pages", oracle="SELECT id AS page_id, CAST(0 AS INTEGER) AS pos, 'sources' AS title, 'a line' || chr(10) AS body FROM fx_pages UNION ALL SELECT id, 1, 'notes', 'more' || chr(10) || CASE id % 2 WHEN 0 THEN '<!-- timeline -->' ELSE '--- timeline ---' END || chr(10) || '- 2024-01-01 x' FROM fx_pages")
def x18(pages):
    return i.sections(_docs(pages))


@query("s11_snapshot_versions", "fx_pages", oracle="SELECT id AS page_id, sha256(content) AS content_hash, CAST(length(content) AS INTEGER) AS chars, 'merge' AS reason FROM fx_pages")
def s11(pages):
    return i.snapshot_versions(pages, "merge")


@query("s12_append_updates", "fx_pages", oracle="""
WITH p AS (SELECT id, CASE WHEN id % 2 = 0 THEN repeat(content || ' ', 20) || CASE WHEN id % 4 = 0 THEN chr(10) || '## Updates' || chr(10) || 'old' ELSE '' END ELSE content END AS content, CASE WHEN id % 3 = 0 THEN 'news of ' || slug END AS delta FROM fx_pages),
b AS (SELECT *, '### 2024-01-0' AS day, ' (per [[sources/x]])' || chr(10) || chr(10) || delta || chr(10) AS tail, trim(content, ' ' || chr(10)) || chr(10) || chr(10) || CASE WHEN contains(content, chr(10) || '## Updates') THEN '' ELSE '## Updates' || chr(10) || chr(10) END AS head FROM p)
SELECT id, CASE WHEN delta IS NULL THEN content WHEN length(trim(content, ' ' || chr(10))) < 200 THEN delta ELSE head || day || '1' || tail || chr(10) || day || '2' || tail END AS content FROM b""")
def s12(pages):
    earlier = F.when(F.col("id") % 4 == 0, "\n## Updates\nold").otherwise("")
    long = pages.select("id", "slug", F.when(F.col("id") % 2 == 0, F.concat(F.repeat(F.concat("content", F.lit(" ")), 20), earlier)).otherwise(F.col("content")).alias("content"))
    deltas = long.where("id % 3 = 0").select("id", F.concat(F.lit("news of "), "slug").alias("delta"))
    once = i.append_updates(long.select("id", "content"), deltas, "2024-01-01", "sources/x")
    return i.append_updates(once, deltas, "2024-01-02", "sources/x")  # the heading is there now


@query("q4_review_gate", "fx_pages", oracle="SELECT id AS page_id, id % 3 = 0 AS reuse FROM fx_pages")
def q4(pages):
    stored = pages.where("id % 3 <> 1").select(F.col("id").alias("page_id"), F.sha2(F.when(F.col("id") % 3 == 0, F.col("content")).otherwise(F.concat("content", F.lit("x"))), 256).alias("content_hash"))
    return i.review_gate(pages, stored)


@query("x14_units", "fx_cells", oracle="SELECT id, CASE row_index % 5 WHEN 0 THEN 'usd_bn' WHEN 1 THEN 'pct' WHEN 2 THEN 'x' WHEN 3 THEN 'cny' ELSE 'widgets' END AS unit FROM fx_cells")
def x14b(cells):
    k = F.col("row_index") % 5
    text = F.when(k == 0, "USD  bn").when(k == 1, "Percent").when(k == 2, "boxes").when(k == 3, "cny_per_card").otherwise("**widgets**")
    return cells.select("id", t.unit_key(text).alias("unit"))


@query("x19_comparable_text", "fx_narratives", oracle="SELECT line_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(content, '\\[\\[([^\\[\\]|]+)\\|([^\\[\\]]+)\\]\\]', '\\2', 'g'), '\\[\\[([^\\[\\]]+)\\]\\]', '\\1', 'g'), '\\s+', ' ', 'g'))) AS text FROM fx_narratives")
def x19b(narratives):
    from lorebase.operators.lifecycle import comparable, without_updates

    return narratives.select("line_id", comparable(without_updates(F.concat("content", F.lit("<!-- note --> \n## Updates\n\nnew")))).alias("text"))
