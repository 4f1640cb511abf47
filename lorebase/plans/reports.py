"""Queries of the reports."""

from pyspark.sql import functions as F

from lorebase.operators import facts as f
from lorebase.operators import graph as g
from lorebase.operators import reports as r
from lorebase.operators import reviews as v
from lorebase.plans.catalog import ORACLES, query
from lorebase.sources.shared import written

_E = "(weight >= 0.9 OR link_type <> 'mention' OR (link_source = 'frontmatter' AND origin_field = 'primary_entities') OR origin_field IN ('facts_block', 'timeline_block'))"
_ENTITY = "type IN ('company', 'industry', 'concept')"
_BACKLOG = f"""le AS (SELECT entity_id AS id, max(ts) AS last_at FROM fx_events WHERE action = 'enrich' GROUP BY 1),
c AS (SELECT l.to_page_id AS id, count(*) FILTER (WHERE {_E}) AS backlinks, count(*) FILTER (WHERE {_E} AND (le.last_at IS NULL OR CAST(l.create_time AS TIMESTAMP) > le.last_at)) AS new_backlinks FROM fx_links l LEFT JOIN le ON le.id = l.to_page_id WHERE deleted = 0 GROUP BY 1),
b AS (SELECT p.id, slug, entity_state, completeness_score, coalesce(backlinks, 0) AS backlinks, coalesce(new_backlinks, 0) AS new_backlinks, le.last_at,
 EXISTS (SELECT 1 FROM fx_jobs j WHERE j.name = 'enrich_entity' AND j.status IN ('waiting', 'active') AND j.target_page_id = p.id) AS in_flight, entity_state IN ('stub', 'candidate_promoted') AS awaits
 FROM fx_pages p LEFT JOIN c ON c.id = p.id LEFT JOIN le ON le.id = p.id WHERE p.deleted = 0 AND {_ENTITY} AND (entity_state IN ('stub', 'candidate_promoted') OR completeness_score < 0.6 OR coalesce(backlinks, 0) >= 3))"""
_LIST = f"""e AS (SELECT p.id, p.slug, p.type, coalesce(n, 0) AS backlinks FROM fx_pages p LEFT JOIN (SELECT to_page_id, count(*) FILTER (WHERE {_E}) AS n FROM fx_links WHERE deleted = 0 GROUP BY 1) l ON l.to_page_id = p.id WHERE p.deleted = 0 AND entity_state IN ('stub', 'candidate_promoted'))"""
_REVIEW = "v AS (SELECT * FROM (SELECT entity_id AS page_id, id, status, ts, count(*) OVER (PARTITION BY entity_id) AS reviews, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, id DESC) AS rn FROM fx_events WHERE action = 'page_review') WHERE rn = 1)"
_EVIDENCE = f"""p AS (SELECT id AS page_id, update_date, completeness_score FROM fx_pages WHERE deleted = 0 AND {_ENTITY} AND entity_state = 'compiled'),
f AS (SELECT x.entity_page_id AS page_id, x.source_page_id, x.valid_from AS d_at FROM fx_facts x JOIN p ON p.page_id = x.entity_page_id WHERE x.deleted = 0 AND x.valid_from > p.update_date),
t AS (SELECT x.entity_page_id AS page_id, x.source_page_id, x.event_date AS d_at FROM fx_timeline x JOIN p ON p.page_id = x.entity_page_id WHERE x.deleted = 0 AND x.event_date > p.update_date),
s AS (SELECT x.entity_page_id AS page_id, x.source_page_id, CAST(x.detected_at AS DATE) AS d_at FROM fx_signals x JOIN p ON p.page_id = x.entity_page_id WHERE x.deleted = 0 AND CAST(x.detected_at AS DATE) > p.update_date),
l AS (SELECT x.to_page_id AS page_id, x.from_page_id AS source_page_id, x.create_time AS d_at FROM fx_links x JOIN p ON p.page_id = x.to_page_id WHERE x.deleted = 0 AND link_type <> 'mention' AND x.create_time > p.update_date),
a AS (SELECT * FROM l UNION ALL SELECT * FROM f UNION ALL SELECT * FROM t UNION ALL SELECT * FROM s),
so AS (SELECT page_id, count(DISTINCT source_page_id) AS n, max(d_at) AS m FROM a WHERE source_page_id IS NOT NULL GROUP BY 1), fa AS (SELECT page_id, count(*) AS n, max(d_at) AS m FROM f GROUP BY 1), ti AS (SELECT page_id, count(*) AS n, max(d_at) AS m FROM t GROUP BY 1), si AS (SELECT page_id, count(*) AS n, max(d_at) AS m FROM s GROUP BY 1),
ev AS (SELECT p.page_id, completeness_score, coalesce(so.n, 0) AS new_sources, coalesce(fa.n, 0) AS new_facts, coalesce(ti.n, 0) AS new_entries, coalesce(si.n, 0) AS new_signals, CAST(datediff('day', update_date, least(greatest(so.m, fa.m, ti.m, si.m), DATE '2001-12-31')) AS INTEGER) AS days_behind
 FROM p LEFT JOIN so USING (page_id) LEFT JOIN fa USING (page_id) LEFT JOIN ti USING (page_id) LEFT JOIN si USING (page_id) WHERE greatest(so.m, fa.m, ti.m, si.m) IS NOT NULL)"""


@query("q1_lint", "fx_pages", "fx_links", "fx_theses", "fx_raw_files", "fx_facts", "fx_events", "fx_timeline", "fx_signals", oracle=f"""
WITH {_REVIEW}, {_EVIDENCE}, ak AS (SELECT DISTINCT id, type, lower(trim(u)) AS key FROM (SELECT id, type, unnest(list_concat([title, split_part(slug, '/', 2)], string_split(alias_csv, ','))) AS u FROM fx_pages WHERE deleted = 0 AND {_ENTITY}) WHERE lower(trim(u)) <> ''),
ck AS (SELECT 'orphans' AS "check", id FROM fx_pages p WHERE deleted = 0 AND {_ENTITY} AND NOT EXISTS (SELECT 1 FROM fx_links l WHERE l.deleted = 0 AND l.to_page_id = p.id)
UNION ALL SELECT 'stale_theses', page_id FROM fx_theses WHERE status = 'active' AND update_date < DATE '2024-02-20' - 30 UNION ALL SELECT 'unenriched_stubs', id FROM fx_pages WHERE deleted = 0 AND entity_state = 'stub'
UNION ALL SELECT 'pending_raw_files', id FROM fx_raw_files WHERE triage_decision = 'pending' AND create_date < DATE '2024-02-20' - 7 UNION ALL SELECT 'expired_facts', id FROM fx_facts WHERE deleted = 0 AND valid_to IS NULL AND make_date(CAST(substr(period, 3, 4) AS BIGINT), 12, 31) < DATE '2024-02-20' - 90
UNION ALL SELECT 'failing_reviews', page_id FROM v WHERE status = 'fail' UNION ALL SELECT 'alias_conflicts', min(id) FROM ak GROUP BY type, key HAVING count(*) > 1
UNION ALL SELECT 'stale_entities', page_id FROM ev WHERE days_behind >= 1 UNION ALL SELECT 'failing_outputs', id FROM fx_pages WHERE type = 'industry'), k AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY id) AS rn, count(*) OVER (PARTITION BY "check") AS n FROM ck)
SELECT "check", any_value(n) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS sample FROM k WHERE rn <= 10 GROUP BY 1""")
def q1(pages, links, theses, raw_files, facts, events, timeline, signals):
    stale = r.stale_entities(r.entity_evidence(pages, links, facts, timeline, signals, "2001-12-31"), 1).select(F.col("page_id").alias("id"))
    # the industries' bodies stand for reports: none has the sections of one
    reports = pages.where("type = 'industry'").select(F.col("id").alias("page_id"), "slug", "content", F.lit(None).cast("string").alias("frontmatter"))
    failing = v.output_issues(reports).where("severity = 'error'").select(F.col("page_id").alias("id")).distinct()
    return r.lint(pages, links, theses, raw_files, facts, events, "2024-02-20", more={"stale_entities": stale, "failing_outputs": failing})


@query("q17_usage_by_skill", "fx_usage", "fx_jobs", oracle="""
SELECT skill, count(DISTINCT job_id) AS jobs, count(*) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM fx_usage u LEFT JOIN (SELECT id AS job_id, skill FROM fx_jobs) j USING (job_id) WHERE source = 'agent_runtime' GROUP BY 1 ORDER BY 4 + 5 DESC LIMIT 50""")
def q17b(usage, jobs):
    return r.usage_by_skill(usage, jobs)


@query("q17_usage_recent", "fx_usage", oracle="SELECT id, source, model, tokens_in, tokens_out FROM fx_usage ORDER BY create_time DESC, id DESC LIMIT 50")
def q17c(usage):
    return r.usage_recent(usage).select("id", "source", "model", "tokens_in", "tokens_out")


@query("q13_comment_threads", "fx_comments", oracle="SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY create_date, id) AS INTEGER) AS rn, id, author, intent FROM fx_comments")
def q13b(comments):
    return r.comment_threads(comments)


@query("q8_facts_risk", "fx_fact_pages", "fx_facts", "fx_table_blocks", oracle="""
WITH n AS (SELECT page_id, 0 AS facts, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END AS tables, len(regexp_extract_all(content, '[0-9]+(?:[.,][0-9]+)*%?')) AS numbers FROM fx_fact_pages ORDER BY page_id LIMIT 1000)
SELECT page_id, CAST(facts AS BIGINT) AS facts, CAST(tables AS BIGINT) AS tables, CAST(numbers AS INTEGER) AS numbers, true AS has_block, CASE WHEN tables > 0 THEN 'high' ELSE 'medium' END AS risk FROM n""")
def q8b(pages, facts, blocks):
    return r.facts_risk(pages.select("page_id", "content"), facts, blocks.where("doc_id % 2 = 0").select(F.col("doc_id").alias("page_id")), 1000)


@query("q3_latest_review", "fx_events", oracle=f"WITH {_REVIEW} SELECT page_id, id, status, ts, reviews FROM v")
def q3(events):
    return r.latest_review(events)


@query("q5_repair_candidates", "fx_pages", "fx_events", oracle=f"""
WITH {_REVIEW}, x AS (SELECT p.id, p.slug, CASE WHEN v.status IS NULL THEN 'never_reviewed' WHEN v.status = 'fail' THEN 'failing' WHEN NOT regexp_matches(content, '(?m)^##\\s+') THEN 'no_headings' END AS reason FROM fx_pages p LEFT JOIN v ON v.page_id = p.id WHERE p.deleted = 0 AND {_ENTITY}) SELECT * FROM x WHERE reason IS NOT NULL""")
def q5(pages, events):
    return r.repair_candidates(pages, events)


@query("q8_facts_coverage", "fx_pages", "fx_facts", oracle="""
WITH n AS (SELECT p.id, p.slug, coalesce(c, 0) AS facts FROM fx_pages p LEFT JOIN (SELECT source_page_id, count(*) AS c FROM fx_facts WHERE deleted = 0 GROUP BY 1) f ON f.source_page_id = p.id WHERE p.deleted = 0 AND p.type = 'source' ORDER BY facts, p.id LIMIT 500)
SELECT id, slug, facts, CASE WHEN facts = 0 THEN 'high' ELSE 'medium' END AS risk FROM n WHERE facts <= 1""")
def q8(pages, facts):
    return r.facts_coverage(pages, facts, 500)


@query("q9_thesis_backlog", "fx_theses", "fx_signals", oracle="""
WITH s AS (SELECT thesis_page_id AS page_id, count(*) AS n FROM fx_signals WHERE deleted = 0 AND detected_at >= CAST(DATE '2024-02-01' - 14 AS TIMESTAMP) GROUP BY 1),
x AS (SELECT t.page_id, CAST(datediff('day', update_date, DATE '2024-02-01') AS INTEGER) AS days_since_update, unresolved_conditions, coalesce(n, 0) AS recent_signals FROM fx_theses t LEFT JOIN s USING (page_id) WHERE status IN ('active', 'monitoring'))
SELECT *, CAST(greatest(days_since_update - 21, 0) + 3 * unresolved_conditions + 2 * recent_signals AS BIGINT) AS priority, CASE WHEN days_since_update >= 21 OR unresolved_conditions > 0 OR recent_signals > 0 THEN 'review_now' ELSE 'monitor' END AS action FROM x""")
def q9(theses, signals):
    return r.thesis_backlog(theses, signals, "2024-02-01")


_ISSUES = r"""a AS (SELECT id, confidence, slug, [x FOR x IN string_split(alias_csv, ',') IF x <> ''] AS al, [lower(trim(x)) FOR x IN string_split(alias_csv, ',') IF x <> ''] AS known, trim(coalesce(display_name, '')) AS name, trim(coalesce(ticker, '')) AS tick FROM {pages} WHERE deleted = 0 AND type = 'company'),
c AS (SELECT *, count(*) OVER (PARTITION BY upper(tick)) AS same FROM a),
i AS (SELECT id AS page_id, 1 AS k, 'missing_display_name' AS code, 'error' AS severity FROM c WHERE name = '' UNION ALL SELECT id, 2, 'display_name_sluggy', 'warn' FROM c WHERE name <> '' AND (contains(name, '-') OR name = lower(name))
UNION ALL SELECT id, 3, 'missing_aliases', 'error' FROM c WHERE len(al) = 0 UNION ALL SELECT id, 4, 'sparse_aliases', 'warn' FROM c WHERE len(al) = 1 AND confidence IS DISTINCT FROM 'low' UNION ALL SELECT id, 5, 'display_name_missing_from_aliases', 'warn' FROM c WHERE name <> '' AND NOT list_contains(known, lower(name))
UNION ALL SELECT id, 6, 'missing_ticker', 'warn' FROM c WHERE tick = '' AND confidence IN ('medium', 'high') UNION ALL SELECT id, 7, 'ticker_suspicious', 'error' FROM c WHERE tick <> '' AND (NOT regexp_full_match(upper(tick), '[A-Z0-9]{{1,8}}([.-][A-Z0-9]{{1,6}}){{0,2}}') OR length(tick) > 16 OR lower(tick) IN ('n/a', 'na', 'none', 'null', 'unknown', 'private', 'private company'))
UNION ALL SELECT id, 8, 'ticker_not_uppercase', 'warn' FROM c WHERE tick <> '' AND tick <> upper(tick) UNION ALL SELECT id, 9, 'ticker_missing_from_aliases', 'warn' FROM c WHERE tick <> '' AND NOT list_contains(known, lower(tick))
UNION ALL SELECT id, 10, 'duplicate_ticker', 'error' FROM c WHERE tick <> '' AND same > 1 UNION ALL SELECT id, 11, 'sparse_aliases', 'warn' FROM c WHERE len(al) > 0 AND NOT list_contains(known, lower(split_part(slug, '/', 2))))"""

#: companies some of which lack aliases or a level of confidence, or have odd tickers
_VARIED = """v AS (SELECT id, type, deleted, slug, display_name, CASE WHEN id % 11 = 0 THEN '' WHEN id % 11 = 1 THEN split_part(slug, '/', 2) ELSE alias_csv END AS alias_csv, CASE WHEN id % 13 = 0 THEN NULL ELSE confidence END AS confidence,
 CASE WHEN id % 17 = 0 THEN 'Private Company' WHEN id % 17 = 1 THEN 'ABCDEFGH.ABCDEF.ABC' WHEN id % 17 = 2 THEN lower(ticker) ELSE ticker END AS ticker FROM fx_pages)"""


def _varied(pages):
    k = F.col("id")
    return pages.withColumns({
        "alias_csv": F.when(k % 11 == 0, "").when(k % 11 == 1, F.split("slug", "/")[1]).otherwise(F.col("alias_csv")), "confidence": F.when(k % 13 != 0, F.col("confidence")),
        "ticker": F.when(k % 17 == 0, "Private Company").when(k % 17 == 1, "ABCDEFGH.ABCDEF.ABC").when(k % 17 == 2, F.lower("ticker")).otherwise(F.col("ticker")),
    })


@query("q10_company_metadata_audit", "fx_pages", oracle="WITH " + _ISSUES.format(pages="fx_pages") + " SELECT DISTINCT page_id, code, severity FROM i")
def q10(pages):
    return r.company_metadata_issues(pages)


@query("q10_company_metadata_ranking", "fx_pages", "fx_links", oracle=f"""
WITH {_VARIED}, {_ISSUES.format(pages="v")}, b AS (SELECT CASE WHEN to_page_id % 3 = 0 THEN 1000000 + to_page_id % 100 ELSE to_page_id END AS page_id, count(*) AS n FROM fx_links WHERE deleted = 0 GROUP BY 1),
g AS (SELECT page_id, string_agg(severity || ':' || code, ',' ORDER BY k) AS issues FROM i GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY coalesce(n, 0) DESC, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, id) AS INTEGER) AS rank, id AS page_id, slug, confidence, coalesce(n, 0) AS backlinks, CAST(len(al) AS INTEGER) AS aliases, issues FROM c JOIN g ON g.page_id = id LEFT JOIN b ON b.page_id = id ORDER BY rank LIMIT 80""")
def q10b(pages, links):
    links = links.withColumn("to_page_id", F.when(F.col("to_page_id") % 3 == 0, 1000000 + F.col("to_page_id") % 100).otherwise(F.col("to_page_id")))
    return r.company_metadata_audit(_varied(pages), links)[0]


@query("q10_company_metadata_counts", "fx_pages", "fx_links", oracle=f"""
WITH {_VARIED}, {_ISSUES.format(pages="v")} SELECT code, count(*) AS n FROM i GROUP BY 1 UNION ALL SELECT 'companies', count(*) FROM c UNION ALL SELECT 'problem_companies', count(DISTINCT page_id) FROM i""")
def q10c(pages, links):
    return r.company_metadata_audit(_varied(pages), links)[1]


@query("q11_daily_sources", "fx_raw_files", oracle="SELECT id, research_id, research_type, triage_decision FROM fx_raw_files WHERE CAST(create_date AS TIMESTAMP) >= TIMESTAMP '2024-01-09 16:00:00' AND CAST(create_date AS TIMESTAMP) < TIMESTAMP '2024-01-10 16:00:00'")
def q11(raw_files):
    return r.daily_sources(raw_files, "2024-01-10")


@query("q11_daily_source_pages", "fx_raw_files", "fx_pages", oracle="""
WITH r AS (SELECT r.id AS raw_file_id, p.id AS page_id, p.slug, research_type, r.create_date, CASE p.id % 4 WHEN 0 THEN 'buy_side' WHEN 1 THEN 'neutral' WHEN 2 THEN 'both' ELSE 'unknown' END AS view_side_raw FROM fx_raw_files r JOIN fx_pages p ON p.id = 6000000 + r.id AND p.deleted = 0
 WHERE CAST(r.create_date AS TIMESTAMP) >= TIMESTAMP '2024-01-09 16:00:00' AND CAST(r.create_date AS TIMESTAMP) < TIMESTAMP '2024-01-10 16:00:00')
SELECT page_id, raw_file_id, slug, research_type, CASE WHEN view_side_raw = 'both' THEN 'unknown' ELSE view_side_raw END AS view_side, view_side_raw FROM r ORDER BY create_date, raw_file_id LIMIT 500""")
def q11b(raw_files, pages):
    side = F.when(F.col("id") % 4 == 0, '{"view_side":"buy_side"}').when(F.col("id") % 4 == 1, '{"view_side":"neutral"}').when(F.col("id") % 4 == 2, '{"view_side":"both"}')
    return r.daily_source_pages(raw_files.withColumn("ingested_page_id", F.col("id") + 6000000), pages.select("id", "slug", "type", "deleted", side.alias("frontmatter")), "2024-01-10")


@query("q12_recent_activity", "fx_events", "fx_signals", "fx_pages", oracle="""
WITH a AS (SELECT 'event' AS kind, id, ts FROM fx_events WHERE ts >= CAST(DATE '2024-02-01' - 7 AS TIMESTAMP) ORDER BY ts DESC, id DESC LIMIT 30), b AS (SELECT 'signal' AS kind, id, detected_at AS ts FROM fx_signals WHERE deleted = 0 AND detected_at >= CAST(DATE '2024-02-01' - 7 AS TIMESTAMP) ORDER BY ts DESC, id DESC LIMIT 30),
c AS (SELECT 'page' AS kind, id, CAST(create_date AS TIMESTAMP) AS ts FROM fx_pages WHERE deleted = 0 AND CAST(create_date AS TIMESTAMP) >= CAST(DATE '2024-02-01' - 7 AS TIMESTAMP) ORDER BY ts DESC, id DESC LIMIT 30)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) ORDER BY ts DESC, kind, id DESC LIMIT 30""")
def q12(events, signals, pages):
    return r.recent_activity(events, signals, pages, "2024-02-01")


@query("q13_recent_comments", "fx_comments", oracle="SELECT id, page_id, author, create_date FROM fx_comments WHERE intent = 'fact_correction' AND create_date >= DATE '2024-02-01' - 30 ORDER BY create_date DESC, id DESC LIMIT 50")
def q13(comments):
    return r.recent_comments(comments, "2024-02-01", "fact_correction")


@query("q14_overview_counts", "fx_pages", "fx_links", "fx_facts", "fx_theses", "fx_signals", "fx_raw_files", oracle="""
SELECT 'pages' AS what, count(*) AS n FROM fx_pages WHERE deleted = 0 UNION ALL SELECT 'links', count(*) FROM fx_links WHERE deleted = 0 UNION ALL SELECT 'facts', count(*) FROM fx_facts WHERE deleted = 0
UNION ALL SELECT 'active_theses', count(*) FROM fx_theses WHERE status = 'active' UNION ALL SELECT 'signals', count(*) FROM fx_signals WHERE deleted = 0 UNION ALL SELECT 'pending_raw', count(*) FROM fx_raw_files WHERE triage_decision = 'pending'""")
def q14(*tables):
    return r.overview_counts(*tables)


@query("q15_queue_breakdown", "fx_jobs", oracle="SELECT name, CASE WHEN name = 'agent_run' THEN concat_ws(':', name, skill) ELSE name END AS task_type, status, count(*) AS n FROM fx_jobs GROUP BY 1, 2, 3")
def q15(jobs):
    return r.queue_breakdown(jobs)


@query("q16_usage_totals", "fx_usage", oracle="""
WITH b AS (SELECT 'today' AS bucket, CAST(DATE '2024-01-30' AS TIMESTAMP) AS since UNION ALL SELECT 'last_7d', CAST(DATE '2024-01-30' - 7 AS TIMESTAMP) UNION ALL SELECT 'last_30d', CAST(DATE '2024-01-30' - 30 AS TIMESTAMP))
SELECT bucket, count(*) AS requests, CAST(coalesce(sum(tokens_in) FILTER (WHERE source = 'embedding'), 0) AS BIGINT) AS embedding_tokens, CAST(coalesce(sum(tokens_in) FILTER (WHERE source <> 'embedding'), 0) AS BIGINT) AS chat_in, CAST(coalesce(sum(tokens_out) FILTER (WHERE source <> 'embedding'), 0) AS BIGINT) AS chat_out
FROM b JOIN fx_usage u ON u.create_time >= b.since GROUP BY 1""")
def q16(usage):
    return r.usage_totals(usage, "2024-01-30")


@query("q16_usage_cost", "fx_usage", oracle="""
WITH b AS (SELECT 'today' AS bucket, CAST(DATE '2024-01-30' AS TIMESTAMP) AS since UNION ALL SELECT 'last_7d', CAST(DATE '2024-01-30' - 7 AS TIMESTAMP) UNION ALL SELECT 'last_30d', CAST(DATE '2024-01-30' - 30 AS TIMESTAMP))
SELECT bucket, round(coalesce(sum(tokens_in) FILTER (WHERE source <> 'embedding'), 0) / 1e6 * 2.5 + coalesce(sum(tokens_out) FILTER (WHERE source <> 'embedding'), 0) / 1e6 * 10 + coalesce(sum(tokens_in) FILTER (WHERE source = 'embedding'), 0) / 1e6 * 0.13, 6) AS cost
FROM b JOIN fx_usage u ON u.create_time >= b.since GROUP BY 1""")
def q16b(usage):
    return r.usage_totals(usage, "2024-01-30", {"input": 2.5, "output": 10.0, "embedding": 0.13}).select("bucket", "cost")


@query("q17_usage_by_source_model", "fx_usage", oracle="SELECT source, model, count(*) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, count(DISTINCT job_id) AS jobs FROM fx_usage GROUP BY 1, 2")
def q17(usage):
    return r.usage_by_source_model(usage)


@query("q18_usage_daily", "fx_usage", oracle="SELECT CAST(create_time + INTERVAL 8 HOUR AS DATE) AS day, source, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, count(*) AS requests FROM fx_usage GROUP BY 1, 2")
def q18(usage):
    return r.usage_daily(usage)


@query("q21_stage_progress", "fx_events", oracle="SELECT entity_id AS page_id, coalesce(string_agg(DISTINCT CAST(stage AS VARCHAR), ',' ORDER BY CAST(stage AS VARCHAR)) FILTER (WHERE status = 'pass'), '') AS stages, max(ts) FILTER (WHERE status = 'fail') AS last_failure FROM fx_events GROUP BY 1")
def q21(events):
    return r.stage_progress(events)


@query("e22_enrich_gate", "fx_pages", "fx_links", "fx_facts", "fx_timeline", oracle=f"""
WITH {_LIST}, f AS (SELECT entity_page_id AS id, count(*) AS n FROM fx_facts WHERE deleted = 0 AND valid_to IS NULL AND source_page_id IS NOT NULL GROUP BY 1), t AS (SELECT entity_page_id AS id, count(*) AS n FROM fx_timeline WHERE deleted = 0 GROUP BY 1),
x AS (SELECT e.id, backlinks, coalesce(f.n, 0) AS facts, coalesce(t.n, 0) AS entries FROM e LEFT JOIN f USING (id) LEFT JOIN t USING (id)), y AS (SELECT *, CASE WHEN backlinks >= 3 THEN 'backlinks' WHEN facts >= 3 THEN 'facts' WHEN entries >= 1 THEN 'timeline' END AS reason FROM x) SELECT * FROM y WHERE reason IS NOT NULL""")
def e22(pages, links, facts, timeline):
    return r.enrich_gate(pages, links, facts, timeline)


@query("e23_enrich_backlog", "fx_pages", "fx_links", "fx_events", "fx_jobs", oracle=f"""
WITH {_BACKLOG} SELECT id, slug, backlinks, new_backlinks, last_at, in_flight, CASE WHEN awaits AND backlinks >= 2 THEN 'enrich_now' WHEN new_backlinks >= 2 OR (backlinks >= 3 AND completeness_score < 0.5) THEN 'retrigger' ELSE 'monitor' END AS action,
CAST(CASE WHEN awaits THEN 3 ELSE 1 END + least(backlinks, 10) + greatest(0, floor(round((0.8 - completeness_score) * 10, 4) + 0.5)) AS BIGINT) AS priority FROM b""")
def e23(pages, links, events, jobs):
    return r.enrich_backlog(pages, links, events, jobs)


@query("e24_enrich_retrigger", "fx_pages", "fx_links", "fx_events", "fx_jobs", oracle=f"""
WITH {_BACKLOG}, x AS (SELECT * FROM b WHERE entity_state = 'compiled' AND backlinks >= 3 AND NOT in_flight ORDER BY backlinks DESC, id LIMIT 90)
SELECT id, slug, backlinks, new_backlinks FROM x WHERE completeness_score < 0.5 OR new_backlinks >= 2 ORDER BY backlinks DESC, id LIMIT 30""")
def e24(pages, links, events, jobs):
    return r.enrich_retrigger(pages, links, events, jobs)


@query("e25_enrich_list", "fx_pages", "fx_links", oracle=f"WITH {_LIST} SELECT * FROM e")
def e25(pages, links):
    return r.enrich_list(pages, links)


@query("e29_entity_evidence", "fx_pages", "fx_links", "fx_facts", "fx_timeline", "fx_signals", oracle=f"WITH {_EVIDENCE} SELECT * FROM ev")
def e29(pages, links, facts, timeline, signals):
    return r.entity_evidence(pages, links, facts, timeline, signals, "2001-12-31")


_UPDATES = f"""{_EVIDENCE}, up AS (SELECT page_id, days_behind, CAST(5 * days_behind + 6 * new_facts + 8 * new_signals + 4 * new_entries + 3 * new_sources + floor(round(10 * (1 - completeness_score), 4) + 0.5) AS BIGINT) AS priority, CASE WHEN new_signals >= 2 OR days_behind >= 21 THEN 'llm_refresh' ELSE 'append_update' END AS action,
 'Sources' || CASE (SELECT type FROM fx_pages g WHERE g.id = ev.page_id)
 WHEN 'company' THEN CASE WHEN new_facts > 0 THEN ',Financial Summary' ELSE '' END || CASE WHEN new_entries > 0 THEN ',Key Timeline' ELSE '' END || CASE WHEN new_signals > 0 THEN ',Risk Factors,Catalysts' ELSE '' END || CASE WHEN new_sources > 0 AND new_facts = 0 AND new_signals = 0 THEN ',Company Overview' ELSE '' END
 WHEN 'industry' THEN CASE WHEN new_facts > 0 THEN ',Market Size And Growth' ELSE '' END || CASE WHEN new_entries + new_signals > 0 THEN ',Key Trends' ELSE '' END || CASE WHEN new_sources > 0 THEN ',Competitive Landscape' ELSE '' END
 ELSE CASE WHEN new_facts + new_entries > 0 THEN ',Use In Investment Research' ELSE '' END || CASE WHEN new_sources > 0 THEN ',Definition' ELSE '' END END AS sections,
 new_signals = 0 AND days_behind < 21 AND new_sources + new_facts + new_entries > 0 AS safe FROM ev WHERE days_behind >= 1)"""


@query("e30_update_candidates", "fx_pages", "fx_links", "fx_facts", "fx_timeline", "fx_signals", oracle=f"WITH {_UPDATES} SELECT * FROM up")
def e30b(pages, links, facts, timeline, signals):
    evidence = r.entity_evidence(pages, links, facts, timeline, signals, "2001-12-31")
    return r.update_candidates(evidence, pages).withColumn("sections", F.array_join("sections", ","))


@query("e30_stale_entities", "fx_pages", "fx_links", "fx_facts", "fx_timeline", "fx_signals", oracle=f"""
WITH {_EVIDENCE} SELECT page_id, days_behind, CAST(5 * days_behind + 6 * new_facts + 8 * new_signals + 4 * new_entries + 3 * new_sources + floor(round(10 * (1 - completeness_score), 4) + 0.5) AS BIGINT) AS priority FROM ev WHERE days_behind >= 1""")
def e30(pages, links, facts, timeline, signals):
    return r.stale_entities(r.entity_evidence(pages, links, facts, timeline, signals, "2001-12-31"))


_SEVEN = {
    "lint_stubs": "SELECT id FROM fx_pages WHERE deleted = 0 AND entity_state = 'stub'", "stale_entities": "SELECT page_id AS id FROM up", "safe_refresh": "SELECT page_id AS id FROM up WHERE safe",
    "facts_coverage": f"SELECT id FROM ({ORACLES['q8_facts_coverage']})", "enrich_backlog": f"SELECT id FROM ({ORACLES['e23_enrich_backlog']}) WHERE NOT in_flight", "thesis_backlog": f"SELECT page_id AS id FROM ({ORACLES['q9_thesis_backlog']}) WHERE action = 'review_now'",
    "failing_reviews": f"SELECT page_id AS id FROM ({ORACLES['q3_latest_review']}) WHERE status = 'fail'", "output_backlog": "SELECT id FROM fx_pages WHERE type = 'industry'",
    "expired_facts": f"SELECT id FROM ({ORACLES['f5_expire_facts']}) WHERE expired",
}


@query("q19_maintain_all", "fx_pages", "fx_links", "fx_facts", "fx_timeline", "fx_signals", "fx_theses", "fx_events", "fx_jobs", oracle=f"""
WITH {_UPDATES.replace("2001-12-31", "1996-07-10")}, al AS ({" UNION ALL ".join(f"SELECT '{part}' AS part, id FROM ({sql})" for part, sql in _SEVEN.items())}), kk AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) AS k, count(*) OVER (PARTITION BY part) AS n FROM al)
SELECT part, count(id) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE k <= 10) AS sample FROM (SELECT unnest({list(_SEVEN)}) AS part) LEFT JOIN kk USING (part) GROUP BY 1""")
def q19_all(pages, links, facts, timeline, signals, theses, events, jobs):
    """Lint, stale entities and those that may be refreshed unasked, facts coverage, enrichment, theses, reviews, reports, expired facts."""
    evidence = written(r.entity_evidence(pages, links, facts, timeline, signals, "1996-07-10"), "evidence")
    updates = r.update_candidates(evidence, pages)
    page = lambda df: df.select(F.col("page_id").alias("id"))
    reports = pages.where("type = 'industry'").select(F.col("id").alias("page_id"), "slug", "content", F.lit(None).cast("string").alias("frontmatter"))
    return v.maintenance_report({
        "lint_stubs": g.active(pages).where("entity_state = 'stub'"), "stale_entities": page(updates), "safe_refresh": page(updates.where("safe")), "facts_coverage": r.facts_coverage(pages, facts, 500),
        "enrich_backlog": e23(pages, links, events, jobs).where("NOT in_flight"), "thesis_backlog": page(r.thesis_backlog(theses, signals, "2024-02-01").where("action = 'review_now'")),
        "failing_reviews": page(r.latest_review(events).where("status = 'fail'")), "output_backlog": page(v.output_backlog(reports, 1 << 30).where("status = 'fail'")), "expired_facts": f.expire(facts, "2001-12-31").where("expired"),
    })
