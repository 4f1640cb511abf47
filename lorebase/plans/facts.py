"""Queries of facts, consensus, theses and signals."""

from pyspark.sql import functions as F

from lorebase.functions.periods import interval
from lorebase.operators import facts as f
from lorebase.plans.catalog import query

_HALF = """x AS (SELECT *, count(*) OVER (PARTITION BY entity_page_id, metric) AS n, row_number() OVER (PARTITION BY entity_page_id, metric ORDER BY valid_from, id) AS rn FROM fx_facts WHERE deleted = 0 AND value_numeric IS NOT NULL),
h AS (SELECT entity_page_id, metric, any_value(n) AS n, count(DISTINCT source_page_id) AS sources, avg(value_numeric) AS mean, max_by(value_numeric, (valid_from, id)) AS latest,
 avg(value_numeric) FILTER (WHERE rn <= n // 2) AS a, avg(value_numeric) FILTER (WHERE rn > n - n // 2) AS b FROM x GROUP BY 1, 2), d AS (SELECT *, CASE WHEN a = 0 THEN 0.0 ELSE (b - a) / abs(a) END AS pct FROM h)"""
_TREND = "CASE WHEN abs(pct) < 0.02 THEN 'stable' WHEN pct > 0 THEN 'rising' ELSE 'falling' END"


@query("f1_dedupe_candidates", "fx_facts", oracle="""
WITH r AS (SELECT id, row_number() OVER (PARTITION BY entity_page_id, metric, period, value_numeric ORDER BY id) AS rn FROM fx_facts) SELECT id FROM r WHERE rn = 1""")
def f1(facts):
    return f.dedupe_candidates(facts, ["entity_page_id", "metric", "period", "value_numeric"], ["id"]).select("id")


@query("f4_merge_facts", "fx_facts", oracle="""
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_page_id, metric, period ORDER BY valid_from DESC, id DESC) AS k FROM fx_facts WHERE valid_from < DATE '1998-01-01' AND value_numeric IS NOT NULL) WHERE k = 1),
allr AS (SELECT entity_page_id, metric, period, value_numeric, valid_from, 0 AS stage, id AS pos FROM cur UNION ALL SELECT entity_page_id, metric, period, value_numeric, DATE '2001-12-31', 1, id FROM fx_facts WHERE valid_from >= DATE '1997-06-01' AND valid_from < DATE '1999-01-01' AND value_numeric IS NOT NULL),
l AS (SELECT *, lag(value_numeric) OVER w AS before, lag(stage) OVER w AS has FROM allr WINDOW w AS (PARTITION BY entity_page_id, metric, period ORDER BY stage, pos)),
k AS (SELECT * FROM l WHERE stage = 0 OR NOT (has IS NOT NULL AND value_numeric IS NOT DISTINCT FROM before)),
e AS (SELECT *, lead(stage) OVER (PARTITION BY entity_page_id, metric, period ORDER BY stage, pos) AS follows FROM k)
SELECT entity_page_id, metric, period, value_numeric, valid_from, CASE WHEN follows = 1 THEN DATE '2001-12-31' END AS valid_to, CASE WHEN stage = 1 THEN 'inserted' WHEN follows = 1 THEN 'closed' ELSE 'kept' END AS action, pos FROM e""")
def f4(facts):
    old = facts.where("valid_from < DATE '1998-01-01' AND value_numeric IS NOT NULL")
    current = f.dedupe_candidates(old, ["entity_page_id", "metric", "period"], [F.desc("valid_from"), F.desc("id")])
    new = facts.where("valid_from >= DATE '1997-06-01' AND valid_from < DATE '1999-01-01' AND value_numeric IS NOT NULL").withColumn("pos", F.col("id"))
    return f.merge_facts(current, new, "2001-12-31")


@query("f5_expire_facts", "fx_facts", oracle="""
WITH e AS (SELECT *, valid_to IS NULL AND make_date(CAST(substr(period, 3, 4) AS BIGINT), 12, 31) < DATE '2001-12-31' - 90 AND deleted = 0 AS expired FROM fx_facts)
SELECT id, expired, CASE WHEN expired THEN DATE '2001-12-31' ELSE valid_to END AS valid_to FROM e""")
def f5(facts):
    return f.expire(facts, "2001-12-31").select("id", "expired", "valid_to")


@query("f5_expire_all_periods", "fx_facts", oracle="""
WITH y AS (SELECT *, CAST(substr(period, 3, 4) AS BIGINT) AS y, id % 9 AS k FROM fx_facts),
e AS (SELECT *, CASE k WHEN 0 THEN make_date(y, 6, 30) WHEN 1 THEN make_date(y, 3, 31) WHEN 2 THEN make_date(y, 9, 30) WHEN 3 THEN make_date(y, 6, 30) WHEN 4 THEN make_date(y + 2, 12, 31) WHEN 5 THEN valid_from WHEN 6 THEN make_date(y, 11, 30) WHEN 7 THEN NULL ELSE make_date(y, 9, 30) END AS period_end FROM y)
SELECT id, period_end, coalesce(valid_to IS NULL AND period_end < DATE '2001-12-31' - 90 AND deleted = 0, false) AS expired FROM e""")
def f5b(facts):
    y = F.substring("period", 3, 4)
    kinds = (F.concat(F.lit("FY"), F.substring("period", 5, 2), F.lit("E")), F.concat(F.lit("1Q"), F.substring("period", 5, 2), F.lit("A")), F.concat(y, F.lit("Q3")), F.concat(F.lit("H1 "), y), F.concat(y, F.lit("-"), (y.cast("int") + 2).cast("string")), F.lit("ttm"), F.concat(y, F.lit("-11")), F.lit("soon"), F.concat(F.lit("9M"), y))
    rows = facts.withColumn("period", F.element_at(F.array(*kinds), (F.col("id") % 9 + 1).cast("int")))
    end = interval(F.col("period"), F.col("valid_from"), 6)["end"]
    return f.expire(rows, "2001-12-31", fiscal_end=6).select("id", end.alias("period_end"), "expired")


@query("f6_query_facts", "fx_facts", "fx_pages", oracle="""
SELECT f.id, e.slug AS entity_slug, s.slug AS source_slug, metric, period, value_numeric, valid_from FROM fx_facts f JOIN fx_pages e ON e.id = f.entity_page_id LEFT JOIN fx_pages s ON s.id = f.source_page_id
WHERE f.deleted = 0 AND metric = 'unit_price' AND valid_to IS NULL AND table_id IS NOT NULL""")
def f6(facts, pages):
    return f.query_facts(facts, pages, metric="unit_price", table_only=True)


@query("f7_compare_facts", "fx_facts", oracle="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity_page_id, period ORDER BY valid_from DESC, id DESC) AS rn FROM fx_facts WHERE deleted = 0 AND metric = 'unit_price' AND table_id IS NOT NULL AND period IN ('FY1996', 'FY1997', 'FY1998'))
SELECT entity_page_id, max(value_numeric) FILTER (WHERE period = 'FY1996') AS fy1996, max(value_numeric) FILTER (WHERE period = 'FY1997') AS fy1997, max(value_numeric) FILTER (WHERE period = 'FY1998') AS fy1998 FROM r WHERE rn = 1 GROUP BY 1""")
def f7(facts):
    return f.compare_facts(facts, "unit_price", ["FY1996", "FY1997", "FY1998"])


_COMPARED = """w AS (SELECT f.id, f.period, value_numeric, valid_from, table_id, e.slug AS entity_slug, s.slug AS source_slug FROM fx_facts f JOIN fx_pages e ON e.id = f.entity_page_id LEFT JOIN fx_pages s ON s.id = f.source_page_id
 WHERE f.deleted = 0 AND metric = 'unit_price' AND table_id IS NOT NULL AND valid_to IS NULL AND period IN ('FY1995', 'FY1996', 'FY1997') AND e.slug LIKE 'concepts/part-1%' AND length(e.slug) <= 18),
c AS (SELECT * FROM w ORDER BY entity_slug, period, valid_from DESC NULLS LAST, id DESC LIMIT 150)"""


def _compared(facts, pages):
    entities = [f"concepts/part-{k}" for k in range(2000) if str(k)[0] == "1"]
    return f.compare_table_facts(f.table_facts(facts, pages, "unit_price", entities, ["FY1995", "FY1996", "FY1997"], current_only=True, limit=150))


@query("f7_compared_cells", "fx_facts", "fx_pages", oracle=f"WITH {_COMPARED}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_slug, period ORDER BY valid_from DESC NULLS LAST, id DESC) AS rn FROM c) SELECT entity_slug, period, id, value_numeric, valid_from, source_slug, table_id FROM r WHERE rn = 1")
def f7b(facts, pages):
    return _compared(facts, pages)[0]


@query("f7_used_tables", "fx_facts", "fx_pages", oracle=f"WITH {_COMPARED} SELECT source_slug, table_id, count(*) AS facts FROM c WHERE source_slug IS NOT NULL GROUP BY 1, 2")
def f7c(facts, pages):
    return _compared(facts, pages)[1]


@query("f9_consensus_stats", "fx_facts", oracle="""
SELECT entity_page_id, metric, count(*) AS n, round(avg(value_numeric), 6) AS mean, round(coalesce(stddev_samp(value_numeric), 0), 6) AS std, round(min(value_numeric), 6) AS low, round(max(value_numeric), 6) AS high,
 round(CASE WHEN avg(value_numeric) = 0 THEN 0.0 ELSE (max(value_numeric) - min(value_numeric)) / abs(avg(value_numeric)) END, 6) AS range_pct, round(min_by(value_numeric, (valid_from, id)), 6) AS earliest, round(max_by(value_numeric, (valid_from, id)), 6) AS latest
FROM fx_facts WHERE deleted = 0 AND value_numeric IS NOT NULL GROUP BY 1, 2""")
def f9(facts):
    return f.consensus_stats(facts)


@query("f10_drift", "fx_facts", oracle=f"WITH {_HALF} SELECT entity_page_id, metric, n, CASE WHEN n >= 2 THEN round(pct, 6) END AS drift_pct, CASE WHEN n >= 2 THEN {_TREND} ELSE 'insufficient_data' END AS trend FROM d")
def f10(facts):
    return f.drift(facts)


@query("f11_outliers", "fx_facts", oracle="""
WITH r AS (SELECT id, entity_page_id, metric, value_numeric AS v, avg(value_numeric) OVER w AS m, stddev_samp(value_numeric) OVER w AS s FROM fx_facts WHERE deleted = 0 AND value_numeric IS NOT NULL WINDOW w AS (PARTITION BY entity_page_id, metric))
SELECT id, entity_page_id, metric, round((v - m) / s, 6) AS z FROM r WHERE s > 0 AND round(abs((v - m) / s), 9) > 1.5""")
def f11(facts):
    return f.outliers(facts)


@query("f12_top_consensus_metrics", "fx_facts", oracle=f"""
WITH {_HALF}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity_page_id ORDER BY n DESC, sources DESC, metric) AS INTEGER) AS rank FROM d WHERE n >= 3 AND sources >= 2)
SELECT entity_page_id, rank, metric, n, sources, round(mean, 6) AS mean, round(latest, 6) AS latest, round(pct, 6) AS drift_pct, {_TREND} AS trend FROM r WHERE rank <= 6""")
def f12(facts):
    return f.top_consensus_metrics(facts)


@query("f13_detect_fact_signals", "fx_facts", oracle="""
WITH p AS (SELECT a.id AS fact_id, a.entity_page_id, a.metric, a.value_numeric AS value, b.value_numeric AS v, row_number() OVER (PARTITION BY a.id ORDER BY b.valid_from DESC, b.id DESC) AS rn
 FROM fx_facts a JOIN fx_facts b ON a.entity_page_id = b.entity_page_id AND a.metric = b.metric AND a.period IS NOT DISTINCT FROM b.period AND a.source_page_id <> b.source_page_id AND a.id <> b.id AND b.deleted = 0
 WHERE a.deleted = 0 AND a.value_numeric IS NOT NULL AND a.valid_from >= DATE '2000-01-01'),
g AS (SELECT fact_id, entity_page_id, metric, any_value(value) AS value, avg(v) AS prior_avg, count(v) AS prior_count FROM p WHERE rn <= 10 GROUP BY 1, 2, 3),
d AS (SELECT *, (value - prior_avg) / abs(prior_avg) AS delta FROM g WHERE prior_count > 0 AND prior_avg <> 0)
SELECT fact_id, entity_page_id, metric, prior_count, round(delta, 6) AS delta_pct, CASE WHEN prior_count >= 2 THEN 'consensus_drift' ELSE 'fact_outlier' END AS signal_type,
 CASE WHEN abs(delta) >= 0.35 THEN 'critical' WHEN abs(delta) >= 0.2 THEN 'warning' ELSE 'info' END AS severity FROM d WHERE abs(delta) >= 0.1""")
def f13(facts):
    return f.detect_fact_signals(facts, facts.where("valid_from >= DATE '2000-01-01'"))


@query("f14_thesis_touch_signals", "fx_facts", "fx_theses", oracle="""
WITH l AS (SELECT f.source_page_id, 1000000 + f.entity_page_id % 97 AS target_page_id, CASE f.id % 3 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'confirms' ELSE 'mention' END AS link_type, f.id FROM fx_facts f WHERE deleted = 0)
SELECT source_page_id, t.page_id AS thesis_id, CASE WHEN min_by(link_type, l.id) IN ('contradicts', 'critiques', 'supersedes') THEN 'thesis_invalidation' ELSE 'thesis_validation' END AS signal_type
FROM l JOIN fx_theses t ON t.target_page_id = l.target_page_id AND t.status = 'active' GROUP BY 1, 2""")
def f14(facts, theses):
    kind = F.when(F.col("id") % 3 == 0, "contradicts").when(F.col("id") % 3 == 1, "confirms").otherwise("mention")
    links = facts.select(F.col("source_page_id").alias("from_page_id"), (1000000 + F.col("entity_page_id") % 97).alias("to_page_id"), kind.alias("link_type"), "id", "deleted")
    return f.thesis_touch_signals(links, theses)


@query("f16_dedupe_signals", "fx_signals", oracle="""
WITH r AS (SELECT id, thesis_page_id IS NOT NULL AND source_page_id IS NOT NULL AND deleted = 0 AS full_key, row_number() OVER (PARTITION BY signal_type, entity_page_id, thesis_page_id, source_page_id ORDER BY detected_at DESC, id DESC) AS rn, deleted FROM fx_signals)
SELECT id, CAST(CASE WHEN full_key AND rn > 1 THEN 1 ELSE deleted END AS INTEGER) AS deleted FROM r""")
def f16(signals):
    return f.dedupe_signals(signals).select("id", "deleted")


@query("f17_thesis_list", "fx_theses", "fx_pages", oracle="SELECT t.page_id, t.title, t.status, t.direction, p.slug AS target_slug, t.update_date FROM fx_theses t LEFT JOIN fx_pages p ON p.id = t.target_page_id AND p.deleted = 0 WHERE t.status IN ('active', 'monitoring')")
def f17(theses, pages):
    return f.thesis_list(theses, pages)


@query("f18_thesis_snapshot_signals", "fx_theses", "fx_signals", oracle="""
WITH b AS (SELECT t.page_id AS thesis_id, s.id, s.detected_at FROM fx_theses t JOIN fx_signals s ON s.thesis_page_id = t.page_id WHERE s.deleted = 0 UNION SELECT t.page_id, s.id, s.detected_at FROM fx_theses t JOIN fx_signals s ON s.entity_page_id = t.target_page_id WHERE s.deleted = 0),
r AS (SELECT thesis_id, id, CAST(row_number() OVER (PARTITION BY thesis_id ORDER BY detected_at DESC, id DESC) AS INTEGER) AS rn FROM b) SELECT thesis_id, rn, id FROM r WHERE rn <= 20""")
def f18(theses, signals):
    return f.thesis_snapshot_signals(theses, signals)


@query("f20_entity_pulse", "fx_facts", "fx_links", oracle="""
WITH f AS (SELECT entity_page_id AS page_id, count(*) AS facts, count(DISTINCT metric) AS metrics, count(DISTINCT source_page_id) AS sources FROM fx_facts WHERE deleted = 0 GROUP BY 1),
l AS (SELECT to_page_id AS page_id, count(*) AS inbound, count(*) FILTER (WHERE weight >= 0.9 OR link_type <> 'mention' OR (link_source = 'frontmatter' AND origin_field = 'primary_entities') OR origin_field IN ('facts_block', 'timeline_block')) AS effective,
 count(*) FILTER (WHERE link_type = 'confirms') AS y, count(*) FILTER (WHERE link_type = 'contradicts') AS n FROM fx_links WHERE deleted = 0 GROUP BY 1)
SELECT page_id, coalesce(facts, 0) AS facts, coalesce(metrics, 0) AS metrics, coalesce(sources, 0) AS sources, coalesce(inbound, 0) AS inbound, coalesce(effective, 0) AS effective, CASE WHEN y + n > 0 THEN round((y - n)::DOUBLE / (y + n), 6) END AS strength FROM f FULL JOIN l USING (page_id)""")
def f20(facts, links):
    return f.entity_pulse(facts, links)


@query("f21_source_facts", "fx_facts", oracle="SELECT source_page_id, CAST(row_number() OVER (PARTITION BY source_page_id ORDER BY entity_page_id, metric, period NULLS LAST, id) AS INTEGER) AS rn, id FROM fx_facts WHERE deleted = 0 AND valid_to IS NULL")
def f21(facts):
    return f.source_facts(facts)


@query("f21_page_timeline", "fx_timeline", oracle="""
WITH b AS (SELECT entity_page_id AS page_id, id, event_date FROM fx_timeline UNION SELECT source_page_id, id, event_date FROM fx_timeline),
r AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY event_date DESC, id DESC) AS INTEGER) AS rn, id, event_date FROM b) SELECT * FROM r WHERE rn <= 30""")
def f21b(timeline):
    return f.page_timeline(timeline)


@query("f4_merge_facts_texts", "fx_facts", oracle="""
WITH c AS (SELECT entity_page_id, metric, period, value_numeric, id FROM (SELECT *, row_number() OVER (PARTITION BY entity_page_id, metric, period ORDER BY valid_from DESC, id DESC) AS k FROM fx_facts) WHERE k = 1)
SELECT entity_page_id, metric, period, 'kept' AS action, CASE WHEN id % 2 = 0 THEN 'q' ELSE 'new quote' END AS source_quote, CASE WHEN id % 3 = 0 THEN 'a longer context' ELSE 'new context' END AS evidence_context FROM c WHERE id % 5 <> 0
UNION ALL SELECT entity_page_id, metric, period, 'closed', CASE WHEN id % 2 = 0 THEN 'q' END, CASE WHEN id % 3 = 0 THEN 'a longer context' ELSE 'short' END FROM c WHERE id % 5 = 0
UNION ALL SELECT entity_page_id, metric, period, 'inserted', 'new quote', 'new context' FROM c WHERE id % 5 = 0""")
def f4b(facts):
    k = F.col("id")
    one = f.dedupe_candidates(facts, ["entity_page_id", "metric", "period"], [F.desc("valid_from"), F.desc("id")]).withColumns({"value_text": F.lit("t"), "unit": F.lit("usd")})
    current = one.withColumns({"source_quote": F.when(k % 2 == 0, "q"), "evidence_context": F.when(k % 3 == 0, "a longer context").otherwise("short")})
    new = one.withColumns({"source_quote": F.lit("new quote"), "evidence_context": F.lit("new context"), "unit": F.when(k % 5 == 0, "eur").otherwise(F.col("unit")), "pos": k})
    return f.merge_facts(current, new, "2001-12-31").select("entity_page_id", "metric", "period", "action", "source_quote", "evidence_context")


@query("f6_query_facts_of_entity", "fx_facts", "fx_pages", oracle="""
SELECT f.id, e.slug AS entity_slug, s.slug AS source_slug, metric, period, value_numeric, valid_from FROM fx_facts f JOIN fx_pages e ON e.id = f.entity_page_id LEFT JOIN fx_pages s ON s.id = f.source_page_id
WHERE f.deleted = 0 AND e.slug = 'concepts/part-7' ORDER BY valid_from DESC, f.id DESC LIMIT 50""")
def f6b(facts, pages):
    return f.query_facts(facts, pages, current_only=False, entity="concepts/part-7", limit=50)


@query("f17_thesis_page", "fx_theses", "fx_pages", oracle="SELECT t.page_id, t.title, t.status, t.direction, p.slug AS target_slug, t.update_date FROM fx_theses t LEFT JOIN fx_pages p ON p.id = t.target_page_id AND p.deleted = 0 WHERE direction = 'long' ORDER BY conviction_rank DESC NULLS LAST, t.update_date DESC NULLS LAST, page_id LIMIT 20 OFFSET 20")
def f17b(theses, pages):
    return f.thesis_page(theses, pages, 20, 20, "long")


@query("f18_thesis_snapshot_facts", "fx_theses", "fx_facts", oracle="""
WITH t AS (SELECT page_id AS thesis_id, 3000000 + page_id % 500 AS target FROM fx_theses), r AS (SELECT thesis_id, f.id, CAST(row_number() OVER (PARTITION BY thesis_id ORDER BY valid_from DESC, f.id DESC) AS INTEGER) AS rn FROM t JOIN fx_facts f ON f.entity_page_id = target WHERE f.deleted = 0 AND valid_to IS NULL) SELECT thesis_id, rn, id FROM r WHERE rn <= 20""")
def f18b(theses, facts):
    return f.thesis_snapshot_facts(theses.select("page_id", (3000000 + F.col("page_id") % 500).alias("target_page_id")), facts)


_SNAPSHOT = """t AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN 3000000 + page_id % 500 WHEN page_id % 50 = 1 THEN 1 ELSE target_page_id END AS target FROM fx_theses WHERE page_id % 29 <> 0), pg AS (SELECT id, slug FROM fx_pages UNION ALL SELECT page_id, 'theses/' || lower(title) FROM t),
fr AS (SELECT t.page_id, f.id, metric, period, value_numeric, unit, source_page_id, CAST(row_number() OVER (PARTITION BY t.page_id ORDER BY valid_from DESC, f.id DESC) AS INTEGER) AS rn FROM t JOIN (SELECT *, CASE WHEN id % 2 = 0 THEN 'usd' END AS unit FROM fx_facts WHERE deleted = 0 AND valid_to IS NULL) f ON f.entity_page_id = t.target),
sr AS (SELECT t.page_id, s.id, signal_type, severity, detected_at, CAST(row_number() OVER (PARTITION BY t.page_id ORDER BY detected_at DESC, s.id DESC) AS INTEGER) AS rn FROM t JOIN fx_signals s ON s.deleted = 0 AND (s.thesis_page_id = t.page_id OR s.entity_page_id = t.target))"""


def _snapshots(theses, pages, facts, signals):
    k = F.col("page_id")
    target = F.when(k % 3 == 0, 3000000 + k % 500).when(k % 50 == 1, 1).otherwise(F.col("target_page_id"))
    theses = theses.where("page_id % 29 <> 0").withColumn("target_page_id", target)
    own = theses.select(k.alias("id"), F.lit("thesis").alias("type"), F.concat(F.lit("theses/"), F.lower("title")).alias("slug"))
    return f.thesis_snapshots(theses, pages.select("id", "type", "slug").unionByName(own), facts.withColumn("unit", F.when(F.col("id") % 2 == 0, "usd")), signals)


@query("f18_thesis_states", "fx_theses", "fx_pages", "fx_facts", "fx_signals", oracle=f"""
WITH {_SNAPSHOT} SELECT t.page_id, direction, status, title, update_date, 'theses/' || lower(title) AS slug, coalesce(pg.slug, '(unknown)') AS target_slug, CAST(coalesce(fn, 0) AS INTEGER) AS facts, CAST(coalesce(sn, 0) AS INTEGER) AS signals FROM t LEFT JOIN pg ON pg.id = target
LEFT JOIN (SELECT page_id, least(count(*), 20) AS fn FROM fr GROUP BY 1) a USING (page_id) LEFT JOIN (SELECT page_id, least(count(*), 20) AS sn FROM sr GROUP BY 1) b USING (page_id)""")
def f18c(theses, pages, facts, signals):
    rows = _snapshots(theses, pages, facts, signals)
    return rows.select("page_id", "direction", "status", "title", "update_date", "slug", "target_slug", F.size("recent_facts").alias("facts"), F.size("recent_signals").alias("signals"))


@query("f18_thesis_state_facts", "fx_theses", "fx_pages", "fx_facts", "fx_signals", oracle=f"WITH {_SNAPSHOT} SELECT page_id, rn, fr.id, metric, period, value_numeric AS value, unit, pg.slug AS source_slug FROM fr LEFT JOIN pg ON pg.id = source_page_id WHERE rn <= 20")
def f18d(theses, pages, facts, signals):
    rows = _snapshots(theses, pages, facts, signals).select("page_id", F.inline("recent_facts"))
    return rows.withColumn("value", F.col("value").cast("double"))


@query("f18_thesis_state_signals", "fx_theses", "fx_pages", "fx_facts", "fx_signals", oracle=f"WITH {_SNAPSHOT} SELECT page_id, rn, id, signal_type, severity, detected_at FROM sr WHERE rn <= 20")
def f18e(theses, pages, facts, signals):
    return _snapshots(theses, pages, facts, signals).select("page_id", F.inline("recent_signals")).drop("title")


@query("f20_entity_latest", "fx_facts", "fx_links", oracle="""
WITH a AS (SELECT entity_page_id AS page_id, 'fact' AS kind, CAST(row_number() OVER (PARTITION BY entity_page_id ORDER BY valid_from DESC, id DESC) AS INTEGER) AS rn, id FROM fx_facts WHERE deleted = 0
UNION ALL SELECT to_page_id, 'inbound', CAST(row_number() OVER (PARTITION BY to_page_id ORDER BY coalesce(weight >= 0.9 OR link_type <> 'mention' OR (link_source = 'frontmatter' AND origin_field = 'primary_entities') OR origin_field IN ('facts_block', 'timeline_block'), false) DESC, weight DESC, create_time DESC, id DESC) AS INTEGER), id FROM fx_links WHERE deleted = 0) SELECT * FROM a WHERE rn <= 10""")
def f20b(facts, links):
    return f.entity_latest(facts, links)
