"""Queries of the link graph."""

from pyspark.sql import functions as F

from lorebase.operators import graph as g
from lorebase.plans.catalog import query

_E = """(weight >= 0.9 OR link_type <> 'mention' OR (link_source = 'frontmatter' AND origin_field = 'primary_entities') OR origin_field IN ('facts_block', 'timeline_block'))"""
_W = """CASE WHEN origin_field IN ('facts_block', 'timeline_block') THEN 1.2 WHEN link_source = 'frontmatter' AND origin_field = 'primary_entities' THEN 1.0 WHEN link_type <> 'mention' THEN 1.0
 WHEN link_source = 'manual' THEN 1.0 WHEN link_source = 'extracted' THEN 0.7 WHEN link_source = 'entity_candidate' THEN 0.7 WHEN link_source = 'frontmatter' THEN 0.6 WHEN link_source = 'markdown' THEN 0.3 ELSE 0.5 END"""
_COUNTS = f"""i AS (SELECT to_page_id AS page_id, count(*) AS t, count(*) FILTER (WHERE {_E}) AS e, count(*) FILTER (WHERE NOT {_E}) AS w FROM fx_links WHERE deleted = 0 GROUP BY 1),
 o AS (SELECT from_page_id AS page_id, count(*) AS t, count(*) FILTER (WHERE {_E}) AS e, count(*) FILTER (WHERE NOT {_E}) AS w FROM fx_links WHERE deleted = 0 GROUP BY 1)"""
_COUNTED = """coalesce(i.t, 0) AS inbound_total, coalesce(i.e, 0) AS inbound_effective, coalesce(i.w, 0) AS inbound_weak, coalesce(o.t, 0) AS outbound_total, coalesce(o.e, 0) AS outbound_effective, coalesce(o.w, 0) AS outbound_weak
 FROM fx_pages p LEFT JOIN i ON i.page_id = p.id LEFT JOIN o ON o.page_id = p.id WHERE p.deleted = 0"""
_MISSING = """m AS (SELECT f.source_page_id, f.entity_page_id, p.type AS entity_type, count(*) AS fact_count FROM fx_facts f JOIN fx_pages p ON p.id = f.entity_page_id AND p.deleted = 0 AND p.type IN ('company', 'concept', 'industry')
 JOIN fx_pages s ON s.id = f.source_page_id AND s.deleted = 0 WHERE f.deleted = 0 AND f.source_page_id <> f.entity_page_id
 AND NOT EXISTS (SELECT 1 FROM fx_links l WHERE l.deleted = 0 AND l.link_source = 'extracted' AND l.origin_field = 'facts_block' AND l.from_page_id = f.source_page_id AND l.to_page_id = f.entity_page_id) GROUP BY 1, 2, 3)"""


@query("g4_effective_links", "fx_links", oracle=f"SELECT id, {_E} AS effective FROM fx_links WHERE deleted = 0")
def g4(links):
    return g.active(links).select("id", g.is_effective().alias("effective"))


@query("g5_reweight_links", "fx_links", oracle=f"SELECT id, CAST({_W} AS DOUBLE) AS weight FROM fx_links WHERE deleted = 0")
def g5(links):
    return g.active(links).select("id", g.default_weight().alias("weight"))


@query("g6_link_counts", "fx_pages", "fx_links", oracle=f"WITH {_COUNTS} SELECT p.id AS page_id, {_COUNTED}")
def g6(pages, links):
    return g.link_counts(pages, links)


@query("g7_link_type_distribution", "fx_links", oracle=f"""
WITH b AS (SELECT to_page_id AS page_id, 'in' AS direction, * FROM fx_links WHERE deleted = 0 UNION ALL SELECT from_page_id, 'out', * FROM fx_links WHERE deleted = 0)
SELECT page_id, direction, link_type, count(*) AS n, count(*) FILTER (WHERE {_E}) AS effective, count(*) FILTER (WHERE NOT {_E}) AS weak, round(sum(weight), 6) AS weight_sum FROM b GROUP BY 1, 2, 3""")
def g7(links):
    return g.link_type_distribution(links)


@query("g8_consensus_strength", "fx_links", oracle="""
WITH c AS (SELECT to_page_id AS page_id, count(*) FILTER (WHERE link_type = 'confirms') AS confirms, count(*) FILTER (WHERE link_type = 'contradicts') AS contradicts FROM fx_links WHERE deleted = 0 GROUP BY 1)
SELECT *, CASE WHEN confirms + contradicts > 0 THEN round((confirms - contradicts)::DOUBLE / (confirms + contradicts), 6) END AS strength FROM c""")
def g8(links):
    return g.consensus_strength(links)


@query("g9_recent_inbound", "fx_links", "fx_pages", oracle=f"""
WITH r AS (SELECT l.to_page_id AS page_id, l.id, p.slug AS source_slug, l.link_type, coalesce({_E}, false) AS effective, l.weight, p.create_date FROM fx_links l JOIN fx_pages p ON p.id = l.from_page_id AND p.deleted = 0 WHERE l.deleted = 0),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY effective DESC, weight DESC, create_date DESC, id) AS INTEGER) AS rn FROM r) SELECT page_id, rn, id, source_slug, link_type, effective, weight FROM n WHERE rn <= 10""")
def g9(links, pages):
    return g.recent_inbound(links, pages, 10)


@query("g10_aggregate_page_links", "fx_links", "fx_pages", oracle=f"""
SELECT p.slug, link_type, count(*) AS occurrences, count(*) FILTER (WHERE {_E}) AS effective, count(*) FILTER (WHERE NOT {_E}) AS weak, max(weight) AS max_weight, string_agg(DISTINCT link_source, ',' ORDER BY link_source) AS provenance
FROM fx_links l JOIN fx_pages p ON p.id = l.to_page_id AND p.deleted = 0 WHERE l.deleted = 0 GROUP BY 1, 2""")
def g10(links, pages):
    return g.aggregate_page_links(links, pages)


@query("g11_missing_provenance_links", "fx_facts", "fx_links", "fx_pages", oracle=f"WITH {_MISSING} SELECT * FROM m")
def g11(facts, links, pages):
    return g.missing_provenance_links(facts, links, pages)


@query("g12_backfill_provenance_links", "fx_facts", "fx_links", "fx_pages", oracle=f"WITH {_MISSING} SELECT entity_type, count(*) AS inserted, count(DISTINCT entity_page_id) AS pages, count(DISTINCT source_page_id) AS sources FROM m GROUP BY 1")
def g12(facts, links, pages):
    return g.backfill_summary(g.missing_provenance_links(facts, links, pages))


@query("g12_backfill_links", "fx_facts", "fx_links", "fx_pages", oracle=f"WITH {_MISSING} SELECT source_page_id AS from_page_id, entity_page_id AS to_page_id, 'mention' AS link_type, 'extracted' AS link_source, 'facts_block' AS origin_field, CAST(1.2 AS DOUBLE) AS weight FROM m ORDER BY fact_count DESC, source_page_id, entity_page_id LIMIT 1000")
def g12b(facts, links, pages):
    return g.backfill_links(g.missing_provenance_links(facts, links, pages))


@query("g13_retire_type", "fx_pages", "fx_links", oracle="""
WITH gone AS (SELECT id FROM fx_pages WHERE deleted = 0 AND type = 'concept')
SELECT id, CAST(CASE WHEN from_page_id IN (SELECT id FROM gone) OR to_page_id IN (SELECT id FROM gone) THEN 1 ELSE deleted END AS INTEGER) AS deleted FROM fx_links""")
def g13(pages, links):
    return g.retire_type(pages, links, "concept")[1].select("id", "deleted")


@query("g15_page_profile", "fx_pages", "fx_links", oracle=f"WITH {_COUNTS} SELECT p.id AS page_id, p.slug, p.type, coalesce(nullif(p.display_name, ''), p.title, p.slug) AS display, {_COUNTED}")
def g15(pages, links):
    return g.page_profile(pages, links)


@query("g15_tagged_profile", "fx_pages", "fx_links", "fx_tags", oracle="SELECT p.id AS page_id, coalesce(nullif(p.display_name, ''), p.title, p.slug) AS display, coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM fx_tags t WHERE t.deleted = 0 AND t.page_id = p.id), '') AS tags FROM fx_pages p WHERE p.deleted = 0")
def g15b(pages, links, tags):
    return g.page_profile(pages, links, tags).select("page_id", "display", F.array_join("tags", ",").alias("tags"))


@query("e12_find_orphans", "fx_pages", "fx_links", oracle="""
SELECT id, slug, type, CAST(datediff('day', create_date, DATE '2001-12-31') AS INTEGER) AS age_days FROM fx_pages p WHERE deleted = 0 AND type IN ('company', 'industry', 'concept') AND NOT EXISTS (SELECT 1 FROM fx_links l WHERE l.deleted = 0 AND l.to_page_id = p.id)""")
def e12(pages, links):
    return g.orphans(pages, links, "2001-12-31")
