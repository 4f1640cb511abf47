"""Queries of merging, retiring, demoting, enriching, refreshing, reviewing and theses."""

from pyspark.sql import functions as F

from lorebase.operators import entities as e
from lorebase.operators import facts as f
from lorebase.operators import graph as g
from lorebase.operators import lifecycle as lc
from lorebase.operators import reviews as r
from lorebase.operators import similarity as sim
from lorebase.operators import theses as th
from lorebase.plans.catalog import query
from lorebase.plans.entities import SCORES
from lorebase.sources.keyed import KeyedTable, save_tables
from lorebase.sources.shared import shared_folder

_TABLES = ("fx_pages", "fx_links", "fx_facts", "fx_timeline", "fx_signals", "fx_theses", "fx_tags", "fx_merges")


def _tables(pages, links, facts, timeline, signals, theses, tags):
    return {"pages": pages, "links": links, "facts": facts, "timeline": timeline, "signals": signals, "theses": theses, "tags": tags}


def _merged(pages, links, facts, timeline, signals, theses, tags, merges):
    return lc.apply_merges(_tables(pages, links, facts, timeline, signals, theses, tags), merges, "merge", "2001-12-31")


def _moved(table, column, keys, extra=""):
    """SQL of a table's rows after the merges: the column by its new id, moved repeats deleted."""
    same = f", row_number() OVER (PARTITION BY {keys}, deleted ORDER BY moved, id) AS k" if keys else ", 1 AS k"
    return f"""WITH a AS (SELECT t.* EXCLUDE ({column}), coalesce(m.new, t.{column}) AS {column}, m.new IS NOT NULL AS moved FROM {table} t LEFT JOIN fx_merges m ON m.old = t.{column}), b AS (SELECT *{same} FROM a)
SELECT id, {column}{extra}, CAST(CASE WHEN deleted = 0 AND moved AND k > 1 THEN 1 ELSE deleted END AS INTEGER) AS deleted FROM b"""


@query("e9_merge_facts", *_TABLES, oracle=_moved("fx_facts", "entity_page_id", "entity_page_id, metric, period, value_numeric, source_page_id, valid_from, valid_to"))
def e9a(*t):
    return _merged(*t)["facts"].select("id", "entity_page_id", "deleted")


@query("e9_merge_timeline", *_TABLES, oracle=_moved("fx_timeline", "entity_page_id", "entity_page_id, event_date, summary"))
def e9b(*t):
    return _merged(*t)["timeline"].select("id", "entity_page_id", "deleted")


@query("e9_merge_tags", *_TABLES, oracle=_moved("fx_tags", "page_id", "page_id, tag"))
def e9c(*t):
    return _merged(*t)["tags"].select("id", "page_id", "deleted")


@query("e9_merge_signals", *_TABLES, oracle=_moved("fx_signals", "entity_page_id", ""))
def e9d(*t):
    return _merged(*t)["signals"].select("id", "entity_page_id", "deleted")


@query("e9_merge_theses", *_TABLES, oracle="SELECT page_id, coalesce(new, target_page_id) AS target_page_id FROM fx_theses LEFT JOIN fx_merges ON old = target_page_id")
def e9e(*t):
    return _merged(*t)["theses"].select("page_id", "target_page_id")


@query("e9_merge_links", *_TABLES, oracle="""
WITH a AS (SELECT l.id, coalesce(x.new, from_page_id) AS from_page_id, coalesce(y.new, to_page_id) AS to_page_id, link_type, link_source, x.new IS NOT NULL OR y.new IS NOT NULL AS moved, deleted FROM fx_links l LEFT JOIN fx_merges x ON x.old = from_page_id LEFT JOIN fx_merges y ON y.old = to_page_id),
b AS (SELECT * REPLACE (CASE WHEN moved AND from_page_id = to_page_id THEN 1 ELSE deleted END AS deleted) FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY from_page_id, to_page_id, link_type, link_source, deleted ORDER BY moved, id) AS k FROM b)
SELECT id, from_page_id, to_page_id, CAST(CASE WHEN deleted = 0 AND moved AND k > 1 THEN 1 ELSE deleted END AS INTEGER) AS deleted FROM c""")
def e9f(*t):
    return _merged(*t)["links"].select("id", "from_page_id", "to_page_id", "deleted")


@query("e9_merge_pages", *_TABLES, oracle="""
WITH p AS (SELECT c.id, c.content, c.deleted, m.old, d.slug AS dslug, d.title AS dtitle, d.display_name AS ddisplay, d.content AS dcontent, d.deleted AS ddeleted, d.alias_csv AS daliases, c.alias_csv AS aliases, c.title, c.slug FROM fx_pages c LEFT JOIN fx_merges m ON m.new = c.id LEFT JOIN fx_pages d ON d.id = m.old AND d.deleted = 0),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(content), '\\[\\[([^\\[\\]|]+)\\|([^\\[\\]]+)\\]\\]', '\\2', 'g'), '\\[\\[([^\\[\\]]+)\\]\\]', '\\1', 'g'), '\\s+', ' ', 'g') AS known, regexp_replace(regexp_replace(regexp_replace(lower(dcontent), '\\[\\[([^\\[\\]|]+)\\|([^\\[\\]]+)\\]\\]', '\\2', 'g'), '\\[\\[([^\\[\\]]+)\\]\\]', '\\1', 'g'), '\\s+', ' ', 'g') AS dnew FROM p)
SELECT n.id, CASE WHEN dslug IS NOT NULL AND NOT contains(known, trim(dnew)) THEN 'Merged context from [[' || dslug || '|' || coalesce(ddisplay, dtitle) || ']] during entity dedupe.' || chr(10) || chr(10) || dcontent ELSE content END AS content,
 CAST(CASE WHEN dslug IS NULL THEN len(string_split(aliases, ',')) ELSE len(list_distinct([lower(trim(x)) FOR x IN list_concat(string_split(aliases, ','), string_split(daliases, ','), [dtitle, split_part(dslug, '/', 2), title, split_part(slug, '/', 2)]) IF trim(x) <> ''])) END AS INTEGER) AS aliases,
 CAST(CASE WHEN g.old IS NOT NULL THEN 1 ELSE deleted END AS INTEGER) AS deleted FROM n LEFT JOIN fx_merges g ON g.old = n.id""")
def e9g(*t):
    return _merged(*t)["pages"].select("id", "content", F.size(F.split("alias_csv", ",")).alias("aliases"), "deleted")


@query("e9_stored_merge", *_TABLES, oracle=_moved("fx_timeline", "entity_page_id", "entity_page_id, event_date, summary"))
def e9_stored(*t):
    """Tables in storage, merged there twice: the second merge finds nothing to rewrite."""
    *tables, merges = t
    spark = merges.sparkSession
    names = ("pages", "links", "timeline")
    now = _tables(*tables)
    stored = {n: KeyedTable(spark, shared_folder(spark, n), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now[n].schema), ["id"], buckets=16) for n in names}
    save_tables(stored, now, "load")
    for commit in ("first", "second"):
        here = now | {n: table.read() for n, table in stored.items()}
        changed = save_tables(stored, lc.apply_merges(here, merges, "merge", "2001-12-31"), commit)
    assert commit == "second" and not any(changed.values()), changed
    return stored["timeline"].read().select("id", "entity_page_id", "deleted")


@query("s10_append_events", *_TABLES, oracle="SELECT old AS entity_id, 'page_merge_duplicate' AS action FROM fx_merges UNION ALL SELECT new, 'page_merge_canonical' FROM fx_merges")
def s10(*t):
    return _merged(*t)["events"].select("entity_id", "action")


def _similar(pages):
    return sim.similar_pairs(g.active(pages).select("id", "type", "title").where("type IN ('company', 'industry', 'concept')"), "title", ["type"], 0.7).select("a", "b", "similarity")


@query("e5_merge_candidates", "fx_pages", "fx_links")
def e5(pages, links):
    return lc.merge_candidates(pages, links, _similar(pages), human_review=True)


@query("e5_merge_candidates_by_name", "fx_pages", "fx_links", oracle="""
WITH k AS (SELECT id, type, unnest(list_distinct([lower(trim(x)) FOR x IN list_concat([title, regexp_replace(slug, '^[^/]*/', '')], string_split(alias_csv, ',')) IF trim(x) <> ''])) AS key FROM fx_pages WHERE deleted = 0),
l AS (SELECT type, key, min(id) AS a FROM k GROUP BY 1, 2 HAVING count(*) > 1), p AS (SELECT a, id AS b, count(*) AS shared FROM k JOIN l USING (type, key) WHERE id <> a GROUP BY 1, 2),
c AS (SELECT to_page_id AS id, count(*) FILTER (WHERE weight >= 0.9 OR link_type <> 'mention' OR (link_source = 'frontmatter' AND origin_field = 'primary_entities') OR origin_field IN ('facts_block', 'timeline_block')) AS n FROM fx_links WHERE deleted = 0 GROUP BY 1),
s AS (SELECT p.id, 100 * CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END + 10 * coalesce(n, 0) + 10 * completeness_score + len([x FOR x IN string_split(alias_csv, ',') IF x <> '']) AS rank FROM fx_pages p LEFT JOIN c USING (id) WHERE deleted = 0)
SELECT CASE WHEN y.rank > x.rank THEN b ELSE a END AS canonical, CASE WHEN y.rank > x.rank THEN a ELSE b END AS duplicate, shared AS shared_keys FROM p JOIN s x ON x.id = a JOIN s y ON y.id = b""")
def e5b(pages, links):
    none = pages.sparkSession.createDataFrame([], "a long, b long, similarity double")
    return lc.merge_candidates(pages, links, none, human_review=True).select("canonical", "duplicate", "shared_keys")


@query("e8_merge_risk_of_pairs", "fx_pages", "fx_links")
def e8(pages, links):
    none = pages.sparkSession.createDataFrame([], "a long, b long, similarity double")
    return lc.merge_candidates(pages, links, none, human_review=True).select("canonical", "duplicate", "text_overlap", "canonical_chars", "dup_chars", "mode", "priority")


@query("e11_auto_cleanup", *_TABLES[:-1])
def e11(*t):
    return lc.auto_cleanup(_tables(*t), _similar, "2001-12-31")[1]


@query("e14_retire_pages", *_TABLES[:-1], oracle="""
SELECT 'pages' AS t, p.id, CAST(CASE WHEN entity_state = 'stub' AND type = 'company' THEN 1 ELSE deleted END AS INTEGER) AS deleted FROM fx_pages p
UNION ALL SELECT 'tags', t.id, CAST(CASE WHEN p.id IS NOT NULL THEN 1 ELSE t.deleted END AS INTEGER) FROM fx_tags t LEFT JOIN fx_pages p ON p.id = t.page_id AND p.entity_state = 'stub' AND p.type = 'company'""")
def e14(*t):
    tables = _tables(*t)
    out = lc.retire_pages(tables, t[0].where("entity_state = 'stub' AND type = 'company'").select("id"), "stub", "2001-12-31")
    return out["pages"].select(F.lit("pages").alias("t"), "id", "deleted").unionByName(out["tags"].select(F.lit("tags").alias("t"), "id", "deleted"))


@query("e20_promotion_effects", "fx_mentions", "fx_pages", oracle="""
SELECT DISTINCT slug, source_page_id, CAST(0.7 AS DOUBLE) AS weight, 'entity_candidate' AS link_source FROM fx_mentions WHERE slug LIKE 'companies/firm-%'""")
def e20(mentions, pages):
    c = e.upsert_candidates(mentions).select("slug", "status").join(mentions.groupBy("slug").agg(F.collect_set("source_page_id").alias("source_page_ids")), "slug")
    return lc.promoted_candidates(c, c.select("slug", F.lit("promote").alias("decision")), pages)[1]


@query("e26_apply_enrichment", "fx_pages", oracle="""
SELECT id, CASE WHEN type <> 'company' THEN alias_csv WHEN id % 3 = 0 THEN 'New Name' WHEN id % 3 = 1 THEN alias_csv || ',Extra' ELSE string_split(alias_csv, ',')[2] END AS alias_csv,
 CASE WHEN type = 'company' AND (confidence IS NULL OR confidence = 'low') THEN CASE WHEN id % 5 = 0 THEN coalesce(confidence, 'low') ELSE 'medium' END ELSE confidence END AS confidence, CASE WHEN type = 'company' THEN 'compiled' ELSE entity_state END AS entity_state,
 CASE WHEN type = 'company' THEN 'The ' || title ELSE display_name END AS display_name FROM fx_pages""")
def e26(pages):
    k = F.col("id") % 3
    none = F.lit(None).cast("array<string>")
    u = pages.where("type = 'company'").select(
        "id", F.when(k == 1, F.array(F.lit(" Extra "), F.lit("extra"))).otherwise(none).alias("aliases_add"), F.when(k == 2, F.array(F.upper("title"))).otherwise(none).alias("aliases_remove"),
        F.when(k == 0, F.array(F.lit("New Name"), F.lit("new name "))).otherwise(none).alias("aliases_replace"), F.lit(None).cast("string").alias("confidence"), F.concat(F.lit("The  "), "title").alias("display_name"),
    )
    reviews = pages.select("id", F.when(F.col("id") % 5 == 0, "fail").otherwise("pass").alias("status"))
    return lc.apply_enrichment(pages, u, reviews).select("id", "alias_csv", "confidence", "entity_state", "display_name")


_GOOD = "".join(f"## {s}\n\nWhat [[sources/order-1]] says of it, at some length. Source: [[sources/order-2]].\n\n" for s in r.PROFILES["company"][2]) + "Words. " * 60


@query("e26_enrich_pages", "fx_pages", oracle=f"""
WITH g AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN '{_GOOD}' ELSE 'too short' END AS content, 'compiled' AS entity_state, 'M,' || alias_csv AS alias_csv,
 CASE WHEN confidence IS NULL OR confidence = 'low' THEN CASE WHEN id % 2 = 0 THEN 'medium' ELSE coalesce(confidence, 'low') END ELSE confidence END AS confidence) FROM fx_pages WHERE type = 'company' AND deleted = 0), {SCORES.format(pages="g", day="1996-08-15")}
SELECT g.id, g.confidence, g.entity_state, score AS completeness_score, CASE WHEN g.id % 2 = 0 THEN 'pass' ELSE 'fail' END AS status FROM g JOIN scores USING (id)
UNION ALL SELECT id, confidence, entity_state, completeness_score, NULL FROM fx_pages WHERE type = 'concept'""")
def e26b(pages):
    none = F.lit(None).cast("array<string>")
    u = pages.where("type = 'company' AND deleted = 0").select("id", F.when(F.col("id") % 2 == 0, _GOOD).otherwise("too short").alias("content"), none.alias("aliases_add"), none.alias("aliases_remove"), F.concat(F.array(F.lit("M")), F.split("alias_csv", ",")).alias("aliases_replace"), F.lit(None).cast("string").alias("confidence"))
    out, reviews = lc.enrich_pages(pages, u, "1996-08-15")
    return out.where("type IN ('company', 'concept')").join(reviews.select(F.col("page_id").alias("id"), "status"), "id", "left").select("id", "confidence", "entity_state", "completeness_score", "status")


_EVIDENCE = """p AS (SELECT id, update_date FROM fx_pages WHERE deleted = 0 AND type IN ('company', 'industry', 'concept')),
c AS (SELECT entity_page_id AS page_id, source_page_id AS id FROM fx_facts WHERE deleted = 0 UNION SELECT entity_page_id, source_page_id FROM fx_timeline WHERE deleted = 0 UNION SELECT entity_page_id, source_page_id FROM fx_signals WHERE deleted = 0),
s AS (SELECT DISTINCT to_page_id AS page_id, from_page_id AS id FROM fx_links l WHERE deleted = 0 AND (link_type <> 'mention' OR EXISTS (SELECT 1 FROM c WHERE c.page_id = to_page_id AND c.id = from_page_id))),
a AS (SELECT page_id, 'source' AS kind, q.create_date AS day, s.id FROM s JOIN fx_pages q ON q.id = s.id AND q.deleted = 0 AND q.type IN ('source', 'brief') UNION ALL SELECT entity_page_id, 'fact', valid_from, id FROM fx_facts WHERE deleted = 0
 UNION ALL SELECT entity_page_id, 'timeline', event_date, id FROM fx_timeline WHERE deleted = 0 UNION ALL SELECT entity_page_id, 'signal', CAST(detected_at AS DATE), id FROM fx_signals WHERE deleted = 0),
r AS (SELECT page_id, kind, a.id, CAST(row_number() OVER (PARTITION BY page_id, kind ORDER BY day DESC, a.id DESC) AS INTEGER) AS rn FROM a JOIN p ON p.id = page_id WHERE day > update_date), ev AS (SELECT page_id, kind, rn, id FROM r WHERE rn <= CASE kind WHEN 'source' THEN 5 ELSE 10 END)"""


@query("e31_refresh_evidence", *_TABLES[:5], oracle=f"WITH {_EVIDENCE} SELECT page_id, kind, rn, id FROM ev")
def e31(*t):
    return lc.refresh_evidence(*t)


@query("e31_refresh_blocks", *_TABLES[:5], oracle=f"WITH {_EVIDENCE} SELECT DISTINCT page_id FROM ev")
def e31b(*t):
    return lc.refresh_blocks(t[0], lc.refresh_evidence(*t), *t[2:]).select("page_id")


@query("e32_refresh_queue", "fx_pages", "fx_jobs", oracle="""
WITH b AS (SELECT target_page_id AS page_id, max(CASE WHEN name = 'embed_chunks' THEN 1 END) AS refreshing, max(CASE WHEN name = 'enrich_entity' THEN 1 END) AS enriching FROM fx_jobs WHERE status IN ('waiting', 'active') GROUP BY 1),
q AS (SELECT id, CASE WHEN refreshing = 1 THEN 'already-in-flight' WHEN deleted = 1 THEN 'page-not-found' WHEN enriching = 1 THEN 'enrich-in-flight' WHEN entity_state IN ('stub', 'candidate_promoted') THEN 'needs-enrich-entity-state-' || entity_state WHEN length(trim(content)) < 200 THEN 'needs-enrich-short-content' ELSE 'queued' END AS reason FROM fx_pages LEFT JOIN b ON page_id = id WHERE type IN ('company', 'industry', 'concept'))
SELECT id AS page_id, reason = 'queued' AS queued, reason FROM q""")
def e32(pages, jobs):
    stale = pages.where("type IN ('company', 'industry', 'concept')").select(F.col("id").alias("page_id"), (F.col("id") % 70).cast("int").alias("priority"))
    busy = jobs.where("status IN ('waiting', 'active')").select(F.col("target_page_id").alias("page_id"), F.when(F.col("name") == "embed_chunks", "entity-refresh").otherwise(F.col("name")).alias("name"))
    return lc.refresh_queue(stale, pages, busy).drop("job_priority")


def _narratives(pages):
    kind = F.when(F.col("type") == "source", "source").otherwise(F.col("type"))
    body = F.concat(F.lit("## Definition\n\nThis is [["), "slug", F.lit("]] and what it means.\n\n### New Information\n\n- [[sources/a]]\n\n## Sources\n\nno\n"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("More words on it. "), 60)).otherwise(""))
    return pages.where("deleted = 0").select(F.col("id").alias("page_id"), kind.alias("type"), body.alias("content"), F.when(F.col("id") % 3 == 0, '{"research_id":"r","research_type":"","markdown_url":"u"}').alias("frontmatter"), F.lit("").alias("timeline"))


@query("q2_review_pages", "fx_pages", oracle="""
WITH p AS (SELECT *, length(slug) AS n FROM fx_pages WHERE deleted = 0)
SELECT id AS page_id, CAST('fail' AS VARCHAR) AS status,
 CAST(CASE type WHEN 'concept' THEN 2 + CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END WHEN 'source' THEN 9 + 1 + CASE WHEN id % 3 = 0 THEN 1 ELSE 3 END ELSE 8 + CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END END AS BIGINT) AS errors,
 CAST(CASE type WHEN 'concept' THEN CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END WHEN 'source' THEN 0 + 1 + 1 + 1 ELSE 1 + CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END END AS BIGINT) AS warnings FROM p""")
def q2(pages):
    return r.review_pages(_narratives(pages)).drop("content_hash")


@query("q2_review_issues", "fx_pages")
def q2b(pages):
    return r.review_issues(_narratives(pages))


@query("q4_gated_reviews", "fx_pages", oracle="SELECT id AS page_id, CASE WHEN id % 4 = 0 THEN 'pass' ELSE 'fail' END AS status, id % 4 = 0 AS reused FROM fx_pages WHERE deleted = 0")
def q4(pages):
    n = _narratives(pages)
    stored = n.where("page_id % 4 < 2").select("page_id", F.sha2(F.when(F.col("page_id") % 4 == 0, F.col("content")).otherwise(F.lit("old")), 256).alias("content_hash"), F.lit("pass").alias("status"))
    return r.gated_reviews(n, stored)


def _reports(orders):
    # dealt by id while rows are narrow: a text takes long to review, and one small file would be one task
    spark = orders.sparkSession
    orders = orders.select("id").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")
    kind = F.when(F.col("id") % 2 == 0, "daily-review").otherwise("daily-summarize")
    body = F.concat(F.lit("## Q1: Biggest Change In Understanding Today\n\n[[sources/a]] [[briefs/b]]\n\n## 4. New Positions\n\nentry 5, size 2% NAV, stop 4, target 9, risk low\n\n## 5. Reduce / Hedge\n\nno action\n"), F.repeat(F.lit("x "), (F.col("id") % 5 * 1000).cast("int")))
    front = F.to_json(F.struct(F.lit("output").alias("type"), kind.alias("subtype"), F.lit("t").alias("title"), F.lit("2024-01-01").alias("date"), F.when(F.col("id") % 3 == 0, F.array(F.lit("daily-review-1"))).alias("sources"), (F.col("id") % 3).cast("int").alias("active_thesis_count"), F.lit("watchlist").alias("portfolio_mode")))
    return orders.select(F.col("id").alias("page_id"), F.concat(F.lit("outputs/"), kind, F.lit("-"), F.col("id").cast("string")).alias("slug"), body.alias("content"), front.alias("frontmatter"))


@query("q6_review_outputs", "fx_jobs", oracle="""
WITH o AS (SELECT id, id % 2 AS k, id % 3 AS n, 175 + (id % 5) * 2000 AS chars FROM fx_jobs), i AS (
 SELECT id AS page_id, 'missing_frontmatter' AS code, unnest(CASE WHEN n = 0 THEN ['tags', 'last_updated'] ELSE ['sources', 'tags', 'last_updated'] END) AS d FROM o
 UNION ALL SELECT id, 'missing_section', unnest(CASE k WHEN 0 THEN range(7) ELSE range(8) END)::VARCHAR FROM o UNION ALL SELECT id, 'low_source_refs', '2' FROM o
 UNION ALL SELECT id, 'missing_questions', '3' FROM o WHERE k = 0 UNION ALL SELECT id, 'missing_sections', '3' FROM o WHERE k = 1
 UNION ALL SELECT id, 'short_output', '' FROM o WHERE chars < CASE k WHEN 0 THEN 5000 ELSE 7000 END
 UNION ALL SELECT id, 'missing_daily_review_reuse', unnest(['Q4', 'Q5', 'Q6']) FROM o WHERE k = 1 AND n = 0 UNION ALL SELECT id, 'missing_watchlist_disclaimer', '' FROM o WHERE k = 1 AND n = 0 UNION ALL SELECT id, 'watchlist_has_execution_fields', '' FROM o WHERE k = 1 AND n = 0
 UNION ALL SELECT id, 'wrong_portfolio_mode', '' FROM o WHERE k = 1 AND n > 0 UNION ALL SELECT id, 'incomplete_trade_sheet', 'catalyst' FROM o WHERE k = 1 AND n > 0)
SELECT page_id, code, count(*) AS n FROM i GROUP BY 1, 2""")
def q6(jobs):
    return r.output_issues(_reports(jobs)).groupBy("page_id", "code").agg(F.count("*").alias("n"))


@query("q7_output_backlog", "fx_jobs", oracle="SELECT id AS page_id, 'outputs/' || CASE WHEN id % 2 = 0 THEN 'daily-review' ELSE 'daily-summarize' END || '-' || CAST(id AS VARCHAR) AS slug, 'fail' AS status FROM fx_jobs ORDER BY 2 DESC LIMIT 30")
def q7(jobs):
    return r.output_backlog(_reports(jobs)).select("page_id", "slug", "status")


@query("q19_maintain", "fx_pages", "fx_links", "fx_facts", "fx_theses", oracle="""
WITH a AS (SELECT 'orphans' AS part, p.id FROM fx_pages p WHERE deleted = 0 AND type IN ('company', 'industry', 'concept') AND NOT EXISTS (SELECT 1 FROM fx_links l WHERE l.deleted = 0 AND l.to_page_id = p.id)
UNION ALL SELECT 'expired_facts', id FROM fx_facts WHERE valid_to IS NULL AND make_date(CAST(substr(period, 3, 4) AS BIGINT), 12, 31) < DATE '2001-12-31' - 90 AND deleted = 0
UNION ALL SELECT 'active_theses', page_id FROM fx_theses WHERE status IN ('active', 'monitoring') UNION ALL SELECT 'failing_reviews', id FROM fx_pages WHERE deleted = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) AS k, count(*) OVER (PARTITION BY part) AS n FROM a) SELECT part, n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE k <= 10) AS sample FROM k GROUP BY 1, 2""")
def q19(pages, links, facts, theses):
    return r.maintenance_report({
        "orphans": g.orphans(pages, links, "2001-12-31"), "expired_facts": f.expire(facts, "2001-12-31").where("expired"),
        "active_theses": f.thesis_list(theses, pages).select(F.col("page_id").alias("id")), "failing_reviews": r.review_pages(_narratives(pages)).where("status = 'fail'").select(F.col("page_id").alias("id")),
    })


@query("s13_save_outputs", "fx_jobs", "fx_pages", oracle="""
SELECT DISTINCT 'outputs/' || CASE WHEN id % 2 = 0 THEN 'daily-review' ELSE 'daily-summarize' END || '-' || strftime(create_date, '%Y-%m-%d') AS slug, unnest(list_concat([lower(x) FOR x IN ['Macro']], CASE WHEN id % 2 = 0 THEN ['daily-review', 'qa', 'old'] ELSE ['daily-summarize', 'pm-brief', 'ic-briefing', 'old'] END)) AS tag FROM fx_jobs""")
def s13(jobs, pages):
    docs = jobs.select(F.when(F.col("id") % 2 == 0, "daily-review").otherwise("daily-summarize").alias("subtype"), F.date_format("create_date", "yyyy-MM-dd").alias("date"), F.lit("").alias("title"), F.concat(F.lit("Body "), F.col("id").cast("string")).alias("content"), F.array(F.lit(" Macro "), F.lit("macro")).alias("tags"))
    here = docs.select(F.concat(F.lit("outputs/"), "subtype", F.lit("-"), "date").alias("slug"), F.lit("old").alias("tag"), F.lit(0).alias("deleted")).distinct()
    return r.save_outputs(docs, pages, here)[1].select("slug", "tag")


@query("f15_match_conditions", "fx_theses", "documents", oracle="""
WITH t AS (SELECT page_id AS thesis_id, ['der', 'zzzz ' || title] AS c FROM fx_theses WHERE status = 'active'), d AS (SELECT doc_id AS source_page_id, lower(text) AS body FROM documents),
p AS (SELECT source_page_id, thesis_id, c, body FROM d JOIN t ON thesis_id % 100 = source_page_id % 100) SELECT source_page_id, thesis_id, CAST(len([x FOR x IN c IF contains(body, lower(x))]) AS INTEGER) AS met FROM p""")
def f15(theses, documents):
    cond = lambda c, title: F.struct(c.cast("string").alias("condition"), title.cast("string").alias("title"), F.lit(None).cast("string").alias("summary"))
    t = theses.where("status = 'active'").select(F.col("page_id").alias("thesis_id"), F.array(cond(F.lit("DER"), F.lit(None)), cond(F.lit(" "), F.concat(F.lit("zzzz "), "title"))).alias("validation_conditions"))
    docs = documents.select(F.col("doc_id").alias("source_page_id"), F.coalesce("text", F.lit("")).alias("text"))
    touches = docs.select("source_page_id", (F.col("source_page_id") % 100).alias("k")).join(t.select("thesis_id", (F.col("thesis_id") % 100).alias("k")), "k").drop("k")
    return th.match_conditions(t, docs, touches).select("source_page_id", "thesis_id", F.size("conditions").alias("met"))


@query("f19_open_theses", "fx_theses", "fx_pages", oracle="""
SELECT 'theses/' || replace(lower(t.title), '#', '-') AS slug, p.id AS target_page_id, direction, 'medium' AS conviction, 'active' AS status, '2024-02-01' AS date_opened FROM fx_theses t JOIN fx_pages p ON p.id = t.target_page_id AND p.deleted = 0""")
def f19a(theses, pages):
    req = theses.join(pages.select(F.col("id").alias("target_page_id"), F.col("slug").alias("target_slug")), "target_page_id").select(F.col("title").alias("name"), "target_slug", "direction", F.lit(None).cast("string").alias("conviction"))
    new, opened, _ = th.open_theses(req, pages, "2024-02-01")
    return opened.join(new.select("page_id", "slug"), "page_id").drop("page_id")


@query("f19_update_theses", "fx_theses", oracle="""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'high' ELSE 'low' END AS conviction, status, CAST(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS catalysts, CASE WHEN page_id % 2 = 1 THEN 'c:open' WHEN page_id % 4 = 0 THEN 'c:met' ELSE 'c:open,d:met' END AS conditions FROM fx_theses""")
def f19b(theses):
    t = theses.select("page_id", F.lit("low").alias("conviction"), "status", F.lit(None).cast("array<string>").alias("catalysts"), F.array(F.struct(F.lit("c").alias("condition"), F.lit("open").alias("status"), F.lit("2023-01-01").alias("last_checked"))).alias("conditions"))
    even = F.col("page_id") % 2 == 0
    u = theses.select("page_id", F.when(even, "high").alias("conviction"), F.lit(None).cast("string").alias("status"), F.when(F.col("page_id") % 3 == 0, "launch").alias("add_catalyst"), F.when(even, F.when(F.col("page_id") % 4 == 0, "c").otherwise("d")).alias("mark_condition"), F.lit("met").alias("mark_status"))
    done = th.update_theses(t, u, "2024-02-01")
    return done.select("page_id", "conviction", "status", F.size("catalysts").alias("catalysts"), F.array_join(F.transform("conditions", lambda c: F.concat(c["condition"], F.lit(":"), c["status"])), ",").alias("conditions"))


@query("f19_close_theses", "fx_theses", "fx_pages", oracle="SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'invalidated' WHEN page_id % 3 = 1 THEN 'closed' ELSE status END AS status, CASE WHEN page_id % 3 < 2 THEN '2024-02-01' END AS date_closed FROM fx_theses")
def f19c(theses, pages):
    c = theses.where("page_id % 3 < 2").select("page_id", F.when(F.col("page_id") % 3 == 0, "invalidated").otherwise("manual").alias("reason"), F.lit("n").alias("note"))
    return th.close_theses(theses, pages, c, "2024-02-01")[0]
