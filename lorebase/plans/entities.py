"""Queries of entity resolution and lifecycle."""

from pyspark.sql import functions as F

from lorebase.operators import entities as e
from lorebase.operators import lifecycle as lc
from lorebase.operators import references as rf
from lorebase.operators import similarity as sim
from lorebase.plans.catalog import query

_ENTITY = "type IN ('company', 'industry', 'concept')"
_E = "(weight >= 0.9 OR link_type <> 'mention' OR (link_source = 'frontmatter' AND origin_field = 'primary_entities') OR origin_field IN ('facts_block', 'timeline_block'))"
_KEYS = "k AS (SELECT DISTINCT id, type, lower(trim(u)) AS key FROM (SELECT id, type, unnest(list_concat([title, split_part(slug, '/', 2)], string_split(alias_csv, ','))) AS u FROM fx_pages WHERE deleted = 0) WHERE lower(trim(u)) <> '')"
_TITLES = "SELECT p_partkey AS id, 'concept' AS type, p_name || ' ' || p_brand || ' ' || p_type AS title FROM part"
_GRAMS = r"""list_distinct(flatten([[substr('  ' || w || ' ', CAST(i AS BIGINT), 3) FOR i IN range(1, length(w) + 2)] FOR w IN [x FOR x IN regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+') IF x <> '']]))"""


@query("e2_find_duplicates", "part", oracle=f"""
WITH t AS ({_TITLES}), c AS (SELECT lower(title) AS title, min(id) AS id FROM t GROUP BY 1), g AS (SELECT id, {_GRAMS} AS g FROM c), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS n FROM g a JOIN g b ON a.id < b.id AND len(a.g) >= 0.7 * len(b.g) AND len(b.g) >= 0.7 * len(a.g))
SELECT 'concept' AS type, a, b, round(i::DOUBLE / (n - i), 6) AS similarity FROM p WHERE i::DOUBLE / (n - i) >= 0.7""")
def e2(part):
    rows = part.select(F.col("p_partkey").alias("id"), F.lit("concept").alias("type"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))
    return sim.similar_pairs(rows, "title", ["type"], 0.7)


@query("e2_duplicate_classes", "part", oracle=f"WITH t AS ({_TITLES}) SELECT id, min(id) OVER (PARTITION BY lower(title)) AS class FROM t")
def e2b(part):
    rows = part.select(F.col("p_partkey").alias("id"), F.lit("concept").alias("type"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))
    return sim.text_classes(rows, "title", ["type"])


@query("e1_trigram_sets", "fx_pages", oracle=f"SELECT id, len({_GRAMS})::INTEGER AS grams FROM fx_pages WHERE deleted = 0")
def e1(pages):
    return pages.where("deleted = 0").select("id", F.size(sim.trigrams(F.col("title"))).alias("grams"))


@query("e3_alias_conflicts", "fx_pages", oracle=f"WITH {_KEYS} SELECT type, key, count(*) AS pages, min(id) AS first_id FROM k WHERE {_ENTITY} GROUP BY 1, 2 HAVING count(*) > 1")
def e3(pages):
    return e.alias_conflicts(pages)


@query("e4_check_new_aliases", "fx_pages", oracle="""
WITH u AS (SELECT id, 'S' || CAST(id % 40 AS VARCHAR) AS alias FROM fx_pages WHERE type = 'industry'), t AS (SELECT id AS other_id, lower(title) AS key, 1 AS rank FROM fx_pages WHERE deleted = 0 UNION ALL SELECT id, lower(split_part(slug, '/', 2)), 2 FROM fx_pages WHERE deleted = 0
UNION ALL SELECT id, lower(trim(unnest(string_split(alias_csv, ',')))), 3 FROM fx_pages WHERE deleted = 0), m AS (SELECT u.id, lower(trim(alias)) AS key, other_id, min(rank) AS r FROM u JOIN t ON t.key = lower(trim(alias)) AND u.id <> other_id GROUP BY 1, 2, 3)
SELECT id, key, other_id, ['title', 'slug_name', 'alias'][r] AS matched_on FROM m""")
def e4(pages):
    updates = pages.where("type = 'industry'").select("id", F.concat(F.lit("S"), (F.col("id") % 40).cast("string")).alias("alias"))
    return e.check_new_aliases(updates, pages)


@query("e6_choose_canonical", "fx_pages", "fx_links", oracle=f"""
WITH b AS (SELECT to_page_id AS id, count(*) FILTER (WHERE {_E}) AS n FROM fx_links WHERE deleted = 0 GROUP BY 1),
s AS (SELECT p.id, 100 * CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END + 10 * coalesce(n, 0) + 10 * coalesce(completeness_score, 0) + len(string_split(alias_csv, ',')) AS score FROM fx_pages p LEFT JOIN b USING (id) WHERE type = 'concept')
SELECT x.id AS a, y.id AS b, CASE WHEN y.score > x.score THEN y.id ELSE x.id END AS canonical FROM s x JOIN s y ON y.id = x.id + 1""")
def e6(pages, links):
    concepts = pages.where("type = 'concept'")
    ids = concepts.select("id")
    pairs = ids.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    return e.choose_canonical(concepts, links, pairs)


@query("e7_narrative_overlap", "fx_pages", oracle=r"""
WITH t AS (SELECT id, list_distinct([x FOR x IN regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+') IF length(x) >= 3]) AS t, list_distinct(string_split(alias_csv, ',')) AS al FROM fx_pages WHERE type = 'concept')
SELECT x.id AS a, round(coalesce(len(list_intersect(x.t, y.t))::DOUBLE / nullif(least(len(x.t), len(y.t)), 0), 0), 6) AS narrative, round(coalesce(len(list_intersect(x.al, y.al))::DOUBLE / nullif(greatest(len(x.al), len(y.al)), 0), 0), 6) AS alias FROM t x JOIN t y ON y.id = x.id + 1""")
def e7(pages):
    t = pages.where("type = 'concept'").select("id", e.narrative_tokens(F.col("content")).alias("t"), F.array_distinct(F.split("alias_csv", ",")).alias("al"))
    n = t.select((F.col("id") - 1).alias("id"), F.col("t").alias("u"), F.col("al").alias("bl"))
    return t.join(n, "id").select(F.col("id").alias("a"), F.round(e.overlap(F.col("t"), F.col("u"), True), 6).alias("narrative"), F.round(e.overlap(F.col("al"), F.col("bl"), False), 6).alias("alias"))


def _mapping(part):
    """Every sixteenth concept goes to the one before it, that one to the one before."""
    k = F.col("p_partkey")
    return part.where(k % 16 < 2).where(k >= 2).select((3000000 + k).alias("old"), (3000000 + k - 1).alias("new"))


@query("e9_apply_merges_links", "part", "fx_links", oracle="""
WITH m AS (SELECT 3000000 + p_partkey AS old, 3000000 + p_partkey - CASE WHEN p_partkey % 16 = 1 AND p_partkey > 2 THEN 2 ELSE 1 END AS new FROM part WHERE p_partkey % 16 < 2 AND p_partkey >= 2),
l AS (SELECT id, coalesce(a.new, from_page_id) AS from_page_id, coalesce(b.new, to_page_id) AS to_page_id, link_type, link_source FROM fx_links LEFT JOIN m a ON a.old = from_page_id LEFT JOIN m b ON b.old = to_page_id),
r AS (SELECT *, row_number() OVER (PARTITION BY from_page_id, to_page_id, link_type, link_source ORDER BY id) AS rn FROM l WHERE from_page_id <> to_page_id) SELECT id, from_page_id, to_page_id, link_type, link_source FROM r WHERE rn = 1""")
def e9(part, links):
    return e.apply_merge_to_links(links, e.merge_mapping(_mapping(part)))


_KEPT = ("fx_pages", "fx_links", "fx_facts", "fx_timeline", "fx_signals", "fx_theses", "fx_tags", "fx_lead_pages", "fx_lead_links", "fx_lead_theses")


def _with_leads(pages, links, facts, timeline, signals, theses, tags, lead_pages, lead_links, lead_theses):
    """All tables, with pages of leads that are referred to in few ways or none."""
    return {"pages": pages.unionByName(lead_pages), "links": links.unionByName(lead_links), "facts": facts, "timeline": timeline, "signals": signals, "theses": theses.unionByName(lead_theses), "tags": tags}


_LEADS = """gp AS (SELECT * FROM fx_pages UNION ALL SELECT * FROM fx_lead_pages), gl AS (SELECT * FROM fx_links WHERE deleted = 0 UNION ALL SELECT * FROM fx_lead_links WHERE deleted = 0), gt AS (SELECT * FROM fx_theses UNION ALL SELECT * FROM fx_lead_theses)"""
_COUNTED = (("inbound_links", "gl", "to_page_id"), ("outbound_links", "gl", "from_page_id"), ("entity_facts", "fx_facts", "entity_page_id"), ("source_facts", "fx_facts", "source_page_id"), ("entity_timeline", "fx_timeline", "entity_page_id"), ("source_timeline", "fx_timeline", "source_page_id"),
            ("entity_signals", "fx_signals", "entity_page_id"), ("thesis_signals", "fx_signals", "thesis_page_id"), ("source_signals", "fx_signals", "source_page_id"), ("thesis_rows", "gt", "page_id"), ("target_theses", "gt", "target_page_id"), ("tags", "fx_tags", "page_id"))
_REPORT = f"""{_LEADS}, {", ".join(f"n_{n} AS (SELECT {c} AS id, count(*) AS {n} FROM {t} {'' if t in ('gl', 'gt') else 'WHERE deleted = 0'} GROUP BY 1)" for n, t, c in _COUNTED)},
r AS (SELECT p.id, p.slug, p.type, entity_state, CAST(length(coalesce(content, '')) AS INTEGER) AS chars, {", ".join(f"coalesce({n}, 0) AS {n}" for n, _, _ in _COUNTED)} FROM gp p {" ".join(f"LEFT JOIN n_{n} ON n_{n}.id = p.id" for n, _, _ in _COUNTED)} WHERE p.deleted = 0),
b AS (SELECT *, [x FOR x IN [CASE WHEN type NOT IN ('company', 'industry', 'concept', 'thesis') THEN 'type' END, CASE WHEN entity_state NOT IN ('stub', 'candidate_promoted') THEN 'entity_state' END, CASE WHEN chars > 300 THEN 'content_chars' END,
 {", ".join(f"CASE WHEN {n} > 0 THEN '{n}' END" for n, _, _ in _COUNTED[:-1])}] IF x IS NOT NULL] AS blockers FROM r)"""


@query("e10_merge_plan", "fx_merges", *_KEPT, oracle=f"""
WITH {_LEADS}, l AS (SELECT from_page_id AS id FROM gl UNION ALL SELECT to_page_id FROM gl WHERE to_page_id <> from_page_id), m AS (SELECT DISTINCT old AS page_id FROM fx_merges),
c AS (SELECT id, 'links' AS t FROM l UNION ALL SELECT entity_page_id, 'facts' FROM fx_facts WHERE deleted = 0 UNION ALL SELECT entity_page_id, 'timeline' FROM fx_timeline WHERE deleted = 0 UNION ALL SELECT entity_page_id, 'signals' FROM fx_signals WHERE deleted = 0
 UNION ALL SELECT target_page_id, 'theses' FROM gt UNION ALL SELECT page_id, 'tags' FROM fx_tags WHERE deleted = 0)
SELECT page_id, {", ".join(f"count(*) FILTER (WHERE t = '{t}') AS {t}" for t in ("links", "facts", "timeline", "signals", "theses", "tags"))} FROM m LEFT JOIN c ON c.id = m.page_id GROUP BY 1""")
def e10(merges, *t):
    return rf.merge_plan(merges, _with_leads(*t)).drop("raw_data", "chunks")


@query("e13_retire_report", *_KEPT, oracle=f"WITH {_REPORT} SELECT id, slug, type, chars, {', '.join(n for n, _, _ in _COUNTED)}, array_to_string(blockers, ',') AS blockers FROM b")
def e13b(*t):
    return rf.retire_report(_with_leads(*t)).drop("origin_links", "raw_data", "chunks").withColumn("blockers", F.array_join("blockers", ","))


@query("e13_retire_candidates", *_KEPT, oracle=f"WITH {_REPORT} SELECT id, slug, chars FROM b WHERE len(blockers) = 0")
def e13(*t):
    return rf.retire_candidates(_with_leads(*t))


_WEAK = f"""i AS (SELECT to_page_id AS id, count(*) FILTER (WHERE NOT coalesce({_E}, false)) AS weak, count(*) FILTER (WHERE coalesce({_E}, false)) AS strong, count(DISTINCT from_page_id) AS origins FROM gl WHERE from_page_id <> to_page_id GROUP BY 1),
d AS (SELECT b.id, b.slug, weak, origins, alias_csv FROM b JOIN i USING (id) JOIN gp USING (id) WHERE strong = 0 AND weak > 0 AND b.{_ENTITY} AND b.entity_state IN ('stub', 'candidate_promoted') AND ticker IS NULL AND exchange IS NULL AND chars <= 1300
 AND entity_facts + source_facts + entity_timeline + source_timeline + entity_signals + thesis_signals + source_signals + thesis_rows + target_theses = 0)"""


@query("e15_demotable_pages", *_KEPT, oracle=f"WITH {_REPORT}, {_WEAK} SELECT id, slug, weak, origins FROM d")
def e15(*t):
    return rf.demotable_pages(_with_leads(*t))


@query("e16_demote_to_candidates", *_KEPT, oracle=f"""
WITH {_REPORT}, {_WEAK}
SELECT 'candidate' AS kind, d.slug, count(DISTINCT from_page_id) AS n, max(array_to_string(list_sort(string_split(alias_csv, ',')), ',')) AS detail FROM d JOIN gl ON to_page_id = d.id GROUP BY d.slug
UNION ALL SELECT 'page', slug, 1, NULL FROM d UNION ALL SELECT 'link', CAST(gl.id AS VARCHAR), 1, NULL FROM gl WHERE to_page_id IN (SELECT id FROM d) OR from_page_id IN (SELECT id FROM d)""")
def e16(*t):
    before = _with_leads(*t)
    after = lc.demote_to_candidates(before, "2001-12-31")
    gone = lambda name, key: after[name].where("deleted = 1").join(before[name].where("deleted = 0").select("id"), "id", "left_semi").select(F.lit(name.rstrip("s")).alias("kind"), F.col(key).cast("string").alias("slug"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("detail"))
    candidates = after["candidates"].select(F.lit("candidate").alias("kind"), "slug", F.col("evidence_count").alias("n"), F.col("aliases").alias("detail"))
    return candidates.unionByName(gone("pages", "slug")).unionByName(gone("links", "id"))


_MENTIONS = """m AS (SELECT slug, count(DISTINCT source_page_id) AS evidence_count, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases, CASE WHEN regexp_matches(split_part(slug, '/', 2), '^(unknown|major-)') THEN 'rejected' ELSE 'pending' END AS status FROM fx_mentions GROUP BY 1)"""


@query("e17_upsert_candidates", "fx_mentions", oracle=f"WITH {_MENTIONS} SELECT * FROM m")
def e17(mentions):
    return e.upsert_candidates(mentions)


@query("e18_auto_reject", "fx_mentions", oracle="SELECT DISTINCT slug, CASE WHEN slug LIKE 'companies/unknown-%' THEN 'generic-placeholder' WHEN slug LIKE 'companies/major-%' THEN 'generic-descriptor' END AS reason FROM fx_mentions")
def e18(mentions):
    return mentions.select("slug").distinct().withColumn("reason", e.auto_reject_reason(F.col("slug")))


@query("e19_list_candidates", "fx_mentions", oracle=f"WITH {_MENTIONS} SELECT * FROM m ORDER BY CASE status WHEN 'pending' THEN 0 ELSE 3 END, evidence_count DESC, slug LIMIT 50")
def e19(mentions):
    return e.list_candidates(e.upsert_candidates(mentions))


_W = r"len(regexp_extract_all(content, '\[\[[a-z]+/[^\]|#]+'))"
_C = r"(len(regexp_extract_all(content, '\[\[sources/')) + CASE WHEN regexp_matches(content, '(?i)sources?[:：]') THEN 1 ELSE 0 END)"


#: The completeness score of pages (a table or subquery) on a day.
SCORES = f"""d AS (SELECT *, length(trim(content)) AS n, len([x FOR x IN string_split(alias_csv, ',') IF x <> '']) AS a, {_W} AS w, {_C} AS c, datediff('day', update_date, DATE '{{day}}') AS days FROM {{pages}} WHERE deleted = 0),
s AS (SELECT *, CASE WHEN n = 0 THEN 0.0 WHEN n < 200 THEN 0.2 WHEN n < 800 THEN 0.5 WHEN n < 2000 THEN 0.8 ELSE 1.0 END::DOUBLE AS co, CASE WHEN a = 0 THEN 0.0 WHEN a = 1 THEN 0.3 WHEN a = 2 THEN 0.6 ELSE 1.0 END::DOUBLE AS al,
 CASE WHEN w = 0 THEN 0.0 WHEN w < 3 THEN 0.4 WHEN w < 10 THEN 0.7 ELSE 1.0 END::DOUBLE AS wi, CASE WHEN c = 0 THEN 0.0 WHEN c < 2 THEN 0.3 WHEN c < 5 THEN 0.7 ELSE 1.0 END::DOUBLE AS ci, CASE WHEN days < 30 THEN 1.0 WHEN days < 90 THEN 0.7 WHEN days < 365 THEN 0.4 ELSE 0.1 END::DOUBLE AS re,
 CASE WHEN trim(coalesce(ticker, '')) <> '' THEN 1.0 WHEN exchange IS NOT NULL THEN 0.6 ELSE 0.0 END::DOUBLE AS li, CASE WHEN sector IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS se, CASE WHEN exchange IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS ex FROM d),
scores AS (SELECT id, type, round(round(CASE type WHEN 'company' THEN 0.20 * co + 0.15 * li + 0.10 * se + 0.15 * al + 0.10 * wi + 0.15 * ci + 0.05 * re + 0.10 * ex WHEN 'industry' THEN 0.30 * co + 0.20 * al + 0.20 * wi + 0.20 * ci + 0.10 * re WHEN 'concept' THEN 0.35 * co + 0.15 * al + 0.20 * wi + 0.20 * ci + 0.10 * re ELSE 0.0 END, 9), 3) AS score FROM s)"""


@query("e28_completeness_score", "fx_pages", oracle="WITH " + SCORES.format(pages="fx_pages", day="1996-08-15") + " SELECT * FROM scores")
def e28(pages):
    return e.completeness(pages, "1996-08-15")


#: pages of theses with the texts of documents, sectors of companies on two levels
_RUBRIC_PAGES = """pg AS (SELECT 4000000 + doc_id AS id, 'thesis' AS type, 0 AS deleted, coalesce(text, '') || CASE doc_id % 4 WHEN 1 THEN ' [[companies/a]] Source: [[sources/a]]' WHEN 2 THEN ' [[a/b]] [[c/d|e]] [[e/f#g]] (per [[sources/a]], sources: x)' ELSE '' END AS content,
 '' AS alias_csv, CAST(NULL AS VARCHAR) AS ticker, CAST(NULL AS VARCHAR) AS exchange, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS sector, CAST(NULL AS VARCHAR) AS sub_sector, doc_id % 3 = 0 AS conditions, doc_id % 5 = 0 AS catalysts, CASE WHEN doc_id % 7 <> 0 THEN DATE '1996-07-30' - CAST(doc_id % 500 AS INTEGER) END AS update_date FROM documents
UNION ALL SELECT id, type, deleted, content, alias_csv, ticker, exchange, CASE WHEN id % 4 = 1 THEN 'US' WHEN id % 4 = 2 THEN '' END, sector, CASE WHEN id % 3 = 0 THEN 'chips' END, false, false, update_date FROM fx_pages WHERE type = 'company'),
d AS (SELECT *, length(trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8232) || chr(8233) || chr(12288) || chr(65279))) AS n, len([x FOR x IN string_split(alias_csv, ',') IF x <> '']) AS a, len(regexp_extract_all(content, '\\[\\[[a-z]+/[^\\]|#]+')) AS w,
 len(regexp_extract_all(content, '\\[\\[sources/')) + CASE WHEN regexp_matches(content, '(?i)sources?[:：]') THEN 1 ELSE 0 END + len(regexp_extract_all(content, '\\(per\\s+\\[\\[')) + len(regexp_extract_all(content, '来源[:：]')) AS c, datediff('day', update_date, DATE '1996-08-15') AS days FROM pg WHERE deleted = 0),
s AS (SELECT id, type, CASE WHEN n = 0 THEN 0.0 WHEN n < 200 THEN 0.2 WHEN n < 800 THEN 0.5 WHEN n < 2000 THEN 0.8 ELSE 1.0 END::DOUBLE AS co, CASE WHEN a = 0 THEN 0.0 WHEN a = 1 THEN 0.3 WHEN a = 2 THEN 0.6 ELSE 1.0 END::DOUBLE AS al, CASE WHEN w = 0 THEN 0.0 WHEN w < 3 THEN 0.4 WHEN w < 10 THEN 0.7 ELSE 1.0 END::DOUBLE AS wi,
 CASE WHEN c = 0 THEN 0.0 WHEN c < 2 THEN 0.3 WHEN c < 5 THEN 0.7 ELSE 1.0 END::DOUBLE AS ci, CASE WHEN days IS NULL THEN 0.0 WHEN days < 30 THEN 1.0 WHEN days < 90 THEN 0.7 WHEN days < 365 THEN 0.4 ELSE 0.1 END::DOUBLE AS re, CASE WHEN trim(coalesce(ticker, '')) <> '' THEN 1.0 WHEN exchange IS NOT NULL THEN 0.6 ELSE 0.0 END::DOUBLE AS li,
 (CASE WHEN sector IS NOT NULL THEN 0.5 ELSE 0.0 END + CASE WHEN sub_sector IS NOT NULL THEN 0.5 ELSE 0.0 END)::DOUBLE AS se, CASE WHEN exchange IS NOT NULL OR country = 'US' THEN 1.0 ELSE 0.0 END::DOUBLE AS ex, CASE WHEN conditions THEN 1.0 ELSE 0.0 END::DOUBLE AS vc, CASE WHEN catalysts THEN 1.0 ELSE 0.0 END::DOUBLE AS ca FROM d)"""


def _rubric_pages(pages, documents):
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    tail = F.when(k % 4 == 1, " [[companies/a]] Source: [[sources/a]]").when(k % 4 == 2, " [[a/b]] [[c/d|e]] [[e/f#g]] (per [[sources/a]], sources: x)").otherwise("")
    matter = F.to_json(F.struct(F.when(k % 3 == 0, F.array(F.struct(F.lit("x").alias("condition")))).when(k % 3 == 1, F.array().cast("array<struct<condition:string>>")).alias("validation_conditions"), F.when(k % 5 == 0, "launch").when(k % 5 == 1, "  ").alias("catalysts")))
    day = F.when(k % 7 != 0, F.date_sub(F.lit("1996-07-30").cast("date"), (k % 500).cast("int")))
    theses = documents.select((k + 4000000).alias("id"), F.lit("thesis").alias("type"), F.lit(0).alias("deleted"), F.concat(F.coalesce("text", F.lit("")), tail).alias("content"), F.lit("").alias("alias_csv"), *[none.alias(c) for c in ("ticker", "exchange", "country", "sector", "sub_sector")], matter.alias("frontmatter"), day.alias("update_date"))
    i = F.col("id")
    firms = pages.where("type = 'company'").withColumns({"country": F.when(i % 4 == 1, "US").when(i % 4 == 2, ""), "sub_sector": F.when(i % 3 == 0, "chips"), "frontmatter": none})
    return theses.unionByName(firms.select(*theses.columns))


@query("e28_completeness_of_theses", "fx_pages", "documents", oracle=f"""
WITH {_RUBRIC_PAGES} SELECT id, type, round(round(CASE type WHEN 'company' THEN 0.20 * co + 0.15 * li + 0.10 * se + 0.15 * al + 0.10 * wi + 0.15 * ci + 0.05 * re + 0.10 * ex ELSE 0.30 * co + 0.15 * wi + 0.15 * ci + 0.20 * vc + 0.10 * ca + 0.10 * re END, 9), 3) AS score FROM s""")
def e28b(pages, documents):
    return e.completeness(_rubric_pages(pages, documents), "1996-08-15")


_PART_ROWS = " UNION ALL ".join(
    f"SELECT id, type, '{part}' AS part, {weight}::DOUBLE AS weight, {column} AS score FROM s WHERE type = '{kind}'"
    for kind, column_of in (
        ("company", {"content": "co", "listing_or_ownership": "li", "sector": "se", "aliases": "al", "wikilinks": "wi", "citations": "ci", "recency": "re", "country_or_exchange": "ex"}),
        ("thesis", {"content": "co", "wikilinks": "wi", "citations": "ci", "validation_conditions": "vc", "catalysts": "ca", "recency": "re"}),
    )
    for (part, column), weight in zip(column_of.items(), {"company": (0.20, 0.15, 0.10, 0.15, 0.10, 0.15, 0.05, 0.10), "thesis": (0.30, 0.15, 0.15, 0.20, 0.10, 0.10)}[kind], strict=True)
)


@query("e28_completeness_parts", "fx_pages", "documents", oracle=f"WITH {_RUBRIC_PAGES} {_PART_ROWS}")
def e28c(pages, documents):
    return e.completeness_parts(_rubric_pages(pages, documents), "1996-08-15")


@query("e33_bootstrap_states", "fx_pages", "fx_events", "fx_mentions", oracle=f"""
WITH c AS (SELECT DISTINCT 3000000 + CAST(regexp_extract(slug, '([0-9]+)$', 1) AS BIGINT) AS id FROM fx_mentions WHERE CAST(regexp_extract(slug, '([0-9]+)$', 1) AS BIGINT) % 2 = 0), d AS (SELECT DISTINCT entity_id AS id FROM fx_events WHERE action = 'enrich')
SELECT p.id, CASE WHEN length(content) <= 300 AND confidence = 'low' AND d.id IS NULL THEN CASE WHEN c.id IS NOT NULL THEN 'candidate_promoted' ELSE 'stub' END ELSE 'compiled' END AS state FROM fx_pages p LEFT JOIN d ON d.id = p.id LEFT JOIN c ON c.id = p.id WHERE p.deleted = 0 AND {_ENTITY}""")
def e33(pages, events, mentions):
    user = F.regexp_extract("slug", "([0-9]+)$", 1).cast("long")
    candidates = mentions.select(F.when(user % 2 == 0, "promoted").otherwise("pending").alias("status"), (user + 3000000).alias("promoted_page_id"), F.lit(0).alias("deleted")).distinct()
    return e.bootstrap_states(pages, events, candidates)


@query("e20_resolve_candidates", "fx_mentions", oracle=f"""
WITH {_MENTIONS}, d AS (SELECT slug, CASE length(slug) % 3 WHEN 0 THEN 'promote' WHEN 1 THEN 'reject' END AS decision FROM m), x AS (SELECT m.slug, m.status, decision, coalesce(decision IS NOT NULL AND (status = 'pending' OR (status = 'rejected' AND decision = 'reject')), false) AS changed FROM m LEFT JOIN d USING (slug))
SELECT slug, CASE WHEN changed THEN CASE decision WHEN 'promote' THEN 'promoted' ELSE 'rejected' END ELSE status END AS status, changed FROM x""")
def e20(mentions):
    c = e.upsert_candidates(mentions)
    k = F.length("slug") % 3
    return e.resolve_candidates(c, c.select("slug", F.when(k == 0, "promote").when(k == 1, "reject").alias("decision")))


def _decisions(mentions):
    c = mentions.groupBy("slug").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.array_sort(F.collect_set("source_page_id")).alias("source_page_ids"))
    user = F.regexp_extract("slug", r"(\d+)$", 1).cast("long")
    c = c.select("slug", F.lit("company").alias("type"), F.concat(F.lit("Firm "), user.cast("string")).alias("display_name"), "aliases", "source_page_ids", F.when(e.auto_reject_reason(F.col("slug")).isNotNull(), "rejected").otherwise("pending").alias("status"))
    decision = F.when(user % 4 == 0, "promote").when(user % 4 == 1, "reject").when(user % 4 == 2, "merge")
    target = F.when(user % 8 == 2, F.concat(F.lit("companies/supplier-"), F.lpad((user % 10 + 1).cast("string"), 9, "0"))).when(user % 16 == 6, "concepts/part-1").otherwise("companies/nobody")
    return c, c.select("slug", decision.alias("decision"), target.alias("target_slug"))


_SETTLED = """c AS (SELECT slug, CAST(regexp_extract(slug, '(\\d+)$', 1) AS BIGINT) AS u, regexp_matches(split_part(slug, '/', 2), '^(unknown|major-)') AS bad, list_sort(list_distinct(list(alias))) AS aliases, list_sort(list_distinct(list(source_page_id))) AS s FROM fx_mentions GROUP BY 1),
d AS (SELECT *, CASE WHEN bad AND u % 4 IN (0, 2) THEN 'status' WHEN u % 4 = 2 AND t.id IS NULL THEN 'no_target' WHEN u % 4 = 2 AND t.type <> 'company' THEN 'type' END AS problem, t.id AS target_id FROM c LEFT JOIN (SELECT slug AS ts, min(id) AS id, min(type) AS type FROM fx_pages WHERE deleted = 0 GROUP BY 1) t
 ON u % 4 = 2 AND ts = CASE WHEN u % 8 = 2 THEN 'companies/supplier-' || lpad(CAST(u % 10 + 1 AS VARCHAR), 9, '0') WHEN u % 16 = 6 THEN 'concepts/part-1' ELSE 'companies/nobody' END)"""


@query("e20_settled_candidates", "fx_pages", "fx_links", "fx_mentions", oracle=f"WITH {_SETTLED} SELECT slug, CASE WHEN problem IS NULL AND u % 4 = 0 THEN 'promoted' WHEN u % 4 = 1 THEN 'rejected' WHEN problem IS NULL AND u % 4 = 2 THEN 'merged' WHEN bad THEN 'rejected' ELSE 'pending' END AS status, problem FROM d")
def e20b(pages, links, mentions):
    return e.settle_candidates(pages, links, *_decisions(mentions))[2].select("slug", "status", "problem")


@query("e20_merged_pages", "fx_pages", "fx_links", "fx_mentions", oracle=f"""
WITH {_SETTLED}, m AS (SELECT target_id AS id, flatten(list(list_prepend('Firm ' || CAST(u AS VARCHAR), aliases) ORDER BY slug)) AS names FROM d WHERE problem IS NULL AND u % 4 = 2 GROUP BY 1),
a AS (SELECT p.id, list_concat(string_split(alias_csv, ','), names) AS v FROM fx_pages p JOIN m USING (id))
SELECT slug, entity_state, CASE WHEN v IS NULL THEN alias_csv ELSE array_to_string([v[i] FOR i IN range(1, len(v) + 1) IF list_position([lower(x) FOR x IN v], lower(v[i])) = i], ',') END AS alias_csv FROM fx_pages LEFT JOIN a USING (id) WHERE type = 'company'
UNION ALL SELECT slug, 'candidate_promoted', array_to_string(aliases, ',') FROM d WHERE problem IS NULL AND u % 4 = 0""")
def e20c(pages, links, mentions):
    return e.settle_candidates(pages, links, *_decisions(mentions))[0].where("type = 'company'").select("slug", "entity_state", "alias_csv")


@query("e20_candidate_links", "fx_pages", "fx_links", "fx_mentions", oracle=f"""
WITH {_SETTLED}, n AS (SELECT slug, (SELECT max(id) FROM fx_pages) + row_number() OVER (ORDER BY slug) AS id FROM d WHERE problem IS NULL AND u % 4 = 0)
SELECT DISTINCT unnest(s) AS from_page_id, coalesce(n.id, target_id) AS to_page_id, 'mention' AS link_type, 'extracted' AS link_source, 0.7::DOUBLE AS weight FROM d LEFT JOIN n USING (slug) WHERE problem IS NULL AND u % 4 IN (0, 2)""")
def e20d(pages, links, mentions):
    return e.settle_candidates(pages, links, *_decisions(mentions))[1].where("origin_field = 'entity_candidate'").select("from_page_id", "to_page_id", "link_type", "link_source", "weight")


@query("e27_retype_pages", "fx_pages", oracle="""
WITH n AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'industries/' ELSE 'concepts/' END || split_part(slug, '/', 2) AS new_slug FROM fx_pages WHERE type = 'concept' AND id % 3 = 0),
t AS (SELECT n.*, EXISTS (SELECT 1 FROM fx_pages p WHERE p.deleted = 0 AND p.slug = n.new_slug) AS taken FROM n)
SELECT p.id, CASE WHEN t.id IS NOT NULL AND NOT taken THEN new_slug ELSE slug END AS slug, CASE WHEN t.id IS NOT NULL AND NOT taken THEN 'industry' ELSE type END AS type, coalesce(taken, false) AS conflict FROM fx_pages p LEFT JOIN t ON t.id = p.id""")
def e27(pages):
    moves = pages.where("type = 'concept' AND id % 3 = 0").select("id", F.lit("industry").alias("new_type"), F.when(F.col("id") % 2 == 0, "industries").otherwise("concepts").alias("new_dir"))
    return e.retype_pages(pages, moves)


@query("g2_create_missing_pages", "fx_mentions", "fx_pages", oracle="""
SELECT DISTINCT slug, split_part(slug, '/', 2) AS title, 'company' AS type, 'stub' AS entity_state FROM fx_mentions m WHERE slug LIKE 'companies/firm-%' AND NOT EXISTS (SELECT 1 FROM fx_pages p WHERE p.deleted = 0 AND p.slug = m.slug)""")
def g2(mentions, pages):
    return e.create_missing_pages(mentions, pages)


@query("e8_merge_risk", "fx_chunks", oracle="""
WITH p AS (SELECT id AS a, id + 1 AS b, id % 5 * 2500 AS dup_chars, CAST(id % 13 AS DOUBLE) / 10 AS ratio, id % 11 AS sections, id % 2 = 0 AS has_updates, CAST(id % 8 AS DOUBLE) / 10 AS overlap FROM fx_chunks)
SELECT a, b, CASE WHEN dup_chars = 0 THEN 'auto_merge' WHEN dup_chars > 8000 OR ratio > 1.1 OR (sections >= 8 AND overlap < 0.45) THEN 'human_review' WHEN dup_chars > 2000 OR ratio > 0.6 OR has_updates OR overlap < 0.35 THEN 'structure_only' ELSE 'auto_merge' END AS mode FROM p""")
def e8(chunks):
    i = F.col("id")
    return e.merge_risk(chunks.select(i.alias("a"), (i + 1).alias("b"), (i % 5 * 2500).alias("dup_chars"), ((i % 13).cast("double") / 10).alias("ratio"), (i % 11).alias("sections"), (i % 2 == 0).alias("has_updates"), ((i % 8).cast("double") / 10).alias("overlap")))


def _named_pairs(pages):
    """Pairs of pages that share a name: each with the smallest id."""
    keys = e.alias_keys(pages)
    low = keys.groupBy("type", "key").agg(F.min("id").alias("a"))
    return keys.join(low, ["type", "key"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()


_PAIRS = f"{_KEYS}, l AS (SELECT type, key, min(id) AS a FROM k GROUP BY 1, 2), pr AS (SELECT DISTINCT a, id AS b FROM k JOIN l USING (type, key) WHERE id <> a)"


@query("e6_choose_canonical_of_conflicts", "fx_pages", "fx_links", oracle=f"""
WITH {_PAIRS}, c AS (SELECT to_page_id AS id, count(*) FILTER (WHERE {_E}) AS n FROM fx_links WHERE deleted = 0 GROUP BY 1),
s AS (SELECT p.id, 100 * CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END + 10 * coalesce(n, 0) + 10 * coalesce(completeness_score, 0) + len(string_split(alias_csv, ',')) AS rank FROM fx_pages p LEFT JOIN c USING (id))
SELECT a, b, CASE WHEN y.rank > x.rank THEN b ELSE a END AS canonical FROM pr JOIN s x ON x.id = a JOIN s y ON y.id = b""")
def e6b(pages, links):
    return e.choose_canonical(pages, links, _named_pairs(pages))


@query("e7_overlaps_of_conflicts", "fx_pages", oracle=rf"""
WITH {_PAIRS}, w AS (SELECT id, list_distinct([x FOR x IN regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}]+') IF length(x) >= 3]) AS w, list_distinct([lower(trim(x)) FOR x IN string_split(alias_csv, ',')]) AS al FROM fx_pages)
SELECT a, b, round(CASE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0.0 ELSE len(list_intersect(x.w, y.w))::DOUBLE / least(len(x.w), len(y.w)) END, 6) AS narrative, round(len(list_intersect(x.al, y.al))::DOUBLE / greatest(len(x.al), len(y.al)), 6) AS aliases FROM pr JOIN w x ON x.id = a JOIN w y ON y.id = b""")
def e7b(pages):
    w = pages.select("id", e.narrative_tokens(F.col("content")).alias("w"), F.array_distinct(F.transform(F.split("alias_csv", ","), lambda x: F.lower(F.trim(x)))).alias("al"))
    both = _named_pairs(pages).join(w.withColumnsRenamed({"id": "a", "w": "wa", "al": "la"}), "a").join(w.withColumnsRenamed({"id": "b", "w": "wb", "al": "lb"}), "b")
    return both.select("a", "b", F.round(e.overlap(F.col("wa"), F.col("wb"), smaller=True), 6).alias("narrative"), F.round(e.overlap(F.col("la"), F.col("lb"), smaller=False), 6).alias("aliases"))


@query("e1_word_similarity", "nation", "part", oracle=r"""
WITH t AS (SELECT p_partkey AS id, n_nationkey AS hint_id FROM part JOIN nation ON p_partkey % 25 = n_nationkey) SELECT id, hint_id, CAST(1.0 AS DOUBLE) AS whole, CAST(0.0 AS DOUBLE) AS none FROM t""")
def e1b(nation, part):
    rows = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"), (F.col("p_partkey") % 25).cast("int").alias("n_nationkey")).join(nation.select("n_nationkey"), "n_nationkey")
    rows = rows.select("id", F.col("n_nationkey").alias("hint_id"), F.element_at(F.split("title", " "), 1).alias("word"), "title", F.lit("qqq").alias("other"))
    return rows.select("id", "hint_id", sim.word_similarity(F.col("word"), F.col("title")).alias("whole"), sim.word_similarity(F.col("other"), F.col("title")).alias("none"))


@query("e2_duplicate_pages", "fx_pages", "fx_links")
def e2c(pages, links):
    return sim.duplicate_pages(pages.where("deleted = 0 AND " + _ENTITY), links, 0.7)


@query("g2_create_evident_pages", "fx_mentions", "fx_pages", oracle="SELECT DISTINCT slug FROM fx_mentions m WHERE slug LIKE 'companies/firm-%' AND id % 4 < 2 AND NOT EXISTS (SELECT 1 FROM fx_pages p WHERE p.deleted = 0 AND p.slug = m.slug)")
def g2b(mentions, pages):
    k = F.col("id") % 4
    return e.create_missing_pages(mentions.withColumn("origin_field", F.when(k == 0, "facts_block").when(k == 1, "primary_entities").when(k == 2, "other")), pages).select("slug")


@query("e17_candidate_pool", "fx_mentions", oracle="""
WITH m AS (SELECT slug, min(source_page_id) AS low, CASE WHEN regexp_matches(split_part(slug, '/', 2), '^(unknown|major-)') THEN 'rejected' ELSE 'pending' END AS fresh, list_sort(list_distinct(list(source_page_id))) AS s FROM fx_mentions GROUP BY 1)
SELECT slug, CASE WHEN low % 2 = 0 THEN 'merged' ELSE fresh END AS status, CAST(len(list_distinct(CASE WHEN low % 2 = 0 THEN list_append(s, 1) ELSE s END)) AS INTEGER) AS evidence_count FROM m""")
def e17b(mentions):
    pool = mentions.groupBy("slug").agg(F.min("source_page_id").alias("low")).where("low % 2 = 0")
    pool = pool.select("slug", F.lit("merged").alias("status"), F.array(F.lit("x")).alias("aliases"), F.array(F.lit(1).cast("long")).alias("source_page_ids"))
    return e.merge_candidate_pool(pool, mentions).select("slug", "status", "evidence_count")


@query("e2_duplicate_report", "fx_pages", "fx_links")
def e2d(pages, links):
    return sim.duplicate_report(pages, links, 0.7, limit=500)[0]


@query("e2_pairs_scanned", "fx_pages", "fx_links", oracle=f"WITH g AS (SELECT type, source_id, count(*) AS n FROM fx_pages WHERE deleted = 0 AND {_ENTITY} GROUP BY 1, 2) SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs_scanned FROM g")
def e2e(pages, links):
    return sim.pairs_scanned(pages)


_STUBS = """m AS (SELECT CASE WHEN n % 2 = 1 THEN 'companies/Firm ' || CAST(n AS VARCHAR) ELSE slug END AS slug, CASE WHEN n % 2 = 1 THEN 'Firm ' || CAST(n AS VARCHAR) ELSE 'firm-' || CAST(n AS VARCHAR) END AS name, n, strong, al FROM (SELECT slug, CAST(regexp_extract(slug, '([0-9]+)$', 1) AS BIGINT) AS n, bool_or(id % 4 < 2) AS strong, list_sort(list(DISTINCT alias)) AS al FROM fx_mentions WHERE slug LIKE 'companies/firm-%' GROUP BY 1)),
p AS (SELECT id, split_part(slug, '/', 2) AS own, alias_csv, 'Firm ' || CAST(id - 1000000 AS VARCHAR) AS extra FROM fx_pages WHERE type = 'company' AND deleted = 0)"""


def _stubs(mentions, pages):
    number, k = F.regexp_extract("slug", "([0-9]+)$", 1), F.col("id") % 4
    odd = F.col("slug").contains("/firm-") & (number.cast("long") % 2 == 1)
    mentions = mentions.withColumn("origin_field", F.when(k == 0, "facts_block").when(k == 1, "primary_entities").when(k == 2, "other")).withColumn("slug", F.when(odd, F.concat(F.lit("companies/Firm "), number)).otherwise(F.col("slug")))
    return e.resolve_or_create(mentions, pages.withColumn("alias_csv", F.concat("alias_csv", F.lit(",Firm "), (F.col("id") - 1000000).cast("string"))), "src")


@query("g2_stub_pages", "fx_mentions", "fx_pages", oracle=f"""
WITH {_STUBS} SELECT 'src' AS source_id, 'companies/firm-' || CAST(n AS VARCHAR) AS slug, 'firm-' || CAST(n AS VARCHAR) AS title, 'company' AS type, 'active' AS status, 'stub' AS entity_state, 'firm-' || CAST(n AS VARCHAR) || CASE WHEN n % 2 = 1 THEN ',' || name ELSE '' END || ',' || array_to_string(al, ',') AS alias_csv FROM m WHERE strong AND NOT EXISTS (SELECT 1 FROM p WHERE p.extra = m.name)""")
def g2c(mentions, pages):
    return _stubs(mentions, pages)[0]


@query("g2_touched_aliases", "fx_mentions", "fx_pages", oracle=f"WITH {_STUBS} SELECT p.id, alias_csv || ',' || extra || ',' || array_to_string(al, ',') AS alias_csv FROM p JOIN m ON m.name = p.extra")
def g2d(mentions, pages):
    return _stubs(mentions, pages)[1]
