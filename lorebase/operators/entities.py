"""Entity resolution and lifecycle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.graph import active, is_effective


def alias_keys(pages: DataFrame) -> DataFrame:
    """(id, type, key): lower-case title, name part of the slug and aliases of each page."""
    keys = F.concat(F.array("title", F.element_at(F.split("slug", "/"), 2)), F.split("alias_csv", ","))
    return active(pages).select("id", "type", F.explode(keys).alias("k")).select("id", "type", F.lower(F.trim("k")).alias("key")).where("key <> ''").distinct()


def alias_conflicts(pages: DataFrame, types: tuple[str, ...] = ("company", "industry", "concept")) -> DataFrame:
    """Keys that name more than one page of a type, with how many and the smallest id."""
    return alias_keys(pages.where(F.col("type").isin(*types))).groupBy("type", "key").agg(F.count("*").alias("pages"), F.min("id").alias("first_id")).where("pages > 1")


def check_new_aliases(updates: DataFrame, pages: DataFrame) -> DataFrame:
    """Conflicts of new aliases (id, alias) with other pages: by title, name part or alias, the first that fits."""
    p = active(pages)
    key = F.lower(F.trim("alias"))
    targets = (
        p.select(F.col("id").alias("other_id"), F.lower("title").alias("key"), F.lit(1).alias("rank"))
        .unionByName(p.select(F.col("id").alias("other_id"), F.lower(F.element_at(F.split("slug", "/"), 2)).alias("key"), F.lit(2).alias("rank")))
        .unionByName(p.select(F.col("id").alias("other_id"), F.explode(F.split("alias_csv", ",")).alias("a")).select("other_id", F.lower(F.trim("a")).alias("key"), F.lit(3).alias("rank")))
    )
    met = updates.withColumn("key", key).where("key <> ''").join(targets, "key").where("id <> other_id")
    label = F.element_at(F.array(F.lit("title"), F.lit("slug_name"), F.lit("alias")), F.min("rank"))
    return met.groupBy("id", "key", "other_id").agg(label.alias("matched_on"))


def choose_canonical(pages: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, canonical): the page with the higher confidence, backlinks, completeness and aliases; ties to the smaller id."""
    back = active(links).groupBy(F.col("to_page_id").alias("id")).agg(F.count_if(is_effective()).alias("backlinks"))
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    score = 100 * rank + 10 * F.coalesce("backlinks", F.lit(0)) + 10 * F.coalesce("completeness_score", F.lit(0.0)) + F.size(F.split("alias_csv", ","))
    s = pages.join(back, "id", "left").select("id", score.alias("score"))
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("score").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("score").alias("sb")), "b")
    return both.select("a", "b", F.when(F.col("sb") > F.col("sa"), F.col("b")).otherwise(F.col("a")).alias("canonical"))


def overlap(a: Column, b: Column, smaller: bool) -> Column:
    """Shared values over the larger (or smaller) of two sets."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    base = F.least(F.size(a), F.size(b)) if smaller else F.greatest(F.size(a), F.size(b))
    return F.coalesce(F.try_divide(both, base), F.lit(0.0))


def narrative_tokens(content: Column) -> Column:
    """Distinct lower-case words of three characters or more, before `## Updates`."""
    body = F.regexp_replace(content, r"(?s)## Updates.*", "")
    return F.array_distinct(F.filter(F.split(F.lower(body), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))


def merge_mapping(pairs: DataFrame) -> DataFrame:
    """(old, new) with chains followed to their end: a to b and b to c give a to c.

    A page with several targets goes to the smallest. Pages of a cycle, and those that lead to it, go to its smallest
    id. Each round doubles the steps taken and is written, so log2 of the pages is the most there can be.
    """
    from lorebase.sources.shared import written

    out = written(pairs.where("old <> new").groupBy("old").agg(F.min("new").alias("new")).withColumn("low", F.least("old", "new")), "mapping")
    for _ in range(out.count().bit_length() + 1):
        # new: where the steps so far lead; low: the smallest id on the way
        step = out.alias("x").join(out.alias("y"), F.col("x.new") == F.col("y.old"), "left")
        step = step.select("x.old", F.coalesce("y.new", "x.new").alias("new"), F.least("x.low", F.coalesce("y.low", "x.low")).alias("low"), F.col("y.new").isNotNull().alias("moved"))
        step = written(step, "mapping")
        out = step.select("old", "new", "low")
        if step.where("moved").isEmpty():
            break
    # an end that is itself an old page lies on a cycle, whose smallest id all its pages have seen by now
    ends = out.select("old", "new").join(out.select(F.col("old").alias("new"), F.col("low").alias("end")), "new", "left")
    return ends.select("old", F.coalesce("end", "new").alias("new")).where("old <> new")


def apply_merge_to_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Links with merged pages renamed; self-links and repeats (from, to, type, source) are dropped, the smallest id stays."""
    m = mapping.select("old", "new")
    out = links
    for c in ("from_page_id", "to_page_id"):
        out = out.join(m.withColumnsRenamed({"old": c, "new": "moved"}), c, "left").withColumn(c, F.coalesce("moved", c)).drop("moved")
    rn = F.row_number().over(Window.partitionBy("from_page_id", "to_page_id", "link_type", "link_source").orderBy("id"))
    return out.where("from_page_id <> to_page_id").withColumn("rn", rn).where("rn = 1").select("id", "from_page_id", "to_page_id", "link_type", "link_source")


#: Patterns of names that stand for no entity, and what they are, in the order in which they are tried.
REJECTED_NAMES = (
    (r"^(unknown|unnamed|various|multiple|several|others?|misc)(-|$)", "generic-placeholder"),
    (r"^(domestic|overseas|leading|major|top|key|selected)-", "generic-descriptor"),
    (r"(^|-)unknown(-|$)", "generic-placeholder"),
    (r"^(company|supplier|vendor|customer|partner|competitor)s?(-|$)", "generic-role"),
)

#: Phrases that tell who owns a company.
OWNERSHIP_SIGNALS = (
    "private company",
    "privately held",
    "not publicly listed",
    "unlisted",
    "subsidiary",
    "parent company",
    "owned by",
    "controlled by",
    "state-owned",
    "joint venture",
    "portfolio company",
    "funding round",
    "series a",
    "series b",
    "series c",
    "ipo candidate",
    "pre-ipo",
    "未上市",
    "私有",
    "私营",
    "子公司",
    "母公司",
    "控股",
)


def auto_reject_reason(slug: Column) -> Column:
    """Why a proposed slug names no entity: it has no name, or a placeholder, descriptor or role; null if it may."""
    name = F.lower(F.regexp_replace(slug, "^[^/]*/?", ""))
    name = F.regexp_replace(F.regexp_replace(name, r"[_\s]+", "-"), "^-+|-+$", "")
    out = F.lit(None).cast("string")
    for pattern, reason in reversed(REJECTED_NAMES):
        out = F.when(name.rlike(pattern), reason).otherwise(out)
    return F.when(name == "", "empty-name").otherwise(out)


def upsert_candidates(mentions: DataFrame) -> DataFrame:
    """Mentions (slug, source_page_id, alias) by slug: distinct sources as evidence, sorted aliases, status."""
    g = mentions.groupBy("slug").agg(F.countDistinct("source_page_id").alias("evidence_count"), F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))
    reason = auto_reject_reason(F.col("slug"))
    return g.select("slug", "evidence_count", "aliases", F.when(reason.isNotNull(), "rejected").otherwise("pending").alias("status"))


def merge_candidate_pool(pool: DataFrame, mentions: DataFrame) -> DataFrame:
    """The pool (slug, status, aliases and source_page_ids as arrays) after mentions (slug, source_page_id, alias).

    Aliases and sources are united and sorted, evidence counts the sources; promoted, merged and rejected stay so.
    """
    new = mentions.groupBy("slug").agg(F.collect_set("alias").alias("new_aliases"), F.collect_set("source_page_id").alias("new_sources"))
    rows = pool.join(new, "slug", "full")
    united = lambda a, b, kind: F.array_sort(F.array_distinct(F.concat(F.coalesce(a, F.array().cast(kind)), F.coalesce(b, F.array().cast(kind)))))
    fresh = F.when(auto_reject_reason(F.col("slug")).isNotNull(), "rejected").otherwise("pending")
    sources = united(F.col("source_page_ids"), F.col("new_sources"), "array<bigint>")
    return rows.select("slug", F.coalesce("status", fresh).alias("status"), united(F.col("aliases"), F.col("new_aliases"), "array<string>").alias("aliases"), sources.alias("source_page_ids"), F.size(sources).alias("evidence_count"))


def list_candidates(candidates: DataFrame, limit: int = 50) -> DataFrame:
    order = F.when(F.col("status") == "pending", 0).when(F.col("status") == "promoted", 1).when(F.col("status") == "merged", 2).otherwise(3)
    return candidates.orderBy(order, F.desc("evidence_count"), "slug").limit(limit)


def _or_null(pages: DataFrame, name: str) -> Column:
    """The column as text, null where the table doesn't have it."""
    return F.col(name).cast("string") if name in pages.columns else F.lit(None).cast("string")


#: What the parts of each type's score weigh.
RUBRICS = {
    "company": {"content": 0.20, "listing_or_ownership": 0.15, "sector": 0.10, "aliases": 0.15, "wikilinks": 0.10, "citations": 0.15, "recency": 0.05, "country_or_exchange": 0.10},
    "industry": {"content": 0.30, "aliases": 0.20, "wikilinks": 0.20, "citations": 0.20, "recency": 0.10},
    "concept": {"content": 0.35, "aliases": 0.15, "wikilinks": 0.20, "citations": 0.20, "recency": 0.10},
    "thesis": {"content": 0.30, "wikilinks": 0.15, "citations": 0.15, "validation_conditions": 0.20, "catalysts": 0.10, "recency": 0.10},
}
BLANKS = " \t\n\u000b\f\r\u00a0\u2028\u2029\u3000\ufeff"


def _parts(pages: DataFrame, as_of: str) -> dict[str, Column]:
    """Each part of a score, from 0 to 1."""
    text = F.coalesce("content", F.lit(""))
    filled = lambda c: F.coalesce(F.btrim(c, F.lit(BLANKS)), F.lit("")) != ""
    there = lambda c: F.coalesce(c != "", F.lit(False))
    steps = lambda n, *at: reduce(lambda w, x: w.when(n < x[0], x[1]), at[1:], F.when(n < at[0][0], at[0][1])).otherwise(1.0)
    times = lambda pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), 0))
    days = F.datediff(F.lit(as_of).cast("date"), "update_date")
    cited = times(r"\[\[sources/") + text.rlike(r"(?i)sources?[:：]").cast("int") + times(r"\(per\s+\[\[") + times("来源[:：]")
    owned = reduce(lambda x, y: x | y, [F.lower(text).contains(phrase) for phrase in OWNERSHIP_SIGNALS])
    exchange, matter = _or_null(pages, "exchange"), _or_null(pages, "frontmatter")

    def stated(field: str) -> Column:
        value = F.get_json_object(matter, f"$.{field}")
        return F.when(filled(value) & (value != "[]"), 1.0).otherwise(0.0)

    return {
        "content": steps(F.length(F.btrim(text, F.lit(BLANKS))), (1, 0.0), (200, 0.2), (800, 0.5), (2000, 0.8)),
        "aliases": steps(F.size(F.filter(F.split(F.coalesce("alias_csv", F.lit("")), ","), lambda x: x != "")), (1, 0.0), (2, 0.3), (3, 0.6)),
        "wikilinks": steps(times(r"\[\[[a-z]+/[^\]|#]+"), (1, 0.0), (3, 0.4), (10, 0.7)),
        "citations": steps(cited, (1, 0.0), (2, 0.3), (5, 0.7)),
        "recency": F.when(days.isNull(), 0.0).when(days < 30, 1.0).when(days < 90, 0.7).when(days < 365, 0.4).otherwise(0.1),
        "listing_or_ownership": F.when(filled(_or_null(pages, "ticker")) | owned, 1.0).when(filled(exchange), 0.6).otherwise(0.0),
        "sector": F.when(there(_or_null(pages, "sector")), 0.5).otherwise(0.0) + F.when(there(_or_null(pages, "sub_sector")), 0.5).otherwise(0.0),
        "country_or_exchange": F.when(there(_or_null(pages, "country")) | there(exchange), 1.0).otherwise(0.0),
        "validation_conditions": stated("validation_conditions"),
        "catalysts": stated("catalysts"),
    }


def completeness(pages: DataFrame, as_of: str) -> DataFrame:
    """(id, type, score) by the weighted rubric of company, industry, concept and thesis pages, to three decimals; other types score 0.

    Columns that a table lacks (ticker, exchange, country, sector, sub_sector, frontmatter as JSON text) count as null.
    """
    parts = _parts(pages, as_of)
    total = F.lit(0.0)
    for kind, weights in RUBRICS.items():
        total = F.when(F.col("type") == kind, reduce(lambda x, y: x + y, [w * parts[name] for name, w in weights.items()])).otherwise(total)
    return active(pages).select("id", "type", F.round(F.round(total, 9), 3).alias("score"))


def completeness_parts(pages: DataFrame, as_of: str) -> DataFrame:
    """(id, type, part, weight, score): the rows that `completeness` adds up, weight times score; none for types without a rubric."""
    parts = _parts(pages, as_of)
    rows = active(pages).where(F.col("type").isin(*RUBRICS)).select("id", "type", *[c.alias(name) for name, c in parts.items()])
    whole = F.lit(None)
    for kind, weights in RUBRICS.items():
        made = F.array(*[F.struct(F.lit(name).alias("part"), F.lit(w).alias("weight"), F.col(name).alias("score")) for name, w in weights.items()])
        whole = F.when(F.col("type") == kind, made).otherwise(whole)
    return rows.select("id", "type", F.inline(whole))


def bootstrap_states(pages: DataFrame, events: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, state) of legacy pages: stubs are short, of low confidence and never enriched; those that a promoted candidate became are candidate_promoted, all others compiled.

    candidates: (status, promoted_page_id, deleted).
    """
    done = events.where("action = 'enrich'").select(F.col("entity_id").alias("id")).distinct().withColumn("done", F.lit(True))
    came = active(candidates).where("status = 'promoted'").select(F.col("promoted_page_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("came", F.lit(True))
    rows = active(pages).where(F.col("type").isin("company", "industry", "concept", "thesis")).join(done, "id", "left").join(came, "id", "left")
    stub = (F.length(F.coalesce("content", F.lit(""))) <= 300) & F.col("done").isNull() & (F.col("confidence") == "low")
    return rows.select("id", F.when(stub & F.col("came"), "candidate_promoted").when(stub, "stub").otherwise("compiled").alias("state"))


def resolve_candidates(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (slug, status) with decisions (slug, decision) promote, merge or reject: only pending ones change, rejected ones may be rejected again."""
    d = candidates.join(decisions, "slug", "left")
    to = F.when(F.col("decision") == "promote", "promoted").when(F.col("decision") == "merge", "merged").when(F.col("decision") == "reject", "rejected")
    free = (F.col("status") == "pending") | ((F.col("status") == "rejected") & (F.col("decision") == "reject"))
    return d.select("slug", F.when(to.isNotNull() & free, to).otherwise(F.col("status")).alias("status"), F.coalesce(to.isNotNull() & free, F.lit(False)).alias("changed"))


def settle_candidates(pages: DataFrame, links: DataFrame, candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, links, candidates) after decisions (slug, decision, target_slug) promote, merge or reject on candidates.

    candidates: (slug, type, display_name, aliases, source_page_ids, status). Promoting makes a page that awaits
    enrichment, or lifts the stub that has the slug. Merging unites the target's aliases with the candidate's name and
    aliases, the first of spellings that differ in case stays; a target that is missing or of another type leaves the
    candidate as it is, with `problem` saying so. Both link each source to the page, as an extracted mention of weight
    0.7, where no such link is. Only pending candidates change, rejected ones may be rejected again. New ids follow the
    greatest there is, in the order of slugs.
    """
    from lorebase.operators.lifecycle import first_spellings

    here = active(pages).groupBy("slug").agg(F.min(F.struct("id", "type")).alias("p"))
    d = candidates.join(decisions.dropDuplicates(["slug"]), "slug", "left")
    d = d.join(here.select(F.col("slug").alias("target_slug"), F.col("p.id").alias("target_id"), F.col("p.type").alias("target_type")), "target_slug", "left").join(here.select("slug", F.col("p.id").alias("own_id")), "slug", "left")
    free = (F.col("status") == "pending") | ((F.col("status") == "rejected") & (F.col("decision") == "reject"))
    problem = F.when(~F.coalesce(free, F.lit(False)) & F.col("decision").isNotNull(), "status").when((F.col("decision") == "merge") & F.col("target_id").isNull(), "no_target").when((F.col("decision") == "merge") & (F.col("target_type") != F.col("type")), "type")
    d = d.withColumn("problem", problem)
    done = F.col("decision").isNotNull() & F.col("problem").isNull()
    to = F.when(F.col("decision") == "promote", "promoted").when(F.col("decision") == "merge", "merged").when(F.col("decision") == "reject", "rejected")
    settled = d.select(*candidates.columns, "problem", to.alias("__to"), done.alias("__done")).withColumn("status", F.when(F.col("__done"), F.coalesce("__to", "status")).otherwise(F.col("status"))).drop("__to", "__done")
    act = d.where(done)
    # promoted slugs that no page has; these are as many as decisions
    new = act.where((F.col("decision") == "promote") & F.col("own_id").isNull()).crossJoin(pages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")))
    new = new.withColumn("new_id", F.col("last") + F.row_number().over(Window.orderBy("slug")))
    named = F.initcap(F.regexp_replace(F.element_at(F.split("slug", "/"), -1), "[-_]+", " "))
    values = {"id": F.col("new_id"), "slug": F.col("slug"), "type": F.col("type"), "title": F.coalesce("display_name", named), "display_name": F.col("display_name"), "alias_csv": F.array_join("aliases", ","), "entity_state": F.lit("candidate_promoted"), "content": F.lit(""), "deleted": F.lit(0)}
    made = new.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in pages.schema])
    target = act.where("decision = 'merge'").groupBy(F.col("target_id").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slug", F.concat(F.array(F.coalesce("display_name", F.lit(""))), "aliases").alias("names")))), lambda x: x["names"])).alias("__names"))
    lifted = act.where("decision = 'promote' AND own_id IS NOT NULL").select(F.col("own_id").alias("id"), F.lit(True).alias("__lifted")).distinct()
    rows = pages.join(target, "id", "left").join(lifted, "id", "left")
    united = F.array_join(first_spellings(F.concat(F.split(F.coalesce("alias_csv", F.lit("")), ","), "__names")), ",")
    changed = {"alias_csv": F.when(F.col("__names").isNotNull(), united).otherwise(F.col("alias_csv")), "entity_state": F.when(F.col("__lifted") & (F.col("entity_state") == "stub"), "candidate_promoted").otherwise(F.col("entity_state"))}
    out = rows.select(*[changed.get(c, F.col(c)).alias(c) for c in pages.columns]).unionByName(made)
    page = act.where("decision IN ('promote', 'merge')").join(new.select("slug", "new_id"), "slug", "left").withColumn("page", F.when(F.col("decision") == "merge", F.col("target_id")).otherwise(F.coalesce("own_id", "new_id")))
    wanted = page.select(F.explode("source_page_ids").alias("from_page_id"), F.col("page").alias("to_page_id")).distinct().where("from_page_id <> to_page_id")
    fixed = {"link_type": "mention", "link_source": "extracted", "origin_field": "entity_candidate", "weight": 0.7, "deleted": 0}
    there = active(links).where((F.col("link_type") == "mention") & (F.col("link_source") == "extracted") & (F.col("origin_field") == "entity_candidate")).select("from_page_id", "to_page_id").distinct()
    fresh = wanted.join(there, ["from_page_id", "to_page_id"], "left_anti").crossJoin(links.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")))
    fresh = fresh.withColumn("id", F.col("last") + F.row_number().over(Window.orderBy("from_page_id", "to_page_id")))
    fresh = fresh.select(*[(F.col(f.name) if f.name in ("id", "from_page_id", "to_page_id") else F.lit(fixed.get(f.name))).cast(f.dataType).alias(f.name) for f in links.schema])
    return out, links.unionByName(fresh), settled


def retype_pages(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Pages (id, slug, type) with moves (id, new_type, new_dir): type and slug change unless another page has the new slug."""
    new = pages.join(moves, "id").select("id", "new_type", F.concat("new_dir", F.lit("/"), F.element_at(F.split("slug", "/"), 2)).alias("new_slug"))
    taken = pages.where("deleted = 0").select(F.col("slug").alias("new_slug")).distinct().withColumn("taken", F.lit(True))
    new = new.join(taken, "new_slug", "left")
    out = pages.join(new, "id", "left")
    ok = F.col("new_slug").isNotNull() & F.col("taken").isNull()
    return out.select("id", F.when(ok, F.col("new_slug")).otherwise(F.col("slug")).alias("slug"), F.when(ok, F.col("new_type")).otherwise(F.col("type")).alias("type"), F.coalesce(F.col("taken"), F.lit(False)).alias("conflict"))


def create_missing_pages(mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """Slugs of mentioned companies that no active page has and no rule rejects, as stub pages named by the slug's second part.

    Where mentions tell their origin_field, only slugs with strong evidence count: a primary entity, or an entity of a
    fact or timeline block.
    """
    strong = F.col("origin_field").isin("primary_entities", "facts_block", "timeline_block") if "origin_field" in mentions.columns else F.lit(True)
    wanted = mentions.where(strong).select("slug").distinct().where(F.col("slug").startswith("companies/") & auto_reject_reason(F.col("slug")).isNull())
    missing = wanted.withColumn("slug", F.regexp_replace(F.lower("slug"), r"[\s_]+", "-")).distinct().join(pages.where("deleted = 0").select("slug"), "slug", "left_anti")
    return missing.select("slug", F.element_at(F.split("slug", "/"), 2).alias("title"), F.lit("company").alias("type"), F.lit("stub").alias("entity_state"))


def resolve_or_create(mentions: DataFrame, pages: DataFrame, source_id: str = "default") -> tuple[DataFrame, DataFrame]:
    """(created, touched): stub pages for companies that no page of the source stands for, and the pages that mentions met, where they gain aliases.

    mentions: (slug, alias, origin_field); pages: (id, source_id, type, slug, alias_csv, deleted). A mention meets the
    active company page found as in `resolve_refs`. What meets none becomes a page if one of its mentions is strong (a
    primary entity, or an entity of a fact or timeline block) and no rule rejects the name. Spellings of one name (case,
    blanks, _ and -) make one page.
    created: (source_id, slug, title, type, status, entity_state, alias_csv): aliases are the name of the slug, the names
    as mentioned and the mentions' aliases in the order of their text, each once whatever its case.
    touched: (id, alias_csv) with the mentions' aliases behind those the page has.
    """
    from lorebase.operators.ingest import resolve_refs

    trim = lambda c: F.btrim(c, F.lit(BLANKS))
    name = trim(F.regexp_replace("slug", "^[^/]*/?", ""))
    rows = mentions.where(F.lower(trim(F.col("slug"))).startswith("companies/")).withColumn("name", name)
    rows = rows.groupBy("slug", "name").agg(F.array_sort(F.collect_set(trim(F.col("alias")))).alias("given"), F.coalesce(F.max(F.col("origin_field").isin("primary_entities", "facts_block", "timeline_block")), F.lit(False)).alias("strong"))

    def merged(*lists: Column) -> Column:
        """All aliases in order, each once whatever its case, blank ones left out."""
        whole = F.filter(F.transform(F.concat(*lists), trim), lambda a: a != "")
        low = F.transform(whole, lambda a: F.lower(a))
        return F.array_join(F.filter(whole, lambda a, i: F.array_position(low, F.lower(a)) == i + 1), ",")

    there = pages.where((F.col("type") == "company") & (F.col("source_id") == source_id))
    met = rows.join(resolve_refs(rows, there).select("slug", "page_id"), "slug", "left")
    found = met.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("given")))).alias("given"))
    have = F.filter(F.split(F.coalesce("alias_csv", F.lit("")), ","), lambda a: a != "")
    touched = there.where("deleted = 0").join(found, "id").select("id", have.alias("have"), merged(have, F.col("given")).alias("alias_csv"))
    touched = touched.where(F.size(F.split("alias_csv", ",")) > F.size("have")).where("alias_csv <> ''").select("id", "alias_csv")

    canonical = F.regexp_replace(F.regexp_replace(F.lower("name"), r"[\s_-]+", "-"), "^-+|-+$", "")
    fresh = met.where("page_id IS NULL").withColumn("key", canonical).where("key <> ''")
    fresh = fresh.groupBy("key").agg(F.max("strong").alias("strong"), F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("given")))).alias("given"))
    fresh = fresh.withColumn("slug", F.concat(F.lit("companies/"), "key")).where(F.col("strong") & auto_reject_reason(F.col("slug")).isNull())
    title = F.element_at(F.split("slug", "/"), -1)
    created = fresh.select(F.lit(source_id).alias("source_id"), "slug", title.alias("title"), F.lit("company").alias("type"), F.lit("active").alias("status"), F.lit("stub").alias("entity_state"), merged(F.array("key"), F.col("names"), F.col("given")).alias("alias_csv"))
    return created, touched


def merge_risk(pairs: DataFrame) -> DataFrame:
    """Risk of merging pairs (a, b, dup_chars, ratio, sections, has_updates, overlap): any sign of a large or separate text raises it."""
    review = (F.col("dup_chars") > 8000) | (F.col("ratio") > 1.1) | ((F.col("sections") >= 8) & (F.col("overlap") < 0.45))
    structure = (F.col("dup_chars") > 2000) | (F.col("ratio") > 0.6) | F.col("has_updates") | (F.col("overlap") < 0.35)
    return pairs.select("a", "b", F.when(F.col("dup_chars") == 0, "auto_merge").when(review, "human_review").when(structure, "structure_only").otherwise("auto_merge").alias("mode"))
