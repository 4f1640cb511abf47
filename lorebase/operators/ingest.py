"""Intake, skeletons, chunks, links and facts from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import wikilinks


def sync_raw_files(upstream: DataFrame, existing: DataFrame, per_type: int, start: str | None = None, end: str | None = None, research_ids: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """New upstream rows (research_id, research_type, create_date), newest first, at most per_type of each type; rows already there use up the quota.

    Where upstream has parse_status and markdown_url, only completed rows with a text count. The days from start up
    to, but without, end count, unless ids are given.
    """
    rows = upstream
    if "parse_status" in rows.columns:
        rows = rows.where("parse_status = 'completed'")
    if "markdown_url" in rows.columns:
        rows = rows.where("markdown_url IS NOT NULL")
    if research_ids is not None:
        rows = rows.where(F.col("research_id").isin(research_ids))
    else:
        rows = rows.where(F.col("create_date") >= F.lit(start).cast("date")) if start else rows
        rows = rows.where(F.col("create_date") < F.lit(end).cast("date")) if end else rows
    if types is not None:
        rows = rows.where(F.col("research_type").isin(types))
    here = existing.select("research_id").distinct().withColumn("here", F.lit(True))
    rn = F.row_number().over(Window.partitionBy("research_type").orderBy(F.desc("create_date"), "research_id"))
    return rows.withColumn("rn", rn).where(F.col("rn") <= per_type).join(here, "research_id", "left").where("here IS NULL").select("research_id", "research_type", "create_date", "rn")


def pending_raw_files(raw: DataFrame, as_of: str, ttl_days: int, limit: int, ttl_minutes: int | None = None) -> DataFrame:
    """Oldest rows that wait, or whose lease has run out: after days from their creation, or with ttl_minutes, so many from when they were taken (`leased_at`; null has run out)."""
    over = F.col("create_date") < F.date_sub(F.lit(as_of).cast("date"), ttl_days)
    if ttl_minutes is not None:
        over = F.coalesce(F.col("leased_at") < F.lit(as_of).cast("timestamp") - F.make_interval(mins=F.lit(ttl_minutes)), F.lit(True))
    stale = (F.col("triage_decision") == "processing") & over
    return raw.where(F.col("ingested_page_id").isNull() & ((F.col("triage_decision") == "pending") | stale)).orderBy("create_date", "id").limit(limit).select("id", "research_id", "create_date")


def peek_stats(documents: DataFrame) -> DataFrame:
    """Characters, lines, words and a preview of each document."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return documents.select("doc_id", F.length("text").alias("chars"), F.size(lines).alias("blocks"), F.substring("text", 1, 1500).alias("preview"))


def page_skeleton(raw: DataFrame) -> DataFrame:
    """The page row of each raw file: slug of its type and id with unsafe characters as -, title, date."""
    slug = F.concat(F.lit("sources/"), F.regexp_replace(F.concat_ws("-", "research_type", "research_id"), r"[^A-Za-z0-9_\-]+", "-"))
    return raw.select("research_id", slug.alias("slug"), F.trim("title").alias("title"), F.date_format("create_date", "yyyy-MM-dd").alias("publish_date"), F.lit("medium").alias("confidence"))


def triage(raw: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (id, decision, reason where there is one) applied to rows that are not ingested yet; a pass keeps its reason."""
    reason = F.col("reason") if "reason" in decisions.columns else F.lit(None).cast("string")
    d = raw.join(decisions.select("id", "decision", reason.alias("reason")), "id", "left")
    free = F.col("decision").isNotNull() & F.col("ingested_page_id").isNull()
    return d.select("id", F.when(free, F.col("decision")).otherwise(F.col("triage_decision")).alias("triage_decision"), free.alias("changed"), F.when(free & (F.col("decision") == "pass"), F.col("reason")).alias("skip_reason"))


def triage_events(triaged: DataFrame, as_of: str) -> DataFrame:
    """An audit row for each row that triage changed."""
    from lorebase.operators.lifecycle import append_events

    return append_events(None, triaged.where("changed").select(F.col("id").alias("entity_id"), F.concat(F.lit("triage_"), "triage_decision").alias("action"), "skip_reason"), as_of)


def skip_pages(tables: dict[str, DataFrame], ids: DataFrame, reason: str, as_of: str) -> dict[str, DataFrame]:
    """Pages (id) with their tags, side data and chunks deleted, and their raw files (`raw_files`) passed with the reason."""
    from lorebase.operators.lifecycle import retire_pages

    out = retire_pages(tables, ids, reason, as_of)
    raw = tables["raw_files"]
    hit = ids.select(F.col("id").alias("ingested_page_id"), F.lit(True).alias("__hit")).distinct()
    out["raw_files"] = raw.join(hit, "ingested_page_id", "left").withColumn("triage_decision", F.when(F.col("__hit"), "pass").otherwise(F.col("triage_decision"))).select(*raw.columns)
    return out


def skip_ingested(tables: dict[str, DataFrame], ids: DataFrame, reason: str, as_of: str, actor: str = "system") -> dict[str, DataFrame]:
    """Tables after pages (id) were skipped at intake, their raw files found by the events of their start.

    tables: pages (archived where they have a status), events (ts, actor, action, entity_id, payload as JSON text),
    raw_files (id, triage_decision, skip_reason, skipped_at), and where given tags, raw_data, chunks (page_id, deleted).
    A page's raw file is the smallest rawFileId of its ingest_start events; it is passed, with the reason and the time. An
    ingest_skip event a page tells the reason, the raw file (left out where there is none) and how many rows of each kind
    were deleted.
    """
    gone = ids.select(F.col("id").cast("long").alias("id")).distinct().join(tables["pages"].select("id"), "id", "left_semi")
    out = dict(tables)
    hit = gone.withColumn("__hit", F.lit(True))
    rows = tables["pages"].join(hit, "id", "left").withColumn("deleted", F.when(F.col("__hit"), 1).otherwise(F.col("deleted")))
    if "status" in tables["pages"].columns:
        rows = rows.withColumn("status", F.when(F.col("__hit"), "archived").otherwise(F.col("status")))
    out["pages"] = rows.select(*tables["pages"].columns)
    file = F.get_json_object("payload", "$.rawFileId").try_cast("long")
    started = tables["events"].where("action = 'ingest_start'").groupBy(F.col("entity_id").alias("id")).agg(F.min(file).alias("raw_id"))
    told = gone.join(started, "id", "left")
    raw = tables["raw_files"]
    passed = told.where("raw_id IS NOT NULL").select(F.col("raw_id").alias("id"), F.lit(True).alias("__hit")).distinct()
    new = {"triage_decision": F.lit("pass"), "skip_reason": F.lit(reason), "skipped_at": F.lit(as_of).cast("timestamp")}
    out["raw_files"] = raw.join(passed, "id", "left").withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in new.items()}).select(*raw.columns)
    counts = []
    for name, label in (("tags", "tags"), ("raw_data", "rawData"), ("chunks", "contentChunks")):
        n = F.lit(0).cast("long")
        if name in tables:
            t = tables[name]
            lost = t.where("deleted = 0").join(gone.withColumnRenamed("id", "page_id"), "page_id").groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias(label))
            told = told.join(lost, "id", "left")
            n = F.coalesce(label, n)
            out[name] = t.join(hit.withColumnRenamed("id", "page_id"), "page_id", "left").withColumn("deleted", F.when(F.col("__hit"), 1).otherwise(F.col("deleted"))).select(*t.columns)
        counts.append(n.alias(label))
    payload = F.to_json(F.struct(F.lit(reason).alias("reason"), F.col("raw_id").cast("string").alias("rawFileId"), F.struct(*counts).alias("softDeleted")))
    new = told.select(F.lit(as_of).cast("timestamp").alias("ts"), F.lit(actor).alias("actor"), F.lit("ingest_skip").alias("action"), F.col("id").alias("entity_id"), payload.alias("payload"))
    out["events"] = tables["events"].unionByName(new, allowMissingColumns=True)
    return out


def promote_briefs(pages: DataFrame, raw: DataFrame, events: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, raw files, events) after briefs (id) became sources: type and slug change, the raw file is committed, stages done before count no more."""
    hit = ids.select("id", F.lit(True).alias("__hit")).distinct()
    p = pages.join(hit, "id", "left")
    brief = F.col("__hit") & F.col("slug").startswith("briefs/")
    moved = p.select(*[F.when(brief, F.regexp_replace("slug", "^briefs/", "sources/")).otherwise(F.col("slug")).alias(c) if c == "slug" else F.when(brief, "source").otherwise(F.col("type")).alias(c) if c == "type" else F.col(c) for c in pages.columns])
    done = p.where(brief).select("id")
    r = raw.join(done.select(F.col("id").alias("ingested_page_id"), F.lit(True).alias("__hit")), "ingested_page_id", "left")
    r = r.withColumn("triage_decision", F.when(F.col("__hit"), "commit").otherwise(F.col("triage_decision"))).select(*raw.columns)
    e = events.join(done.select(F.col("id").alias("entity_id"), F.lit(True).alias("__hit")), "entity_id", "left")
    e = e.withColumn("deleted", F.when(F.col("__hit") & (F.col("action") == "stage_done"), 1).otherwise(F.lit(0))).select(*[c for c in events.columns if c != "deleted"], "deleted")
    return moved, r, e


def explicit_only(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Fact candidates (page_id, tier, ...) without those of tiers B and C of briefs and meeting minutes; pages: (page_id, type, research_type)."""
    strict = (F.col("type") == "brief") | F.coalesce(F.col("research_type") == "meeting_minutes", F.lit(False))
    return candidates.join(pages.select("page_id", strict.alias("__strict")), "page_id", "left").where("tier = 'A' OR NOT coalesce(__strict, false)").select(*candidates.columns)


def page_frontmatter(raw: DataFrame) -> DataFrame:
    """(research_id, frontmatter as JSON text) of raw files: id, type, date and address of the text, by what is there."""
    return raw.select("research_id", F.to_json(F.struct("research_id", "research_type", F.substring(F.col("create_date").cast("string"), 1, 10).alias("publish_date"), F.coalesce("original_url", "markdown_url").alias("original_url"), F.coalesce("file_type", F.regexp_extract("markdown_url", r"\.([a-z0-9]+)$", 1)).alias("file_type"))).alias("frontmatter"))


def write_narratives(pages: DataFrame, narratives: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(pages, versions) after narratives (id, narrative, frontmatter as map): body and timeline apart, new keys over old ones, the hash of the whole narrative.

    pages: (id, content, timeline, frontmatter as map<string,string>).
    """
    parts = split_body(narratives.select(F.col("id").alias("page_id"), F.col("narrative").alias("content"))).withColumnsRenamed({"page_id": "id", "timeline": "new_timeline"})
    n = narratives.select("id", "narrative", F.col("frontmatter").alias("new_front")).join(parts, "id")
    rows = pages.join(n, "id", "left")
    hit = F.col("narrative").isNotNull()
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("frontmatter", none), F.coalesce("new_front", none)
    front = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    out = rows.select("id", F.when(hit, F.col("body")).otherwise(F.col("content")).alias("content"), F.when(hit, F.col("new_timeline")).otherwise(F.col("timeline")).alias("timeline"), F.when(hit, front).otherwise(F.col("frontmatter")).alias("frontmatter"), F.when(hit, F.sha2("narrative", 256)).alias("content_hash"))
    return out, out.where("content_hash IS NOT NULL").select(F.col("id").alias("page_id"), "content", "timeline", "content_hash", F.lit(reason).alias("reason"))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list, replace: bool) -> DataFrame:
    """Insert updates whose null-safe key is not in target; with replace, updates also take the place of present rows. One update a key, the first by order."""
    one = updates.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
    keep, add = (target, one)
    t, u = keep.alias("t"), add.alias("u")
    on = None
    for k in keys:
        c = F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}"))
        on = c if on is None else on & c
    if replace:
        keep = t.join(u, on, "left_anti")
    else:
        add = u.join(t, on, "left_anti")
    return keep.unionByName(add.select(*target.columns))


def harvest_links(pages: DataFrame) -> DataFrame:
    """(page_id, slug, label) of every wikilink in content."""
    pattern = F.lit(r"\[\[((?:companies|industries|concepts|sources|theses|briefs|outputs)/[^\]|#]+)(?:#[^\]|]*)?(?:\|([^\]]*))?\]\]")
    both = F.arrays_zip(F.regexp_extract_all("content", pattern, 1).alias("slug"), F.regexp_extract_all("content", pattern, 2).alias("label"))
    return pages.select("page_id", F.explode(both).alias("x")).select("page_id", F.trim("x.slug").alias("slug"), F.trim("x.label").alias("label"))


def link_type(label: DataFrame):
    """The type before a colon in a label, mention if there is none of the known ones."""
    head = F.lower(F.trim(F.element_at(F.split(label, ":"), 1)))
    return F.when(label.contains(":") & head.isin("confirms", "contradicts", "supersedes", "cites", "critiques", "derives_from", "tracks"), head).otherwise("mention")


def resolve_refs(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """(slug, page_id): by exact slug, else lower case, else with blanks and underscores as -, else by an alias equal to the name part; ties to the smallest id."""
    r = refs.select("slug").distinct().withColumn("name", F.lower(F.element_at(F.split("slug", "/"), 2)))
    p = pages.where("deleted = 0").select("id", F.col("slug").alias("page_slug"), "alias_csv")
    norm = lambda c: F.regexp_replace(F.lower(c), r"[\s_-]+", "-")
    found = r.join(p, F.col("slug") == F.col("page_slug")).select("slug", "id", F.lit(1).alias("rank"))
    found = found.unionByName(r.join(p, F.lower("slug") == F.lower("page_slug")).select("slug", "id", F.lit(2).alias("rank")))
    found = found.unionByName(r.join(p, norm("slug") == norm("page_slug")).select("slug", "id", F.lit(3).alias("rank")))
    aliases = p.select("id", F.explode(F.split("alias_csv", ",")).alias("a"))
    found = found.unionByName(r.join(aliases, F.col("name") == F.lower(F.trim("a"))).select("slug", "id", F.lit(4).alias("rank")))
    best = found.groupBy("slug").agg(F.min(F.struct("rank", "id")).alias("x"))
    return r.select("slug").join(best, "slug", "left").select("slug", F.col("x.id").alias("page_id"), F.col("x.rank").alias("rank"))


def build_links(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Links of resolved references: occurrences by (from, to, type) with the strongest weight; no self-links."""
    rows = refs.join(resolved.where("page_id IS NOT NULL").select("slug", F.col("page_id").alias("to_page_id")), "slug").withColumn("link_type", link_type(F.col("label")))
    weight = F.when(F.col("link_type") != "mention", 1.0).otherwise(0.3)
    return rows.where("page_id <> to_page_id").groupBy(F.col("page_id").alias("from_page_id"), "to_page_id", "link_type").agg(F.count("*").alias("occurrences"), F.max(weight).alias("weight"))


def single_entity(pages: DataFrame) -> DataFrame:
    """The one distinct entity that a page links, null for none or several."""
    found = F.array_distinct(F.filter(wikilinks(F.col("content")), lambda s: s.rlike("^(companies|industries|concepts)/")))
    return pages.select("page_id", F.when(F.size(found) == 1, F.element_at(found, 1)).alias("entity"))


#: A line that begins the timeline, with the kinds that are told apart: to the end, a comment that may be closed, a rule before a heading.
_TIMELINE = r"(?i:---[ \t]+timeline[ \t]+---)[ \t\r]*$|<!--\s*(?i:timeline)\b[^\n]*$|---[ \t\r]*$(?=\s*^[ \t]*##\s+(?i:timeline|history)\b)"


def split_body(pages: DataFrame) -> DataFrame:
    """(page_id, body, timeline) of pages (page_id, content), parted at the first line that begins a timeline.

    `<!-- timeline -->`, `--- timeline ---` and `---` before a Timeline or History heading (but not where a page begins)
    take all that follows. A comment that is only opened, `<!-- timeline`, goes to the line `-->`; what comes after that
    stays in the body. A body without a timeline is left as it is, else blanks at its end go.
    """
    blank = F.lit(" \t\r\n")
    # the rule at the very beginning is front matter
    whole = rf"(?ms)\A((?:\s*^[ \t]*---[ \t\r]*$)?+.*?)^[ \t]*({_TIMELINE})(.*)\z"
    part = lambda k: F.regexp_extract("content", whole, k)
    rows = pages.select("page_id", "content", part(1).alias("head"), F.trim(part(2), blank).alias("mark"), part(3).alias("rest"))
    close = r"(?m)^[ \t]*-->[ \t\r]*$"
    wrapped = F.startswith("mark", F.lit("<!--")) & ~F.col("mark").isin("<!-- timeline -->", "<!--timeline-->") & F.col("rest").rlike(close)
    halves = F.split("rest", close, 2)
    body = F.when(wrapped, F.concat("head", F.regexp_replace(F.get(halves, F.lit(1)), r"\A\n", ""))).otherwise(F.col("head"))
    timeline = F.when(wrapped, F.get(halves, F.lit(0))).otherwise(F.col("rest"))
    found = F.col("mark") != ""
    return rows.select("page_id", F.when(found, F.rtrim(body, blank)).otherwise(F.col("content")).alias("body"), F.when(found, F.trim(timeline, blank)).otherwise("").alias("timeline"))


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, body) of second- and third-level headings."""
    parts = F.split("content", r"(?m)^(?=#{2,3}\s)")
    rows = pages.select("page_id", F.posexplode(F.filter(parts, lambda p: p.rlike(r"^#{2,3}\s"))).alias("pos", "part"))
    return rows.select("page_id", "pos", F.lower(F.trim(F.regexp_extract("part", r"^#{2,3}\s+([^\n]*)", 1))).alias("title"), F.trim(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("body"))


def snapshot_versions(pages: DataFrame, reason: str) -> DataFrame:
    """A version row of each page with the hash of its content."""
    return pages.select(F.col("id").alias("page_id"), F.sha2("content", 256).alias("content_hash"), F.length("content").alias("chars"), F.lit(reason).alias("reason"))


def append_updates(pages: DataFrame, deltas: DataFrame, date: str, source: str | None) -> DataFrame:
    """Pages (id, content) with deltas (id, delta) as a dated block at the end, under the `## Updates` that is there or a new one.

    A delta takes the place of a body under 200 characters as it is. A null source leaves out the reference.
    """
    blank = F.lit(" \t\r\n")
    tag = F.lit(f" (per [[{source}]])" if source else "")
    block = F.concat(F.lit(f"### {date}"), tag, F.lit("\n\n"), F.trim("delta", blank), F.lit("\n"))
    body = F.trim(F.coalesce("content", F.lit("")), blank)
    heading = F.when(body.contains("\n## Updates"), "\n\n").otherwise("\n\n## Updates\n\n")
    d = pages.join(deltas, "id", "left")
    return d.select("id", F.when(F.col("delta").isNull(), F.col("content")).when(F.length(body) < 200, F.col("delta")).otherwise(F.concat(body, heading, block)).alias("content"))


def review_gate(pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """(page_id, reuse): whether the stored review (page_id, content_hash) is of the page's present content."""
    now = pages.select(F.col("id").alias("page_id"), F.sha2("content", 256).alias("content_hash"))
    hit = reviews.select("page_id", "content_hash").distinct().withColumn("reuse", F.lit(True))
    return now.join(hit, ["page_id", "content_hash"], "left").select("page_id", F.coalesce("reuse", F.lit(False)).alias("reuse"))
