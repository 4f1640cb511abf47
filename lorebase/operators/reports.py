"""Quality, backlog, activity and usage reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.graph import active, effective_backlinks, is_effective, orphans
from lorebase.sources.shared import written


def latest_review(events: DataFrame) -> DataFrame:
    """The newest page review of each page."""
    rows = events.where("action = 'page_review'")
    return rows.groupBy(F.col("entity_id").alias("page_id")).agg(F.max_by(F.struct("id", "status", "ts"), F.struct("ts", "id")).alias("x"), F.count("*").alias("reviews")).select("page_id", "x.id", "x.status", "x.ts", "reviews")


def repair_candidates(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Entity pages that were never reviewed, fail their newest review, or have no second-level heading."""
    last = latest_review(events).select(F.col("page_id").alias("id"), "status")
    rows = active(pages).where(F.col("type").isin("company", "industry", "concept")).join(last, "id", "left")
    reason = F.when(F.col("status").isNull(), "never_reviewed").when(F.col("status") == "fail", "failing").when(~F.col("content").rlike(r"(?m)^##\s+"), "no_headings")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "slug", "reason")


def facts_coverage(pages: DataFrame, facts: DataFrame, limit: int = 30) -> DataFrame:
    """Source pages with table facts: fact counts and risk. The limit applies before the risk filter."""
    n = active(facts).groupBy(F.col("source_page_id").alias("id")).agg(F.count("*").alias("facts"), F.count("table_id").alias("table_facts"))
    rows = active(pages).where("type = 'source'").join(n, "id", "left").fillna(0, ["facts", "table_facts"])
    first = rows.orderBy("facts", "id").limit(limit)
    risk = F.when(F.col("facts") == 0, "high").when(F.col("facts") <= 1, "medium")
    return first.withColumn("risk", risk).where("risk IS NOT NULL").select("id", "slug", "facts", "risk")


def thesis_backlog(theses: DataFrame, signals: DataFrame, as_of: str, stale_days: int = 21, signal_days: int = 14) -> DataFrame:
    """Active theses by priority: days beyond stale, three per unresolved condition, two per recent signal; the action is to review now if there is any of these."""
    recent = active(signals).where(F.col("detected_at") >= F.date_sub(F.lit(as_of).cast("date"), signal_days).cast("timestamp")).groupBy(F.col("thesis_page_id").alias("page_id")).agg(F.count("*").alias("recent_signals"))
    rows = theses.where("status IN ('active', 'monitoring')").join(recent, "page_id", "left").fillna(0, ["recent_signals"])
    days = F.datediff(F.lit(as_of).cast("date"), "update_date")
    priority = F.greatest(days - stale_days, F.lit(0)) + 3 * F.col("unresolved_conditions") + 2 * F.col("recent_signals")
    due = (days >= stale_days) | (F.col("unresolved_conditions") > 0) | (F.col("recent_signals") > 0)
    return rows.select("page_id", days.alias("days_since_update"), "unresolved_conditions", "recent_signals", priority.cast("long").alias("priority"), F.when(due, "review_now").otherwise("monitor").alias("action"))


#: What a ticker looks like, and texts that stand for none.
TICKER = r"^[A-Z0-9]{1,8}([.-][A-Z0-9]{1,6}){0,2}$"
NO_TICKER = ("n/a", "na", "none", "null", "unknown", "private", "private company")


def _company_issues(pages: DataFrame) -> DataFrame:
    """Company pages with `issues`, an array of (code, severity); a page has sparse_aliases twice if both of its causes hold."""
    trim = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r"))
    rows = active(pages).where("type = 'company'").withColumns({"aliases": F.filter(F.split(F.coalesce("alias_csv", F.lit("")), ","), lambda a: a != ""), "name": trim(F.col("display_name")), "tick": trim(F.col("ticker"))})
    rows = rows.withColumns({"known": F.transform("aliases", lambda a: F.lower(trim(a))), "of_slug": trim(F.regexp_replace("slug", "^[^/]*/?", ""))})
    # companies of one ticker by a map-side count: those without one are most, and no window gathers them
    shared = rows.where("tick <> ''").groupBy(F.upper("tick").alias("upper_tick")).agg(F.count("*").alias("same_ticker")).where("same_ticker > 1")
    rows = rows.withColumn("upper_tick", F.upper("tick")).join(shared, "upper_tick", "left")
    has, tick, n, lacks = F.col("name") != "", F.col("tick") != "", F.size("aliases"), lambda c: ~F.array_contains("known", F.lower(c))
    low = F.coalesce(F.col("confidence") == "low", F.lit(False))
    curated = F.coalesce(F.col("confidence").isin("medium", "high"), F.lit(False))
    odd = ~F.col("upper_tick").rlike(TICKER) | F.lower("tick").isin(*NO_TICKER) | (F.length("tick") > 16)
    rules: list[tuple[str, str, Column]] = [
        ("missing_display_name", "error", ~has),
        ("display_name_sluggy", "warn", has & (F.col("name").contains("-") | (F.col("name") == F.lower("name")))),
        ("missing_aliases", "error", n == 0),
        ("sparse_aliases", "warn", (n == 1) & ~low),
        ("display_name_missing_from_aliases", "warn", has & lacks(F.col("name"))),
        ("missing_ticker", "warn", ~tick & curated),
        ("ticker_suspicious", "error", tick & odd),
        ("ticker_not_uppercase", "warn", tick & (F.col("tick") != F.col("upper_tick"))),
        ("ticker_missing_from_aliases", "warn", tick & lacks(F.col("tick"))),
        ("duplicate_ticker", "error", tick & F.col("same_ticker").isNotNull()),
        ("sparse_aliases", "warn", (F.col("of_slug") != "") & (n > 0) & lacks(F.col("of_slug"))),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"))) for code, s, c in rules]), lambda x: x.isNotNull())
    return rows.withColumn("issues", found)


def company_metadata_issues(pages: DataFrame) -> DataFrame:
    """(page_id, code, severity) of what is wrong with company names, aliases and tickers, a code once a page."""
    return _company_issues(pages).select(F.col("id").alias("page_id"), F.inline(F.array_distinct("issues")))


def company_metadata_audit(pages: DataFrame, links: DataFrame, limit: int = 80, include_ok: bool = False, confidence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the first companies with issues by backlinks, confidence (high, medium, low, none) and id, and how often each code occurs in all of them.

    Rows: (rank, page_id, slug, confidence, backlinks, aliases, issues as `severity:code` joined by commas); include_ok
    adds companies without issues. Duplicate tickers count over all companies, whatever the confidence asked for.
    Counts: (code, n), with the codes `companies` and `problem_companies` for how many there are.
    """
    rows = _company_issues(pages)
    rows = rows if confidence is None else rows.where(F.col("confidence") == confidence)
    rows = written(rows.select(F.col("id").alias("page_id"), "slug", "confidence", F.size("aliases").alias("aliases"), "issues"), "audit")
    back = active(links).groupBy(F.col("to_page_id").alias("page_id")).agg(F.count("*").alias("backlinks"))
    level = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    shown = rows if include_ok else rows.where("size(issues) > 0")
    order = [F.desc("backlinks"), level.desc(), F.asc("page_id")]
    top = shown.join(back, "page_id", "left").fillna(0, ["backlinks"]).orderBy(*order).limit(limit)
    text = F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["severity"], x["code"])), ",")
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "page_id", "slug", "confidence", "backlinks", "aliases", text.alias("issues"))
    codes = F.concat(F.array(F.lit("companies")), F.when(F.size("issues") > 0, F.array(F.lit("problem_companies"))).otherwise(F.array().cast("array<string>")), F.col("issues.code"))
    return ranked, rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def daily_sources(raw_files: DataFrame, date: str, tz: str = "Asia/Shanghai") -> DataFrame:
    """Raw files created within the local day, as a half-open range of instants."""
    start = F.to_utc_timestamp(F.lit(date).cast("timestamp"), tz)
    end = F.to_utc_timestamp(F.date_add(F.lit(date).cast("date"), 1).cast("timestamp"), tz)
    at = F.col("create_date").cast("timestamp")
    return raw_files.where((at >= start) & (at < end)).select("id", "research_id", "research_type", "triage_decision")


#: Sides of a source; any other is unknown.
VIEW_SIDES = ("buy_side", "sell_side", "neutral", "unknown")


def daily_source_pages(raw_files: DataFrame, pages: DataFrame, date: str, tz: str = "Asia/Shanghai", kind: str | None = None, limit: int = 500) -> DataFrame:
    """(page_id, raw_file_id, slug, research_type, view_side, view_side_raw) of the pages (id, slug, type, deleted, frontmatter as JSON text) whose raw files came within the local day, the first `limit` of them.

    Pages of one type, or else sources and briefs.
    """
    day = daily_sources(raw_files, date, tz).select("id")
    rows = raw_files.join(day, "id", "left_semi").select(F.col("id").alias("raw_file_id"), "research_type", "create_date", F.col("ingested_page_id").alias("page_id"))
    wanted = active(pages).where(F.col("type").isin(*([kind] if kind else ["source", "brief"])))
    rows = rows.join(wanted.select(F.col("id").alias("page_id"), "slug", "frontmatter"), "page_id")
    raw = F.coalesce(F.get_json_object("frontmatter", "$.view_side"), F.lit("unknown"))
    out = rows.withColumn("view_side_raw", raw).withColumn("view_side", F.when(F.col("view_side_raw").isin(*VIEW_SIDES), F.col("view_side_raw")).otherwise("unknown"))
    return out.orderBy("create_date", "raw_file_id").limit(limit).select("page_id", "raw_file_id", "slug", "research_type", "view_side", "view_side_raw")


def recent_activity(events: DataFrame, signals: DataFrame, pages: DataFrame, as_of: str, days: int = 7, limit: int = 30) -> DataFrame:
    """The newest events, signals and pages, each limited, then together."""
    since = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")
    parts = [
        events.where(F.col("ts") >= since).select(F.lit("event").alias("kind"), "id", "ts"),
        active(signals).where(F.col("detected_at") >= since).select(F.lit("signal").alias("kind"), "id", F.col("detected_at").alias("ts")),
        active(pages).select(F.lit("page").alias("kind"), "id", F.col("create_date").cast("timestamp").alias("ts")).where(F.col("ts") >= since),
    ]
    tops = [p.orderBy(F.desc("ts"), F.desc("id")).limit(limit) for p in parts]
    return tops[0].unionByName(tops[1]).unionByName(tops[2]).orderBy(F.desc("ts"), "kind", F.desc("id")).limit(limit)


def recent_comments(comments: DataFrame, as_of: str, intent: str, days: int = 30, limit: int = 50) -> DataFrame:
    rows = comments.where((F.col("intent") == intent) & (F.col("create_date") >= F.date_sub(F.lit(as_of).cast("date"), days)))
    return rows.orderBy(F.desc("create_date"), F.desc("id")).limit(limit).select("id", "page_id", "author", "create_date")


def overview_counts(pages: DataFrame, links: DataFrame, facts: DataFrame, theses: DataFrame, signals: DataFrame, raw_files: DataFrame) -> DataFrame:
    """Six headline counts, a row each."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    out = one("pages", active(pages))
    for name, df in (("links", active(links)), ("facts", active(facts)), ("active_theses", theses.where("status = 'active'")), ("signals", active(signals)), ("pending_raw", raw_files.where("triage_decision = 'pending'"))):
        out = out.unionByName(one(name, df))
    return out


def queue_breakdown(jobs: DataFrame) -> DataFrame:
    kind = F.when(F.col("name") == "agent_run", F.concat_ws(":", "name", "skill")).otherwise(F.col("name"))
    return jobs.groupBy("name", kind.alias("task_type"), "status").agg(F.count("*").alias("n"))


def usage_totals(usage: DataFrame, as_of: str, prices: dict[str, float] | None = None) -> DataFrame:
    """Tokens of today and the last 7 and 30 days, embedding apart from chat: one pass of conditional sums, a row a bucket.

    With prices of a million tokens (input, output, embedding) also what they cost.
    """
    day = F.lit(as_of).cast("date")
    windows = (("today", 0), ("last_7d", 7), ("last_30d", 30))
    rows = usage.withColumn("since", F.array(*[F.when(F.col("create_time") >= F.date_sub(day, n).cast("timestamp"), F.lit(name)) for name, n in windows]))
    out = rows.select(F.explode(F.filter("since", lambda x: x.isNotNull())).alias("bucket"), "source", "tokens_in", "tokens_out").groupBy("bucket").agg(
        F.count("*").alias("requests"), F.coalesce(F.sum(F.when(F.col("source") == "embedding", F.col("tokens_in"))), F.lit(0)).alias("embedding_tokens"),
        F.coalesce(F.sum(F.when(F.col("source") != "embedding", F.col("tokens_in"))), F.lit(0)).alias("chat_in"), F.coalesce(F.sum(F.when(F.col("source") != "embedding", F.col("tokens_out"))), F.lit(0)).alias("chat_out"),
    )
    if prices is None:
        return out
    parts = (("chat_in", "input"), ("chat_out", "output"), ("embedding_tokens", "embedding"))
    return out.withColumn("cost", F.round(reduce(lambda a, b: a + b, [F.col(c) / 1e6 * prices.get(k, 0.0) for c, k in parts]), 6))


def usage_by_source_model(usage: DataFrame) -> DataFrame:
    return usage.groupBy("source", "model").agg(F.count("*").alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.countDistinct("job_id").alias("jobs"))


def usage_daily(usage: DataFrame, tz: str = "Asia/Shanghai") -> DataFrame:
    """Sums per local day and source."""
    return usage.groupBy(F.from_utc_timestamp("create_time", tz).cast("date").alias("day"), "source").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("*").alias("requests"))


def stage_progress(events: DataFrame) -> DataFrame:
    """Finished stages of each page and its last failure."""
    done = F.array_sort(F.collect_set(F.when(F.col("status") == "pass", F.col("stage"))))
    return events.groupBy(F.col("entity_id").alias("page_id")).agg(F.array_join(F.transform(done, lambda x: x.cast("string")), ",").alias("stages"), F.max(F.when(F.col("status") == "fail", F.col("ts"))).alias("last_failure"))


def enrich_backlog(pages: DataFrame, links: DataFrame, events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pages that await enrichment, score low or are much linked, with what has changed since the last one."""
    last = events.where("action = 'enrich'").groupBy(F.col("entity_id").alias("id")).agg(F.max("ts").alias("last_at"))
    e = is_effective()
    into = active(links).select(F.col("to_page_id").alias("id"), e.alias("e"), "create_time").join(last, "id", "left")
    counts = into.groupBy("id").agg(F.count_if("e").alias("backlinks"), F.count_if(F.col("e") & (F.col("last_at").isNull() | (F.col("create_time").cast("timestamp") > F.col("last_at")))).alias("new_backlinks"))
    busy = jobs.where("name = 'enrich_entity' AND status IN ('waiting', 'active')").select(F.col("target_page_id").alias("id")).distinct().withColumn("in_flight", F.lit(True))
    rows = active(pages).where(F.col("type").isin("company", "industry", "concept")).join(counts, "id", "left").join(last, "id", "left").join(busy, "id", "left").fillna(0, ["backlinks", "new_backlinks"]).fillna(False, ["in_flight"])
    awaits = F.col("entity_state").isin("stub", "candidate_promoted")
    rows = rows.where(awaits | (F.col("completeness_score") < 0.6) | (F.col("backlinks") >= 3))
    action = F.when(awaits & (F.col("backlinks") >= 2), "enrich_now").when((F.col("new_backlinks") >= 2) | ((F.col("backlinks") >= 3) & (F.col("completeness_score") < 0.5)), "retrigger").otherwise("monitor")
    priority = F.when(awaits, 3).otherwise(1) + F.least("backlinks", F.lit(10)) + F.greatest(F.lit(0), F.floor(F.round((0.8 - F.col("completeness_score")) * 10, 4) + 0.5))
    return rows.select("id", "slug", "backlinks", "new_backlinks", "last_at", "in_flight", action.alias("action"), priority.cast("long").alias("priority"))


def enrich_retrigger(pages: DataFrame, links: DataFrame, events: DataFrame, jobs: DataFrame, min_score: float = 0.5, min_backlinks: int = 3, min_new: int = 2, limit: int = 30) -> DataFrame:
    """Of the 3 * limit most linked enriched pages those with a low score or new links, limited."""
    rows = enrich_backlog(pages, links, events, jobs).join(pages.select("id", "entity_state", "completeness_score"), "id")
    first = rows.where((F.col("entity_state") == "compiled") & (F.col("backlinks") >= min_backlinks) & ~F.col("in_flight")).orderBy(F.desc("backlinks"), "id").limit(3 * limit)
    return first.where((F.col("completeness_score") < min_score) | (F.col("new_backlinks") >= min_new)).orderBy(F.desc("backlinks"), "id").limit(limit).select("id", "slug", "backlinks", "new_backlinks")


def enrich_list(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages awaiting their first enrichment with their effective backlinks."""
    rows = active(pages).where(F.col("entity_state").isin("stub", "candidate_promoted"))
    return rows.join(effective_backlinks(links).withColumnRenamed("page_id", "id"), "id", "left").fillna(0, ["backlinks"]).select("id", "slug", "type", "backlinks")


def enrich_gate(pages: DataFrame, links: DataFrame, facts: DataFrame, timeline: DataFrame) -> DataFrame:
    """Stubs and candidates with enough backlinks, sourced facts or a timeline entry, and why."""
    f = active(facts).where("valid_to IS NULL AND source_page_id IS NOT NULL").groupBy(F.col("entity_page_id").alias("id")).agg(F.count("*").alias("facts"))
    t = active(timeline).groupBy(F.col("entity_page_id").alias("id")).agg(F.count("*").alias("entries"))
    rows = enrich_list(pages, links).join(f, "id", "left").join(t, "id", "left").fillna(0, ["facts", "entries"])
    reason = F.when(F.col("backlinks") >= 3, "backlinks").when(F.col("facts") >= 3, "facts").when(F.col("entries") >= 1, "timeline")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "backlinks", "facts", "entries", "reason")


def entity_evidence(pages: DataFrame, links: DataFrame, facts: DataFrame, timeline: DataFrame, signals: DataFrame, as_of: str) -> DataFrame:
    """What each compiled entity page has missed since its update: facts, entries, signals, and sources that carry any or link by type."""
    page = active(pages).where(F.col("type").isin("company", "industry", "concept") & (F.col("entity_state") == "compiled")).select(F.col("id").alias("page_id"), "update_date", "completeness_score")

    def since(df: DataFrame, at: str) -> DataFrame:
        return active(df).withColumnRenamed("entity_page_id", "page_id").withColumn("at", F.col(at).cast("date")).join(page.select("page_id", "update_date"), "page_id").where(F.col("at") > F.col("update_date"))

    parts = {"facts": since(facts, "valid_from"), "entries": since(timeline, "event_date"), "signals": since(signals, "detected_at")}
    typed = active(links).where("link_type <> 'mention'").select(F.col("to_page_id").alias("page_id"), F.col("from_page_id").alias("source_page_id"), F.col("create_time").alias("at")).join(page.select("page_id", "update_date"), "page_id").where("at > update_date")
    sources = typed.select("page_id", "source_page_id", "at")
    for df in parts.values():
        sources = sources.unionByName(df.where("source_page_id IS NOT NULL").select("page_id", "source_page_id", "at"))
    out = page.join(sources.groupBy("page_id").agg(F.countDistinct("source_page_id").alias("new_sources"), F.max("at").alias("latest_source")), "page_id", "left")
    for name, df in parts.items():
        out = out.join(df.groupBy("page_id").agg(F.count("*").alias(f"new_{name}"), F.max("at").alias(f"latest_{name}")), "page_id", "left")
    latest = F.greatest("latest_source", "latest_facts", "latest_entries", "latest_signals")
    out = out.fillna(0, ["new_sources", "new_facts", "new_entries", "new_signals"]).withColumn("latest", latest).where("latest IS NOT NULL")
    return out.select("page_id", "completeness_score", "new_sources", "new_facts", "new_entries", "new_signals", F.datediff(F.least("latest", F.lit(as_of).cast("date")), "update_date").alias("days_behind"))


def stale_entities(evidence: DataFrame, stale_days: int = 1) -> DataFrame:
    """Entities behind their evidence, with the update priority."""
    p = 5 * F.col("days_behind") + 6 * F.col("new_facts") + 8 * F.col("new_signals") + 4 * F.col("new_entries") + 3 * F.col("new_sources") + F.floor(F.round(10 * (1 - F.col("completeness_score")), 4) + 0.5)
    return evidence.where(F.col("days_behind") >= stale_days).select("page_id", "days_behind", p.cast("long").alias("priority"))


#: Sections that new evidence of a kind suggests, by page type; sources are always suggested, the last kind is that of sources alone.
SUGGESTED = {
    "company": {"new_facts": ("Financial Summary",), "new_entries": ("Key Timeline",), "new_signals": ("Risk Factors", "Catalysts"), "only_sources": ("Company Overview",)},
    "industry": {"new_facts": ("Market Size And Growth",), "entries_or_signals": ("Key Trends",), "new_sources": ("Competitive Landscape",)},
    "concept": {"facts_or_entries": ("Use In Investment Research",), "new_sources": ("Definition",)},
}


def update_candidates(evidence: DataFrame, pages: DataFrame, stale_days: int = 1, limit: int | None = None) -> DataFrame:
    """(page_id, days_behind, priority, action, sections, safe): stale entities with what to do and which sections the evidence suggests.

    The action is a rewrite (llm_refresh) from two signals or 21 days on, else append_update; that is safe to do unasked
    where there is evidence but no signal. With a limit those of the highest priority, ties by page.
    """
    kinds = {
        "new_facts": F.col("new_facts") > 0, "new_entries": F.col("new_entries") > 0, "new_signals": F.col("new_signals") > 0, "new_sources": F.col("new_sources") > 0,
        "only_sources": (F.col("new_sources") > 0) & (F.col("new_facts") == 0) & (F.col("new_signals") == 0), "entries_or_signals": (F.col("new_entries") > 0) | (F.col("new_signals") > 0), "facts_or_entries": (F.col("new_facts") > 0) | (F.col("new_entries") > 0),
    }
    sections = F.array(F.lit("Sources"))
    for kind, own in SUGGESTED.items():
        parts = [F.when(kinds[k], x) for k, names in own.items() for x in names]
        sections = F.when(F.col("type") == kind, F.array_compact(F.array(F.lit("Sources"), *parts))).otherwise(sections)
    stale = stale_entities(evidence, stale_days).select("page_id", "priority")
    rows = evidence.join(stale, "page_id").join(pages.select(F.col("id").alias("page_id"), "type"), "page_id")
    action = F.when((F.col("new_signals") >= 2) | (F.col("days_behind") >= 21), "llm_refresh").otherwise("append_update")
    safe = (action == "append_update") & (F.col("type") != "thesis") & (F.col("new_signals") == 0) & (F.col("new_sources") + F.col("new_facts") + F.col("new_entries") > 0)
    out = rows.select("page_id", "days_behind", "priority", action.alias("action"), sections.alias("sections"), safe.alias("safe"))
    return out.orderBy(F.desc("priority"), "page_id").limit(limit) if limit else out


def lint(pages: DataFrame, links: DataFrame, theses: DataFrame, raw_files: DataFrame, facts: DataFrame, events: DataFrame, as_of: str, sample: int = 10, more: dict[str, DataFrame] | None = None) -> DataFrame:
    """(check, n, sample of ids) of the quality checks; checks that find nothing have no row.

    more: further checks by name with an `id` each, such as failing reports and stale entities of their operators.
    """
    from lorebase.operators.entities import alias_conflicts
    from lorebase.operators.facts import expire

    day = F.lit(as_of).cast("date")
    checks = {
        "orphans": orphans(pages, links, as_of).select("id"),
        "stale_theses": theses.where((F.col("status") == "active") & (F.col("update_date") < F.date_sub(day, 30))).select(F.col("page_id").alias("id")),
        "unenriched_stubs": active(pages).where("entity_state = 'stub'").select("id"),
        "pending_raw_files": raw_files.where((F.col("triage_decision") == "pending") & (F.col("create_date") < F.date_sub(day, 7))).select("id"),
        "expired_facts": expire(facts, as_of, 90).where("expired").select("id"),
        "failing_reviews": latest_review(events).where("status = 'fail'").select(F.col("page_id").alias("id")),
        "alias_conflicts": alias_conflicts(pages).select(F.col("first_id").alias("id")),
    } | {name: df.select("id") for name, df in (more or {}).items()}
    rows = None
    for name, df in checks.items():
        one = df.select(F.lit(name).alias("check"), F.col("id").cast("long").alias("id"))
        rows = one if rows is None else rows.unionByName(one)
    rows = written(rows, "lint")  # ids only: the checks run once, counts and samples read these
    rank = F.row_number().over(Window.partitionBy("check").orderBy("id"))
    n = rows.groupBy("check").agg(F.count("*").alias("n"))
    few = rows.withColumn("k", rank).where(F.col("k") <= sample).groupBy("check").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("sample"))
    return n.join(few, "check")


def usage_by_skill(usage: DataFrame, jobs: DataFrame, limit: int = 50) -> DataFrame:
    """Tokens of agent runs by skill, most first; usage without a job counts under no skill."""
    skill = jobs.select(F.col("id").alias("job_id"), "skill")
    g = usage.where("source = 'agent_runtime'").join(skill, "job_id", "left").groupBy("skill").agg(F.countDistinct("job_id").alias("jobs"), F.count("*").alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return g.orderBy(F.desc(F.col("tokens_in") + F.col("tokens_out")), F.col("skill").asc_nulls_last()).limit(limit)


def usage_recent(usage: DataFrame, limit: int = 50) -> DataFrame:
    return usage.orderBy(F.desc("create_time"), F.desc("id")).limit(limit)


def comment_threads(comments: DataFrame) -> DataFrame:
    """Comments of each page in the order of time, numbered."""
    rn = F.row_number().over(Window.partitionBy("page_id").orderBy("create_date", "id"))
    return comments.select("page_id", rn.alias("rn"), "id", "author", "intent")


def facts_risk(pages: DataFrame, facts: DataFrame, tables: DataFrame, limit: int = 30) -> DataFrame:
    """(page_id, facts, tables, numbers, has_block, risk) of pages (page_id, content) with tables (page_id) or a fact block.

    risk is high for tables without facts, medium for one fact at most, else none. The limit, by fewest facts, applies before the risk.
    """
    n = active(facts).groupBy(F.col("source_page_id").alias("page_id")).agg(F.count("*").alias("facts"))
    t = tables.groupBy("page_id").agg(F.count("*").alias("tables"))
    block = F.col("content").rlike(r"(?i)<!--\s*facts\b")
    rows = pages.join(n, "page_id", "left").join(t, "page_id", "left").fillna(0, ["facts", "tables"]).withColumn("has_block", F.coalesce(block, F.lit(False))).where("tables > 0 OR has_block")
    first = rows.orderBy("facts", "page_id").limit(limit)
    risk = F.when((F.col("tables") > 0) & (F.col("facts") == 0), "high").when(F.col("facts") <= 1, "medium")
    return first.select("page_id", "facts", "tables", F.regexp_count("content", F.lit(r"\d+(?:[.,]\d+)*%?")).alias("numbers"), "has_block", risk.alias("risk")).where("risk IS NOT NULL")
