"""Deterministic reviews of pages and of report documents: one row an issue, and a verdict a page."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import yaml
from lorebase.operators.extraction import EVENT_KEYS, EVENT_TEXTS, FACT_KEYS, REQUIRED_SECTIONS, fact_block, suspicious_date
from lorebase.operators.graph import active

#: By page type the least characters and wikilinks, the sections and the keys of the front matter.
PROFILES = {
    "source": (1200, 2, ("Source Overview", "Entities Covered", "Factual Claims And Data", "Core Views", "Investment Mechanism", "Expectation Gap", "Investment Implications", "Relation To Existing Knowledge", "Follow-up Research Tasks"), ("research_id", "research_type", "markdown_url")),
    "brief": (120, 1, ("TL;DR", "Key Observations", "Links"), ("research_id", "research_type", "markdown_url")),
    "company": (900, 3, REQUIRED_SECTIONS["company"], ()),
    "industry": (900, 3, REQUIRED_SECTIONS["industry"], ()),
    "concept": (500, 2, REQUIRED_SECTIONS["concept"], ()),
    "thesis": (800, 2, ("Core Thesis", "Bull Case", "Bear Case", "Key Assumptions", "Validation / Falsification Conditions", "Catalyst Timeline", "Risk Management", "Thesis Evolution", "Sources"), ()),
}
#: Subsections that compare a source with what is known; one name of each group must be there.
RELATION_GROUPS = (("new information",), ("confirms existing view",), ("contradictions / revisions", "contradictions or revisions"))
#: Further sections of meeting minutes.
MEETING_SECTIONS = ("Meeting Context", "Management Claims vs Analyst Inference", "Management Claims", "Analyst Inference")

#: By report subtype the least characters, the keys of the front matter, the sections and the least number of numbered headings.
OUTPUT_PROFILES = {
    "daily-review": (
        5000, ("type", "subtype", "title", "date", "sources", "tags", "last_updated"),
        ("Q1: Biggest Change In Understanding Today", "Q2: Most Contrarian Data Point / Expectation Gap", "Q3: Cross-Sector Connections", "Q4: Highest-Conviction Long", "Q5: Highest-Conviction Short / Reduce", "Q6: Knowledge Gaps And Next Ingest Priorities", "Q7: Red Team / Bias Check", "Sources"),
        7,
    ),
    "daily-summarize": (
        7000, ("type", "subtype", "title", "date", "sources", "active_thesis_count", "portfolio_mode", "tags", "last_updated"),
        ("1. Executive Summary", "2. Market Snapshot", "3. Portfolio Impact", "4. New Positions", "5. Reduce / Hedge", "6. Risk Alerts", "7. Catalyst Calendar", "8. Research To-Do", "9. Talking Points", "Self-Check"),
        9,
    ),
}
#: What a section of new positions, and one of reductions, must say, and by which words that is told.
TRADE_FIELDS = {
    "sizing": r"\bsizing\b|\bsize\b|% NAV|position size",
    "entry": r"\bentry\b|limit price|market on open|入场",
    "stop": r"\bstop\b|invalidation|止损",
    "target": r"\btarget\b|base case|bull case|bear case|目标",
    "catalyst": r"\bcatalyst\b|催化",
    "risk": r"\brisk\b|风险",
}
HEDGE_FIELDS = {
    "instrument/action": r"\breduce\b|\bhedge\b|\btrim\b|\bshort\b|减仓|对冲",
    "sizing": r"\bsizing\b|\bsize\b|% NAV|比例|notional",
    "rationale": r"\brationale\b|\breason\b|why|理由",
    "priority": r"\bpriority\b|urgent|monitor|优先|紧急",
}
#: Fixed value: words by which a section tells that nothing is to be done.
NO_ACTION = r"no (new )?(position|trade|opportunit|action)|no need to|hold current|保持|not actionable|watchlist only|research task"


def heading_key(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(title, "[`*_]", ""), r"\s+", " ")))


def visible_text(markdown: Column) -> Column:
    """Text without comments, link targets and marks, white space collapsed."""
    for pattern, to in ((r"(?s)<!--.*?-->", " "), (r"\[\[([^\[\]|]+)\|([^\[\]]+)\]\]", "$2"), (r"\[\[([^\[\]]+)\]\]", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"[#>*`|-]", " "), (r"\s+", " ")):
        markdown = F.regexp_replace(markdown, pattern, to)
    return F.trim(markdown)


def first_sections(body: Column) -> Column:
    """array<struct<key, text>>: second- and third-level sections in their order, the first of each name."""
    parts = F.filter(F.split(body, r"(?m)^(?=#{2,3}\s+\S)"), lambda p: p.rlike(r"\A#{2,3}\s+\S"))
    found = F.transform(parts, lambda p: F.struct(heading_key(F.regexp_extract(p, r"\A#{2,3}\s+(.+?)\s*(?:\n|\z)", 1)).alias("key"), F.regexp_replace(p, r"\A[^\n]*\n?", "").alias("text")))
    # the array is named once, so that it is built once
    return F.get(F.transform(F.array(found), lambda s: F.filter(s, lambda x, i: F.array_position(F.transform(s, lambda y: y["key"]), x["key"]) == i + 1)), F.lit(0))


def _present(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "") & (value != "[]")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _issue(severity: str, code: str, detail: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (none if detail is None else detail.cast("string")).alias("detail"))


class Rules:
    """Issues of a row as one array: of conditions, and of lists with an issue for each of their values."""

    def __init__(self) -> None:
        self.single: list[Column] = []
        self.lists: list[Column] = []

    def when(self, condition: Column, severity: str, code: str, detail: Column | None = None) -> None:
        self.single.append(F.when(condition, _issue(severity, code, detail)))

    def each(self, details: Column, severity: str, code: str) -> None:
        """An issue for each value of an array of texts; none for null."""
        none = F.array().cast("array<string>")
        self.lists.append(F.transform(F.coalesce(details, none), lambda d: _issue(severity, code, d)))

    def of(self, rows: DataFrame) -> DataFrame:
        """(page_id, severity, code, detail), from one pass over the rows."""
        # outer, since explode() would have its array evaluated once more, in a filter for rows without issues
        found = rows.select("page_id", F.explode_outer(F.concat(F.array_compact(F.array(*self.single)), *self.lists)).alias("x"))
        return found.where("x IS NOT NULL").select("page_id", "x.*")


def _by_kind(kind: Column, values: dict[str, tuple]) -> Column:
    """The array that a kind has; empty for others."""
    out = F.array().cast("array<string>")
    for k, own in values.items():
        out = F.when(kind == k, F.array(*map(F.lit, own)) if own else F.array().cast("array<string>")).otherwise(out)
    return out


def plan_lists(plan: Column) -> Column:
    """struct<kind, companies, soft> of an entity plan: mapping, other or malformed; the slugs proposed for companies and the types of soft candidates, where they are text."""

    def texts(value: object, key: str) -> list[str]:
        return [x[key] for x in value if isinstance(x, dict) and isinstance(x.get(key), str)] if isinstance(value, list) else []

    def shape(value: object, malformed: bool) -> dict:
        if not isinstance(value, dict):
            return {"kind": "malformed" if malformed else "other", "companies": [], "soft": []}
        return {"kind": "mapping", "companies": texts(value.get("new_company_candidates"), "proposed_slug"), "soft": texts(value.get("soft_candidates"), "type")}

    strings = pa.list_(pa.string())
    return yaml.column(plan, shape, "struct<kind:string,companies:array<string>,soft:array<string>>", pa.struct([("kind", pa.string()), ("companies", strings), ("soft", strings)]))


def review_issues(pages: DataFrame) -> DataFrame:
    """(page_id, severity, code, detail) of pages (page_id, type, content, frontmatter as JSON text, timeline).

    Each type has a profile of least sizes, sections and keys; sources also need a fact block, comparisons with what
    is known and an entity plan, a YAML mapping whose company candidates are slugs of companies and whose soft candidates
    are concepts or industries.
    """
    rows = pages.select("page_id", "type", F.coalesce("content", F.lit("")).alias("body"), F.coalesce("frontmatter", F.lit("{}")).alias("fm"), F.coalesce("timeline", F.lit("")).alias("timeline"))
    known, source = F.col("type").isin(*PROFILES), F.col("type") == "source"
    least = lambda i: F.element_at(F.create_map(*[F.lit(x) for t, p in PROFILES.items() for x in (t, p[i])]), F.when(known, F.col("type")))
    plan = F.trim(F.regexp_extract("body", r"(?is)<!--\s*entity_plan\b(.*?)-->", 1), F.lit(" \n\t\r"))
    fields = F.coalesce(F.from_json("fm", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = rows.select(
        "page_id", "type", F.length(visible_text(F.col("body"))).alias("chars"), F.regexp_count("body", F.lit(r"\[\[[^\[\]]+\]\]")).alias("wikilinks"), first_sections(F.col("body")).alias("sections"), fields.alias("fields"),
        yaml.records(F.when(source, fact_block(F.col("body"))), FACT_KEYS).alias("facts"), yaml.records(F.when(known, F.col("timeline")), EVENT_KEYS, EVENT_TEXTS).alias("events"), F.col("body").rlike(r"(?i)<!--\s*facts\b").alias("has_facts"),
        (F.trim("timeline") != "").alias("has_timeline"), F.col("body").rlike(r"(?i)<!--\s*entity_plan\b").alias("has_plan"), plan.alias("plan_text"), plan_lists(F.when(source & (plan != ""), plan)).alias("plan"),
    )
    text_of = lambda key: F.get(F.filter("sections", lambda x: x["key"] == key), F.lit(0))["text"]
    rows = rows.withColumn("wanted", F.transform(_by_kind(F.col("type"), {t: p[2] for t, p in PROFILES.items()}), lambda w: F.struct(w.alias("section"), text_of(F.lower(w)).alias("text"))))
    related = F.filter("sections", lambda x: x["key"].isin(*[n for names in RELATION_GROUPS for n in names]))
    slugs = lambda x: F.transform(F.regexp_extract_all(x["text"], F.lit(r"\[\[([^\[\]|]+)(?:\|[^\[\]]+)?\]\]"), 1), lambda t: F.trim(t))
    whole = F.lit(True)
    keys = F.transform("sections", lambda x: x["key"])
    for names in RELATION_GROUPS:
        whole = whole & F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    rows = rows.withColumn("whole", whole).withColumn("links", F.array_distinct(F.flatten(F.transform(related, slugs))))

    rules = Rules()
    rules.when(~F.coalesce(known, F.lit(False)), "warn", "no_profile", F.col("type"))
    rules.when(F.col("chars") < least(0), "error", "content_too_short", F.col("chars"))
    rules.when(F.col("wikilinks") < least(1), "warn", "too_few_wikilinks", F.col("wikilinks"))
    rules.each(F.transform(F.filter("wanted", lambda w: w["text"].isNull()), lambda w: w["section"]), "error", "missing_section")
    compared = source & F.col("whole")
    thin = F.filter("wanted", lambda w: (F.length(visible_text(w["text"])) < 20) & ~((F.lower(w["section"]) == "relation to existing knowledge") & compared))
    rules.each(F.transform(thin, lambda w: w["section"]), "warn", "thin_section")
    rules.when(source & ~F.col("whole"), "warn", "missing_relation_subsections")
    rules.when(compared & (F.size("links") == 0), "warn", "relation_missing_specific_links")
    rules.when(compared & (F.size("links") == 1), "warn", "relation_too_few_specific_links")
    rules.when(compared & (F.size("links") > 1) & ~F.exists("links", lambda x: x.rlike("^(sources|companies|industries)/")), "warn", "relation_missing_comparable_page_links")

    field = lambda k: F.try_element_at("fields", k)
    rules.each(F.filter(_by_kind(F.col("type"), {t: p[3] for t, p in PROFILES.items()}), lambda k: ~F.coalesce(_present(field(k)), F.lit(False))), "error", "missing_frontmatter_key")
    good = F.filter("facts", lambda x: x["entity"].isNotNull() & x["metric"].isNotNull() & x["value"].isNotNull())
    rules.when(source & ~F.col("has_facts"), "warn", "missing_facts_block")
    rules.when(source & F.col("has_facts") & (F.size(good) == 0), "warn", "empty_facts_block")
    dated = F.filter("events", lambda x: x["date"].isNotNull() & x["event_type"].isNotNull() & x["summary"].isNotNull())
    rules.when(known & F.col("has_timeline") & (F.size(dated) == 0), "warn", "invalid_timeline_yaml")
    rules.each(F.transform(F.filter(dated, lambda x: suspicious_date(x["date"], x["summary"])), lambda x: x["date"]), "warn", "approximate_timeline_date")

    minutes = source & field(F.lit("research_type")).eqNullSafe("meeting_minutes")
    rules.each(F.when(minutes, F.filter(F.array(*map(F.lit, MEETING_SECTIONS)), lambda w: text_of(F.lower(w)).isNull())), "error", "missing_meeting_minutes_section")
    rules.when(minutes & ~F.col("has_facts"), "warn", "meeting_minutes_missing_facts_block")
    soft = F.filter(F.from_json(field(F.lit("primary_entities")), "array<string>"), lambda x: x.rlike("^(concepts|industries)/"))
    rules.when(source & (F.size(soft) > 0), "warn", "primary_entities_soft_entity", F.array_join(soft, ", "))
    rules.when(source & ~F.col("has_plan"), "warn", "missing_entity_plan")
    rules.when(source & F.col("has_plan") & (F.col("plan_text") == ""), "warn", "empty_entity_plan")
    rules.when(F.col("plan.kind") == "malformed", "warn", "invalid_entity_plan_yaml")
    rules.when(F.col("plan.kind") == "other", "warn", "invalid_entity_plan_shape")
    wrong = F.filter("plan.companies", lambda x: ~x.startswith("companies/"))
    rules.when(F.size(wrong) > 0, "warn", "invalid_entity_plan_company_candidate", F.array_join(wrong, ", "))
    wrong = F.array_distinct(F.filter("plan.soft", lambda x: ~x.isin("concept", "industry")))
    rules.when(F.size(wrong) > 0, "warn", "invalid_entity_plan_soft_candidate", F.array_join(wrong, ", "))
    return rules.of(rows)


def review_pages(pages: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """(page_id, status, errors, warnings, content_hash): fail where there is an error."""
    n = (issues if issues is not None else review_issues(pages)).groupBy("page_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    rows = pages.select("page_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash")).join(n, "page_id", "left").fillna(0, ["errors", "warnings"])
    return rows.select("page_id", F.when(F.col("errors") > 0, "fail").otherwise("pass").alias("status"), "errors", "warnings", "content_hash")


def gated_reviews(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored review (page_id, content_hash, status) where it is of the present content, else a new one; `reused` tells which."""
    now = pages.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    old = stored.select("page_id", "content_hash", F.col("status").alias("stored")).dropDuplicates(["page_id", "content_hash"])
    met = now.join(old, ["page_id", "content_hash"], "left")
    fresh = review_pages(met.where("stored IS NULL").select(*pages.columns)).select("page_id", "status", F.lit(False).alias("reused"))
    return met.where("stored IS NOT NULL").select("page_id", F.col("stored").alias("status"), F.lit(True).alias("reused")).unionByName(fresh)


#: What \s, ^ and $ of Java's expressions know, (?m) set.
_BLANK, _BREAKS = "[ \\t\\n\\x0b\\f\\r]", "\n\r\u0085\u2028\u2029"
_EOL = "(?=[\\r\u0085\u2028\u2029]|(?<!\\r)\\n|\\Z)"
_NUMBERED = re.compile(f"##{_BLANK}+(?:Q[0-9]|[0-9]+\\.)")
_HEADING = re.compile(f"##{_BLANK}+([^{_BREAKS}]+?){_BLANK}*{_EOL}")
_SECTIONS = [re.compile(f"##{_BLANK}+{re.escape(title)}{_BLANK}*{_EOL}") for title in ("4. New Positions", "5. Reduce / Hedge")]
_DISCLAIMERS = (b"watchlist", b"no active thesis", b"research brief")


def _visible_lengths(texts: pa.Array) -> np.ndarray:
    """The characters of each text, trimmed and with runs of white space as one."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = (offsets - offsets[0]).astype(np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~blank
    begins[1:] &= blank[:-1]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    begins[inner] = ~blank[inner]
    count = lambda mask: np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[at])
    words = count(begins)
    return count(~blank & ((data & 0xC0) != 0x80)) + np.maximum(words - 1, 0)


_SEEN = "struct<chars:int,refs:int,numbered:int,titles:array<string>,new:string,cut:string,asked:array<boolean>,disclaimer:boolean>"


def _scan(texts: pa.Array) -> pa.Array:
    """What the rules on a report document look for, by one search for its headings in place of an expression for each."""
    texts = texts.cast(pa.string())
    rows = []
    for t in texts.to_pylist():
        heads, i = [], t.find("##")
        while i >= 0:
            if i == 0 or t[i - 1] in _BREAKS:
                heads.append(i)
            i = t.find("##", i + 1)
        titles, end = [], 0
        for i in heads:
            m = _HEADING.match(t, i) if i >= end else None
            if m:
                titles.append(m[1].strip(" "))
                end = m.end()
        parts, heads_of = [], [i for i in heads if t[i + 2 : i + 3] in tuple(" \t\n\x0b\f\r")]
        for pattern in _SECTIONS:
            m = next(filter(None, (pattern.match(t, i) for i in heads_of)), None)
            parts.append(t[m.end() : next((i for i in heads_of if i >= m.end()), len(t))] if m else "")
        low = t.encode().lower()
        rows.append((t.count("[[sources/") + t.count("[[briefs/"), sum(_NUMBERED.match(t, i) is not None for i in heads), titles, *parts, [q in low for q in (b"q4", b"q5", b"q6")], any(d in low for d in _DISCLAIMERS)))
    refs, numbered, titles, new, cut, asked, said = zip(*rows, strict=True) if rows else [()] * 7
    columns = [pa.array(_visible_lengths(texts) if rows else [], pa.int32()), pa.array(refs, pa.int32()), pa.array(numbered, pa.int32()), pa.array(titles, pa.list_(pa.string())), pa.array(new, pa.string()), pa.array(cut, pa.string()), pa.array(asked, pa.list_(pa.bool_())), pa.array(said, pa.bool_())]
    return pa.StructArray.from_arrays(columns, ["chars", "refs", "numbered", "titles", "new", "cut", "asked", "disclaimer"])


def output_issues(outputs: DataFrame) -> DataFrame:
    """(page_id, severity, code, detail) of report documents (page_id, slug, content, frontmatter as JSON text)."""
    fields = F.coalesce(F.from_json(F.coalesce("frontmatter", F.lit("{}")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = outputs.select("page_id", "slug", F.coalesce("content", F.lit("")).alias("body"), fields.alias("f"))
    get = lambda k: F.try_element_at("f", F.lit(k))
    rows = rows.withColumn("subtype", F.when(get("subtype").isin(*OUTPUT_PROFILES), get("subtype")).when(F.col("slug").contains("daily-summarize"), "daily-summarize").otherwise("daily-review"))
    rows = rows.withColumn("seen", F.arrow_udf(_scan, _SEEN)("body")).select("*", "seen.*").withColumns({"n": get("active_thesis_count").try_cast("int"), "mode": get("portfolio_mode")})
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for t, p in OUTPUT_PROFILES.items() for x in (t, p[i])]), F.col("subtype"))
    brief = F.col("subtype") == "daily-summarize"
    rules = Rules()
    rules.each(F.filter(_by_kind(F.col("subtype"), {t: p[1] for t, p in OUTPUT_PROFILES.items()}), lambda k: ~F.coalesce(_present(F.try_element_at("f", k)), F.lit(False))), "error", "missing_frontmatter")
    rules.when(~get("type").eqNullSafe("output"), "error", "wrong_type")
    rules.when(~get("subtype").eqNullSafe(F.col("subtype")), "error", "wrong_subtype")
    rules.when(F.col("chars") < of(0), "warn", "short_output", F.col("chars"))
    rules.each(F.filter(_by_kind(F.col("subtype"), {t: p[2] for t, p in OUTPUT_PROFILES.items()}), lambda h: ~F.array_contains("titles", h)), "error", "missing_section")
    rules.when(F.col("refs") < 5, "warn", "low_source_refs", F.col("refs"))
    rules.when(~brief & (F.col("numbered") < of(3)), "error", "missing_questions", F.col("numbered"))
    rules.when(brief & (F.col("numbered") < of(3)), "error", "missing_sections", F.col("numbered"))
    unused = F.array_compact(F.array(*[F.when(~(F.get("asked", F.lit(q - 4)) & F.col("body").rlike(rf"(?i)\bQ{q}\b|§Q{q}\b")), f"Q{q}") for q in (4, 5, 6)]))
    rules.each(F.when(brief & get("sources").contains("daily-review-"), unused), "error", "missing_daily_review_reuse")
    watch, live = brief & (F.coalesce("n", F.lit(1)) == 0), brief & (F.coalesce("n", F.lit(1)) != 0)
    rules.when(watch & ~F.col("mode").eqNullSafe("watchlist"), "error", "wrong_portfolio_mode")
    rules.when(watch & ~F.col("disclaimer"), "error", "missing_watchlist_disclaimer")
    rules.when(watch & F.col("new").rlike(r"(?i)%\s*NAV|\bNAV\b|\bsizing\b|\bentry\b|\bstop\b|\btarget\b"), "error", "watchlist_has_execution_fields")
    rules.when(live & (F.col("n") > 0) & _present(F.col("mode")) & (F.col("mode") != "active-thesis"), "error", "wrong_portfolio_mode")
    for column, wanted, code in (("new", TRADE_FIELDS, "incomplete_trade_sheet"), ("cut", HEDGE_FIELDS, "incomplete_reduce_hedge")):
        acting = live & F.col(column).rlike(r"[^ \n\t\r]") & ~F.col(column).rlike("(?i)" + NO_ACTION)
        lacking = F.array_compact(F.array(*[F.when(~F.col(column).rlike("(?i)" + p), k) for k, p in wanted.items()]))
        rules.each(F.when(acting, lacking), "error", code)
    return rules.of(rows)


def output_backlog(outputs: DataFrame, limit: int = 30) -> DataFrame:
    """Verdicts of report documents, failing ones first, then by slug from the last."""
    n = output_issues(outputs).groupBy("page_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    rows = outputs.select("page_id", "slug").join(n, "page_id", "left").fillna(0, ["errors", "warnings"]).withColumn("status", F.when(F.col("errors") > 0, "fail").otherwise("pass"))
    return rows.orderBy("status", F.desc("slug")).limit(limit).select("page_id", "slug", "status", "errors", "warnings")


def maintenance_report(parts: dict[str, DataFrame], sample: int = 10) -> DataFrame:
    """(part, n, sample): how many rows each report has, and the first ids of it; each part has an `id` column."""
    counts = _union([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()])
    firsts = _union([df.select(F.lit(name).alias("part"), F.col("id").cast("long").alias("id")).orderBy("id").limit(sample) for name, df in parts.items()])
    return counts.join(firsts.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("sample")), "part", "left")


#: Tags that a report's subtype gives it.
OUTPUT_TAGS = {"daily-review": ("daily-review", "qa"), "daily-summarize": ("daily-summarize", "pm-brief", "ic-briefing")}


def save_outputs(documents: DataFrame, pages: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, tags) that report documents (subtype, date, title, content, tags as array) make of the ones there are.

    pages: (slug, title, content, content_hash, created), tags: (slug, tag, action add, keep or delete). The last of
    documents with one subtype and date counts by title, then content.
    """
    default = F.when(F.col("subtype") == "daily-review", F.concat(F.lit("Daily Research Review - "), "date")).otherwise(F.concat(F.lit("Daily PM Brief - "), "date"))
    given = F.lit(None).cast("array<string>")
    for kind, own in OUTPUT_TAGS.items():
        given = F.when(F.col("subtype") == kind, F.array(*map(F.lit, own))).otherwise(given)
    rows = documents.where(F.col("subtype").isin(*OUTPUT_TAGS) & F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    rows = rows.select(
        F.concat(F.lit("outputs/"), "subtype", F.lit("-"), "date").alias("slug"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), default).alias("title"), F.concat(F.rtrim("content"), F.lit("\n")).alias("content"), F.sha2("content", 256).alias("content_hash"),
        F.array_distinct(F.filter(F.transform(F.concat(F.coalesce("tags", F.array().cast("array<string>")), given), lambda t: F.lower(F.trim(t))), lambda t: t != "")).alias("tags"),
    )
    last = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("title"), F.desc("content")))
    rows = rows.withColumn("k", last).where("k = 1").drop("k")
    here = active(pages).select("slug").distinct().withColumn("there", F.lit(True))
    saved = rows.join(here, "slug", "left").select("slug", "title", "content", "content_hash", F.col("there").isNull().alias("created"))
    want = rows.select("slug", F.explode("tags").alias("tag")).withColumn("wanted", F.lit(True))
    have = active(tags).join(rows.select("slug"), "slug", "left_semi").select("slug", "tag").distinct().withColumn("had", F.lit(True))
    action = F.when(F.col("had").isNull(), "add").when(F.col("wanted").isNull(), "delete").otherwise("keep")
    return saved, want.join(have, ["slug", "tag"], "full").select("slug", "tag", action.alias("action"))
