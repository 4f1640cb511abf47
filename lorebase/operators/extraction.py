"""Facts, events, links and contexts from the text of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import yaml
from lorebase.functions.text import wikilinks

#: Kinds of dated events; any other becomes `other`.
EVENT_TYPES = ("earnings", "guidance", "partnership", "regulatory", "debt", "rating_change", "product_launch", "thesis_open", "thesis_close", "news", "other")
#: Terms by which a first of January or July is taken for a placeholder.
SUSPICIOUS_TERMS = ("fy", "expected", "estimate", "1h", "2h", "e", "guidance window", "source")
#: Names of metrics that hold words, not numbers.
TEXT_METRICS = ("quote", "comment", "view", "note", "summary", "opinion")
#: Directories of pages.
DIRECTORIES = "companies|industries|concepts|sources|theses|outputs|briefs"

FACT_KEYS = ("entity", "metric", "period", "value", "unit", "source_quote")
EVENT_KEYS = ("entity", "date", "event_type", "summary", "detail")
#: Keys of an event that must be text, not numbers or lists.
EVENT_TEXTS = ("date", "event_type", "summary")
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def fact_block(content: Column) -> Column:
    """The inside of the first `<!-- facts` comment, null if there is none."""
    inner = F.regexp_extract(content, r"(?s)<!--\s*facts\s*\n(.+?)\n\s*-->", 1)
    return F.when(inner != "", inner)


def parse_fact_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, entity, metric, period, value, unit, source_quote) of the pages' (page_id, content) fact blocks.

    Records need entity, metric and value, of which numbers become text; a block that is no YAML list gives none.
    """
    rows = pages.select("page_id", F.posexplode(yaml.records(fact_block(F.col("content")), FACT_KEYS)).alias("pos", "x"))
    return rows.select("page_id", "pos", "x.*").where("entity IS NOT NULL AND metric IS NOT NULL AND value IS NOT NULL")


def suspicious_date(date: Column, summary: Column) -> Column:
    """A first of January or July whose summary has one of the terms of estimates."""
    return date.rlike(r"^\d{4}-(01|07)-01$") & F.exists(F.array(*map(F.lit, SUSPICIOUS_TERMS)), lambda t: F.lower(summary).contains(t))


def parse_timeline(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Events of the pages' (page_id, timeline) lists: (entity_page_id, source_page_id, event_date, event_type, summary, detail).

    Dates must be days, summary and type must not be blank, placeholder dates go; events of an entity that is none of
    the known (slug, id) go, those of no entity stay. Repeats of (entity, date, summary) count once.
    """
    rows = pages.select("page_id", F.posexplode(yaml.records(F.col("timeline"), EVENT_KEYS, EVENT_TEXTS)).alias("pos", "x")).select("page_id", "pos", "x.*")
    kept = rows.where(F.col("date").rlike(_DATE) & (F.trim("summary") != "") & (F.trim("event_type") != "") & ~suspicious_date(F.col("date"), F.col("summary")))
    met = kept.join(known.select(F.col("slug").alias("entity"), F.col("id").alias("entity_page_id")), "entity", "left").where("entity IS NULL OR entity_page_id IS NOT NULL")
    rows = met.select(
        "entity_page_id", F.col("page_id").alias("source_page_id"), F.col("date").try_cast("date").alias("event_date"),
        F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")).otherwise("other").alias("event_type"), F.trim("summary").alias("summary"), "detail", "pos",
    ).where("event_date IS NOT NULL")
    first = Window.partitionBy("entity_page_id", "event_date", "summary").orderBy("source_page_id", "pos")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k", "pos")


def structured_value(value: Column) -> Column:
    """A number, perhaps qualified or a share, a number and more, or a range."""
    v = F.trim(value)
    return v.rlike(r"^[<>≤≥~≈]?\s*\d[\d,]*(?:\.\d+)?\s*%?$") | v.rlike(r"^\d[\d,]*(?:\.\d+)?\s*\+$") | v.rlike(r"^\d[\d,]*(?:\.\d+)?\s*[-–—]\s*\d[\d,]*(?:\.\d+)?$")


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def judge_proposed_facts(proposed: DataFrame, pages: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposed facts (page_id, pos, entity, metric, period, value, unit, source_quote) with why they are dropped.

    pages (page_id, content) and existing facts (page_id, entity, metric, period). A fact stays (reason null,
    confidence 0.7) if its entity is a slug that the page links, its metric and value hold a number, its quote is in
    the page but for case and white space, and it isn't there yet.
    """
    p = pages.select("page_id", F.transform(wikilinks(F.col("content")), lambda x: F.trim(x)).alias("linked"), _collapsed(F.lower("content")).alias("body"))
    e = existing.select("page_id", "entity", "metric", F.coalesce("period", F.lit("")).alias("period_key")).distinct().withColumn("there", F.lit(True))
    rows = proposed.withColumns({"entity": F.trim("entity"), "metric": F.trim("metric"), "period": F.nullif(F.trim("period"), F.lit("")), "period_key": F.coalesce(F.trim("period"), F.lit(""))})
    rows = rows.join(p, "page_id", "left").join(e, ["page_id", "entity", "metric", "period_key"], "left")
    quote = _collapsed(F.lower("source_quote"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    schema = no(F.col("metric") != "") | F.lower("metric").isin(*TEXT_METRICS) | no(structured_value(F.col("value")))
    reason = (
        F.when(no(F.col("entity").rlike(r"^(companies|industries|concepts)/[^/\s][^/]*$")), "schema")
        .when(no(F.array_contains("linked", F.col("entity"))), "entity")
        .when(schema, "schema")
        .when(no((F.length(F.trim("source_quote")) >= 4) & F.contains("body", quote)), "hallucinated")
        .when(F.col("there"), "duplicate")
    )
    return rows.select(*proposed.columns, reason.alias("reason")).withColumn("confidence", F.when(F.col("reason").isNull(), 0.7))


def drop_counts(judged: DataFrame) -> DataFrame:
    """How many proposed facts were kept and dropped for each reason."""
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def evidence_context(facts: DataFrame, pages: DataFrame, window: int = 280) -> DataFrame:
    """(fact_id, context) of facts (fact_id, page_id, source_quote): the quote within `window` characters on either side.

    Fact blocks are out of the text. The quote is sought as it is, then without brackets; then both again in the text
    with white space collapsed. A quote that isn't there is its own context, a blank one has none.
    """
    visible = pages.select("page_id", F.regexp_replace("content", r"(?is)<!--\s*facts\b.*?-->", "").alias("body")).withColumn("flat", F.regexp_replace("body", r"\s+", " "))
    q = F.trim("source_quote")
    variants = F.filter(F.array_distinct(F.transform(F.array(q, F.regexp_replace(q, "（[^）]*）", ""), F.regexp_replace(q, r"\([^)]*\)", "")), _collapsed)), lambda v: v != "")
    rows = facts.join(visible, "page_id", "left").withColumn("variants", variants)
    found = lambda text: F.get(F.filter(F.transform("variants", lambda v: F.struct(F.position(v, F.col(text)).alias("at"), F.length(v).alias("n"))), lambda x: x["at"] > 0), F.lit(0))
    rows = rows.withColumn("direct", found("body")).withColumn("loose", found("flat"))
    use = F.when(F.col("direct").isNotNull(), F.struct(F.col("body").alias("text"), "direct.at", "direct.n")).when(F.col("loose").isNotNull(), F.struct(F.col("flat").alias("text"), "loose.at", "loose.n"))
    rows = rows.withColumn("u", use).withColumn("start", F.greatest(F.col("u.at") - 1 - window, F.lit(0))).withColumn("end", F.least(F.length("u.text"), F.col("u.at") - 1 + F.col("u.n") + window))
    around = _collapsed(F.substring(F.col("u.text"), F.col("start") + 1, F.col("end") - F.col("start")))
    marked = F.concat(F.when(F.col("start") > 0, "...").otherwise(""), around, F.when(F.col("end") < F.length("u.text"), "...").otherwise(""))
    return rows.select("fact_id", F.when(F.coalesce(q, F.lit("")) == "", None).otherwise(F.coalesce(marked, q)).alias("context"))


def harvest_references(pages: DataFrame, radius: int = 50) -> DataFrame:
    """References of pages (page_id, content, frontmatter as JSON text, timeline), one row each.

    (page_id, slug, alias, link_type, source, origin_field, context): wikilinks, Markdown links, primary entities of
    the front matter, entities of the fact block and of the timeline. The context is the text around a link.
    """
    wiki = rf"\[\[(?:{DIRECTORIES})/[^\]|#]+?(?:#[^\]|]*?)?(?:\|[^\]]+?)?\]\]"
    markdown = rf"\[[^\]]+\]\((?:\.\./)*(?:{DIRECTORIES})/[^)\s]+?(?:\.md)?\)"
    # the text between the links tells where each begins
    def located(pattern: str) -> DataFrame:
        rows = pages.select("page_id", "content", F.regexp_extract_all("content", F.lit(pattern), 0).alias("m"), F.split("content", pattern, -1).alias("gap"))
        rows = rows.select("page_id", "content", "m", F.transform("gap", lambda g: F.length(g)).alias("gap"), F.posexplode("m").alias("i", "raw"))
        before = F.aggregate(F.slice("gap", 1, F.col("i") + 1), F.lit(0), lambda s, x: s + x) + F.aggregate(F.slice(F.transform("m", lambda x: F.length(x)), F.lit(1), F.col("i")), F.lit(0), lambda s, x: s + x)
        rows = rows.select("page_id", "content", "raw", before.alias("start"))
        lo = F.greatest(F.col("start") - radius, F.lit(0))
        hi = F.least(F.length("content"), F.col("start") + F.length("raw") + radius)
        return rows.select("page_id", "raw", F.substring(_collapsed(F.substring(F.col("content"), lo + 1, hi - lo)), 1, 200).alias("context"))

    kind = r"^([a-z_]+)\s*:\s*"
    label = F.regexp_extract("raw", r"\|([^\]]+?)\]\]$", 1)
    name = F.trim(F.regexp_extract("raw", rf"^\[\[(?:{DIRECTORIES})/([^\]|#]+?)(?:#[^\]|]*?)?(?:\|[^\]]+?)?\]\]$", 1))
    directory = F.regexp_extract("raw", rf"^\[\[({DIRECTORIES})/", 1)
    typed = F.regexp_extract(label, kind, 1)
    out = located(wiki).select(
        "page_id", F.concat(directory, F.lit("/"), F.coalesce(F.try_url_decode(F.regexp_replace(name, r"\+", "%2B")), name)).alias("slug"), F.nullif(F.trim(F.regexp_replace(label, kind, "")), F.lit("")).alias("alias"),
        F.when(typed == "", "mention").otherwise(typed).alias("link_type"), F.lit("markdown").alias("source"), F.lit(None).cast("string").alias("origin_field"), "context",
    )
    target = F.regexp_replace(F.regexp_replace(F.regexp_extract("raw", r"\]\(([^)]*)\)$", 1), r"^(\.\./)+", ""), r"\.md$", "")
    out = out.unionByName(located(markdown).select("page_id", target.alias("slug"), F.trim(F.regexp_extract("raw", r"^\[([^\]]+)\]", 1)).alias("alias"), F.lit("mention").alias("link_type"), F.lit("markdown").alias("source"), F.lit(None).cast("string").alias("origin_field"), "context"))

    def others(found: Column, source: str, origin: str) -> DataFrame:
        rows = pages.select("page_id", F.explode(found).alias("slug")).select("page_id", F.trim("slug").alias("slug")).where("slug <> ''")
        return rows.select("page_id", "slug", F.lit(None).cast("string").alias("alias"), F.lit("mention").alias("link_type"), F.lit(source).alias("source"), F.lit(origin).alias("origin_field"), F.lit(None).cast("string").alias("context"))

    primary = F.filter(F.from_json(F.get_json_object("frontmatter", "$.primary_entities"), "array<string>"), lambda s: s.contains("/"))
    out = out.unionByName(others(primary, "frontmatter", "primary_entities"))
    entity = lambda text: F.transform(yaml.records(text, ("entity",)), lambda x: x["entity"])
    out = out.unionByName(others(entity(fact_block(F.col("content"))), "extracted", "facts_block"))
    return out.unionByName(others(entity(F.col("timeline")), "extracted", "timeline_block"))


def occurrence_weight() -> Column:
    """The weight of a reference: of a block 1.2, primary, typed or manual 1, extracted 0.7, front matter 0.6, else 0.3."""
    return (
        F.when(F.col("origin_field").isin("facts_block", "timeline_block"), 1.2)
        .when((F.col("source") == "frontmatter") & (F.col("origin_field") == "primary_entities"), 1.0)
        .when((F.col("link_type") != "mention") | (F.col("source") == "manual"), 1.0)
        .when(F.col("source") == "extracted", 0.7)
        .when(F.col("source") == "frontmatter", 0.6)
        .otherwise(0.3)
    )


#: Types of links; any other becomes a mention.
LINK_TYPES = ("mention", "confirms", "contradicts", "supersedes", "cites", "critiques", "derives_from", "tracks")


def build_typed_links(references: DataFrame, resolved: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Links of references by (from, to, type, source, origin_field) with the strongest weight; no self-links, none that exists.

    resolved: (slug, page_id) as of resolve_refs. The context is that of the first reference by text.
    """
    keys = ["from_page_id", "to_page_id", "link_type", "source", "origin_field"]
    rows = references.join(resolved.where("page_id IS NOT NULL").select("slug", F.col("page_id").alias("to_page_id")), "slug").where("page_id <> to_page_id").withColumnRenamed("page_id", "from_page_id")
    rows = rows.withColumn("weight", occurrence_weight()).withColumn("link_type", F.when(F.col("link_type").isin(*LINK_TYPES), F.col("link_type")).otherwise("mention"))
    links = rows.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.max("weight").alias("weight"), F.min("context").alias("context"))
    if existing is None:
        return links
    a, b = links.alias("a"), existing.alias("b")
    return a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left_anti")


def unresolved_references(references: DataFrame, resolved: DataFrame, titles: DataFrame, min_sim: float = 0.3, limit: int = 5) -> DataFrame:
    """(slug, mentions, pages, suggestions): references that no page answers, with the most similar titles (id, title)."""
    from lorebase.operators.search import fuzzy_suggest

    open_ = resolved.where("page_id IS NULL").select("slug")
    rows = references.join(open_, "slug", "left_semi").groupBy("slug").agg(F.count("*").alias("mentions"), F.countDistinct("page_id").alias("pages"))
    hints = rows.select(F.col("slug").alias("hint_id"), F.regexp_replace(F.element_at(F.split("slug", "/"), -1), "[-_]+", " ").alias("text"))
    near = fuzzy_suggest(hints, titles, min_sim, limit).groupBy(F.col("hint_id").alias("slug")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "similarity"))).alias("suggestions"))
    return rows.join(near, "slug", "left").select("slug", "mentions", "pages", F.coalesce(F.transform("suggestions", lambda s: s["id"]), F.array().cast("array<bigint>")).alias("suggestions"))


#: Sections of entity pages, in order.
REQUIRED_SECTIONS = {
    "company": ("Company Overview", "Business Model", "Financial Summary", "Competitive Landscape", "Valuation", "Risk Factors", "Catalysts", "Key Timeline", "Sources"),
    "industry": ("Industry Overview", "Market Size And Growth", "Value Chain", "Competitive Landscape", "Key Trends", "Regulatory Environment", "Investment Opportunities And Risks", "Related Companies", "Sources"),
    "concept": ("Definition", "Use In Investment Research", "Related Concepts", "Sources"),
}
#: Fixed value: the body of a section that has none.
PLACEHOLDER = "Structural repair placeholder: no additional source-backed detail was present in the legacy narrative for this section."


def plain_heading(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(title), r"[`*_#\[\]()]", ""), "[/:&-]+", " "), r"\s+", " "))


def _titled(key: Column) -> Callable[[Column], Column]:
    return lambda section: plain_heading(section["title"]) == key


def repair_sections(pages: DataFrame) -> DataFrame:
    """(page_id, content, changed) of entity pages (page_id, type, content) in the required order of sections.

    The first section of each required name stays in its place; what stood before the first heading and all other
    sections go under `### Legacy Notes` of the first; sections without text get a placeholder; updates come last.
    Front matter stays in front. Pages of other types are unchanged.
    """
    head = F.regexp_extract("content", r"\A(---\n(?s:.*?)\n---)(?:\n|\z)", 1)
    body = F.trim(F.expr("substring(content, length(head) + 1)"))
    parts = F.split("body", r"(?m)^(?=##\s+\S)")
    rows = pages.withColumn("head", head).withColumn("body", body).withColumn("parts", parts)
    section = lambda p: F.struct(F.trim(F.regexp_extract(p, r"\A##\s+(.+?)\s*(?:\n|\z)", 1)).alias("title"), F.trim(F.regexp_replace(p, r"\A[^\n]*\n?", ""), F.lit(" \n\t\r")).alias("body"))
    sections = F.transform(F.filter("parts", lambda p: p.rlike(r"\A##\s+\S")), section)
    preamble = F.trim(F.get(F.filter("parts", lambda p: ~p.rlike(r"\A##\s+\S")), F.lit(0)), F.lit(" \n\t\r"))
    rows = rows.withColumn("s", sections).withColumn("pre", F.coalesce(preamble, F.lit("")))
    out = F.col("content")
    for kind, required in REQUIRED_SECTIONS.items():
        keys = [plain_heading(F.lit(r)) for r in required]
        own = [F.get(F.filter("s", _titled(k)), F.lit(0)) for k in keys]
        # the others: updates and the first of each required name are taken
        spare = F.filter("s", lambda x, i: (plain_heading(x["title"]) != "updates") & ~(plain_heading(x["title"]).isin(*keys) & (F.array_position(F.transform("s", lambda y: plain_heading(y["title"])), plain_heading(x["title"])) == i + 1)))
        legacy = F.filter(F.concat(F.array("pre"), F.transform(spare, lambda x: F.when(x["body"] != "", F.concat(F.lit("### "), x["title"], F.lit("\n\n"), x["body"])).otherwise(F.concat(F.lit("### "), x["title"])))), lambda t: t != "")
        notes = F.when(F.size(legacy) > 0, F.array_join(F.concat(F.array(F.lit("### Legacy Notes")), legacy), "\n\n"))
        blocks = []
        for i, (title, mine) in enumerate(zip(required, own, strict=True)):
            texts = F.array_compact(F.array(F.nullif(mine["body"], F.lit("")), *([notes] if i == 0 else [])))
            blocks.append(F.concat(F.lit(f"## {title}\n\n"), F.when(F.size(texts) > 0, F.array_join(texts, "\n\n")).otherwise(PLACEHOLDER)))
        updates = F.transform(F.filter("s", lambda x: plain_heading(x["title"]) == "updates"), lambda x: F.trim(F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["body"]), F.lit(" \n")))
        whole = F.concat(F.array_join(F.concat(F.array(*blocks), updates), "\n\n"), F.lit("\n"))
        out = F.when(F.col("type") == kind, F.concat(F.when(F.col("head") != "", F.concat("head", F.lit("\n\n"))).otherwise(""), whole)).otherwise(out)
    blank = F.lit(" \n\t\r")
    return rows.select("page_id", out.alias("repaired"), "content").select("page_id", F.col("repaired").alias("content"), (F.trim("repaired", blank) != F.trim("content", blank)).alias("changed"))


def hashing_embedder(dimension: int = 64) -> Callable[[pd.Series], list[list[float]]]:
    """A vectoriser without a model: counts of words by hash, scaled to length 1."""
    import zlib

    def embed(texts: pd.Series) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimension
            for w in (text or "").lower().split():
                v[zlib.crc32(w.encode()) % dimension] += 1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def embed_chunks(chunks: DataFrame, embed: Callable[[pd.Series], list[list[float]]], as_of: str, batch: int = 100, longest: int = 4000) -> DataFrame:
    """(id, embedding, embedded_at) of chunks (id, input) by the caller's vectoriser, which gets `batch` texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": embed(part["input"].str.slice(0, longest))})

    return chunks.select("id", "input").mapInPandas(run, "id long, embedding array<float>").withColumn("embedded_at", F.lit(as_of).cast("timestamp"))
