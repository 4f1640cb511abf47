"""Merging, retiring, demoting, enriching and refreshing entity pages, over all tables that refer to them.

Tables come and go as a dict of DataFrames by name; an operator returns the same dict with the tables it changes.
Deletions are soft. A mapping has one row a merged page: (old, new).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.entities import auto_reject_reason, merge_mapping, merge_risk, overlap, upsert_candidates
from lorebase.operators.graph import active, effective_backlinks, orphans
from lorebase.operators.ingest import append_updates
from lorebase.operators.references import demotable_pages
from lorebase.sources.shared import written

Tables = dict[str, DataFrame]

#: The columns of each table that name a page.
PAGE_COLUMNS = {
    "tags": ("page_id",), "raw_data": ("page_id",), "chunks": ("page_id",), "links": ("from_page_id", "to_page_id", "origin_page_id"), "facts": ("entity_page_id",),
    "timeline": ("entity_page_id",), "signals": ("entity_page_id",), "theses": ("target_page_id",),
}
#: What makes two rows of a merged page the same; the row that was there, then the smallest id, stays.
SAME_ROW = {
    "tags": ("page_id", "tag"), "raw_data": ("page_id", "source"), "links": ("from_page_id", "to_page_id", "link_type", "link_source", "origin_page_id"),
    "facts": ("entity_page_id", "metric", "period", "value_numeric", "value_text", "unit", "source_page_id", "valid_from", "valid_to"),
    "timeline": ("entity_page_id", "event_date", "summary"),
}


def without_updates(content: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(content), r"(?s)\n## Updates.*", ""))


def comparable(content: Column) -> Column:
    """Lower-case text with links by their labels, without comments, white space collapsed."""
    for pattern, to in ((r"\[\[([^\[\]|]+)\|([^\[\]]+)\]\]", "$2"), (r"\[\[([^\[\]]+)\]\]", "$1"), (r"(?s)<!--.*?-->", " "), (r"\s+", " ")):
        content = F.regexp_replace(content, pattern, to)
    return F.lower(F.trim(content))


def first_spellings(values: Column) -> Column:
    """Trimmed values without blanks, the first of those that differ in case only."""
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    low = F.transform(kept, lambda v: F.lower(v))
    return F.transform(F.filter(F.arrays_zip(kept.alias("v"), low.alias("k"), F.transform(low, lambda k: F.array_position(low, k)).alias("first"), F.sequence(F.lit(1), F.greatest(F.size(kept), F.lit(1))).alias("i")), lambda x: x["first"] == x["i"]), lambda x: x["v"])


def page_features(pages: DataFrame, links: DataFrame) -> DataFrame:
    """What merging looks at: names, words, sizes and backlinks of each active page."""
    body = without_updates(F.coalesce("content", F.lit("")))
    keys = F.array_distinct(F.filter(F.transform(F.concat(F.array("title", F.regexp_replace("slug", "^[^/]*/", "")), F.split("alias_csv", ",")), lambda v: F.lower(F.trim(v))), lambda v: v != ""))
    words = F.array_distinct(F.filter(F.split(comparable(body), r"[^a-z0-9\x{4e00}-\x{9fff}]+"), lambda w: F.length(w) >= 3))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.lower("title"), r"[\s._-]+", ""), "holdings?|group|inc|corp|corporation|company|co|ltd|limited", ""))
    confidence = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    rows = active(pages).join(effective_backlinks(links).withColumnRenamed("page_id", "id"), "id", "left").fillna(0, ["backlinks"])
    return rows.select(
        "id", "type", "source_id", keys.alias("keys"), words.alias("words"), name.alias("name"), F.length(comparable(body)).alias("chars"), F.regexp_count("content", F.lit(r"(?m)^###\s+\d{4}-\d{2}-\d{2}")).alias("update_blocks"),
        F.regexp_count(body, F.lit(r"(?m)^##\s+")).alias("sections"), "backlinks", F.coalesce("completeness_score", F.lit(0.0)).alias("completeness"),
        (100 * confidence + 10 * F.col("backlinks") + 10 * F.coalesce("completeness_score", F.lit(0.0)) + F.size(F.filter(F.split("alias_csv", ","), lambda a: a != ""))).alias("rank"),
    )


def merge_candidates(pages: DataFrame, links: DataFrame, similar: DataFrame, human_review: bool = False) -> DataFrame:
    """(canonical, duplicate, similarity, shared_keys, alias_overlap, text_overlap, mode, priority) of pages that may be one.

    Pairs come from similar titles (a, b, similarity) and from shared names: of the pages with a name each is paired
    with the smallest id, so m pages give m - 1 pairs. Without a shared name a pair needs alike aliases or names.
    """
    f = written(page_features(pages, links), "features")
    shared = f.select("type", "source_id", "id", F.explode("keys").alias("key"))
    low = shared.groupBy("type", "source_id", "key").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1")
    named = shared.join(low, ["type", "source_id", "key"]).where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("shared_keys"))
    pairs = similar.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").join(named, ["a", "b"], "full").fillna(0, ["similarity", "shared_keys"])
    left, right = (f.select(*[F.col(c).alias(f"{side}_{c}") for c in f.columns]) for side in "xy")
    rows = pairs.join(left, F.col("a") == F.col("x_id")).join(right, F.col("b") == F.col("y_id")).where("x_type = y_type AND x_source_id = y_source_id")
    rows = rows.withColumn("alias_overlap", overlap(F.col("x_keys"), F.col("y_keys"), smaller=False)).withColumn("text_overlap", overlap(F.col("x_words"), F.col("y_words"), smaller=True))
    rows = rows.where("shared_keys > 0 OR alias_overlap >= 0.3 OR x_name = y_name")
    second = F.col("y_rank") > F.col("x_rank")
    of = lambda c, canonical: F.when(second == canonical, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}"))
    rows = rows.select(
        of("id", True).alias("canonical"), of("id", False).alias("duplicate"), "similarity", "shared_keys", "alias_overlap", "text_overlap", of("chars", True).alias("canonical_chars"), of("chars", False).alias("dup_chars"),
        of("sections", False).alias("sections"), (of("update_blocks", False) > 0).alias("has_updates"), (F.col("x_backlinks") + F.col("y_backlinks")).alias("backlinks"), F.greatest(of("completeness", True) - of("completeness", False), F.lit(0.0)).alias("gap"),
    )
    rows = rows.withColumn("ratio", F.col("dup_chars") / F.greatest("canonical_chars", F.lit(1)))
    risk = merge_risk(rows.select(F.col("canonical").alias("a"), F.col("duplicate").alias("b"), "dup_chars", "ratio", "sections", "has_updates", F.col("text_overlap").alias("overlap")))
    rows = rows.join(risk.withColumnsRenamed({"a": "canonical", "b": "duplicate"}), ["canonical", "duplicate"])
    evidence = F.greatest("similarity", F.when(F.col("shared_keys") > 0, F.col("alias_overlap")).otherwise(0.0))
    penalty = F.when(F.col("mode") == "auto_merge", 0).when(F.col("mode") == "structure_only", 1).otherwise(3)
    rows = rows.withColumn("priority", F.round(evidence * 5 + F.least("backlinks", F.lit(20)) / 4 + F.col("gap") - penalty, 2))
    rows = rows if human_review else rows.where("mode <> 'human_review'")
    return rows.select("canonical", "duplicate", F.round("similarity", 6).alias("similarity"), "shared_keys", F.round("alias_overlap", 6).alias("alias_overlap"), F.round("text_overlap", 6).alias("text_overlap"), "canonical_chars", "dup_chars", "mode", "priority")


def _renamed(df: DataFrame, columns: tuple[str, ...], mapping: DataFrame) -> DataFrame:
    """df with merged pages by their new ids; `__moved` tells the rows that changed."""
    df = df.withColumn("__moved", F.lit(False))
    for c in [c for c in columns if c in df.columns]:
        df = df.join(mapping.select(F.col("old").alias(c), F.col("new").alias("__new")), c, "left").withColumn("__moved", F.col("__moved") | F.col("__new").isNotNull()).withColumn(c, F.coalesce("__new", c)).drop("__new")
    return df


def apply_merges(tables: Tables, mapping: DataFrame, reason: str, as_of: str) -> Tables:
    """All tables after the merge of each old page into its new one.

    Rows of the old page move; a moved row that is there already, and a link from a page to itself, are deleted. The
    canonical page gets the names of its duplicates, a display name if it has none, and those parts of their texts
    that it lacks, under `## Updates` or in place of a body under 200 characters; the duplicates are deleted and archived.
    `events` gets a row for each side; `merges` tells what went where.
    """
    m = written(merge_mapping(mapping), "mapping")
    out = dict(tables)
    for name, columns in PAGE_COLUMNS.items():
        if name not in tables:
            continue
        whole = tables[name].columns
        df = _renamed(tables[name], columns, m)
        if name == "links":
            df = df.withColumn("deleted", F.when(F.col("__moved") & (F.col("from_page_id") == F.col("to_page_id")), 1).otherwise(F.col("deleted")))
        if name in SAME_ROW:
            keys = [c for c in SAME_ROW[name] if c in whole]
            first = F.row_number().over(Window.partitionBy(*keys, "deleted").orderBy("__moved", "id"))
            df = df.withColumn("__k", first).withColumn("deleted", F.when((F.col("deleted") == 0) & F.col("__moved") & (F.col("__k") > 1), 1).otherwise(F.col("deleted")))
        if name == "chunks":  # a merged page's chunks go; its text is chunked anew
            df = df.withColumn("page_id", F.col("page_id")).withColumn("deleted", F.when(F.col("__moved"), 1).otherwise(F.col("deleted")))
        out[name] = df.select(*whole)
    pages = tables["pages"]
    old = pages.join(m.withColumnRenamed("old", "id"), "id").where("deleted = 0")
    canonical_text = pages.select(F.col("id").alias("new"), comparable(F.coalesce("content", F.lit(""))).alias("known"))
    body = without_updates(F.coalesce("content", F.lit("")))
    # the text whole where the canonical page lacks it
    lacking = (F.col("body") != "") & (comparable(F.col("body")) != "") & ~F.contains("known", comparable(F.col("body")))
    gained = old.withColumn("body", body).join(canonical_text, "new", "left").select(
        "new", "id", "alias_csv", "title", F.regexp_replace("slug", "^[^/]*/", "").alias("name"), "display_name",
        F.when(lacking, F.concat(F.lit("Merged context from [["), "slug", F.lit("|"), F.coalesce("display_name", "title"), F.lit("]] during entity dedupe.\n\n"), "body")).alias("delta"),
    )
    per_page = gained.groupBy(F.col("new").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "alias_csv", "title", "name", "display_name", "delta"))).alias("from"))
    rows = pages.join(per_page, "id", "left").join(m.select(F.col("old").alias("id"), F.col("new").alias("__into")), "id", "left")
    names = F.flatten(F.transform("from", lambda x: F.concat(F.split(x["alias_csv"], ","), F.array(x["title"], x["name"]))))
    joined = first_spellings(F.concat(F.split("alias_csv", ","), names, F.array(F.col("title"), F.regexp_replace("slug", "^[^/]*/", ""))))
    deltas = rows.where("from IS NOT NULL").select("id", F.array_join(F.filter(F.transform("from", lambda x: x["delta"]), lambda d: d.isNotNull()), "\n\n").alias("delta")).where("delta <> ''")
    text = append_updates(pages.select("id", F.coalesce("content", F.lit("")).alias("content")).join(deltas.select("id"), "id", "left_semi"), deltas, as_of, reason)
    rows = rows.join(text.withColumnRenamed("content", "__text"), "id", "left")
    changed = {
        "alias_csv": F.when(F.col("from").isNotNull(), F.array_join(joined, ",")).otherwise(F.col("alias_csv")),
        "display_name": F.coalesce("display_name", F.get(F.filter(F.transform("from", lambda x: x["display_name"]), lambda d: d.isNotNull()), F.lit(0))),
        "content": F.coalesce("__text", "content"),
        "deleted": F.when(F.col("__into").isNotNull(), 1).otherwise(F.col("deleted")),
    }
    out["pages"] = rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in pages.columns])
    out["merges"] = m
    sides = m.select(F.explode(F.array(F.struct(F.col("new").alias("entity_id"), F.lit("page_merge_canonical").alias("action")), F.struct(F.col("old").alias("entity_id"), F.lit("page_merge_duplicate").alias("action")))).alias("x"), F.col("new").alias("canonical"))
    out["events"] = append_events(tables.get("events"), sides.select("x.entity_id", "x.action", F.lit(reason).alias("reason"), "canonical"), as_of)
    return out


def append_events(events: DataFrame | None, rows: DataFrame, as_of: str, actor: str = "system") -> DataFrame:
    """Audit rows (ts, actor, action, entity_id, payload) of rows (action, entity_id, ...) behind the events there are; other columns become the payload."""
    payload = F.to_json(F.struct(*[c for c in rows.columns if c not in ("action", "entity_id")]))
    new = rows.select(F.lit(as_of).cast("timestamp").alias("ts"), F.lit(actor).alias("actor"), "action", F.col("entity_id").cast("long").alias("entity_id"), payload.alias("payload"))
    return new if events is None else events.unionByName(new, allowMissingColumns=True)


def retire_pages(tables: Tables, ids: DataFrame, reason: str, as_of: str) -> Tables:
    """Pages (id) with their tags, side data and chunks deleted, and an event for each."""
    gone = ids.select("id").distinct()
    out = dict(tables)
    for name, key in (("pages", "id"), ("tags", "page_id"), ("raw_data", "page_id"), ("chunks", "page_id")):
        if name in tables:
            whole = tables[name].columns
            hit = gone.select(F.col("id").alias(key), F.lit(True).alias("__gone"))
            out[name] = tables[name].join(hit, key, "left").withColumn("deleted", F.when(F.col("__gone"), 1).otherwise(F.col("deleted"))).select(*whole)
    rows = tables["pages"].where("deleted = 0").join(gone, "id", "left_semi").select(F.col("id").alias("entity_id"), F.lit("page_retire").alias("action"), "slug", F.lit(reason).alias("reason"))
    out["events"] = append_events(tables.get("events"), rows, as_of)
    return out


def demote_to_candidates(tables: Tables, as_of: str, strong: float = 0.9, max_chars: int = 1300) -> Tables:
    """Pages that only weak mentions know become candidates: their links in and out and their rows are deleted.

    `candidates` holds (slug, evidence_count, aliases, status) of them, rejected where the name stands for no entity.
    """
    page = demotable_pages(tables, strong, max_chars)
    page = written(page.join(tables["pages"].select("id", "alias_csv"), "id"), "demoted")
    mentions = active(tables["links"]).join(page.select(F.col("id").alias("to_page_id"), "slug", "alias_csv"), "to_page_id").select("slug", F.col("from_page_id").alias("source_page_id"), F.explode(F.split("alias_csv", ",")).alias("alias"))
    out = retire_pages(tables, page, "legacy-low-confidence-weak-mention-only", as_of)
    links = tables["links"]
    for c in ("from_page_id", "to_page_id"):
        links = links.join(page.select(F.col("id").alias(c), F.lit(True).alias(f"__{c}")), c, "left")
    out["links"] = links.withColumn("deleted", F.when(F.col("__from_page_id") | F.col("__to_page_id"), 1).otherwise(F.col("deleted"))).select(*tables["links"].columns)
    out["candidates"] = upsert_candidates(mentions)
    return out


def independent_pairs(candidates: DataFrame) -> DataFrame:
    """Of candidates (canonical, duplicate, priority) those that are the best of both their pages: no page is in two."""
    best = F.struct("priority", (-F.col("duplicate")).alias("d"), (-F.col("canonical")).alias("c"))
    sides = candidates.select(F.explode(F.array("canonical", "duplicate")).alias("page"), best.alias("x"))
    top = sides.groupBy("page").agg(F.max("x").alias("x"))
    own = candidates.withColumn("x", best)
    for c in ("canonical", "duplicate"):
        own = own.join(top.select(F.col("page").alias(c), F.col("x").alias("top")), c).where("x = top").drop("top")
    return own.drop("x")


def merge_eligible(candidates: DataFrame) -> DataFrame:
    """Candidates that need no reader: low risk; medium with strong, high with very strong evidence of identity."""
    alias = F.col("shared_keys") > 0
    strong = (F.col("text_overlap") >= 0.6) | (alias & (F.col("alias_overlap") >= 0.3)) | (F.col("similarity") >= 0.9)
    very = ((F.col("similarity") >= 0.98) & (F.col("shared_keys") >= 2)) | ((F.col("similarity") >= 0.92) & alias & (F.col("alias_overlap") >= 0.7))
    mode = F.col("mode")
    return candidates.where((mode == "auto_merge") | ((mode == "structure_only") & strong) | ((mode == "human_review") & very))


def auto_cleanup(tables: Tables, similar, as_of: str, passes: int = 5, min_age_days: int = 3) -> tuple[Tables, DataFrame]:
    """Merge eligible pairs in passes until none is left, then retire old stubs that nothing refers to.

    similar(pages) gives (a, b, similarity). Returns the tables and (kind, page_id, into) of what was done. A pass
    merges the pairs that are best for both pages; each pass is written, so the next one starts from a table.
    """
    spark = tables["pages"].sparkSession
    done = spark.createDataFrame([], "kind string, page_id long, into long")
    for _ in range(passes):
        pairs = written(independent_pairs(merge_eligible(merge_candidates(tables["pages"], tables["links"], similar(tables["pages"]), human_review=True))), "pairs")
        if pairs.isEmpty():
            break
        after = apply_merges(tables, pairs.select(F.col("duplicate").alias("old"), F.col("canonical").alias("new")), "auto-cleanup", as_of)
        done = written(done.unionByName(pairs.select(F.lit("merge").alias("kind"), F.col("duplicate").alias("page_id"), F.col("canonical").alias("into"))), "done")
        tables = {name: written(df, name) for name, df in after.items() if name != "merges"}
    age = F.datediff(F.lit(as_of).cast("date"), F.col("create_date"))
    old = orphans(tables["pages"], tables["links"], as_of).select("id").join(tables["pages"].where((F.col("entity_state") == "stub") & (age >= min_age_days)), "id", "left_semi")
    used = reduce(DataFrame.unionByName, [(active(tables[t]) if "deleted" in tables[t].columns else tables[t]).select(F.col(c).alias("id")) for t, c in (("links", "from_page_id"), ("facts", "entity_page_id"), ("facts", "source_page_id"), ("timeline", "entity_page_id"), ("signals", "entity_page_id"), ("theses", "target_page_id"))])
    old = written(old.join(used, "id", "left_anti"), "retired")
    done = done.unionByName(old.select(F.lit("retire").alias("kind"), F.col("id").alias("page_id"), F.lit(None).cast("long").alias("into")))
    return retire_pages(tables, old, "orphan entity stub", as_of), done


def apply_enrichment(pages: DataFrame, updates: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Pages after updates (id, content, aliases_add, aliases_remove, aliases_replace, confidence, display_name, ticker, sector, exchange).

    Nulls change nothing; aliases_replace takes the place of the other two. The state becomes compiled. Without a
    given confidence, none or low becomes medium, unless the page's review (id, status) fails.
    """
    u = updates.select("id", *[F.col(c).alias(f"u_{c}") for c in updates.columns if c != "id"]).withColumn("__hit", F.lit(True))
    rows = pages.join(u, "id", "left")
    rows = rows.join(reviews.select("id", F.col("status").alias("__review")), "id", "left") if reviews is not None else rows.withColumn("__review", F.lit(None).cast("string"))
    have = F.filter(F.split("alias_csv", ","), lambda a: a != "")
    gone = F.transform(F.coalesce("u_aliases_remove", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))
    kept = F.filter(have, lambda a: ~F.array_contains(gone, F.lower(F.trim(a))))
    merged = F.concat(kept, F.coalesce("u_aliases_add", F.array().cast("array<string>")))
    aliases = F.when(F.col("u_aliases_replace").isNotNull(), F.array_join(first_spellings(F.col("u_aliases_replace")), ",")).when(F.col("u_aliases_add").isNotNull() | F.col("u_aliases_remove").isNotNull(), F.array_join(first_spellings(merged), ","))
    low = F.col("confidence").isNull() | (F.col("confidence") == "low")
    failed = F.coalesce(F.col("__review") == "fail", F.lit(False))
    confidence = F.coalesce("u_confidence", F.when(low & F.col("__hit"), F.when(failed, F.coalesce("confidence", F.lit("low"))).otherwise("medium")), "confidence")
    changed = {"alias_csv": F.coalesce(aliases, "alias_csv"), "confidence": confidence, "entity_state": F.when(F.col("__hit"), "compiled").otherwise(F.col("entity_state"))}
    changed |= {c: F.coalesce(f"u_{c}", c) for c in ("content", "ticker", "sector", "exchange") if f"u_{c}" in rows.columns}
    if "u_display_name" in rows.columns:
        changed["display_name"] = F.coalesce(F.nullif(F.trim(F.regexp_replace("u_display_name", r"\s+", " ")), F.lit("")), F.col("display_name"))
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in pages.columns])


def enrich_pages(pages: DataFrame, updates: DataFrame, as_of: str, frontmatter: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, reviews) after updates as of apply_enrichment, scored and reviewed anew.

    The enriched pages get the completeness score of what they are now, and a review (page_id, status, errors, warnings,
    content_hash) of their new text, with the front matter (id, frontmatter, timeline) where there is any. Where it
    fails, confidence that was raised without being asked for goes back.
    """
    from lorebase.operators.entities import completeness
    from lorebase.operators.reviews import review_pages

    hit = updates.select("id").distinct()
    first = apply_enrichment(pages, updates).join(hit, "id", "left_semi")
    extra = frontmatter if frontmatter is not None else hit.select("id", F.lit(None).cast("string").alias("frontmatter"), F.lit(None).cast("string").alias("timeline"))
    reviews = written(review_pages(first.join(extra, "id", "left").select(F.col("id").alias("page_id"), "type", "content", "frontmatter", "timeline")), "reviews")
    out = apply_enrichment(pages, updates, reviews.select(F.col("page_id").alias("id"), "status"))
    scores = completeness(out.join(hit, "id", "left_semi"), as_of).select("id", F.col("score").alias("__score"))
    return out.join(scores, "id", "left").withColumn("completeness_score", F.coalesce("__score", "completeness_score")).select(*pages.columns), reviews


def refresh_evidence(pages: DataFrame, links: DataFrame, facts: DataFrame, timeline: DataFrame, signals: DataFrame, sources: int = 5, others: int = 10) -> DataFrame:
    """(page_id, kind, rn, id) of what is newer than an entity page: up to 5 sources, 10 facts, events and signals each.

    A source counts if it links with a type, or carries a fact, event or signal of the page.
    """
    e = active(pages).where(F.col("type").isin("company", "industry", "concept")).select(F.col("id").alias("page_id"), F.col("update_date").alias("since"))

    def newer(rows: DataFrame, kind: str, n: int) -> DataFrame:
        met = rows.join(e, "page_id").where("at > since")
        rn = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("at"), F.desc("id")))
        return met.withColumn("rn", rn).where(F.col("rn") <= n).select("page_id", F.lit(kind).alias("kind"), "rn", "id")

    carried = reduce(DataFrame.unionByName, [active(t).where("source_page_id IS NOT NULL").select(F.col("entity_page_id").alias("page_id"), F.col("source_page_id").alias("id")) for t in (facts, timeline, signals)])
    linked = active(links).select(F.col("to_page_id").alias("page_id"), F.col("from_page_id").alias("id"), "link_type")
    good = linked.where("link_type <> 'mention'").select("page_id", "id").unionByName(linked.select("page_id", "id").join(carried.distinct(), ["page_id", "id"], "left_semi")).distinct()
    src = active(pages).where(F.col("type").isin("source", "brief")).select("id", F.col("create_date").alias("at"))
    of = lambda t, at: active(t).select(F.col("entity_page_id").alias("page_id"), F.col(at).cast("date").alias("at"), "id")
    return newer(good.join(src, "id").select("page_id", "at", "id"), "source", sources).unionByName(newer(of(facts, "valid_from"), "fact", others)).unionByName(newer(of(timeline, "event_date"), "timeline", others)).unionByName(newer(of(signals, "detected_at"), "signal", others))


def refresh_blocks(pages: DataFrame, evidence: DataFrame, facts: DataFrame, timeline: DataFrame, signals: DataFrame) -> DataFrame:
    """(page_id, block): the Markdown that tells an entity page's new evidence, section by section."""
    p = pages.select("id", "slug", "title", "type", "create_date")
    link = F.concat(F.lit("[["), "slug", F.lit("|"), "title", F.lit("]]"))
    via = p.select(F.col("id").alias("source_page_id"), link.alias("via"))
    ev = lambda kind: evidence.where(F.col("kind") == kind)
    lines = ev("source").join(p, "id").select("page_id", F.lit(0).alias("part"), "rn", F.concat(F.lit("- "), link, F.lit(" ("), "type", F.lit(", "), F.col("create_date").cast("string"), F.lit(")")).alias("line"))
    fact = ev("fact").join(facts.select("id", "metric", "period", "value_numeric", "source_page_id"), "id").join(via, "source_page_id", "left")
    period = F.coalesce(F.concat(F.lit(" ("), "period", F.lit(")")), F.lit(""))
    lines = lines.unionByName(fact.select("page_id", F.lit(1).alias("part"), "rn", F.concat(F.lit("- "), "metric", period, F.lit(": "), F.coalesce(F.col("value_numeric").cast("string"), F.lit("(text)")), F.coalesce(F.concat(F.lit(" via "), "via"), F.lit(""))).alias("line")))
    event = ev("timeline").join(timeline.select("id", "event_date", "event_type", "summary", "source_page_id"), "id").join(via, "source_page_id", "left")
    lines = lines.unionByName(event.select("page_id", F.lit(2).alias("part"), "rn", F.concat(F.lit("- "), F.col("event_date").cast("string"), F.lit(" ["), "event_type", F.lit("] "), "summary", F.coalesce(F.concat(F.lit(" ("), "via", F.lit(")")), F.lit(""))).alias("line")))
    signal = ev("signal").join(signals.select("id", "signal_type", "severity", "detected_at"), "id")
    lines = lines.unionByName(signal.select("page_id", F.lit(3).alias("part"), "rn", F.concat(F.lit("- "), F.date_format("detected_at", "yyyy-MM-dd"), F.lit(" ["), "severity", F.lit("] "), "signal_type").alias("line")))
    heads = F.array(*map(F.lit, ("New Sources", "New Facts", "New Timeline Signals", "New System Signals")))
    whys = F.array(*map(F.lit, ("New high-value source coverage", "New structured facts", "New timeline events", "New signals")))
    parts = lines.groupBy("page_id", "part").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "\n").alias("body"))
    parts = parts.select("page_id", "part", F.concat(F.lit("- "), F.get(whys, F.col("part")), F.lit(": "), "n").alias("why"), F.concat(F.lit("#### "), F.get(heads, F.col("part")), F.lit("\n"), "body").alias("text"))
    all_parts = parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("part", "why", "text"))).alias("x"))
    top = F.concat(F.lit("Entity refresh for "), link, F.lit(".\n\n#### Why this refresh\n"), F.array_join(F.transform("x", lambda y: y["why"]), "\n"))
    end = F.concat(F.lit("#### Recommended page follow-up\n- Revisit the core sections of "), link, F.lit(" if the new evidence materially changes the current assessment."))
    return all_parts.join(p.withColumnRenamed("id", "page_id"), "page_id").select("page_id", F.array_join(F.concat(F.array(top), F.transform("x", lambda y: y["text"]), F.array(end)), "\n\n").alias("block"))


def refresh_queue(stale: DataFrame, pages: DataFrame, in_flight: DataFrame, min_chars: int = 200) -> DataFrame:
    """(page_id, queued, reason, job_priority) of refresh candidates (page_id, priority); in_flight: (page_id, name)."""
    busy = in_flight.groupBy("page_id").agg(F.max(F.when(F.col("name") == "entity-refresh", True)).alias("refreshing"), F.max(F.when(F.col("name") == "enrich_entity", True)).alias("enriching"))
    rows = stale.join(active(pages).select(F.col("id").alias("page_id"), "type", "entity_state", "content", "display_name"), "page_id", "left").join(busy, "page_id", "left")
    reason = (
        F.when(F.col("refreshing"), "already-in-flight").when(F.col("type").isNull(), "page-not-found").when(F.col("enriching"), "enrich-in-flight")
        .when(F.col("entity_state").isin("stub", "candidate_promoted"), F.concat(F.lit("needs-enrich-entity-state-"), "entity_state"))
        .when(F.length(F.trim(F.coalesce("content", F.lit("")))) < min_chars, "needs-enrich-short-content")
        .when(F.col("type").isin("company", "industry", "concept") & (F.coalesce("display_name", F.lit("")) == ""), "needs-enrich-display-name").otherwise("queued")
    )
    return rows.withColumn("reason", reason).select("page_id", (F.col("reason") == "queued").alias("queued"), "reason", F.when(F.col("reason") == "queued", F.greatest(F.lit(40), F.least(F.lit(95), F.col("priority") + 40))).alias("job_priority"))


def promoted_candidates(candidates: DataFrame, decisions: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What decisions (slug, decision) do to the graph: new pages (slug, title, type) of promoted candidates that no page has, and
    links (slug, source_page_id, weight, link_source) from each of their sources. candidates: (slug, status, source_page_ids)."""
    chosen = candidates.join(decisions.where("decision = 'promote'"), "slug").where("status = 'pending'")
    chosen = chosen.where(auto_reject_reason(F.col("slug")).isNull())
    new = chosen.join(active(pages).select("slug"), "slug", "left_anti").select("slug", F.regexp_replace("slug", "^[^/]*/", "").alias("title"), F.when(F.col("slug").startswith("companies/"), "company").when(F.col("slug").startswith("industries/"), "industry").otherwise("concept").alias("type"))
    links = chosen.select("slug", F.explode("source_page_ids").alias("source_page_id")).distinct().select("slug", "source_page_id", F.lit(0.7).alias("weight"), F.lit("entity_candidate").alias("link_source"))
    return new, links

