"""Link-graph operators over links(from_page_id, to_page_id, link_type, link_source, origin_field, weight, deleted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where("deleted = 0")


def is_effective() -> Column:
    """Whether a link carries evidence. Unknown for a plain mention without an origin, which `NOT` leaves unknown as well."""
    return (
        (F.col("weight") >= 0.9)
        | (F.col("link_type") != "mention")
        | ((F.col("link_source") == "frontmatter") & (F.col("origin_field") == "primary_entities"))
        | F.col("origin_field").isin("facts_block", "timeline_block")
    )


def default_weight() -> Column:
    """The weight that a link's provenance gives it."""
    source, origin = F.col("link_source"), F.col("origin_field")
    return (
        F.when(origin.isin("facts_block", "timeline_block"), 1.2)
        .when((source == "frontmatter") & (origin == "primary_entities"), 1.0)
        .when(F.col("link_type") != "mention", 1.0)
        .when(source == "manual", 1.0)
        .when(source == "extracted", 0.7)
        .when(source == "entity_candidate", 0.7)
        .when(source == "frontmatter", 0.6)
        .when(source == "markdown", 0.3)
        .otherwise(0.5)
    )


def _counts(links: DataFrame, side: str, prefix: str) -> DataFrame:
    e = is_effective()
    return active(links).groupBy(F.col(side).alias("page_id")).agg(F.count("*").alias(f"{prefix}_total"), F.count_if(e).alias(f"{prefix}_effective"), F.count_if(~e).alias(f"{prefix}_weak"))


def link_counts(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links in and out of each active page: all, effective, weak."""
    out = active(pages).select(F.col("id").alias("page_id")).join(_counts(links, "to_page_id", "inbound"), "page_id", "left").join(_counts(links, "from_page_id", "outbound"), "page_id", "left")
    return out.fillna(0)


def effective_backlinks(links: DataFrame) -> DataFrame:
    return active(links).groupBy(F.col("to_page_id").alias("page_id")).agg(F.count_if(is_effective()).alias("backlinks"))


def link_type_distribution(links: DataFrame) -> DataFrame:
    e = is_effective()
    both = active(links).select(F.explode(F.array(F.struct(F.col("to_page_id").alias("page_id"), F.lit("in").alias("direction")), F.struct(F.col("from_page_id").alias("page_id"), F.lit("out").alias("direction")))).alias("x"), "*")
    return both.groupBy("x.page_id", "x.direction", "link_type").agg(F.count("*").alias("n"), F.count_if(e).alias("effective"), F.count_if(~e).alias("weak"), F.round(F.sum("weight"), 6).alias("weight_sum"))


def consensus_strength(links: DataFrame) -> DataFrame:
    """(confirms - contradicts) / (confirms + contradicts) by page; null where there are neither."""
    yes, no = F.count_if(F.col("link_type") == "confirms"), F.count_if(F.col("link_type") == "contradicts")
    return active(links).groupBy(F.col("to_page_id").alias("page_id")).agg(yes.alias("confirms"), no.alias("contradicts"), F.round(F.try_divide(yes - no, yes + no), 6).alias("strength"))


def recent_inbound(links: DataFrame, pages: DataFrame, n: int = 10) -> DataFrame:
    """The n strongest and newest links into each page: effective first, then weight, then the source page's date, then id."""
    source = active(pages).select(F.col("id").alias("from_page_id"), F.col("slug").alias("source_slug"), F.col("create_date").alias("source_date"))
    rows = active(links).join(source, "from_page_id").withColumn("effective", F.coalesce(is_effective(), F.lit(False)))
    w = Window.partitionBy("to_page_id").orderBy(F.desc("effective"), F.desc("weight"), F.desc("source_date"), "id")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select(F.col("to_page_id").alias("page_id"), "rn", "id", "source_slug", "link_type", "effective", "weight")


def aggregate_page_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    e = is_effective()
    return (
        active(links).join(active(pages).select(F.col("id").alias("to_page_id"), "slug"), "to_page_id")
        .groupBy("slug", "link_type")
        .agg(F.count("*").alias("occurrences"), F.count_if(e).alias("effective"), F.count_if(~e).alias("weak"), F.max("weight").alias("max_weight"), F.array_join(F.array_sort(F.collect_set("link_source")), ",").alias("provenance"))
    )


def missing_provenance_links(facts: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """(source, entity) pairs that share facts but no extracted link from the facts block."""
    entity = active(pages).where(F.col("type").isin("company", "concept", "industry")).select(F.col("id").alias("entity_page_id"), F.col("type").alias("entity_type"))
    source = active(pages).select(F.col("id").alias("source_page_id"))
    linked = active(links).where("link_source = 'extracted' AND origin_field = 'facts_block'").select(F.col("from_page_id").alias("source_page_id"), F.col("to_page_id").alias("entity_page_id")).distinct()
    pairs = active(facts).where("source_page_id <> entity_page_id").groupBy("source_page_id", "entity_page_id").agg(F.count("*").alias("fact_count"))
    return pairs.join(entity, "entity_page_id").join(source, "source_page_id").join(linked, ["source_page_id", "entity_page_id"], "left_anti").select("source_page_id", "entity_page_id", "entity_type", "fact_count")


def backfill_summary(missing: DataFrame) -> DataFrame:
    """What inserting the missing links would do, by entity type."""
    return missing.groupBy("entity_type").agg(F.count("*").alias("inserted"), F.countDistinct("entity_page_id").alias("pages"), F.countDistinct("source_page_id").alias("sources"))


def backfill_links(missing: DataFrame, limit: int = 1000) -> DataFrame:
    """The links that close the gaps, most facts first, at most `limit` (5,000 at most) in one run."""
    first = missing.orderBy(F.desc("fact_count"), "source_page_id", "entity_page_id").limit(min(limit, 5000))
    return first.select(F.col("source_page_id").alias("from_page_id"), F.col("entity_page_id").alias("to_page_id"), F.lit("mention").alias("link_type"), F.lit("extracted").alias("link_source"), F.lit("facts_block").alias("origin_field"), F.lit(1.2).alias("weight"))


def retire_type(pages: DataFrame, links: DataFrame, page_type: str) -> tuple[DataFrame, DataFrame]:
    """Soft-delete all pages of a type and every link from or to them."""
    gone = active(pages).where(F.col("type") == page_type).select("id")
    marked = pages.withColumn("deleted", F.when(F.col("type") == page_type, 1).otherwise(F.col("deleted")))
    side = lambda c, n: gone.select(F.col("id").alias(c), F.lit(True).alias(n))
    hit = links.join(side("from_page_id", "a"), "from_page_id", "left").join(side("to_page_id", "b"), "to_page_id", "left")
    return marked, hit.withColumn("deleted", F.when(F.col("a") | F.col("b"), 1).otherwise(F.col("deleted"))).select(*links.columns)


def page_profile(pages: DataFrame, links: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Each active page with its display text and link counts, and with tags (page_id, tag) also its sorted distinct ones."""
    shown = active(pages).select(F.col("id").alias("page_id"), "slug", "type", F.coalesce(F.expr("nullif(display_name, '')"), "title", "slug").alias("display"))
    out = shown.join(link_counts(pages, links), "page_id")
    if tags is None:
        return out
    own = active(tags).groupBy("page_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return out.join(own, "page_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def orphans(pages: DataFrame, links: DataFrame, as_of: str, types: tuple[str, ...] = ("company", "industry", "concept"), min_age_days: int = 0) -> DataFrame:
    """Entity pages without any active inbound link, with their age."""
    age = F.datediff(F.lit(as_of).cast("date"), "create_date")
    linked = active(links).select(F.col("to_page_id").alias("id"))
    return active(pages).where(F.col("type").isin(*types)).join(linked, "id", "left_anti").withColumn("age_days", age).where(F.col("age_days") >= min_age_days).select("id", "slug", "type", "age_days")
