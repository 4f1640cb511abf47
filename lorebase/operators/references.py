"""What refers to a page: one declared list of (table, column), counted by one aggregate, and what follows from the counts.

Tables come as a dict of DataFrames by name, as in `lifecycle`; rows with `deleted` other than 0 don't count. A table
or column that isn't there has no references. Each table is read once; the rows are counted before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.operators.graph import active, is_effective

Tables = dict[str, DataFrame]

#: References that keep a page: the name of the count, the table and the column that names the page.
REFERENCES = {
    "inbound_links": ("links", "to_page_id"), "outbound_links": ("links", "from_page_id"), "origin_links": ("links", "origin_page_id"),
    "entity_facts": ("facts", "entity_page_id"), "source_facts": ("facts", "source_page_id"),
    "entity_timeline": ("timeline", "entity_page_id"), "source_timeline": ("timeline", "source_page_id"),
    "entity_signals": ("signals", "entity_page_id"), "thesis_signals": ("signals", "thesis_page_id"), "source_signals": ("signals", "source_page_id"),
    "thesis_rows": ("theses", "page_id"), "target_theses": ("theses", "target_page_id"),
}
#: Rows that belong to a page and go with it.
OWN_ROWS = {"tags": ("tags", "page_id"), "raw_data": ("raw_data", "page_id"), "chunks": ("chunks", "page_id")}
#: Rows that a merge would move: the columns of a table; a row that names the page twice counts once.
MOVED = {
    "links": ("from_page_id", "to_page_id", "origin_page_id"), "facts": ("entity_page_id",), "timeline": ("entity_page_id",), "signals": ("entity_page_id",), "theses": ("target_page_id",),
    "tags": ("page_id",), "raw_data": ("page_id",), "chunks": ("page_id",),
}
#: Types of pages that can be retired, and the states in which nobody has worked on them.
RETIRABLE, UNWORKED = ("company", "industry", "concept", "thesis"), ("stub", "candidate_promoted")


def _live(table: DataFrame) -> DataFrame:
    return active(table) if "deleted" in table.columns else table


def _counts(parts: list[DataFrame], names: list[str]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts).where("page_id IS NOT NULL")
    return rows.groupBy("page_id").agg(*[F.count_if(F.col("name") == n).alias(n) for n in names])


def reference_counts(tables: Tables, registry: dict[str, tuple[str, str]] = REFERENCES) -> DataFrame:
    """(page_id, one count for each name of the registry) of the pages that have any reference."""
    by_table: dict[str, list[tuple[str, str]]] = {}
    for name, (table, column) in registry.items():
        if table in tables and column in tables[table].columns:
            by_table.setdefault(table, []).append((name, column))
    parts = [
        _live(tables[t]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("long").alias("page_id")) for n, c in own])).alias("x")).select("x.name", "x.page_id")
        for t, own in by_table.items()
    ]
    none = tables["pages"].select(F.lit("").alias("name"), F.lit(None).cast("long").alias("page_id")).where("false")
    return _counts(parts or [none], list(registry))


def moved_counts(tables: Tables) -> DataFrame:
    """(page_id, rows of each table of MOVED) that name the page."""
    parts = []
    for t, columns in MOVED.items():
        here = [F.col(c).cast("long") for c in columns if t in tables and c in tables[t].columns]
        if here:
            parts.append(_live(tables[t]).select(F.lit(t).alias("name"), F.explode(F.array_distinct(F.array(*here))).alias("page_id")))
    none = tables["pages"].select(F.lit("").alias("name"), F.lit(None).cast("long").alias("page_id")).where("false")
    return _counts(parts or [none], list(MOVED))


def merge_plan(mapping: DataFrame, tables: Tables) -> DataFrame:
    """(page_id, rows of each table of MOVED) that a merge of each page (old) would touch."""
    ids = mapping.select(F.col("old").alias("page_id")).distinct()
    return ids.join(moved_counts(tables), "page_id", "left").fillna(0)


def retire_report(tables: Tables, max_chars: int = 300, force: bool = False) -> DataFrame:
    """(id, slug, type, chars, all counts, blockers) of the active pages: why a page can't be retired, [] if it can.

    Blockers are type, entity_state and content_chars (these two not if forced), then the counts above 0 in their
    order. A null text has no characters, a null state counts as compiled.
    """
    counts = reference_counts(tables, REFERENCES | OWN_ROWS).withColumnRenamed("page_id", "id")
    pages = active(tables["pages"]).select("id", "slug", "type", "entity_state", F.length(F.coalesce("content", F.lit(""))).alias("chars"))
    rows = pages.join(counts, "id", "left").fillna(0, list(REFERENCES | OWN_ROWS))
    rules: list[Column] = [F.when(~F.coalesce(F.col("type").isin(*RETIRABLE), F.lit(False)), "type")]
    if not force:
        rules += [F.when(~F.coalesce(F.col("entity_state").isin(*UNWORKED), F.lit(False)), "entity_state"), F.when(F.col("chars") > max_chars, "content_chars")]
    rules += [F.when(F.col(n) > 0, n) for n in REFERENCES]
    return rows.withColumn("blockers", F.array_compact(F.array(*rules))).drop("entity_state")


def retire_candidates(tables: Tables, max_chars: int = 300) -> DataFrame:
    """(id, slug, chars) of the pages that nothing speaks against retiring."""
    return retire_report(tables, max_chars).where(F.size("blockers") == 0).select("id", "slug", "chars")


def demotable_pages(tables: Tables, strong: float = 0.9, max_chars: int = 1300) -> DataFrame:
    """(id, slug, weak, origins) of unworked entity pages that only weak links of other pages lead to: no listing, no fact, event, signal or thesis."""
    effective = F.coalesce(is_effective(), F.lit(False)) | F.coalesce(F.col("weight") >= strong, F.lit(False))
    into = active(tables["links"]).where("from_page_id <> to_page_id").groupBy(F.col("to_page_id").alias("id"))
    into = into.agg(F.count_if(~effective).alias("weak"), F.count_if(effective).alias("strong"), F.countDistinct("from_page_id").alias("origins")).where("strong = 0 AND weak > 0")
    others = {n: x for n, x in REFERENCES.items() if x[0] != "links"}
    used = reference_counts(tables, others).select(F.col("page_id").alias("id"))
    rows = active(tables["pages"]).where(F.col("type").isin("company", "industry", "concept") & F.col("entity_state").isin(*UNWORKED))
    rows = rows.where(F.col("ticker").isNull() & F.col("exchange").isNull() & (F.length(F.coalesce("content", F.lit(""))) <= max_chars))
    return rows.join(into, "id").join(used, "id", "left_anti").select("id", "slug", "weak", "origins")
