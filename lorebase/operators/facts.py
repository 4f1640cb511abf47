"""Facts, consensus, theses and signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.periods import interval
from lorebase.operators.graph import active, consensus_strength, is_effective, link_type_distribution


def half_means(facts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the number of values and the means of the first and the last half; the middle one of an odd number counts in neither."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = facts.withColumn("n", n).withColumn("rn", rn).withColumn("half", F.floor(F.col("n") / 2))
    first, last = F.when(F.col("rn") <= F.col("half"), F.col("value_numeric")), F.when(F.col("rn") > F.col("n") - F.col("half"), F.col("value_numeric"))
    return rows.groupBy(*keys).agg(F.first("n").alias("n"), F.avg(first).alias("first_mean"), F.avg(last).alias("last_mean"))


def drift_label(pct: Column, threshold: float = 0.02) -> Column:
    return F.when(F.abs(pct) < threshold, "stable").when(pct > 0, "rising").otherwise("falling")


def drift_pct(first: Column, last: Column) -> Column:
    """Change over the size of the first mean; 0 where that is 0."""
    return F.when(first == 0, 0.0).otherwise((last - first) / F.abs(first))


def numeric(facts: DataFrame) -> DataFrame:
    return active(facts).where("value_numeric IS NOT NULL")


def consensus_stats(facts: DataFrame) -> DataFrame:
    """Per (entity, metric): count, mean, sample deviation (0 for one value), range, earliest and latest value."""
    order = F.struct("valid_from", "id")
    mean = F.avg("value_numeric")
    return numeric(facts).groupBy("entity_page_id", "metric").agg(
        F.count("*").alias("n"), F.round(mean, 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value_numeric"), F.lit(0.0)), 6).alias("std"), F.round(F.min("value_numeric"), 6).alias("low"), F.round(F.max("value_numeric"), 6).alias("high"),
        F.round(F.when(mean == 0, 0.0).otherwise((F.max("value_numeric") - F.min("value_numeric")) / F.abs(mean)), 6).alias("range_pct"),
        F.round(F.min_by("value_numeric", order), 6).alias("earliest"), F.round(F.max_by("value_numeric", order), 6).alias("latest"),
    )


def drift(facts: DataFrame, min_obs: int = 2) -> DataFrame:
    h = half_means(numeric(facts), ["entity_page_id", "metric"], ["valid_from", "id"])
    pct = drift_pct(F.col("first_mean"), F.col("last_mean"))
    enough = F.col("n") >= max(min_obs, 2)
    return h.select("entity_page_id", "metric", "n", F.round(F.when(enough, pct), 6).alias("drift_pct"), F.when(enough, drift_label(pct)).otherwise("insufficient_data").alias("trend"))


def outliers(facts: DataFrame, z: float = 1.5) -> DataFrame:
    """Values more than z sample deviations from the mean of their (entity, metric); to nine decimals, as sums in any order differ beyond."""
    w = Window.partitionBy("entity_page_id", "metric")
    rows = numeric(facts).withColumn("mean", F.avg("value_numeric").over(w)).withColumn("std", F.stddev_samp("value_numeric").over(w))
    score = (F.col("value_numeric") - F.col("mean")) / F.col("std")
    return rows.where((F.col("std") > 0) & (F.round(F.abs(score), 9) > z)).select("id", "entity_page_id", "metric", F.round(score, 6).alias("z"))


def top_consensus_metrics(facts: DataFrame, k: int = 6, min_obs: int = 3, min_sources: int = 2) -> DataFrame:
    """Each entity's k metrics with the most observations and sources, over all periods, with trend and latest value.

    One sort by (entity, metric) serves ranks, counts and sums. Values are added in their order, so that a mean and a
    change that lies on a bound come out the same however rows are dealt.
    """
    keys = ["entity_page_id", "metric"]
    w = Window.partitionBy(*keys)
    order = w.orderBy("valid_from", "id")
    rows = numeric(facts).select(*keys, "valid_from", "id", F.col("value_numeric").alias("v"), "source_page_id", F.row_number().over(order).alias("rn"), F.count("*").over(w).alias("n"))
    half, running = F.floor(F.col("n") / 2), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low, high = F.when(F.col("rn") <= half, F.col("v")), F.when(F.col("rn") > F.col("n") - half, F.col("v"))
    rows = rows.select(*keys, "source_page_id", "n", (F.col("rn") == F.col("n")).alias("end"), "v", F.sum("v").over(running).alias("sum"), F.sum(low).over(running).alias("low"), F.sum(high).over(running).alias("high"))
    last = lambda c: F.max(F.when(F.col("end"), F.col(c)))
    # by source first, which needs no further shuffle, so that no buffer holds the sources of a hot entity
    one = rows.groupBy(*keys, "source_page_id").agg(F.first("n").alias("n"), *[last(c).alias(c) for c in ("v", "sum", "low", "high")])
    g = one.groupBy(*keys).agg(F.first("n").alias("n"), F.count("source_page_id").alias("sources"), F.max("v").alias("latest"), *[F.max(c).alias(c) for c in ("sum", "low", "high")])
    half = F.floor(F.col("n") / 2)
    pct = drift_pct(F.try_divide("low", half), F.try_divide("high", half))
    kept = g.where((F.col("n") >= min_obs) & (F.col("sources") >= min_sources))
    rank = F.row_number().over(Window.partitionBy("entity_page_id").orderBy(F.desc("n"), F.desc("sources"), "metric"))
    kept = kept.withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.select("entity_page_id", "rank", "metric", "n", "sources", F.round(F.col("sum") / F.col("n"), 6).alias("mean"), F.round("latest", 6).alias("latest"), F.round(pct, 6).alias("drift_pct"), drift_label(pct).alias("trend"))


def expire(facts: DataFrame, as_of: str, age_days: int = 90, fiscal_end: int = 12) -> DataFrame:
    """Close current facts whose period ended more than age_days before as_of; a period without an end (see periods.interval) never expires.

    Trailing and next twelve months and current values count from the fact's valid_from.
    """
    end = interval(F.col("period"), F.col("valid_from"), fiscal_end)["end"]
    old = F.col("valid_to").isNull() & (end < F.date_sub(F.lit(as_of).cast("date"), age_days)) & (F.col("deleted") == 0)
    return facts.withColumn("expired", F.coalesce(old, F.lit(False))).withColumn("valid_to", F.when(old, F.lit(as_of).cast("date")).otherwise(F.col("valid_to")))


def query_facts(facts: DataFrame, pages: DataFrame, metric: str | None = None, period: str | None = None, current_only: bool = True, table_only: bool = False, entity: str | None = None, table_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Facts with the slugs of their entity, found by slug or ticker, and, where there is one, source; with a limit the newest."""
    rows = active(facts)
    if metric:
        rows = rows.where(F.col("metric") == metric)
    if period:
        rows = rows.where(F.col("period") == period)
    if current_only:
        rows = rows.where("valid_to IS NULL")
    if table_only:
        rows = rows.where("table_id IS NOT NULL")
    if table_id:
        rows = rows.where(F.col("table_id") == table_id)
    named = pages.where((F.col("slug") == entity) | (F.upper("ticker") == entity.upper())) if entity else pages
    named = named.select(F.col("id").alias("entity_page_id"), F.col("slug").alias("entity_slug"))
    source = pages.select(F.col("id").alias("source_page_id"), F.col("slug").alias("source_slug"))
    out = rows.join(named, "entity_page_id").join(source, "source_page_id", "left").select("id", "entity_slug", "source_slug", "metric", "period", "value_numeric", "valid_from")
    return out.orderBy(F.desc("valid_from"), F.desc("id")).limit(limit) if limit else out


def compare_facts(facts: DataFrame, metric: str, periods: list[str]) -> DataFrame:
    """Entity by period: the newest table-sourced value of a metric."""
    rows = active(facts).where((F.col("metric") == metric) & F.col("table_id").isNotNull()).withColumn("period", F.coalesce("period", F.lit("current"))).where(F.col("period").isin(*periods))
    newest = F.row_number().over(Window.partitionBy("entity_page_id", "period").orderBy(F.desc("valid_from"), F.desc("id")))
    first = rows.withColumn("rn", newest).where("rn = 1")
    cells = [F.max(F.when(F.col("period") == p, F.col("value_numeric"))).alias(p.lower()) for p in periods]
    return first.groupBy("entity_page_id").agg(*cells)


def table_facts(facts: DataFrame, pages: DataFrame, metric: str, entities: list[str] | None = None, periods: list[str] | None = None, source: str | None = None, current_only: bool = False, limit: int = 200) -> DataFrame:
    """The table-sourced facts of a metric that a comparison looks at: the first `limit` by entity slug, period and the newest first.

    Entities are slugs or tickers, a source is a slug; a null period counts as `current`.
    """
    rows = active(facts).where((F.col("metric") == metric) & F.col("table_id").isNotNull()).withColumn("period", F.coalesce("period", F.lit("current")))
    rows = rows.where("valid_to IS NULL") if current_only else rows
    rows = rows.where(F.col("period").isin(*periods)) if periods else rows
    named = pages.where(F.col("slug").isin(*entities) | F.upper("ticker").isin(*[x.upper() for x in entities])) if entities else pages
    rows = rows.join(named.select(F.col("id").alias("entity_page_id"), F.col("slug").alias("entity_slug")), "entity_page_id")
    origin = pages.select(F.col("id").alias("source_page_id"), F.col("slug").alias("source_slug"))
    rows = rows.join(origin.where(F.col("source_slug") == source), "source_page_id") if source else rows.join(origin, "source_page_id", "left")
    return rows.orderBy("entity_slug", F.col("period") == "current", "period", F.desc_nulls_last("valid_from"), F.desc("id")).limit(limit)


def compare_table_facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, tables) of table_facts: the newest fact of each (entity_slug, period), and each (source_slug, table_id) used with how many facts."""
    newest = F.row_number().over(Window.partitionBy("entity_slug", "period").orderBy(F.desc_nulls_last("valid_from"), F.desc("id")))
    cells = rows.withColumn("rn", newest).where("rn = 1").select("entity_slug", "period", "id", "value_numeric", "valid_from", "source_slug", "table_id")
    used = rows.where("source_slug IS NOT NULL").groupBy("source_slug", "table_id").agg(F.count("*").alias("facts"))
    return cells, used


def detect_fact_signals(facts: DataFrame, new_facts: DataFrame, priors: int = 10, threshold: float = 0.1) -> DataFrame:
    """Signals of new facts against up to `priors` newest facts of the same entity, metric and period from other, known sources.

    The limit applies before priors without a number are left out; priors are not restricted to earlier dates.
    """
    # whatever source a fact is of, its priors are among the 2 * priors newest of the key, taken at most `priors` a source
    keys = ["entity_page_id", "metric", "period"]
    of_source = F.row_number().over(Window.partitionBy(*keys, "source_page_id").orderBy(F.desc("valid_from"), F.desc("id")))
    of_key = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("valid_from"), F.desc("id")))
    few = active(facts).where("source_page_id IS NOT NULL").withColumn("k", of_source).where(F.col("k") <= priors).withColumn("k", of_key).where(F.col("k") <= 2 * priors)
    new = numeric(new_facts).select(F.col("id").alias("fact_id"), "entity_page_id", "metric", F.col("period").alias("p"), F.col("value_numeric").alias("value"), F.col("source_page_id").alias("s"))
    old = few.select("id", F.col("entity_page_id").alias("e"), F.col("metric").alias("m"), "period", "value_numeric", "source_page_id", "valid_from")
    pairs = new.join(old, (F.col("entity_page_id") == F.col("e")) & (F.col("metric") == F.col("m")) & F.col("p").eqNullSafe(F.col("period")) & (F.col("source_page_id") != F.col("s")) & (F.col("id") != F.col("fact_id")))
    rn = F.row_number().over(Window.partitionBy("fact_id").orderBy(F.desc("valid_from"), F.desc("id")))
    g = pairs.withColumn("rn", rn).where(F.col("rn") <= priors).groupBy("fact_id", "entity_page_id", "metric").agg(F.first("value").alias("value"), F.avg("value_numeric").alias("prior_avg"), F.count("value_numeric").alias("prior_count"))
    delta = (F.col("value") - F.col("prior_avg")) / F.abs("prior_avg")
    g = g.where("prior_count > 0 AND prior_avg <> 0").withColumn("delta", delta).where(F.abs("delta") >= threshold)
    return g.select(
        "fact_id", "entity_page_id", "metric", "prior_count", F.round("delta", 6).alias("delta_pct"),
        F.when(F.col("prior_count") >= 2, "consensus_drift").otherwise("fact_outlier").alias("signal_type"),
        F.when(F.abs("delta") >= 0.35, "critical").when(F.abs("delta") >= 0.2, "warning").otherwise("info").alias("severity"),
    )


def dedupe_signals(signals: DataFrame) -> DataFrame:
    """Soft-delete all but the newest of signals that agree in type, entity, thesis and source, all of them known."""
    keys = ["signal_type", "entity_page_id", "thesis_page_id", "source_page_id"]
    full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & (F.col("deleted") == 0)
    rn = F.row_number().over(Window.partitionBy(*keys, full).orderBy(F.desc("detected_at"), F.desc("id")))
    return signals.withColumn("rn", rn).withColumn("deleted", F.when(full & (F.col("rn") > 1), 1).otherwise(F.col("deleted"))).drop("rn")


def merge_facts(current: DataFrame, candidates: DataFrame, as_of: str) -> DataFrame:
    """Versioned merge of (entity_page_id, metric, period, value_numeric, pos) candidates: rows of all versions with an action.

    Equal values are kept; a changed one closes the current row at as_of. Candidates of one batch close each other in
    their order and the last stays current; one equal to its predecessor adds nothing. value_text and unit, where both
    tables have them, must be equal too. A kept row without a source_quote gets that of an equal candidate, and the
    longest evidence_context of both, where both tables have these.
    """
    keys = ["entity_page_id", "metric", "period"]
    both = [c for c in ("value_text", "unit", "source_quote", "evidence_context") if c in current.columns and c in candidates.columns]
    values = ["value_numeric", *[c for c in ("value_text", "unit") if c in both]]
    w = Window.partitionBy(*keys).orderBy("stage", "pos")
    old = current.select(*keys, "value_numeric", *both, F.col("valid_from"), F.lit(0).alias("stage"), F.col("id").alias("pos"))
    new = candidates.select(*keys, "value_numeric", *both, F.lit(as_of).cast("date").alias("valid_from"), F.lit(1).alias("stage"), "pos")
    value = F.struct(*values)
    rows = old.unionByName(new).withColumn("value", value)
    before, has = F.lag("value").over(w), F.lag("stage").over(w)
    rows = rows.withColumn("same", F.coalesce(has.isNotNull() & F.col("value").eqNullSafe(before), F.lit(False)))
    # a run of equal values is one version
    rows = rows.withColumn("run", F.sum(F.when((F.col("stage") == 0) | ~F.col("same"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    version = Window.partitionBy(*keys, "run").orderBy("stage", "pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    if "source_quote" in both:
        rows = rows.withColumn("source_quote", F.first(F.nullif(F.col("source_quote"), F.lit("")), ignorenulls=True).over(version))
    if "evidence_context" in both:
        rows = rows.withColumn("evidence_context", F.max_by("evidence_context", F.length("evidence_context")).over(version))
    kept = rows.where((F.col("stage") == 0) | ~F.col("same"))
    follows = F.lead("stage").over(w)
    ends = F.when(follows == 1, F.lit(as_of).cast("date"))
    return kept.withColumn("valid_to", ends).select(*keys, "value_numeric", *both, "valid_from", "valid_to", F.when(F.col("stage") == 1, "inserted").when(follows == 1, "closed").otherwise("kept").alias("action"), "pos")


def thesis_snapshot_facts(theses: DataFrame, facts: DataFrame, n: int = 20) -> DataFrame:
    """The n newest current facts of each thesis's target."""
    rows = theses.select(F.col("page_id").alias("thesis_id"), F.col("target_page_id").alias("entity_page_id")).join(active(facts).where("valid_to IS NULL"), "entity_page_id")
    rn = F.row_number().over(Window.partitionBy("thesis_id").orderBy(F.desc("valid_from"), F.desc("id")))
    return rows.withColumn("rn", rn).where(F.col("rn") <= n).select("thesis_id", "rn", "id")


def thesis_snapshot_signals(theses: DataFrame, signals: DataFrame, n: int = 20) -> DataFrame:
    """The n newest signals of each thesis, by the thesis or by its target: two equi-joins instead of one on either."""
    s = active(signals).select("id", "thesis_page_id", "entity_page_id", "detected_at")
    t = theses.select(F.col("page_id").alias("thesis_id"), "target_page_id")
    by_thesis = t.join(s, t["thesis_id"] == s["thesis_page_id"]).select("thesis_id", "id", "detected_at")
    by_target = t.join(s, t["target_page_id"] == s["entity_page_id"]).select("thesis_id", "id", "detected_at")
    rn = F.row_number().over(Window.partitionBy("thesis_id").orderBy(F.desc("detected_at"), F.desc("id")))
    return by_thesis.union(by_target).distinct().withColumn("rn", rn).where(F.col("rn") <= n).select("thesis_id", "rn", "id")


def thesis_snapshots(theses: DataFrame, pages: DataFrame, facts: DataFrame, signals: DataFrame, n: int = 20) -> DataFrame:
    """Every thesis that has a page: its own columns, slug, target_slug, and the n newest current facts of its target and signals.

    recent_facts: array of (rn, id, metric, period, value, unit, source_slug), value being the number as text, else the text;
    recent_signals: array of (rn, id, signal_type, severity, title, detected_at), by the thesis or by its target. Newest by
    ingested_at (valid_from where facts have none) and detected_at, ties to the greater id. Columns that a table lacks are
    null. The target is `(unknown)` where it has no page; deleted pages count, as their theses are still open to view.

    Each target's newest rows are ranked once, before theses meet them, so a target of many theses costs no more. A thesis
    has one row, even where pages of other kinds have its id: its own page is one of type thesis, where pages tell their
    type, and of several pages with an id the first by slug names it.
    """
    text = lambda df, c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    slugs = pages.select(F.col("id").alias("page_id"), "slug")

    def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
        rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc("id")))
        return rows.where(F.col(key).isNotNull()).withColumn("rn", rn).where(F.col("rn") <= n)

    wanted = theses.select(F.col("target_page_id").alias("entity_page_id")).distinct()
    at = "ingested_at" if "ingested_at" in facts.columns else "valid_from"
    current = active(facts).where("valid_to IS NULL").join(wanted, "entity_page_id", "left_semi")
    value = F.coalesce(text(facts, "value_numeric"), text(facts, "value_text"))
    tops = newest(current.select("entity_page_id", "id", at, "metric", "period", value.alias("value"), text(facts, "unit").alias("unit"), "source_page_id"), "entity_page_id", at)
    tops = tops.join(slugs.withColumnsRenamed({"page_id": "source_page_id", "slug": "source_slug"}), "source_page_id", "left")
    of_target = tops.groupBy(F.col("entity_page_id").alias("target_page_id")).agg(F.array_sort(F.collect_list(F.struct("rn", "id", "metric", "period", "value", "unit", "source_slug"))).alias("recent_facts"))

    s = active(signals).select("id", "signal_type", "severity", text(signals, "title").alias("title"), "detected_at", "thesis_page_id", "entity_page_id")
    t = theses.select("page_id", "target_page_id")
    by_thesis = newest(s, "thesis_page_id", "detected_at").withColumn("page_id", F.col("thesis_page_id"))
    by_target = newest(s.join(wanted, "entity_page_id", "left_semi"), "entity_page_id", "detected_at").join(t.withColumnRenamed("target_page_id", "entity_page_id"), "entity_page_id")
    shown = ["page_id", "id", "signal_type", "severity", "title", "detected_at"]
    both = by_thesis.select(*shown).unionByName(by_target.select(*shown)).dropDuplicates(["page_id", "id"])
    of_thesis = newest(both, "page_id", "detected_at").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rn", *shown[1:]))).alias("recent_signals"))

    own = [c for c in theses.columns if c not in ("slug", "target_slug", "recent_facts", "recent_signals")]
    kept = pages.where("type = 'thesis'") if "type" in pages.columns else pages
    one = lambda df, key, name: df.join(theses.select(F.col(key).alias("id")).distinct(), "id", "left_semi").groupBy(F.col("id").alias(key)).agg(F.min("slug").alias(name))
    out = theses.select(*own).join(one(kept, "page_id", "slug"), "page_id").join(one(pages, "target_page_id", "target_slug"), "target_page_id", "left")
    out = out.join(of_target, "target_page_id", "left").join(of_thesis, "page_id", "left")
    return out.select(*own, "slug", F.coalesce("target_slug", F.lit("(unknown)")).alias("target_slug"), *[F.coalesce(c, F.array()).alias(c) for c in ("recent_facts", "recent_signals")])


def thesis_list(theses: DataFrame, pages: DataFrame, statuses: tuple[str, ...] = ("active", "monitoring")) -> DataFrame:
    target = active(pages).select(F.col("id").alias("target_page_id"), F.col("slug").alias("target_slug"))
    return theses.where(F.col("status").isin(*statuses)).join(target, "target_page_id", "left").select("page_id", "title", "status", "direction", "target_slug", "update_date")


def thesis_touch_signals(links: DataFrame, theses: DataFrame) -> DataFrame:
    """For each source page that links to an active thesis's target: a signal by the first link's type."""
    l = active(links).select(F.col("from_page_id").alias("source_page_id"), F.col("to_page_id").alias("target_page_id"), "link_type", "id")  # noqa: E741
    t = theses.where("status = 'active'").select(F.col("page_id").alias("thesis_id"), "target_page_id")
    first = l.join(t, "target_page_id").groupBy("source_page_id", "thesis_id").agg(F.min_by("link_type", "id").alias("link_type"))
    kind = F.when(F.col("link_type").isin("contradicts", "critiques", "supersedes"), "thesis_invalidation").otherwise("thesis_validation")
    return first.select("source_page_id", "thesis_id", kind.alias("signal_type"))


def entity_pulse(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Per entity: facts, metrics, sources, link totals and consensus strength, each table read once."""
    f = active(facts).groupBy(F.col("entity_page_id").alias("page_id")).agg(F.count("*").alias("facts"), F.countDistinct("metric").alias("metrics"), F.countDistinct("source_page_id").alias("sources"))
    d = link_type_distribution(links).where("direction = 'in'").groupBy("page_id").agg(F.sum("n").alias("inbound"), F.sum("effective").alias("effective"))
    return f.join(d, "page_id", "full").join(consensus_strength(links).select("page_id", "strength"), "page_id", "left").fillna(0, ["facts", "metrics", "sources", "inbound", "effective"])


def entity_latest(facts: DataFrame, links: DataFrame, n: int = 10) -> DataFrame:
    """(page_id, kind, rn, id): each entity's n latest facts and n strongest inbound links, by which its pulse is shown."""
    f = active(facts).select(F.col("entity_page_id").alias("page_id"), F.lit("fact").alias("kind"), F.row_number().over(Window.partitionBy("entity_page_id").orderBy(F.desc("valid_from"), F.desc("id"))).alias("rn"), "id")
    strong = Window.partitionBy("to_page_id").orderBy(F.coalesce(is_effective(), F.lit(False)).desc(), F.desc("weight"), F.desc("create_time"), F.desc("id"))
    inbound = active(links).select(F.col("to_page_id").alias("page_id"), F.lit("inbound").alias("kind"), F.row_number().over(strong).alias("rn"), "id")
    return f.where(F.col("rn") <= n).unionByName(inbound.where(F.col("rn") <= n))


def thesis_page(theses: DataFrame, pages: DataFrame, offset: int, limit: int, direction: str | None = None) -> DataFrame:
    """A page of all theses by conviction rank, nulls last, then the latest update, then id."""
    target = active(pages).select(F.col("id").alias("target_page_id"), F.col("slug").alias("target_slug"))
    rows = theses if direction is None else theses.where(F.col("direction") == direction)
    return rows.join(target, "target_page_id", "left").orderBy(F.col("conviction_rank").desc_nulls_last(), F.col("update_date").desc_nulls_last(), "page_id").offset(offset).limit(limit).select("page_id", "title", "status", "direction", "target_slug", "update_date")


def source_facts(facts: DataFrame) -> DataFrame:
    """Current facts per citing source in the order entity, metric, period."""
    rn = F.row_number().over(Window.partitionBy("source_page_id").orderBy("entity_page_id", "metric", F.col("period").asc_nulls_last(), "id"))
    return active(facts).where("valid_to IS NULL").withColumn("rn", rn).select("source_page_id", "rn", "id")


def page_timeline(timeline: DataFrame, n: int = 30) -> DataFrame:
    """Newest n entries of each page, as source or as entity."""
    t = active(timeline)
    both = t.select(F.col("entity_page_id").alias("page_id"), "id", "event_date").union(t.select("source_page_id", "id", "event_date")).distinct()
    rn = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("event_date"), F.desc("id")))
    return both.withColumn("rn", rn).where(F.col("rn") <= n).select("page_id", "rn", "id", "event_date")


def dedupe_candidates(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first candidate of each key; nulls are equal."""
    return candidates.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")
