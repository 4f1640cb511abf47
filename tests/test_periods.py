"""Periods as intervals, and references of pages."""

import datetime

from pyspark.sql import functions as F

from lorebase.functions.periods import interval
from lorebase.operators import references as rf

CASES = {
    "FY2024": ("2024-01-01", "2024-12-31"), "fy24e": ("2024-01-01", "2024-12-31"), "CY99": ("1999-01-01", "1999-12-31"), "2023": ("2023-01-01", "2023-12-31"), "1Q24A": ("2024-01-01", "2024-03-31"), "Q4 2023": ("2023-10-01", "2023-12-31"),
    "2024Q2": ("2024-04-01", "2024-06-30"), "FY25-Q3": ("2025-07-01", "2025-09-30"), "2H26E": ("2026-07-01", "2026-12-31"), "H1 2024": ("2024-01-01", "2024-06-30"), "9M24": ("2024-01-01", "2024-09-30"), "2024-02": ("2024-02-01", "2024-02-29"),
    "2024-2026": ("2024-01-01", "2026-12-31"), "TTM": ("2023-05-18", "2024-05-17"), "ntm": ("2024-05-18", "2025-05-17"), "current": ("2024-05-17", "2024-05-17"), "soon": None, "": None, "24": None, "5Q24": None, "13M24": None, "2024-13": None, "2026-2024": None,
}


def days(x):
    return None if x is None else (str(x["start"]), str(x["end"]))


def test_intervals(spark):
    rows = spark.createDataFrame([(p,) for p in CASES] + [(None,)], "p string").withColumn("on", F.lit(datetime.date(2024, 5, 17)))
    got = {r["p"]: days(r["x"]) for r in rows.select("p", interval(F.col("p"), F.col("on")).alias("x")).collect()}
    assert got == CASES | {None: None}
    assert {days(r["x"]) for r in rows.where("p IN ('TTM', 'current')").select(interval(F.col("p")).alias("x")).collect()} == {None}


def test_fiscal_years_that_end_in_june(spark):
    got = spark.createDataFrame([("FY2024",), ("FY24Q1",), ("2024",), ("1H FY24",)], "p string").select(interval(F.col("p"), fiscal_end=6).alias("x")).collect()
    assert [days(r["x"]) for r in got] == [("2023-07-01", "2024-06-30"), ("2023-07-01", "2023-09-30"), ("2024-01-01", "2024-12-31"), ("2023-07-01", "2023-12-31")]


def tables(spark):
    page = "id long, slug string, type string, entity_state string, content string, ticker string, exchange string, deleted int"
    pages = [(i, f"companies/{i}", "company", "stub", "x", None, None, 0) for i in range(1, 17)] + [(20, "outputs/a", "output", None, None, None, None, 0), (21, "companies/long", "company", "stub", "x" * 400, None, None, 0), (22, "companies/done", "company", "compiled", None, None, None, 0), (23, "companies/gone", "company", "stub", "", None, None, 1)]
    link = "id long, from_page_id long, to_page_id long, origin_page_id long, link_type string, link_source string, origin_field string, weight double, deleted int"
    return {
        "pages": spark.createDataFrame(pages, page),
        "links": spark.createDataFrame([(1, 2, 1, 3, "mention", "markdown", None, 0.3, 0), (2, 2, 15, None, "mention", "markdown", None, None, 0), (3, 2, 16, None, "mention", "markdown", None, 0.3, 0), (4, 16, 16, None, "cites", "manual", None, 1.0, 0), (5, 20, 14, None, "mention", None, None, 0.3, 1), (6, 20, 13, None, "mention", "markdown", None, 0.3, 0)], link),
        "facts": spark.createDataFrame([(1, 4, 5, 0), (2, 14, None, 1)], "id long, entity_page_id long, source_page_id long, deleted int"),
        "timeline": spark.createDataFrame([(1, 6, 7, 0)], "id long, entity_page_id long, source_page_id long, deleted int"),
        "signals": spark.createDataFrame([(1, 8, 9, 10, 0)], "id long, entity_page_id long, thesis_page_id long, source_page_id long, deleted int"),
        "theses": spark.createDataFrame([(11, 12), (99, 13)], "page_id long, target_page_id long"),
        "tags": spark.createDataFrame([(1, 14, 0)], "id long, page_id long, deleted int"),
    }


def test_every_reference_is_a_blocker(spark):
    t = tables(spark)
    got = {r["id"]: r for r in rf.retire_report(t).collect()}
    assert {i: r["blockers"] for i, r in got.items()} == {
        1: ["inbound_links"], 2: ["outbound_links"], 3: ["origin_links"], 4: ["entity_facts"], 5: ["source_facts"], 6: ["entity_timeline"], 7: ["source_timeline"], 8: ["entity_signals"], 9: ["thesis_signals"], 10: ["source_signals"], 11: ["thesis_rows"], 12: ["target_theses"],
        13: ["inbound_links", "target_theses"], 14: [], 15: ["inbound_links"], 16: ["inbound_links", "outbound_links"], 20: ["type", "entity_state", "outbound_links"], 21: ["content_chars"], 22: ["entity_state"],
    }
    assert got[14]["tags"] == 1 and got[16]["inbound_links"] == 2
    assert [r["id"] for r in rf.retire_candidates(t).collect()] == [14]
    assert {r["id"] for r in rf.retire_report(t, force=True).where(F.size("blockers") == 0).collect()} == {14, 21, 22}


def test_only_weak_links_of_others_make_a_page_demotable(spark):
    t = tables(spark)
    assert sorted((r["id"], r["weak"], r["origins"]) for r in rf.demotable_pages(t).collect()) == [(1, 1, 1), (15, 1, 1), (16, 1, 1)]  # 13 is a thesis target
    plan = {r["page_id"]: r for r in rf.merge_plan(spark.createDataFrame([(16, 1), (12, 1), (50, 1)], "old long, new long"), t).collect()}
    assert (plan[16]["links"], plan[12]["theses"], plan[50]["links"]) == (2, 1, 0)
    alone = {"pages": t["pages"]}
    assert rf.retire_candidates(alone).count() == 16 and rf.reference_counts(alone).count() == 0
