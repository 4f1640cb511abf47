"""What larger tables brought to light: equal ids, sums in another order, work that grows faster than its input."""

import random

import pytest
from pyspark.sql import functions as F

from lorebase.operators import facts, hybrid, reviews, search, trigrams
from lorebase.operators import theses as theses_
from lorebase.plans import catalog
from lorebase.sources.keyed import KeyedTable


@pytest.mark.parametrize("typed", [True, False])
def test_a_thesis_whose_id_another_page_has_is_shown_once(spark, typed):
    theses = spark.createDataFrame([(40, 7, "t"), (41, 8, "u")], "page_id long, target_page_id long, title string")
    rows = [(40, "concept", "concepts/part-40"), (40, "thesis", "theses/t"), (41, "thesis", "theses/u"), (7, "company", "companies/b"), (7, "company", "companies/a"), (90, "source", "sources/s")]
    pages = spark.createDataFrame(rows if typed else [(i, s) for i, _, s in rows[1:]], "id long, type string, slug string" if typed else "id long, slug string")
    known = spark.createDataFrame([(i, 7, "m", "FY2024", float(i), 90, "2024-01-01", None, 0) for i in (1, 2, 3)], "id long, entity_page_id long, metric string, period string, value_numeric double, source_page_id long, valid_from string, valid_to string, deleted int")
    signals = spark.createDataFrame([(5, "drift", "info", "2024-01-01", 40, 7, 0)], "id long, signal_type string, severity string, detected_at string, thesis_page_id long, entity_page_id long, deleted int")
    got = facts.thesis_snapshots(theses, pages, known, signals)
    assert sorted((r["page_id"], r["slug"], r["target_slug"], [f["id"] for f in r["recent_facts"]], [x["id"] for x in r["recent_signals"]]) for r in got.collect()) == [(40, "theses/t", "companies/a", [3, 2, 1], [5]), (41, "theses/u", "(unknown)", [], [])]


def test_a_change_on_the_bound_is_added_up_in_order(spark):
    """Two changes of exactly -0.02: whether the sums reach it depends on the order in which the values are added."""
    values = {
        1: [0.1, 0.07, 0.08, 0.09, 0.09, 0.01, 0.01, 0.05, 0.05, 0.09, 0.08, 0.06, 0.03, 0.02, 0.09, 0.07, 0.05],
        2: [0.03, 0.01, 0.09, 0.08, 0.09, 0.05, 0.02, 0.09, 0.04, 0.07, 0.02, 0.06, 0.07, 0.08, 0.07, 0.09, 0.01, 0.02],
    }
    wanted = set()
    for e, own in values.items():
        h = len(own) // 2
        low = high = 0.0
        for x, y in zip(own[:h], own[-h:], strict=True):
            low, high = low + x, high + y
        wanted.add((e, "stable" if abs((high / h - low / h) / (low / h)) < 0.02 else "falling"))
    for seed in range(2):
        rows = [(100 * e + i, e, "m", v, f"2024-01-{i + 1:02d}", 0, i % 2) for e, own in values.items() for i, v in enumerate(own)]
        random.Random(seed).shuffle(rows)
        known = spark.createDataFrame(rows, "id long, entity_page_id long, metric string, value_numeric double, valid_from string, deleted int, source_page_id long")
        assert {(r["entity_page_id"], r["trend"]) for r in facts.top_consensus_metrics(known).collect()} == wanted
    assert len({t for _, t in wanted}) == 2


def test_scanned_pairs_are_counted_without_comparing_titles(spark, monkeypatch):
    monkeypatch.setattr(trigrams, "alike", lambda *_, **__: pytest.fail("titles are compared"))
    rows = [(i, ["company", "concept", "source"][i % 3], "s", "t", int(i == 0), "x/y", "low", "a") for i in range(30)]
    pages = spark.createDataFrame(rows, "id long, type string, source_id string, title string, deleted int, slug string, confidence string, alias_csv string")
    monkeypatch.setattr(catalog, "derive", lambda spark, sf_dir, table: pages)
    assert catalog.QUERIES["e2_pairs_scanned"](spark, "").collect()[0][0] == 9 * 8 // 2 + 10 * 9 // 2


def test_suggestions_don_t_shuffle_pairs(spark):
    """Each of 40 hints is like each of 3000 titles: only a block's best rows leave it."""
    titles = spark.range(3000).select("id", F.concat(F.lit("steel ring number "), F.col("id").cast("string")).alias("title"))
    hints = spark.range(40).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("hint_id"), F.concat(F.lit("steel ring "), F.col("id").cast("string")).alias("text"))
    df = search.fuzzy_suggest(hints, titles, 0.15, 3)
    plan = df._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "array_intersect" not in plan
    got = df.where("hint_id = 'h7'").orderBy("rank").collect()
    grams = lambda s: {f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)}
    near = lambda i: round(len(grams("steel ring 7") & grams(f"steel ring number {i}")) / len(grams("steel ring 7") | grams(f"steel ring number {i}")), 6)
    assert [(r["id"], r["similarity"]) for r in got] == [(i, near(i)) for i in sorted(range(3000), key=lambda i: (-near(i), i))[:3]]
    assert df.count() == 120


def test_a_page_s_chunks_meet_its_queries_in_tiles(spark, monkeypatch):
    for name, size in (("ASKED", 3), ("CHUNKS", 8), ("COUNTED", 3), ("REMEMBERED", 5)):
        monkeypatch.setattr(hybrid, name, size)
    rng = random.Random(5)
    words = ["alpha", "alphabet", "beta", "gamma", "gam-ma", "delta", "omega", "ñandú", "光学"]
    rows = [(i, 100 + i % 3, rng.choice([None, 0, 1, 2]), rng.choice([None, " ".join(rng.choices(words, k=4))]) if i % 9 == 0 else " ".join(rng.choices(words, k=4)), "companies/p") for i in range(90)]
    asked = [(k, " ".join(rng.sample(["alp", "bet", "gamma", "gam", "omega", "ñan", "光学", "zzz"], k=3))) for k in range(8)]
    chunks = spark.createDataFrame(rows, "id long, page_id long, chunk_index int, chunk_text string, slug string")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    df = hybrid.keyword_chunks(queries, search.postings(chunks.select("page_id", "chunk_text"), {"chunk_text": 0.4}), chunks, 30)
    got = {(r["query_id"], r["page_id"]): r["id"] for r in df.collect()}
    hits = lambda text, chunk: sum(any(w.startswith(t) for w in (chunk or "").split()) for t in text.split())
    want = {(k, p): min((-hits(text, c), -1 if at is None else at, i) for i, page, at, c, _ in rows if page == p)[2] for k, text in asked for p in (100, 101, 102)}
    assert got == want
    assert "startswith" not in df._jdf.queryExecution().executedPlan().toString().lower().split("mapinarrow")[0]
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()


def test_reports_are_searched_once_and_found_the_same(spark):
    """The scan against the expressions it stands for, on texts with every kind of line end, blank and heading."""
    rng = random.Random(7)
    bits = ["## ", "##", "### ", "##\t", "\n", "\n\n", "\r\n", "\r", " ", "  ", "\u0085", " ", "\x0b", "\x0c", " ", "4. New Positions", "5. Reduce / Hedge", "Q1: x", "Q4", "12.", "1. A  ", "[[sources/a]]", "[[[briefs/b]]", "WatchList", "光", "é", "##  \n", "\n## 4. New Positions\n", "\n## 5. Reduce / Hedge \n\n"]
    texts = ["", " ", "\n##", *["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(1500)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    section = lambda title: F.regexp_extract("t", rf"(?ms)^##\s+{title}\s*$(.*?)(?=^##\s+|\z)", 1)
    want = {
        "chars": F.length(F.trim(F.regexp_replace("t", r"\s+", " "))), "refs": F.regexp_count("t", F.lit(r"\[\[(sources|briefs)/")), "numbered": F.regexp_count("t", F.lit(r"(?m)^##\s+(?:Q\d|\d+\.)")),
        "titles": F.transform(F.regexp_extract_all("t", F.lit(r"(?m)^##\s+(.+?)\s*$"), 1), lambda x: F.trim(x)), "new": section(r"4\. New Positions"), "cut": section("5\\. Reduce / Hedge"), "disclaimer": F.col("t").rlike("(?i)watchlist|no active thesis|research brief"),
    }
    rows = df.withColumn("seen", F.arrow_udf(reviews._scan, reviews._SEEN)("t")).select("t", *[F.struct(F.col(f"seen.{k}").alias("got"), c.alias("want")).alias(k) for k, c in want.items()]).collect()
    assert len(rows) == len(texts) and [(k, r["t"]) for r in rows for k in want if r[k]["got"] != r[k]["want"]] == []
    out = df.select(F.col("id").alias("page_id"), F.lit("outputs/x").alias("slug"), F.col("t").alias("content"), F.lit(None).cast("string").alias("frontmatter"))
    plan = reviews.output_issues(out)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower()


def test_a_text_is_searched_by_all_theses_that_touch_it(spark, monkeypatch):
    monkeypatch.setattr(theses_, "TOUCHES", 3)  # a document's touches are dealt in parts
    rng = random.Random(9)
    words = ["Alpha", "beta", "ÉCLAIR", "光学", " ", "", None]
    cond = [(i, None if i == 5 else [tuple(rng.choices(words, k=3)) for _ in range(i % 3)]) for i in range(12)]
    docs = [(1, "the alphabet, an éclair"), (2, "光学 BETA"), (3, None), (4, ""), (5, "never touched")]
    touched = [(d, t) for d in (1, 2, 3, 4, 9) for t in range(13)]
    kind = "thesis_id long, validation_conditions array<struct<condition:string,title:string,summary:string>>"
    df = theses_.match_conditions(spark.createDataFrame(cond, kind), spark.createDataFrame(docs, "source_page_id long, text string"), spark.createDataFrame(touched, "source_page_id long, thesis_id long"))
    fields = lambda c: [f for f in c if f and f.strip()]
    want = {(d, t): None if own is None else [fields(c)[0] for c in own if body is not None and any(f.lower() in body.lower() for f in fields(c))] for d, body in docs[:4] for t, own in cond}
    got = {(r["source_page_id"], r["thesis_id"]): r["conditions"] for r in df.collect()}
    assert got == want and df.count() == len(want)
    # the text reaches the comparison in rows of its own
    assert "contains(" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_staged_updates_go_once_they_are_committed(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "id long, v string", ["id"], buckets=4)
    rows = lambda n, v: spark.range(n).select("id", F.lit(v).alias("v"))
    assert table.upsert(rows(20, "a"), ["id"], True, "one") and table.upsert(rows(5, "b"), ["id"], True, "two")
    assert table.upsert(rows(5, "b"), ["id"], True, "three") == 0 and table.upsert(rows(20, "c"), ["id"], True, "two") == 0
    assert sorted(tuple(r) for r in table.read().collect()) == [(i, "b" if i < 5 else "a") for i in range(20)]
    assert list((tmp_path / "t").glob("staged/*")) == [] and len(list((tmp_path / "t").glob("data/*"))) == 2
