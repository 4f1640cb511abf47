"""Small literal cases of single operators."""

import random

import pytest
from pyspark.sql import functions as F

from lorebase.functions import text as t
from lorebase.operators import chunking, entities, facts, graph, ingest, search, similarity


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "metric", "unit", "want"),
    [("300+", "units", None, (None, "300+")), (">60%", "gross_margin", None, (None, ">60%")), ("100000-130000", "units", None, (None, "100000-130000")), ("50,000", "units", None, (50000.0, None)), ("20", "gross_margin", None, (0.2, None)), ("1.2", "gross_margin", None, (1.2, None)), ("-5", "growth", "pct", (-5.0, None)), ("abc", "units", None, (None, "abc"))],
)
def test_fact_values(spark, value, metric, unit, want):
    got = one(spark, value, lambda c: t.fact_value(c, F.lit(metric), F.lit(unit).cast("string")))
    assert (got["numeric"], got["text"]) == want


@pytest.mark.parametrize(("text", "want"), [("GM", "gross_margin"), ("GM (%)", "gross_margin"), ("R&D", "r_and_d"), ("毛利率", None), ("", None), ("**Rev**", "revenue")])
def test_metrics(spark, text, want):
    assert one(spark, text, t.metric_key) == want


@pytest.mark.parametrize(("text", "want"), [("USD bn", "usd_bn"), ("%", "pct"), ("x", "x"), ("cny_per_card", "cny"), ("widgets", "widgets"), ("boxes", "x"), ("", None)])
def test_units(spark, text, want):
    assert one(spark, text, t.unit_key) == want


@pytest.mark.parametrize(("text", "want"), [("FY26E", "FY2026E"), ("26a", "FY2026A"), ("1Q26A", "1Q2026A"), ("h126e", "H12026E"), ("ttm", "TTM"), ("Current", "current"), ("2026-04-15", "2026-04-15"), ("", None)])
def test_periods(spark, text, want):
    assert one(spark, text, t.period_key) == want


@pytest.mark.parametrize(
    ("cell", "want"),
    [("$12 bn", (12.0, None, "usd_bn")), ("15%", (15.0, None, "pct")), ("n/a", None), ("-", None), ("1,234", (1234.0, None, None)), ("8x", (8.0, None, "x")), ("about 5", (None, "about 5", None)), ("¥30", (30.0, None, "jpy")), ("", None)],
)
def test_value_cells(spark, cell, want):
    got = one(spark, cell, t.value_cell)
    assert (got and (got["numeric"], got["text"], got["unit"])) == want


def test_tokens(spark):
    assert one(spark, "abcdefgh", t.estimate_tokens) == 2 and one(spark, "漢字漢", t.estimate_tokens) == 2 and one(spark, "", t.estimate_tokens) == 0


def test_effective_links_keep_unknown_apart(spark):
    rows = [(0.3, "mention", "markdown", None), (0.95, "mention", "markdown", None), (0.3, "mention", "markdown", "facts_block"), (0.3, "mention", "frontmatter", "primary_entities"), (0.3, "mention", "markdown", "other")]
    df = spark.createDataFrame(rows, "weight double, link_type string, link_source string, origin_field string")
    assert [r["e"] for r in df.select(graph.is_effective().alias("e")).collect()] == [None, True, True, True, False]


def test_link_weights(spark):
    rows = [("mention", "extracted", "facts_block", 1.2), ("mention", "frontmatter", "primary_entities", 1.0), ("confirms", "markdown", None, 1.0), ("mention", "extracted", None, 0.7), ("mention", "frontmatter", None, 0.6), ("mention", "markdown", None, 0.3), ("mention", "other", None, 0.5)]
    df = spark.createDataFrame(rows, "link_type string, link_source string, origin_field string, want double")
    assert all(r["w"] == r["want"] for r in df.select(graph.default_weight().alias("w"), "want").collect())


def test_merge_facts_closes_in_order(spark):
    schema = "id long, entity_page_id long, metric string, period string, value_numeric double, valid_from date"
    import datetime

    day = datetime.date(2020, 1, 1)
    current = spark.createDataFrame([(1, 1, "m", None, 5.0, day), (2, 2, "m", "p", 7.0, day)], schema)
    new = spark.createDataFrame([(1, "m", None, 6.0, 1), (1, "m", None, 8.0, 2), (2, "m", "p", 7.0, 3)], "entity_page_id long, metric string, period string, value_numeric double, pos long")
    got = sorted((r["entity_page_id"], r["value_numeric"], r["action"], str(r["valid_to"])) for r in facts.merge_facts(current, new, "2021-01-01").collect())
    assert got == [(1, 5.0, "closed", "2021-01-01"), (1, 6.0, "inserted", "2021-01-01"), (1, 8.0, "inserted", "None"), (2, 7.0, "kept", "None")]


def test_drift_skips_the_middle(spark):
    rows = [(i, 1, "m", v, f"2020-01-0{i}", 0) for i, v in enumerate((1.0, 100.0, 2.0), 1)]
    df = spark.createDataFrame(rows, "id long, entity_page_id long, metric string, value_numeric double, valid_from string, deleted int")
    r = facts.drift(df).first()
    assert (r["drift_pct"], r["trend"]) == (1.0, "rising")
    assert facts.drift(df.limit(1)).first()["trend"] == "insufficient_data"


def test_upsert_is_null_safe(spark):
    target = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k long, s string, v string")
    new = spark.createDataFrame([(1, None, "c"), (3, "y", "d"), (3, "y", "e")], "k long, s string, v string")
    rows = lambda replace: sorted((r["k"], r["v"]) for r in ingest.upsert(target, new, ["k", "s"], ["v"], replace).collect())
    assert rows(False) == [(1, "a"), (2, "b"), (3, "d")] and rows(True) == [(1, "c"), (2, "b"), (3, "d")]


def test_merge_chains(spark):
    got = {r["old"]: r["new"] for r in entities.merge_mapping(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "old long, new long")).collect()}
    assert got == {1: 4, 2: 4, 3: 4, 9: 8}


@pytest.mark.parametrize(("slug", "want"), [("companies/unknown-x", "generic-placeholder"), ("companies/acme-unknown", "generic-placeholder"), ("companies/major-bank", "generic-descriptor"), ("companies/suppliers", "generic-role"), ("companies/", "empty-name"), ("companies/acme", None)])
def test_auto_reject(spark, slug, want):
    assert one(spark, slug, entities.auto_reject_reason) == want


def test_similar_pairs_find_what_all_pairs_find(spark):
    r = random.Random(3)
    words = ["alpha", "alphas", "beta", "gamma", "gammas", "delta", "deltas", "omega"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(120)]
    df = spark.createDataFrame([(i, "g", x) for i, x in enumerate(texts)], "id long, type string, title string")

    def grams(x):
        return {f"  {w} "[k : k + 3] for w in x.split() for k in range(len(w) + 1)}

    first = {}
    for i, x in enumerate(texts):
        first.setdefault(x, i)
    for least in (0.5, 0.7, 0.9):
        want = set()
        for a, i in first.items():
            for b, j in first.items():
                s = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
                if i < j and s >= least:
                    want.add((i, j))
        assert {(r["a"], r["b"]) for r in similarity.similar_pairs(df, "title", ["type"], least).collect()} == want


def test_query_terms(spark):
    assert one(spark, "What is the GPU-demand of site:x.com Nvidia, nvidia in 漢?", search.query_terms) == ["gpu-demand", "nvidia", "漢"]


@pytest.mark.parametrize(("text", "want"), [("who is X", "entity"), ("latest on X", "temporal"), ("X raised $5", "event"), ("everything about X", "temporal"), ("X margins", "general"), ("X是谁", "entity")])
def test_intents(spark, text, want):
    assert one(spark, text, search.intent) == want


def test_metrics_of_a_ranking(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, page_id long, rn int")
    qrels = spark.createDataFrame([(1, 11, 1), (1, 99, 1), (2, 5, 1)], "query_id long, page_id long, grade long")
    r = {x["query_id"]: x for x in search.evaluate(hits, qrels, 5).collect()}
    assert (r[1]["precision"], r[1]["recall"], r[1]["mrr"], r[1]["ndcg"]) == (0.2, 0.5, 0.5, pytest.approx(0.63093 / 1.63093, abs=1e-4))
    assert r[2]["ndcg"] == 0


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "\n".join(["x" * 400] * 9)), (2, "short"), (3, "y" * 4000 + "\n" + "z" * 100), (4, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["chunk_index"], r["tokens"]) for r in chunking.chunk_documents(docs).orderBy("doc_id", "chunk_index").collect()]
    assert got == [(1, 0, 600), (1, 1, 300), (3, 0, 1000), (3, 1, 25)]
