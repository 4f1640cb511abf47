"""Literal cases of blocks, tables, fact blocks, merges, reviews, theses and the whole hybrid search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lorebase.operators import blocks as b
from lorebase.operators import entities, extraction, hybrid, lifecycle, reviews, search, similarity, tables, theses

LIMITS = {"target": 600, "list_atomic": 1200, "hard_cjk": 2500, "hard_ascii": 3000, "min_chars": 30, "overlap": 1}


def block(kind, text="", page=0, level=None, items=None, html=None, caption=None, footnote=None):
    return {"page_idx": page, "block_idx": 0, "type": kind, "level": level, "text": text, "items": [{"ilevel": 0, "prefix": "-", "text": x} for x in items] if items else None, "html": html, "caption": caption, "footnote": footnote}


def chunks(*blocks, **limits):
    return list(b.document_chunks(list(blocks), LIMITS | limits))


LONG = "A paragraph that is long enough to be kept as a chunk."


def test_noise_and_short_pieces_go():
    got = chunks(block("page_header", "Confidential"), block("page_footer", "signature"), block("page_number", "p.1"), block("paragraph", LONG))
    assert [c[3] for c in got] == [LONG]
    assert chunks() == [] and chunks(block("paragraph", "OK")) == []


def test_titles_head_what_is_below():
    got = chunks(block("title", "Top", level=1), block("title", "Mid", level=2), block("title", "Deep", level=4), block("paragraph", LONG), block("title", "New", level=1), block("paragraph", LONG))
    assert [c[2] for c in got] == [["Top", "Mid", "Deep"], ["New"]]
    assert got[0][3].startswith("Top > Mid > Deep\n\n")
    assert [c[2] for c in chunks(block("title", "Q", level=1), block("title", "Q1", level=4), block("paragraph", LONG), block("title", "Q2", level=4), block("paragraph", LONG))] == [["Q", "Q1"], ["Q", "Q2"]]


def test_paragraphs_roll_to_the_budget():
    assert len(chunks(*[block("paragraph", LONG)] * 3)) == 1
    assert len(chunks(*[block("paragraph", "a" * 400)] * 4, target=150)) == 4
    huge = chunks(block("paragraph", "x" * 8000), block("paragraph", LONG), target=500)
    assert [len(c[3]) for c in huge] == [8000, len(LONG)]
    assert [c[1] for c in chunks(block("paragraph", LONG, page=3), block("paragraph", LONG, page=4))] == [3]


@pytest.mark.parametrize(
    ("text", "limits"),
    [("中" * 6500, {}), ("x" * 22000, {}), ("\n\n".join(["中" * 1500] * 5), {}), (("中" * 800 + "。") * 8, {}), ("中" * 2000, {"hard_cjk": 200})],
)
def test_hard_limits(text, limits):
    got = chunks(block("title", "S", level=1), block("paragraph", text), min_chars=1, **limits)
    cap = limits.get("hard_cjk", 2500 if "中" in text else 3000)
    assert len(got) > 1 and all(b.token_count(c[3]) <= cap and c[3].startswith("S\n\n") for c in got)
    assert "".join(c[3][3:] for c in got).replace("\n", "") == text.replace("\n", "")
    if "。" in text:
        assert all(c[3].endswith("。") for c in got)


def test_tables_stand_alone():
    got = chunks(block("title", "H", level=1), block("paragraph", LONG), block("table", html="<table><tr><td>x</td></tr></table>", caption="Cap", footnote="note"), block("paragraph", LONG))
    assert [c[0] for c in got] == ["text", "table", "text"]
    assert got[1][3] == "H\n\nTable: Cap\n\n<table><tr><td>x</td></tr></table>\n\n(footnote: note)"
    assert chunks(block("table")) == []


def test_lists():
    assert chunks(block("list", items=["item one of the list", "item two of the list"]))[0][0] == "list"
    mixed = chunks(block("list", items=["an item of some length here"]), block("paragraph", LONG))
    assert [c[0] for c in mixed] == ["text"]
    led = chunks(block("paragraph", LONG), block("list", items=["an item that is somewhat longer than thirty characters"]))
    assert [c[0] for c in led] == ["text"]
    big = chunks(block("list", items=["y" * 1000 + f"_{i}" for i in range(10)]), list_atomic=2400)
    assert len(big) > 1 and all(c[0] == "list" for c in big)
    assert all(x[3].split("\n")[-1] == y[3].split("\n")[0] for x, y in zip(big, big[1:], strict=False))


def test_chunks_through_spark(spark):
    docs = spark.createDataFrame([(1, f"{LONG}\n\n{LONG}"), (2, None), (3, "")], "doc_id long, text string")
    got = b.chunk_documents(b.blocks_of_lines(docs)).collect()
    assert [(r["doc_id"], r["chunk_index"], r["chunk_text"], r["tokens"]) for r in got] == [(1, 0, f"{LONG}\n\n{LONG}", math.ceil((2 * len(LONG) + 2) / 4))]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", [["a", "b"], ["c", ""]]),
        ('<tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr>', [["a", "b"], ["a", "c"]]),
        ("<tr><th colspan=2>a</th></tr><tr><td>b</td><td>c</td></tr>", [["a", "a"], ["b", "c"]]),
        ('<tr><td rowspan="2" colspan="2">a</td><td>b</td></tr><tr><td>c</td></tr>', [["a", "a", "b"], ["a", "a", "c"]]),
        ("<tr><td>A &amp; B</td><td>x&nbsp;<b>y</b>\n z</td><td>&#65;</td></tr>", [["A & B", "x y z", "A"]]),
        ("<table></table>", []),
    ],
)
def test_grids(html, want):
    assert tables.grid(html) == want


def test_empty_tables_leave_gaps(spark):
    rows = [(1, 0, i, "table", None, None, None, h, None, None) for i, h in enumerate(["<tr><td>a</td></tr>", "<table></table>", "<tr><td>b</td></tr><tr><td>c</td></tr>"])]
    t = tables.extract_tables(spark.createDataFrame(rows, "doc_id long, page_idx int, block_idx int, type string, level int, text string, items array<string>, html string, caption string, footnote string"))
    assert {(r["table_id"], tuple(r["headers"]), len(r["rows"])) for r in t.collect()} == {("t1", ("a",), 0), ("t3", ("b",), 1)}


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("date", "summary", "want"), [("2026-07-01", "2H26 expected ramp", True), ("2026-04-15", "earnings release", False), ("2026-01-01", "ship it", False)])
def test_placeholder_dates(spark, date, summary, want):
    assert one(spark, date, lambda c: extraction.suspicious_date(c, F.lit(summary))) is want


def test_fact_blocks(spark):
    good = "x\n<!-- facts\n- entity: companies/a\n  metric: 'rev: total'\n  value: 1,200  # as told\n  period: 2020\n# note\n- entity: b\n  metric: m\n-->"
    rows = [(1, good), (2, "<!-- facts\nfacts: [\n-->"), (3, "none"), (4, None), (5, "<!-- facts\n- entity: a\nbad line\n-->")]
    got = extraction.parse_fact_blocks(spark.createDataFrame(rows, "page_id long, content string")).collect()
    assert [tuple(r) for r in got] == [(1, 0, "companies/a", "rev: total", "2020", "1,200", None, None)]


def test_proposed_facts(spark):
    pages = spark.createDataFrame([(1, "[[companies/a|A]] share may approach 20%. [[companies/b]] price is 100000.")], "page_id long, content string")
    rows = [(1, 0, "companies/a", "market_share", "2026E", "~20%", "pct", "SHARE may\napproach 20%"), (1, 1, "companies/c", "market_share", "2026E", "10", "pct", "share may approach"), (1, 2, "companies/b", "quote", None, "dominant", None, "price is 100000"), (1, 3, "companies/b", "price", None, "100000", None, "invented quote"), (1, 4, "companies/b", "price", "current", "100000", None, "price is 100000")]
    proposed = spark.createDataFrame(rows, "page_id long, pos int, entity string, metric string, period string, value string, unit string, source_quote string")
    there = spark.createDataFrame([(1, "companies/b", "price", "current")], "page_id long, entity string, metric string, period string")
    judged = extraction.judge_proposed_facts(proposed, pages, there)
    assert [r["reason"] for r in judged.orderBy("pos").collect()] == [None, "entity", "schema", "hallucinated", "duplicate"]
    assert {tuple(r) for r in extraction.drop_counts(judged).collect()} == {("kept", 1), ("entity", 1), ("schema", 1), ("hallucinated", 1), ("duplicate", 1)}


def test_evidence(spark):
    pages = spark.createDataFrame([(1, "aaa bbb  ccc (x) ddd <!-- facts\n bbb -->eee")], "page_id long, content string")
    facts = spark.createDataFrame([(1, 1, "bbb ccc"), (2, 1, "ddd (note)"), (3, 1, "zzz"), (4, 1, " ")], "fact_id long, page_id long, source_quote string")
    got = {r["fact_id"]: r["context"] for r in extraction.evidence_context(facts, pages, 4).collect()}
    assert got == {1: "aaa bbb ccc (x)...", 2: "...(x) ddd eee", 3: "zzz", 4: None}


def test_chains_and_cycles_of_merges(spark):
    pairs = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 9), (11, 12), (12, 13), (13, 11), (10, 12), (21, 30), (21, 22)], "old long, new long")
    got = {r["old"]: r["new"] for r in entities.merge_mapping(pairs).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 10: 11, 12: 11, 13: 11, 21: 22}


PAGE = "id long, source_id string, slug string, type string, title string, display_name string, content string, alias_csv string, ticker string, exchange string, confidence string, entity_state string, completeness_score double, create_date date, deleted int"


def graph(spark):
    from datetime import date

    old = date(2020, 1, 1)
    pages = [
        (1, "s", "companies/acme", "company", "Acme", "Acme", "Acme makes rings and other things.", "Acme,AC", None, None, "high", "compiled", 0.8, old, 0),
        (2, "s", "companies/acme-inc", "company", "Acme Inc", None, "", "acme,ACM", None, None, "low", "stub", 0.1, old, 0),
        (3, "s", "companies/weak", "company", "Weak", None, "short", "Weak,W", None, None, "low", "stub", 0.1, old, 0),
        (4, "s", "companies/alone", "company", "Alone", None, "short", "Alone", None, None, "low", "stub", 0.1, old, 0),
        (9, "s", "sources/a", "source", "A", None, "x", "", None, None, "medium", "compiled", 0.0, old, 0),
    ]
    links = [(1, 9, 2, 9, "mention", "markdown", "facts_block", 1.2, old, 0), (2, 9, 1, 9, "mention", "markdown", None, 0.3, old, 0), (3, 9, 3, 9, "mention", "markdown", None, 0.3, old, 0), (4, 2, 1, 2, "confirms", "manual", None, 1.0, old, 0)]
    e = lambda schema: spark.createDataFrame([], schema)
    return {
        "pages": spark.createDataFrame(pages, PAGE),
        "links": spark.createDataFrame(links, "id long, from_page_id long, to_page_id long, origin_page_id long, link_type string, link_source string, origin_field string, weight double, create_time date, deleted int"),
        "facts": spark.createDataFrame([(1, 1, 9, "m", 0), (2, 2, 9, "m", 0)], "id long, entity_page_id long, source_page_id long, metric string, deleted int"),
        "timeline": e("id long, entity_page_id long, source_page_id long, event_date date, summary string, deleted int"), "signals": e("id long, entity_page_id long, source_page_id long, deleted int"),
        "theses": e("page_id long, target_page_id long"), "tags": spark.createDataFrame([(1, 1, "t", 0), (2, 2, "t", 0), (3, 2, "u", 0)], "id long, page_id long, tag string, deleted int"),
    }


def test_merge_of_all_tables(spark):
    out = lifecycle.apply_merges(graph(spark), spark.createDataFrame([(2, 1)], "old long, new long"), "same", "2024-01-01")
    assert {(r["id"], r["from_page_id"], r["to_page_id"], r["deleted"]) for r in out["links"].collect()} == {(1, 9, 1, 1), (2, 9, 1, 0), (3, 9, 3, 0), (4, 1, 1, 1)}
    assert {(r["id"], r["entity_page_id"], r["deleted"]) for r in out["facts"].collect()} == {(1, 1, 0), (2, 1, 1)}
    assert {(r["id"], r["page_id"], r["deleted"]) for r in out["tags"].collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 0)}
    page = {r["id"]: r for r in out["pages"].collect()}
    assert page[2]["deleted"] == 1 and page[1]["alias_csv"] == "Acme,AC,ACM,Acme Inc,acme-inc" and page[1]["content"] == "Acme makes rings and other things."
    assert {(r["entity_id"], r["action"]) for r in out["events"].collect()} == {(1, "page_merge_canonical"), (2, "page_merge_duplicate")}


def test_cleanup_and_demotion(spark):
    none = spark.createDataFrame([], "a long, b long, similarity double")
    tables_, done = lifecycle.auto_cleanup(graph(spark), lambda pages: none, "2024-01-01")
    assert {tuple(r) for r in done.collect()} == {("merge", 2, 1), ("retire", 4, None)}
    assert {r["id"] for r in tables_["pages"].where("deleted = 0").collect()} == {1, 3, 9}
    out = lifecycle.demote_to_candidates(graph(spark), "2024-01-01")
    assert [tuple(r) for r in out["candidates"].collect()] == [("companies/weak", 1, "W,Weak", "pending")]
    assert {r["id"] for r in out["links"].where("deleted = 1").collect()} == {3}
    assert {r["id"] for r in out["pages"].where("deleted = 1").collect()} == {3}


def source_page(facts=True):
    parts = [f"## {s}\n\nSomething of substance is said here, at length.\n" for s in reviews.PROFILES["source"][2]]
    body = "".join(parts) + "### New Information\n[[sources/a]]\n### Confirms Existing View\n[[companies/b|B]]\n### Contradictions / Revisions\nnone\n" + "Words to fill it up. " * 60
    return body + ("\n<!-- facts\n- entity: companies/b\n  metric: m\n  value: 1\n-->\n" if facts else "") + "<!-- entity_plan\nexisting: []\n-->"


def test_reviews(spark):
    front = '{"research_id":"1","research_type":"report","markdown_url":"u"}'
    rows = [(1, "source", source_page(), front, ""), (2, "source", source_page(False), '{"research_type":"meeting_minutes","research_id":" ","primary_entities":["concepts/x"]}', "- date: soon"), (3, "note", "x", None, None), (4, "source", "", None, "- date: 2026-07-01\n  event_type: news\n  summary: expected")]
    pages = spark.createDataFrame(rows, "page_id long, type string, content string, frontmatter string, timeline string")
    issues = {}
    for r in reviews.review_issues(pages).collect():
        issues.setdefault(r["page_id"], set()).add(r["code"])
    assert issues == {
        2: {"missing_facts_block", "missing_frontmatter_key", "missing_meeting_minutes_section", "meeting_minutes_missing_facts_block", "primary_entities_soft_entity", "invalid_timeline_yaml"},
        3: {"no_profile"},
        4: {"content_too_short", "missing_section", "missing_frontmatter_key", "too_few_wikilinks", "missing_facts_block", "missing_relation_subsections", "missing_entity_plan", "approximate_timeline_date"},
    }
    assert {r["page_id"]: r["status"] for r in reviews.review_pages(pages).collect()} == {1: "pass", 2: "fail", 3: "pass", 4: "fail"}


def test_report_documents(spark):
    heads = "".join(f"## {s}\n\n[[sources/x]] text\n\n" for s in reviews.OUTPUT_PROFILES["daily-review"][2])
    front = '{"type":"output","subtype":"daily-review","title":"t","date":"d","sources":["a"],"tags":["b"],"last_updated":"n"}'
    out = spark.createDataFrame([(1, "outputs/daily-review-1", heads + "word " * 1100, front), (2, "outputs/daily-review-2", heads, front), (3, "outputs/daily-review-3", "", None)], "page_id long, slug string, content string, frontmatter string")
    codes = {(r["page_id"], r["code"]) for r in reviews.output_issues(out).collect()}
    assert {c for c in codes if c[0] < 3} == {(2, "short_output")}
    assert [(r["page_id"], r["status"]) for r in reviews.output_backlog(out).collect()] == [(3, "fail"), (2, "pass"), (1, "pass")]


def test_conditions(spark):
    t = spark.createDataFrame([(1, [("Margin up", None, None), (" ", "Deal", None), (None, None, "never")])], "thesis_id long, validation_conditions array<struct<condition:string,title:string,summary:string>>")
    docs = spark.createDataFrame([(5, "the margin UP after the deal")], "source_page_id long, text string")
    touch = spark.createDataFrame([(5, 1)], "source_page_id long, thesis_id long")
    assert theses.match_conditions(t, docs, touch).first()["conditions"] == ["Margin up", "Deal"]


def test_word_similarity(spark):
    def plain(part, text):
        grams = lambda s: [g for w in __import__("re").findall(r"\w+", s.lower()) for p in [f"  {w} "] for g in (p[i : i + 3] for i in range(len(p) - 2))]
        a, run = set(grams(part)), grams(text)
        best = 0.0
        for i in range(len(run)):
            for j in range(i, len(run)):
                piece = set(run[i : j + 1])
                best = max(best, len(a & piece) / len(a | piece))
        return best

    rng = random.Random(1)
    words = ["ring", "wing", "window", "steel", "bright", "brig", "widget"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(1, 2))), " ".join(rng.choices(words, k=rng.randint(1, 4)))) for _ in range(30)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.word_similarity(F.col("a"), F.col("b")).alias("s"))
    assert all(abs(r["s"] - plain(r["a"], r["b"])) < 1e-9 for r in df.collect())


def test_fuzzy_and_similar_pairs_lose_none(spark):
    rng = random.Random(2)
    words = ["ring", "wing", "window", "steel", "bright", "brig", "widget", "pipe", "cold"]
    titles = [(i, "x", " ".join(rng.choices(words, k=rng.randint(1, 5)))) for i in range(120)]
    grams = lambda s: {f"  {w} "[i : i + 3] for w in s.lower().split() for i in range(len(w) + 1)}
    df = spark.createDataFrame(titles, "id long, type string, title string")
    sim = lambda s, t: len(grams(s) & grams(t)) / len(grams(s) | grams(t))
    first = {}
    for i, _, t in titles:
        first.setdefault(t, i)
    want = {(min(i, j), max(i, j)) for s, i in first.items() for t, j in first.items() if i < j and sim(s, t) >= 0.6}
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(df, "title", ["type"], 0.6).collect()} == want
    hints = spark.createDataFrame([(1, "brigt ring"), (2, "windows"), (3, "")], "hint_id long, text string")
    got = search.fuzzy_suggest(hints, df.select("id", "title"), 0.15, 5).collect()
    for h, text in ((1, "brigt ring"), (2, "windows")):
        best = sorted(((-round(sim(text, t), 6), i) for i, _, t in titles if sim(text, t) >= 0.15))[:5]
        assert [(r["similarity"], r["id"]) for r in got if r["hint_id"] == h] == [(-s, i) for s, i in best]


def test_hits_are_thinned(spark):
    rows = [
        (1, 10, 1, 1.0, "company", "text", "one two three four five six seven", 2), (1, 10, 2, 0.9, "company", "text", "other words here", 2), (1, 10, 3, 0.8, "company", "text", "more words there", 2), (1, 10, 4, 0.7, "company", "compiled_truth", "compiled", 2),
        (1, 20, 5, 0.95, "concept", "text", "ONE two three four five six seven", 2), (1, 20, 6, 0.2, "concept", "text", "unlike any", 2), (1, 30, 7, 0.1, "concept", "text", "last of all", 2),
    ]
    df = spark.createDataFrame(rows, "query_id long, page_id long, id long, score double, type string, chunk_type string, chunk_text string, per_page int")
    assert sorted(r["id"] for r in hybrid.dedupe_hits(df).collect()) == [1, 4, 6, 7]


def test_hybrid_search_in_plain_python(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta"]
    chunk_rows = [(i, 100 + i % 6, i // 6, " ".join(rng.choices(words, k=12)), "compiled_truth" if i % 7 == 0 else "text", "companies/p" if i % 2 else "sources/MS-p", "company" if i % 2 else "source") for i in range(40)]
    vec = {i: [rng.uniform(-1, 1) for _ in range(6)] for i in range(40) if i % 5}
    queries = [(1, "alpha omega"), (2, "latest gamma zeta")]
    qvec = {1: [rng.uniform(-1, 1) for _ in range(6)], 2: [rng.uniform(-1, 1) for _ in range(6)]}
    chunks_ = spark.createDataFrame(chunk_rows, "id long, page_id long, chunk_index int, chunk_text string, chunk_type string, slug string, type string")
    vectors = spark.createDataFrame([(1000 if i is None else i, v) for i, v in vec.items()], "id long, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, text string")
    qv = spark.createDataFrame([(k, v) for k, v in qvec.items()], "query_id long, embedding array<double>")
    back = spark.createDataFrame([(101, 10)], "page_id long, backlinks long")
    index = search.postings(chunks_.select("page_id", "chunk_text"), {"chunk_text": 0.4})
    kw = {(r["query_id"], r["id"]): r["rn"] for r in hybrid.keyword_chunks(q, index, chunks_, 30).collect()}
    nearest = {(r["query_id"], r["id"]): r["rn"] for r in hybrid.vector_chunks(qv.where("query_id < 0").unionByName(qv), chunks_, vectors.withColumn("id", F.col("id")), 30).collect()}
    cos = lambda a, c: sum(x * y for x, y in zip(a, c, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in c))
    by = {r[0]: r for r in chunk_rows}
    got = {}
    for r in hybrid.hybrid_chunks(q, qv, index, chunks_, vectors, back, limit=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 4)))
    for k, natural in ((1, False), (2, True)):
        s = {}
        for ranks in (kw, nearest):
            for (qq, i), rn in ranks.items():
                if qq == k:
                    s[i] = s.get(i, 0) + 1 / (60 + rn - 1)
        top = max(s.values())
        s = {i: x / top * (2 if by[i][4] == "compiled_truth" and not natural else 1) for i, x in s.items()}
        top = max(s.values())
        s = {i: round(0.7 * x / top + 0.3 * (cos(qvec[k], vec[i]) if i in vec else 0.5), 5) for i, x in s.items()}
        s = {i: round(x * (min(1 + 0.05 * math.log(11), 1.5) if by[i][1] == 101 else 1), 6) for i, x in s.items()}
        hits = [(k, by[i][1], i, x, by[i][6], by[i][4], by[i][3], 3 if natural else 2) for i, x in s.items()]
        thin = hybrid.dedupe_hits(spark.createDataFrame(hits, "query_id long, page_id long, id long, score double, type string, chunk_type string, chunk_text string, per_page int")).collect()
        best = {}
        for r in sorted(thin, key=lambda r: (-r["score"], r["id"])):
            best.setdefault(r["page_id"], (r["id"], round(r["score"], 4)))
        want = [(n + 1, i, x) for n, (i, x) in enumerate(sorted(best.values(), key=lambda p: (-p[1], p[0]))[:3])]
        assert sorted(got[k]) == want
