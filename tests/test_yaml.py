"""The YAML reader: literal documents, structures against PyYAML where it is there, and columns."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorebase.functions import yaml
from lorebase.functions.yaml import YamlError, parse, text_of
from lorebase.operators import extraction as x
from lorebase.operators import reviews


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("- a: 1\n  b: x # c\n- a: 2024-01-01", [{"a": 1, "b": "x"}, {"a": "2024-01-01"}]),
        ("a:\n- 1\n- 2.50\nb: ~\nc: true", {"a": [1, 2.5], "b": None, "c": True}),
        ("- - 1\n  - [2, {x: y}]\n-\n- k:\n    - z", [[1, [2, {"x": "y"}]], None, {"k": ["z"]}]),
        ("a: \"x: y # z\\n\\u00e9\"\nb: 'it''s'\nc: http://h/p?q=1#f", {"a": "x: y # z\né", "b": "it's", "c": "http://h/p?q=1#f"}),
        ("a: |\n  one\n    two\n\n  three\nb: >-\n  folded\n  text\n\n  para\nc: 1", {"a": "one\n  two\n\nthree\n", "b": "folded text\npara", "c": 1}),
        ("a: plain\n  goes on\n\n  here\nb: [1,\n  2, # two\n  3]\n", {"a": "plain goes on\nhere", "b": [1, 2, 3]}),
        ('"q: k": 1', {"q: k": 1}),
        ("---\na: -1\n...\n", {"a": -1}),
        ("", None),
        ("just text", "just text"),
    ],
)
def test_documents(text, value):
    assert parse(text) == value


@pytest.mark.parametrize("text", ["facts: [", "a: b: c", "a: 1\na: 2", "\t- a: 1", "- a: 1\n b: 2", "a: *x", "a: &x 1", "a: !t 1", "a: 'open", "a: [1 2", "[" * 100 + "]" * 100, "a: 1\n  b: 2", "a: \"\\q\"", "a: [1] x"])
def test_malformed(text):
    with pytest.raises(YamlError):
        parse(text)


def test_numbers_as_text():
    assert [text_of(v) for v in (2020, 1.0, 1e21, 0.5, 1e-7, True, None, "x", [1, {"a": None}])] == ["2020", "1", "1e+21", "0.5", "1e-7", "true", None, "x", '[1, {"a": null}]']


plain = st.from_regex(r"[A-Za-z][A-Za-z0-9/._-]{0,8}", fullmatch=True)
values = st.recursive(plain, lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(plain, v, max_size=3)), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(values, st.booleans())
def test_same_structure_as_the_library(value, flow):
    library = pytest.importorskip("yaml")
    text = library.safe_dump(value, default_flow_style=flow, width=30)
    leaves = lambda v: {k: leaves(x) for k, x in v.items()} if isinstance(v, dict) else [leaves(x) for x in v] if isinstance(v, list) else text_of(v) or ""
    assert leaves(parse(text)) == leaves(library.load(text, library.BaseLoader))


def test_long_and_many_lines():
    n = 20_000
    assert len(parse("\n".join(f"- a: [{i},\n    'x y']\n  b: \"t: {i}\"" for i in range(n)))) == n
    assert parse("a: " + "x" * 1_000_000)["a"] == "x" * 1_000_000


def test_columns(spark):
    rows = [(1, "- entity: companies/a\n  metric: m\n  value: 10\n  period: 2020\n  tags: [a, b]\n  source_quote: \"ratio 3: 4\"\n- metric: lost\n- plain"), (2, "facts: ["), (3, None), (4, "a: 1"), (5, "")]
    df = spark.createDataFrame(rows, "page_id long, text string")
    got = {r["page_id"]: r["x"] for r in df.select("page_id", yaml.records(F.col("text"), x.FACT_KEYS).alias("x")).collect()}
    assert [tuple(v) for v in got[1]] == [("companies/a", "m", "2020", "10", None, "ratio 3: 4"), (None, "lost", None, None, None, None)]
    assert all(got[i] == [] for i in (2, 3, 4, 5))
    blocks = df.select("page_id", F.concat(F.lit("text\n<!-- facts\n"), "text", F.lit("\n-->\nmore")).alias("content"))
    assert [(r["page_id"], r["pos"], r["value"], r["source_quote"]) for r in x.parse_fact_blocks(blocks).collect()] == [(1, 0, "10", "ratio 3: 4")]


def test_events_need_texts(spark):
    rows = [(1, "- entity: companies/a\n  date: 2024-05-17\n  event_type: news\n  summary: \"A: b\"\n  detail: |\n    one\n    two"), (2, "- date: 2024\n  event_type: news\n  summary: s\n- date: 2024-05-18\n  event_type: [news]\n  summary: s\n- date: 2024-05-19\n  event_type: odd\n  summary: 5")]
    known = spark.createDataFrame([("companies/a", 9)], "slug string, id long")
    got = x.parse_timeline(spark.createDataFrame(rows, "page_id long, timeline string"), known).collect()
    assert [(r["entity_page_id"], str(r["event_date"]), r["summary"], r["detail"]) for r in got] == [(9, "2024-05-17", "A: b", "one\ntwo\n")]


def test_entity_plans(spark):
    plans = {
        1: "existing:\n  - slug: companies/M\n    role: primary_company\nnew_company_candidates: []\nsoft_candidates:\n  - type: industry\n    label: Memory\nnoise_mentions: []",
        2: "new_company_candidates:\n  - proposed_slug: concepts/x\n  - proposed_slug: companies/y\n  - plain\nsoft_candidates:\n  - {type: company}\n  - {type: company}\n  - {type: 5}",
        3: "- a", 4: "a: b: c", 5: "  ",
    }
    rows = [(k, "source", f"<!-- entity_plan\n{p}\n-->") for k, p in plans.items()]
    pages = spark.createDataFrame(rows, "page_id long, type string, content string").withColumns({"frontmatter": F.lit(None).cast("string"), "timeline": F.lit(None).cast("string")})
    got = sorted((r["page_id"], r["code"], r["detail"]) for r in reviews.review_issues(pages).collect() if "plan" in r["code"])
    assert got == [(2, "invalid_entity_plan_company_candidate", "concepts/x"), (2, "invalid_entity_plan_soft_candidate", "company"), (3, "invalid_entity_plan_shape", None), (4, "invalid_entity_plan_yaml", None), (5, "empty_entity_plan", None)]
    plan = reviews.review_issues(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("Relation [") <= 1  # one pass over the pages
