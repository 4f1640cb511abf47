"""The pipeline's stages and its registration."""

import collections
import itertools
import re

import __spark_entry__ as entry
import corpus_pipeline
from lorebase.llm import catalog

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert {n for n in names if n.startswith("op")} == set(catalog.QUERIES) and "pipeline" in names
    assert set(catalog.ORACLES) <= names


def test_stages_keep_the_columns_and_act(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, kept = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString(), name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        rows.append(kept.count())
    assert rows == sorted(rows, reverse=True) and rows[-1] < rows[0]
    assert kept.select("doc_id").distinct().count() == rows[-1]
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert set(docs.columns) < set(last.columns) and last.where("copies < 1 or copies > 2").isEmpty()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def brute_force(rows, items):
    """What the first four stages keep: {doc_id: text}."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    texts = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    sets = {}
    for i, t in texts.items():
        w = word.findall(lower(t))
        sets[i] = set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)}
    root = {i: i for i in sets}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    texts = {i: t for i, t in texts.items() if top(i) == i}
    words = {i: word.findall(t) for i, t in texts.items()}
    times = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    kept = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 34) if times[tuple(w[k : k + 35])] > 1 for j in range(35)}
        if len(gone) < len(w):
            kept[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else texts[i]
    plain = lambda t: " " + " ".join(re.sub(r"[\W_]+", "", x) for x in t.lower().split() if re.sub(r"[\W_]+", "", x)) + " "
    return {i: t for i, t in kept.items() if not any(plain(x) in plain(t) for x in items)}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
    want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == want
    mixed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in mixed} <= set(want) and all(r["text"] == want[r["doc_id"]] for r in mixed)
