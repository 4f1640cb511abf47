"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names: every operator."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebase.llm import decontamination, gru_lm, language_id, mixing, near_duplicates, quality_lm, substring_dedup, topk_search, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label string, score double, m int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abdeginorstu") for _ in range(r.randint(2, 8))) for _ in range(n))


def odd_rows():
    long = prose(1, 30_000)
    rows = [(1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "one two three"), (6, prose(2, 80)), (7, prose(2, 80)), (7, prose(2, 80)), (8, long), (9, long + " end"), (None, prose(3, 50)), (None, None), (10, "!!! 123 ..."), (11, "Ünïcödé 漢字 " * 20)]
    return [(i, t, None if (i or 0) % 3 == 0 else "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 2}", None, "x", "y", 1.0, 3) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, none):
    got = near_duplicates.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert by[4]["n_shingles"] == by[5]["n_shingles"] == 1
    assert {i: r["component_id"] for i, r in by.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 11}
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert near_duplicates.near_duplicates(none).count() == 0
    assert near_duplicates.keep_first(docs).columns == docs.columns
    assert near_duplicates.keep_first(docs).count() == docs.count() - 3


def test_substring_dedup(docs, none):
    done = substring_dedup.drop_repeats(docs)
    got = done.select("doc_id", "__n_words", "__n_removed", "m").collect()
    assert len(got) == docs.count() and all(r["m"] == 3 for r in got)
    by = {r["doc_id"]: (r["__n_words"], r["__n_removed"]) for r in got if r["doc_id"] is not None}
    assert by[1] == by[2] == by[3] == (0, 0) and by[4] == (1, 0)
    assert by[6] == by[7] == (80, 80) and by[8] == (30000, 30000) and by[9] == (30001, 30000)
    assert by[11] == (40, 40)  # its own windows recur within it
    assert substring_dedup.drop_repeats(none).count() == 0


def test_crowded_anchors_give_the_same(docs):
    a, b = (substring_dedup.drop_repeats(docs, window=8, hot=h).select("doc_id", "__n_removed", "__kept_sha256").collect() for h in (0, 20_000))
    order = lambda rows: sorted(map(str, rows))
    assert order(a) == order(b)


def test_language_id(docs, none):
    teach = docs.where("lang is not null")
    model = language_id.train(teach)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect() if r["doc_id"] is not None}
    assert {i for i, r in got.items() if r["__lang_pred"] == "und"} == {1, 2, 3, 10}
    assert all(0 <= r["__lang_score"] <= 1 for r in got.values())
    assert language_id.train(none) is None
    assert {r["__lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    assert all(r["__copies"] * r["__size"] <= 2 * r["__size"] and r["__copies"] >= 0 for r in got)
    assert mixing.mix_sources(none).count() == 0


def test_toxicity(spark, docs, none):
    rows = docs.withColumn("held_out", F.lit(False))
    labels = spark.createDataFrame([(6, 0, 1), (6, 0, 0), (7, 0, None), (99, 0, 1), (None, 0, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(rows, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(rows, labels.limit(0)).count() == docs.count()
    assert toxicity.toxicity(none.withColumn("held_out", F.lit(False)), labels).count() == 0


def test_toxicity_learns_every_term(spark):
    r = random.Random(5)
    marks = ["".join("bcdfghjklm"[int(d)] for d in f"{k:04d}") + "xq" for k in range(700)] + ["zq"]
    toxic = [[] for _ in range(240)]
    for k, word in enumerate(marks):
        for i in range(6):
            toxic[(k * 7 + i * 37) % 240].append(word)
    rows = [(i, prose(i, 30) + " " + " ".join(own), False) for i, own in enumerate(toxic)] + [(1000 + i, prose(2000 + i, 30), False) for i in range(1400)]
    rows += [(5000 + k, prose(9000 + k, 30) + f" {word} {word}", True) for k, word in enumerate(marks)] + [(6000 + k, prose(12000 + k, 30), True) for k in range(300)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _, h in rows if not h], "doc_id long, toxic int")
    got = {r["doc_id"]: tuple(r) for r in toxicity.toxicity(docs, labels).collect()}
    any_ = toxicity.toxicity(docs, labels).where("held_out and any > 0").select("doc_id")
    found = {r[0] for r in any_.collect()}
    assert {5000 + k for k in range(len(marks))} <= found
    shards = {r["doc_id"]: tuple(r) for r in toxicity.toxicity(docs, labels, bound=1500).collect()}
    assert got.keys() == shards.keys() and all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-6) for a, b in ((got[i], shards[i]) for i in got))


def test_lm(docs, none):
    got = gru_lm.score_documents(docs.withColumn("held_out", F.coalesce(F.col("doc_id") == 8, F.lit(False)))).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[8]["n_tokens"] == 30001
    assert all(r["score"] < 0 and r["base_score"] < 0 and r["train_tokens"] == by[1]["train_tokens"] for r in got)
    assert gru_lm.score_documents(none.withColumn("held_out", F.lit(False))).count() == 0
    only = gru_lm.score_documents(docs.withColumn("held_out", F.lit(True))).collect()
    assert len(only) == docs.count() and all(r["score"] == 0 and r["n_known"] == 0 for r in only)


def test_lm_trains_on_every_word(monkeypatch):
    texts = [" ".join(f"w{j}" for j in range(i, i + n)) for i, n in ((0, 700), (700, 1), (701, 16), (717, 40), (757, 33))]
    column = pa.array(texts)
    h, letter, c = (np.concatenate(x) for x in zip(*[[col.to_numpy() for col in b.columns] for b in gru_lm._count(iter([pa.RecordBatch.from_arrays([column], ["text"])]))], strict=True))
    v = gru_lm.Vocabulary(h, letter.astype(int), c, np.zeros(gru_lm.LETTERS))
    targets, plain = [], gru_lm.train_window

    def watched(p, x, y, h):
        assert (y[:-1] == x[1:]).all()
        targets.extend(y.ravel().tolist())
        return plain(p, x, y, h)

    monkeypatch.setattr(gru_lm, "train_window", watched)
    p = gru_lm.initial(v)
    for some in ([0, 1, 2, 3, 4], [1] * 70):  # the last few of a task teach as well
        targets.clear()
        rows = pa.RecordBatch.from_arrays([column.take(pa.array(some))], ["text"])
        (out,) = gru_lm._train(SimpleNamespace(value=(v, p)))(iter([rows]))
        want = sorted(x for _, _, w in gru_lm.word_chunks(rows.column(0), lower=True) for x in v.code(w)[0].tolist())
        assert sorted(x for x in targets if x != v.end) == want and targets.count(v.end) >= len(some)
        assert out.column(1)[0].as_py() == len(targets)


def test_lm_long_texts_do_not_end_alone(monkeypatch):
    texts = ["a b c"] * 768 + [" ".join(["a"] * 150)]
    column = pa.array(texts)
    h, letter, c = (np.concatenate(x) for x in zip(*[[col.to_numpy() for col in b.columns] for b in gru_lm._count(iter([pa.RecordBatch.from_arrays([column], ["text"])]))], strict=True))
    v = gru_lm.Vocabulary(h, letter.astype(int), c, np.zeros(gru_lm.LETTERS))
    widths, plain = [], gru_lm.train_window

    def watched(p, x, y, h):
        widths.append(x.shape[1])
        return plain(p, x, y, h)

    monkeypatch.setattr(gru_lm, "train_window", watched)
    p = gru_lm.initial(v)
    list(gru_lm._train(SimpleNamespace(value=(v, p)))(iter([pa.RecordBatch.from_arrays([column], ["text"])])))
    assert len(widths) <= 14 and sum(widths) == 768 + 10  # 22 windows where the long one runs last


def test_lm_frequent_words_end_where_a_sort_ends(spark):
    r = random.Random(3)
    rows = [(r.randrange(-(2**63), 2**63), min(50, int(r.paretovariate(1)))) for _ in range(3000)]
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    df = spark.createDataFrame(rows, "h long, c long")
    edge = sum(c > 1 for _, c in rows)
    for most in (10, edge - 1, edge, edge + 1, 2999, 3000):
        c, h = gru_lm._limit(df, most)
        assert [x for x in order if x[1] > c or (x[1] == c and x[0] <= h)] == order[:most]


def test_quality(spark, docs, none):
    trusted = spark.createDataFrame([(6,), (6,), (8,), (None,)], "doc_id long")
    got = {r["doc_id"]: r for r in quality_lm.quality(docs, trusted).collect() if r["doc_id"] is not None}
    assert len(got) == 11 and got[6]["keep"] and not got[1]["keep"] and got[2]["perplexity"] is None and not got[10]["keep"]
    assert quality_lm.quality(docs, trusted.limit(0)).where("keep").count() == 10
    assert quality_lm.quality(none, trusted).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, prose(2, 40)), (1, prose(2, 40)), (2, None), (3, ""), (4, "one two three"), (None, prose(9, 20))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(6, 1), (7, 1), (5, 4)}
    blocks = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items, block=2).collect()}
    assert blocks == got
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0 and decontamination.contaminated(none, items).count() == 0
    assert decontamination.drop_contaminated(docs, items).columns == docs.columns


def test_decontamination_of_repetitive_and_equal_items(spark):
    refrain, row = "tell me more about it " * 12, "7 " * 30
    texts = spark.createDataFrame([(1, prose(4, 50) + " " + refrain + prose(5, 50)), (2, row), (3, "he said yes please now"), (4, prose(6, 80))], "doc_id long, text string")
    items = spark.createDataFrame([(1, refrain), (2, row), (3, "yes please"), (4, "Yes, please!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["covered"]) for r in decontamination.contaminated(texts, items).collect()}
    assert got == {(1, 1, 60), (2, 2, 30), (3, 3, 2), (3, 4, 2)}
    assert {r["doc_id"] for r in decontamination.drop_contaminated(texts, items).collect()} == {4}


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/x"), (4, "http://A.Net/x?y#z"), (5, "https://example.net/en/1"), (5, "https://example.net/en/1"), (6, "http://sub.example.com/de/2"), (7, "http://x.org/fr/"), (8, "http://notnet/"), (None, "http://x.org/zz#/q"), (9, "http://net"), (10, "a" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("score", F.lit("clash")).withColumn("rule", F.lit("clash"))
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["host"], by[1]["path"], by[3]["host"]) == ("", "", "")
    assert (by[4]["host"], by[4]["path"], by[4]["rule"], by[4]["verdict"]) == ("a.net", "/x", "net/", "block")
    assert by[5]["verdict"] == "allow" and by[5]["rule"] == "example.net/en/" and by[6]["rule"] == "example.com/de/" and by[7]["rule"] == "org/fr/"
    assert by[8]["rule"] is None and by[9]["rule"] is None and all(r["verdict"] in ("allow", "block") for r in got)
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.where("page_id = 8")).collect()} == {"allow"}


def test_top_k(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, []), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [0.2, 0.1, 0.3]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (9, [1.0, 0.5]), (100, [1e30, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [tuple(r) for r in topk_search.top_k(v, lambda c: c % 100 == 0).orderBy("query_id", "rank").collect()]
    most, same = 2**63 - 1, 1024 * 1024 + 512 * 512
    assert got[:4] == [(0, 1, 100, most), (0, 2, 1, same), (0, 3, 9, same), (0, 4, 8, -1024 * 1024)]
    assert got[4:] == [(100, 1, 0, most), (100, 2, 0, most), (100, 3, 1, most), (100, 4, 9, most), (100, 5, 8, -most - 1)]
    assert topk_search.top_k(v.limit(0), lambda c: c % 100 == 0).count() == 0
