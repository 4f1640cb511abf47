"""Operator 12 against a plain version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.llm import catalog
from lorebase.llm import spelling_variants as sv

LOWER = str.maketrans(sv.UPPER, sv.LOWER)


def counted(docs, every=97, least=3, shortest=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= shortest
    return {w: c for w, c in n.items() if c >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs, every=97):
    n = counted(docs, every)
    by_part = {}
    for w in n:  # near words share what is left of one letter less, or are it
        for k in range(len(w)):
            by_part.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    out, forms = {}, {}
    for w in n:
        others = set().union(by_part.get(w, ()), *(by_part[w[:k] + w[k + 1 :]] | {w[:k] + w[k + 1 :]} for k in range(len(w))))
        found = sorted((-n[x], x) for x in others if x in n and near(w, x))
        form = found[0][1] if found and -found[0][0] >= 2 * n[w] else None
        forms[w] = form
        out[w] = (form, n[w], len(found), n[form] if form else None)
    result = set()
    for w, (form, c, k, m) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        result.add((w, form, root, c, k, m))
    return result


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def random_docs(seed, words=300):
    rng = random.Random(seed)
    letters = "abcé÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(words)]
    return [(i if i % 9 else None, " ".join(x.upper() if rng.random() < 0.3 else x for x in (base[int(words * rng.random() ** 4)] for _ in range(60)))) for i in range(90)]


def test_equals_a_plain_version_with_any_page_size(spark):
    docs = random_docs(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = plain(docs, every=5)
    assert sum(r[1] is not None for r in want) > 10 and sum(r[2] not in (r[0], r[1]) for r in want) > 0
    assert sorted(map(str, rows_of(sv.spelling_variants(df, every=5)))) == sorted(map(str, want))
    words = spark.createDataFrame([(r[0], r[3]) for r in want], "word string, n long")
    whole = {tuple(r) for r in sv.neighbours(words).collect()}
    assert whole and whole == {tuple(r) for r in sv.neighbours(words, page=20).collect()}  # many cells
    assert whole == {tuple(r) for r in sv.neighbours(words, sample=8, page=10).collect()}  # cells in parts


def test_letter_trees():
    rng = random.Random(2)
    for length in (5, 7):
        words = sorted({"".join(rng.choice("abcdeé") for _ in range(length)) for _ in range(2500)})
        longer = sorted({"".join(rng.choice("abcdeé") for _ in range(length + 1)) for _ in range(2500)})
        a, b = (sv.Classes(x, np.ones(len(x), np.int64), len(x[0])) for x in (words, longer))
        got = [(words[x], words[y]) for i, j in sv.near_words(a, a, sv.Lower(a.counts), own=True) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        parts = {}
        for w in words:
            for k in range(length):
                parts.setdefault(w[:k] + "*" + w[k + 1 :], []).append(w)
        assert sorted(tuple(sorted(p)) for p in got) == sorted((x, y) for g in parts.values() for i, x in enumerate(g) for y in g[i + 1 :])
        got = [(words[x], longer[y]) for i, j in sv.near_words(a, b, sv.Lower(b.counts)) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        have = set(words)
        assert sorted(got) == sorted({(w[:k] + w[k + 1 :], w) for w in longer for k in range(length + 1) if w[:k] + w[k + 1 :] in have})
        counts = sv.counts_of(sv.codes_of(words, length))
        tree, cells = sv.upper_tree(counts[::3], 30)
        home = sv.home(tree, counts)
        assert cells == 30 and set(home.tolist()) <= set(range(30))
        rows, at = sv.reach(tree, counts, 1, 1)
        reached = set(zip(rows.tolist(), at.tolist(), strict=True))
        place = {w: i for i, w in enumerate(words)}
        assert all((place[x], home[place[y]]) in reached and (place[y], home[place[x]]) in reached for g in parts.values() for x in g for y in g)


def test_long_words_and_anagrams():
    base = "ab" * 3000
    words = sorted({base[:k] + "c" + base[k + 1 :] for k in range(0, 6000, 500)} | {base})
    c = sv.Classes(words, np.ones(len(words), np.int64), 6000)
    got = {tuple(sorted((words[x], words[y]))) for i, j in sv.near_words(c, c, sv.Lower(c.counts), own=True) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {tuple(sorted((x, y))) for x in words for y in words if x < y and near(x, y)}


@pytest.mark.parametrize("shape", ["empty", "nulls", "extra"])
def test_odd_tables(spark, shape):
    rows = {"empty": [], "nulls": [(None, None), (1, None), (2, "")], "extra": [(i, "lovely lovely LOVELY lovly lovly lovly ×÷éÉabc " + "x" * 1500) for i in (7, 7, 8, None)]}[shape]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert sorted(map(str, rows_of(sv.spelling_variants(df)))) == sorted(map(str, plain(rows)))


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(catalog.op12_spelling_variants(spark, sf))
    assert len(got) == len(set(got)) and sorted(map(str, got)) == sorted(map(str, plain(docs)))
