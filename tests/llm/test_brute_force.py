"""The operators against plain versions of themselves."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.llm import decontamination, gru_lm, language_id, mixing, near_duplicates, substring_dedup, topk_search, toxicity, url_filter
from lorebase.llm.common import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def near(spark):
    """Chains of edits, so that similarities lie all around the threshold."""
    r = random.Random(5)
    rows = []
    for family in range(6):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice((6, 40, 150, 400)))]
        for _ in range(25):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = f"w{r.randint(0, 400)}"
    return spark.createDataFrame(rows, "doc_id long, text string")


def components(edges, nodes):
    root = {n: n for n in nodes}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_near_duplicates(docs, near):
    for df in (docs, near):
        sets = {}
        for r in df.select("doc_id", "text").collect():
            w = WORD.findall(lower(r["text"]))
            sets[r["doc_id"]] = set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()
        links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
        want = components(links, sets)
        got = near_duplicates.near_duplicates(df).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}


def test_odd_sketch_estimates():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 1000, dtype=np.uint64)
    import pyarrow as pa

    text = [" ".join(f"x{v}" for v in a), " ".join([f"x{v}" for v in a[:960]] + [f"y{v}" for v in a[960:]])]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(text)], ["doc_id", "text"])
    out = next(near_duplicates._features(5)(iter([batch])))
    s = [np.frombuffer(x, np.uint64) for x in out.column(4).to_pylist()]
    n, occ = out.column(1).to_numpy(), out.column(5).to_numpy()
    j, sd = near_duplicates.estimate(np.bitwise_count(s[0] ^ s[1]).sum(), n[0], n[1], occ[0], occ[1], 0.9)
    assert abs(j - 956 / (2 * 996 - 956)) < 4 * sd


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 60), (60, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in components(edges, set(itertools.chain(*edges))).items()}


@pytest.mark.parametrize("window", [5, 35])
def test_substring_dedup(docs, near, window):
    for df in (docs, near):
        words = {r["doc_id"]: WORD.findall(r["text"] or "") for r in df.select("doc_id", "text").collect()}
        times = collections.Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
        want = {}
        for i, w in words.items():
            gone = set()
            for k in range(len(w) - window + 1):
                if times[tuple(w[k : k + window])] > 1:
                    gone.update(range(k, k + window))
            want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
        got = substring_dedup.drop_repeats(df, window=window).collect()
        assert {r["doc_id"]: (r["__n_words"], r["__n_removed"], r["__kept_sha256"]) for r in got} == want


def test_lm_base_scores_and_gain(docs):
    rows = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    got = {r["doc_id"]: r for r in gru_lm.score_documents(rows).collect()}
    tokens = {r["doc_id"]: [*WORD.findall(lower(r["text"])), None] for r in docs.select("doc_id", "text").collect()}
    c = collections.Counter(t for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in w)
    total, kinds = sum(c.values()), len(c)
    for i, w in tokens.items():
        base = sum(math.log10((c[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in w)
        assert got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(c[t] > 0 for t in w) and got[i]["train_tokens"] == total
        assert math.isclose(got[i]["base_score"], base, rel_tol=1e-9)


def test_lm_gradients_and_carried_state():
    h = np.array([-1, *range(50)])
    v = gru_lm.Vocabulary(h, np.zeros(51, int), np.arange(60, 9, -1), np.zeros(gru_lm.LETTERS))
    p = {k: x.astype(np.float64) for k, x in gru_lm.initial(v).items()}
    r = np.random.default_rng(0)
    x = r.integers(0, 50, (5, 3))
    y = r.integers(0, 50, (5, 3))
    y[0, 0] = gru_lm.NEURAL + 3
    g, _, _ = gru_lm.train_window(p, x, y, np.zeros((3, gru_lm.HIDDEN)))
    for name, at in (("e", (int(x[0, 0]), 5)), ("u", (3, 50)), ("wc", (2, 0)), ("bc", (0,)), ("ww", (0, 2, 7)), ("bw", (0, 3))):
        old = p[name][at]
        loss = []
        for d in (1e-5, -1e-5):
            p[name][at] = old + d
            loss.append(gru_lm.train_window(p, x, y, np.zeros((3, gru_lm.HIDDEN)))[2])
        p[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-5 - g[name][at]) < 1e-6
    ids = r.integers(0, 50, 100)
    whole = gru_lm.log_likelihood(p, ids, np.array([0, 100]), 0)[0]
    state, want, last = np.zeros((1, gru_lm.HIDDEN)), 0.0, gru_lm.INPUTS - 1
    for t in [*ids, 0]:
        state = gru_lm.step(p, p["e"][[last]], state)[0]
        want += gru_lm.output(p, state, np.array([t]))[0]
        last = t
    assert abs(whole - want) < 1e-2


def test_lm_probabilities_sum_to_one():
    h = np.array([-1, *range(3000)])
    v = gru_lm.Vocabulary(h, np.arange(3001) % gru_lm.LETTERS, np.arange(4000, 999, -1), np.ones(gru_lm.LETTERS))
    p = gru_lm.initial(v)
    state = np.random.default_rng(0).normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    every = np.arange(gru_lm.NEURAL + gru_lm.TAILS)
    ln = gru_lm.output(p, np.repeat(state, len(every), 0), every)
    assert abs(np.exp(ln).sum() - 1) < 1e-3


def test_top_k(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], np.floor(1024 * np.array(r["embedding"], np.float64))) for r in v.collect()]
    want = []
    for q, x in rows:
        if q % 20 == 0:
            best = sorted(((-int(x @ y), i) for i, y in rows if i != q))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for block in (4096, 7):
        got = [tuple(r) for r in topk_search.top_k(v, lambda c: c % 20 == 0, block=block).collect()]
        assert sorted(got) == sorted(want)


def fill(sizes, weights, total):
    """Weighted shares of total, none above twice the size; the excess goes round again."""
    target, open_ = {}, set(sizes)
    rest = total
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / w > 2 * sizes[s]}
        if not over:
            return target | {s: rest * weights[s] / w for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing(docs):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert {r["doc_id"]: r["__copies"] for r in got} == {r["doc_id"]: r["__copies"] for r in again}
    sizes, largest, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for r in got:
        assert r["__size"] == len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += r["__size"]
        largest[r["source"]] = max(largest[r["source"]], r["__size"])
        taken[r["source"]] += r["__size"] * r["__copies"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for r in got:
        assert r["__source_size"] == sizes[r["source"]] and math.isclose(r["__target"], want[r["source"]], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    # the rates meet the constraints of the dual
    for s in sizes:
        assert math.isclose(sum(r["__rate"] * r["__size"] for r in got if r["source"] == s), want[s], rel_tol=1e-6)


def test_language_id_held_out(docs):
    rows = docs.withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    done = language_id.identify(rows, language_id.train(rows.where("not held")))
    right, all_ = done.where("held").agg(F.count_if(F.col("lang") == F.col("__lang_pred")), F.count("*")).first()
    assert right >= 0.95 * all_


def test_codewords_lie_apart():
    for n in (1, 2, 4, 30):
        code = language_id.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
        assert all((code[i] != code[j]).sum() >= 4 for i, j in itertools.combinations(range(n), 2))


def test_tiles_catch_reordered_passages():
    item = np.arange(1, 31, dtype=np.uint64)
    text = np.concatenate([np.full(5, 99), item[15:], np.full(3, 98), item[:15]]).astype(np.uint64)
    assert sum(t[2] for t in decontamination.tiles(item, text)) == 30
    assert sum(t[2] for t in decontamination.tiles(item, np.flip(item))) == 0
    # marked words are not used twice
    assert sum(t[2] for t in decontamination.tiles(np.concatenate([item, item]), text)) == 30


def test_decontamination(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"] in (d["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()}
    assert want and want <= got and len(got - want) <= 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_matches_edit_distance():
    r = random.Random(2)
    terms = {"".join(r.choice("abc") for _ in range(r.randint(5, 8))).encode(): 1.0 for _ in range(40)}
    trie = toxicity.Trie(terms)
    for _ in range(400):
        word = "".join(r.choice("abc") for _ in range(r.randint(5, 9)))
        best = min(distance(word, t.decode()) for t in terms)
        found = trie.match(word)
        assert (found[1] if found else None) == (best if best <= 1 else None)
    assert toxicity.Trie({b"lowei*": 2.0}).match("loweischaft") == (2.0, 0)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    right, all_ = got.agg(F.count_if((F.col("score") >= 0.5) == (F.col("toxic") == 1)), F.count("*")).first()
    assert right >= 0.95 * all_


def test_urls(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    for r in url_filter.judge(rows).join(rows, "page_id").collect():
        rest = r["url"].split("://", 1)[1] if "://" in (r["url"] or "") else None
        host = lower(re.match(r"[^/?#]*", rest)[0]) if rest is not None else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest is not None else ""
        fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict is None or r["verdict"] == verdict
