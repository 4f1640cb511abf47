"""Operator 13 against a plain version in Python's integers."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.llm import catalog
from lorebase.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def whole(x):
    return math.floor(hn.SCALE * x) if abs(x) < 2.0**44 else int(hn.SCALE * x) if math.isfinite(hn.SCALE * x) else int(x)


def plain(rows, every=50, positives=5, negatives=3, least=50, most=95):
    fine = [(i, tuple(whole(x) for x in v), y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, y in fine:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted((-sum(x * z for x, z in zip(q, v, strict=True)), i, y) for i, v, y in fine if i != a and len(v) == len(q))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            window = [(n, i) for n, i, y in scored if y != label and least * -s <= 100 * -n <= most * -s]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(window[:negatives])]
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    return sorted((*r[:4], clip(r[4]), clip(r[5])) for r in out)


def mine(spark, rows, every=50):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("dim", F.lit("clash")).withColumn("score", F.lit(0))
    return sorted(tuple(r) for r in hn.hard_negatives(df, lambda i: i % every == 0).collect())


def clusters(seed, n, dim=6, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [(i, (centres[i % 8] + spread * rng.normal(size=dim)).tolist(), int(i % 3)) for i in range(n)]


@pytest.mark.parametrize("spread", [0.0, 0.05, 2.0])
def test_equals_the_plain_version_in_many_pages(spark, monkeypatch, spread):
    monkeypatch.setattr(hn, "PAGE", 100)
    monkeypatch.setattr(hn, "LEAF", 10)
    monkeypatch.setattr(hn, "SAMPLE", 64)
    monkeypatch.setattr(hn, "ROOTS", 6)
    rows = clusters(int(spread * 100), 700, spread=spread)
    want = plain(rows, every=20)
    assert want and mine(spark, rows, every=20) == want


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = clusters(5, 200)
    rows += [(0, [1.0] * 6, 1), (0, [0.5] * 6, 0), (50, [0.0] * 6, 1), (7, [1.0] * 6, 2), (7, [1.0] * 6, 2)]  # repeated and zero
    rows += [(None, [1.0] * 6, 1), (100, None, 1), (101, [1.0] * 6, None), (102, [1.0, None] * 3, 1), (103, [float("nan")] * 6, 1), (104, [float("inf")] * 6, 2)]
    rows += [(1000 + i, [rng.random() for _ in range(3)], i % 2) for i in range(60)]  # of another length
    rows += [(2000 + 50 * i, [], i % 2) for i in range(4)]
    rows += [(3000 + 10 * i, [1e9 * (i + 1), 1.0, -3e8, 2.0, 5.0, 7.0], i % 2) for i in range(12)]  # wide
    rows += [(4000 + 25 * i, [2.0**46 * (40 + i), 3e13, 1.0, 0.0, -1.0, 2.0], i % 2) for i in range(12)]  # beyond a double's integers
    want = plain(rows)
    assert want and mine(spark, rows) == want
    assert mine(spark, []) == [] and mine(spark, [(50, [1.0], 1)]) == []


def test_a_tree_saves_computations_on_clusters():
    rng = np.random.default_rng(1)
    centres = 3000 * rng.normal(size=(20, 8))
    v = np.floor(centres[np.arange(4000) % 20] + 40 * rng.normal(size=(4000, 8)))
    most = float((v * v).sum(axis=1).max())
    splits, leaf = hn.page_splits(v, most)
    order = np.argsort(leaf, kind="stable")
    import pyarrow as pa

    table = pa.table({"leaf": leaf[order], "vec_id": order, "label": (order % 3).astype(np.int64), "v": [x.astype(np.int32).tobytes() for x in v[order]]})
    page = hn.Page(8, True, [table], splits.points.tobytes() + splits.low.tobytes() + splits.high.tobytes(), most)
    assert len(page.splits.points) == len(splits.points) and (page.splits.high == splits.high).all()
    ids = np.arange(0, 4000, 40)
    nothing = [[-np.inf] for _ in ids]
    got = page.search(v[ids], ids, ids % 3, nothing, [[np.inf] for _ in ids], nothing, 5, True)
    s = v[ids] @ v.T
    for row, i in enumerate(ids.tolist()):
        fit = [(-int(s[row, j]), j) for j in range(4000) if j % 3 == i % 3 and j != i]
        assert sorted((-x, j) for r, _, j, x in got if r == row) == sorted(fit)[:5]
    assert page.computed < 0.5 * len(ids) * 4000


def test_equals_duckdb(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, catalog.op13_hard_negatives(spark, sf).collect())) == sorted(con.execute(catalog.ORACLES["op13_hard_negatives"]).fetchall())
