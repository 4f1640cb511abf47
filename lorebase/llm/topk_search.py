"""Exact top-k search with an M-tree.

Vectors are scored by inner product. One more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, puts them at
equal distance from the origin, so that the largest inner product is the smallest Euclidean distance and the
triangle inequality holds.

The tree is a written table. Its upper level are up to ROOTS routing vectors of a bounded sample; every row goes to
the nearest, which clusters the whole table. The rows of a routing vector, in pages of about PAGE rows where it has
many, are dealt into the lower level: metric nodes of about NODE rows with a routing vector of their own, its distance
to the upper one, a covering radius, and each member's distance to it (the parent distance).

A query knows its distances to the upper level. From these and the stored ones it gets a lower bound for each node
without a computation, visits nodes best-first by that bound, drops nodes once the bound or, with the distance to
the node's routing vector, its refinement passes the k-th best, and within a node skips members by their parent
distances. Rows of nodes cover the table, so a task searches whole nodes, keeps k rows a query across all of them,
and hands these up; a window ranks them. A bounded sample gives every query a first k-th best.

The queries are a stated set, taken in blocks of QUERY_BLOCK; each block is one pass over the tree.

Vectors that are null, or hold null or non-finite components take no part, nor do rows without an id. A vector meets
those of its own length only (an empty one the empty ones, with score 0). Components that don't fit 32 bits after
scaling stand in no node: such rows and queries are compared with all others in exact integers. A score beyond the
range of a long is ranked as it is up to 38 digits, and shown as the nearest long. Rows with the query's id are never
its result; repeated query ids count once, by the smallest vector; repeated candidate rows each. Ties go to the
smaller id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import broadcast_if_small, cut, whole_groups

QUERY_BLOCK = 4096
ROOTS = 256
PAGE = 4096
NODE = 64
#: Nodes of a group that each query visits best-first; the others follow in the order of the nodes, if their bounds let them.
FIRST = 6
SAMPLE = 4096
SCALE = 1024
_WIDE = float(1 << 31)
_MOST = 10**38 - 1
_ROWS = "dim int, root int, vec_id long, to_root double, v binary"
_NODES = "dim int, root int, to_root double, radius double, pivot binary, ids array<long>, parents array<double>, v binary"


def _parse(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integers as doubles) of the usable rows, by dimension."""
    ids, vectors = batch.column(0), batch.column(1)
    usable = np.array(ids.is_valid()) & np.array(vectors.is_valid())
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.values
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    at = vectors.offsets.to_numpy()[:-1]
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == n))
        x = flat[at[rows][:, None] + np.arange(n)]
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            v = SCALE * x[fine]
            # doubles too large for the scale are whole numbers already
            yield keys[rows[fine]], np.where(np.isfinite(v), np.floor(v), x[fine])


def _narrow(v: np.ndarray) -> np.ndarray:
    return (np.abs(v) < _WIDE).all(axis=1)


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most: dict[int, float] = {}
    for batch in batches:
        for _, v in _parse(batch):
            some = v[_narrow(v)]
            most[v.shape[1]] = max(most.get(v.shape[1], 0.0), float((some * some).sum(axis=1).max(initial=0.0)))
    if most:
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.float64())], ["dim", "most"])


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(0.0, most - (v * v).sum(axis=1)))])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T))


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of v with all of q; doubles hold them exactly below 2^53, Python's integers any."""
    big = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(v.shape[1], 1)
    if big < 2**53:
        return v @ q.T
    if big < 2**62:
        return v.astype(np.int64) @ q.astype(np.int64).T
    whole = lambda a: np.array([[int(c) for c in row] for row in a], object).reshape(a.shape)
    return whole(v) @ whole(q).T if v.shape[1] else np.zeros((len(v), len(q)))


def _place(roots: dict[int, tuple[np.ndarray, float]]):
    """Rows with the upper routing vector that is nearest; -1 for those that stand in no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v in _parse(batch):
                n = v.shape[1]
                pivots, most = roots.get(n, (np.zeros((0, n + 1)), 0.0))
                root, far = np.full(len(ids), -1, np.int32), np.zeros(len(ids))
                fit = np.flatnonzero(_narrow(v)) if len(pivots) else np.zeros(0, int)
                for k in range(0, len(fit), 1024):
                    own = fit[k : k + 1024]
                    d = distances(lifted(v[own], most), pivots)
                    root[own] = d.argmin(axis=1)
                    far[own] = d.min(axis=1)
                body = [x.astype(np.int32).tobytes() if r >= 0 else x.tobytes() for x, r in zip(v, root.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), n, np.int32)), pa.array(root), pa.array(ids), pa.array(far), pa.array(body, pa.binary())], ["dim", "root", "vec_id", "to_root", "v"])

    return run


def vectors_of(bodies: list[bytes], dim: int, root: int) -> np.ndarray:
    return np.frombuffer(b"".join(bodies), np.int32 if root >= 0 else np.float64).reshape(len(bodies), dim).astype(np.float64)


def nodes(ids: np.ndarray, v: np.ndarray, root: np.ndarray | None, most: float) -> Iterator[tuple]:
    """(distance to the upper routing vector, radius, routing vector, members, parent distances) of the nodes of a page."""
    if root is None:
        yield 0.0, float("inf"), np.zeros(v.shape[1] + 1), np.arange(len(ids)), np.zeros(len(ids))
        return
    x = lifted(v, most)
    places = np.unique(np.linspace(0, len(ids) - 1, max(1, -(-len(ids) // NODE))).astype(int))
    d = distances(x, x[places])
    owner = d.argmin(axis=1)
    up = distances(x[places], root[None])[:, 0]
    for k in np.unique(owner).tolist():
        members = np.flatnonzero(owner == k)
        yield float(up[k]), float(d[members, k].max()), x[places[k]], members, d[members, k]


def _pages(roots: dict[int, tuple[np.ndarray, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["dim", "root", "part"]):
            dims, at, ids = (table.column(c).to_numpy() for c in ("dim", "root", "vec_id"))
            bodies = table.column("v").to_pylist()
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                n, r = int(dims[a]), int(at[a])
                pivots, most = roots.get(n, (None, 0.0))
                out = [(n, r, up, radius, pivot.tobytes(), ids[a:b][members], parents, b"".join(bodies[a + i] for i in members.tolist())) for up, radius, pivot, members, parents in nodes(ids[a:b], vectors_of(bodies[a:b], n, r), pivots[r] if r >= 0 else None, most)]
                columns = list(zip(*out, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["dim", "root", "to_root", "radius", "pivot", "ids", "parents", "v"])

    return run


class Search:
    """The queries of one dimension on their way through nodes: the k best of each, and what was computed."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floors: np.ndarray, pivots: np.ndarray, most: float, k: int):
        self.ids, self.q, self.k, self.most = ids, q, k, most
        self.narrow = _narrow(q)
        safe = np.where(self.narrow[:, None], q, 0.0)
        self.reach = (safe * safe).sum(axis=1) + most
        self.slack = 1e-6 * np.sqrt(self.reach) + 1e-6
        self.up = np.column_stack([safe, np.zeros(len(q))])
        self.to_roots = distances(self.up, pivots)
        self.floors = floors
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id)
        self.met, self.all = 0, 0

    def bounds(self) -> np.ndarray:
        """How far a vector may be that can still be among a query's k best."""
        far = np.sqrt(np.maximum(0.0, self.reach - 2 * self.floors)) + self.slack
        return np.where(self.narrow & (self.floors > -np.inf), far, np.inf)

    def take(self, queries: np.ndarray, ids: np.ndarray, v: np.ndarray, allowed: np.ndarray) -> None:
        """Score the members v that are allowed (queries x members) and keep the best."""
        s = exact(v, self.q[queries]).T
        self.met += int(allowed.sum())
        low = self.floors[queries]
        some = allowed & (ids != self.ids[queries][:, None]) & (s >= low[:, None])
        for row in np.flatnonzero(some.any(axis=1)).tolist():
            i = int(queries[row])
            at = np.flatnonzero(some[row])
            merged = sorted(self.best[i] + [(-int(x), int(y)) for x, y in zip(s[row, at].tolist(), ids[at].tolist(), strict=True)])[: self.k]
            self.best[i] = merged
            if len(merged) == self.k:
                self.floors[i] = max(self.floors[i], -float(merged[-1][0]) * (1 - 1e-12 * np.sign(-merged[-1][0])))

    def visit(self, batch: list[tuple]) -> None:
        """Nodes (root, distance to it, radius, routing vector, ids, parent distances, vectors), for each query in the order of its bounds."""
        self.all += len(self.ids) * sum(len(n[4]) for n in batch)
        root = np.array([n[0] for n in batch])
        up, radius = np.array([n[1] for n in batch]), np.array([n[2] for n in batch])
        known = self.to_roots[:, np.maximum(root, 0)] if self.to_roots.shape[1] else np.zeros((len(self.ids), len(batch)))
        lower = np.where((root >= 0) & self.narrow[:, None], np.abs(known - up) - radius, -np.inf)
        order = np.argsort(lower, axis=1, kind="stable")
        live = np.arange(len(self.ids))
        for turn in range(min(FIRST, len(batch))):
            node = order[live, turn]
            near = lower[live, node] <= self.bounds()[live]
            live, node = live[near], node[near]
            if not len(live):
                return
            by_node = np.argsort(node, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(node[by_node]) > 0))
            for a, b in zip(cuts, np.append(cuts[1:], len(live)), strict=True):
                self._enter(batch[int(node[by_node[a]])], live[by_node[a:b]])
        # whose bounds have settled by now, in the order of the nodes
        turns = np.argsort(order, axis=1, kind="stable")
        for k, node in enumerate(batch):
            self._enter(node, live[(turns[live, k] >= FIRST) & (lower[live, k] <= self.bounds()[live])])

    def _enter(self, node: tuple, queries: np.ndarray) -> None:
        root, _, radius, pivot, ids, parents, v = node
        if not len(queries):
            return
        if root < 0:
            self.take(queries, ids, v, np.ones((len(queries), len(ids)), bool))
            return
        bound = self.bounds()[queries]
        d = distances(self.up[queries], pivot[None])[:, 0]
        close = (d - radius <= bound) | ~self.narrow[queries]
        queries, d, bound = queries[close], d[close], bound[close]
        allowed = np.abs(d[:, None] - parents) <= np.where(self.narrow[queries], bound, np.inf)[:, None]
        wanted = allowed.any(axis=0)
        if wanted.any():
            self.take(queries, ids[wanted], v[wanted], allowed[:, wanted])


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, roots = shared.value
        going: dict[int, Search] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for n in np.unique(dims).tolist():
                if n not in blocks:
                    continue
                ids, q, floors = blocks[n]
                pivots, most = roots.get(n, (np.zeros((0, n + 1)), 0.0))
                if n not in going:
                    going[n] = Search(ids, q, floors.copy(), pivots, most, k)
                own = np.flatnonzero(dims == n)
                for i in range(0, len(own), 128):
                    rows = batch.take(pa.array(own[i : i + 128])).to_pylist()
                    going[n].visit([(r["root"], r["to_root"], r["radius"], np.frombuffer(r["pivot"], np.float64), np.array(r["ids"], np.int64), np.array(r["parents"]), np.frombuffer(r["v"], np.int32 if r["root"] >= 0 else np.float64).reshape(len(r["ids"]), n).astype(np.float64)) for r in rows])
        for s in going.values():
            rows = [(int(q), i, Decimal(max(-_MOST, min(_MOST, -x)))) for q, best in zip(s.ids.tolist(), s.best, strict=True) for x, i in best]
            if rows:
                q, i, x = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(x, pa.decimal128(38, 0))], ["query_id", "vec_id", "score"])

    return run


def _first_floors(ids: np.ndarray, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """The k-th best score of each query in the sample; -inf where there are fewer."""
    floors = np.full(len(ids), -np.inf)
    if sample is not None and len(sample[0]) > k:
        s = exact(sample[1], q).T.astype(float)
        s[ids[:, None] == sample[0]] = -np.inf
        floors = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return np.where(np.isfinite(floors), floors - 1e-9 * np.abs(floors), -np.inf)


def build(rows: DataFrame, roots: dict[int, tuple[np.ndarray, float]]) -> DataFrame:
    """The tree's nodes over all rows (vec_id, vector), as a written table."""
    placed = cut(rows.mapInArrow(_place(roots), _ROWS), "placed")
    sizes = placed.groupBy("dim", "root").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("parts"))
    dealt = placed.join(broadcast_if_small(sizes, len(roots) * (ROOTS + 1), 100_000), ["dim", "root"]).withColumn("part", F.expr("cast(pmod(xxhash64(vec_id, v), parts) as int)"))
    dealt = dealt.repartition("dim", "root", "part").sortWithinPartitions("dim", "root", "part").select("dim", "root", "part", "vec_id", "v")
    return cut(dealt.mapInArrow(_pages(roots), _NODES), "nodes")


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products among all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    most = {r[0]: r[1] for r in rows.mapInArrow(_norms, "dim int, most double").groupBy("dim").agg(F.max("most")).collect()}
    usable = rows.where(F.col("vec_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sample: dict[int, list] = {}
    for b in usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().to_batches():
        for ids, v in _parse(b):
            sample.setdefault(v.shape[1], []).append((ids, v))
    pooled = {n: (np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own])) for n, own in sample.items()}
    roots = {}
    for n, (_, v) in pooled.items():
        some = v[_narrow(v)]
        if len(some) and n:
            roots[n] = (np.unique(lifted(some[:: max(1, len(some) // ROOTS)][:ROOTS], most[n]), axis=0), most[n])
    tree = build(rows, roots)
    queries = usable.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = cut(queries, "queries")
    parts = max(1, -(-queries.count() // block))
    out = None
    for part in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(parts)) == part) if parts > 1 else queries
        found: dict[int, list] = {}
        for b in mine.toArrow().to_batches():  # about `block` rows
            for ids, q in _parse(b):
                found.setdefault(q.shape[1], []).append((ids.astype(np.int64), q))
        blocks = {}
        for n, own in found.items():
            ids, q = np.concatenate([i for i, _ in own]), np.concatenate([x for _, x in own])
            blocks[n] = (ids, q, _first_floors(ids, q, pooled.get(n), k))
        hits = tree.mapInArrow(_search(spark.sparkContext.broadcast((blocks, roots)), k), "query_id long, vec_id long, score decimal(38,0)")
        out = hits if out is None else out.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    shown = F.expr(f"cast(greatest(least(score, cast('{2**63 - 1}' as decimal(38,0))), cast('{-(2**63)}' as decimal(38,0))) as bigint)")
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", shown.alias("score"))
