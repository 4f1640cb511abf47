"""Hard negatives from a GNAT-style multiway hyperplane tree.

Rows are integer vectors with a label, scored by inner product. One more coordinate puts all vectors at equal distance
from the origin, so a score is a Euclidean distance and a window of scores is an annulus around the anchor.

The tree has two written levels. Up to ROOTS split points of a bounded sample part the table by the nearest one
(hyperplanes between them); an aggregate over all rows stores for each split point the range of its distances to every
sibling subtree. A subtree is dealt in pages of about PAGE rows with split points of their own, whose leaves and ranges
to sibling leaves are written beside the rows. A query drops a subtree, and later a leaf, when from any split point the
range does not intersect the annulus around the query; leaves are scored in exact integers.

Two searches use the tree: the first `positives` other rows of an anchor's label, and for each of the windows that
these set the first `negatives` rows of other labels. Queries are rows too: each is dealt to the pages that are left to
it, where a task holds one page and streams its queries through, nearest leaf first. What it hands up are its best rows
of a query or window; a window function keeps the best of all pages. No query passes the driver. A bounded sample
gives each query and window a first k-th best.

Rows with a null id or label, a null vector, or a null or non-finite component take no part. Vectors meet those of
their own length only. Components that don't fit 32 bits after scaling stand in no subtree: such rows form pages that
every query of their length visits, and such queries visit all pages. Rows with the anchor's id are neither its
positives nor its negatives; repeated anchor ids count once, by the smallest label and vector, repeated candidates
each. A positive of score 0 has negatives of score 0; one below 0 has none. Ties go to the smaller id. Scores beyond
the range of a long are ranked exactly up to 38 digits and shown as the nearest long. Extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import broadcast_if_small, cut, whole_groups
from lorebase.llm.topk_search import distances, exact, lifted

SCALE = 256
SAMPLE = 4096
#: Split points of the upper level, rows of a page, rows of a leaf, about.
ROOTS, PAGE, LEAF = 32, 1 << 14, 128
#: Queries of a page that are scored at a time.
QUERIES = 512
_WIDE = float(1 << 31)
_MOST = 10**38 - 1
_PLACED = "dim int, root int, vec_id long, label long, v binary"
_PAGES = "dim int, root int, part int, leaf int, vec_id long, label long, v binary"
_DEALT = "dim int, root int, part int, role int, leaf int, vec_id long, label long, v binary, low array<decimal(38,0)>, high array<decimal(38,0)>, floor array<decimal(38,0)>"
_FOUND = "anchor_id long, place int, vec_id long, score decimal(38,0)"


def usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(dim, vec_id, label, vector) of the rows that take part, components scaled and rounded down."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    # doubles too large for the scale are whole numbers already; a decimal or long floor would overflow
    whole = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**44, F.floor(scale * x).cast("double")).when(F.abs(x * scale) < float("inf"), x * scale).otherwise(x))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vector"))
    return rows.where("label is not null").select(F.size("vector").alias("dim"), "vec_id", "label", "vector")


def matrix(bodies: list[bytes], dim: int, narrow: bool) -> np.ndarray:
    return np.frombuffer(b"".join(bodies), np.int32 if narrow else np.float64).reshape(len(bodies), dim).astype(np.float64)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


class Splits:
    """Split points of one level with their distance ranges to every subtree: low[i, j] and high[i, j] from point i."""

    def __init__(self, points: np.ndarray, most: float):
        self.points, self.most = points, most
        self.low = np.full((len(points), len(points)), np.inf)
        self.high = np.full((len(points), len(points)), -np.inf)

    def add(self, d: np.ndarray, owner: np.ndarray) -> None:
        """Widen the ranges by rows with these distances (row, point) and owners."""
        for j in np.unique(owner).tolist():
            own = d[owner == j]
            self.low[:, j] = np.minimum(self.low[:, j], own.min(axis=0))
            self.high[:, j] = np.maximum(self.high[:, j], own.max(axis=0))

    def open(self, d: np.ndarray, near: np.ndarray, far: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """(query, subtree): whether some row of the subtree may lie between near and far of the query, by all ranges."""
        out = np.ones(d.shape, bool)
        for i in range(len(self.points)):
            x = d[:, i][:, None]
            # distances from the query lie between |x - range| and x + high
            least = np.maximum(x - self.high[i], self.low[i] - x)
            out &= (least <= (far + slack)[:, None]) & (x + self.high[i] >= (near - slack)[:, None])
        return out & (self.high[0] > -np.inf if len(self.points) else True)


class Annuli:
    """Queries of one dimension with windows of scores, as distances in the lifted space."""

    def __init__(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, most: float):
        self.narrow = (np.abs(q) < _WIDE).all(axis=1)
        self.safe = np.where(self.narrow[:, None], q, 0.0)
        self.reach = (self.safe * self.safe).sum(axis=1) + most
        self.slack = 1e-6 * np.sqrt(self.reach) + 1e-6
        self.lifted = np.column_stack([self.safe, np.zeros(len(q))])
        self.set(low, high)

    def set(self, low: np.ndarray, high: np.ndarray) -> None:
        """Scores from low to high; -inf and inf where unknown."""
        self.far = np.where(self.narrow & (low > -np.inf), np.sqrt(np.maximum(0.0, self.reach - 2 * np.where(np.isfinite(low), low, 0.0))), np.inf)
        self.near = np.where(self.narrow & (high < np.inf), np.sqrt(np.maximum(0.0, self.reach - 2 * np.where(np.isfinite(high), high, 0.0))), 0.0)


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most: dict[int, float] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for n in np.unique(dims).tolist():
            v = _vectors(batch.column(1).take(pa.array(np.flatnonzero(dims == n))), n)
            v = v[(np.abs(v) < _WIDE).all(axis=1)]
            most[n] = max(most.get(n, 0.0), float((v * v).sum(axis=1).max(initial=0.0)))
    if most:
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.float64())], ["dim", "most"])


def _place(shared):
    """Rows with the nearest upper split point; -1 for those that stand in no subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = shared.value
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for n in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == n)))
                v = _vectors(own.column(3), n)
                narrow = (np.abs(v) < _WIDE).all(axis=1)
                root = np.full(len(v), -1, np.int32)
                if n in splits and narrow.any():
                    root[narrow] = distances(lifted(v[narrow], splits[n].most), splits[n].points).argmin(axis=1)
                body = [x.astype(np.int32).tobytes() if r >= 0 else x.tobytes() for x, r in zip(v, root.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(root), own.column(1), own.column(2), pa.array(body, pa.binary())], ["dim", "root", "vec_id", "label", "v"])

    return run


def _ranges(shared):
    """A task's ranges of the distances from each upper split point to each subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = {n: Splits(s.points, s.most) for n, s in shared.value.items()}
        for batch in batches:
            dims, roots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for n in np.unique(dims[roots >= 0]).tolist():
                at = np.flatnonzero((dims == n) & (roots >= 0))
                v = matrix(batch.column(4).take(pa.array(at)).to_pylist(), n, True)
                splits[n].add(distances(lifted(v, splits[n].most), splits[n].points), roots[at])
        for n, s in splits.items():
            i, j = np.nonzero(s.high > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), n, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s.low[i, j]), pa.array(s.high[i, j])], ["dim", "i", "j", "low", "high"])

    return run


def page_splits(v: np.ndarray, most: float) -> tuple[Splits, np.ndarray]:
    """Split points of a page with their ranges, and each row's leaf."""
    x = lifted(v, most)
    places = np.unique(np.linspace(0, len(v) - 1, max(1, -(-len(v) // LEAF))).astype(int))
    s = Splits(x[places], most)
    owner = np.zeros(len(v), np.int32)
    for k in range(0, len(v), 4096):
        d = distances(x[k : k + 4096], s.points)
        owner[k : k + 4096] = d.argmin(axis=1)
        s.add(d, owner[k : k + 4096])
    return s, owner


def _leaves(shared):
    """Whole pages with each row's leaf; a head row (leaf -1) before them holds split points and ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = shared.value
        for table, starts in whole_groups(batches, ["dim", "root", "part"]):
            dims, roots = table.column("dim").to_numpy(), table.column("root").to_numpy()
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                page = table.slice(a, b - a).combine_chunks()
                n, root = int(dims[a]), int(roots[a])
                leaf = np.zeros(b - a, np.int32)
                if root >= 0:
                    s, leaf = page_splits(matrix(page.column("v").to_pylist(), n, True), splits[n].most)
                    head = s.points.tobytes() + s.low.tobytes() + s.high.tobytes()
                    one = page.slice(0, 1)
                    yield from pa.table({"dim": one["dim"], "root": one["root"], "part": one["part"], "leaf": pa.array([-1], pa.int32()), "vec_id": pa.array([None], pa.int64()), "label": pa.array([None], pa.int64()), "v": pa.array([head], pa.binary())}).to_batches()
                order = pa.array(np.argsort(leaf, kind="stable"))
                page = page.append_column("leaf", pa.array(leaf)).take(order)
                yield from page.select(["dim", "root", "part", "leaf", "vec_id", "label", "v"]).combine_chunks().to_batches(max_chunksize=4096)

    return run


class Tree:
    """The written tree: pages (dim, root, part, leaf, vec_id, label, v), parts (dim, root, parts), upper splits and a sample by dimension."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        most = {r[0]: r[1] for r in rows.select("dim", "vector").mapInArrow(_norms, "dim int, most double").groupBy("dim").agg(F.max("most")).collect()}
        some: dict[int, list] = {}
        for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toLocalIterator():
            some.setdefault(r["dim"], []).append((r["vec_id"], r["label"], r["vector"]))
        self.sample = {n: (np.array([x[0] for x in own]), np.array([x[1] for x in own]), np.array([x[2] for x in own], float).reshape(len(own), n)) for n, own in some.items()}
        total = {r[0]: r[1] for r in rows.groupBy("dim").agg(F.count("*")).collect()}
        splits: dict[int, Splits] = {}
        for n, (_, _, v) in self.sample.items():
            v = v[(np.abs(v) < _WIDE).all(axis=1)]
            if len(v) and n:
                want = min(ROOTS, max(2, -(-total[n] // (PAGE // 4))))
                splits[n] = Splits(np.unique(lifted(v[:: max(1, len(v) // want)][:want], most[n]), axis=0), most[n])
        shared = spark.sparkContext.broadcast(splits)
        placed = cut(rows.mapInArrow(_place(shared), _PLACED), "placed")
        ranges = placed.mapInArrow(_ranges(shared), "dim int, i int, j int, low double, high double").groupBy("dim", "i", "j").agg(F.min("low"), F.max("high"))
        for n, i, j, low, high in ranges.collect():  # ROOTS x ROOTS of each sampled length
            splits[n].low[i, j], splits[n].high[i, j] = low, high
        parts = cut(placed.groupBy("dim", "root").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("parts")), "parts")
        self.parts = broadcast_if_small(parts, parts.count(), 100_000)
        dealt = placed.join(self.parts, ["dim", "root"]).withColumn("part", F.expr("cast(pmod(xxhash64(vec_id, v), parts) as int)"))
        dealt = dealt.select("dim", "root", "part", "vec_id", "label", "v").repartition("dim", "root", "part").sortWithinPartitions("dim", "root", "part")
        self.pages = cut(dealt.mapInArrow(_leaves(shared), _PAGES), "pages")
        self.upper = spark.sparkContext.broadcast((splits, self.sample))

    def search(self, queries: DataFrame, k: int, same: bool, share: tuple[int, int] = (50, 95)) -> DataFrame:
        """(anchor_id, place, vec_id, score) with the best k rows of each query's windows.

        queries (dim, vec_id, label, vector, scores): for each score s (decimals) a window of the scores from share[0] to
        share[1] percent of s; a null score for all. Rows of the query's label if same, else of the others.
        """
        routed = queries.mapInArrow(_route(self.upper, k, same, share), "dim int, vec_id long, label long, v binary, low array<decimal(38,0)>, high array<decimal(38,0)>, floor array<decimal(38,0)>, roots array<int>")
        asked = routed.withColumn("root", F.explode("roots")).join(self.parts, ["dim", "root"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        asked = asked.select("dim", "root", "part", F.lit(1).alias("role"), F.lit(0).alias("leaf"), "vec_id", "label", "v", "low", "high", "floor")
        none = F.lit(None).cast("array<decimal(38,0)>")
        pages = self.pages.select("dim", "root", "part", F.lit(0).alias("role"), "leaf", "vec_id", "label", "v", none.alias("low"), none.alias("high"), none.alias("floor"))
        key = ["dim", "root", "part"]
        dealt = pages.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "role", "leaf")
        hits = dealt.mapInArrow(_search(self.upper, k, same), _FOUND)
        rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _decimals(column: pa.Array, missing: float) -> list[list]:
    """Lists of whole numbers; a missing one is an infinity."""
    return [[missing if x is None else int(x) for x in own] for own in column.to_pylist()]


def _route(shared, k: int, same: bool, share: tuple[int, int]):
    """Queries with a first k-th best of each window, and the subtrees that are left to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, sample = shared.value
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for n in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == n)))
                q, ids, labels = _vectors(own.column(3), n), own.column(1).to_numpy(), own.column(2).to_numpy()
                scores = own.column(4).to_pylist()
                low = [[-np.inf if s is None else -(-int(s) * share[0] // 100) for s in x] for x in scores]
                high = [[np.inf if s is None else int(s) * share[1] // 100 for s in x] for x in scores]
                floors = [list(x) for x in low]
                if n in sample:
                    some, theirs, v = sample[n]
                    for a in range(0, len(q), QUERIES):
                        s = exact(v, q[a : a + QUERIES]).T
                        for i in range(len(s)):
                            fit = ((theirs == labels[a + i]) if same else (theirs != labels[a + i])) & (some != ids[a + i])
                            for w, (x, y) in enumerate(zip(low[a + i], high[a + i], strict=True)):
                                inside = s[i][fit & (s[i] >= x) & (s[i] <= y)]
                                if len(inside) >= k:
                                    floors[a + i][w] = max(x, int(np.sort(inside)[-k]))
                bounds = [min(f, default=-np.inf) for f in floors], [max(h, default=np.inf) for h in high]
                roots = np.full((len(q), 1), True)
                numbers = np.array([-1], np.int32)
                if n in upper:
                    s = upper[n]
                    ring = Annuli(q, *(np.array(x, float) for x in bounds), s.most)
                    inner = s.open(distances(ring.lifted, s.points), ring.near, ring.far, ring.slack) | ~ring.narrow[:, None]
                    roots, numbers = np.column_stack([roots, inner]), np.append(numbers, np.arange(len(s.points), dtype=np.int32))
                made = [pa.array([None if x in (np.inf, -np.inf) else Decimal(max(-_MOST, min(_MOST, x))) for own in lists for x in own], pa.decimal128(38, 0)) for lists in (low, high, floors)]
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in low])), pa.int32())
                windows = [pa.ListArray.from_arrays(offsets, x) for x in made]
                body = pa.array([x.tobytes() for x in q], pa.binary())
                left = pa.array([numbers[r] for r in roots], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), body, *windows, left], ["dim", "vec_id", "label", "v", "low", "high", "floor", "roots"])

    return run


class Page:
    """One page in a task: rows sorted by leaf, split points and ranges of the leaves."""

    def __init__(self, dim: int, narrow: bool, rows: list[pa.Table], head: bytes | None, most: float):
        t = pa.concat_tables(rows).combine_chunks()
        self.ids, self.labels = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
        self.v = matrix(t.column("v").to_pylist(), dim, narrow)
        leaf = t.column("leaf").to_numpy()
        self.splits = None
        if head is not None:
            m = int((-(dim + 1) + ((dim + 1) ** 2 + len(head)) ** 0.5) / 2 + 0.5)  # 8 m (dim + 1) + 16 m m bytes
            m = next(x for x in range(max(1, m // 4), 4 * m + 8) if 8 * x * (dim + 1) + 16 * x * x == len(head))
            values = np.frombuffer(head, np.float64)
            self.splits = Splits(values[: m * (dim + 1)].reshape(m, dim + 1), most)
            self.splits.low, self.splits.high = values[m * (dim + 1) :].reshape(2, m, m)
        leaves = len(self.splits.points) if self.splits else 1
        self.bounds = np.searchsorted(leaf, np.arange(leaves + 1))
        self.computed = 0

    def search(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: list[list], high: list[list], floors: list[list], k: int, same: bool) -> list[tuple]:
        """(query, window, id, score) of the best k of each window."""
        width = max((len(x) for x in low), default=0)
        pad = lambda lists, by: np.array([[*x, *[by] * (width - len(x))] for x in lists], object).reshape(len(q), width)
        floor, top = pad(floors, np.inf), pad(high, -np.inf)
        best: dict[tuple[int, int], list[tuple]] = {}
        big = float(np.abs(self.v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(q.shape[1], 1)
        simple = big < 2**53 and all(abs(x) < 2**53 for x in (*floor.ravel(), *top.ravel()) if x not in (np.inf, -np.inf))
        if simple:
            floor, top = floor.astype(float), top.astype(float)

        def enter(leaf: int, queries: np.ndarray) -> None:
            a, b = self.bounds[leaf], self.bounds[leaf + 1]
            if a == b or not len(queries):
                return
            self.computed += int(b - a) * len(queries)
            s = exact(self.v[a:b], q[queries]).T
            fit = ((self.labels[a:b] == labels[queries][:, None]) == same) & (self.ids[a:b] != ids[queries][:, None])
            for w in range(width):
                i, j = np.nonzero(fit & (s >= floor[queries, w][:, None]) & (s <= top[queries, w][:, None]))
                for x in np.unique(i).tolist():
                    row, mine = int(queries[x]), j[i == x]
                    kept = best.setdefault((row, w), [])
                    kept += [(-int(y), int(z)) for y, z in zip(s[x, mine].tolist(), self.ids[a:b][mine].tolist(), strict=True)]
                    kept.sort()
                    del kept[k:]
                    if len(kept) == k:
                        floor[row, w] = max(floor[row, w], -kept[-1][0])

        everyone = np.arange(len(q))
        if self.splits is None:
            enter(0, everyone)
        else:
            ring = Annuli(q, floor.min(axis=1, initial=np.inf).astype(float), top.max(axis=1, initial=-np.inf).astype(float), self.splits.most)
            d = distances(ring.lifted, self.splits.points)
            first = np.where(self.splits.high[0] > -np.inf, np.abs(d - ring.near[:, None]), np.inf).argmin(axis=1)
            for leaf in np.unique(first).tolist():
                enter(leaf, np.flatnonzero(first == leaf))
            ring.set(floor.min(axis=1, initial=np.inf).astype(float), top.max(axis=1, initial=-np.inf).astype(float))
            inside = self.splits.open(d, ring.near, ring.far, ring.slack) | ~ring.narrow[:, None]
            inside[everyone, first] = False
            for leaf in range(len(self.splits.points)):
                enter(leaf, np.flatnonzero(inside[:, leaf]))
        return [(row, w, i, -x) for (row, w), kept in best.items() for x, i in kept]


def _search(shared, k: int, same: bool):
    """Rows sorted by page: its head and rows (role 0), then its queries (role 1), which are streamed through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, _ = shared.value
        key, head, rows, page = None, None, [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in range(4)]
            new = np.ones(len(batch), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            cuts = np.flatnonzero(new).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                at, role = tuple(int(c[a]) for c in columns[:3]), int(columns[3][a])
                own = batch.slice(a, b - a)
                if at != key:
                    key, head, rows, page = at, None, [], None
                if role == 0:
                    if own.column(4)[0].as_py() == -1:
                        head, own = own.column(7)[0].as_py(), own.slice(1)
                    if len(own):
                        rows.append(pa.Table.from_batches([own]).select(["leaf", "vec_id", "label", "v"]))
                    continue
                if page is None:
                    page, rows = Page(at[0], at[1] >= 0, rows, head, upper[at[0]].most if at[0] in upper else 0.0), []
                for c in range(0, len(own), QUERIES):
                    part = own.slice(c, QUERIES)
                    ids = part.column(5).to_numpy()
                    found = page.search(matrix(part.column(7).to_pylist(), at[0], False), ids, part.column(6).to_numpy(), _decimals(part.column(8), -np.inf), _decimals(part.column(9), np.inf), _decimals(part.column(10), -np.inf), k, same)
                    if found:
                        q, w, i, s = zip(*found, strict=True)
                        score = pa.array([Decimal(max(-_MOST, min(_MOST, x))) for x in s], pa.decimal128(38, 0))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[list(q)]), pa.array(w, pa.int32()), pa.array(i, pa.int64()), score], ["anchor_id", "place", "vec_id", "score"])

    return run


def hard_negatives(vectors: DataFrame, is_anchor, label: Column | None = None, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Negatives of a positive are rows of another label whose score is from least to most percent of the positive's.
    """
    rows = cut(usable(vectors, id_col, vector_col, F.col("label") if label is None else label, scale), "vectors")
    tree = Tree(rows)
    anchors = rows.where(is_anchor(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x"))
    anchors = cut(anchors.select(F.size("x.vector").alias("dim"), "vec_id", "x.label", "x.vector"), "anchors")
    whole = F.array(F.lit(None).cast("decimal(38,0)")).alias("scores")
    found = cut(tree.search(anchors.select("*", whole), positives, True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # positives of one score share a window, those below 0 have none
    windows = found.where("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))  # at most `positives`
    windows = cut(windows, "windows")
    asked = anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).select("dim", "vec_id", "label", "vector", "scores")
    hits = tree.search(asked, negatives, False, (least, most))
    scores = windows.select("anchor_id", F.posexplode("scores").alias("place", "positive_score"))
    out = hits.join(scores, ["anchor_id", "place"]).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(found, ["anchor_id", "positive_score"])
    shown = lambda c: F.expr(f"cast(greatest(least({c}, cast('{2**63 - 1}' as decimal(38,0))), cast('{-(2**63)}' as decimal(38,0))) as bigint)").alias(c)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", shown("positive_score"), shown("negative_score"))
