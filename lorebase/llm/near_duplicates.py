"""MinHash near-duplicate detection with odd sketches.

Every text becomes the set of its five-word shingles. Equal sets collapse into one representative. The
representatives' MinHash bands give buckets; within a bucket the odd sketches (MinHash samples of 1024 bins,
folded into a parity bitmap of 2048 bits) estimate similarities from XOR population counts, and only pairs whose
estimate may reach the threshold go on. These are confirmed on the full sets. First a spanning forest of each
bucket is confirmed. Where that leaves a bucket with members of several components whose estimates may still
reach the threshold, their full sets are brought together, in parts of bounded rows and bytes, and counted against
each other exactly; a part gives only the links that join components. So no step makes more rows than its buckets
have members, and no confirmed link between components is left out.

Nulls and ties: a null or blank text has an empty set and is linked with nothing. Rows with a null id take no
part and come back with a null component. Rows that repeat an id are one document: they share a node, and stay or go together. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import broadcast_if_small, connected_components, cut, lists, mix, quoted, whole_groups, word_chunks

SHINGLE = 5
BANDS, ROWS = 20, 5
BINS, BITS = 1024, 2048
#: Members of a bucket that are compared in one group.
BLOCK = 4096
#: Groups up to so many members are compared all at once, others member by member.
SMALL = 16
#: Rows and bytes of full sets that are counted against each other in one group are twice these at most.
PART_ROWS, PART_BYTES = 1024, 8 << 20
#: Columns of the incidence matrix at a time.
SLICE = 2048
#: Below so many ids, the texts to confirm are picked by a broadcast of the ids (8 bytes each), else by a shuffle.
BROADCAST_IDS = 500_000

_RNG = np.random.default_rng(20240501)
_FACTORS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FEATURES = "doc_id long, n long, set_key binary, bands array<long>, sketch binary, occupied int"


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text, run by run."""
    for a, b, w in word_chunks(column, lower=True, rows=512):
        counts = np.diff(w.bounds)
        at = w.starts_of(shingle)
        h = w.spans(at, at + shingle)
        cuts = np.searchsorted(at, w.bounds)
        short = np.flatnonzero((counts > 0) & (counts < shingle))
        whole = dict(zip(short.tolist(), mix(w.spans(w.bounds[short], w.bounds[short + 1]) + np.uint64(1)), strict=True)) if len(short) else {}
        yield a, b, [np.array([whole[i]], np.uint64) if i in whole else np.unique(h[cuts[i] : cuts[i + 1]]) for i in range(b - a)]


def _features(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, sets in _sets(batch.column(1), shingle):
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                lengths = np.zeros(b - a, np.int64)
                keys: list = [None] * (b - a)
                sketches: list = [None] * (b - a)
                occupied = np.zeros(b - a, np.int32)
                bands = np.zeros((0,), np.int64)
                if len(full):
                    u = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    signature = np.empty((len(full), BANDS * ROWS), np.uint64)
                    for k, f in enumerate(_FACTORS):
                        signature[:, k] = np.minimum.reduceat((u * f) >> np.uint64(24), starts)
                    of = np.zeros((len(full), BANDS), np.uint64)
                    for r in range(ROWS):
                        of = mix(of + signature[:, r::ROWS] + np.uint64(r))
                    of = mix(of + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
                    bands = of.astype(np.int64).ravel()
                    lengths[full] = BANDS
                    bins = u >> np.uint64(64 - BINS.bit_length() + 1)
                    first = np.ones(len(u), bool)
                    first[1:] = bins[1:] != bins[:-1]
                    first[starts] = True
                    owner = np.repeat(np.arange(len(full)), n[full])[first]
                    bit = (mix(u[first] + np.uint64(77)) & np.uint64(BITS - 1)).astype(np.int64)
                    parity = (np.bincount(owner * BITS + bit, minlength=len(full) * BITS) & 1).astype(np.uint8)
                    packed = np.packbits(parity.reshape(len(full), BITS), axis=1)
                    occupied[full] = np.bincount(owner, minlength=len(full))
                    for j, i in enumerate(full):
                        keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        sketches[i] = packed[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n), pa.array(keys, pa.binary()), lists(bands, lengths, pa.int64()), pa.array(sketches, pa.binary()), pa.array(occupied)],
                    ["doc_id", "n", "set_key", "bands", "sketch", "occupied"],
                )

    return run


def estimate(pop: np.ndarray, n: np.ndarray, m: np.ndarray, occ_n: np.ndarray, occ_m: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarity from the population count of two sketches' XOR, and its standard deviation near `at`."""
    x = 1 - 2 * pop / BITS
    differ = np.where(x > 0, -BITS / 2 * np.log(np.maximum(x, 1e-9)), np.inf)
    match = (occ_n + occ_m - differ) / 2
    union = (n + m) / (1 + at)
    fill = lambda x: BINS * -np.expm1(-x / BINS)
    # bins that the union fills: as many as the two texts fill, times what the union has more in the mean
    filled = fill(union) * (occ_n + occ_m) / (fill(n) + fill(m))
    j = match / filled
    d = filled * (1 - at) / (1 + at) * 2
    sampling = at * (1 - at) / filled * np.maximum(0, 1 - filled / union)
    folding = np.maximum(0, BITS / 4 * np.expm1(4 * d / BITS) - d) / (4 * filled**2)
    return j, np.sqrt(sampling + folding)


def _forest(x: np.ndarray, y: np.ndarray, j: np.ndarray) -> list[int]:
    """Places of the pairs that make a maximum spanning forest."""
    root: dict[int, int] = {}

    def top(v: int) -> int:
        while root.get(v, v) != v:
            root[v] = root.get(root[v], root[v])
            v = root[v]
        return v

    chosen = []
    for e in np.argsort(-j, kind="stable").tolist():
        s, t = top(int(x[e])), top(int(y[e]))
        if s != t:
            root[s] = t
            chosen.append(e)
    return chosen


class Members:
    """Representatives of a run of buckets, and which of them may be near duplicates by their sketches."""

    def __init__(self, table: pa.Table, threshold: float):
        self.ids, self.n, self.occupied = (table.column(c).to_numpy() for c in ("doc_id", "n", "occupied"))
        self.words = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(self.ids), BITS // 64)
        self.group = table.column("component").to_numpy() if "component" in table.column_names else self.ids
        self.side = table.column("side").to_numpy() if "side" in table.column_names else None
        self.threshold = threshold

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the pairs (x, y) and whether they may reach the threshold."""
        n, m = self.n[x].astype(float), self.n[y].astype(float)
        ok = (np.minimum(n, m) >= self.threshold * np.maximum(n, m) - 1e-9) & (self.group[x] != self.group[y])
        if self.side is not None:
            ok &= self.side[x] != self.side[y]
        j = np.zeros(len(ok))
        k = np.flatnonzero(ok)
        if len(k):
            x, y = (np.broadcast_to(v, ok.shape)[k] for v in (x, y))
            pop = np.bitwise_count(self.words[x] ^ self.words[y]).sum(axis=1, dtype=np.int64)
            j[k], sd = estimate(pop, n[k] if len(n) == len(ok) else np.full(len(k), n[0]), m[k], self.occupied[x], self.occupied[y], self.threshold)
            ok[k] = j[k] >= self.threshold - 4.5 * sd - 0.004
        return j, ok

    def small_pairs(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs within the groups of SMALL members at most; the groups begin at starts, the last entry is the end."""
        sizes = np.diff(starts)
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
            i, j = np.triu_indices(s, 1)
            base = starts[:-1][sizes == s][:, None]
            xs.append((base + i).ravel())
            ys.append((base + j).ravel())
        return np.concatenate(xs), np.concatenate(ys)


def _edges(threshold: float):
    """A maximum spanning forest of each bucket's pairs whose estimate may reach the threshold: fewer rows than members."""

    def grown(m: Members, a: int, b: int) -> Iterator[tuple[int, int]]:
        # Prim's algorithm: one member against all others a step, so that no pair is kept
        best = np.full(b - a, -np.inf)
        via = np.zeros(b - a, np.int64)
        left = np.ones(b - a, bool)
        others = np.arange(a, b)
        for _ in range(b - a):
            at = int(np.argmax(np.where(left, best, -np.inf)))
            if best[at] == -np.inf or not left[at]:
                at = int(np.argmax(left))
            else:
                yield int(via[at]), a + at
            left[at] = False
            j, ok = m.near(np.array([a + at]), others)
            better = ok & left & (j > best)
            best[better], via[better] = j[better], a + at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["key", "block"]):
            m = Members(table, threshold)
            x, y = m.small_pairs(starts)
            j, ok = m.near(x, y)
            x, y, j = x[ok], y[ok], j[ok]
            chosen = _forest(x, y, j)
            out = [(x[chosen], y[chosen])]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a > SMALL:
                    pairs = np.array(list(grown(m, int(a), int(b))), np.int64).reshape(-1, 2)
                    out.append((pairs[:, 0], pairs[:, 1]))
            x, y = (np.concatenate(c) for c in zip(*out, strict=True))
            if len(x):
                a, b = m.ids[x], m.ids[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _unsettled(threshold: float):
    """Members of a bucket with an estimate that may reach the threshold to another component: a row a member at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["key", "p", "r"]):
            m = Members(table, threshold)
            wanted = np.zeros(len(m.ids), bool)
            x, y = m.small_pairs(starts)
            _, ok = m.near(x, y)
            wanted[x[ok]] = wanted[y[ok]] = True
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                step = max(1, (1 << 15) // int(b - a))
                for i in range(a, b, step) if b - a > SMALL else ():
                    x, y = np.divmod(np.arange((min(i + step, b) - i) * (b - a)), b - a)
                    _, ok = m.near(x + i, y + a)
                    wanted[x[ok] + i] = wanted[y[ok] + a] = True
            if wanted.any():
                yield table.select(["key", "p", "r", "side", "doc_id", "component", "n"]).filter(pa.array(wanted)).combine_chunks().to_batches()[0]

    return run


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch.column(1), shingle):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])

    return run


def _confirm(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for s, t in zip(f["sa"], f["sb"], strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(s) + len(t) - len(np.union1d(s, t))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield f.loc[np.array(keep, bool), ["a", "b"]]

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: products of slices of the incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    column, owner = (np.cumsum(often) - 1)[column[often[column]]], owner[often[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(often.sum()), SLICE):
        own = slice(*np.searchsorted(column, [c, c + SLICE]))
        x = np.zeros((len(sets), SLICE), np.float32)
        x[owner[own], column[own] - c] = 1
        common += x @ x.T
    return common


def _settle(percent: int):
    """Of one part of a bucket, confirmed on the full sets: links that join its components, fewer than members."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, group, side = (frame[c].to_numpy() for c in ("doc_id", "component", "side"))
        sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        n = np.array([len(s) for s in sets], np.float32)
        common = common_counts(sets)
        linked = 100 * common >= percent * (n[:, None] + n - common)
        linked &= group[:, None] != group
        if (side != side[0]).any():
            linked &= side[:, None] != side
        left = np.ones(len(ids), bool)
        a: list[int] = []
        b: list[int] = []
        while left.any():
            wave = np.array([int(np.argmax(left))])
            left[wave] = False
            while len(wave):
                reach = linked[wave] & left
                found = np.flatnonzero(reach.any(axis=0))
                a += ids[wave[reach[:, found].argmax(axis=0)]].tolist() if len(found) else []
                b += ids[found].tolist()
                left[found] = False
                wave = found
        out = np.sort(np.array([a, b], np.int64), axis=0)
        return pd.DataFrame({"a": out[0], "b": out[1]})

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, links) of every row.

    Two texts are linked when 100 * common shingles >= percent * all their shingles. component_id is the smallest
    id that can be reached over links; links counts the confirmed links of a text's representative that the search
    needed. Bands miss a pair at the threshold with a probability below 1e-5.
    """
    t = percent / 100
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    feat = cut(source.mapInArrow(_features(shingle), _FEATURES), "features")
    reps = feat.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    picked = feat.join(reps, ["set_key", "doc_id"]).select("doc_id", "n", "occupied", "sketch", "bands").dropDuplicates(["doc_id", "sketch"])
    picked = cut(picked, "representatives")
    features = picked.select("doc_id", "n", "occupied", "sketch")
    banded = picked.select("doc_id", F.explode("bands").alias("key"))
    common = banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    parts, own = F.ceil(F.col("m") / BLOCK).cast("int"), F.expr("cast(pmod(xxhash64(doc_id, 3), parts) as int)")
    placed = cut(banded.join(common, "key").withColumn("parts", parts).withColumn("block", own), "placed")

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = cut(ids.distinct(), "ids")
        return cut(source.join(broadcast_if_small(ids, ids.count(), BROADCAST_IDS), "doc_id", "left_semi").mapInArrow(_shingle_sets(shingle), "id long, shingles binary"), "sets")

    # a forest of each block, in which some of the bucket stand in all its blocks
    hub = F.expr(f"parts > 1 and pmod(xxhash64(doc_id, 5), parts * {BLOCK // 16}) = 0")
    blocks = placed.select("key", "doc_id", F.explode(F.when(hub, F.expr("sequence(0, parts - 1)")).otherwise(F.array("block"))).alias("block")).join(features, "doc_id")
    estimated = blocks.repartition("key", "block").sortWithinPartitions("key", "block").select("key", "block", "doc_id", "n", "occupied", "sketch")
    pairs = cut(estimated.mapInArrow(_edges(t), "a long, b long").distinct(), "pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    first = cut(both.mapInPandas(_confirm(percent), "a long, b long").distinct(), "links")
    joined = cut(connected_components(first), "joined")

    # what is still apart: buckets of three or more with more than one component
    state = placed.join(joined.withColumnsRenamed({"node": "doc_id"}), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    apart = state.where("m > 2").groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    other = F.explode(F.expr("sequence(0, parts - 1)")).alias("other")
    again = (
        state.join(apart, "key")
        .select("key", "doc_id", "component", "block", other)
        .select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("r"), "doc_id", "component", "block")
        .withColumn("side", F.expr("if(p = r, doc_id, cast(block as long))"))
        .join(features, "doc_id")
        .repartition("key", "p", "r").sortWithinPartitions("key", "p", "r")
        .select("key", "p", "r", "side", "doc_id", "component", "n", "occupied", "sketch")
    )
    open_ = cut(again.mapInArrow(_unsettled(t), "key long, p int, r int, side long, doc_id long, component long, n long"), "unsettled")
    size = open_.groupBy("key", "p", "r").agg(F.ceil(F.greatest(F.count("*") / PART_ROWS, F.sum("n") * 8 / PART_BYTES)).cast("int").alias("cuts"))
    dealt = (
        open_.join(size, ["key", "p", "r"])
        .withColumn("s", F.expr("cast(pmod(xxhash64(doc_id, 11), cuts) as int)"))
        .withColumn("o", F.explode(F.expr("sequence(0, cuts - 1)")))
        .select("key", "p", "r", F.least("s", "o").alias("s"), F.greatest("s", "o").alias("o"), F.expr("if(p = r and s <> o, cast(s as long), side)").alias("side"), "doc_id", "component")
    )
    full = dealt.join(sets_of(open_.select("doc_id")).withColumnRenamed("id", "doc_id"), "doc_id")
    second = cut(full.groupBy("key", "p", "r", "s", "o").applyInPandas(_settle(percent), "a long, b long").distinct(), "links")

    links = first.unionByName(second).distinct()
    moved = second.join(joined.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left").join(joined.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
    merged = connected_components(moved.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    of_rep = (
        picked.select(F.col("doc_id").alias("rep")).distinct()
        .join(joined.withColumnsRenamed({"node": "rep", "component": "c1"}), "rep", "left")
        .withColumn("c1", F.coalesce("c1", "rep"))
        .join(merged.withColumnsRenamed({"node": "c1", "component": "c2"}), "c1", "left")
        .select("rep", F.coalesce("c2", "c1").alias("component"))
        .join(links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links")), "rep", "left")
    )
    to_rep = reps.withColumnRenamed("doc_id", "rep").join(of_rep, "rep").select("set_key", "component", "links")
    return feat.select("doc_id", "n", "set_key").join(to_rep, "set_key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )


def keep_first(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs that are the smallest of their component, and rows with a null id; all columns."""
    gone = cut(near_duplicates(docs, percent).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(broadcast_if_small(gone, gone.count(), BROADCAST_IDS), "doc_id", "left_anti").select(*quoted(docs.columns))
