"""Benchmark decontamination by greedy string tiling.

The shared-token seeds are sequences of SEED normalised words (lower case, letters and digits only). A document meets
a benchmark item when they share seeds; only such pairs are tiled: the longest match of unmarked words, found by
running Karp-Rabin over shrinking lengths, is marked in both texts, again and again, until no match of MIN_TILE words
is left. The share of the item's words that tiles cover decides, so passages are caught wherever they stand and in
whatever order their parts come.

The benchmark is read by every task in blocks of about BLOCK_ITEMS items and BLOCK_BYTES bytes (a stated set against
all rows), which bounds a broadcast. Hot seeds cost nothing extra, as no seed is ever the key
of a shuffle.

Null or blank texts and items meet nothing; items with fewer than SEED words are matched as a whole by a seed of
their own length. A pair is left untiled only if the item's places under its shared seeds can't reach the threshold. Rows with null ids take part and keep the null. Repeated rows are reported each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import broadcast_if_small, cut, mix, quoted, word_chunks

SEED = 4
MIN_TILE = 4
COVERAGE = 0.5
BLOCK_ITEMS = 20_000
#: Bytes of items in a block, about.
BLOCK_BYTES = 32 << 20
#: Below so many ids to drop they are broadcast (8 bytes each), else the texts are shuffled.
BROADCAST_IDS = 500_000
_BASE = 0xC2B2AE3D27D4EB4F
_POWERS: list[np.ndarray] = []
_NOT_WORD = re.compile(r"[\W_]+")


def words(text: str | None) -> list[str]:
    return [x for x in (_NOT_WORD.sub("", w) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower())) if x]


def word_hash(x: str) -> int:
    h = 14695981039346656037
    for b in x.encode("utf-8"):
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


def powers(n: int) -> list[np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i up to n at least."""
    if not _POWERS or len(_POWERS[0]) <= n:
        both = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(max(n + 1, 1 << 16), b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of k consecutive word hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    p, inverse = powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: len(h) - k + 1])


def _all(free: np.ndarray, k: int) -> np.ndarray:
    """Where k free words begin."""
    total = np.append(0, np.cumsum(free))
    return total[k:] - total[:-k] == k


def _run(free: np.ndarray) -> int:
    """The longest run of free words."""
    return int(np.diff(np.flatnonzero(np.concatenate([[True], ~free, [True]]))).max()) - 1


def _common(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes that free windows of k words of both have, windows of the item, windows of the text)."""
    hi, ht = windows(item, k), windows(text, k)
    return np.intersect1d(hi[_all(free_i, k)], ht[_all(free_t, k)]), hi, ht


def tiles(item: np.ndarray, text: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, text start, length), longest first, ties to the earliest in the item."""
    out = []
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    k = min(len(item), len(text))
    while k >= least:
        k = min(k, _run(free_i), _run(free_t))
        if k < least:
            break
        common, hi, ht = _common(item, text, free_i, free_t, k)
        if not len(common):
            # the longest match is shorter: whoever has one of k words has one of k - 1
            low, high = least - 1, k - 1
            while low < high:
                middle = (low + high + 1) // 2
                if len(_common(item, text, free_i, free_t, middle)[0]):
                    low = middle
                else:
                    high = middle - 1
            k = low
            continue
        ok_i, ok_t = _all(free_i, k), _all(free_t, k)
        where: dict[int, list[int]] = {}
        for t in np.flatnonzero(ok_t & np.isin(ht, common)).tolist():
            where.setdefault(int(ht[t]), []).append(t)
        for i in np.flatnonzero(ok_i & np.isin(hi, common)).tolist():
            if not free_i[i : i + k].all():
                continue
            for t in where.get(int(hi[i]), ()):
                if free_t[t : t + k].all() and (item[i : i + k] == text[t : t + k]).all():
                    free_i[i : i + k] = False
                    free_t[t : t + k] = False
                    out.append((i, t, k))
                    break
        k -= 1
    return out


class Seeds:
    """The seeds of a block of items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.ids = [i for i, _ in items]
        self.texts = [np.array([word_hash(x) for x in words(t)], np.uint64) for _, t in items]
        hashes, owners, times = [], [], []
        for k, h in enumerate(self.texts):
            s, n = np.unique(windows(h, seed) if len(h) >= seed else np.zeros(0, np.uint64), return_counts=True)
            hashes.append(s)
            times.append(n)
            owners.append(np.full(len(s), k))
        h, o = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*owners, np.zeros(0, int)])
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners = h[order], o[order].astype(np.int64)
        self.times = np.concatenate([*times, np.zeros(0, int)])[order].astype(np.int64)
        self.unique, self.first = np.unique(self.hashes, return_index=True)
        self.last = np.append(self.first[1:], len(self.hashes))
        self.short: dict[int, list[int]] = {}
        for k, h in enumerate(self.texts):
            if 0 < len(h) < seed:
                self.short.setdefault(int(windows(h, len(h))[0]), []).append(k)
        self.short_lengths = sorted({len(self.texts[k]) for own in self.short.values() for k in own})
        self.counts = np.bincount(o, minlength=len(items))


def _meet(shared, seed: int, least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Seeds = shared.value
        vocabulary = np.unique(np.concatenate([*block.texts, np.zeros(0, np.uint64)]))
        known: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0)
            out: list[tuple] = []
            for a, _, w in word_chunks(batch.column(1)):
                raw = w.data.tobytes()
                get = known.get
                h = np.zeros(len(w.starts), np.uint64)
                for k, (s, e) in enumerate(zip(w.starts.tolist(), w.ends.tolist(), strict=True)):
                    x = raw[s:e]
                    v = get(x)
                    if v is None:
                        n = _NOT_WORD.sub("", x.decode("utf-8", "replace").lower())
                        v = word_hash(n) if n else 0
                        if len(known) < 300_000:
                            known[x] = v
                    h[k] = v
                text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
                keep = h != 0
                h, text = h[keep], text[keep]
                bounds = np.searchsorted(text, np.arange(len(w.bounds)))
                pairs: dict[tuple[int, int], int] = {}
                for k in {seed, *block.short_lengths}:
                    g = windows(h, k)
                    inside = text[: len(g)] == text[k - 1 :] if len(g) else np.zeros(0, bool)
                    if k == seed and len(block.unique):
                        at = np.minimum(np.searchsorted(block.unique, g), len(block.unique) - 1)
                        hit = np.flatnonzero((block.unique[at] == g) & inside)
                        seen = np.unique(np.stack([text[hit], at[hit]]), axis=1) if len(hit) else np.zeros((2, 0), int)
                        for t, u in seen.T.tolist():
                            own = slice(block.first[u], block.last[u])
                            for o, n in zip(block.owners[own].tolist(), block.times[own].tolist(), strict=True):
                                pairs[t, o] = pairs.get((t, o), 0) + n
                    if k != seed or k in block.short_lengths:
                        for i in np.flatnonzero(inside).tolist() if block.short else ():
                            for o in block.short.get(int(g[i]), ()):
                                if len(block.texts[o]) == k:
                                    pairs[int(text[i]), o] = 10**9
                for (t, o), n in pairs.items():
                    item = block.texts[o]
                    if len(item) >= seed and n * seed < coverage * len(item):
                        continue  # n places of shared seeds cover n * seed words at most
                    body = h[bounds[t] : bounds[t + 1]]
                    near = np.isin(body, item)
                    found = tiles(item, body if near.all() else _near(body, near), min(least, len(item)))
                    covered = sum(x[2] for x in found)
                    if covered >= coverage * len(item):
                        out.append((a + t, block.ids[o], covered, len(item), len(found), max((x[2] for x in found), default=0)))
            if out:
                rows, items, covered, size, count, longest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(items, pa.int64()), pa.array(covered, pa.int32()), pa.array(size, pa.int32()), pa.array(count, pa.int32()), pa.array(longest, pa.int32())],
                    ["doc_id", "item_id", "covered", "item_words", "tiles", "longest"],
                )

    return run


def _near(body: np.ndarray, near: np.ndarray) -> np.ndarray:
    """body without words that the item doesn't have; one zero stands for each gap, so that no match crosses it."""
    keep = near.copy()
    gap = ~near
    gap[1:] &= near[:-1]
    keep |= gap
    out = body.copy()
    out[~near] = 0
    return out[keep]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, least: int = MIN_TILE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, covered, item_words, tiles, longest, coverage) of the pairs whose coverage reaches the threshold."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    total, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-total // block), -(-size // BLOCK_BYTES))
    schema = "doc_id long, item_id long, covered int, item_words int, tiles int, longest int"
    out = None
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        rows = sorted((tuple(r) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # at most about `block` items
        found = texts.mapInArrow(_meet(spark.sparkContext.broadcast(Seeds(rows, seed)), seed, least, coverage), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("coverage", F.col("covered") / F.col("item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that reach the threshold with no item; rows are told apart by a hash of id and text, so null ids are no exception."""
    key = F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))
    keys = cut(contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, coverage).select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), key.alias("__key"))
    return rows.join(broadcast_if_small(keys, keys.count(), BROADCAST_IDS), "__key", "left_anti").select("row.*")
