"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The n-grams are of bytes as they are (nothing is folded), of order five; a code holds one in a long, so suffixes and
contexts are masks and shifts. Four of five trusted texts are counted per task, the counts summed over the cluster by
n-gram; continuation counts, context sums, discounts and back-off weights are tables that joins and aggregates make
of that count table, all dealt by n-gram. Documents are put in blocks of some megabytes. A block asks for its distinct
n-grams; the distinct n-grams of all blocks get their probabilities through joins with the count tables, order by
order; the answers go back to the blocks, which meet their texts, moved as compressed runs, in a cogroup that gives each
document its perplexity per byte. A document is kept when that is not above a quantile of its language, taken over the trusted texts that the
model has not seen, so that it is held against a rule for new text.

Null and blank texts have no perplexity (null) and are not kept. A null language, or one without such trusted texts,
is held against the quantile over all of them; without any, everything with words is kept. Rows with null ids are
scored. Repeated rows count each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import broadcast_if_small, cut, fold, text_chunks

ORDER = 5
QUANTILE = 0.995
#: One in so many trusted texts is not learned from; the thresholds come from these.
HELD_OUT = 5
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK = 32 << 20
_CHUNK = 1 << 20
#: N-grams of a task that wait to be summed.
_WAITING = 1 << 22
#: Trusted ids (8 bytes each) up to which they are broadcast to the texts; beyond, both are shuffled.
BROADCAST_IDS = 500_000


def _codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER - 1 before it as one number; zeros stand before a text."""
    x = data.astype(np.int64)
    code = x.copy()
    place = np.arange(len(x)) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, ORDER):
        back = np.zeros_like(x)
        back[k:] = x[:-k]
        back[place < k] = 0
        code |= back << (8 * k)
    return code


_RUN = "block long, ids array<long>, langs array<string>, trusted array<boolean>, words array<boolean>, held array<boolean>, lengths array<int>, size int, data binary"
_FIELDS = ("ids", "langs", "trusted", "words", "held")


def _zstd(data: bytes) -> bytes:
    """Texts and answers move compressed; level 5 takes a sixth less than the default, for 20 seconds a GB of text."""
    return pa.Codec("zstd", compression_level=5).compress(data, asbytes=True)


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows (doc_id, text, lang, trusted, words, held): a run is one row with its texts compressed; a block is some runs of one task."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for a, b, data, offsets in text_chunks(batch.column(1), _CHUNK):
            if size and size + len(data) > BLOCK:
                block, size = block + 1, 0
            size += len(data)
            columns = [batch.column(k).slice(a, b - a) for k in (0, 2, 3, 4, 5)]
            whole = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), c) for c in columns]
            lengths = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.array(np.diff(offsets).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([block]), *whole, lengths, pa.array([len(data)], pa.int32()), pa.array([_zstd(data.tobytes())], pa.binary())], ["block", *_FIELDS, "lengths", "size", "data"])


def _runs(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, dict]]:
    """(block, fields) of runs: arrays of the rows, `data` their bytes, `at` where each text begins and the last one ends."""
    for r in rows.to_pylist():
        data = np.frombuffer(pa.decompress(r["data"], r["size"], "zstd", asbytes=True) if r["size"] else b"", np.uint8)
        yield r["block"], {f: r[f] for f in _FIELDS} | {"data": data, "at": np.concatenate([[0], np.cumsum(r["lengths"])]).astype(np.int64)}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of the trusted texts that aren't held out, with how often a task has them."""
    codes, times, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        u, place = np.unique(np.concatenate(codes), return_inverse=True)
        return u, np.bincount(place, np.concatenate(times), len(u)).astype(np.int64)

    for batch in batches:
        for k in range(batch.num_rows):
            for _, run in _runs(batch.slice(k, 1)):
                learned = np.array(run["trusted"]) & np.array(run["words"]) & ~np.array(run["held"])
                u, n = np.unique(_codes(run["data"], run["at"])[np.repeat(learned, np.diff(run["at"]))], return_counts=True)
                codes.append(u)
                times.append(n)
                waiting += len(u)
            if waiting > _WAITING:
                u, n = summed()
                codes, times, waiting = [u], [n], 0
                if len(u) > _WAITING // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["code", "n"])
                    codes, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    u, n = summed()
    for k in range(0, len(u), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 100_000]), pa.array(n[k : k + 100_000])], ["code", "n"])


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each block among a task's runs."""
    now, found = None, []

    def asked() -> Iterator[pa.RecordBatch]:
        u = np.unique(np.concatenate(found))
        for k in range(0, len(u), 100_000):
            part = u[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), now)), pa.array(part)], ["block", "code"])

    for batch in batches:
        for k in range(batch.num_rows):
            for block, run in _runs(batch.slice(k, 1)):
                if block != now and found:
                    yield from asked()
                    found = []
                now = block
                found.append(np.unique(_codes(run["data"], run["at"])))
    if found:
        yield from asked()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers (block, code, p) of a task as a row a block: n, the steps between its sorted codes and their p, compressed."""
    kept: list[pa.RecordBatch] = []

    def rows() -> Iterator[pa.RecordBatch]:
        block, codes, p = (np.concatenate([b.column(k).to_numpy() for b in kept]) for k in range(3))
        order = np.lexsort((codes, block))
        block, codes, p = block[order], codes[order], p[order].astype(np.float32)
        starts = np.concatenate([np.flatnonzero(np.diff(block, prepend=block[0] - 1)), [len(block)]])
        for k in range(0, len(starts) - 1, 1000):
            spans = list(zip(starts[k : k + 1000], starts[k + 1 : k + 1001], strict=False))
            made = [[_zstd(x.tobytes()) for x in (np.diff(codes[a:b], prepend=0).astype(np.int64), p[a:b])] for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array([block[a] for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int32()), *[pa.array(c, pa.binary()) for c in zip(*made, strict=True)]], ["block", "n", "codes", "ps"])

    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
        if sum(b.num_rows for b in kept) > _WAITING:
            yield from rows()
            kept.clear()
    if kept:
        yield from rows()


def _unpacked(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted codes of a block's answers, each once, and their p."""
    codes, ps = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for r in answers.to_pylist():
        codes.append(np.cumsum(np.frombuffer(pa.decompress(r["codes"], 8 * r["n"], "zstd", asbytes=True), np.int64)))
        ps.append(np.frombuffer(pa.decompress(r["ps"], 4 * r["n"], "zstd", asbytes=True), np.float32))
    codes, place = np.unique(np.concatenate(codes), return_index=True)
    return codes, np.concatenate(ps)[place]


def suffix(code: Column, k: int) -> Column:
    return code.bitwiseAND(F.lit((1 << (8 * k)) - 1))


def kneser_ney(counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """By order: (code, own) with the discounted share of each n-gram, and (context, rest) with what its context leaves to shorter ones."""
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # of lower orders, in how many contexts an n-gram goes on
        tables[k] = cut(tables[k + 1].groupBy(suffix(F.col("code"), k).alias("code")).agg(F.count("*").alias("n")), f"order{k}")
    model = {}
    for k, t in tables.items():
        some = {r[0]: r[1] for r in t.where("n <= 4").groupBy("n").count().collect()}
        n1, n2, n3, n4 = (float(some.get(i, 0)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        discounts = [min(max(d, 0.05), top) for d, top in ((1 - 2 * y * n2 / max(n1, 1), 0.95), (2 - 3 * y * n3 / max(n2, 1), 1.9), (3 - 4 * y * n4 / max(n3, 1), 2.8))]
        context = F.shiftright("code", 8)
        d = F.when(F.col("n") == 1, discounts[0]).when(F.col("n") == 2, discounts[1]).otherwise(discounts[2])
        sums = cut(t.groupBy(context.alias("context")).agg(F.sum("n").alias("whole"), F.sum(d).alias("off")), f"contexts{k}")
        own = t.withColumn("context", context).join(sums, "context").select("code", ((F.col("n") - d) / F.col("whole")).alias("own"))
        model[k] = (own, sums.select("context", (F.col("off") / F.col("whole")).alias("rest")))
    return model


def probabilities(asked: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(code, p) of the asked n-grams (code, each once): the discounted share, and what is left times the shorter one's p."""
    wanted = {ORDER: asked}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = cut(wanted[k + 1].select(suffix(F.col("code"), k).alias("code")).distinct(), f"asked{k}")
    shorter = asked.sparkSession.createDataFrame([(0, 1.0 / 256)], "code long, p double")
    for k in range(1, ORDER + 1):
        own, rest = model[k]
        met = (
            wanted[k].withColumn("context", F.shiftright("code", 8)).withColumn("less", suffix(F.col("code"), k - 1))
            .join(own, "code", "left").join(rest, "context", "left").join(shorter.withColumnsRenamed({"code": "less", "p": "q"}), "less")
        )
        shorter = cut(met.select("code", (F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("q")).alias("p")), f"p{k}")
    return shorter


_SCORED = "doc_id long, lang string, trusted boolean, words boolean, held boolean, perplexity double"


def _perplexities(runs: pa.Table, answers: pa.Table) -> pa.Table:
    codes, p = _unpacked(answers)
    bits = np.log2(p.astype(np.float64))
    out = []
    for k in range(runs.num_rows):
        for _, run in _runs(runs.slice(k, 1)):
            at = run["at"]
            n = np.diff(at)
            full = np.flatnonzero((n > 0) & np.array(run["words"]))
            score = np.full(len(n), np.nan)
            if len(full):
                each = bits[np.searchsorted(codes, _codes(run["data"], at))]
                total = np.concatenate([[0.0], np.cumsum(each)])
                score[full] = np.exp2(-(total[at[full + 1]] - total[at[full]]) / n[full])
            out.append(pa.Table.from_arrays([pa.array(run["ids"], pa.int64()), pa.array(run["langs"], pa.string()), pa.array(run["trusted"], pa.bool_()), pa.array(run["words"], pa.bool_()), pa.array(run["held"], pa.bool_()), pa.array(score, from_pandas=True)], ["doc_id", "lang", "trusted", "words", "held", "perplexity"]))
    return pa.concat_tables(out)


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, trusted, perplexity, threshold, keep) of all rows of docs (doc_id, text, lang); trusted has doc_id."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.join(broadcast_if_small(ids, ids.count(), BROADCAST_IDS), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    words = F.coalesce(F.trim(F.translate("text", "\t\n\u000b\u000c\r", "     ")) != "", F.lit(False))
    rows = rows.select("doc_id", "text", "lang", "trusted", words.alias("words"), (F.col("trusted") & (fold("doc_id", HELD_OUT) == 0)).alias("held"))
    blocks = cut(rows.mapInArrow(_in_blocks, _RUN), "blocks")
    counts = cut(blocks.mapInArrow(_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "order5")
    if counts.isEmpty():
        none = F.lit(None).cast("double")
        return rows.select("doc_id", "lang", "trusted", none.alias("perplexity"), none.alias("threshold"), F.col("words").alias("keep"))
    requests = blocks.mapInArrow(_requests, "block long, code long")
    # dealt by n-gram before they are gathered: rows of two longs move, not partial sets
    asked = cut(requests.repartition("code").groupBy("code").agg(F.collect_set("block").alias("blocks")), "asked")
    p = probabilities(asked.select("code"), kneser_ney(counts))
    answers = asked.join(p, "code").select(F.explode("blocks").alias("block"), "code", F.col("p").cast("float").alias("p"))
    answers = answers.mapInArrow(_packed, "block long, n int, codes binary, ps binary")
    scored = cut(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_perplexities, _SCORED), "perplexities")
    unseen = scored.where("held and perplexity is not null")
    by_lang = cut(unseen.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 100_000).alias("own")).where("lang is not null"), "thresholds")
    overall = unseen.agg(F.percentile_approx("perplexity", quantile, 100_000).alias("all"))
    done = scored.join(broadcast_if_small(by_lang, by_lang.count(), 10_000), "lang", "left").withColumn("threshold", F.coalesce("own", overall.scalar()))
    fits = F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))
    return done.select("doc_id", "lang", "trusted", "perplexity", "threshold", F.coalesce(F.col("words") & fits, F.lit(False)).alias("keep"))
