"""Hybrid search of chunks over batches of queries: two channels, fusion, rescoring, boost, dedup, best chunk of each page."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.search import backlink_factor, cosine, detail, evaluate_configs, intent, keyword_search, query_terms, source_factor, tokens, vector_search, without_prefixes
from lorebase.sources.shared import written

#: How alike two chunks' words may be, the greatest share of a type, chunks of a page that enter, the weight of compiled text.
SIMILAR, TYPE_SHARE, ENTER, COMPILED = 0.85, 0.6, 3, 2.0


#: Chunks of a page that a level of detail shows.
PER_PAGE = {"low": 1, "medium": 2, "high": 3}


@dataclass(frozen=True)
class Filters:
    """What a search leaves out, in both channels and before their pools are filled: other types, older pages, slug prefixes (but for those taken in again)."""

    kind: str | None = None
    since: str | None = None
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()

    def of(self, chunks: DataFrame) -> DataFrame:
        """Chunks (slug, type, and create_time where `since` is set) that may be found."""
        rows = chunks.where(F.col("type") == self.kind) if self.kind else chunks
        rows = rows.where(F.col("create_time") >= F.lit(self.since).cast("timestamp")) if self.since else rows
        return without_prefixes(rows, "slug", self.exclude, self.include)


def _ranked(hits: DataFrame, pool: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rn", rn).where(F.col("rn") <= pool)


#: Queries and chunks of one page that meet in a task, about, and chunks that are counted at once.
ASKED, CHUNKS, COUNTED = 1024, 4096, 256
#: Words whose terms a task remembers.
REMEMBERED = 1 << 18


def _most_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunk with most terms of each query of a tile, from rows (page_id, x, y, role, at, id, words) sorted by tile, its queries (role 0, id, terms) first.

    A term is in a chunk if it begins one of its words. Ties go to the smaller place, then to the smaller id.
    """
    key, asked, q, best = None, [], None, None

    def done() -> Iterator[pa.RecordBatch]:
        if best is not None and best[0][0] >= 0:
            n = len(q[0])
            yield pa.RecordBatch.from_arrays([pa.array(q[0]), pa.array(np.full(n, key[0])), pa.array(best[0]), pa.array(best[1]), pa.array(best[2])], ["query_id", "page_id", "hits", "chunk_index", "id"])

    def begin() -> tuple:
        ids, terms = [i for i, _ in asked], [t.split(" ") for _, t in asked]
        number = {t: n for n, t in enumerate(dict.fromkeys(t for own in terms for t in own))}
        wants = np.zeros((len(number), len(ids)), np.float32)
        for column, own in enumerate(terms):
            wants[[number[t] for t in own], column] = 1
        return np.array(ids, np.int64), number, sorted({len(t) for t in number}), wants, {}

    def count(part: pa.RecordBatch) -> None:
        _, number, lengths, wants, known = q
        has = np.zeros((len(part), len(number)), np.float32)
        for row, words in enumerate(part.column(6).to_pylist()):
            found = set()
            for w in set((words or "").split(" ")):
                own = known.get(w)
                if own is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    own = known[w] = tuple(number[w[:n]] for n in lengths if n <= len(w) and w[:n] in number)
                if own:
                    found.update(own)
            has[row, list(found)] = 1
        place, ids = part.column(4).to_numpy(), part.column(5).to_numpy()
        order = np.lexsort((ids, place))
        hits = (has[order] @ wants).astype(np.int64)
        first = hits.argmax(axis=0)
        now = hits[first, np.arange(hits.shape[1])], place[order][first], ids[order][first]
        better = (now[0] > best[0]) | ((now[0] == best[0]) & ((now[1] < best[1]) | ((now[1] == best[1]) & (now[2] < best[2]))))
        for old, new in zip(best, now, strict=True):
            old[better] = new[better]

    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in range(4)]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
        cuts = np.flatnonzero(new).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
            at, part = tuple(int(c[a]) for c in columns[:3]), batch.slice(a, b - a)
            if at != key:
                yield from done()
                key, asked, q, best = at, [], None, None
            if int(columns[3][a]) == 0:
                asked += zip(part.column(5).to_pylist(), part.column(6).to_pylist(), strict=True)
                continue
            if not asked:
                continue
            if q is None:
                q = begin()
                best = tuple(np.full(len(q[0]), x, np.int64) for x in (-1, 0, 0))
            for k in range(0, b - a, COUNTED):
                count(part.slice(k, COUNTED))
    yield from done()


def keyword_chunks(queries: DataFrame, index: DataFrame, chunks: DataFrame, pool: int) -> DataFrame:
    """(query_id, page_id, id, score, rn): the best chunk of each page that the keyword index finds.

    chunks: (id, page_id, chunk_index, chunk_text, slug). A page's score is its rank times its source's factor; 2 * pool
    pages go on, each with the chunk that has most of the terms, the first of equals. Pages without chunks are not found.

    A page's chunks meet the queries that found it in tiles of both, as groups of one shuffle: a chunk's words are looked
    at once a tile, whatever the number of queries, and a tile hands up one chunk a query.
    """
    page = chunks.select("page_id", "slug").distinct()
    found = keyword_search(queries, index, 1 << 30).join(page, "page_id").withColumn("score", F.col("score") * source_factor(F.col("slug")))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id"))
    top = written(found.withColumn("k", order).where(F.col("k") <= 2 * pool).select("query_id", "page_id", "score"), "top")
    parts = lambda rows, size, name: rows.groupBy("page_id").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    tiles = parts(top, ASKED, "asked").join(parts(chunks, CHUNKS, "held"), "page_id")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    page_id = F.col("page_id").cast("long").alias("page_id")
    terms = queries.select("query_id", F.array_join(query_terms(F.col("text")), " ").alias("terms"))
    q = top.join(terms, "query_id").join(tiles, "page_id").select(page_id, own("query_id", "asked").alias("x"), each("held").alias("y"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("at"), F.col("query_id").cast("long").alias("id"), F.col("terms").alias("words"))
    first = F.coalesce(F.col("chunk_index").cast("long"), F.lit(-(1 << 63)).cast("long"))  # nulls come first
    c = chunks.join(tiles, "page_id").select(page_id, each("asked").alias("x"), own("id", "held").alias("y"), F.lit(1).alias("role"), first.alias("at"), F.col("id").cast("long").alias("id"), F.array_join(F.array_distinct(tokens(F.col("chunk_text"))), " ").alias("words"))
    met = q.unionByName(c).repartition("page_id", "x", "y").sortWithinPartitions("page_id", "x", "y", "role").mapInArrow(_most_terms, "query_id long, page_id long, hits long, chunk_index long, id long")
    best = F.row_number().over(Window.partitionBy("query_id", "page_id").orderBy(F.desc("hits"), "chunk_index", "id"))
    one = met.withColumn("b", best).where("b = 1").join(top, ["query_id", "page_id"]).select("query_id", "page_id", "id", "score")
    return _ranked(one, pool)


def vector_chunks(query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, pool: int) -> DataFrame:
    """(query_id, page_id, id, score, rn): of the 3 * pool nearest chunks those with the best score times their source's factor."""
    own = vectors.join(chunks.select("id"), "id", "left_semi")
    near = vector_search(query_vectors, own, 3 * pool).select("query_id", "id", "score").join(chunks.select("id", "page_id", "slug"), "id")
    return _ranked(near.select("query_id", "page_id", "id", (F.col("score") * source_factor(F.col("slug"))).alias("score")), pool)


def fuse_chunks(lists: list[DataFrame], chunks: DataFrame, natural: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, page_id, chunk_type, score, rrf_raw, rrf_norm, rrf_boost, keyword_rank, vector_rank): reciprocal-rank fusion of chunk lists, the keyword list first.

    Scores are relative to the query's best; compiled text counts twice but for queries in natural (query_id). The ranks
    are that in the keyword list and the best one in the others.
    """
    parts = [df.select("query_id", "id", (1 / (k + F.col("rn") - 1)).alias("s"), F.when(F.lit(i == 0), F.col("rn")).alias("keyword_rank"), F.when(F.lit(i > 0), F.col("rn")).alias("vector_rank")) for i, df in enumerate(lists)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    fused = rows.groupBy("query_id", "id").agg(F.sum("s").alias("rrf_raw"), F.min("keyword_rank").alias("keyword_rank"), F.min("vector_rank").alias("vector_rank"))
    fused = fused.withColumn("rrf_norm", F.col("rrf_raw") / F.max("rrf_raw").over(Window.partitionBy("query_id")))
    fused = fused.join(chunks.select("id", "page_id", "chunk_type"), "id").join(natural.select("query_id").distinct().withColumn("natural", F.lit(True)), "query_id", "left")
    boost = F.when((F.col("chunk_type") == "compiled_truth") & F.col("natural").isNull(), COMPILED).otherwise(1.0)
    return fused.select("query_id", "id", "page_id", "chunk_type", (F.col("rrf_norm") * boost).alias("score"), "rrf_raw", "rrf_norm", boost.alias("rrf_boost"), "keyword_rank", "vector_rank")


def dedupe_hits(hits: DataFrame, similar: float = SIMILAR, type_share: float = TYPE_SHARE) -> DataFrame:
    """Hits (query_id, page_id, id, score, type, chunk_type, chunk_text, per_page) without what repeats.

    The best three of a page enter; a hit goes whose words are too like those of a better one; of each page type at most
    ceil(share of all) stay, of each page per_page; a page without compiled text gets its best one in place of its worst.
    A query has a pool of hits at most, so each query is one small group.
    """

    def thin(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "id"], ascending=[False, True])
        kept, bags = [], []
        for i, text in f[f.groupby("page_id").cumcount() < ENTER]["chunk_text"].items():
            bag = set((text or "").lower().split())
            if not any(len(bag | b) and len(bag & b) / len(bag | b) > similar for b in bags):
                kept.append(i)
                bags.append(bag)
        out = f.loc[kept]
        out = out[out.groupby("type").cumcount() < max(1, -int(-len(out) * type_share // 1))]
        out = out[out.groupby("page_id").cumcount() < int(f["per_page"].iloc[0])]
        compiled = f[f["chunk_type"] == "compiled_truth"].drop_duplicates("page_id")
        lacking = set(compiled["page_id"]) & (set(out["page_id"]) - set(out.loc[out["chunk_type"] == "compiled_truth", "page_id"]))
        worst = out[out["page_id"].isin(lacking)].drop_duplicates("page_id", keep="last").index
        return pd.concat([out.drop(worst), compiled[compiled["page_id"].isin(lacking)]]).drop(columns=["chunk_text", "per_page", "chunk_type"])

    columns = ["query_id", "page_id", "id", "score", "type"]
    return hits.groupBy("query_id").applyInPandas(lambda f: thin(f)[columns], "query_id long, page_id long, id long, score double, type string")


def page_hits(scored: DataFrame, chunks: DataFrame, levels: DataFrame, limit: int) -> DataFrame:
    """(query_id, page_id, id, score, rank) of scored chunks (query_id, page_id, id, score): thinned, the best chunk of each page, the best pages."""
    rows = scored.select("query_id", "page_id", "id", "score").join(chunks.select("id", "chunk_type", "chunk_text", "type"), "id").join(levels, "query_id")
    kept = dedupe_hits(rows.select("query_id", "page_id", "id", "score", "type", "chunk_type", "chunk_text", "per_page"))
    best = F.row_number().over(Window.partitionBy("query_id", "page_id").orderBy(F.desc("score"), "id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return kept.withColumn("b", best).where("b = 1").withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "page_id", "id", "score", "rank")


#: What a hit was made of, with `explain`.
PARTS = ("keyword_rank", "vector_rank", "rrf_raw", "rrf_norm", "rrf_boost", "cosine", "blended", "backlinks", "backlink_boost")


def hybrid_chunks(queries: DataFrame, query_vectors: DataFrame | None, index: DataFrame, chunks: DataFrame, vectors: DataFrame | None, backlinks: DataFrame, variants: DataFrame | None = None, limit: int = 10, filters: Filters | None = None, explain: bool = False) -> DataFrame:
    """(query_id, page_id, id, score, rank): the whole search; with explain also the columns of PARTS.

    queries (query_id, text, and detail where it is set: low, medium or high), query_vectors (query_id, embedding), index
    as of postings, chunks (id, page_id, chunk_index, chunk_text, chunk_type, slug, type), vectors (id, embedding),
    backlinks (page_id, backlinks), variants (query_id, channel, embedding): each channel is one more vector list.

    Without a vector (all of them: query_vectors is None) a query's hits are the keyword list by score over its best,
    with no boosts. The detail follows from the intent where it is not set; searches of high detail don't favour compiled
    text. A query whose channels find nothing has no row, at low detail neither than at high, which it would be run at.
    """
    pool = max(4 * limit, 30)
    chunks = (filters or Filters()).of(chunks)
    kind = queries.select("query_id", intent(F.col("text")).alias("intent"), (F.lower("detail") if "detail" in queries.columns else F.lit(None).cast("string")).alias("set"))
    shown = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PER_PAGE.items() for x in p]), F.when(F.col("set").isin(*PER_PAGE), F.col("set"))), detail(F.col("intent")))
    levels = kind.select("query_id", shown.alias("per_page"))
    natural = kind.where((F.col("set") == "high") | (F.col("set").isNull() & F.col("intent").isin("temporal", "event")))
    words = written(keyword_chunks(queries, index, chunks, pool), "words")
    none = {c: F.lit(None).cast("int" if c.endswith("_rank") else "long" if c == "backlinks" else "double").alias(c) for c in PARTS}
    alone = words if query_vectors is None else words.join(query_vectors.select("query_id").distinct(), "query_id", "left_anti")
    relative = F.col("score") / F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1e-9))
    alone = alone.select("query_id", "page_id", "id", F.round(relative, 6).alias("score"), F.col("rn").alias("keyword_rank"), *[none[c] for c in PARTS[1:]])
    scored = alone
    if query_vectors is not None:
        own = words.join(query_vectors.select("query_id").distinct(), "query_id", "left_semi")
        lists = [own, vector_chunks(query_vectors, chunks, vectors, pool)]
        if variants is not None:
            lists += [vector_chunks(variants.where(F.col("channel") == c).select("query_id", "embedding"), chunks, vectors, pool) for c in (1, 2)]
        fused = fuse_chunks(lists, chunks, natural).join(query_vectors.withColumnRenamed("embedding", "q"), "query_id", "left").join(vectors.select("id", "embedding"), "id", "left").join(backlinks, "page_id", "left")
        # 0.7 of the fused score over the query's best, 0.3 of the cosine; 0.5 stands for a missing one
        best = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
        near = F.when(F.col("embedding").isNotNull() & F.col("q").isNotNull(), cosine(F.col("q"), F.col("embedding")))
        fused = fused.withColumn("cosine", near).withColumn("backlinks", F.coalesce("backlinks", F.lit(0)).cast("long")).withColumn("backlink_boost", backlink_factor(F.col("backlinks")))
        fused = fused.withColumn("blended", F.round(0.7 * best + 0.3 * F.coalesce("cosine", F.lit(0.5)), 5))
        scored = fused.select("query_id", "page_id", "id", F.round(F.col("blended") * F.col("backlink_boost"), 6).alias("score"), *PARTS).unionByName(alone)
    hits = page_hits(scored, chunks, levels, limit)
    return hits.join(scored.select("query_id", "id", *PARTS), ["query_id", "id"]).select(*hits.columns, *PARTS) if explain else hits


def run_eval(runs: dict[str, DataFrame], qrels: DataFrame, k: int = 5) -> DataFrame:
    """Mean precision, recall, reciprocal rank and nDCG at k of runs (name: query_id, page_id, rn), over all queries with judgements."""
    return evaluate_configs(runs, qrels, k)
