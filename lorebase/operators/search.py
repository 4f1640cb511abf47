"""Retrieval over batches of queries, and its evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that a query does not search for.
STOPWORDS = (
    "the", "a", "an", "of", "to", "in", "for", "on", "and", "or",
    "is", "are", "was", "were", "be", "been", "being",
    "find", "search", "show", "give", "tell", "list", "all", "any", "some",
    "what", "who", "which", "when", "where", "why", "how",
    "site", "filetype", "inurl", "intitle", "www", "com", "org", "io",
    "的", "了", "和", "与", "或", "是", "在", "有", "我", "你", "他", "它",
)

#: Slug prefixes and their score factors.
SOURCE_FACTORS = {
    "sources/Arete-": 1.5,
    "sources/Merit-": 1.4,
    "sources/MS-": 1.3,
    "sources/BofA-": 1.3,
    "sources/Daiwa-": 1.3,
    "sources/Nomura-": 1.3,
    "sources/SMBC-": 1.3,
    "sources/Verdent-": 1.3,
    "sources/sub-": 1.1,
    "sources/ace-": 1.0,
    "sources/mm-": 1.0,
    "sources/meeting_minutes-": 1.0,
    "sources/vk-": 0.9,
    "sources/cb-": 0.6,
    "companies/": 1.4,
    "industries/": 1.4,
    "theses/": 1.5,
    "concepts/": 1.2,
}

#: Patterns (case does not matter) by which a query's intent is told, in the order in which kinds are tried.
INTENT_PATTERNS = (
    ("temporal", (
        r"\beverything\b",
        r"\ball\s+(about|info|information|details)\b",
        r"\bfull\s+(history|context|picture|story|details)\b",
        r"\bcomprehensive\b",
        r"\bdeep\s+dive\b",
        r"\bgive\s+me\s+everything\b",
        r"全部|所有|完整",
    )),
    ("temporal", (
        r"\bwhen\b",
        r"\blast\s+(met|meeting|call|conversation|chat|talked|spoke|seen|heard|time)\b",
        r"\brecent(ly)?\b",
        r"\bhistory\b",
        r"\btimeline\b",
        r"\bmeeting\s+notes?\b",
        r"\bwhat('s| is| was)\s+new\b",
        r"\blatest\b",
        r"\bupdate(s)?\s+(on|from|about)\b",
        r"\bhow\s+long\s+(ago|since)\b",
        r"\b\d{4}[-/]\d{2}\b",
        r"\blast\s+(week|month|quarter|year)\b",
        r"最近|近期|最新|时间线|历史",
    )),
    ("event", (
        r"\bannounce[ds]?(ment)?\b",
        r"\blaunch(ed|es|ing)?\b",
        r"\braised?\s+\$?\d",
        r"\bfund(ing|raise)\b",
        r"\bIPO\b",
        r"\bacquisition\b",
        r"\bmerge[drs]?\b",
        r"\bnews\b",
        r"\bhappened?\b",
        r"\bguidance\b",
        r"\bearnings\b",
        r"发布|公告|融资|并购|上市|财报|指引",
    )),
    ("entity", (
        r"\bwho\s+is\b",
        r"\bwhat\s+(is|does|are)\b",
        r"\btell\s+me\s+about\b",
        r"\bdescribe\b",
        r"\bsummar(y|ize)\b",
        r"\boverview\b",
        r"\bbackground\b",
        r"\bprofile\b",
        r"\bwhat\s+do\s+(you|we)\s+know\b",
        r"是谁|是什么|介绍|概览|简介",
    )),
)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits, _ and -."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_\-]+"), lambda w: w != "")


def query_terms(text: Column, most: int = 16) -> Column:
    """The first distinct search terms of a query: no operators such as site:x, no short ASCII words, no stopwords."""
    cleaned = F.regexp_replace(text, r"(?i)\b(?:site|filetype|inurl|intitle|cache|info|related)\s*:\s*\S+", " ")
    keep = F.filter(tokens(cleaned), lambda w: ~(w.rlike(r"^[a-z0-9_-]+$") & (F.length(w) < 3)) & ~w.isin(*STOPWORDS))
    return F.slice(F.array_distinct(keep), 1, most)


def source_factor(slug: Column, factors: dict[str, float] | None = None) -> Column:
    """The factor of the longest prefix that fits, else 1."""
    out = F.lit(1.0)
    for prefix, x in sorted((factors or SOURCE_FACTORS).items(), key=lambda p: len(p[0])):
        out = F.when(slug.startswith(prefix), x).otherwise(out)
    return out


def without_prefixes(df: DataFrame, slug: str, exclude: tuple[str, ...], include: tuple[str, ...] = ()) -> DataFrame:
    for p in exclude:
        if p not in include:
            df = df.where(~F.col(slug).startswith(p))
    return df


def postings(texts: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(page_id, token, weight, tf) of the given text fields of texts (page_id, ...)."""
    parts = [texts.select("page_id", F.explode(tokens(F.coalesce(F.col(f), F.lit("")))).alias("token"), F.lit(w).alias("weight")) for f, w in fields.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("page_id", "token", "weight").agg(F.count("*").alias("tf"))


def keyword_search(queries: DataFrame, index: DataFrame, pool: int = 50) -> DataFrame:
    """(query_id, page_id, score, rn): pages by the sum of weight * ln(1 + tf) over terms that begin a token.

    Terms meet the dictionary of tokens, not the postings, by their first letters (three, or all of a shorter term); each term's matching tokens then
    join the postings. Prefix matches of a term add their tf; the sum is divided by the number of terms.
    """
    q = queries.select("query_id", F.explode(query_terms(F.col("text"))).alias("term"))
    count = q.groupBy("query_id").agg(F.count("*").alias("terms"))
    terms = q.select("term").distinct().withColumn("head", F.substring("term", 1, 3))
    heads = F.array_distinct(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(F.col("token"), F.lit(1), n)))
    dictionary = index.select("token").distinct().withColumn("head", F.explode(heads))
    matches = terms.join(dictionary, "head").where(F.col("token").startswith(F.col("term"))).select("term", "token")
    met = matches.join(index, "token").groupBy("term", "page_id", "weight").agg(F.sum("tf").alias("tf"))
    part = met.groupBy("term", "page_id").agg(F.sum(F.col("weight") * F.log(1 + F.col("tf"))).alias("s"))
    scored = q.join(part, "term").groupBy("query_id", "page_id").agg(F.sum("s").alias("s")).join(count, "query_id")
    scored = scored.select("query_id", "page_id", F.round(F.col("s") / F.col("terms"), 6).alias("score"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id"))
    return scored.withColumn("rn", rn).where(F.col("rn") <= pool)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their shorter length; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.coalesce(u.cast("double") * v.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


#: Queries and vectors of a tile, about: a task holds the queries of one tile and streams its vectors through.
QUERY_TILE, VECTOR_TILE = 1024, 1 << 16


def _best(ids: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `keep` of each row by score to five decimals, ties by id; -inf is nothing."""
    low = np.round(scores, 5)
    if scores.shape[1] > keep:
        least = np.partition(low, low.shape[1] - keep, axis=1)[:, low.shape[1] - keep]
        row, column = np.nonzero((low >= least[:, None]) & np.isfinite(low))
    else:
        row, column = np.nonzero(np.isfinite(low))
    order = np.lexsort((ids[row, column], -low[row, column], row))
    row, column = row[order], column[order]
    starts = np.searchsorted(row, np.arange(len(scores)))
    place = np.arange(len(row)) - starts[row]
    row, column, place = (x[place < keep] for x in (row, column, place))
    have, best = np.zeros((len(scores), keep), np.int64), np.full((len(scores), keep), -np.inf)
    have[row, place], best[row, place] = ids[row, column], scores[row, column]
    return have, best


def _tiles(pool: int):
    """The best of each query of a tile, from rows (n, q, v, role, id, embedding) sorted by tile, its queries (role 0) first."""

    def vectors(column: pa.Array, n: int) -> np.ndarray:
        return np.nan_to_num(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, q, have, best = None, [], None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if q is not None:
                fine = np.isfinite(best)
                rows = np.nonzero(fine)[0]
                yield pa.RecordBatch.from_arrays([pa.array(q[0][rows]), pa.array(have[fine]), pa.array(best[fine])], ["query_id", "id", "score"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in range(4)]
            new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
            cuts = np.flatnonzero(new).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                at, role = tuple(int(c[a]) for c in columns[:3]), int(columns[3][a])
                part = batch.slice(a, b - a)
                if at != key:
                    yield from done()
                    key, asked, q = at, [], None
                if role == 0:
                    asked.append((part.column(4).to_numpy(), vectors(part.column(5), at[0])))
                    continue
                if not asked:
                    continue  # no query of this length
                if q is None:
                    q = np.concatenate([i for i, _ in asked]), np.concatenate([x for _, x in asked])
                    size = np.linalg.norm(q[1], axis=1)
                    have, best = np.zeros((len(q[0]), 0), np.int64), np.zeros((len(q[0]), 0))
                for c in range(0, b - a, 4096):
                    some = part.slice(c, 4096)
                    ids, v = some.column(4).to_numpy(), vectors(some.column(5), at[0])
                    norm = size[:, None] * np.linalg.norm(v, axis=1)
                    score = 1 / (2 - np.divide(q[1] @ v.T, norm, out=np.zeros_like(norm), where=norm > 0))
                    score[q[0][:, None] == ids] = -np.inf
                    have, best = _best(np.concatenate([have, np.broadcast_to(ids, score.shape)], 1), np.concatenate([best, score], 1), 2 * pool)
        yield from done()

    return run


def vector_search(queries: DataFrame, vectors: DataFrame, pool: int = 50, query_tile: int = QUERY_TILE, vector_tile: int = VECTOR_TILE) -> DataFrame:
    """(query_id, id, score, rn): nearest vectors by 1 / (1 + cosine distance), to five decimals, ties by id; never the query's own id.

    Queries and vectors are dealt in tiles by their hash, every tile of queries meets every tile of vectors of its length
    as one group of a shuffle, and hands up its best; their number comes from two counts, the rows never pass the driver.
    A zero vector has cosine 0 with all. A repeated query id counts each of its vectors' best.
    """
    whole = lambda df, key: df.where(F.col("embedding").isNotNull()).select(F.size("embedding").alias("n"), F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked, rows = whole(queries, "query_id"), whole(vectors, "id")
    nq, nv = max(1, -(-asked.count() // query_tile)), max(1, -(-rows.count() // vector_tile))
    dealt = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    q = asked.select("n", dealt(nq).alias("q"), each(nv).alias("v"), F.lit(0).alias("role"), "id", "embedding")
    v = rows.select("n", each(nq).alias("q"), dealt(nv).alias("v"), F.lit(1).alias("role"), "id", "embedding")
    tiles = q.unionByName(v).repartition("n", "q", "v").sortWithinPartitions("n", "q", "v", "role")
    found = tiles.mapInArrow(_tiles(pool), "query_id long, id long, score double")
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("score", F.round("score", 5)).withColumn("rn", rn).where(F.col("rn") <= pool)


def rrf_fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, page_id, rn from 1): sum of 1 / (k + rn - 1) over the query's best."""
    rows = None
    for channel, df in enumerate(lists):
        part = df.select("query_id", "page_id", (1 / (k + F.col("rn") - 1)).alias("s"), F.lit(channel).alias("channel"), "rn")
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "page_id").agg(F.sum("s").alias("s"), F.min(F.when(F.col("channel") == 0, F.col("rn"))).alias("keyword_rank"), F.min(F.when(F.col("channel") > 0, F.col("rn"))).alias("vector_rank"))
    return fused.select("query_id", "page_id", F.round(F.col("s") / F.max("s").over(Window.partitionBy("query_id")), 6).alias("score"), "keyword_rank", "vector_rank")


def backlink_factor(n: Column) -> Column:
    return F.when(n > 0, F.least(1 + 0.05 * F.log1p(n), F.lit(1.5))).otherwise(1.0)


def intent(text: Column) -> Column:
    """temporal, event, entity or general, by the first kind with a pattern that is found."""
    out = F.lit("general")
    for kind, patterns in reversed(INTENT_PATTERNS):
        fits = F.lit(False)
        for p in patterns:
            fits = fits | text.rlike("(?i)" + p)
        out = F.when(fits, kind).otherwise(out)
    return out


def detail(kind: Column) -> Column:
    """Chunks per page that an intent gets."""
    return F.when(kind == "entity", 1).when(kind.isin("temporal", "event"), 3).otherwise(2)


def best_per_page(hits: DataFrame, limit: int) -> DataFrame:
    """The best hit of each page, and of those the best of each query; hits (query_id, page_id, id, score)."""
    one = F.row_number().over(Window.partitionBy("query_id", "page_id").orderBy(F.desc("score"), "id"))
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("k", one).where("k = 1").drop("k").withColumn("rank", top).where(F.col("rank") <= limit)


def evaluate(hits: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """Per query of qrels (query_id, page_id, grade): precision, recall, reciprocal rank and nDCG of hits (query_id, page_id, rn)."""
    met = hits.where(F.col("rn") <= k).join(qrels, ["query_id", "page_id"])
    got = met.groupBy("query_id").agg(F.count("*").alias("found"), F.min("rn").alias("first"), F.sum(F.col("grade") / F.log2(F.col("rn") + 1)).alias("dcg"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "page_id"))
    ideal = qrels.withColumn("i", order).groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("i") <= k, F.col("grade") / F.log2(F.col("i") + 1))).alias("ideal"))
    out = ideal.join(got, "query_id", "left").fillna(0, ["found", "dcg"])
    return out.select(
        "query_id", F.round(F.col("found") / k, 6).alias("precision"), F.round(F.col("found") / F.col("relevant"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)), 6).alias("ndcg"),
    )


#: The orders in which entities can be listed; ties go to the smaller id.
ENTITY_SORTS = {"inbound": ("inbound_total", False), "updated": ("update_date", False), "title": ("title", True), "completeness": ("completeness_score", False)}


def list_entities(pages: DataFrame, counts: DataFrame, offset: int, limit: int, sort: str = "inbound", kind: str | None = None, state: str | None = None, with_total: bool = False) -> DataFrame:
    """A page of the entities in one of ENTITY_SORTS, of one type and state if asked; with_total adds how many there are."""
    column, ascending = ENTITY_SORTS[sort]
    rows = pages.where(F.col("deleted") == 0).where(F.col("type").isin("company", "industry", "concept"))
    rows = rows.where(F.col("type") == kind) if kind else rows
    rows = rows.where(F.col("entity_state") == state) if state else rows
    rows = rows.join(counts, F.col("id") == F.col("page_id"), "left").fillna(0, ["inbound_total"])
    order = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    total = [rows.agg(F.count("*")).scalar().alias("total")] if with_total else []
    return rows.orderBy(order, "id").offset(offset).limit(limit).select("id", "slug", "inbound_total", *total)


def cosine_rescore(hits: DataFrame, weight: float = 0.7) -> DataFrame:
    """Hits (query_id, id, score, q, embedding) by weight * score over the query's best + (1 - weight) * cosine; 0.5 without a vector."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    cos = F.when(F.col("embedding").isNull() | F.col("q").isNull(), 0.5).otherwise(cosine(F.col("q"), F.col("embedding")))
    return hits.select("query_id", "id", F.round(weight * F.try_divide("score", best) + (1 - weight) * cos, 5).alias("score"))


def query_variants(variants: DataFrame, most: int = 2) -> DataFrame:
    """At most `most` alternatives of each query (query_id, pos, text): control characters out, 500 characters, distinct without case."""
    clean = F.substring(F.trim(F.regexp_replace("text", r"[\x00-\x1f\x7f]+", " ")), 1, 500)
    rows = variants.withColumn("text", clean).where("text <> ''").withColumn("low", F.lower("text"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "low").orderBy("pos"))).where("k = 1")
    return first.withColumn("channel", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("channel") <= most).select("query_id", "channel", "text")


def fuzzy_suggest(hints: DataFrame, titles: DataFrame, min_sim: float = 0.15, limit: int = 5) -> DataFrame:
    """(hint_id, id, similarity, rank): titles by trigram similarity to hints (hint_id, text), ties to the smaller id.

    Hints are a stated set that meets all titles, block by block and part by part (see `trigrams.suggestions`); each hands
    up its best, so that no pair is shuffled.
    """
    from pyspark.sql.types import IntegralType

    from lorebase.operators.trigrams import suggestions
    from lorebase.sources.shared import written

    pages = titles.select("id", "title", F.lit(None).cast("string").alias("slug"))
    names = None
    if not isinstance(hints.schema["hint_id"].dataType, IntegralType):  # written, so that each hint keeps its number
        names = written(hints.select("hint_id", "text", F.monotonically_increasing_id().alias("n")), "hints")
        hints = names.select(F.col("n").alias("hint_id"), "text")
    near = suggestions(hints, pages, min_sim, limit, runs=False).withColumnRenamed("score", "similarity")
    if names is not None:
        near = near.withColumnRenamed("hint_id", "n").join(names.select("hint_id", "n"), "n")
    return near.select("hint_id", "id", "similarity", "rank")


def suggest_pages(hints: DataFrame, pages: DataFrame, min_sim: float = 0.15, limit: int = 5) -> DataFrame:
    """(hint_id, id, score, rank, advice) of hints (hint_id, text): pages by the greatest of slug, title and word similarity, ties to the smaller id.

    The advice is confident where the best page of a hint scores 0.5 or more.
    """
    from lorebase.operators.trigrams import suggestions

    top = suggestions(hints, pages, min_sim, limit)
    return top.select("hint_id", "id", "score", "rank", F.when(F.max("score").over(Window.partitionBy("hint_id")) >= 0.5, "confident").otherwise("unsure").alias("advice"))


def cap_hits(hits: DataFrame, per_page: int = 3, type_share: float = 0.6) -> DataFrame:
    """Hits (query_id, page_id, id, score, type): the best per_page of a page, then of each type at most ceil(type_share * hits)."""
    page = F.row_number().over(Window.partitionBy("query_id", "page_id").orderBy(F.desc("score"), "id"))
    few = hits.withColumn("k", page).where(F.col("k") <= per_page)
    kind = F.row_number().over(Window.partitionBy("query_id", "type").orderBy(F.desc("score"), "id"))
    n = F.count("*").over(Window.partitionBy("query_id"))
    return few.withColumn("k", kind).withColumn("n", n).where(F.col("k") <= F.ceil(F.col("n") * type_share)).select("query_id", "page_id", "id", "score", "type")


def hybrid_search(queries: DataFrame, vectors_of_queries: DataFrame, index: DataFrame, vectors: DataFrame, factors: DataFrame, pool: int = 50, limit: int = 10) -> DataFrame:
    """(query_id, page_id, score, rank): keyword and vector channels fused by reciprocal rank, times each page's factor.

    queries (query_id, text), vectors_of_queries (query_id, embedding), index as of postings, vectors (id, page_id, embedding),
    factors (page_id, factor). A page's vector rank is that of its best vector.
    """
    kw = keyword_search(queries, index, pool).select("query_id", "page_id", "rn")
    near = vector_search(vectors_of_queries, vectors.select("id", "embedding"), pool).select("query_id", "id", "rn")
    pages = near.join(vectors.select("id", "page_id"), "id").groupBy("query_id", "page_id").agg(F.min("rn").alias("best"))
    vec = pages.select("query_id", "page_id", F.row_number().over(Window.partitionBy("query_id").orderBy("best")).alias("rn"))
    fused = rrf_fuse([kw, vec]).join(factors, "page_id", "left")
    scored = fused.select("query_id", "page_id", F.round(F.col("score") * F.coalesce("factor", F.lit(1.0)), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def evaluate_configs(runs: dict[str, DataFrame], qrels: DataFrame, k: int = 5) -> DataFrame:
    """Mean metrics of several runs (name: hits as of evaluate)."""
    out = None
    for name, hits in runs.items():
        one = evaluate(hits, qrels, k).agg(*[F.round(F.avg(m), 5).alias(m) for m in ("precision", "recall", "mrr", "ndcg")], F.count("*").alias("queries")).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
