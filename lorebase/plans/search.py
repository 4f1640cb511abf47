"""Queries of retrieval and evaluation."""

from pyspark.sql import functions as F

from lorebase.operators import graph as g
from lorebase.operators import hybrid as hy
from lorebase.operators import search as s
from lorebase.plans.catalog import query

_TOK = r"[x FOR x IN regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_\-]+') IF x <> '']"
_STOP = "(" + ", ".join(f"'{w}'" for w in s.STOPWORDS) + ")"
_Q = f"""q0 AS (SELECT item_id AS query_id, unnest({_TOK.format("text")}) AS term, generate_subscripts({_TOK.format("text")}, 1) AS pos FROM benchmark),
q1 AS (SELECT query_id, term, min(pos) AS pos FROM q0 WHERE NOT (regexp_full_match(term, '[a-z0-9_-]+') AND length(term) < 3) AND term NOT IN {_STOP} GROUP BY 1, 2),
q AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS k FROM q1) WHERE k <= 16)"""
_INDEX = f"""ix AS (SELECT page_id, token, count(*) AS tf FROM (SELECT page_id, unnest({_TOK.format("chunk_text")}) AS token FROM fx_chunks) GROUP BY 1, 2)"""
_KEYWORD = f"""{_Q}, {_INDEX}, mt AS (SELECT term, page_id, sum(tf) AS tf FROM (SELECT DISTINCT term FROM q) t JOIN ix ON starts_with(ix.token, t.term) GROUP BY 1, 2),
ks AS (SELECT query_id, page_id, round(sum(0.4 * ln(1 + tf)) / any_value(n), 6) AS score FROM q JOIN mt USING (term) JOIN (SELECT query_id, count(*) AS n FROM q GROUP BY 1) USING (query_id) GROUP BY 1, 2),
kw AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS INTEGER) AS rn FROM ks) WHERE rn <= 20)"""


def _queries(benchmark):
    return benchmark.select(F.col("item_id").alias("query_id"), "text")


def _index(chunks):
    return s.postings(chunks.select("page_id", "chunk_text"), {"chunk_text": 0.4})


@query("r1_query_terms", "benchmark", oracle=f"WITH {_Q} SELECT query_id, term FROM q")
def r1(benchmark):
    return _queries(benchmark).select("query_id", F.explode(s.query_terms(F.col("text"))).alias("term"))


@query("r2_build_postings", "fx_pages", oracle=f"""
WITH t AS (SELECT id AS page_id, unnest({_TOK.format("title")}) AS token, CAST(1.0 AS DOUBLE) AS weight FROM fx_pages WHERE deleted = 0 UNION ALL SELECT id, unnest({_TOK.format("content")}), CAST(0.4 AS DOUBLE) FROM fx_pages WHERE deleted = 0)
SELECT page_id, token, weight, count(*) AS tf FROM t GROUP BY 1, 2, 3""")
def r2(pages):
    return s.postings(g.active(pages).select(F.col("id").alias("page_id"), "title", "content"), {"title": 1.0, "content": 0.4})


@query("r3_keyword_search", "benchmark", "fx_chunks", oracle=f"WITH {_KEYWORD} SELECT query_id, page_id, score, rn FROM kw")
def r3(benchmark, chunks):
    return s.keyword_search(_queries(benchmark), _index(chunks), 20)


@query("r4_vector_search", "embeddings", oracle="""
WITH v AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), p AS (SELECT q.id AS query_id, v.id, round(1 / (1 + (1 - list_cosine_similarity(q.e, v.e))), 5) AS score FROM v q JOIN v ON q.id % 20 = 0 AND v.id <> q.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rn FROM p) SELECT * FROM r WHERE rn <= 20""")
def r4(embeddings):
    v = embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return s.vector_search(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, 20)


_CASES = " ".join(f"WHEN starts_with(slug, '{p}') THEN {x}" for p, x in sorted(s.SOURCE_FACTORS.items(), key=lambda p: -len(p[0])))


@query("r5_source_factor", "fx_pages", oracle=f"SELECT id, CAST(CASE {_CASES} ELSE 1.0 END AS DOUBLE) AS factor FROM fx_pages")
def r5(pages):
    return pages.select("id", s.source_factor(F.col("slug")).alias("factor"))


@query("r6_exclude_prefixes", "fx_pages", oracle="SELECT id FROM fx_pages WHERE NOT starts_with(slug, 'sources/')")
def r6(pages):
    return s.without_prefixes(pages, "slug", ("sources/", "concepts/"), ("concepts/",)).select("id")


@query("r7_rrf_fuse", "benchmark", "fx_chunks", oracle=f"""
WITH {_KEYWORD}, v AS (SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY page_id % 7, page_id) AS INTEGER) AS rn FROM kw),
u AS (SELECT query_id, page_id, 1.0::DOUBLE / (60 + rn - 1) AS s, 0 AS c, rn FROM kw UNION ALL SELECT query_id, page_id, 1.0::DOUBLE / (60 + rn - 1), 1, rn FROM v), f AS (SELECT query_id, page_id, sum(s) AS s, min(rn) FILTER (WHERE c = 0) AS keyword_rank, min(rn) FILTER (WHERE c = 1) AS vector_rank FROM u GROUP BY 1, 2)
SELECT query_id, page_id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score, keyword_rank, vector_rank FROM f""")
def r7(benchmark, chunks):
    from pyspark.sql import Window

    kw = s.keyword_search(_queries(benchmark), _index(chunks), 20)
    other = kw.select("query_id", "page_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("page_id") % 7, "page_id")).alias("rn"))
    return s.rrf_fuse([kw, other])


@query("r10_backlink_boost", "fx_pages", "fx_links", oracle="""
WITH b AS (SELECT to_page_id AS id, count(*) FILTER (WHERE weight >= 0.9 OR link_type <> 'mention' OR (link_source = 'frontmatter' AND origin_field = 'primary_entities') OR origin_field IN ('facts_block', 'timeline_block')) AS n FROM fx_links WHERE deleted = 0 GROUP BY 1)
SELECT p.id, round(CASE WHEN coalesce(n, 0) > 0 THEN least(1 + 0.05 * ln(1 + n), 1.5) ELSE 1.0 END, 6) AS factor FROM fx_pages p LEFT JOIN b USING (id)""")
def r10(pages, links):
    n = g.effective_backlinks(links).withColumnRenamed("page_id", "id")
    return pages.join(n, "id", "left").select("id", F.round(s.backlink_factor(F.coalesce("backlinks", F.lit(0))), 6).alias("factor"))


@query("r12_best_chunk_per_page", "fx_chunks", oracle="""
WITH h AS (SELECT id % 20 AS query_id, page_id, id, CAST(length(chunk_text) % 37 AS INTEGER) AS score FROM fx_chunks), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY score DESC, id) AS k FROM h) WHERE k = 1),
r AS (SELECT query_id, page_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM o) SELECT * FROM r WHERE rank <= 10""")
def r12(chunks):
    hits = chunks.select((F.col("id") % 20).alias("query_id"), "page_id", "id", (F.length("chunk_text") % 37).alias("score"))
    return s.best_per_page(hits, 10)


@query("r13_classify_intent", "fx_comments", oracle=r"""
WITH t AS (SELECT id, CASE id % 6 WHEN 0 THEN 'what is ' WHEN 1 THEN 'latest on ' WHEN 2 THEN 'who announced ' WHEN 3 THEN 'everything about ' WHEN 4 THEN 'earnings of ' ELSE '' END || author AS text FROM fx_comments)
SELECT id, CASE id % 6 WHEN 0 THEN 'entity' WHEN 1 THEN 'temporal' WHEN 2 THEN 'event' WHEN 3 THEN 'temporal' WHEN 4 THEN 'event' ELSE 'general' END AS intent, CASE id % 6 WHEN 0 THEN 1 WHEN 5 THEN 2 ELSE 3 END AS max_per_page FROM t""")
def r13(comments):
    heads = F.array(*map(F.lit, ("what is ", "latest on ", "who announced ", "everything about ", "earnings of ", "")))
    text = F.concat(F.get(heads, (F.col("id") % 6).cast("int")), "author")
    return comments.withColumn("intent", s.intent(text)).select("id", "intent", s.detail(F.col("intent")).alias("max_per_page"))


_QRELS = "qr AS (SELECT item_id AS query_id, 7000000 + doc_id % 50 AS page_id, CAST(count(*) AS BIGINT) AS grade FROM documents JOIN benchmark ON contains(documents.text, substr(benchmark.text, 1, 40)) GROUP BY 1, 2)"


@query("r16_retrieval_metrics", "benchmark", "fx_chunks", "documents", oracle=f"""
WITH {_KEYWORD}, {_QRELS}, m AS (SELECT query_id, count(*) AS found, min(rn) AS first, sum(grade / log2(rn + 1)) AS dcg FROM kw JOIN qr USING (query_id, page_id) WHERE rn <= 5 GROUP BY 1),
i AS (SELECT query_id, count(*) AS relevant, sum(grade / log2(i + 1)) FILTER (WHERE i <= 5) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, page_id) AS i FROM qr) GROUP BY 1)
SELECT query_id, round(coalesce(found, 0) / 5, 6) AS precision, round(coalesce(found, 0) / relevant, 6) AS recall, round(coalesce(1 / first, 0.0), 6) AS mrr, round(coalesce(dcg / ideal, 0.0), 6) AS ndcg FROM i LEFT JOIN m USING (query_id)""")
def r16(benchmark, chunks, documents):
    kw = s.keyword_search(_queries(benchmark), _index(chunks), 20)
    head = F.substring("text", 1, 40)
    # documents that hold an item's first words: joined on the longest whole word, without the texts, then confirmed
    inner = F.slice(F.split("head", r"\s+"), F.lit(2), F.greatest(F.size(F.split("head", r"\s+")) - 2, F.lit(1)))
    items = benchmark.select(F.col("item_id").alias("query_id"), head.alias("head")).withColumn("w", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    words = documents.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w"))
    met = words.join(items, "w").join(documents.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("head")))
    qrels = met.groupBy("query_id", (7000000 + F.col("doc_id") % 50).alias("page_id")).agg(F.count("*").alias("grade"))
    return s.evaluate(kw, qrels, 5)


@query("r19_list_entities", "fx_pages", "fx_links", oracle="""
WITH c AS (SELECT to_page_id, count(*) AS n FROM fx_links WHERE deleted = 0 GROUP BY 1) SELECT id, slug, coalesce(n, 0) AS inbound_total FROM fx_pages LEFT JOIN c ON to_page_id = id WHERE deleted = 0 AND type IN ('company', 'industry', 'concept') ORDER BY 3 DESC, id LIMIT 25 OFFSET 50""")
def r19(pages, links):
    return s.list_entities(pages, g.link_counts(pages, links).select("page_id", "inbound_total"), 50, 25)


@query("r9_cosine_rescore", "fx_chunks", "embeddings", oracle="""
WITH h AS (SELECT id % 20 AS query_id, id, CAST(length(chunk_text) % 37 + 1 AS DOUBLE) AS score FROM fx_chunks), v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)
SELECT h.query_id, h.id, round(0.7 * (score / max(score) OVER (PARTITION BY h.query_id)) + (1 - 0.7) * CASE WHEN a.e IS NULL OR b.e IS NULL THEN 0.5 ELSE list_cosine_similarity(a.e, b.e) END, 5) AS score FROM h LEFT JOIN v a ON a.vec_id = h.query_id LEFT JOIN v b ON b.vec_id = h.id""")
def r9(chunks, embeddings):
    hits = chunks.select((F.col("id") % 20).alias("query_id"), "id", (F.length("chunk_text") % 37 + 1).cast("double").alias("score"))
    q = embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return s.cosine_rescore(hits.join(q, "query_id", "left").join(embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id", "left"))


@query("r11_hit_caps", "fx_chunks", oracle="""
WITH h AS (SELECT id % 10 AS query_id, page_id, id, CAST(length(chunk_text) % 37 AS INTEGER) AS score, chunk_type AS type FROM fx_chunks), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY score DESC, id) AS k FROM h) WHERE k <= 3),
b AS (SELECT query_id, page_id, id, score, type, row_number() OVER (PARTITION BY query_id, type ORDER BY score DESC, id) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM a) SELECT query_id, page_id, id, score, type FROM b WHERE k <= ceil(n * 0.6)""")
def r11(chunks):
    return s.cap_hits(chunks.select((F.col("id") % 10).alias("query_id"), "page_id", "id", (F.length("chunk_text") % 37).alias("score"), F.col("chunk_type").alias("type")))


@query("r15_query_variants", "fx_comments", oracle=r"""
WITH c AS (SELECT page_id AS query_id, id AS pos, substr(trim(regexp_replace(substr(content, 1, 30), '[\x00-\x1f\x7f]+', ' ', 'g')), 1, 500) AS text FROM fx_comments), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY pos) AS k FROM c WHERE text <> '') WHERE k = 1),
n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS channel, text FROM f) SELECT * FROM n WHERE channel <= 2""")
def r15(comments):
    return s.query_variants(comments.select(F.col("page_id").alias("query_id"), F.col("id").alias("pos"), F.substring("content", 1, 30).alias("text")))


_GR = r"""list_distinct(flatten([[substr('  ' || w || ' ', CAST(i AS BIGINT), 3) FOR i IN range(1, length(w) + 2)] FOR w IN [x FOR x IN regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+') IF x <> '']]))"""


@query("r18_fuzzy_suggest", "nation", "part", oracle=f"""
WITH h AS (SELECT n_nationkey AS hint_id, {_GR.format("'smal ring brand#' || CAST(n_nationkey AS VARCHAR)")} AS g FROM nation), t AS (SELECT p_partkey AS id, {_GR.format("p_name || ' ' || p_brand || ' ' || p_type")} AS g FROM part),
p AS (SELECT hint_id, id, len(list_intersect(h.g, t.g)) AS i, len(h.g) + len(t.g) AS n FROM h, t), r AS (SELECT hint_id, id, round(i::DOUBLE / (n - i), 6) AS similarity FROM p WHERE i > 0 AND i::DOUBLE / (n - i) >= 0.15),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY hint_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM r) SELECT * FROM k WHERE rank <= 5""")
def r18(nation, part):
    hints = nation.select(F.col("n_nationkey").alias("hint_id"), F.concat(F.lit("smal ring brand#"), F.col("n_nationkey").cast("string")).alias("text"))
    return s.fuzzy_suggest(hints, part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title")))


_VECTOR = """v0 AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), v1 AS (SELECT q.id AS query_id, c.id, round(1 / (1 + (1 - list_cosine_similarity(q.e, c.e))), 5) AS score FROM v0 q JOIN v0 c ON c.id <> q.id WHERE q.id IN (SELECT item_id FROM benchmark)),
v2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM v1), v3 AS (SELECT query_id, 7000000 + id % 50 AS page_id, min(rn) AS best FROM v2 WHERE rn <= 20 GROUP BY 1, 2), vc AS (SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best) AS INTEGER) AS rn FROM v3)"""
_FUSED = f"""{_KEYWORD}, {_VECTOR}, u AS (SELECT query_id, page_id, 1.0::DOUBLE / (60 + rn - 1) AS s FROM kw UNION ALL SELECT query_id, page_id, 1.0::DOUBLE / (60 + rn - 1) FROM vc), f0 AS (SELECT query_id, page_id, sum(s) AS s FROM u GROUP BY 1, 2),
f1 AS (SELECT query_id, page_id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM f0), f2 AS (SELECT query_id, page_id, round(score * CASE WHEN page_id % 2 = 0 THEN 1.2 ELSE 1.0 END::DOUBLE, 6) AS score FROM f1),
hy AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS INTEGER) AS rank FROM f2) WHERE rank <= 10)"""


def _hybrid(benchmark, chunks, embeddings):
    vectors = embeddings.select(F.col("vec_id").alias("id"), (7000000 + F.col("vec_id") % 50).alias("page_id"), "embedding")
    own = benchmark.select(F.col("item_id").alias("query_id")).join(embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    factors = chunks.select("page_id").distinct().withColumn("factor", F.when(F.col("page_id") % 2 == 0, 1.2).otherwise(1.0))
    return s.hybrid_search(_queries(benchmark), own, _index(chunks), vectors, factors, 20, 10)


@query("r14_hybrid_search", "benchmark", "fx_chunks", "embeddings", oracle=f"WITH {_FUSED} SELECT query_id, page_id, score, rank FROM hy")
def r14(benchmark, chunks, embeddings):
    return _hybrid(benchmark, chunks, embeddings)


def _chunk_table(chunks):
    kind = F.when(F.col("page_id") % 3 == 0, "company").when(F.col("page_id") % 3 == 1, "concept").otherwise("source")
    slug = F.concat(F.when(kind == "company", "companies/p").when(kind == "concept", "concepts/p").otherwise("sources/MS-p"), F.col("page_id").cast("string"))
    return chunks.withColumn("type", kind).withColumn("slug", slug)


def _whole_hybrid(benchmark, chunks, embeddings, limit=10):
    vectors = embeddings.select(F.col("vec_id").alias("id"), "embedding")
    own = benchmark.select(F.col("item_id").alias("query_id")).join(vectors.withColumnRenamed("id", "query_id"), "query_id")
    backlinks = chunks.groupBy("page_id").agg(F.count_if(F.col("chunk_type") == "compiled_truth").alias("backlinks"))
    return hy.hybrid_chunks(_queries(benchmark), own, _index(chunks), _chunk_table(chunks), vectors, backlinks, limit=limit)


@query("r14_hybrid_chunks", "benchmark", "fx_chunks", "embeddings")
def r14b(benchmark, chunks, embeddings):
    return _whole_hybrid(benchmark, chunks, embeddings)


_SIMILAR = "len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) > 0.85"


@query("r14_keyword_only", "benchmark", "fx_chunks", oracle=rf"""
WITH RECURSIVE {_Q}, {_INDEX}, mt AS (SELECT term, page_id, sum(tf) AS tf FROM (SELECT DISTINCT term FROM q) t JOIN ix ON starts_with(ix.token, t.term) GROUP BY 1, 2),
ks AS (SELECT query_id, page_id, round(sum(0.4 * ln(1 + tf)) / any_value(n), 6) AS score FROM q JOIN mt USING (term) JOIN (SELECT query_id, count(*) AS n FROM q GROUP BY 1) USING (query_id) GROUP BY 1, 2),
pp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS k FROM ks WHERE page_id % 3 = 1 AND page_id % 10 <> 4),
ql AS (SELECT query_id, list(term) AS terms FROM q GROUP BY 1),
h0 AS (SELECT pp.query_id, pp.page_id, pp.score, c.id, c.chunk_index, c.chunk_text, len([t FOR t IN terms IF len([w FOR w IN {_TOK.format("chunk_text")} IF starts_with(w, t)]) > 0]) AS hits FROM pp JOIN fx_chunks c USING (page_id) JOIN ql USING (query_id) WHERE k <= 80),
h1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY hits DESC, chunk_index, id) AS b FROM h0),
h2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rn FROM h1 WHERE b = 1),
h3 AS (SELECT query_id, page_id, id, rn, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score, list_distinct([w FOR w IN regexp_split_to_array(lower(chunk_text), '\s+') IF w <> '']) AS bag FROM h2 WHERE rn <= 40),
h4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM h3), bags AS (SELECT query_id, list(bag ORDER BY n) AS bags, max(n) AS last FROM h4 GROUP BY 1),
g AS (SELECT query_id, 1::BIGINT AS n, [1::BIGINT] AS kept FROM bags UNION ALL SELECT g.query_id, g.n + 1, CASE WHEN len([x FOR x IN kept IF {_SIMILAR.format("bags[x]", "bags[g.n + 1]")}]) > 0 THEN kept ELSE list_append(kept, g.n + 1) END FROM g JOIN bags USING (query_id) WHERE g.n < last),
d AS (SELECT h4.*, row_number() OVER (PARTITION BY query_id ORDER BY h4.n) AS k, len(kept) AS m FROM h4 JOIN g USING (query_id) JOIN bags USING (query_id) WHERE g.n = last AND list_contains(kept, h4.n)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM d WHERE k <= ceil(m * 0.6))
SELECT query_id, page_id, id, score, rank, rn AS keyword_rank FROM r WHERE rank <= 10""")
def r14c(benchmark, chunks):
    """Keyword-only search among the pages of one type, without some prefixes."""
    filters = hy.Filters(kind="concept", exclude=("concepts/p7000004", "concepts/p7000014", "concepts/p7000024", "concepts/p7000034", "concepts/p7000044", "concepts/p7000001"), include=("concepts/p7000001",))
    none = chunks.select("page_id", F.lit(0).alias("backlinks")).where("false")
    return hy.hybrid_chunks(_queries(benchmark), None, _index(chunks), _chunk_table(chunks), None, none, filters=filters, explain=True).select("query_id", "page_id", "id", "score", "rank", "keyword_rank")


@query("r11_dedupe_hits", "benchmark", "fx_chunks", "embeddings")
def r11b(benchmark, chunks, embeddings):
    found = _chunk_table(chunks).join(hy.keyword_chunks(_queries(benchmark), _index(chunks), _chunk_table(chunks), 30).select("query_id", "id", "score"), "id")
    return hy.dedupe_hits(found.select("query_id", "page_id", "id", "score", "type", "chunk_type", "chunk_text", F.lit(2).alias("per_page")))


def _qrels(benchmark, documents):
    head = benchmark.select(F.col("item_id").alias("query_id"), F.substring("text", 1, 40).alias("head"))
    inner = F.slice(F.split("head", r"\s+"), F.lit(2), F.greatest(F.size(F.split("head", r"\s+")) - 2, F.lit(1)))
    items = head.withColumn("w", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    words = documents.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w"))
    met = words.join(items, "w").join(documents.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("head")))
    return met.groupBy("query_id", (7000000 + F.col("doc_id") % 50).alias("page_id")).agg(F.count("*").alias("grade"))


_MEANS = "SELECT '{0}' AS config, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(mrr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg, count(*) AS queries FROM e_{0}"
_EVAL = """m_{0} AS (SELECT query_id, count(*) AS found, min(rn) AS first, sum(grade / log2(rn + 1)) AS dcg FROM {1} JOIN qr USING (query_id, page_id) WHERE rn <= 5 GROUP BY 1),
e_{0} AS (SELECT query_id, round(coalesce(found, 0) / 5, 6) AS precision, round(coalesce(found, 0) / relevant, 6) AS recall, round(coalesce(1 / first, 0.0), 6) AS mrr, round(coalesce(dcg / ideal, 0.0), 6) AS ndcg FROM i LEFT JOIN m_{0} USING (query_id))"""


@query("r17_run_eval", "benchmark", "fx_chunks", "embeddings", "documents", oracle=f"""
WITH {_KEYWORD}, {_VECTOR}, {_QRELS}, i AS (SELECT query_id, count(*) AS relevant, sum(grade / log2(i + 1)) FILTER (WHERE i <= 5) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, page_id) AS i FROM qr) GROUP BY 1),
{_EVAL.format("keyword", "kw")}, {_EVAL.format("vector", "vc")} {_MEANS.format("keyword")} UNION ALL {_MEANS.format("vector")}""")
def r17(benchmark, chunks, embeddings, documents):
    from pyspark.sql import Window

    kw = s.keyword_search(_queries(benchmark), _index(chunks), 20)
    v = embeddings.select(F.col("vec_id").alias("id"), "embedding")
    own = benchmark.select(F.col("item_id").alias("query_id")).join(v.withColumnRenamed("id", "query_id"), "query_id")
    pages = s.vector_search(own, v, 20).groupBy("query_id", (7000000 + F.col("id") % 50).alias("page_id")).agg(F.min("rn").alias("best"))
    vec = pages.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("best")))
    return hy.run_eval({"keyword": kw, "vector": vec}, _qrels(benchmark, documents), 5)


@query("r17_run_eval_hybrid", "benchmark", "fx_chunks", "embeddings", "documents")
def r17b(benchmark, chunks, embeddings, documents):
    return hy.run_eval({"hybrid": _whole_hybrid(benchmark, chunks, embeddings).withColumnRenamed("rank", "rn")}, _qrels(benchmark, documents), 5)


@query("r2_build_postings_all_fields", "fx_pages", oracle=f"""
WITH t AS (SELECT id AS page_id, unnest({_TOK.format("title")}) AS token, CAST(1.0 AS DOUBLE) AS weight FROM fx_pages WHERE deleted = 0 UNION ALL SELECT id, unnest({_TOK.format("alias_csv")}), CAST(0.9 AS DOUBLE) FROM fx_pages WHERE deleted = 0
UNION ALL SELECT id, unnest({_TOK.format("content")}), CAST(0.4 AS DOUBLE) FROM fx_pages WHERE deleted = 0 UNION ALL SELECT id, unnest({_TOK.format("slug")}), CAST(0.2 AS DOUBLE) FROM fx_pages WHERE deleted = 0)
SELECT page_id, token, weight, count(*) AS tf FROM t GROUP BY 1, 2, 3""")
def r2b(pages):
    rows = g.active(pages).select(F.col("id").alias("page_id"), "title", F.col("alias_csv").alias("aliases"), "content", F.col("slug").alias("timeline"))
    return s.postings(rows, {"title": 1.0, "aliases": 0.9, "content": 0.4, "timeline": 0.2})


@query("r18_suggest_pages", "nation", "fx_pages")
def r18b(nation, pages):
    return s.suggest_pages(nation.select(F.col("n_nationkey").alias("hint_id"), F.concat(F.lit("smal ring brand#"), F.col("n_nationkey").cast("string")).alias("text")), pages.where("deleted = 0"))


@query("r19_list_entities_by_title", "fx_pages", "fx_links", oracle="""
WITH c AS (SELECT to_page_id, count(*) AS n FROM fx_links WHERE deleted = 0 GROUP BY 1), e AS (SELECT id, slug, title, coalesce(n, 0) AS inbound_total FROM fx_pages LEFT JOIN c ON to_page_id = id WHERE deleted = 0 AND type = 'concept')
SELECT id, slug, inbound_total, (SELECT count(*) FROM e) AS total FROM e ORDER BY title NULLS LAST, id LIMIT 25 OFFSET 25""")
def r19b(pages, links):
    return s.list_entities(pages, g.link_counts(pages, links).select("page_id", "inbound_total"), 25, 25, "title", "concept", with_total=True)
