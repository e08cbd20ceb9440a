"""Full text, vectors, fusion, hybrid search and evaluation as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, vector
from ..operators import evaluation, fusion, ivf, joins, search
from .fixtures import TABLES_SQL as T
from .fixtures import files, read, scratch, shared_store, tables
from .read_queries import main_views
from .registry import query

TERMS = "the of"
#: The query vector is the embedding of this id.
VECTOR_ID = 1

_TOKENS = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_SCOPE = "chunk_contents k WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_content_hash = k.content_hash AND c.source_view_id IN (SELECT id FROM source_views WHERE ref_name = 'main'))"


def _text_sql(terms: list[str], scope: str = _SCOPE, k: int = 50) -> str:
    """CTEs: post (id, term, pos) for the terms and text_channel (id, score)."""
    held = ", ".join(f"'{t}'" for t in terms)
    tok = f"tok AS (SELECT content_hash AS id, {_TOKENS} AS toks FROM {scope}), post AS (SELECT id, term, pos FROM (SELECT id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM tok) WHERE term IN ({held})), "
    every = f"doc AS (SELECT id FROM post GROUP BY id HAVING count(DISTINCT term) = {len(terms)}), kept AS (SELECT id, term, pos FROM (SELECT *, row_number() OVER (PARTITION BY id, term ORDER BY pos) AS r FROM post) WHERE r <= 256), "
    if len(terms) == 1:
        scored = "scored AS (SELECT id, round(0.1::DOUBLE * sum(1.0::DOUBLE / (r * r)) / 1.64493406685::DOUBLE, 6) AS score FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM kept) GROUP BY id), "
    else:
        scored = (
            "scored AS (SELECT a.id, round(1 - product(1 - 0.1::DOUBLE * sqrt(CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30::DOUBLE ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(a.pos - b.pos) / 1.5::DOUBLE - 2)) END)), 6) AS score "
            "FROM kept a JOIN kept b ON a.id = b.id AND a.term < b.term WHERE a.id IN (SELECT id FROM doc) GROUP BY a.id), "
        )
    return tok + every + scored + f"text_channel AS (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT {k})"


def _vector_sql(name: str, column: str = "embedding", scope: str = _SCOPE, k: int = 50) -> str:
    q = f"(SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID})"
    return f"{name} AS (SELECT content_hash AS id, round(list_cosine_similarity(CAST({column} AS DOUBLE[]), CAST({q} AS DOUBLE[])), 6) AS score FROM {scope} AND {column} IS NOT NULL ORDER BY score DESC, id LIMIT {k})"


def _fusion_sql(weights: dict[str, float], n: int = 50) -> str:
    """CTE fusion over NAME_channel CTEs."""
    parts = " UNION ALL ".join(f"SELECT id, '{c}' AS channel, score, {w}::DOUBLE AS w, row_number() OVER (ORDER BY score DESC, id) AS r FROM {c}_channel" for c, w in weights.items())
    scores = ", ".join(f"max(CASE WHEN channel = '{c}' THEN score END) AS {c}_score" for c in weights)
    return f"fusion AS (SELECT id, round(sum(w / (60 + r)), 9) AS fused, {scores} FROM ({parts}) GROUP BY id ORDER BY fused DESC, id LIMIT {n})"


def query_vector(spark, sf: str) -> list[float]:
    return list(read(spark, sf, "embeddings").where(F.col("vec_id") == VECTOR_ID).select("embedding").first()[0])


def _inside(t):
    return t["chunk_contents"].join(joins.in_views(t["chunks"], main_views(t)).select(F.col("chunk_content_hash").alias("content_hash")), "content_hash", "left_semi")


#: What search reads: all but whole files.
SEARCHED = ("sources", "source_views", "chunk_contents", "chunks", "postings")


def _indexed(spark, sf):
    """The tables of a store over the test tables, its postings, and the content hashes of the main views."""
    store = shared_store(spark, sf, SEARCHED)
    t = store.tables()
    return t, store.table("postings"), search.scope_hashes(t["chunks"], _scope(t))


def _by_text(spark, sf, query: str):
    _, posts, hashes = _indexed(spark, sf)
    return search.postings_search(posts, hashes, query, 50)


_OPEN = T.rstrip() + ", "


@query("s02_fts_match_all", _OPEN + _text_sql(["the", "of"], k=100000) + " SELECT id FROM doc")
def s02_match(spark, sf):
    toks = _inside(tables(spark, sf)).select(F.col("content_hash").alias("id"), text.tokens(F.col("content")).alias("t"))
    return toks.where(F.array_contains("t", "the") & F.array_contains("t", "of")).select("id")


@query("s02_fts_rank_single", _OPEN + _text_sql(["the"]) + " SELECT id, score FROM text_channel")
def s02_single(spark, sf):
    return _by_text(spark, sf, "the")


@query("s02_fts_rank_and", _OPEN + _text_sql(["the", "of"]) + " SELECT id, score FROM text_channel")
def s02_and(spark, sf):
    return _by_text(spark, sf, TERMS)


@query("s02_fts_rank_three", _OPEN + _text_sql(["the", "of", "and"]) + " SELECT id, score FROM text_channel")
def s02_three(spark, sf):
    return _by_text(spark, sf, "The of, and")


@query("s03_vector_topk", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID}) AS DOUBLE[])), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50")
def s03(spark, sf):
    return vector.topk(read(spark, sf, "embeddings"), "vec_id", "embedding", query_vector(spark, sf), 50)


@query("s03_vector_topk_prefiltered", _OPEN + _vector_sql("vector_channel") + " SELECT id, score FROM vector_channel")
def s03_scoped(spark, sf):
    return search.vector_search(_inside(tables(spark, sf)), query_vector(spark, sf), 50)


@query(
    "s03_vector_topk_batch",
    "SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE r <= 10",
)
def s03_batch(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return vector.topk_batch(e, "vec_id", "embedding", e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "embedding", 10)


@query("s03_vector_index", "SELECT CAST(count(*) AS BIGINT) AS vectors, CAST(least(100, count(*)) AS BIGINT) AS queries, true AS reached FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0")
def s03_index(spark, sf):
    """The approximate index over all vectors: how many are coded, and whether the top 10 of a hundred of them are found as by exact search (0.9)."""
    e, path = read(spark, sf, "embeddings").select("vec_id", "embedding"), scratch(spark, "codes")
    asked = e.where(F.exists("embedding", lambda v: v != 0)).orderBy("vec_id").limit(100).select(F.col("vec_id").alias("query_id"), "embedding")
    model = ivf.fitted(e, "vec_id", "embedding", 64)
    ivf.coded(e, "vec_id", "embedding", model).write.parquet(path)
    index = spark.read.parquet(path)
    got = ivf.calibrated(index, e, asked, "query_id", "embedding", "vec_id", "embedding", model, 10)
    return index.agg(F.count("*").alias("vectors")).select("vectors", F.lit(asked.count()).cast("long").alias("queries"), F.lit(got.recall >= 0.9).alias("reached"))


@query("s04_summary_vector_topk", _OPEN + _vector_sql("summary_channel", "summary_embedding") + " SELECT id, score FROM summary_channel")
def s04(spark, sf):
    return search.vector_search(_inside(tables(spark, sf)), query_vector(spark, sf), 50, "summary_embedding")


@query("s05_scope_mode", T + "SELECT s.name, CAST(count(DISTINCT c.chunk_content_hash) AS BIGINT) AS hashes, CASE WHEN count(DISTINCT c.chunk_content_hash) < 10000 THEN 'narrow' ELSE 'broad' END AS mode FROM chunks c JOIN source_views v ON v.id = c.source_view_id JOIN sources s ON s.id = v.source_id GROUP BY s.name")
def s05(spark, sf):
    t = tables(spark, sf)
    v = t["source_views"].join(t["sources"].select(F.col("id").alias("source_id"), "name"), "source_id").select(F.col("id").alias("source_view_id"), "name")
    n = t["chunks"].join(v, "source_view_id").groupBy("name").agg(F.countDistinct("chunk_content_hash").alias("hashes"))
    return n.withColumn("mode", search.mode_of(F.col("hashes"), F.lit(False)))


@query("s06_scope_branch", T + "SELECT c.path, v.source_id FROM chunks c JOIN source_views v ON v.id = c.source_view_id WHERE v.view_kind = 'branch' AND v.ref_name = 'feature' AND v.source_id = sha256('source:src4')")
def s06(spark, sf):
    t = tables(spark, sf)
    v = joins.branch_views(t["sources"], t["source_views"], "feature").where("name = 'src4'").select(F.col("id").alias("source_view_id"), "source_id")
    return t["chunks"].join(v, "source_view_id").select("path", "source_id")


@query("s10_channel_ranks", _OPEN + _text_sql(["the", "of"]) + " SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM text_channel")
def s10(spark, sf):
    return fusion.ranked(_by_text(spark, sf, TERMS), "text").drop("channel")


_TWO = _OPEN + _text_sql(["the", "of"]) + ", " + _vector_sql("vector_channel") + ", " + _fusion_sql({"text": 0.4, "vector": 0.6})
_THREE = _OPEN + _text_sql(["the", "of"]) + ", " + _vector_sql("vector_channel") + ", " + _vector_sql("summary_channel", "summary_embedding") + ", " + _fusion_sql({"text": 0.3, "vector": 0.5, "summary": 0.2})


def _found(spark, sf, three: bool):
    t, posts, hashes = _indexed(spark, sf)
    inside, q = t["chunk_contents"].join(hashes, "content_hash", "left_semi"), query_vector(spark, sf)
    channels = {"text": search.postings_search(posts, hashes, TERMS, 50), "vector": search.vector_search(inside, q, 50)}
    if three:
        channels["summary"] = search.vector_search(inside, q, 50, "summary_embedding")
    return fusion.best(fusion.fused(channels, fusion.WEIGHTS_3 if three else fusion.WEIGHTS_2), 50)


@query("s11_rrf_2way", _TWO + " SELECT id, fused, text_score, vector_score FROM fusion")
def s11_two(spark, sf):
    return _found(spark, sf, False)


@query("s11_rrf_3way", _THREE + " SELECT id, fused, text_score, vector_score, summary_score FROM fusion")
def s11_three(spark, sf):
    return _found(spark, sf, True)


@query("s12_candidate_cut", _TWO + " SELECT id, fused FROM fusion ORDER BY fused DESC, id LIMIT 10")
def s12(spark, sf):
    return fusion.best(_found(spark, sf, False).select("id", "fused"), 10)


_OCCURRENCE = "(SELECT chunk_content_hash, path, ordinal, id, source_view_id, row_number() OVER (PARTITION BY chunk_content_hash ORDER BY path, ordinal, id) AS o FROM chunks WHERE source_view_id IN (SELECT id FROM source_views WHERE ref_name = 'main'))"


def _results_sql(start: str, extra: str = "") -> str:
    return (
        start + f" SELECT o.id AS chunk_id, o.path, s.name AS source_name, substr(k.content, 1, 500) AS snippet, f.fused, f.text_score, f.vector_score{extra} FROM (SELECT * FROM fusion ORDER BY fused DESC, id LIMIT 10) f "
        f"JOIN {_OCCURRENCE} o ON o.chunk_content_hash = f.id AND o.o = 1 JOIN chunk_contents k ON k.content_hash = f.id JOIN source_views v ON v.id = o.source_view_id JOIN sources s ON s.id = v.source_id"
    )


def _scope(t):
    return search.Scope(main_views(t).select("id"))


def _flat(rows):
    return rows.select("chunk_id", "path", "source_name", "snippet", "scores.fused", F.col("scores.text").alias("text_score"), F.col("scores.vector").alias("vector_score"), F.col("scores.summary").alias("summary_score"))


@query("hybrid_search", _results_sql(_TWO))
def hybrid_search(spark, sf):
    t, posts, _ = _indexed(spark, sf)
    return _flat(search.search(t, TERMS, query_vector(spark, sf), _scope(t), posts=posts)).drop("summary_score")


@query("s15_hybrid_three_way", _results_sql(_THREE, ", f.summary_score"))
def hybrid_three(spark, sf):
    t, posts, _ = _indexed(spark, sf)
    return _flat(search.search(t, TERMS, query_vector(spark, sf), _scope(t), search.Options(use_summary=True), posts))


@query(
    "s14_rerank",
    _TWO + " SELECT id, fused, CAST(length(content) AS DOUBLE) AS rerank_score FROM fusion f JOIN (SELECT content_hash, content FROM chunk_contents) k ON k.content_hash = f.id ORDER BY rerank_score DESC, id LIMIT 10",
)
def s14(spark, sf):
    found = _found(spark, sf, False).join(tables(spark, sf)["chunk_contents"].select(F.col("content_hash").alias("id"), "content"), "id")
    placed = found.withColumn("place", F.row_number().over(Window.orderBy("id")))
    return search.ScoreReranker(lambda q, c: F.length(c)).rerank(TERMS, placed, 10).select("id", "fused", "rerank_score")


@query("s16_response_meta", _TWO + f" SELECT CAST((SELECT count(*) FROM fusion) AS BIGINT) AS total_candidates, CASE WHEN n = 0 THEN 'empty' WHEN n < {search.NARROW} THEN 'narrow' ELSE 'broad' END AS retrieval_mode FROM (SELECT count(DISTINCT chunk_content_hash) AS n FROM chunks WHERE source_view_id IN (SELECT id FROM source_views WHERE ref_name = 'main'))")
def s16(spark, sf):
    t = shared_store(spark, sf, SEARCHED).tables()
    n = search.scope_hashes(t["chunks"], _scope(t)).agg(F.count("*").alias("n")).first().n
    return _found(spark, sf, False).agg(F.count("*").alias("total_candidates")).withColumn("retrieval_mode", F.lit(search.mode(n, False)))


_HASHED = "list_transform(range(64), lambda i: CAST('0x' || substr(sha256('query:' || text), CAST(i % 32 * 2 + 1 AS BIGINT), 2) AS INTEGER) / 127.5::DOUBLE - 1)"
_BATCH = (
    _OPEN
    + f"q AS (SELECT item_id AS query_id, list_distinct(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda t: lower(regexp_replace(t, '[^a-zA-Z0-9а-яА-ЯёЁ_]', '', 'g'))), lambda t: t <> '')) AS terms, {_HASHED} AS raw FROM benchmark), "
    + "v AS (SELECT query_id, CAST(list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) AS FLOAT[]) AS vector FROM q), qt AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM q), "
    + f"post AS (SELECT id, term, pos, row_number() OVER (PARTITION BY id, term ORDER BY pos) AS r FROM (SELECT id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM (SELECT content_hash AS id, {_TOKENS} AS toks FROM chunk_contents)) WHERE term IN (SELECT term FROM qt)), "
    + "kept AS (SELECT * FROM post WHERE r <= 256), hit AS (SELECT query_id, id, n FROM qt JOIN kept USING (term) WHERE r = 1 GROUP BY query_id, id, n HAVING count(*) = n), hp AS (SELECT h.query_id, h.id, h.n, k.term, k.pos, k.r FROM hit h JOIN qt USING (query_id) JOIN kept k ON k.id = h.id AND k.term = qt.term), "
    + "scored AS (SELECT a.query_id, a.id, round(1 - exp(sum(CASE WHEN abs(a.pos - b.pos) > 100 THEN 0 ELSE ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(a.pos - b.pos) / 1.5::DOUBLE - 2)))) END)), 6) AS score FROM hp a JOIN hp b ON a.query_id = b.query_id AND a.id = b.id AND a.term < b.term GROUP BY a.query_id, a.id "
    + "UNION ALL SELECT query_id, id, round(0.1::DOUBLE * sum(1.0::DOUBLE / (r * r)) / 1.64493406685::DOUBLE, 6) FROM hp WHERE n = 1 GROUP BY query_id, id), "
    + "near AS (SELECT v.query_id, k.content_hash AS id, round(list_cosine_similarity(CAST(k.embedding AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 6) AS score FROM chunk_contents k, v WHERE k.embedding IS NOT NULL), "
    + "ranks AS (SELECT query_id, id, 'text' AS channel, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored UNION ALL SELECT query_id, id, 'vector', score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM near), "
    + "sums AS (SELECT query_id, id, round(sum(CASE channel WHEN 'text' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END / (60 + r)), 9) AS fused, max(CASE WHEN channel = 'text' THEN score END) AS text_score, max(CASE WHEN channel = 'vector' THEN score END) AS vector_score FROM ranks WHERE r <= 10 GROUP BY query_id, id) "
    + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank FROM sums) WHERE rank <= 10"
)


@query("s17_batch_search", _BATCH)
def s17(spark, sf):
    """All benchmark texts as queries, with hashed vectors, in one job over stored postings."""
    store = shared_store(spark, sf, SEARCHED)
    contents = store.table("chunk_contents").select("content_hash", "content", "embedding")
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    q = q.withColumn("embedding", vector.hash_vector_column(F.concat(F.lit("query:"), "query"), 64))
    return search.search_batch(contents, q, 10, posts=store.table("postings"))


_KNOWN = _BATCH.replace(f"{_HASHED} AS raw FROM benchmark", "item_id FROM benchmark").replace(_BATCH[_BATCH.index("v AS (SELECT query_id"):_BATCH.index(" qt AS (SELECT query_id")], "v AS (SELECT query_id, e.embedding AS vector FROM q JOIN embeddings e ON e.vec_id = q.item_id),")


@query(
    "a13_recall_mrr",
    _KNOWN[: _KNOWN.rindex("SELECT * FROM (SELECT *, row_number()")].rstrip().rstrip(",")
    + ", found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank FROM sums) WHERE rank <= 10), "
    + "occ AS (SELECT chunk_content_hash, path, row_number() OVER (PARTITION BY chunk_content_hash ORDER BY path, ordinal, id) AS o FROM chunks), "
    + "want AS (SELECT q.query_id, f.lang AS category, f.path FROM q JOIN files f ON f.doc_id = q.item_id AND f.ref = 'main'), "
    + "r AS (SELECT w.query_id, w.category, min(f.rank) AS rank FROM want w LEFT JOIN (SELECT f.query_id, f.rank, o.path FROM found f JOIN occ o ON o.chunk_content_hash = f.id AND o.o = 1) f ON f.query_id = w.query_id AND f.path = w.path GROUP BY w.query_id, w.category) "
    + "SELECT coalesce(category, 'all') AS category, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r GROUP BY ROLLUP (category)",
)
def a13(spark, sf):
    """Batch search for all benchmark texts, each with the vector of its number; expected is the document of that number."""
    store, b = shared_store(spark, sf, ("chunk_contents", "chunks", "postings")), read(spark, sf, "benchmark")
    q = b.join(read(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id", "left").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "embedding")
    found = search.search_batch(store.table("chunk_contents").select("content_hash", "content", "embedding"), q, 10, posts=store.table("postings"))
    at = search.occurrences(store.table("chunks"), search.Scope()).select(F.col("chunk_content_hash").alias("id"), "path", "start_line", "end_line")
    main = files(spark, sf).where("ref = 'main'")
    want = b.select("item_id").join(main, F.col("item_id") == F.col("doc_id")).select(F.col("item_id").alias("query_id"), F.col("lang").alias("category"), "path", F.lit(1).alias("lo"), F.lit(None).cast("int").alias("hi"))
    return evaluation.evaluated(found.join(at, "id").select("query_id", "path", "start_line", "end_line", "rank"), want)


@query(
    "s02_okapi_bm25",
    "WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS toks FROM documents), n AS (SELECT doc_id, len(toks) AS length, len(list_filter(toks, lambda t: t = 'with')) AS tf FROM d), "
    "s AS (SELECT CAST(count(*) AS DOUBLE) AS docs, CAST(count(*) FILTER (WHERE tf > 0) AS DOUBLE) AS df, avg(length) AS mean FROM n) "
    "SELECT doc_id, round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score FROM n, s WHERE tf > 0",
)
def bm25(spark, sf):
    toks = read(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("toks"))
    n = toks.select("doc_id", F.size("toks").alias("length"), F.size(F.filter("toks", lambda t: t == "with")).alias("tf"), F.lit(1).alias("_one"))
    s = n.agg(F.count("*").cast("double").alias("docs"), F.count_if(F.col("tf") > 0).cast("double").alias("df"), F.avg("length").alias("mean")).withColumn("_one", F.lit(1))
    return n.where("tf > 0").join(F.broadcast(s), "_one").select("doc_id", F.round(text.okapi_bm25(F.col("tf"), F.col("df"), F.col("docs"), F.col("length"), F.col("mean")), 6).alias("score"))
