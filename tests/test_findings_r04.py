"""Cases of the review's fourth round, against the queries' SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def made(spark, tmp_path):
    """Writes tables and gives their folder."""

    def make(**tables):
        for name, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def agree(spark, folder, name, tables):
    df = QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = con.execute(SQL[name])
    at = [[d[0] for d in got.description].index(c) for c in df.columns]
    want = sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want
    return want


def test_mock_summary_of_blank_texts(spark, made):
    texts = ["", " ", "   \n", "\u00a0", "a b", None]
    docs = spark.createDataFrame([(i, t, "en", "src1" if i else "", len(t or "")) for i, t in enumerate(texts)], DOCUMENTS)
    assert len(agree(spark, made(documents=docs), "f17_mock_summary", ["documents"])) == len(texts)


def test_cost_of_ties_and_nulls(spark, made):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "'' AS text", "'en' AS lang", "'src1' AS source", "CASE WHEN id < 50000 THEN 350 * id WHEN id < 59999 THEN id - 50000 END AS n_chars")
    agree(spark, made(documents=docs), "f18_cost_format", ["documents"])


def test_vector_index_of_vectors_that_codes_tell_apart_badly(spark, made):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(6000, 64))
    x[5] = 0
    vectors = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    assert agree(spark, made(embeddings=vectors), "s03_vector_index", ["embeddings"]) == ["(5999, 100, True)"]


def size_of(folder):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder.removeprefix("file://").removeprefix("file:")) for f in names if f.endswith((".parquet", ".gz")))


def test_postings_take_less_than_twice_their_texts(spark, sf):
    """Hashes of contents are in a dictionary, so a posting costs its positions and little more."""
    from lodeseek.plans.fixtures import stored

    store = stored(spark, sf)
    assert 0 < size_of(store.files.at("postings")) < 2 * size_of(store.files.at("chunk_contents"))


def test_runs_of_postings(spark, monkeypatch):
    """Runs of any length hold the same postings, each by term and content."""
    from lodeseek.operators import search

    k = spark.createDataFrame([(f"h{i:03d}", " ".join(f"W{i % 7} w{j % 5}" for j in range(i % 40))) for i in range(300)], "content_hash string, content string").coalesce(1)
    whole = [tuple(r) for r in search.postings(k).collect()]
    monkeypatch.setattr(search, "RUN_TOKENS", 100)
    runs = [tuple(r) for r in search.postings(k).collect()]
    assert sorted(runs) == whole and runs != whole
    want = sorted((t, r.content_hash, [i + 1 for i, x in enumerate(toks) if x == t][:256]) for r in k.collect() for toks in [r.content.lower().split()] for t in set(toks))
    assert whole == want


def shuffled(df):
    """Rows that a query's shuffles have written."""
    df.collect()
    n, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            n += p.metrics().apply("shuffleRecordsWritten").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if "AdaptiveSparkPlanExec" in kind:
            todo.append(p.executedPlan())
        elif "QueryStageExec" in kind:
            todo.append(p.plan())
    return n


def test_batch_search_shuffles_candidates_only(spark):
    """Queries of common words and a rare one meet the texts that hold the rare one, with stored postings and without."""
    from lodeseek.operators import search

    common = " ".join(f"c{i}" for i in range(20))
    k = spark.createDataFrame([(f"h{i:04d}", f"{common} r{i}", None) for i in range(600)], "content_hash string, content string, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, f"{common} r{i}", None) for i in range(50)] + [(50, "c1 nowhere", None)], "query_id int, query string, embedding array<float>")
    for posts in (None, search.postings(k)):
        found = search.search_batch(k, q, 10, posts=posts)
        assert sorted((r.query_id, r.id) for r in found.collect()) == [(i, f"h{i:04d}") for i in range(50)]
        assert shuffled(found) < 10_000


def test_queries_store_what_they_read(spark, made, sf):
    """A list of sources stores no texts, and summaries no second store."""
    from lodeseek.plans import fixtures

    folder = made(**{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "embeddings")})
    agree(spark, folder, "s07_source_name", ["documents", "embeddings"])
    agree(spark, folder, "u05_list_sources_tool", ["documents", "embeddings"])
    assert {n for n, e in fixtures.shared_store(spark, folder, ()).current()[1].items() if e} == {"sources", "source_views"}
    agree(spark, folder, "w14_summarize_loop", ["documents", "embeddings"])
    assert not fixtures.shared_store(spark, folder, ()).current()[1].get("chunk_contents")
    agree(spark, folder, "s02_fts_rank_single", ["documents", "embeddings"])
    assert fixtures.shared_store(spark, folder, ()).current()[1]["postings"] and not fixtures.shared_store(spark, folder, ()).current()[1].get("file_blobs")


def test_tables_of_repeated_and_null_texts(spark, made):
    docs = spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in [(1, "a b"), (1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c")]], DOCUMENTS)
    vectors = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(7)], "vec_id long, embedding array<float>, label int")
    folder = made(documents=docs, embeddings=vectors)
    for name in ("w07_embedding_update", "w08_summary_update", "u06_status_tool"):
        agree(spark, folder, name, ["documents", "embeddings"])


def test_sql_export_in_compressed_files(spark, sf, tmp_path, monkeypatch):
    from lodeseek.plans.fixtures import stored
    from lodeseek.sources import archive

    monkeypatch.setattr(archive, "STATEMENTS", 50)
    store, target = stored(spark, sf, ("sources", "source_views", "indexed_files", "file_blobs", "chunk_contents", "chunks")), str(tmp_path / "out")
    archive.export(store, [r.name for r in store.table("sources").collect()], target, sql=True, compression="gzip")
    texts = [r.value for r in spark.read.text(f"{target}/sql/file_blobs", wholetext=True).collect()]
    assert size_of(f"{target}/sql") > 0 and max(len(archive.statements(t)) for t in texts) <= 50
    assert sum(len(archive.statements(t)) for t in texts) == store.table("file_blobs").count()

def test_crowds_of_short_texts(spark):
    """Texts of few words that share most of their shingles: a band of many minima is all but never equal, which is no error."""
    from lodeseek.llm import crowded, near_dedup

    assert [crowded.bands(0.03, k) for k in (1, 2)] == [378, 12787] and crowded.bands(0.03, 12) > 1e18
    texts = [f"a{n % 40} one two three four five six seven eight b{n // 40 % 40}" for n in range(1610)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    first = {}
    for i, t in enumerate(texts):  # of 6 shingles each, so only equal texts are linked
        first.setdefault(t, i)
    assert got == {i: (6, first[t]) for i, t in enumerate(texts)}


def test_reembedding_and_indexing_store_little_beside_texts(spark, sf, monkeypatch):
    """Contents to be embedded have no postings, and those of indexed texts take less than twice the texts."""
    from lodeseek.plans import coverage_queries, maintenance_queries

    folders = []
    monkeypatch.setattr(maintenance_queries, "stored", lambda *a, f=maintenance_queries.stored: (folders.append((s := f(*a)).folder), s)[1])
    monkeypatch.setattr(coverage_queries, "scratch", lambda *a, f=coverage_queries.scratch: (folders.append(x := f(*a)), x)[1])
    for name in ("w13_reembed_queue", "w09_finalise"):
        assert QUERIES[name](spark, sf).collect()
    embedded, indexed = folders
    assert size_of(f"{embedded}/chunk_contents") and not size_of(f"{embedded}/postings")
    assert 0 < size_of(f"{indexed}/postings") < 2 * size_of(f"{indexed}/chunk_contents")
