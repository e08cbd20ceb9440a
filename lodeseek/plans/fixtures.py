"""The engine's six tables over the test tables: documents are files, sources their sources, two views each.

View `main` holds every document; view `feature` leaves out every seventh and appends ` (edited)` to every fifth.
A file is one chunk. TABLES_SQL is the same in DuckDB, as common table expressions.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import postings
from ..store import TABLES, Store

_stores: dict[tuple[str, str], str] = {}
EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or, in local mode, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="lodeseek-plans-"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/lodeseek-{label}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


STORED = (*TABLES, "postings")


def stored(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = STORED) -> Store:
    """A new store with the named tables, whole; columns that the fixtures don't have are null."""
    store = Store(spark, scratch(spark, "store"))
    _put(store, tables(spark, sf_dir), names)
    return store


def _put(store: Store, made: dict[str, DataFrame], names: tuple[str, ...]) -> None:
    """Stores the named tables in one commit; chunk contents come before their postings."""
    change = store.change()
    for name in names:
        if name == "postings":
            contents = [e["rows"] for e in change.entries["chunk_contents"]]
            change.add(name, postings(store.spark.read.schema(TABLES["chunk_contents"]).parquet(*[store.files.at("chunk_contents", p) for p in contents])), in_runs=True)
        else:
            columns = [x.split() for x in TABLES[name].split(", ")]
            change.add(name, made[name].select(*[F.col(c) if c in made[name].columns else F.lit(None).cast(t).alias(c) for c, t in columns]))
    change.commit()


def shared_store(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = STORED) -> Store:
    """One store for all queries that only read it; each table is stored, whole, once a query first asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        _stores[key] = scratch(spark, "store")
    store = Store(spark, _stores[key])
    wanted = set(names) | ({"chunk_contents"} if "postings" in names else set())
    if missing := tuple(n for n in STORED if n in wanted and not store.current()[1].get(n)):
        _put(store, tables(spark, sf_dir), missing)
    return store


def _id(*parts) -> F.Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, ref, source_view_id, path, doc_id, lang, content, content_hash)."""
    d = read(spark, sf_dir, "documents")
    refs = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("main"))).otherwise(F.array(F.lit("main"), F.lit("feature")))
    d = d.select("source", "lang", "doc_id", "text", F.explode(refs).alias("ref"))
    edited = (F.col("ref") == "feature") & (F.col("doc_id") % 5 == 0)
    d = d.select("source", "lang", "doc_id", "ref", F.when(edited, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")).alias("content"))
    return d.select("source", "ref", _id(F.lit("view"), "source", "ref").alias("source_view_id"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "doc_id", "lang", "content", F.sha2("content", 256).alias("content_hash"))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    f = files(spark, sf_dir)
    names = read(spark, sf_dir, "documents").select("source").distinct()
    sources = names.select(_id(F.lit("source"), "source").alias("id"), F.col("source").alias("name"), F.lit("local").alias("type"), F.concat(F.lit("/data/"), "source").alias("path"), _id(F.lit("view"), "source", F.lit("main")).alias("active_view_id"))
    views = names.select("source", F.explode(F.array(F.lit("main"), F.lit("feature"))).alias("ref"))
    views = views.select(_id(F.lit("view"), "source", "ref").alias("id"), _id(F.lit("source"), "source").alias("source_id"), F.lit("branch").alias("view_kind"), F.col("ref").alias("ref_name"), (F.col("ref") == "feature").alias("dirty"))
    stamp = F.to_timestamp(F.lit(EPOCH)) + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    indexed = f.select(_id("source_view_id", "path").alias("id"), "source_view_id", "path", "content_hash", "doc_id", stamp.alias("indexed_at"))
    # Texts are shuffled once a table, by their hash ("" for null); what they are joined with comes to the same places.
    g = f.select(F.coalesce("content_hash", F.lit("")).alias("k"), "content_hash", "content", "doc_id")
    stamp = F.to_timestamp(F.lit(EPOCH)) + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    once = g.groupBy("k").agg(F.first("content_hash").alias("content_hash"), F.first("content").alias("content"), F.min("doc_id").alias("doc_id"))
    blobs = once.select("content_hash", "content", F.octet_length("content").cast("long").alias("byte_size"), stamp.alias("created_at"), "doc_id")
    vec = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    of_summary = vec.select(F.col("vec_id").alias("v"), F.col("embedding").alias("summary_embedding"))
    vectors = g.groupBy("k").agg(F.min("doc_id").alias("doc_id")).join(vec, F.col("doc_id") == F.col("vec_id"), "left").drop("vec_id")
    vectors = vectors.join(of_summary, (F.col("v") == F.col("doc_id") + 1) & (F.col("doc_id") % 3 == 0), "left").select("k", "embedding", "summary_embedding")
    summary = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Summary "), F.substring("content_hash", 1, 8)))
    contents = once.join(vectors, "k").select("content_hash", "content", stamp.alias("created_at"), "doc_id", "embedding", summary.alias("summary"), "summary_embedding")
    n_lines = F.size(F.split("content", "\n"))
    chunks = f.select(
        _id(_id("source_view_id", "path"), F.lit("0")).alias("id"), "source_view_id", _id("source_view_id", "path").alias("indexed_file_id"), F.col("content_hash").alias("chunk_content_hash"), "path",
        F.when(F.col("doc_id") % 10 == 0, "markdown").otherwise("text").alias("source_type"), F.lit(1).alias("start_line"), n_lines.alias("end_line"),
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("# "), "lang")).alias("header_path"), F.col("lang").alias("language"), F.lit(0).alias("ordinal"),
        F.to_json(F.struct(F.when(F.col("doc_id") % 4 == 0, "TYPE").when(F.col("doc_id") % 4 == 1, "CLASS").alias("fragmentType"))).alias("metadata"),
    )
    return {"sources": sources, "source_views": views, "indexed_files": indexed, "file_blobs": blobs, "chunk_contents": contents, "chunks": chunks}


TABLES_SQL = """
WITH f AS (
  SELECT source, lang, doc_id, ref, sha256('view:' || source || ':' || ref) AS source_view_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
    CASE WHEN ref = 'feature' AND doc_id % 5 = 0 THEN text || ' (edited)' ELSE text END AS content
  FROM documents, (VALUES ('main'), ('feature')) AS r(ref) WHERE NOT (ref = 'feature' AND doc_id % 7 = 0)
), files AS (SELECT *, sha256(content) AS content_hash FROM f),
names AS (SELECT DISTINCT source FROM documents),
sources AS (SELECT sha256('source:' || source) AS id, source AS name, 'local' AS type, '/data/' || source AS path, sha256('view:' || source || ':main') AS active_view_id FROM names),
source_views AS (SELECT sha256('view:' || source || ':' || ref) AS id, sha256('source:' || source) AS source_id, 'branch' AS view_kind, ref AS ref_name, ref = 'feature' AS dirty FROM names, (VALUES ('main'), ('feature')) AS r(ref)),
indexed_files AS (SELECT sha256(source_view_id || ':' || path) AS id, source_view_id, path, content_hash, doc_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS indexed_at FROM files),
file_blobs AS (SELECT content_hash, min(content) AS content, CAST(strlen(min(content)) AS BIGINT) AS byte_size, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(min(doc_id) AS INTEGER)) AS created_at, min(doc_id) AS doc_id FROM files GROUP BY content_hash),
chunk_contents AS (
  SELECT b.content_hash, b.content, b.created_at, b.doc_id, e.embedding, CASE WHEN b.doc_id % 3 = 0 THEN 'Summary ' || substr(b.content_hash, 1, 8) END AS summary, s.embedding AS summary_embedding
  FROM file_blobs b LEFT JOIN embeddings e ON e.vec_id = b.doc_id LEFT JOIN embeddings s ON s.vec_id = b.doc_id + 1 AND b.doc_id % 3 = 0
), chunks AS (
  SELECT sha256(sha256(source_view_id || ':' || path) || ':0') AS id, source_view_id, sha256(source_view_id || ':' || path) AS indexed_file_id, content_hash AS chunk_content_hash, path,
    CASE WHEN doc_id % 10 = 0 THEN 'markdown' ELSE 'text' END AS source_type, 1 AS start_line, len(string_split(content, chr(10))) AS end_line,
    CASE WHEN doc_id % 10 = 0 THEN '# ' || lang END AS header_path, lang AS language, 0 AS ordinal,
    CASE WHEN doc_id % 4 = 0 THEN 'TYPE' WHEN doc_id % 4 = 1 THEN 'CLASS' END AS fragment_type
  FROM files
)
"""
