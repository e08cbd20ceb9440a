"""Writes, deletes, clean-up and indexing as queries over the state they leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import changes, maintenance
from ..sources import archive
from ..store import TABLES, Store
from ..streaming import ingest
from ..streaming.ingest import windowed
from .fixtures import TABLES_SQL as T
from .fixtures import files, read, scratch, shared_store, stored, tables
from .read_queries import windows_sql
from .registry import query

_MAIN = "source_view_id IN (SELECT id FROM source_views WHERE ref_name = 'main')"


@query("w01_source_upsert", T + "SELECT id, name, CASE WHEN name LIKE 'src1%' THEN '/moved/' || name ELSE path END AS path FROM sources UNION ALL SELECT sha256('source:new'), 'new', '/moved/new'")
def w01(spark, sf):
    old = tables(spark, sf)["sources"].select("id", "name", "path")
    new = old.where("name like 'src1%'").select(F.lit("other").alias("id"), "name", F.concat(F.lit("/moved/"), "name").alias("path"))
    added = spark.range(1).select(F.sha2(F.lit("source:new"), 256).alias("id"), F.lit("new").alias("name"), F.lit("/moved/new").alias("path"))
    return maintenance.upsert(old, new.unionByName(added), ["name"])


@query("w02_view_upsert", T + "SELECT source_id, view_kind, CASE WHEN ref_name = 'feature' THEN NULL ELSE ref_name END AS ref_name, CASE WHEN ref_name = 'feature' THEN true ELSE dirty END AS dirty FROM source_views")
def w02(spark, sf):
    v = tables(spark, sf)["source_views"]
    old = v.select("source_id", "view_kind", F.when(F.col("ref_name") != "feature", F.col("ref_name")).alias("ref_name"), F.lit(False).alias("dirty"))
    return maintenance.upsert(old, old.where("ref_name is null").withColumn("dirty", F.lit(True)), ["source_id", "view_kind", "ref_name"])


@query("w03_insert_absent", T + "SELECT DISTINCT content_hash FROM files")
def w03(spark, sf):
    f = files(spark, sf).select("content_hash", "ref")
    old = f.where("ref = 'main'").select("content_hash").distinct()
    return maintenance.insert_absent(old, f.where("ref = 'feature'").select("content_hash"), "content_hash")


@query("w04_file_upsert", T + "SELECT o.path, coalesce(n.content_hash, o.content_hash) AS content_hash FROM (SELECT * FROM files WHERE ref = 'main') o LEFT JOIN (SELECT * FROM files WHERE ref = 'feature') n ON n.path = o.path")
def w04(spark, sf):
    f = files(spark, sf).select("path", "content_hash", "ref")
    return maintenance.upsert(f.where("ref = 'main'").drop("ref"), f.where("ref = 'feature'").drop("ref"), ["path"])


@query("w06_delete_paths", T + f"SELECT id, path FROM indexed_files WHERE NOT ({_MAIN} AND starts_with(path, 'src2/'))")
def w06(spark, sf):
    t = tables(spark, sf)
    rows = t["indexed_files"].select("id", "path", "source_view_id")
    views = t["source_views"].where("ref_name = 'main'").select(F.col("id").alias("source_view_id"))
    gone = rows.where("path like 'src2/%'").join(views, "source_view_id", "left_semi")
    return maintenance.without(rows, gone, ["source_view_id", "path"]).select("id", "path")


_SUM = "round(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE))), 4)"


@query("w07_embedding_update", T + f"SELECT content_hash, CASE WHEN embedding IS NULL AND doc_id % 2 = 0 THEN doc_id + 0.5::DOUBLE ELSE {_SUM.format('embedding')} END AS total FROM chunk_contents")
def w07(spark, sf):
    """Vectors for contents that have none; where no new one was made, the old one stays."""
    k = tables(spark, sf)["chunk_contents"].select("content_hash", "embedding", "doc_id")
    new = k.where("embedding is null").select("content_hash", F.when(F.col("doc_id") % 2 == 0, F.array(F.col("doc_id").cast("float"), F.lit(0.5).cast("float"))).alias("embedding"))
    out = maintenance.updated(k, new.where("embedding is not null"), "content_hash", ["embedding"])
    return out.select("content_hash", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("w08_summary_update", T + "SELECT content_hash, coalesce(summary, 'S ' || content_hash) AS summary, coalesce(summary_embedding, embedding) IS NOT NULL AS has_vector FROM (SELECT content_hash, summary, embedding, CASE WHEN summary IS NOT NULL THEN summary_embedding END AS summary_embedding FROM chunk_contents) WHERE summary IS NULL OR summary_embedding IS NOT NULL")
def w08(spark, sf):
    k = tables(spark, sf)["chunk_contents"].select("content_hash", "summary", "summary_embedding", "embedding")
    new = k.where("summary is null").select("content_hash", F.concat(F.lit("S "), "content_hash").alias("summary"), F.col("embedding").alias("summary_embedding"))
    out = maintenance.updated(k, new, "content_hash", ["summary", "summary_embedding"])
    return out.where("summary like 'S %' or summary_embedding is not null").select("content_hash", "summary", F.col("summary_embedding").isNotNull().alias("has_vector"))


@query("w10_stale_branches", T + "SELECT id, ref_name FROM source_views WHERE source_id = sha256('source:src5') AND ref_name <> 'main'")
def w10(spark, sf):
    return maintenance.stale_branches(tables(spark, sf)["source_views"], _source(spark, "src5"), ["main"]).select("id", "ref_name")


def _source(spark, name: str) -> str:
    import hashlib

    return hashlib.sha256(f"source:{name}".encode()).hexdigest()


_KEPT = "source_view_id NOT IN (SELECT id FROM source_views WHERE ref_name = 'feature')"


@query(
    "w11_collect_garbage",
    T + f"SELECT 'contents' AS kind, content_hash FROM chunk_contents k WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_content_hash = k.content_hash AND {_KEPT}) OR created_at >= TIMESTAMP '2024-01-01 10:00:00' UNION ALL "
    f"SELECT 'blobs', content_hash FROM file_blobs k WHERE EXISTS (SELECT 1 FROM indexed_files c WHERE c.content_hash = k.content_hash AND {_KEPT}) OR created_at >= TIMESTAMP '2024-01-01 10:00:00'",
)
def w11(spark, sf):
    t = tables(spark, sf)
    left = maintenance.collected(maintenance.delete_views(t, t["source_views"].where("ref_name = 'feature'")), "2024-01-01 11:00:00", 60)
    return left["chunk_contents"].select(F.lit("contents").alias("kind"), "content_hash").unionByName(left["file_blobs"].select(F.lit("blobs").alias("kind"), "content_hash"))


@query(
    "w12_cascade_delete",
    T + "SELECT 'sources' AS kind, CAST(count(*) AS BIGINT) AS n FROM sources WHERE name <> 'src3' UNION ALL SELECT 'views', CAST(count(*) AS BIGINT) FROM source_views WHERE source_id <> sha256('source:src3') UNION ALL "
    "SELECT 'files', CAST(count(*) AS BIGINT) FROM indexed_files WHERE NOT starts_with(path, 'src3/') UNION ALL SELECT 'chunks', CAST(count(*) AS BIGINT) FROM chunks WHERE NOT starts_with(path, 'src3/')",
)
def w12(spark, sf):
    left = maintenance.delete_source(tables(spark, sf), "src3")
    one = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one("sources", left["sources"]).union(one("views", left["source_views"])).union(one("files", left["indexed_files"])).union(one("chunks", left["chunks"]))


@query(
    "w17_diff_scan",
    T + "SELECT p.path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN n.content_hash = o.content_hash THEN 'unchanged' ELSE 'modified' END AS status FROM (SELECT DISTINCT path FROM files) p "
    "LEFT JOIN (SELECT * FROM files WHERE ref = 'feature') n ON n.path = p.path LEFT JOIN (SELECT * FROM files WHERE ref = 'main') o ON o.path = p.path",
)
def w17(spark, sf):
    f = files(spark, sf).select("path", "content_hash", "ref")
    return changes.compare_paths(f, f.where("ref = 'feature'"), f.where("ref = 'main'"))


@query("w13_reembed_queue", T + "SELECT CAST(count(*) FILTER (WHERE embedding IS NULL) AS BIGINT) AS made, CAST(0 AS BIGINT) AS open, CAST(count(*) AS BIGINT) AS contents, CAST(0 AS BIGINT) AS made_again FROM chunk_contents")
def w13(spark, sf):
    """Engine.re_embed over contents without a vector; a second run finds none left."""
    engine = Engine(spark, stored(spark, sf, ("chunk_contents",)).folder)
    made, again = engine.re_embed(), engine.re_embed()
    k = engine.store.table("chunk_contents")
    return k.agg(F.lit(made).cast("long").alias("made"), F.count_if(F.col("embedding").isNull()).alias("open"), F.countDistinct("content_hash").alias("contents"), F.lit(again).cast("long").alias("made_again"))


@query("w19_repair_chunkless", T.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + windows_sql("SELECT f.id AS key, b.content AS text FROM indexed_files f JOIN file_blobs b ON b.content_hash = f.content_hash WHERE f.doc_id % 10 = 0") + "SELECT f.path, f.source_view_id, c.ordinal, f.content_hash, c.content FROM cut c JOIN indexed_files f ON f.id = c.key")
def w19(spark, sf):
    from ..operators.indexing import repaired

    t = tables(spark, sf)
    made = repaired(t["indexed_files"], t["chunks"].where("source_type <> 'markdown'"), t["file_blobs"])
    return made.select("path", "source_view_id", "ordinal", "content_hash", "content")


@query("i15_import_remap", T + "SELECT 'sources' AS kind, name AS id, CASE WHEN name = 'src2' THEN path ELSE replace(path, '/data', '/restored') END AS value FROM sources WHERE name IN ('src1', 'src2') UNION ALL SELECT 'chunks', id, path FROM chunks WHERE starts_with(path, 'src1/') OR starts_with(path, 'src2/') UNION ALL SELECT 'skipped', 'src2', NULL")
def i15(spark, sf):
    """Exports two sources and imports them with another path into a store that has one of them already, which is left as it is."""
    store, target = shared_store(spark, sf, tuple(TABLES)), scratch(spark, "export")
    archive.export(store, ["src1", "src2"], target)
    other = Store(spark, scratch(spark, "import"))
    change = other.change()
    for name, rows in archive.tables_of(store.tables(), ["src2"]).items():
        change.add(name, rows)
    change.commit()
    _, skipped, _ = archive.import_(other, target, remap=("/data", "/restored"))
    t = other.tables()
    rows = t["sources"].select(F.lit("sources").alias("kind"), F.col("name").alias("id"), F.col("path").alias("value")).unionByName(t["chunks"].select(F.lit("chunks").alias("kind"), "id", F.col("path").alias("value")))
    return rows.unionByName(spark.createDataFrame([("skipped", x, None) for x in skipped], "kind string, id string, value string"))


@query("x01_change_feed", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x01(spark, sf):
    """The events as a stream into windowed counts, by a table that the stream writes."""
    events = read(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = scratch(spark, "feed")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    windowed(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark, "feed-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("w17_stream_order", "SELECT CAST(doc_id AS VARCHAR) || '.txt' AS path, sha256(text) AS content_hash FROM documents WHERE doc_id % 9 <> 0 AND text IS NOT NULL")
def w17_stream(spark, sf):
    """All documents as a stream of changes whose older versions come last: the store holds the newest, and no deleted path."""
    feed, engine = scratch(spark, "feed"), Engine(spark, scratch(spark, "streamed"))
    d = read(spark, sf, "documents").select(F.lit("all").alias("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "doc_id", "text")
    newest = d.select("source", "path", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("content"), F.lit(3).cast("long").alias("version"))
    older = d.select("source", "path", F.concat(F.lit("older "), F.coalesce("text", F.lit(""))).alias("content"), (F.col("doc_id") % 3).cast("long").alias("version"))
    checkpoint = scratch(spark, "stream-checkpoint")
    for part in (newest, older):
        part.write.mode("append").parquet(feed)
        ingest.ingest(spark.readStream.schema(part.schema).parquet(feed), engine, checkpoint).awaitTermination()
    return engine.store.table("indexed_files").select("path", "content_hash")
