"""Overlaps, hydration, the summarise loop, manifests, statements and the server's tools as queries."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from .. import server
from ..engine import Engine
from ..operators import chunking, search
from ..sources import archive
from ..store import TABLES, Files
from .fixtures import TABLES_SQL as T
from .fixtures import scratch, shared_store, stored
from .read_queries import _CUT, _as_files
from .registry import query
from .search_queries import _OCCURRENCE, _TWO, SEARCHED, TERMS, _found, _scope

_MAIN = "source_view_id IN (SELECT id FROM source_views WHERE ref_name = 'main')"


@query("c03_overlaps", _CUT.replace("{0}", ".txt").replace("{1}", "text") + "SELECT a.key AS path, CAST(count(*) AS BIGINT) AS seams, CAST(sum(a.from_char + length(a.content) - b.from_char) AS BIGINT) AS repeated FROM cut a JOIN cut b ON b.key = a.key AND b.ordinal = a.ordinal + 1 GROUP BY a.key")
def c03(spark, sf):
    """Per cut file: its seams, and how many characters are in two neighbouring chunks."""
    c = chunking.chunked(_as_files(spark, sf, ".txt"), chunkers=[chunking.FixedChunker()]).select("path", "ordinal", "start_offset", "end_offset")
    after = c.select("path", (F.col("ordinal") - 1).alias("ordinal"), F.col("start_offset").alias("next"))
    return c.join(after, ["path", "ordinal"]).groupBy("path").agg(F.count("*").alias("seams"), F.sum((F.col("end_offset") - F.col("next")).cast("long")).alias("repeated"))


@query(
    "s13_hydrate",
    _TWO + f" SELECT f.place, o.id AS chunk_id, o.path, s.name AS source_name, CAST(length(k.content) AS BIGINT) AS chars FROM (SELECT *, row_number() OVER (ORDER BY fused DESC, id) AS place FROM fusion) f "
    f"JOIN {_OCCURRENCE} o ON o.chunk_content_hash = f.id AND o.o = 1 JOIN chunk_contents k ON k.content_hash = f.id JOIN source_views v ON v.id = o.source_view_id JOIN sources s ON s.id = v.source_id",
)
def s13(spark, sf):
    t = shared_store(spark, sf, SEARCHED).tables()
    rows = search.hydrated(_found(spark, sf, False), t["chunks"], t["chunk_contents"], t["sources"], t["source_views"], _scope(t))
    return rows.select("place", "chunk_id", "path", "source_name", F.length("content").cast("long").alias("chars"))


_KIND = "coalesce(fragment_type, source_type)"


@query(
    "w14_summarize_loop",
    T + f", o AS (SELECT k.content_hash, k.content, c.path, {_KIND} AS kind, row_number() OVER (PARTITION BY k.content_hash ORDER BY c.id) AS r FROM chunk_contents k JOIN chunks c ON c.chunk_content_hash = k.content_hash WHERE k.summary IS NULL AND c.{_MAIN}) "
    "SELECT content_hash, CASE WHEN length(content) < 200 THEN '[skipped:content<200]' WHEN lower(kind) IN ('type', 'interface') AND NOT (contains(substr(content, 1, 256), '/**') OR contains(substr(content, 1, 256), '/*!') OR contains(substr(content, 1, 256), '\"\"\"')) THEN '[skipped:' || lower(kind) || '-without-docstring]' "
    "ELSE 'Mock summary ' || substr(sha256(path || '|' || content), 1, 8) || ': ' || lower(kind) || ' in ' || path || '. Content length ' || length(content) || ' chars; generated deterministically for tests.' END AS summary, true AS done FROM o WHERE r = 1",
)
def w14(spark, sf):
    """Engine.summarize over all contents of the active views without a summary; a second run finds none left."""
    store = stored(spark, sf, ("sources", "source_views", "indexed_files", "chunk_contents", "chunks"))
    engine = Engine(spark, store.folder, {"summarization": {"enabled": True}})
    before = store.table("chunk_contents").where("summary is null").select("content_hash")  # of this commit, whatever comes after
    engine.summarize()
    again = engine.summarize()
    return store.table("chunk_contents").where("summary is not null").join(before, "content_hash", "left_semi").select("content_hash", "summary", F.lit(not again).alias("done"))


_EXPORTED = ["src1", "src4"]


@query(
    "i14_manifest",
    T + f"SELECT s.name, 2 AS version, CAST(count(DISTINCT v.id) AS BIGINT) AS views, CAST(count(c.id) AS BIGINT) AS chunks, s.name IN ({', '.join(map(repr, _EXPORTED))}) AS listed FROM sources s JOIN source_views v ON v.source_id = s.id LEFT JOIN chunks c ON c.source_view_id = v.id WHERE s.name IN ({', '.join(map(repr, _EXPORTED))}) GROUP BY s.name",
)
def i14(spark, sf):
    """The manifest of an export, read back and checked; a manifest of version 1 is refused."""
    files = Files(spark, scratch(spark, "manifest"))
    archive.export(shared_store(spark, sf, tuple(TABLES)), _EXPORTED, files.folder)
    m = archive.checked(json.loads(files.read(files.at("manifest.json"))))
    try:
        archive.checked(m | {"version": 1})
    except ValueError:
        return spark.createDataFrame([(s["name"], m["version"], s["viewCount"], s["chunkCount"], s["name"] in _EXPORTED) for s in m["sources"]], "name string, version int, views long, chunks long, listed boolean")
    raise RuntimeError("a manifest of version 1 was read")


@query("i16_statements", T + " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(count(*) AS BIGINT) AS statements, CAST(0 AS BIGINT) AS torn FROM {n}" for n in TABLES))
def i16(spark, sf):
    """The SQL text of an export of all sources, split into statements: as many as rows, each whole."""
    target, store = scratch(spark, "sql"), shared_store(spark, sf, tuple(TABLES))
    archive.export(store, [r.name for r in store.table("sources").select("name").collect()], target, sql=True, compression="gzip")

    def split(batches):
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = archive.statements(body)
                torn = sum(not (s.startswith(f"INSERT INTO {name} ") and s.endswith(";")) for s in found)
                yield pa.RecordBatch.from_pydict({"name": [name], "statements": [len(found)], "torn": [torn]})

    parts = None
    for name in TABLES:
        files = spark.read.text(f"{target}/sql/{name}", wholetext=True).select(F.lit(name).alias("name"), "value")
        parts = files if parts is None else parts.unionByName(files)
    counts = parts.mapInArrow(split, "name string, statements long, torn long")
    return counts.groupBy("name").agg(F.sum("statements").alias("statements"), F.sum("torn").alias("torn"))


@query("u03_search_tool", _TWO + f" SELECT CAST(row_number() OVER (ORDER BY f.fused DESC, f.id) AS INTEGER) AS place, o.path FROM (SELECT * FROM fusion ORDER BY fused DESC, id LIMIT 5) f JOIN {_OCCURRENCE} o ON o.chunk_content_hash = f.id AND o.o = 1")
def u03(spark, sf):
    """The server's search tool with five results; its query vector is the one of the other search queries."""
    from .search_queries import query_vector

    engine = Engine(spark, shared_store(spark, sf, SEARCHED).folder)
    vector = query_vector(spark, sf)
    engine.embedder.query = lambda _: vector
    found = server.call(engine, "search", {"query": TERMS, "topK": 5})
    return spark.createDataFrame([(r["place"], r["path"]) for r in found], "place int, path string")


@query("u05_list_sources_tool", T + "SELECT name, path FROM sources WHERE starts_with(path, '/data/src1') ORDER BY name LIMIT 4")
def u05(spark, sf):
    found = server.call(Engine(spark, shared_store(spark, sf, ("sources", "source_views")).folder), "list_sources", {"sourceType": "local", "path": "/data/src1", "limit": 4})
    return spark.createDataFrame([(r["name"], r["path"]) for r in found], "name string, path string")


@query("u06_status_tool", T + "SELECT CAST((SELECT count(*) FROM sources) AS BIGINT) AS sources, CAST((SELECT count(*) FROM source_views) AS BIGINT) AS views, CAST((SELECT count(*) FROM indexed_files) AS BIGINT) AS files, CAST((SELECT count(*) FROM chunks) AS BIGINT) AS chunks, CAST((SELECT count(*) FROM chunk_contents WHERE embedding IS NOT NULL) AS BIGINT) AS embedded")
def u06(spark, sf):
    s = server.call(Engine(spark, shared_store(spark, sf, tuple(TABLES)).folder), "status", {})
    return spark.createDataFrame([tuple(s[c] for c in ("sources", "views", "files", "chunks", "embedded"))], "sources long, views long, files long, chunks long, embedded long")
