"""Further operators as queries: delete joins, score maps, counters, finalising, gates, language maps, scans, exports."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import code_nodes, scalar, text, vector
from ..operators import changes, chunking, fusion, indexing, joins, maintenance, ranks, search
from ..store import TABLES, Store
from . import code_shapes
from .fixtures import TABLES_SQL as T
from .fixtures import files, read, scratch, shared_store, tables
from .read_queries import main_views
from .registry import query
from .search_queries import _OPEN, TERMS, VECTOR_ID, _inside, _text_sql, _vector_sql, query_vector

_MAIN = "source_view_id IN (SELECT id FROM source_views WHERE ref_name = 'main')"


@query("j12_delete_join", T + "SELECT id FROM chunks WHERE source_view_id NOT IN (SELECT v.id FROM source_views v JOIN sources s ON s.id = v.source_id WHERE s.name = 'src1' AND v.ref_name = 'main')")
def j12(spark, sf):
    t = tables(spark, sf)
    gone = joins.views_of_source(t, "src1").where("ref_name = 'main'").select(F.col("id").alias("source_view_id"))
    return maintenance.without(t["chunks"], gone, ["source_view_id"]).select("id")


@query(
    "j14_score_maps",
    _OPEN + _text_sql(["the", "of"]) + ", " + _vector_sql("vector_channel") + " SELECT coalesce(t.id, v.id) AS id, t.score AS text_score, v.score AS vector_score FROM text_channel t FULL JOIN vector_channel v ON v.id = t.id",
)
def j14(spark, sf):
    inside = _inside(tables(spark, sf))
    both = {"text": search.text_search(inside, TERMS, 50), "vector": search.vector_search(inside, query_vector(spark, sf), 50)}
    return fusion.fused(both, {"text": 1.0, "vector": 1.0}).select("id", "text_score", "vector_score")


_SHAPE = T + f"SELECT c.path, k.content_hash FROM chunks c JOIN chunk_contents k ON k.content_hash = c.chunk_content_hash WHERE contains(lower(k.content), 'with') AND {_MAIN}"


@query("j17_search_then_join", _SHAPE)
def j17_a(spark, sf):
    t = tables(spark, sf)
    hits = t["chunk_contents"].where(F.contains(F.lower("content"), F.lit("with"))).select("content_hash")
    return hits.join(joins.in_views(t["chunks"], main_views(t)).select("path", F.col("chunk_content_hash").alias("content_hash")), "content_hash").select("path", "content_hash")


@query("j17_join_then_search", _SHAPE)
def j17_b(spark, sf):
    t = tables(spark, sf)
    rows = joins.in_views(t["chunks"], main_views(t)).join(t["chunk_contents"].select("content_hash", "content"), F.col("chunk_content_hash") == F.col("content_hash"))
    return rows.where(F.contains(F.lower("content"), F.lit("with"))).select("path", "content_hash")


@query(
    "a12_rrf_sum",
    "WITH r AS (SELECT doc_id AS id, quality AS channel, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rank FROM labels UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY doc_id DESC) FROM labels) SELECT id, round(sum(CASE channel WHEN 2 THEN 0.6 ELSE 0.4 END / (60 + rank)), 9) AS fused FROM r GROUP BY id",
)
def a12(spark, sf):
    """Three rankings of whole tables, ranked by ranges, so none goes through one task."""
    d = read(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    channels = {f"q{q}": d.where(F.col("quality") == q).select("id", (-F.col("id")).alias("score")) for q in (0, 1)} | {"all": d.select("id", F.col("id").alias("score"))}
    channels = {name: ranks.numbered(c, [F.desc("score"), F.col("id")], "rank", scratch(spark, f"rank-{name}")) for name, c in channels.items()}
    return fusion.fused(channels, {"q0": 0.4, "q1": 0.4, "all": 0.6}).select("id", "fused")


@query(
    "a16_index_counters",
    T + "SELECT CAST(count(*) FILTER (WHERE o.path IS NULL OR n.content_hash <> o.content_hash) AS BIGINT) AS new, CAST(count(*) FILTER (WHERE n.path IS NULL) AS BIGINT) AS deleted, CAST(count(*) FILTER (WHERE n.content_hash = o.content_hash) AS BIGINT) AS unchanged "
    "FROM (SELECT * FROM files WHERE ref = 'feature') n FULL JOIN (SELECT * FROM files WHERE ref = 'main') o ON n.path = o.path",
)
def a16(spark, sf):
    f = files(spark, sf).select("path", "content_hash", "ref")
    s = changes.compare(f.where("ref = 'feature'"), f.where("ref = 'main'"))
    return s.agg(F.count_if(F.col("status").isin("added", "modified")).alias("new"), F.count_if(F.col("status") == "deleted").alias("deleted"), F.count_if(F.col("status") == "unchanged").alias("unchanged"))


@query("w05_append_chunks", T + "SELECT id, path FROM chunks")
def w05(spark, sf):
    """Two appends in one commit, and a third in another."""
    c = shared_store(spark, sf, ("chunks",)).table("chunks")
    store = Store(spark, scratch(spark, "append"))
    change = store.change()
    for kind in ("CLASS", "TYPE"):
        change.add("chunks", c.where(F.get_json_object("metadata", "$.fragmentType") == kind))
    change.commit()
    change = store.change()
    change.add("chunks", c.where(F.get_json_object("metadata", "$.fragmentType").isNull()))
    change.commit()
    return store.table("chunks").select("id", "path")


@query(
    "w09_finalise",
    "SELECT 'branch' AS view_kind, ref AS ref_name, CAST(count(*) AS INTEGER) AS file_count, true AS counted, ref = 'b' AS active FROM documents, (VALUES ('a'), ('b')) AS r(ref) WHERE ref = 'a' OR doc_id % 3 > 0 GROUP BY ref",
)
def w09(spark, sf):
    """Indexes all documents as one branch of a source, and two thirds as another; the view indexed last is the active one."""
    engine = Engine(spark, scratch(spark, "finalise"))
    d = read(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    engine.index_documents("all", d.select("path", "content"), "a", "2024-01-01 00:00:00")
    engine.index_documents("all", d.where("doc_id % 3 > 0").select("path", "content"), "b", "2024-01-02 00:00:00")
    t = engine.store.tables()
    chunks = t["chunks"].groupBy(F.col("source_view_id").alias("id")).agg(F.count("*").alias("n"))
    v = t["source_views"].join(chunks, "id").join(t["sources"].select(F.col("active_view_id")), F.col("active_view_id") == F.col("id"), "left")
    return v.select("view_kind", "ref_name", "file_count", (F.col("chunk_count") == F.col("n")).alias("counted"), F.col("active_view_id").isNotNull().alias("active"))


@query("w16_full_scan_diff", T + "SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN n.content_hash = o.content_hash THEN 'unchanged' ELSE 'modified' END AS status FROM (SELECT * FROM files WHERE ref = 'main') n FULL JOIN (SELECT * FROM files WHERE ref = 'feature') o ON n.path = o.path) GROUP BY status")
def w16(spark, sf):
    f = files(spark, sf).select("path", "content_hash", "ref")
    return changes.compare(f.where("ref = 'main'"), f.where("ref = 'feature'")).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "w18_index_view",
    T + "SELECT n.path, n.content_hash, CAST(CASE WHEN NOT EXISTS (SELECT 1 FROM files m WHERE m.ref = 'main' AND m.content_hash = n.content_hash) THEN strlen(n.content) END AS BIGINT) AS new_bytes FROM (SELECT * FROM files WHERE ref = 'feature') n LEFT JOIN (SELECT * FROM files WHERE ref = 'main') o ON o.path = n.path WHERE o.path IS NULL OR o.content_hash <> n.content_hash",
)
def w18(spark, sf):
    """What indexing the feature files over the main view writes: files, with the bytes of blobs that the store hasn't yet."""
    t = tables(spark, sf)
    main = files(spark, sf).where("ref = 'main'")
    state = t | {"indexed_files": main.select(F.lit("v").alias("source_view_id"), "path", "content_hash")}
    for name in ("file_blobs", "chunk_contents"):
        state[name] = t[name].join(main.select("content_hash"), "content_hash", "left_semi")
    done = indexing.index_view(files(spark, sf).where("ref = 'feature'").select("path", "content"), "v", state, indexing.HashEmbedder(8), F.to_timestamp(F.lit("2024-01-01")))
    return done.files.join(done.blobs.select("content_hash", F.col("byte_size").alias("new_bytes")), "content_hash", "left").select("path", "content_hash", "new_bytes")


@query("w20_embedding_deferred", T + "SELECT CAST(count(*) FILTER (WHERE length(content) % 3 = 0) AS BIGINT) AS deferred, CAST(count(*) FILTER (WHERE length(content) % 3 > 0) AS BIGINT) AS embedded FROM chunk_contents")
def w20(spark, sf):
    """An embedder that fails for a third of the texts: their batches stay without a vector, others have theirs."""

    def embed_many(texts):
        if any(len(x) % 3 == 0 for x in texts):
            raise RuntimeError("the provider refuses")
        return [[1.0, float(len(x))] for x in texts]

    k = tables(spark, sf)["chunk_contents"].select("content")
    made = indexing.BatchEmbedder(embed_many, 2, 1).embed(k, "content", "vector")
    return made.agg(F.count_if(F.col("vector").isNull()).alias("deferred"), F.count_if((F.col("vector")[1] == F.length("content"))).alias("embedded"))


@query(
    "s07_source_name",
    T + "SELECT 'view' AS kind, v.id AS value FROM source_views v JOIN sources s ON s.id = v.source_id WHERE s.name = 'src6' AND v.ref_name = 'main' UNION ALL SELECT 'branch', v.id FROM source_views v JOIN sources s ON s.id = v.source_id WHERE s.name = 'src6' AND v.ref_name = 'feature' "
    "UNION ALL SELECT 'error', 'no source nope' UNION ALL SELECT 'error', 'give a source''s id or its name, not both'",
)
def s07(spark, sf):
    """The views of a name by default and by branch, and what names that can't be resolved say."""
    engine = Engine(spark, shared_store(spark, sf, ("sources", "source_views")).folder)
    rows = engine.scope(source_name="src6").views.select(F.lit("view").alias("kind"), F.col("id").alias("value")).unionByName(engine.scope("feature", source_name="src6").views.select(F.lit("branch").alias("kind"), F.col("id").alias("value")))
    for wrong in ({"source_name": "nope"}, {"source_name": "src6", "source_id": "x"}):
        try:
            engine.scope(**wrong)
        except ValueError as e:
            rows = rows.unionByName(spark.range(1).select(F.lit("error").alias("kind"), F.lit(str(e)).alias("value")))
    return rows


@query(
    "s08_summary_gate",
    T + "SELECT s.name, count(k.summary_embedding) > 0 AS three_way FROM sources s JOIN source_views v ON v.source_id = s.id AND v.ref_name = 'feature' LEFT JOIN chunks c ON c.source_view_id = v.id LEFT JOIN chunk_contents k ON k.content_hash = c.chunk_content_hash GROUP BY s.name",
)
def s08(spark, sf):
    """Whether summaries take part, for each source's branch as a scope, in one job."""
    t = tables(spark, sf)
    views = t["source_views"].where("ref_name = 'feature'").join(t["sources"].select(F.col("id").alias("source_id"), "name"), "source_id")
    return search.summaries_by(t["chunks"], t["chunk_contents"], views, "name")


@query("s09_occurrence_in_scope", T + f"SELECT chunk_content_hash, path FROM (SELECT *, row_number() OVER (PARTITION BY chunk_content_hash ORDER BY path, ordinal, id) AS r FROM chunks WHERE {_MAIN} AND source_type = 'text') WHERE r = 1")
def s09(spark, sf):
    t = tables(spark, sf)
    return search.occurrences(joins.in_views(t["chunks"], main_views(t)), search.Scope(source_type="text")).select("chunk_content_hash", "path")


@query("f09_coalesce_cast", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'none') AS quality, CAST(d.n_chars AS DOUBLE) / 4 AS tokens FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def f09(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("quality"), (F.col("n_chars").cast("double") / 4).alias("tokens"))


@query("f11_cosine_distance", f"SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID}) AS DOUBLE[])), 6) AS distance FROM embeddings")
def f11(spark, sf):
    q = vector.literal(query_vector(spark, sf))
    return read(spark, sf, "embeddings").select("vec_id", F.round(1 - vector.cosine(F.col("embedding"), q), 6).alias("distance"))


@query("f12_match", "SELECT doc_id, list_contains(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''), 'with') AS hit FROM documents")
def f12(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_contains(text.tokens(F.col("text")), "with").alias("hit"))


@query("f18_cost_format", "SELECT doc_id, CASE WHEN n_chars / 7e5 < 0.01 THEN '$' || printf('%.2f', n_chars / 7e5 * 1000) || 'm' ELSE '$' || printf('%.3f', n_chars / 7e5) END AS cost FROM documents")
def f18(spark, sf):
    return read(spark, sf, "documents").select("doc_id", scalar.cost_text(F.col("n_chars") / 7e5).alias("cost"))


@query("l06_final_cut", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) LIMIT 100")
def l06(spark, sf):
    """A final cut above the candidates' cut gives the candidates."""
    d = read(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return d.select("doc_id").limit(100)


_ENDINGS = (*code_nodes.LANGUAGES, ".go", ".TSX", "")


@query("c07_language_map", f"SELECT doc_id, path, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) {' '.join(f"WHEN '{e}' THEN '{x}'" for e, x in code_nodes.LANGUAGES.items())} END AS language FROM (SELECT doc_id, source || '/v.' || lang || '/' || doc_id || ([{', '.join(map(repr, _ENDINGS))}])[CAST(doc_id % {len(_ENDINGS)} + 1 AS INTEGER)] AS path FROM documents)")
def c07(spark, sf):
    """The grammar of each document's path, whose ending follows from its id."""
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % len(_ENDINGS) + 1).cast("int"))
    paths = read(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/v."), "lang", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"))
    return paths.select("doc_id", "path", chunking.language_of("path").alias("language"))


def code_files(spark, sf, shapes: list[tuple[str, str, str]]):
    """A file a document, (path, content): its text as a comment, then one of the shapes (ending, code, declarations) by its id."""
    at = (F.col("doc_id") % len(shapes) + 1).cast("int")
    of = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in shapes]), at)
    number = F.col("doc_id").cast("string")
    code = F.regexp_replace(of(1), F.lit(r"(?<=\w)@"), number)
    comment = F.concat(F.lit("/*\n"), F.translate(F.coalesce("text", F.lit("")), "*", " "), F.lit("\n*/\n"))
    return read(spark, sf, "documents").select(F.concat(number, of(0)).alias("path"), F.concat(comment, code).alias("content"))


def code_sql(shapes: list[tuple[str, str, str]]) -> str:
    of = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = [f"({i}, '{ending}', '{code_nodes.LANGUAGES[ending]}', {n}, {of(name)}, '{kind}', {a}, {b}, {of(subtype)}, {of(receiver)})" for i, (ending, _, held) in enumerate(shapes) for n, (kind, name, a, b, subtype, receiver) in enumerate(code_shapes.declared(held))]
    number, lines = "CAST(doc_id AS VARCHAR)", "length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 3"
    # Runs of properties are named after their first line.
    names = f"replace(CASE WHEN subtype = 'PROPERTIES' THEN regexp_replace(fqn, '[0-9]+$', CAST(a + {lines} AS VARCHAR)) ELSE fqn END, '@', {number}) AS fqn, kind AS fragment_type, subtype AS fragment_subtype, replace(receiver, '@', {number}) AS receiver_type"
    return f"SELECT {number} || ext AS path, CAST(n AS INTEGER) AS ordinal, language, {names}, CAST(a + {lines} AS INTEGER) AS start_line, CAST(b + {lines} AS INTEGER) AS end_line FROM documents JOIN (VALUES {', '.join(rows)}) AS v(shape, ext, language, n, fqn, kind, a, b, subtype, receiver) ON doc_id % {len(shapes)} = shape"


_SHAPES = {".ts": code_shapes.TYPESCRIPT, ".java": code_shapes.JAVA, ".kt": code_shapes.KOTLIN}
_SHAPES = {ending: [(".tsx" if "<div" in code else ending, code, held) for code, held in shapes] for ending, shapes in _SHAPES.items()}


def _declared(spark, sf, shapes):
    return chunking.chunked(code_files(spark, sf, shapes)).select("path", "ordinal", "language", "fqn", "fragment_type", "fragment_subtype", "receiver_type", "start_line", "end_line")


@query("c06_declarations", code_sql([s for shapes in _SHAPES.values() for s in shapes]))
def c06(spark, sf):
    """Files of three languages side by side."""
    return _declared(spark, sf, [s for shapes in _SHAPES.values() for s in shapes])


@query("c08_typescript_nodes", code_sql(_SHAPES[".ts"]))
def c08(spark, sf):
    return _declared(spark, sf, _SHAPES[".ts"])


@query("c09_java_nodes", code_sql(_SHAPES[".java"]))
def c09(spark, sf):
    return _declared(spark, sf, _SHAPES[".java"])


@query("c10_kotlin_nodes", code_sql(_SHAPES[".kt"]))
def c10(spark, sf):
    return _declared(spark, sf, _SHAPES[".kt"])


@query("i01_directory_scan", "SELECT doc_id || '.txt' AS path, text AS content FROM documents WHERE doc_id % 2 = 0 AND strlen(text) <= 1048576")
def i01(spark, sf):
    """All documents as files, written by the executors into the shared folder, half of them with a suffix that is filtered out, and scanned."""
    from ..sources.scan import scan

    folder = scratch(spark, "scan")

    def write(batches):
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    suffix = F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".png")
    d = read(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), suffix).alias("name"), "text")
    d.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return scan(spark, folder)[0]


@query("i11_export_tables", T + "SELECT 'chunks' AS kind, id FROM chunks WHERE starts_with(path, 'src2/') UNION ALL SELECT 'contents', content_hash FROM chunk_contents WHERE content_hash IN (SELECT chunk_content_hash FROM chunks WHERE starts_with(path, 'src2/')) UNION ALL SELECT 'files', id FROM indexed_files WHERE starts_with(path, 'src2/')")
def i11(spark, sf):
    from ..sources.archive import tables_of

    t = tables_of(tables(spark, sf), ["src2"])
    part = lambda kind, df, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return part("chunks", t["chunks"], "id").union(part("contents", t["chunk_contents"], "content_hash")).union(part("files", t["indexed_files"], "id"))


@query(
    "u04_read_by_heading",
    T + f", m AS (SELECT c.path, k.content, c.end_line FROM chunks c JOIN chunk_contents k ON k.content_hash = c.chunk_content_hash WHERE {_MAIN} AND header_path = '# fr' ORDER BY path LIMIT 1) SELECT 'heading' AS asked, path, content, 1 AS start_line, end_line FROM m "
    "UNION ALL SELECT 'lines', path, array_to_string(list_slice(string_split(content, chr(10)), 1, least(end_line, 3)), chr(10)), 1, CAST(least(end_line, 3) AS INTEGER) FROM m UNION ALL SELECT 'branch', path, content, 1, end_line FROM m UNION ALL SELECT 'nothing', NULL, NULL, NULL, NULL",
)
def u04(spark, sf):
    """Engine.read_source by heading, by lines with context, from a branch that isn't there, and of a path that isn't."""
    store = shared_store(spark, sf, tuple(TABLES))
    engine, c = Engine(spark, store.folder), store.table("chunks")
    path = joins.in_views(c, main_views(store.tables())).where("header_path = '# fr'").agg(F.min("path")).first()[0]
    asked = {"heading": {"path": path, "header_path": "# fr"}, "lines": {"path": path, "start_line": 2, "context": 1}, "branch": {"path": path, "branch": "nope"}, "nothing": {"path": "no/such.txt", "branch": "feature"}}
    rows = []
    for name, a in asked.items():
        r = engine.read_source(**a)
        rows.append((name, r and r["path"], r and r["content"], r and r["start_line"], r and r["end_line"]))
    return spark.createDataFrame(rows, "asked string, path string, content string, start_line int, end_line int")
