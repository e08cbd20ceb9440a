"""Exports: Parquet tables with a manifest in a folder or an archive, and their import."""

from __future__ import annotations

import json
import os
import tarfile
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import insert_text
from ..operators import joins, maintenance
from ..operators.search import postings
from ..store import SCHEMA_VERSION, TABLES, Files, Store

VERSION = 2


def tables_of(tables: dict[str, DataFrame], names: list[str]) -> dict[str, DataFrame]:
    """The rows of all tables that belong to the named sources; contents and blobs by semi joins."""
    s = tables["sources"].where(F.col("name").isin(*names))
    v = tables["source_views"].join(s.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    f, c = joins.in_views(tables["indexed_files"], v), joins.in_views(tables["chunks"], v)
    return {
        "sources": s, "source_views": v, "indexed_files": f, "chunks": c,
        "file_blobs": tables["file_blobs"].join(f.select("content_hash"), "content_hash", "left_semi"),
        "chunk_contents": tables["chunk_contents"].join(c.select(F.col("chunk_content_hash").alias("content_hash")), "content_hash", "left_semi"),
    }


def manifest(tables: dict[str, DataFrame], created_at: str | None = None) -> dict:
    views = {r.source_id: r.n for r in tables["source_views"].groupBy("source_id").agg(F.count("*").alias("n")).collect()}
    chunks = {r.source_id: r.n for r in tables["chunks"].join(tables["source_views"].select(F.col("id").alias("source_view_id"), "source_id"), "source_view_id").groupBy("source_id").agg(F.count("*").alias("n")).collect()}
    embedded = not tables["chunk_contents"].where("embedding is not null").isEmpty()
    sources = [{"name": r.name, "type": r.type, "path": r.path, "viewCount": views.get(r.id, 0), "chunkCount": chunks.get(r.id, 0)} for r in tables["sources"].orderBy("name").collect()]
    return {"version": VERSION, "schemaVersion": SCHEMA_VERSION, "createdAt": created_at or datetime.now(timezone.utc).isoformat(), "sources": sources, "hasEmbeddings": embedded}


def checked(m: dict) -> dict:
    if m.get("version") != VERSION:
        raise ValueError(f"manifest version {m.get('version')} can't be read")
    if m.get("schemaVersion") not in (1, SCHEMA_VERSION):  # the exported tables are the same in both
        raise ValueError(f"the export has schema {m.get('schemaVersion')}, not {SCHEMA_VERSION}")
    if not isinstance(m.get("sources"), list) or not all(s.get("name") for s in m["sources"]):
        raise ValueError("the manifest lists no sources")
    return m


def _is_archive(target: str) -> bool:
    return target.endswith((".tar", ".tar.gz", ".tgz"))


def pack(files: Files, folder: str, target: str) -> str:
    """A folder of any file system as a tar archive on any file system, compressed if the name ends in gz.

    Files pass the driver's disk one by one; the archive itself is there once, as a tar file is one file.
    """
    with tempfile.TemporaryDirectory(prefix="lodeseek-pack-") as here:
        made, one = os.path.join(here, "archive"), os.path.join(here, "one")
        with tarfile.open(made, "w:gz" if target.endswith("gz") else "w") as t:
            for name in files.walk(folder):
                files.fetch(f"{folder.rstrip('/')}/{name}", one)
                t.add(one, name)
                os.remove(one)
        files.send(made, target)
    return target


def unpack(files: Files, archive: str, folder: str) -> str:
    """An archive on any file system into a folder on any file system, file by file."""
    with tempfile.TemporaryDirectory(prefix="lodeseek-unpack-") as here:
        held = os.path.join(here, "archive")
        files.fetch(archive, held)
        with tarfile.open(held) as t:
            for member in t:
                if member.isfile():
                    t.extract(member, here, filter="data")
                    files.send(os.path.join(here, member.name), f"{folder.rstrip('/')}/{member.name}")
                    os.remove(os.path.join(here, member.name))
    return folder


def statements(text: str) -> list[str]:
    """The statements of an SQL export: comment and blank lines are skipped, a line that ends in `;` ends one."""
    out, held = [], []
    for line in text.split("\n"):
        if not held and (not line.strip() or line.lstrip().startswith("--")):
            continue
        held.append(line)
        if line.rstrip().endswith(";"):
            out.append("\n".join(held))
            held = []
    return out + (["\n".join(held)] if held else [])


#: Statements of an SQL file.
STATEMENTS = 20_000


def export(store: Store, names: list[str], target: str, sql: bool = False, compression: str | None = None) -> dict:
    """Writes the sources' tables with all columns to target (a folder, or an archive by its ending); gives the manifest.

    sql: INSERT statements as text beside the tables, in the order of their references; compression: of the text, as
    Spark names it (gzip), none by default. Statements are made of the tables as written, so no text is joined twice.
    """
    rows = tables_of(store.tables(), names)
    m = manifest(rows)
    # Executors write to the target itself or, for an archive, to the store's own file system, which they share.
    folder = store.files.at("scratch", uuid.uuid4().hex) if _is_archive(target) else target
    files = Files(store.spark, folder)
    for name, df in rows.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(files.at(name))
        if sql:
            content, rows_of = name in ("file_blobs", "chunk_contents"), store.spark.read.schema(df.schema).parquet(files.at(name))
            rows_of.select(insert_text(name, dict(df.dtypes), content)).write.mode("overwrite").option("maxRecordsPerFile", STATEMENTS).text(files.at("sql", name), compression=compression)
    files.delete(files.at("manifest.json"))
    files.create(files.at("manifest.json"), json.dumps(m, indent=2))
    if _is_archive(target):
        pack(files, folder, target)
        files.delete(folder)
    return m


def listed(target: str, spark: SparkSession | None = None) -> list[str]:
    """Names of the sources in an export, a folder or an archive, on any file system that the session reads."""
    files = Files(spark or SparkSession.getActiveSession(), target)
    if not _is_archive(target):
        return [s["name"] for s in checked(json.loads(files.read(files.at("manifest.json"))))["sources"]]
    with tempfile.TemporaryDirectory(prefix="lodeseek-list-") as here:
        files.fetch(target, os.path.join(here, "archive"))
        with tarfile.open(os.path.join(here, "archive")) as t:
            return [s["name"] for s in checked(json.load(t.extractfile("manifest.json")))["sources"]]


def import_(store: Store, target: str, on_conflict: str = "skip", remap: tuple[str, str] | None = None, names: list[str] | None = None) -> tuple[list[str], list[str], list[str]]:
    """Puts an export's sources into the store; gives (imported, skipped, warnings).

    on_conflict: `skip` leaves sources that are there, `force` replaces them, `fail` raises. remap replaces a part of
    the sources' paths. All tables change in one commit.
    """
    unpacked = store.files.at("scratch", uuid.uuid4().hex) if _is_archive(target) else None
    folder = unpack(store.files, target, unpacked) if unpacked else target
    try:
        listing = Files(store.spark, folder)
        wanted = [s["name"] for s in checked(json.loads(listing.read(listing.at("manifest.json"))))["sources"] if names is None or s["name"] in names]
        tables = store.tables()
        there = {r.name for r in tables["sources"].where(F.col("name").isin(*wanted)).select("name").collect()} if wanted else set()
        if there and on_conflict == "fail":
            raise ValueError(f"already there: {', '.join(sorted(there))}")
        skipped = sorted(there) if on_conflict == "skip" else []
        todo = [n for n in wanted if n not in skipped]
        if not todo:
            return [], skipped, []
        new = tables_of({n: store.spark.read.schema(s).parquet(f"{folder.rstrip('/')}/{n}") for n, s in TABLES.items()}, todo)
        if remap:
            new["sources"] = new["sources"].withColumn("path", F.replace("path", F.lit(remap[0]), F.lit(remap[1])))
        change = store.change()
        for n in there if on_conflict == "force" else ():
            of_view = joins.views_of_source(tables, n).select(F.col("id").alias("source_view_id"))
            for name in ("indexed_files", "chunks"):
                change.remove(name, of_view)
            tables = maintenance.delete_source(tables, n)
        for name in ("sources", "source_views"):
            change.replace(name, tables[name].unionByName(new[name]))
        for name in ("indexed_files", "chunks"):
            change.add(name, new[name])
        for name in ("file_blobs", "chunk_contents"):
            rows = change.add(name, new[name].dropDuplicates(["content_hash"]).join(tables[name].select("content_hash"), "content_hash", "left_anti"))
        change.add("postings", postings(rows), in_runs=True)  # of the chunk contents
        change.commit()
        paths = [r.path for r in store.table("sources").where(F.col("name").isin(*todo)).select("path").collect()]
        return todo, skipped, [f"path not found: {p}" for p in paths if p and not os.path.exists(p)]
    finally:
        if unpacked:
            store.files.delete(unpacked)
