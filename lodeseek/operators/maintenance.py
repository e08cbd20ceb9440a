"""Upserts, inserts if absent, deletes, updates, cascades and garbage collection as DataFrame rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import orphans


def _same(keys: list[str], a: str = "old", b: str = "new"):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """old with the rows of new put in by a null-safe key; what is in keep stays as it was where the key existed."""
    n, o = new.alias("new"), old.alias("old")
    columns = [F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")).alias(c) if c in keep else F.col(f"new.{c}").alias(c) for c in old.columns]
    put = n.join(o, _same(keys), "left").select(*columns)
    return o.join(n, _same(keys), "left_anti").select(*[F.col(f"old.{c}") for c in old.columns]).unionByName(put)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and those rows of new, one a key, whose key isn't there."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*old.columns))


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """rows without those that match a row of gone."""
    return rows.alias("old").join(gone.select(*on).alias("new"), _same(on), "left_anti")


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns taken from changes where the key is there; all columns of a change go together."""
    c = changes.select(F.col(key).alias("_key"), *[F.col(x).alias("_" + x) for x in columns], F.lit(True).alias("_hit"))
    j = rows.join(c, F.col(key) == F.col("_key"), "left")
    return j.select(*[F.when(F.col("_hit"), F.col("_" + x)).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in rows.columns])


def delete_views(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """tables without the views in gone (id) and what hangs on them; a source whose active view goes has none."""
    ids = gone.select("id")
    of_view = ids.select(F.col("id").alias("source_view_id"))
    s = tables["sources"].join(ids.select(F.col("id").alias("active_view_id"), F.lit(True).alias("_gone")), "active_view_id", "left")
    active = F.when(F.col("_gone").isNull(), F.col("active_view_id"))
    return tables | {
        "sources": s.withColumn("active_view_id", active).select(*tables["sources"].columns),
        "source_views": without(tables["source_views"], ids, ["id"]),
        "indexed_files": without(tables["indexed_files"], of_view, ["source_view_id"]),
        "chunks": without(tables["chunks"], of_view, ["source_view_id"]),
    }


def delete_source(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """tables without a source, its views, files and chunks; contents and blobs stay until collected."""
    s = tables["sources"].where(F.col("name") == name)
    views = tables["source_views"].join(s.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    out = delete_views(tables, views)
    return out | {"sources": out["sources"].where(F.col("name") != name)}


def stale_branches(views: DataFrame, source_id: str, live: list[str]) -> DataFrame:
    """Branch views of a source whose branch is not live; with no live branch, all of them. Other kinds are never stale."""
    mine = views.where((F.col("source_id") == source_id) & (F.col("view_kind") == "branch"))
    return mine.where(~F.col("ref_name").isin(*live)) if live else mine


def collected(tables: dict[str, DataFrame], as_of: str, grace_minutes: int = 60) -> dict[str, DataFrame]:
    """tables without contents, then blobs, that nothing uses and that are older than the grace time."""
    contents = orphans(tables["chunk_contents"], tables["chunks"], "content_hash", "chunk_content_hash", as_of, grace_minutes)
    blobs = orphans(tables["file_blobs"], tables["indexed_files"], "content_hash", "content_hash", as_of, grace_minutes)
    return tables | {"chunk_contents": without(tables["chunk_contents"], contents, ["content_hash"]), "file_blobs": without(tables["file_blobs"], blobs, ["content_hash"])}
