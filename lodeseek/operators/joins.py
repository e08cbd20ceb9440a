"""Relational operators of reads and clean-up: scope, hydration, anti joins, candidates, pages, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_views(rows: DataFrame, views: DataFrame, column: str = "source_view_id") -> DataFrame:
    """Rows whose view is among views (id)."""
    return rows.join(views.select(F.col("id").alias(column)), column, "left_semi")


def keyset_page(rows: DataFrame, key: str, after: str | None, n: int) -> DataFrame:
    """The n rows that follow a key, in its order; from the first if after is None."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(n)


def older_than(column: str, as_of: str, minutes: int) -> Column:
    return F.col(column) < F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(mins=F.lit(minutes))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """[start, end] meets [low, high]; a missing bound is open."""
    return F.coalesce(start <= high, F.lit(True)) & F.coalesce(end >= low, F.lit(True))


def range_join(expected: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """expected (key, lo, hi) with the rows (key, start_line, end_line) that overlap it: an equal join on the key, the range as the rest."""
    e = expected.select(F.col(key).alias("k"), *[c for c in expected.columns if c != key])
    return e.join(rows, (F.col("k") == F.col(key)) & overlaps(F.col("start_line"), F.col("end_line"), F.col("lo"), F.col("hi"))).drop("k")


def hydrate(wanted: DataFrame, chunks: DataFrame, contents: DataFrame, views: DataFrame) -> DataFrame:
    """wanted (id, pos) with occurrence, content and view; order by pos restores the order asked for."""
    rows = wanted.join(chunks, "id").join(contents.select(F.col("content_hash").alias("chunk_content_hash"), "content"), "chunk_content_hash")
    return rows.join(views.select(F.col("id").alias("source_view_id"), "source_id", "view_kind", "ref_name"), "source_view_id")


def chunkless(indexed_files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files without a chunk."""
    return indexed_files.join(chunks.select(F.col("indexed_file_id").alias("id")), "id", "left_anti")


def orphans(rows: DataFrame, uses: DataFrame, key: str, used_key: str, as_of: str, grace_minutes: int) -> DataFrame:
    """Rows that nothing uses and that are older than the grace time."""
    old = rows.where(older_than("created_at", as_of, grace_minutes))
    return old.join(uses.select(F.col(used_key).alias(key)), key, "left_anti")


def summary_candidates(tables: dict[str, DataFrame], views: DataFrame, n: int | None = None) -> DataFrame:
    """Contents in the views that have no summary, each with its occurrence of the smallest id; with n the first n by hash, in order."""
    open_ = tables["chunk_contents"].where("summary is null").select("content_hash", "content")
    c = in_views(tables["chunks"], views).join(tables["indexed_files"].select(F.col("id").alias("indexed_file_id")), "indexed_file_id", "left_semi")
    keep = [x for x in ("id", "path", "source_type", "language", "metadata") if x in c.columns]
    first = c.groupBy(F.col("chunk_content_hash").alias("content_hash")).agg(F.min_by(F.struct(*keep), "id").alias("o")).select("content_hash", "o.*")
    out = open_.join(first, "content_hash")
    return out if n is None else out.orderBy("content_hash").limit(n)


def default_views(sources: DataFrame, views: DataFrame) -> DataFrame:
    return sources.select("name", F.col("active_view_id").alias("id")).join(views, "id")


def branch_views(sources: DataFrame, views: DataFrame, ref: str) -> DataFrame:
    """Each source's view of a branch."""
    mine = views.where((F.col("view_kind") == "branch") & (F.col("ref_name") == ref))
    return mine.join(sources.select(F.col("id").alias("source_id"), "name"), "source_id")


def views_of_source(tables: dict[str, DataFrame], name: str) -> DataFrame:
    s = tables["sources"].where(F.col("name") == name).select(F.col("id").alias("source_id"))
    return tables["source_views"].join(s, "source_id", "left_semi")


def blobs_of_source(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """File blobs of a source; the semi join needs no DISTINCT."""
    f = in_views(tables["indexed_files"], views_of_source(tables, name))
    return tables["file_blobs"].join(f.select("content_hash"), "content_hash", "left_semi")


def contents_of_source(tables: dict[str, DataFrame], name: str) -> DataFrame:
    c = in_views(tables["chunks"], views_of_source(tables, name))
    return tables["chunk_contents"].join(c.select(F.col("chunk_content_hash").alias("content_hash")), "content_hash", "left_semi")


def reembed_selection(tables: dict[str, DataFrame], views: DataFrame | None = None, source_type: str | None = None, path_prefix: str | None = None, force: bool = False) -> DataFrame:
    """(content_hash, path) of contents to embed again, each with its first path among the chunks that the filters leave.

    Contents without a vector, or with force all.
    """
    k = tables["chunk_contents"] if force else tables["chunk_contents"].where("embedding is null")
    c = tables["chunks"] if views is None else in_views(tables["chunks"], views)
    if source_type is not None:
        c = c.where(F.col("source_type") == source_type)
    if path_prefix:
        c = c.where(F.col("path").startswith(path_prefix))
    first = c.groupBy(F.col("chunk_content_hash").alias("content_hash")).agg(F.min("path").alias("path"))
    return k.select("content_hash").join(first, "content_hash")


def first_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
