"""Indexing a view: what a scan changes in the six tables, as one plan of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector
from ..sources.providers import in_order
from . import changes, chunking
from .joins import chunkless

METADATA = {"fqn": "fqn", "fragment_type": "fragmentType", "fragment_subtype": "fragmentSubtype", "receiver_type": "receiverType", "header_level": "headerLevel", "start_offset": "startOffset", "end_offset": "endOffset"}


class Embedder(Protocol):
    """Adds a vector for a text column; null where a text could not be embedded."""

    dimensions: int

    def embed(self, rows: DataFrame, text_col: str, out: str) -> DataFrame: ...


class HashEmbedder:
    """Deterministic vectors from SHA-256, made by built-in functions."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, rows: DataFrame, text_col: str, out: str) -> DataFrame:
        return rows.withColumn(out, vector.hash_vector_column(F.col(text_col), self.dimensions))

    def query(self, text: str) -> list[float]:
        return vector.query_vector(text, self.dimensions)


class BatchEmbedder:
    """Calls embed_many(texts) for batches of a bounded size; one retry a batch, else its vectors stay null.

    A task has at_once calls in flight at most, and their vectors in the texts' order. Only failures of the provider
    (RuntimeError, OSError) defer a batch, and that batch alone; other errors are programming errors and end the job.
    """

    def __init__(self, embed_many, dimensions: int, batch: int = 32, embed_queries=None, at_once: int = 3):
        self.embed_many, self.dimensions, self.batch, self.embed_queries, self.at_once = embed_many, dimensions, batch, embed_queries or embed_many, at_once

    def query(self, text: str) -> list[float]:
        return [float(x) for x in self.embed_queries([text])[0]]

    def embed(self, rows: DataFrame, text_col: str, out: str) -> DataFrame:
        embed_many, size, at_once = self.embed_many, self.batch, self.at_once

        def one(part: list[str]) -> list:
            for attempt in (1, 2):
                try:
                    return list(embed_many(part))
                except (RuntimeError, OSError):
                    if attempt == 2:
                        return [None] * len(part)

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            parts = [texts.iloc[i : i + size].tolist() for i in range(0, len(texts), size)]
            return pd.Series([v for made in in_order(one, parts, at_once) for v in made])

        return rows.withColumn(out, run(F.col(text_col)))


def identity(*parts: str) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def metadata() -> Column:
    """The chunk's further fields as JSON, without those that are null."""
    return F.to_json(F.struct(*[F.col(c).alias(n) for c, n in METADATA.items()]))


@dataclass
class Indexed:
    """New rows by table, the paths whose rows go, and the counters of the run."""

    files: DataFrame
    blobs: DataFrame
    contents: DataFrame
    chunks: DataFrame
    gone: DataFrame
    status: DataFrame


def index_view(scanned: DataFrame, view_id: str, tables: dict[str, DataFrame], embedder: Embedder, as_of: Column, paths: DataFrame | None = None, max_tokens: int = chunking.MAX_TOKENS, overlap: int = chunking.OVERLAP, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> Indexed:
    """What indexing (path, content) as a view changes.

    Only added and modified files are chunked, and only contents that no view has had are embedded: both are cut by
    anti joins before the work. paths limits the comparison to named paths. settle: writes what is used more than
    once (statuses, touched files, chunks), so it isn't made again.
    """
    scan = scanned.select("path", "content", F.sha2("content", 256).alias("content_hash"))
    old = tables["indexed_files"].where(F.col("source_view_id") == view_id).select("path", "content_hash")
    keys = scan.select("path", "content_hash")
    status = changes.compare(keys, old) if paths is None else changes.compare_paths(paths, keys, old)
    status = settle(status)
    touched = settle(scan.join(status.where("status in ('added', 'modified')").select("path"), "path", "left_semi"))
    view = F.lit(view_id)
    new_files = touched.select(identity(view, "path").alias("id"), view.alias("source_view_id"), "path", "content_hash", as_of.alias("indexed_at"))
    blobs = touched.select("content_hash", "content", F.octet_length("content").cast("long").alias("byte_size"), as_of.alias("created_at")).dropDuplicates(["content_hash"])
    blobs = blobs.join(tables["file_blobs"].select("content_hash"), "content_hash", "left_anti")
    made = settle(chunking.chunked(touched, max_tokens=max_tokens, overlap=overlap).withColumn("chunk_content_hash", F.sha2("content", 256)))
    contents = made.select(F.col("chunk_content_hash").alias("content_hash"), "content").dropDuplicates(["content_hash"])
    contents = contents.join(tables["chunk_contents"].select("content_hash"), "content_hash", "left_anti")
    contents = embedder.embed(contents, "content", "embedding").withColumns({"summary": F.lit(None).cast("string"), "summary_embedding": F.lit(None).cast("array<float>"), "created_at": as_of})
    chunks = made.select(
        identity(identity(view, "path"), F.col("ordinal").cast("string")).alias("id"), view.alias("source_view_id"), identity(view, "path").alias("indexed_file_id"), "chunk_content_hash", "path", "source_type",
        "start_line", "end_line", "header_path", "language", "ordinal", metadata().alias("metadata"), as_of.alias("created_at"),
    )
    return Indexed(new_files, blobs, contents, chunks, status.where("status in ('modified', 'deleted')").select("path"), status)


def repaired(indexed_files: DataFrame, chunks: DataFrame, blobs: DataFrame, max_tokens: int = chunking.MAX_TOKENS, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Chunks of files that have none, made from their blobs, with n_chunks of the file."""
    lost = chunkless(indexed_files, chunks).join(blobs.select("content_hash", "content"), "content_hash")
    made = chunking.chunked(lost, carry=("id", "source_view_id", "content_hash"), max_tokens=max_tokens, overlap=overlap)
    from pyspark.sql import Window

    return made.withColumn("n_chunks", F.count("*").over(Window.partitionBy("id")))


def counters(status: DataFrame, deferred: int = 0, repaired: int = 0) -> dict[str, int]:
    """Files by what happened to them, in one pass."""
    found = {r.status: r.n for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return {"new": found.get("added", 0) + found.get("modified", 0), "deleted": found.get("deleted", 0), "unchanged": found.get("unchanged", 0), "deferred": deferred, "repaired": repaired}
