"""Directories as DataFrames of text files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import MAX_BYTES, included, keeps, visible


def _lines(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read().splitlines()
    except OSError:
        return []


def scan(spark: SparkSession, base: str, include: list[str] | None = None, exclude: list[str] | None = None, ownignore: str = ".lodeseekignore") -> tuple[DataFrame, DataFrame]:
    """(files, excluded) below a folder: files (path, content) and excluded (path), both lazy.

    Spark lists and reads the files; names are filtered before contents are read (the binary source prunes its
    content column), files over MAX_BYTES are excluded, bytes that aren't UTF-8 are replaced.
    """
    root = os.path.realpath(os.path.expanduser(base)) if "://" not in base else base
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    raw = raw.withColumn("name", F.expr(f"substring(path, instr(path, {_quoted(root.split('://')[-1])}) + {len(root.split('://')[-1]) + 1})"))
    raw = raw.where(visible(F.col("name")) & included(F.col("name"), include or []))
    ok = keeps(F.col("name"), _lines(os.path.join(root, ".gitignore")), _lines(os.path.join(root, ownignore)), exclude or []) & (F.col("length") <= MAX_BYTES)
    files = raw.where(ok).select(F.col("name").alias("path"), F.decode("content", "UTF-8").alias("content"))
    return files, raw.where(~ok).select(F.col("name").alias("path"))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_documents(documents: DataFrame) -> DataFrame:
    """(path, content) of a table of documents, for corpora that already are tables."""
    return documents.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
