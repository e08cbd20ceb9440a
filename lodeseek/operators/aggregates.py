"""Counts, status, coverage, manifests, retrieval metrics, dry-run costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

COVERAGE, CHARS_PER_TOKEN = 95.0, 4


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def file_counts(indexed_files: DataFrame, views: DataFrame, key: str = "ref_name") -> DataFrame:
    """(key, files) of the views (id, key)."""
    of = views.select(F.col("id").alias("source_view_id"), key)
    return indexed_files.select("id", "source_view_id").join(of, "source_view_id").groupBy(key).agg(F.countDistinct("id").alias("files"))


def list_sources(sources: DataFrame, kind: str | None = None, prefix: str | None = None, n: int | None = None) -> DataFrame:
    """Sources by name, optionally of a type, below a path, and at most n."""
    if kind:
        sources = sources.where(F.col("type") == kind)
    if prefix:
        sources = sources.where(F.col("path").startswith(prefix))
    out = sources.orderBy("name")
    return out if n is None else out.limit(n)


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: table sizes, embedded contents, bytes of blobs, time of the last indexing. Each table is read once, to one row."""
    parts = [
        tables["sources"].agg(F.count("*").alias("sources")),
        tables["source_views"].agg(F.count("*").alias("views")),
        tables["indexed_files"].agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed_at")),
        tables["chunks"].agg(F.count("*").alias("chunks")),
        tables["chunk_contents"].agg(F.count("*").alias("contents"), F.count_if(F.col("embedding").isNotNull()).alias("embedded")),
        tables["file_blobs"].agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("blob_bytes")),
    ]
    row = reduce(lambda a, b: a.join(b.withColumn("_one", F.lit(1)), "_one"), parts[1:], parts[0].withColumn("_one", F.lit(1)))
    return row.select("sources", "views", "files", "chunks", "contents", "embedded", "blob_bytes", "last_indexed_at")


def coverage(tables: dict[str, DataFrame], views: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """Per source of the views: chunks, chunks with an embedding, percent (0 if there is none), and whether that is enough."""
    c = tables["chunks"].select("chunk_content_hash", "source_view_id").join(views.select(F.col("id").alias("source_view_id"), "source_id"), "source_view_id")
    k = tables["chunk_contents"].select(F.col("content_hash").alias("chunk_content_hash"), F.col("embedding").isNotNull().alias("has"))
    out = c.join(k, "chunk_content_hash").groupBy("source_id").agg(F.count("*").alias("total"), F.count_if("has").alias("covered"))
    percent = F.round(F.coalesce(F.try_divide(100.0 * F.col("covered"), F.col("total")), F.lit(0.0)), 6)
    return out.select("source_id", "total", "covered", percent.alias("percent"), (percent >= threshold).alias("ok"))


def manifest_hash(files: DataFrame, *keys: str) -> DataFrame:
    """(keys.., manifest): SHA-256 of the hashes of 256 buckets of paths, in order; a bucket's is that of its lines
    `path TAB hash` in binary order of path. So no task holds all paths of a view.
    """
    lines = F.transform(F.sort_array(F.collect_list(F.struct("path", "content_hash"))), lambda x: F.concat_ws("\t", x["path"], x["content_hash"]))
    parts = files.groupBy(*keys, F.substring(F.sha2("path", 256), 1, 2).alias("bucket")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("part"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "part"))), lambda x: F.concat(x["bucket"], x["part"]))
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("manifest"))


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """Recall at 5 and 10 and mean reciprocal rank, per category and overall (`all`), in one pass; rank is null for a miss."""
    within = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    rows = ranks.rollup("category").agg(F.count("*").alias("n"), within(5), within(10), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.grouping("category").alias("g"))
    return rows.where("n > 0").select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "n", "recall_5", "recall_10", "mrr")


def first_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, category, rank): the best rank of a result (query_id, path, start_line, end_line, rank) that overlaps an expectation (query_id, category, path, lo, hi)."""
    from .joins import overlaps

    e = expected.select("query_id", "category", F.col("path").alias("p"), "lo", "hi")
    r = results.select(F.col("query_id").alias("q"), scalar.normal_path(F.col("path")).alias("path"), "start_line", "end_line", "rank")
    on = (F.col("query_id") == F.col("q")) & (scalar.normal_path(F.col("p")) == F.col("path")) & overlaps(F.col("start_line"), F.col("end_line"), F.col("lo"), F.col("hi"))
    return e.join(r, on, "left").groupBy("query_id", "category").agg(F.min("rank").alias("rank"))


def dry_run(open_contents: DataFrame, sample: int, input_price: float = 0.0, output_price: float = 0.0, output_tokens: int = 300) -> DataFrame:
    """One row: sample size, skipped in it, their share, all contents, how many are expected to be summarised, and what that takes.

    Tokens are a quarter of the characters; prices are those of a million tokens.
    """
    head = open_contents.select("content_hash", "content").orderBy("content_hash").limit(sample)
    s = head.agg(F.count("*").cast("double").alias("sample"), F.count_if(scalar.gate(F.col("content"), F.lit("text")).isNotNull()).cast("double").alias("skipped")).withColumn("_one", F.lit(1))
    t = open_contents.agg(F.count("*").alias("total"), F.coalesce(F.avg(F.length("content")), F.lit(0.0)).alias("mean")).withColumn("_one", F.lit(1))
    rate = F.coalesce(F.try_divide("skipped", "sample"), F.lit(0.0))
    row = s.join(t, "_one").select("sample", "skipped", F.round(rate, 6).alias("skip_rate"), "total", F.floor(F.col("total") * (1 - rate) + 0.5).cast("long").alias("expected"), "mean")
    row = row.select("*", F.floor(F.col("expected") * F.col("mean") / CHARS_PER_TOKEN + 0.5).cast("long").alias("input_tokens"), (F.col("expected") * output_tokens).cast("long").alias("output_tokens"))
    cost = F.col("input_tokens") / 1e6 * input_price + F.col("output_tokens") / 1e6 * output_price
    return row.drop("mean").withColumn("cost", F.round(cost, 9))

