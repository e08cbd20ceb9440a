"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs.
All stages but the last keep the columns of docs, whatever their names; an empty table stays one; texts of any length
are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeseek.llm import decontaminate, mixing, near_dedup, quality, tokens
from lodeseek.llm.common import delete, fresh_path, ready, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each judged by itself.

    Null, empty and short texts go (fewer than 10 words); repeated rows are judged alike; a null language is a language.
    """
    return quality.passed(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Null and wordless texts, and rows without an id, are in no group and stay; all rows of an id stay or go together, so
    exact repetitions of a row with the same id stay; equal texts of several ids tie by id.
    """
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark, each judged by itself: repeated rows alike.

    Null and wordless texts have no passage and stay; null and wordless items have none to find.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once or twice.

    A null source is a source; null and wordless texts weigh nothing and are taken like others; rows of equal id draw
    the same number, so repeated rows are taken equally often; reruns agree.
    """
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its place and checksum in the token files: doc_id, start, n_tokens, ids_crc32.

    Rows are written by ascending doc_id, those without one first, copies of equal id after each other by their ids; a
    null text is its end id alone.
    """
    return tokens.round_trip(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup_stage), ("decontamination", decontamination), ("mixing", source_mixing), ("token_ids", token_ids)]
#: Byte-pair encoding and Jensen-Shannon references can't be written in DuckDB's SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has read is deleted once the next has been written."""
    ready(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
