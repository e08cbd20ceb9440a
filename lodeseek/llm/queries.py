"""One query for each operator, over its whole table; the SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, licences, mixing, near_dedup, negatives, quality, repeats, secrets, sharding, tokens, urls, warc
from .common import table


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op2_secret_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"))


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"), docs["doc_id"])
    return found.selectExpr("row as doc_id", "n_words", "n_hit", "n_items", "items_sha256", "n_hit > 0 as contaminated")


def op8_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(table(spark, sf_dir, "documents"))


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_distribution_divergence, op2_secret_grammars, op3_huffman_tokens, op4_stratified_shards, op5_minhash_near_dedup,
        op6_source_mixing, op7_fm_decontamination, op8_url_language_models, op9_warc, op10_license_digests, op11_repeated_passages, op12_token_alignment, op13_hard_negatives,
    )
}
SQL: dict[str, str] = {"op6_source_mixing": mixing.SQL, "op9_warc": warc.SQL, "op10_license_digests": licences.sql()}
