"""Summaries of contents: gates, a model behind a protocol, one write."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from .indexing import Embedder
from .joins import summary_candidates


class Summarizer(Protocol):
    """Adds `summary` (null on failure) and `reason` to rows (path, kind, content, fqn, language)."""

    def summarize(self, rows: DataFrame) -> DataFrame: ...


class MockSummarizer:
    """Deterministic, by built-in functions."""

    def summarize(self, rows: DataFrame) -> DataFrame:
        made = scalar.mock_summary(F.col("path"), F.col("kind"), F.col("content"), F.col("fqn"))
        return rows.withColumns({"summary": made, "reason": F.when(made.isNull(), F.lit("empty content"))})


class PromptSummarizer:
    """Calls complete(prompts) for batches of prompts; it gives a text, or None, for each."""

    def __init__(self, complete, batch: int = 16):
        self.complete, self.batch = complete, batch

    def summarize(self, rows: DataFrame) -> DataFrame:
        complete, size = self.complete, self.batch

        @F.pandas_udf("string")
        def run(prompts: pd.Series) -> pd.Series:
            out: list = []
            for i in range(0, len(prompts), size):
                part = prompts.iloc[i : i + size].tolist()
                try:
                    out += list(complete(part))
                except Exception:  # noqa: BLE001  a model's failure leaves a placeholder
                    out += [None] * len(part)
            return pd.Series(out, dtype=object)

        prompt = scalar.prompt(F.col("path"), F.col("kind"), F.col("content"), F.col("fqn"), F.col("language"))
        return rows.withColumn("summary", F.trim(run(prompt))).withColumn("reason", F.when(F.col("summary").isNull(), F.lit("no answer")))


def inputs(tables: dict[str, DataFrame], views: DataFrame, n: int | None = None) -> DataFrame:
    """(content_hash, content, path, kind, fqn, language) of contents without a summary."""
    c = summary_candidates(tables, views, n)
    return c.select("content_hash", "content", "path", scalar.kind(F.col("metadata"), F.col("source_type")).alias("kind"), F.get_json_object("metadata", "$.fqn").alias("fqn"), "language")


def summarized(rows: DataFrame, summarizer: Summarizer, embedder: Embedder) -> DataFrame:
    """(content_hash, summary, summary_embedding) of inputs: placeholders where a gate or the model says no, without a vector."""
    gated = rows.withColumn("skip", scalar.gate(F.col("content"), F.col("kind")))
    held = gated.where("skip is not null").select("content_hash", scalar.skipped(F.col("skip")).alias("summary"), F.lit(None).cast("array<float>").alias("summary_embedding"))
    asked = summarizer.summarize(gated.where("skip is null").drop("skip"))
    made = embedder.embed(asked, "summary", "summary_embedding")
    text = F.coalesce("summary", scalar.failed(F.coalesce("reason", F.lit("unknown"))))
    made = made.select("content_hash", text.alias("summary"), F.when(F.col("summary").isNotNull(), F.col("summary_embedding")).alias("summary_embedding"))
    return held.unionByName(made)
