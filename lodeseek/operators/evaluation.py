"""Golden sets and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .aggregates import first_hits, retrieval_metrics

VERSION = 2
EXPECTED = "query_id int, category string, path string, lo int, hi int"


def validated(golden: dict) -> list[dict]:
    """The queries of a golden set, or ValueError naming the first thing that is wrong."""
    if golden.get("version") != VERSION:
        raise ValueError(f"version must be {VERSION}")
    if not golden.get("source") or not isinstance(golden.get("queries"), list) or not golden["queries"]:
        raise ValueError("a golden set has a source and queries")
    for i, q in enumerate(golden["queries"]):
        if not str(q.get("query") or "").strip() or not q.get("category"):
            raise ValueError(f"query {i} has no text or category")
        if not 1 <= len(q.get("expected") or []) <= 3:
            raise ValueError(f"query {i} has {len(q.get('expected') or [])} expectations, not 1 to 3")
        for e in q["expected"]:
            a, b = e.get("startLine"), e.get("endLine")
            if not e.get("path") or any(x is not None and (not isinstance(x, int) or x < 1) for x in (a, b)) or (a and b and a > b):
                raise ValueError(f"query {i} has a wrong expectation")
    return golden["queries"]


def expectations(spark: SparkSession, queries: list[dict]) -> DataFrame:
    rows = [(i, q["category"], e["path"], e.get("startLine"), e.get("endLine")) for i, q in enumerate(queries) for e in q["expected"]]
    return spark.createDataFrame(rows, EXPECTED)


def evaluated(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Metrics per category and overall of results (query_id, path, start_line, end_line, rank)."""
    return retrieval_metrics(first_hits(results, expected))


def compared(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """Both runs' metrics side by side, and the differences."""
    names = [c for c in baseline.columns if c not in ("category", "n")]
    b = baseline.select("category", *[F.col(c).alias(f"baseline_{c}") for c in names])
    t = treatment.select("category", *[F.col(c).alias(f"treatment_{c}") for c in names])
    return b.join(t, "category", "full_outer").select("*", *[F.round(F.col(f"treatment_{c}") - F.col(f"baseline_{c}"), 6).alias(f"delta_{c}") for c in names])
