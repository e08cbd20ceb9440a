"""Tokens, query terms, full-text match and rank as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rank: default weight, normaliser of one term, positions kept a lexeme.
WEIGHT, ONE_TERM, POSITIONS = 0.1, 1.64493406685, 256


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; no stop words, no stemming."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_terms(query: str, unicode_clean: bool = False) -> list[str]:
    """Distinct lower-cased terms of a query: white space splits, other characters are stripped, empties go.

    The plain form keeps ASCII and Cyrillic letters, digits and `_`; unicode_clean keeps all letters and digits.
    """
    drop = r"[^\w]" if unicode_clean else r"[^a-zA-Z0-9а-яА-ЯёЁ_]"
    cleaned = (re.sub(drop, "", t).lower() for t in query.split())
    return list(dict.fromkeys(t for t in cleaned if t))


def query_terms_column(query: Column) -> Column:
    """The plain form of query_terms for a column of queries."""
    parts = F.transform(F.split(query, r"\s+"), lambda t: F.lower(F.regexp_replace(t, "[^a-zA-Z0-9а-яА-ЯёЁ_]", "")))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def positions(toks: Column, term) -> Column:
    """The first positions (from 1) of a term among tokens."""
    at = F.transform(toks, lambda t, i: F.when(t == term, i + 1))
    return F.slice(F.filter(at, lambda p: p.isNotNull()), 1, POSITIONS)


def nearness(distance: int) -> float:
    """Weight of two positions' distance."""
    return 1e-30 if distance > 100 else 1 / (1.005 + 0.05 * math.exp(distance / 1.5 - 2))


def log_misses() -> Column:
    """log(1 - weight) for distances 0 to 100; beyond them it is 0 to within 1e-15."""
    return F.array(*[F.lit(math.log1p(-WEIGHT * math.sqrt(nearness(d)))) for d in range(101)])


def pair_misses(p: Column, q: Column, table: Column) -> Column:
    """Sum of log(1 - weight) over all pairs of positions."""
    return F.aggregate(p, F.lit(0.0), lambda m, a: F.aggregate(q, m, lambda n, b: n + F.coalesce(F.get(table, F.abs(a - b)), F.lit(0.0))))


def rank(term_positions: list[Column]) -> Column:
    """Rank of a text that holds all terms, from each term's positions; null if one is missing."""
    every = F.size(term_positions[0]) > 0
    for p in term_positions[1:]:
        every = every & (F.size(p) > 0)
    if len(term_positions) == 1:
        n = F.size(term_positions[0])
        total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, j: a + F.lit(1.0) / (j * j))
        return F.when(every, WEIGHT * total / ONE_TERM)
    miss, table = F.lit(0.0), log_misses()
    for k, p in enumerate(term_positions):
        for q in term_positions[k + 1 :]:
            miss = miss + pair_misses(p, q, table)
    return F.when(every, 1 - F.exp(miss))


def okapi_bm25(tf: Column, df: Column, n_docs: Column, length: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """The published Okapi term score; an extra, not part of the hybrid rank."""
    idf = F.ln(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))
