"""Mixing sources to target weights, with built-in functions only.

Tokens are summed for each source; sources in code-point order (null last) take the weights in turn; a share of
all tokens is dealt by weight, but no source takes more than `cap` times its own tokens, and what is over goes to
the others by weight. That level is found in one ordered pass over the sources: in order of cap / weight, a source
is full if the level that is left for it and those behind it reaches its cap (running sums by ranges, so no task holds
all sources). A document's copies are
floor(rate) and one more if a number in [0, 1), hashed from seed and id, lies below the rate's fraction.

Null or blank texts count 0 and are taken like the others (their copies weigh nothing); a null source is a source;
rows of equal id draw the same number, so reruns and repeated rows agree; equal caps are taken in the order of sources;
texts of any length count all their words; an empty table gives an empty one. The
table of sources has a row for each source only; it is broadcast up to BROADCAST_ROWS rows and shuffled beyond.
Other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, n_words_of, running, small, spare, unit, written

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, 17


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size)."""
    by_name = F.col("source").asc_nulls_last()
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    t = running(t, [by_name], {"place": "one"}, "sources")
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    t = t.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("fill", F.col("most") / F.col("weight"))
    t = written(running(t, [F.col("fill"), by_name], {"most_before": "most", "weight_before": "weight"}, "fills"), "levels")
    whole = t.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(share) * (whole["size"] or 0)) - F.col("most_before")) / (F.lit(whole["weight"] or 0.0) - F.col("weight_before"))
    t = t.withColumn("level", level)
    final = t.where("level < fill").agg(F.min(F.struct("fill", F.col("source").isNull().alias("last"), "source", "level"))["level"]).first()[0]
    target = F.col("most") if final is None else F.least("most", F.lit(final) * F.col("weight"))
    return t.select("source", "source_size", target.alias("target")).withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> tuple[DataFrame, dict[str, Column]]:
    """docs joined with their source's plan, and columns size, source_size, target, copies over it."""
    s, n, t, r = spare(docs, "mix_source", "mix_size", "mix_target", "mix_rate")
    plan = written(targets(docs.select(col(source_col).alias("source"), n_words_of(col(text_col)).alias("size")), weights, share, cap), "targets")
    plan = plan.toDF(s, n, t, r)
    rows = docs.join(small(plan), col(source_col).eqNullSafe(F.col(s)))
    whole = F.floor(r)
    draw = unit(F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit(""))))
    copies = whole + F.when(draw < F.col(r) - whole, 1).otherwise(0)
    return rows, {"size": n_words_of(col(text_col)), "source_size": F.col(n), "target": F.col(t), "copies": copies.cast("long")}


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, size, source_size, target, taken) for each row."""
    rows, c = planned(docs, id_col, **options)
    rows = rows.select(col(id_col), c["size"].alias("size"), c["source_size"].alias("source_size"), c["target"].alias("target"), c["copies"].alias("copies"))
    return rows.select(id_col, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix: each row of docs as often as it is taken; the columns of docs."""
    rows, c = planned(docs, id_col, **options)
    (k,) = spare(rows, "mix_copy")
    return rows.where(c["copies"] > 0).withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), c["copies"]))).select(*[col(x) for x in docs.columns])


#: DuckDB's form of report() over `documents`.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM d GROUP BY source
), f AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS fill FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level,
    row_number() OVER (ORDER BY fill, source NULLS LAST) AS place
  FROM f WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(most, coalesce((SELECT level FROM l WHERE level < fill ORDER BY place LIMIT 1) * weight, most)) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
    ('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
