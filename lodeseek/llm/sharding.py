"""Proportional stratified interleaving into shards, with built-in functions only.

Rows are ranked by a seeded hash within their source; the fraction (rank + 1/2) / rows of the source orders all
rows; that order is cut into shards whose row counts differ by one at most, so every stretch of it, and every
shard, holds the sources in proportion (within one row a source).

No task sees a whole source or the whole order: ranks are counted in two steps, the rows of each cell of the
hash (or of the fraction) by a small table of counts, and the rows within the cell by a window. Cells hold about
ROWS_A_CELL rows at any size of the input. The cells' counts are summed up by ranges, so no task holds them all. Only
counts and narrow rows are shuffled, never texts.

Null texts count as empty; a null source is a source; rows alike in id, source and text share a hash and take
neighbouring ranks; equal fractions of several sources are ordered by source, equal draws by id, checksum and size; texts
of any length count by their bytes; an empty table gives an empty one. Further columns are kept by write_shards, whatever
their names, and left out of the report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, running, small, spare, written

SHARDS, SEED, ROWS_A_CELL = 8, 29, 8_192


def _bits(rows: int) -> int:
    return max(4, (rows // ROWS_A_CELL).bit_length())


def assigned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(id, source, size, text_crc32, shard, slot): size and text_crc32 as in the query, slot counts from 0 in a shard."""
    text = F.coalesce(col(text_col), F.lit(""))
    narrow = docs.select(col(id_col).alias("id"), col(source_col).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    narrow = narrow.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "source", "text_crc32"), 1))
    narrow = written(narrow, "narrow")
    total = narrow.count()
    cells = 1 << (bits := _bits(total))
    narrow = narrow.withColumn("cell", F.shiftright("draw", 63 - bits))

    counts = running(narrow.groupBy("source", "cell").agg(F.count("*").alias("n")), [F.col("source").asc_nulls_last(), F.col("cell")], {"passed": "n"}, "cells")
    counts = written(counts, "passed")
    of_source = small(written(counts.groupBy("source").agg(F.min("passed").alias("base"), F.sum("n").alias("of_source")), "of-source")).withColumnRenamed("source", "s")
    counts = counts.join(of_source, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("cell").alias("c"), (F.col("passed") - F.col("base")).alias("before"), "of_source")
    within = Window.partitionBy("source", "cell").orderBy("draw", "id", "text_crc32", "size")
    ranked = narrow.withColumn("k", F.row_number().over(within)).join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    fraction = (F.col("before") + F.col("k") - 0.5) / F.col("of_source")
    ranked = ranked.select("id", "source", "size", "text_crc32", "draw", fraction.alias("fraction"))
    ranked = written(ranked.withColumn("place", F.floor(F.col("fraction") * cells)), "ranked")

    places = running(ranked.groupBy("place").agg(F.count("*").alias("n")), [F.col("place")], {"before": "n"}, "places").select(F.col("place").alias("p"), "before")
    order = Window.partitionBy("place").orderBy("fraction", F.col("source").asc_nulls_last(), "draw", "id", "text_crc32", "size")
    out = ranked.withColumn("k", F.row_number().over(order)).join(places, F.col("place") == F.col("p"))
    out = out.select("id", "source", "size", "text_crc32", (F.col("before") + F.col("k") - 1).cast("long").alias("position"))
    shard = F.expr(f"(position * {shards}) div {max(total, 1)}").cast("int")
    out = out.withColumn("shard", shard)
    return out.select("id", "source", "size", "text_crc32", "shard", (F.col("position") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).cast("long").alias("slot"))


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for each row."""
    out = assigned(docs, id_col, **options)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> tuple[str, str]:
    """Writes docs as Parquet below path, a folder for each shard, rows sorted by slot within a file; gives the names of
    the two columns that are added: shard and slot, with `_` before a name that docs has.

    Rows are matched with their places by id, source and text checksum; rows alike in all of these are counted
    off against each other, so each takes one place.
    """
    shard, slot, i, s, n, c, k = spare(docs, "shard", "slot", "place_id", "place_source", "place_size", "place_crc32", "place_k")
    at = assigned(docs, id_col, text_col, source_col, **options).toDF(i, s, n, c, shard, slot)
    alike = Window.partitionBy(i, s, n, c).orderBy(shard, slot)
    at = at.withColumn(k, F.row_number().over(alike))
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.withColumns({i + "_of": col(id_col), s + "_of": col(source_col), n + "_of": (F.octet_length(text) + 1).cast("long"), c + "_of": F.crc32(F.encode(text, "UTF-8"))})
    rows = rows.withColumn(k + "_of", F.row_number().over(Window.partitionBy(i + "_of", s + "_of", n + "_of", c + "_of").orderBy(F.lit(0))))
    same = [F.col(x + "_of").eqNullSafe(F.col(x)) for x in (i, s, n, c, k)]
    out = rows.join(at, same[0] & same[1] & same[2] & same[3] & same[4]).select(*[col(x) for x in docs.columns], shard, slot)
    out.repartition(shard, F.floor(F.col(slot) / 100_000)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return shard, slot
