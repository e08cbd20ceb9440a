"""Shared helpers: intermediate tables in the shared folder, guarded broadcasts, name-safe columns."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: White space that separates words in every contract: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
#: Largest side, in rows and in bytes, that is sent to every executor. Beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20
#: A key of a join is hot with more rows than HOT_ROWS and than one in HOT_KEYS, so there are HOT_KEYS hot keys at most.
HOT_ROWS, HOT_KEYS = 10_000, 100_000


def ready(spark: SparkSession) -> SparkSession:
    """Sends the package to the workers and bounds the Arrow batches that they hold at a time, by rows and bytes."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        held = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < held <= most:
            spark.conf.set(key, str(most))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where unset in local mode (tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("lodeseek.own.checkpoint.dir", None)
        if not base:
            base = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="lodeseek-"))
            spark.conf.set("lodeseek.own.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lodeseek-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodeseek_path = path
    return out


def _bytes(name: str, kind: T.DataType) -> Column:
    """What a value takes: its bytes, and 16 for its place in a row."""
    c = col(name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, T.ArrayType):
        held = F.transform(c, lambda x: F.octet_length(x)) if isinstance(kind.elementType, (T.StringType, T.BinaryType)) else None
        size = F.size(c) * 8 + (F.aggregate(held, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) if held is not None else 0)
    else:
        size = F.lit(0)
    return (F.coalesce(size, F.lit(0)) + 16).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes, else as it is; df should be a written table."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(sum((_bytes(f.name, f.dataType) for f in df.schema), F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def hot_keys(key: str, rows: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame | None:
    """The hot keys of rows, HOT_KEYS at most; None if none is. Give rows, or counted (key, n); better a written table."""
    n = rows.groupBy(key).agg(F.count("*").alias("n")) if counted is None else counted
    total = rows.count() if counted is None else counted.agg(F.sum("n")).first()[0] or 0
    if total <= HOT_ROWS:
        return None
    hot = written(n.where(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select(key), "hot")
    return None if hot.isEmpty() else F.broadcast(hot)


def spread(n: Column, rows: int = 512) -> Column:
    """Over how many tasks a key's n rows are dealt."""
    return F.greatest(F.lit(1), F.ceil(n / rows)).cast("int")


def met(few: DataFrame, many: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
    """few and many joined on keys, with the rows of a key of many dealt over as many tasks as column name of both says.

    by: what many's rows are dealt by; each row of few goes to all of its key's tasks.
    """
    a = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col(name) - 1))).drop(name)
    b = many.withColumn("_part", F.pmod(F.xxhash64(by), F.col(name)).cast("int")).drop(name)
    return a.join(b, [*keys, "_part"]).drop("_part")


def looked_up(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with table, which has a row a key at most, whatever share of the rows a key holds.

    The table's rows of hot keys (from hot_keys) are broadcast, HOT_KEYS at most; all others meet in a shuffle.
    """
    if hot is None:
        return rows.join(table, key, how)
    of_hot = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(of_hot, key, how).unionByName(rows.join(hot, key, "left_anti").join(table, key, how))


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names like `wanted` that clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(df: DataFrame, kept: str, columns: list[str]) -> DataFrame:
    """The columns of those rows of df whose column kept is true.

    A row number that the condition needs keeps the optimizer from moving the condition below the projections that
    kept is made by, which would write their expressions out again and again.
    """
    (n,) = spare(df, "row_number")
    rows = df.withColumn(n, F.monotonically_increasing_id()).where(F.col(kept) & (F.col(n) >= 0))
    return rows.select(*[col(c) for c in columns])


def running(df: DataFrame, order: list[Column], sums: dict[str, str], label: str) -> DataFrame:
    """df with columns that have, by name, the sum of a column of df over all rows before in the order; 0 for the first.

    Rows are sorted by ranges; each range is summed on its own, and the ranges' totals (as many as shuffle partitions)
    once. The order should have no ties.
    """
    part, *offsets = spare(df, "range_part", *(n + "_offset" for n in sums))
    rows = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), label)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(part).agg(*[F.sum(c).alias(o) for o, c in zip(offsets, sums.values())])
    totals = totals.select(part, *[F.sum(o).over(before).alias(o) for o in offsets])
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    out = rows.join(F.broadcast(totals), part)
    return out.withColumns({n: F.coalesce(F.col(o), zero) + F.coalesce(F.sum(c).over(within), zero) for (n, c), o in zip(sums.items(), offsets)}).drop(part, *offsets)


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words as long, without keeping them."""
    return F.size(words_of(text)).cast("long")


def unit(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
