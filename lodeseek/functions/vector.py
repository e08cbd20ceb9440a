"""Cosine similarity as a column expression, and an Arrow form for batches of queries."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def hash_vector(text: str, dimensions: int) -> list[float]:
    """Deterministic embedding: byte i % 32 of the SHA-256 scaled to [-1, 1], normalised."""
    digest = hashlib.sha256(text.encode()).digest()
    raw = [digest[i % 32] / 127.5 - 1 for i in range(dimensions)]
    norm = math.sqrt(sum(x * x for x in raw))
    return [x / norm for x in raw] if norm else raw


def query_vector(text: str, dimensions: int) -> list[float]:
    return hash_vector("query:" + text, dimensions)


def hash_vector_column(text: Column, dimensions: int) -> Column:
    """hash_vector for a column, without Python: bytes come from the hex digest."""
    byte = lambda d, i: F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1
    of_digest = lambda d: F.transform(F.sequence(F.lit(0), F.lit(min(dimensions, 32) - 1)), lambda i: byte(d, i))
    spread = lambda b: F.slice(F.flatten(F.array_repeat(b, (dimensions + 31) // 32)), 1, dimensions)
    with_norm = lambda r: F.struct(r.alias("r"), F.sqrt(dot(r, r)).alias("n"))
    scaled = let(let(let(let(F.sha2(text, 256), of_digest), spread), with_norm), lambda s: F.transform(s["r"], lambda x: (x / s["n"]).cast("float")))
    return F.when(text.isNotNull(), scaled)


def topk(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], k: int) -> DataFrame:
    """(id_col, score) of the k nearest by cosine; null vectors are skipped, ties go to the smaller id."""
    scored = vectors.where(F.col(vector_col).isNotNull()).select(id_col, F.round(cosine(F.col(vector_col), literal(query)), 6).alias("score"))
    return scored.orderBy(F.desc_nulls_last("score"), id_col).limit(k).where("score is not null")  # a filter below would score twice


def topk_batch(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_id: str, query_col: str, k: int, block: int = 4096, scopes: str | None = None) -> DataFrame:
    """(query_id, id_col, score) of the k nearest for each query: one matrix product a batch of vectors.

    scopes: a column of vectors with the numbers of the scopes that a row is in, and one of the same name of queries with
    the number of their scope; a query finds rows of its scope only.

    Queries are taken to every executor in blocks of a bounded number of rows; each task keeps its k best a query,
    so what is shuffled is k rows a query and task.
    """
    spark, out, held = vectors.sparkSession, None, []
    schema = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {id_col} {vectors.schema[id_col].dataType.simpleString()}, score double"
    id_type, query_type = ({"bigint": pa.int64(), "int": pa.int32()}.get(df.schema[c].dataType.simpleString(), pa.string()) for df, c in ((vectors, id_col), (queries, query_id)))

    def search(rows: list) -> DataFrame:
        names = [r[0] for r in rows]
        q = np.array([r[1] for r in rows], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((names, q, np.array([r[2] for r in rows]) if scopes else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, of = shared.value
            best_s, best_i = np.full((len(names), 0), -2.0), np.empty((len(names), 0), object)
            for batch in batches:
                if not batch.num_rows:
                    continue
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(flat, axis=1)
                s = np.round(q @ (flat / np.maximum(norm, 1e-300)[:, None]).T, 6)
                s[:, norm == 0] = -2
                if of is not None:
                    lists = batch.column(2)
                    inside = np.zeros((int(of.max()) + 1, batch.num_rows), bool)
                    number, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                    asked = number < len(inside)
                    inside[number[asked], row[asked]] = True
                    s[~inside[of]] = -2
                ids = np.array(batch.column(0).to_pylist(), object)
                s, i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, np.broadcast_to(ids, (len(names), len(ids)))], axis=1)
                keep = [np.lexsort((i[r].astype("int64" if isinstance(i[r][0], int) else str), -s[r]))[:k] for r in range(len(names))]
                best_s, best_i = np.stack([s[r][x] for r, x in enumerate(keep)]), np.stack([i[r][x] for r, x in enumerate(keep)])
            for r, name in enumerate(names):
                ok = best_s[r] > -2
                if n := int(ok.sum()):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, query_type), pa.array(best_i[r][ok].tolist(), id_type), pa.array(best_s[r][ok])], [query_id, id_col, "score"])

        rows_of = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col, *([scopes] if scopes else []))
        near = rows_of.mapInArrow(run, schema)
        place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_col))
        return near.withColumn("place", place).where(F.col("place") <= k).drop("place")

    for r in queries.where(F.col(query_col).isNotNull()).select(query_id, query_col, *([scopes] if scopes else [])).toLocalIterator():
        held.append(r)
        if len(held) == block:
            part, held = search(held), []
            out = part if out is None else out.union(part)
    if held or out is None:
        part = search(held) if held else spark.createDataFrame([], schema)
        out = part if out is None else out.union(part)
    return out
