"""Approximate cosine search: inverted lists of product-quantised residuals, with exact scores for a short list.

Centroids and code books are fitted on a bounded sample (SAMPLE rows of the smallest hashes); every vector is coded, under its
nearest centroid. A query reads the codes of its nearest centroids' lists only, adds up table entries, and scores its
short list with the vectors themselves. Vectors are coded one by one, so new ones join the lists as they come. `recall`
measures against exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine

SAMPLE, ROUNDS, BOOKS, CODES = 20_000, 12, 8, 256
#: Candidates scored exactly for each result that is wanted, unless the model needs more, and queries that are looked up side by side.
SHORT, SIDE_BY_SIDE = 16, 256
#: Rows of short lists that are sent to every executor; more are joined by a shuffle.
SENT = 500_000


@dataclass
class Model:
    """Centroids of the lists, code books of the residuals' parts, how many lists a query looks into, and how many candidates a result it scores."""

    dimensions: int
    centroids: list[list[float]]
    books: list[list[list[float]]]
    probes: int = 1
    recall: float = 0.0
    short: int = SHORT

    @staticmethod
    def of(held: dict) -> "Model":
        return Model(**held)

    def held(self) -> dict:
        return asdict(self)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.centroids, np.float64), np.array(self.books, np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, BOOKS, width): the vectors' parts, filled up with zeros."""
    width = -(-x.shape[1] // BOOKS)
    return np.pad(x, ((0, 0), (0, BOOKS * width - x.shape[1]))).reshape(len(x), BOOKS, width)


def _means(x: np.ndarray, n: int, rng, spherical: bool) -> np.ndarray:
    """k-means of at most n centres."""
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T - (0 if spherical else 0.5) * (c * c).sum(axis=1)).argmax(axis=1)
        sums, count = np.zeros_like(c), np.bincount(near, minlength=len(c))[:, None]
        np.add.at(sums, near, x)
        c = np.where(count > 0, _unit(sums) if spherical else sums / np.maximum(count, 1), c)
    return c


def fitted(vectors: DataFrame, id_col: str, vector_col: str, lists: int, sample: int = SAMPLE, seed: int = 1) -> Model:
    """The model of a sample that is the same in every run."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(vector_col, F.xxhash64(F.lit(seed), id_col).alias("h")).orderBy("h").limit(sample).collect()
    if not rows:
        raise ValueError("there are no vectors to fit an index to")
    x, rng = _unit(np.array([r[0] for r in rows], np.float64)), np.random.default_rng(seed)
    c = _means(x, lists, rng, True)
    rest = _parts(x - c[(x @ c.T).argmax(axis=1)])
    books = [_means(rest[:, k], CODES, rng, False).tolist() for k in range(BOOKS)]
    return Model(x.shape[1], c.tolist(), books)


def coded(vectors: DataFrame, id_col: str, vector_col: str, model: Model) -> DataFrame:
    """(list, id_col, code, vector_col) of every vector; null and zero vectors have none."""
    held = vectors.sparkSession.sparkContext.broadcast(model.arrays())
    types = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, books = held.value
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                near = (x @ c.T).argmax(axis=1)
                rest = _parts(x - c[near])
                code = np.stack([(rest[:, k] @ b.T - 0.5 * (b * b).sum(axis=1)).argmax(axis=1) for k, b in enumerate(books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), pa.array([r.tobytes() for r in code], pa.binary()), batch.column(1)], ["list", id_col, "code", vector_col])

    rows = vectors.select(id_col, vector_col).where(F.col(vector_col).isNotNull() & F.exists(vector_col, lambda v: v != 0))
    return rows.mapInArrow(run, f"list int, {id_col} {types[id_col]}, code binary, {vector_col} {types[vector_col]}")


def search(index: DataFrame, queries: list[tuple], id_col: str, vector_col: str, model: Model, k: int, probes: int | None = None, query_type: str = "int") -> DataFrame:
    """(query_id, id_col, score) of the k best of each of SIDE_BY_SIDE queries (id, vector) at most, by exact cosine of a short list.

    Only the lists that some query looks into are read: first their codes, then the vectors of the short lists.
    """
    if len(queries) > SIDE_BY_SIDE:
        raise ValueError(f"{len(queries)} queries, more than {SIDE_BY_SIDE}")
    spark, short = index.sparkSession, model.short * k
    c, books = model.arrays()
    q = _unit(np.array([v for _, v in queries], np.float64).reshape(len(queries), -1))
    base = q @ c.T
    mine = np.argsort(-base, axis=1, kind="stable")[:, : probes or model.probes]
    looks = np.zeros(base.shape, bool)
    np.put_along_axis(looks, mine, True, axis=1)
    tables = np.einsum("qkw,kcw->qkc", _parts(q), books)
    held = spark.sparkContext.broadcast((base, looks, tables))
    id_type = dict(index.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, looks, tables = held.value
        best: list[tuple[np.ndarray, list]] = [(np.zeros(0), []) for _ in range(len(base))]
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0).to_numpy()
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, tables.shape[1])
            ids = batch.column(1).to_pylist()
            for i in np.flatnonzero(looks[:, np.unique(lists)].any(axis=1)).tolist():
                rows = np.flatnonzero(looks[i, lists])
                score = base[i, lists[rows]] + sum(tables[i, m, code[rows, m]] for m in range(code.shape[1]))
                score, found = np.concatenate([best[i][0], score]), best[i][1] + [ids[r] for r in rows.tolist()]
                keep = np.argsort(-score, kind="stable")[:short]
                best[i] = score[keep], [found[r] for r in keep.tolist()]
        for i, (score, found) in enumerate(best):
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int32)), pa.array(found, batch.column(1).type), pa.array(score)], ["at", id_col, "near"])

    inside = index.where(F.col("list").isin(*np.unique(mine).tolist()))
    near = inside.select("list", id_col, "code").mapInArrow(run, f"at int, {id_col} {id_type}, near double")
    place = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("near"), id_col))
    near = near.withColumn("place", place).where(F.col("place") <= short).select("at", id_col)
    asked = spark.createDataFrame([(i, name, [float(x) for x in v]) for i, (name, v) in enumerate(queries)], f"at int, query_id {query_type}, _v array<double>")
    near = F.broadcast(near) if short * len(queries) <= SENT else near
    scored = inside.select(id_col, vector_col).join(near, id_col).join(F.broadcast(asked), "at")  # SIDE_BY_SIDE queries at most
    scored = scored.select("query_id", id_col, F.round(cosine(F.col(vector_col), F.col("_v")), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return scored.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def recall(found: DataFrame, exact: DataFrame, query_id: str, id_col: str) -> float:
    """The share of the exact results that were found."""
    n = exact.count()
    return exact.join(found, [query_id, id_col], "left_semi").count() / n if n else 1.0


def calibrated(index: DataFrame, vectors: DataFrame, queries: DataFrame, query_id: str, query_col: str, id_col: str, vector_col: str, model: Model, k: int, target: float = 0.9) -> Model:
    """The model with the fewest probes (half as many more each time, then all lists) whose recall against exact search over all rows reaches target.

    Where all lists don't reach it, short lists grow twofold until they do; at the latest they hold all rows, which is
    exact search. queries: SIDE_BY_SIDE at most.
    """
    from ..functions.vector import topk_batch

    held = [tuple(r) for r in queries.select(query_id, query_col).collect()]
    kind, lists = dict(queries.dtypes)[query_id], len(model.centroids)
    exact = topk_batch(vectors, id_col, vector_col, queries, query_id, query_col, k).persist()
    try:
        probes, short, n = 1, SHORT, index.count()
        while True:
            probes = min(probes, lists)
            model = replace(model, probes=probes, short=short)
            found = search(index, held, id_col, vector_col, model, k, probes, kind).withColumnRenamed("query_id", query_id)
            got = recall(found, exact, query_id, id_col)
            if got >= target or probes == lists and short * k >= n:
                return replace(model, recall=got)
            if probes == lists:
                short *= 2
            probes = probes + max(1, probes // 2)
    finally:
        exact.unpersist()
