"""Hard negatives by a vector-approximation file.

Rows are dealt into blocks, and each block is a file of approximations: every dimension is cut into 16 cells that hold
about as many of the block's rows, so a row takes half a byte a dimension beside its exact integers. For a block of
anchors, a table gives the least and the greatest product of an anchor's component with any value of a cell, two dimensions
together; so two lookups a byte, added up, bound a row's score from below and above. Exact scores are computed only
for rows whose bounds say that they may enter:

1. positives: rows of the anchor's label whose upper bound reaches the anchor's last place so far, and the last place that
   the block's lower bounds make sure of;
2. negatives: rows of other labels whose bounds meet the window of one of the anchor's positives, with an upper bound
   that reaches the last place in it.

Anchors and blocks meet on a grid: blocks are dealt into groups, anchors into blocks of ANCHORS, and a task goes through a
group's blocks one after another for a block of anchors, keeping the best of each. So each task holds one block of either, and
what is shuffled beside the blocks is a few rows for each anchor and group. The groups' best are ranked at the end.

A component x becomes floor(scale * x), x as double; scores are integer inner products, exact. Rows with a null id, label
or vector, with a null or non-finite component, or one of 2**24 or more, take no part. A shorter vector is as if
filled up with zeros. Rows of equal id are one row: the first by label, then vector. Ties go to the smaller id. Anchors without
positives, and positives without negatives, give no rows; so do empty tables. Columns with other names are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, ready, small, written
from .kernels import begin

CELLS, BLOCK, ANCHORS, STRETCH = 16, 4096, 8192, 64
LARGEST = 1 << 24


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part: integer components, an id once."""
    v = col(vector_col)
    sound = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))  # NaN counts as larger than any number
    rows = vectors.where(col(id_col).isNotNull() & col(label_col).isNotNull() & v.isNotNull() & sound)
    rows = rows.select(col(id_col).cast("long").alias("id"), col(label_col).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    several = written(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "several")
    if several.isEmpty():
        return rows
    one = rows.join(small(several), "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return rows.join(small(several), "id", "left_anti").unionByName(one)


def _blocks(rows: DataFrame, n: int, size: int, dims: int, label: str) -> DataFrame:
    """(block, ids, labels, v) with about `size` rows in each block, as little-endian 64-bit numbers, rows by label and id."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        flat, offsets = _ragged(table.column("v"))
        v = np.zeros((table.num_rows, dims), "<i8")
        at = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
        v[np.repeat(np.arange(len(v)), np.diff(offsets)), at] = flat
        ids, labels = (table.column(c).to_numpy().astype("<i8") for c in ("id", "label"))
        order = np.lexsort((ids, labels))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([x[order].tobytes()], pa.binary()) for c, x in (("ids", ids), ("labels", labels), ("v", v))}})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // size)))).cast("int"))
    return written(dealt.groupBy("block").applyInArrow(run, "block int, ids binary, labels binary, v binary"), label)


def _ragged(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    held = lists.combine_chunks()
    held = pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
    return held.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


class Approximations:
    """A block's cells: a byte for two dimensions of a row, and the least and greatest value in each cell."""

    def __init__(self, v: np.ndarray):
        n, dims = v.shape
        marks = np.sort(v, axis=0)[(np.arange(1, CELLS) * n) // CELLS]
        cell = np.zeros((n, dims + dims % 2), np.int64)
        for m in marks:  # ties stay in one cell
            cell[:, :dims] += v > m
        self.low, self.high = np.zeros((dims + dims % 2, CELLS), np.int64), np.zeros((dims + dims % 2, CELLS), np.int64)
        for c in range(CELLS):
            here = cell[:, :dims] == c
            some = here.any(axis=0)
            self.low[:dims, c] = np.where(some, np.where(here, v, np.iinfo(np.int64).max).min(axis=0), 0)
            self.high[:dims, c] = np.where(some, np.where(here, v, np.iinfo(np.int64).min).max(axis=0), 0)
        self.codes = np.ascontiguousarray((cell[:, ::2] * CELLS + cell[:, 1::2]).T)

    def bounds(self, q: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score of each of the rows with each anchor of q: (rows, anchors)."""
        a, d = len(q), q.shape[1]
        q = np.concatenate([q, np.zeros((a, len(self.low) - d), np.int64)], axis=1)
        x, y = q.T[:, None, :] * self.low[:, :, None], q.T[:, None, :] * self.high[:, :, None]
        ends = np.concatenate([np.minimum(x, y), np.maximum(x, y)], axis=2)  # (dimensions, cells, 2 * anchors)
        table = (ends[::2, :, None, :] + ends[1::2, None, :, :]).reshape(len(self.codes), CELLS * CELLS, 2 * a)
        total = np.zeros((rows.stop - rows.start, 2 * a), np.int64)
        for t, codes in zip(table, self.codes):
            total += t[codes[rows]]
        return total[:, :a], total[:, a:]


class Best:
    """The best rows of each anchor so far: anchor (a place), id, score."""

    def __init__(self, k: int, anchors: int):
        self.k, self.n = k, anchors
        self.at, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def last(self) -> np.ndarray:
        """The score of each anchor's last place; the least number there is while places are free."""
        out, n = np.full(self.n, np.iinfo(np.int64).min), np.bincount(self.at, minlength=self.n)
        full = np.flatnonzero(n == self.k)
        out[full] = self.scores[np.cumsum(n)[full] - 1]
        return out

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        at, ids, scores = (np.concatenate([x, y]) for x, y in ((self.at, at), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < self.k
        self.at, self.ids, self.scores = at[keep], ids[keep], scores[keep]


def _sure(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest lower bound of each anchor's rows: a score that k rows have at least."""
    return np.partition(low, len(low) - k, axis=0)[len(low) - k] if len(low) >= k else np.full(low.shape[1], np.iinfo(np.int64).min)


def _exact(q: np.ndarray, v: np.ndarray, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", v[r[i : i + 65536]], q[a[i : i + 65536]]) for i in range(0, len(r), 65536)]])


class Anchors:
    """A block of anchors, and the best rows for them in the blocks that have come by."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, windows: np.ndarray | None, k: int):
        self.ids, self.labels, self.q, self.k, self.scored, self.met = ids, labels, q, k, 0, 0
        self.windows = windows  # None, or (anchors, positives, 2): the least and greatest score; least > greatest is none
        self.best = [Best(k, len(ids)) for _ in range(1 if windows is None else windows.shape[1])]

    def meet(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        """Both sides are sorted by label; positives come from rows of an anchor's label, negatives from the others."""
        cells = Approximations(v)
        for label in np.unique(self.labels):
            s, e = np.searchsorted(self.labels, [label, label + 1])
            first, last = np.searchsorted(labels, [label, label + 1])
            ranges = [slice(int(first), int(last))] if self.windows is None else [slice(0, int(first)), slice(int(last), len(ids))]
            for a in range(s, e, STRETCH):
                b = min(e, a + STRETCH)
                for rows in ranges:
                    if rows.stop > rows.start:
                        self._stretch(cells, ids, v, a, b, rows)

    def _stretch(self, cells: Approximations, ids: np.ndarray, v: np.ndarray, a: int, b: int, rows: slice) -> None:
        q, least = self.q[a:b], np.iinfo(np.int64).min
        low, high = cells.bounds(q, rows)
        self.met += low.size
        if self.windows is None:
            itself = ids[rows][:, None] == self.ids[a:b][None, :]
            need = np.maximum(self.best[0].last()[a:b], _sure(np.where(itself, least, low), self.k))
            enter = (high >= need) & ~itself
        else:
            enter = np.zeros(low.shape, bool)
            for best, (lo, hi) in zip(self.best, np.moveaxis(self.windows[a:b], 0, 2)):
                inside = np.where((low >= lo) & (high <= hi), low, least)
                enter |= (high >= np.maximum(lo, np.maximum(best.last()[a:b], _sure(inside, self.k)))) & (low <= hi)
        r, at = np.nonzero(enter)
        self.scored += len(r)
        scores = _exact(q, v, r + rows.start, at)
        for i, best in enumerate(self.best):
            ok = slice(None)
            if self.windows is not None:
                lo, hi = self.windows[a:b, i].T
                ok = (scores >= lo[at]) & (scores <= hi[at])
            best.add(at[ok] + a, ids[r[ok] + rows.start], scores[ok])


def _met(rows: DataFrame, anchors: DataFrame, windows: int, k: int, dims: int) -> DataFrame:
    """(anchor, place, id, score): for each anchor and place of a window, or 0, the k best in each group of blocks.

    rows, anchors: blocks; those of anchors may have windows, as bytes.
    """
    spark = rows.sparkSession
    n_anchors, n_rows = anchors.count(), rows.count()
    groups = max(1, min(n_rows, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, n_anchors))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    q = anchors.select(F.col("block").alias("a"), every(groups).alias("g"), F.lit(-1).alias("block"), "ids", "labels", "v", (F.col("windows") if windows else F.lit(None).cast("binary")).alias("windows"))
    r = rows.select(every(n_anchors).alias("a"), F.pmod("block", F.lit(groups)).alias("g"), "block", "ids", "labels", "v", F.lit(None).cast("binary").alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("negatives")
        held = None

        def out(held: Anchors) -> Iterator[pa.RecordBatch]:
            for place, best in enumerate(held.best):
                for s in range(0, len(best.at), 65536):
                    at = best.at[s : s + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(held.ids[at]), pa.array(np.full(len(at), place), pa.int32()), pa.array(best.ids[s : s + 65536]), pa.array(best.scores[s : s + 65536])], ["anchor", "place", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                block, *data = (batch.column(c)[i].as_py() for c in range(2, 7))
                ids, labels, v = (np.frombuffer(x, "<i8") for x in data[:3])
                v = v.reshape(len(ids), dims)
                if block < 0:
                    if held is not None:
                        yield from out(held)
                    held = Anchors(ids, labels, v, np.frombuffer(data[3], "<i8").reshape(len(ids), windows, 2) if windows else None, k)
                else:
                    held.meet(ids, labels, v)
        if held is not None:
            yield from out(held)

    dealt = q.unionByName(r).repartition("a", "g").sortWithinPartitions("a", "g", "block")
    return dealt.mapInArrow(run, "anchor long, place int, id long, score long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where is_anchor holds.

    An anchor's positives are the first rows of its label; the negatives of each are the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. First: by score, then the smaller id.
    """
    ready(vectors.sparkSession)
    rows = written(integers(vectors, id_col, vector_col, label_col, scale), "integers")
    queries = written(rows.join(vectors.where(is_anchor).select(col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi"), "anchors")
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(1, dims)
    blocks = _blocks(rows, n, BLOCK, dims, "blocks")
    of_anchors = _blocks(queries, queries.count(), ANCHORS, dims, "anchor-blocks")
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id")) - 1
    best = _met(blocks, of_anchors, 0, positives, dims).withColumn("place", first.cast("int")).where(F.col("place") < positives)
    best = written(best.select("anchor", "place", F.col("id").alias("positive"), F.col("score").alias("of_positive")), "positives")

    def windowed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.frombuffer(left.column("ids")[0].as_py(), "<i8")
        w = np.tile(np.array([1, 0], "<i8"), (len(ids), positives, 1))
        at, place, p = (right.column(c).to_numpy() for c in ("anchor", "place", "of_positive"))
        order = np.argsort(ids)
        at = order[np.searchsorted(ids, at, sorter=order)]
        w[at, place, 0], w[at, place, 1] = -((-low * p) // 100), high * p // 100
        return left.append_column("windows", pa.array([w.tobytes()], pa.binary()))

    n_blocks = max(1, -(-queries.count() // ANCHORS))
    scores = best.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)).cast("int"))
    with_windows = written(of_anchors.groupBy("block").cogroup(scores.groupBy("block")).applyInArrow(windowed, "block int, ids binary, labels binary, v binary, windows binary"), "windows")
    found = _met(blocks, with_windows, positives, negatives, dims).join(best, ["anchor", "place"])
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("of_positive").alias("positive_score"), F.col("score").alias("negative_score"))


def report(vectors: DataFrame) -> DataFrame:
    """Every id divisible by 100 is an anchor; labels of ids divisible by 7 are shifted, as noise that mining meets."""
    noisy = vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(noisy, F.col("vec_id") % 100 == 0)
