"""Candidate pairs among texts of a template whose other parts come from few alternatives.

Such texts share most of their shingles, and each of the others with a good part of all texts, so no single shingle tells
pairs apart. MinHash does, over the rarest shingles only. If two sets of n_a and n_b shingles (a <= b) have
a similarity of t, they share o = t / (1 + t) * (n_a + n_b) at least; then the first n_a - o + l of the one and n_b - o + l of
the other, rarest first, share l at least, whatever l is. With l small enough that these prefixes hold little of what all texts
share, texts of a template have a small similarity there, and linked ones must reach l / (n_a + n_b - 2 * o + l).

Texts that may meet (one cluster) choose l, as a part of the size, and the number of minima in a band k so that bands and
expected pairs cost least; the number of bands follows from the similarity that links must reach, so that a link is missed with
probability MISS at most. Sizes are graded in STEPS steps a factor of 1 / t, and each two grades that linked sets can have
are handled on their own, as l / ... depends on both. Keys are one band of one cluster and two grades. What meets by a key
is compared by sketches of the prefixes, and by what they share, before it is a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, looked_up, met, small, spread, written
from .kernels import U, begin, estimate, mix, stream

MISS, STEPS, SKETCH, MARGIN = 1e-5, 8, 512, 0.13
#: What two sets share is looked up in prefixes with an l of this part of the size at least.
SCREEN = 0.2
#: Parts of a set's size that l is chosen from, and minima in a band.
PARTS, MOST_ROWS, MOST_BANDS = (0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.45, 0.7), 12, 4096


@lru_cache(1)
def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of n permutations of 32-bit numbers."""
    return (stream(n, 11) >> U(32)).astype(np.uint32) | np.uint32(1), (stream(n, 12) >> U(32)).astype(np.uint32)


def minima(h: np.ndarray, first: int, last: int) -> np.ndarray:
    """The least values of permutations first to last - 1 over 32-bit hashes; h isn't empty."""
    a, b = functions(SKETCH + MOST_ROWS * MOST_BANDS)
    step, out = max(1, (1 << 18) // len(h)), []
    for s in range(first, last, step):
        e = min(last, s + step)
        out.append((a[s:e, None] * h[None, :] + b[s:e, None]).min(axis=1))
    return np.concatenate(out)


def shared_part(t: float) -> float:
    return t / (1 + t)


def lengths(g: int, d: int, part: float, t: float) -> tuple[float, float, float]:
    """(prefix of the smaller set, of the larger one, similarity that links reach) for sizes of grades g and g + d."""
    r = t ** (-1 / STEPS)
    a, b = r**g, r ** (g + d)
    o, share = shared_part(t) * (a + b), part * a
    m_a, m_b = a * r - o + share, b * r - o + share
    return m_a, m_b, share / (m_a + m_b + 2 - share)  # prefixes are whole numbers of shingles


def bands(s: float, k: int) -> int:
    """Bands of k minima after which a pair of similarity s is missed with probability MISS; s of short texts may be so small that 1 - s**k is 1."""
    return max(1, ceil(log(MISS) / log1p(-(s**k)))) if s < 1 else 1


def chosen(members: int, n: float, shares: list[float], t: float) -> tuple[float, int]:
    """(part, k) of least cost for a cluster of sets of n shingles; shares: for each part, the mean share of members that hold a shingle of the prefix."""
    best = (float("inf"), PARTS[-1], 1)
    for part, p in zip(PARTS, shares):
        by_chance = p / (2 - p)
        for k in range(1, MOST_ROWS + 1):
            count = bands(lengths(grade(n, t), 0, part, t)[2], k)
            if count <= MOST_BANDS or k == 1:
                best = min(best, (count * (k + 1 + members * by_chance**k), part, k))
    return best[1:]


def grade(n: float, t: float) -> int:
    """n lies in [r**grade, r**(grade + 1)), with r = t**(-1 / STEPS)."""
    return int(log(n) / (-log(t) / STEPS) + 1e-9)


def _packed(x: np.ndarray) -> list[int]:
    """2 low bits of each of SKETCH mixed minima, 32 to a long."""
    low = (mix(x.astype(np.uint64)) & U(3)).reshape(-1, 32)
    return (low << (np.arange(32, dtype=np.uint64) * U(2))[None, :]).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def _profile(t: float):
    """Of rows (cluster, members, n, alone, times) how commonly the shingles of each prefix are held, and the grade."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near_dedup")
        for batch in batches:
            out = []
            for members, n, alone, times in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                held = np.concatenate([[0.0], np.cumsum(np.minimum(1.0, np.array(times, np.float64) / members))])
                sizes = [ceil(lengths(grade(n, t), 0, p, t)[0]) for p in PARTS]
                out.append([held[min(max(0, m - alone), len(times))] / m for m in sizes] + [grade(n, t)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[-1] for x in out], pa.int32()), *[pa.array([x[i] for x in out], pa.float64()) for i in range(len(PARTS))]], ["cluster", "grade", *[f"p{i}" for i in range(len(PARTS))]])

    return run


def _choice(t: float):
    """Of rows (cluster, members, n, share of each part) the cluster's part and k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [chosen(m, n, shares, t) for m, n, *shares in zip(*[c.to_pylist() for c in batch.columns[1:]])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int32())], ["cluster", "part", "k"])

    return run


def _sketched(t: float):
    """Of rows (id, n, alone, part, shingles) a sketch of the prefix that a set of its size meets its equals by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near_dedup")
        for batch in batches:
            out = [_packed(minima(_hashes(x)[: max(1, ceil(screened(p, t) * n) - alone)], 0, SKETCH)) for n, alone, p, x in zip(*[c.to_pylist() for c in batch.columns[1:]])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "sketch"])

    return run


def _hashes(shingles: list[int]) -> np.ndarray:
    return (np.array(shingles, np.int64).view(np.uint64) >> U(32)).astype(np.uint32)


def screened(part: float, t: float) -> float:
    """The prefix of a set that is sketched, as a part of its size."""
    return 1 - 2 * shared_part(t) + part


def _keys(t: float):
    """Of rows (cluster, part, k, grades, id, comp, n, alone, shingles) the band keys in both roles, for the grades that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near_dedup")
        for batch in batches:
            for cluster, part, k, grades, i, comp, n, alone, shingles in zip(*[c.to_pylist() for c in batch.columns]):
                h, g = _hashes(shingles), grade(n, t)
                for other in grades:
                    for larger in (False, True):
                        low, d = (other, g - other) if larger else (g, other - g)
                        m_a, m_b, s = lengths(low, d, part, t)
                        count = ceil(m_b if larger else m_a) - alone
                        if not 0 <= d <= STEPS or count <= 0:  # no linked sets of these grades, or none holds another's shingle
                            continue
                        rows = next(x for x in range(k, 0, -1) if x == 1 or bands(s, x) <= MOST_BANDS)  # the same for both roles
                        n_bands = bands(s, rows)
                        x = minima(h[:count], SKETCH, SKETCH + n_bands * rows).astype(np.uint64).reshape(n_bands, rows)
                        key = mix(np.arange(n_bands, dtype=np.uint64) * U(0xBF58476D1CE4E5B9) + U((cluster * 0x9E3779B97F4A7C15 + low * 1_000_003 + d) & (1 << 64) - 1))
                        for c in range(rows):
                            key = mix(key * U(0x94D049BB133111EB) + x[:, c])
                        for first in range(0, n_bands, 65536):
                            some = key[first : first + 65536].view(np.int64)
                            full = lambda v, kind: pa.array(np.full(len(some), v), kind)
                            yield pa.RecordBatch.from_arrays([pa.array(some), full(larger, pa.bool_()), full(i, pa.int64()), full(comp, pa.int64()), full(n, pa.int64())], ["key", "larger", "id", "comp", "n"])

    return run


def pairs(posts: DataFrame, clusters: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be similar; posts: (id, comp, n, w, times), a row a shingle.

    n: the size of the set; times: how many sets hold the shingle; shingles of one holder have no row. clusters: (id,
    cluster) of those that may meet; None if all may.
    """
    t = min(percent, 99) / 100
    texts = posts.groupBy("id").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("times", "w"))).alias("held"))
    texts = texts.withColumn("cluster", F.lit(0).cast("long")) if clusters is None else texts.join(clusters, "id")  # who is alone meets none
    texts = written(texts.select("id", "comp", "n", "cluster", (F.col("n") - F.size("held")).alias("alone"), F.col("held.times").alias("times"), F.col("held.w").alias("shingles")), "crowded-texts")
    sizes = written(texts.groupBy("cluster").agg(F.count("*").alias("members"), F.avg("n").alias("mean")).where("members > 1"), "cluster-sizes")
    hot = hot_keys("cluster", counted=sizes.select("cluster", F.col("members").alias("n")))
    shares = [f"p{i}" for i in range(len(PARTS))]
    of = looked_up(texts, sizes, "cluster", hot).select("cluster", "members", "n", "alone", "times")
    of = of.mapInArrow(_profile(t), "cluster long, grade int, " + ", ".join(f"{p} double" for p in shares))
    of = of.groupBy("cluster").agg(F.collect_set("grade").alias("grades"), *[F.avg(p).alias(p) for p in shares])  # grades grow with the logarithm of sizes
    of = written(of.join(sizes, "cluster"), "clusters")
    choice = of.select("cluster", "members", "mean", *shares).mapInArrow(_choice(t), "cluster long, part double, k int")
    texts = written(looked_up(texts, of.select("cluster", "grades").join(choice, "cluster"), "cluster", hot), "chosen")
    keys = texts.select("cluster", "part", "k", "grades", "id", "comp", "n", "alone", "shingles").mapInArrow(_keys(t), "key long, larger boolean, id long, comp long, n long")
    keys = written(keys, "crowded-keys")
    # Of each key's holders, those of its commonest component meet only the others.
    split = keys.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("major"), F.count("*").alias("comps"), F.sum("m").alias("n"))
    split = written(split.where("comps > 1").select("key", "major", "n"), "crowded-split")
    keys = looked_up(keys, split.select("key", "major", spread(F.col("n")).alias("tasks")), "key", hot_keys("key", counted=split.select("key", "n"))).withColumn("minor", F.col("comp") != F.col("major"))
    keys = written(keys, "meeting")
    x = keys.where("not larger").select("key", "tasks", F.col("id").alias("i"), F.col("n").alias("n_i"), F.col("comp").alias("c_i"), F.col("minor").alias("minor_i"))
    y = keys.where("larger").select("key", "tasks", F.col("id").alias("j"), F.col("n").alias("n_j"), F.col("comp").alias("c_j"), F.col("minor").alias("minor_j"))
    on = (F.col("c_i") != F.col("c_j")) & ((F.col("n_i") < F.col("n_j")) | ((F.col("n_i") == F.col("n_j")) & (F.col("i") < F.col("j")))) & (100 * F.col("n_i") >= percent * F.col("n_j"))
    found = met(x.where("minor_i"), y, ["key"], "j", "tasks").where(on).unionByName(met(y.where("minor_j"), x.where("not minor_i"), ["key"], "i", "tasks").where(on))
    found = found.select("i", "j", "n_i", "n_j").distinct()
    prefix = 1 - 2 * shared_part(t) + F.col("part")
    sketches = texts.select("id", "n", "alone", "part", "shingles").mapInArrow(_sketched(t), "id long, sketch array<long>")
    wide = lambda of: of - F.col("part") + F.greatest(F.col("part"), F.lit(SCREEN))
    first = F.slice("shingles", 1, F.greatest(F.lit(0), F.ceil(wide(prefix) * F.col("n")) - F.col("alone")).cast("int"))
    sketches = written(sketches.join(texts.select("id", "part", first.alias("first")), "id"), "prefix-sketches")
    held = small(sketches)
    # What two prefixes of these sizes share at least, if the sets are linked.
    both = F.col("n_i") + F.col("n_j")
    shared = lambda of: of * F.col("n_j") - F.col("n_j") + shared_part(t) * both
    least = shared(prefix)
    found = found.join(held.select(F.col("id").alias("i"), "part", F.col("sketch").alias("sketch_i"), F.col("first").alias("first_i")), "i").join(held.select(F.col("id").alias("j"), F.col("sketch").alias("sketch_j"), F.col("first").alias("first_j")), "j")
    found = found.where(estimate(F.col("sketch_i"), F.col("sketch_j"), SKETCH) >= least / (prefix * both + 2 - least) - MARGIN)
    found = found.where(F.size(F.array_intersect("first_i", "first_j")) >= shared(wide(prefix)) - 1e-6)
    return found.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
