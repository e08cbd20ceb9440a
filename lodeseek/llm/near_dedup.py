"""Near-duplicate groups by b-bit MinHash.

Every text gives the set of its distinct 5-word shingles, 160 minima (permutations), 26 band keys of 6 minima
each, and a packed sketch of the lowest 2 bits of each minimum. Pairs come from equal band keys, are screened by
the collision-corrected estimate from counting equal bit pairs, and are confirmed on the full shingle sets.

Texts with equal sets form one class first; in each band group every class meets the group's smallest member. Groups whose
other members then still lie in different components (texts of one template, say) are split by rare shingles: by the
number of these members that hold a shingle, fewest first, two sets as similar as that must share one of their first
15 %, and the smaller one (or either of two equal ones) one of its first 8 %; the places also bound what they can share at
most. Pairs that share a band key and such a shingle, with sizes that allow the similarity, go the same way as the others.
No candidate link is left out by this, and texts that share a template, but differ elsewhere by more than the threshold
allows, don't meet.

A shingle that more than CROWD members outside its commonest component hold lists no pairs: what it would list grows with
their square. Texts with such a shingle among their first 15 % are crowded, and two crowded texts meet by MinHash once more, over their rarest
shingles only (`crowded`), where texts of one template have little in common, and linked ones must have much.

At a similarity of 0.85 a pair shares no band with probability (1 - 0.85**6)**26, about 5e-6; the screen lets
through estimates down to 0.18 below the threshold (3 standard deviations). A pair of crowded texts is missed with
probability 1e-5 at most beside that.

Whatever share of the rows a band key, a leader, a class or a component holds, its rows are dealt over many tasks: hot
keys are looked up by a broadcast of those few, and a leader's text goes to as many places as there are shuffle
partitions at most, where it meets its members one after another.

Rows: null text, blank text and empty tables give empty sets, linked with nothing. A null id is linked with
nothing and has no component; its row is kept. Rows of one id are one document, and each is returned; if their texts
differ, the one whose set comes first by digest speaks for the id in the links, and each row has its own n_shingles.
Long texts are taken whole; equal texts tie by id. Other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import crowded
from .common import col, hot_keys, looked_up, met, ready, small, spare, spread, written
from .components import connected_components
from .kernels import BITS, U, Words, begin, class_table, estimate, mix, slices, stream

SHINGLE, PERMUTATIONS, BANDS, ROWS = 5, 160, 26, 6
MARGIN = 0.18
#: Holders outside its commonest component that a shingle may have at most to list pairs; beyond, texts meet as crowded ones do.
CROWD = 24
WORD = class_table([(0x20, 0x20), (0x09, 0x0D)])
_weights = stream(SHINGLE + 1, 2)
_a = (stream(1024, 3) >> U(32)).astype(np.uint32) | np.uint32(1)
_b = (stream(1024, 4) >> U(32)).astype(np.uint32)
_band = stream(ROWS, 5)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes (64 bits): words lower-cased in A-Z, whole texts."""
    for _, _, data, origin in slices(texts):
        w = Words(data, origin, WORD)
        n = len(w.hash)
        windows = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            windows += w.hash[k : n - SHINGLE + 1 + k] * _weights[k] if len(windows) else U(0)
        windows = mix(windows)
        for a, b in zip(w.first[:-1], w.first[1:]):
            if b - a >= SHINGLE:
                yield np.unique(windows[a : b - SHINGLE + 1])
            elif b > a:
                yield mix((w.hash[a:b] * _weights[: b - a]).sum(dtype=np.uint64, keepdims=True) + _weights[SHINGLE:] * U(b - a))
            else:
                yield np.zeros(0, np.uint64)


def minima(s: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The smallest value of each of the first permutations over a set that isn't empty."""
    h, out = (s >> U(32)).astype(np.uint32), None
    for k in range(0, len(h), 4096):
        m = (_a[:permutations, None] * h[None, k : k + 4096] + _b[:permutations, None]).min(axis=1)
        out = m if out is None else np.minimum(out, m)
    return out


def signature(s: np.ndarray) -> tuple[list, list]:
    """Band keys and the packed sketch."""
    m = minima(s)
    rows = m[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    keys = mix((mix(rows + _band[None, :]) * _band[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64), packed(m)


def packed(m: np.ndarray) -> np.ndarray:
    """The lowest bits of mixed minima, as many to a long as fit."""
    low, per = mix(m.astype(np.uint64)) & U((1 << BITS) - 1), 64 // BITS
    out = np.zeros((len(m) + per - 1) // per * per, np.uint64)
    out[: len(m)] = low
    return (out.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * U(BITS))[None, :]).sum(axis=1, dtype=np.uint64).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("near_dedup")
    for batch in batches:
        n, digest, bands, sketch = [], [], [], []
        for s in shingle_sets(batch.column(2)):
            n.append(len(s))
            if len(s):
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                k, p = signature(s)
                bands.append(k)
                sketch.append(p)
            else:
                digest.append(None)
                bands.append(None)
                sketch.append(None)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, longs), pa.array(sketch, longs)], ["id", "h", "n", "digest", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("near_dedup")
    for batch in batches:
        sets = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])


def _confirm(percent: int):
    """Of sorted rows (a, place, b, t), where b is null in the row with a's text, the pairs that are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near_dedup")
        leader, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for a, b, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(3))):
                if b is None:
                    leader, x = a, y
                    ok.append(False)
                    continue
                if a != leader:
                    raise ValueError(f"no text for {a}")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep)], ["a", "b"])

    return confirm


def _near(n_a: str, n_b: str, percent: int) -> Column:
    """Sizes alone allow the similarity, and the sketches don't speak against it."""
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (estimate(F.col("sketch_a"), F.col("sketch_b")) >= percent / 100 - MARGIN)


def _common_band() -> Column:
    """Both sides have a band key in common."""
    return F.coalesce(*[F.when(F.col("bands_a")[k] == F.col("bands_b")[k], True) for k in range(BANDS)], F.lit(False))


def _links(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of ids those whose full sets are similar enough; texts: (id, t).

    A leader's pairs are dealt over places, as many as shuffle partitions at most; its text goes once to each.
    """
    places = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(places)).cast("int").alias("place"), "b")
    asked = written(pairs.select("a", "place").distinct().withColumn("b", F.lit(None).cast("long")).unionByName(pairs), "asked")
    who = F.coalesce("b", "a")
    ids = written(asked.select(who.alias("id")).distinct(), "asked-ids")
    held = written(texts.join(small(ids), "id", "left_semi").dropDuplicates(["id"]), "texts")
    rows = asked.withColumn("id", who).join(held, "id").select("a", "place", "b", "t")
    return rows.repartition("a", "place").sortWithinPartitions("a", "place", F.col("b").asc_nulls_first()).mapInArrow(_confirm(percent), "a long, b long")


def _rare_pairs(sets: DataFrame, percent: int, stars: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of different components that may be similar; sets: (id, comp, shingles), an id once.

    Pairs that share a shingle rare enough, and crowded pairs; of those, the ones in one component of stars (a, b), or any.
    """
    posts = sets.select("id", "comp", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("w"))
    times = written(posts.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"), "times")
    held = looked_up(posts, times.withColumnRenamed("n", "times"), "w", hot_keys("w", counted=times))
    # Shingles of one holder come first; they pair nothing, but take places.
    of_id = Window.partitionBy("id")
    place = F.col("n") - F.count("*").over(of_id) + F.row_number().over(of_id.orderBy("times", "w")) - 1
    first = lambda part, whole: F.col("n") - F.expr(f"({part} * n + {whole - 1}) div {whole}") + 1
    near = held.select("id", "comp", "n", "w", place.alias("place")).where(F.col("place") < first(percent, 100))
    near = written(near.withColumn("inner", F.col("place") < first(2 * percent, 100 + percent)), "rare")
    # Of each shingle's holders, those of its commonest component meet only the others.
    split = near.groupBy("w", "comp").agg(F.count("*").alias("m")).groupBy("w").agg(F.max_by("comp", F.struct("m", "comp")).alias("major"), (F.sum("m") - F.max("m")).alias("others"), F.sum("m").alias("n"))
    split = written(split.where("others > 0"), "split")
    near = written(looked_up(near, split.select("w", "major", "others", spread(F.col("n")).alias("tasks")), "w", hot_keys("w", counted=split.select("w", "n"))), "rare-split")
    many = written(near.where(F.col("others") > CROWD).select("id").distinct(), "crowded")
    near = near.where(F.col("others") <= CROWD)
    step = log(100 / percent) * 1.0001 if percent < 100 else 1.0
    grade = F.floor(F.log("n") / F.lit(step)).cast("int")
    x = near.where("inner").select("w", "tasks", "place", grade.alias("grade"), F.col("id").alias("i"), F.col("n").alias("n_x"), F.col("comp").alias("c_x"), (F.col("comp") != F.col("major")).alias("minor_x"))
    y = near.select("w", "tasks", F.explode(F.array(grade, grade - 1)).alias("grade"), F.col("place").alias("place_y"), F.col("id").alias("j"), F.col("n").alias("n_y"), F.col("comp").alias("c_y"), (F.col("comp") != F.col("major")).alias("minor_y"))
    sizes = ((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("i") < F.col("j")))) & (100 * F.col("n_x") >= percent * F.col("n_y"))
    most = F.least(F.col("n_x") - F.col("place"), F.col("n_y") - F.col("place_y"))  # what they can share from their first common shingle on
    on = (F.col("c_x") != F.col("c_y")) & sizes & ((100 + percent) * most >= percent * (F.col("n_x") + F.col("n_y")))
    found = met(x.where("minor_x"), y, ["w", "grade"], "j", "tasks").where(on).unionByName(met(y.where("minor_y"), x.where("not minor_x"), ["w", "grade"], "i", "tasks").where(on))
    found = found.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    if not many.isEmpty():
        of = held.select("id", "comp", "n", "w", "times").join(small(many), "id", "left_semi")
        together = None if stars is None else connected_components(stars, "clusters").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
        found = found.unionByName(crowded.pairs(of, together, percent))
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row; links: 100 * intersection >= percent * union.

    id_col must be of an integer type. The smallest id of a component is its class.
    """
    ready(docs.sparkSession)
    own = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("t"))
    features = own.select("id", F.xxhash64("t").alias("h"), "t").mapInArrow(_features, "id long, h long, n long, digest binary, bands array<long>, sketch array<long>")
    features = written(features, "features")
    held, texts = features.where("n > 0 and id is not null"), own.where("id is not null")
    several = written(held.groupBy("id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("id"), "several")
    others = None
    if not several.isEmpty():  # ids with different texts
        of = held.join(small(several), "id", "left_semi").select("id", "h", "digest").distinct()
        one = of.groupBy("id").agg(F.min(F.struct("digest", "h")).alias("one")).select("id", "one.h")
        others = written(of.select("id", "h").join(one, ["id", "h"], "left_anti"), "others")
        held = held.join(small(others), ["id", "h"], "left_anti")
        texts = texts.withColumn("h", F.xxhash64("t")).join(small(others), ["id", "h"], "left_anti").select("id", "t")
    classes = written(held.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = held.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id"])
    reps = written(reps.select("id", "n", "bands", "sketch"), "reps")
    banded = reps.select("id", F.explode("bands").alias("key"))
    groups = written(banded.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("n")).where("leader <> last"), "groups")
    members = looked_up(banded, groups.select("key", "leader", F.col("n").alias("m")), "key", hot_keys("key", counted=groups))
    members = written(members.where("id <> leader"), "members")

    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    together = written(members.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    stars = looked_up(together, side("a"), "a", hot_keys("a", together)).join(side("b"), "b").where(_near("n_a", "n_b", percent)).select("a", "b")
    stars = written(stars, "near-stars")
    links = written(_links(texts, stars, percent), "links")
    found = connected_components(links)

    # Groups whose members beside the leader lie in several components.
    known = members.where("m > 2").join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    known = written(known, "known")
    mixed = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
    mixed = written(mixed, "mixed")
    ids = written(looked_up(known, mixed.select("key"), "key", hot_keys("key", counted=mixed)).select("id", "comp").distinct(), "mixed-ids")
    if not ids.isEmpty():
        sets = texts.join(small(ids.select("id")), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets, "id long, shingles array<long>")
        rest = written(_rare_pairs(written(sets.join(ids, "id"), "sets"), percent, together).join(stars, ["a", "b"], "left_anti"), "rest")
        rest = looked_up(rest, side("a"), "a", hot_keys("a", rest))
        rest = written(rest.join(side("b"), "b").where(_common_band() & _near("n_a", "n_b", percent)).select("a", "b"), "near-rest")
        if not rest.isEmpty():
            found = connected_components(links.union(_links(texts, rest, percent)))

    of = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = features.select("id", "h", "n", F.coalesce("digest", F.encode(F.concat_ws(":", F.lit("none"), "id"), "UTF-8")).alias("digest"))
    out = looked_up(out, of, "digest", hot_keys("digest", counted=classes), "left")
    if others is not None:  # rows whose text doesn't speak for their id
        spoken = written(out.join(small(several), "id", "left_semi").join(small(others), ["id", "h"], "left_anti").where("component is not null").groupBy("id").agg(F.min("component").alias("of_id")), "spoken")
        out = out.join(small(spoken), "id", "left").withColumn("component", F.coalesce("of_id", "component"))
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """docs without the rows of documents that are not the first of their component; their columns as they were."""
    (gone,) = spare(docs, "gone")
    drop = near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col(id_col).alias(gone)).distinct()
    return docs.join(small(written(drop, "gone")), col(id_col) == F.col(gone), "left_anti")
