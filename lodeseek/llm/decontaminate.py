"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of texts. Its words become symbols: one for each word that occurs in a benchmark phrase, and
one separator for everything else and for the ends of texts (a phrase can't reach across it, so runs that are
shorter than the shortest phrase are left out without losing an occurrence). Over the symbols stand a suffix
array, the Burrows-Wheeler transform in a wavelet matrix with rank directories, and the positions of every
eighth symbol. Phrases are searched backwards, all at once; occurrences are located by stepping to a sampled
position; spans that touch are merged.

Phrases: every run of `window` consecutive words of an item; an item with fewer words, but not none, is one
phrase. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null or wordless texts have no words
and no hits; wordless items have no phrases; repeated items or rows each count for themselves; a null item id
counts as the empty string; an empty benchmark hits nothing, an empty table gives an empty one. A text longer than a
slice is a slice of its own and is searched whole; which of equal occurrences comes first makes no difference, as spans
are merged. Other columns pass through whatever their names.

How much the index holds: on the documents of sf0.1, runs of benchmark words that are long enough make 4 % of all words.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, ready, written
from .kernels import Words, begin, class_table, slices

WINDOW = 10
#: Every so many symbols a suffix position is kept.
SAMPLE = 8
WORD = class_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Items that one pass takes to every executor; more are taken in further passes. Also the bytes of their texts.
ITEMS_A_PASS, BYTES_A_PASS = 50_000, 64 << 20


class Phrases:
    """Distinct phrases of a block of items as rows of symbols 2.., by length, and the items of each phrase."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        texts = pa.array([t for _, t in items], pa.string())
        runs: dict[bytes, set[int]] = defaultdict(set)
        self.item = ["" if i is None else str(i) for i, _ in items]
        for a, _, data, origin in slices(texts):
            w = Words(data, origin, WORD)
            for k in range(len(origin) - 1):
                h = w.hash[w.first[k] : w.first[k + 1]]
                for j in range(max(1, len(h) - window + 1) if len(h) else 0):
                    runs[h[j : j + window].tobytes()].add(a + k)
        keys = sorted(runs, key=lambda x: (len(x), x))
        words = [np.frombuffer(x, np.uint64) for x in keys]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(x) for x in words}):
            ids = np.array([i for i, x in enumerate(words) if len(x) == n])
            self.by_length[n] = ids, np.searchsorted(self.vocabulary, np.stack([words[i] for i in ids])).astype(np.int64) + 2
        self.items_of = [np.array(sorted(runs[x]), np.int64) for x in keys]
        self.shortest = min(self.by_length, default=0)
        self.length = np.array([len(x) for x in words], np.int64)


class Wavelet:
    """Wavelet matrix over small integers with popcount rank directories."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.n, self.levels = len(s), max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            w = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(w)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)]))
            self.zeros.append(self.n - int(bit.sum()))
            s = np.concatenate([s[~bit], s[bit]])

    def ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        k = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][k] + np.bitwise_count(self.words[level][k] & low)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands among the first i symbols."""
        lo, hi = np.zeros_like(i), i
        for level in range(self.levels):
            up = (c >> (self.levels - 1 - level) & 1).astype(bool)
            a, b = self.ones(level, lo), self.ones(level, hi)
            lo = np.where(up, self.zeros[level] + a, lo - a)
            hi = np.where(up, self.zeros[level] + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions i, and how often each stands before its position."""
        c, lo = np.zeros_like(i), np.zeros_like(i)
        for level in range(self.levels):
            a, b = self.ones(level, lo), self.ones(level, i)
            up = (self.words[level][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            lo, i = np.where(up, self.zeros[level] + a, lo - a), np.where(up, self.zeros[level] + b, i - b)
            c = c << 1 | up
        return c, i - lo


class FMIndex:
    """Over symbols 1.. with a final 0."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        s = np.append(symbols, 0).astype(np.int64)
        n = len(s)
        rank, k = s, 1
        while True:  # sorts by prefixes of twice the length until all differ
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            k *= 2
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.wavelet = Wavelet(s[order - 1], sigma)
        sampled = order % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]
        self.sampled = sampled

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the sorted suffixes that begin with each phrase (all of one length): first and after the last."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.wavelet.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        dead = lo >= hi
        lo[dead] = hi[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, steps, live = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        at = rows.copy()
        while len(live):
            done = self.sampled[at[live]]
            hit = live[done]
            out[hit] = self.samples[self.marks[at[hit]]] + steps[hit]
            live = live[~done]
            c, before = self.wavelet.access(at[live])
            at[live] = self.first[c] + before
            steps[live] += 1
        return out


def occurrences(w: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word index, phrase) of every occurrence of a phrase in the slice's words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(w.hash) or not phrases.shortest:
        return none
    at = np.searchsorted(phrases.vocabulary, w.hash)
    at[at == len(phrases.vocabulary)] = 0
    symbol = np.where(phrases.vocabulary[at] == w.hash, at + 2, 1)
    # Runs of known words within a text; those of fewer words than the shortest phrase hold no occurrence.
    known = symbol > 1
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    edge = np.ones(len(symbol) + 1, bool)
    edge[1:-1] = (known[1:] != known[:-1]) | (text[1:] != text[:-1])
    bounds = np.flatnonzero(edge)
    a, b = bounds[:-1], bounds[1:]
    keep = known[a] & (b - a >= phrases.shortest)
    a, b = a[keep], b[keep]
    if not len(a):
        return none
    sizes = b - a + 1  # with a separator behind each run
    begins = np.cumsum(sizes) - sizes
    index = np.arange(int(sizes.sum())) - np.repeat(begins, sizes) + np.repeat(a, sizes)
    ends = begins + sizes - 1
    symbols = symbol[np.minimum(index, len(symbol) - 1)]
    symbols[ends] = 1
    fm = FMIndex(symbols, len(phrases.vocabulary) + 2)
    where, what = [], []
    for ids, rows in phrases.by_length.values():
        lo, hi = fm.ranges(rows)
        n = hi - lo
        if total := int(n.sum()):
            each = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
            where.append(index[fm.locate(each)])
            what.append(np.repeat(ids, n))
    return (np.concatenate(where), np.concatenate(what)) if where else none


def _pass(phrases: Phrases):
    """Adds to each row (row, text, n_words, spans, items) this block's word spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("decontaminate")
        for batch in batches:
            texts, old_spans, old_items = batch.column(1), batch.column(3), batch.column(4)
            n_words, spans, items = [], [], []
            for a, b, data, origin in slices(texts):
                w = Words(data, origin, WORD)
                where, what = occurrences(w, phrases)
                order = np.argsort(where, kind="stable")
                where, what = where[order], what[order]
                cut = np.searchsorted(where, w.first)
                n_words.extend(np.diff(w.first).tolist())
                for k in range(b - a):
                    x, p = where[cut[k] : cut[k + 1]], what[cut[k] : cut[k + 1]]
                    before, kept = old_spans[a + k].as_py() or [], old_items[a + k].as_py() or []
                    if len(x):
                        at = x - w.first[k]
                        before = merged(before + [list(s) for s in zip(at.tolist(), (at + phrases.length[p]).tolist())])
                        kept = kept + [phrases.item[i] for i in np.unique(np.concatenate([phrases.items_of[i] for i in np.unique(p)]))]
                    spans.append(before)
                    items.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), texts, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
                ["row", "text", "n_words", "spans", "items"],
            )

    return run


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From word spans: hit words, items' digest, and removal spans in code points."""
    for batch in batches:
        n_hit, n_items, digests, removal = [], [], [], []
        for k in range(batch.num_rows):
            spans, items = batch.column(3)[k].as_py() or [], sorted(batch.column(4)[k].as_py() or [])
            n_hit.append(sum(b - a for a, b in spans))
            n_items.append(len(items))
            digests.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            cuts: list[list[int]] = []
            if spans:
                for _, _, data, origin in slices(batch.column(1).slice(k, 1)):
                    w = Words(data, origin, WORD)
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    cuts = [[int(points[w.start[a]]), int(points[w.end[b - 1]])] for a, b in spans]
            removal.append(cuts)
        pairs = pa.list_(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), pa.array(removal, pairs)],
            ["row", "n_words", "n_hit", "n_items", "items_sha256", "spans"],
        )


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans [a, b) by start, overlapping and touching ones as one."""
    out: list[list[int]] = []
    for a, b in sorted(map(list, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded number and bytes, as they come."""
    block, size = [], 0
    for r in benchmark.select(col(item_col).cast("string"), col(text_col)).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "") * 4
        if len(block) >= ITEMS_A_PASS or size >= BYTES_A_PASS:
            yield block
            block, size = [], 0
    yield block


SPANS = T.ArrayType(T.ArrayType(T.LongType()))
STATE = (("text", T.StringType()), ("n_words", T.LongType()), ("spans", SPANS), ("items", T.ArrayType(T.StringType())))
REPORT = (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("spans", SPANS))


def hits(docs: DataFrame, benchmark: DataFrame, row: Column, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(row, n_words, n_hit, n_items, items_sha256, spans) for each row of docs.

    row: what stands for the row, of any type. spans: merged removal spans [start, end) in code points.
    Benchmarks beyond one block are searched in further passes over the same rows, one broadcast block at a time.
    """
    spark = ready(docs.sparkSession)
    state = docs.select(row.alias("row"), F.coalesce(col(text_col), F.lit("")).alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<array<long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    kind = state.schema["row"]
    schema = lambda fields: T.StructType([kind, *(T.StructField(n, t) for n, t in fields)])
    blocks = _blocks(benchmark, item_col, item_text)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        held = spark.sparkContext.broadcast(pickle.dumps(Phrases(block, window)))

        def run(batches: Iterator[pa.RecordBatch], held=held, last=after is None) -> Iterator[pa.RecordBatch]:
            found = _pass(pickle.loads(held.value))(batches)
            yield from _last(found) if last else found

        state = state.mapInArrow(run, schema(REPORT if after is None else STATE))
        if after is not None:  # the next pass starts from what this one has written
            state = written(state, "hits")
        block = after
    return state


def _of_rows(docs: DataFrame, benchmark: DataFrame, text_col: str, *options) -> DataFrame:
    """hits of whole rows: row is a struct of all columns of docs."""
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("whole"), col(text_col).alias("text"))
    return hits(rows, benchmark, F.col("whole"), "text", *options)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the contaminated rows; their columns as they were."""
    found = _of_rows(docs, benchmark, text_col, item_col, item_text, window).where("n_hit = 0")
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def excised(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the hit words cut out of their texts; no row goes."""
    found = _of_rows(docs, benchmark, text_col, item_col, item_text, window)
    text = F.col("row").getField(text_col)
    # What lies between the spans, in order.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s[1]))
    ends = F.concat(F.transform("spans", lambda s: s[0]), F.array(F.length(text).cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.substring(text, (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int")))
    cut = F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(text)
    return found.select(*[(cut if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
