"""Passages that repeat anywhere in a corpus, by column-wise construction of a collection's Burrows-Wheeler transform.

A string of `length` bytes repeats if it starts at two places. Equal strings have equal least grams: of the hashes of
all grams of length // 3 bytes within a string, the smallest (the first of equal ones) stands at the same offset. So every text
is cut into pieces, runs of string starts that share one least gram, and strings can only be equal in pieces of equal gram,
at equal offsets from it. Equal pieces are one class with a number; classes whose gram no other class has are decided by
that number. All others form collections, one for each gram, with their strings aligned at the gram:

The collection's transform is built column by column, from the last to the first. Each round inserts one symbol of each
string: the order of the suffixes that begin in the column comes from the order of those that begin in the next one, by a
stable sort on the inserted symbols, and common prefixes with the neighbour come from those before by a least value over a
range. As equal strings begin in the same column, no other column's suffixes need to be compared. Strings with a common prefix
of `length` bytes with a neighbour repeat. Collections are sorted by gram on disk (Spark's sorted shuffle files) and read
once in sequence; a task holds about BLOCK strings of length + 2 * (length - gram) bytes at most, whatever the size of the corpus.

A gram with more than MOST classes (the edge of a passage that very many texts share, say) would be a collection in one
task: there the strings themselves are counted by their 128-bit digests, dealt over all tasks. Texts of a short period give
equal pieces one after another, which are one row with a number.

Symbols are bytes, or words `[^\x20\x09-\x0D]+` by their 64-bit hashes: with `words`, strings of so many words that start at
two places are found too, by the same steps. They are told as passages beside the spans, and remove nothing.

Texts are UTF-8 bytes, taken whole, and long ones in stretches of bounded memory. Null and empty texts have no bytes; texts
shorter than `length` lose nothing. Matches never cross texts. Each row counts as a text, also with an equal or null id.
Equal texts repeat each other, so they lose all bytes. Empty tables give empty ones. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, hot_keys, looked_up, ready, small, written
from .kernels import BYTE, SLICE_BYTES, U, Words, begin, class_table, mix, powers, slices

LENGTH, WORDS, BLOCK, MOST = 400, 50, 4096, 4096
WORD = class_table([(0x20, 0x20), (0x09, 0x0D)])
PLACE = (1 << 24) - 1
END = 256
PIECE = "doc binary, tag long, key long, digest long, start int, n int, shift int, times int"


def symbols(texts: pa.Array, words: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, symbols, texts' limits in them) of each slice of a column; the words of a long text come part by part."""
    for s, _, data, origin in slices(texts):
        if not words:
            yield s, data, origin
        elif len(data) <= SLICE_BYTES:
            w = Words(data, origin, WORD, lower=False)
            yield s, w.hash, w.first
        else:
            found, a = [], 0
            while a < len(data):
                b = a + SLICE_BYTES
                while b < len(data) and not len(gaps := np.flatnonzero(~WORD[data[a:b]])):
                    b += b - a  # a word longer than the part
                b = a + gaps[-1] + 1 if b < len(data) else len(data)
                found.append(Words(data[a:b], np.array([0, b - a]), WORD, lower=False).hash)
                a = b
            found = np.concatenate(found)
            yield s, found, np.array([0, len(found)])


def stretches(data: np.ndarray, origin: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first symbol, symbols, texts' limits in them) of a slice; a long text in parts that overlap by length - 1 symbols."""
    if len(data) <= SLICE_BYTES:
        yield 0, data, origin
        return
    for a in range(0, len(data), SLICE_BYTES):
        part = data[a : a + SLICE_BYTES + length - 1]
        yield a, part, np.array([0, len(part)])


def least(x: np.ndarray, w: int) -> np.ndarray:
    """The least value of each w neighbours, from running minima of blocks of w forwards and backwards."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def pieces(data: np.ndarray, origin: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of some texts' symbols the pieces: (text, start, n, shift, key, digest, times).

    A piece has the n strings that start at `start` and after; its gram stands `shift` symbols behind the start. `times`
    equal pieces follow each other, each n symbols after the one before.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((BYTE[data] if data.dtype == np.uint8 else data) * up[:n], dtype=np.uint64, out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    at = (least(h & U(~PLACE & (1 << 64) - 1) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & U(PLACE)).astype(np.int64)
    long = np.flatnonzero(np.diff(origin) >= length)
    edge = np.zeros(len(at) + 1, np.int64)
    edge[origin[long]] += 1
    edge[origin[long + 1] - length + 1] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    head = inside.copy()
    head[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
    start = np.flatnonzero(head)
    stop = np.flatnonzero(inside & np.concatenate([~inside[1:] | head[1:], [True]])) + 1
    size, shift = stop - start, at[start] - start
    key = h[at[start]]
    digest = mix((total[stop + length - 1] - total[start]) * down[start] + size.astype(np.uint64) * U(0x9E3779B97F4A7C15) + shift.astype(np.uint64))
    text = np.searchsorted(origin, start, side="right") - 1
    first = np.ones(len(start), bool)
    first[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]) | (start[1:] != start[:-1] + size[:-1])
    heads = np.flatnonzero(first)
    times = np.diff(np.append(heads, len(start)))
    return tuple(x[heads] for x in (text, start, size, shift, key.view(np.int64), digest.view(np.int64))) + (times,)


def _pieces(length: int, gram: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("repeats")
        for batch in batches:
            for s, data, origin in symbols(batch.column(2), words):
                for a, part, limits in stretches(data, origin, length):
                    text, start, n, shift, key, digest, times = pieces(part, limits, length, gram)
                    row = pa.array(text + s)
                    start = start + a - (limits[text] if len(limits) > 2 or not a else 0)
                    ints = [pa.array(x, pa.int32()) for x in (start, n, shift, times)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(key), pa.array(digest), *ints], [f.split()[0] for f in PIECE.split(", ")])

    return run


def columns(strings: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, order, common) from the last column to the first: the collections' transform and common prefixes.

    strings: a row a string, END where it has no symbol; group: its collection, ascending. order: the strings by collection
    and the suffix that begins in the column, so the transform is the column before in this order. common: the
    symbols that a string's suffix shares with that of the one before, of its collection.
    """
    rows, wide = strings.shape
    order, common = np.arange(rows), np.zeros(rows, np.int16)
    by_column = np.ascontiguousarray(strings.T)
    group = group.astype(np.uint16) if not rows or group[-1] < 1 << 16 else group
    same_group = np.concatenate([[False], group[1:] == group[:-1]])
    largest = int(np.bincount(group).max(initial=1))
    log = np.zeros(largest + 1, np.int64)
    for k in range(2, largest + 1):
        log[k] = log[k // 2] + 1
    for t in range(wide - 1, -1, -1):
        symbol = by_column[t][order]
        rank = np.argsort(symbol, kind="stable")
        rank = rank[np.argsort(group[rank], kind="stable")]  # by collection, then symbol, then the order before
        symbol = symbol[rank]
        meet = np.flatnonzero(same_group & np.concatenate([[False], (symbol[1:] == symbol[:-1]) & (symbol[1:] != END)]))
        after = np.zeros(rows, np.int16)
        if len(meet):
            # The least common prefix between the two in the order before, by two overlapping powers of two.
            levels = [common]
            while 2 << len(levels) - 1 <= largest:
                x, half = levels[-1], 1 << len(levels) - 1
                levels.append(np.minimum(x, np.concatenate([x[half:], np.full(half, np.iinfo(np.int16).max, np.int16)])[: len(x)]))
            table = np.stack(levels)
            low, high = rank[meet - 1] + 1, rank[meet]
            level = log[high - low + 1]
            after[meet] = 1 + np.minimum(table[level, low], table[level, high - (1 << level) + 1])
        order, common = order[rank], after
        yield t, order, common


def repeated(strings: list[bytes], n: np.ndarray, shift: np.ndarray, times: np.ndarray, group: np.ndarray, length: int, gram: int, wide: int = 1) -> list[np.ndarray]:
    """For each piece which of its n strings repeat; pieces are sorted by group (their gram). wide: bytes a symbol."""
    free = length - gram
    codes = np.frombuffer(b"".join(strings), np.uint8 if wide == 1 else np.uint64)
    if wide > 1:
        codes = np.unique(codes, return_inverse=True)[1]
        codes = codes + (codes >= END)
    matrix = np.full((len(strings), length + free), END, np.uint16 if codes.max(initial=0) < 1 << 16 else np.uint32)
    at = np.cumsum([0, *(len(s) // wide for s in strings)]).tolist()
    for row, a, b, d in zip(matrix, at, at[1:], (free - shift).tolist()):
        row[d : d + b - a] = codes[a:b]
    hit = np.zeros((free + 1, len(strings)), bool)
    for t, order, common in columns(matrix, group):
        if t <= free:
            long = common >= length
            hit[t, order] = long | np.concatenate([long[1:], [False]])
    return [np.full(k, True) if many > 1 else hit[free - d : free - d + k, i] for i, (k, d, many) in enumerate(zip(n.tolist(), shift.tolist(), times.tolist()))]


def runs(flags: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """First symbols, and symbols after the last, of what the strings that are flagged cover."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + length - 1).tolist()


SPANS = "key long, digest long, first array<int>, last array<int>"


def _transform(length: int, gram: int, wide: int):
    """Of sorted rows (key, digest, n, shift, times, string) the spans of each class, in blocks of whole collections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("repeats")
        held: list[tuple] = []

        def out(block: list[tuple]) -> pa.RecordBatch:
            key, digest, n, shift, times, strings = zip(*block)
            _, group = np.unique(np.array(key, np.int64), return_inverse=True)
            flags = repeated(list(strings), np.array(n), np.array(shift), np.array(times), group, length, gram, wide)
            first, last = zip(*[runs(f, length) for f in flags])
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(digest, pa.int64()), pa.array(first, ints), pa.array(last, ints)], ["key", "digest", "first", "last"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and row[:2] == held[-1][:2]:
                    continue  # a class that a repeated row has given again
                if len(held) >= BLOCK and row[0] != held[-1][0]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    return run


def _windows(length: int, wide: int):
    """Of rows (key, digest, n, times, string) each string's digest and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("repeats")
        for batch in batches:
            for key, digest, n, times, s in zip(*[c.to_pylist() for c in batch.columns]):
                found = [hashlib.blake2b(s[j * wide : (j + length) * wide], digest_size=16).digest() for j in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *[pa.array(np.full(n, x)) for x in (key, digest)], pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, times))], ["w", "key", "digest", "j", "times"])

    return run


def _counted(strings: DataFrame, length: int, wide: int) -> DataFrame:
    """The spans of classes whose gram very many share: each string counted by its digest, over all tasks."""
    windows = written(strings.dropDuplicates(["key", "digest"]).select("key", "digest", "n", "times", "string").mapInArrow(_windows(length, wide), "w binary, key long, digest long, j int, times long"), "windows")
    counts = windows.groupBy("w").agg(F.sum("times").alias("all"), F.count("*").alias("n"))
    counts = written(counts.where("all > 1"), "window-counts")
    hit = looked_up(windows, counts.select("w"), "w", hot_keys("w", counted=counts.select("w", "n")))
    places = hit.groupBy("key", "digest").agg(F.sort_array(F.collect_set("j")).alias("j"))  # as many as a piece has strings at most
    return places.select("key", "digest", F.col("j").alias("first"), F.transform("j", lambda j: j + length).alias("last"))


def _cut(words: bool):
    """Of rows (text, wanted pieces) the pieces with their symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("repeats")
        names = ["key", "digest", "n", "shift", "times"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            for first, data, limits in symbols(batch.column(0), words):
                held, wide = memoryview(data).cast("B") if len(data) else b"", data.itemsize
                for row, at in enumerate(limits[:-1].tolist(), first):
                    wanted = batch.column(1)[row].as_py()
                    for s in range(0, len(wanted), 4096):
                        some = wanted[s : s + 4096]
                        strings = pa.array([bytes(held[(at + w["start"]) * wide : (at + w["stop"]) * wide]) for w in some], pa.binary())
                        yield pa.RecordBatch.from_arrays([*[pa.array([w[c] for w in some], t) for c, t in zip(names, types)], strings], [*names, "string"])

    return run


def united(found: list[dict] | None) -> list[dict]:
    """Spans in any order as maximal runs."""
    out: list[dict] = []
    for s, e in sorted((x["start"], x["stop"]) for x in found or ()):
        if out and s <= out[-1]["stop"]:
            out[-1]["stop"] = max(e, out[-1]["stop"])
        else:
            out.append({"start": s, "stop": e})
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, text, spans in any order, or null, perhaps passages alike) the united spans, the bytes outside them and the united passages."""
    begin("repeats")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        spans, kept, sizes = [], [], []
        for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
            data, mine, at, left = text.as_buffer().to_pybytes() if text.is_valid else b"", united(found), 0, []
            for x in mine:
                left.append(data[at : x["start"]])
                at = x["stop"]
            spans.append(mine)
            kept.append(b"".join([*left, data[at:]]))
            sizes.append(len(data))
        passages = [pa.array([united(x) for x in c.to_pylist()], kind) for c in batch.columns[3:]]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), *passages], ["id", "n_bytes", "spans", "kept", *["passages"] * len(passages)])


def _covered(own: DataFrame, length: int, gram: int, words: bool = False) -> DataFrame:
    """(doc, spans) of each text with strings of length symbols that repeat: what they cover, in any order."""
    wide = 8 if words else 1
    least_bytes = 2 * length - 1 if words else length
    found = written(own.where(F.octet_length("text") >= least_bytes).select("doc", "tag", "text").mapInArrow(_pieces(length, gram, words), PIECE), "pieces")
    grams = written(found.groupBy("key").agg(F.sum("times").alias("n"), F.count("*").alias("rows"), (F.min("digest") != F.max("digest")).alias("mixed")).where("n > 1"), "grams")
    hot = hot_keys("key", counted=grams.select("key", F.col("rows").alias("n")))
    held = small(grams.select("key", "mixed"))
    found = written(found.join(held, "key") if hot is None else looked_up(found, grams.select("key", "mixed"), "key", hot), "repeated-grams")
    stop = lambda times: (F.col("start") + F.col("n") * times + length - 1).alias("stop")
    spans = found.where("not mixed").select("doc", "start", stop(F.col("times")))
    mixed = found.where("mixed")
    classes = mixed.groupBy("key", "digest").agg(F.sum("times").alias("times"), F.count("*").alias("rows"), F.min(F.struct("tag", "doc", "start", "n", "shift")).alias("at"))
    classes = written(classes.select("key", "digest", "times", "rows", "at.*", (F.col("at.start") + F.col("at.n") + length - 1).alias("stop")), "classes")
    wanted = classes.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "digest", "n", "shift", "times", "start", "stop")).alias("wanted"))  # a text's pieces at most
    of_texts = own.join(small(written(wanted, "wanted")), ["doc", "tag"]).select("text", "wanted")
    strings = written(of_texts.mapInArrow(_cut(words), "key long, digest long, n int, shift int, times long, string binary"), "strings")
    many = written(classes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("key"), "many")
    alone = strings.join(small(many), "key", "left_anti").repartition("key").sortWithinPartitions("key", "digest")
    of_classes = alone.select("key", "digest", "n", "shift", "times", "string").mapInArrow(_transform(length, gram, wide), SPANS)
    of_classes = of_classes.unionByName(_counted(strings.join(small(many), "key", "left_semi"), length, wide))
    of_classes = written(of_classes.where(F.size("first") > 0).select(F.struct("key", "digest").alias("class"), "first", "last"), "class-spans")
    hot = hot_keys("class", counted=classes.select(F.struct("key", "digest").alias("class"), F.col("rows").alias("n")))
    at = looked_up(mixed.withColumn("class", F.struct("key", "digest")), of_classes, "class", hot)
    # Equal pieces in a row make a class with a number, so all of it repeats.
    last = lambda x: F.col("start") + x + F.when(F.col("times") > 1, F.col("n") * (F.col("times") - 1)).otherwise(0)
    covered = at.select("doc", "start", "n", "times", F.explode(F.arrays_zip("first", "last")).alias("x")).select("doc", (F.col("start") + F.col("x.first")).alias("start"), last(F.col("x.last")).alias("stop"))
    return written(spans.unionByName(covered).groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, words: int | None = None) -> DataFrame:
    """(id, n_bytes, spans, kept) of each row: the maximal runs of bytes that repeated strings cover, and the other bytes.

    With words also passages, the maximal runs of words (numbers of the first and after the last) that repeated strings of so many words cover.
    """
    ready(docs.sparkSession)
    own = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).withColumns({"doc": F.unhex(F.md5("text")), "tag": F.xxhash64("id")})
    of_docs = _covered(own, length, gram or max(1, length // 3))
    if words:
        passages = _covered(own, words, max(1, words // 3), words=True).withColumnRenamed("spans", "passages")
        of_docs = written(of_docs.join(passages, "doc", "full"), "spans-and-passages")
    copies = hot_keys("doc", own.select("doc"))
    met = own.join(small(of_docs), "doc", "left") if copies is None else looked_up(own, of_docs, "doc", copies, "left")
    kind, spans = docs.schema[id_col].dataType.simpleString(), "array<struct<start:int,stop:int>>"
    return met.drop("doc", "tag").mapInArrow(_kept, f"id {kind}, n_bytes long, spans {spans}, kept binary" + (f", passages {spans}" if words else ""))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words) of each row.

    The last two are passages of WORDS words or more that start anywhere else too, some with fewer bytes than a span.
    """
    removed = F.col("n_bytes") - F.octet_length("kept")
    of_words = F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    found = repeats(docs, id_col, text_col, words=WORDS)
    base = (F.col("id").alias(id_col), "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return found.select(*base, F.size("passages").cast("long").alias("n_passages"), of_words.alias("n_passage_words"))
