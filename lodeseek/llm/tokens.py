"""Token ids as binary blocks: canonical length-limited Huffman codes from global counts.

Texts are tokenised once and their ids written to the shared folder. Counts of all ids give code lengths of at most
16 bits (or as many as it takes to tell the ids in use apart, where they are more than 65,536) by package-merge, and so
the canonical codes. Documents are dealt by ranges of ids and sorted; each task
packs whole documents into independent blocks, with a bit offset for every 256 symbols. Decoding reads a block
alone: all its checkpoints advance together, each looking as many bits as the longest code up in one table.

Block: magic, symbols, documents and checkpoint step as 32-bit numbers; documents' lengths (32 bits each); bit
offsets of the checkpoints (64 bits each); the bits. The code lengths stand in the row of each task's first block, so
each file can be read alone.

Files are Parquet with one block a row (part, block, docs, n_docs, n_tokens, code_lengths, data), written by Spark's
committer, so lost tasks leave nothing behind. A document's start is the sum of tokens before it: of its part (a
sum for each part, collected: as many numbers as parts), of its part's earlier blocks, and of its block.

The tokenizer adds no special tokens; id 0 ends each document. Null text is empty (its id 0 alone). A null id comes
first. Rows of equal id follow each other, ordered by their ids. Empty tables give empty ones. A text longer than a block
is a block of its own. Further columns, whatever their names, are left out: files hold the id column and token ids.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, col, fresh_path, ready, written
from . import kernels

MAX_BITS, STEP, BLOCK_TOKENS, MAGIC = 16, 256, 1 << 18, 0x4C484246
END = 0
#: Distinct pieces that a worker keeps with their ids; at that number it starts anew. As many wait at first sight.
KEPT_PIECES, KEPT_HEADS, LONGEST = 700_000, 60_000, 64
SIGNS = ".,;:!?"


def tokenizer_file() -> str:
    """The default vocabulary file; pass another path where it lies elsewhere."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces(dict):
    """ids, as little-endian 32-bit numbers, of pieces seen so far: what follows `lead` (a space, or nothing) up to the next space.

    A piece is kept for good at its second sight; until then it waits among the young, which are dropped when they are
    many, so words that occur once don't fill the memory.

    A piece with one line break between other characters is cut there; letters are cut from closing signs; a word of
    letters is one unit of the pre-tokenizer and goes to the library's model at once; any other piece goes through the
    whole library.
    """

    def __init__(self, owner: "Tokenizer", lead: str, most: int):
        self.owner, self.lead, self.most, self.young = owner, lead, most, {}
        self.mark = "\u0120" if lead else ""

    def keep(self, p: str, ids: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[p] = ids
        return ids

    def __missing__(self, p: str) -> bytes:
        if (ids := self.young.pop(p, None)) is not None:
            return self.keep(p, ids)
        i = p.find("\n")
        if i >= 0:
            if 0 < i < len(p) - 1 and p.find("\n", i + 1) < 0 and not p[i - 1].isspace() and not p[i + 1].isspace():
                return self[p[:i]] + self.owner.line_break + self.owner.heads[p[i + 1 :]]
            return self.owner.whole(self.lead + p)
        core = p.rstrip(SIGNS)
        n = len(core)
        if 0 < n and len(p) < LONGEST and core.isalpha():
            if n < len(p):
                known = core in self
                ids = self[core] + self.owner.signs(p[n:])
                return self.keep(p, ids) if known else ids
            mapped = self.mark + (p if p.isascii() else "".join(map(self.owner.alphabet.__getitem__, p.encode())))
            ids = array("I", [t.id for t in self.owner.model.tokenize(mapped)]).tobytes()
        else:
            ids = self.owner.whole(self.lead + p)
        if len(p) < LONGEST:
            if len(self.young) >= self.most:
                self.young.clear()
            self.young[p] = ids
        return ids


class Tokenizer:
    """The tokenizers library behind tables of pieces it has seen.

    Byte-level pre-tokenising cuts before each space that stands between two characters which aren't spaces, so a
    text without double spaces can be cut there and each piece tokenised alone. All other texts, and all texts of
    other kinds of tokenizers, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        config = json.loads(self.library.to_str())
        pre = config.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not config.get("normalizer") and config["model"]["type"] == "BPE"
        self.cuts = self.cuts and all(" " not in t["content"] and "\n" not in t["content"] and not t["content"].rstrip(SIGNS).isalpha() and not t["lstrip"] and not t["rstrip"] for t in config.get("added_tokens", []))
        self.model = self.library.model
        # Byte-level alphabet: printable bytes stand for themselves, others for the characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}
        self.tails, self.heads = Pieces(self, " ", KEPT_PIECES), Pieces(self, "", KEPT_HEADS)
        self.signs = lru_cache(1 << 12)(self.whole)
        self.line_break = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not self.cuts or "  " in text:
            return self.whole(text)
        head, *rest = text.split(" ")
        return b"".join([self.heads[head] if head else b"", *map(self.tails.__getitem__, rest)])


@lru_cache(1)
def tokenizer(path: str) -> Tokenizer:
    """The worker's tokenizer, kept from task to task until another operator's task comes."""
    return Tokenizer(path)


kernels.keeps("tokens", lambda: tokenizer.cache_info().currsize > 0, tokenizer.cache_clear)


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids, counts): a row with null counts for each text, ids with the closing END, 16-bit ones where they fit.

    Each task adds a row that has only counts: ids that occurred and how often, as 64-bit pairs.
    """
    path = path or tokenizer_file()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.begin("tokens")
        t, names, n, kind = tokenizer(path), ["id", "ids", "counts"], np.zeros(0, np.int64), pa.null()
        for batch in batches:
            ids, kind = [np.frombuffer(t.ids(x.as_py() or "") + end, "<u4") for x in batch.column(1)], batch.column(0).type
            if ids:
                n = added(n, np.bincount(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([narrowed(x) for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        if len(used := np.flatnonzero(n)):
            pairs = np.stack([used, n[used]], axis=1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())], names)

    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids binary, counts binary")


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of two count vectors of different lengths."""
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return out


def narrowed(ids: np.ndarray) -> bytes:
    """A byte for the width, and the ids with 2 or 4 bytes each."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of some tasks as rows (token, n)."""
    n = np.zeros(0, np.int64)
    for batch in batches:
        for x in batch.column(0):
            token, k = np.frombuffer(x.as_py(), "<i8").reshape(-1, 2).T
            n = added(n, np.bincount(token, weights=k).astype(np.int64))
    ids = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n[ids], pa.int64())], ["token", "n"])


def code_lengths(counts: np.ndarray, most: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most `most` bits (package-merge); 0 for ids that don't occur.

    Default: MAX_BITS, or what the number of ids in use takes.
    """
    used = np.flatnonzero(counts)
    most = max(MAX_BITS, int(len(used) - 1).bit_length()) if most is None else most
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids don't fit into codes of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # Each level: single ids merged with the pairs of the level below; how many singles are in the first so many tells the lengths.
    levels, pairs = [], np.zeros(0)
    for _ in range(most):
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weight))
        merged = both[rank]
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(used) - 2
    for single in reversed(levels):
        ones = int(single[:take].sum())
        out[order[:ones]] += 1
        take = 2 * (take - ones)
    return out


class Codes:
    """Canonical codes from code lengths: shorter first, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.bits = max(MAX_BITS, int(lengths.max(initial=0)))
        self.span = 24 if self.bits <= 17 else 32  # bits from a code's first byte on that hold it whole
        if self.bits > 25:
            raise ValueError(f"codes of {self.bits} bits")
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        n = lengths[order].astype(np.int64)
        self.codes = np.zeros(len(lengths), np.uint32)
        starts = np.concatenate([[0], np.cumsum(np.int64(1) << (self.bits - n))])
        self.codes[order] = (starts[:-1] >> (self.bits - n)).astype(np.uint32)
        # The table: for each so many bits the id that they begin with; bits that begin no code are of id 0 and never met.
        self.table = np.zeros(1 << self.bits, np.uint32)
        self.table[: starts[-1]] = np.repeat(order, np.diff(starts))

    def encode(self, ids: np.ndarray, stretch: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, most significant bit first, and the bit offset of each symbol (one more at the end).

        A stretch of symbols at a time stays in the processor's cache. Each code lies within the `span` bits that begin at
        its first byte; bits of different codes never meet, so sums are unions: codes that begin in the same byte are
        added, then each of the span's bytes goes to its place.
        """
        n = self.lengths[ids]
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, dtype=np.int64, out=at[1:])
        size = (int(at[-1]) + 7) // 8
        span = np.uint32(self.span)
        out = np.zeros(size + self.span // 8, np.uint8)
        for a in range(0, len(ids), stretch):
            part = ids[a : a + stretch]
            here = at[a : a + len(part)]
            value = self.codes[part] << (span - (here & 7).astype(np.uint32) - n[a : a + stretch])
            byte = here >> 3
            starts = np.flatnonzero(np.diff(byte, prepend=-1))
            sums, where = np.add.reduceat(value, starts), byte[starts]
            for k in range(self.span // 8):
                out[where + k] |= (sums >> np.uint32(self.span - 8 - 8 * k)).astype(np.uint8)
        return out[:size], at

    def decode(self, data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
        """n ids from bytes and the bit offsets of every STEP-th symbol; all stretches advance together."""
        wide = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
        words = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
        if self.span == 32:
            words = words[:-1] << np.uint32(8) | wide[3:]
        rest, mask = np.uint32(self.span - self.bits), np.uint32((1 << self.bits) - 1)
        out = np.zeros((len(offsets), STEP), np.uint32)
        at, left = offsets.astype(np.int64), np.full(len(offsets), STEP)
        if len(offsets):
            left[-1] = n - STEP * (len(offsets) - 1)
        for k in range(min(STEP, n)):
            if k >= left[-1] and len(at) == len(offsets):
                at = at[:-1]  # the last stretch is over
                if not len(at):
                    break
            ids = self.table[words[at >> 3] >> (rest - (at & 7).astype(np.uint32)) & mask]
            out[: len(at), k] = ids
            at = at + self.lengths[ids]
        return out.reshape(-1)[:n] if len(offsets) else out.reshape(-1)


def packed(ids: np.ndarray, sizes: np.ndarray, codes: Codes) -> bytes:
    """A block: header, documents' lengths, checkpoints, bits."""
    bits, at = codes.encode(ids)
    head = np.array([MAGIC, len(ids), len(sizes), STEP], "<u4").tobytes()
    return head + sizes.astype("<u4").tobytes() + at[:-1:STEP].astype("<u8").tobytes() + bits.tobytes()


def unpacked(block: bytes, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block, and the documents' lengths."""
    magic, n, docs, step = np.frombuffer(block, "<u4", 4).tolist()
    if magic != MAGIC or step != STEP:
        raise ValueError("not a block")
    sizes = np.frombuffer(block, "<u4", docs, 16)
    marks = (n + STEP - 1) // STEP
    offsets = np.frombuffer(block, "<u8", marks, 16 + 4 * docs)
    ids = codes.decode(np.frombuffer(block, np.uint8, offset=16 + 4 * docs + 8 * marks), offsets, n)
    if int(sizes.sum()) != n:
        raise ValueError("lengths don't add up")
    return ids, sizes


BLOCKS = "part int, block int, docs array<{0}>, n_docs int, n_tokens long, code_lengths binary, data binary"


def write_files(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, parts: int | None = None) -> str:
    """Writes the ids of docs in ascending order of id_col as files below out; gives out."""
    spark = ready(docs.sparkSession)
    ids = written(tokenised(docs, id_col, text_col, path), "ids")
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ids.where("counts is not null").select("counts").mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    n = np.zeros(max((r.token for r in counts), default=0) + 1, np.int64)
    for r in counts:
        n[r.token] = r.n
    held = spark.sparkContext.broadcast(zlib.compress(code_lengths(n).tobytes()))
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, part, block = zlib.decompress(held.value), TaskContext.get().partitionId(), 0
        codes = Codes(np.frombuffer(lengths, np.uint8))
        names, rows, size = [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in rows], np.int64)
            data = packed(np.concatenate(rows), sizes, codes)
            one = [[part], [block], [names], [len(names)], [size], [None if block else held.value], [data]]
            types = [pa.int32(), pa.int32(), pa.list_(of), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, types)], ["part", "block", "docs", "n_docs", "n_tokens", "code_lengths", "data"])

        of = pa.null()
        for batch in batches:
            of = batch.column(0).type
            for name, data in zip(batch.column(0), batch.column(1)):
                x = widened(data.as_py())
                if rows and size + len(x) > BLOCK_TOKENS:
                    yield flush()
                    names, rows, size, block = [], [], 0, block + 1
                names.append(name.as_py())
                rows.append(x)
                size += len(x)
        if rows:
            yield flush()

    dealt = ids.where("counts is null").select("id", "ids").repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "ids")
    dealt.mapInArrow(run, BLOCKS.format(kind)).write.option("compression", "none").parquet(out)
    return out


def read_files(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) of each document of the files below out; ids as little-endian 32-bit numbers."""
    ready(spark)
    files = spark.read.parquet(out)
    kind = files.schema["docs"].dataType.elementType.simpleString()
    code = files.where("code_lengths is not null").select("code_lengths").limit(1).collect()
    held = spark.sparkContext.broadcast(code[0][0] if code else zlib.compress(b""))
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each part
    before, total = {}, 0
    for r in sorted(sums):
        before[r.part], total = total, total + r.n
    of_parts = spark.sparkContext.broadcast(before)
    index = files.select("part", "block", "n_tokens")
    index = index.select("part", "block", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    blocks = files.drop("code_lengths").join(F.broadcast(index) if index.count() <= BROADCAST_ROWS else index, ["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(np.frombuffer(zlib.decompress(held.value), np.uint8))
        for batch in batches:
            for part, names, start, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                ids, sizes = unpacked(data.as_py(), codes)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4").tobytes()
                cut = [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist())]
                starts = (ends - sizes).astype(np.int64) + start + of_parts.value[part]
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array(starts, pa.int64()), pa.array(sizes.astype(np.int64), pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(cut if with_ids else [None] * len(cut), pa.binary())],
                    ["id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.select("part", "docs", "start", "data").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document, from files that were written and read back."""
    out = write_files(docs, fresh_path(docs.sparkSession, "tokens"), id_col, text_col, path)
    return read_files(docs.sparkSession, out, with_ids=False).select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")
