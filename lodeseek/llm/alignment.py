"""Alignment of two tokenizers over the same bytes, a batch at a time.

Each text is tokenised by A and by B; the tokens of both spell the same bytes. The byte ends of all tokens of a batch of
texts, one text after another, are counted once for A and B together: a place counted twice ends a token of both and cuts
the tokens into groups; a place counted at least once ends an overlap of exactly one A token and one B token, a link.
Prefix sums over the places, taken at the texts' ends, give each text's numbers; the tokens that a link is of are how many
ends of A, and of B, lie before it.

How often an id pair is linked is counted over the whole corpus: a batch gives each text's distinct pairs with their
numbers, which are summed by pair, and looked up again by a join. Hot pairs are looked up by a broadcast of those few.

A is a byte-level BPE of the tokenizers library, over a space and the text; B is a sentencepiece model, which adds the space
itself. Texts that are null or empty, or whose tokens don't spell the space and the text (as a model that normalises, or
that takes U+2581 for a space, may do), have no tokens: zeros, no groups. Rows with equal or null ids each stand for
themselves; all are counted. Empty tables give empty ones. Texts of any length are taken whole; a long one is a batch of
its own. Further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import col, hot_keys, looked_up, ready, small, written
from .tokens import Tokenizer, tokenizer_file

BATCH_BYTES = 1 << 20


def pieces_file() -> str:
    """The default model of B; pass another path where it lies elsewhere."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """The bytes of ids 0 to n - 1, and the text of a list of ids with a sign after each."""

    def __init__(self, spelled: list[bytes], inner: str, last: str):
        self.spelled, self.n = spelled, len(spelled)
        self.length = np.array([len(x) for x in spelled], np.int64)
        # Decimal ids with the sign within a list, then those with the sign after its last one, as bytes of equal width.
        shown = np.array([f"{i}{sign}" for sign in (inner, last) for i in range(self.n)], "S")
        self.shown, self.width = shown.view(np.uint8).reshape(len(shown), -1), np.char.str_len(shown)

    def texts(self, ids: np.ndarray, is_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = ids + self.n * is_last
        return self.shown[at], self.width[at]


class Pair:
    """Both tokenizers: ids of a text, or none where they don't spell it."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.tokenizer = Tokenizer(path_a)
        self.tokenizer.library.encode_special_tokens = True
        byte = {c: b for b, c in self.tokenizer.alphabet.items()}
        names = sorted((i, t) for t, i in self.tokenizer.library.get_vocab(with_added_tokens=True).items())
        spelled = [b""] * (names[-1][0] + 1)
        for i, t in names:
            spelled[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.a = Vocabulary(spelled, ",", "|")
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        piece = self.pieces.id_to_piece
        self.b = Vocabulary([bytes([int(piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.pieces.get_piece_size())], ",", ";")

    def ids(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        none = np.zeros(0, np.int64)
        for t, b in zip(texts, self.pieces.encode([t or "" for t in texts], num_threads=1)):
            if not t:
                yield none, none
                continue
            whole, a = " " + t, np.frombuffer(self.tokenizer.ids(" " + t), "<u4").astype(np.int64)
            want = whole.encode()
            same = b"".join(map(self.a.spelled.__getitem__, a.tolist())) == want == b"".join(map(self.b.spelled.__getitem__, b))
            yield (a, np.array(b, np.int64)) if same else (none, none)


@lru_cache(1)
def pair(path_a: str, path_b: str) -> Pair:
    """The worker's tokenizers, kept from task to task until another operator's task comes."""
    return Pair(path_a, path_b)


kernels.keeps("alignment", lambda: pair.cache_info().currsize > 0, pair.cache_clear)


def aligned_batch(texts: list[str | None], p: Pair) -> tuple[np.ndarray, list[bytes], list[np.ndarray], list[np.ndarray]]:
    """Of each text: (n_a, n_b, n_groups, n_links); its groups as text; its distinct id pairs; how often each is linked."""
    ids = list(p.ids(texts))
    a, b = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in ids]]) for k in (0, 1))
    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    end_a, end_b = np.cumsum(p.a.length[a]), np.cumsum(p.b.length[b])
    first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    limits = np.concatenate([[0], end_a])[first_a]  # each text's first byte, and the end
    ends = np.bincount(np.concatenate([end_a, end_b]), minlength=int(limits[-1]) + 1)
    links, cuts = np.flatnonzero(ends), np.flatnonzero(ends == 2)
    # Ends up to a text's last byte, less those up to its first one.
    counted = [np.diff(np.searchsorted(x, limits, side="right")) for x in (cuts, links)]
    of_a, of_b = np.searchsorted(end_a, links), np.searchsorted(end_b, links)
    keys, where = a[of_a] * p.b.n + b[of_b], np.repeat(np.arange(len(texts)), counted[1])
    order = np.lexsort((keys, where))
    keys, where = keys[order], where[order]
    heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (where[1:] != where[:-1])])) if len(keys) else np.zeros(0, np.int64)
    times, of_text = np.diff(np.append(heads, len(keys))), np.searchsorted(where[heads], np.arange(len(texts) + 1))
    pairs = keys[heads]
    # The groups' text: A's tokens of a group, then B's, so a token stands after those of the other side's earlier groups.
    last_a, last_b = ends[end_a] == 2, ends[end_b] == 2
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    before = np.searchsorted(group_b, group_a)
    upto = np.searchsorted(group_a, group_b, side="right")
    place_a, place_b = np.arange(len(a)) + before, np.arange(len(b)) + upto
    (chars_a, width_a), (chars_b, width_b) = p.a.texts(a, last_a), p.b.texts(b, last_b)
    wide = max(chars_a.shape[1], chars_b.shape[1])
    chars, width = np.zeros((len(a) + len(b), wide), np.uint8), np.zeros(len(a) + len(b), np.int64)
    for place, c, w in ((place_a, chars_a, width_a), (place_b, chars_b, width_b)):
        chars[place, : c.shape[1]], width[place] = c, w
    flat = chars[np.arange(wide)[None, :] < width[:, None]].tobytes()
    at = np.concatenate([[0], np.cumsum(width)])[first_a + first_b]
    groups = [flat[s : max(s, e - 1)] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]  # without the last sign
    cut = lambda x: [x[s:e] for s, e in zip(of_text[:-1].tolist(), of_text[1:].tolist())]
    return np.stack([n_a, n_b, *counted]), groups, cut(pairs), cut(times)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times) of each row.

    groups: `a1,a2|b1;a3|b2,b3`, the ids of A and B of each group in order. pairs: the distinct linked id pairs as
    a * (number of B's ids) + b; times: how often each is linked in the text.
    """
    paths = path_a or tokenizer_file(), path_b or pieces_file()
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.begin("alignment")
        p, names = pair(*paths), ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
        for batch in batches:
            for s, e, _, _ in kernels.slices(batch.column(1), BATCH_BYTES):
                n, groups, pairs, times = aligned_batch(batch.column(1).slice(s, e - s).to_pylist(), p)
                of = [pa.array(groups, pa.binary()).cast(pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), *[pa.array(x, pa.int64()) for x in n], *of], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best) of all linked id pairs: links in the corpus, and whether no pair of the same B id has more.

    A B id has as many pairs as A has ids at most, so its window is bounded.
    """
    counts = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair") % n_b)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    n_b = pair(path_a or tokenizer_file(), path_b or pieces_file()).b.n
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    rows = aligned(docs, id_col, text_col, path_a, path_b).select("id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "alignment")
    counts = written(pair_counts(rows, n_b), "pair-counts")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    held = small(counts)
    links = links.join(held, "pair") if held is not counts else looked_up(links, counts, "pair", hot_keys("pair", counted=counts.select("pair", "n")))
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.drop("pairs", "times").join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
