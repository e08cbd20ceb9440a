"""NumPy kernels over Arrow text columns: words as hashes, whole batches at a time.

A batch is cut into slices of bounded bytes (a longer text is a slice of its own), so memory follows the
slice, not the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Freed Arrow buffers go back to the system, as JVM and Python share the executor's memory.
pa.set_memory_pool(pa.system_memory_pool())

#: What operators keep in a worker between their tasks, by operator: whether there is something, and how to drop it.
_kept: dict[str, tuple[Callable[[], bool], Callable[[], None]]] = {}


def keeps(owner: str, some: Callable[[], bool], drop: Callable[[], None]) -> None:
    """Tells that an operator keeps things in its worker between tasks."""
    _kept[owner] = some, drop


def begin(owner: str) -> None:
    """At a task's start: drops what other operators have kept in this worker, and gives the memory back."""
    gone = [drop for name, (some, drop) in _kept.items() if name != owner and some()]
    for drop in gone:
        drop()
    if gone:
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:
            pass  # another C library


SLICE_BYTES = 1 << 19
#: Bits of a minimum that sketches keep.
BITS = 2
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))


BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
BYTE = stream(256, 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n, kept while the worker lives."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
        if n > 2 * SLICE_BYTES:  # for one huge text only
            out = _powers[0], _powers[1]
            _powers[:] = [x[:1].copy() for x in out]
            return out
    return _powers[0][:n], _powers[1][:n]


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def class_table(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes of words, False for those in the excluded ranges (both ends included)."""
    t = np.ones(256, bool)
    for a, b in excluded:
        t[a : b + 1] = False
    return t


LOWER = lower_table()


class Words:
    """Words of the texts of a slice.

    hash: 64 bits a word; first: index of each text's first word, with one more entry at the end;
    start, end: byte positions of the words in `data`; origin: byte position of each text.
    """

    def __init__(self, data: np.ndarray, origin: np.ndarray, is_word: np.ndarray, lower: bool = True):
        self.data, self.origin = data, origin
        n = len(data)
        low = LOWER[data] if lower else data
        inside = is_word[low]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        edges = origin[:-1][origin[:-1] < n]
        opens[edges] = inside[edges]
        last = origin[1:] - 1
        last = last[last >= 0]
        closes[last] = inside[last]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, origin)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[low] * up[:n], dtype=np.uint64, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, byte position of each row and the end) of a column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def estimate(a: Column, b: Column, permutations: int = 160) -> Column:
    """Similarity from two sketches: the share of equal 2-bit values, less the share that agrees by chance."""
    differ = F.lit(0)
    for k in range((permutations * BITS + 63) // 64):
        x = a[k].bitwiseXOR(b[k])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / F.lit(float(permutations))) - chance) / (1 - chance)
