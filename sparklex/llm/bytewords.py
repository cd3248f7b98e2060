"""Words of whole texts as numpy arrays over UTF-8 bytes, half a megabyte at a time.

A chunk is a slice of an Arrow batch whose texts add up to about CHUNK bytes (one longer text is a chunk
of its own), so that the memory of a task is bounded by the longest text, not by its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U64 = np.uint64

#: Bytes of words: all but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words: digits, small letters and all that is not ASCII; texts are lower-cased before.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random64(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix(U64(seed)))


_factors = random64(4096, 1)


def factors(n: int) -> np.ndarray:
    """A multiplier for each position in a word."""
    global _factors
    if len(_factors) < n:
        _factors = random64(max(n, 2 * len(_factors)), 1)
    return _factors[:n]


@dataclass
class Chunk:
    rows: pa.RecordBatch
    data: np.ndarray  # bytes of all texts
    at: np.ndarray  # where each text begins, and the end

    def __len__(self) -> int:
        return len(self.at) - 1


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[Chunk]:
    """Null texts count as empty."""
    for batch in batches:
        texts = batch.column(column)
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
        n = len(texts)
        if not n:
            continue
        _, offsets, values = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
        raw = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
            j = min(j, n)
            yield Chunk(batch.slice(i, j - i), raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            i = j


@dataclass
class Words:
    start: np.ndarray  # first byte of each word in the chunk's data
    end: np.ndarray
    hash: np.ndarray  # 64 bits of each word's bytes
    first: np.ndarray  # index of each text's first word, and the number of words

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text())


def words(chunk: Chunk, table: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    data = LOWER[chunk.data] if lower else chunk.data
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[chunk.at] = True  # words end where texts do
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, chunk.at)
    return Words(start, end, _hashes(data, inside, start, end), first)


def _hashes(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    at = np.cumsum(size) - size
    value = data[inside].astype(U64)
    place = np.arange(len(value)) - np.repeat(at, size)
    value += U64(1)
    value *= factors(int(size.max()))[place]
    return mix(np.add.reduceat(value, at) + size.astype(U64))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive elements (also across texts; the caller leaves those out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
    return mix(out)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Which words begin a window of k words of their own text; first as in Words."""
    ok = np.zeros(first[-1], bool)
    n = np.diff(first) - k + 1
    at = first[:-1][n > 0]
    n = n[n > 0]
    ok[np.repeat(at, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))] = True
    return ok


def covered(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie in a run that begins at one of starts."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + length, -1)
    return np.cumsum(delta[:-1]) > 0
