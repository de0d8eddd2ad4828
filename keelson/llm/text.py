"""Words, hashes and sliding windows of whole Arrow batches as numpy arrays: no Python step per word or byte.

Words are runs of bytes other than space and U+0009 to U+000D of the UTF-8 text, so they equal the runs of characters
of ``[^\\x20\\x09-\\x0D]+``. A null text is an empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64


def tidy(work):
    """A task function that gives freed memory back when it ends: workers live on, and would keep the most they ever held."""

    def run(batches):
        yield from work(batches)
        release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text worked on at once; a longer document is worked on alone.
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_BASE = 0x5851F42D4C957F2D
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Rolling:
    """Hash of any range of ``values`` in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])

    def windows(self, size: int) -> np.ndarray:
        """Hash of each run of ``size`` values, by its first."""
        if len(self.sums) <= size:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


@dataclass
class Chunk:
    """Some whole documents: rows ``low`` to ``high`` of the batch, their bytes, and where each begins."""

    low: int
    high: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of a string or binary column in runs of at most ``limit`` bytes, or one longer document."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    n = len(column)
    if not n:
        return
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield Chunk(low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


@dataclass
class Words:
    """Words of a chunk: byte ranges, and the index of each document's first word (one more entry at the end)."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, data: np.ndarray) -> np.ndarray:
        return Rolling(_BYTE[data]).spans(self.begin, self.end)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~SPACE[data]
    open_ = inside.copy()
    open_[1:] &= ~inside[:-1] | edge[1:n]
    close = inside.copy()
    close[:-1] &= ~inside[1:] | edge[1:n]
    begin = np.flatnonzero(open_)
    return Words(begin, np.flatnonzero(close) + 1, np.searchsorted(begin, offsets))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of each run of ``size`` values."""
    low, span = values, 1
    while span * 2 <= size:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0]
        span *= 2
    rest = size - span
    if rest:
        low = np.minimum(low[:-rest], low[rest:]) if len(low) > rest else low[:0]
    return low


def inside_one(n: int, size: int, first: np.ndarray) -> np.ndarray:
    """For each of the ``n - size + 1`` runs of ``size`` tokens, whether it lies within one document."""
    if n < size:
        return np.zeros(0, bool)
    cut = np.zeros(n + 1, np.int64)
    inner = first[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    np.add.at(cut, np.maximum(inner - size + 1, 0), 1)
    np.add.at(cut, inner, -1)
    return (np.cumsum(cut) == 0)[: n - size + 1]
