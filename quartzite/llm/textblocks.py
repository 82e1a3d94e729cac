"""Words of many texts at once: NumPy over the UTF-8 bytes of an Arrow column.

Words are ``[^\\x20\\x09-\\x0D]+``. The bytes 0x20 and 0x09 to 0x0D never occur inside a UTF-8
sequence of several bytes, so words can be cut on bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_SEED = np.random.default_rng(0x5EED)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            steps = np.full(n + 1, _BASE, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = _BACK
            self.down = np.cumprod(steps)
        return self.up, self.down


_POWERS = _Powers()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK, docs: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs of documents with about that many bytes, and so many documents at most; a longer document by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(i + docs, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and each document's first word (one more entry at the end)."""
    inside = ~SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    begin = at[:-1]
    word = inside[begin] if len(begin) else np.zeros(0, bool)
    starts, ends = begin[word], at[1:][word]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    up, down = _POWERS.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def count_words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    data, offsets = text_bytes(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in chunks(offsets):
        _, _, first = word_bounds(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out[i:j] = np.diff(first)
    return out


def release() -> None:
    """Gives what a Python worker no longer uses back to the system, for the next task in its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
