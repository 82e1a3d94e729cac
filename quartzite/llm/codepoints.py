"""Words as runs of code points: hashes of many at once, and which of them are equal."""

from __future__ import annotations

import functools

import numpy as np

from .textblocks import mix

CODES = 0x110000
_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _values() -> np.ndarray:
    return mix(np.arange(CODES, dtype=np.uint64) + np.uint64(0x5EED)) | np.uint64(1)


@functools.cache
def _powers() -> np.ndarray:
    return np.cumprod(np.full(1 << 16, _BASE, np.uint64))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] numbers, then those of the next, and so on; below 2**31."""
    ends = np.cumsum(sizes)
    out = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


def word_keys(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; the words follow each other and are all of codes."""
    place = np.arange(len(codes), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), sizes)
    place &= 0xFFFF
    return mix(np.add.reduceat(_values()[codes] * _powers()[place], starts) + sizes.astype(np.uint64))


def firsts(h: np.ndarray) -> np.ndarray:
    """For each hash the place of one occurrence of it, the same for all of its occurrences."""
    out = np.empty(len(h), np.int64)
    left = np.arange(len(h))
    bits = max(10, int(len(h)).bit_length())
    slots = np.zeros(1 << bits, np.int64)
    for turn in range(64 // bits):
        if not len(left):
            return out
        at = ((h[left] >> np.uint64(turn * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        slots[at] = left
        found = slots[at]
        same = h[found] == h[left]
        out[left[same]] = found[same]
        left = left[~same]
    if len(left):
        _, first, inverse = np.unique(h[left], return_index=True, return_inverse=True)
        out[left] = left[first][inverse]
    return out


def equal_words(a: np.ndarray, a_starts: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Which words of a equal the words of b at the same places of the lists."""
    same = a_sizes == b_sizes
    at = np.flatnonzero(same)
    if len(at):
        differ = a[spread(a_starts[at], a_sizes[at])] != b[spread(b_starts[at], a_sizes[at])]
        if differ.any():
            same[at] = ~np.logical_or.reduceat(differ, np.cumsum(a_sizes[at]) - a_sizes[at])
    return same


def distinct_words(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words, the place of an equal word for each, and the places that stand for themselves.

    Equal words have equal keys and one place; should two different words share a key, all stand for themselves.
    """
    keys = word_keys(codes, starts, sizes)
    same = firsts(keys)
    shift = np.repeat((starts[same] - starts).astype(np.int32), sizes)
    shift += np.arange(len(codes), dtype=np.int32)
    if (sizes[same] != sizes).any() or (codes[shift] != codes).any():
        same = np.arange(len(starts))
    return keys, same, np.flatnonzero(same == np.arange(len(same)))
