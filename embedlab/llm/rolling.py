"""Rabin-Karp hashing of runs of words or bytes with NumPy, and minimum selection over windows.

A window hash is the polynomial of its items modulo 2**64 for an odd base. Differences of prefix
sums give all windows of a text at once. ``mix`` spreads the bits before hashes are compared by size.
"""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
MAX_CACHED_WORDS = 1_000_000


class WordHashes(dict):
    """64-bit hashes of words, computed once per distinct word; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MAX_CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Powers:
    """Powers of the base and of its inverse, extended on demand."""

    def __init__(self) -> None:
        self._up = np.ones(1, np.uint64)
        self._down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_up", BASE), ("_down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self._up[:n], self._down[:n]


def prefix_sums(items: np.ndarray, powers: Powers) -> np.ndarray:
    sums = np.zeros(len(items) + 1, np.uint64)
    up, _ = powers.upto(max(len(items), 1))
    np.cumsum(items * up[: len(items)], out=sums[1:])
    return sums


def window_hashes(sums: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """Hash of every run of ``length`` items, from the prefix sums; empty for shorter texts."""

    count = len(sums) - length
    if count <= 0:
        return np.empty(0, np.uint64)
    _, down = powers.upto(count)
    return (sums[length:] - sums[:count]) * down


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the runs [start, end); runs of other lengths differ by the length mixed in."""

    _, down = powers.upto(len(sums))
    return (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(BASE)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""

    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from block-wise running minima."""

    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, values.dtype)
    padded = -(-len(values) // width) * width
    full = np.full(padded, np.iinfo(values.dtype).max, values.dtype)
    full[: len(values)] = values
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal stretches of rows equal in all columns."""

    length = len(columns[0])
    if length == 0:
        empty = np.empty(0, np.int64)
        return empty, empty
    changed = np.zeros(length - 1, bool)
    for values in columns:
        changed |= values[1:] != values[:-1]
    cuts = np.flatnonzero(changed) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [length]))


def covered(starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Mask of the places inside any of the ranges [start, end)."""

    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
