"""Vectorised word handling over Arrow string columns, shared by the operators that run Python.

A column is walked in blocks of whole texts, so memory follows the block size (or one text, if longer).
Words are spans of bytes; each gets a 64-bit hash of its bytes, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: bytes -> bytes, A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true inside the (first, last) ranges."""
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: the complement of space and \x09-\x0D
BETWEEN_SPACES = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: digits, a-z and all of the non-ASCII bytes, for text in lower case
ALPHANUMERIC = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, _BASE if kind == "up" else _INVERSE)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if where else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Block:
    """Some whole rows of a text column."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, stop: int):
        self.first, self.stop = first, stop
        self.data = data[offsets[first] : offsets[stop]]
        self.offsets = offsets[first : stop + 1] - offsets[first]

    def __len__(self) -> int:
        return self.stop - self.first

    def lowered(self) -> Block:
        self.data = LOWER[self.data]
        return self

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of the bytes in a class, none across rows; and the index of each row's first run (n + 1 values)."""
        mask = inside[self.data]
        cut = self.offsets[:-1][self.offsets[:-1] < len(mask)]
        begins = mask.copy()
        begins[1:] &= ~mask[:-1]
        begins[cut] = mask[cut]
        ends = mask.copy()
        ends[:-1] &= ~mask[1:]
        last = cut[cut > 0] - 1
        ends[last] = mask[last]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span's bytes."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(np.uint64) * _LENGTH)

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole rows of a column, as many at a time as stay under limit bytes, one at least."""
    data, offsets = column_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Block(data, offsets, first, min(stop, n))
        first = min(stop, n)


def row_of(firsts: np.ndarray) -> np.ndarray:
    """For each word its row, from the index of each row's first word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width hashes (also across rows)."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * np.uint64((0xA24BAED4963EE407 * (2 * k + 1) * (k + 3)) & ((1 << 64) - 1) | 1)
    return mix(total)


def ragged(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """firsts[0], firsts[0] + 1, ... for counts[0] values, and so on for each pair."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(skip, counts) + np.repeat(firsts, counts)


def binary_column(parts: list[bytes | memoryview]) -> pa.Array:
    return pa.array([bytes(p) for p in parts], pa.binary())
