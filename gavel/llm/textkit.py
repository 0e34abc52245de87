"""Vectorised hashing of words and n-grams for tasks that hold Arrow batches of texts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Texts are hashed in chunks of whole texts of about so many bytes, to bound the arrays.
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def _lower_case() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Rolling:
    """Hashes of any substring of some bytes, from one pass over them."""

    def __init__(self, data: np.ndarray):
        size = max(1 << 21, 1 << int(len(data) + 1).bit_length())
        up, self._down = _powers(size)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * up[: len(data)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes from ``starts`` up to ``ends``, lengths included."""
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all substrings of one width."""
        n = len(self._sums) - width
        raw = (self._sums[width:] - self._sums[:-width]) * self._down[:n]
        return mix(raw)


def binary_parts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # pyarrow keeps several chunks if one were too long
        column = pa.concat_arrays(column.chunks)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


@dataclass
class Words:
    """The words of several texts, one after the other."""

    starts: np.ndarray  # places in the bytes
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray  # words of each text


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """ASCII white space separates; A-Z are hashed in lower case."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    rolling = Rolling(_lower_case()[data])
    edges = np.searchsorted(starts, offsets)
    return Words(starts, ends, rolling.hashes(starts, ends), np.diff(edges))


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, shingles of each text), repeats included.

    A text with fewer words than ``width`` has one shingle of all its words, or none without words.
    """
    first = np.cumsum(found.counts) - found.counts
    combined = np.zeros(len(found.hashes), np.uint64)
    n = len(combined)
    for i in range(min(width, n)):  # out of place at the ends of texts, which are left out below
        combined[: n - i] = combined[: n - i] * np.uint64(0x9FB21C651E98DF25) + found.hashes[i:]
    combined = mix(combined)
    counts = np.where(
        found.counts >= width, found.counts - width + 1, np.minimum(found.counts, 1)
    )
    for text in np.flatnonzero((found.counts > 0) & (found.counts < width)):
        own = found.hashes[first[text] : first[text] + found.counts[text]]
        value = len(own)
        for h in own.tolist():
            value = (value * 0x9FB21C651E98DF25 + h) % (1 << 64)
        combined[first[text]] = mix(np.array([value], np.uint64))[0]
    where = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return combined[where], counts
