"""Words of Arrow text batches as numpy arrays: positions and 64-bit hashes, over whole texts.

A word is a run of bytes other than space and U+0009 to U+000D. Hashes are polynomials
modulo 2^64 over random byte values, taken from one running sum, so a batch costs a few
passes over its bytes and no loop over words or documents.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

# Bytes worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def byte_values(seed: int, lower: bool) -> np.ndarray:
    """A random 64-bit value per byte; A-Z as a-z when ``lower``."""
    values = np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = byte_values(20240607, False)
_LOWER = byte_values(20240607, True)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _UNBASE):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least ``n`` bytes."""
    return _powers(max(SLICE_BYTES, 1 << int(n - 1).bit_length() if n > 1 else 1))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Sums:
    """Running sums of a byte buffer, for the hash of any of its ranges."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        up, self._down = powers(len(data) + 1)
        values = (_LOWER if lower else _VALUES)[data]
        values *= up[: len(data)]
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values, out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the ranges [start, end); equal bytes give equal hashes."""
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


@dataclass
class TextSlice:
    """Some rows of a batch: ``data[offsets[i]:offsets[i+1]]`` is the text of row ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # the row of each word, from 0 in the slice
    bounds: np.ndarray  # words of row i: bounds[i] to bounds[i + 1]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """The texts of a string column, in slices of about ``limit`` bytes; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = max(int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1, at + 1)
        yield TextSlice(at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and an executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def lean(run: Callable) -> Callable:
    """A mapInArrow function that gives freed memory back at the end of each task."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, where each is turned into Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def find_words(part: TextSlice) -> Words:
    inside = np.zeros(len(part.data) + 1, dtype=bool)
    np.logical_not(_SPACE[part.data], out=inside[:-1])
    starts = inside[:-1].copy()
    starts[1:] &= ~inside[:-2]
    edges = part.offsets[:-1][part.offsets[:-1] < len(part.data)]
    starts[edges] = inside[edges]
    ends = inside[:-1] & ~inside[1:]
    last = part.offsets[1:][part.offsets[1:] > 0] - 1
    ends[last] = inside[last]
    first, stop = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(first, part.offsets)
    return Words(first, stop, np.repeat(np.arange(len(part.offsets) - 1), np.diff(bounds)), bounds)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` words in a row, at each first word; the last n - 1 of a slice are cut off."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k])
    return out
