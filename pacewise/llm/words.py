"""Words and word hashes of Arrow text batches, with numpy over the raw bytes.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are 64-bit
polynomials over the bytes, mixed; equal words have equal hashes on every machine.
Different strings of some thousand bytes can be made to have one polynomial modulo 2**64,
so strings of more than ``LONG`` bytes are hashed by blake2b.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SLICE_ROWS = 1000
LONG = 256

_BASE = 0x9E3779B97F4A7C55
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit (splitmix64 finalizer)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mix_in_place(h: np.ndarray) -> np.ndarray:
    """:func:`mix` with one array of scratch space."""
    scratch = h >> np.uint64(30)
    h ^= scratch
    h *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(h, np.uint64(27), out=scratch)
    h ^= scratch
    h *= np.uint64(0x94D049BB133111EB)
    np.right_shift(h, np.uint64(31), out=scratch)
    h ^= scratch
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers, _inverse
    if len(_powers) < n:
        size = -(-n // (1 << 16)) << 16
        back = pow(_BASE, -1, 1 << 64)
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
        _inverse = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, back, np.uint64)])
    return _powers, _inverse


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets from 0)`` of pieces of about ``limit`` bytes; a text is never cut."""
    data, offsets = raw_text(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


# Bytes that end a word where punctuation does not count: ASCII other than letters and digits.
PLAIN = np.ones(256, bool)
PLAIN[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False


def slices(batches, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, without copying them."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc
        return lambda keep: 0


def give_back() -> None:
    """Freed memory back to the system, since later stages use the same Python worker."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(run):
    """``run`` over batches; what it freed goes back to the system at its end."""
    def wrapped(batches):
        yield from run(batches)
        give_back()
    return wrapped


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    solid = ~breaks[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    cut = inner[inner > 0] - 1
    ends[cut] = solid[cut]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word; ``lower`` folds A-Z first."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    sums[1:] = _LOWER[data] if lower else data
    sums[1:] += np.uint64(1)
    sums[1:] *= power[:len(data)]
    np.cumsum(sums[1:], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return long_hashes(hashes, _LOWER[data] if lower and (ends - starts > LONG).any() else data, starts, ends)


def long_hashes(hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same hashes, but those of long strings by blake2b."""
    for i in np.flatnonzero(ends - starts > LONG):
        hashes[i] = int.from_bytes(blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes


_ODD = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; entry i starts at word i."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    size = len(words) - k + 1
    total = np.full(size, k, np.uint64)
    for j in range(k):
        total += words[j:j + size] * _ODD[j]
    return mix(total)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct shingle hashes)`` for each text.

    A text with fewer than ``k`` words has its whole sequence as one shingle, a text
    without words none.
    """
    for first, end, data, offsets in chunks(column):
        starts, ends, at = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        windows = window_hashes(words, k)
        for row in range(end - first):
            a, b = at[row], at[row + 1]
            if b - a >= k:
                yield first + row, np.unique(windows[a:b - k + 1])
            elif b > a:
                yield first + row, window_hashes(words[a:b], b - a)
            else:
                yield first + row, windows[:0]
