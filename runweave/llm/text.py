"""Vectorised text primitives on UTF-8 bytes: words, word hashes and shingles.

A word is a longest run of bytes other than space and the controls 9 to 13. In
UTF-8 these six bytes never occur inside another character, so words can be
found on bytes. Hashes are 64 bits wide: a polynomial over randomised byte
values, taken for all words of a block at once from one running sum, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a block of documents has at most, unless one document is longer.
BLOCK_BYTES = 1 << 18

U64 = np.uint64
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15 | 5


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _byte_values(seed: int, lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed * 0x632BE59BD9B4E019 % 2**64))
    if lower:
        values[65:91] = values[97:123]
    return values


_values: dict[tuple[int, bool], np.ndarray] = {}
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n; grown by doubling and kept."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        got = np.empty(size, dtype=U64)
        got[0] = 1
        filled = 1
        while filled < size:
            step = U64(pow(base, filled, 2**64))
            more = min(filled, size - filled)
            np.multiply(got[:more], step, out=got[filled : filled + more])
            filled += more
        _powers[base] = got
    return got[:n]


@lru_cache(1)
def give_memory_back() -> None:
    """Let freed arrays go back to the system at once, as several workers share an executor's memory."""
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc's; elsewhere nothing is set
    if mallopt is not None:
        # smaller arrays are reused: to map each of them anew costs more than to compute it
        mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets, from 0; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]
    return buf, ends - ends[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each has at most `limit` bytes, or is one row."""
    give_memory_back()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def words(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each document's words begin among them.

    `member` says for each byte whether it belongs to a word.
    """
    n = len(buf)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    inside = member[buf]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    border[1:n] |= ~inside[:-1]
    starts = np.flatnonzero(inside & border[:n])
    border[:] = False
    border[offsets] = True
    border[1:n] |= ~inside[1:]
    ends = np.flatnonzero(inside & border[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words in each text of a column."""
    starts_at = words(*utf8(column))[2]
    return np.diff(starts_at)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; `lower` folds A to Z."""
    values = _values.get((seed, lower))
    if values is None:
        values = _values[seed, lower] = _byte_values(seed, lower)
    inverse = pow(_BASE, -1, 2**64)
    out = np.empty(len(starts), dtype=U64)
    at = 0
    while at < len(starts):
        origin = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, origin + BLOCK_BYTES, side="right")))
        span = int(ends[to - 1]) - origin
        total = np.empty(span + 1, dtype=U64)
        total[0] = 0
        np.cumsum(values[buf[origin : origin + span]] * _power_table(_BASE, span), out=total[1:])
        begin = starts[at:to] - origin
        out[at:to] = (total[ends[at:to] - origin] - total[begin]) * _power_table(inverse, span)[begin]
        at = to
    return mix(out)


_FACTORS = mix(np.arange(1, 65, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def ngram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` values, in order; documents are not looked at."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = hashes[:n] * _FACTORS[0]
    for k in range(1, width):
        total += hashes[k : k + n] * _FACTORS[k]
    return mix(total)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents and where each document's begin.

    A document with 1 to `width` - 1 words has one shingle, its whole sequence;
    one without words has none.
    """
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(at[-1], dtype=U64)
    long = counts >= width
    runs = ngram_hashes(hashes, width)
    if len(runs):
        keep = np.zeros(len(runs) + 1, dtype=np.int32)
        np.add.at(keep, first[:-1][long], 1)
        np.add.at(keep, (first[1:] - width + 1)[long], -1)
        fill = np.zeros(at[-1] + 1, dtype=np.int32)
        np.add.at(fill, at[:-1][long], 1)
        np.add.at(fill, at[1:][long], -1)
        out[np.cumsum(fill)[:-1] > 0] = runs[np.cumsum(keep)[:-1] > 0]
    for i in np.flatnonzero((counts > 0) & ~long):
        part = hashes[first[i] : first[i + 1]]
        out[at[i]] = mix(np.array([(part * _FACTORS[: len(part)]).sum(dtype=U64) + U64(len(part))], dtype=U64))[0]
    return out, at


def code_points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
