"""Vectorised text primitives shared by the Python-side operators.

Everything works on Arrow string buffers, so a batch of documents is hashed without making one Python string a word.
A batch is cut into slices of about ``SLICE`` bytes (a longer single document makes a longer slice), which bounds memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 512 << 10
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: White space of the word contract: space and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: int, key: str) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; the slice-sized table is kept."""
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, SLICE + (SLICE >> 1))
        made = np.full(size, base & _M64, dtype=np.uint64)
        made[0] = 1
        made = np.multiply.accumulate(made)
        if size > 8 * SLICE:  # one very long text: not kept
            return made
        _powers[key] = have = made
    return have


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; equal inputs and salts give equal outputs."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & _M64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """What a worker has freed goes back to the system, so reused and idle workers hold little."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first row, row after the last, bytes, offsets from 0."""
    data, offsets = string_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    if n and offsets[n] - offsets[0] > limit:
        give_back()


def flags_at(n: int, offsets: np.ndarray) -> np.ndarray:
    """True where a text begins; one longer than the buffer."""
    at = np.zeros(n + 1, dtype=bool)
    at[offsets] = True
    return at


def words(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators; no run spans two texts."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~separator[buf]
    first = flags_at(n, offsets)
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def prefix_hash(buf: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Running polynomial sums; span_hash turns them into hashes of byte spans."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(code[buf] * _power(len(buf), _BASE, "up")[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes: equal bytes give equal hashes wherever they stand."""
    down = _power(len(sums), _BASE_INV, "down")
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets into the spans by text: text i has spans out[i]:out[i + 1]."""
    return np.searchsorted(starts, offsets, side="left")


def owner(cuts: np.ndarray) -> np.ndarray:
    """The text of each span, from per_text's offsets."""
    return np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges start, start + 1, ..., in order."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def shingles(word_hash: np.ndarray, cuts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words, and their offsets by text.

    A text of fewer words, but one at least, has one shingle: its whole sequence. A text without words has none.
    """
    counts = np.diff(cuts)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = ragged(cuts[:-1], made)
    size = np.repeat(np.minimum(counts, width), made)
    h = mix(size.astype(np.uint64), 7)
    for k in range(width):
        some = size > k
        h[some] = mix(h[some] * np.uint64(0x2545F4914F6CDD1D) + word_hash[at[some] + k], k + 1)
    return h, np.concatenate([[0], np.cumsum(made)])


def distinct_sorted(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and the offsets by text."""
    who = owner(cuts)
    order = np.lexsort((values, who))
    v, w = values[order], who[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    v, w = v[keep], w[keep]
    return v, np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(cuts) - 1))]).astype(np.int64)


def binary_column(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value a text out of a flat numeric array."""
    flat = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((np.asarray(cuts, np.int64) * flat.itemsize).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
