"""Vectorised text primitives over Arrow string columns.

Everything works on the UTF-8 bytes of a slice of documents at a time (SLICE_BYTES), so memory does not follow the size of a batch or a partition.  Words are maximal runs of bytes outside
``0x20`` and ``0x09``-``0x0D``, unless others are given; ASCII letters are folded to lower case while hashing.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

_U = np.uint64
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser: a bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x = x ^ (x >> _U(27))
    x = x * _M2
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values for a seed."""
    with np.errstate(over="ignore"):
        return mix64(_U(seed) * _M2 + _GOLD * np.arange(1, n + 1, dtype=np.uint64))


SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = stream(11, 256)[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = stream(13, 16) | _U(1)
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if not _pow or len(_pow[0]) < n:
        n = max(n, 2 * SLICE_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            f = np.full(n, _U(b), dtype=np.uint64)
            f[0] = _U(1)
            out.append(np.cumprod(f, dtype=np.uint64))
        _pow[:] = out
    return _pow[0], _pow[1]


#: Called when a batch is done: caches that can tell whether they are still in use.
on_idle: list[Callable[[], None]] = []
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and an executor's memory is shared."""
    for f in on_idle:
        f()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


class Words:
    """The words of a slice: byte spans, hashes of the lower-cased bytes, and where each document's words begin."""

    __slots__ = ("starts", "ends", "first", "hashes", "data")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True, outside: np.ndarray = SEPARATOR):
        n = len(data)
        self.data = data
        sep = outside[data]
        cut = np.empty(n + 1, dtype=bool)  # a separator or the edge of a document stands before i
        cut[0] = cut[n] = True
        cut[1:n] = sep[: n - 1] if n else False
        cut[offsets[offsets < n]] = True
        word = ~sep
        self.starts = np.flatnonzero(word & cut[:n])
        after = np.empty(n, dtype=bool)
        after[: n - 1] = sep[1:]
        if n:
            after[n - 1] = True
        inner = offsets[(offsets > 0) & (offsets <= n)] - 1
        after[inner] = True
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(data, self.starts, self.ends) if hashed else None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of the byte spans, independent of where they stand."""
    powers, inverse = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(table[data] * powers[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words and each document's first; a shorter document has one run of all its words."""
    h, first = words.hashes, words.first
    n = np.diff(first)
    made = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(begin[-1], dtype=np.uint64)
    long = np.flatnonzero(n >= width)
    if len(long):
        total = made[long]
        at = np.repeat(first[:-1][long] - np.concatenate(([0], np.cumsum(total)[:-1])), total) + np.arange(total.sum())
        acc = h[at] * _STEP[0]
        for k in range(1, width):
            acc += h[at + k] * _STEP[k]
        to = np.repeat(begin[:-1][long] - np.concatenate(([0], np.cumsum(total)[:-1])), total) + np.arange(total.sum())
        out[to] = mix64(acc)
    for d in np.flatnonzero((n > 0) & (n < width)):
        own = h[first[d] : first[d + 1]]
        out[begin[d]] = mix64((own * _STEP[: len(own)]).sum(dtype=np.uint64) + _U(len(own)) * _GOLD)
    return out, begin


def distinct_per_doc(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in ascending order, and where each document's begin."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, doc))
    values = values[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    kept = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], kept[begin]


def binary_list(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """A binary column holding each document's part of values."""
    width = values.dtype.itemsize
    if int(begin[-1] - begin[0]) * width >= 1 << 31:
        raise ValueError("a slice holds 2 GiB or more; use smaller slices")
    offsets = pa.py_buffer(((begin - begin[0]) * width).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values[begin[0] : begin[-1]]))])


def int64(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as the signed values Spark's LONG holds."""
    return x.view(np.int64)
