"""Bloom filters of 64-bit hashes, built by all tasks and broadcast: they let the large side of a join emit likely hits only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a filter at most; past that it grows less selective, and what follows it stays exact.
FILTER_BYTES = 16 << 20
CHUNK = 1 << 16


def probe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter has both of a hash's bits."""
    n = np.uint64(len(bits) * 8 - 1)
    one = h & n
    out = (bits[(one >> np.uint64(3)).astype(np.int64)] >> (one & np.uint64(7)).astype(np.uint8)) & 1 != 0
    at = np.flatnonzero(out)
    two = (h[at] >> np.uint64(32)) & n
    out[at] = (bits[(two >> np.uint64(3)).astype(np.int64)] >> (two & np.uint64(7)).astype(np.uint8)) & 1 != 0
    return out


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=np.uint8)
        n = np.uint64(size * 8 - 1)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            for x in (h & n, (h >> np.uint64(32)) & n):
                np.bitwise_or.at(bits, (x >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (x & np.uint64(7)).astype(np.uint8)))
        some = [k for k in range(0, size, CHUNK) if bits[k : k + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([bits[k : k + CHUNK].tobytes() for k in some], pa.binary())], names=["at", "bits"])

    return run


def _either(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in parts:
        for blob in part["bits"].to_pylist():
            own = np.frombuffer(blob, np.uint8)
            total = own.copy() if total is None else total | own
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["at", "bits"])


def bloom(hashes: DataFrame, per_key: int = 64) -> np.ndarray:
    """The filter of a written table's one column of longs, with per_key bits for each row where FILTER_BYTES allow it."""
    count, size = hashes.count(), 1 << 12
    while size < FILTER_BYTES and size * 8 < per_key * count:
        size *= 2
    bits = np.zeros(size, dtype=np.uint8)
    for r in hashes.mapInArrow(_chunks(size), "at long, bits binary").groupBy("at").applyInArrow(_either, "at long, bits binary").collect():  # FILTER_BYTES in all
        own = np.frombuffer(r["bits"], np.uint8)
        bits[r["at"] : r["at"] + len(own)] = own
    return bits
