"""Order-preserving packing of documents into sequences by dynamic programming.

Documents keep their order.  Their ids form a stream that is cut into windows of at most `width` ids;
a cut may stand where a document ends (no penalty), where a sentence ends (SENTENCE), or, where
a quarter of a window has neither, at every HARD_STEP-th id, and near the end of a block at any id (HARD).  The cuts
minimise, over a block of documents, padding + penalties + EACH for every sequence, where a window
shorter than `width` is padded to it unless its length is a power of two.

f(j), the least cost of the ids before cut j, is penalty(j) + EACH + min over cuts i in reach of
f(i) + width - (p(j) - p(i)): with f(i) + p(i) as key that is a sliding minimum, which a monotone
queue gives in constant time a cut.  Windows of a power of two are one more transition for each power.

A block is a run of at least BLOCK_IDS ids of one partition, so tasks need no neighbour and hold no
more than a block.  Sequence ids are unique, ascending inside a partition and not consecutive
between partitions.

Defined cases: a null or empty text is a document of the end id alone; documents longer than a window
are cut; repeated rows are packed as often as they come; an empty table gives no piece; columns other
than key and text are never read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._spark import small_batches
from rolegraph.llm._text import text_slices
from rolegraph.llm._tokens import PIECE, encoder, with_end

WIDTH = 2048
SENTENCE, HARD, EACH = 4, 48, 2
HARD_STEP = 64
#: The shortest window that a power of two frees from padding, but for a block's last ids.
LEAST_POWER = 64
BLOCK_IDS = 1 << 18

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_points(total: int, docs: np.ndarray, sentences: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places where a cut may stand, 0 and total included, and their penalties."""
    penalty = {}
    at = np.union1d(np.union1d(docs, sentences), [0, total])
    gaps = np.diff(at)
    hard = [np.arange(max(0, total - 2 * width), total)]
    for a, g in zip(at[:-1][gaps > width // 4].tolist(), gaps[gaps > width // 4].tolist()):
        hard.append(np.arange(a + width // 4, a + g, HARD_STEP))
    at = np.union1d(at, np.concatenate(hard))
    penalty = np.full(len(at), HARD, dtype=np.int64)
    penalty[np.isin(at, sentences, assume_unique=True)] = SENTENCE
    penalty[np.isin(at, docs)] = 0
    penalty[[0, -1]] = 0
    return at, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, width: int, least_power: int = LEAST_POWER, tail: int = 0) -> list[int]:
    """Indices into at of the cuts of least cost; from `tail` on, any power of two frees a window from padding."""
    m = len(at)
    jumps_to, jumps_from = [], []
    p = 1
    while p < width:
        want = at - p
        i = np.searchsorted(at, want)
        ok = (want >= 0) & (at[np.minimum(i, m - 1)] == want)
        if p < least_power:
            ok &= want >= tail
        jumps_to.append(np.flatnonzero(ok))
        jumps_from.append(i[ok])
        p *= 2
    to, source = np.concatenate(jumps_to), np.concatenate(jumps_from)
    order = np.argsort(to, kind="stable")
    to, source = to[order].tolist() + [m], source[order].tolist()
    places, costs = at.tolist(), (penalty + EACH).tolist()
    f, back, key = [0] * m, [0] * m, [0] * m
    window: deque[int] = deque([0])
    key[0] = places[0]
    h = 0
    for j in range(1, m):
        here = places[j]
        while places[window[0]] < here - width:
            window.popleft()
        i = window[0]
        best = key[i] + width - here
        while to[h] == j:
            k = source[h]
            if f[k] < best:
                best, i = f[k], k
            h += 1
        best += costs[j]
        f[j], back[j], key[j] = best, i, best + here
        while window and key[window[-1]] >= key[j]:
            window.pop()
        window.append(j)
    cuts, j = [m - 1], m - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def _pack(tokenizer: str, end_id: int, width: int):
    def block(keys: pa.Array, ids: np.ndarray, begin: np.ndarray, ends: np.ndarray, first: int) -> tuple[pa.RecordBatch, int]:
        total = len(ids)
        sentences = np.flatnonzero(ends[ids]) + 1
        at, penalty = cut_points(total, begin[1:], sentences, width)
        windows = at[best_cuts(at, penalty, width, tail=total - 2 * width)]
        edges = np.union1d(windows, begin)
        starts, lengths = edges[:-1], np.diff(edges)
        doc = np.searchsorted(begin, starts, side="right") - 1
        seq = np.searchsorted(windows, starts, side="right") - 1
        wide = memoryview(ids.astype("<u4").tobytes())
        sums = np.fromiter((zlib.crc32(wide[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist())), np.int64, len(starts))
        columns = [keys.take(pa.array(doc))] + [pa.array(x.astype(np.int64)) for x in (starts - begin[doc], lengths, sums, np.diff(begin)[doc], first + seq, starts - windows[seq])]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")]), first + len(windows) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        ends = enc.stops
        first = TaskContext.get().partitionId() << 33
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, count
            sizes = np.concatenate([np.diff(b) for _, _, b in held])
            out, first = block(pa.concat_arrays([k for k, _, _ in held]), np.concatenate([i for _, i, _ in held]), np.concatenate(([0], np.cumsum(sizes))), ends, first)
            held.clear()
            count = 0
            return out

        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), PIECE):
                ids, begin = with_end(*enc.encode(data, offsets), end_id)
                held.append((batch.column(0).slice(a, b - a), ids, begin))
                count += len(ids)
                if count >= BLOCK_IDS:
                    yield flush()
        if count:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of docs in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_pack(tokenizer, end_id, width), PIECES)
