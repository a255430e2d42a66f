"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every block of rows (a run of rows inside a partition) fingerprints its texts, sorts the distinct
   fingerprints of each owner's range and sends them as one Golomb-Rice coded message.
2. An owner merges its messages and answers each with a bitmap: which of the sent fingerprints
   occur in another block too.
3. Blocks turn bitmaps (and repeats they saw themselves) into suspect rows; only the suspects'
   texts are shuffled, and the groups are formed on the bytes of the text.

A fingerprint has about FALSE_BITS bits more than the number of rows needs, so about one row in
2**FALSE_BITS is a suspect by chance; the comparison of bytes clears it.

Defined cases: a null text counts as the empty text, and empty texts equal each other; of equal texts
the rows that carry the largest doc_id stay (rows that repeat a doc_id together with its text are one
document given twice: all of them count in group_size, and all stay or all go); a null doc_id is
smaller than any other.  An empty table gives an empty result; columns other than the key and the
text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._spark import ID_BYTES, BROADCAST_BYTES, keep_ids, release, small_enough, written

#: Rows of a block: what one message per owner is made from.
BLOCK_ROWS = 65_536
#: Rows' fingerprints that an owner holds at once, about.
OWNER_ROWS = 500_000
FALSE_BITS = 8


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code (divisor 2**k) of the gaps of ascending distinct values: gap's quotient in unary, then k low bits."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1 + k)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    stop = ends - k - 1  # the unary part is zeros, ended by a one
    bits[stop] = 1
    for j in range(k):
        bits[stop + 1 + j] = (gaps >> np.uint64(k - 1 - j)) & np.uint64(1)
    return np.packbits(bits).tobytes()


def rice_decode(blob: bytes, n: int, k: int) -> np.ndarray:
    """The n values that rice_encode was given."""
    bits = np.unpackbits(np.frombuffer(blob, dtype=np.uint8))
    ones = np.flatnonzero(bits)
    gaps = np.empty(n, dtype=np.uint64)
    at, begin, hops = 0, 0, ones.tolist()
    stops = np.empty(n, dtype=np.int64)
    for i in range(n):  # the first one at or after `begin` ends the unary part
        while hops[at] < begin:
            at += 1
        stops[i] = hops[at]
        begin = hops[at] + 1 + k
    quotient = stops - np.concatenate(([0], stops[:-1] + 1 + k)) if n else stops
    gaps[:] = quotient.astype(np.uint64) << np.uint64(k)
    for j in range(k):
        gaps |= bits[stops + 1 + j].astype(np.uint64) << np.uint64(k - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64)


def _messages(bits: int, owners: int):
    """Per block and owner: the coded fingerprints, and the rows they stand for in the code's order."""
    width = np.uint64(-(-(1 << bits) // owners))

    def flush(part: int, block: int, ids: list, shas: list) -> pa.RecordBatch:
        ids, shas = pa.concat_arrays(ids), pa.concat_arrays(shas)
        raw = np.frombuffer(shas.buffers()[1], dtype=np.uint8)[shas.offset * 32 : (shas.offset + len(shas)) * 32].reshape(-1, 32)
        prints = raw[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - bits)
        order = np.argsort(prints, kind="stable")
        prints, raw, ids = prints[order], raw[order], ids.take(pa.array(order))
        first = np.ones(len(prints), dtype=bool)
        first[1:] = prints[1:] != prints[:-1]
        owner = (prints // width).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]))
        rows = {x: [] for x in ("block", "owner", "n", "k", "code", "repeats", "ids", "shas")}
        for a, b in zip(cuts[:-1], cuts[1:]):
            sent = prints[a:b][first[a:b]] - width * np.uint64(owner[a])
            k = max(0, int(np.log2(max(1.0, float(width) / len(sent) * 0.69))))
            rows["block"].append((part << 33) + block)
            rows["owner"].append(int(owner[a]))
            rows["n"].append(len(sent))
            rows["k"].append(k)
            rows["code"].append(rice_encode(sent, k))
            rows["repeats"].append(np.packbits(~first[a:b]).tobytes())
            rows["ids"].append(ids.slice(a, b - a))
            rows["shas"].append(raw[a:b].tobytes())
        arrays = [pa.array(rows["block"], pa.int64()), pa.array(rows["owner"], pa.int32()), pa.array(rows["n"], pa.int32()), pa.array(rows["k"], pa.int32()), pa.array(rows["code"], pa.binary()), pa.array(rows["repeats"], pa.binary())]
        sizes = np.concatenate(([0], np.cumsum([len(x) for x in rows["ids"]]))).astype(np.int32)
        arrays += [pa.ListArray.from_arrays(pa.array(sizes), pa.concat_arrays(rows["ids"])), pa.array(rows["shas"], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=list(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, ids, shas, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                cut = batch.slice(at, BLOCK_ROWS)
                ids.append(cut.column(0))
                shas.append(cut.column(1).cast(pa.binary(32)))
                held += cut.num_rows
                if held >= BLOCK_ROWS:
                    yield flush(part, block, ids, shas)
                    block, ids, shas, held = block + 1, [], [], 0
        if held:
            yield flush(part, block, ids, shas)

    return run


def _answers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """An owner's answer to every message: a bitmap of the fingerprints that another block sent too."""
    sent = [rice_decode(c, n, k) for c, n, k in zip(table["code"].to_pylist(), table["n"].to_pylist(), table["k"].to_pylist())]
    everything = np.sort(np.concatenate(sent))
    twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
    maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in sent]
    return pa.table({"block": table["block"], "owner": table["owner"], "found": pa.array(maps, pa.binary())})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the blocks again, with what the bitmaps say of each."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch["ids"][i].values
            repeats = np.unpackbits(np.frombuffer(batch["repeats"][i].as_py(), dtype=np.uint8))[: len(ids)].astype(bool)
            group = np.cumsum(~repeats) - 1
            found = np.unpackbits(np.frombuffer(batch["found"][i].as_py(), dtype=np.uint8))[: group[-1] + 1].astype(bool)
            own = np.bincount(group) > 1
            shas = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(ids), [None, pa.py_buffer(batch["shas"][i].as_py())])
            yield pa.RecordBatch.from_arrays([ids, shas.cast(pa.binary()), pa.array((found | own)[group])], names=["doc_id", "sha", "suspect"])


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("sha"))
    n = docs.count()
    bits = min(64, max(8, int(np.ceil(np.log2(n + 2))) + FALSE_BITS))
    owners = max(8, -(-n // OWNER_ROWS), min(64, n // 2_000))
    blocks = written(hashed.mapInArrow(_messages(bits, owners), "block long, owner int, n int, k int, code binary, repeats binary, ids array<long>, shas binary"), "dedup-blocks")
    found = blocks.select("block", "owner", "n", "k", "code").groupBy("owner").applyInArrow(_answers, "block long, owner int, found binary")
    rows = blocks.select("block", "owner", "repeats", "ids", "shas").join(found, ["block", "owner"]).select("repeats", "ids", "shas", "found").mapInArrow(_rows, "doc_id long, sha binary, suspect boolean")
    rows = written(rows, "dedup-rows")
    release(spark, blocks)
    suspects = rows.where("suspect").select("doc_id")
    near = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"))
    near = keep_ids(near, suspects.distinct(), "left_semi").withColumn("sha", F.unhex(F.sha2("text", 256)))
    # the bytes decide: one group for each text, rows of a text summed before the shuffle
    groups = near.groupBy("sha", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = written(groups.select("sha", "text", "keep_id", "group_size"), "dedup-groups")
    per_sha = groups.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts"))
    per_sha = per_sha.where("group_size > 1 or texts > 1")
    if small_enough(per_sha, ID_BYTES + 32, BROADCAST_BYTES):
        per_sha = F.broadcast(per_sha)
    out = rows.select("doc_id", "sha").join(per_sha, "sha", "left")
    same = out.where("texts is null or texts = 1").select("doc_id", F.when(F.col("texts").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha")
    # texts whose digests collide are told apart by the text itself
    clash = out.where("texts > 1").select("doc_id", "sha").distinct()
    apart = near.select("doc_id", "sha", "text").join(clash.select(F.col("doc_id").alias("i"), F.col("sha").alias("s")), (F.col("doc_id").eqNullSafe(F.col("i"))) & (F.col("sha") == F.col("s")), "left_semi") if clash.limit(1).count() else None
    if apart is not None:
        same = same.union(apart.join(groups, ["sha", "text"]).select("doc_id", "keep_id", "group_size", "sha"))
    return same.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; rows of one key have a fate each, by their texts."""
    found = exact_dedup(docs, text, key).where("not kept").select("doc_id", F.xxhash64("text_sha256").alias("mark"))
    gone = written(found.distinct(), "dedup-gone")
    marked = docs.withColumn("__sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    side = gone.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    if small_enough(gone):
        side = F.broadcast(side)
    return marked.join(side, marked[key].cast("long").eqNullSafe(side["__id"]) & (F.xxhash64(marked["__sha"]) == side["__mark"]), "left_anti").drop("__sha")
