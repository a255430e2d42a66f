"""Token ids as length-delimited binary records with an offset index.

A shard is a data file of framed records and an index file beside it.  A record is

    length uint64 | masked checksum of those 8 bytes uint32 | payload | masked checksum of the payload uint32

all little-endian; the checksum is CRC-32, masked by rotating it right by 15 bits and adding a
constant, so that data holding checksums doesn't look like a frame.  A payload is a document's ids as
uint16 (uint32 if the vocabulary needs it).  The index holds doc_id, offset of the frame, and number
of ids for each record, so that a reader can take records in any order.

Shards are ranges of doc_id in ascending order; rows of a shard are sorted by doc_id, equal ids by
their token ids.  Ranges are as many as the texts' bytes ask for, and a range whose records outgrow
SHARD_BYTES goes on in another shard.  A task writes under the name of its own attempt, and the shard
table, which Spark commits, says which attempts count; so a repeated or speculative task harms nothing.

Defined cases: a null text counts as empty and gives a record of the end id alone; a null doc_id
comes first; repeated doc_ids are records of their own; an empty table gives no shard; other columns
are never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolegraph.llm._spark import scratch_path, small_batches, written
from rolegraph.llm._text import binary_list, text_slices
from rolegraph.llm._tokens import PIECE, encoder, with_end

INDEX_MAGIC, DATA_MAGIC = b"RGTIDX01", b"RGTREC01"
#: Bytes of text in a range, and of records in a shard, about.
RANGE_BYTES = SHARD_BYTES = 64 << 20
READ_BYTES = 8 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(buffer: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at a place, and where the next begins."""
    head = buffer[at : at + 8]
    (n,) = struct.unpack("<Q", head)
    payload = buffer[at + 12 : at + 12 + n]
    if struct.unpack_from("<I", buffer, at + 8)[0] != masked(head) or struct.unpack_from("<I", buffer, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"a record's checksum is wrong at {at}")
    return payload, at + 16 + n


def _encode(path: str, end_id: int, bounds: list[int]):
    limits = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), PIECE):
                ids, begin = with_end(*enc.encode(data, offsets), end_id)
                keys = batch.column(0).slice(a, b - a)
                shard = np.searchsorted(limits, keys.fill_null(-(1 << 63)).to_numpy(), side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.array(shard), binary_list(ids, begin)], names=["doc_id", "shard", "ids"])

    return run


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _write(uri: str, width: int, most: int):
    names = ["shard", "file", "records", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(uri)
        attempt = TaskContext.get().taskAttemptId()
        out, shard, keys, places, sizes, at = None, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal out
            out.close()
            out = None
            name = f"shard-{shard:012d}-{attempt}"
            own = pa.concat_arrays(keys)
            with fs.open_output_stream(f"{top}/{name}.idx") as f:
                f.write(INDEX_MAGIC + struct.pack("<Q", len(own)))
                for x in (own.is_valid().cast(pa.int64()).to_numpy(), own.fill_null(0).to_numpy(), np.array(places, dtype=np.int64), np.array(sizes, dtype=np.int64)):
                    f.write(np.ascontiguousarray(x, dtype="<i8").tobytes())
            done = pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([f"{uri}/{name}"]), pa.array([len(own)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=names)
            for x in (keys, places, sizes):
                x.clear()
            return done

        for batch in batches:
            if not batch.num_rows:
                continue
            if shard >> 20 != batch.column(1)[0].as_py():
                shard = batch.column(1)[0].as_py() << 20
            if out is None:
                out = fs.open_output_stream(f"{top}/shard-{shard:012d}-{attempt}.bin")
                out.write(DATA_MAGIC + struct.pack("<Q", width))
                at = 16
            frames = []
            for payload in batch.column(2).to_pylist():
                frames.append(frame(payload))
                places.append(at)
                sizes.append(len(payload) // width)
                at += len(payload) + 16
            out.write(b"".join(frames))
            keys.append(batch.column(0))
            if at >= most:
                yield close()
                shard += 1
        if out is not None:
            yield close()

    return run


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write docs' ids as shards under uri; returns (shard, file, records, ids), a row for each shard."""
    spark = docs.sparkSession
    width = np.dtype(encoder(tokenizer).dtype).itemsize
    small_batches(spark)
    ids = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranges = max(1, -(-(ids.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    bounds: list[int] = []
    if ranges > 1:  # quantiles of the key alone: the texts aren't read for them
        bounds = sorted({int(x) for x in ids.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges)})
    fs, top = _open(uri)
    fs.create_dir(top, recursive=True)
    coded = ids.mapInArrow(_encode(tokenizer, end_id, bounds), "doc_id long, shard int, ids binary")
    placed = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
    return written(placed.mapInArrow(_write(uri, width, SHARD_BYTES), "shard long, file string, records long, ids long"), "token-shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist()):
            fs, path = _open(file)
            with fs.open_input_stream(f"{path}.idx") as f:
                raw = f.read()
            if raw[:8] != INDEX_MAGIC:
                raise ValueError(f"{file}.idx is not an index")
            (n,) = struct.unpack_from("<Q", raw, 8)
            there, keys, places, sizes = np.frombuffer(raw, dtype="<i8", offset=16).reshape(4, n)
            starts = base + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            with fs.open_input_file(f"{path}.bin") as f:
                head = f.read(16)
                if head[:8] != DATA_MAGIC:
                    raise ValueError(f"{file}.bin is not a record file")
                kind = "<u2" if head[8] == 2 else "<u4"
                stops = places + 16 + sizes * head[8]
                i = 0
                while i < n:
                    j = max(i + 1, int(np.searchsorted(stops, places[i] + READ_BYTES, side="right")))
                    f.seek(int(places[i]))
                    buffer, sums = f.read(int(stops[j - 1] - places[i])), np.empty(j - i, dtype=np.int64)
                    for k in range(i, j):
                        payload, _ = unframe(buffer, int(places[k] - places[i]))
                        if len(payload) != sizes[k] * head[8]:
                            raise ValueError(f"the index of {file} doesn't fit its records")
                        sums[k - i] = zlib.crc32(np.frombuffer(payload, dtype=kind).astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i:j], mask=there[i:j] == 0), pa.array(starts[i:j]), pa.array(sizes[i:j]), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j


def read_token_files(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """Read shards back by their indexes, checking every frame: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for SHARD_BYTES of records
    each = shards.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return each.repartition(max(1, shards.count())).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs in the shared folder and read the files back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, scratch_path(spark, "tokens"), tokenizer, end_id))
