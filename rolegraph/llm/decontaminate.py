"""Benchmark passages in documents by spaced-seed hashing.

A mask such as 1101011 is laid over a text's words at every place; the words under its ones are
hashed, those under its zeros may differ.  Hashes of the benchmark's items and of the documents are
joined; each hit fixes how an item would lie in the document, and the words under that overlap are
compared one by one.  A document holds an item if at least SIMILARITY of the item's words stand at
their places.  MASKS hit every item of more than BRIEF words somewhere, wherever up to a fifth of its
words are replaced; items of 5 to BRIEF words are hit by MASKS and BRIEF_MASKS together, and shorter
ones must be whole, so they are looked up as they are.  (The tests go through all places of the
replaced words.)

A filter of the benchmark's hashes lets the document side emit likely hits only.  The join with the benchmark's hashes and that
with its items are ordinary joins, so a benchmark of any size works.

Defined cases: letters of every script compare in lower case; a null or empty text holds nothing, a null or empty
item is held by nothing; equal items
are reported each; a document that repeats is reported once per doc_id and item; a null doc_id is a
key like others; an empty table on either side gives no row; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._bloom import bloom, probe
from rolegraph.llm._spark import keep_ids, row_mark, small_batches, small_enough, written
from rolegraph.llm._text import Words, int64, mix64, stream, text_slices

MASKS = ("11111", "1110011", "1101011")
#: Laid as well for items of no more than BRIEF words.
BRIEF_MASKS = ("1111", "10111", "11011", "11101")
BRIEF = 10
SIMILARITY = 0.8
#: Places where items may lie in a document that one row holds, about.
LAYS = 4_096

_STEP = stream(23, 4096) | np.uint64(1)


def _on(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def windows(words: Words, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place where the mask fits inside a document: hash, document, and the word it begins at."""
    first, span = words.first, len(mask)
    made = np.maximum(0, np.diff(first) - span + 1)
    doc = np.repeat(np.arange(len(made)), made)
    place = np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(made)[:-1])), made)
    at = first[:-1][doc] + place
    acc = np.full(len(at), np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64)), dtype=np.uint64)
    for i in _on(mask):
        acc += words.hashes[at + i] * _STEP[i % 4096]
    return mix64(acc), doc, place


def laid_masks(lengths: list[int]) -> list[tuple[str, int, int, int]]:
    """(mask, salt, least and most words of the items it is laid for) for items of such lengths, of which only those up to BRIEF matter."""
    least = len(MASKS[0])
    out = [(m, k + 1, least, 1 << 62) for k, m in enumerate(MASKS)]
    if any(least <= n <= BRIEF for n in lengths):
        out += [(m, k + 101, least, BRIEF) for k, m in enumerate(BRIEF_MASKS)]
    return out + [("1" * n, 1000 + n, n, n) for n in lengths if n < least]


def _seeds(laid: list[tuple[str, int, int, int]], shared=None):
    """(id, hash, place, words) of the masks' windows: of items, or of documents where the filter is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                for mask, salt, least, most in laid:
                    h, doc, place = windows(words, mask, salt)
                    size = words.counts()[doc]
                    keep = (size >= least) & (size <= most) if shared is None else probe(shared.value, h)
                    h, doc, place, size = h[keep], doc[keep], place[keep], size[keep]
                    if len(h):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(int64(h)), pa.array(place.astype(np.int64)), pa.array(size.astype(np.int64))], names=["id", "hash", "place", "words"])

    return run


def _longs(values: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate(([0], np.cumsum([len(x) for x in values])))
    return pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(int64(np.concatenate(values)) if len(values) else [], pa.int64()))


def _words_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words): hashes of a text's words."""
    for batch in batches:
        for a, b, data, offsets in text_slices(batch.column(1)):
            words = Words(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(int64(words.hashes)))], names=["id", "words"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The document's words where each item would lie; a place outside the document is left out."""
    for batch in batches:
        ids, texts, lays = batch.column(0), batch.column(1), batch.column(2)
        for a, b, data, offsets in text_slices(texts):
            words = Words(data, offsets)
            doc, item, lead, seg = [], [], [], []
            for i in range(a, b):
                own = words.hashes[words.first[i - a] : words.first[i - a + 1]]
                for lay in lays[i].as_py():
                    s, e = lay["lies"], lay["lies"] + lay["n"]
                    doc.append(i)
                    item.append(lay["item_id"])
                    lead.append((s, max(0, -s)))
                    seg.append(own[max(0, s) : max(0, e)])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array([x[0] for x in lead], pa.int64()), pa.array([x[1] for x in lead], pa.int64()), _longs(seg)], names=["doc_id", "item_id", "lies", "lead", "segment"])


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, word_at, matched, item_words): the best overlap of each document and item that reach the similarity."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.lower(text).alias("text"))
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.lower(item_text).alias("text"))
    tokens = written(items.mapInArrow(_words_column, "id long, words array<long>").where("size(words) > 0").select(F.col("id").alias("item_id"), F.col("words").alias("item_words"), F.size("words").alias("n")), "bench-words")
    laid = laid_masks(sorted(r.n for r in tokens.where(F.col("n") <= BRIEF).select("n").distinct().collect()))
    seeds = items.mapInArrow(_seeds(laid), "id long, hash long, place long, words long")
    seeds = written(seeds.select(F.col("id").alias("item_id"), "hash", "place", F.col("words").alias("n")).distinct(), "bench-seeds")
    bits = spark.sparkContext.broadcast(bloom(seeds.select("hash"), 256))
    hits = rows.mapInArrow(_seeds(laid, bits), "id long, hash long, place long, words long").select(F.col("id").alias("doc_id"), "hash", F.col("place").alias("at"))
    lays = hits.join(seeds, "hash").select("doc_id", F.struct("item_id", (F.col("at") - F.col("place")).alias("lies"), "n").alias("lay")).distinct()
    lays = written(lays, "bench-lays")
    many = written(lays.groupBy("doc_id").agg(F.count("*").alias("c")).where(F.col("c") > LAYS).select(F.col("doc_id").alias("many_id"), F.ceil(F.col("c") / LAYS).alias("cuts")), "bench-many")
    lays = lays.join(F.broadcast(many) if small_enough(many) else many, F.col("doc_id").eqNullSafe(F.col("many_id")), "left").withColumn("cut", F.pmod(F.xxhash64("lay"), F.coalesce("cuts", F.lit(1))))
    lays = written(lays.groupBy("doc_id", "cut").agg(F.collect_list("lay").alias("lays")).select("doc_id", "lays"), "bench-lays")
    near = keep_ids(rows, _ids(lays), "left_semi")
    met = near.join(lays.select(F.col("doc_id").alias("id"), "lays"), F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "lays")
    cut = met.mapInArrow(_segments, "doc_id long, item_id long, lies long, lead long, segment array<long>")
    same = F.size(F.filter(F.zip_with(F.slice("item_words", (F.col("lead") + 1).cast("int"), F.size("segment")), F.col("segment"), lambda x, y: x == y), lambda x: x)).cast("long")
    compared = cut.join(tokens.select("item_id", "item_words", "n"), "item_id").select("doc_id", "item_id", "lies", same.alias("matched"), F.col("n").cast("long").alias("item_words"))
    good = compared.where(F.col("matched") >= F.ceil(F.col("item_words") * F.lit(similarity) - 1e-9))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", -F.col("lies"))).alias("m"), F.max("item_words").alias("item_words"))
    return best.select("doc_id", "item_id", F.greatest(F.lit(0), -F.col("m.col2")).alias("word_at"), F.col("m.matched").alias("matched"), "item_words")


def _ids(lays: DataFrame) -> DataFrame:
    out = lays.select("doc_id")
    out._scratch = lays._scratch
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; every row by its own text, whatever its key."""
    marked = docs.withColumn("__mark", row_mark(F.col(text)))
    bad = written(contaminated(marked, benchmark, text=text, **options | {"key": "__mark"}).select("doc_id").distinct(), "bench-found")
    return keep_ids(marked, bad, "left_anti", "__mark").drop("__mark")
