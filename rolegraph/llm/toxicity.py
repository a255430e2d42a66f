"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all runs of letters of the labelled examples (letters: a-z and every sign outside ASCII) in
lower case.  A text's vector has every one of its terms that the vocabulary knows, with weight
(1 + log tf) * idf * telling, and length 1.  idf counts all documents.  `telling` is a supervised
factor, max(FLOOR, |z| - CHANCE), where z is the log odds ratio of the labels for examples with the
term, over its standard error: a term that tells nothing keeps FLOOR and takes part like any other.

The examples form an inverted index in blocks of BLOCK alike examples.  A cell is a term in a block:
its postings and the greatest weight among them.  The DENSE terms of most postings are a matrix
instead, whose part of every cosine is one product.  For a text, the greatest such part in a block
plus the sum of its other weights times their cells' maxima bounds the cosine with any example of the
block; a few blocks of the greatest bounds are scored first, then all whose bound reaches the K-th
best cosine so far, until none is left.  So the neighbours are exactly those of a full search (equal
cosines: smaller place in the index first).

Neighbours vote by cosine, and the votes are calibrated by a logistic curve over the examples' own
votes with themselves left out; an example counts for as many as the draw took it from.  Examples are
at most about PER_LABEL of each label, drawn by a hash of the key; that bound holds the index at a
size that may be broadcast.

Defined cases: a text without a term of the vocabulary (null and empty ones among them) and every
text where nothing is labelled with one of the labels has the share of toxic ones among the labelled
rows (0 without labels); rows of several labels take the largest; repeated rows are scored each; a
null key is never labelled; an empty table gives an empty result; label, language, source and key are
never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._spark import drawn, keep_ids, row_mark, small_batches, written
from rolegraph.llm._text import Words, binary_list, give_back, text_slices

PER_LABEL = 2_000
FLOOR, CHANCE = 0.05, 2.0
BLOCK = 64
K = 15
#: Weight of the share of toxic examples in a vote, against cosines of at most 1.
PRIOR = 0.25
#: Blocks that are scored before the first look at the bounds; texts that are scored at once.
FIRST = 3
AT_ONCE = 64
#: Terms of most postings whose weights are a matrix.
DENSE = 256
#: Frequent terms that place alike examples in one block.
ALIKE = 1_024
#: Tasks that the examples' own votes are spread over.
EXAMPLE_TASKS = 24

#: Bytes of lower-cased text that are no letters.
_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[97:123] = _OUTSIDE[128:] = False

_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct terms as hashes, how often it has them, and where each text's begin."""
    words = Words(data, offsets, outside=_OUTSIDE)
    doc = np.repeat(np.arange(len(offsets) - 1), words.counts())
    order = np.lexsort((words.hashes, doc))
    h, doc = words.hashes[order], doc[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(doc[at], np.arange(len(offsets)))


def known_terms(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for terms of the vocabulary: places, counts and begins."""
    h, count, begin = terms_of(data, offsets)
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == h
    return at[hit], count[hit], np.concatenate(([0], np.cumsum(hit)))[begin]


def runs(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and the range of each."""
    n = stop - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - (np.cumsum(n) - n - start)[of], of


def telling(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """The supervised factor of terms that so many examples of each label have."""
    t, o, p, q = toxic + 0.5, other + 0.5, n_toxic - toxic + 0.5, n_other - other + 0.5
    z = (np.log(t / p) - np.log(o / q)) / np.sqrt(1 / t + 1 / o + 1 / p + 1 / q)
    return np.maximum(FLOOR, abs(z) - CHANCE)


def alike_order(place: np.ndarray, weight: np.ndarray, begin: np.ndarray, terms: int) -> np.ndarray:
    """The examples in an order that puts alike ones side by side: halved again and again along their main direction."""
    n = len(begin) - 1
    common = np.argsort(-np.bincount(place, minlength=terms), kind="stable")[:ALIKE]
    row = np.full(terms, -1)
    row[common] = np.arange(len(common))
    x = np.zeros((n, len(common)), dtype=np.float32)
    some = row[place] >= 0
    x[np.repeat(np.arange(n), np.diff(begin))[some], row[place][some]] = weight[some]
    out, parts = [], [np.arange(n)]
    while parts:
        part = parts.pop()
        if len(part) <= BLOCK:
            out.append(part)
            continue
        own = x[part] - x[part].mean(axis=0)
        axis = own[np.argmax((own * own).sum(axis=1))]
        for _ in range(6):
            axis = own.T @ (own @ axis)
            axis /= np.sqrt((axis * axis).sum()) or 1
        part = part[np.lexsort((part, np.round(own @ axis, 5)))]
        half = -(-len(part) // (2 * BLOCK)) * BLOCK  # whole blocks on the left
        parts += [part[half:], part[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Index:
    """Labelled examples with a block-max inverted index."""

    vocabulary: np.ndarray  # ascending hashes
    factor: np.ndarray  # idf * telling of a term
    ids: np.ndarray
    labels: np.ndarray
    share: float
    block: int  # examples of a block
    row: np.ndarray  # of a term, its row of the matrix or -1
    matrix: np.ndarray  # dense terms x examples, blocks whole
    cell_start: np.ndarray  # of a term, its cells
    cell_block: np.ndarray
    cell_most: np.ndarray
    post_start: np.ndarray  # of a cell, its postings
    post_example: np.ndarray
    post_weight: np.ndarray
    curve: tuple[float, float] | None = None

    @staticmethod
    def of(vocabulary: np.ndarray, factor: np.ndarray, ids: np.ndarray, labels: np.ndarray, share: float, place: np.ndarray, count: np.ndarray, begin: np.ndarray) -> Index:
        """place, count, begin: the examples' terms as known_terms gives them."""
        weight = weights(factor, place, count, begin)
        order = alike_order(place, weight, begin, len(vocabulary))
        take, of = runs(begin[:-1][order], begin[1:][order])
        place, weight, example = place[take], weight[take], of
        by = np.lexsort((example, place))
        place, weight, example = place[by], weight[by], example[by]
        row = np.full(len(vocabulary), -1)
        dense = np.argsort(-np.bincount(place, minlength=len(vocabulary)), kind="stable")[:DENSE]
        row[dense] = np.arange(len(dense))
        matrix = np.zeros((len(dense), -(-len(ids) // BLOCK) * BLOCK))
        full = row[place] >= 0
        matrix[row[place[full]], example[full]] = weight[full]
        place, weight, example = place[~full], weight[~full], example[~full]
        key = place * (len(ids) // BLOCK + 1) + example // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        most = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        cell_start = np.searchsorted(place[first], np.arange(len(vocabulary) + 1))
        return Index(vocabulary, factor, ids[order], labels[order], share, BLOCK, row, matrix, cell_start, (example[first] // BLOCK).astype(np.int32), most, np.append(first, len(key)), example.astype(np.int32), weight)

    def nearest(self, place: np.ndarray, weight: np.ndarray, begin: np.ndarray, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of each text's K nearest examples with a cosine above 0, best first; leave: an id that doesn't count for each text."""
        docs, size = len(begin) - 1, self.matrix.shape[1]
        blocks, text = size // self.block, np.repeat(np.arange(docs), np.diff(begin))
        row = self.row[place]
        query = np.zeros((docs, len(self.matrix)))
        query[text[row >= 0], row[row >= 0]] = weight[row >= 0]
        acc = query @ self.matrix
        gone = None if leave is None else np.pad(leave[:, None] == self.ids, ((0, 0), (0, size - len(self.ids))))
        if gone is not None:
            acc[gone] = 0
        cell, of = runs(self.cell_start[place], self.cell_start[place + 1])
        doc, w = text[of], weight[of]
        slot = doc * blocks + self.cell_block[cell]
        bound = acc.reshape(docs, blocks, self.block).max(axis=2) + np.bincount(slot, w * self.cell_most[cell], minlength=docs * blocks).reshape(docs, blocks)
        done = bound <= 0
        first = min(FIRST, blocks)
        todo = ~done & (bound >= np.partition(bound, blocks - first, axis=1)[:, blocks - first : blocks - first + 1])
        least = np.zeros((docs, 1))
        while todo.any():
            pick = np.flatnonzero(todo.ravel()[slot])
            post, by = runs(self.post_start[cell[pick]], self.post_start[cell[pick] + 1])
            if len(post):
                acc += np.bincount(doc[pick][by] * size + self.post_example[post], w[pick][by] * self.post_weight[post], minlength=docs * size).reshape(docs, size)
            done |= todo
            if gone is not None:
                acc[gone] = 0
            if size > K:
                least = np.partition(acc, size - K, axis=1)[:, size - K : size - K + 1]
            todo = ~done & (bound >= least - 1e-9)
        acc = np.round(acc, 10)
        least = np.partition(acc, size - K, axis=1)[:, size - K : size - K + 1] if size > K else np.zeros((docs, 1))
        text, example = np.nonzero((acc >= least) & (acc > 0))
        cos = acc[text, example]
        order = np.lexsort((example, -cos, text))
        text, example, cos = text[order], example[order], cos[order]
        rank = np.arange(len(text)) - np.searchsorted(text, np.arange(docs))[text]
        return text[rank < K], example[rank < K], cos[rank < K]

    def votes(self, docs: int, text: np.ndarray, example: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """The neighbours' share of toxic ones, weighted by cosine."""
        return (np.bincount(text, cos * self.labels[example], minlength=docs) + PRIOR * self.share) / (np.bincount(text, cos, minlength=docs) + PRIOR)

    def judged(self, data: np.ndarray, offsets: np.ndarray, leave: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For AT_ONCE texts at a time: votes, which of them have a term, and the neighbours as nearest() gives them."""
        place, count, begin = known_terms(data, offsets, self.vocabulary)
        weight = weights(self.factor, place, count, begin)
        for a in range(0, len(offsets) - 1, AT_ONCE):
            cut = begin[a : a + AT_ONCE + 1]
            some = slice(cut[0], cut[-1])
            found = self.nearest(place[some], weight[some], cut - cut[0], None if leave is None else leave[a : a + AT_ONCE])
            yield self.votes(len(cut) - 1, *found), np.diff(cut) > 0, *found


def weights(factor: np.ndarray, place: np.ndarray, count: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The terms' weights in vectors of length 1."""
    w = (1 + np.log(count)) * factor[place]
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    norm = np.sqrt(np.bincount(doc, w * w, minlength=len(begin) - 1))
    return w / norm[doc]


def curved(curve: tuple[float, float], votes: np.ndarray) -> np.ndarray:
    """The calibrated scores of votes."""
    v = votes.clip(1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(curve[0] + curve[1] * np.log(v / (1 - v))).clip(-99, 99)))


def fitted(votes: np.ndarray, y: np.ndarray, of: np.ndarray) -> tuple[float, float]:
    """The logistic curve of the labels over the votes' log odds; of: how many rows each example stands for."""
    votes = votes.clip(1e-6, 1 - 1e-6)
    x = np.log(votes / (1 - votes))
    a, b = 0.0, 1.0
    for _ in range(50):  # Newton steps on the logistic likelihood, held near the identity
        p = 1 / (1 + np.exp(-(a + b * x).clip(-99, 99)))
        v, e = of * p * (1 - p), of * (y - p)
        g = np.array([e.sum() - a * 0.5, (e * x).sum() - (b - 1) * 0.5])
        h = np.array([[v.sum() + 0.5, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.5]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, terms as uint64, counts as uint32) of every example."""
    for batch in batches:
        for a, b, data, offsets in text_slices(batch.column(2)):
            h, count, begin = terms_of(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), binary_list(h, begin), binary_list(count.astype(np.uint32), begin)], names=["doc_id", "label", "terms", "counts"])


def _frequencies(vocabulary):
    """(place, df): in how many texts of a task each term of the vocabulary occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.value), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                total += np.bincount(known_terms(data, offsets, vocabulary.value)[0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "df"])

    return run


def _own_votes(shared):
    """(label, vote) of the examples, themselves left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                found = shared.value.judged(data, offsets, batch.column(0).slice(a, b - a).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(np.concatenate([x[0] for x in found]))], names=["label", "vote"])

    return run


def _scores(shared):
    """(what stands before the text, score, evidence) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for a, _, data, offsets in text_slices(batch.column(batch.num_columns - 1)):
                for votes, some, text, example, cos in index.judged(data, offsets):
                    best = np.arange(len(text)) - np.searchsorted(text, np.arange(len(votes)))[text] < 3
                    text, example = text[best], example[best]
                    told = pa.StructArray.from_arrays([pa.array(index.ids[example]), pa.array(index.labels[example].astype(np.int32)), pa.array(cos[best])], fields=list(_EVIDENCE.value_type))
                    told = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(votes) + 1)).astype(np.int32)), told)
                    score = np.where(some, curved(index.curve, votes), index.share)
                    names = [*batch.schema.names[:-1], "score", "evidence"]
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, len(votes)) for c in batch.columns[:-1]), pa.array(score), told], names=names)
                    a += len(votes)

    return run


def build_index(ids: np.ndarray, labels: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, share: float, document_frequencies) -> Index:
    """An index, not calibrated yet, of examples with so many (sizes) of the terms each; document_frequencies: of a vocabulary, (documents, their numbers with each term)."""
    vocabulary, place = np.unique(terms, return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    seen: set[tuple] = set()  # copies count once in what a term tells
    apart = np.array([(k := (y, terms[s:e].tobytes())) not in seen and not seen.add(k) for y, s, e in zip(labels.tolist(), begin, begin[1:])], dtype=bool)
    example = np.repeat(np.arange(len(ids)), sizes)
    toxic, other = (np.bincount(place[(apart & (labels == y))[example]], minlength=len(vocabulary)) for y in (1, 0))
    n, df = document_frequencies(vocabulary)
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    return Index.of(vocabulary, idf * telling(toxic, other, int((apart & (labels == 1)).sum()), int((apart & (labels == 0)).sum())), ids, labels, share, place, counts, begin)


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, text: str = "text", key: str = "doc_id", label: str = "toxic", marks: bool = False) -> DataFrame:
    """(doc_id, score, evidence array<struct<doc_id, label, cosine>>), a row for each row of docs; (doc_id, mark, ...) where `marks`, with row_mark() of the text.

    labels has the key and the label 0 or 1; `learn` says, by the key, which rows may be learned from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.lower(text).alias("text"))
    lead = ["doc_id", "mark"] if marks else ["doc_id"]
    named = docs.select(F.col(key).cast("long").alias("doc_id"), row_mark(F.col(text)).alias("mark"), F.lower(text).alias("text")).select(*lead, "text")
    alike = named.select(*lead, F.lit(0.0).alias("score"), F.array().cast("array<struct<doc_id:long,label:int,cosine:double>>").alias("evidence"))
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return alike.withColumn("score", F.lit(share))
    known = known.where(F.when(F.col("label") == 1, drawn("doc_id", PER_LABEL, sizes[1])).otherwise(drawn("doc_id", PER_LABEL, sizes[0])))
    marked = rows.join(F.broadcast(written(known, "toxic-labels")), "doc_id").select("doc_id", "label", "text")  # about 2 * PER_LABEL labels
    found = marked.mapInArrow(_examples, "doc_id long, label int, terms binary, counts binary").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    column = lambda k, kind: np.frombuffer(b"".join(found[k].to_pylist()), kind).astype(np.uint64 if k == "terms" else np.int64)

    def document_frequencies(vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
        shared = spark.sparkContext.broadcast(vocabulary)
        own = rows.select("text").mapInArrow(_frequencies(shared), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
        shared.destroy()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        df[own["place"].to_numpy()] = own["df"].to_numpy()
        return rows.count(), df

    y = found["label"].to_numpy()
    index = build_index(found["doc_id"].to_numpy(), y.astype(np.float64), column("terms", np.uint64), column("counts", np.uint32), np.array([len(x) // 8 for x in found["terms"].to_pylist()], dtype=np.int64), share, document_frequencies)
    if not len(index.ids):
        return alike.withColumn("score", F.lit(share))
    del found
    give_back()
    shared = spark.sparkContext.broadcast(index)
    own = marked.repartition(EXAMPLE_TASKS).mapInArrow(_own_votes(shared), "label int, vote double").toArrow()
    shared.destroy()
    tried = own["label"].to_numpy()
    of = np.where(tried == 1, max(1, sizes[1] / PER_LABEL), max(1, sizes[0] / PER_LABEL))
    index.curve = fitted(own["vote"].to_numpy(), tried.astype(np.float64), of)
    return named.mapInArrow(_scores(spark.sparkContext.broadcast(index)), ", ".join(f"{c} long" for c in lead) + ", score double, evidence array<struct<doc_id:long,label:int,cosine:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, learn: Column | None = None, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose score is below 0.5, with all their columns; every row by its own text, whatever its key."""
    found = score_toxicity(docs, labels, learn, text, key, marks=True, **options).where("score >= 0.5")
    return keep_ids(docs, written(found.select("doc_id", "mark").distinct(), "toxic-found"), "left_anti", key, text)
