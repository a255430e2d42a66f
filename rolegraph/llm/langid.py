"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte n-grams of GRAMS lengths over lower-cased text with white space as one
kind of edge and digits as one sign; each is hashed to one of BUCKETS embeddings, the text is their
average, and a softmax over the average gives the language.  Training is mini-batch stochastic
gradient descent in numpy on at most PER_LANG texts of each language, drawn by a hash of the key; a
fifth of them is set aside to fit the temperature that calibrates scores and the threshold below
which a prediction is marked as rejected.  Embeddings and softmax multiply out to one vector of
scores per bucket, so applying the model is a sum over a text's subwords.

Defined cases: a null text, or one without a letter of any script, is `und` with score 0; rows
without a language are never learned from; with nothing to learn from every text is `und`; repeated
rows are predicted each; an empty table gives an empty result; language, source and key are never
inputs of a prediction.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._spark import drawn, small_batches
from rolegraph.llm._text import LOWER, SEPARATOR, mix64, stream, text_slices

GRAMS = (1, 2, 3)
BUCKETS = 1 << 13
DIM = 16
PER_LANG = 1200
EPOCHS, BATCH, RATE = 12, 32, 4.0
#: With fewer texts set aside the temperature is 1 and nothing is rejected.
LEAST_HELD = 20
#: Of the calibration texts that are predicted right, the share that the threshold lets through.
PASS = 0.995

_SIGN = stream(31, 256)
_FOLD = LOWER.copy()
_FOLD[SEPARATOR] = 0x20
_FOLD[48:58] = 48
_SIGN = _SIGN[_FOLD]
_STEP = stream(37, 8) | np.uint64(1)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: buckets of a slice's n-grams, and where each document's begin."""
    signs = _SIGN[data]
    size = np.diff(offsets)
    for n in GRAMS:
        if len(data) < n:
            continue
        acc = signs[: len(data) - n + 1] * _STEP[0]
        for k in range(1, n):
            acc = acc + signs[k : len(data) - n + 1 + k] * _STEP[k]
        bucket = (mix64(acc + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        inside = np.ones(len(bucket), dtype=bool)
        for k in range(1, n):  # n-grams that reach into the next document
            edge = offsets[1:-1] - k
            inside[edge[(edge >= 0) & (edge < len(bucket))]] = False
        begin = np.concatenate(([0], np.cumsum(np.maximum(0, size - n + 1))))
        yield bucket[inside], begin


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
    return out


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x langs
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        docs = len(offsets) - 1
        total, count = np.zeros((docs, len(self.langs))), np.zeros(docs)
        for bucket, begin in subwords(data, offsets):
            full = np.flatnonzero(np.diff(begin))
            if len(full):
                total[full] += np.add.reduceat(self.scores[bucket], begin[:-1][full], axis=0)
                count += np.diff(begin)
        return total / np.maximum(count, 1)[:, None] + self.bias


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, buckets as uint16, shares as float32): a text's average as a sparse vector."""
    for batch in batches:
        for a, b, data, offsets in text_slices(batch.column(1)):
            parts = list(subwords(data, offsets))
            where, share = [], []
            for i in range(b - a):
                own = np.bincount(np.concatenate([x[s[i] : s[i + 1]] for x, s in parts]) if parts else np.zeros(0, np.int64), minlength=BUCKETS)
                some = np.flatnonzero(own)
                where.append(some.astype(np.uint16).tobytes())
                share.append((own[some] / max(1, own.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(where, pa.binary()), pa.array(share, pa.binary())], names=["lang", "buckets", "shares"])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(examples: list[tuple[str, bytes, bytes]], seed: int = 7) -> Model | None:
    """Fit embeddings, softmax, temperature and threshold; examples as _histograms gives them."""
    if not examples:
        return None
    langs = sorted({e[0] for e in examples})
    y = np.array([langs.index(e[0]) for e in examples])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(examples))
    held = order[: len(order) // 5]
    fit = order[len(order) // 5 :]

    def dense(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), dtype=np.float32)
        for r, i in enumerate(rows):
            out[r, np.frombuffer(examples[i][1], np.uint16)] = np.frombuffer(examples[i][2], np.float32)
        return out

    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    out = (rng.standard_normal((DIM, len(langs))) * 0.1).astype(np.float32)
    bias = np.zeros(len(langs), dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(fit)
        for k in range(0, len(fit), BATCH):
            rows = fit[k : k + BATCH]
            x = dense(rows)
            mean = x @ emb
            wrong = _softmax(mean @ out + bias)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            wrong /= len(rows)
            back = wrong @ out.T
            out -= rate * mean.T @ wrong
            bias -= rate * wrong.sum(axis=0)
            emb -= rate * x.T @ back
    scores = (emb @ out).astype(np.float64)
    if len(held) < LEAST_HELD:
        return Model(langs, scores, bias.astype(np.float64), 1.0, 0.0)
    judge = held
    logits = np.concatenate([dense(judge[k : k + 256]) @ scores for k in range(0, len(judge), 256)]) + bias
    best = min((float(-np.log(_softmax(logits / t)[np.arange(len(judge)), y[judge]] + 1e-12).mean()), t) for t in np.geomspace(0.05, 5, 40))
    p = _softmax(logits / best[1])
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[judge]])
    return Model(langs, scores, bias.astype(np.float64), best[1], float(right[int(len(right) * (1 - PASS))]) if len(right) else 1.0)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                known = has_letter(data, offsets) & (model is not None)
                names, score = np.full(b - a, "und", dtype=object), np.zeros(b - a)
                if model is not None:
                    p = _softmax(model.logits(data, offsets) / model.temperature)
                    names[known] = np.array(model.langs, dtype=object)[p.argmax(axis=1)][known]
                    score[known] = np.clip(p.max(axis=1), 0, 1)[known]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(score), pa.array(score < (model.threshold if model else 1.0))], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def fit_langid(docs: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", lang: str = "lang") -> Model | None:
    """A model from at most about PER_LANG rows of each language among those that `learn` allows."""
    small_batches(docs.sparkSession)
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    sample = rows.where(functools.reduce(lambda a, x: a | x, [(F.col("lang") == k) & drawn("doc_id", PER_LANG, n) for k, n in sorted(sizes.items())])).select("lang", "text")
    return train(sorted((r.lang, bytes(r.buckets), bytes(r.shares)) for r in sample.mapInArrow(_histograms, "lang string, buckets binary, shares binary").toLocalIterator()))


def predict_lang(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, rejected), a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, rejected boolean")
