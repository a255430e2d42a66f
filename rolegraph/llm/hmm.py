"""Language-model scores from a hidden Markov model trained by Baum-Welch over the whole corpus.

Base model.  A text's tokens are its lower-cased words and one end.  A token's base probability is
(c + 0.5) / (N + 0.5 (V + 1)) from counts over all training texts.

Hidden Markov model.  Latent states emit word classes: every word that the training texts hold
OWN_COUNT times or more is a class of its own (the OWN_MOST most frequent at most), the end is one,
and other words fall into ENDINGS classes by their last two bytes.  A word's probability is its
class's under the model times the base probability of the word within its class, so the model is a
distribution over the same texts, and

    score = log10 P(classes) + base score - sum of the classes' base log10 probabilities.

Training reads all training texts each time.  It starts from how often each class stands before each
of CONTEXTS buckets of classes, a table of fixed size that all tasks add to: on the driver, states
drift apart until their mixture explains this table.  Then Baum-Welch runs ROUNDS times: every task
runs the scaled forward and backward recursions over its whole texts and sends its expected counts,
which are summed in two steps.  Scoring runs the scaled forward recursion over each whole text.

Counts are looked up where they are: the HEAD most frequent words are broadcast (a fixed size), the
rest of a text's words join the count table by shuffle; a word frequent enough to make that join
uneven is in the head.

Defined cases: a null, empty or blank text is the end alone; a word that no training text holds has
c = 0; with no training text every token is unknown (N = 0, V = 0) and all classes are alike;
repeated rows are scored (and learned from) each; an empty table gives an empty result; columns other
than key and text are never read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._spark import release, small_batches, written
from rolegraph.llm._text import Words, binary_list, give_back, int64, mix64, text_slices

STATES = 8
OWN_COUNT, OWN_MOST = 200, 8_192
ENDINGS = 512
HEAD = 1 << 18
#: Buckets of the class that follows, and steps of the mixture over the whole table.
CONTEXTS = 64
CONTEXT_STEPS = 200
ROUNDS = 2
RUN = 128
#: Tokens that a task holds at once, about: while scoring, while training.
HOLD, HOLD_TRAIN = 1 << 20, 1 << 18
#: Texts of up to so many tokens train together, so that the recursions run over many texts a step.
LENGTHS = (256, 1_024, 4_096)
STAY = 0.9
SMOOTH = 20.0


def endings(words: Words) -> np.ndarray:
    """Each word's place among the ENDINGS by its last two bytes."""
    last = words.data[words.ends - 1].astype(np.uint64)
    short = words.ends - words.starts < 2
    before = np.where(short, 0, words.data[np.maximum(words.ends - 2, 0)]).astype(np.uint64)
    low = lambda x: np.where((x >= 65) & (x < 91), x + 32, x)
    return (mix64(low(before).astype(np.uint64) * np.uint64(256) + low(last).astype(np.uint64)) % np.uint64(ENDINGS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ending, c): a task's counts, summed over several slices at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        h, e = (np.concatenate(x) for x in zip(*held))
        held.clear()
        h, first, c = np.unique(h, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(int64(h)), pa.array(e[first].astype(np.int32)), pa.array(c.astype(np.int64))], names=["word", "ending", "c"])

    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0)):
            words = Words(data, offsets)
            held.append((words.hashes, endings(words).astype(np.int16)))
            size += len(words.hashes)
            if size >= 4 << 20:
                yield flush()
                size = 0
    if held:
        yield flush()


@dataclass
class Lexicon:
    """What every task needs to know of the counts: the head, and the classes' base probabilities."""

    words: np.ndarray  # ascending hashes of the head
    counts: np.ndarray
    classes: np.ndarray  # of the head's words: an own class, or -1 for the ending's
    own: int  # own classes; the end's follows them, then those of the endings
    end: float  # log10 (c + 0.5) of the end
    total: int
    log_scale: float
    class_log: np.ndarray  # log10 of each class's base probability

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.searchsorted(self.words, h)
        at[at == len(self.words)] = 0
        return at, self.words[at] == h

    def sequence(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the documents' tokens, ends included, their begins, and for the words: place in the head, whether there."""
        at, there = self.find(words.hashes)
        own = np.where(there, self.classes[at], -1) if len(self.words) else np.full(len(at), -1)
        own = np.where(own >= 0, own, endings(words) + self.own + 1)
        docs = len(words.first) - 1
        out = np.full(len(own) + docs, self.own, dtype=np.int16)
        keep = np.ones(len(out), dtype=bool)
        keep[words.first[1:] + np.arange(docs)] = False
        out[keep] = own
        return out, words.first + np.arange(docs + 1), at, there


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes

    def expect(self, classes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts over whole sequences: starts, moves, emissions; and their log10 likelihood."""
        n = np.diff(begin)
        order = np.argsort(-n, kind="stable")
        s, n = begin[:-1][order], n[order]
        longest = int(n[0]) if len(n) else 0
        alive = np.searchsorted(-n, -np.arange(longest), side="left").tolist()  # sequences longer than t
        k, emit, back = len(self.start), np.ascontiguousarray(self.emit.T), np.ascontiguousarray(self.move.T)
        alpha, scale, seen = [], [], []
        for t, m in enumerate(alive):
            c = classes[s[:m] + t]
            a = (self.start if t == 0 else alpha[-1][:m] @ self.move) * emit[c]
            z = np.add.reduce(a, axis=1)[:, None]
            a /= z
            alpha.append(a)
            scale.append(z)
            seen.append(c)
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((len(emit), k))
        gammas = []
        for t in range(longest - 1, -1, -1):
            beta, m = np.ones((alive[t], k)), alive[t + 1] if t + 1 < longest else 0
            if m:
                w = emit[seen[t + 1]] * ahead
                w /= scale[t + 1]
                moves += alpha[t][:m].T @ w
                beta[:m] = w @ back
            gammas.append(alpha[t] * beta)  # sums to one, as the scales are those of the forward recursion
            ahead = beta
        moves *= self.move
        if longest:
            starts += gammas[-1].sum(axis=0)
            every, own = np.concatenate(seen), np.concatenate(gammas[::-1])
            for j in range(k):
                emits[:, j] = np.bincount(every, weights=own[:, j], minlength=len(emit))
        return starts, moves, emits.T, float(np.log10(np.concatenate(scale)).sum()) if longest else 0.0

    def log10(self, classes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log10 probability of each whole sequence by the scaled forward recursion."""
        n = np.diff(begin)
        order = np.argsort(-n, kind="stable")
        s, n = begin[:-1][order], n[order]
        total = np.zeros(len(n))
        emit = np.ascontiguousarray(self.emit.T)
        alive = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
        a = None
        for t, m in enumerate(alive.tolist()):
            a = (self.start if t == 0 else a[:m] @ self.move) * emit[classes[s[:m] + t]]
            z = a.sum(axis=1)
            a /= z[:, None]
            total[:m] += np.log10(z)
        out = np.empty(len(n))
        out[order] = total
        return out


def reestimate(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, base: np.ndarray) -> Hmm:
    """The model of the expected counts; emissions lean on the classes' base probabilities."""
    emit = emits + SMOOTH * base
    return Hmm((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def begin_model(base: np.ndarray, sample: list[np.ndarray], states: int, steps: int, seed: int = 5) -> Hmm:
    rng = np.random.default_rng(seed)
    emit = base * rng.gamma(4.0, 0.25, (states, len(base)))
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    model = Hmm(np.full(states, 1 / states), move, emit)
    if sample:
        sample = [x[k : k + RUN] for x in sample for k in range(0, len(x), RUN)]
        classes, begin = np.concatenate(sample), np.concatenate(([0], np.cumsum([len(x) for x in sample])))
        for _ in range(steps):
            model = reestimate(*model.expect(classes, begin)[:3], base)
    return model


def split_states(model: Hmm, follows: np.ndarray, base: np.ndarray, steps: int) -> Hmm:
    """The model with the starts and emissions of a mixture over (class, bucket of the next class), fitted to all their counts."""
    if not follows.any():
        return model
    share, emit = model.start, model.emit
    after = emit @ follows
    after /= after.sum(axis=1, keepdims=True)
    for _ in range(steps):
        ratio = follows / np.maximum((share[:, None] * emit).T @ after, 1e-300)
        own, after = emit * (share[:, None] * (after @ ratio.T)), after * (share[:, None] * (emit @ ratio))
        mass = own.sum(axis=1)
        share, after = mass / mass.sum(), after / np.maximum(after.sum(axis=1, keepdims=True), 1e-300)
        emit = own / np.maximum(mass[:, None], 1e-300)
    emit = own + SMOOTH * base
    return Hmm((mass + 1) / (mass + 1).sum(), model.move, emit / emit.sum(axis=1, keepdims=True))


def _follows(width: int):
    """(part, counts): a task's counts of each class before each bucket of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * CONTEXTS, dtype=np.int64)
        bucket = (mix64(np.arange(width, dtype=np.uint64)) % np.uint64(CONTEXTS)).astype(np.int64)
        some = False
        for batch in batches:
            for x in batch.column(0).to_pylist():
                classes = np.frombuffer(x, np.int16).astype(np.int64)
                np.add.at(total, classes[:-1] * CONTEXTS + bucket[classes[1:]], 1)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 8], pa.int32()), pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["part", "counts"])

    return run


def _sequences(lexicon):
    """Classes of every text, as int16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                classes, begin, _, _ = lexicon.value.sequence(Words(data, offsets))
                yield pa.RecordBatch.from_arrays([binary_list(classes, begin)], names=["classes"])

    return run


def _expected(model):
    """(part, counts): a task's expected counts over sequences, texts of like lengths together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        held: list[list[np.ndarray]] = [[] for _ in range(len(LENGTHS) + 1)]
        size = [0] * len(held)

        def add(k: int) -> None:
            nonlocal total
            if held[k]:
                *counts, like = model.value.expect(np.concatenate(held[k]), np.concatenate(([0], np.cumsum([len(x) for x in held[k]]))))
                total = total + np.append(np.concatenate([x.ravel() for x in counts]), like)
            held[k], size[k] = [], 0

        for batch in batches:
            for x in batch.column(0).to_pylist():
                classes = np.frombuffer(x, np.int16)
                k = bisect.bisect_left(LENGTHS, len(classes))
                held[k].append(classes)
                size[k] += len(classes)
                if size[k] >= HOLD_TRAIN:
                    add(k)
            give_back()
        for k in range(len(held)):
            add(k)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    return run


def _sum(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0.0
    for part in parts:
        for blob in part["counts"].to_pylist():
            total = total + np.frombuffer(blob)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])


def _scores(lexicon, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, hmm = lexicon.value, model.value
        logs = np.log10(lex.counts + 0.5)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            keys, classes, sizes, base, class_logs, known, tails = zip(*held)
            held.clear()
            size = 0
            begin = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            latent = hmm.log10(np.concatenate(classes), begin) - np.concatenate(class_logs)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(np.diff(begin)), pa.array(np.concatenate(known)), pa.array(np.concatenate(base)), pa.array(latent), pa.concat_arrays(tails)], names=["doc_id", "n_tokens", "known", "head", "latent", "tail"])

        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                classes, begin, at, there = lex.sequence(words)
                first, docs = words.first, b - a
                sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first])
                logsum = sums(np.where(there, logs[at], 0.0) if len(logs) else np.zeros(len(at)))
                classlog = np.diff(np.concatenate(([0.0], np.cumsum(lex.class_log[classes])))[begin])
                known = sums(there.astype(np.int64)) + (1 if lex.total else 0)
                stops = np.concatenate(([0], np.cumsum(~there)))[first].astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(stops), pa.array(int64(words.hashes[~there])))
                held.append((batch.column(0).slice(a, docs), classes, np.diff(begin), logsum + lex.end, classlog, known, tail))
                size += len(classes)
                if size >= HOLD:
                    yield flush()
        if held:
            yield flush()

    return run


def _head(counts: DataFrame) -> dict[str, np.ndarray]:
    """The most frequent words, HEAD at most: all whose count reaches a bound, found from a histogram of counts."""
    bucket = F.floor(8 * F.log2("c"))
    least, size = None, 0
    for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect():  # eight for each power of two
        size += r.n
        if size > HEAD:
            break
        least = r.b
    if least is None:
        return {"word": np.zeros(0, np.int64), "c": np.zeros(0, np.int64)}
    got = counts.where(bucket >= least).select("word", "c").toArrow()
    return {k: got[k].to_numpy() for k in ("word", "c")}


def score_lm(docs: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs; `learn` says which rows train."""
    spark = docs.sparkSession
    small_batches(spark)
    share = lambda x: spark.sparkContext.broadcast(x)
    train = docs.where(learn).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = written(train.select("text").mapInArrow(_counts, "word long, ending int, c long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("c").alias("c")), "lm-counts")
    sums = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    texts = train.count()
    total, distinct = sums.n + texts, sums.v + (1 if texts else 0)
    head = _head(counts)
    order = np.lexsort((head["word"], -head["c"]))  # by count
    head = {k: v[order] for k, v in head.items()}
    words = head["word"].view(np.uint64)
    order = np.argsort(words)
    words, c = words[order], head["c"][order]
    n_own = int(min(OWN_MOST, (head["c"] >= OWN_COUNT).sum()))
    own = np.where(order < n_own, order, -1)  # the place by count, of the most frequent
    by_class = np.zeros(n_own + 1 + ENDINGS)
    for r in counts.groupBy("ending").agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
        by_class[n_own + 1 + r.ending] = r.m
    by_class[:n_own] = head["c"][:n_own] + 0.5
    top = spark.createDataFrame([(int(w),) for w in head["word"][:n_own]], "word long")  # OWN_MOST rows at most
    for r in counts.join(F.broadcast(top), "word").groupBy("ending").agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
        by_class[n_own + 1 + r.ending] -= r.m
    by_class[n_own + 1 :] = np.maximum(by_class[n_own + 1 :], 0) + 0.5  # unknown words with the ending
    by_class[n_own] = texts + 0.5
    scale = total + 0.5 * (distinct + 1)
    lexicon = share(Lexicon(words, c, own, n_own, float(np.log10(texts + 0.5)), total, float(np.log10(scale)), np.log10(by_class / scale)))
    base = by_class / by_class.sum()

    sequences = written(train.select("text").mapInArrow(_sequences(lexicon), "classes binary"), "lm-sequences")

    def summed(function) -> list:
        return sorted(sequences.mapInArrow(function, "part int, counts binary").groupBy("part").applyInArrow(_sum, "part int, counts binary").collect(), key=lambda r: r.part)  # 32 rows at most

    follows = sum((np.frombuffer(r.counts) for r in summed(_follows(len(base)))), np.zeros(len(base) * CONTEXTS))
    model = split_states(begin_model(base, [], states, 0), follows.reshape(len(base), CONTEXTS), base, CONTEXT_STEPS)
    for _ in range(rounds if texts else 0):
        flat = sum(np.frombuffer(r.counts) for r in summed(_expected(share(model))))
        k = states
        model = reestimate(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1].reshape(k, len(base)), base)

    release(spark, sequences)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = rows.mapInArrow(_scores(lexicon, share(model)), "doc_id long, n_tokens long, known long, head double, latent double, tail array<long>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    tail = scored.select("row", F.explode("tail").alias("word")).join(counts.select("word", "c"), "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest"), F.count("c").alias("more"))
    out = scored.select("row", "doc_id", "n_tokens", "known", "head", "latent").join(tail, "row", "left")
    base_score = F.col("head") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(scale))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base_score.alias("base_score"), (base_score + F.col("latent")).alias("score"))
