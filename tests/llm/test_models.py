import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolegraph.llm import hmm, langid

from .conftest import prose


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))


# hidden Markov model


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = hmm.Hmm(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 5))))
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 2, 5)]
    classes, begin = np.concatenate(seqs), np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
    got = m.log10(classes, begin)
    for s, x in zip(seqs, got):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[path[0], s[0]]
            for a, b, c in zip(path, path[1:], s[1:]):
                p *= m.move[a, b] * m.emit[b, c]
            total += p
        assert x == pytest.approx(math.log10(total))
    starts, moves, emits, like = m.expect(classes, begin)
    assert starts.sum() == pytest.approx(4) and moves.sum() == pytest.approx(len(classes) - 4) and emits.sum() == pytest.approx(len(classes))
    assert like == pytest.approx(got.sum())


def test_training_never_lowers_the_likelihood(monkeypatch):
    monkeypatch.setattr(hmm, "SMOOTH", 0.0)
    rng = np.random.default_rng(2)
    seqs = [np.concatenate([rng.integers(0, 6, 30), rng.integers(5, 12, 30)]) for _ in range(20)]
    classes, begin = np.concatenate(seqs), np.arange(0, 1201, 60)
    base = np.full(12, 1 / 12)
    m, last = hmm.begin_model(base, [], 3, 0), -np.inf
    for _ in range(8):
        *counts, like = m.expect(classes, begin)
        assert like >= last - 2  # the moves and starts are smoothed by one
        last, m = like, hmm.reestimate(*counts, base)
    assert last > m.log10(classes, begin).sum() * 1.2


@pytest.mark.parametrize("head", [1 << 19, 7])
def test_base_scores(docs, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD", head)
    rows = docs.collect()
    learn = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 != 1
    c, texts = Counter(), 0
    for r in rows:
        if learn(r.doc_id):
            c.update(words(r.text))
            texts += 1
    n, v = sum(c.values()) + texts, len(c) + 1
    want = []
    for r in rows:
        w = words(r.text)
        want.append((r.doc_id, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((texts + 0.5) / (n + 0.5 * (v + 1)))))
    got = hmm.score_lm(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, rounds=1).collect()
    key = lambda x: (str(x[0]), x[1])
    for g, x in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == x[:4] and g[4] == pytest.approx(x[4]) and math.isfinite(g[5])


def test_scores_without_training(docs, no_docs):
    got = hmm.score_lm(docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in got} == {(0, 0)}
    assert hmm.score_lm(no_docs, F.lit(True)).count() == 0


# languages


def test_languages(spark, docs, no_docs):
    r = random.Random(3)
    stock = {"aa": ["kolu", "mera", "tipan", "soka"], "bb": ["schwer", "tzung", "pfahl", "ksch"], "cc": ["éaux", "ième", "çeau", "ouè"]}
    rows = [(i, " ".join(r.choice(stock[k]) + r.choice(stock[k]) for _ in range(r.randrange(1, 30))), k) for i, k in enumerate(r.choices(list(stock), k=300))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_langid(table, F.col("doc_id") % 2 == 0)
    got = {x.doc_id: x.lang_pred for x in langid.predict_lang(table, model).collect()}
    assert sum(got[i] == k for i, _, k in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 ... €"), (4, "日本"), (5, "schwertzung " * 9000)], "doc_id long, text string")
    got = {x.doc_id: x for x in langid.predict_lang(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und" and got[5].lang_pred == "bb"
    assert {x.lang_pred for x in langid.predict_lang(docs, langid.fit_langid(no_docs, F.lit(True))).collect()} == {"und"}
    assert langid.predict_lang(no_docs, model).count() == 0


def mixed(x):
    mask = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & mask
    return x ^ (x >> 31)


def test_languages_against_a_loop(spark):
    r = random.Random(5)
    stock = {"aa": ["kolu", "mera", "tipan"], "bb": ["schwer", "tzung", "pfahl"], "cc": ["éaux", "ième", "çeau"]}
    rows = [(i, " ".join(r.choice(stock[k]) for _ in range(r.randrange(1, 20))), k) for i, k in enumerate(r.choices(list(stock), k=400))]
    model = langid.fit_langid(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    odd = [(900, "Kolu 12 MERA\tx"), (901, "é"), (902, "a"), (903, "schwer " * 4000), (904, "schwer kolu"), (904, "schwer kolu"), (905, rows[0][1]), (906, None), (907, "日本語 42")]
    texts = [(k, t) for k, t, _ in rows[:60]] + odd
    signs, step = [int(x) for x in langid._SIGN], [int(x) for x in langid._STEP]
    for got, (k, t) in zip(sorted(langid.predict_lang(spark.createDataFrame(texts, "doc_id long, text string"), model).collect(), key=lambda x: (x.doc_id)), sorted(texts, key=lambda x: x[0]), strict=True):
        if t is None:
            assert (got.lang_pred, got.score) == ("und", 0)
            continue
        data, total, n = t.encode(), np.zeros(len(model.langs)), 0
        for size in langid.GRAMS:
            for i in range(len(data) - size + 1):
                acc = sum(signs[data[i + j]] * step[j] for j in range(size)) + size & (1 << 64) - 1
                total += model.scores[mixed(acc) % langid.BUCKETS]
                n += 1
        x = np.exp((total / max(n, 1) + model.bias) / model.temperature)
        x /= x.sum()
        assert got.lang_pred == model.langs[int(x.argmax())] and got.score == pytest.approx(x.max(), abs=1e-9)
        assert got.rejected == (got.score < model.threshold)


def test_few_examples_and_equal_draws(spark):
    few = spark.createDataFrame([(1, "kolu mera", "aa"), (1, "kolu mera", "aa"), (2, "schwer", "bb"), (3, None, "aa"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit_langid(few, F.lit(True))
    assert model.langs == ["aa", "bb"] and model.temperature == 1 and model.threshold == 0
    assert len(langid.predict_lang(few, model).collect()) == 5


def test_whole_texts_train_without_cuts():
    rng = np.random.default_rng(3)
    m = hmm.begin_model(np.full(6, 1 / 6), [rng.integers(0, 6, 300) for _ in range(4)], 3, 2)
    classes, begin = rng.integers(0, 6, 900), np.array([0, 1, 500, 900])
    starts, moves, emits, like = m.expect(classes, begin)
    assert starts.sum() == pytest.approx(3) and moves.sum() == pytest.approx(897) and like == pytest.approx(m.log10(classes, begin).sum())


def test_the_start_counts_every_training_text(spark, monkeypatch):
    seen = []
    was = hmm.split_states

    def spy(model, follows, base, steps):
        seen.append(follows)
        return was(model, follows, base, steps)

    monkeypatch.setattr(hmm, "split_states", spy)
    rows = [(i, prose(i, 1 + i % 23)) for i in range(1_000)]  # more than the 800 that the start once drew
    got = hmm.score_lm(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), F.col("doc_id") % 10 != 0, rounds=0).collect()
    assert len(got) == 1_000 and all(math.isfinite(r.score) for r in got)
    assert seen[0].sum() == sum(len(words(t)) for k, t in rows if k % 10)  # each word stands before a word or the end


def test_states_split_by_what_follows():
    rng = np.random.default_rng(4)
    base = np.full(40, 1 / 40)
    follows = np.zeros((40, 16))
    follows[:20, :8], follows[20:, 8:] = rng.integers(50, 90, (20, 8)), rng.integers(50, 90, (20, 8))
    m = hmm.split_states(hmm.begin_model(base, [], 2, 0), follows, base, 200)
    one = m.emit[:, :20].sum(axis=1)
    assert one.max() > 0.95 and one.min() < 0.05 and m.start.sum() == pytest.approx(1) and m.emit.sum(axis=1) == pytest.approx(1)
    same = hmm.begin_model(base, [], 2, 0)
    assert hmm.split_states(same, np.zeros((40, 16)), base, 5) is same
