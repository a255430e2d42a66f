import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from rolegraph.llm import toxicity

from .conftest import prose


def terms(text):
    return Counter(re.findall(r"[a-z\x80-\U0010FFFF]+", (text or "").lower()))


def brute(rows, labels, learn):
    """doc_id to (score, evidence ids) by dense cosines with every example."""
    texts = dict(rows)
    known = {k: y for k, y in labels if learn(k)}
    share = sum(known.values()) / len(known)
    known = {k: y for k, y in known.items() if k in texts}
    every = {k: terms(t) for k, t in rows}
    ids = sorted(known)
    vocabulary = sorted(set().union(*(every[k] for k in ids)))
    place = {t: i for i, t in enumerate(vocabulary)}
    apart = {(known[k], frozenset(every[k])): k for k in reversed(ids)}.values()
    n = {y: sum(known[k] == y for k in apart) for y in (0, 1)}
    weight = np.zeros(len(vocabulary))
    for t, i in place.items():
        df = sum(t in c for c in every.values())
        a, b = (sum(t in every[k] for k in apart if known[k] == y) + 0.5 for y in (1, 0))
        p, q = n[1] - a + 1, n[0] - b + 1
        z = (math.log(a / p) - math.log(b / q)) / math.sqrt(1 / a + 1 / b + 1 / p + 1 / q)
        weight[i] = (math.log((len(rows) + 1) / (df + 1)) + 1e-3) * max(0.05, abs(z) - 2)

    def vector(k):
        v = np.zeros(len(vocabulary))
        for t, c in every[k].items():
            if t in place:
                v[place[t]] = (1 + math.log(c)) * weight[place[t]]
        return v / (np.linalg.norm(v) or 1)

    full = np.array([vector(k) for k in ids])
    y = np.array([known[k] for k in ids], float)

    def vote(k, leave):
        cos = np.round(full @ vector(k), 10)
        if leave:
            cos[ids.index(k)] = 0
        at = np.argsort(-cos, kind="stable")[: toxicity.K]
        at = at[cos[at] > 0]
        return (cos[at] @ y[at] + 0.25 * share) / (cos[at].sum() + 0.25), np.sort(cos[at])[::-1]

    curve = toxicity.fitted(np.array([vote(k, True)[0] for k in ids]), y, np.ones(len(ids)))
    out = {}
    for k in every:
        v, cos = vote(k, False)
        out[k] = (float(toxicity.curved(curve, np.array(v))) if vector(k).any() else share, cos[:3])
    return out


def labelled(seed, n, mark=("grobnak", "grobnaks", "vilestuff")):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        y = int(r.random() < 0.25)
        w = prose(i, 40).split()
        if y:
            for _ in range(r.randrange(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(mark))
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_are_those_of_dense_cosines(spark, seed, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    monkeypatch.setattr(toxicity, "DENSE", 9)
    r = random.Random(seed)
    rows, labels = labelled(seed, 150)
    rows += [(900, None), (901, ""), (902, "12 34 !"), (903, "unseenword"), (904, "GROBNAK, vilestuff!!"), (905, rows[3][1]), (906, "é " + prose(5, 3000))]
    rows += [(1000 + i, prose(i, r.randrange(1, 9)) + " ça élan" * (i % 3)) for i in range(30)]
    labels += [(i, i % 2) for i in (900, 901, 904, 905, 1000, 1001, 1002, 7777)]
    table, marks = frames(spark, rows, labels)
    got = {x.doc_id: x for x in toxicity.score_toxicity(table, marks, learn=F.col("doc_id") % 3 != 0).collect()}
    want = brute(rows, labels, lambda k: k % 3 != 0)
    assert got.keys() == want.keys()
    for k, (score, cos) in want.items():
        assert got[k].score == pytest.approx(score, abs=1e-6), k
        assert [e.cosine for e in got[k].evidence] == pytest.approx(list(cos), abs=1e-8)


@pytest.mark.parametrize("dense", [0, 6, 100])
def test_blocks_are_pruned_and_nothing_is_lost(monkeypatch, dense):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    monkeypatch.setattr(toxicity, "DENSE", dense)
    rng = np.random.default_rng(8)
    texts = [np.unique(np.concatenate((rng.integers(0, 12, 5), [12 + 8 * (i % 6) + rng.integers(0, 8)]))) for i in range(200)]
    counts = [rng.integers(1, 4, len(p)) for p in texts]
    factor = np.where(np.arange(60) < 12, 0.1, 3.0) * (rng.random(60) + 0.5)
    begin = np.concatenate(([0], np.cumsum([len(p) for p in texts])))
    place, count = np.concatenate(texts), np.concatenate(counts)
    index = toxicity.Index.of(np.arange(60, dtype=np.uint64), factor, np.arange(200), np.zeros(200), 0.5, place, count, begin)
    weight = toxicity.weights(factor, place, count, begin)
    full = np.zeros((200, 60))
    full[np.repeat(np.arange(200), np.diff(begin)), place] = weight
    for leave in (None, np.arange(200)):
        text, example, cos = index.nearest(place, weight, begin, leave)
        every = np.round(full @ full[index.ids].T, 10)
        if leave is not None:
            every[leave[:, None] == index.ids] = 0
        for i in range(200):
            want = np.lexsort((np.arange(200), -every[i]))[: toxicity.K]
            own = text == i
            assert np.allclose(cos[own], every[i][want][every[i][want] > 0], atol=1e-9)
            assert np.allclose(every[i][example[own]], cos[own], atol=1e-9)


def test_labels_ties_repeats_and_empty_tables(spark, docs, no_docs):
    rows, labels = labelled(6, 400)
    table, marks = frames(spark, rows, labels)
    got = {x.doc_id: x for x in toxicity.score_toxicity(table, marks, learn=F.col("doc_id") % 2 == 0).collect()}
    assert all((got[i].score >= 0.5) == y for i, y in labels)
    assert all(e.label == 1 for i, y in labels if y for e in got[i].evidence)
    none = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == docs.count() and {x.score for x in none} == {0.0}
    assert {x.score for x in toxicity.score_toxicity(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")).collect()} == {1.0}
    assert toxicity.score_toxicity(no_docs, marks).count() == 0
    # repeated rows, equal texts under both labels, a null key, null and repeated labels
    odd = spark.createDataFrame([(111, 0), (111, 1), (100, 0), (101, 1), (7, None), (None, 1), (3, 0), (4, 0), (5, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, odd).collect()
    assert len(got) == docs.count() and all(0 <= x.score <= 1 for x in got)
    assert len({x.score for x in got if x.doc_id == 111}) == 1 and sum(x.doc_id == 111 for x in got) == 2
