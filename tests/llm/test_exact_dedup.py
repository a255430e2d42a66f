import hashlib
from collections import defaultdict

import numpy as np
import pytest

from rolegraph.llm import exact_dedup as M


@pytest.mark.parametrize("n,span", [(0, 10), (1, 1), (50, 60), (700, 1 << 30)])
def test_rice_round_trip(n, span):
    values = np.unique(np.random.default_rng(n).integers(0, span, n).astype(np.uint64))
    for k in (0, 3, 11):
        if span < 1 << 20 or k > 8:
            if span > 1 << 20:
                k = 20
            assert (M.rice_decode(M.rice_encode(values, k), len(values), k) == values).all()


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_against_brute_force(docs):
    got = sorted(map(tuple, M.exact_dedup(docs).collect()), key=str)
    assert got == expected(docs.collect())


def test_by_shuffle_too(docs, monkeypatch):
    monkeypatch.setattr(M, "small_enough", lambda *a, **k: False)
    monkeypatch.setattr("rolegraph.llm._spark.small_enough", lambda *a, **k: False)
    assert sorted(map(tuple, M.exact_dedup(docs).collect()), key=str) == expected(docs.collect())


def test_filter_and_empty(docs, no_docs):
    kept = M.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.dropDuplicates(["doc_id"]).collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in docs.collect()})
    assert M.exact_dedup(no_docs).count() == 0
