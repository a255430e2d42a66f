import itertools
import random

import pytest

from rolegraph.functions.fold import name_key
from rolegraph.operators import duplicates as D
from rolegraph.sources.relations import Relations


def graph(spark, names):
    g = Relations(spark)
    for cls, own in names.items():
        g.add_class(cls, spark.createDataFrame([(i, n) for i, n in enumerate(own)], "k long, name string").repartition(3), "k")
    return g


def brute(names, threshold):
    """Near pairs by comparing all keys of a class; equal keys are chained to their first."""
    near, same = set(), set()
    for cls, own in names.items():
        first = {}
        for i, n in enumerate(own):
            k = name_key(n or "")
            if k and k in first:
                same.add((cls, 1.0, f"#{cls[0]}-{first[k]}", f"#{cls[0]}-{i}"))
            elif k:
                first[k] = i
        for (a, i), (b, j) in itertools.combinations(first.items(), 2):
            score = D.similarity(a, b)
            if score >= threshold:
                near.add((cls, round(score, 9), f"#{cls[0]}-{i}", f"#{cls[0]}-{j}"))
    return near | same


def made(seed):
    r = random.Random(seed)
    words = ["cold", "anvil", "bolt", "gear", "old", "iron", "w", "ng", "x"]
    out = []
    for _ in range(90):
        n = list("".join(r.choice(words) for _ in range(r.randrange(1, 5))))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(n))
            n[at : at + r.randrange(2)] = r.choice("abcdé1 ")
        out.append("".join(n))
    return [*out, "coldanvil", "oldanvil", "Cold-Anvil", "ab", "a", "abcdefghijklmnop", "", None, "!!", "日本", "日本語", "Łódź Brass", "Lodz brass", "aaaaaaaaaaaa", "aaaaaaaaaaab"]


@pytest.mark.parametrize("seed, threshold", [(1, 0.85), (2, 0.7), (3, 0.95)])
def test_against_all_pairs(spark, seed, threshold):
    names = {"thing": made(seed), "other": made(seed + 10)[:40]}
    got = D.sweep(graph(spark, names), threshold=threshold).collect()
    assert len(got) == len({(r["class"], r.a, r.b) for r in got})
    assert {(r["class"], round(r.score, 9), r.a, r.b) for r in got} == brute(names, threshold)


def test_a_name_of_a_third_of_the_nodes_is_chained(spark):
    names = {"thing": ["hub"] * 200 + [f"n{i * 7919}x" for i in range(20)]}
    got = [r for r in D.sweep(graph(spark, names)).collect() if r.score == 1.0]
    assert len(got) == 199 and {r.a for r in got} == {"#t-0"}


def test_keys_out_of_range_stay_apart(spark):
    g = Relations(spark)
    keys = [-1, -(1 << 62), 0, 5, (1 << 48) - 1, 1 << 48, (1 << 48) + 5, 2 << 48, (1 << 63) - 1]
    for cls in ("one", "two", "three"):
        g.add_class(cls, spark.createDataFrame([(k,) for k in keys], "k long"), "k", {"k": "k"})
    every = [r.nid for cls in ("one", "two", "three") for r in g.nodes(cls).collect()]
    assert len(set(every)) == len(every) == 3 * len(keys)
    g.add_edge("near", spark.createDataFrame([(k, k) for k in keys], "a long, b long"), {"x": ("one", "a"), "y": ("two", "b")})
    ends = g.edges("near").join(g.nodes("one").withColumnRenamed("nid", "x"), "x").join(g.nodes("two").select("nid").withColumnRenamed("nid", "y"), "y")
    assert ends.count() == len(keys)
