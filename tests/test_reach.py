import random

import pytest

from rolegraph.operators import reach as operator
from rolegraph.operators.reach import reach, reach_counts, reach_self
from rolegraph.plans import compiler
from rolegraph.session import Session
from rolegraph.sources.relations import Relations


def brute(edges, start):
    out = set()
    for s in start:
        front, found = {s}, set()
        while front:
            front = {b for a, b in edges if a in front} - found
            found |= front
        out |= {(s, x) for x in found}
    return out


def graphs():
    r = random.Random(5)
    mixed = [(i, r.randrange(40)) for i in range(40) if r.random() < 0.9]  # cycles, tails and ends
    chain = [(i, i + 1) for i in range(33)]
    yield "single", mixed
    yield "single back", [(b, a) for a, b in mixed]
    yield "rings", [(i, i // 10 * 10 + (i + 3) % 10) for i in range(30)] + [(50, 50), (51, 50), (52, 51), (53, 50), (60, 61), (61, 60)]
    yield "chain", chain + chain[:5]  # an edge may come twice
    yield "tree", [(i, c) for i in range(31) for c in (2 * i + 1, 2 * i + 2)]
    yield "tree back", [(c, i) for i in range(31) for c in (2 * i + 1, 2 * i + 2)]
    yield "any", [(r.randrange(25), r.randrange(25)) for _ in range(40)]
    yield "none", []


@pytest.mark.parametrize("name,edges", list(graphs()), ids=lambda x: x if isinstance(x, str) else "")
def test_reach_counts_and_returns(spark, name, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    for start in (range(0, 70), [3, 50]):
        sources = spark.createDataFrame([(i,) for i in [*start, start[0]]], "s long")
        pairs = brute(edges, start)
        assert sorted(map(tuple, reach(sources, df, "a", "b", None).collect())) == sorted(pairs)
        assert sorted(map(tuple, reach_self(sources, df, "a", "b").collect())) == sorted(p for p in pairs if p[0] == p[1])
        wanted = spark.createDataFrame([(i,) for i in range(0, 70, 2)] * 2, "w long")
        counts = {s: n for s in start if (n := sum(a == s and b % 2 == 0 for a, b in pairs))}
        assert {r.src: r.n for r in reach_counts(sources, df, "a", "b", wanted).collect()} == counts


def ring(spark, n):
    g = Relations(spark)
    g.add_class("item", spark.range(n).selectExpr("id as k", "concat('i', id) as name", "id % 3 as tint"), "k")
    g.add_edge("next", spark.range(n).selectExpr("id as a", f"(id + 1) % {n} as b"), {"from_": ("item", "a"), "to": ("item", "b")}, unique=True)
    return Session(g)


@pytest.mark.parametrize("program,rows", [("find item as a\nfollow a next to upto any as b\ngroup by a as g\ncount distinct g.b as n\nreturn a.name, n", 200), ("find item as a\nfollow a next to upto any as a\nreturn a.name", 200), ("find item as a\nfollow a next to upto any as b\nreturn a.name, b.name", 40000)])
def test_a_long_ring_takes_few_rounds(spark, monkeypatch, program, rows):
    written, stored = [], operator.stored
    monkeypatch.setattr(operator, "stored", lambda df, name: written.append(name) or stored(df, name))
    assert Session.df(ring(spark, 200), program).count() == rows
    assert len(written) < 40  # one a hop would be 200


COUNTED = [
    "find item as a\nfollow a next to upto any as b\ngroup by a as g\ncount distinct g.b as n\nreturn a.name, n order by a.name desc limit 4",
    "find item where tint = 1 as a\nfollow a next to where tint = 2 upto any as b\ngroup by a as g\ncount distinct g.b as n\nmax g.a.tint as m\nkeep g where n > 2\nreturn a.name, n, m",
    "find item as a\nfollow a next to as c\nfollow a next from_ upto any as b\ngroup by a as g\ncount distinct g.b as n\nreturn a.name, c.name, n",
    "find item as a\nfollow a next to upto any as b\ngroup by a as g\ncount distinct g.b as n\ncount g.b as m\nreturn a.name, n, m",
    "find item as a\nfollow a next to upto any as b\ngroup by a as g\ncount distinct g.b as n\nmax g.b.tint as m\nreturn a.name, n, m",
    "find item as a\nfollow a next to upto any as b\ngroup by b as g\ncount distinct g.a as n\nreturn b.name, n",
    "find item as a\nfollow a next to upto any as b or none\ngroup by a as g\ncount distinct g.b as n\nreturn a.name, n",
    "find item as a\nfollow a next to upto any as b\ngroup by a as g\ncount distinct g.b as n\nreturn a.name, b.name, n",
    "find item where tint = 0 as a\nor\nfind item as a\nfollow a next to upto any as b\ngroup by a as g\ncount distinct g.a as n\nreturn a.name, n",
]


@pytest.mark.parametrize("program", COUNTED)
def test_counting_without_pairs_changes_no_result(spark, monkeypatch, program):
    s = ring(spark, 9)
    fast = s.rows(program)
    monkeypatch.setattr(compiler, "REWRITES", {**compiler.REWRITES, "counted": False})
    slow = s.rows(program)
    assert fast == slow if "order by" in program else sorted(map(tuple, fast)) == sorted(map(tuple, slow))


def comb(spark, n):
    """A tree of n levels: 2k holds 2k + 1 and 2k + 2."""
    g = Relations(spark)
    g.add_class("item", spark.range(2 * n).selectExpr("id as k", "id as number"), "k")
    g.add_edge("holds", spark.range(1, 2 * n).selectExpr("id - 2 + id % 2 as a", "id as b"), {"whole": ("item", "a"), "piece": ("item", "b")}, unique=True)
    return Session(g)


def test_wholes_of_a_deep_tree_take_few_rounds(spark, monkeypatch):
    written, stored = [], operator.stored
    monkeypatch.setattr(operator, "stored", lambda df, name: written.append(name) or stored(df, name))
    got = comb(spark, 60).rows("find item as q\nfollow q holds whole upto any as p\ngroup by q as g\ncount distinct g.p as n\nreturn q.number, n")
    assert sorted(got) == [[k, k // 2 + k % 2] for k in range(1, 120)]
    assert len(written) < 30  # one a level would be 60


def test_pieces_of_a_deep_tree_take_few_rounds(spark, monkeypatch):
    written, stored = [], operator.stored
    monkeypatch.setattr(operator, "stored", lambda df, name: written.append(name) or stored(df, name))
    got = comb(spark, 60).rows("find item as p\nfollow p holds piece upto any as q\ngroup by p as g\ncount distinct g.q as n\nreturn p.number, n")
    assert sorted(got) == [[k, 119 - k] for k in range(0, 119, 2)]
    assert len(written) < 35  # one a level would be 60
