"""Nodes reached over one edge type in up to N steps, or any number: a set of nodes, not of paths.

Where no node has more than one step ahead, or none more than one behind (trees, chains, rings), walks
of any length double each round, and how many nodes each reaches, or whether it reaches itself, is
found without listing pairs.  Other graphs are walked hop by hop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.operators.scratch import stored

#: Up to this many steps the walk is one lazy plan, without a job of its own.
UNROLL = 4
#: Tables of reached pairs that the next round's anti-joins read at most.
MERGE = 12


def reach(sources: DataFrame, edges: DataFrame, depart: str, arrive: str, steps: int | None) -> DataFrame:
    """(src, node): for each distinct source in the one column of `sources`, every node it reaches.

    A start is reached only through a cycle.  Each round is one hop (or twice as far as before, see
    `single`) from what the last one found new, written as a table, so a cycle ends, no hop is computed
    twice and plans stay short.  Edges are never made distinct: pairs are, once a hop.
    """
    hops, start = _ends(edges, depart, arrive), _starts(sources)
    if steps is not None and steps <= UNROLL:
        levels = [_hop(start.withColumn("node", F.col("src")), hops)]
        for _ in range(steps - 1):
            levels.append(_hop(levels[-1].distinct(), hops))
        return reduce(DataFrame.union, levels).distinct()
    hops = stored(hops, "hops")
    if steps is None and (one := single(hops)):
        return _far(start, *one)
    return _wide(start, hops, steps)


def reach_counts(sources: DataFrame, edges: DataFrame, depart: str, arrive: str, wanted: DataFrame) -> DataFrame:
    """(src, n): how many of the distinct nodes in the one column of `wanted` each source reaches in any number of steps; none with 0."""
    hops, start = stored(_ends(edges, depart, arrive), "hops"), _starts(sources)
    wanted = wanted.select(F.col(wanted.columns[0]).alias("node")).where("node is not null").distinct()
    one = single(hops)
    if one is None:
        return _wide(start, hops, None).join(wanted, "node").groupBy("src").agg(F.count("*").alias("n"))
    step, along = one
    every = step.select("at").union(step.select("to")).distinct()
    weight = stored(every.join(wanted.select(F.col("node").alias("at"), F.lit(1).cast("long").alias("w")), "at", "left").select("at", F.coalesce("w", F.lit(0)).alias("w")), "weights")
    ring = cycles(step)
    found = (_ahead if along else _behind)(step, weight, ring)
    return start.join(found.select(F.col("at").alias("src"), "n").where("n > 0"), "src")


def reach_self(sources: DataFrame, edges: DataFrame, depart: str, arrive: str) -> DataFrame:
    """(src, node): the distinct sources that reach themselves in any number of steps, twice."""
    hops, start = stored(_ends(edges, depart, arrive), "hops"), _starts(sources)
    one = single(hops)
    if one is None:
        return _wide(start, hops, None).where("src = node")
    return start.join(cycles(one[0]).select(F.col("at").alias("src")), "src").select("src", F.col("src").alias("node"))


def single(hops: DataFrame) -> tuple[DataFrame, bool] | None:
    """(at, to): the one step from each node that has any, along the edges (True) or against them (False); None where some nodes have several both ways."""
    for at, to, along in (("__d", "node", True), ("node", "__d", False)):
        step = stored(hops.groupBy(F.col(at).alias("at")).agg(F.min(to).alias("to"), F.max(to).alias("other")), "single")
        if step.where("to <> other").isEmpty():
            return step.select("at", "to"), along
    return None


def cycles(step: DataFrame) -> DataFrame:
    """(at): the nodes on cycles of single steps.

    What walks of 2^i steps end at only shrinks with i, and holds the cycles' nodes; once it doesn't
    shrink from one i to the next, every node in it is a step's end from within, so it holds no others.
    """
    jump, before = step, -1
    while True:
        ends = stored(jump.select(F.col("to").alias("at")).distinct(), "ends")
        n = ends.count()
        if n in (0, before):
            return ends
        jump, before = stored(_twice(jump), "jump"), n


def _ends(edges: DataFrame, depart: str, arrive: str) -> DataFrame:
    return edges.select(F.col(depart).alias("__d"), F.col(arrive).alias("node")).where("__d is not null and node is not null")


def _starts(sources: DataFrame) -> DataFrame:
    return sources.select(F.col(sources.columns[0]).alias("src")).where("src is not null").distinct()


def _hop(front: DataFrame, hops: DataFrame) -> DataFrame:
    return front.select("src", F.col("node").alias("__at")).join(hops, F.col("__at") == F.col("__d")).select("src", "node")


def _twice(jump: DataFrame) -> DataFrame:
    """(at, to) of walks twice as long."""
    return jump.select("at", F.col("to").alias("mid")).join(jump.select(F.col("at").alias("mid"), "to"), "mid").select("at", "to")


def _wide(start: DataFrame, hops: DataFrame, steps: int | None) -> DataFrame:
    """Pairs of a graph with any edges, a round for each hop."""
    front = start.withColumn("node", F.col("src"))
    seen: list[DataFrame] = []
    left = steps
    while left is None or left > 0:
        found = _hop(front, hops).distinct()
        if seen:
            found = found.join(reduce(DataFrame.union, seen), ["src", "node"], "left_anti")
        front = stored(found, "reach")
        if front.isEmpty():
            break
        seen.append(front)
        left = None if left is None else left - 1
        if len(seen) > MERGE:  # the anti-joins read few tables
            seen = [stored(reduce(DataFrame.union, seen), "reach")]
    return reduce(DataFrame.union, seen) if seen else front


def _far(start: DataFrame, step: DataFrame, along: bool) -> DataFrame:
    """Pairs of a graph with single steps: each round adds what is 2^i steps from the pairs of up to 2^i steps."""
    jump = step
    hops = lambda: jump.select(F.col("at" if along else "to").alias("__d"), F.col("to" if along else "at").alias("node"))
    seen = [stored(_hop(start.withColumn("node", F.col("src")), hops()).distinct(), "reach")]
    while True:
        pairs = reduce(DataFrame.union, seen)
        found = stored(_hop(pairs, hops()).distinct().join(pairs, ["src", "node"], "left_anti"), "reach")
        if found.isEmpty():
            return pairs
        seen.append(found)
        jump = stored(_twice(jump), "jump")


def _rings(step: DataFrame, weight: DataFrame, ring: DataFrame) -> DataFrame:
    """(at, total): for each node on a cycle the weight of its whole cycle."""
    part = step.join(ring, "at").select("at", "to", F.col("at").alias("least"), F.lit(True).alias("moved"))
    while True:  # the least node among the next 2^i; where none changes, those windows have gone around
        ahead = part.select(F.col("at").alias("mid"), F.col("to").alias("next"), F.col("least").alias("other"))
        part = stored(part.join(ahead, F.col("to") == F.col("mid")).select("at", F.col("next").alias("to"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved")), "rings")
        if part.where("moved").isEmpty():
            break
    total = part.join(weight, "at").groupBy("least").agg(F.sum("w").alias("total"))
    return part.join(total, "least").select("at", "total")


def _ahead(step: DataFrame, weight: DataFrame, ring: DataFrame) -> DataFrame:
    """(at, n): the weight of the nodes ahead of each; a walk into a cycle meets all of it."""
    around = _rings(step, weight, ring)
    off = step.join(ring, "at", "left_anti")
    gain = weight.join(ring, "at", "left_anti").select(F.col("at").alias("to"), "w")  # a cycle is added at the end
    walk = stored(off.join(gain, "to", "left").select("at", "to", F.coalesce("w", F.lit(0)).alias("n"), F.lit(True).alias("moved")), "walk")
    while not walk.where("moved").isEmpty():  # n is the weight from behind `at` up to `to`
        ahead = walk.select(F.col("at").alias("mid"), F.col("to").alias("next"), F.col("n").alias("more"))
        met = F.col("mid").isNotNull()
        walk = stored(walk.join(ahead, F.col("to") == F.col("mid"), "left").select("at", F.coalesce("next", "to").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), met.alias("moved")), "walk")
    ended = walk.join(around.select(F.col("at").alias("to"), "total"), "to", "left").select("at", (F.col("n") + F.coalesce("total", F.lit(0))).alias("n"))
    return ended.union(around.select("at", F.col("total").alias("n")))


def _behind(step: DataFrame, weight: DataFrame, ring: DataFrame) -> DataFrame:
    """(at, n): the weight of the nodes whose steps lead to each; all on a cycle have the same."""
    off = step.join(ring, "at", "left_anti")
    tree = weight.join(ring, "at", "left_anti").select("at", "w", F.col("w").alias("s"))
    jump = off.join(ring.select(F.col("at").alias("to")), "to", "left_anti").select("at", "to")
    while True:  # s is the weight of the nodes up to 2^i steps behind, without the farthest
        jump = stored(jump, "jump")
        if jump.isEmpty():
            break
        more = jump.join(tree, "at").groupBy("to").agg(F.sum("s").alias("more")).select(F.col("to").alias("at"), "more")
        tree = stored(tree.join(more, "at", "left").select("at", "w", (F.col("s") + F.coalesce("more", F.lit(0))).alias("s")), "tree")
        jump = _twice(jump)
    hung = off.join(tree, "at").select(F.col("to").alias("at"), F.col("s").alias("w"))
    around = _rings(step, weight.union(hung), ring)  # a cycle leads to the trees that hang on it
    return tree.select("at", (F.col("s") - F.col("w")).alias("n")).union(around.select("at", F.col("total").alias("n")))
