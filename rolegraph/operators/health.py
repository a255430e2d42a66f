"""Health of nodes: four numbers from 0 (sound) to 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(graph) -> DataFrame:
    """(nid, degree): live edges at each node that has any; an edge from a node to itself counts once."""
    ends = []
    for e in graph.catalog.edges.values():
        a, b = e.roles
        df = graph.edges(e.name)
        ends += [df.select(F.col(a).alias("nid")), df.where(F.col(a) != F.col(b)).select(F.col(b).alias("nid"))]
    if not ends:
        return graph.spark.createDataFrame([], "nid long, degree long")
    return reduce(DataFrame.union, ends).groupBy("nid").agg(F.count("*").alias("degree"))


def health(graph) -> DataFrame:
    """(nid, loss, query, structure, staleness) of nodes that have an edge or a signal; others: see `absent`."""
    known = degrees(graph).join(graph.signals(), "nid", "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    one = lambda x: F.least(F.lit(1.0), x)
    structure = F.greatest(one(n("degree") / 100), one(n("traversals") / 50), F.when(n("degree") == 0, 0.3).otherwise(0.0))
    stale = F.when(F.col("last_confirmed").isNull(), 0.0).otherwise(one((F.lit(graph.position()) - F.col("last_confirmed")) / 1000))
    return known.select("nid", one(n("conflicts") / 5).alias("loss"), one(n("flags") / 3).alias("query"), structure.alias("structure"), stale.alias("staleness"))


#: What a node without edges and signals scores.
ABSENT = {"loss": 0.0, "query": 0.0, "structure": 0.3, "staleness": 0.0}
