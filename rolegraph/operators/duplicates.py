"""Candidates for duplicate nodes: similar names within a class."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolegraph.functions.fold import name_keyed

THRESHOLD = 0.85
SCHEMA = "class string, score double, a string, b string, evidence string"


def similarity(a: str, b: str) -> float:
    """Ratio of matching blocks of two name keys; a name that begins with the other scores 0.9 at least."""
    if not a or not b:
        return 0.0
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    if a != b and (a.startswith(b) or b.startswith(a)):
        ratio = max(ratio, 0.9)
    return ratio


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        part["score"] = [similarity(a, b) for a, b in zip(part["ka"], part["kb"])]
        yield part[["class", "score", "a", "b", "ka", "kb"]]


def named(graph, cls: str) -> DataFrame | None:
    """(class, id, nid, key) of a class's nodes with a name."""
    df = graph.nodes(cls)
    if df is None or "name" not in df.columns:
        return None
    return df.where("name is not null").select("class", "id", "nid", name_keyed(F.col("name")).alias("key")).where("key <> ''")


def prefixes(names: DataFrame, threshold: float) -> DataFrame:
    """(class, key, n, token, place): the rarest signs of each key, so many that keys of the ratio share one.

    A key's tokens are its signs, each with how often it came before ("a0", "a1"), so the tokens that
    two keys share are at least the signs that matching blocks hold.  A ratio of t needs
    t / 2 * (n + m) of them, and t / (2 - t) * n for any m; so in an order that all keys share, both
    have one of those among their first n - that + 1.
    """
    signs = F.split(F.col("key"), "")
    token = F.transform(signs, lambda c, i: F.concat(c, (F.size(F.filter(F.slice(signs, F.lit(1), i), lambda d: d == c))).cast("string")))
    each = names.select("class", "key", F.length("key").alias("n"), F.explode(token).alias("token"))
    held = each.groupBy("class", "token").agg(F.count("*").alias("held"))
    order = Window.partitionBy("class", "key").orderBy("held", "token")  # a name's own signs
    placed = each.join(held, ["class", "token"]).withColumn("place", F.row_number().over(order) - 1)
    return placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (threshold / (2 - threshold)) - 1e-9)).drop("held")


def near_names(names: DataFrame, threshold: float) -> DataFrame:
    """(class, ka, kb): pairs of keys of a class, each once, that may reach the threshold; none that does is left out."""
    short = prefixes(names, threshold)
    a, b = (short.select("class", "token", F.col("key").alias(f"k{s}"), F.col("n").alias(f"n{s}"), F.col("place").alias(f"p{s}")) for s in "ab")
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= (F.col("na") + F.col("nb")) * (threshold / 2) - 1e-9
    alike = a.join(b, ["class", "token"]).where((F.col("ka") < F.col("kb")) & room).select("class", "ka", "kb")
    # a name that another begins with, whatever its length
    begins = names.select("class", F.col("key").alias("kb"), F.explode(F.sequence(F.lit(1), F.length("key") - 1)).alias("n")).where("n > 0 and n < length(kb)")
    begins = begins.select("class", F.expr("left(kb, n)").alias("ka"), "kb").join(names.select("class", F.col("key").alias("ka")), ["class", "ka"])
    return alike.union(begins.select("class", "ka", "kb")).distinct()


def sweep(graph, classes: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(class, score, a, b, evidence): pairs of a class whose similarity reaches the threshold, across all blocks.

    Equal names are one row on each side, so a name that a third of the nodes carry is compared once
    and its nodes are chained to the first of them, not paired with each other.
    """
    parts = [p for c in (classes or list(graph.catalog.classes)) if (p := named(graph, c)) is not None]
    if not parts:
        return graph.spark.createDataFrame([], SCHEMA)
    rows = reduce(DataFrame.union, parts)
    first = rows.groupBy("class", "key").agg(F.min(F.struct("nid", "id")).alias("f"), F.count("*").alias("n")).select("class", "key", F.col("f.nid").alias("nid"), F.col("f.id").alias("id"), "n")
    again = rows.join(first.where("n > 1").select("class", "key", F.col("nid").alias("fn"), F.col("id").alias("a")), ["class", "key"]).where("nid <> fn")
    same = again.select("class", F.lit(1.0).alias("score"), "a", F.col("id").alias("b"), F.concat(F.lit("same name "), F.col("key")).alias("evidence"))
    side = lambda s: first.select("class", F.col("key").alias(f"k{s}"), F.col("nid").alias(f"nid{s}"), F.col("id").alias(f"id{s}"))
    met = near_names(first.select("class", "key"), threshold).join(side("a"), ["class", "ka"]).join(side("b"), ["class", "kb"])
    before = F.col("nida") < F.col("nidb")
    pairs = met.select("class", F.when(before, F.col("ida")).otherwise(F.col("idb")).alias("a"), F.when(before, F.col("idb")).otherwise(F.col("ida")).alias("b"), F.when(before, F.col("ka")).otherwise(F.col("kb")).alias("ka"), F.when(before, F.col("kb")).otherwise(F.col("ka")).alias("kb"))
    scored = pairs.mapInPandas(_scored, "class string, score double, a string, b string, ka string, kb string").where(F.col("score") >= threshold)
    near = scored.select("class", "score", "a", "b", F.concat(F.lit("names "), "ka", F.lit(" and "), "kb").alias("evidence"))
    return same.union(near)
