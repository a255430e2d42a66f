"""Results as text within a budget of tokens."""

from __future__ import annotations

import bisect
import functools
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.lang import tree as T
from rolegraph.limits import current, guarded, too_many

#: Characters that count as a token, and those kept back for the header.
TOKEN, HEADER = 4, 60


_WORDS = {True: "true", False: "false"}
#: Columns that a node's block doesn't list as properties.
_ASIDE = frozenset(("nid", "id", "class", "state", "query_traffic", "lineage", "name"))


def value(v: object) -> str:
    match v:
        case bool():
            return _WORDS[v]
        case float():
            return format(v, "g")
        case list():
            return f"[{', '.join(value(x) for x in v)}]"
    return str(v)


def emit(blocks: list[str], header: str | None, total: int, before: int, budget: int) -> tuple[str, list[str]]:
    """The text of as many blocks as the budget holds (one at least), and the blocks left over."""
    head = [] if header is None else [header]
    ends = list(itertools.accumulate(len(b) + 1 for b in blocks))  # room that the first blocks take together
    fit = bisect.bisect_right(ends, budget * TOKEN - HEADER - sum(map(len, head)))
    fit = min(len(blocks), max(fit, 1))
    state = "complete" if fit == len(blocks) else "budget hit"
    return "\n".join([f"results: {before + fit} of {total}, {state}", *head, *blocks[:fit]]), blocks[fit:]


def node_blocks(graph, compiler, ids: list[int]) -> dict[int, str]:
    """For each node: class, name and properties, and under it its edges; two jobs, whatever the number of edge types."""
    spark = graph.spark
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "nid long"))  # the page's nodes
    every = compiler.frame("nodes")
    title = F.coalesce(*(F.col(c).cast("string") for c in ("name", "title", "id") if c in every.columns))
    page = every.join(wanted, "nid").withColumn("__title", title).collect()
    ways = []
    for place, e in enumerate(compiler.catalog.edges.values()):
        edges, (a, b) = graph.edges(e.name), e.roles
        for near, far, sign in ((a, b, "->"), (b, a, "<-")):
            one = edges if sign == "->" else edges.where(F.col(a) != F.col(b))
            ways.append(one.join(wanted, F.col(near) == F.col("nid")).select("nid", F.lit(place).alias("place"), "eid", F.lit(f"  {e.name} {sign} ").alias("lead"), F.col(far).alias("far")))
    under: dict[int, list[str]] = {}
    if ways:
        ends = every.select(F.col("nid").alias("far"), F.concat("class", F.lit(' "'), title, F.lit('"')).alias("end"))
        lines = functools.reduce(DataFrame.union, ways).join(ends, "far").orderBy("nid", "place", "eid")
        for r in lines.select("nid", F.concat("lead", "end").alias("line")).collect():
            under.setdefault(r.nid, []).append(r.line)
    out = {}
    for r in page:
        said = ", ".join(f"{k}: {value(v)}" for k, v in r.asDict().items() if v is not None and k not in _ASIDE and not k.startswith("_"))
        out[r["nid"]] = "\n".join([f'{r["class"]} "{r["__title"]}"' + (said and f" {{{said}}}"), *under.get(r["nid"], ())])
    return out


def blocks(graph, compiler, state, s: T.Return) -> tuple[list[str], str | None, int]:
    """The result's rows as text blocks, the header naming the columns (none for node blocks), and the number of rows before the limit."""
    df: DataFrame = compiler.returned(state, s, with_ids=True)
    if s.limit is None:
        rows = guarded(graph.spark, df, lambda d: d.collect())
        total = len(rows)
    else:  # only the page comes to the driver
        total = guarded(graph.spark, df, lambda d: [d.count()])[0]
        most = current()[0]
        if most is not None and total > most:
            raise too_many(most)
        rows = guarded(graph.spark, df.limit(s.limit), lambda d: d.collect())
    bare = [len(p) == 1 and p[0] in state.bound and state.bound[p[0]].kind == "node" for p in s.cols]
    n = len(s.cols)
    if any(b and rows and rows[0][n + i] is not None for i, b in enumerate(bare)):
        ids = [r[n + i] for r in rows for i, b in enumerate(bare) if b and r[n + i] is not None]
        text = node_blocks(graph, compiler, ids)
        return ["\n".join(text[r[n + i]] if b and r[n + i] is not None else value(r[i]) for i, b in enumerate(bare)) for r in rows], None, total
    return [", ".join(value(r[i]) for i in range(n)) for r in rows], "columns: " + ", ".join(".".join(p) for p in s.cols), total
