"""Loading tables of nodes and edges: CSV or JSON lines, checked as a whole before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.functions.fold import folded
from rolegraph.lang.tree import ProgramError
from rolegraph.operators.scratch import stored
from rolegraph.sources.relations import SPARK_TYPES
from rolegraph.store.store import RECORD, Store

# fixed values: words that stand for true and false
TRUE, FALSE = ("true", "1", "yes", "t"), ("false", "0", "no", "f")


class LoadProblem(ProgramError):
    pass


def coerce(text: str | None, kind: str):
    """A cell as a value of a type; an empty cell is absent, a bad one a ValueError."""
    if text is None or text == "":
        return None
    if kind == "bool":
        low = text.strip().lower()
        if low in TRUE or low in FALSE:
            return low in TRUE
        raise ValueError(f"{text!r} is no bool")
    try:
        return {"int": int, "float": float, "str": str}[kind](text)
    except ValueError:
        raise ValueError(f"{text!r} is no {kind}") from None


def coerced(col: Column, kind: str) -> Column:
    """The same for a column of text; a bad cell is null."""
    text = F.when(F.trim(col) != "", F.trim(col))
    if kind == "str":
        return F.when(col != "", col)
    if kind == "bool":
        return F.when(F.lower(text).isin(*TRUE), True).when(F.lower(text).isin(*FALSE), False)
    if kind == "int":
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    return text.try_cast("double")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: JSON lines by the file's name or first sign, else CSV with a header."""
    first = spark.read.text(path).limit(1).collect()
    if path.endswith((".jsonl", ".ndjson")) or (first and first[0].value.lstrip("﻿").startswith("{")):
        df = spark.read.option("primitivesAsString", "true").option("mode", "FAILFAST").json(path)
        return df.select(*(F.col(c) if t == "string" else F.to_json(c).alias(c) for c, t in df.dtypes))
    return spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").option("mode", "FAILFAST").csv(path)


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """df with row numbers from 0 in `__i`, counted by partition, and how many."""
    low = (1 << 33) - 1
    df = stored(df.withColumn("__m", F.monotonically_increasing_id()), "load")
    part = F.shiftright("__m", 33)
    sizes = df.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row per partition
    offsets, total = {}, 0
    for r in sizes:
        offsets[r.p] = total
        total += r.n
    if not sizes:
        return df.withColumn("__i", F.lit(0).cast("long")).drop("__m"), 0
    base = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[part]
    return df.withColumn("__i", base + F.col("__m").bitwiseAND(low)).drop("__m"), total


def records(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    kinds = [c.strip().split(" ") for c in RECORD.split(", ")]
    return df.select(*[(columns[c] if c in columns else F.lit(None)).cast(t).alias(c) for c, t in kinds])


def _bad_cells(df: DataFrame, kinds: dict[str, str]) -> None:
    for c, kind in kinds.items():
        bad = df.where((F.trim(F.col(c)) != "") & coerced(F.col(c), kind).isNull()).select(c).limit(1).collect()
        if bad:
            raise LoadProblem(f"{bad[0][0]!r} in column {c} is no {kind}; nothing was written")


def _map(kinds: dict[str, str]) -> Column:
    pairs = [F.struct(F.lit(c).alias("key"), coerced(F.col(c), k).cast("string").alias("value")) for c, k in kinds.items()]
    if not pairs:
        return F.lit(None)
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def load_nodes(store: Store, path: str, cls: str) -> int:
    """Add a node of the class for every row; returns how many."""
    props = store.catalog.props(cls) if cls in store.catalog.classes else None
    if props is None:
        raise LoadProblem(f"there is no class {cls}; nothing was written")
    df = read_table(store.spark, path)
    if unknown := [c for c in df.columns if c not in props]:
        raise LoadProblem(f"{cls} has no property {', '.join(unknown)}; nothing was written")
    kinds = {c: props[c] for c in df.columns}
    rows, n = numbered(df)
    if not n:
        return 0
    _bad_cells(rows, kinds)
    nid, number = store.reserve(cls, n)
    added = records(rows, {"pos": F.lit(store.position() + 1) + F.col("__i"), "op": F.lit("node"), "nid": F.lit(nid) + F.col("__i"), "id": F.concat(F.lit(f"#{cls[0]}-"), (F.lit(number) + F.col("__i")).cast("string")), "cls": F.lit(cls), "props": _map(kinds), "state": F.lit("atom")})
    store.append(added, {"node": n}, {cls: n}, n)
    return n


def load_edges(store: Store, path: str, edge: str, roles: dict[str, str]) -> tuple[int, list[str]]:
    """Add an edge for every row whose two endpoints are one node each; returns how many, and notes on the others.

    A cell names an endpoint by node id or by its folded name within the role's class.
    """
    e = store.catalog.edges.get(edge)
    if e is None or set(roles) != set(e.roles):
        raise LoadProblem(f"name a column for each role of {edge}; nothing was written")
    df = read_table(store.spark, path)
    if unknown := [c for c in df.columns if c not in e.props and c not in roles.values()]:
        raise LoadProblem(f"{edge} has no property {', '.join(unknown)}; nothing was written")
    kinds = {c: e.props[c] for c in df.columns if c in e.props}
    rows, n = numbered(df)
    if not n:
        return 0, []
    _bad_cells(rows, kinds)
    for role, column in roles.items():
        nodes = store.nodes(e.roles[role])
        ids = store.spark.createDataFrame([], "k string, m long, nid long") if nodes is None else None
        if nodes is not None:
            by_id = nodes.select(F.col("id").alias("k"), "nid")
            by_name = nodes.where("name is not null").select(folded(F.col("name")).alias("k"), "nid") if "name" in nodes.columns else by_id.limit(0)
            ids = by_id.union(by_name).groupBy("k").agg(F.count("*").alias("m"), F.first("nid").alias("nid"))
        key = F.when(F.startswith(F.col(column), F.lit("#")), F.col(column)).otherwise(folded(F.col(column)))
        ids = ids.select(F.col("k").alias(f"__k_{role}"), F.col("m").alias(f"__m_{role}"), F.col("nid").alias(f"__n_{role}"))
        rows = rows.join(ids, key == F.col(f"__k_{role}"), "left")
    rows = stored(rows, "load-edges")
    good = " and ".join(f"__m_{r} = 1" for r in roles)
    notes = []
    for role, column in roles.items():
        for r in rows.where(f"__m_{role} is null or __m_{role} > 1").groupBy(column, f"__m_{role}").count().limit(20).collect():
            notes.append(f"{role} {r[0]!r}: {'no such node' if r[1] is None else f'{r[1]} nodes'}; {r[2]} rows left out")
    n = rows.where(good).count()
    if n:
        a, b = e.roles
        written, _ = numbered(rows.where(good))
        added = records(written, {"pos": F.lit(store.position() + 1) + F.col("__i"), "op": F.lit("edge"), "eid": F.lit(store.position() + 1) + F.col("__i"), "type": F.lit(edge), "a": F.col(f"__n_{a}"), "b": F.col(f"__n_{b}"), "props": _map(kinds)})
        store.append(added, {"edge": n}, {}, n)
    return n, notes


def load_graph_json(spark: SparkSession, path: str):
    """A property graph as JSON (entities and relations) as registered relations.

    A relation label that joins several pairs of classes becomes one edge type per pair; its roles
    are the classes' names, or subj and obj where they are the same.
    """
    from rolegraph.sources.relations import Relations

    raw = spark.read.option("multiLine", "true").json(path)
    entity = raw.select(F.explode("entities").alias("e")).select("e.*")
    relation = raw.select(F.explode("relations").alias("r")).select("r.*")
    g = Relations(spark)
    props = {f.name for f in entity.schema["properties"].dataType.fields} if "properties" in entity.columns else set()
    for r in entity.select("label").distinct().orderBy("label").collect():
        own = entity.where(F.col("label") == r.label)
        used = [p for p in sorted(props) if not own.where(F.col("properties")[p].isNotNull()).isEmpty()]
        g.add_class(r.label.lower(), own, "eid", {"name": "name", **{p: F.col("properties")[p] for p in used}})
    kinds = entity.select(F.col("eid").alias("i"), "label")
    typed = relation.join(kinds.select(F.col("i").alias("subj_id"), F.col("label").alias("sl")), "subj_id").join(kinds.select(F.col("i").alias("obj_id"), F.col("label").alias("ol")), "obj_id")
    pairs = typed.select("label", "sl", "ol").distinct().orderBy("label", "sl", "ol").collect()
    several = {p.label for p in pairs if sum(q.label == p.label for q in pairs) > 1}
    fields = [f.name for f in relation.schema["properties"].dataType.fields] if "properties" in relation.columns else []
    for p in pairs:
        name = f"{p.label}_{p.sl.lower()}_{p.ol.lower()}" if p.label in several else p.label
        s, o = (p.sl.lower(), p.ol.lower()) if p.sl != p.ol else ("subj", "obj")
        own = typed.where((F.col("label") == p.label) & (F.col("sl") == p.sl) & (F.col("ol") == p.ol))
        g.add_edge(name, own, {s: (p.sl.lower(), "subj_id"), o: (p.ol.lower(), "obj_id")}, {f: F.col("properties")[f] for f in fields}, unique=True)
    return g


__all__ = ["SPARK_TYPES", "LoadProblem", "coerce", "load_edges", "load_graph_json", "load_nodes", "read_table"]
