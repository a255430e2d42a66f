"""Registered queries over stores: each builds a store from tables in the shared folder, writes to it, and reads it back."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.catalog import Catalog
from rolegraph.ingest.stage import stage_files
from rolegraph.operators.scratch import shared_dir
from rolegraph.session import Session
from rolegraph.sources.bulk import load_edges, load_nodes
from rolegraph.store.store import Store
from rolegraph.streaming.feed import follow_changes, upsert_latest


def _catalog() -> Catalog:
    c = Catalog.standard()
    c.add_class("region", {"name": "str"})
    c.add_class("nation", {"name": "str", "code": "int"})
    c.add_class("supplier", {"name": "str", "acctbal": "float", "rich": "bool"})
    c.add_edge("inside", {"member": "nation", "area": "region"})
    c.add_edge("based_in", {"firm": "supplier", "home": "nation"}, {"code": "int"})
    return c


class _Build:
    """A new store, and files of table rows to load into it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.top = f"{shared_dir(spark)}/rolegraph/stores/{uuid.uuid4().hex}"
        self.store = Store(spark, f"{self.top}/db", _catalog())

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def file(self, df: DataFrame, order: str, kind: str = "csv", **columns: Column | str) -> str:
        """A file of the columns in the rows' order."""
        uri = f"{self.top}/{uuid.uuid4().hex}{'.jsonl' if kind == 'json' else ''}"
        out = df.orderBy(order).coalesce(1).select(*(F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items())).write
        (out.option("header", "true") if kind == "csv" else out).format(kind).save(uri)
        return uri

    def regions(self) -> None:
        load_nodes(self.store, self.file(self.table("region"), "r_regionkey", name="r_name"), "region")

    def nations(self) -> None:
        load_nodes(self.store, self.file(self.table("nation"), "n_nationkey", "json", name="n_name", code=F.col("n_nationkey").cast("string")), "nation")

    def suppliers(self) -> None:
        rich = F.when(F.col("s_acctbal") > 5000, "yes").otherwise("f")
        load_nodes(self.store, self.file(self.table("supplier"), "s_suppkey", name="s_name", acctbal="s_acctbal", rich=rich), "supplier")

    def inside(self) -> None:
        df = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        load_edges(self.store, self.file(df, "n_nationkey", n=F.lower("n_name"), r="r_name"), "inside", {"member": "n", "area": "r"})

    def df(self, program: str) -> DataFrame:
        return Session(self.store).df(program)


def store_load_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Build(spark, sf_dir)
    b.suppliers()
    return b.df("find supplier where acctbal > 0 as s\nreturn s.id, s.name, s.acctbal, s.rich")


def store_load_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Build(spark, sf_dir)
    b.nations()
    return b.df("find nation where code >= 3 as n\nreturn n.id, n.name, n.code, n.state")


def store_load_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints named by folded name and by node id."""
    b = _Build(spark, sf_dir)
    b.nations()
    b.suppliers()
    df = b.table("supplier")
    load_edges(b.store, b.file(df, "s_suppkey", firm=F.upper("s_name"), home=F.concat(F.lit("#n-"), F.col("s_nationkey") + 1), code="s_suppkey"), "based_in", {"firm": "firm", "home": "home"})
    found = b.df("find nation as n\nfollow n based_in firm as s\ngroup by n as g\ncount g.s as firms\nsum g.s.acctbal as total\nreturn n.name, firms, total")
    return found.withColumn("total", F.round("total", 2))


def store_assert_retire(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Build(spark, sf_dir)
    b.regions()
    b.nations()
    b.inside()
    Session(b.store).execute('assert region {name: "Atlantis"} as a\nassert nation {name: "Poseidonis", code: 99} as n\nassert edge inside(member: n, area: a)\nretire #r-3 reason "gone"\nretire #n-1 reason "gone"')
    return b.df("find region as r\nfollow r inside member as n\nreturn r.name, n.name, n.code")


def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the node that goes lead to the one that stays."""
    b = _Build(spark, sf_dir)
    b.regions()
    b.nations()
    b.inside()
    Session(b.store).execute("merge #n-1, #n-2\nmerge #n-1, #n-25")
    return b.df("find region as r\nfollow r inside member as n\nreturn r.name, n.id")


def store_snapshot_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Build(spark, sf_dir)
    b.nations()
    Session(b.store).execute('assert nation {name: "Thule", code: 50} as a')
    b.store.snapshot()
    Session(b.store).execute('retire #n-5 reason "gone"')
    b.store.close()
    b.store = Store(spark, b.store.path, _catalog())
    return b.df("find nation as n\nreturn n.id, n.name, n.code")


def store_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a table that is attached to a node become nodes of their own."""
    b = _Build(spark, sf_dir)
    os.makedirs(os.path.join(b.store.path, "attachments"))
    with open(os.path.join(b.store.path, "attachments", "lands.csv"), "w", encoding="utf-8") as f:
        f.writelines(["land,key\n", *(f"{r.n_name},{r.n_nationkey}\n" for r in b.table("nation").orderBy("n_nationkey").collect())])  # 25 rows at any scale
    Session(b.store).execute('assert nation {name: attach:lands} as t\nrefine t into nation with {name: col "land", code: col "key"} as k')
    return b.df("find nation where state = atom as n\nreturn n.name, n.code")


def store_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived class answers for its base."""
    b = _Build(spark, sf_dir)
    b.nations()
    Session(b.store).execute('derive class isle from nation with {area: float} quota 3\nassert isle {name: "Thule", code: 50, area: 2.5} as a\nassert isle {name: "Avalon", area: 1} as b')
    return b.df("find nation as n\ngroup by n.class as g\ncount g.n as n_nodes\nreturn g.key, n_nodes")


def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a compacted binding go, one composite node stands for them."""
    b = _Build(spark, sf_dir)
    b.nations()
    Session(b.store).execute('find nation where code < 10 as n\ncompact n as low {name: "Low"}')
    return b.df("find nation as n\nreturn n.name, n.state")


def store_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names like known ones become candidates until they are merged or declared distinct."""
    b = _Build(spark, sf_dir)
    b.nations()
    pairs = ("Zanzibar", "Zanzibarr"), ("Quivira", "Quiviraa"), ("Lemuria", "Lemuriaa")
    lines = [f'assert nation {{name: "{n}"}} as x{i}{j}' for i, pair in enumerate(pairs) for j, n in enumerate(pair)]
    Session(b.store).execute("\n".join([*lines, 'distinct x10, x11 reason "two lands"', "merge x20, x21"]))
    return b.df("find dup_candidates as d\nreturn d.class, d.a, d.b")


def store_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each node, kept up to date from the change feed by a stream that starts twice."""
    b = _Build(spark, sf_dir)
    s, target = Session(b.store), f"{b.top}/latest"

    def catch_up() -> None:
        q = follow_changes(b.store, upsert_latest(target), f"{b.top}/feed")
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    names = [r.r_name for r in b.table("region").orderBy("r_regionkey").collect()]  # five at any scale
    s.execute("\n".join(f'assert region {{name: "{n}"}} as r{i}' for i, n in enumerate(names)))
    catch_up()
    s.execute('retire #r-2 reason "gone"\nassert region {name: "Atlantis"} as a')
    catch_up()
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    last = max(int(f.getPath().getName()[1:]) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
    return spark.read.parquet(f"{target}/v{last}").groupBy("op").agg(F.count("*").alias("n"))


def store_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a file, staged by tasks: documents with the pieces they hold and the pieces' signs."""
    b = _Build(spark, sf_dir)
    files = b.table("documents").where("length(text) > 0").select(F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt")).alias("file"), F.encode("text", "UTF-8").alias("content"))
    stage_files(b.store, files)
    stage_files(b.store, files)  # what is there already is left alone
    pieces = b.df("find chunk as c\nfollow c part_of whole as d\nreturn d.title, c.ord, c.text")
    return pieces.groupBy("d_title").agg(F.count("*").alias("pieces"), F.sum(F.length("c_text")).alias("signs"), F.max("c_ord").alias("last"))


def store_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each kind the verbs leave in the log."""
    b = _Build(spark, sf_dir)
    b.regions()
    Session(b.store).execute('assert region {name: "Atlantis"} as a\nflag #r-1 reason "look"\nretire #r-2 reason "gone"\nassert region {name: "Mu"} as m')
    return b.store.records().groupBy("op").agg(F.count("*").alias("n")).where("op in ('node', 'flag', 'retire')")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (store_load_nodes, store_load_jsonl, store_load_edges, store_assert_retire, store_merge, store_snapshot_reopen, store_refine, store_derive, store_compact, store_duplicates, store_feed, store_stage, store_log)}


def oracle_sql() -> dict[str, str]:
    return {
        "store_load_nodes": "SELECT '#s-' || row_number() OVER (ORDER BY s_suppkey) AS s_id, s_name, s_acctbal, s_acctbal > 5000 AS s_rich FROM supplier QUALIFY s_acctbal > 0",
        "store_load_jsonl": "SELECT '#n-' || row_number() OVER (ORDER BY n_nationkey) AS n_id, n_name, CAST(n_nationkey AS BIGINT) AS n_code, 'atom' AS n_state FROM nation QUALIFY n_nationkey >= 3",
        "store_load_edges": "SELECT n_name, count(*) AS firms, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
        "store_assert_retire": "SELECT r_name, n_name, CAST(n_nationkey AS BIGINT) AS n_code FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 AND n_nationkey <> 0 UNION ALL SELECT 'Atlantis', 'Poseidonis', 99",
        "store_merge": "SELECT r_name, '#n-' || CASE WHEN n_nationkey IN (1, 24) THEN 1 ELSE n_nationkey + 1 END AS n_id FROM nation JOIN region ON n_regionkey = r_regionkey",
        "store_snapshot_reopen": "SELECT '#n-' || (n_nationkey + 1) AS n_id, n_name, CAST(n_nationkey AS BIGINT) AS n_code FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT '#n-' || (count(*) + 1), 'Thule', 50 FROM nation",
        "store_refine": "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_code FROM nation",
        "store_derive": "SELECT 'nation' AS g_key, count(*) AS n_nodes FROM nation UNION ALL SELECT 'isle', 2",
        "store_compact": "SELECT n_name, 'atom' AS n_state FROM nation WHERE n_nationkey >= 10 UNION ALL SELECT 'Low', 'composite'",
        "store_duplicates": "SELECT 'nation' AS d_class, '#n-' || (count(*) + 1) AS d_a, '#n-' || (count(*) + 2) AS d_b FROM nation",
        "store_feed": "SELECT 'node' AS op, count(*) AS n FROM region UNION ALL SELECT 'retire', 1",
        "store_stage": STAGE_SQL,
        "store_log": "SELECT 'node' AS op, count(*) + 2 AS n FROM region UNION ALL SELECT 'flag', 1 UNION ALL SELECT 'retire', 1",
    }


#: Of equal texts the smallest doc_id names the document; texts are single paragraphs, cut at 2400 signs.
STAGE_SQL = """
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS d_title, CAST(ceil(n / 2400.0) AS BIGINT) AS pieces, CAST(n AS BIGINT) AS signs, CAST(ceil(n / 2400.0) - 1 AS BIGINT) AS last
FROM (SELECT min(doc_id) AS doc_id, length(trim(text, E' \\t\\n\\r\\x0b\\x0c')) AS n FROM documents WHERE length(text) > 0 GROUP BY text)
WHERE n > 0
"""
