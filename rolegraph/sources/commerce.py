"""The graph over the star-schema tables: customers, suppliers, parts, orders and events as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.sources.relations import Relations


def commerce(spark: SparkSession, sf_dir: str) -> Relations:
    """Register the tables of a folder; nothing is read before a query asks for it."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    g = Relations(spark)
    nation, region, customer, supplier, part, orders, lineitem, events = (read(t) for t in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    g.add_class("region", region, "r_regionkey", {"name": "r_name"})
    g.add_class("nation", nation, "n_nationkey", {"name": "n_name"})
    g.add_class("customer", customer, "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment"})
    g.add_class("supplier", supplier, "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal"})
    props = {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice", "words": F.split("p_name", " ")}
    economy = F.startswith(F.col("p_type"), F.lit("ECONOMY"))
    g.add_class("part", part.where(~F.coalesce(economy, F.lit(False))), "p_partkey", props)
    g.add_class("economy_part", part.where(economy), "p_partkey", props, base="part")
    g.add_class("purchase", orders, "o_orderkey", {"status": "o_orderstatus", "total": "o_totalprice", "order_date": day("o_orderdate"), "priority": "o_orderpriority"})
    g.add_class("event", events, "event_id", {"kind": "event_type", "value": "value", "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")})
    g.add_class("shopper", events.select("user_id").distinct(), "user_id", {"user_id": "user_id"})
    g.add_edge("in_region", nation, {"member": ("nation", "n_nationkey"), "area": ("region", "n_regionkey")}, unique=True)
    g.add_edge("lives_in", customer, {"resident": ("customer", "c_custkey"), "home": ("nation", "c_nationkey")}, unique=True)
    g.add_edge("based_in", supplier, {"firm": ("supplier", "s_suppkey"), "home": ("nation", "s_nationkey")}, unique=True)
    g.add_edge("placed_by", orders, {"deal": ("purchase", "o_orderkey"), "buyer": ("customer", "o_custkey")}, unique=True)
    line = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "ship_date": day("l_shipdate")}
    g.add_edge("line_part", lineitem, {"deal": ("purchase", "l_orderkey"), "item": ("part", "l_partkey")}, line)
    g.add_edge("line_firm", lineitem, {"deal": ("purchase", "l_orderkey"), "firm": ("supplier", "l_suppkey")}, line)
    spells = lineitem.groupBy("l_partkey", "l_suppkey").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_ship"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("m"))
    spells = spells.withColumn("last_ship", F.when(F.col("m") < "1998-01-01", F.col("m")))  # a spell that reaches 1998 is open
    g.add_edge("supplies", spells, {"item": ("part", "l_partkey"), "source": ("supplier", "l_suppkey")}, {"first_ship": "first_ship", "last_ship": "last_ship"}, unique=True)
    g.add_edge("emitted", events, {"item": ("event", "event_id"), "actor": ("shopper", "user_id")}, unique=True)
    g.add_edge("contains", tree(part), {"whole": ("part", "k"), "piece": ("part", "child")}, unique=True)
    g.add_edge("next_firm", ring(supplier), {"prev": ("supplier", "k"), "succ": ("supplier", "next")}, unique=True)
    return g


def tree(part: DataFrame) -> DataFrame:
    """Part k holds parts 2k + 1 and 2k + 2."""
    n = part.agg((F.max("p_partkey") + 1).alias("n"))
    children = part.select(F.col("p_partkey").alias("k"), F.explode(F.array(F.col("p_partkey") * 2 + 1, F.col("p_partkey") * 2 + 2)).alias("child"))
    return children.crossJoin(F.broadcast(n)).where("child < n").select("k", "child")  # one row with the number of parts


def ring(supplier: DataFrame) -> DataFrame:
    """Supplier k is followed by (7 k + 1) mod n."""
    n = supplier.agg(F.count("*").alias("n"))
    return supplier.select(F.col("s_suppkey").alias("k")).crossJoin(F.broadcast(n)).select("k", ((F.col("k") * 7 + 1) % F.col("n")).alias("next"))  # one row
