"""Registered queries over the commerce graph, each with its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.session import Session
from rolegraph.sources.commerce import commerce

#: name -> (program, SQL, rounded columns)
PROGRAMS: dict[str, tuple[str, str] | tuple[str, str, dict[str, int]]] = {
    # scans and predicates
    "find_all_regions": ("find region as r\nreturn r.name, r.id, r.class, r.state", "SELECT r_name AS r_name, '#r-' || r_regionkey AS r_id, 'region' AS r_class, 'atom' AS r_state FROM region"),
    "find_eq_folded": ('find part where name = "SMALL Ring" as p\nreturn p.id, p.name', "SELECT '#' || (CASE WHEN p_type LIKE 'ECONOMY%' THEN 'e' ELSE 'p' END) || '-' || p_partkey AS p_id, p_name FROM part WHERE lower(p_name) = 'small ring'"),
    "find_range": ("find part where size >= 10 and size < 12 as p\nreturn p.id, p.size", "SELECT '#' || (CASE WHEN p_type LIKE 'ECONOMY%' THEN 'e' ELSE 'p' END) || '-' || p_partkey AS p_id, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size >= 10 AND p_size < 12"),
    "find_and_or": (
        'find customer where segment = "building" and acctbal > 9000 or segment = "machinery" and acctbal < 0 as c\nreturn c.name, c.segment, c.acctbal',
        "SELECT c_name, c_mktsegment AS c_segment, c_acctbal FROM customer WHERE (lower(c_mktsegment) = 'building' AND c_acctbal > 9000) OR (lower(c_mktsegment) = 'machinery' AND c_acctbal < 0)",
    ),
    "find_contains": ('find part where name contains "WID" as p\ncount p as n\nreturn n', "SELECT count(*) AS n FROM part WHERE lower(p_name) LIKE '%wid%'"),
    "find_contains_number": ("find part where size contains 4 as p\ncount p as n\nreturn n", "SELECT count(*) AS n FROM part WHERE CAST(p_size AS VARCHAR) LIKE '%4%'"),
    "find_neq": ('find purchase where status != "f" as o\ncount o as n\nreturn n', "SELECT count(*) AS n FROM orders WHERE lower(o_orderstatus) <> 'f'"),
    "find_type_mismatch": ('find part where size != "big" and brand > "brand#2" as p\ncount p as n\nreturn n', "SELECT count(*) AS n FROM part WHERE lower(p_brand) > 'brand#2'"),
    "find_present": ("find part where name != none and size = none as p\ncount p as n\nreturn n", "SELECT count(*) AS n FROM part WHERE p_name IS NOT NULL AND p_size IS NULL"),
    "find_date_text": ('find purchase where order_date >= "1997-01-01" and order_date < "1997-02-01" as o\nreturn o.id, o.order_date', "SELECT '#p-' || o_orderkey AS o_id, strftime(o_orderdate, '%Y-%m-%d') AS o_order_date FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-02-01'"),
    "find_subclass_union": ("find part as p\ngroup by p.class as g\ncount g.p as n\nreturn g.key, n", "SELECT CASE WHEN p_type LIKE 'ECONOMY%' THEN 'economy_part' ELSE 'part' END AS g_key, count(*) AS n FROM part GROUP BY 1"),
    "find_subclass_only": ("find economy_part where size > 45 as p\nreturn p.id, p.brand", "SELECT '#e-' || p_partkey AS p_id, p_brand FROM part WHERE p_type LIKE 'ECONOMY%' AND p_size > 45"),
    "find_any_node": ('find nodes where name contains "a" as x\ngroup by x.class as g\ncount g.x as n\nreturn g.key, n', "SELECT k AS g_key, count(*) AS n FROM (SELECT 'region' AS k, r_name AS s FROM region UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'customer', c_name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT CASE WHEN p_type LIKE 'ECONOMY%' THEN 'economy_part' ELSE 'part' END, p_name FROM part) WHERE lower(s) LIKE '%a%' GROUP BY k"),
    "find_class_catalog": ("find class where base = part as k\nreturn k.name, k.status, k.base", "SELECT 'economy_part' AS k_name, 'active' AS k_status, 'part' AS k_base"),
    "multivalued_membership": ('find part where words = "ring" as p\ncount p as n\nreturn n', "SELECT count(*) AS n FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')"),
    "multivalued_not": ('find part where words != "ring" and words contains "ed" as p\ncount p as n\nreturn n', "SELECT count(*) AS n FROM part WHERE NOT list_contains(string_split(p_name, ' '), 'ring') AND len(list_filter(string_split(p_name, ' '), lambda x: x LIKE '%ed%')) > 0"),
    # traversal
    "follow_one_hop": ("find customer where acctbal > 9500 as c\nfollow c lives_in home as n\nreturn c.name, n.name", "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500"),
    "follow_two_hop": ("find region where name = asia as r\nfollow r in_region member as n\nfollow n based_in firm as s\nreturn s.name, n.name", "SELECT s_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'ASIA'"),
    "follow_three_hop_region": ("find purchase where total > 400000 as o\nfollow o placed_by buyer as c\nfollow c lives_in home as n\nfollow n in_region area as r\ngroup by r as g\ncount g.o as n_orders\nreturn r.name, n_orders", "SELECT r_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 400000 GROUP BY r_name"),
    "follow_where_arrival": ('find nation where name = "nation_3" as n\nfollow n lives_in resident where segment = "BUILDING" as c\nreturn c.name', "SELECT c_name FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'"),
    "follow_via_edge_property": ("find supplier as s\nfollow s line_firm deal where via.quantity >= 50 and via.discount > 0.09 as o\ngroup by s as g\ncount distinct g.o as n\nreturn s.name, n", "SELECT s_name, count(DISTINCT l_orderkey) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 50 AND l_discount > 0.09 GROUP BY s_suppkey, s_name"),
    "follow_via_none": ("find supplier as s\nfollow s supplies item where via.last_ship = none as p\ncount p as n\nreturn n", "SELECT count(*) AS n FROM (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING max(l_shipdate) >= TIMESTAMP '1998-01-01') JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey"),
    "follow_trail_neighbours": ('find supplier where name = "Supplier#000000007" as a\nfollow a based_in home as n\nfollow n based_in firm as b\nreturn b.name', "SELECT b.s_name AS b_name FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE a.s_name = 'Supplier#000000007'"),
    "follow_optional_zero_counts": ("find customer as c\nfollow c placed_by deal where total > 300000 as o or none\ngroup by c as g\ncount g.o as n\nreturn c.name, n", "SELECT c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey, c_name"),
    "follow_optional_rows": ("find nation as n\nfollow n based_in firm where acctbal < 0 as s or none\nreturn n.name, s.name", "SELECT n_name, s_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0"),
    "anti_join_idiom": ("find customer as c\nfollow c placed_by deal where total > 300000 as o or none\nkeep c where o = none\nreturn c.name", "SELECT c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "semi_join_idiom": ("find customer as c\nfollow c placed_by deal where total > 450000 as o\nreturn c.name", "SELECT c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"),
    "name_reuse_intersection": (
        'find part as p\nfollow p supplies source where name = "Supplier#000000001" as a\nfollow p supplies source where name = "Supplier#000000002" as b\nreturn p.id',
        "SELECT '#' || (CASE WHEN p_type LIKE 'ECONOMY%' THEN 'e' ELSE 'p' END) || '-' || p_partkey AS p_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2)",
    ),
    "name_reuse_join": (
        'find supplier where name = "Supplier#000000001" as a\nfollow a supplies item as p\nfind supplier where name = "Supplier#000000002" as b\nfollow b supplies item as p\nreturn p.id',
        "SELECT '#' || (CASE WHEN p_type LIKE 'ECONOMY%' THEN 'e' ELSE 'p' END) || '-' || p_partkey AS p_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2)",
    ),
    "two_finds_cross": ("find region as r\nfind nation where name contains \"_2\" as n\nreturn r.name, n.name", "SELECT r_name, n_name FROM region, nation WHERE n_name LIKE '%_2%' ESCAPE '!' AND contains(n_name, '_2')"),
    "two_finds_natural": ("find part where size > 40 as p\nfind part where size < 43 as p\ncount p as n\nreturn n", "SELECT count(*) AS n FROM part WHERE p_size > 40 AND p_size < 43"),
    # reach
    "upto_bounded": ("find part as p\nfollow p contains piece upto 3 as q\ngroup by p as g\ncount distinct g.q as n\nreturn p.id, n", "WITH RECURSIVE t AS (SELECT p_partkey AS k, unnest([2 * p_partkey + 1, 2 * p_partkey + 2]) AS c FROM part), e AS (SELECT k, c FROM t WHERE c < (SELECT max(p_partkey) + 1 FROM part)), r(s, n, d) AS (SELECT k, c, 1 FROM e UNION SELECT s, c, d + 1 FROM r JOIN e ON n = k WHERE d < 3) SELECT '#' || (CASE WHEN a.p_type LIKE 'ECONOMY%' THEN 'e' ELSE 'p' END) || '-' || a.p_partkey AS p_id, count(DISTINCT n) AS n FROM r JOIN part a ON a.p_partkey = s GROUP BY 1"),
    "upto_any_tree": ("find part as p\nfollow p contains piece upto any as q\ngroup by p as g\ncount distinct g.q as n\nreturn p.id, n", "WITH RECURSIVE t AS (SELECT p_partkey AS k, unnest([2 * p_partkey + 1, 2 * p_partkey + 2]) AS c FROM part), e AS (SELECT k, c FROM t WHERE c < (SELECT max(p_partkey) + 1 FROM part)), r(s, n) AS (SELECT k, c FROM e UNION SELECT s, c FROM r JOIN e ON n = k) SELECT '#' || (CASE WHEN a.p_type LIKE 'ECONOMY%' THEN 'e' ELSE 'p' END) || '-' || a.p_partkey AS p_id, count(*) AS n FROM r JOIN part a ON a.p_partkey = s GROUP BY 1"),
    "upto_any_cycle": ("find supplier as s\nfollow s next_firm succ upto any as x\ngroup by s as g\ncount distinct g.x as n\nreturn s.id, n", "WITH RECURSIVE m AS (SELECT count(*) AS c FROM supplier), r(s, n) AS (SELECT s_suppkey, (s_suppkey * 7 + 1) % c FROM supplier, m UNION SELECT s, (n * 7 + 1) % c FROM r, m) SELECT '#s-' || s AS s_id, count(*) AS n FROM r GROUP BY s"),
    "upto_filtered": ("find part as p\nfollow p contains piece where size > 40 upto 4 as q\nreturn p.id, q.id, q.size", "WITH RECURSIVE t AS (SELECT p_partkey AS k, unnest([2 * p_partkey + 1, 2 * p_partkey + 2]) AS c FROM part), e AS (SELECT k, c FROM t WHERE c < (SELECT max(p_partkey) + 1 FROM part)), r(s, n, d) AS (SELECT k, c, 1 FROM e UNION SELECT s, c, d + 1 FROM r JOIN e ON n = k WHERE d < 4) SELECT DISTINCT '#' || (CASE WHEN a.p_type LIKE 'ECONOMY%' THEN 'e' ELSE 'p' END) || '-' || a.p_partkey AS p_id, '#' || (CASE WHEN b.p_type LIKE 'ECONOMY%' THEN 'e' ELSE 'p' END) || '-' || b.p_partkey AS q_id, CAST(b.p_size AS BIGINT) AS q_size FROM r JOIN part a ON a.p_partkey = s JOIN part b ON b.p_partkey = n WHERE b.p_size > 40"),
    "upto_reverse": ("find part as q\nfollow q contains whole upto any as p\ngroup by q as g\ncount distinct g.p as n\nreturn q.id, n", "WITH RECURSIVE r(s, n) AS (SELECT p_partkey, (p_partkey - 1) // 2 FROM part WHERE p_partkey > 0 UNION SELECT s, (n - 1) // 2 FROM r WHERE n > 0) SELECT '#' || (CASE WHEN a.p_type LIKE 'ECONOMY%' THEN 'e' ELSE 'p' END) || '-' || a.p_partkey AS q_id, count(*) AS n FROM r JOIN part a ON a.p_partkey = s GROUP BY 1"),
    "upto_reused_name": ("find supplier as s\nfollow s next_firm succ upto any as s\nreturn s.id", "WITH RECURSIVE m AS (SELECT count(*) AS c FROM supplier), r(s, n) AS (SELECT s_suppkey, (s_suppkey * 7 + 1) % c FROM supplier, m UNION SELECT s, (n * 7 + 1) % c FROM r, m) SELECT '#s-' || s AS s_id FROM r WHERE s = n"),
    # unions
    "or_union": ('find nation where name = "nation_1" as n\nfollow n based_in firm as s\nor\nfind nation where name = "nation_2" as n\nfollow n based_in firm as s\nreturn s.name', "SELECT s_name FROM supplier WHERE s_nationkey IN (1, 2)"),
    "or_union_count": ('find supplier where acctbal > 5000 as s\nor\nfind supplier where name contains "5" as s\ncount distinct s as n\nreturn n', "SELECT count(*) AS n FROM supplier WHERE s_acctbal > 5000 OR contains(s_name, '5')"),
    # aggregation
    "min_slice": ("find part where size > 40 as p\nfollow p supplies source as s\ngroup by s as g\ncount distinct g.p as n_parts\nreturn s.name, n_parts order by n_parts desc", "SELECT s_name, count(DISTINCT l_partkey) AS n_parts FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE p_size > 40 GROUP BY s_suppkey, s_name"),
    "group_by_identity": ("find supplier where acctbal > 9000 as s\nfollow s supplies item as p\ngroup by p as g\ncount g.s as n\nreturn p.id, p.name, n", "SELECT '#' || (CASE WHEN p_type LIKE 'ECONOMY%' THEN 'e' ELSE 'p' END) || '-' || p_partkey AS p_id, p_name, count(DISTINCT l_suppkey) AS n FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 9000 GROUP BY p_partkey, p_name, p_type"),
    "group_by_value": ("find part as p\ngroup by p.name as g\ncount g.p as n\nreturn g.key, n", "SELECT p_name AS g_key, count(*) AS n FROM part GROUP BY p_name"),
    "group_key_only": ("find part as p\ngroup by p.brand as g\nreturn g", "SELECT DISTINCT p_brand AS g FROM part"),
    "group_member": ("find part where size = 7 as p\ngroup by p.brand as g\nreturn g.p.name", "SELECT p_name AS g_p_name FROM part WHERE p_size = 7"),
    "agg_count": ("find purchase as o\nfollow o placed_by buyer as c\ngroup by c.segment as g\ncount g.o as n\ncount distinct g.c as n_buyers\nreturn g.key, n, n_buyers", "SELECT c_mktsegment AS g_key, count(*) AS n, count(DISTINCT c_custkey) AS n_buyers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "agg_sum_distinct_binding": ("find supplier as s\nfollow s supplies item as p\ngroup by s as g\nsum distinct g.p.size as total\navg distinct g.p.size as mean\nreturn s.name, total, mean", "SELECT s_name, CAST(sum(p_size) AS BIGINT) AS total, round(avg(p_size), 6) AS mean FROM (SELECT DISTINCT s_suppkey, s_name, p_partkey, p_size FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey) GROUP BY s_suppkey, s_name", {"mean": 6}),
    "agg_minmax_avg": ("find purchase as o\ngroup by o.priority as g\nmin g.o.total as low\nmax g.o.total as high\navg g.o.total as mean\nsum g.o.total as total\nreturn g.key, low, high, mean, total", "SELECT o_orderpriority AS g_key, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", {"mean": 4, "total": 2}),
    "agg_global_each": ("find part as p\ncount p as n\nsum p.size as total\nmin p.name as first\nmax p.retailprice as top\navg p.size as mean\nreturn n, total, first, top, mean", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, min(p_name) AS first, max(p_retailprice) AS top, round(avg(p_size), 6) AS mean FROM part", {"mean": 6}),
    "agg_empty_sum": ("find part where size > 1000 as p\nsum p.size as total\ncount p as n\navg p.size as mean\nreturn total, n, mean", "SELECT CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS mean"),
    "keep_having": ("find nation as n\nfollow n lives_in resident as c\ngroup by n as g\ncount g.c as n_c\nkeep g where n_c > 60\nreturn n.name, n_c", "SELECT n_name, count(*) AS n_c FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name HAVING count(*) > 60"),
    "keep_plain": ("find customer as c\nfollow c lives_in home as n\nkeep c where acctbal > 9000 and n.name != \"nation_3\"\nreturn c.name, n.name", "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 AND n_name <> 'NATION_3'"),
    "keep_then_more_aggregates": ("find nation as n\nfollow n lives_in resident as c\ngroup by n as g\ncount g.c as k\nkeep g where k > 55\nmax g.c.acctbal as top\nreturn n.name, k, top", "SELECT n_name, count(*) AS k, max(c_acctbal) AS top FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name HAVING count(*) > 55"),
    # arithmetic
    "compute_arithmetic": ("find supplier as s\ncompute s.acctbal plus s.acctbal as twice\ncompute twice minus s.acctbal as once\ncompute s.acctbal times s.acctbal as square\nreturn s.name, twice, once, square", "SELECT s_name, round(s_acctbal + s_acctbal, 4) AS twice, round(s_acctbal + s_acctbal - s_acctbal, 4) AS once, round(s_acctbal * s_acctbal, 4) AS square FROM supplier", {"twice": 4, "once": 4, "square": 4}),
    "compute_over": ("find part as p\ncompute p.retailprice over p.size as unit\nreturn p.id, unit", "SELECT '#' || (CASE WHEN p_type LIKE 'ECONOMY%' THEN 'e' ELSE 'p' END) || '-' || p_partkey AS p_id, round(p_retailprice / p_size, 6) AS unit FROM part", {"unit": 6}),
    "compute_same": ("find supplier as a\nfollow a next_firm succ as b\nfollow a based_in home as x\nfollow b based_in home as y\ncompute x.name same y.name as together\nkeep a where together = true\nreturn a.name, b.name", "SELECT a.s_name AS a_name, b.s_name AS b_name FROM supplier a JOIN supplier b ON b.s_suppkey = (a.s_suppkey * 7 + 1) % (SELECT count(*) FROM supplier) WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey"),
    # returns
    "return_identity_dedup": ("find purchase where total > 300000 as o\nfollow o line_part item as p\nreturn p.name, p.size", "SELECT p_name, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 300000)"),
    "return_distinct_values": ("find purchase where total > 300000 as o\nfollow o line_part item as p\nreturn distinct p.name", "SELECT DISTINCT p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 300000)"),
    "order_nulls_last_desc": ("find supplier as s\nfollow s supplies item where via.last_ship != none as p or none\ngroup by s as g\nmin g.p.size as least\nreturn s.name, least order by least desc", "SELECT s_name, CAST(min(p_size) AS BIGINT) AS least FROM supplier LEFT JOIN (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING max(l_shipdate) < TIMESTAMP '1998-01-01') ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY s_suppkey, s_name"),
    "topk_limit": ("find customer as c\nreturn c.name, c.acctbal order by c.acctbal desc limit 25", "SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25"),
    "limit_by_rank": ("find part where size = 20 as p\nreturn p.id limit 10", "SELECT '#' || (CASE WHEN p_type LIKE 'ECONOMY%' THEN 'e' ELSE 'p' END) || '-' || p_partkey AS p_id FROM part WHERE p_size = 20 ORDER BY p_partkey LIMIT 10"),
    "find_order_limit": ("find customer where acctbal > 0 order by acctbal desc as c\nreturn c.name limit 5", "SELECT c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 5"),
    # derived views
    "health_structure": ("find nation as n\nreturn n.name, n.health.structure", "SELECT n_name, CAST(least(1.0, (1 + coalesce(c, 0) + coalesce(s, 0)) / 100.0) AS DOUBLE) AS n_health_structure FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey"),
    "health_filter": ("find supplier where health.structure < 0.9 as s\ncount s as n\nreturn n", "SELECT count(*) AS n FROM (SELECT s_suppkey, least(1.0, (count(l_suppkey) + 3) / 100.0) AS h FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1) WHERE h < 0.9"),
    # more than one operator
    "revenue_by_nation": ("find purchase where status = \"F\" as o\nfollow o placed_by buyer as c\nfollow c lives_in home as n\ngroup by n as g\nsum g.o.total as revenue\ncount distinct g.c as buyers\nreturn n.name, revenue, buyers order by revenue desc", "SELECT n_name, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT c_custkey) AS buyers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_nationkey, n_name", {"revenue": 2}),
    "lines_per_part_brand": ("find purchase as o\nfollow o line_part item as p\ngroup by p.brand as g\ncount g.o as lines\ncount distinct g.o as deals\nreturn g.key, lines, deals", "SELECT p_brand AS g_key, count(*) AS lines, count(DISTINCT l_orderkey) AS deals FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "events_per_shopper": ("find shopper as u\nfollow u emitted item where kind = \"purchase\" as e or none\ngroup by u as g\ncount g.e as n\nsum g.e.value as total\nreturn u.user_id, n, total", "SELECT u.user_id AS u_user_id, count(e.event_id) AS n, round(coalesce(sum(e.value), 0), 4) AS total FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = 'purchase' GROUP BY 1", {"total": 4}),
}


_sessions: dict[tuple[str, str], Session] = {}


def _session(spark: SparkSession, sf_dir: str) -> Session:
    """The registered tables of a folder: registration reads footers and is done once, data is never kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _sessions:
        if len(_sessions) >= 8:
            _sessions.clear()
        _sessions[key] = Session(commerce(spark, sf_dir))
    return _sessions[key]


def _program(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text, _, *rounded = PROGRAMS[name]
        df = _session(spark, sf_dir).df(text)
        for c, n in (rounded[0] if rounded else {}).items():
            df = df.withColumn(c, F.round(c, n))
        return df

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from rolegraph import more_queries, store_queries

    return {name: _program(name) for name in PROGRAMS} | more_queries.queries() | store_queries.queries()


def oracle_sql() -> dict[str, str]:
    from rolegraph import more_queries, store_queries

    return {name: entry[1] for name, entry in PROGRAMS.items()} | more_queries.oracle_sql() | store_queries.oracle_sql()
