"""Registered queries of operators that are no programs: duplicates, documents, staging, streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.functions.sniff import sniff
from rolegraph.ingest.stage import chunk_texts
from rolegraph.operators.health import degrees
from rolegraph.operators.duplicates import sweep
from rolegraph.sources.commerce import commerce


def dup_candidates_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(commerce(spark, sf_dir), ["part"])


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sniff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of file each page would be, by its bytes."""

    @F.pandas_udf("string")
    def kind(html: pd.Series) -> pd.Series:
        return html.map(lambda t: sniff((t or "").encode(), "page.html"))

    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", kind("html").alias("kind"))


def stage_sha_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that staging would take once, and how often they come."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes have each degree over all edge types."""
    return degrees(commerce(spark, sf_dir)).groupBy("degree").agg(F.count("*").alias("nodes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (dup_candidates_parts, chunk_documents, sniff_pages, stage_sha_dedup, node_degrees)}


def oracle_sql() -> dict[str, str]:
    return {
        "chunk_documents": CHUNKS_SQL,
        "node_degrees": DEGREES_SQL,
        "stage_sha_dedup": "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    }


#: The documents are single paragraphs without headings: chunks are cuts of 2400 signs, as many as a text has.
CHUNKS_SQL = """
SELECT doc_id, CAST(k AS INTEGER) AS ord, CAST(k * 2400 + lead AS BIGINT) AS "offset", CAST(least(2400, length(t) - k * 2400) AS BIGINT) AS n_chars
FROM (
  SELECT doc_id, t, lead, unnest(range(0, CAST(ceil(length(t) / 2400.0) AS BIGINT))) AS k
  FROM (SELECT doc_id, trim(text, E' \\t\\n\\r\\x0b\\x0c') AS t, 0 AS lead FROM documents)
)
"""

#: Endpoints of all edges, a loop once.
DEGREES_SQL = """
WITH top AS (SELECT max(p_partkey) + 1 AS n FROM part), firms AS (SELECT count(*) AS n FROM supplier),
tree AS (SELECT p_partkey AS k, unnest([2 * p_partkey + 1, 2 * p_partkey + 2]) AS c FROM part),
ends AS (
  SELECT 'n' AS f, n_nationkey AS k FROM nation WHERE n_regionkey IS NOT NULL UNION ALL SELECT 'r', n_regionkey FROM nation
  UNION ALL SELECT 'c', c_custkey FROM customer WHERE c_nationkey IS NOT NULL UNION ALL SELECT 'n', c_nationkey FROM customer
  UNION ALL SELECT 's', s_suppkey FROM supplier WHERE s_nationkey IS NOT NULL UNION ALL SELECT 'n', s_nationkey FROM supplier
  UNION ALL SELECT 'o', o_orderkey FROM orders WHERE o_custkey IS NOT NULL UNION ALL SELECT 'c', o_custkey FROM orders
  UNION ALL SELECT 'o', l_orderkey FROM lineitem UNION ALL SELECT 'p', l_partkey FROM lineitem
  UNION ALL SELECT 'o', l_orderkey FROM lineitem UNION ALL SELECT 's', l_suppkey FROM lineitem
  UNION ALL SELECT 'p', l_partkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 's', l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  UNION ALL SELECT 'e', event_id FROM events WHERE user_id IS NOT NULL UNION ALL SELECT 'u', user_id FROM events
  UNION ALL SELECT 'p', k FROM tree, top WHERE c < n UNION ALL SELECT 'p', c FROM tree, top WHERE c < n
  UNION ALL SELECT 's', s_suppkey FROM supplier UNION ALL SELECT 's', (s_suppkey * 7 + 1) % n FROM supplier, firms WHERE (s_suppkey * 7 + 1) % n <> s_suppkey
)
SELECT degree, count(*) AS nodes FROM (SELECT f, k, count(*) AS degree FROM ends GROUP BY f, k) GROUP BY degree
"""
