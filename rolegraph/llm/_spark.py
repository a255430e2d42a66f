"""Shared Spark helpers: scratch tables, size-checked joins, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to a Python worker at once: whole texts are large, and both sides hold a batch.
ARROW_ROWS = 1_000
#: A side is broadcast only if its rows, at this many bytes each, stay below BROADCAST_BYTES.
BROADCAST_BYTES = 32 << 20
ID_BYTES = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="rolegraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Have workers get whole texts in batches of ARROW_ROWS, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rolegraph/{name}-{uuid.uuid4().hex}"


#: Paths of the scratch tables that this driver wrote and has not deleted.
_tables: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and a lost executor costs nothing before it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    _tables.append(path)
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        _delete(spark, t._scratch)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _tables:
        _tables.remove(path)
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: until then the files of a shuffle stay on disk, though what it led to is written."""
    gc.collect()
    spark._jvm.System.gc()


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, as a scratch table; the tables that were written on the way are deleted."""
    before = set(_tables)
    out = written(make(), name)
    for path in set(_tables) - before - {out._scratch}:
        _delete(out.sparkSession, path)
    return out


def small_enough(df: DataFrame, row_bytes: int = ID_BYTES, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df's rows stay below the broadcast limit; looks at no more rows than that."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def with_running(df: DataFrame, lengths: str, out: str, step: int = 64) -> DataFrame:
    """df with an array more: for each element of an int array, the sum of those before it.

    Sums of blocks of `step` elements come first, so the cost of n elements is n * step + (n / step) ** 2.
    """
    add = lambda array: F.aggregate(array, F.lit(0), lambda a, x: a + x)
    block = lambda i: F.floor(i / step).cast("int")
    df = df.withColumn("__sums", F.transform(F.sequence(F.lit(0), block(F.size(lengths))), lambda k: add(F.slice(lengths, k * step + 1, F.lit(step)))))
    df = df.withColumn("__bases", F.transform("__sums", lambda _, k: add(F.slice("__sums", F.lit(1), k))))
    df = df.withColumn(out, F.transform(lengths, lambda _, i: F.get("__bases", block(i)) + add(F.slice(lengths, block(i) * step + 1, i % step))))
    return df.drop("__sums", "__bases")


def drawn(key: str, take: int, of: int) -> Column:
    """Whether a row belongs to a sample of about `take` rows out of `of`, by a 64-bit hash of its key."""
    if of <= take:
        return F.lit(True)
    return F.xxhash64(F.col(key).cast("string")) < F.lit((take << 64) // of - (1 << 63)).cast("long")


def keep_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id", text: str | None = None) -> DataFrame:
    """Rows of docs with (left_semi) or without (left_anti) their key in ids; null equals null.

    ids is a written table of one column, or of two, the second row_mark() of the text: then a row is
    meant by its key and its text, so rows that share a key have a fate each.  ids is broadcast only
    if it is small by count; else Spark joins by shuffle, skewed keys split by adaptive execution.
    """
    side = ids.select(*(F.col(c).alias(f"__{n}") for c, n in zip(ids.columns, ("id", "mark"))))
    if small_enough(ids):
        side = F.broadcast(side)
    on = docs[key].eqNullSafe(side["__id"])
    return docs.join(side, on if text is None else on & (row_mark(docs[text]) == side["__mark"]), how)


def row_mark(text: Column) -> Column:
    """A 64-bit mark of a text, null being empty, that tells rows of one key apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node reached.

    Alternating large-star and small-star steps: each is one distributed aggregation, the number of
    rounds is logarithmic in the longest chain, and no round collects an adjacency list: a star is
    the minimum of a node's neighbours joined back to them.
    """
    spark = edges.sparkSession
    kinds = edges.select("a", "b").where("a <> b")
    now = written(kinds.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    nodes = now
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        small = small.where("a <> b").distinct()
        after = written(small, name)
        # at the fixed point every edge leads to its component's smallest node: no b is ever an a
        tops = after.select(F.col("b").alias("a")).distinct().join(after.select("a").distinct(), "a", "left_semi")
        many = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        done = tops.limit(1).count() == 0 and many.limit(1).count() == 0
        if now is not nodes:
            release(spark, now)
        now = after
        if done:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = written(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), name)
    release(spark, now, *([nodes] if nodes is not now else []))
    return out
