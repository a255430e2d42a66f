"""A store's committed segments as a Structured Streaming source, and views kept up to date from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolegraph.store.store import RECORD, Store


def changes(store: Store) -> DataFrame:
    """Records of JSON segments as they are committed; a snapshot replaces files that were read before."""
    return store.spark.readStream.schema(RECORD).option("pathGlobFilter", "log-*.jsonl").json("file://" + store.path)


def follow_changes(store: Store, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call handle(records, batch) for what is committed from the checkpoint on."""
    return changes(store).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def counters(store: Store) -> DataFrame:
    """A streaming count of records by kind and class."""
    return changes(store).groupBy("op", "cls").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


def upsert_latest(target: str) -> Callable[[DataFrame, int], None]:
    """A handler that keeps, per node, the record with the last position; a batch given twice changes nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where("op in ('node', 'patch', 'retire')").select("nid", "pos", "op", "cls", "props")
        path = f"{target}/v{number}"
        before = [p for p in range(number - 1, -1, -1) if _exists(spark, f"{target}/v{p}")]
        rows = new.unionByName(spark.read.parquet(f"{target}/v{before[0]}")) if before else new
        rows.groupBy("nid").agg(F.max_by(F.struct("pos", "op", "cls", "props"), "pos").alias("r")).select("nid", "r.*").write.mode("overwrite").parquet(path)

    return handle


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
