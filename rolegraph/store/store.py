"""The managed store.

A store is a folder: `manifest.json` names its segments in order.  A segment is a file of JSON lines
(one program's statement) or a Parquet folder (a bulk load or a snapshot), all with the schema RECORD.
A commit writes its segment first and then replaces the manifest, so readers see all of it or none;
what a crash leaves beside the manifest is ignored.  Nodes and edges are views over the records:
later records win by position.  One process writes, under an advisory lock; readers call refresh().
"""

from __future__ import annotations

import functools
import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.catalog import Catalog
from rolegraph.lang.tree import ProgramError
from rolegraph.sources.relations import SPARK_TYPES

RECORD = (
    "pos long, op string, nid long, id string, cls string, props map<string,string>, state string, origin long, eid long, type string, "
    "a long, b long, reason string, kind string, payload string, score double, evidence string, source string, conflicts int"
)
OPS = ("node", "edge", "patch", "retire", "retire_edge", "state", "alias", "flag", "lineage", "dup", "distinct", "rows")
#: A snapshot is taken once the log has this many segments.
SNAPSHOT_SEGMENTS = 200
KEEP_SNAPSHOTS = 2


class StoreProblem(ProgramError):
    pass


def text_of(value: object) -> str | None:
    """A property's value as the text that records hold."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, dict)):
        return json.dumps(value, ensure_ascii=False)
    return str(value)


class Store:
    def __init__(self, spark: SparkSession, path: str, catalog: Catalog | None = None, lock: bool = True, track: bool = False):
        """track: reads count which nodes they walk through, in tables beside the log; a count may be lost, a record never is."""
        self.track = track
        self.spark, self.path = spark, os.path.abspath(path.removeprefix("file://"))
        os.makedirs(self.path, exist_ok=True)
        self._lock = None
        if lock:
            self._take_lock()
        self._declared = catalog.copy() if catalog else Catalog.standard()
        self.manifest: dict = {}
        self.refresh()

    # files

    def _take_lock(self) -> None:
        import fcntl

        f = open(os.path.join(self.path, "lock"), "a+")
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            f.seek(0)
            holder = f.read().strip()
            f.close()
            raise StoreProblem(f"the store {self.path} is open for writing in process {holder or 'unknown'}") from e
        f.seek(0)
        f.truncate()
        f.write(str(os.getpid()))
        f.flush()
        self._lock = f

    def close(self) -> None:
        if self._lock is not None:
            self._lock.close()
            self._lock = None

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _file(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def refresh(self) -> int:
        """See what has been committed since; returns the number of new positions."""
        before = self.manifest.get("pos", 0)
        name = self._file("manifest.json")
        if os.path.exists(name):
            try:
                with open(name, encoding="utf-8") as f:
                    self.manifest = json.load(f)
            except ValueError as e:
                raise StoreProblem(f"{name} is damaged: {e}") from e
            if self.manifest.get("format") != 1:
                raise StoreProblem(f"{name} has a format of another version: {self.manifest.get('format')}")
            if strange := set(self.manifest["ops"]) - set(OPS):
                raise StoreProblem(f"the store holds records of unknown kinds: {sorted(strange)}")
            for s in self.manifest["segments"]:
                if not os.path.exists(self._file(s)):
                    raise StoreProblem(f"the segment {s} is missing")
        else:
            self.manifest = {"format": 1, "pos": 0, "nid": 0, "ids": {}, "ops": {}, "classes": {}, "segments": []}
        self._restore()
        return self.manifest["pos"] - before

    def _publish(self, manifest: dict) -> None:
        tmp = self._file(f".manifest-{uuid.uuid4().hex}")
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(manifest, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, self._file("manifest.json"))
        self.manifest = manifest

    def commit(self, records: list[dict]) -> int:
        """Append records as one segment; returns the position of the last."""
        if self._lock is None:
            raise StoreProblem("the store is open for reading only")
        m = json.loads(json.dumps(self.manifest))
        for r in records:
            m["pos"] += 1
            r["pos"] = m["pos"]
            m["ops"][r["op"]] = m["ops"].get(r["op"], 0) + 1
            if r["op"] == "node":
                m["classes"][r["cls"]] = m["classes"].get(r["cls"], 0) + 1
        name = f"log-{m['pos']:012d}.jsonl"
        tmp = self._file(f".{name}")
        with open(tmp, "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in records)
        os.replace(tmp, self._file(name))
        m["segments"].append(name)
        self._publish(m)
        self._restore()
        if len(m["segments"]) > SNAPSHOT_SEGMENTS:
            self.snapshot()
        return self.manifest["pos"]

    def append(self, records: DataFrame, counts: dict[str, int], classes: dict[str, int], positions: int) -> int:
        """Append a DataFrame of records (schema RECORD) as one Parquet segment; its positions are taken already."""
        if self._lock is None:
            raise StoreProblem("the store is open for reading only")
        m = json.loads(json.dumps(self.manifest))
        name = f"bulk-{m['pos'] + positions:012d}-{uuid.uuid4().hex[:8]}.parquet"
        records.write.parquet("file://" + self._file(name))
        m["pos"] += positions
        for k, n in counts.items():
            m["ops"][k] = m["ops"].get(k, 0) + n
        for k, n in classes.items():
            m["classes"][k] = m["classes"].get(k, 0) + n
        m["segments"].append(name)
        self._publish(m)
        return m["pos"]

    def reserve(self, cls: str, n: int = 1) -> tuple[int, int]:
        """The first of n new node ids, and of n new numbers for shown ids; used up with the next commit."""
        nid, number = self.manifest["nid"] + 1, self.manifest["ids"].get(cls[0], 0) + 1
        self.manifest["nid"] += n
        self.manifest["ids"][cls[0]] = number + n - 1
        return nid, number

    def snapshot(self) -> None:
        """Rewrite the log as one Parquet segment sorted for pruning; segments it replaces go."""
        name = f"snap-{self.manifest['pos']:012d}.parquet"
        self.records().repartition("op", "cls", "type").sortWithinPartitions("op", "cls", "type", "nid").write.mode("overwrite").parquet("file://" + self._file(name))
        old = self.manifest["segments"]
        self._publish({**self.manifest, "segments": [name]})
        snaps = sorted(s for s in [*old, *(x for x in os.listdir(self.path) if x.startswith("snap-"))] if s.startswith("snap-") and s != name)
        for s in set(old) - set(snaps) | set(snaps[: -(KEEP_SNAPSHOTS - 1)]):
            full = self._file(s)
            shutil.rmtree(full) if os.path.isdir(full) else os.remove(full)

    def _restore(self) -> None:
        """The catalog: what was declared, and what lineage records have derived and deprecated since."""
        self.catalog = self._declared.copy()
        if not self.manifest["ops"].get("lineage"):
            return
        for r in self.records().where("op = 'lineage' and kind in ('derive_class', 'derive_edge', 'deprecate_class')").select("kind", "payload").orderBy("pos").collect():
            p = json.loads(r.payload)
            if r.kind == "derive_class" and p["name"] not in self.catalog.classes:
                self.catalog.add_class(p["name"], p["props"], p["base"], status="provisional", quota=p["quota"], dedup=p["dedup"])
            elif r.kind == "derive_edge" and p["name"] not in self.catalog.edges:
                self.catalog.add_edge(p["name"], p["roles"], p.get("props"))
            elif r.kind == "deprecate_class" and p["name"] in self.catalog.classes:
                self.catalog.classes[p["name"]].status = "deprecated"

    # records as DataFrames

    def records(self) -> DataFrame:
        logs = [self._file(s) for s in self.manifest["segments"] if s.endswith(".jsonl")]
        out = self.spark.read.schema(RECORD).option("mode", "FAILFAST").json(["file://" + x for x in logs]) if logs else self.spark.createDataFrame([], RECORD)
        for s in self.manifest["segments"]:
            if s.endswith(".parquet"):
                out = out.union(self.spark.read.schema(RECORD).parquet("file://" + self._file(s)))
        return out

    def _has(self, op: str) -> bool:
        return self.manifest["ops"].get(op, 0) > 0

    def gone(self) -> DataFrame:
        """nid of nodes that are retired or merged into another."""
        return self.records().where("op in ('retire', 'alias')").select("nid").distinct()

    def properties(self) -> DataFrame:
        """(nid, props) of every node: of each property the value with the last position."""
        made = self.records().where("op = 'node'").select("nid", "props")
        if not self._has("patch"):
            return made
        changed = self.records().where("op = 'patch'").select("nid").distinct()
        entries = self.records().where("op in ('node', 'patch')").join(changed, "nid", "left_semi").select("nid", "pos", F.explode("props").alias("k", "v"))
        latest = entries.groupBy("nid", "k").agg(F.max_by("v", "pos").alias("v")).groupBy("nid").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props"))
        return made.join(changed, "nid", "left_anti").unionByName(latest)

    def nodes(self, cls: str) -> DataFrame | None:
        """The compiler's view: live nodes of exactly this class."""
        if not self.manifest["classes"].get(cls):
            return None
        made = self.records().where((F.col("op") == "node") & (F.col("cls") == cls)).select("nid", "id", "cls", "state", "origin", "props")
        if self._has("retire") or self._has("alias"):
            made = made.join(self.gone(), "nid", "left_anti")
        if self._has("patch"):
            made = made.drop("props").join(self.properties(), "nid")
        if self._has("state"):
            last = self.records().where("op = 'state'").groupBy("nid").agg(F.max_by("state", "pos").alias("__s"))
            made = made.join(last, "nid", "left").withColumn("state", F.coalesce("__s", "state")).drop("__s")
        props = []
        for p, t in self.catalog.props(cls).items():
            v = F.col("props")[p]
            if self.catalog.is_multi(cls, p):
                props.append(F.from_json(v, f"array<{SPARK_TYPES[t]}>").alias(p))
            else:
                props.append(v.try_cast(SPARK_TYPES[t]).alias(p))
        lineage = F.when(F.col("origin").isNotNull(), F.concat(F.lit("from node "), F.col("origin").cast("string"))).otherwise("")
        traffic, walks = self.traffic(), F.lit(0).cast("long")
        if traffic is not None:
            made, walks = made.join(traffic.select("nid", "walks"), "nid", "left"), F.coalesce("walks", F.lit(0).cast("long"))
        return made.select("nid", "id", F.col("cls").alias("class"), "state", walks.alias("query_traffic"), lineage.alias("lineage"), *props)

    def touch(self, walked: list[DataFrame]) -> None:
        """Count nodes that statements walked through: (nid, state) of each statement, distinct."""
        rows = [w.where("nid is not null").distinct().select("nid", (F.col("state") == "blob").cast("long").alias("blob")) for w in walked]
        if rows:
            functools.reduce(DataFrame.union, rows).groupBy("nid").agg(F.count("*").alias("walks"), F.sum("blob").alias("blobs")).write.mode("append").parquet("file://" + self._file("telemetry"))

    def traffic(self) -> DataFrame | None:
        """(nid, walks, blobs) as counted so far, or None."""
        path = self._file("telemetry")
        if not os.path.isdir(path) or not any(x.endswith(".parquet") for x in os.listdir(path)):
            return None
        each = self.spark.read.schema("nid long, walks long, blobs long").parquet("file://" + path)
        return each.groupBy("nid").agg(F.sum("walks").alias("walks"), F.sum("blobs").alias("blobs"))

    def aliases(self) -> DataFrame:
        """(nid, to): merged nodes and the one they are now; kept free of chains by the writer."""
        return self.records().where("op = 'alias'").groupBy("nid").agg(F.max_by("b", "pos").alias("to"))

    def edges(self, name: str) -> DataFrame:
        e = self.catalog.edges[name]
        a, b = e.roles
        df = self.records().where((F.col("op") == "edge") & (F.col("type") == name)).select("eid", F.col("a").alias(a), F.col("b").alias(b), "props")
        if self._has("retire_edge"):
            df = df.join(self.records().where("op = 'retire_edge'").select("eid"), "eid", "left_anti")
        if self._has("retire") or self._has("alias"):
            for role in (a, b):
                df = df.join(self.gone().withColumnRenamed("nid", "__gone"), F.col(role) == F.col("__gone"), "left_anti")
        return df.select("eid", a, b, *(F.col("props")[p].try_cast(SPARK_TYPES[t]).alias(p) for p, t in e.props.items()))

    def populated(self) -> set[str]:
        return {c for c, n in self.manifest["classes"].items() if n}

    def position(self) -> int:
        return self.manifest["pos"]

    def health(self) -> DataFrame:
        from rolegraph.operators.health import health

        return health(self)

    def signals(self) -> DataFrame:
        r = self.records().where("op in ('node', 'patch', 'flag')").select("nid", "op", "pos", "conflicts", F.lit(0).cast("long").alias("blobs"))
        traffic = self.traffic()
        if traffic is not None:
            r = r.unionByName(traffic.select("nid", "blobs").where("blobs > 0"), allowMissingColumns=True)
        return r.groupBy("nid").agg(
            F.sum(F.when(F.col("op") == "patch", F.coalesce("conflicts", F.lit(0))).otherwise(0)).alias("conflicts"),
            F.count(F.when(F.col("op") == "flag", 1)).alias("flags"),
            F.sum("blobs").alias("traversals"),
            F.max(F.when(F.col("op") != "flag", F.col("pos"))).alias("last_confirmed"),
        )

    def candidates(self) -> DataFrame:
        """Pairs of the ledger that are neither merged nor declared distinct."""
        names = self.records().where("op = 'node'").select("nid", "id")
        r = self.records().where("op = 'dup'").groupBy("a", "b").agg(F.max_by("cls", "pos").alias("class"), F.max_by("score", "pos").alias("score"), F.max_by("evidence", "pos").alias("evidence"))
        for side in ("a", "b"):
            r = r.join(self.gone().withColumnRenamed("nid", "__gone"), F.col(side) == F.col("__gone"), "left_anti")
        r = r.join(self.records().where("op = 'distinct'").select("a", "b"), ["a", "b"], "left_anti")
        r = r.join(names.select(F.col("nid").alias("a"), F.col("id").alias("ia")), "a").join(names.select(F.col("nid").alias("b"), F.col("id").alias("ib")), "b")
        return r.select("class", "score", F.col("ia").alias("a"), F.col("ib").alias("b"), "evidence")
