"""The write verbs: each commits one segment and returns a receipt."""

from __future__ import annotations

import csv
import difflib
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.functions.fold import fold, name_key, name_keyed
from rolegraph.lang import tree as T
from rolegraph.operators.duplicates import THRESHOLD, similarity
from rolegraph.sources.bulk import coerce
from rolegraph.store.store import Store, text_of


@dataclass
class Receipt:
    verb: str
    created: list[str] = field(default_factory=list)
    changed: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    position: int = 0

    def __str__(self) -> str:
        parts = [f"{self.verb} @t-{self.position}"]
        if self.created:
            parts.append("created " + ", ".join(self.created))
        if self.changed:
            parts.append("changed " + ", ".join(self.changed))
        return "; ".join(parts) + "".join(f"\n  {n}" for n in self.notes)


def _alike(a: str | None, b: str | None) -> bool:
    """Whether two values as text are one value: equal, or equal numbers."""
    try:
        return a is not None and b is not None and (fold(a) == fold(b) or float(a) == float(b))
    except ValueError:
        return False


class Writer:
    def __init__(self, store: Store, bound: dict[str, tuple[str, list[str]]]):
        self.store, self.bound = store, bound

    def fail(self, stmt: T.Stmt, message: str):
        from rolegraph.session import RunProblem

        return RunProblem(f"line {stmt.line}: {message}")

    def write(self, stmt: T.Stmt) -> Receipt:
        return getattr(self, "_" + type(stmt).__name__)(stmt)

    # lookups

    def node(self, stmt: T.Stmt, ref: str) -> dict:
        """The live node that a name or id stands for."""
        if ref.startswith("#"):
            wanted = ref
        else:
            _, ids = self.bound.get(ref, ("", []))
            if len(ids) != 1:
                raise self.fail(stmt, f"{ref} stands for {len(ids)} nodes; a reference is one node")
            wanted = ids[0]
        rows = self.store.records().where((F.col("op") == "node") & (F.col("id") == wanted)).select("nid", "id", "cls").limit(1).collect()
        if not rows:
            raise self.fail(stmt, f"there is no node {wanted}")
        nid = rows[0].nid
        if self.store._has("alias"):
            to = self.store.aliases().where(F.col("nid") == nid).collect()
            nid = to[0].to if to else nid
        found = self.store.records().where((F.col("op") == "node") & (F.col("nid") == nid)).select("nid", "id", "cls", "pos").first()
        props = self.store.properties().where(F.col("nid") == nid).first()
        state = self.store.records().where((F.col("op") == "state") & (F.col("nid") == nid)).orderBy(F.desc("pos")).limit(1).collect()
        retired = self.store._has("retire") and not self.store.records().where((F.col("op") == "retire") & (F.col("nid") == nid)).isEmpty()
        made = self.store.records().where((F.col("op") == "node") & (F.col("nid") == nid)).select("state").first()
        return {"nid": nid, "id": found.id, "cls": found.cls, "pos": found.pos, "props": dict(props.props or {}) if props else {}, "state": state[0].state if state else made.state, "retired": retired}

    def live(self, stmt: T.Stmt, ref: str) -> dict:
        n = self.node(stmt, ref)
        if n["retired"]:
            raise self.fail(stmt, f"{n['id']} is retired")
        return n

    def _bind(self, name: str, cls: str, ids: list[str]) -> None:
        self.bound[name] = (cls, ids)

    def _quota(self, stmt: T.Stmt, cls: str, more: int = 1) -> str | None:
        c = self.store.catalog.classes[cls]
        if c.quota is None:
            return None
        used = self.store.manifest["classes"].get(cls, 0)
        if used + more > c.quota:
            raise self.fail(stmt, f"the class {cls} has a quota of {c.quota} nodes, retired ones included, and holds {used}")
        return f"quota {used + more} of {c.quota}"

    # nodes and edges

    def _payload(self, stmt: T.Stmt, key: str) -> list[dict[str, str]]:
        """Rows of an attachment: a CSV file in the store's folder of attachments."""
        top = os.path.realpath(os.path.join(self.store.path, "attachments"))
        name = os.path.realpath(os.path.join(top, f"{key}.csv"))
        if not name.startswith(top + os.sep) or not os.path.exists(name):
            raise self.fail(stmt, f"there is no attachment {key}")
        with open(name, encoding="utf-8-sig", newline="") as f:
            return list(csv.DictReader(f))

    def _similar(self, cls: str, nid: int, name: str | None, given: dict[str, str] | None = None) -> tuple[list[dict], list[str]]:
        """Candidates for a new node's duplicates in its block, as records and notes."""
        key = name_key(name or "")
        df = self.store.nodes(cls)
        if not key or df is None or "name" not in df.columns:
            return [], []
        least = self.store.catalog.classes[cls].dedup or THRESHOLD
        size = F.length("key")
        props = [p for p in self.store.catalog.props(cls) if p in df.columns and p != "name" and not self.store.catalog.is_multi(cls, p)]
        held = F.to_json(F.struct(*(F.col(p).cast("string").alias(p) for p in props))) if props else F.lit("{}")
        near = df.where(F.col("nid") != nid).select("nid", "id", "name", name_keyed(F.col("name")).alias("key"), held.alias("held")).where(F.substring("key", 1, 4) == key[:4])
        near = near.where((2.0 * F.least(size, F.lit(len(key))) / (size + len(key)) >= least) | F.startswith(F.col("key"), F.lit(key)) | F.startswith(F.lit(key), F.col("key")))
        if self.store._has("distinct"):
            apart = self.store.records().where("op = 'distinct'").where((F.col("a") == nid) | (F.col("b") == nid)).select(F.when(F.col("a") == nid, F.col("b")).otherwise(F.col("a")).alias("nid"))
            near = near.join(apart, "nid", "left_anti")
        out, notes = [], []
        given = given or {}
        for r in near.toLocalIterator():
            score = similarity(key, r.key)
            if score >= least:
                a, b = sorted((nid, r.nid))
                both = [f"{p} {v}" for p, v in json.loads(r.held).items() if p in given and _alike(given[p], v)]
                out.append({"op": "dup", "a": a, "b": b, "cls": cls, "score": score, "evidence": f"names {key} and {r.key}" + (f"; both have {', '.join(both)}" if both else "")})
                notes.append(f"may repeat {r.id} ({score:.2f}): merge or declare distinct")
        return out, notes

    def _AssertNode(self, s: T.AssertNode) -> Receipt:
        guard = self._quota(s, s.cls)
        nid, number = self.store.reserve(s.cls)
        node_id = f"#{s.cls[0]}-{number}"
        props = {k: v for k, v in s.props if v is not T.ABSENT}
        rows = next((self._payload(s, v.removeprefix("attach:")) for v in props.values() if isinstance(v, str) and v.startswith("attach:")), None)
        records = [{"op": "node", "nid": nid, "id": node_id, "cls": s.cls, "props": {k: text_of(v) for k, v in props.items()}, "state": "blob" if rows is not None else "atom", "source": s.source}]
        if rows is not None:
            records.append({"op": "rows", "nid": nid, "payload": json.dumps(rows, ensure_ascii=False)})
        more, notes = self._similar(s.cls, nid, props.get("name"), {k: text_of(v) for k, v in props.items()})
        position = self.store.commit(records + more)
        self._bind(s.name, s.cls, [node_id])
        return Receipt("assert", [node_id], [], ([guard] if guard else []) + notes, position)

    def _AssertEdge(self, s: T.AssertEdge) -> Receipt:
        edge = self.store.catalog.edges[s.edge]
        ends = {role: self.live(s, ref) for role, ref in s.roles}
        for role, n in ends.items():
            if not self.store.catalog.is_a(n["cls"], edge.roles[role]):
                raise self.fail(s, f"{role} of {s.edge} is a {edge.roles[role]}, and {n['id']} is a {n['cls']}")
        a, b = (ends[r]["nid"] for r in edge.roles)
        position = self.store.commit([{"op": "edge", "eid": self.store.position() + 1, "type": s.edge, "a": a, "b": b, "props": {}, "source": s.source}])
        return Receipt("assert edge", [f"{s.edge}({', '.join(f'{r}: {n['id']}' for r, n in ends.items())})"], position=position)

    def _Merge(self, s: T.Merge) -> Receipt:
        x, y = self.live(s, s.a), self.live(s, s.b)
        if x["nid"] == y["nid"]:
            raise self.fail(s, f"{s.a} and {s.b} are one node already")
        if x["cls"] != y["cls"]:
            raise self.fail(s, f"{x['id']} is a {x['cls']} and {y['id']} a {y['cls']}; only nodes of one class merge")
        old, new = sorted((x, y), key=lambda n: n["pos"])
        winner = new
        if s.prefer != "newest":
            sources = {r.nid: r.source for r in self.store.records().where(F.col("op") == "node").where(F.col("nid").isin(old["nid"], new["nid"])).select("nid", "source").collect()}
            winner = next((n for n in (old, new) if sources[n["nid"]] == s.prefer), new)
        loser = new if winner is old else old
        merged = {**loser["props"], **winner["props"]}
        differ = sorted(k for k in old["props"].keys() & new["props"].keys() if old["props"][k] != new["props"][k])
        records = [
            {"op": "lineage", "kind": "merge", "payload": json.dumps({"survivor": old["id"], "absorbed": new["id"], "before": [old["props"], new["props"]]}, ensure_ascii=False)},
            {"op": "patch", "nid": old["nid"], "props": merged, "conflicts": len(differ)},
            {"op": "alias", "nid": new["nid"], "b": old["nid"]},
        ]
        if self.store._has("alias"):  # who was merged into the absorbed node is now the survivor too
            records += [{"op": "alias", "nid": r.nid, "b": old["nid"]} for r in self.store.aliases().where(F.col("to") == new["nid"]).collect()]
        moved = 0
        for e in self.store.catalog.edges.values():
            a, b = e.roles
            touched = self.store.edges(e.name).where((F.col(a) == new["nid"]) | (F.col(b) == new["nid"]))
            for r in touched.toLocalIterator():
                d = r.asDict()
                swap = lambda n: old["nid"] if n == new["nid"] else n
                records += [{"op": "retire_edge", "eid": d["eid"]}, {"op": "edge", "eid": self.store.position() + len(records) + 2, "type": e.name, "a": swap(d[a]), "b": swap(d[b]), "props": {p: text_of(d[p]) for p in e.props if d[p] is not None}}]
                moved += 1
        position = self.store.commit(records)
        return Receipt("merge", [], [old["id"], new["id"]], [f"{old['id']} survives; {moved} edges moved"] + ([f"conflicts: {', '.join(differ)}"] if differ else []), position)

    def _Distinct(self, s: T.Distinct) -> Receipt:
        x, y = self.node(s, s.a), self.node(s, s.b)
        if x["nid"] == y["nid"]:
            raise self.fail(s, f"{s.a} and {s.b} are one node")
        a, b = sorted((x["nid"], y["nid"]))
        return Receipt("distinct", [], [x["id"], y["id"]], position=self.store.commit([{"op": "distinct", "a": a, "b": b, "reason": s.reason}]))

    def _Refine(self, s: T.Refine) -> Receipt:
        parent = self.live(s, s.ref)
        held = self.store.records().where((F.col("op") == "rows") & (F.col("nid") == parent["nid"])).select("payload").first()
        if held is None:
            raise self.fail(s, f"{parent['id']} holds no table to refine")
        rows = json.loads(held.payload)
        for _, column in s.mapping:
            if rows and column not in rows[0]:
                raise self.fail(s, f"the table of {parent['id']} has no column {column}; it has {', '.join(rows[0])}")
        guard = self._quota(s, s.cls, len(rows))
        kinds = self.store.catalog.props(s.cls)
        nid, number = self.store.reserve(s.cls, len(rows))
        ids, records, notes = [], [], []
        for i, row in enumerate(rows):
            try:
                props = {p: coerce(row[c], kinds[p]) for p, c in s.mapping}
            except ValueError as e:
                raise self.fail(s, f"row {i + 1}: {e}") from e
            ids.append(f"#{s.cls[0]}-{number + i}")
            records.append({"op": "node", "nid": nid + i, "id": ids[-1], "cls": s.cls, "props": {k: text_of(v) for k, v in props.items() if v is not None}, "state": "atom", "origin": parent["nid"]})
        records += [{"op": "lineage", "kind": "refine", "payload": json.dumps({"from": parent["id"], "into": ids})}, {"op": "state", "nid": parent["nid"], "state": "composite"}]
        position = self.store.commit(records)
        self._bind(s.name, s.cls, ids)
        return Receipt("refine", ids, [parent["id"]], ([guard] if guard else []) + notes, position)

    def _Compact(self, s: T.Compact) -> Receipt:
        cls, ids = self.bound.get(s.source, ("", []))
        if not ids:
            raise self.fail(s, f"{s.source} stands for no node")
        wanted = self.store.spark.createDataFrame([(i,) for i in ids], "id string")
        members = self.store.records().where(F.col("op") == "node").join(wanted, "id", "left_semi").select("nid", "cls").collect()
        if len({m.cls for m in members}) > 1:
            raise self.fail(s, "compact takes nodes of one class")
        cls = members[0].cls
        guard = self._quota(s, cls)
        nid, number = self.store.reserve(cls)
        node_id = f"#{cls[0]}-{number}"
        records = [{"op": "node", "nid": nid, "id": node_id, "cls": cls, "props": {k: text_of(v) for k, v in s.props if v is not T.ABSENT}, "state": "composite"}]
        records += [{"op": "lineage", "kind": "compact", "payload": json.dumps({"into": node_id, "from": ids})}]
        records += [{"op": "retire", "nid": m.nid, "reason": f"compacted into {node_id}"} for m in members]
        position = self.store.commit(records)
        self._bind(s.name, cls, [node_id])
        return Receipt("compact", [node_id], ids, [guard] if guard else [], position)

    def _Retire(self, s: T.Retire) -> Receipt:
        n = self.live(s, s.ref)
        return Receipt("retire", [], [n["id"]], position=self.store.commit([{"op": "retire", "nid": n["nid"], "reason": s.reason}]))

    def _Flag(self, s: T.Flag) -> Receipt:
        n = self.node(s, s.ref)
        return Receipt("flag", [], [n["id"]], position=self.store.commit([{"op": "flag", "nid": n["nid"], "reason": s.reason}]))

    # schema

    def _DeriveClass(self, s: T.DeriveClass) -> Receipt:
        near = [c for c in self.store.catalog.classes if difflib.SequenceMatcher(None, c, s.name).ratio() >= 0.7]
        payload = {"name": s.name, "base": s.base, "props": dict(s.props), "quota": s.quota or 500, "dedup": s.dedup}
        position = self.store.commit([{"op": "lineage", "kind": "derive_class", "payload": json.dumps(payload)}])
        return Receipt("derive class", [s.name], [], [f"similar classes: {', '.join(near)}"] if near else [], position)

    def _DeriveEdge(self, s: T.DeriveEdge) -> Receipt:
        position = self.store.commit([{"op": "lineage", "kind": "derive_edge", "payload": json.dumps({"name": s.name, "roles": dict(s.roles)})}])
        return Receipt("derive edge", [s.name], position=position)


def deprecate_class(store: Store, name: str) -> int:
    """New nodes of the class are refused from now on; those there can be read."""
    if name not in store.catalog.classes:
        raise ValueError(f"there is no class {name}")
    return store.commit([{"op": "lineage", "kind": "deprecate_class", "payload": json.dumps({"name": name})}])


def sweep(store: Store, classes: list[str] | None = None) -> int:
    """Search all names of the classes for duplicates and enter new pairs in the ledger; returns how many."""
    from rolegraph.operators.duplicates import sweep as search

    found = search(store, classes)
    names = store.records().where("op = 'node'").select("nid", "id")
    pairs = found.join(names.select(F.col("nid").alias("x"), F.col("id").alias("a")), "a").join(names.select(F.col("nid").alias("y"), F.col("id").alias("b")), "b")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("class").alias("cls"), "score", "evidence").distinct()
    for op in ("dup", "distinct"):
        if store._has(op):
            pairs = pairs.join(store.records().where(F.col("op") == op).select("a", "b"), ["a", "b"], "left_anti")
    return _ledger(store, pairs)


def _ledger(store: Store, pairs: DataFrame) -> int:
    from rolegraph.operators.scratch import stored
    from rolegraph.store.store import RECORD

    pairs = stored(pairs, "pairs")
    n = pairs.count()
    if n:
        columns = [c.strip().split(" ") for c in RECORD.split(", ")]
        fixed = {"pos": F.lit(store.position() + 1).cast("long"), "op": F.lit("dup")}
        rows = pairs.select(*[(fixed[c] if c in fixed else F.col(c) if c in pairs.columns else F.lit(None)).cast(t).alias(c) for c, t in columns])
        store.append(rows, {"dup": n}, {}, 1)
    return n


__all__ = ["Receipt", "Writer", "deprecate_class", "fold", "sweep"]
