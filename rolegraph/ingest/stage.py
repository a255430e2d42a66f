"""Documents as graph nodes: one document with its chunks, tables and images."""

from __future__ import annotations

import csv
import functools
import hashlib
import io
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.functions.chunk import split
from rolegraph.functions.sniff import sniff
from rolegraph.ingest.normalize import Envelope, UnsupportedKind, normalize
from rolegraph.operators.scratch import stored
from rolegraph.sources.bulk import numbered, records
from rolegraph.store.store import Store, text_of

CHUNKS = "sha256 string, file string, kind string, error string, ord int, page int, offset long, text string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of a folder's or pattern's files."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        rows = []
        for sha, file, content in zip(part["sha256"], part["file"], part["content"]):
            try:
                env = normalize(bytes(content), file)
            except (UnsupportedKind, ValueError) as e:
                rows.append((sha, file, sniff(bytes(content), file), str(e), None, None, None, None))
                continue
            for i, (text, at) in enumerate(split(env.body)):
                rows.append((sha, file, env.kind, None, i, env.page_at(at), at, text))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])
        yield out.astype({"ord": "Int32", "page": "Int32", "offset": "Int64"})


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of distinct files (file, content), in parallel: equal contents are chunked once."""
    distinct = files.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    return distinct.select("sha256", "file", "content").mapInPandas(_chunked, CHUNKS)


def chunk_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, offset, n_chars) of the chunks of every text of a table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(k, i, at, len(t)) for k, body in zip(part[key], part[text]) for i, (t, at) in enumerate(split(body or ""))]
            yield pd.DataFrame(rows, columns=[key, "ord", "offset", "n_chars"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInPandas(run, f"{key} long, ord int, offset long, n_chars long")


def stage(store: Store, data: bytes, filename: str) -> tuple[str, list[str]]:
    """Add a document unless its bytes are there already; returns its id and notes."""
    sha = hashlib.sha256(data).hexdigest()
    docs = store.nodes("document")
    if docs is not None:
        same = docs.where(F.col("sha256") == sha).select("id").limit(1).collect()
        if same:
            return same[0].id, [f"{filename} is {same[0].id} already"]
    env = normalize(data, filename)
    return _staged(store, env, sha, filename)


def _staged(store: Store, env: Envelope, sha: str, filename: str) -> tuple[str, list[str]]:
    nid, number = store.reserve("document")
    doc_id, notes = f"#d-{number}", []
    source = f"doc:{re.sub(r'\s', '_', filename)}"
    pages = env.meta.get("pages") or (len(env.anchors) or None)
    props = {"title": filename, "mime": env.kind, "pages": text_of(pages), "sha256": sha}
    records = [{"op": "node", "nid": nid, "id": doc_id, "cls": "document", "props": {k: v for k, v in props.items() if v is not None}, "state": "composite", "source": source}]

    def piece(cls: str, values: dict, state: str, page: int | None) -> int:
        n, shown = store.reserve(cls)
        records.append({"op": "node", "nid": n, "id": f"#{cls[0]}-{shown}", "cls": cls, "props": {k: text_of(v) for k, v in values.items() if v is not None}, "state": state, "origin": nid, "source": source + (f"#p{page}" if page else "")})
        return n

    members = []
    for i, (text, at) in enumerate(split(env.body)):
        members.append(piece("chunk", {"text": text, "page": env.page_at(at), "ord": i}, "atom", env.page_at(at)))
    for image in env.images:
        members.append(piece("media", {"caption": image.caption, "format": image.format, "page": image.page}, "atom", image.page))
    for t in env.tables:
        key = f"{sha[:8]}-{re.sub(r'[^A-Za-z0-9_-]+', '_', t.name)}"
        os.makedirs(os.path.join(store.path, "attachments"), exist_ok=True)
        text = io.StringIO()
        writer = csv.DictWriter(text, fieldnames=list(t.rows[0]) if t.rows else [])
        writer.writeheader()
        writer.writerows(t.rows)
        with open(os.path.join(store.path, "attachments", f"{key}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text.getvalue())
        n = piece("chunk", {"text": f"attach:{key}"}, "blob", None)
        records.append({"op": "rows", "nid": n, "payload": json.dumps(t.rows, ensure_ascii=False)})
        members.append(n)
        notes.append(f"table {t.name}: attach:{key}, {len(t.rows)} rows")
    at = store.position() + len(records)
    records += [{"op": "edge", "eid": at + i + 1, "type": "part_of", "a": m, "b": nid, "props": {}} for i, m in enumerate(members)]
    store.commit(records)
    return doc_id, notes


def stage_all(store: Store, path: str) -> list[tuple[str, str, list[str]]]:
    """Stage every file of a folder or pattern; (file, document id or empty, notes) for each."""
    out = []
    for r in read_files(store.spark, path).orderBy("file").toLocalIterator():
        try:
            doc, notes = stage(store, bytes(r.content), r.file)
        except UnsupportedKind as e:
            doc, notes = "", [str(e)]
        out.append((r.file, doc, notes))
    return out


PIECES = "sha256 string, file string, what string, kind string, error string, pages int, ord int, page int, text string, format string, payload string"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for every document (or its error), chunk, image and table of the files."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    for part in batches:
        rows = []
        for sha, file, content in zip(part["sha256"], part["file"], part["content"]):
            try:
                env = normalize(bytes(content), file)
            except (UnsupportedKind, ValueError) as e:
                rows.append((sha, file, "document", sniff(bytes(content), file), str(e), *[None] * 6))
                continue
            rows.append((sha, file, "document", env.kind, None, env.meta.get("pages") or len(env.anchors) or None, *[None] * 5))
            for i, (text, at) in enumerate(split(env.body)):
                rows.append((sha, file, "chunk", env.kind, None, None, i, env.page_at(at), text, None, None))
            for image in env.images:
                rows.append((sha, file, "media", env.kind, None, None, None, image.page, image.caption, image.format, None))
            for t in env.tables:
                name = f"attach:{sha[:8]}-{re.sub(r'[^A-Za-z0-9_-]+', '_', t.name)}"
                rows.append((sha, file, "table", env.kind, None, None, None, None, name, None, json.dumps(t.rows, ensure_ascii=False)))
        yield pd.DataFrame(rows, columns=names).astype({"pages": "Int32", "ord": "Int32", "page": "Int32"})


def stage_files(store: Store, files: DataFrame) -> tuple[int, DataFrame]:
    """Add all files (file, content) whose bytes the store lacks, as one segment; the number of new documents, and (file, error) of refused ones.

    Files are read, cut and numbered by tasks; of equal contents the file with the smallest name
    counts.  Tables become blobs whose rows are in the log, so refine works on them; their CSV files
    are only written by stage().
    """
    hashed = files.select("file", "content", F.sha2("content", 256).alias("sha256"))
    names = hashed.groupBy("sha256").agg(F.min("file").alias("file"))
    docs = store.nodes("document")
    if docs is not None:
        names = names.join(docs.select("sha256"), "sha256", "left_anti")
    fresh = hashed.join(names, ["sha256", "file"], "left_semi").dropDuplicates(["sha256"])
    found = stored(fresh.select("sha256", "file", "content").mapInPandas(_pieces, PIECES), "stage")
    refused = found.where("error is not null").select("file", "error")
    made, n = numbered(found.where("what = 'document' and error is null"))
    if not n:
        return 0, refused
    first, number = store.reserve("document", n)
    made = made.select("*", (F.lit(first) + F.col("__i")).alias("doc"))
    parts, classes, members = [], {"document": n}, found.where("what <> 'document'").join(made.select("sha256", "doc"), "sha256")
    for cls, which in (("chunk", "what in ('chunk', 'table')"), ("media", "what = 'media'")):
        own, m = numbered(members.where(which))
        if m:
            nid, shown = store.reserve(cls, m)
            parts.append(own.select("*", (F.lit(nid) + F.col("__i")).alias("nid"), F.concat(F.lit(f"#{cls[0]}-"), (F.lit(shown) + F.col("__i")).cast("string")).alias("id"), F.lit(cls).alias("cls"), (F.lit(sum(classes.values())) + F.col("__i")).alias("at")))
            classes[cls] = m
    at, several = store.position() + 1, sum(classes.values()) - n
    source = F.concat(F.lit("doc:"), F.regexp_replace("file", r"\s", "_"))
    text = lambda **columns: F.map_filter(F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))]), lambda _, v: v.isNotNull())
    out = records(made, {
        "pos": F.lit(at) + F.col("__i"), "op": F.lit("node"), "nid": F.col("doc"), "id": F.concat(F.lit("#d-"), (F.lit(number) + F.col("__i")).cast("string")), "cls": F.lit("document"),
        "props": text(title=F.col("file"), mime=F.col("kind"), pages=F.col("pages"), sha256=F.col("sha256")), "state": F.lit("composite"), "source": source,
    })
    tables = 0
    if parts:
        every = stored(functools.reduce(DataFrame.unionByName, parts), "stage-pieces")
        media = F.col("cls") == "media"
        props = F.when(media, text(caption=F.col("text"), format=F.col("format"), page=F.col("page"))).otherwise(text(text=F.col("text"), page=F.col("page"), ord=F.col("ord")))
        origin = F.concat(source, F.coalesce(F.concat(F.lit("#p"), F.col("page").cast("string")), F.lit("")))
        state = F.when(F.col("what") == "table", "blob").otherwise("atom")
        out = out.union(records(every, {"pos": F.lit(at) + F.col("at"), "op": F.lit("node"), "nid": F.col("nid"), "id": F.col("id"), "cls": F.col("cls"), "props": props, "state": state, "origin": F.col("doc"), "source": origin}))
        edge = F.lit(at + several) + F.col("at")
        out = out.union(records(every, {"pos": edge, "op": F.lit("edge"), "eid": edge, "type": F.lit("part_of"), "a": F.col("nid"), "b": F.col("doc"), "props": F.create_map().cast("map<string,string>")}))
        rows, tables = numbered(every.where("what = 'table'").drop("__i"))
        if tables:
            out = out.union(records(rows, {"pos": F.lit(at + n + 2 * several) + F.col("__i"), "op": F.lit("rows"), "nid": F.col("nid"), "payload": F.col("payload")}))
    counts = {"node": n + several, "edge": several, "rows": tables}
    store.append(out, {k: v for k, v in counts.items() if v}, classes, n + 2 * several + tables)
    return n, refused
