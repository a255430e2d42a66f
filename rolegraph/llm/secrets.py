"""Secrets in texts and who owns them, with Spark expressions only.

Candidates are found by pattern: assignments of passwords and keys, access key ids, hex strings, and
opaque tokens (whole runs of 20 or more signs of keys with a letter and a digit among them).  Every
candidate's value is hashed and the hashes are counted over the whole corpus: in how many distinct
repositories and with how many distinct owners they occur.  A value that WIDESPREAD or more owners
hold is copied, an example from a manual or a placeholder; one with fewer owners looks live.
Assignments, access keys and hex strings are reported either way and marked; opaque tokens, of which
the pattern alone says little, are reported only where they look live.

Positions are code points, ends exclusive.  Matches of a kind are leftmost and don't overlap: the
text between them is what splitting at the pattern leaves, and lengths add up to positions.

Defined cases: a null or empty text has no span; a null owner or repository counts as one owner or
repository more; repeated rows are reported each; kinds may overlap and are then reported each, by
start and then in the order of KINDS; an empty table gives an empty result; columns other than those
named are never read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._spark import with_running, written

#: Name, pattern, group of the value, least length of the value, what the value must have besides.
KINDS = (
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, ()),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, ()),
    ("hex", r"[0-9a-f]{24,}", 0, 24, ()),
    ("opaque", r"[A-Za-z0-9+/_-]{20,}", 0, 20, ("[0-9]", "[A-Za-z]")),
)
BASE = 3
WIDESPREAD = 3


def with_spans(df: DataFrame, kind: int) -> DataFrame:
    """df with the column k<kind>: the kind's matches of `text` as an array of (start, kind, end, value)."""
    _, pattern, group, least, has = KINDS[kind]
    some = F.col("text").rlike(pattern)  # most texts have none: then nothing else is looked for
    none = F.array().cast("array<string>")
    df = df.withColumn("__whole", F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("__gaps", F.when(F.size("__whole") > 0, F.transform(F.split("text", pattern, -1), lambda g: F.length(g))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("__lengths", F.zip_with("__whole", F.slice("__gaps", F.lit(1), F.size("__whole")), lambda w, g: F.length(w) + g))
    df = with_running(df, "__lengths", "__before")
    value = (lambda w: F.regexp_extract(w, pattern, group)) if group else (lambda w: w)
    span = lambda w, i: F.struct((F.get("__before", i) + F.get("__gaps", i)).alias("start"), F.lit(kind).alias("kind"), (F.get("__before", i) + F.get("__lengths", i)).alias("end"), value(w).alias("value"))
    kept = F.filter(F.transform("__whole", span), lambda s: functools.reduce(lambda a, x: a & s["value"].rlike(x), has, F.length(s["value"]) >= least))
    return df.withColumn(f"k{kind}", kept).drop("__whole", "__gaps", "__lengths", "__before")


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end, digest, repositories, owners, live>>), one row per row of docs."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows
    for k in range(len(KINDS)):
        found = with_spans(found, k)
    spans = F.transform(F.concat(*(F.col(f"k{k}") for k in range(len(KINDS)))), lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("digest")))
    found = written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", spans.alias("spans")), "secret-spans")
    each = found.where("size(spans) > 0").select("row", "repository", "owner", F.explode("spans").alias("s"))
    # a value in many rows meets as one row per repository and task, then per repository, then in one sum
    held = each.select(F.col("s.digest").alias("digest"), F.coalesce("repository", F.lit("\x00")).alias("repository"), F.coalesce("owner", F.lit("\x00")).alias("owner")).distinct()
    repositories = held.select("digest", "repository").distinct().groupBy("digest").agg(F.count("*").alias("repositories"))
    owners = held.select("digest", "owner").distinct().groupBy("digest").agg(F.count("*").alias("owners"))
    counts = repositories.join(owners, "digest")
    judged = each.select("row", "s").join(counts, F.col("s.digest") == F.col("digest"))
    judged = judged.select("row", F.struct("s.start", "s.kind", "s.end", "digest", "repositories", "owners", (F.col("owners") < WIDESPREAD).alias("live")).alias("s"))
    judged = judged.where(f"s.kind < {BASE} or s.live").groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    none = F.array().cast(judged.schema["spans"].dataType)
    return found.select("row", "doc_id").join(judged, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
