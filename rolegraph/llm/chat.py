"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; neighbours of one role become one block.
The text of a conversation is its blocks one after another:

    <s>role[INST]text[/INST][INST]text[/INST]</s>

Texts and roles are escaped so that none of the four control strings occurs in them: a backslash
becomes two, and each control string gets a backslash after its first character.  The loss mask is
the list of (start, length) spans, in code points, of the assistant's escaped texts.

Defined cases: a null text or role counts as empty; rows with the same turn are ordered by role and
then text; a null turn comes first; repeated rows are turns of their own; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._spark import with_running

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, length>>): one row per conversation."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    differs = lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])
    sorted_turns = sorted_turns.withColumn("escaped", F.transform("turns", lambda t: escape(t["text"])))
    # heads: where a block begins; a block is a role and its escaped texts
    heads = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), differs)
    block = lambda k: F.struct(
        F.get("turns", F.get("heads", k))["role"].alias("role"),
        F.slice("escaped", F.get("heads", k) + 1, F.coalesce(F.get("heads", k + 1), F.size("turns")) - F.get("heads", k)).alias("texts"),
    )
    merged = sorted_turns.withColumn("heads", heads).withColumn("blocks", F.transform(F.sequence(F.lit(0), F.size("heads") - 1), block))
    joined = F.transform("blocks", lambda b: F.concat(F.lit("<s>"), escape(b["role"]), F.concat_ws("", F.transform(b["texts"], lambda t: F.concat(F.lit("[INST]"), t, F.lit("[/INST]")))), F.lit("</s>")))
    # what stands before a turn's [INST] and belongs to it: the end of the block before and the head of its own
    opens = F.transform("turns", lambda t, i: F.when(differs(i), F.when(i > 0, 7).otherwise(3) + F.length(escape(t["role"]))).otherwise(0))
    merged = merged.withColumn("opens", opens).withColumn("lengths", F.zip_with("opens", "escaped", lambda o, e: o + 13 + F.length(e)))
    merged = with_running(merged, "lengths", "before")
    spans = F.transform("turns", lambda t, i: F.struct((F.get("before", i) + F.get("opens", i) + 6).alias("start"), F.length(F.get("escaped", i)).alias("length"), t["role"].alias("role")))
    loss = F.transform(F.filter(spans, lambda s: s["role"] == learn), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return merged.select("conv_id", F.concat_ws("", joined).alias("formatted"), loss.alias("loss"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """From (conv_id, formatted, loss): the turns as array<struct<role, text>> and the text under the loss mask."""
    blocks = F.slice(F.split("formatted", "</s>", -1), F.lit(1), F.size(F.split("formatted", "</s>", -1)) - 1)
    fields = F.transform(blocks, lambda b: F.split(F.substring(b, 4, 1 << 30), r"\[INST\]", -1))
    turn = lambda f: F.transform(F.slice(f, F.lit(2), F.size(f) - 1), lambda t: F.struct(unescape(F.get(f, F.lit(0))).alias("role"), unescape(F.substring(t, F.lit(1), F.length(t) - 7)).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"])))
    return formatted.select("conv_id", F.flatten(F.transform(fields, turn)).alias("turns"), F.concat_ws("", learned).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
