"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.llm import chat as _chat
from rolegraph.llm import decontaminate as _decontaminate
from rolegraph.llm import exact_dedup as _dedup
from rolegraph.llm import hmm as _hmm
from rolegraph.llm import jaccard as _jaccard
from rolegraph.llm import langid as _langid
from rolegraph.llm import packing as _packing
from rolegraph.llm import secrets as _secrets
from rolegraph.llm import token_files as _tokens
from rolegraph.llm import toxicity as _toxicity

#: Folder of the public tokenizers' files; None: the installed package that ships them.
TOKENIZERS: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZERS is not None:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup.exact_dedup(_read(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def fold(key: str, of: int) -> Column:
    """The row's fold: CRC-32 of the key as text, modulo `of`."""
    return F.crc32(F.col(key).cast("string")) % of


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), learn=fold("doc_id", 5) != 0)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _hmm.score_lm(_read(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return scored.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = _langid.predict_lang(docs, _langid.fit_langid(docs, fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def secret_report(docs: DataFrame) -> DataFrame:
    found = _secrets.find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"] < _secrets.BASE)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{_secrets.KINDS[k][0]}") for k in range(_secrets.BASE)]
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select("doc_id", *counts, F.sha2(_secrets.joined(base), 256).alias("base_sha256"), _secrets.joined(F.col("spans")).alias("spans"), live)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_read(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens.token_round_trip(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text"))
    extra = extra.select(*(F.col(f.name).cast(f.dataType) for f in turns.schema))
    back = _chat.read_chat(_chat.format_chat(turns.unionByName(extra)))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS et,
    replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS er
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(et) + 13 + CASE WHEN before IS DISTINCT FROM role THEN 7 + length(er) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_hmm, op4_packing, op5_jaccard, op6_langid, op7_decontaminate, op8_secrets, op9_token_files, op10_chat)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op10_chat": OP10_SQL}
