"""A cleaning pipeline over `documents`: each stage calls one operator of rolegraph.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents, whatever others
docs has besides.

Defined cases, for every stage: a null text counts as empty; an empty text is never toxic by its own
words (it has the share of toxic labels as its score), equals other empty texts, has no near copy and
holds no benchmark item; a filtering stage decides each row by its text, so rows that share a doc_id, null
among them, have a fate each; of ties the stage's own rule keeps one (exact copies: the largest
doc_id, near copies: the smallest, and all rows that carry it); very long texts are read whole; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolegraph.llm._spark import written_alone
from rolegraph.llm.decontaminate import drop_contaminated
from rolegraph.llm.exact_dedup import drop_exact_duplicates
from rolegraph.llm.jaccard import drop_near_duplicates
from rolegraph.llm.packing import pack
from rolegraph.llm.queries import fold, tokenizer_path
from rolegraph.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose score is 0.5 or more."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=fold("doc_id", 5) != 0)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the one with the smallest doc_id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Nearest neighbours, component search, spaced seeds and packing aren't expressible in SQL; tests/llm/test_pipeline.py checks the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
