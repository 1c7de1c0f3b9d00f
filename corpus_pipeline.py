"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, mixing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is written as Parquet and read again as the next stage's
documents. All stages but the last return the columns of ``documents``; the last adds the mix's columns and keeps the
documents of which the mix takes at least one copy.

Defined cases, for every stage: null ids and sources stay what they are; a null or empty text has no words; texts of any length
are read whole; columns beyond those of ``documents``, whatever their names, are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillmark.llm import decontaminate, mixing, pii, quality_rules, simhash
from rillmark.scratch import materialize


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy keeps. A document without ten words goes; repeated rows are judged one by one."""
    return quality_rules.keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, of equal ids the one with the least text hash, of
    repeated rows one. Documents without words are copies of each other."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. A document without words stays; repeated rows share a fate."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and ``n_chars`` counted anew. A null text stays null; repeated rows stay equal."""
    return pii.mask(docs, pii.fit(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once each, with ``size, source_size, target, copies, taken`` in place of any such columns.
    A document without words isn't taken; repeated rows become one with the sum of their copies."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: SimHash components, belief propagation and dependent rounding can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
