"""A training corpus from documents: quality rules, near-duplicates, personal data, mixing and packing.

run() writes each stage to the shared folder and reads it again, so a lost executor never costs more than one stage.
The stages aren't SQL; tests/llm/test_pipeline.py checks them against plain computations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import mixing, near_dup, packing, pii, quality_rules
from pixelloom.llm.common import documents, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep: null, empty and short texts go, repeated rows alike. No rows of an empty table."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest doc_id; rows without one only where their group has none. Empty texts are a group."""
    return near_dup.one_of_each(docs, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks for personal data; null texts stay null, repeated rows stay."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without a word never. A null source is a source."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; null texts are the end id alone."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixture), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
