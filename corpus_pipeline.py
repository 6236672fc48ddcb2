"""A corpus pipeline of five stages: each reads what the one before kept and returns documents, the last one packing.

A stage is (name, function of (spark, docs, sf_dir) → DataFrame); its result is written as Parquet and
read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import decontaminate, jaccard_join, packing, quality_rules, substring_dedup
from orbweave.llm.store import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or are mostly boilerplate lines."""
    return quality_rules.keep(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard_join.first_of_groups(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take word sequences that repeat anywhere in the corpus out of the texts."""
    return substring_dedup.clean(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of a benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    return packing.pack_texts(docs)


STAGES = [("quality rules", rules), ("n-gram jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("benchmark decontamination", leaks), ("packing", batches)]

#: Line labelling and bucket search can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
