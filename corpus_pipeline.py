"""The corpus pipeline: five stages over ``documents``, each by one of the training-data operators.

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each class of near copies the row with the least doc_id stays.
3. decontamination: documents with a word inside a benchmark window go.
4. mixing: each document is repeated as often as the mix takes it, and goes if it is not taken.
5. sharding: doc_id, size, text_crc32, law, shard, slot and grown_shard of what is left.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of docs. Nulls, empty texts, repeated rows and empty tables have the operators' defined results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sceneloom.llm import common, decontamination, mixing, near_join, quality, sharding


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, common.table(spark, sf_dir, "labels"), common.table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier is trained and the join's classes are a fixpoint: SQL can't express them; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; between two of them the rows are a Parquet table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
