"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Toxic documents go; repeated line runs lose their later copies; one document of each
near-duplicate group stays; documents that hold benchmark passages go; what is left is encoded.
The stages before the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import decontaminate, line_dedup, sentencepiece_dropout, simhash, toxicity
from fathomline.llm.common import fresh_path, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the factorization machine, learned from ``labels``, scores under 0.5."""
    machine = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, machine)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints stays; of those, one of each group of texts that are alike word by word, whose fingerprints can differ in more bits."""
    return simhash.representatives(stored(simhash.one_of_each(docs), "fingerprints"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_dropout.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # the learned scores and the segmentation can't be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
