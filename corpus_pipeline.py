"""A corpus pipeline over the table `documents`: toxic documents go, repeated lines go,
one document of each group of near-duplicates stays, documents that hold benchmark
passages go, and the sources are mixed to their target weights.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
All but the last return the columns of `documents`; the last returns a row for every
repetition that the mix takes of a document, the last of them cut to the words taken, and
adds copy, size, source_size, target and taken (words of the row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontaminate, line_dedup, minhash_dedup, mixing, toxicity
from waymark.llm.common import store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train_outside(docs, _table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, mixing.mix(docs))


STAGES = [
    ("toxicity", _toxicity),
    ("line_dedup", _line_dedup),
    ("near_dedup", _near_dedup),
    ("decontamination", _decontaminate),
    ("mixing", _mixing),
]

#: SQL cannot express the first three stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each result written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
