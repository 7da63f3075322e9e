"""A corpus made ready for training: documents in, packed windows out.

Stages run one after another; each writes its rows as a Parquet table in the shared folder, and the next one reads
them back, so a lost executor costs no finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import crf_pii, hamming_trees, level_packing, pigeonhole, toxicity_chain
from tablescope.llm.shared import import_path, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    import_path(spark)
    chain = toxicity_chain.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_chain.without_toxic(docs, chain)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints (three-word shingles, two bits) stays, the smallest id."""
    import_path(spark)
    return hamming_trees.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return pigeonhole.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, their personal data replaced by its kind."""
    return crf_pii.masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their windows."""
    return level_packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fitted models, trees and packing have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
