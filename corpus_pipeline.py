"""Corpus pipeline: toxic texts, copies, near copies and contaminated texts go, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a
DataFrame that `run` writes as Parquet and reads again for the next stage. All stages but the
last return the columns of `documents` as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paideon.llm import bestfit, decontaminate, exact_dedup, hyperminhash, toxicity
from paideon.llm.queries import table, vocabulary
from paideon.session import stage, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under one half; it learns from labelled rows of `docs`."""
    tune(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    tune(spark)
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked at a Jaccard similarity of 0.8 over five-word shingles."""
    tune(spark)
    return hyperminhash.first_of_groups(docs, 5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is benchmark text."""
    tune(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, placed in sequences."""
    tune(spark)
    return bestfit.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Learned scores and packing have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
