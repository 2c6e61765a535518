"""From raw documents to a training mix: five stages, each a written table that the next one reads.

A stage takes all its predecessor kept and returns the columns of ``documents``; the last adds ``copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelight.llm import jaccard, leaks, lines, mixing, quality
from tidelight.session import cut


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, or nearly, go; so do documents of which nothing is left."""
    return lines.shortened(docs)


def _groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with nearly the same word runs the one of smallest id stays."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other numbers and names, go."""
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with the number of their copies."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", _quality),
    ("line dedup", _lines),
    ("n-gram Jaccard join", _groups),
    ("benchmark decontamination", _benchmark),
    ("mixing sources to target weights", _mix),
]

#: A factorisation machine is no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
