"""Corpus preparation from end to end: each stage works on what the one before kept.

Defined results: every stage takes any table with the columns of ``documents`` and any
others, which it carries along; nulls, empty texts, ties and empty tables have the results
that the stage's operator defines.  All stages but the last return the columns they got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from declcensus.llm import decontamination, exact_dedup, language_id, near_dedup, queries
from declcensus.operators.ordering import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def recognise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that no learned language explains."""
    return language_id.recognised(docs, language_id.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the one with the smallest id stays."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that hold an item of ``benchmark``."""
    return decontamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample at the target weights; adds ``probability``."""
    return queries.mixed(docs).filter("sampled").select("row.*", "probability")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", recognise),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: Sketches, alignments and edit searches have no SQL form; tests/llm has brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
