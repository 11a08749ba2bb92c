"""Aggregates over per-file counts.

``groupBy`` on six keys: every task folds its own rows to at most six before the
shuffle, so a language that holds most of the files costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOTAL = "Total"


def language_totals(counts: DataFrame) -> DataFrame:
    """Rows ``(language, file_count, function_count, class_struct_count)``."""
    return counts.groupBy("language").agg(
        F.count("*").alias("file_count"),
        F.sum("function_count").alias("function_count"),
        F.sum("class_struct_count").alias("class_struct_count"),
    )


def grand_totals(by_language: DataFrame) -> DataFrame:
    """One row of totals over ``language_totals``; zeros, not NULLs, without files."""
    return by_language.agg(
        *(
            F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
            for c in ("file_count", "function_count", "class_struct_count")
        )
    )


def with_total(by_language: DataFrame) -> DataFrame:
    """Language rows plus a total row, also on empty input."""
    total = grand_totals(by_language).withColumn("language", F.lit(TOTAL))
    return by_language.unionByName(total)


def counts_of_declarations(declarations: DataFrame) -> DataFrame:
    """Per-file counts from declaration rows; a cross-check of the row-local counts."""
    return declarations.groupBy("path", "language").agg(
        F.count_if(F.col("category") == "function").alias("function_count"),
        F.count_if(F.col("category") == "class_struct").alias("class_struct_count"),
    )
