"""One pass over the source files: filters, language, counts, errors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declcensus import schemas as S
from declcensus.functions import counting, masking
from declcensus.operators import errors, filters, language


def analyze_files(
    files: DataFrame,
    ignore: Iterable[str] = (),
    max_depth: int = S.ANY_DEPTH,
    follow_links: bool = False,
) -> DataFrame:
    """Rows ``(path, language, function_count, class_struct_count, message)``.

    One narrow row per file that has a language, and per error of the walk;
    ``message`` is set where the file could not be read.  The path filters come
    first, and nothing is shuffled.
    """
    kept = filters.ignore(filters.within_depth(filters.links(files, follow_links), max_depth), ignore)
    found = errors.with_message(language.with_language(kept))
    text = F.when(F.col("message").isNull(), F.col("content").cast("string"))
    masked = found.select(
        "path", "language", "message", masking.mask(text, F.col("language")).alias("masked")
    )
    code = masked.withColumn("code", counting.with_headers(F.col("masked"), F.col("language")))
    return code.select(
        "path",
        "language",
        counting.function_count(F.col("code"), F.col("language")).alias("function_count"),
        counting.class_struct_count(F.col("code"), F.col("language")).alias("class_struct_count"),
        "message",
    )


def file_counts(analyzed: DataFrame) -> DataFrame:
    """The files that went through."""
    return analyzed.filter(F.col("message").isNull()).drop("message")


def file_stats(analyzed: DataFrame) -> DataFrame:
    return file_counts(analyzed).select(
        "path", "language", F.struct("function_count", "class_struct_count").alias("stats")
    )


def file_errors(analyzed: DataFrame) -> DataFrame:
    """Rows ``(path, error_kind, message)`` of the files that did not."""
    return analyzed.filter(F.col("message").isNotNull()).select(
        "path", F.lit(errors.IO_ERROR).alias("error_kind"), "message"
    )
