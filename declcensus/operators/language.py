"""Language operators: by extension, by content, and the two resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declcensus.functions import detection, paths


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add ``columns`` so that a filter on them is not pushed below.

    Catalyst moves a filter under a projection by inlining the projected
    expression, which would then run once for the filter and once for the
    output.  It does not move one below a generator on the generator's own
    columns, so costly columns that get filtered are added as a one-row
    generator.
    """
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.inline(F.array(row)))


def with_extension_language(files: DataFrame) -> DataFrame:
    extension = paths.file_extension(F.col("path"))
    return files.withColumn("extension_language", paths.language_of_extension(extension))


def with_content_language(files: DataFrame) -> DataFrame:
    """Add ``content_language``; NULL where the content gives no supported label."""
    labelled = detection.with_label(files, "content", "_label")
    return labelled.withColumn("content_language", paths.language_of_label(F.col("_label"))).drop("_label")


def with_language(files: DataFrame) -> DataFrame:
    """Add ``language``: the content decides, even against the extension, and the
    extension where the content gives none."""
    both = with_content_language(with_extension_language(files))
    resolved = F.coalesce(F.col("content_language"), F.col("extension_language"))
    return barrier(both, language=resolved).drop("content_language", "extension_language")


def supported(files: DataFrame) -> DataFrame:
    """Only files with a language; the rest are skipped silently."""
    return files.filter(F.col("language").isNotNull())
