"""Errors as data: a bad file gives a row, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declcensus.functions import paths
from declcensus.operators.language import barrier

IO_ERROR = "IoError"

# Message formats.
IO_MESSAGE = "IO error: "
READ_MESSAGE = "Failed to read "
UNSUPPORTED_MESSAGE = "Unsupported file type: "
INVALID_UTF8 = "stream did not contain valid UTF-8"


def unsupported_message(path: Column) -> Column:
    return F.concat(F.lit(UNSUPPORTED_MESSAGE), path)


def io_message() -> Column:
    """Message of a file that cannot be used, NULL for a good one.

    An error of the walk itself has no ``length`` and speaks for itself.
    """
    io_error = F.col("io_error")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    cause = F.when(io_error.isNotNull(), io_error).when(~valid, F.lit(INVALID_UTF8))
    unread = F.concat(F.lit(READ_MESSAGE), F.col("path"), F.lit(": "), cause)
    walk = io_error.isNotNull() & F.col("length").isNull()
    return F.concat(F.lit(IO_MESSAGE), F.when(walk, io_error).otherwise(unread))


def with_message(files_with_language: DataFrame) -> DataFrame:
    """Add ``message`` and keep what counts: files with a language, good or bad, and
    errors of the walk.  A bad file without a language is skipped silently."""
    flagged = barrier(files_with_language, message=io_message())
    walk = F.col("message").isNotNull() & F.col("length").isNull()
    return flagged.filter(F.col("language").isNotNull() | walk)


def analysis_errors(files_with_language: DataFrame) -> DataFrame:
    """Rows ``(path, error_kind, message)``."""
    return (
        with_message(files_with_language)
        .filter(F.col("message").isNotNull())
        .select("path", F.lit(IO_ERROR).alias("error_kind"), "message")
    )


def first_error(errors: DataFrame) -> DataFrame:
    """The first error in path order; each task keeps one row, nothing is sorted whole."""
    return errors.orderBy(paths.path_order(F.col("path")), "message").limit(1)


def run_status(files_with_language: DataFrame) -> DataFrame:
    """One row ``(file_count, error_count, failed, first_error)`` from one pass.

    A run has failed only if there were errors and no file went through.
    """
    return status_of(with_message(files_with_language))


def status_of(flagged: DataFrame) -> DataFrame:
    """``run_status`` over rows with ``path`` and ``message``."""
    wrong = F.col("message").isNotNull()
    order = F.struct(paths.path_order(F.col("path")).alias("path"), F.col("message"))
    totals = flagged.agg(
        F.count_if(~wrong).alias("file_count"),
        F.count_if(wrong).alias("error_count"),
        F.min(F.when(wrong, order)).alias("first"),
    )
    return totals.select(
        "file_count",
        "error_count",
        ((F.col("error_count") > 0) & (F.col("file_count") == 0)).alias("failed"),
        F.col("first.message").alias("first_error"),
    )


def raise_if_failed(status: DataFrame) -> None:
    """Raise the first error of a run in which nothing went through."""
    row = status.first()
    if row["failed"]:
        raise RuntimeError(row["first_error"])
