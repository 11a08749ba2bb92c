"""Complete runs: a tree, a table or one file in, statistics and reports out."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from declcensus import schemas as S
from declcensus.operators import aggregates, analysis, errors, ordering, report
from declcensus.sources import table, tree


@dataclass
class Census:
    """Result of a run.  ``analyzed`` is narrow and materialized, so everything
    below reads the sources no second time."""

    analyzed: DataFrame

    @property
    def counts(self) -> DataFrame:
        return analysis.file_counts(self.analyzed)

    @property
    def file_stats(self) -> DataFrame:
        return ordering.by_path(analysis.file_stats(self.analyzed))

    @property
    def errors(self) -> DataFrame:
        return analysis.file_errors(self.analyzed)

    @property
    def by_language(self) -> DataFrame:
        return aggregates.language_totals(self.counts)

    @property
    def totals(self) -> DataFrame:
        return aggregates.grand_totals(self.by_language)

    @property
    def status(self) -> DataFrame:
        return errors.status_of(self.analyzed)

    def report(self, format: str = report.SUMMARY, detail: bool = False) -> DataFrame:
        return report.report(self.counts, format, detail, materialized=True)

    def summary(self) -> str:
        return report.summary_text(self.by_language)


def analyze(
    files: DataFrame,
    ignore: Iterable[str] = (),
    max_depth: int = S.ANY_DEPTH,
    follow_links: bool = False,
) -> Census:
    """Run over a ``source_files`` table; raise the first error if nothing went through."""
    analyzed = ordering.materialize(
        analysis.analyze_files(files, ignore, max_depth, follow_links)
    )
    census = Census(analyzed)
    errors.raise_if_failed(census.status)
    return census


def analyze_directory(
    spark: SparkSession,
    root: str,
    ignore: Iterable[str] = (),
    max_depth: int = S.DEFAULT_MAX_DEPTH,
    follow_links: bool = False,
) -> Census:
    """Run over a directory tree."""
    ignore = list(ignore)
    files = tree.source_files(spark, root, ignore, max_depth, follow_links)
    return analyze(files, ignore, max_depth, follow_links)


def analyze_file(files: DataFrame, path: str) -> DataFrame:
    """The one-row counts of a single file of a ``source_files`` table.

    What a directory run skips is an error here: a missing file, an unsupported
    type, unreadable text.
    """
    one = table.single_file(files, path)
    found = analysis.analyze_files(one, max_depth=S.ANY_DEPTH, follow_links=True).take(2)
    if not found:
        if one.isEmpty():
            raise FileNotFoundError(f"{errors.IO_MESSAGE}{path} is not a file")
        raise ValueError(f"{errors.UNSUPPORTED_MESSAGE}{path}")
    if len(found) > 1:
        raise ValueError(f"{path} is in the table more than once")
    if found[0]["message"] is not None:
        raise OSError(found[0]["message"])
    return files.sparkSession.createDataFrame(
        [tuple(found[0])[:-1]],
        "path string, language string, function_count bigint, class_struct_count bigint",
    )


def analyze_path(
    spark: SparkSession,
    path: str,
    ignore: Iterable[str] = (),
    max_depth: int = S.DEFAULT_MAX_DEPTH,
    follow_links: bool = False,
    format: str = report.SUMMARY,
    detail: bool = False,
) -> DataFrame:
    """Report lines for a file or a directory of the local or mounted file system."""
    if os.path.isfile(path):
        counts = analyze_file(tree.one_file(spark, path), path)
        return report.single_file_text(counts).selectExpr("0L AS position", "text")
    if not os.path.isdir(path):
        raise FileNotFoundError(f"{path} is neither a file nor a directory")
    census = analyze_directory(spark, path, ignore, max_depth, follow_links)
    return census.report(format, detail)
