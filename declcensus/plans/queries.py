"""Registered queries: one per operator, each over the whole ``documents`` table."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declcensus import schemas as S
from declcensus.functions import paths
from declcensus.operators import (
    aggregates,
    analysis,
    counts,
    errors,
    filters,
    language,
    ordering,
    report,
    tokens,
)
from declcensus.plans import census, corpus
from declcensus.sources import tree

IGNORED = (".git", "a-b/")
MAX_DEPTH = 2
ANY_DEPTH = S.ANY_DEPTH


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.mixed_files(spark, sf_dir)
    return analysis.analyze_files(files, max_depth=ANY_DEPTH, follow_links=True)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.file_counts(_analyzed(spark, sf_dir))


def _by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.language_totals(_counts(spark, sf_dir))


def _with_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.with_language(corpus.mixed_files(spark, sf_dir))


def _good_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = errors.with_message(_with_language(spark, sf_dir))
    return found.filter(F.col("message").isNull())


# --- paths, languages, filters ----------------------------------------------


def file_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.mixed_files(spark, sf_dir)
    return files.select("path", paths.file_extension(F.col("path")).alias("extension"))


def detect_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = language.with_extension_language(corpus.mixed_files(spark, sf_dir))
    return files.select("path", "extension_language")


def detect_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = language.with_content_language(corpus.mixed_files(spark, sf_dir))
    return files.select("path", "content_language")


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_language(spark, sf_dir).select("path", "language")


def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.supported(_with_language(spark, sf_dir)).select("path", "language")


def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.mixed_files(spark, sf_dir).select(
        "path", "length", "depth", "via_link", F.md5("content").alias("digest")
    )


def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.ignore(corpus.mixed_files(spark, sf_dir), IGNORED).select("path")


def depth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.mixed_files(spark, sf_dir)
    return filters.within_depth(files, MAX_DEPTH).select("path", "depth")


def link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.links(corpus.mixed_files(spark, sf_dir)).select("path", "via_link")


# --- errors -----------------------------------------------------------------


def utf8_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.analysis_errors(_with_language(spark, sf_dir))


def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.first_error(utf8_errors(spark, sf_dir))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.run_status(_with_language(spark, sf_dir))


# --- counts -----------------------------------------------------------------


def mask_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = counts.with_masked(_good_files(spark, sf_dir))
    squeezed = F.regexp_replace("masked", r"\s+", "")
    return masked.select("path", F.md5(squeezed).alias("code_digest"))


def _language_counts(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return analysis.file_counts(analysis.analyze_files(corpus.files_in(spark, sf_dir, name)))

    return query


def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.file_counts(analysis.analyze_files(corpus.nested_files(spark, sf_dir)))


def empty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.plain_files(spark, sf_dir, corpus.COMMENT_BLOCKS, empty_even=True)
    return analysis.file_counts(analysis.analyze_files(files))


def broken_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.plain_files(spark, sf_dir, corpus.BROKEN_BLOCKS)
    return analysis.file_counts(analysis.analyze_files(files))


def unicode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.plain_files(spark, sf_dir, corpus.UNICODE_BLOCKS)
    return analysis.file_counts(analysis.analyze_files(files))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.declarations(_good_files(spark, sf_dir))


def methods_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.method_counts(_good_files(spark, sf_dir))


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


# --- aggregates, order, reports ---------------------------------------------


def one_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file with the smallest path, found and counted on its own."""
    files = corpus.mixed_files(spark, sf_dir)
    path = _good_files(spark, sf_dir).agg(F.min("path")).first()[0]
    counts = _counts(spark, sf_dir).limit(0) if path is None else census.analyze_file(files, path)
    return report.single_file_text(counts)


def language_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked_languages(_by_language(spark, sf_dir))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.grand_totals(_by_language(spark, sf_dir))


def summary_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.with_total(ordering.materialize(_by_language(spark, sf_dir)))


def files_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = ordering.materialize(_good_files(spark, sf_dir).select("path", "language"))
    return ordering.with_position(files, paths.path_order(F.col("path")))


def single_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.single_file_text(_counts(spark, sf_dir))


def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_lines(ordering.materialize(_by_language(spark, sf_dir)))


def detail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.detail_lines(ordering.materialize(_counts(spark, sf_dir)))


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_fragments(ordering.materialize(_counts(spark, sf_dir)))


def format_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report by format and detail flag; the flag changes a summary only."""
    found = ordering.materialize(_counts(spark, sf_dir))
    chosen = [(report.SUMMARY, False), (report.SUMMARY, True), (report.DETAIL, False), (report.JSON, True)]
    reports = [
        report.report(found, format, detail, materialized=True).select(
            F.lit(format).alias("format"), F.lit(detail).alias("detail"), "position", "text"
        )
        for format, detail in chosen
    ]
    return reduce(DataFrame.unionByName, reports)


def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a tree of files, and the tree walked and read again.

    Spark's writer leaves files with hidden names beside its own: the walk sees all of them.
    """
    root = f"{ordering.checkpoint_folder(spark)}/{uuid4()}"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    documents.select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").text(root)
    files = tree.source_files(spark, re.sub(r"^file:(//)?", "", root), ignore=[".crc", "_SUCCESS"])
    folder = F.regexp_extract("path", r"/source=([^/]*)/[^/]*$", 1)
    return files.groupBy(folder.alias("source")).agg(
        F.sum("length").alias("bytes"), F.sum(F.length("content")).cast("bigint").alias("bytes_read"),
        F.min("depth").cast("bigint").alias("depth"), F.count("io_error").alias("errors"),
    )


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = report.from_json_lines(report.to_json_lines(_counts(spark, sf_dir)))
    return back.select("path", "language", "stats.function_count", "stats.class_struct_count")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "file_extension": file_extension,
    "detect_by_extension": detect_by_extension,
    "detect_by_content": detect_by_content,
    "detect_language": detect_language,
    "supported_files": supported_files,
    "source_scan": source_scan,
    "ignore_filter": ignore_filter,
    "depth_filter": depth_filter,
    "link_filter": link_filter,
    "utf8_errors": utf8_errors,
    "first_error": first_error,
    "run_status": run_status,
    "mask_code": mask_code,
    "rust_counts": _language_counts(S.RUST),
    "go_counts": _language_counts(S.GO),
    "python_counts": _language_counts(S.PYTHON),
    "js_counts": _language_counts(S.JAVASCRIPT),
    "ts_counts": _language_counts(S.TYPESCRIPT),
    "java_counts": _language_counts(S.JAVA),
    "nested_counts": nested_counts,
    "empty_files": empty_files,
    "broken_syntax": broken_syntax,
    "unicode_counts": unicode_counts,
    "declarations": declarations,
    "methods_exact": methods_exact,
    "file_stats": file_stats,
    "single_file_stats": single_file_stats,
    "one_file_stats": one_file_stats,
    "language_summary": language_summary,
    "totals": totals,
    "summary_with_total": summary_with_total,
    "files_ordered": files_ordered,
    "summary_lines": summary_lines,
    "detail_lines": detail_lines,
    "json_report": json_report,
    "json_roundtrip": json_roundtrip,
    "format_choice": format_choice,
    "tree_scan": tree_scan,
}
