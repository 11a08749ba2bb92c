"""Reports: summary, detail, JSON and single-file text.

A report is a DataFrame of ``(position, text)``: the texts in order of position,
one newline apart, are the document.  The per-file parts stay distributed however
many files there are; only the summary, of one line per language, is ever small
enough to be put into a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declcensus import schemas as S
from declcensus.functions import paths
from declcensus.operators import aggregates, ordering

SUMMARY = "summary"
DETAIL = "detail"
JSON = "json"
FORMATS = (SUMMARY, DETAIL, JSON)

# The layouts of the text reports.
SUMMARY_HEAD = "Language Summary:"
SUMMARY_LINE = "  %-12s %4d functions, %4d structs/classes in %d files"
TOTAL_LINE = "Total: %d functions, %d structs/classes in %d files"
FILE_HEAD = "%s (%s):"
FILE_FUNCTIONS = "  Functions: %d"
FILE_TYPES = "  Structs/Classes: %d"
SINGLE_FILE = (
    "Analyzing file: %s (Language: %s)\nCode Statistics:\nFunctions: %d\nClasses/Structs: %d"
)

_COUNTS = ("function_count", "class_struct_count", "file_count")


def ranked_languages(by_language: DataFrame) -> DataFrame:
    """Add ``rank``, alphabetical.  One row per language is gathered, six at most."""
    sorted_rows = by_language.agg(
        F.array_sort(F.collect_list(F.struct("language", *_COUNTS))).alias("rows")
    )
    return sorted_rows.select(F.posexplode("rows").alias("place", "row")).select(
        "row.language", *(f"row.{c}" for c in _COUNTS), (F.col("place") + 1).alias("rank")
    )


def summary_lines(by_language: DataFrame) -> DataFrame:
    """Head, a line per language in alphabetical order, an empty line, the total."""
    language_lines = ranked_languages(by_language).select(
        F.col("rank").cast("bigint").alias("position"),
        F.format_string(
            SUMMARY_LINE, F.concat("language", F.lit(":")), *(F.col(c) for c in _COUNTS)
        ).alias("text"),
    )
    languages = by_language.agg(F.count("*").alias("n"), *(
        F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in _COUNTS
    ))
    total = F.format_string(TOTAL_LINE, *(F.col(c) for c in _COUNTS))
    frame = languages.select(
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("position"), F.lit(SUMMARY_HEAD).alias("text")),
                F.struct((F.col("n") + 1).alias("position"), F.lit("").alias("text")),
                F.struct((F.col("n") + 2).alias("position"), total.alias("text")),
            )
        )
    )
    return language_lines.unionByName(frame)


def detail_lines(counts: DataFrame) -> DataFrame:
    """A block of four lines per file in path order, then the summary.

    ``counts`` is read more than once and should be materialized.
    """
    placed = ordering.with_position(counts, paths.path_order(F.col("path")), name="place")
    blocks = placed.select(
        "place",
        F.posexplode(
            F.array(
                F.format_string(FILE_HEAD, "path", "language"),
                F.format_string(FILE_FUNCTIONS, "function_count"),
                F.format_string(FILE_TYPES, "class_struct_count"),
                F.lit(""),
            )
        ).alias("line", "text"),
    ).select(((F.col("place") - 1) * 4 + F.col("line") + 1).alias("position"), "text")
    by_language = aggregates.language_totals(counts)
    offset = by_language.agg(
        (F.coalesce(F.sum("file_count"), F.lit(0)) * 4 + 1).alias("offset")
    )
    # The right side is one row.
    tail = summary_lines(by_language).crossJoin(F.broadcast(offset)).select(
        (F.col("position") + F.col("offset")).alias("position"), "text"
    )
    return blocks.unionByName(tail)


def json_fragments(counts: DataFrame) -> DataFrame:
    """The JSON report as ordered fragments: a head, one per file, a tail.

    Joined by newlines they are one pretty-printed document, files in path order
    and languages in alphabetical order.  ``counts`` is read more than once and
    should be materialized.
    """
    placed = ordering.with_position(counts, paths.path_order(F.col("path")), name="position")
    by_language = aggregates.language_totals(counts)
    grand = by_language.agg(
        *(F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in _COUNTS),
        # At most six entries.
        F.array_sort(F.collect_list(F.struct("language", *_COUNTS))).alias("languages"),
    )
    # One row, joined to say which file comes last.
    total = grand.select(F.col("file_count").alias("_files"))
    files = placed.crossJoin(F.broadcast(total)).select(
        F.col("position").cast("bigint").alias("position"),
        F.concat(
            _file_json(),
            F.when(F.col("position") < F.col("_files"), F.lit(",")).otherwise(F.lit("")),
        ).alias("text"),
    )
    empty = F.col("file_count") == 0
    head = F.when(empty, F.lit('{\n  "files": [],')).otherwise(F.lit('{\n  "files": ['))
    languages = F.transform("languages", _language_json)
    by_language_text = F.when(empty, F.lit('  "total_by_language": {},')).otherwise(
        F.concat(
            F.lit('  ],\n  "total_by_language": {\n'), F.array_join(languages, ",\n"), F.lit("\n  },")
        )
    )
    total_text = F.format_string(
        '  "total_stats": {\n    "function_count": %d,\n    "class_struct_count": %d\n  }\n}',
        "function_count",
        "class_struct_count",
    )
    frame = grand.select(
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("position"), head.alias("text")),
                F.struct(
                    (F.col("file_count") + 1).alias("position"),
                    F.concat(by_language_text, F.lit("\n"), total_text).alias("text"),
                ),
            )
        )
    )
    return files.unionByName(frame)


def _json_string(value: Column) -> Column:
    """``value`` as a quoted JSON string."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def _file_json() -> Column:
    return F.format_string(
        '    {\n      "path": %s,\n      "language": "%s",\n      "stats": {\n'
        '        "function_count": %d,\n        "class_struct_count": %d\n      }\n    }',
        _json_string(F.col("path")),
        "language",
        "function_count",
        "class_struct_count",
    )


def _language_json(row: Column) -> Column:
    return F.format_string(
        '    "%s": {\n      "file_count": %d,\n      "function_count": %d,\n'
        '      "class_struct_count": %d\n    }',
        row["language"],
        row["file_count"],
        row["function_count"],
        row["class_struct_count"],
    )


def single_file_text(counts: DataFrame) -> DataFrame:
    """Rows ``(path, text)``: the four-line report of each file on its own."""
    return counts.select(
        "path",
        F.format_string(
            SINGLE_FILE, "path", "language", "function_count", "class_struct_count"
        ).alias("text"),
    )


def report(
    counts: DataFrame, format: str = SUMMARY, detail: bool = False, materialized: bool = False
) -> DataFrame:
    """The report in the chosen format; ``detail`` turns a summary into a detail
    report and changes nothing else.  ``materialized`` counts are not written again."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    if format == JSON or format == DETAIL or detail:
        once = counts if materialized else ordering.materialize(counts)
        return json_fragments(once) if format == JSON else detail_lines(once)
    return summary_lines(aggregates.language_totals(counts))


def write_report(lines: DataFrame, path: str) -> None:
    """Write a report as text; the part files in name order are the document."""
    lines.orderBy("position").select("text").write.mode("overwrite").text(path)


def summary_text(by_language: DataFrame) -> str:
    """The summary as one string: nine lines at most."""
    rows = summary_lines(by_language).orderBy("position").collect()
    return "\n".join(r["text"] for r in rows)


def to_json_lines(counts: DataFrame) -> DataFrame:
    """One JSON object per file, for reading back at any size."""
    stats = F.struct("function_count", "class_struct_count").alias("stats")
    return counts.select("path", F.to_json(F.struct("path", "language", stats)).alias("text"))


def from_json_lines(lines: DataFrame) -> DataFrame:
    """``(path, language, stats)`` read back from ``to_json_lines``."""
    parsed = lines.select(F.from_json("text", S.FILE_STATS).alias("file"))
    return parsed.select("file.path", "file.language", "file.stats")


def read_report(spark, path: str) -> DataFrame:
    """A whole JSON report read back into the report schema."""
    return spark.read.schema(S.REPORT).json(path, multiLine=True)
