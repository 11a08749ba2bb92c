"""Aggregates, order and report layouts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from declcensus.functions import paths
from declcensus.operators import aggregates, ordering, report

COUNTS = [
    ("core/run.rs", "Rust", 4, 2),
    ("core/api.rs", "Rust", 6, 1),
    ("tool.py", "Python", 1, 1),
]
SCHEMA = "path string, language string, function_count bigint, class_struct_count bigint"


def _counts(spark, rows=COUNTS):
    return spark.createDataFrame(rows, SCHEMA)


def _text(lines):
    return "\n".join(r["text"] for r in lines.orderBy("position").collect())


def test_totals(spark):
    by_language = aggregates.language_totals(_counts(spark))
    assert {tuple(r) for r in by_language.collect()} == {("Rust", 2, 10, 3), ("Python", 1, 1, 1)}
    assert tuple(aggregates.grand_totals(by_language).first()) == (3, 11, 4)
    assert ("Total", 3, 11, 4) in {tuple(r) for r in aggregates.with_total(by_language).collect()}


def test_totals_of_nothing_are_zero(spark):
    empty = aggregates.language_totals(_counts(spark, []))
    assert [tuple(r) for r in aggregates.with_total(empty).collect()] == [("Total", 0, 0, 0)]


def test_summary(spark):
    expected = (
        "Language Summary:\n"
        "  Python:         1 functions,    1 structs/classes in 1 files\n"
        "  Rust:          10 functions,    3 structs/classes in 2 files\n"
        "\n"
        "Total: 11 functions, 4 structs/classes in 3 files"
    )
    assert _text(report.report(_counts(spark))) == expected
    assert report.summary_text(aggregates.language_totals(_counts(spark))) == expected


def test_empty_reports(spark):
    empty = _counts(spark, [])
    assert _text(report.report(empty)) == (
        "Language Summary:\n\nTotal: 0 functions, 0 structs/classes in 0 files"
    )
    assert _text(report.report(empty, "detail")) == _text(report.report(empty))
    assert json.loads(_text(report.report(empty, "json"))) == {
        "files": [],
        "total_by_language": {},
        "total_stats": {"function_count": 0, "class_struct_count": 0},
    }


def test_detail(spark):
    text = _text(report.report(_counts(spark), detail=True))
    assert text.startswith(
        "core/api.rs (Rust):\n  Functions: 6\n  Structs/Classes: 1\n\n"
        "core/run.rs (Rust):\n  Functions: 4\n  Structs/Classes: 2\n\n"
        "tool.py (Python):\n  Functions: 1\n  Structs/Classes: 1\n\n"
        "Language Summary:\n"
    )


def test_json_is_pretty_printed(spark):
    text = _text(report.report(_counts(spark), "json"))
    value = {
        "files": [
            {"path": p, "language": l, "stats": {"function_count": f, "class_struct_count": c}}
            for p, l, f, c in sorted(COUNTS)
        ],
        "total_by_language": {
            "Python": {"file_count": 1, "function_count": 1, "class_struct_count": 1},
            "Rust": {"file_count": 2, "function_count": 10, "class_struct_count": 3},
        },
        "total_stats": {"function_count": 11, "class_struct_count": 4},
    }
    assert text == json.dumps(value, indent=2)


def test_json_report_is_read_back(spark, tmp_path):
    odd = [('a "b"\\c\t&.rs', "Rust", 1, 0), *COUNTS]
    report.write_report(report.report(_counts(spark, odd), "json"), str(tmp_path / "parts"))
    whole = tmp_path / "report.json"
    parts = sorted((tmp_path / "parts").glob("part-*"))
    whole.write_text("".join(p.read_text() for p in parts))
    row = report.read_report(spark, str(whole)).first()
    got = {(f["path"], f["language"], *f["stats"]) for f in row["files"]}
    assert got == set(odd)
    assert row["total_stats"]["function_count"] == 12
    assert row["total_by_language"]["Rust"]["file_count"] == 3


def test_json_lines_round_trip(spark):
    back = report.from_json_lines(report.to_json_lines(_counts(spark)))
    got = {(r["path"], r["language"], *r["stats"]) for r in back.collect()}
    assert got == set(COUNTS)


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        report.report(_counts(spark), "JSON")


def test_path_order_is_by_component(spark):
    names = ["a-b/c.rs", "a/b.rs", "a", "a/b/c.rs", "b", "a.rs", "A/z", "a/é.rs", "a/b-c.rs"]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = [r["path"] for r in ordering.by_path(df).collect()]
    assert got == sorted(names, key=lambda n: [p.encode() for p in n.split("/")])


def test_positions_are_exact_across_ranges(spark):
    names = [f"d{i % 37}/f{i * 7919 % 5000}.rs" for i in range(5000)]
    df = spark.createDataFrame([(n,) for n in names], "path string").repartition(7)
    placed = ordering.with_position(df, paths.path_order(F.col("path")))
    got = {r["position"]: r["path"] for r in placed.collect()}
    expected = sorted(names, key=lambda n: n.split("/"))
    assert [got[i + 1] for i in range(len(names))] == expected


def test_positions_run_in_more_than_one_task(spark):
    df = spark.range(10_000).select(F.format_string("f%05d", "id").alias("path"))
    placed = ordering.with_position(df, paths.path_order(F.col("path")))
    assert placed.select(F.spark_partition_id()).distinct().count() > 1
