"""Path filters, links, bad files, run status."""

import pytest
from helpers import counted, files
from pyspark.sql import functions as F

from declcensus.operators import analysis, errors, filters, language
from declcensus.plans import census

CODE = {
    "src/main.rs": "fn a() {}",
    "src/deep/x/lib.rs": "fn b() {}\nstruct S;",
    ".git/config.rs": "fn c() {}",
    "main.go": "package main\nfunc d() {}\n",
    "a%b_c/e.py": "def e():\n    pass\n",
}


def _paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


@pytest.mark.parametrize(
    "patterns, left",
    [
        ((), 5),
        ((".git",), 4),
        ((".GIT",), 5),
        (("src", ".git"), 2),
        (("%",), 4),
        (("*.rs",), 5),
        (("",), 0),
    ],
)
def test_ignore_is_a_literal_substring(spark, patterns, left):
    assert len(_paths(filters.ignore(files(spark, CODE), patterns))) == left


def test_ignore_is_pushed_to_the_scan(spark, tmp_path):
    files(spark, CODE).select("path", "content").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).withColumn("io_error", F.lit(None).cast("string"))
    df = df.withColumn("length", F.lit(1))
    plan = filters.ignore(df, [".git"]).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(path,.git)" in plan
    assert "content" not in plan.split("ReadSchema")[1]


def test_depth(spark):
    assert _paths(filters.within_depth(files(spark, CODE), 1)) == ["main.go"]
    assert _paths(filters.within_depth(files(spark, CODE), 0)) == []
    assert len(_paths(filters.within_depth(files(spark, CODE), 4))) == 5


def test_links(spark):
    df = files(spark, CODE).withColumn("via_link", F.col("path").startswith("src"))
    assert len(_paths(filters.links(df))) == 3
    assert len(_paths(filters.links(df, follow_links=True))) == 5


def test_bad_file_is_a_row_and_the_rest_goes_on(spark):
    mixed = {"ok.rs": "fn a() {}", "bad.rs": b"\xff\xfe\xff\xff", "bad.txt": b"\xff\xfe"}
    df = language.with_language(files(spark, mixed))
    assert [tuple(r) for r in errors.analysis_errors(df).collect()] == [
        ("bad.rs", "IoError", "IO error: Failed to read bad.rs: stream did not contain valid UTF-8")
    ]
    assert counted(spark, mixed) == {"ok.rs": ("Rust", 1, 0)}
    assert tuple(errors.run_status(df).first())[:3] == (1, 1, False)
    assert census.analyze(files(spark, mixed)).totals.first()["file_count"] == 1


def test_run_fails_only_if_nothing_went_through(spark):
    bad = {"a-b/c.rs": b"\xff", "a/b.rs": b"\xff"}
    with pytest.raises(RuntimeError, match="Failed to read a/b.rs"):
        census.analyze(files(spark, bad))
    nothing = census.analyze(files(spark, {"a.txt": "text"}))
    assert tuple(nothing.totals.first()) == (0, 0, 0)
    assert tuple(nothing.status.first()) == (0, 0, False, None)


def test_first_error_is_in_path_order(spark):
    bad = {"a-b/c.rs": b"\xff", "a/b.rs": b"\xff", "z.rs": b"\xff"}
    analyzed = analysis.analyze_files(files(spark, bad))
    assert errors.first_error(analysis.file_errors(analyzed)).first()["path"] == "a/b.rs"


def test_single_file(spark):
    df = files(spark, {**CODE, "n.txt": "text", "bad.rs": b"\xff"})
    assert tuple(census.analyze_file(df, "src/deep/x/lib.rs").first()) == (
        "src/deep/x/lib.rs", "Rust", 1, 1,
    )
    with pytest.raises(ValueError, match="Unsupported file type: n.txt"):
        census.analyze_file(df, "n.txt")
    with pytest.raises(FileNotFoundError, match="is not a file"):
        census.analyze_file(df, "missing.rs")
    with pytest.raises(OSError, match="Failed to read bad.rs"):
        census.analyze_file(df, "bad.rs")
