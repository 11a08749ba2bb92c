"""Directory trees: hidden names, depth, links, loops, unreadable text, reports."""

import json
import os

import pytest

from declcensus.plans import census
from declcensus.sources import tree

PROJECT = {
    "src/main.rs": "fn main() {}\nfn helper(a: i32) -> i32 { a }\nstruct Config { n: i32 }\n",
    "src/lib.rs": "pub fn one() {}\npub struct Two;\nenum Three { A }\n",
    "python/__init__.py": "def start():\n    pass\n\nclass App:\n    def run(self):\n        return 1\n",
    "js/app.js": "const f = (a) => a;\nclass P { go() {} }\n",
    "main.go": "package main\n\nfunc main() {}\n\ntype T struct{}\n",
    "README.md": "# Project\n",
    ".git/config.rs": "fn hidden() {}\n",
    "_gen/out.rs": "fn generated() {}\n",
    "special chars & spaces/file with spaces.rs": "fn test() {}\n",
}


@pytest.fixture
def project(tmp_path):
    for path, text in PROJECT.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    return tmp_path


def _totals(run):
    return tuple(run.totals.first())


def test_nothing_is_ignored_by_itself(spark, project):
    listed = {os.path.relpath(r["path"], project) for r in tree.list_tree(spark, str(project)).collect()}
    assert listed == set(PROJECT)


@pytest.mark.parametrize("units", [1, 3, 1000])
def test_work_units_do_not_change_the_listing(spark, project, units):
    listed = [r["path"] for r in tree.list_tree(spark, str(project), units=units).collect()]
    assert len(listed) == len(set(listed)) == len(PROJECT)


def test_directory_run(spark, project):
    run = census.analyze_directory(spark, str(project))
    by_language = {r["language"]: tuple(r)[1:] for r in run.by_language.collect()}
    assert by_language == {
        "Rust": (5, 6, 3),
        "Python": (1, 2, 1),
        "JavaScript": (1, 2, 1),
        "Go": (1, 1, 1),
    }
    assert _totals(run) == (8, 11, 6)


def test_options(spark, project):
    assert _totals(census.analyze_directory(spark, str(project), ignore=[".git", "_gen"])) == (6, 9, 6)
    assert _totals(census.analyze_directory(spark, str(project), max_depth=1)) == (1, 1, 1)
    assert _totals(census.analyze_directory(spark, str(project), max_depth=0)) == (0, 0, 0)
    # The root is part of the path that is searched for a pattern.
    assert _totals(census.analyze_directory(spark, str(project), ignore=[project.name])) == (0, 0, 0)


def test_directory_links(spark, tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    (source / "linked.rs").write_text("fn linked() {}")
    (tmp_path / "link").symlink_to(source)
    (tmp_path / "file_link.rs").symlink_to(source / "linked.rs")
    (tmp_path / "broken.rs").symlink_to(tmp_path / "missing")
    # A link to a file counts either way, one to a directory only if followed.
    assert _totals(census.analyze_directory(spark, str(tmp_path))) == (2, 2, 0)
    followed = census.analyze_directory(spark, str(tmp_path), follow_links=True)
    assert _totals(followed) == (3, 3, 0)
    assert followed.errors.count() == 1


def test_link_loop_ends_in_an_error_row(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.rs").write_text("fn a() {}")
    (tmp_path / "d" / "up").symlink_to(tmp_path)
    run = census.analyze_directory(spark, str(tmp_path), follow_links=True)
    assert _totals(run) == (1, 1, 0)
    assert "loop" in run.errors.first()["message"]


def test_invalid_text(spark, tmp_path):
    (tmp_path / "invalid.rs").write_bytes(b"\xff\xfe\xff\xff")
    with pytest.raises(RuntimeError, match="valid UTF-8"):
        census.analyze_directory(spark, str(tmp_path))
    (tmp_path / "valid.rs").write_text("fn valid() {}")
    run = census.analyze_directory(spark, str(tmp_path))
    assert _totals(run) == (1, 1, 0)
    assert run.errors.count() == 1


def test_missing_path(spark):
    with pytest.raises(FileNotFoundError, match="neither a file nor a directory"):
        census.analyze_path(spark, "/nonexistent/directory/path")


def test_reports_of_a_path(spark, project):
    def text(**options):
        lines = census.analyze_path(spark, str(project), **options).orderBy("position").collect()
        return "\n".join(r["text"] for r in lines)

    summary = text()
    assert summary.startswith("Language Summary:\n  Go:             1 functions,    1 structs/classes in 1 files\n")
    assert summary.endswith("\n\nTotal: 11 functions, 6 structs/classes in 8 files")
    detail = text(detail=True)
    assert detail == text(format="detail")
    assert f"{project}/src/lib.rs (Rust):\n  Functions: 1\n  Structs/Classes: 2\n\n" in detail
    assert detail.endswith(summary)
    report = json.loads(text(format="json", detail=True))
    assert report["total_stats"] == {"function_count": 11, "class_struct_count": 6}
    assert any(f["path"].endswith("special chars & spaces/file with spaces.rs") for f in report["files"])


def test_report_of_one_file(spark, project):
    path = f"{project}/main.go"
    assert census.analyze_path(spark, path).first()["text"] == (
        f"Analyzing file: {path} (Language: Go)\nCode Statistics:\nFunctions: 1\nClasses/Structs: 1"
    )
    with pytest.raises(ValueError, match="Unsupported file type"):
        census.analyze_path(spark, f"{project}/README.md")


def test_a_name_that_is_not_utf8_is_a_row(spark, tmp_path):
    (tmp_path / "a.rs").write_text("fn f() {}")
    with open(os.path.join(os.fsencode(str(tmp_path)), b"b\xff.rs"), "wb") as f:
        f.write(b"fn g() {}\nfn h() {}")
    got = {r["path"]: r["function_count"] for r in census.analyze_directory(spark, str(tmp_path)).counts.collect()}
    assert got == {f"{tmp_path}/a.rs": 1, f"{tmp_path}/b\ufffd.rs": 2}


def test_a_wide_level_gives_no_more_partitions_than_units(tmp_path):
    for k in range(40):
        (tmp_path / f"d{k}" / "e").mkdir(parents=True)
    reader = tree._TreeReader(str(tmp_path), 100, False, 8)
    parts = reader.partitions()
    assert len(parts) == 8 and sum(len(p.directories) for p in parts) >= 40
    narrow = tree._TreeReader(str(tmp_path), 100, False, 2)
    assert len(narrow.partitions()) <= 2


def test_a_folder_too_wide_for_the_driver_is_one_unit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "_WIDE", 1)
    for k in range(30):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "x.rs").write_text("")
    reader = tree._TreeReader(str(tmp_path), 100, False, 4)
    parts = reader.partitions()
    assert len(parts) == 1 and sum(1 for p in parts for _ in reader.read(p)) == 30
