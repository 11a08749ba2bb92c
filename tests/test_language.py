"""Extensions, content labels and how the two are resolved."""

import pytest
from helpers import counted, files
from pyspark.sql import functions as F

from declcensus.functions import paths
from declcensus.operators import language

PYTHON = "def foo(a):\n    return 42\n\nclass Thing:\n    def method(self):\n        pass\n"
TSX = "interface Props {\n  name: string;\n}\nconst C = ({ name }: Props) => <b>{name}</b>;\nexport default C;\n"
JSX = "function C() {\n  return <div>Hello</div>;\n}\nconst D = () => {\n  return <b>x</b>;\n};\nexport default C;\n"


@pytest.mark.parametrize(
    "path, extension",
    [
        ("a/main.rs", "rs"),
        ("MAIN.RS", "rs"),
        ("x.spec.js", "js"),
        ("a.b/file", None),
        (".rs", None),
        ("dir/.hidden.py", "py"),
        ("Makefile", None),
        ("", None),
        ("dot.", ""),
        ("a b & c/d.go", "go"),
    ],
)
def test_extension(spark, path, extension):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(paths.file_extension(F.col("path"))).first()[0] == extension


def test_extension_and_label_tables(spark):
    keys = ["rs", "go", "py", "js", "ts", "java", "jsx", "tsx", "mjs", "pyi", "txt", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r[0] for r in df.select(paths.language_of_extension(F.col("k"))).collect()]
    assert got == ["Rust", "Go", "Python", "JavaScript", "TypeScript", "Java"] + [None] * 6
    labels = ["rust", "go", "python", "javascript", "typescript", "java", "txt", "unknown"]
    df = spark.createDataFrame([(k,) for k in labels], "k string")
    got = [r[0] for r in df.select(paths.language_of_label(F.col("k"))).collect()]
    assert got == ["Rust", "Go", "Python", "JavaScript", "TypeScript", "Java", None, None]


def _languages(spark, contents):
    df = language.with_language(files(spark, contents))
    return {r["path"]: r["language"] for r in df.select("path", "language").collect()}


def test_content_decides_and_extension_fills_in(spark):
    got = _languages(
        spark,
        {
            "script": "#!/usr/bin/env python3\nprint('x')\n",
            "code.txt": PYTHON,
            "wrong.js": PYTHON,
            "view.tsx": TSX,
            "view.jsx": JSX,
            "mod.mjs": "export const a = () => { console.log(1); };\n",
            "tiny.rs": "fn f(){}",
            "prose.py": "A plain sentence about nothing in particular.",
            "note.txt": "This is not a code file",
            "run.sh": "#!/bin/bash\necho hello\n",
            "data.json": '{"key": "value"}',
            "README.md": "# Title\n\nSome text with `code`.\n",
            "lib.cpp": "#include <string>\nclass A {\npublic:\n  void f(int x) { return; }\n};\n",
            "a.rs": "",
            "guide.md": "# Guide\n\n```python\n" + PYTHON + "```\n",
            "guide.rst": "Guide\n=====\n\n" + PYTHON,
            "cached.pyc": b"\x00\x01\xff" + PYTHON.encode(),
        },
    )
    assert got == {
        "script": "Python",
        "code.txt": "Python",
        "wrong.js": "Python",
        "view.tsx": "TypeScript",
        "view.jsx": "JavaScript",
        "mod.mjs": "JavaScript",
        "tiny.rs": "Rust",
        "prose.py": "Python",
        "note.txt": None,
        "run.sh": None,
        "data.json": None,
        "README.md": None,
        "lib.cpp": None,
        "a.rs": "Rust",
        "guide.md": None,
        "guide.rst": None,
        "cached.pyc": None,
    }


def test_large_files_are_searched_in_full(spark):
    
    filler = "# filler text\n" * 400_000
    got = _languages(spark, {"big.txt": filler + PYTHON, "prose.txt": filler})
    assert got == {"big.txt": "Python", "prose.txt": None}


def test_unsupported_files_are_skipped(spark):
    got = counted(spark, {"a.rs": "fn a() {}", "b.txt": "text", "c.md": "# x"})
    assert got == {"a.rs": ("Rust", 1, 0)}
