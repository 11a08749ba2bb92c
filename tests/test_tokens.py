"""Bracket matching as rows: any depth, any chunk size, same counts as the patterns."""

import pytest
from helpers import files
from pyspark.sql import functions as F

from declcensus.operators import counts, language, tokens

CODE = {
    "a.js": "class A {\n  constructor(x) { super(x); }\n  get y() { return f(g(h(1))); }\n}\nnew Foo();\nif (a) { b(c); }\n",
    "b.ts": "class B { m<T>(cb: (x: T) => void): Promise<T> { return go(cb); } n(a: string): void; }\n",
    "c.java": "class C { C(int a) { f(a); } void m() { g(h(1)); } abstract int n(Map<A, B> m) throws E; int x = k(2); }\n",
    "none.js": "const x = f(1);\n",
    "d.rs": "fn a() {}",
}


def _methods(spark, contents, chunk=tokens.CHUNK):
    df = language.with_language(files(spark, contents))
    return {r["path"]: r["method_count"] for r in tokens.method_counts(df, chunk).collect()}


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, tokens.CHUNK])
def test_method_counts(spark, chunk):
    assert _methods(spark, CODE, chunk) == {"a.js": 2, "b.ts": 1, "c.java": 3}


def test_depth_beyond_the_patterns(spark):
    deep = "(" * 40 + "1" + ")" * 40
    code = {"deep.js": f"const o = {{ m(a = {deep}) {{ return a; }}, n() {{}} }};\n"}
    assert _methods(spark, code) == {"deep.js": 2}


def test_agrees_with_declaration_rows(spark):
    many = {f"f{i}.java": "class A { " + "void m(int a) { f(g(a)); } " * i + "}" for i in range(1, 30)}
    df = language.with_language(files(spark, many))
    rows = counts.declarations(df).filter(F.col("category") == "function").groupBy("path").count()
    assert {r["path"]: r["count"] for r in rows.collect()} == _methods(spark, many, chunk=16)
