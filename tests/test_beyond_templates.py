"""Forms outside the derived corpus, deep nesting, and hostile inputs that must not take long."""

import time

import pytest
from helpers import counted, files, snippet_counts

from declcensus.functions import brackets, masking
from declcensus.operators import counts, language

TYPESCRIPT = [
    ("class A { private cb: ((x: number) => void) | null = null; m() {} }", 1, 1),
    ("class A { private cb: ((x: number) => void) | null; m() {} }", 1, 1),
    ("class A { private subs: ((x: number) => void)[] = []; }", 0, 1),
    ("let v: ((a: number) => string) | undefined;", 0, 0),
    ("class A {\n  handler: (e: Event) => void\n  m() {}\n}", 1, 1),
    ("let v: (a: number) => string\nfunction f() {}", 1, 0),
    ("declare const x: (a: number) => void\n", 0, 0),
    ("class A { private h: { [k: string]: (x: number) => void } = {}; m() {} }", 1, 1),
    ("let handlers: { a: () => void; b: () => void };", 0, 0),
    ("function f(): { a: () => void } { return g(); }", 1, 0),
    ("const f = () => void 0;\nconst g = (x: number) => string(x);", 2, 0),
    ("function f<T extends { a: string }>(x: T) { }", 1, 0),
    ("class A { m<T extends { a: string }>(x: T) { } }", 1, 1),
    ("class A { m<T extends (a: { b: 1 }) => void, U = Array<T>>(x: T): { c: T } { } }", 1, 1),
    ("let v: (a: number) => Foo\nfunction f() {}", 1, 0),
    ("let v: (a: number) => Foo\n  | Bar;\nfunction f() {}", 1, 0),
    ("class A {\n  cb?: (x: number) => Foo\n  m() {}\n}", 1, 1),
    ("class A { cb: (x: Foo) => Bar }", 0, 1),
    ("class A { cb: (x: Foo, y: (z: Foo) => Bar) => Bar; run = (x: Foo): Bar => { }; m() { return { cb: (x: Foo) => x }; } }", 3, 1),
    ("if (a < b) { } class A { m() { return a < b; } n<T>(c: T) { return c > (d); } }", 2, 1),
]
OTHERS = [
    ("Rust", "fn f() -> [[f64; 3]; 3] { x() }\nfn g(a: [[u8; 2]; 2]) -> u8 { 0 }", 2, 0),
    ("Go", "package p\n\ntype Arr [N + 1]struct{}\n\ntype Set[T comparable] struct {\n\tm map[T]bool\n}\n\ntype Pair[K, V any] struct{}\n", 0, 2),
    ("Java", 'enum E implements I { ONE("x") { public void f() {} }; E(String s) {} }', 2, 0),
    ("Java", "@interface M { String value() default \"x\"; int[] n() default {1, 2}; class I { void f() {} } }\nclass A { A() {} }", 2, 2),
    ("JavaScript", "function C() { return <p>Don't {xs.map(x => x)} and won't</p>; }", 2, 0),
    ("JavaScript", "function C() { return <p>see http://x {xs.map(x => x)}</p>; }\nfunction d() {}", 3, 0),
    ("JavaScript", "switch (a) { case'x => y': return'() => 1'; } // () => 2\nvar s = 'http://x => y', t = \"https://a\";", 0, 0),
    ("Java", "@interface M { class I { void f() {} } int v(); class J { int g() { return 1; } } int w() default 1; }", 2, 2),
    ("Java", "class A { int f(int a)[] { } void g() throws E, F { } abstract int h() throws E; int x = k(2); }", 3, 1),
    ("JavaScript", "x = { 1() {}, 2.5() {} };", 2, 0),
    ("JavaScript", "class A { with() {} if() {} for() {} get x() { return 1; } *g() {} }", 5, 1),
    ("JavaScript", "class A { m() { if (a) { } for (;;) { } while (b) { } switch (c) { } } static { if (d) { } } f = function () { }; }", 2, 1),
    ("JavaScript", "return" + " " * 20 + "/a => b/.test(s); x = a / b; y = (c) => c / 2 / d;", 1, 0),
    ("Python", "def \\\nf(): pass\nx = 1 + \\\n  2\n", 1, 0),
    ("Go", "package p\n\ntype (\n\tA[T any] struct{ x T }\n\tB [4]int\n\n\tC struct {\n\t\tf func(a struct{}) struct{}\n\t}\n)\n", 0, 2),
    ("Rust", "fn a\x01(b: i32) -> i32 { m!{ fn no() {} } }\x02 fn c() { n![[fn no() {}]]; o!((fn no() {})); }", 2, 0),
    ("JavaScript", "a(1)\n" + " " * 300 + "\nclass A {\n" + " " * 200 + "m() {}\n}", 1, 1),
]


def test_typescript_type_positions(spark):
    got = snippet_counts(spark, [(str(k), "TypeScript", t) for k, (t, _, _) in enumerate(TYPESCRIPT)])
    assert got == {str(k): (f, c) for k, (_, f, c) in enumerate(TYPESCRIPT)}


def test_other_languages(spark):
    got = snippet_counts(spark, [(str(k), lang, t) for k, (lang, t, _, _) in enumerate(OTHERS)])
    assert got == {str(k): (f, c) for k, (_, _, f, c) in enumerate(OTHERS)}


@pytest.mark.parametrize("depth", [13, 40, 600, 3000])
def test_deep_brackets(spark, depth):
    inside = "(" * depth + "0" + ")" * depth
    snippets = [
        ("rust", "Rust", f"fn f(a: {inside}) -> u8 {{ 0 }}\nm! {{ {'{' * (depth - 1)} fn no() {{}} {'}' * (depth - 1)} }}"),
        ("go", "Go", f"package p\n\nfunc f(a {inside}) int {{\n}}\n"),
        ("python", "Python", f"def f(a={inside}):\n    pass\n"),
        ("js", "JavaScript", f"class A {{ m(a = {inside}) {{ }} }}\nfunction g(b = {inside}) {{ }}"),
        ("ts", "TypeScript", f"class A {{ m(a = {inside}): void {{ }} }}"),
        ("java", "Java", f"class A {{ @B(x = {inside}) void f(@C({inside}) int a) {{ }} }}"),
        ("comment", "Rust", "/* " * depth + "fn no() {}" + " */" * depth + " fn yes() {}"),
    ]
    expected = {"rust": (1, 0), "go": (1, 0), "python": (1, 0), "js": (2, 1), "ts": (1, 1), "java": (1, 1), "comment": (1, 0)}
    assert snippet_counts(spark, snippets) == expected


HOSTILE = [
    ("Go", "a /* b\n"), ("Rust", "a /* b\n"), ("Java", "a /* b\n"), ("JavaScript", "a /* b\n"), ("TypeScript", "a /* b\n"),
    ("Rust", 'r#" x\n'), ("JavaScript", "` ${ x\n"), ("Python", '""" x\n'), ("Go", "` x\n"), ("Python", "def f(a)\n"),
    ("JavaScript", "a(b, "), ("TypeScript", "const a: "), ("Rust", "fn f(a, "), ("Java", "void f(int a, "), ("Go", "func f(a, "),
]


@pytest.mark.parametrize("lang, unit", HOSTILE)
def test_masks_and_counts_are_linear(spark, lang, unit):
    seconds = []
    for size in (250_000, 1_000_000):
        start = time.perf_counter()
        snippet_counts(spark, [("x", lang, unit * (size // len(unit)))])
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 30 and seconds[1] < 8 * seconds[0] + 3, seconds


@pytest.mark.parametrize(
    "unit", ["def f(a)\n", "const a: b\n", "const {\n", "impl a\n", "fn f(a\n", "import a\n", "public a<\n", "struct a\n", "class a\n", "interface a\n", "<\n"]
)
def test_detection_is_linear(spark, unit):
    seconds = []
    for size in (250_000, 1_000_000):
        start = time.perf_counter()
        language.with_language(files(spark, {"x.rb": unit * (size // len(unit))})).select("language").collect()
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 30 and seconds[1] < 8 * seconds[0] + 3, seconds


GO = "x := 1\nfmt.Println(x)\ntype T struct {\n}\n"
SIZES = {"go": GO, "python": "#!/usr/bin/python27\nx\n", "rust": "fn f<'a>(x: &'a str) -> bool {\n  true\n}\n", "script": "const f = (a) => {\n  return <b>x</b>;\n};\n"}


@pytest.mark.parametrize("name", SIZES)
def test_labels_do_not_depend_on_the_size(spark, name):
    filler = ("  lorem ipsum dolor\n") * 250_000
    small = counted(spark, {"x.txt": SIZES[name] + "  lorem ipsum dolor\n"})
    large = counted(spark, {"x.txt": SIZES[name] + filler})
    assert small == large


def test_content_wins_and_the_operators_agree(spark):
    contents = {
        "gen.py": 'import json\n\nTEMPLATE = """\n' + "function a() {\n  return 1;\n}\nconst b = () => { console.log(1); };\n" * 3 + 'export default a;\n"""\n\ndef f(x):\n    return x\n',
        "wrong.js": "def foo(a):\n    return 42\n\nclass Thing:\n    def method(self):\n        pass\n",
        "plain.go": "nothing here\n",
        "quoted.rs": "```\nfn f() {\n}\n```\n",
        "none.txt": "nothing here\n",
    }
    both = language.with_content_language(language.with_extension_language(files(spark, contents)))
    one = {r["path"]: r["language"] for r in language.with_language(files(spark, contents)).collect()}
    for r in both.collect():
        assert one[r["path"]] == (r["content_language"] or r["extension_language"])
    assert one["wrong.js"] == "Python" and one["plain.go"] == "Go" and one["none.txt"] is None and one["quoted.rs"] == "Rust"


def test_a_mark_takes_the_same_text_in_any_company():
    """Brackets of one text do not meet those of another, however texts are put together."""
    texts = [("Rust", b"fn f(a: ((1)) { x("), ("Java", b"class A { void f() throws E { } } ))"), ("Go", b"type (\x08\n\tA struct{}\n)"),
             ("TypeScript", b"class A {\x07 m<T>(x: T): { a: 1 } { } b: (c: D) => E }"), ("Python", b"def f[T](a) -> x:"), ("Rust", b""), (None, b"f(x) {")]
    alone = [brackets.rewrite([t], [lang])[0] for lang, t in texts]
    assert brackets.rewrite([t for _, t in texts], [lang for lang, _ in texts]) == alone
    assert brackets.rewrite([t for _, t in texts] * 3, [lang for lang, _ in texts] * 3) == alone * 3


@pytest.mark.parametrize("unit", ["/* ", "*/ ", '" ', "// x\n", "/* */ ", "r#\" ", "' "])
def test_flat_comments_read_a_text_once(unit):
    start = time.perf_counter()
    masking.flat_comments("/* /* */ */" + unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - start < 5


def test_bytes_that_are_not_text_do_not_stop_a_task(spark):
    rows = [("a", "Rust", b"/* /* \xff */ */ fn a() {}"), ("b", "Rust", b"fn b() { \xfe }"), ("c", "Java", b"class C { void m() { \xff } }")]
    df = spark.createDataFrame(rows, "path string, language string, content binary")
    assert {r["path"]: r["function_count"] for r in counts.file_counts(df).collect()} == {"a": 1, "b": 1, "c": 1}
