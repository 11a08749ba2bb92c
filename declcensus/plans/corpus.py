"""A source-code corpus that Spark derives from the ``documents`` table.

Every line of every document becomes one block of code in which the line is
carried along as comment or string text; what a block declares is known from its
template.  The number of declarations thus grows with the text, and the expected
results follow from counting lines, without parsing anything.

In a template ``«`` and ``»`` enclose a span that masking must blank, ``{i}`` is
the number of the line, ``{line}`` the line itself and ``{quoted}`` the line
without the characters that could end a literal, ``{line_c}`` the line without
those of a block comment, ``{word}`` its first word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from declcensus import schemas as S
from declcensus.sources import table

FN = S.FUNCTION
TYPE = S.CLASS_STRUCT


@dataclass(frozen=True)
class Block:
    """Template and what it declares, in order: (category, kind, name)."""

    template: str
    declares: tuple[tuple[str, str, str | None], ...]

    @property
    def text(self) -> str:
        return self.template.replace("«", "").replace("»", "")

    def masked(self, keep_quotes: bool = False) -> str:
        """The template without its masked spans and without white space.

        With ``keep_quotes`` a literal leaves its two quotes.
        """
        parts = self.template.split("«")
        code = parts[0]
        for part in parts[1:]:
            span, rest = part.split("»", 1)
            literal = keep_quotes and span[0] in "\"'`" and span[0] == span[-1]
            code += (span[0] * 2 if literal else "") + rest
        return "".join(code.split())


_RUST_BLOCKS = (
    Block(
        "fn plain_{i}(a: &str, b: [u8; 4]) -> i32 {\n    «// {line}»\n"
        "    let s = «\"fn decoy() {} {quoted}\"»;\n    s.len()\n}\n",
        ((FN, "function_item", "plain_{i}"),),
    ),
    Block(
        "pub struct Holder_{i}<T> where T: Clone {\n    value: T, «/* struct Fake /* nested */ fn no() {} */»\n}\n"
        "impl<T: Clone> Holder_{i}<T> {\n    «// {line}»\n"
        "    pub fn get<'a, F: Fn(&'a T) -> i32>(&'a self, f: F) -> i32 where F: Copy { f(&self.value) }\n}\n",
        ((TYPE, "struct_item", "Holder_{i}"), (FN, "function_item", "get")),
    ),
    Block(
        "trait Shape_{i} {\n    fn area(&self) -> f64;\n    fn name(&self) -> char { «'n'» }\n}\n«// {line}»\n",
        ((FN, "function_item", "name"),),
    ),
    Block(
        "enum Kind_{i} { A, B(fn(i32) -> i32) } «// enum Fake {line}»\n",
        ((TYPE, "enum_item", "Kind_{i}"),),
    ),
    Block(
        "fn grid_{i}(a: [[f64; 3]; 3]) -> [[f64; 3]; 3] { a }\n«// {line}»\n",
        ((FN, "function_item", "grid_{i}"),),
    ),
    Block(
        "const TEXT_{i}: &str = «r#\"struct Raw { \"{quoted}\" } fn raw() {}\"#»;\n"
        "async fn run_{i}() { let f = |x: i32| x + 1; make!(fn inner() {} struct In;); }\n«// {line}»\n",
        ((FN, "function_item", "run_{i}"),),
    ),
)

_GO_BLOCKS = (
    Block(
        "func Plain_{i}(a, b int) (int, error) {\n\t«// {line}»\n\ts := «\"func no() {} {quoted}\"»\n"
        "\tf := func(x int) int { return x }\n\treturn f(a), nil\n}\n",
        ((FN, "function_declaration", "Plain_{i}"),),
    ),
    Block(
        "type Holder_{i} struct {\n\tinner struct{ n int }\n}\n«// {line}»\n"
        "func (h *Holder_{i}) Get(f func(int) int) int { return f(h.inner.n) }\n",
        ((TYPE, "type_spec", "Holder_{i}"), (FN, "method_declaration", "Get")),
    ),
    Block(
        "type (\n\tFirst_{i} struct {\n\t\tx struct{}\n\t}\n\tAlias_{i} = string\n\tWriter_{i} interface {\n"
        "\t\tWrite(p []byte) (int, error)\n\t}\n\tSecond_{i}[T any] struct{ v T }\n)\n«// {line}»\n",
        ((TYPE, "type_spec", "First_{i}"), (TYPE, "type_spec", "Second_{i}")),
    ),
    Block(
        "type Arr_{i} [N + 1]struct{}\n«// {line}»\ntype Of_{i}[K comparable, V any] struct{ m map[K]V }\n",
        ((TYPE, "type_spec", "Of_{i}"),),
    ),
    Block(
        "type Named_{i} []struct{ n int }\nconst text_{i} = «`type Fake struct {} {quoted}`»\n«// {line}»\n",
        (),
    ),
    Block(
        "func Map_{i}[K comparable, V any](m map[K]V) []K {\n\t«/* func no() {line_c} */»\n\treturn nil\n}\n",
        ((FN, "function_declaration", "Map_{i}"),),
    ),
)

_PYTHON_BLOCKS = (
    Block(
        "def plain_{i}(a, b=(1, (2, 3))):\n    «# {line}»\n    return «\"def no(): {quoted}\"»\n\n",
        ((FN, "function_definition", "plain_{i}"),),
    ),
    Block(
        "class Holder_{i}(dict):\n    «\"\"\"class Fake:\n    def no(self): {quoted}\n    \"\"\"»\n\n"
        "    @staticmethod\n    def get(x: «\"int\"» = 3) -> dict[str, int]:\n        «# {line}»\n        return x\n\n",
        ((TYPE, "class_definition", "Holder_{i}"), (FN, "function_definition", "get")),
    ),
    Block(
        "async def run_{i}(\n    a,\n    *args,\n):\n    «# {line}»\n    def inner(z):\n        return lambda q: z\n    return inner\n\n",
        ((FN, "function_definition", "run_{i}"), (FN, "function_definition", "inner")),
    ),
    Block(
        "def \\\njoined_{i}(a):\n    «# {line}»\n    pass\n\n",
        ((FN, "function_definition", "joined_{i}"),),
    ),
    Block(
        "text_{i} = «'''\ndef no():\n    {quoted}\nclass Fake:\n'''»\n«# class No: {line}»\n\n",
        (),
    ),
)

_SCRIPT_COMMON = (
    Block(
        "class Words_{i} {\n    if() {}\n    for(a = ((1))) { return          «/x => y/g»; }\n}\n"
        "const o_{i} = { 1() {}, 2.5() {} };\n«// {line}»\n",
        (
            (TYPE, "class_declaration", "Words_{i}"),
            (FN, "method_definition", "if"),
            (FN, "method_definition", "for"),
            (FN, "method_definition", "1"),
            (FN, "method_definition", "2.5"),
        ),
    ),
    Block(
        "function plain_{i}(a, b = (1 + 2)) {\n    «// {line}»\n    console.log(«\"function no() {} {quoted}\"»);\n"
        "    return new Thing(a);\n}\n",
        ((FN, "function_declaration", "plain_{i}"),),
    ),
    Block(
        "class Holder_{i} extends Base {\n    constructor(x) { super(x); }\n    get size() { return 1; }\n"
        "    static async load() { if (true) { return null; } }\n    *items() {}\n    #secret() {}\n}\n«// {line}»\n",
        (
            (TYPE, "class_declaration", "Holder_{i}"),
            (FN, "method_definition", "constructor"),
            (FN, "method_definition", "size"),
            (FN, "method_definition", "load"),
            (FN, "method_definition", "items"),
            (FN, "method_definition", "#secret"),
        ),
    ),
    Block(
        "const make_{i} = function () { return «/no\\(\\) => {}/»; };\nconst add_{i} = (a, b) => a + b;\n"
        "const list_{i} = items.map(x => x + 1);\nfunction* gen_{i}() {}\n«// {line}»\n",
        (
            (FN, "function_expression", None),
            (FN, "arrow_function", None),
            (FN, "arrow_function", None),
        ),
    ),
    Block(
        "const obj_{i} = {\n    run(a) { return a; },\n    key: (q) => q,\n    other: class Inner {},\n};\n"
        "const text_{i} = «`class Fake {} () => {quoted}`»;\n«/* function no() {} {line_c} */»\n",
        ((FN, "method_definition", "run"), (FN, "arrow_function", None)),
    ),
    Block(
        "const mixed_{i} = «`a ${»rows.map(r => «`<b>${»r«}</b>`»)«} class Fake {} {quoted}`»;\n«// {line}»\n",
        ((FN, "arrow_function", None),),
    ),
)

_TYPESCRIPT_BLOCKS = (
    Block(
        "interface Shape_{i} {\n    area(scale: number): number;\n    done: (x: number) => void;\n}\n«// {line}»\n",
        (),
    ),
    Block(
        "type Fn_{i} = (a: string) => void;\nfunction take_{i}(cb: (x: number) => string, n?: number): (y: string) => void {\n"
        "    const f: (z: string) => void = (z) => {};\n    return f;\n}\n«// {line}»\n",
        ((FN, "function_declaration", "take_{i}"), (FN, "arrow_function", None)),
    ),
    Block(
        "abstract class Base_{i} {\n    abstract run(): void;\n    private handler: (e: Event) => void;\n"
        "    protected stop(code: number): Promise<void> { return null; }\n}\n«// {line}»\n",
        ((FN, "method_definition", "stop"),),
    ),
    Block(
        "class Hub_{i} {\n    private cb: ((x: number) => void) | null = null;\n"
        "    private subs: ((x: number) => void)[] = [];\n"
        "    private map: { [k: string]: (x: number) => void } = {};\n"
        "    handler: (e: Event) => void\n    go() {}\n}\n"
        "let v_{i}: ((a: number) => string) | undefined;\nlet w_{i}: { a: () => void; b: () => void };\n"
        "declare const x_{i}: (a: number) => void\n"
        "function f_{i}(): { a: () => void } { return v; }\n«// {line}»\n",
        (
            (TYPE, "class_declaration", "Hub_{i}"),
            (FN, "method_definition", "go"),
            (FN, "function_declaration", "f_{i}"),
        ),
    ),
    Block(
        "function pick_{i}<T extends { a: string; f: (x: T) => void }>(x: T): T { return x; }\n"
        "class Lazy_{i} {\n    on?: (x: number) => Foo\n    with(a: number) {}\n"
        "    get<K extends { b: Array<K> }>(k: K): { c: K } { return go(k); }\n}\n"
        "let later_{i}: (a: number) => Foo\n«// {line}»\n",
        (
            (FN, "function_declaration", "pick_{i}"),
            (TYPE, "class_declaration", "Lazy_{i}"),
            (FN, "method_definition", "with"),
            (FN, "method_definition", "get"),
        ),
    ),
    *_SCRIPT_COMMON,
)

_JAVA_BLOCKS = (
    Block(
        "@interface Mark_{i} {\n    class In_{i} { void f() {} }\n    String value() default «\"x\"»;\n"
        "    int[] n() default {1, 2};\n}\n«// {line}»\n",
        ((TYPE, "class_declaration", "In_{i}"), (FN, "method_declaration", "f")),
    ),
    Block(
        "public class Holder_{i}<T> extends Base {\n    private int value = compute(3);\n"
        "    public Holder_{i}(int value) { super(value); }\n"
        "    public <R extends Comparable<R>> List<R> get(Map<String, R> m, int[] a) throws IOException {\n"
        "        «// {line}»\n        foo(«\"void no() {} {quoted}\"»);\n        return new ArrayList<R>(a.length) {};\n    }\n}\n",
        (
            (TYPE, "class_declaration", "Holder_{i}"),
            (FN, "constructor_declaration", "Holder_{i}"),
            (FN, "method_declaration", "get"),
        ),
    ),
    Block(
        "interface Shape_{i} {\n    double area();\n    default String name() { return String.valueOf(«'n'»); }\n}\n«// {line}»\n",
        (
            (TYPE, "interface_declaration", "Shape_{i}"),
            (FN, "method_declaration", "area"),
            (FN, "method_declaration", "name"),
        ),
    ),
    Block(
        "enum Kind_{i} {\n    ONE(1) { int id() { return 1; } },\n    TWO(2) { int id() { return 2; } };\n"
        "    abstract int id();\n}\n«// class No {line}»\n",
        (
            (FN, "method_declaration", "id"),
            (FN, "method_declaration", "id"),
            (FN, "method_declaration", "id"),
        ),
    ),
    Block(
        "enum Op_{i} implements Run {\n    ONE(«\"x\"») { public void run() {} };\n    Op_{i}(String s) {}\n}\n"
        "@interface Tag_{i} {\n    String value() default «\"{quoted}\"»;\n    class In_{i} { void go() {} }\n}\n«// {line}»\n",
        (
            (FN, "method_declaration", "run"),
            (FN, "constructor_declaration", "Op_{i}"),
            (TYPE, "class_declaration", "In_{i}"),
            (FN, "method_declaration", "go"),
        ),
    ),
    Block(
        "record Point_{i}(int x, int y) {}\n@interface Mark_{i} { String value(); }\n"
        "abstract class Part_{i} {\n    «/* interface No {line_c} */»\n    abstract void run(Runnable r);\n"
        "    void go() { synchronized (this) { run(() -> go()); } do step(); while (true); }\n}\n",
        (
            (TYPE, "class_declaration", "Part_{i}"),
            (FN, "method_declaration", "run"),
            (FN, "method_declaration", "go"),
        ),
    ),
)

# Opening lines give even a one-line document enough evidence of its language.
HEADS = {
    S.RUST: "use std::fmt;\n#[derive(Debug)]\nmod tests;\n",
    S.GO: "package main\n\nimport (\n\t«\"fmt\"»\n)\n\n",
    S.PYTHON: "import os\nfrom sys import path\n\nif __name__ == «\"__main__\"»:\n    pass\n\n",
    S.JAVASCRIPT: "export const version = 1;\nconst fs = require(«\"fs\"»);\n",
    S.TYPESCRIPT: "export const version: number = 1;\nimport type { A } from «\"a\"»;\n",
    S.JAVA: "package a.b;\n\nimport java.util.List;\n\n",
}
BLOCKS = {
    S.RUST: _RUST_BLOCKS,
    S.GO: _GO_BLOCKS,
    S.PYTHON: _PYTHON_BLOCKS,
    S.JAVASCRIPT: _SCRIPT_COMMON,
    S.TYPESCRIPT: _TYPESCRIPT_BLOCKS,
    S.JAVA: _JAVA_BLOCKS,
}

# Slot of a document in the mixed corpus: (language of the code, extension).
# The seventh is a script without extension, the eighth plain prose; in the ninth content
# and extension disagree.
SLOTS = (
    (S.RUST, ".rs"),
    (S.GO, ".Go"),
    (S.PYTHON, ".py"),
    (S.JAVASCRIPT, ".mjs"),
    (S.TYPESCRIPT, ".TS"),
    (S.JAVA, ".java"),
    (S.PYTHON, ""),
    (None, ".spec.txt"),
    (S.PYTHON, ".js"),
)
SHEBANG = "#!/usr/bin/env python3\n"
FOLDERS = ("a/", "a-b/", "src/main/x/", ".git/", "_gen/", "", "a/b.d/")
QUOTE_CHARACTERS = "\"'`\\$*/"
INVALID_EVERY = 97
LINKED_EVERY = 11


def strip_marks(text: str) -> str:
    return text.replace("«", "").replace("»", "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_text(value: str) -> str:
    """SQL literal; a dollar sign as its code, or ``${...}`` would be substituted."""
    escapes = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\t": "\\t", "$": "\\u0024"}
    return "'" + "".join(escapes.get(c, c) for c in value) + "'"


# What stands for each placeholder, as SQL over the lambda variables ``line`` and ``i``.
_PLACEHOLDERS = {
    "i": "i",
    "line": "line",
    "quoted": "translate(line, " + _sql_text(QUOTE_CHARACTERS) + ", '')",
    "line_c": "translate(line, '*/', '')",
    "word": r"regexp_extract(line, r'\p{L}+', 0)",
}


def _sql_block(text: str) -> str:
    """A template as one SQL concatenation."""
    parts = re.split(r"\{(i|line|quoted|line_c|word)\}", text)
    values = [_sql_text(p) if n % 2 == 0 else _PLACEHOLDERS[p] for n, p in enumerate(parts)]
    return "concat(" + ", ".join(values) + ")"


def render(text: str, head: str, blocks: tuple[Block, ...]) -> Column:
    """Code of one document: the head, then a block per line of ``text`` in turn."""
    choices = " ".join(f"WHEN {v} THEN {_sql_block(b.text)}" for v, b in enumerate(blocks))
    return F.expr(
        f"concat({_sql_text(strip_marks(head))}, array_join(transform(split({text}, '\\n'), "
        f"(line, i) -> CASE i % {len(blocks)} {choices} END), ''))"
    )


def mixed_content(doc_id: Column) -> Column:
    content = F.when(F.lit(False), F.lit(""))
    for slot, (language, extension) in enumerate(SLOTS):
        if language is None:
            code = F.col("text")
        else:
            head = HEADS[language] if extension else SHEBANG + HEADS[language]
            code = render("text", head, BLOCKS[language])
        content = content.when(doc_id % len(SLOTS) == slot, code)
    return content


def mixed_path(doc_id: Column, source: Column) -> Column:
    folder = F.element_at(
        F.array(*(F.lit(f) for f in FOLDERS)), (doc_id % len(FOLDERS) + 1).cast("int")
    )
    extension = F.element_at(
        F.array(*(F.lit(e) for _, e in SLOTS)), (doc_id % len(SLOTS) + 1).cast("int")
    )
    return F.concat(F.lit("corpus/"), source, F.lit("/"), folder, F.lit("d"), doc_id, extension)


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, spread over the languages; some linked, some not valid UTF-8."""
    doc_id = F.col("doc_id")
    invalid = doc_id % INVALID_EVERY == INVALID_EVERY - 1
    code = mixed_content(doc_id).cast("binary")
    rendered = documents(spark, sf_dir).select(
        mixed_path(doc_id, F.col("source")).alias("path"),
        F.when(invalid, F.concat(code, F.lit(b"\xff\xfe"))).otherwise(code).alias("content"),
        (doc_id % LINKED_EVERY == 0).alias("linked"),
    )
    return table.source_files(rendered, via_link="linked", root="corpus")


def files_in(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """All documents as files of one language."""
    extension = next(e for lang, e in SLOTS if lang == language)
    code = render("text", HEADS[language], BLOCKS[language])
    return _numbered(documents(spark, sf_dir), F.lit(extension), code)


# --- special corpora, all over the whole table ------------------------------

PLAIN_EXTENSIONS = ((S.RUST, ".rs"), (S.GO, ".go"), (S.PYTHON, ".py"),
                    (S.JAVASCRIPT, ".js"), (S.TYPESCRIPT, ".ts"), (S.JAVA, ".java"))

NESTED_BLOCK = Block(
    "function outer_{i}() {\n«// {line}»\nconst arrow_{i} = () => {\n",
    ((FN, "function_declaration", "outer_{i}"), (FN, "arrow_function", None)),
)

COMMENT_BLOCKS = {
    language: Block("«# {line}»\n" if language == S.PYTHON else "«// {line}»\n", ())
    for language, _ in PLAIN_EXTENSIONS
}

BROKEN_BLOCKS = {
    S.RUST: Block("fn broken_{i}( { «// {line}»\n", ()),
    S.GO: Block("func broken_{i}( { «/* {line}»\n", ()),
    S.PYTHON: Block("def broken_{i}(: «# {line}»\n", ()),
    S.JAVASCRIPT: Block("function broken_{i}( { «// {line}»\n", ()),
    S.TYPESCRIPT: Block("function broken_{i}( { «// {line}»\n", ()),
    S.JAVA: Block("void broken_{i}( { «/* {line}»\n", ()),
}

UNICODE_BLOCKS = {
    S.RUST: Block("fn 関é{word}_{i}() {}\nstruct 型{word}_{i};\n", ()),
    S.GO: Block("func 関é{word}_{i}() {}\ntype 型{word}_{i} struct{}\n", ()),
    S.PYTHON: Block("def 関é{word}_{i}():\n    pass\nclass 型{word}_{i}:\n    pass\n", ()),
    S.JAVASCRIPT: Block("function 関é{word}_{i}() {}\nclass 型{word}_{i} {}\n", ()),
    S.TYPESCRIPT: Block("function 関é{word}_{i}() {}\nclass 型{word}_{i} {}\n", ()),
    S.JAVA: Block("class 型{word}_{i} { void 関é{word}_{i}() {} }\n", ()),
}


def _numbered(docs: DataFrame, extension: Column, code: Column) -> DataFrame:
    path = F.concat(F.lit("corpus/d"), F.col("doc_id"), extension)
    return table.source_files(docs.select(path.alias("path"), code.alias("content")), root="corpus")


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One function inside the other, as deep as the document has lines."""
    opened = render("text", HEADS[S.JAVASCRIPT], (NESTED_BLOCK,))
    code = F.concat(opened, F.repeat(F.lit("}"), 2 * F.size(F.split("text", "\n"))))
    return _numbered(documents(spark, sf_dir), F.lit(".js"), code)


def plain_files(
    spark: SparkSession, sf_dir: str, blocks: dict[str, Block], empty_even: bool = False
) -> DataFrame:
    """One block per line, without a head; the language follows from the extension."""
    doc_id = F.col("doc_id")
    code = F.when(F.lit(False), F.lit(""))
    if empty_even:
        code = F.when(doc_id % 2 == 0, F.lit(""))
    extension = F.when(F.lit(False), F.lit(""))
    for slot, (language, suffix) in enumerate(PLAIN_EXTENSIONS):
        chosen = doc_id % len(PLAIN_EXTENSIONS) == slot
        code = code.when(chosen, render("text", "", (blocks[language],)))
        extension = extension.when(chosen, F.lit(suffix))
    return _numbered(documents(spark, sf_dir), extension, code)
