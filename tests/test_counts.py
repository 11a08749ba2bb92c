"""Exact counts per language: ordinary code, look-alikes, odd layouts."""

from helpers import counted, snippet_counts

from declcensus.operators import counts

# (name, language, text, functions, types)
CASES = [
    # --- Rust
    ("rust items", "Rust", "fn a() {}\npub fn b(x: i32) -> i32 { x }\nstruct S { v: i32 }\nenum E { A, B }\n", 2, 2),
    ("rust tuple and unit structs", "Rust", "struct A(i32);\nstruct B;\npub(crate) struct C<T>(T);\n", 0, 3),
    ("rust trait signature", "Rust", "trait T { fn a(&self); fn b(&self) -> i32 { 1 } }", 1, 0),
    ("rust extern block", "Rust", 'extern "C" { fn puts(s: *const u8) -> i32; }\npub unsafe extern "C" fn cb(x: i32) {}\n', 1, 0),
    ("rust not counted kinds", "Rust", "trait T {}\nunion U { a: i32 }\ntype A = fn(i32) -> i32;\nimpl T for A {}\nmod m {}\n", 0, 0),
    ("rust generics with Fn bound", "Rust", "fn f<F: Fn(i32) -> i32, T>(f: F) -> T where F: Send { f(1) }", 1, 0),
    ("rust array types in header", "Rust", "fn f(a: [u8; 3]) -> [u8; 3] where [u8; 3]: Copy { a }", 1, 0),
    ("rust nested fn", "Rust", "fn a() { fn b() { fn c() {} } }", 3, 0),
    ("rust closures", "Rust", "fn a() { let f = |x| x + 1; let g = move || { 1 }; }", 1, 0),
    ("rust fn pointer types", "Rust", "struct S { f: fn(i32) -> i32, g: Box<dyn Fn(i32)> }", 0, 1),
    ("rust macro bodies", "Rust", "macro_rules! m { ($n:ident) => { fn $n() {} struct Q; } }\nquote! { fn q() {} }\nfn r() { vec![1]; assert!(a != (b)); }", 1, 0),
    ("rust lifetimes and chars", "Rust", "fn f<'a>(x: &'a str) -> char { let c = '{'; let q = '\\''; 'x' }\nfn g() {}", 2, 0),
    ("rust raw strings", "Rust", 'fn f() { let s = r#"fn no() { "x" } struct N;"#; let b = br"struct M;"; }\nstruct Y;', 1, 1),
    ("rust nested comment", "Rust", "/* a /* fn no() {} */ struct N; */ fn yes() {}", 1, 0),
    ("rust multi line string", "Rust", 'fn f() { let s = "line\nfn no() {}\n\\" struct N;"; }', 1, 0),
    ("rust comment marker in string", "Rust", 'fn f() { let u = "http://x"; }\nfn g() {}', 2, 0),
    ("rust raw identifier", "Rust", "fn r#type() {}\nstruct r#struct {}", 1, 1),
    ("rust async const unsafe", "Rust", "async fn a() {}\nconst fn b() {}\nunsafe fn c() {}\npub(super) async unsafe fn d() {}", 4, 0),
    ("rust multi line header", "Rust", "fn long(\n    a: i32, // one\n    b: Vec<(i32, String)>,\n) -> Result<(), Box<dyn Error>>\nwhere\n    T: Clone,\n{\n}\n", 1, 0),
    ("rust broken header", "Rust", "fn open( { // oops", 0, 0),
    ("rust unicode", "Rust", "fn größe_数() {}\nstruct Größe型 { 値: String }", 1, 1),
    # --- Go
    ("go functions and methods", "Go", "package p\nfunc A() {}\nfunc (r *T) B(x int) (int, error) { return 0, nil }\nfunc (T) C() {}\n", 3, 0),
    ("go literals and types", "Go", "func a() { f := func(x int) int { return x }; go func() {}(); defer func() {}() }\nvar F func(int) error\ntype H func(a int) (b int)\n", 1, 0),
    ("go interface methods", "Go", "type W interface {\n\tWrite(p []byte) (n int, err error)\n\tClose() error\n}\n", 0, 0),
    ("go structs", "Go", "type A struct{}\ntype B struct {\n\tC struct{ d int }\n\tf func() struct{}\n}\ntype D = struct{}\ntype E []struct{}\ntype G *struct{}\n", 0, 2),
    ("go grouped types", "Go", "type (\n\tA struct {\n\t\tB struct{ x int }\n\t}\n\n\tC int // note\n\tD interface{ M(struct{}) }\n\tE[K comparable, V any] struct{ k K }\n\tF = struct{}\n)\nfunc f() { type (\n\tL struct{}\n) }\n", 1, 3),
    ("go one line group", "Go", "type ( A struct{}; B int; C struct{} )", 0, 2),
    ("go generics", "Go", "func Map[K comparable, V any](m map[K]V) []K { return nil }\ntype Set[T comparable] struct{ m map[T]struct{} }\nfunc (s *Set[T]) Add(t T) {}\n", 2, 1),
    ("go without body", "Go", "func asm(x int) int\n", 1, 0),
    ("go strings and runes", "Go", "func a() { s := `func no() {}\ntype N struct{}`; r := '\"'; t := \"func x() {}\" }\nfunc b() {}\n", 2, 0),
    ("go local types", "Go", "func a() { type point struct{ x, y int }; v := struct{ a int }{1} }", 1, 1),
    # --- Python
    ("python functions", "Python", "def a():\n    pass\n\nasync def b(x, *, y=(1, 2)):\n    pass\n\nf = lambda x: x\n", 2, 0),
    ("python classes", "Python", "class A:\n    def m(self) -> int: return 1\n\n    class B(A, metaclass=M):\n        pass\n\nclass C[T]: pass\n", 1, 3),
    ("python decorated", "Python", "@dec(a, b)\n@staticmethod\ndef f(): pass\n@dec\nclass C: pass\n", 1, 1),
    ("python strings", "Python", 's = """\ndef no():\n    pass\nclass N: pass\n"""\nt = \'\'\'def no(): pass\'\'\'\nu = "# \\" def x():"\nr = r"\\"\ndef yes(): pass\n', 1, 0),
    ("python comments", "Python", "# def no(): pass\nx = 1  # class N:\ndef yes():  # def no2():\n    pass\n", 1, 0),
    ("python multi line header", "Python", "def f(\n    a: int = 1,  # one\n    b: Callable[[int], str] = lambda q: (q),\n) -> Dict[str, int]:\n    pass\n", 1, 0),
    ("python attribute names", "Python", "x.def_ = 1\nclassify(3)\ndefine = 2\n", 0, 0),
    ("python quote mix", "Python", "a = \"it's\"\nb = 'say \"hi\"'\ndef f(): pass\nc = 'x' # don't\ndef g(): pass\n", 2, 0),
    # --- JavaScript
    ("js forms", "JavaScript", "function a() {}\nconst b = function () {};\nconst c = function named() {};\nconst d = () => 1;\nconst e = async x => x;\nasync function f() {}\n", 6, 0),
    ("js generators", "JavaScript", "function* g() {}\nconst h = function* () {};\nclass A { *m() {} async *n() {} }\n", 2, 1),
    ("js methods", "JavaScript", "class A extends B {\n  constructor() { super(); }\n  get x() { return 1; }\n  set x(v) {}\n  static s() {}\n  async t() {}\n  #p() {}\n  [Symbol.iterator]() {}\n  'quoted'() {}\n  static { init(); }\n}\n", 8, 1),
    ("js object methods", "JavaScript", "const o = { a() {}, b: function () {}, c: () => {}, async d() {}, get e() { return 1; } };", 5, 0),
    ("js control flow", "JavaScript", "if (a) { b(); } else if (c) { } for (const x of y) { } while (z) { } switch (q) { case f(1): { } } try { } catch (e) { }\ndo { } while (x)\n", 0, 0),
    ("js class expressions", "JavaScript", "const A = class {};\nconst B = class C {};\nexport default class extends D {}\nfoo(class E {});\nexport class F {}\nexport default class G {}\n", 0, 2),
    ("js mixin", "JavaScript", "class A extends mix(B, C) {\n  m() {}\n}\nnew Foo(function () {});\n", 2, 1),
    ("js templates", "JavaScript", "const s = `function no() {} ${xs.map(x => `<${x}>`)} class N {}`;\nfunction yes() {}\n", 2, 0),
    ("js regex literals", "JavaScript", "const r = /[/'\"`]=>/g;\nconst q = s.replace(/\\/\\*/, '');\nfunction yes() {}\nconst d = a / b / c;\n", 1, 0),
    ("js comments", "JavaScript", "// function no() {}\n/* class N { m() {} } */\nconst u = 'http://x'; // () => {}\nfunction yes() {}\n", 1, 0),
    ("js nested parameters", "JavaScript", "function a(cb = () => { return (1); }, o = { m() {} }) {}\n", 3, 0),
    ("js jsx", "JavaScript", "function App() { return <div onClick={() => go()}>It's <b>fine</b></div>; }\nclass P { render() { return <p>x</p>; } }\n", 3, 1),
    ("js nested", "JavaScript", "function a() { function b() { const c = () => {}; return c; } return b; }", 3, 0),
    # --- TypeScript
    ("ts types are not functions", "TypeScript", "interface I { a(x: number): void; b: (y: string) => void; new (z: any): I }\ntype F = (a: number) => void;\ntype G = {\n  f: () => void;\n  g(x: number): string;\n}\n| null;\ndeclare function d(x: number): void;\nlet v: (a: number) => string;\n", 0, 0),
    ("ts typed functions", "TypeScript", "function a(x: number): number { return x; }\nconst b = (x: string): string => x;\nconst c = function (d: any): boolean { return !!d; };\nasync function e<T extends object>(x: T): Promise<T> { return x; }\n", 4, 0),
    ("ts callback parameters", "TypeScript", "function a(cb: (x: number) => void, n: number): void {}\nclass A {\n  constructor(private readonly f: (x: number) => string, public g?: () => void) {}\n  handler: (e: Event) => void;\n  opt?: () => void = undefined;\n  run = (x: number): void => {};\n}\n", 3, 1),
    ("ts function results", "TypeScript", "function a(): () => void { return () => {}; }\nconst b = (x: number): ((y: number) => void) => (y) => {};\n", 4, 0),
    ("ts type arguments", "TypeScript", "const m = new Map<string, (x: number) => void>();\nuseState<() => void>(() => {});\nconst c = x as (a: number) => string;\n", 1, 0),
    ("ts object values stay", "TypeScript", "const o = { a: 1, cb: (x: number) => x, d: y => y };\nfoo({ a: 1, cb: (x) => x });\nconst t = c ? a : (b: number) => b;\n", 4, 0),
    ("ts classes", "TypeScript", "abstract class A { abstract m(): void; n(): void {} }\nexport class B<T> extends A implements I {}\nenum E { X }\nnamespace N { export class C {} }\n", 1, 2),
    ("ts overloads", "TypeScript", "function f(a: string): void;\nfunction f(a: number): void;\nfunction f(a: any): void {}\nclass C { g(a: string): void; g(a: any): void {} }\n", 2, 1),
    ("ts object result type", "TypeScript", "class C { m(): { a: string; b: number } { return null; } n(x: { a: number }): x is D { return true; } }\n", 2, 1),
    # --- Java
    ("java members", "Java", "public class A {\n  private int x = f(1);\n  public A() {}\n  A(int x) { this.x = x; }\n  public static void main(String[] args) throws Exception { run(args); }\n  <T> T gen(List<T> l) { return l.get(0); }\n  int[] arr() { return new int[0]; }\n}\n", 5, 1),
    ("java abstract and interface", "Java", "abstract class A { abstract void a(); protected abstract <T> List<T> b(Map<String, T> m) throws E; }\ninterface I extends J { void c(); default int d() { return 1; } static void e() {} }\n", 5, 2),
    ("java not counted kinds", "Java", "enum E { A(1) { int v() { return 1; } }, B(2); E(int x) {} }\nrecord R(int a, int b) { R { } int sum() { return a + b; } }\n@interface M { String value() default \"\"; int n(); }\n", 3, 0),
    ("java statements", "Java", "class A { void m() { foo(1); return bar(2); } void n() { if (a) { } for (;;) { } while (b) { } do x(); while (c); switch (d) { case E: f(); default -> g(); } throw new X(1); } }\n", 2, 1),
    ("java anonymous and lambda", "Java", "class A { Runnable r = new Runnable() { public void run() { go(); } }; Runnable s = () -> { go(); }; Object o = new Foo(1) { int z() { return 1; } }; Class<?> c = A.class; }\n", 2, 1),
    ("java annotations", "Java", "class A {\n  @Override public String toString() { return \"\"; }\n  @Test(timeout = 5)\n  void t() {}\n  @Inject(x = @Q(1))\n  A(B b) {}\n}\n", 3, 1),
    ("java text block", "Java", 'class A { String s = """\n  class N { void no() {} }\n  """; char c = \'"\'; void yes() {} }\n', 1, 1),
    ("java comparison", "Java", "class A { boolean m() { boolean b = a > f(x); return g(y) && h < i(z); } }", 1, 1),
    ("java inner", "Java", "class A { class B { interface C { void m(); } } static class D {} }", 1, 4),
]


def test_cases(spark):
    got = snippet_counts(spark, [(n, l, t) for n, l, t, _, _ in CASES])
    wrong = {n: (got[n], (f, c)) for n, _, _, f, c in CASES if got[n] != (f, c)}
    assert not wrong


def test_declaration_rows_agree_with_counts(spark):
    rows = [(n, l, t.encode()) for n, l, t, _, _ in CASES]
    df = spark.createDataFrame(rows, "path string, language string, content binary")
    found = {}
    for r in counts.declarations(df).collect():
        f, c = found.get(r["path"], (0, 0))
        found[r["path"]] = (f + (r["category"] == "function"), c + (r["category"] == "class_struct"))
    wrong = {n: (found.get(n, (0, 0)), (f, c)) for n, _, _, f, c in CASES if found.get(n, (0, 0)) != (f, c)}
    assert not wrong


def test_empty_text_is_one_file_with_zeros(spark):
    got = counted(spark, {f"e.{x}": "" for x in ("rs", "go", "py", "js", "ts", "java")})
    assert len(got) == 6
    assert all(v[1:] == (0, 0) for v in got.values())


def test_many_functions(spark):
    text = "".join(f"fn function_{i}() {{}}\n" for i in range(1000))
    assert snippet_counts(spark, [("m", "Rust", text)])["m"] == (1000, 0)


def test_large_spans_do_not_overflow(spark):
    big = "x" * 2_000_000
    lines = "a b\n" * 400_000
    cases = [
        ("rust string", "Rust", f'fn a() {{ let s = "{big}"; }}\n'),
        ("rust escapes", "Rust", 'fn a() { let s = "' + '\\n' * 500_000 + '"; }\n'),
        ("rust comment", "Rust", f"/* {lines} */ fn a() {{}}\n"),
        ("rust body", "Rust", "fn a() { m!(" + "(x)," * 300_000 + "); }\n"),
        ("go raw", "Go", f"var s = `{lines}`\nfunc a() {{}}\n"),
        ("python docstring", "Python", f'"""{lines}"""\ndef a(): pass\n'),
        ("js template", "JavaScript", f"const s = `{lines}`;\nfunction a() {{}}\n"),
        ("js substitutions", "JavaScript", "const s = `" + "${x} y " * 200_000 + "`;\nfunction a() {}\n"),
        ("ts object", "TypeScript", "const o = {" + "a: (1)," * 200_000 + "};\nfunction a() {}\n"),
        ("java array", "Java", "class A { int[] x = {" + "f(1)," * 200_000 + "}; void a() {} }\n"),
        ("js parens", "JavaScript", "f(" + "(a)," * 300_000 + "1);\nfunction a() {}\n"),
    ]
    got = snippet_counts(spark, cases)
    assert {n: got[n][0] for n, _, _ in cases} == {n: 1 for n, _, _ in cases}
