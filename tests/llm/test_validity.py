"""The parsers against each other's languages, against Python's own, and on what must and must not parse."""

from __future__ import annotations

import ast
import glob
import json
import sysconfig
import tomllib

import pytest

from seamark.llm import validity as V
from seamark.llm.grammar.data import json_errors, toml_errors
from seamark.llm.grammar.go import go_errors
from seamark.llm.grammar.python import python_errors
from seamark.llm.grammar.rust import rust_errors
from seamark.llm.grammar.typescript import typescript_errors

GOOD = {
    rust_errors: [
        "", "#!/bin/x\nfn main() {}", "use a::{self, b::*, c as d}; mod m; pub(crate) struct S<'a, T: ?Sized + 'a, const N: usize = 3>(pub &'a T, [u8; N]) where T: Clone;",
        "impl<T> Tr<T> for Vec<Vec<T>> where for<'a> &'a T: Fn(&'a u8) -> u8 { type X = u8; const C: u8 = 1; unsafe extern \"C\" fn f(mut self: Box<Self>, (a, b): (u8, u8)) -> impl Iterator<Item = u8> + '_ { a..=b } }",
        "fn f() { let Some(x) = y else { return }; if let Some(a) = b && c { } match x { 0 | 1 => (), n if n > 3 => { } [a, .., b] => {} S { x, .. } => 1, 'a'..='z' => 2, _ => {} } 'l: loop { break 'l; } }",
        "fn f() -> u8 { let c = |x: u8| -> u8 { x }; let s = S { a: 1, ..d }; x.y::<Vec<_>>()?.await.0[1] as u8 + 2; unsafe { *p = -1 }; vec![1, 2; 3]; return; }", "macro_rules! m { ($x:expr) => { $x }; } m!{ } m![1];",
        "enum E { A = 1, B(u8), C { x: u8 }, } trait T: A + B { fn f(&self) -> u8; fn g() {} } extern crate a; static mut X: u8 = 0; union U { a: u8 } type F = fn(&u8, ...) -> !;", "fn f() { a < b; if a == b { c } else if d { e } else { f } }",
        "/* a /* b */ c */ fn f() { r#\"}\"#; b'x'; '\\''; 1.0e3f64; 0xffu8; x.0.1; }", "async fn f() { for i in (0..n).rev() { } while let Some(x) = s.pop() { } }",
    ],
    go_errors: [
        "package a", "package a\nimport (\n\t\"x\"\n\t. \"y\"\n)\nvar a, b = 1, 2\nconst (\n\tA = iota\n\tB\n)\n", "package a\ntype T[K comparable, V any] struct {\n\tA, B int `x`\n\t*E\n}\ntype I interface { ~int | string; F(int) (a, b string); E }\n",
        "package a\nfunc (t *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tfor i := range 10 {\n\t}\n\tfor i, v := range s { _ = v }\n\tfor i := 0; i < 3; i++ { continue }\n\tfor {\n\t}\nL:\n\tfor x < 3 { break L }\n\treturn\n}\n",
        "package a\nfunc f() {\n\tif x := g(); x != nil {\n\t} else if y {\n\t} else {\n\t}\n\tswitch x := y.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase v, ok := <-c:\n\tcase c <- 1:\n\t}\n\tgo func() { defer h() }()\n\ta := []map[string]int{{\"x\": 1}, nil}\n\tb := T{A: 1}\n\tc.d[1:2:3].e(f...)\n\tp := &x[1]\n\t*p = <-c\n}\n",
        "package a\nfunc f() { if (T{}) == x { }; switch { case a: fallthrough; default: } }\nfunc g[T any](x T) {}\nvar f2 func(int) chan<- int\n", "package a; var x = struct{a int}{1}; var y = [...]int{1,\n2,\n}",
    ],
    typescript_errors: [
        "", "import a, { b as c, type D } from './x'; import * as q from \"y\"; import './z'; export default class {} export * from 'a'; export { x, y as default };", "const f = async <T,>(a: T, ...b: any[]): Promise<T> => { await a; };",
        "class A<T> extends B<T> implements C, D { private readonly x?: number = 1; static #p = 2; constructor(public a: string) { super(); } get v(): number { return 1 } async *g() {} [k: string]: any; static { } abstract m(): void }",
        "type X<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]?: T[K] } & `a${string}`; interface I extends A, B { (x: number): string; new (): I; m?(): void; get x(): number }", "enum E { A = 1, B, 'c' = 2 } declare module 'x' { export const y: number } namespace N.M { }",
        "let a = b ? (c) : d => e\nlet x = <any>y, z = w as const, v = u!\nfor (const [k, v] of o) { } for (let i = 0, n = 3; i < n; i++) ; for (var p in q) { } do { } while (x)\nlabel: while (1) { continue label }",
        "const re = /[{(]+x/g, t = `{ ${a.map((v: string) => `<${v}>`).join('')} `; a = b / c / d; if (x) return_1(); switch (a) { case 1: break; default: }", "try { } catch { } finally { }\nthrow new Error(`x ${String(e)}`)", "f<string>(x); a < b; c > d; new Map<string, Array<number>>(); x?.y?.[1]?.(); a ??= b ?? c; x = y\n++z",
        "function f(this: A, { a, b: [c] = [] }: T = {}): x is string { return a! } export const o = { 'it\\'s': 1, [k]: 2, get z() { return 1 }, async m() {}, ...r, s };", "let u: typeof import('x'); let g: (a: number) => void = () => {}; let h: [a: string, b?: number, ...c: any[]]", "@dec() class A { @p() x = 1; @m method() {} }",
    ],
    json_errors: ["1", '{"a": [1, -2.5e3, true, null, "\\u00e9"]}', "[]", " {} \r\n", "[" * 500 + "]" * 500],
    toml_errors: ["", "a = 1\n[b.c]\nd = 'x'\n[[e]]\nf = [1,\n 2, # c\n]\n", "a.\"b c\".d = { x = 1, y = \"z\" }\nt = 1979-05-27T07:32:00Z\nu = 1979-05-27 07:32:00.5\nf = -1_000.5e3\nh = 0xFF\ni = inf\ns = \"\"\"a\n\"q\" \\\n  b\"\"\"\nl = '''\n<<<<<<< HEAD\n'''\n", "1 = 2\ntrue = false\n"],
}
BAD = {
    rust_errors: ["fn f() {", "fn f() }", "let x = 1;", "fn f() { let = 1; }", "fn f() { a b }", "struct S { a u8 }", "fn f( {}", "<<<<<<< HEAD\nfn f() {}\n", "fn f() { \"x }", "fn f() { /* /* */ }", "use a", "fn f() { match x { 1 => } }", "impl { fn }", "fn f() { if { } }", "#[a]", "def f():\n  pass", "fn f() { (a }"],
    go_errors: ["", "func f() {}", "package a\nfunc f() {", "package a\nx := 1", "package a\nfunc f()\n{\n}", "package a\nfunc f() { a b }", "package a\nfunc f() { x = }", "package a\nvar x = [1, 2}", "package a\nfunc f() { s := \"a\n }", "package a\n<<<<<<< ours\n", "package a\nfunc f() { for i := 0; i < 3 { } }", "package a\nfunc f() { x := []int{1,\n2\n} }", "package a\nvar x = 1\nimport \"y\"", "package a\nfunc f() { `x }", "package a\nfunc f() { if x { } else y }"],
    typescript_errors: ["function f( {", "const = 1", "let x = ;", "class A { x: }", "import { a from 'b'", "const a = `x ${b`;", "if (a { }", "a b c", "=======\n", "function f() { } }", "const s = 'abc\n'", "x = = y", "return (", "interface A { x: string", "type X = ;", "const { a: } = b", "def f():\n  pass", "1 = x", "# heading"],
    json_errors: ["", " ", "{", "[1,]", '{"a" 1}', "{'a': 1}", "01", "[1] 2", '"\n"', "NaN", '{"a":1,}', "// c\n{}", "+1", '"\\x"', "tru", "[" * 30, "1." ],
    toml_errors: ["a", "a =", "= 1", "a = 1 b = 2", "[a", "a = 'x", "a = [1, 2", "a = 01", "a = \"\"\"x", "<<<<<<< HEAD", "a = tru", "[[a]", "a = {x = 1", "a = 1.", "a = \"\\q\"", "a b = 1"],
    python_errors: ["def f(:\n pass", "if x\n  y", "def f():\nreturn 1", "  x = 1", "x = (1", "x = 1)", "print 'a'", "class A\n  pass", "\tif x:\n        y", "x = 'a", "a = 1 +", "for x y:\n pass", "1abc = 2", "f(a=1, b)", "x = [1, 2", "try:\n  x", "lambda: = 1", "a b", "<<<<<<< HEAD\n", "f'{'", "f'{}'", "def f(a=1, b): pass", "1 = x", "x +=", "import", "@a\nx", "if x:\n    a\n  b", "return = 1", "\0"],
}


@pytest.mark.parametrize(("check", "text"), [(c, t) for c, ts in GOOD.items() for t in ts])
def test_valid(check, text):
    assert check(text) == []


@pytest.mark.parametrize(("check", "text"), [(c, t) for c, ts in BAD.items() for t in ts])
def test_invalid(check, text):
    assert check(text)


def test_python_agrees_with_its_own_parser():
    files = sorted(glob.glob(sysconfig.get_path("stdlib") + "/*.py"))
    wrong = 0
    for f in files:
        text = open(f, encoding="utf-8").read()
        ast.parse(text)
        wrong += bool(python_errors(text))
        # broken by a cut inside of it: whatever Python says must be said here
        cut = text[: len(text) // 2]
        try:
            ast.parse(cut)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        assert (not python_errors(cut)) == ok, f
    assert wrong == 0
    for t in GOOD[json_errors]:
        json.loads(t)
    for t in GOOD[toml_errors]:
        tomllib.loads(t)
    for t in BAD[toml_errors]:
        with pytest.raises(tomllib.TOMLDecodeError):
            tomllib.loads(t)
    for t in BAD[python_errors]:
        with pytest.raises((SyntaxError, ValueError)):
            ast.parse(t)


def test_fields_of_formatted_strings():
    """Quotes and line ends within fields, as the grammar has had them since 3.12."""
    good = [
        "x = f'{f' {d}\\n' if d else ''} def {n}({a}){r}:\\n{b}'\n", "f'{a['b']}'\n", "f'{a\n+ b}'\n", 'f"{x:{w}.{p}}"\n', "f'{ {1: 2}[1] }'\n", "rf'{x!r:>{w}}' 'b'\n", "f'{f'{f'{1}'}'}'\n", 'f"""{\nx\n}"""\n', "f'{{}}'\n",
        "f'{(lambda y: y)(1)}'\n",
    ]
    bad = ["f'{a['\n", "f'{a'\n", "f'{f'{a'}'\n", "f'{}'\n", "f'{a b}'\n", "f'}'\n", "x = f'{a['b']\n"]
    for t in good:
        ast.parse(t)
        assert python_errors(t) == [], t
    for t in bad:
        with pytest.raises(SyntaxError):
            ast.parse(t)
        assert python_errors(t), t


def test_recovery_finds_all_errors():
    assert len(rust_errors("fn a() { let = 1; let y = 2; let = 3; }\nfn b( {}\nfn c() {}")) >= 3
    assert len(go_errors("package a\nfunc f() {\n\tx = = 1\n\ty := 2\n\tz = = 3\n}\nfunc g() {}\n")) == 2
    assert len(python_errors("def f() x:\n    pass\nx = 1\ny = = 2\n")) == 2
    assert len(typescript_errors("const = 1;\nlet b = 2;\nconst = 3;\n")) == 2


def test_other_languages_are_refused():
    py, rs, ts, go = "import os\n\ndef f(a):\n    return a\n", "use a::b;\n\npub fn f(a: u8) -> u8 { a }\n", "import { a } from 'b';\nexport const x: number = 1;\n", 'package a\n\nimport "fmt"\n\nfunc F() { fmt.Println() }\n'
    for check, own in ((python_errors, py), (rust_errors, rs), (typescript_errors, ts), (go_errors, go)):
        assert check(own) == []
        for other in (py, rs, ts, go, "# Title\n\nSome text.\n", "<!DOCTYPE html>\n<html></html>\n", '{"a": 1}\n[b]\n'):
            # a mapping and a list are statements of Python too
                assert other == own or check(other) or (check is python_errors and other.startswith("{")), (check, other)


def test_long_chains_and_deep_nesting_are_valid(spark):
    n, deep = 1500, 5000
    bodies = [
        ("a.go", "package a\nfunc f(x int) {\n\tif x == 0 {\n\t}" + "".join(f" else if x == {i} {{\n\t}}" for i in range(n)) + " else {\n\t}\n}\n"),
        ("a.ts", "if (x == 0) {\n}" + "".join(f" else if (x == {i}) {{\n}}" for i in range(n)) + " else {\n}\n"),
        ("b.ts", "if (a) if (b) c(); else d(); else if (e) f(); else g();\n"),
        ("b.go", "package a\n\nvar x = " + "(" * deep + "1" + ")" * deep + "\n"),
        ("c.ts", "x = " + "[" * deep + "]" * deep + ";\n"),
        ("a.rs", "fn f() " + "{" * deep + "}" * deep),
        ("a.toml", "x = " + "[" * deep + "]" * deep + "\n"),
        ("a.py", "x = " + "(" * deep + "1" + ")" * deep + "\n"),
        ("a.json", '{"a":' * deep + "1" + "}" * deep),
        ("d2.ts", "const f = " + "() => (" * deep + "1" + ")" * deep + ";\n"),
        ("b.rs", "type A = " + "Vec<" * deep + "u8" + ">" * deep + ";\n"),
    ]
    broken = [("d.go", bodies[0][1].replace("else {", "else else {")), ("d.ts", bodies[1][1] + "else {}\n"), ("d.rs", bodies[5][1][:-1]), ("d.py", bodies[7][1].replace("1", "1 1"))]
    src = spark.createDataFrame([(i, "r", *x) for i, x in enumerate(bodies + broken)], "source_id long, repo string, path string, body string")
    assert {r["source_id"] for r in V.check_sources(src).filter("NOT valid").collect()} == {11, 12, 13, 14}


def test_files(spark):
    rows = [
        (1, "r", "a.py", "x = 1\n", 5), (1, "r", "a.py", "x = 1\n", 5), (2, "r", "a.PY", "x = (", 5), (3, "r", "a.json", "", 5), (4, "r", "a.rs", "", 5), (5, "r", "a.md", "anything <<<<<<<", 5), (6, "r", "a.go", None, 5), (7, "r", "a.xyz", "?", 5), (8, "r", None, "x", 5),
        (9, None, "b.toml", "a = ", None), (10, "r", "deep.py", "(" * 5000 + ")" * 5000, 5), (11, "r", "deep.json", "[" * 100_000 + "]" * 100_000, 5), (12, "r", "c.rs", "<<<<<<< HEAD\nfn a() {}\n=======\n>>>>>>> b\n", 5), (13, "r", "long.py", "x = [" + "1, " * 300_000 + "]", 5), (14, "r", "e.go", "", 5), (15, "r", "f.go", "\n", 5), (16, "r", "g.go", "// only a comment\n", 5),
    ]
    src = spark.createDataFrame(rows, "source_id long, repo string, path string, body string, valid int")
    got = {r["source_id"]: r for r in V.check_sources(src).collect()}
    assert {k for k, r in got.items() if not r["valid"]} == {2, 3, 9, 12, 16}
    assert set(got) == {1, 2, 3, 4, 5, 9, 10, 11, 12, 13, 14, 15, 16} and got[12]["cause"] == "merge conflict" and got[2]["cause"] == "truncated" and got[2]["errors"]
    rates = {(r["repo"], r["lang"]): r["invalid"] for r in V.acceptance(V.check_sources(src)).filter("level = 0").collect()}
    assert rates[("r", "python")] == 1 and rates[(None, "toml")] == 1
    assert V.check_sources(src.limit(0)).count() == 0 and V.acceptance(V.check_sources(src)).filter("level = 3").first()["files"] == 13
