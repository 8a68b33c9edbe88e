"""Grammars: valid and invalid texts per language, positions, and both evaluations of a grammar against each other."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import grammars, syntax

VALID = {
    "go": ["package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable] struct {\n\tA, B int `json:\"a\"`\n\t*sync.Mutex\n}\n\nfunc (t *T[K]) F(a, b int, c ...string) (int, error) {\n\tif x, ok := m[a]; !ok || x > 1 {\n\t\treturn 0, errors.New(\"}\")\n\t} else if y {\n\t}\n\tfor i := 0; i < 10; i++ {\n\t}\n\tfor k, v := range map[string][]int{\"a\": {1, 2}} {\n\t}\n\tswitch v := x.(type) {\n\tcase int, *T[K]:\n\t\tgo f(v)\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v, ok := <-d:\n\t}\nout:\n\tfor {\n\t\tbreak out\n\t}\n\tg := func(x int) func() { return nil }\n\tdefer func() { recover() }()\n\treturn a&^b, nil\n}\n"],
    "java": ["", "package a.b;\nimport static x.Y.*;\n@Ann(value = {1, 2}, x = @B)\npublic final class A<T extends Comparable<? super T>> extends B<T> implements C, D {\n  private final Map<String, List<int[]>> m = new HashMap<>();\n  static { x = 1; }\n  enum E { P(1) { void f() {} }, Q; int z; }\n  record R(int a, String b) implements C { R { } }\n  public <U> U f(final int a, String... b) throws X, Y {\n    for (int i = 0, j = 1; i < 3; i++, j--) if (a > 1) return null; else continue;\n    for (var x : xs) { }\n    try (var r = open(); s) { } catch (A | B e) { } finally { }\n    switch (a) { case 1, 2 -> f(); case 3 -> { } default -> throw new X(); }\n    switch (a) { case 1: case 2: f(); break; default: }\n    int y = switch (a) { case 1 -> 2; default -> { yield 3; } };\n    Runnable q = () -> {}; g((x, z) -> x + z, A::new, int[]::new, (String) o);\n    int[] arr = {1, 2}, b2[] = new int[3][];\n    String t = \"\"\"\n      text } \"\"\";\n    if (o instanceof A<?> p && p.x() >> 2 >>> 1 > 3) do x--; while (x > 0);\n    label: while (true) break label;\n    synchronized (this) { assert x : \"m\"; }\n    return a ? b : c ? (T) d : e;\n  }\n  abstract void g();\n  @interface I { int v() default 1; }\n}\n"],
    "py": ["", "x = 1\n", "@dec(1)\nasync def f(a, /, b: int = 1, *args, c=2, **kw) -> x[int]:\n    \"\"\"doc\"\"\"\n    async with a as b, c:\n        pass\n    return [y async for y in z if y]\n\nclass A(B, metaclass=M):\n    x: int = 3\n    def g(self): return lambda a, *b: (yield)\n\nif (n := 1) and not x in y:\n  a, *b = c = {**d, 'k': v}\nelif z: pass\nelse:\n\tpass\nfor i, in j:\n    try:\n        del a[1:2, ...], b.c\n    except (A, B) as e:\n        raise X from e\n    except* C: ...\n    else: pass\n    finally: pass\nelse:\n    pass\nwhile 1: break\nmatch x:\n    case [1, y] if y: pass\n    case A(b=1) | None: pass\nwith (open(a) as f, g):\n    print(f'{x!r:>{w}}', r'a', b'' 'a')\nfrom . import (a as b, c,)\nimport a.b as c, d\nt = a if b else c if d else e\ns = x @ y ** -z\n"],
    "ts": ["", "import a, { type B as C } from \"x\";\nexport default class A<T extends B = C> extends D.E<T> implements F {\n  private readonly x?: Map<string, Array<number>> = new Map<string, any>();\n  static #p = 1;\n  constructor(public a: string, b?: number) { super(a!); }\n  get y(): number { return this.#p }\n  async *gen<U>(x: U, ...r: U[]): AsyncGenerator<U> { yield* x }\n  [key: string]: any;\n}\nexport interface I extends J { a(): void; b: (x: number) => string; readonly [k: string]: T[\"x\"] | null }\ntype M = { [K in keyof T]?: T[K] } & (A | B)\nenum E { A = 1, B }\ndeclare module \"m\" { export const z: number }\nnamespace N { }\nfunction f(this: X, { a, b = 2 }: Y = {}, [c]: Z): x is Y { return x as unknown as Y }\nconst g = async <T,>(x: T) => { for await (const y of z) { } }\nlet h = (a, b) => a ?? b?.c?.[d]?.(e)\nif (a) b(); else if (c) d\nelse { }\nlabel: for (let i = 0, n = 2; i < n; i++) { if (x) continue label }\ndo { x++ } while (x < 3)\nswitch (a) { case 1: break; default: { } }\ntry { } catch { } finally { }\nconst re = /[/\\]]+/g.test(s), t = `a ${b + `c`} d`\nabstract class Q { abstract m(): void }\nfoo<string>(x)\n"],
    "js": ["#!/usr/bin/env node\n", "!function(e){if(!e)throw Error('x');var a=1,b=[2,,3];for(var k in e)k;return e&&e.d?e:{default:e}}(window.x||{});Mx=function(e){return e};const f=(e,t)=>e<t?-1:1;function g(e,t){return e.D?t[e.t]:void 0}\nexport const o = { a, b: 1, get c() { return 1 }, async d() {}, [e]: f, ...g }\nclass A { x = 1\n  y = 2\n  static z() { return new.target } }\nlet a = b\n+c\nreturn_\nasync function* q() { await x }\nxs.map((v) => { return { v } }).then(async () => {}, e => ({ e }))\nvar r = a ? b : c, s = typeof x === 'y' && !z in w\n"],
    "rs": ["", "#![allow(x)]\nuse a::{self, b::*, c as d};\n#[derive(Debug)]\npub struct A<'a, T: B + 'a = C, const N: usize = 1> where T: D { pub x: &'a mut [T; N], y: Box<dyn Fn(i32) -> i32 + Send> }\nstruct U(pub i32, String);\nstruct V;\nenum E { A, B(i32), C { x: i32 } = 1 }\nimpl<'a, T> Tr for A<'a, T> { type X = Vec<Option<T>>; const Y: i32 = 1;\n  pub(crate) async unsafe fn f<F>(&mut self, (a, b): (i32, i32), _: F) -> Result<(), Box<dyn Err>> where F: Fn() {\n    let Some(x) = y else { return Err(z)?; };\n    let v: Vec<u8> = w.iter().map(|&x| x as u8).collect::<Vec<_>>();\n    match v { [a, .., b] if a > b => 1, E::B(n @ 1..=5) | E::C { x, .. } => { 2 } _ => panic!(\"{}\", x), };\n    if let Some(q) = r && s < t { } else if u == V { }\n    'o: for i in 0..n { while let Ok(x) = f() { break 'o; } }\n    let c = move |a: i32| -> i32 { a };\n    let s = S { a, b: 1, ..d };\n    unsafe { *p = <T as D>::g(1u8) };\n    if x { 1 } else { 2 }\n  } }\ntrait Tr: A + B { fn g(&self) -> i32 { 1 } fn h(); }\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\nstatic mut Z: [i32; 2] = [1, 2];\nmod n { }\nfn main() { println!(\"{}\", r#\"}\"#); let c = '{'; }\n"],
}
BROKEN = {
    "go": ["package a\nfunc f() {\n", "package a\nfunc f() { x = = 1 }\n", "package a\nvar x = \"cut\n", "class A {}\n", "package a\n<<<<<<< HEAD\nvar x = 1\n=======\n>>>>>>> b\n"],
    "java": ["class A {", "class A { int f( { } }", "class A { void f() { x = ; } }", "import a.b\nclass A {}", "class A { String s = \"cut; }"],
    "py": ["def f():\nx = 1\n", "if x\n    pass\n", "x = (1\n", "  x = 1\ny\n", "x = 'cut\n", "try:\n    pass\n", "else:\n    pass\n", "x = = 1\n"],
    "ts": ["class A { f(x: number { } }", "let x = = 1", "const s = 'cut\nlet y", "interface { }", "def f(): pass"],
    "js": ["function f( {", "let x: number = 1", "a b", "if (x { }", "const s = \"cut\n"],
    "rs": ["fn f( { }", "fn f() { let = 1; }", "struct A { x i32 }", "fn f() {", "import x"],
}


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in VALID.items() for t in ts])
def test_valid(ext, text):
    assert syntax.parses(text, ext), syntax.first_failure(text, ext)
    assert syntax.parses("﻿" + text.replace("\n", "\r\n"), ext) or text.startswith("#!")


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in BROKEN.items() for t in ts])
def test_broken(ext, text):
    assert syntax.parses(text, ext) is False
    line, column, cause = syntax.first_failure(text, ext)
    assert 1 <= line <= text.count("\n") + 1 and column >= 1 and cause


def test_causes():
    assert syntax.first_failure("package a\nvar x = \"cut\n", "go")[2] == "unterminated literal"
    assert syntax.first_failure("class A {", "java")[2] == "end of file"
    assert syntax.first_failure("def f():\n    pass\n<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> z\n", "py")[2] == "conflict marker"
    assert syntax.first_failure("x = (1]\n", "py")[2] == "unbalanced bracket"
    assert syntax.first_failure("x = 1\ny = = 2\n", "py")[:2] == (2, 5)


def test_unknown_language_and_long_text():
    assert syntax.parses("anything", "xyz") is None
    assert syntax.parses("x = [\n" + "    1, 2, 3,\n" * 50_000 + "]\n", "py")
    assert syntax.parses("package a\nvar x = " + "(" * 400 + "1" + ")" * 400 + "\n", "go")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["x", "1", "(", ")", "[", "]", ":", ",", "=", "+", "if ", " else ", "def f():", "\n", "\n    ", "return ", "'s'", "not ", " in ", "lambda x: ", "*", "{", "}", "for x in y:"]), max_size=14))
def test_python_agrees_with_the_compiler(parts):
    text = "".join(parts) + "\n"
    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        return  # the compiler also refuses what is no syntax here
    assert syntax.parses(text, "py"), text


def test_shared_memo_changes_nothing():
    for ext in VALID:
        grammar = grammars.BY_EXTENSION[ext][2]
        texts = VALID[ext] + BROKEN[ext]
        warm = [syntax.parses(t, ext) for t in texts * 2][len(texts):]
        cold = []
        for t in texts:
            grammar.memo.clear(), grammar.items.clear()
            cold.append(syntax.parses(t, ext))
        assert warm == cold


def test_operator(spark, rows):
    files = spark.createDataFrame(
        [(1, "/repos/a/x.py", None, 7), (1, "/repos/a/x.py", None, 7), (2, "\\repos\\a\\y.go", None, 7), (3, "/repos/b/z.js", None, 7), (4, "/repos/b/n.rs", None, 7), (5, None, None, 7), (6, "/repos/b/e.py", None, 7)],
        "id bigint, absolute_path string, indexed_at timestamp, content int",
    )
    texts = spark.createDataFrame([(1, "x = (\n"), (2, "package a\n"), (3, None), (4, ""), (5, "x"), (6, "ok = 1\n"), (None, "x")], "file_id bigint, content string")
    assert rows(syntax.invalid_files(files, texts), "file_id") == [(1,)]
    assert rows(syntax.syntax_rates(files, texts), "repository", "language", "files", "invalid") == [("a", "go", 1, 0), ("a", "python", 1, 1), ("b", "python", 1, 0), ("b", "rust", 1, 0)]
    assert syntax.check_syntax(files.limit(0), texts.limit(0)).collect() == []


@pytest.mark.parametrize(("ext", "form"), [
    ("rs", "fn f(x: {}) {{}}\n"), ("rs", "type X = {};\n"), ("ts", "let x: {};\n"), ("ts", "type X = {}\n"), ("java", "class A {{ {} x = new A<>(); }}\n"),
])
@pytest.mark.parametrize("levels", [4, 5, 12, 60])
def test_generics_of_any_depth(ext, form, levels):
    assert syntax.parses(form.format("A<" * levels + "B" + ">" * levels), ext)
    assert syntax.parses(form.format("A<" * levels + "B" + ">" * (levels + 1)), ext) is False
    assert syntax.parses(form.format("A<" * levels + "B" + ">" * (levels - 1)), ext) is False


def _library():
    import os
    import pathlib
    import tokenize

    out = []
    for path in sorted(pathlib.Path(os.__file__).parent.glob("[a-z]*.py")):
        with tokenize.open(path) as file:
            text = file.read()
        try:
            compile(text, str(path), "exec")
        except SyntaxError:
            continue
        out.append((path.name, text))
    return out


def test_standard_library_in_any_order():
    import random

    texts = _library()
    assert len(texts) > 100
    for seed in (1, 2):
        random.Random(seed).shuffle(texts)
        texts = texts[:90]
        assert [name for name, text in texts if not syntax.parses(text, "py")] == []
    for name, text in texts[:40]:
        grammars.PYTHON.memo.clear(), grammars.PYTHON.items.clear()
        assert syntax.parses(text, "py"), name
        lines = text.rstrip().split("\n")
        cut = "\n".join(lines[: len(lines) // 2]) + "\n(\n" + "\n".join(lines[len(lines) // 2 :])
        try:
            compile(cut, name, "exec")
        except SyntaxError:
            assert syntax.parses(cut, "py") is False, name


@pytest.mark.parametrize(("ext", "text", "valid"), [
    ("py", "if a:\n    if b:\n        pass\nif a:\n    b()\nelse:\n    c()\n", True),
    ("py", "def f():\n    if a: pass\ndef g():\n    if a: pass\n    else: pass\n", True),
    ("py", "try:\n    try: pass\n    except A: pass\nexcept B: pass\nelse: pass\n", True),
    ("py", "x = f\"{a[\"b\"]:{w}.{p}} {{}} {d!r}\"\ny = f'{f'{f'{1}'}'}'\n", True),
    ("py", "type X[T] = int\ntype = 3\nx = type (1)\n", True),
    ("py", "match x:\n    case {0: (0 | 1 as z)}:\n        pass\n    case A(b=1, c=[x, *_]) as d: pass\n    case -1, None if q: pass\n", True),
    ("py", "f(a, *b, c=1, *d, **e, f=2)\nf().x[1] = 2\n", True),
    ("py", "f(a=1, 2)\n", False), ("py", "1 = x\n", False), ("py", "f() = 1\n", False), ("py", "x = 08\n", False), ("py", "x = (a as b)\n", False),
    ("py", "if a:\n" + " " * 2000 + "x\n" + " " * 1500 + "y\n", False),
    ("js", "x = f ? a ? 2 ? 5 : 2 : 3 : m\n", True), ("js", "if (a) for (;;) if (b) c; else d; else e\n", True), ("js", "e >>>= 8, f >>= 1\n", True),
    ("js", "a = {}\n// note\nb = c\n  && /x`/.test(d)\n// more\nfrom = 1\nx = `a ${b ? `c ${{ d: `e` }.d}` : f}`\n", True),
    ("js", "const a;\n", False), ("js", "if (a) b; else c; else d\n", False), ("js", "x = `a ${b\n", False),
    ("ts", "import a = require('b')\nexport = a\n", True), ("ts", "type A = <V>() => V extends B ? 1 : 2\ntype C<out T = D extends E ? 1 : 2> = T extends infer U extends F ? U : never\n", True),
    ("ts", "interface A {\n  b(): Promise<void>\n  c: void\n  /** d */\n  (e: number): f\n  [g]: h\n}\n", True), ("ts", "@a<B>(c => 1)\nexport abstract class D { accessor e = 1 }\nasync function f() { using g = h() }\n", True),
    ("java", "class A { void f() { if (a) for (;;) if (b) c(); else d(); else e(); x >>>= 2; int y = a ? b ? c ? 1 : 2 : 3 : 4; } }", True),
    ("rs", "fn f() -> u8 { a.0.b += x as u8 + self.1; if 1 != unsafe { g() } { } for i in 0.. { } &raw mut c; let d = &e[..crate::F]; }\n", True),
    ("rs", "union U { a: u8 }\ntype A<'a> = B<<C as D>::E<'a>, <<F as G>::H as I>::J> where K: L;\nfn m(r#type: u8) { #[cfg(x)] { } #[a] unsafe { } 1 << 2; n <<= 3; }\n", True),
    ("rs", "fn f() { a. }\n", False), ("rs", "union U { a u8 }\n", False),
])
def test_forms(ext, text, valid):
    for shapes in (grammars.BY_EXTENSION[ext][2].memo, grammars.BY_EXTENSION[ext][2].items):
        shapes.clear()
    assert syntax.parses(text, ext) is valid
