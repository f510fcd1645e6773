"""The grammars of programming languages and YAML: what they take as a whole and what they don't."""

import pytest

from spanweave.grammar import library
from spanweave.kernel.matcher import Matcher

C = [
    "#include <stdio.h>\n#define MAX(a, b) \\\n  ((a) > (b) ? (a) : (b))\n\nint main(int argc, char **argv) {\n  printf(\"%d\\n\", MAX(1, 2)); // say\n  return 0;\n}\n",
    "typedef struct node { int key : 3; struct node *next, *last; union { float f; unsigned long u; }; } node_t;\nstatic const node_t *find(const node_t *n, int (*same)(int, int)) { for (; n && !same(n->key, 3); n = n->next) ; return n; }",
    "enum colour { RED = 1, GREEN, BLUE = 0x1fUL, };\nextern int a[10], *b, (*c)(void);\nint m[2][3] = { { 1, 2 }, [1] = { [0 ... 2] = 'x' } };\nstruct p q = { .x = 1, .y.z = 2 };",
    "void f(size_t n) { foo_t *x = (foo_t *)malloc(sizeof *x * n), y; a * b; x->c[3].d++; *x = (foo_t){ 1 }; if (n > 1) { goto out; } else return; do { --n; } while (n); out: free(x); }",
    "int g(void) { switch (k) { case 1: case 2 ... 4: break; default: ; } for (int i = 0, j = 1; i < 3; i += j) continue; return sizeof(int) + sizeof (x).y + -1.5e-3f + .5 + (a) - b + (a)(b) + 'c'; }",
    "int vararg(const char *fmt, ...);\nint *(*h(int))(char[]);\n__attribute__((noreturn)) void die(void);\n_Static_assert(sizeof(int) == 4, \"int\");\n",
    "x_t f(u8 *restrict p) { return a ? b : c ? d, e : f; }\nunsigned x = 1 << 3 | ~2 & 0b11;\n",
    "",
]
NOT_C = ["int main( { }", "int x = ;", "int x", "void f() { if x return; }", "void f() { a b c; }", "struct { int }", "return 1;", "void f() { 'open }", "int if;", "void f() { x = 1 2; }"]
GO = [
    'package main\n\nimport (\n\t"fmt"\n\tm "math" // maths\n)\n\nfunc main() {\n\tfmt.Println("a", m.Pi)\n}\n',
    "package p\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*E\n\tp.Q\n}\ntype I interface { M(x int) (y string, err error); ~int | string }\ntype L[K comparable, V any] map[K][]V\nvar x, y = 1, 2\nconst (\n\ta = iota\n\tb\n)\n",
    "package p\nfunc (t *T) f(a, b int, c ...string) (n int, err error) {\n\tfor i := 0; i < n; i++ {\n\t\tif v, ok := m[k]; ok && v > 3 {\n\t\t\tcontinue\n\t\t} else if x == y {\n\t\t\tbreak\n\t\t} else {\n\t\t\tgo g()\n\t\t}\n\t}\n\tfor k, v := range m {\n\t\ts += v\n\t}\n\tfor range 10 {}\n\tfor {\n\t\tselect {\n\t\tcase v := <-c:\n\t\t\treturn v, nil\n\t\tcase d <- 1:\n\t\tdefault:\n\t\t}\n\t}\n}\n",
    'package p\nfunc f() {\n\tx := []T{{1, 2}, {A: 3}}\n\ty := map[string]int{\n\t\t"a": 1,\n\t}\n\tz := &T{A: 1}\n\t*p = 3\n\tx[1:2:3], y.(int)\n\tswitch t := y.(type) {\n\tcase int, *T:\n\tcase nil:\n\t\tfallthrough\n\tdefault:\n\t\tx = a +\n\t\t\tb\n\t}\n\tdefer func() { recover() }()\n\tf(a,\n\t\tb...)\n\tg[int](3).h.i()\n}\n',
    "package p\nfunc m[K any](x K) K { return K(x) }\nvar c chan<- int = make(chan int, 0x1F)\nvar e = 'x' + '\\n' - -1.5e3i &^ 2 << 1\nfunc h() { L: for ; ; { break L }; goto L; if (T{1} == t) { } }",
    "package p",
]
NOT_GO = ["func f() {}", "package p\nfunc f( {}", "package p\nvar x =", "package p\nfunc f() { a b }", "package p\nfunc f() { x := 1 y := 2 }", "package p\nfunc f() {\n", "package p\nfunc f() { if x == T{} { } else }", "package if", 'package p\nimport "a', "package p\nfunc f() { a = b\n + }"]
JAVASCRIPT = [
    "#!/usr/bin/env node\n'use strict'\nlet a = 1, b\nconst { c, d: [e, ...f], g = 2, ...h } = require('x')\nvar i = a\n  .b(c)\n  [0]?.d?.[1]?.(2)\n++b\n",
    "import x, { y as z, default as w } from './m.js'\nimport * as n from \"n\"; import 'side'\nexport default function () {}\nexport const q = 1\nexport { a, b as c } from 'd'; export * from 'e'; export class K {}",
    "for (let i = 0; i < 3; i++) { if (i) continue; else break }\nfor (const k of xs) f(k)\nfor (k in o) ;\nouter: while (true) { do { x-- } while (x) break outer }\nfor (;;) {}\nswitch (x) { case 1: case 'a': f(); break; default: g() }\ntry { throw new Error('x') } catch ({ message }) { } finally { }",
    "class A extends B.C { static #n = 0; x = 1\n get y() { return this.#n } static async *gen(a, b = 2, ...c) { yield* a; yield } constructor() { super(); } static { f() } ['k' + 1]() {} 'q'() {} }",
    "const f = async (a, { b }, [c] = []) => { await a }, g = x => ({ x, y: 1, 'z': 2, [w]: 3, m() {}, get n() { return 1 }, async p() {}, ...r })\nconst t = `a ${f(`b ${1}`)} \\` c` + tag`x`\n",
    "x = a ? b : c ?? d || e && !f ** -2 >>> 1 === typeof g instanceof H; y = /[/\\]]+\\/x/gi.test(s) / 2; z = 0xFFn + 1_000.5e-3 + .5; a ||= b; (function () { return\n1 })(); new X; new Y(1).z; delete a[b], void 0",
    "a\n/* c\n */ b // d\n;[1, , 2].map((x) => x * 2);if(a)b;else c",
    "",
]
NOT_JAVASCRIPT = ["let = 1", "a b", "let x = 1 2", "f(", "if x {}", "{ a", "'open", "class { x y }", "const f = a => ", "return 1 2", "for (let i = 0; i < 3) {}", "x = { a: }", "`${`", "var if = 1"]
RUST = [
    "use std::{collections::HashMap, fmt::{self, Display as D}, io::*};\n\nfn main() {\n    println!(\"{} {}\", 1, x);\n    let mut v: Vec<Vec<u8>> = Vec::new();\n    v.push(vec![1u8, 2]);\n}\n",
    "#[derive(Debug, Clone)]\npub struct P<'a, T: Display + 'a = u8> where T: Copy { pub x: &'a mut T, y: [f32; 3] }\nstruct U;\nstruct W(pub i32, String);\npub(crate) enum E { A, B(u8, P<'static>), C { x: i64 } = 3, }\ntype R<T> = Result<T, Box<dyn Error + Send>>;\nconst N: usize = 1 << 3;\nstatic mut S: &str = r#\"a\"b\"#;",
    "impl<T> Trait<u8> for P<'_, T> where for<'a> T: Fn(&'a u8) -> bool { type Out = T; const K: u8 = 1; fn f(&self, (a, b): (u8, u8)) -> impl Iterator<Item = u8> + '_ { self.x.iter().map(|x| x + 1).collect::<Vec<_>>() } }\npub unsafe trait Q: Clone { fn g(&mut self) -> Self; }",
    "fn f(x: Option<u8>) -> u8 {\n    if x == None { return 1; }\n    if let Some(n) = x && n > 2 { n } else if y { 2 } else { 3 };\n    match x {\n        Some(1 | 2) => 1,\n        Some(n @ 3..=9) if n > 4 => { n }\n        None => P { x: 1, ..d }.x,\n        _ => loop { break 'a 3; },\n    }\n}",
    "fn g() { 'a: for i in 0..n { while let Some(x) = it.next() { continue 'a } } let c = move |a: u8, b| -> u8 { a }; let Some(z) = q else { return }; *p += -1 as i64 as f64 / 2.5e3_f32; let t = (1, 'x', b'\\n', '\\u{1F600}', true).0; a[1..] = b?.await; let r = &mut s[..2]; unsafe { h() } async move { 1 }; }",
    "macro_rules! m { ($x:expr) => { $x + 1 }; }\nmod a { pub fn f() {} }\nextern crate b;\n/* a /* nested */ comment */\n/// docs\nextern \"C\" { fn c(x: *const u8, ...); }\nconst fn k<const M: usize>() -> [u8; M] { [0; M] }",
    "fn l() { let f: fn(u8) -> u8 = <T as Q>::g; let u = a < b && c > d; if a < b as u8 { } x = y == P { x: 1 }.x; (a.b)(c); }",
    "",
]
NOT_RUST = ["fn main( {}", "fn f() { let x = ; }", "struct S { x }", "fn f() { a b }", "let x = 1;", "fn f() {", "fn fn() {}", 'fn f() { "open }', "fn f() { match x { 1 } }", "impl { fn }", "use a::;", "fn f() { if x }"]
STARLARK = [
    'load("//a:b.bzl", "c", d = "e")\n\n# comment\ndef f(a, b = 1, *args, **kw):\n    """Doc."""\n    if a and not b:\n        return [x for x in a if x]\n    elif a in b:\n        pass\n\n    # inner\n    else:\n        for i, j in z.items():\n            if i: break\n            k += 1; l = -2\n    return None\n\ncc_library(\n    name = "x",\n    srcs = glob(["*.c"]) +\n        ["y"],  # more\n    deps = {"a": 1,\n            "b": 2}\n)\n',
    "x = lambda a, b = 2: a if b else c\ny = x[1:2], x[::3], (1,), ()\nz = {k: v for k, v in w if v not in u}\na.b.c = 0x1F // 3 % 2\n",
    "def f():\n  pass\ndef g(): return 1",
    "\n\n  # only this\n",
    "a = b \\\n  + c",
    "",
]
NOT_STARLARK = ["def f():\npass", "if x:\n    a\n  b", "x = ", "a b", "def f(:\n  pass", "x = [1, 2", "  x = 1\ny = 2", "while x:\n  pass", 'x = "open', "class A: pass", "else:\n  pass"]
YAML = [
    "# top\na: 1\nb:\n  c: x y  # note\n  d: [1, two, {e: f, \"g\": 'h'}]\nlist:\n- 1\n- k: v\n  l: m\n-\n  - nested\n  - - deep\n    - er\nlast: true\n",
    "%YAML 1.2\n---\ntext: |\n  line one\n\n    more: than\n  # no comment\nfold: >-\n  a\n  b\nnext: ~\n---\n- &x !t val\n- *x\n...\n",
    "key with blanks: http://a.b/c:d\n'q': \"two\n  lines\"\nempty:\n? complex\n: value\nmulti: first\n  second\n  third\n<<: *base\nn: -1.5e3\n",
    "- a\n- b: c\n  d:\n    - e\n\n  f: g\n- [a,\n   b]\n",
    "plain scalar",
    "[1, 2]\n",
    "",
]
NOT_YAML = ["a: [1, 2", "a: b: c", "a: 1\n  b: 2", "a: 'open", "- a\nb: c", "a: }", "a:\n  b: 1\n c: 2", "{a: 1} x", "a: @x"]
KINDS = set("keyword string number comment operator punctuation type function constant property variable".split())
ALL = {"c": (C, NOT_C), "go": (GO, NOT_GO), "javascript": (JAVASCRIPT, NOT_JAVASCRIPT), "rust": (RUST, NOT_RUST), "starlark": (STARLARK, NOT_STARLARK), "yaml": (YAML, NOT_YAML)}


@pytest.mark.parametrize(("grammar", "text", "whole"), [(g, t, w) for g, both in ALL.items() for ts, w in zip(both, (True, False), strict=True) for t in ts])
def test_whole_documents(grammar, text, whole):
    found = Matcher(library.program(grammar)).match(text.encode())
    assert found.complete == whole, text[found.matched :]
    assert {k for k, _, _ in found.captures} <= KINDS


@pytest.mark.parametrize(
    ("grammar", "text", "numbers"),
    [("c", "int f(void) { return " + "(" * 40 + "1" + ")" * 40 + "; }", 1), ("go", "package p\nvar x = " + "(" * 40 + "1" + ")" * 40, 1), ("javascript", "x = " + "(" * 40 + "1" + ")" * 40, 1), ("rust", "fn f() { " + "(" * 40 + "1" + ")" * 40 + " }", 1), ("starlark", "x = " + "[" * 40 + "1" + "]" * 40, 1), ("yaml", "x: " + "[" * 40 + "1" + "]" * 40, 1)],
)
def test_nested_brackets_take_no_exponential_time(grammar, text, numbers):
    found = Matcher(library.program(grammar)).match(text.encode())
    assert found.complete and sum(k == "number" for k, _, _ in found.captures) == numbers


@pytest.mark.parametrize(("grammar", "text", "words"), [("c", "int intx = iffy;", ["intx", "iffy"]), ("go", "package ifx\nvar forx = gox", ["ifx", "forx", "gox"]), ("javascript", "let letx = newx", ["letx", "newx"]), ("rust", "fn f() { let letx = ifx; }", ["letx", "ifx"]), ("starlark", "x = notx", ["x", "notx"])])
def test_words_that_begin_like_keywords(grammar, text, words):
    found = Matcher(library.program(grammar)).match(text.encode())
    assert found.complete and [text[a:b] for k, a, b in found.captures if k == "variable"] == words
