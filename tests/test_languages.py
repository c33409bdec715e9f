"""Symbols, kinds, names and imports per language, from hand-derived expectations."""
import pytest
from pyspark.sql import functions as F

from treelode import schema
from treelode.functions.languages import declaration, import_of
from treelode.functions.statements import cut
from treelode.operators.outline import file_outline, symbol_source

CASES = {
    # name rules and kinds of scripts
    "src/kinds.ts": ("""
export function useFoo() {}
function use() {}
const use_x = 1
const use1 = 1
function user() {}
class Foo {}
interface Foo2 {}
class foo {}
interface foo2 {}
type foo3 = 1
enum foo4 { A }
export default class Named extends Base {}
export default function () {}
export { a }
export * from './m'
export default foo
export const enum Mode { A }
export abstract class Hidden {}
abstract class Hidden2 {}
declare const hidden3: number
function* hidden4() {}
var hidden5 = 1
namespace hidden6 { class X {} }
const { x } = plain
const { y } = call()
const [z] = arr, after = 2
let first = 1, second = 2
@Dec() class Decorated {}
function overload(a: string): void
function overload(a: any) { return { } }
export async function later(): Promise<{ a: 1 }> {}
""", [("hook", "useFoo"), ("hook", "use"), ("hook", "use_x"), ("hook", "use1"), ("function", "user"), ("component", "Foo"),
      ("component", "Foo2"), ("class", "foo"), ("type", "foo2"), ("type", "foo3"), ("type", "foo4"), ("component", "Named"),
      ("component", "Mode"), ("function", "plain"), ("function", "arr"), ("function", "first"), ("component", "Decorated"),
      ("function", "overload"), ("function", "later")]),
    "src/plain.js": ("interface a {}\ntype b = 1\nenum c {}\nexport interface d {}\nexport enum E {}\nclass f {}\n",
                     [("function", "d"), ("component", "E"), ("class", "f")]),
    "src/a.py": ("import os\n@d\nclass A: pass\nclass B: pass\nasync def c(): pass\nif x:\n    def hidden(): pass\n",
                 [("function", "A"), ("class", "B"), ("function", "c")]),
    "src/a.go": ("package a\nfunc F() {}\nfunc (r R) M() {}\ntype T struct{}\ntype (\n A = int\n B int\n)\ntype C = int\nvar x = 1\n",
                 [("function", "F"), ("method", "M"), ("type", "T"), ("type", "B")]),
    "src/a.rs": ("pub fn f() {}\nstruct S;\nenum E {}\nimpl S {}\nimpl T for S {}\nimpl<T> G<T> {}\nimpl a::B for S {}\nimpl G<u8> for &S {}\n"
                 "trait T {}\ntype A = u8;\nmod m;\nconst C: u8 = 1;\nfn sig();\nunion U { a: u8 }\n",
                 [("function", "f"), ("struct", "S"), ("struct", "E"), ("impl", "impl S"), ("impl", "impl T"), ("impl", "impl S"),
                  ("trait", "T"), ("type", "A"), ("function", "m")]),
    "src/a.php": ("<?php\nfunction f() {}\nfinal class C {}\ninterface I {}\ntrait T {}\nenum E {}\nnamespace N { class X {} }\n$g = function () {};\n",
                  [("function", "f"), ("class", "C"), ("type", "I"), ("type", "T")]),
    "src/a.css": ("@charset \"x\";\n@import 'a';\na, b > c { d: e }\n@media print { a {} }\n@keyframes k { }\n@font-face { }\n",
                  [("rule", "@import"), ("rule", "a, b > c"), ("rule", "@media"), ("rule", "@keyframes k")]),
    "src/a.html": ("<!-- c --><div><p>a<p>b</div>\n<br>\n<img/>\n<script>let a = '<div>'</script>\n<Ul><li>x",
                   [("element", "div"), ("element", "br"), ("element", "Ul")]),
    "src/a.sql": ("create function f() {}", []),
}


@pytest.fixture(scope="module")
def outlines(spark):
    rows = [(path, "." + path.rsplit(".", 1)[1], text) for path, (text, _) in CASES.items()]
    files = spark.createDataFrame(rows, "file_path string, extension string, content string")
    return {r.file: r for r in file_outline(files).collect()}


@pytest.mark.parametrize("path", CASES)
def test_symbols(outlines, path):
    row = outlines[path]
    assert [(s.kind, s.name) for s in row.symbols] == CASES[path][1]
    assert row.error is None and row.symbols_count == len(row.symbols)
    assert list(row.exports) == list(dict.fromkeys(s.name for s in row.symbols))
    assert all(s.kind in schema.CHUNK_TYPES for s in row.symbols)


@pytest.mark.parametrize("path,text,expected", [
    ("a.ts", "import a from 'x'\nimport { b } from \"y\"\nimport 'z'\nimport type { T } from 'w'\nimport q = require('r')\nimport('s')\n",
     ["x", "y", "z", "w"]),
    ("a.py", "import os\nfrom a.b import c\nfrom . import d\nfrom .m import e as f, g\nfrom __future__ import h\nfrom x import (\n  y)\nfrom a.b import c\n",
     ["a.b", "d", "g", "x", "a.b"]),
    ("a.rs", "use std::fmt;\nuse a;\nuse b::{c};\nuse d::*;\nuse e as f;\npub use crate::g;\nuse crate;\n", ["std::fmt", "a", "crate::g"]),
    ("a.go", "import \"fmt\"\n", []), ("a.css", "@import 'x';\n", []), ("a.php", "<?php\nuse A\\B;\n", []),
])
def test_imports(files, path, text, expected):
    assert file_outline(files({path: text})).first().imports == expected


@pytest.mark.parametrize("ext,text,rows", [
    # strings, comments, templates and expressions that look like brackets
    (".ts", "function a() { return `}${ `{` }` }\nconst b = /[/}]\\/{/.test('x')\n// {\nclass c {}", [(0, 0), (1, 1), (3, 3)]),
    (".ts", "const a = 1\n  + 2\nconst b = x\n  .y()\ntype c = A<B>\ntype d =\n  | 1\n  | 2", [(0, 1), (2, 3), (4, 4), (5, 7)]),
    (".tsx", "const a = () => {\n  return <p>it's {x} :) (</p>\n}\nconst b = 1", [(0, 2), (3, 3)]),
    (".py", "def a():\n    x = '''\ndef no(): pass\n'''\n\n    # inside\n  # outside\n\ndef b(): pass", [(0, 5), (8, 8)]),
    (".py", "def a(\n  x): return (\n 1)\nx = 1; y = 2", [(0, 2), (3, 3), (3, 3)]),
    (".rs", "fn a() { '{'; \"}\"; r#\"}\"#; b'}'; 'x: loop {} }\n/* /* } */ { */ fn b() {}", [(0, 0), (1, 1)]),
    (".go", "func a() { x := `}`; y := '}' }\nfunc b() {\n}", [(0, 0), (1, 2)]),
    (".php", "<?php function a() { // } ?>\n<?php }\nfunction b() { # {\n}", [(0, 1), (2, 3)]),
    (".css", "a[b='}'] { c: '{' }\n/* { */ d { }", [(0, 0), (1, 1)]),
    (".ts", "function open() {\n  never closed", [(0, 1)]),
    (".ts", "", []), (".py", "\n\n", []), (".html", "text only", []), (".html", "</p><b>x", [(0, 0)]),
])
def test_ranges(ext, text, rows):
    assert [(a, b) for _, a, b in cut(text, ext)] == rows


def test_python_cut_agrees_with_the_standard_parser():
    import ast
    import glob
    import os
    folder = os.path.dirname(os.__file__)
    for path in sorted(glob.glob(folder + "/*.py"))[:60]:
        with open(path, encoding="utf-8") as stream:
            text = stream.read()
        declared = [node for node in ast.parse(text).body
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        expected = [min([n.lineno] + [d.lineno for d in n.decorator_list]) for n in declared]
        import re
        found = [a + 1 for head, a, _ in cut(text, ".py") if re.match(r"@|class\b|(?:async\s+)?def\b", head)]
        assert found == expected, path


def test_first_of_equal_names_wins_and_siblings_drop_both(files):
    frame = files({"a.ts": "function f(a: string): void\nfunction f(a) { 1 }\nclass G {}\nfunction f() { 2 }\n"})
    row = symbol_source(frame, F.lit("f")).first()
    assert row.source == "function f(a) { 1 }" and row.lines == "2-2" and row.siblings == ["component G (3-3)"]
    assert symbol_source(frame, F.lit("none")).count() == 0


def test_warnings(files):
    lines = ["  // TODO fix", "# Notebook", "* @Deprecated", "/** TODO x", "x = 1 // TODO", "-- TODO", "<!-- TODO", "/*FIXME*/",
             " // warning: x "]
    frame = files({"a.ts": "\n".join(lines), "a.sql": "\n".join(lines)})
    found = {r.file: r.warnings for r in file_outline(frame).collect()}
    assert found["a.ts"] == ["L1: TODO fix", "L2: Notebook", "L3: @Deprecated", "L8: FIXME*/", "L9: warning: x"]
    assert found["a.sql"] == []


LARGE = 1 << 20
HUGE = {
    ".ts": ["@a" * 20_000 + " x", "@a " * (LARGE // 3) + "class Foo {}", "export " + "@a@" * 9_000, "const {}" + "=a" * (LARGE // 2), "type " + "x " * (LARGE // 2)],
    ".py": ["from . import (\n" + "    a as b,\n" * (LARGE // 12) + "    last)", "from ." + ".x" * (LARGE // 2) + " y", "@" + "d" * LARGE,
            "from . import (" + "# note\n" * (LARGE // 7), "from a" + ". b" * (LARGE // 3)],
    ".go": ["type (\n" + "A = int\n" * (LARGE // 8) + "Last struct{}\n)", "type (" + "A" * LARGE, "func () " + "x" * LARGE],
    ".rs": ["impl" + "<T: A" * 100_000 + ">" * 100_000 + " Foo {}", "use a" + "::b" * (LARGE // 3) + ";", "pub " + "async " * (LARGE // 6) + "fn f() {}", "impl" + "<" * LARGE],
    ".php": ["#[] " * (LARGE // 4) + "class A {}", "final " * (LARGE // 6) + "class A {}"],
    ".css": ["a " * (LARGE // 2) + "{}", "@keyframes " + "x" * LARGE],
}


@pytest.mark.parametrize("extension", HUGE)
def test_very_long_statements_end_soon(spark, extension):
    """No pattern recurses per repetition or tries the same characters again and again."""
    import time
    frame = spark.createDataFrame([(text,) for text in HUGE[extension]], "head string")
    start = time.perf_counter()
    found = frame.select(declaration(F.col("head"), F.lit(extension)).alias("d"), import_of(F.col("head"), F.lit(extension)).alias("i")).collect()
    assert time.perf_counter() - start < 20
    if extension == ".py":
        assert found[0].i == "last"
    if extension == ".rs":
        assert found[0].d.name == "impl Foo"


def test_deep_generics_keep_their_symbol(spark):
    heads = ["impl<T: A<B<C<D<E>>>>> Foo {}", "impl<F: Fn() -> Vec<Vec<T>>> Bar {}", "impl<T> Box<T> {}", "impl Baz {}", "impl<T> Show for Qux {}"]
    frame = spark.createDataFrame([(n, head) for n, head in enumerate(heads)], "n int, head string")
    found = frame.select("n", declaration(F.col("head"), F.lit(".rs"))["name"].alias("name")).orderBy("n").collect()
    assert [row.name for row in found] == ["impl Foo", "impl Bar", None, "impl Baz", "impl Show"]


def test_unclosed_tags_end_soon():
    import time
    start = time.perf_counter()
    cut("<p>ok</p>" + "<a " * 100_000, ".html")
    assert time.perf_counter() - start < 2
