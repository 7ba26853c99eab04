import ast
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcloom.llm import syntax
from arcloom.llm.gll import Grammar

GOOD = {
    "java": [
        "", "package a.b; import java.util.*; import static x.Y.z; /** d */ public final class A<T extends B & C> extends D<T> implements E, F { }",
        "class A { int x = 1, y[] = {1, 2,}; List<Map<String, int[]>> m; static { x = 3; } A() { this(1); } <T> T f(final T t, int... n) throws E { return (T) t; } }",
        "class A { void f() { boolean c = a < b && c > d; foo.<String>bar(x -> x + 1, (a, b) -> { return a; }, String::new, int[]::new, A.super::f); x = y ? z : w; } }",
        "enum E { A, B(1) { void f() { } }, ; int x; E() { } }", "record R(int a, String... b) implements I { R { } static int q; }", "@interface N { int v() default 1; String[] w() default {}; }",
        "sealed interface S permits P, Q { } non-sealed class P implements S { }", "class A { int f(int k) { return switch (k) { case 1, 2 -> 3; default -> { yield 4; } }; } }",
        'class A { String s = """\n  a "quoted" b\n  """; char c = \'\\u0041\'; long l = 0xFFL + 1_000 + 0b11; double d = 1.e3 + .5f; }',
        "class A { void f() { for (int i = 0, j = 1; i < 9; i++, j--) { } for (final var x : xs) continue; l: while (true) { break l; } do x++; while (x < 3); try (var a = b(); c) { } catch (E | F e) { } finally { } synchronized (this) { } assert a : b; if (o instanceof String s && s.length() > 1) throw new E(); int a[] = new int[3][]; new Outer().new Inner() { }; } }",
    ],
    "js": [
        "", "'use strict';\nconst {a, b: [c = 1, ...d], ...e} = f(`x ${y + `z`} w`) ?? g?.h?.[0]\nlet r = /[/\\]]+/gi.test(s) ? 1 / 2 : x => ({ x, y() { return 1 }, get z() { return 2 }, [k]: 3, async *m() { yield* n } })",
        "async function f(a = 1, ...b) { for await (const x of y) { await x } }\nclass A extends B { #p = 1; static q; static { } constructor() { super() } get #r() { return this.#p } }\nlabel: for (var i = 0, n = 3; i < n; i++) { if (i) continue label; else break }",
        "a = b\n++c\nvar x = function () { return\n1 }\nfor (const k in o) ;\nswitch (z) { case 1: default: }\ntry { } catch { } finally { }\nimport('m').then(async () => { })",
        "!function(g){\"object\"==typeof g?g.a=7:void 0}(this);var e=function(n){for(var d=0,r=[];d<n.length;d++)r.push(n[d]^63);return r}", "/*!\n*/ x = 1 // end",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', "[]", '"x"', " 1 "],
    "xml": ['<?xml version="1.0"?><!-- c --><a b="1" c=\'&lt;&#10;\'><b/>t &amp; <![CDATA[ <x> ]]></a>\n', "<!DOCTYPE a><a/>", "<a>é</a>"],
    "py": [
        "", "import a.b as c, d\nfrom .e import (f, g as h,)\nx: int = 1\nx += 2; y = z = lambda *a, k=1, **w: a[1:2, ::3]\n@dec(1)\nasync def f(a, /, b: int = 2, *, c, **d) -> int:\n    async with p() as q, r:\n        await s\n    return [i async for i in t if i]\n",
        "class A(B, metaclass=C):\n    'doc'\n    def f(self): pass\n\n    if x:\n        y = 1\n", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from e\nelse: pass\nfinally:\n  del a, b[0]\n",
        "match x:\n  case {'a': 1, **r} if y: pass\n  case A(b=2) | [c, *_]: pass\n  case _:\n    pass\nmatch = 1\ntype X = int\nprint(f'{a!r:>{w}}' \"b\" rb'c')\nif (n := 10) > 5: pass\n",
        "def f():\n    # only\n    return {**a, 'b': 1}, {x for x in y}, {k: v for k, v in z}, not a in b, c is not d\n",
    ],
}
BAD = {
    "java": ["class A {", "class A { int x = ; }", "class A { void f() { x; } }", "class A { void f() { int 1x; } }", "<<<<<<< HEAD\nclass A { }\n=======\n>>>>>>> x", 'class A { String s = "x; }', "class A { } }", "int x;", "class A { void f() { if x { } } }", "class A { void f() { try { } } }", "class A { int f( { } }", "'use strict';", "{\"a\": 1}", "class A { void f() { foo() } }", "class A { char c = 'ab'; }", "class class { }"],
    "js": ["{\"a\": 1, \"b\": 2}", "function (", "let x = ;", "a b", "return 1", "`x ${y", "if (x { }", "class A { x: 1 }", "<html></html>", "var a = 'x\n'", "for (;;", "package a.b;", "x = {a: 1,, b: 2}", "1 +", "import x from 'y'", "const a = [1, 2"],
    "json": ["", "{a: 1}", "{'a': 1}", "[1,]", '{"a": 1,}', "[1] 2", "NaN", "01", '"\t"', '{"a" 1}', "// c\n1", "[1, 2"],
    "xml": ["", "<a>", "<a></b>", "<a/><b/>", "<a b=1/>", "<a b='1' b='2'/>", "<a>&nbsp;</a>", "<a>]]></a>", "text", "<a><!-- -- --></a>", " <?xml version='1.0'?><a/>", "<a x='<'/>"],
    "py": ["def f(:\n  pass\n", "if x\n  pass\n", "def f():\npass\n", "x = (1\n", "  x = 1\n", "if x:\n    a\n  b\n", "'abc\n", "print 1\n", "<<<<<<< HEAD\n", "for x y: pass\n", "f(a b)\n", "class A:\n", "x = = 1\n", "return = 3\n"],
}


@pytest.mark.parametrize("lang,code", [(k, c) for k, v in GOOD.items() for c in v])
def test_accepts(lang, code):
    assert syntax.rejected_at(lang, code) is None
    assert not syntax.is_broken(lang, code)


@pytest.mark.parametrize("lang,code", [(k, c) for k, v in BAD.items() for c in v])
def test_rejects(lang, code):
    assert syntax.is_broken(lang, code)


def test_own_sources_parse_as_python():
    import pathlib

    for p in pathlib.Path(syntax.__file__).parents[1].rglob("*.py"):
        assert syntax.rejected_at("py", p.read_text()) is None, p


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8), st.integers(0, 200), st.sampled_from('{}[],:"1 a'))
def test_json_agrees_with_the_exact_parser(value, at, c):
    text = json.dumps(value)
    assert syntax.rejected_at("json", text) is None
    cut = text[: at % (len(text) + 1)] + c + text[at % (len(text) + 1) :]
    try:
        json.loads(cut, parse_constant=lambda _: 1 / 0)
        ok = True
    except (ValueError, ZeroDivisionError):
        ok = False
    assert (syntax.rejected_at("json", cut) is None) == ok


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12))
def test_damaged_python_agrees_with_the_exact_parser(at, n):
    src = GOOD["py"][1]
    at %= len(src)
    cut = src[:at] + src[at + n :]
    try:
        ast.parse(cut)
        ok = True
    except SyntaxError:
        ok = False
    if ok:
        assert syntax.rejected_at("py", cut) is None or syntax.acquitted("py", cut)


def test_ambiguity_and_dialects_share_the_stack():
    g = Grammar("s = e ; e = t ('+' t)* ; t = N | '(' e ')' | N ; r = N N ;", ("s", "r"))
    n, p, a, b = (g.tid(x) for x in ("N", "+", "(", ")"))
    assert g.accepts([a, n, p, n, b])[0] and g.accepts([n, n])[0] and not g.accepts([n, p])[0] and not g.accepts([a, n])[0]
    deep = [a] * 20_000 + [n] + [b] * 20_000
    assert g.accepts(deep)[0] and not g.accepts(deep[:-1])[0]


def test_files(spark):
    rows = [(1, 1, "a/X.JAVA", "class X {", "v"), (2, 1, "b\\y.py", "x = 1\n", "v"), (3, 1, "c.json", None, "v"), (4, 1, "d.txt", "((", "v"), (5, 1, None, "((", "v"), (6, 2, "e.json", "{", "v"), (6, 2, "e.json", "{", "w"), (7, 2, "f.xml", "", "v"), (8, 2, "g.js", "", "v"), (9, 2, "h.py", "\ufeffx = 1\n", "v"), (10, 2, "i.json", "[" * 50_000, "v")]
    df = spark.createDataFrame(rows, "file_id int, repo int, file_path string, file_code string, language string")
    got = {r["file_id"] for r in syntax.check_files(df).where("broken").select("file_id").distinct().collect()}
    assert got == {1, 6, 7, 10}
    assert syntax.check_files(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "lang, code, accepted",
    [
        ("java", "record P(int x) { }", ["Java 17"]),
        ("java", "class A { void f(AutoCloseable c) throws Exception { try (c) { } } }", ["Java 11", "Java 17"]),
        ("java", 'class A { String s = """\n  x\n  """; int f(Object o) { if (o instanceof String t) return switch (1) { case 1, 2 -> 3; default -> 4; }; return 0; } }', ["Java 17"]),
        ("java", "class A { int f(Object o) { return o instanceof String ? 1 : 0; } }", ["Java 8", "Java 11", "Java 17"]),
        ("java", "class A { int record = 1; int sealed, yield; }", ["Java 8", "Java 11", "Java 17"]),
        ("java", "class A {", []),
        ("js", "with (a) { b(); }", ["ES2017", "ES2018", "ES2020", "ES2022"]),
        ("js", "with (a) { b ??= c?.d; }", ["ES2022"]),
        ("js", "const {a, ...b} = c; try { f(); } catch { g(); }", ["ES2020", "ES2022", "ES2022 strict"]),
        ("js", "class A { #x = 1; static { f(); } y; }", ["ES2022", "ES2022 strict"]),
        ("py", "def f(a, /, b):\n    return (n := a)\n", ["3.8", "3.10", "3.12"]),
        ("py", "type X[T] = list[T]\n", ["3.12"]),
        ("py", "match x:\n    case 1:\n        pass\n", ["3.10", "3.12"]),
        ("py", "match = type(x)\n", ["3.7", "3.8", "3.10", "3.12"]),
        ("json", "[1]", ["RFC 8259"]),
        ("xml", '<?xml version="1.0" encoding=\'latin-1\'?><a>é</a>', ["XML 1.0"]),
    ],
)
def test_dialects_run_together(lang, code, accepted):
    assert syntax.verdict(lang, code)[:2] == (not accepted, accepted)


def test_a_parse_keeps_to_one_dialect():
    # what one dialect has cannot be joined to what another has, however the stack is shared
    g = Grammar("s = e e ; e = @a A | @b B | C ;", ("s",), (), ("a", "b"), {"a": ("a",), "b": ("b",)})
    a, b, c = g.tid("A"), g.tid("B"), g.tid("C")
    assert [g.accepting(t)[0] for t in ([a, a], [a, b], [c, b], [c, c], [(a, b), (a, b)], [(a, b), a])] == [1, 0, 2, 3, 3, 1]


def test_dialect_rows(spark):
    df = spark.createDataFrame([(1, 1, "a.java", "record P(int x) { }"), (1, 1, "a.java", "record P(int x) { }"), (2, 1, "b.Java", "class {"), (3, 1, "c.java", None), (4, 2, "d.txt", "x")], "file_id int, repo int, file_path string, file_code string").withColumn("language", F.lit(1)).withColumn("accepted", F.lit(1))
    got = {(r["file_id"], r["broken"], tuple(r["accepted"])) for r in syntax.check_files(df).collect()}
    assert got == {(1, False, ("Java 17",)), (2, True, ())}
