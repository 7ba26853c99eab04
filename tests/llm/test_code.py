import random

import pytest
from pyspark.sql import functions as F

from arcloom.llm import functions, mixing, provenance, splitting

# -- functions and documentation ---------------------------------------------------------------
DOC = [
    (1, "sortKeys", None, "/** Sorts stable, nulls last. */\n@Override\npublic void sortKeys(int a) {\n  if (a > 0) { run(); }\n}", True),
    (2, "sortKeys", "Sorts the keys.", "/** sort keys */ void sortKeys() { }", False),
    (3, "sortKeys", "n/a", "/**\n * @param a\n * @return x\n */\n@A(b = {1, 2})\nvoid sortKeys(int a) { }", False),
    (4, "sortKeys", "Not thread-safe.", "void sortKeys() { }", True),
    (5, "sortKeys", None, "void sortKeys() {\n // Inside comments do not count here.\n}", False),
    (6, "sortKeys", None, "// ------ Keys ------\n// run(a); b();\n// return null;\nvoid sortKeys() { }", False),
    (7, "sortKeys", None, "@Deprecated\n// 单位为克。\nvoid sortKeys() { }", True),
    (8, "sortKeys", "TODO", "/** auto-generated stub */ void sortKeys() { }", False),
    (9, None, None, None, False),
    (10, None, "Keeps the order.", None, True),
    (11, "run", None, "/* {@inheritDoc} */ abstract List<T> run(int a) throws X;", False),
    (12, "run", None, "/* Gives up early. */ abstract List<T> run(int a) throws X;", True),
    (13, "run", "暂无描述", "/** */ void run() { String s = \"/* no */ { // no\"; char c = '{'; }", False),
    (14, "run", "", "/** Uses a lot of blanks. */" + " " * 20000 + "void run() { /* " + "x" * 200000 + " */ }", True),
]


def test_documented_functions(spark):
    df = spark.createDataFrame([(i, n, d, c, "x") for i, n, d, c, _ in DOC] + [DOC[0][:4] + ("x",)], "func_id int, func_name string, func_desc string, func_code string, name string")
    got = functions.documented(df)
    rows = {r["func_id"]: r for r in got.collect()}
    assert set(rows) == {i for i, *_, want in DOC if want} and got.count() == len(rows)
    assert rows[1]["description"] == "Sorts stable, nulls last." and rows[1]["place"] == "comment" and rows[1]["code"].startswith("@Override")
    assert rows[4]["place"] == "func_desc"
    assert functions.documented(df.limit(0)).count() == 0


def test_functions_of_a_file(spark):
    code = "package p;\n/** Class doc. */\npublic class A {\n  int x = f(1);\n  /** First. */ @X(y = \"{\") A(int a) { this.a = a; }\n  // Second.\n  static <T> Map<T, int[]> go(final T t) {\n    for (int i = 0; i < 3; i++) { new Thread(() -> { run(); }).start(); }\n    Runnable r = new Runnable() { public void run() { } };\n    return null;\n  }\n  abstract void none();\n}\n"
    df = spark.createDataFrame([(1, code), (2, None), (3, ""), (4, "}}}} void odd( {{{")], "k int, c string")
    got = {r["name"]: r for r in functions.functions_of(df, "k", "c").where("key = 1").collect()}
    assert set(got) == {"A", "go", "run", "none"} and got["A"]["comments"] == ["/** First. */"] and got["go"]["comments"] == ["// Second."]
    assert got["go"]["closes"] > got["run"]["closes"] and got["none"]["closes"] is None


def test_methods_without_a_body_in_nested_types(spark):
    code = "interface A {\n  /** Stops it. */ void stop();\n  interface B {\n    /** Goes on. */\n    @X void go(int a);\n    class C { abstract int deep(); void run() { go(1); a.b(2); f(x).g(y); new D(1); } void last(); }\n    int end();\n  }\n}\n"
    got = {r["name"]: r["comments"] for r in functions.functions_of(spark.createDataFrame([(1, code)], "k int, c string"), "k", "c").collect()}
    assert got == {"stop": ["/** Stops it. */"], "go": ["/** Goes on. */"], "deep": [], "run": [], "last": [], "end": []}


def test_python_functions(spark):
    code = "# Module.\nimport os\n\n# Above it.\n@wraps(\n  f)\n# Between.\ndef one(a,\n   b=\"def x():\"):\n    # no\n    \'\'\'Says\n    one.\'\'\'\n    async def inner(): pass\n\nclass A:\n    def two(self): return 1\n    s = \"# no\"\n    def three(self):\n        return \"no\"\n"
    df = spark.createDataFrame([(1, code), (2, None), (3, ""), (4, "def broken("), (5, code.replace("\n", "\r\n"))], "k int, c string")
    got = {(r["key"], r["name"]): [x for x in r["comments"]] for r in functions.python_functions(df, "k", "c").collect()}
    doc = "\'\'\'Says\n    one.\'\'\'"
    assert got == {(k, n): [x.replace("\n", "\r\n") if k == 5 else x for x in c] for k in (1, 5) for n, c in (("one", ["# Above it.", "# Between.", doc]), ("inner", []), ("two", []), ("three", []))} | {(4, "broken"): []}
    said = {r["t"] for r in spark.createDataFrame([(doc,), ("# Above it.",), ("r\"x\"",)], "c string").select(functions.cleaned_python(F.col("c")).alias("t")).collect()}
    assert said == {"Says\none.", "Above it.", "x"}


# -- splitting ---------------------------------------------------------------------------------
SPEC = [("java", 400, 60), ("js", 100, 0)]


def check_pieces(pieces, code, size, overlap):
    assert pieces[0]["start"] == 0 and pieces[-1]["stop"] == len(code)
    for k, p in enumerate(pieces):
        assert p["piece"] == k and p["text"] == code[p["start"] : p["stop"]] and 0 < len(p["text"]) <= size
        if k:
            assert pieces[k - 1]["start"] < p["start"] <= pieces[k - 1]["stop"] < p["stop"]


def test_pieces(spark):
    rnd = random.Random(4)
    lines = ["    call(" + "x" * rnd.randrange(30) + ");" for _ in range(300)]
    files = {
        1: ("a.JAVA", "class A {\r\n" + "\r\n".join(lines) + "\r\n}\r\n"), 2: ("b.java", "x" * 400), 3: ("c.java", "x" * 401), 4: ("d.js", "a;" * 500), 5: ("e.js", "é🙂" * 400), 6: ("f.java", None), 7: ("g.txt", "y" * 9999),
        8: (None, "z" * 9999), 9: ("h\\i.js", "\n" * 250), 10: ("j.js", ""), 11: ("k.java", "\n\n".join("int f" + str(i) + "() { }" for i in range(200))), 12: ("l.java", "\t" * 50000),
    }
    df = spark.createDataFrame([(i, p, c, "q") for i, (p, c) in files.items()] + [(1, *files[1], "q")], "file_id int, file_path string, file_code string, ext string").withColumn("n", F.lit(1))
    spec = spark.createDataFrame(SPEC, "ext string, max_chars int, overlap_chars int").withColumn("file_id", F.lit(0))
    got = {}
    for r in splitting.split(df, spec).collect():
        got.setdefault(r["file_id"], []).append(r)
    assert set(got) == {1, 3, 4, 5, 9, 11, 12}
    for i, ps in got.items():
        size, overlap = (400, 60) if (files[i][0]).lower().endswith("java") else (100, 0)
        check_pieces(sorted(ps, key=lambda r: r["piece"]), files[i][1], size, overlap)
    assert all(p["text"].endswith("\n") for p in got[11][:-1] if p["stop"] < len(files[11][1]))
    first = sorted(got[1], key=lambda r: r["piece"])
    assert all(45 <= a["stop"] - b["start"] <= 90 for a, b in zip(first, first[1:]))


def test_no_pieces(spark):
    files = spark.createDataFrame([(1, "a.java", "x" * 500)], "file_id int, file_path string, file_code string")
    spec = spark.createDataFrame(SPEC, "ext string, max_chars int, overlap_chars int")
    assert splitting.split(files, spec.limit(0)).count() == 0 and splitting.split(files.limit(0), spec).count() == 0


def test_chain_equals_the_greedy_walk(spark):
    links = {(f, s): s + 3 + (s * f) % 5 for f in (1, 2, 3) for s in range(100)}
    df = spark.createDataFrame([(f, s, n) for (f, s), n in links.items()], "file_id int, pos int, next int")
    want = set()
    for f in (1, 2, 3):
        s = 0
        while s is not None:
            want.add((f, s))
            s = links.get((f, s))
    want = {(f, s) for f, s in want}
    assert {(r["file_id"], r["pos"]) for r in splitting.reachable(df).collect()} == want


def greedy(bounds, max_chars, overlap):
    """A plain walk: each piece ends at the best boundary it may end at, by the starts given."""
    n, slack = max(bounds), min(overlap // 4, (max_chars - overlap) // 4)
    at, out = 0, []
    while at < n:
        s = bounds[at][1]
        reach = s + max_chars
        end = n if reach >= n else None
        for r, share in ((1, 0.6), (2, 0.4), (3, 0.25), (4, 0.1)):
            near = [p for p, (rank, _) in bounds.items() if rank <= r and p <= reach]
            if end is None and near and max(near) >= max(s + overlap + slack + 1, s + max_chars * share):
                end = max(near)
        end = max(p for p in bounds if p <= reach) if end is None else end
        out.append((s, end))
        at = end
    return out


def test_any_limit_and_overlap(spark):
    rnd = random.Random(12)
    pieces_of = ["x", "é", "🙂", " ", "\t", "\n", "\r\n", "\r", ";", "}\n", "\n\n", "call(a, b);", "long" * 20, "for (;;) {\n"]
    files, spec = [], []
    for i in range(70):
        most = rnd.choice([1, 2, 3, 5, 8, 20, 60, 100, 200])
        over = rnd.choice([0, most - 1, rnd.randrange(most), most // 10])
        text = "x" * rnd.choice([1, 100, 700]) if i % 5 == 0 else "".join(rnd.choice(pieces_of) for _ in range(rnd.randrange(200)))
        files.append((i, f"f.e{i}", text))
        spec.append((f"e{i}", most, over))
    f, s = spark.createDataFrame(files, "file_id int, file_path string, file_code string"), spark.createDataFrame(spec, "ext string, max_chars int, overlap_chars int")
    got, bounds = {}, {}
    for r in splitting.split(f, s).collect():
        got.setdefault(r["file_id"], []).append(r)
    for r in splitting.starts_of(splitting.boundaries_of(splitting.oversized(f, s))).collect():
        bounds.setdefault(r["file_id"], {})[r["pos"]] = (r["rank"], r["start"])
    for (i, _, text), (_, most, over) in zip(files, spec):
        assert (i in got) == (len(text) > most)
        if i in got:
            ps = sorted(got[i], key=lambda r: r["piece"])
            check_pieces(ps, text, most, over)
            assert all(over <= a["stop"] - b["start"] <= over + max(1, over // 4) for a, b in zip(ps, ps[1:]))
            assert [(p["start"], p["stop"]) for p in ps] == greedy(bounds[i], most, over)


@pytest.mark.parametrize("most, over", [(0, 0), (10, 10), (10, -1), (-5, 0)])
def test_a_spec_that_cannot_be_met_is_an_error(spark, most, over):
    f = spark.createDataFrame([(1, "a.java", "x" * 500)], "file_id int, file_path string, file_code string")
    with pytest.raises(Exception, match="split spec"):
        splitting.split(f, spark.createDataFrame([("java", most, over)], "ext string, max_chars int, overlap_chars int")).collect()


# -- mixing ------------------------------------------------------------------------------------
def test_pivot_keeps_tokens_and_rounds():
    rnd = random.Random(8)
    for n in (0, 1, 2, 50, 999):
        rows = [(i, float(rnd.randrange(1, 400)), rnd.random()) for i in range(n)]
        want = sum(s * p for _, s, p in rows)
        done, left = mixing.pivot(rows, 1, 0)
        size = {i: s for i, s, _ in rows}
        assert len(done) + (left is not None) == n and {u for _, u in done} <= {0, 1}
        assert sum(size[i] * u for i, u in done) + (left[1] * left[2] if left else 0) == pytest.approx(want, abs=1e-4)
    up = sum(dict(mixing.pivot([(1, 10.0, 0.3), (2, 10.0, 0.7)], s, 0)[0]).get(1, 0) for s in range(2000))
    assert 500 < up < 700


def test_a_text_of_an_unlisted_source_counts_for_the_listed_one_that_has_it_too(spark):
    docs = spark.createDataFrame([(1, "shared words", "other"), (2, "shared words", "a"), (3, "more words here", "b")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    got = {(r["source"], r["doc_id"]) for r in mixing.sized_texts(docs, targets).collect()}
    assert got == {("a", 2), ("b", 3)}


def test_mix(spark):
    rnd = random.Random(6)
    docs = [(i, f"text {i} " + "word " * rnd.randrange(1, 60), rnd.choice(["A", "a", "b", " B", "c"])) for i in range(600)]
    docs += [(1000, None, "a"), (1001, "", "a"), (1002, "no source", None), (1003, "other", "zzz"), (1004, docs[0][1], docs[0][2]), (1005, docs[1][1], "c")]
    t = [("a", 0.5, 2), ("B", 0.3, 3), ("c", 0.1, 1), ("none", 0.1, 4), ("C", 0.05, 9), ("zero", 0.0, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(1)).withColumn("copies", F.lit(1))
    chosen, planned = mixing.mix(df, spark.createDataFrame(t, "source string, target_share double, max_repeats int"), bucket=40, group=3)
    rows, plan = chosen.collect(), {r["source"]: r for r in planned.collect()}
    text = {i: x for i, x, _ in docs}
    uses, got = {}, {}
    for r in rows:
        assert text[r["doc_id"]] and r["copies"] <= plan[r["source"]]["max_repeats"]
        assert text[r["doc_id"]] not in uses
        uses[text[r["doc_id"]]] = r["copies"]
        got[r["source"]] = got.get(r["source"], 0) + r["tokens"] * r["copies"]
    assert set(plan) == {"a", "b", "c", "none", "zero"} and plan["none"]["target"] == 0 and plan["c"]["max_repeats"] == 1
    for s in ("a", "b", "c"):
        assert abs(got[s] - plan[s]["target"]) <= 80
    again, _ = mixing.mix(df, spark.createDataFrame(t, "source string, target_share double, max_repeats int"), bucket=40, group=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(df, t)[0].count() == 0 and mixing.mix(df, t.limit(0))[0].count() == 0


# -- provenance --------------------------------------------------------------------------------
def java(name, rnd):
    verbs, nouns = ["load", "store", "merge", "check", "count", "render"], ["Invoice", "Customer", "Report", "Address", "Shipment", "Contract"]
    body = ""
    for _ in range(8):
        v, n = rnd.choice(verbs), rnd.choice(nouns)
        body += f"    // Handles case {rnd.randrange(10**6)} of the {n.lower()} rules\n    public {n} {v}{n}(String code, List<{n}> rows) {{\n        for ({n} row : rows) {{ if (row.getCode().equals(code + {rnd.randrange(999)})) {{ return row; }} }}\n        return null;\n    }}\n"
    return f"package org.app.{name.lower()};\n\nimport java.util.List;\n\npublic class {name} {{\n{body}}}\n"


def test_provenance(spark):
    rnd = random.Random(11)
    rows = [(i, i % 6, f"src/main/java/org/app/r{i % 6}/Own{i}.java", java(f"Own{i}", rnd)) for i in range(60)]
    lib = java("RingPool", rnd)
    rows += [(100 + r, r, f"src/main/java/ringlib/core/RingPool.java", lib.replace("999", str(r))) for r in range(5)]
    gen = "package a;\npublic final class G implements java.io.Serializable {\n" + "".join(f"    private String title{i}_;\n    public String getTitle{i}() {{ return title{i}_; }}\n" for i in range(40)) + "}\n"
    mini = "!function(e,t){" + "".join(f"var {a}{b}=function({a},n){{for(var r=0;r<n;r++){a}[r]^=t;return {a}}};" for a in "abcdefgh" for b in "xyz") + "}(this,1);"
    data = "public class T {\n    static final int[] ROWS = {\n" + ",\n".join("        " + ", ".join(str(rnd.randrange(10**5)) for _ in range(10)) for _ in range(40)) + "\n    };\n}\n"
    notice = "// This file was created automatically, any change will be lost.\n" + java("Noted", rnd)
    decoy = "/* generated ids start at 100 */\n" + java("Decoy", rnd)
    script = "const api = require('./api');\nasync function loadCustomer(identifier) {\n  const response = await api.fetch(identifier);\n  return response.customer;\n}\nfunction renderInvoice(invoice, target) { target.append(invoice.title); }\n"
    rows += [(300 + k, k, f"web/src/own/page{k}.js", script.replace("Invoice", f"Invoice{'ABCDEFGH'[k]}list")) for k in range(8)]
    dump = "\n".join(f"{i * 16:08x}: " + " ".join(f"{rnd.randrange(256):02x}" for _ in range(16)) for i in range(60))
    rows += [(200, 1, "src/main/java/a/G.java", gen), (201, 1, "web/x.js", mini), (202, 2, "src/main/java/a/T.java", data), (203, 2, "src/main/java/a/Noted.java", notice), (204, 3, "src/main/java/a/Decoy.java", decoy)]
    rows += [(205, 3, "src/main/java/a/Dump.java", dump), (206, 3, "src/main/java/a/N.java", None), (207, 4, "a/b/c.json", '{"name": "x", "weights": [1, 2, 3]}'), (208, None, None, "class A { }"), (209, 4, "x/y/z.java", ""), (200, 1, "src/main/java/a/G.java", gen)]
    df = spark.createDataFrame(rows, "file_id int, repo int, file_path string, file_code string").withColumn("lang", F.lit("q")).withColumn("folder", F.lit("q"))
    got = {r["file_id"]: r["kind"] for r in provenance.judged(df).collect()}
    assert got == {200: "generated", 201: "minified", 202: "data", 203: "generated"} | {100 + r: "vendored" for r in range(5)}
    assert provenance.judged(df.limit(0)).count() == 0


def test_a_library_in_one_repository_is_found_by_its_style(spark):
    rnd = random.Random(12)
    rows = [(i, i % 6, f"src/main/java/org/app/{['billing', 'orders', 'rules'][i % 3]}/Own{i}.java", java(f"Own{i}", rnd)) for i in range(120)]
    lib = java("RingPool", rnd).replace("org.app.ringpool", "qwyxzk.vjq")
    rows += [(500, 2, "src/main/java/qwyxzk/vjq/RingPool.java", lib)]
    # a folder with a name that the repository's own names suggest, and other names of the same folder with other lines
    rows += [(501, 3, "src/main/java/org/app/customer/Lone.java", java("Lone", rnd))]
    rows += [(600 + r, r, f"src/main/java/org/app/report/Same.java", java(f"Same{r}", rnd)) for r in range(6)]
    df = spark.createDataFrame(rows, "file_id int, repo int, file_path string, file_code string")
    assert {r["file_id"]: r["kind"] for r in provenance.judged(df).collect()} == {500: "vendored"}


def test_long_headers_hide_neither_notices_nor_declarations():
    licence = "/*\n" + " * These terms say nothing of use to anybody.\n" * 80 + " */\n"
    at = [c.strip().split(" ")[0] for c in provenance._MEASURES.split(",")][2:]
    for code, notice in (("// auto-generated by a tool\nclass A { }\n", True), ('package a;\nimport b.C;\n@Generated("x")\npublic class A { }\n', True), ("class A { }\n// " + "x " * 400 + "\n// auto-generated by a tool\n", False)):
        got = dict(zip(at, provenance.measure("a/A.java", licence + code, "java")))
        assert got["declares"] and got["notice"] == notice
    got = dict(zip(at, provenance.measure("a/A.java", licence.replace("nothing", "class") + "run(1);\n", "java")))
    assert not got["declares"]
