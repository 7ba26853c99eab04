from random import Random

import pytest
from pyspark.sql import functions as F

from arcloom.functions import prompts, signatures as sig, texts
from arcloom.operators import clusters, diff, java_source, upsert


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("a.b.Foo.run( Map<String, List<Long>> m, int[] n )", "a.b.Foo.run(Map,int[])"),
        ("a.b.Foo.<init>( final java.util.List<String> x )", "a.b.Foo.Foo(List)"),
        ("a.b.Foo.run(  )", "a.b.Foo.run()"),
        ("run( String... s )", "run(String...)"),
    ],
)
def test_signatures(spark, text, want):
    assert one(spark, sig.normalised(F.col("s")), s=text) == want


def test_names_and_links(spark):
    assert one(spark, sig.git_name(F.col("s")), s="https://git.invalid/owner/name.git") == "owner/name"
    assert one(spark, sig.git_name(F.col("s")), s="git@host:owner/name") == "owner/name"
    assert one(spark, sig.git_name(F.col("s")), s=None) == "no link"
    assert one(spark, sig.git_name(F.col("s")), s="??") == "unknown"
    with pytest.raises(Exception, match="unknown vertex kind"):
        one(spark, sig.kind_label(F.col("s")), s="Nonsense")


def test_texts(spark):
    assert one(spark, texts.lines_of_code(F.col("s")), s="a;\r\n\n // x\n /* y\n * z\n  b;") == 2
    assert one(spark, texts.usecase(F.col("s")), s='ok ```json\n{"description": "d", "flow": "f"}\n```').asDict() == {"description": "d", "flow": "f", "notf": ""}
    assert one(spark, texts.usecase(F.col("s")), s="nothing")["description"] == ""
    assert one(spark, texts.file_plans(F.col("s")), s='```json\n[{"filename": "A", "plan": "p"}]\n```')[0]["filename"] == "A"
    assert one(spark, texts.chunk_content(F.col("s")), s='data: {"choices": [{"delta": {"content": "hi"}}]}') == "hi"
    assert one(spark, texts.chunk_content(F.col("s")), s="data: [DONE]") is None
    assert one(spark, texts.imported(F.col("s")), s="import a.B;\nimport static c.D.*;\n") == ["a.B", "c.D.*"]


def test_upserts_and_deletes(spark):
    old = spark.createDataFrame([(1, 1, "a"), (5, None, "b")], "id int, module int, name string")
    new = spark.createDataFrame([(9, 1, "a"), (8, None, "b"), (7, 2, "c"), (6, 2, "c")], "id int, module int, name string")
    fresh = upsert.new_rows(new, old, ["module", "name"], ["id"])
    assert [(r["id"], r["name"]) for r in fresh.collect()] == [(6, "c")]
    assert [r["id"] for r in upsert.numbered(fresh, old, ["name"]).collect()] == [6]
    m = spark.createDataFrame([(1, 12), (2, 13)], "id int, repo int")
    f = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, module int")
    c = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, feature int")
    e = spark.createDataFrame([(1, 12), (2, None)], "id int, repo int")
    rest = upsert.delete_project(12, m, f, c, e)
    assert {k: sorted(r["id"] for r in v.collect()) for k, v in rest.items()} == {"code_map": [2, 3], "features": [2, 3], "modules": [2], "graph_edge": [2]}
    gone = upsert.delete_feature(2, f, c, m)
    assert [r["id"] for r in gone["modules"].collect()] == [1] and sorted(r["id"] for r in gone["code_map"].collect()) == [1, 3]


def test_diffs_apply():
    for a, b in (("x\ny\nz", "x\nq\nz"), ("", "n"), ("same", "same"), (None, None)):
        d = diff.unified(a, b, "F")
        assert diff.apply_diff(d) == (b or "")
    assert "@@ -1,1 +1,1 @@" in diff.unified("same", "same", "F")


def test_deletable_and_assembled(spark):
    df = spark.createDataFrame([("K", 2, "b", [1, 2]), ("K", 1, "a", [3]), ("K", 3, "c", None)], "k string, pos int, code string, ids array<int>")
    sel = F.array(F.lit(1), F.lit(2))
    assert diff.assembled(df, ["k"], "pos", "code").first()["code"] == "a\nb\nc"
    assert diff.assembled(df, ["k"], "pos", "code", keep=~diff.deletable(F.col("ids"), sel)).first()["code"] == "a"
    assert diff.assembled(df, ["k"], "pos", "code", keep=~diff.deletable(F.col("ids"), sel, True)).first()["code"] == "a\nc"


def test_cluster_measures_against_pairs(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(5)], i % 3) for i in range(24)] + [(99, [0.0] * 5, 7)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")

    def u(v):
        n = sum(x * x for x in v) ** 0.5 or 1
        return [x / n for x in v]

    s = {(i, j): (1 + sum(x * y for x, y in zip(u(a), u(b)))) / 2 for i, a, _ in rows for j, b, _ in rows}
    got = {r["label"]: r for r in clusters.cluster_densities(df, []).collect()}
    for c in range(3):
        own = [i for i, _, x in rows if x == c]
        rest = [i for i, _, x in rows if x != c]
        assert got[c]["intra"] == pytest.approx(sum(s[i, j] for i in own for j in own if i != j) / (len(own) * (len(own) - 1)))
        assert got[c]["inter"] == pytest.approx(sum(s[i, j] for i in own for j in rest) / (len(own) * len(rest)))
    assert got[7]["intra"] is None
    near = clusters.nearest(df, df.where("vec_id < 4"), 5, block=2, chunk=7).collect()
    for i in range(4):
        want = sorted((j for j, _, _ in rows), key=lambda j: (-round(s[i, j], 9), j))[:5]
        assert {r["j"] for r in near if r["i"] == i} == set(want) - {i}


def test_communities_of_two_cliques(spark):
    e = [(1, f"{c}{a}", f"{c}{b}", 1.0) for c in "xy" for a in range(5) for b in range(a)] + [(1, "x0", "y0", 1.0)]
    df = spark.createDataFrame(e, "repo int, src string, dst string, w double")
    got = {r["id"]: r["label"] for r in clusters.cpm_communities(df, ["repo"], 0.3, rounds=10).collect()}
    assert len({got[f"x{i}"] for i in range(5)}) == 1 and len({got[f"y{i}"] for i in range(5)}) == 1 and got["x1"] != got["y1"]


def test_communities_are_settled(spark):
    rnd = Random(5)
    e = {(a, a + 1) for a in range(199)} | {tuple(sorted(rnd.sample(range(200), 2))) for _ in range(250)} | {(0, b) for b in range(1, 60)}
    df = spark.createDataFrame([(1, f"n{a}", f"n{b}", 1.0) for a, b in sorted(e)] + [(2, "a", "b", 1.0)], "repo int, src string, dst string, w double")
    got = {(r["repo"], r["id"]): r["label"] for r in clusters.cpm_communities(df, ["repo"], 0.05).collect()}
    size = {x: sum(v == x for (r, _), v in got.items() if r == 1) for x in got.values()}
    near = {}
    for a, b in e:
        for i, j in ((a, b), (b, a)):
            x = got[1, f"n{j}"]
            near.setdefault(i, {})[x] = near.setdefault(i, {}).get(x, 0) + 1
    for i, w in near.items():
        own = got[1, f"n{i}"]
        stay = w.get(own, 0) - 0.05 * (size[own] - 1)
        assert all(k - 0.05 * size[x] <= stay + 1e-6 for x, k in w.items() if x != own)
    assert got[2, "a"] == got[2, "b"]
    with pytest.raises(RuntimeError):
        clusters.cpm_communities(df, ["repo"], 0.05, rounds=1)


def test_java_arcs(spark):
    a = "package p;\nimport q.Helper;\n@Tag public class A extends Base implements Go {\n Helper h = new Helper();\n Color c;\n static { }\n public void run(int n) { h.help(n); go(); Color x = Color.RED; }\n}\nenum Color { RED }\ninterface Go { void go(); }\nclass Base { void go() { } }\n@interface Tag { }\n"
    b = "package q;\npublic class Helper { public int help(int n) { return n; } }\n"
    df = spark.createDataFrame([(1, 1, a), (2, 1, b), (3, 1, None), (4, 1, "class {{{ broken"), (5, 1, "")], "file_id int, repo int, code string")
    f = java_source.facts_of(df).cache()
    v = java_source.vertices_of(f).cache()
    assert {(r["id"], r["kind"]) for r in v.collect()} >= {("p.A", "Class"), ("p.Color", "Enum"), ("p.Go", "Interface"), ("p.Tag", "Annotation"), ("p.A.run(int)", "Method"), ("p.A.A()", "Constructor"), ("p.A.Helper h", "Field")}
    arcs = {(r["src"], r["dst"], r["arc_kind"]) for r in java_source.arcs_of(f, v).collect()}
    assert {
        ("p.Base", "p.A", "Extends"), ("p.Go", "p.A", "Implements"), ("p.A", "p.A.run(int)", "MethodMember"), ("p.A.Helper h", "q.Helper", "FieldType"), ("p.A.run(int)", "q.Helper.help(int)", "NormalCall"),
        ("p.A.run(int)", "p.Base.go()", "NormalCall"), ("p.A.run(int)", "p.Color", "EnumUse"), ("p.A", "p.Tag", "AnnotationUse"), ("p.A.Helper h", "q.Helper.Helper()", "NormalCall"),
    } <= arcs


def test_prompts(spark):
    m = spark.createDataFrame([(1, 2, "saveUser"), (1, 1, "findUser")], "feature int, pos int, name string")
    p = prompts.feature_prompts(m)
    assert p.first()["prompt"].endswith("- findUser\n- saveUser")
    assert prompts.describe(p, "feature").first()["description"] == "user and find and save"
    assert list(prompts.name_modules([(1, ["list users"]), (2, ["x"])])) == [1, 2]
    waits, tries = [], []

    def fail():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("429 too many")
        return "ok"

    assert prompts.with_retry(fail, sleep=waits.append) == "ok" and len(waits) == 2
    with pytest.raises(ValueError):
        prompts.with_retry(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)
