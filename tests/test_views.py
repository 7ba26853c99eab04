import json
import random

import pytest
from pyspark.sql import functions as F

from arcloom.functions import prompts, signatures, texts
from arcloom.operators import diff, upsert, views
from arcloom.operators import java_source as js
from arcloom.sources import files
from arcloom.tables import cut


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first()[0]


# -- slices and selections ----------------------------------------------------------------------
def graph(spark):
    arcs = [(1, "a", "b"), (1, "b", "c"), (1, "c", "b"), (1, "d", "c"), (2, "a", "x")]
    return spark.createDataFrame(arcs, "repo int, src string, dst string")


def test_slices_and_what_a_selection_touches(spark):
    entries = spark.createDataFrame([(1, "d"), (1, "a"), (2, "a"), (1, "a")], "repo int, id string")
    numbers = cut(views.numbered_slices(entries, ["repo"]))
    assert {(r["repo"], r["id"]): r["slice"] for r in numbers.collect()} == {(1, "a"): 1, (1, "d"): 2, (2, "a"): 3}
    slices = views.slice_members(numbers, graph(spark), ["repo"])
    assert {(r["slice"], r["id"]) for r in slices.collect()} == {(1, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "c"), (2, "b"), (3, "a"), (3, "x")}
    own = spark.createDataFrame([(7, 1, "a"), (8, 1, "b"), (9, 1, "none")], "feature int, repo int, id string")
    choice = views.selected(own, slices, "feature", ["repo"])
    assert {(r["feature"], r["slice"]) for r in choice.collect()} == {(7, 1), (8, 1), (8, 2)}
    nodes, arcs = views.max_graph(choice, slices, graph(spark), "feature", ["repo"])
    assert {r["id"] for r in nodes.where("feature = 7").collect()} == {"a", "b", "c"} and nodes.where("feature = 9").isEmpty()
    assert {(r["src"], r["dst"]) for r in arcs.where("feature = 8").collect()} == {("a", "b"), ("b", "c"), ("c", "b"), ("d", "c")}
    got = {(r["feature"], r["id"]): r["owned"] for r in views.touched(choice, slices, "feature", ["repo"]).collect()}
    assert got[7, "a"] and not got[7, "b"] and all(got[8, x] for x in "abcd")


def test_groups_of_slices_say_what_their_nodes_say(spark):
    rnd = random.Random(3)
    arcs = [(r, f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for r in (1, 2, 3) for _ in range(45)] + [(1, "n1", "n1"), (1, "n1", "n1")]
    a = spark.createDataFrame(arcs, "repo int, src string, dst string")
    entries = spark.createDataFrame([(r, f"n{rnd.randrange(40)}") for r in (1, 2, 3) for _ in range(9)] + [(3, None), (5, "lone")], "repo int, id string")
    own = spark.createDataFrame([(f, 1 + f % 3, f"n{rnd.randrange(40)}") for f in range(30) for _ in range(2)] + [(97, 5, "lone"), (96, 5, "none")], "feature int, repo int, id string")
    seen = None
    for limit in (10**6, 47, 1):
        members, groups = views.slice_groups(entries, a, ["repo"], limit=limit)
        assert members.count() == members.select("repo", "id").distinct().count() == groups.agg(F.sum("nodes")).first()[0]
        chosen, hits = views.selections(own, members, groups, "feature", ["repo"])
        rows = sorted((r["feature"], r["repo"], r["id"]) for r in views.held(chosen, hits, members, "feature", ["repo"], rows=50).collect())
        t = chosen.join(hits, ["repo", "like"]).join(groups, ["repo", "group"]).groupBy("feature").agg(F.sum("nodes"), F.sum("arcs"), F.sum(F.when(F.col("owned"), F.col("nodes")).otherwise(0)))
        got = rows, sorted(map(tuple, t.collect()))
        assert seen is None or got == seen
        seen = got
    pairs = a.distinct()  # the plain way
    slices = cut(views.slice_members(cut(views.numbered_slices(entries.where("id is not null"), ["repo"])), pairs, ["repo"]))
    choice = cut(views.selected(own, slices, "feature", ["repo"]))
    nodes, out = views.max_graph(choice, slices, pairs, "feature", ["repo"])
    assert sorted(map(tuple, nodes.select("feature", "repo", "id").collect())) == seen[0]
    degree = {r["feature"]: r["count"] for r in out.groupBy("feature").count().collect()}
    owned = {r["feature"]: r["n"] for r in views.touched(choice, slices, "feature", ["repo"]).groupBy("feature").agg(F.count_if("owned").alias("n")).collect()}
    n = {r["feature"]: r["count"] for r in nodes.groupBy("feature").count().collect()}
    assert [(f, n[f], degree.get(f, 0), owned[f]) for f in sorted(n)] == seen[1]


def test_deep_graphs_are_grouped_in_one_task(spark):
    a = spark.createDataFrame([(4, f"c{k}", f"c{k + 1}") for k in range(3000)] + [(4, "c2999", "c2000")], "repo int, src string, dst string")
    members, groups = views.slice_groups(spark.createDataFrame([(4, "c1"), (4, "c0"), (4, "c2500")], "repo int, id string"), a, ["repo"])
    assert sorted((len(r["slices"]), r["nodes"], r["arcs"]) for r in groups.collect()) == [(1, 1, 1), (2, 1999, 1999), (3, 1001, 1001)] and members.count() == 3001


def test_code_without_a_selection(spark):
    members = spark.createDataFrame([("T", 1, 10, "one"), ("T", 2, 20, "two"), ("T", 3, 30, "three"), ("U", 4, 1, "four")], "top string, member int, pos int, code string")
    owners = spark.createDataFrame([(7, 1), (7, 1), (8, 1), (7, 2), (9, 4)], "feature int, member int")
    drop = {(r["feature"], r["top"]): (r["origin"], r["rest"], r["members"], r["left"]) for r in views.member_code(members, owners, "feature").collect()}
    assert drop == {(7, "T"): ("one\ntwo\nthree", "one", 3, 1), (8, "T"): ("one\ntwo\nthree", "one\ntwo", 3, 2), (9, "U"): ("four", "", 1, 0)}
    keep = {(r["feature"], r["top"]): r["rest"] for r in views.member_code(members, owners, "feature", keep_unbound=True).collect()}
    assert keep == {(7, "T"): "one\nthree", (8, "T"): "one\ntwo\nthree", (9, "U"): ""}
    for (f, t), (origin, rest, *_) in drop.items():
        d = diff.unified(origin, rest, t)
        assert diff.apply_diff(d) == rest


def test_nesting_goes_from_the_inside_out(spark):
    rows = [(1, "A", None, 1, "a"), (1, "A.B", "A", 5, "b"), (1, "A.C", "A", 2, "c"), (1, "A.B.D", "A.B", 1, "d"), (1, "Z", None, 2, "z")]
    df = spark.createDataFrame(rows, "repo int, id string, owner string, pos int, code string")
    assert {r["id"]: r["code"] for r in views.nested(df, ["repo"]).collect()} == {"A": "a\nc\nb\nd", "Z": "z"}
    assert views.nested(df.where("owner is null"), ["repo"]).count() == 2 and views.nested(df.limit(0), ["repo"]).count() == 0


def test_lookups_overlays_and_positions(spark):
    classes = spark.createDataFrame([(1, "p.q.A"), (1, "p.B"), (1, "p.C")], "repo int, id string")
    code = spark.createDataFrame([(1, "p.q.A", "exact"), (1, "x.p.q.A", "no"), (1, "long.p.B", "suffix"), (2, "p.C", "other")], "repo int, id string, code string")
    assert {r["id"]: r["code"] for r in views.looked_up(classes, code, ["repo"]).collect()} == {"p.q.A": "exact", "p.B": "suffix", "p.C": None}
    new = classes.limit(0).unionByName(spark.createDataFrame([(1, "p.B"), (1, "n")], "repo int, id string"))
    assert {r["id"]: r["type"] for r in views.overlay(classes, new, ["repo", "id"]).collect()} == {"p.q.A": "Default", "p.B": "Modify", "p.C": "Default", "n": "Modify"}
    m = spark.createDataFrame([("o", 1, True), ("o", 2, False), ("o", 3, True), ("o", 4, True)], "outer string, pos int, kept boolean")
    assert [r["at"] for r in views.insert_positions(m, ["outer"]).orderBy("pos").collect()] == [0, 1, 1, 2]


# -- edits --------------------------------------------------------------------------------------
def test_edits_of_a_feature(spark):
    features = spark.createDataFrame([(1, 5, 1, "old"), (2, 5, 2, "b")], "id int, module int, feature_id int, feature_desc string")
    bound = spark.createDataFrame([(10, 2, "p.A.f( )")], "id int, feature int, method_name string")
    edges = spark.createDataFrame([(1, "p.A", "p.B")], "repo int, src string, dest string")
    methods = spark.createDataFrame([("p.A.f( )",), ("p.A.g( )",), ("p.A.g( )",)], "method_name string")
    arcs = upsert.package_edges(spark.createDataFrame([(1, "p.A")], "repo int, id string"), spark.createDataFrame([(1, "p.A"), (1, "p.B"), (1, "q.C"), (1, "p.s.D")], "repo int, id string"))
    arcs = arcs.withColumnRenamed("dst", "dest")
    got = upsert.edit_feature(1, "new", features, bound, edges, methods, arcs)
    assert {r["id"]: r["feature_desc"] for r in got["features"].collect()} == {1: "new", 2: "b"}
    assert [tuple(r) for r in got["new_methods"].collect()] == [(11, 1, "p.A.g( )")] and [tuple(r) for r in got["new_edges"].collect()] == [(1, "p.B", "p.A")]
    added = upsert.edit_feature(None, "fresh", features, bound, edges, methods, arcs, module=5)
    assert (3, 5, 3, "fresh") in {tuple(r) for r in added["features"].collect()} and added["new_methods"].first()["feature"] == 3


def test_cascading_inserts(spark):
    m = spark.createDataFrame([(4, 1, 0, None)], "id int, repo int, cluster_id int, module_desc string")
    f = spark.createDataFrame([(6, 4, 1)], "id int, module int, feature_id int")
    c = spark.createDataFrame([(9, 6, "x")], "id int, feature int, method_name string")
    rows = spark.createDataFrame([(1, 0, None, 1, "x"), (1, 0, None, 1, "y"), (1, 0, None, 2, "x"), (1, 7, "m", 1, "x"), (1, 7, "m", 1, "x")], "repo int, cluster_id int, module_desc string, feature_id int, method_name string")
    got = upsert.insert_rows(rows, m, f, c)
    assert [(r["id"], r["module_desc"]) for r in got["modules"].collect()] == [(5, "m")]
    assert {(r["id"], r["module"], r["feature_id"]) for r in got["features"].collect()} == {(7, 4, 2), (8, 5, 1)}
    assert {(r["feature"], r["method_name"]) for r in got["code_map"].collect()} == {(6, "y"), (7, "x"), (8, "x")}
    again = upsert.insert_rows(rows.limit(2), m, f, c.unionByName(got["code_map"].select(*[F.col(k).cast("int") if k != "method_name" else F.col(k) for k in c.columns])))
    assert all(df.isEmpty() for df in again.values())


# -- Java ---------------------------------------------------------------------------------------
JAVA = """package p;
import lombok.Data;
@Data
class A extends Base {
  private String name; static int n; boolean open;
  static { n = 1; }
  A() { this("x"); }
  A(String s) { super(s); }
  Map<String, int[]> go(Map<String, List<B>> m, final B b) {
    m.values().forEach(x -> b.run());
    list.stream().map(B::size).map(this::help).map(A::new);
    return null;
  }
  int help(B b) { return 1; }
  void setName(String other) { }
}
"""


def sources(spark, *codes):
    return spark.createDataFrame([(i, 1, c) for i, c in enumerate(codes)], "file_id int, repo int, code string")


def test_java_calls_and_accessors(spark):
    base = "package p;\nclass Base { Base(String s) { } }\n"
    b = "package p;\nclass B { void run() { } int size() { return 0; } }\n"
    f = cut(js.facts_of(sources(spark, JAVA, base, b)))
    v = cut(js.vertices_of(f))
    ids = {r["id"]: r["annotations"] for r in v.where("kind in ('Method', 'Constructor')").collect()}
    made = {i for i, a in ids.items() if a == ["lombok.Generated"]}
    assert made == {"p.A.getName()", "p.A.isOpen()", "p.A.setOpen(boolean)"}  # the declared setter stays, static fields have none
    calls = {(r["src"], r["dst"]) for r in js.arcs_of(f, v).where("arc_kind = 'NormalCall'").collect()}
    go = "p.A.go(Map, B)"
    assert {("p.A.A()", "p.A.A(String)"), ("p.A.A(String)", "p.Base.Base(String)"), (go, "p.B.run()"), (go, "p.B.size()"), (go, "p.A.help(B)")} <= calls
    assert any(s == go and d in ("p.A.A()", "p.A.A(String)") for s, d in calls)
    got = {r["method_signature"]: r for r in js.methods_of(f, sources(spark, JAVA, base, b)).collect()}
    assert "p.A.go( Map<String, List<B>> m, B b )" in got and got["p.A.<init>( String s )"]["method_code"] == "  A(String s) { super(s); }"
    assert {r["type"] for r in js.unresolved(f, v).collect()} >= {"Map", "String", "List"}


def test_overloads_by_the_types_of_arguments(spark):
    code = "package p;\nclass A {\n  void f(int a) { } void f(String a) { } void f(Long a) { } void f(B b) { } void f(int a, String b) { }\n  void s(String x) { f(x); } void i() { f(7); } void l() { f(7L); } void n() { f(new B()); } void two() { f(1, g(2)); } int g(int q) { return q; }\n}\nclass B { }\n"
    f = cut(js.facts_of(sources(spark, code)))
    got = {(r["src"], r["dst"]) for r in js.arcs_of(f, js.vertices_of(f)).where("arc_kind = 'NormalCall'").collect()}
    want = {("p.A.s(String)", "p.A.f(String)"), ("p.A.i()", "p.A.f(int)"), ("p.A.l()", "p.A.f(Long)"), ("p.A.n()", "p.A.f(B)"), ("p.A.n()", "p.B.B()"), ("p.A.two()", "p.A.f(int, String)"), ("p.A.two()", "p.A.g(int)")}
    assert got == want


def test_java_that_breaks(spark):
    good, bad = "class A { void f() { } }", "class A {\n  void f() {\n    g(;\n"
    f = js.facts_of(sources(spark, good, bad, "", "}}}"))
    assert {(r["file_id"], r["start"]) for r in f.where("fact = 'broken'").collect()} == {(1, 2)}
    with pytest.raises(Exception, match="breaks at line"):
        js.facts_of(sources(spark, bad), mode="FAILFAST").count()
    assert js.facts_of(sources(spark, good), mode="FAILFAST").count() > 0
    a, b = ("class A { { " + "run(1); " * 60 + x + "(2); } }" for x in ("one", "two"))
    both = js.vertices_of(js.facts_of(sources(spark, a.replace("} }", "} { " + "run(1); " * 60 + "two(2); } }")))).where("kind = 'NormalInitializer'")
    assert both.count() == 2


def test_marks_of_annotations(spark):
    a = F.split("s", " ")
    assert one(spark, js.marked(a), s="lombok.Getter Other") == ["lombok.Getter", "Other", "ltm.lombok.Getter"]
    assert one(spark, js.restored(a), s="Getter Other ltm.lombok.Getter") == ["Getter", "Other"]


# -- texts and files ----------------------------------------------------------------------------
def test_signatures_of_any_depth(spark):
    s = "p.A.f( Map<String, List<Map<A, B<C<D<E<F<G>>>>>>>> m, @X(a, b) final int[] n, java.util.Date d )"
    assert one(spark, signatures.normalised(F.col("s")), s=s) == "p.A.f(Map,int[],Date)"
    assert one(spark, signatures.normalised(F.col("s")), s="p.A.<init>(  )") == "p.A.A()"


def test_replies(spark):
    assert one(spark, texts.first_object(F.col("s")), s='x ```json {"a": "}{", "b": {"c": 1}} ``` {"d": 2}') == '{"a": "}{", "b": {"c": 1}}'
    assert one(spark, texts.first_object(F.col("s")), s="none") is None and one(spark, texts.first_object(F.col("s")), s=None) is None
    nested = json.dumps({"Actor": "Clerk", "Steps": ["open", {"then": "close"}], "": None, "None": None})
    assert one(spark, texts.bullet_text(F.col("s")), s=nested) == "- Actor: Clerk\n- Steps: - open\n- then: close\n- None"
    assert one(spark, texts.bullet_text(F.col("s")), s=" plain ") == "plain"
    reply = 'so ```json {"needAdditionalFile": true, "additionalFileList": [{"filename": "a.B", "recommendReason": "r"}]} ``` end'
    assert one(spark, texts.needed_files(F.col("s")), s=reply)["files"][0]["filename"] == "a.B" and not one(spark, texts.needed_files(F.col("s")), s="no")["need"]
    assert one(spark, texts.file_plans(F.col("s")), s='```json\n{"modifiedFileList": [{"filename": "A", "plan": "p"}]}\n```')[0]["plan"] == "p"
    assert one(spark, texts.line_slice(F.split("s", "\n"), F.lit(2), F.lit(3)), s="a\nb\nc\nd") == "b\nc"


def test_edit_pipeline():
    asked = []

    def generate(prompts_):
        asked.extend(prompts_)
        out = []
        for p in prompts_:
            if "is enough" in p:
                out.append('```json {"needAdditionalFile": true, "additionalFileList": [{"filename": "a.C"}, {"filename": "gone"}]} ```')
            elif "Plan the change" in p:
                out.append('```json {"modifiedFileList": [{"filename": "a.B", "plan": "add f", "note": "n"}, {"filename": "a.N", "plan": "new"}]} ```')
            else:
                out.append("```java\nclass X { }\n```")
        return out

    got = prompts.edit_feature("wanted", {"a.B": "class B"}, generate, {"a.C": "class C", "a.D": "class D"}, "before")
    assert got == {"a.B": "class X { }", "a.N": "class X { }"} and len(asked) == 4
    assert "class C" in asked[1] and "class D" not in asked[1] and "before" in asked[0] and "add f" in asked[2]
    assert prompts.imports_for("a.B", "class B", ["a.C"], lambda p: ["```java\nimport a.C;\nimport java.util.List;\n```"]) == ["import a.C;", "import java.util.List;"]
    with pytest.raises(ValueError):
        prompts.imports_for("a.B", "", [], lambda p: ["nothing"])


def test_sibling_context(spark):
    features = spark.createDataFrame([(i, 1) for i in range(1, 7)] + [(9, None)], "id int, module int")
    code = spark.createDataFrame([(1, "A", "a"), (2, "A", "again"), (2, "B", "b"), (5, "C", "late"), (9, "D", "d")], "feature int, class_id string, code string")
    assert [tuple(r) for r in prompts.sibling_context(features, code).collect()] == [(1, "a\nb")]


def test_trees_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("p/A.java", "class A {\n}\n"), ("p/q/B.java", "class B { }"), ("p/E.java", None), (None, "x")], "path string, code string")
    root = str(tmp_path / "out")
    for _ in range(2):
        files.write_tree(df, root)
    got = {r["path"]: r["code"] for r in files.source_tree(spark, root).collect()}
    assert got["p/A.java"] == "class A {\n}\n" and got["p/q/B.java"] == "class B { }"
    assert {r["path"].rsplit("/", 1)[-1] for r in files.file_paths(spark, root).collect()} == {"A.java", "B.java"}
    with pytest.raises(Exception, match="leaves the folder"):
        files.write_tree(spark.createDataFrame([("../x", "y")], "path string, code string"), root)
    up = spark.createDataFrame([(["one", "two", "three"], ["a", "b"])], "files array<string>, paths array<string>")
    assert {tuple(r) for r in files.paired(up).collect()} == {("a", "one"), ("b", "two")}


def test_rewritten_source(spark):
    got = spark.createDataFrame([("p", ["import a;"], "class A { }"), ("", [], "class B { }")], "p string, i array<string>, b string").select(diff.rewritten(F.col("p"), F.col("i"), F.col("b")).alias("x"))
    assert [r["x"] for r in got.collect()] == ["package p;\n\nimport a;\n\nclass A { }", "class B { }"]
