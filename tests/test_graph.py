
from pyspark.sql import functions as F

from arcloom.operators import graph

ARCS = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (2, "a", "x"), (1, "e", "e")]


def arcs(spark):
    return spark.createDataFrame(ARCS, "repo int, src string, dst string")


def test_closure_handles_cycles_groups_and_nulls(spark):
    seeds = spark.createDataFrame([(1, "a"), (2, "a"), (1, "e"), (1, None)], "repo int, id string")
    got = {tuple(r) for r in graph.closure(seeds, arcs(spark), ["repo"], depth="d").select("repo", "id", "d").collect()}
    assert got == {(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "d", 3), (2, "a", 0), (2, "x", 1), (1, "e", 0)}


def test_closure_of_nothing(spark):
    seeds = spark.createDataFrame([], "repo int, id string")
    assert graph.closure(seeds, arcs(spark), ["repo"]).count() == 0


def test_entries(spark):
    m = spark.createDataFrame([(1, "a", False, []), (1, "z", False, None), (1, "y", True, []), (1, "w", None, ["lombok.Generated"])], "repo int, id string, is_abstract boolean, annotations array<string>")
    assert [r["id"] for r in graph.entries(m, arcs(spark), ["repo"]).collect()] == ["z"]


VERTICES = [("m1", "Method"), ("m2", "Method"), ("f1", "Field"), ("init", "StaticInitializer"), ("E", "Enum"), ("C", "Class"), ("P", "Interface"), ("Out", "Class"), ("Ann", "Annotation"), ("m3", "Method"), ("T", "Class"), ("lone", "Method")]
TYPED = [
    ("m1", "m2", "CallArc", "NormalCall"), ("m2", "f1", "UseReference", "FieldUse"), ("init", "f1", "UseReference", "FieldDef"), ("init", "m3", "CallArc", "NormalCall"),
    ("m2", "E", "UseReference", "EnumUse"), ("m1", "T", "MethodReference", "ParameterType"), ("C", "m1", "MemberArc", "MethodMember"), ("C", "f1", "MemberArc", "FieldMember"),
    ("P", "C", "ParentArc", "Implements"), ("Out", "C", "InnerArc", "InnerClass"), ("C", "Ann", "AnnotationReference", "AnnotationUse"), ("m1", "init", "CallArc", "InitializerCall"),
]


def by_rules():
    kind = dict(VERTICES)
    code = {v for v, k in VERTICES if k not in ("Enum", "Class", "Interface", "Annotation")}
    s, grown = {"m1"}, True
    while grown:
        new = set()
        for a, b, g, k in TYPED:
            if k == "NormalCall" and a in s and a in code:
                new.add(b)
            if g == "UseReference" and a in s and (a in code or kind[a] == "Enum"):
                new.add(b)
            if k == "FieldDef" and b in s and kind[a].endswith("Initializer"):
                new.add(a)
        grown = not new <= s
        s |= new
    t = {x for x in s if x not in code}
    for a, b, g, k in TYPED:
        if a in s and a in code and g in ("FieldReference", "MethodReference", "AnnotationReference"):
            t.add(b)
        if b in s and g == "MemberArc" and b in code:
            t.add(a)
    grown = True
    while grown:
        new = {a for a, b, g, k in TYPED if b in t and g in ("ParentArc", "InnerArc")} | {b for a, b, g, k in TYPED if a in t and g == "AnnotationReference"}
        grown = not new <= t
        t |= new
    return s | t


def test_slice_equals_the_rules_applied_one_by_one(spark):
    v = spark.createDataFrame(VERTICES, "id string, kind string")
    a = spark.createDataFrame(TYPED, "src string, dst string, arc_group string, arc_kind string")
    seeds = spark.createDataFrame([(7, "m1")], "slice int, id string")
    members, used = graph.slice_graph(seeds, v, a, ["slice"])
    assert {r["id"] for r in members.collect()} == by_rules()
    ends = {x for r in used.collect() for x in (r["src"], r["dst"])}
    assert ("m1", "init") not in {(r["src"], r["dst"]) for r in used.where("arc_kind = 'InitializerCall'").collect()} and "lone" not in ends


def test_dispatch_takes_the_nearest_owner_and_overriders(spark):
    calls = spark.createDataFrame([("x", "B", "go()")], "caller string, type string, sig string")
    owns = spark.createDataFrame([("A", "go()", "A.go"), ("C", "go()", "C.go"), ("D", "go()", "D.go")], "type string, sig string, method string")
    parents = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "D")], "parent string, child string")
    assert {r["target"] for r in graph.dispatch(calls, owns, parents).collect()} == {"A.go", "C.go"}


def test_dense_ids_are_consecutive(spark):
    df = spark.range(0, 1000).select(F.expr("cast(999 - id as int)").alias("k"))
    got = sorted((r["k"], r["n"]) for r in graph.dense_ids(df, ["k"], "n", 5).collect())
    assert got == [(i, i + 5) for i in range(1000)]


def test_induced_keeps_arcs_within_a_group(spark):
    m = spark.createDataFrame([(9, 1, "a"), (9, 1, "b"), (8, 1, "b"), (8, 2, "x")], "feature int, repo int, id string")
    assert {tuple(r) for r in graph.induced(m, arcs(spark), ["feature"], ["repo"]).collect()} == {(9, "a", "b")}
