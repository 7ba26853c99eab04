import json

from pyspark.sql import functions as F

from arcloom.sources import files
from arcloom.streaming import landing
from arcloom.tables import first_delivery


def test_source_tree_and_contents(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/C.java").write_text("class C {}\n")
    (tmp_path / "a/A.java").write_text("class A {}")
    (tmp_path / "a/x.txt").write_text("no")
    got = files.source_tree(spark, str(tmp_path)).orderBy("file_id").collect()
    assert [(r["file_id"], r["path"], r["dotted"]) for r in got] == [(0, "a/A.java", "a.A"), (1, "a/b/C.java", "a.b.C")]
    names = spark.createDataFrame([("a.A",), ("z",)], "dotted string")
    assert {r["dotted"]: r["code"] for r in files.file_content(files.source_tree(spark, str(tmp_path)), names).collect()} == {"a.A": "class A {}", "z": "file not found"}


def test_methods_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "A.b( )", 'x = "q, r";\ny();', "A", "A.java", 1, 2)], files.METHOD_CSV)
    files.write_methods(df, str(tmp_path / "m"))
    assert files.read_methods(spark, str(tmp_path / "m")).collect() == df.collect()


def test_matrix_both_ways(spark, tmp_path):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "c")], "src string, dest string")
    files.to_matrix(e, ["a", "b", "c"]).coalesce(1).write.option("header", True).csv(str(tmp_path / "x"))
    assert {tuple(r) for r in files.read_matrix(spark, str(tmp_path / "x")).collect()} == {("a", "b"), ("b", "c")}


def test_dump_and_commits(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO `modules` VALUES (1,2,3,'it''s \\'x\\'\\n',NULL),(2,2,3,'',NULL);\nINSERT INTO `project_info` VALUES (12,'r',NULL,NULL,1,2,3,4,0x01);")
    t = files.load_dump(spark, str(tmp_path / "d.sql"))
    assert [r["module_desc"] for r in t["modules"].collect()] == ["it's 'x'\n", ""] and t["project_info"].first()["summary_flag"] is True
    (tmp_path / "c.json").write_text(json.dumps({"dataset": [{"project_name": "p", "issues": [{"id": "1", "issue": "i", "description": "d", "methods": ["m", "n"]}, {"id": "2", "methods": []}]}]}))
    assert [r["method"] for r in files.read_commits(spark, str(tmp_path / "c.json")).collect()] == ["m", "n", None]


def test_first_delivery(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", None), (2, "x", None)], "id int, v string, loaded_at int")
    assert {(r["id"], r["v"]) for r in first_delivery(df, "id").collect()} == {(1, "a"), (2, "x")}


def test_landing_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"repo": 1, "class_id": "p.New", "code": "package p;\nimport q.Old;\n"}, {"repo": 1, "class_id": "p.New", "code": "again"}, {"repo": 1, "class_id": None, "code": None}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows)))
    known = spark.createDataFrame([(1, "q.Old"), (1, "p.Near"), (2, "p.Other")], "repo int, id string")
    edges, out = spark.createDataFrame([(1, "p.New", "p.Near")], "repo int, src string, dst string"), []
    q = landing.maintain(landing.landed(spark, str(tmp_path / "in")), lambda: known, lambda: edges, lambda df: out.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert set(out) == {(1, "p.New", "q.Old"), (1, "p.Near", "p.New")}


def test_relayed(spark):
    lines = [(1, 2, 'data: {"choices": [{"delta": {"content": "b"}}]}'), (1, 1, 'data: {"choices": [{"delta": {"content": "a"}}]}'), (1, 3, "data: [DONE]"), (1, 0, ": ping")]
    df = spark.createDataFrame(lines, "stream int, n int, line string")
    assert landing.relayed(df).first()["text"] == "ab"


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_core_does_not_import_the_optional_part():
    import pathlib

    root = pathlib.Path(files.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "arcloom.llm" not in p.read_text(), p
    assert F is not None
