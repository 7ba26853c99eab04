from arcloom.plans import pipelines
from arcloom.sources import files

SOURCES = {
    "p/Order.java": "package p;\nimport q.Store;\npublic class Order {\n  int total(int a) { return a; }\n  void save(Store s) { s.put(total(1)); }\n}\n",
    "p/OrderItem.java": "package p;\npublic class OrderItem {\n  Order order() { return new Order(); }\n}\n",
    "q/Store.java": "package q;\nimport p.*;\nclass Store {\n  void put(int a) { }\n}\nclass Helper { }\n",
    "r/Lone.java": "package r;\nclass Lone { void alone() { } }\n",
}


def tree(spark, tmp_path):
    root = str(tmp_path / "src")
    files.write_tree(spark.createDataFrame(list(SOURCES.items()), "path string, code string"), root)
    return root


def test_import_matrix(spark, tmp_path):
    wide = pipelines.import_matrix(spark, tree(spark, tmp_path), str(tmp_path / "m.csv"))
    ones = {(r["src"], c) for r in wide.collect() for c in wide.columns[1:] if r[c]}
    assert wide.columns[1:] == ["p.Order", "p.OrderItem", "q.Helper", "q.Store", "r.Lone"]
    assert ones == {("p.Order", "p.OrderItem"), ("p.Order", "q.Store"), ("p.OrderItem", "p.Order"), ("q.Store", "p.Order"), ("q.Store", "p.OrderItem"), ("q.Store", "q.Helper")}
    assert {tuple(r) for r in files.read_matrix(spark, str(tmp_path / "m.csv")).collect()} == ones


def test_summary_of_a_repository(spark, tmp_path):
    out = str(tmp_path / "out")
    got = pipelines.repo_summary(spark, tree(spark, tmp_path), out)
    m = {r["method_signature"]: r for r in files.read_methods(spark, f"{out}/method.csv").collect()}
    assert set(m) == {"p.Order.total( int a )", "p.Order.save( Store s )", "p.OrderItem.order(  )", "q.Store.put( int a )", "r.Lone.alone(  )"}
    f = files.read_features(spark, f"{out}/features.csv").collect()
    assert sorted(r["method_name"] for r in f) == sorted(m) and all(r["desc"] and r["module_desc"] for r in f)
    assert sorted({r["id"] for r in f}) == list(range(1, len({r["id"] for r in f}) + 1)) and got["modules"].count() == 4
