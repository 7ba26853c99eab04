"""Queries over the project → module → feature → method model: overviews, upserts, deletes, bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.functions import signatures as sig
from arcloom.operators import graph, upsert
from arcloom.plans.signature_sql import SIGNATURES
from arcloom.tables import first_delivery, table


def _live(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return first_delivery(table(spark, sf_dir, name), "id").where("deleted_at is null")


def project_list(spark, sf_dir):
    p = first_delivery(table(spark, sf_dir, "project_info").withColumn("loaded_at", F.lit(0)), "id")
    return p.select("id", "repo_name", sig.git_name(F.col("git_link")).alias("git_name"), "loc", F.coalesce("summary_flag", F.lit(False)).alias("summarised"))


def project_overview(spark, sf_dir):
    """Modules, features, bound methods and arcs of every project."""
    m = _live(spark, sf_dir, "modules").select(F.col("id").alias("module"), "repo")
    f = _live(spark, sf_dir, "features").select(F.col("id").alias("feature"), "module")
    cm = first_delivery(table(spark, sf_dir, "code_map"), "id").select("feature", "method_name")
    per_f = f.join(cm.groupBy("feature").agg(F.count(F.lit(1)).alias("n")), "feature", "left")
    per_m = per_f.groupBy("module").agg(F.count(F.lit(1)).alias("nf"), F.coalesce(F.sum("n"), F.lit(0)).alias("nm"))
    mods = m.join(per_m, "module", "left").groupBy("repo").agg(F.count(F.lit(1)).alias("modules"), F.coalesce(F.sum("nf"), F.lit(0)).alias("features"), F.coalesce(F.sum("nm"), F.lit(0)).alias("methods"))
    e = first_delivery(table(spark, sf_dir, "graph_edge"), "id").groupBy("repo").agg(F.count(F.lit(1)).alias("arcs"))
    p = table(spark, sf_dir, "project_info").select(F.col("id").alias("repo")).distinct()
    out = p.join(mods, "repo", "left").join(e, "repo", "left")
    return out.select("repo", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("modules", "features", "methods", "arcs")])


def module_prompts(spark, sf_dir):
    """Each module's first four features (the limit is the query), in order, as one text."""
    f = _live(spark, sf_dir, "features").where("module is not null and feature_desc is not null").select("module", "id", "feature_desc")
    four = f.withColumn("n", F.row_number().over(Window.partitionBy("module").orderBy("id"))).where("n <= 4")
    return four.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "feature_desc"))), lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["feature_desc"])), "\n").alias("prompt"))


def feature_ordinals(spark, sf_dir):
    """Numbers 1..N of each module's features in the order of their ids."""
    f = _live(spark, sf_dir, "features")
    return f.select("id", "module", F.row_number().over(Window.partitionBy("module").orderBy("id")).cast("long").alias("ordinal"))


def nested_features(spark, sf_dir):
    """Module → features → methods as nested rows, flattened to their sizes."""
    cm = first_delivery(table(spark, sf_dir, "code_map"), "id").where("method_name is not null").groupBy("feature").agg(F.count_distinct("method_name").alias("n"))
    f = _live(spark, sf_dir, "features").select(F.col("id").alias("feature"), "module").join(cm, "feature", "left")
    nest = f.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("feature", F.coalesce("n", F.lit(0)).alias("methods")))).alias("features"))
    m = _live(spark, sf_dir, "modules").select(F.col("id").alias("module"), "repo").join(nest, "module", "left")
    return m.select("module", "repo", F.coalesce(F.size("features"), F.lit(0)).cast("long").alias("n_features"), F.coalesce(F.aggregate("features", F.lit(0).cast("long"), lambda a, x: a + x["methods"]), F.lit(0)).alias("n_methods"), F.try_element_at("features", F.lit(1))["feature"].alias("first_feature"))


def method_signatures(spark, sf_dir):
    """Every bound method's class, name and normalised signature."""
    cm = table(spark, sf_dir, "code_map").where("method_name is not null").select("method_name").distinct()
    m = F.col("method_name")
    return cm.select("method_name", sig.class_of(m).alias("class_id"), sig.method_of(m).alias("method"), sig.normalised(m).alias("normalised"))


def first_feature_of_method(spark, sf_dir):
    """Where features share a method, the feature with the least id has it."""
    cm = table(spark, sf_dir, "code_map").where("method_name is not null and feature is not null")
    return cm.groupBy("method_name").agg(F.min("feature").alias("feature"))


_HALF = "timestamp '2024-12-01 00:00:00Z'"


def upsert_features(spark, sf_dir):
    """Features that arrived from the second half on and whose (module, ordinal) was not there, with new ids."""
    f = table(spark, sf_dir, "features").select("id", "module", "feature_id", "loaded_at")
    old, late = f.where(f"loaded_at < {_HALF}"), f.where(f"loaded_at >= {_HALF}")
    fresh = upsert.new_rows(late, old, ["module", "feature_id"], ["id"])
    return upsert.numbered(fresh.select("id", "module", "feature_id"), old, ["module", "feature_id"])


def upsert_edges(spark, sf_dir):
    """Arcs that arrived from the second half on and were not there."""
    e = table(spark, sf_dir, "graph_edge").select("id", "repo", "src", "dest", "loaded_at")
    return upsert.new_rows(e.where(f"loaded_at >= {_HALF}"), e.where(f"loaded_at < {_HALF}"), ["repo", "src", "dest"], ["id"]).select("repo", "src", "dest")


def upsert_methods(spark, sf_dir):
    """Methods that arrived from the second half on; a name that exists anywhere is not added again."""
    c = table(spark, sf_dir, "code_map").where("method_name is not null").select("id", "method_name", "loaded_at")
    return upsert.new_rows(c.where(f"loaded_at >= {_HALF}"), c.where(f"loaded_at < {_HALF}"), ["method_name"], ["id"]).select("method_name")


def delete_project_rows(spark, sf_dir):
    """What is left of each table when project 12 is deleted."""
    rest = upsert.delete_project(12, *(table(spark, sf_dir, n) for n in ("modules", "features", "code_map", "graph_edge")))
    parts = [df.select(F.lit(n).alias("table_name"), F.col("id").alias("row_id")).distinct() for n, df in rest.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def surviving_methods(spark, sf_dir):
    """Bindings left when features and modules marked deleted go, and what hangs on them."""
    gone_m = first_delivery(table(spark, sf_dir, "modules"), "id").where("deleted_at is not null")
    f = first_delivery(table(spark, sf_dir, "features"), "id")
    gone_f = f.where("deleted_at is not null").select("id").unionByName(f.join(gone_m.select(F.col("id").alias("module")), "module", "left_semi").select("id"))
    return upsert.without(table(spark, sf_dir, "code_map").select("id", "feature").distinct(), gone_f, "feature").select("id")


_KINDS = ["Annotation", "Class", "Enum", "Interface", "Other"]


def kind_matrix(spark, sf_dir):
    """Vertex kinds by repository as a matrix (pivot); kinds beyond the four of type declarations, and none, are in ``Other``."""
    v = table(spark, sf_dir, "vertices").select("repo", "id", F.when(F.col("kind").isin(*_KINDS[:-1]), F.col("kind")).otherwise("Other").alias("kind")).distinct()
    return v.groupBy("repo").pivot("kind", _KINDS).agg(F.count(F.lit(1))).na.fill(0)


def kind_matrix_melted(spark, sf_dir):
    """The matrix back as rows, zeros left out (unpivot)."""
    return kind_matrix(spark, sf_dir).unpivot("repo", _KINDS, "kind", "n").where("n > 0")


def file_numbers(spark, sf_dir):
    """Dense numbers of the files in the order of their paths, as a walk of the tree gives them."""
    f = table(spark, sf_dir, "code_file").select("repo", F.regexp_replace("file_path", r"\\", "/").alias("path")).distinct()
    return graph.dense_ids(f, ["repo", "path"], "file_no", 0)


def path_tree(spark, sf_dir):
    """Folders of the uploaded files: each with its parent and the files below."""
    f = table(spark, sf_dir, "code_file").select("repo", "file_id", F.split(F.regexp_replace("file_path", r"\\", "/"), "/").alias("p")).dropDuplicates(["file_id"])
    up = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda n: F.struct(F.array_join(F.slice("p", F.lit(1), n), "/").alias("folder"), F.array_join(F.slice("p", F.lit(1), n - 1), "/").alias("parent")))
    return f.where(F.size("p") > 1).select("repo", "file_id", F.explode(up).alias("x")).groupBy("repo", "x.folder", "x.parent").agg(F.count(F.lit(1)).alias("files"))


QUERIES = {
    f.__name__: f
    for f in (
        project_list, project_overview, module_prompts, feature_ordinals, nested_features, method_signatures, first_feature_of_method, upsert_features,
        upsert_edges, upsert_methods, delete_project_rows, surviving_methods, kind_matrix, kind_matrix_melted, file_numbers, path_tree,
    )
}

_LIVE = """
WITH f0 AS (SELECT id, min_by(module, loaded_at) AS module, min_by(feature_id, loaded_at) AS feature_id, min_by(feature_desc, loaded_at) AS feature_desc, min(deleted_at) AS deleted_at FROM features GROUP BY id),
f AS (SELECT * FROM f0 WHERE deleted_at IS NULL),
m0 AS (SELECT id, any_value(repo) AS repo, min(deleted_at) AS deleted_at FROM modules GROUP BY id), m AS (SELECT * FROM m0 WHERE deleted_at IS NULL),
cm AS (SELECT DISTINCT id, feature, method_name FROM code_map)"""
_HEAD = "trim(split_part(method_name, '(', 1))"
_CLS = f"CASE WHEN contains({_HEAD}, '.') THEN regexp_extract({_HEAD}, '^(.*)\\.[^.]*$', 1) END"
_SHORT = f"regexp_extract({_HEAD}, '([^.]*)$', 1)"
_MET = f"CASE WHEN {_SHORT} = '<init>' THEN regexp_extract({_CLS}, '([^.]*)$', 1) ELSE {_SHORT} END"
_KIND = "SELECT repo, " + ", ".join(f"count(DISTINCT id) FILTER (WHERE kind = '{k}') AS {k}" for k in ("Annotation", "Class", "Enum", "Interface")) + ", count(DISTINCT id) FILTER (WHERE kind IS NULL OR kind NOT IN ('Annotation', 'Class', 'Enum', 'Interface')) AS Other FROM vertices GROUP BY repo"

ORACLE = {
    "project_list": "SELECT DISTINCT id, repo_name, CASE WHEN git_link IS NULL OR trim(git_link) = '' THEN 'no link' WHEN regexp_extract(git_link, '[/:]([A-Za-z0-9_.\\-]+/[A-Za-z0-9_.\\-]+?)(?:\\.git)?/?$', 1) = '' THEN 'unknown' ELSE regexp_extract(git_link, '[/:]([A-Za-z0-9_.\\-]+/[A-Za-z0-9_.\\-]+?)(?:\\.git)?/?$', 1) END AS git_name, loc, coalesce(summary_flag, false) AS summarised FROM project_info",
    "project_overview": _LIVE
    + """, pf AS (SELECT f.id, f.module, count(cm.id) AS n FROM f LEFT JOIN cm ON cm.feature = f.id GROUP BY ALL),
pm AS (SELECT m.id, m.repo, count(pf.id) AS nf, coalesce(sum(pf.n), 0) AS nm FROM m LEFT JOIN pf ON pf.module = m.id GROUP BY ALL)
SELECT p.id AS repo, (SELECT count(*) FROM m WHERE m.repo = p.id) AS modules, (SELECT coalesce(sum(nf), 0)::BIGINT FROM pm WHERE pm.repo = p.id) AS features,
  (SELECT coalesce(sum(nm), 0)::BIGINT FROM pm WHERE pm.repo = p.id) AS methods, (SELECT count(DISTINCT id) FROM graph_edge g WHERE g.repo = p.id) AS arcs
FROM (SELECT DISTINCT id FROM project_info) p""",
    "module_prompts": _LIVE + ", n AS (SELECT module, feature_desc, row_number() OVER (PARTITION BY module ORDER BY id) AS n FROM f WHERE module IS NOT NULL AND feature_desc IS NOT NULL) SELECT module, string_agg(n::VARCHAR || '. ' || feature_desc, chr(10) ORDER BY n) AS prompt FROM n WHERE n <= 4 GROUP BY module",
    "feature_ordinals": _LIVE + " SELECT id, module, row_number() OVER (PARTITION BY module ORDER BY id) AS ordinal FROM f",
    "nested_features": _LIVE
    + """, pf AS (SELECT f.id, f.module, count(DISTINCT cm.method_name) AS n FROM f LEFT JOIN cm ON cm.feature = f.id GROUP BY ALL)
SELECT m.id AS module, m.repo, count(pf.id) AS n_features, coalesce(sum(pf.n), 0)::BIGINT AS n_methods, min(pf.id) AS first_feature FROM m LEFT JOIN pf ON pf.module = m.id GROUP BY m.id, m.repo""",
    "method_signatures": "WITH names AS (SELECT method_name AS m FROM code_map WHERE method_name IS NOT NULL)," + SIGNATURES + " SELECT m AS method_name, cls AS class_id, method, normalised FROM sg",
    "first_feature_of_method": "SELECT method_name, min(feature) AS feature FROM code_map WHERE method_name IS NOT NULL AND feature IS NOT NULL GROUP BY method_name",
    "upsert_features": """
WITH old AS (SELECT * FROM features WHERE loaded_at < TIMESTAMPTZ '2024-12-01 00:00:00+00'), late AS (SELECT module, feature_id FROM features WHERE loaded_at >= TIMESTAMPTZ '2024-12-01 00:00:00+00' GROUP BY ALL),
fresh AS (SELECT * FROM late l WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.module IS NOT DISTINCT FROM l.module AND o.feature_id IS NOT DISTINCT FROM l.feature_id))
SELECT module, feature_id, (SELECT coalesce(max(id), 0) FROM old) + row_number() OVER (ORDER BY module NULLS FIRST, feature_id NULLS FIRST) AS id FROM fresh""",
    "upsert_edges": "SELECT repo, src, dest FROM graph_edge l WHERE loaded_at >= TIMESTAMPTZ '2024-12-01 00:00:00+00' AND NOT EXISTS (SELECT 1 FROM graph_edge o WHERE o.loaded_at < TIMESTAMPTZ '2024-12-01 00:00:00+00' AND o.repo IS NOT DISTINCT FROM l.repo AND o.src IS NOT DISTINCT FROM l.src AND o.dest IS NOT DISTINCT FROM l.dest) GROUP BY ALL",
    "upsert_methods": "SELECT DISTINCT method_name FROM code_map l WHERE method_name IS NOT NULL AND loaded_at >= TIMESTAMPTZ '2024-12-01 00:00:00+00' AND NOT EXISTS (SELECT 1 FROM code_map o WHERE o.loaded_at < TIMESTAMPTZ '2024-12-01 00:00:00+00' AND o.method_name = l.method_name)",
    "delete_project_rows": """
WITH gm AS (SELECT id FROM modules WHERE repo = 12), gf AS (SELECT id FROM features WHERE module IN (SELECT id FROM gm))
SELECT DISTINCT 'code_map' AS table_name, id AS row_id FROM code_map c WHERE NOT EXISTS (SELECT 1 FROM gf WHERE gf.id = c.feature)
UNION ALL SELECT DISTINCT 'features', id FROM features f WHERE NOT EXISTS (SELECT 1 FROM gm WHERE gm.id = f.module)
UNION ALL SELECT DISTINCT 'modules', id FROM modules WHERE repo IS DISTINCT FROM 12 UNION ALL SELECT DISTINCT 'graph_edge', id FROM graph_edge WHERE repo IS DISTINCT FROM 12""",
    "surviving_methods": _LIVE + ", gf AS (SELECT id FROM f0 WHERE deleted_at IS NOT NULL OR module IN (SELECT id FROM m0 WHERE deleted_at IS NOT NULL)) SELECT DISTINCT id FROM code_map c WHERE NOT EXISTS (SELECT 1 FROM gf WHERE gf.id = c.feature)",
    "kind_matrix": _KIND,
    "kind_matrix_melted": f"SELECT repo, kind, n FROM (UNPIVOT ({_KIND}) ON Annotation, Class, Enum, Interface, Other INTO NAME kind VALUE n) WHERE n > 0",
    "file_numbers": "SELECT repo, path, row_number() OVER (ORDER BY repo, path) - 1 AS file_no FROM (SELECT DISTINCT repo, replace(file_path, '\\', '/') AS path FROM code_file)",
    "path_tree": """
SELECT repo, folder, parent, count(*) AS files FROM (
  SELECT repo, file_id, array_to_string(p[1:n], '/') AS folder, array_to_string(p[1:n-1], '/') AS parent
  FROM (SELECT repo, file_id, p, unnest(range(1, len(p))) AS n FROM (SELECT DISTINCT repo, file_id, string_split(replace(file_path, '\\', '/'), '/') AS p FROM code_file))
) GROUP BY ALL""",
}
