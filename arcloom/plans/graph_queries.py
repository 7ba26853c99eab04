"""Queries over the class graph: edges, entries, reachability, feature graphs, hierarchies, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.functions.signatures import class_of, kind_label, package_of
from arcloom.operators import graph
from arcloom.tables import first_delivery, table


def arcs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs (repo, src, dst) between named classes, as often as they were delivered."""
    e = table(spark, sf_dir, "graph_edge").where("src is not null and dest is not null and repo is not null")
    return e.select("repo", "src", F.col("dest").alias("dst"))


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct arcs (repo, src, dst) between named classes."""
    return arcs_of(spark, sf_dir).distinct()


def vertices_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that were not deleted, once each."""
    return first_delivery(table(spark, sf_dir, "vertices"), "repo", "id").where("deleted_at is null")


def feature_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, repo, id): the classes whose methods a feature is made of."""
    cm = table(spark, sf_dir, "code_map").where("feature is not null and method_name is not null").select("feature", class_of(F.col("method_name")).alias("id")).distinct()
    f = table(spark, sf_dir, "features").where("deleted_at is null and module is not null").select(F.col("id").alias("feature"), "module").distinct()
    m = table(spark, sf_dir, "modules").where("deleted_at is null").select(F.col("id").alias("module"), "repo").distinct()
    return cm.join(f, "feature").join(m, "module").select("feature", "repo", "id")


def class_edges(spark, sf_dir):
    return edges_of(spark, sf_dir)


def entry_classes(spark, sf_dir):
    return graph.entries(vertices_of(spark, sf_dir), edges_of(spark, sf_dir).where("src <> dst"), ["repo"]).select("repo", "id")


def class_degrees(spark, sf_dir):
    """Arcs out of and into every class that has any."""
    e = edges_of(spark, sf_dir)
    ends = e.select("repo", F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select("repo", F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("repo", "id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def hub_classes(spark, sf_dir):
    """The twenty classes most depended on (the limit is the query)."""
    return class_degrees(spark, sf_dir).orderBy(F.desc("n_in"), "repo", "id").limit(20).select("repo", "id", "n_in")


def reachable_classes(spark, sf_dir):
    """What each repository's entry classes reach."""
    return graph.closure(entry_classes(spark, sf_dir), edges_of(spark, sf_dir), ["repo"])


def reach_depths(spark, sf_dir):
    """Least number of arcs from an entry class, and how many classes lie so far."""
    got = graph.closure(entry_classes(spark, sf_dir), edges_of(spark, sf_dir), ["repo"], depth="depth")
    return got.groupBy("repo", "depth").agg(F.count(F.lit(1)).alias("n"))


def typed_arcs(spark, sf_dir):
    """The class graph as typed arcs: what a class points to tells how (enum use, interface reference, call)."""
    v = vertices_of(spark, sf_dir).select("repo", "id", "kind", "owner_id")
    e = edges_of(spark, sf_dir).join(v.select("repo", F.col("id").alias("dst"), "kind"), ["repo", "dst"])
    use = e.select("repo", "src", "dst", F.when(F.col("kind") == "Enum", "UseReference").when(F.col("kind") == "Interface", "MethodReference").otherwise("CallArc").alias("arc_group"), F.when(F.col("kind") == "Enum", "EnumUse").when(F.col("kind") == "Interface", "ParameterType").otherwise("NormalCall").alias("arc_kind"))
    own = v.where("owner_id is not null").select("repo", F.col("owner_id").alias("src"), F.col("id").alias("dst"), F.lit("MemberArc").alias("arc_group"), F.lit("MethodMember").alias("arc_kind"))
    return use.unionByName(own).distinct()


def slice_members(spark, sf_dir):
    """Slice of each repository from its entries by the typed rules: classes act as methods, packages as types."""
    v = vertices_of(spark, sf_dir).select("repo", "id", "kind", "owner_id")
    packages = v.where("owner_id is not null").select("repo", F.col("owner_id").alias("id"), F.lit("Class").alias("kind")).distinct()
    acts = v.select("repo", "id", F.when(F.col("kind") == "Class", "Method").otherwise(F.col("kind")).alias("kind")).unionByName(packages)
    named, _ = graph.slice_graph(entry_classes(spark, sf_dir), acts, typed_arcs(spark, sf_dir), ["repo"])
    return named.select("repo", "id", "role")


def feature_graph_nodes(spark, sf_dir):
    """Classes of each feature that are in the graph."""
    live = vertices_of(spark, sf_dir).select("repo", "id", "kind")
    return feature_classes(spark, sf_dir).join(live, ["repo", "id"]).select("feature", "id", kind_label(F.col("kind")).alias("type"))


def feature_graph_edges(spark, sf_dir):
    """Arcs between classes of the same feature."""
    return graph.induced(feature_classes(spark, sf_dir), edges_of(spark, sf_dir), ["feature"], ["repo"])


def exclusive_classes(spark, sf_dir):
    """Classes that one feature alone owns: they go when it goes; the others lose only members."""
    own = feature_classes(spark, sf_dir).groupBy("repo", "id").agg(F.count_distinct("feature").alias("features"), F.min("feature").alias("feature"))
    return own.select("repo", "id", "features", F.when(F.col("features") == 1, F.col("feature")).alias("feature"))


def package_members(spark, sf_dir):
    """Classes by package with the arcs among them that exist and that the implicit package rule implies (n·(n−1))."""
    v = vertices_of(spark, sf_dir).select("repo", "id", package_of(F.col("id")).alias("package")).where("package is not null")
    n = v.groupBy("repo", "package").agg(F.count(F.lit(1)).alias("classes"))
    e = edges_of(spark, sf_dir).where("src <> dst").select("repo", "src", "dst", package_of(F.col("src")).alias("package")).where(F.col("package") == package_of(F.col("dst")))
    e = e.join(v.select("repo", F.col("id").alias("src")), ["repo", "src"], "left_semi").join(v.select("repo", F.col("id").alias("dst")), ["repo", "dst"], "left_semi")
    have = e.groupBy("repo", "package").agg(F.count(F.lit(1)).alias("arcs"))
    return n.join(have, ["repo", "package"], "left").select("repo", "package", "classes", (F.col("classes") * (F.col("classes") - 1)).alias("implied"), F.coalesce("arcs", F.lit(0)).cast("long").alias("arcs"))


def package_tree(spark, sf_dir):
    """Every package and all packages above it, with the classes below (reflexive closure of the hierarchy)."""
    parts = F.split("owner_id", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    v = vertices_of(spark, sf_dir).where("owner_id is not null").select("repo", "id", F.explode(up).alias("package"))
    return v.groupBy("repo", "package").agg(F.count(F.lit(1)).alias("classes"))


def member_positions(spark, sf_dir):
    """Where each class is inserted among its package's kept ones: the kept classes before it."""
    v = first_delivery(table(spark, sf_dir, "vertices"), "repo", "id").where("owner_id is not null")
    before = Window.partitionBy("repo", "owner_id").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("deleted_at").isNull().cast("long")).over(before), F.lit(0))
    return v.select("repo", "id", at.alias("insert_at"))


def graph_overlay(spark, sf_dir):
    """The graph before and after the second half of the period: classes as Default, Modify (in both) or New."""
    v = first_delivery(table(spark, sf_dir, "vertices"), "repo", "id")
    old = v.where("loaded_at < timestamp '2024-12-01 00:00:00Z'").select("repo", "id", F.lit(True).alias("old"))
    e = table(spark, sf_dir, "graph_edge").where("loaded_at >= timestamp '2024-12-01 00:00:00Z' and src is not null and repo is not null").select("repo", F.col("src").alias("id")).distinct().withColumn("new", F.lit(True))
    both = old.join(e, ["repo", "id"], "full")
    return both.select("repo", "id", F.when(F.col("old").isNull(), "New").when(F.col("new").isNotNull(), "Modify").otherwise("Default").alias("type"))


def incremental_edges(spark, sf_dir):
    """Edges to add for the classes that arrived last (from 2025-05-01): to and from their package, if missing."""
    v = vertices_of(spark, sf_dir).select("repo", "id", "owner_id", "loaded_at").where("owner_id is not null")
    new = v.where("loaded_at >= timestamp '2025-05-01 00:00:00Z'").select("repo", "owner_id", F.col("id").alias("a"))
    pair = new.join(v.select("repo", "owner_id", F.col("id").alias("b")), ["repo", "owner_id"]).where("a <> b")
    want = pair.select("repo", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pair.select("repo", F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()
    return want.join(edges_of(spark, sf_dir), ["repo", "src", "dst"], "left_anti")


QUERIES = {
    f.__name__: f
    for f in (
        class_edges, entry_classes, class_degrees, hub_classes, reachable_classes, reach_depths, slice_members, feature_graph_nodes, feature_graph_edges,
        exclusive_classes, package_members, package_tree, member_positions, graph_overlay, incremental_edges,
    )
}

CTE = """
WITH RECURSIVE vx AS (
  SELECT repo, id, min_by(kind, loaded_at) AS kind, min_by(owner_id, loaded_at) AS owner_id, min_by(is_abstract, loaded_at) AS is_abstract, min(pos) AS pos,
    min_by(annotations, loaded_at) AS annotations, min(loaded_at) AS loaded_at, min(deleted_at) AS deleted_at
  FROM vertices GROUP BY repo, id
), v AS (SELECT * FROM vx WHERE deleted_at IS NULL),
e AS (SELECT DISTINCT repo, src, dest AS dst FROM graph_edge WHERE repo IS NOT NULL AND src IS NOT NULL AND dest IS NOT NULL),
ent AS (
  SELECT repo, id FROM v WHERE NOT coalesce(is_abstract, false) AND NOT coalesce(list_has_any(annotations, ['lombok.Generated', 'ltm.Generated']), false)
  AND NOT EXISTS (SELECT 1 FROM e WHERE e.repo = v.repo AND e.dst = v.id AND e.src <> e.dst)
),
fc AS (
  SELECT DISTINCT cm.feature, m.repo, regexp_extract(trim(split_part(cm.method_name, '(', 1)), '^(.*)\\.[^.]*$', 1) AS id
  FROM code_map cm
  JOIN (SELECT DISTINCT id, module FROM features WHERE deleted_at IS NULL AND module IS NOT NULL) f ON f.id = cm.feature
  JOIN (SELECT DISTINCT id, repo FROM modules WHERE deleted_at IS NULL) m ON m.id = f.module
  WHERE cm.method_name IS NOT NULL
)"""
_DEG = CTE + ", d AS (SELECT repo, id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT repo, src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT repo, dst, 0, 1 FROM e) GROUP BY ALL) "
_REACH = CTE + ", r AS (SELECT repo, id FROM ent UNION SELECT e.repo, e.dst FROM r JOIN e ON e.repo = r.repo AND e.src = r.id) "

ORACLE = {
    "class_edges": CTE + " SELECT repo, src, dst FROM e",
    "entry_classes": CTE + " SELECT repo, id FROM ent",
    "class_degrees": _DEG + "SELECT repo, id, n_out, n_in FROM d",
    "hub_classes": _DEG + "SELECT repo, id, n_in FROM d ORDER BY n_in DESC, repo, id LIMIT 20",
    "reachable_classes": _REACH + "SELECT repo, id FROM r",
    # a cyclic graph has no last depth: paths end after 60 arcs, far beyond the depth of these tables
    "reach_depths": CTE + ", r AS (SELECT repo, id, 0 AS d FROM ent UNION SELECT e.repo, e.dst, r.d + 1 FROM r JOIN e ON e.repo = r.repo AND e.src = r.id WHERE r.d < 60), l AS (SELECT repo, id, min(d) AS depth FROM r GROUP BY ALL) SELECT repo, depth, count(*) AS n FROM l GROUP BY ALL",
    "slice_members": CTE
    + """, acts AS (SELECT repo, id, CASE WHEN kind = 'Class' THEN 'M' ELSE 'T' END AS role, kind FROM v UNION ALL SELECT DISTINCT repo, owner_id, 'T', 'Class' FROM v WHERE owner_id IS NOT NULL),
typed AS (SELECT e.repo, e.src, e.dst, s.role AS s_role, s.kind AS s_kind, v.kind AS d_kind FROM e JOIN v ON v.repo = e.repo AND v.id = e.dst JOIN acts s ON s.repo = e.repo AND s.id = e.src),
step AS (SELECT * FROM typed WHERE (d_kind = 'Class' AND s_role = 'M') OR (d_kind = 'Enum' AND (s_role = 'M' OR s_kind = 'Enum'))),
core AS (SELECT repo, id FROM ent UNION SELECT s.repo, s.dst FROM core c JOIN step s ON s.repo = c.repo AND s.src = c.id),
allm AS (
  SELECT repo, id FROM core
  UNION SELECT t.repo, t.dst FROM typed t JOIN core c ON c.repo = t.repo AND c.id = t.src WHERE t.d_kind = 'Interface' AND t.s_role = 'M'
  UNION SELECT v.repo, v.owner_id FROM v JOIN core c ON c.repo = v.repo AND c.id = v.id WHERE v.owner_id IS NOT NULL AND v.kind = 'Class'
)
SELECT m.repo, m.id, a.role FROM allm m LEFT JOIN acts a ON a.repo = m.repo AND a.id = m.id""",
    "feature_graph_nodes": CTE + " SELECT fc.feature, fc.id, coalesce(v.kind, 'Unknown') AS type FROM fc JOIN v ON v.repo = fc.repo AND v.id = fc.id",
    "feature_graph_edges": CTE + " SELECT a.feature, e.src, e.dst FROM fc a JOIN e ON e.repo = a.repo AND e.src = a.id JOIN fc b ON b.feature = a.feature AND b.repo = a.repo AND b.id = e.dst",
    "exclusive_classes": CTE + " SELECT repo, id, count(DISTINCT feature) AS features, CASE WHEN count(DISTINCT feature) = 1 THEN min(feature) END AS feature FROM fc GROUP BY repo, id",
    "package_members": CTE
    + """, p AS (SELECT repo, id, regexp_extract(id, '^(.*)\\.[^.]*$', 1) AS package FROM v WHERE contains(id, '.')),
n AS (SELECT repo, package, count(*) AS classes FROM p GROUP BY ALL),
h AS (SELECT a.repo, a.package, count(*) AS arcs FROM e JOIN p a ON a.repo = e.repo AND a.id = e.src JOIN p b ON b.repo = e.repo AND b.id = e.dst WHERE a.package = b.package AND e.src <> e.dst GROUP BY ALL)
SELECT n.repo, n.package, classes, classes * (classes - 1) AS implied, coalesce(arcs, 0) AS arcs FROM n LEFT JOIN h ON h.repo = n.repo AND h.package = n.package""",
    "package_tree": CTE
    + """ SELECT repo, package, count(*) AS classes FROM (
  SELECT repo, id, array_to_string(string_split(owner_id, '.')[1:n], '.') AS package FROM (SELECT repo, id, owner_id, unnest(range(1, len(string_split(owner_id, '.')) + 1)) AS n FROM v WHERE owner_id IS NOT NULL)
) GROUP BY ALL""",
    "member_positions": CTE + " SELECT repo, id, coalesce(sum((deleted_at IS NULL)::INT) OVER (PARTITION BY repo, owner_id ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS insert_at FROM vx WHERE owner_id IS NOT NULL",
    "graph_overlay": CTE
    + """, o AS (SELECT repo, id FROM vx WHERE loaded_at < TIMESTAMPTZ '2024-12-01 00:00:00+00'),
g AS (SELECT DISTINCT repo, src AS id FROM graph_edge WHERE loaded_at >= TIMESTAMPTZ '2024-12-01 00:00:00+00' AND src IS NOT NULL AND repo IS NOT NULL)
SELECT coalesce(o.repo, g.repo) AS repo, coalesce(o.id, g.id) AS id, CASE WHEN o.id IS NULL THEN 'New' WHEN g.id IS NOT NULL THEN 'Modify' ELSE 'Default' END AS type FROM o FULL JOIN g ON g.repo = o.repo AND g.id = o.id""",
    "incremental_edges": CTE
    + """, pr AS (SELECT a.repo, a.id AS x, b.id AS y FROM v a JOIN v b ON b.repo = a.repo AND b.owner_id = a.owner_id AND a.id <> b.id WHERE a.loaded_at >= TIMESTAMPTZ '2025-05-01 00:00:00+00')
SELECT repo, src, dst FROM (SELECT repo, x AS src, y AS dst FROM pr UNION SELECT repo, y, x FROM pr) w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo = w.repo AND e.src = w.src AND e.dst = w.dst)""",
}
