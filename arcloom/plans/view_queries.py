"""Queries over slices by number, what features touch, code without a feature, and edits of the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcloom.functions import signatures as sig
from arcloom.functions import texts
from arcloom.operators import diff, upsert, views
from arcloom.plans.signature_sql import SIGNATURES
from arcloom.plans.graph_queries import CTE, arcs_of, edges_of, entry_classes, feature_classes, vertices_of
from arcloom.tables import cut, first_delivery, table


def _numbers(spark, sf_dir):
    return cut(views.numbered_slices(entry_classes(spark, sf_dir), ["repo"]))


def _slices(spark, sf_dir):
    return views.slice_members(_numbers(spark, sf_dir), edges_of(spark, sf_dir), ["repo"])


def _choice(spark, sf_dir, slices):
    return cut(views.selected(feature_classes(spark, sf_dir), slices, "feature", ["repo"]))


def slice_numbers(spark, sf_dir):
    return _numbers(spark, sf_dir).select("repo", "id", "slice")


def class_slices(spark, sf_dir):
    """Every class with its kind and the numbers of its slices."""
    s = _slices(spark, sf_dir).groupBy("repo", "id").agg(F.array_sort(F.collect_set("slice")).alias("s"))
    v = vertices_of(spark, sf_dir).select("repo", "id", "kind").join(s, ["repo", "id"], "left")
    return v.select("repo", "id", F.coalesce("kind", F.lit("Unknown")).alias("type"), F.coalesce(F.array_join(F.transform("s", lambda x: x.cast("string")), ","), F.lit("")).alias("slices"))


def feature_slices(spark, sf_dir):
    return _choice(spark, sf_dir, _slices(spark, sf_dir)).select("feature", "slice")


def _groups(spark, sf_dir):
    return views.slice_groups(entry_classes(spark, sf_dir), arcs_of(spark, sf_dir), ["repo"])


def max_graph_nodes(spark, sf_dir):
    """Classes and interfaces of the slices that each feature selects."""
    members, groups = _groups(spark, sf_dir)
    chosen, hits = views.selections(feature_classes(spark, sf_dir), members, groups, "feature", ["repo"])
    shown = cut(members.join(vertices_of(spark, sf_dir).where(views.is_class(F.col("kind"))).select("repo", "id"), ["repo", "id"]))
    return views.held(chosen, cut(hits), shown, "feature", ["repo"]).select("feature", "id")


def max_graph_sizes(spark, sf_dir):
    """Nodes and arcs of the slices that each feature selects."""
    members, groups = _groups(spark, sf_dir)
    chosen, hits = views.selections(feature_classes(spark, sf_dir), members, groups, "feature", ["repo"])
    n = hits.join(groups, ["repo", "group"]).groupBy("repo", "like").agg(F.sum("nodes").alias("nodes"), F.sum("arcs").alias("arcs"))
    return chosen.join(n, ["repo", "like"]).groupBy("feature").agg(F.sum("nodes").alias("nodes"), F.sum("arcs").alias("arcs"))


def removable_classes(spark, sf_dir):
    """Of the classes a feature's slices touch: those that go with it (all their slices are selected) and those that stay."""
    members, groups = _groups(spark, sf_dir)
    chosen, hits = views.selections(feature_classes(spark, sf_dir), members, groups, "feature", ["repo"])
    n = hits.join(groups, ["repo", "group"]).groupBy("repo", "like")
    n = n.agg(F.sum(F.when(F.col("owned"), F.col("nodes")).otherwise(0)).alias("gone"), F.sum(F.when(F.col("owned"), 0).otherwise(F.col("nodes"))).alias("stay"))
    return chosen.join(n, ["repo", "like"]).groupBy("feature").agg(F.sum("gone").alias("gone"), F.sum("stay").alias("stay"))


def _members(spark, sf_dir):
    """(top, member, pos, code): functions of each file."""
    fn = table(spark, sf_dir, "code_function").where("func_code is not null and file_id is not null").dropDuplicates(["func_id"])
    return fn.select(F.col("file_id").alias("top"), F.col("func_id").alias("member"), F.struct("start_line", "func_id").alias("pos"), F.col("func_code").alias("code"))


def _owners(spark, sf_dir):
    return bound_functions(spark, sf_dir).select("feature", F.col("func_id").alias("member"))


def bound_functions(spark, sf_dir):
    """Functions of the classes that features name, in the features' own repositories, and whether the whole signature
    (method and types of parameters) is the one named."""
    m_ = F.col("method_name")
    cm = table(spark, sf_dir, "code_map").where("method_name is not null and feature is not null").select("feature", sig.class_of(m_).alias("c"), sig.normalised(m_).alias("m")).distinct()
    f = table(spark, sf_dir, "features").where("deleted_at is null and module is not null").select(F.col("id").alias("feature"), "module").distinct()
    m = table(spark, sf_dir, "modules").where("deleted_at is null").select(F.col("id").alias("module"), "repo").distinct()
    files = table(spark, sf_dir, "code_file").where("repo is not null").select("file_id", "repo").distinct()
    n_ = F.col("func_fullname")
    fn = table(spark, sf_dir, "code_function").where("func_fullname is not null").select("func_id", "file_id", sig.class_of(n_).alias("c"), sig.normalised(n_).alias("n")).distinct()
    both = cm.join(f, "feature").join(m, "module").join(fn.join(files, "file_id"), ["repo", "c"])
    return both.groupBy("feature", "func_id").agg(F.bool_or(F.col("m") == F.col("n")).alias("exact"))


def code_without_feature(spark, sf_dir):
    """Each file with functions of a feature: what is left of its code without the feature, and whether anything changes."""
    got = views.member_code(_members(spark, sf_dir), _owners(spark, sf_dir), "feature")
    return got.select("feature", F.col("top").alias("file_id"), F.md5("origin").alias("origin_md5"), F.md5("rest").alias("rest_md5"), "members", "left", diff.differs(F.col("origin"), F.col("rest")).alias("differs"))


def code_without_feature_kept(spark, sf_dir):
    """The same with functions that no feature has kept."""
    got = views.member_code(_members(spark, sf_dir), _owners(spark, sf_dir), "feature", keep_unbound=True)
    return got.select("feature", F.col("top").alias("file_id"), F.md5("rest").alias("rest_md5"), "members", "left", diff.differs(F.col("origin"), F.col("rest")).alias("differs"))


def delete_diffs(spark, sf_dir):
    """Unified diffs of those files with all lines as context: lines taken out, and what the diff gives when applied."""
    got = views.member_code(_members(spark, sf_dir), _owners(spark, sf_dir), "feature", keep_unbound=True)
    d = got.select("feature", F.col("top").alias("file_id"), diff.unified_diff("origin", "rest", F.col("top").cast("string")).alias("diff"))
    return d.select("feature", "file_id", F.md5(diff.new_side(F.col("diff"))).alias("applied_md5"))


def context_views(spark, sf_dir):
    """Files that a feature touches, whole, as a diff without changes."""
    touched = _owners(spark, sf_dir).join(_members(spark, sf_dir).select("member", "top"), "member").select("feature", "top").distinct()
    code = diff.assembled(_members(spark, sf_dir), ["top"], "pos", "code")
    got = touched.join(code, "top").select("feature", F.col("top").alias("file_id"), diff.unified_diff("code", "code", F.col("top").cast("string")).alias("d"))
    return got.select("feature", "file_id", F.md5("d").alias("diff_md5"))


def new_code_diffs(spark, sf_dir):
    """Files against what replaces them: a file of the same name and folder in another repository; a file without one is emptied."""
    from arcloom.plans.text_queries import same_files

    pair = same_files(spark, sf_dir).select("file_id", "first_code")
    f = table(spark, sf_dir, "code_file").where("file_code is not null").dropDuplicates(["file_id"]).select("file_id", F.col("file_code").alias("code"))
    both = f.join(pair, "file_id", "left")
    return both.select("file_id", F.length("code").cast("long").alias("old_chars"), F.length(F.coalesce("first_code", F.lit(""))).cast("long").alias("new_chars"), diff.differs(F.col("code"), F.col("first_code")).alias("differs"))


def modified_nodes(spark, sf_dir):
    """Classes of each feature: Modify where code of theirs goes with the feature, else Default."""
    code = views.member_code(_members(spark, sf_dir), _owners(spark, sf_dir), "feature", keep_unbound=True)
    fn = table(spark, sf_dir, "code_function").where("func_fullname is not null and file_id is not null").select(F.col("file_id").alias("top"), sig.class_of(F.col("func_fullname")).alias("id")).distinct()
    changed = code.where(diff.differs(F.col("origin"), F.col("rest"))).join(fn, "top").select("feature", "id").distinct()
    own = feature_classes(spark, sf_dir).select("feature", "id")
    return own.join(changed.withColumn("m", F.lit(True)), ["feature", "id"], "left").select("feature", "id", F.when(F.col("m"), "Modify").otherwise("Default").alias("type")).distinct()


def new_class_code(spark, sf_dir):
    """The source of every class: the file of its full name, else one whose name ends alike."""
    from arcloom.plans.text_queries import java_files

    j = java_files(spark, sf_dir).where("repo is not null").select("repo", F.concat_ws(".", F.when(F.col("pkg") != "", F.col("pkg")), "name").alias("id"), "code")
    got = views.looked_up(vertices_of(spark, sf_dir).select("repo", "id"), j, ["repo"])
    return got.select("repo", "id", F.md5("code").alias("code_md5"))


def package_depths(spark, sf_dir):
    """The packages and classes below every top package, with their depth."""
    v = vertices_of(spark, sf_dir).select("repo", "id")
    parts = F.split("id", r"\.")
    up = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n - 1), ".").alias("parent"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("id")))
    tree = v.where(F.size(parts) > 1).select("repo", F.explode(up).alias("x")).select("repo", "x.*").distinct()
    return views.tree_depths(tree, ["repo"]).select("repo", "top", "id", "depth")


def sliced_functions(spark, sf_dir):
    """Functions cut out of their files again by their lines."""
    f = table(spark, sf_dir, "code_file").where("file_code is not null").dropDuplicates(["file_id"]).select("file_id", texts.lines(F.col("file_code")).alias("l"))
    fn = table(spark, sf_dir, "code_function").where("start_line >= 1 and end_line >= start_line").select("func_id", "file_id", "start_line", "end_line").distinct()
    return fn.join(f, "file_id").select("func_id", F.md5(texts.line_slice(F.col("l"), F.col("start_line"), F.col("end_line"))).alias("code_md5"))


def module_json(spark, sf_dir):
    """Modules with their features as JSON text."""
    f = first_delivery(table(spark, sf_dir, "features"), "id").where("deleted_at is null and module is not null")
    f = f.groupBy(F.col("module").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("features"))
    m = first_delivery(table(spark, sf_dir, "modules"), "id").where("deleted_at is null").select("id").join(f, "id")
    return m.select("id", F.to_json(F.struct(F.col("id").alias("module"), "features")).alias("json"))


# -- edits ------------------------------------------------------------------------------------
def _least_feature(spark, sf_dir) -> int:
    """The feature that the edits are made on: the least id."""
    return table(spark, sf_dir, "features").agg(F.min("id")).first()[0]


def _row_ids(tables):
    parts = [df.select(F.lit(n).alias("table_name"), F.col("id").cast("long").alias("row_id")).distinct() for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def delete_feature_rows(spark, sf_dir):
    """What is left when a feature (the least id) is deleted: with its module, if that has no other."""
    t = {n: table(spark, sf_dir, n) for n in ("features", "code_map", "modules")}
    return _row_ids(upsert.delete_feature(_least_feature(spark, sf_dir), t["features"], t["code_map"], t["modules"]))


def edited_feature_rows(spark, sf_dir):
    """The methods and arcs that an edit of a feature (the one with the most classes in the graph) adds: the declared methods of its classes'
    files, and arcs to their packages' classes, where they are missing."""
    known = feature_classes(spark, sf_dir).join(vertices_of(spark, sf_dir).select("repo", "id"), ["repo", "id"], "left_semi")
    first = known.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "feature").first()
    feature = first["feature"] if first else -1
    classes = known.where(F.col("feature") == feature).select("repo", "id")
    files = table(spark, sf_dir, "code_file").select("file_id", "repo").distinct()
    fn = table(spark, sf_dir, "code_function").where("func_fullname is not null").select("file_id", F.col("func_fullname").alias("method_name")).distinct().join(files, "file_id")
    declared = fn.withColumn("id", sig.class_of(F.col("method_name"))).join(classes, ["repo", "id"]).select("method_name").distinct()
    got = upsert.edit_feature(
        feature, "edited", table(spark, sf_dir, "features"), table(spark, sf_dir, "code_map"), edges_of(spark, sf_dir).withColumnRenamed("dst", "dest"), declared,
        upsert.package_edges(classes, vertices_of(spark, sf_dir).select("repo", "id")).withColumnRenamed("dst", "dest"),
    )
    methods = got["new_methods"].select(F.lit("code_map").alias("table_name"), F.col("method_name").alias("name"))
    arcs = got["new_edges"].select(F.lit("graph_edge").alias("table_name"), F.concat_ws(" ", F.col("repo").cast("string"), "src", "dest").alias("name"))
    return methods.unionByName(arcs)


_HALF = "timestamp '2024-12-01 00:00:00Z'"


def cascade_inserts(spark, sf_dir):
    """How many modules, features and methods the model of the second half adds to that of the first."""
    m, f, c = (first_delivery(table(spark, sf_dir, n), "id") for n in ("modules", "features", "code_map"))
    rows = c.where("method_name is not null").select(F.col("feature").alias("f"), "method_name").join(f.select(F.col("id").alias("f"), F.col("module").alias("m"), "feature_id", "loaded_at"), "f")
    rows = rows.join(m.select(F.col("id").alias("m"), "repo", "cluster_id", "module_desc"), "m").where(f"loaded_at >= {_HALF}")
    old = {"modules": m.where(f"loaded_at < {_HALF}"), "features": f.where(f"loaded_at < {_HALF}"), "code_map": c.where(f"loaded_at < {_HALF}")}
    got = upsert.insert_rows(rows.select("repo", "cluster_id", "module_desc", "feature_id", "method_name"), old["modules"], old["features"], old["code_map"])
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.min("id").cast("long").alias("first_id")).select(F.lit(n).alias("table_name"), "n", "first_id") for n, df in got.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def finished_projects(spark, sf_dir):
    """Projects after the one with the least id is marked as summarised."""
    p = first_delivery(table(spark, sf_dir, "project_info").withColumn("loaded_at", F.lit(0)), "id")
    return upsert.finish(p, p.agg(F.min("id")).first()[0]).select("id", F.coalesce("summary_flag", F.lit(False)).alias("summary_flag"))


QUERIES = {
    f.__name__: f
    for f in (
        slice_numbers, class_slices, feature_slices, max_graph_nodes, max_graph_sizes, removable_classes, bound_functions, code_without_feature, code_without_feature_kept, delete_diffs, context_views,
        new_code_diffs, modified_nodes, new_class_code, package_depths, sliced_functions, module_json, delete_feature_rows, edited_feature_rows, cascade_inserts, finished_projects,
    )
}

_SL = CTE + """, num AS (SELECT repo, id, row_number() OVER (ORDER BY repo, id) AS slice FROM ent),
sl AS (SELECT repo, slice, id FROM num UNION SELECT e.repo, s.slice, e.dst FROM sl s JOIN e ON e.repo = s.repo AND e.src = s.id),
ch AS (SELECT DISTINCT fc.feature, fc.repo, sl.slice FROM fc JOIN sl ON sl.repo = fc.repo AND sl.id = fc.id),
nd AS (SELECT DISTINCT ch.feature, ch.repo, sl.id FROM ch JOIN sl ON sl.repo = ch.repo AND sl.slice = ch.slice)"""
_BOUND = (
    """WITH names AS (SELECT method_name AS m FROM code_map WHERE method_name IS NOT NULL UNION SELECT func_fullname FROM code_function WHERE func_fullname IS NOT NULL),"""
    + SIGNATURES
    + """, bf AS (SELECT cm.feature, fn.func_id, bool_or(a.normalised = b.normalised) AS exact FROM code_map cm JOIN sg a ON a.m = cm.method_name JOIN features f ON f.id = cm.feature AND f.deleted_at IS NULL
  JOIN modules mo ON mo.id = f.module AND mo.deleted_at IS NULL JOIN sg b ON b.cls = a.cls JOIN code_function fn ON fn.func_fullname = b.m JOIN code_file cf ON cf.file_id = fn.file_id AND cf.repo = mo.repo GROUP BY ALL)"""
)
_LEFT = (
    _BOUND
    + """, fn AS (SELECT DISTINCT file_id, func_id, start_line, func_code FROM code_function WHERE func_code IS NOT NULL AND file_id IS NOT NULL),
ow AS (SELECT fn.func_id, count(bf.feature) AS n FROM fn LEFT JOIN bf ON bf.func_id = fn.func_id GROUP BY fn.func_id),
asked AS (SELECT DISTINCT bf.feature, fn.file_id FROM bf JOIN fn ON fn.func_id = bf.func_id),
mem AS (SELECT a.feature, a.file_id, fn.func_id, start_line, func_code, ow.n, EXISTS (SELECT 1 FROM bf WHERE bf.feature = a.feature AND bf.func_id = fn.func_id) AS mine FROM asked a JOIN fn ON fn.file_id = a.file_id JOIN ow ON ow.func_id = fn.func_id),
kept AS (SELECT *, (mine AND n = 1) OR n = 0 AS gone, mine AND n = 1 AS gone2 FROM mem)"""
)

ORACLE = {
    "slice_numbers": CTE + " SELECT repo, id, row_number() OVER (ORDER BY repo, id) AS slice FROM ent",
    "class_slices": _SL + " SELECT v.repo, v.id, coalesce(v.kind, 'Unknown') AS type, coalesce((SELECT string_agg(slice::VARCHAR, ',' ORDER BY slice) FROM sl WHERE sl.repo = v.repo AND sl.id = v.id), '') AS slices FROM v",
    "feature_slices": _SL + " SELECT feature, slice FROM ch",
    "max_graph_nodes": _SL + " SELECT feature, nd.id FROM nd JOIN v ON v.repo = nd.repo AND v.id = nd.id WHERE kind IN ('Class', 'Interface')",
    "max_graph_sizes": _SL + " SELECT feature, count(*) AS nodes, sum((SELECT count(*) FROM e WHERE e.repo = nd.repo AND e.src = nd.id))::BIGINT AS arcs FROM nd GROUP BY feature",
    "removable_classes": _SL + """, t AS (SELECT feature, NOT EXISTS (SELECT 1 FROM sl WHERE sl.repo = nd.repo AND sl.id = nd.id AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.feature = nd.feature AND ch.repo = sl.repo AND ch.slice = sl.slice)) AS owned FROM nd)
SELECT feature, count(*) FILTER (WHERE owned) AS gone, count(*) FILTER (WHERE NOT owned) AS stay FROM t GROUP BY feature""",
    "bound_functions": _BOUND + " SELECT feature, func_id, exact FROM bf",
    "code_without_feature": _LEFT
    + """ SELECT feature, file_id, md5(string_agg(func_code, chr(10) ORDER BY start_line, func_id)) AS origin_md5, md5(coalesce(string_agg(func_code, chr(10) ORDER BY start_line, func_id) FILTER (WHERE NOT gone), '')) AS rest_md5, count(*) AS members,
  count(*) FILTER (WHERE NOT gone) AS left, string_agg(func_code, chr(10) ORDER BY start_line, func_id) <> coalesce(string_agg(func_code, chr(10) ORDER BY start_line, func_id) FILTER (WHERE NOT gone), '') AS differs FROM kept GROUP BY feature, file_id""",
    "code_without_feature_kept": _LEFT
    + """ SELECT feature, file_id, md5(coalesce(string_agg(func_code, chr(10) ORDER BY start_line, func_id) FILTER (WHERE NOT gone2), '')) AS rest_md5, count(*) AS members,
  count(*) FILTER (WHERE NOT gone2) AS left, bool_or(gone2) AS differs FROM kept GROUP BY feature, file_id""",
    "delete_diffs": _LEFT + " SELECT feature, file_id, md5(rtrim(coalesce(string_agg(func_code, chr(10) ORDER BY start_line, func_id) FILTER (WHERE NOT gone2), ''), chr(10))) AS applied_md5 FROM kept GROUP BY feature, file_id",
    "context_views": _LEFT
    + """, c AS (SELECT file_id, string_agg(func_code, chr(10) ORDER BY start_line, func_id) AS code FROM fn GROUP BY file_id),
n AS (SELECT file_id, rtrim(code, chr(10)) AS code, len(string_split(rtrim(code, chr(10)), chr(10))) AS n FROM c)
SELECT feature, a.file_id, md5('--- ' || a.file_id || chr(10) || '+++ ' || a.file_id || chr(10) || '@@ -1,' || n || ' +1,' || n || ' @@' || chr(10) || ' ' || replace(code, chr(10), chr(10) || ' ')) AS diff_md5 FROM asked a JOIN n ON n.file_id = a.file_id""",
    "new_code_diffs": """
WITH f AS (SELECT DISTINCT file_id, lower(replace(file_path, '\\', '/')) AS p, file_code FROM code_file WHERE file_code IS NOT NULL), g AS (SELECT *, array_to_string(string_split(p, '/')[-3:], '/') AS nm, len(string_split(p, '/')) AS k FROM f),
b AS (SELECT g.file_id, o.file_code AS first_code FROM g JOIN (SELECT nm, min(file_id) AS first_id FROM g WHERE k >= 3 GROUP BY nm) x ON x.nm = g.nm AND g.k >= 3 JOIN f o ON o.file_id = x.first_id WHERE g.file_id <> x.first_id)
SELECT f.file_id, length(f.file_code) AS old_chars, length(coalesce(first_code, '')) AS new_chars, f.file_code <> coalesce(first_code, '') AS differs FROM f LEFT JOIN b ON b.file_id = f.file_id""",
    "modified_nodes": "WITH fcx AS (" + CTE + " SELECT feature, id FROM fc)," + _LEFT.removeprefix("WITH ")
    + """, chg AS (SELECT DISTINCT k.feature, regexp_extract(trim(split_part(cf.func_fullname, '(', 1)), '^(.*)\\.[^.]*$', 1) AS id FROM kept k JOIN code_function cf ON cf.file_id = k.file_id WHERE gone2 AND cf.func_fullname IS NOT NULL)
SELECT DISTINCT fcx.feature, fcx.id, CASE WHEN chg.id IS NOT NULL THEN 'Modify' ELSE 'Default' END AS type FROM fcx LEFT JOIN chg ON chg.feature = fcx.feature AND chg.id = fcx.id""",
    "new_class_code": CTE
    + """, j AS (SELECT DISTINCT repo, file_code AS code, regexp_extract(replace(file_path, '\\', '/'), '([^/]+)\\.[A-Za-z]+$', 1) AS name, regexp_extract(file_code, '(?:^|\\n)[ \\t]*package[ \\t]+([\\w.]+)[ \\t]*;', 1) AS pkg FROM code_file WHERE file_code IS NOT NULL AND repo IS NOT NULL AND lower(file_path) LIKE '%.java'),
k AS (SELECT repo, code, CASE WHEN pkg = '' THEN name ELSE pkg || '.' || name END AS id FROM j)
SELECT v.repo, v.id, md5(coalesce((SELECT min(code) FROM k WHERE k.repo = v.repo AND k.id = v.id), (SELECT arg_min(code, k.id) FROM k WHERE k.repo = v.repo AND (ends_with(k.id, '.' || v.id) OR ends_with(v.id, '.' || k.id))))) AS code_md5 FROM v""",
    "package_depths": CTE
    + """, t AS (SELECT DISTINCT repo, array_to_string(p[1:n-1], '.') AS parent, array_to_string(p[1:n], '.') AS id FROM (SELECT repo, p, unnest(range(2, len(p) + 1)) AS n FROM (SELECT repo, string_split(id, '.') AS p FROM v))),
w AS (SELECT repo, parent AS top, parent AS id, 0 AS depth FROM t WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.repo = t.repo AND x.id = t.parent) UNION SELECT t.repo, w.top, t.id, w.depth + 1 FROM w JOIN t ON t.repo = w.repo AND t.parent = w.id)
SELECT repo, top, id, depth FROM w""",
    "sliced_functions": """
SELECT DISTINCT fn.func_id, md5(array_to_string(regexp_split_to_array(f.file_code, '\\r\\n|\\r|\\n')[fn.start_line:fn.end_line], chr(10))) AS code_md5
FROM (SELECT DISTINCT func_id, file_id, start_line, end_line FROM code_function WHERE start_line >= 1 AND end_line >= start_line) fn JOIN (SELECT DISTINCT file_id, file_code FROM code_file WHERE file_code IS NOT NULL) f ON f.file_id = fn.file_id""",
    "module_json": """
WITH f AS (SELECT id, min_by(module, loaded_at) AS module FROM features GROUP BY id HAVING min(deleted_at) IS NULL), m AS (SELECT id FROM modules GROUP BY id HAVING min(deleted_at) IS NULL)
SELECT m.id, to_json({'module': m.id, 'features': list(f.id ORDER BY f.id)})::VARCHAR AS json FROM m JOIN f ON f.module = m.id GROUP BY m.id""",
    "delete_feature_rows": """
WITH x AS (SELECT min(id) AS id FROM features), gone AS (SELECT DISTINCT module FROM features WHERE id = (SELECT id FROM x) AND module IS NOT NULL),
empty AS (SELECT module FROM gone WHERE module NOT IN (SELECT module FROM features WHERE id <> (SELECT id FROM x) AND module IS NOT NULL))
SELECT DISTINCT 'features' AS table_name, id::BIGINT AS row_id FROM features WHERE id <> (SELECT id FROM x)
UNION ALL SELECT DISTINCT 'code_map', id::BIGINT FROM code_map WHERE feature IS DISTINCT FROM (SELECT id FROM x)
UNION ALL SELECT DISTINCT 'modules', id::BIGINT FROM modules WHERE id NOT IN (SELECT module FROM empty)""",
    "edited_feature_rows": CTE
    + """, kn AS (SELECT fc.* FROM fc JOIN v ON v.repo = fc.repo AND v.id = fc.id), c AS (SELECT repo, id FROM kn WHERE feature = (SELECT feature FROM kn GROUP BY feature ORDER BY count(*) DESC, feature LIMIT 1)),
m AS (SELECT DISTINCT func_fullname AS n FROM code_function fn JOIN code_file cf ON cf.file_id = fn.file_id JOIN c ON c.repo = cf.repo AND c.id = regexp_extract(trim(split_part(func_fullname, '(', 1)), '^(.*)\\.[^.]*$', 1)),
p AS (SELECT c.repo, c.id AS a, v.id AS b FROM c JOIN v ON v.repo = c.repo AND v.id <> c.id AND regexp_extract(v.id, '^(.*)\\.[^.]*$', 1) = regexp_extract(c.id, '^(.*)\\.[^.]*$', 1))
SELECT 'code_map' AS table_name, n AS name FROM m WHERE n NOT IN (SELECT method_name FROM code_map WHERE method_name IS NOT NULL)
UNION ALL SELECT 'graph_edge', repo || ' ' || s || ' ' || d FROM (SELECT repo, a AS s, b AS d FROM p UNION SELECT repo, b, a FROM p) w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo = w.repo AND e.src = w.s AND e.dst = w.d)""",
    "cascade_inserts": """
WITH m AS (SELECT id, any_value(repo) AS repo, any_value(cluster_id) AS cluster_id, min_by(module_desc, loaded_at) AS module_desc, min(loaded_at) AS loaded_at FROM modules GROUP BY id),
f AS (SELECT id, min_by(module, loaded_at) AS module, min_by(feature_id, loaded_at) AS feature_id, min(loaded_at) AS loaded_at FROM features GROUP BY id),
c AS (SELECT id, min_by(feature, loaded_at) AS feature, min_by(method_name, loaded_at) AS method_name, min(loaded_at) AS loaded_at FROM code_map GROUP BY id),
h AS (SELECT TIMESTAMPTZ '2024-12-01 00:00:00+00' AS t),
r AS (SELECT m.repo, m.cluster_id, m.module_desc, f.feature_id, c.method_name FROM c JOIN f ON f.id = c.feature JOIN m ON m.id = f.module WHERE c.method_name IS NOT NULL AND f.loaded_at >= (SELECT t FROM h)),
om AS (SELECT repo, cluster_id, module_desc, min(id) AS id FROM m WHERE loaded_at < (SELECT t FROM h) GROUP BY ALL), ofe AS (SELECT module, feature_id, min(id) AS id FROM f WHERE loaded_at < (SELECT t FROM h) GROUP BY ALL),
oc AS (SELECT DISTINCT feature, method_name FROM c WHERE loaded_at < (SELECT t FROM h)),
rm AS (SELECT r.*, om.id AS mid FROM r LEFT JOIN om ON om.repo IS NOT DISTINCT FROM r.repo AND om.cluster_id IS NOT DISTINCT FROM r.cluster_id AND om.module_desc IS NOT DISTINCT FROM r.module_desc),
rf AS (SELECT rm.*, ofe.id AS fid FROM rm LEFT JOIN ofe ON ofe.module = rm.mid AND ofe.feature_id IS NOT DISTINCT FROM rm.feature_id),
rc AS (SELECT rf.*, oc.feature AS hit FROM rf LEFT JOIN oc ON oc.feature = rf.fid AND oc.method_name = rf.method_name)
SELECT 'modules' AS table_name, count(*) AS n, CASE WHEN count(*) > 0 THEN (SELECT max(id) + 1 FROM m WHERE loaded_at < (SELECT t FROM h))::BIGINT END AS first_id FROM (SELECT DISTINCT repo, cluster_id, module_desc FROM rm WHERE mid IS NULL)
UNION ALL SELECT 'features', count(*), CASE WHEN count(*) > 0 THEN (SELECT max(id) + 1 FROM f WHERE loaded_at < (SELECT t FROM h))::BIGINT END FROM (SELECT DISTINCT repo, cluster_id, module_desc, mid, feature_id FROM rf WHERE fid IS NULL)
UNION ALL SELECT 'code_map', count(*), CASE WHEN count(*) > 0 THEN (SELECT max(id) + 1 FROM c WHERE loaded_at < (SELECT t FROM h))::BIGINT END FROM (SELECT DISTINCT repo, cluster_id, module_desc, feature_id, fid, method_name FROM rc WHERE hit IS NULL)""",
    "finished_projects": "SELECT DISTINCT id, coalesce(summary_flag, false) OR id = (SELECT min(id) FROM project_info) AS summary_flag FROM project_info",
}
