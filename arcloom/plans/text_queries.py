"""Queries over source text: lines, imports, names, intervals, reassembled code, diffs, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.functions import texts
from arcloom.operators import diff
from arcloom.plans.graph_queries import vertices_of
from arcloom.tables import table


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Java files once each: file_id, repo, name (simple class name), pkg, code."""
    f = table(spark, sf_dir, "code_file").where("file_code is not null and lower(file_path) like '%.java'").dropDuplicates(["file_id"])
    path = F.regexp_replace("file_path", r"\\", "/")
    return f.select("file_id", "repo", F.regexp_extract(path, r"([^/]+)\.[A-Za-z]+$", 1).alias("name"), F.regexp_extract("file_code", r"(?:^|\n)[ \t]*package[ \t]+([\w.]+)[ \t]*;", 1).alias("pkg"), F.col("file_code").alias("code"))


def loc_by_file(spark, sf_dir):
    f = table(spark, sf_dir, "code_file").where("file_code is not null").dropDuplicates(["file_id"])
    return f.select("file_id", "repo", texts.lines_of_code(F.col("file_code")).alias("loc"))


def repo_statistics(spark, sf_dir):
    """Files, lines of code and functions of every repository."""
    loc = loc_by_file(spark, sf_dir)
    fn = table(spark, sf_dir, "code_function").select("func_id", "file_id").distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return loc.join(fn, "file_id", "left").groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.coalesce(F.sum("n"), F.lit(0)).alias("functions"))


def import_edges(spark, sf_dir):
    """Arcs from a file's class to the known classes it imports by name or by package, else those of a class's simple name in its text.

    Files stand for the class of their full name, else for the one of their simple name (``resolved_files``)."""
    known = vertices_of(spark, sf_dir).select("repo", F.col("id").alias("dst"), "owner_id")
    at = resolved_files(spark, sf_dir).where("class_id is not null").select("file_id", F.col("class_id").alias("src"))
    j = java_files(spark, sf_dir).select("file_id", "repo", "code").join(at, "file_id")
    imp = j.select("repo", "src", F.explode(texts.imported(F.col("code"))).alias("imp"))
    exact = imp.join(known.withColumnRenamed("dst", "imp"), ["repo", "imp"]).select("repo", "src", F.col("imp").alias("dst"), F.lit("import").alias("how"))
    wide = imp.where("imp like '%.*'").withColumn("owner_id", F.expr("substr(imp, 1, length(imp) - 2)")).join(known, ["repo", "owner_id"]).select("repo", "src", "dst", F.lit("package").alias("how"))
    simple = known.groupBy("repo", F.substring_index("dst", ".", -1).alias("name")).agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("n")).where("n = 1")
    word = j.select("repo", "src", F.explode(texts.identifiers(F.col("code"))).alias("name")).join(simple, ["repo", "name"]).select("repo", "src", "dst", F.lit("name").alias("how"))
    return exact.unionByName(wide).unionByName(word).where("src <> dst").distinct()


def resolved_files(spark, sf_dir):
    """The class each Java file stands for: by its full name, else by its simple name in the repository."""
    j = java_files(spark, sf_dir).select("file_id", "repo", "name", F.concat_ws(".", "pkg", "name").alias("fqn"))
    v = vertices_of(spark, sf_dir).select("repo", "id")
    full = v.select("repo", F.col("id").alias("fqn"), F.col("id").alias("a")).distinct()
    simple = v.groupBy("repo", F.substring_index("id", ".", -1).alias("name")).agg(F.min("id").alias("b"))
    out = j.join(full, ["repo", "fqn"], "left").join(simple, ["repo", "name"], "left")
    return out.select("file_id", F.coalesce("a", "b").alias("class_id"), F.when(F.col("a").isNotNull(), "full").when(F.col("b").isNotNull(), "simple").otherwise("none").alias("how"))


def name_links(spark, sf_dir):
    """Java files of a repository that mention another file's class name (equi-join on identifiers, in both directions)."""
    j = java_files(spark, sf_dir)
    ids = j.select("repo", F.col("file_id").alias("a"), F.explode(texts.identifiers(F.col("code"))).alias("name"))
    hit = ids.join(j.select("repo", "name", F.col("file_id").alias("b")), ["repo", "name"]).where("a <> b").select("a", "b")
    return hit.unionByName(hit.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def comment_contexts(spark, sf_dir):
    """The innermost function around every line comment of a file (interval join on equal files, smallest span)."""
    f = table(spark, sf_dir, "code_file").where("file_code is not null").dropDuplicates(["file_id"]).select("file_id", F.posexplode(texts.lines(F.col("file_code"))).alias("i", "line"))
    at = f.where(F.ltrim("line").startswith("//")).select("file_id", (F.col("i") + 1).alias("line_no"))
    fn = table(spark, sf_dir, "code_function").where("start_line is not null").select("file_id", "func_id", "start_line", "end_line").distinct()
    hit = at.join(fn, "file_id").where("line_no between start_line and end_line")
    return hit.groupBy("file_id", "line_no").agg(F.min_by("func_id", F.struct(F.col("end_line") - F.col("start_line"), "func_id")).alias("func_id"))


def assembled_code(spark, sf_dir):
    """Every file's functions put together again in the order of their lines."""
    fn = table(spark, sf_dir, "code_function").where("func_code is not null").dropDuplicates(["func_id"])
    one = fn.select("file_id", F.struct("start_line", "func_id").alias("at"), "func_code")
    return diff.assembled(one, ["file_id"], "at", "func_code").select("file_id", F.md5("code").alias("code_md5"), F.length("code").cast("long").alias("chars"))


def rewritten_files(spark, sf_dir):
    """Every Java file with functions written anew from its package, its imports and its functions."""
    body = diff.assembled(table(spark, sf_dir, "code_function").where("func_code is not null").dropDuplicates(["func_id"]).select("file_id", F.struct("start_line", "func_id").alias("at"), "func_code"), ["file_id"], "at", "func_code")
    j = java_files(spark, sf_dir).select("file_id", "pkg", texts.import_lines(F.col("code")).alias("imports")).join(body, "file_id")
    return j.select("file_id", F.md5(diff.rewritten(F.col("pkg"), F.col("imports"), F.col("code"))).alias("code_md5"))


def file_versions(spark, sf_dir):
    """Files of the same name and folder in several repositories: whether each differs from the first one."""
    pair = same_files(spark, sf_dir)
    return pair.select("file_id", "first_id", diff.differs(F.col("first_code"), F.col("code")).alias("differs"))


def file_diffs(spark, sf_dir):
    """The unified diffs of those that differ: what each gives when applied, line ends being equal."""
    pair = same_files(spark, sf_dir).where(diff.differs(F.col("first_code"), F.col("code")))
    d = pair.select("file_id", "first_id", diff.unified_diff("first_code", "code", "file_name").alias("diff"))
    return d.select("file_id", "first_id", F.md5(diff.new_side(F.col("diff"))).alias("applied_md5"))


def same_files(spark, sf_dir):
    f = table(spark, sf_dir, "code_file").where("file_code is not null").dropDuplicates(["file_id"])
    parts = F.split(F.lower(F.regexp_replace("file_path", r"\\", "/")), "/")
    f = f.select("file_id", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), "/").alias("file_name"), F.size(parts).alias("n"), F.col("file_code").alias("code")).where("n >= 3").drop("n")
    first = f.groupBy("file_name").agg(F.min("file_id").alias("first_id"))
    both = f.select("file_id", "file_name", "code").join(first, "file_name").where("file_id <> first_id")
    return both.join(f.select(F.col("file_id").alias("first_id"), F.col("code").alias("first_code")), "first_id")


def event_payloads(spark, sf_dir):
    """The number in each event's JSON, per type."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("p.k").alias("with_k"), F.sum("p.k").alias("sum_k"))


def encoded_descriptions(spark, sf_dir):
    m = table(spark, sf_dir, "modules").where("module_desc is not null").select("id", "module_desc").distinct()
    return m.select("id", texts.base64_text(F.col("module_desc")).alias("b64"))


def module_labels(spark, sf_dir):
    """Latest delivery wins: each module's newest description and its place among the project's modules."""
    m = table(spark, sf_dir, "modules").where("repo is not null")
    newest = m.groupBy("id", "repo").agg(F.max_by("module_desc", F.struct("loaded_at", "module_desc")).alias("label"))
    return newest.select("id", "label", F.row_number().over(Window.partitionBy("repo").orderBy("id")).cast("long").alias("place"))


QUERIES = {
    f.__name__: f
    for f in (
        loc_by_file, repo_statistics, import_edges, resolved_files, name_links, comment_contexts, assembled_code, rewritten_files, file_versions, file_diffs, event_payloads, encoded_descriptions, module_labels,
    )
}

_LOC = "len(list_filter(list_transform(regexp_split_to_array(file_code, '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '/*') AND NOT starts_with(x, '*')))"
_FILES = "(SELECT DISTINCT file_id, repo, file_path, file_code FROM code_file WHERE file_code IS NOT NULL)"
_JAVA = f"""
WITH vx AS (SELECT repo, id, min_by(owner_id, loaded_at) AS owner_id, min(deleted_at) AS deleted_at FROM vertices GROUP BY repo, id), v AS (SELECT * FROM vx WHERE deleted_at IS NULL),
j AS (SELECT file_id, repo, regexp_extract(replace(file_path, '\\', '/'), '([^/]+)\\.[A-Za-z]+$', 1) AS name, regexp_extract(file_code, '(?:^|\\n)[ \\t]*package[ \\t]+([\\w.]+)[ \\t]*;', 1) AS pkg, file_code AS code
  FROM {_FILES} WHERE lower(file_path) LIKE '%.java')"""
_SAME = f"""
WITH f AS (SELECT file_id, lower(replace(file_path, '\\', '/')) AS p, file_code FROM {_FILES}), g AS (SELECT file_id, file_code, array_to_string(string_split(p, '/')[-3:], '/') AS file_name FROM f WHERE len(string_split(p, '/')) >= 3),
b AS (SELECT *, min(file_id) OVER (PARTITION BY file_name) AS first_id FROM g)"""

ORACLE = {
    "loc_by_file": f"SELECT file_id, repo, {_LOC} AS loc FROM {_FILES}",
    "repo_statistics": f"SELECT repo, count(*) AS files, sum({_LOC})::BIGINT AS loc, coalesce(sum((SELECT count(DISTINCT func_id) FROM code_function c WHERE c.file_id = f.file_id)), 0)::BIGINT AS functions FROM {_FILES} f GROUP BY repo",
    "import_edges": _JAVA
    + """, s AS (SELECT repo, regexp_extract(id, '([^.]*)$', 1) AS name, min(id) AS b, count(*) AS n FROM v GROUP BY ALL),
r AS (SELECT j.file_id, j.repo, j.code, coalesce(v.id, s.b) AS src FROM j LEFT JOIN v ON v.repo = j.repo AND v.id = CASE WHEN pkg = '' THEN '.' || name ELSE pkg || '.' || name END LEFT JOIN s ON s.repo = j.repo AND s.name = j.name),
i AS (SELECT DISTINCT repo, src, unnest(regexp_extract_all(code, '(?:^|\\n)[ \\t]*import[ \\t]+(?:static[ \\t]+)?([\\w.]+(?:\\.\\*)?)[ \\t]*;', 1)) AS imp FROM r WHERE src IS NOT NULL),
w AS (SELECT DISTINCT repo, src, unnest(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM r WHERE src IS NOT NULL)
SELECT repo, src, dst, how FROM (SELECT i.repo, src, v.id AS dst, 'import' AS how FROM i JOIN v ON v.repo = i.repo AND v.id = imp UNION SELECT i.repo, src, v.id, 'package' FROM i JOIN v ON v.repo = i.repo AND imp = v.owner_id || '.*'
  UNION SELECT w.repo, src, s.b, 'name' FROM w JOIN s ON s.repo = w.repo AND s.name = w.name AND s.n = 1) WHERE src <> dst""",
    "resolved_files": _JAVA
    + """, s AS (SELECT repo, regexp_extract(id, '([^.]*)$', 1) AS name, min(id) AS b FROM v GROUP BY ALL)
SELECT file_id, coalesce(v.id, s.b) AS class_id, CASE WHEN v.id IS NOT NULL THEN 'full' WHEN s.b IS NOT NULL THEN 'simple' ELSE 'none' END AS how
FROM j LEFT JOIN v ON v.repo = j.repo AND v.id = CASE WHEN pkg = '' THEN '.' || name ELSE pkg || '.' || name END LEFT JOIN s ON s.repo = j.repo AND s.name = j.name""",
    "name_links": _JAVA
    + """, i AS (SELECT DISTINCT repo, file_id AS a, unnest(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM j), h AS (SELECT i.a, j.file_id AS b FROM i JOIN j ON j.repo = i.repo AND j.name = i.name WHERE i.a <> j.file_id)
SELECT a, b FROM h UNION SELECT b, a FROM h""",
    "comment_contexts": f"""
WITH l AS (SELECT file_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS line_no FROM (SELECT file_id, regexp_split_to_array(file_code, '\\r\\n|\\r|\\n') AS s FROM {_FILES})),
fn AS (SELECT DISTINCT file_id, func_id, start_line, end_line FROM code_function WHERE start_line IS NOT NULL)
SELECT l.file_id, line_no, arg_min(func_id, (end_line - start_line)::BIGINT * 1000000000 + func_id) AS func_id FROM l JOIN fn ON fn.file_id = l.file_id AND line_no BETWEEN start_line AND end_line WHERE starts_with(ltrim(line, ' '), '//') GROUP BY ALL""",
    "assembled_code": "SELECT file_id, md5(c) AS code_md5, length(c) AS chars FROM (SELECT file_id, string_agg(func_code, chr(10) ORDER BY start_line, func_id) AS c FROM (SELECT DISTINCT file_id, func_id, start_line, func_code FROM code_function WHERE func_code IS NOT NULL) GROUP BY file_id)",
    "rewritten_files": _JAVA
    + """, b AS (SELECT file_id, string_agg(func_code, chr(10) ORDER BY start_line, func_id) AS c FROM (SELECT DISTINCT file_id, func_id, start_line, func_code FROM code_function WHERE func_code IS NOT NULL) GROUP BY file_id),
i AS (SELECT file_id, list_filter(list_transform(regexp_split_to_array(code, '\\r\\n|\\r|\\n'), lambda x: trim(x)), lambda x: starts_with(x, 'import ')) AS l FROM j)
SELECT j.file_id, md5(concat_ws(chr(10) || chr(10), CASE WHEN pkg <> '' THEN 'package ' || pkg || ';' END, CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) END, b.c)) AS code_md5 FROM j JOIN b ON b.file_id = j.file_id JOIN i ON i.file_id = j.file_id""",
    "file_versions": _SAME + " SELECT b.file_id, b.first_id, b.file_code <> g.file_code AS differs FROM b JOIN g ON g.file_id = b.first_id WHERE b.file_id <> b.first_id",
    # texts whose lines are the same but for their ends give a diff without changes, of the first one's lines
    "file_diffs": _SAME
    + """, n AS (SELECT b.file_id, b.first_id, regexp_replace(regexp_replace(b.file_code, '\\r\\n|\\r', chr(10), 'g'), '\\n\\z', '') AS c, b.file_code <> g.file_code AS d FROM b JOIN g ON g.file_id = b.first_id WHERE b.file_id <> b.first_id)
SELECT file_id, first_id, md5(c) AS applied_md5 FROM n WHERE d""",
    "event_payloads": "SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')::INT) AS with_k, sum(json_extract(props, '$.k')::INT)::BIGINT AS sum_k FROM events GROUP BY event_type",
    "encoded_descriptions": "SELECT DISTINCT id, to_base64(encode(module_desc)) AS b64 FROM modules WHERE module_desc IS NOT NULL",
    "module_labels": "SELECT id, label, row_number() OVER (PARTITION BY repo ORDER BY id) AS place FROM (SELECT id, repo, arg_max(module_desc, loaded_at) AS label FROM modules WHERE repo IS NOT NULL GROUP BY id, repo)",
}
