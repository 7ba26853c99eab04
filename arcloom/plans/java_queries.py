"""Queries over the graph extracted from the Java sources themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcloom.operators import graph
from arcloom.operators import java_source as js
from arcloom.tables import cut, table


def _facts(spark, sf_dir):
    f = table(spark, sf_dir, "code_file").where("file_code is not null and lower(file_path) like '%.java'").dropDuplicates(["file_id"])
    return js.facts_of(f.select("file_id", "repo", F.col("file_code").alias("code")))


def java_declarations(spark, sf_dir):
    """Declarations by repository and kind."""
    return js.vertices_of(_facts(spark, sf_dir)).groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))


def java_arcs(spark, sf_dir):
    """Typed arcs by repository and kind."""
    f = cut(_facts(spark, sf_dir))
    return js.arcs_of(f, js.vertices_of(f)).groupBy("repo", "arc_group", "arc_kind").agg(F.count(F.lit(1)).alias("n"))


def java_slices(spark, sf_dir):
    """Slices of all methods that nothing calls, by the typed rules: their number of members and arcs, by repository."""
    f = cut(_facts(spark, sf_dir))
    v = cut(js.vertices_of(f))
    arcs = cut(js.arcs_of(f, v))
    calls = arcs.where("arc_group = 'CallArc'").select("repo", "src", "dst")
    heads = graph.entries(v.where("kind = 'Method'"), calls, ["repo"]).select("repo", F.col("id").alias("slice"), "id")
    members, used = graph.slice_graph(heads, v.select("repo", "id", "kind"), arcs, ["repo", "slice"])
    a = members.groupBy("repo").agg(F.count_distinct("slice").alias("slices"), F.count(F.lit(1)).alias("members"))
    return a.join(used.groupBy("repo").agg(F.count(F.lit(1)).alias("arcs")), "repo", "left")


def java_methods(spark, sf_dir):
    """Declared methods with their signatures and lines."""
    f = table(spark, sf_dir, "code_file").where("file_code is not null and lower(file_path) like '%.java'").dropDuplicates(["file_id"]).select("file_id", "repo", F.col("file_code").alias("code"))
    return js.methods_of(cut(js.facts_of(f)), f).select("file_id", "method_signature", "class_name", "start_line", "end_line", F.md5("method_code").alias("code_md5"))


def java_statistics(spark, sf_dir):
    """Type declarations, callables and fields of every repository, and files that do not hold together."""
    f = cut(_facts(spark, sf_dir))
    d = f.where("fact = 'decl' and not array_contains(notes, 'ltm.Generated')")
    n = d.groupBy("repo").agg(F.count_if(F.col("kind").isin("Class", "Interface", "Enum", "Annotation")).alias("noc"), F.count_if(F.col("kind").isin("Method", "Constructor")).alias("nom"), F.count_if(F.col("kind") == "Field").alias("nof"))
    bad = f.where("fact = 'broken'").groupBy("repo").agg(F.count_distinct("file_id").alias("broken"))
    return n.join(bad, "repo", "left").na.fill(0, ["broken"])


def java_unresolved(spark, sf_dir):
    """Names of types that no class of the repository answers to."""
    f = cut(_facts(spark, sf_dir))
    return js.unresolved(f, js.vertices_of(f))


QUERIES = {f.__name__: f for f in (java_declarations, java_arcs, java_slices, java_methods, java_statistics, java_unresolved)}
ORACLE: dict[str, str] = {}
