"""Whole runs from a folder of sources to interchange files: import graphs, and the batch that makes features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.functions import texts
from arcloom.functions.prompts import Generate, describe, feature_prompts, from_words, name_modules
from arcloom.operators import clusters, graph
from arcloom.operators import java_source as js
from arcloom.operators import resolution as res
from arcloom.plans.cluster_queries import FILES, FUNCTIONS, SEEDS
from arcloom.sources import files as src
from arcloom.tables import cut


def class_imports(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """((id), (src, dest)): classes below ``root``, and what each file's first class depends on: imports by name and by
    package, and all other classes of its package."""
    tree = src.source_tree(spark, root)
    f = cut(js.facts_of(tree.select("file_id", F.lit(0).alias("repo"), "code")))
    v = js.vertices_of(f).where(F.col("kind").isin("Class", "Interface", "Enum", "Annotation") & F.col("owner_id").isNull())
    top = v.groupBy("file_id").agg(F.min_by("id", F.struct("start", "id")).alias("src"))
    known = v.select("id", F.regexp_extract("id", r"^(.*)\.[^.]*$", 1).alias("p")).distinct()
    imp = f.where("fact = 'import'").select("file_id", "name").join(top, "file_id")
    exact = imp.join(known.select(F.col("id").alias("name")), "name").select("src", F.col("name").alias("dest"))
    wide = imp.where("name like '%.*'").select("src", F.expr("substr(name, 1, length(name) - 2)").alias("p")).join(known, "p").select("src", F.col("id").alias("dest"))
    near = top.select("src", F.regexp_extract("src", r"^(.*)\.[^.]*$", 1).alias("p")).join(known, "p").select("src", F.col("id").alias("dest"))
    return known.select("id"), exact.unionByName(wide).unionByName(near).where("src <> dest").distinct()


def import_matrix(spark: SparkSession, root: str, out: str) -> DataFrame:
    """The matrix of ``class_imports`` as a CSV below ``out``: for export of one project, whose classes are its columns."""
    nodes, edges = class_imports(spark, root)
    wide = src.to_matrix(edges, [r["id"] for r in nodes.orderBy("id").collect()])
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(out)
    return wide


def repo_summary(spark: SparkSession, root: str, out: str, generate: Generate = from_words, load=res.hashed_trigrams) -> dict[str, DataFrame]:
    """From sources to features: methods and their calls, files clustered into modules, each module's methods into features,
    both named by ``generate``. Writes ``method.csv`` and ``features.csv`` below ``out``; gives the tables."""
    tree = cut(src.source_tree(spark, root).withColumn("file_id", F.col("file_id").cast("int")).withColumn("repo", F.lit(0)))
    f = cut(js.facts_of(tree.select("file_id", "repo", "code")))
    v = cut(js.vertices_of(f))
    calls = js.arcs_of(f, v).where("arc_kind = 'NormalCall'")
    listed = js.methods_of(f, tree).join(tree.select("file_id", F.col("path").alias("file_path")), "file_id")
    methods = cut(graph.dense_ids(listed, ["method_signature", "file_path", "start_line"], "ID", 0).withColumn("ID", F.col("ID").cast("int")))
    src.write_methods(methods.select("ID", "method_signature", "method_code", "class_name", "file_path", "start_line", "end_line"), f"{out}/method.csv")

    word = tree.select(F.col("file_id").alias("i"), F.explode(texts.identifiers(F.col("code"))).alias("name"))
    hit = word.join(tree.select(F.col("file_id").alias("j"), "name"), "name").where("i <> j").select(F.lit(0).alias("repo"), "i", "j")
    links = hit.unionByName(hit.select("repo", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    nodes = tree.select("repo", F.col("file_id").alias("id"), "name")
    w = clusters.group_weights(res.encoded(nodes, ["repo", "id"], "name", load), links, ["repo"], FILES["a"], FILES["k"])
    got, _ = res.best_clustering(nodes.select("repo", "id"), w, ["repo"], FILES["gammas"], SEEDS, least=FILES["least"], ratio=FILES["ratio"], tau=FILES["tau"], merge=True)
    module = cut(got.select(F.col("id").cast("int").alias("file_id"), F.col("label").alias("module")))

    name = F.substring_index(F.substring_index("method_signature", "(", 1), ".", -1)
    fn = cut(methods.join(module, "file_id").select("module", F.col("ID").alias("id"), name.alias("name"), "method_signature", "file_id", "start_line"))
    at = v.select("file_id", F.col("start").alias("start_line"), F.col("id").alias("vertex")).join(fn.select("file_id", "start_line", "module", "id"), ["file_id", "start_line"])
    pair = calls.join(at.select(F.col("vertex").alias("src"), "module", F.col("id").alias("i")), "src").join(at.select(F.col("vertex").alias("dst"), "module", F.col("id").alias("j")), ["dst", "module"])
    pair = pair.where("i <> j").select("module", "i", "j")
    called = pair.unionByName(pair.select("module", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    wf = clusters.group_weights(res.encoded(fn, ["module", "id"], "name", load), called, ["module"], FUNCTIONS["a"], FUNCTIONS["k"])
    parts, _ = res.best_clustering(fn.select("module", "id"), wf, ["module"], FUNCTIONS["gammas"], SEEDS, least=FUNCTIONS["least"], ratio=FUNCTIONS["ratio"], tau=FUNCTIONS["tau"])
    parts = cut(parts.select("module", "label", F.col("id").cast("int").alias("id")))
    firsts = parts.groupBy("module", "label").agg(F.min("id").alias("first"))
    # one row a feature of one project
    numbers = firsts.withColumn("feature", F.row_number().over(Window.orderBy("module", "first")))
    bound = cut(parts.join(numbers, ["module", "label"]).join(fn.drop("module"), "id").select("feature", "module", "id", "name", "method_signature"))
    desc = cut(describe(feature_prompts(bound.select("feature", F.col("id").alias("pos"), "name")), "feature", generate))
    of_module = bound.select("feature", "module").distinct().join(desc, "feature").groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "description"))), lambda x: x["description"]).alias("d"))
    names = name_modules([(r["module"], r["d"]) for r in of_module.orderBy("module").collect()], generate)  # a row a module; each prompt has the names before it
    named = spark.createDataFrame(list(names.items()) or [], "module long, module_desc string")
    features = bound.join(desc, "feature").join(F.broadcast(named), "module", "left")
    rows = features.select(F.col("feature").alias("id"), F.col("module").cast("int").alias("cluster_id"), "module_desc", F.col("description").alias("desc"), F.col("method_signature").alias("method_name"), F.lit("").alias("flow"), F.lit("").alias("notf"))
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{out}/features.csv")
    return {"methods": methods, "modules": module, "features": rows}
