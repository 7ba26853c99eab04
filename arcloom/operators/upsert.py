"""Idempotent loading, cascading deletes and snapshots of the project model.

Tables are immutable: an operation gives the rows of a new snapshot, to be written elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.operators.graph import dense_ids
from arcloom.tables import cut


def new_rows(incoming: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet, one a key (the least by ``order``); null keys equal each other."""
    cols = [c for c in incoming.columns if c not in key]
    one = incoming.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__r")).select(*key, "__r.*") if cols else incoming.select(*key).distinct()
    have = existing.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return one.join(have, same, "left_anti")


def numbered(rows: DataFrame, existing: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """New surrogate ids after the largest existing one, in a total order."""
    top = existing.agg(F.max(name)).first()[0] or 0
    return dense_ids(rows.drop(name), order, name, top + 1)


def without(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is not among the deleted ``parents``."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def delete_project(repo: int, modules: DataFrame, features: DataFrame, code_map: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The four tables without a project's rows, children before parents."""
    gone_m = modules.where(F.col("repo") == repo)
    gone_f = features.join(gone_m.select(F.col("id").alias("module")).distinct(), "module", "left_semi")
    return {
        "code_map": without(code_map, gone_f, "feature"),
        "features": without(features, gone_m, "module"),
        "modules": modules.where(~F.col("repo").eqNullSafe(F.lit(repo))),
        "graph_edge": edges.where(~F.col("repo").eqNullSafe(F.lit(repo))),
    }


def delete_feature(feature: int, features: DataFrame, code_map: DataFrame, modules: DataFrame) -> dict[str, DataFrame]:
    """Without one feature and its methods, and without its module if that has no other feature."""
    gone = features.where(F.col("id") == feature)
    rest = features.where(F.col("id") != feature)
    empty = gone.select("module").where("module is not null").distinct().join(rest.select("module").distinct(), "module", "left_anti").select(F.col("module").alias("id"))
    return {"features": rest, "code_map": without(code_map, gone, "feature"), "modules": modules.join(empty, "id", "left_anti")}


def insert_rows(rows: DataFrame, modules: DataFrame, features: DataFrame, code_map: DataFrame) -> dict[str, DataFrame]:
    """The modules, features and methods that denormalised rows (repo, cluster_id, module_desc, feature_id, method_name) add,
    with new ids, each level after the one above; what is there already, by its key, is used and not added again."""
    mk, fk = ["repo", "cluster_id", "module_desc"], ["module", "feature_id"]
    new_m = cut(numbered(new_rows(rows.select(*mk).distinct(), modules, mk, mk), modules, mk))
    at_m = modules.select("id", *mk).unionByName(new_m.select("id", *mk)).groupBy(*mk).agg(F.min("id").cast("long").alias("module"))
    r = _looked_up(rows, at_m, mk, "module")
    new_f = cut(numbered(new_rows(r.select(*fk).distinct(), features, fk, fk), features, fk))
    at_f = features.select(F.col("id").cast("long").alias("id"), F.col("module").cast("long").alias("module"), "feature_id").unionByName(new_f.select("id", *fk)).groupBy(*fk).agg(F.min("id").alias("feature"))
    r = _looked_up(r, at_f, fk, "feature")
    ck = ["feature", "method_name"]
    new_c = numbered(new_rows(r.select(*ck).distinct(), code_map, ck, ck), code_map, ck)
    return {"modules": new_m, "features": new_f, "code_map": new_c}


def _looked_up(rows: DataFrame, ids: DataFrame, key: list[str], name: str) -> DataFrame:
    """Adds the id of each row's key; null keys equal each other."""
    have = ids.select(*[F.col(k).alias(f"__{k}") for k in key], name)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return rows.join(have, same).drop(*[f"__{k}" for k in key])


def package_edges(classes: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, src, dst): arcs between ``classes`` (repo, id) and the other known classes of their packages, both ways."""

    def package(c: str):
        return F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)

    near = classes.select("repo", F.col("id").alias("src"), package("id").alias("p")).join(known.select("repo", F.col("id").alias("dst"), package("id").alias("p")), ["repo", "p"]).where("src <> dst")
    return near.select("repo", "src", "dst").unionByName(near.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def edit_feature(feature: int | None, text: str, features: DataFrame, code_map: DataFrame, edges: DataFrame, methods: DataFrame, arcs: DataFrame, module: int | None = None) -> dict[str, DataFrame]:
    """A changed feature, or with ``feature`` None a new one of ``module``: its description, and the methods (method_name)
    and arcs (repo, src, dest) of its changed files that are not there yet. Methods are unique over all features."""
    if feature is None:
        top = features.agg(F.max("id").alias("id"), F.max(F.when(F.col("module") == module, F.col("feature_id"))).alias("n")).first()
        feature = (top["id"] or 0) + 1
        row = features.sparkSession.range(1).select(F.lit(feature).alias("id"), F.lit(module).alias("module"), F.lit((top["n"] or 0) + 1).alias("feature_id"), F.lit(text).alias("feature_desc"))
        kept = features.unionByName(row.select(*[F.col(c).cast(features.schema[c].dataType) for c in row.columns]), allowMissingColumns=True)
    else:
        kept = features.withColumn("feature_desc", F.when(F.col("id") == feature, F.lit(text)).otherwise(F.col("feature_desc")))
    fresh = new_rows(methods.select("method_name").distinct(), code_map, ["method_name"], ["method_name"])
    named = numbered(fresh.withColumn("feature", F.lit(feature)), code_map, ["method_name"])
    key = ["repo", "src", "dest"]
    return {"features": kept, "new_methods": named.select("id", "feature", "method_name"), "new_edges": new_rows(arcs.select(*key).distinct(), edges, key, key).select(*key)}


def finish(projects: DataFrame, repo: int) -> DataFrame:
    """Sets the summary flag of a project."""
    return projects.withColumn("summary_flag", F.when(F.col("id") == repo, F.lit(True)).otherwise(F.col("summary_flag")))
