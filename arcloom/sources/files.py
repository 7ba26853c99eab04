"""Reading source trees, interchange files and dumps; writing them back."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.operators.graph import dense_ids

METHOD_CSV = "ID int, method_signature string, method_code string, class_name string, file_path string, start_line int, end_line int"
FEATURES_CSV = "id int, cluster_id int, module_desc string, desc string, method_name string, flow string, notf string"
SEED = {
    "project_info": "id int, repo_name string, description string, git_link string, loc int, noc int, nom int, nof int, summary_flag boolean",
    "modules": "id int, repo int, cluster_id int, module_desc string, module_desc_cn string",
    "features": "id int, module int, feature_id int, feature_desc string, feature_desc_cn string",
    "code_map": "id int, feature int, method_name string",
    "graph_edge": "id int, repo int, src string, dest string",
}
COMMITS = "dataset array<struct<project_name:string,issues:array<struct<id:string,issue:string,description:string,methods:array<string>>>>>"


def source_tree(spark: SparkSession, root: str, suffix: str = ".java") -> DataFrame:
    """(file_id, path, name, dotted, code) of every file below ``root``, numbered in the order of their paths."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}").select("value", F.col("_metadata.file_path").alias("full"))
    base = re.escape(root.rstrip("/"))
    rows = raw.select(F.regexp_replace("full", rf"^(?:file:/*)?/*{base.lstrip('/')}/", "").alias("path"), F.col("value").alias("code"))
    bare = F.regexp_replace("path", re.escape(suffix) + "$", "")
    named = rows.select("path", F.substring_index(bare, "/", -1).alias("name"), F.replace(bare, F.lit("/"), F.lit(".")).alias("dotted"), "code")
    return dense_ids(named, ["path"], "file_id", 0).select("file_id", "path", "name", "dotted", "code")


def file_paths(spark: SparkSession, root: str, suffix: str = ".java") -> DataFrame:
    """(path) of every file below ``root`` that has any content; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path")


def write_tree(files: DataFrame, root: str) -> None:
    """Each (path, code) as a file below ``root``, a folder that all executors share. Written again, a file is the same."""

    def run(batches):
        for b in batches:
            for path, code in zip(b["path"], b["code"]):
                at = os.path.normpath(os.path.join(root, path))
                if not at.startswith(os.path.normpath(root) + os.sep):
                    raise ValueError(f"{path} leaves the folder")
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "w", encoding="utf-8", newline="") as f:
                    f.write(code or "")
            yield b[["path"]]

    files.select("path", "code").where("path is not null").mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def paired(uploads: DataFrame, contents: str = "files", paths: str = "paths") -> DataFrame:
    """(path, content) of uploads that carry two lists in the same order; what has no partner is left out."""
    both = F.arrays_zip(F.col(contents).alias("content"), F.col(paths).alias("path"))
    return uploads.select(F.explode(both).alias("x")).select(F.col("x.path").alias("path"), F.col("x.content").alias("content")).where("path is not null and content is not null")


def file_content(files: DataFrame, names: DataFrame, missing: str = "file not found") -> DataFrame:
    """Contents by dotted name, with a fixed sentence for those that are missing."""
    return names.join(files.select("dotted", "code"), "dotted", "left").select("dotted", F.coalesce("code", F.lit(missing)).alias("code"))


def read_methods(spark: SparkSession, path: str) -> DataFrame:
    """The interchange file of methods, newlines in code restored."""
    df = spark.read.schema(METHOD_CSV).csv(path, header=True, multiLine=True, escape='"')
    return df.withColumn("method_code", F.replace("method_code", F.lit("\\n"), F.lit("\n")))


def write_methods(df: DataFrame, path: str) -> None:
    df.withColumn("method_code", F.replace("method_code", F.lit("\n"), F.lit("\\n"))).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES_CSV).csv(path, header=True, multiLine=True, escape='"')


def write_features(features: DataFrame, methods: DataFrame, path: str) -> None:
    """One row for each feature and method."""
    features.join(methods, "id").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(src, dest) of the ones of a 0/1 adjacency matrix file whose first row and column name the nodes."""
    wide = spark.read.option("header", True).csv(path)
    first, rest = wide.columns[0], wide.columns[1:]
    return wide.withColumnRenamed(first, "src").unpivot("src", [F.col(f"`{c}`") for c in rest], "dest", "v").where(F.col("v").cast("int") == 1).select("src", "dest")


def to_matrix(edges: DataFrame, nodes: list[str]) -> DataFrame:
    """The dense 0/1 matrix of a small graph (its nodes are named by the caller)."""
    base = edges.sparkSession.createDataFrame([(n,) for n in nodes], "src string")
    wide = edges.groupBy("src").pivot("dest", nodes).agg(F.max(F.lit(1)))
    return base.join(wide, "src", "left").na.fill(0).orderBy("src")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """(project_name, id, issue, description, method) of a replay file."""
    d = spark.read.schema(COMMITS).option("multiLine", True).json(path)
    one = d.select(F.explode("dataset").alias("d")).select("d.project_name", F.explode("d.issues").alias("i"))
    return one.select("project_name", "i.id", "i.issue", "i.description", F.explode_outer("i.methods").alias("method"))


_INSERT = re.compile(r"INSERT INTO `?(\w+)`?(?:\s*\([^)]*\))?\s+VALUES\s*", re.I)
_VALUE = re.compile(r"\s*(?:'((?:[^'\\]|\\[\s\S]|'')*)'|(NULL)|(0x[0-9a-fA-F]+)|_binary\s*'([^']*)'|(-?\d+(?:\.\d+)?)|b'([01]+)')\s*", re.I)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def parse_dump(text: str) -> dict[str, list[tuple]]:
    """Rows of the multi-row INSERT statements of a dump, by table (quotes doubled or escaped, NULL, bits)."""
    out: dict[str, list[tuple]] = {}
    for m in _INSERT.finditer(text):
        i, rows = m.end(), out.setdefault(m.group(1), [])
        while i < len(text) and text[i] == "(":
            i, row = i + 1, []
            while True:
                v = _VALUE.match(text, i)
                if not v:
                    raise ValueError(f"no value at {text[i:i + 40]!r}")
                s, null, hexed, binary, number, bits = v.groups()
                if s is not None:
                    row.append(re.sub(r"\\([\s\S])", lambda x: _ESCAPES.get(x.group(1), x.group(1)), s.replace("''", "'")))
                else:
                    row.append(None if null else bool(int(hexed, 16)) if hexed else bool(ord(binary[-1]) & 1) if binary else bool(int(bits, 2)) if bits else float(number) if "." in number else int(number))
                i = v.end()
                if text[i] == ",":
                    i += 1
                    continue
                break
            rows.append(tuple(row))
            i += 1
            nxt = re.compile(r"\s*,\s*(?=\()").match(text, i)
            if not nxt:
                break
            i = nxt.end()
    return out


def load_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Seed tables of a dump (a small fixture file)."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return {t: spark.createDataFrame([r[: len(SEED[t].split(", "))] for r in rows], SEED[t]) for t, rows in parse_dump(text).items() if t in SEED}
