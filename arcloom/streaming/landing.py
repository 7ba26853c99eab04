"""Incremental upkeep of the class graph from a landing folder of new source files.

An extension: files that land are read as a stream, and each micro-batch adds the edges of its
classes (imports of known classes, and both ways within their package) that are not in the edge
table yet. Batches are idempotent: the anti-join makes a batch that is run again add nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcloom.functions.texts import imported

SCHEMA = "repo int, class_id string, code string"


def landed(spark: SparkSession, folder: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(SCHEMA).format(fmt).load(folder)


def new_edges(batch: DataFrame, known: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, src, dst) that the batch's classes add. ``known`` are (repo, id) of all classes, the batch's among them."""
    b = batch.where("class_id is not null").select("repo", F.col("class_id").alias("src"), "code").dropDuplicates(["repo", "src"])
    imp = b.select("repo", "src", F.explode(imported(F.col("code"))).alias("dst")).join(known.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_semi")
    pack = F.regexp_extract("id", r"^(.*)\.[^.]*$", 1)
    near = b.select("repo", "src", F.regexp_extract("src", r"^(.*)\.[^.]*$", 1).alias("p")).join(known.select("repo", F.col("id").alias("dst"), pack.alias("p")), ["repo", "p"])
    both = imp.select("repo", "src", "dst").unionByName(near.select("repo", "src", "dst")).unionByName(near.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct().join(edges.select("repo", "src", "dst"), ["repo", "src", "dst"], "left_anti")


def maintain(stream: DataFrame, known: Callable[[], DataFrame], edges: Callable[[], DataFrame], append: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Runs until the folder is read; ``append`` writes what a batch adds."""

    def one(batch: DataFrame, _: int) -> None:
        now = known().unionByName(batch.select("repo", F.col("class_id").alias("id"))).distinct()
        append(new_edges(batch, now, edges()))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def relayed(lines: DataFrame) -> DataFrame:
    """(stream, text): what a token stream says, from its ``data:`` lines in order (stream, n, line)."""
    from arcloom.functions.texts import chunk_content

    parts = lines.select("stream", "n", chunk_content(F.col("line")).alias("c")).where("c is not null")
    return parts.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]), "").alias("text"))
