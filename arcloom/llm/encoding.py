"""Problem 8: the token ids of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm.tokens import encode
from arcloom.tables import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and characters a token, by source."""
    docs = table(spark, sf_dir, "documents")
    n = encode(docs, "doc_id").select("doc_id", F.size("ids").cast("long").alias("n"))
    by = docs.select("doc_id", F.lower("source").alias("source"), F.length("text").alias("chars")).join(n, "doc_id")
    return by.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.round(F.sum("chars") / F.sum("n"), 4).alias("chars_a_token"))


QUERIES = {"p8_ids": p8_ids, "p8_stats": p8_stats}
ORACLE: dict[str, str] = {}
