"""Access to the input tables, and the few session helpers every plan shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (one file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_delivery(df: DataFrame, *key: str, order: str = "loaded_at") -> DataFrame:
    """One row per key: the delivery with the earliest ``order`` column.

    Deliveries without a time sort last; equal times are told apart by the row's hash, so the
    choice is the same on every run. ``min_by`` combines on the map side, so a key that is
    delivered very often does not gather in one task.
    """
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(F.col(order).isNull(), F.col(order), F.xxhash64(*[F.col(f"`{c}`") for c in rest if not _nested(df, c)]))
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank).alias("__row"))
    return picked.select(*[F.col(c) if c in key else F.col("__row").getField(c).alias(c) for c in df.columns])


def _nested(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names in ``spark.checkpoint.dir``. Where none is set, a local session gets
    one of its own; on a cluster, whose executors would each write to their own disk, it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="arcloom-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame, loop: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors.

    A checkpointed frame keeps the estimates of its plan, and a join's is the product of its sides: in a
    loop the numbers would double their digits each round until planning takes longer than running.
    ``loop`` drops them, with what is known of the partitioning.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    if not loop:
        return kept
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)
