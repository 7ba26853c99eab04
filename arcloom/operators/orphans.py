"""References to records that do not exist, were deleted before, or arrive later.

``find_orphans`` checks one foreign key, simple or composite. A composite key may be partly
null, so references are grouped by their null mask (which of the key's columns are set) and every
mask is joined on exactly its non-null columns. What a partly null key means is declared:

``simple``   a key with any null column refers to nothing and is never an orphan;
``partial``  it must match some target on the columns that are set;
``full``     a key is either wholly set or wholly null, so a partly null one is an orphan.

A wholly null key is never a reference.

Scale: the targets are reduced to one row per key before the join (combined on the map side), so
the join never multiplies rows and a hot key (one target named by a third of the references) is a
skew of the probe side only, which adaptive execution splits. Deliveries of a reference are
reduced after the join, when only suspicious rows are left; for `late` and `deleted` that gives
the same answer as reducing them first (both are monotone in the delivery time).

Defined edge cases: null times make neither `late` nor `deleted` true; repeated deliveries count
once by the earliest time; targets delivered repeatedly count from their earliest time; several
targets under a partly null key are late (deleted) only if all of them are; an empty reference
table gives no rows, an empty target table makes every reference `missing`; other columns of the
inputs, whatever their names, are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = ("missing", "late", "deleted")


def find_orphans(
    refs: DataFrame,
    targets: DataFrame,
    ref_key: list[str],
    target_key: list[str],
    *,
    row_id: str = "id",
    match: str = "partial",
    ref_time: str = "loaded_at",
    target_time: str = "loaded_at",
    deleted: str | None = "deleted_at",
    keep: list[str] | None = None,
    required: list[str] | None = None,
) -> DataFrame:
    """Rows (row_id, reason, *keep) of the references of ``refs`` without a valid target.

    ``required`` names the key columns without which a row is no reference at all (for an edge's
    end: the end itself); the default is that any set column makes a reference.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics {match!r}")
    keep = list(keep or [])
    required = list(required or [])
    cols = [f"k{i}" for i in range(len(ref_key))]
    r = refs.select(
        F.col(f"`{row_id}`").alias("row_id"),
        F.col(f"`{ref_time}`").alias("r_time"),
        *[F.col(f"`{c}`").alias(k) for c, k in zip(ref_key, cols)],
        *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)],
    )
    t = targets.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(target_key, cols)],
        F.col(f"`{target_time}`").alias("t_time"),
        (F.col(f"`{deleted}`") if deleted else F.lit(None).cast("timestamp")).alias("t_deleted"),
    )
    parts = []
    for mask in product((True, False), repeat=len(cols)):
        if not any(mask) or any(not m and c in required for m, c in zip(mask, ref_key)):
            continue
        on = [c for c, m in zip(cols, mask) if m]
        part = r.where(reduce(Column.__and__, [F.col(c).isNotNull() if m else F.col(c).isNull() for c, m in zip(cols, mask)]))
        if not all(mask) and match == "simple":
            continue
        if not all(mask) and match == "full":
            parts.append(_shaped(part.withColumns({"t_time": F.lit(None).cast("timestamp"), "t_deleted": F.lit(None).cast("timestamp"), "hit": F.lit(False)}), len(keep)))
            continue
        parts.append(_shaped(part.join(_one_per_key(t, cols, on), on, "left").withColumn("hit", F.coalesce("hit", F.lit(False))), len(keep)))
    suspect = reduce(DataFrame.unionByName, parts).where(~F.col("hit") | F.col("t_deleted").isNotNull() | (F.col("t_time") > F.col("r_time")))
    first = suspect.groupBy("row_id").agg(
        F.min("r_time").alias("r_time"),
        F.min("t_time").alias("t_time"),
        F.min("t_deleted").alias("t_deleted"),
        F.bool_or("hit").alias("hit"),
        *[F.min_by(f"keep{i}", F.struct(F.col("r_time").isNull(), "r_time")).alias(c) for i, c in enumerate(keep)],
    )
    reasons = F.filter(
        F.array(
            F.when(~F.col("hit"), "missing"),
            F.when(F.col("hit") & (F.col("t_time") > F.col("r_time")), "late"),
            F.when(F.col("hit") & (F.col("t_deleted") <= F.col("r_time")), "deleted"),
        ),
        lambda x: x.isNotNull(),
    )
    return first.select("row_id", F.explode(reasons).alias("reason"), *[F.col(f"`{c}`") for c in keep])


def _one_per_key(t: DataFrame, cols: list[str], on: list[str]) -> DataFrame:
    """One row per value of ``on``. Deliveries of one record come first, then several records."""
    whole = t.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in on])).groupBy(*cols).agg(F.min("t_time").alias("t_time"), F.min("t_deleted").alias("t_deleted"))
    if len(on) < len(cols):
        whole = whole.groupBy(*on).agg(
            F.min("t_time").alias("t_time"),
            F.when(F.count("t_deleted") == F.count(F.lit(1)), F.max("t_deleted")).alias("t_deleted"),
        )
    return whole.select(*on, "t_time", "t_deleted", F.lit(True).alias("hit"))


def _shaped(df: DataFrame, kept: int) -> DataFrame:
    return df.select("row_id", "r_time", "t_time", "t_deleted", "hit", *[f"keep{i}" for i in range(kept)])


def project_orphans(code_map: DataFrame, features: DataFrame, modules: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The orphans of the project's four references: table_name, field_name, row_id, reason, created_at."""

    def of(table: str, field: str, found: DataFrame) -> DataFrame:
        return found.select(F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), "row_id", "reason", "created_at")

    keep = ["created_at"]
    parts = [
        of("code_map", "feature", find_orphans(code_map, features, ["feature"], ["id"], keep=keep)),
        of("features", "module", find_orphans(features, modules, ["module"], ["id"], keep=keep)),
    ]
    for end in ("src", "dest"):
        parts.append(of("graph_edge", end, find_orphans(edges, vertices, ["repo", end], ["repo", "id"], keep=keep, required=[end])))
    return reduce(DataFrame.unionByName, parts)


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, month of created_at (null month where it is unknown) and reason."""
    return found.groupBy("table_name", "field_name", F.date_format("created_at", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("n"))
