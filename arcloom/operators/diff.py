"""Line diffs with full context, and code put together from its members."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def unified(old: str | None, new: str | None, name: str) -> str:
    """A unified diff with all lines as context; equal texts give one hunk without changes."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    if a == b:
        body = [f"@@ -1,{len(a)} +1,{len(b)} @@", *(" " + x for x in a)]
        return "\n".join([f"--- {name}", f"+++ {name}", *body])
    return "\n".join(x.rstrip("\n") for x in difflib.unified_diff(a, b, name, name, n=max(len(a), len(b)), lineterm=""))


@F.pandas_udf(StringType())
def unified_diff(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for old, new, name in batches:
        yield pd.Series([unified(a, b, n) for a, b, n in zip(old, new, name)])


def apply_diff(text: str) -> str:
    """The new side of a full-context diff."""
    rows = [x for x in text.split("\n") if not x.startswith(("---", "+++", "@@"))]
    return "\n".join(x[1:] for x in rows if x[:1] in (" ", "+"))


def new_side(diff: Column) -> Column:
    """The text a full-context diff leads to: its lines after the three of the head, those taken out left out."""
    lines = F.split(diff, "\n")
    kept = F.filter(F.slice(lines, F.lit(4), F.greatest(F.size(lines) - 3, F.lit(0))), lambda x: x.startswith(" ") | x.startswith("+"))
    return F.array_join(F.transform(kept, lambda x: F.substring(x, 2, 2147483647)), "\n")


def differs(old: Column, new: Column) -> Column:
    return ~F.coalesce(old, F.lit("")).eqNullSafe(F.coalesce(new, F.lit("")))


def assembled(members: DataFrame, key: list[str], pos: str, code: str, out: str = "code", keep: Column | None = None) -> DataFrame:
    """One text a class from its members in order; members that ``keep`` rejects are left out, a class without any is empty."""
    kept = F.when(keep if keep is not None else F.lit(True), F.struct(F.col(pos).alias("p"), F.col(code).alias("c")))
    return members.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["c"]), "\n").alias(out))


def deletable(cluster_ids: Column, selected: Column, keep_unsliced: bool = False) -> Column:
    """Whether a member goes with the selected slices: all its slices are selected (a member without any goes, too, unless kept)."""
    ids = F.coalesce(cluster_ids, F.array().cast("array<int>"))
    gone = F.size(F.array_except(ids, selected)) == 0
    return gone & (F.size(ids) > 0) if keep_unsliced else gone


def rewritten(package: Column, imports: Column, body: Column) -> Column:
    """Source of a class from its package, import lines and body."""
    return F.concat_ws("\n\n", F.when(package.isNotNull() & (package != ""), F.concat(F.lit("package "), package, F.lit(";"))), F.when(F.size(imports) > 0, F.array_join(imports, "\n")), body)
