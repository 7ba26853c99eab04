"""Bounded samples of rows, drawn and counted in the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that count over a sample; what each sends to the driver is bounded by the table it counts into.
TASKS = 8


def drawn(rows: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` of the rows (all, if there are no more): those whose key's hash lies below n / count.

    A row's place in the sample depends on its key only, no row is sent to the driver, and the count
    reads the key column alone. The number drawn differs from ``n`` by its square root or so.
    """
    total = rows.select(key).count()
    if total <= n:
        return rows
    return rows.where(F.shiftrightunsigned(F.xxhash64(key), 1) < F.lit(int(n / total * 2**63)))


def sparse(counts: dict) -> Iterator[pd.DataFrame]:
    """(key, at, n) rows of dense counts by key; nothing without a key."""
    if counts:
        at = {k: np.flatnonzero(c) for k, c in counts.items()}
        yield pd.DataFrame({"key": list(at), "at": [a.astype(np.int32) for a in at.values()], "n": [counts[k][a] for k, a in at.items()]})


def gathered(rows: DataFrame) -> Iterator[tuple]:
    """(key, at, n) rows on the driver, as arrays."""
    got = rows.toArrow()
    for key, at, n in zip(got["key"].to_pylist(), got["at"], got["n"]):
        yield key, at.values.to_numpy(), n.values.to_numpy()
