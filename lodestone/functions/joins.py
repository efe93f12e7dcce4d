"""Joins on keys of which null is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null; the keys stand once. Without keys ``right`` has to be one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    names = {k: f"__of_{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(renamed, on, how).drop(*names.values())
