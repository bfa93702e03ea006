"""Lists as facts: rows of (list, pos, label, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get(items: DataFrame, name: str, pos: int | None = None, label: str | None = None) -> DataFrame:
    """Values of a list at a position, or under a label."""
    if (pos is None) == (label is None):
        raise ValueError("a position or a label")
    own = items.where(F.col("list") == name)
    return (own.where(F.col("pos") == pos) if label is None else own.where(F.col("label") == label)).select("value")


def first(items: DataFrame, name: str) -> DataFrame:
    return get(items, name, 0)


def pop(items: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(value, label) of the first item, and all items without it; those that follow move up."""
    own, head = F.col("list").eqNullSafe(F.lit(name)), F.col("pos") == 0
    rest = items.where(~(own & head)).withColumn("pos", F.when(own, F.col("pos") - 1).otherwise(F.col("pos")))
    return items.where(own & head).select("value", "label"), rest
