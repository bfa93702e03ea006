"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _lowest(edges: DataFrame, key: str, other: str) -> DataFrame:
    """The lowest neighbour of each key, stored so that the join that follows may split a hot key."""
    return stored(edges.groupBy(F.col(key).alias("k")).agg(F.min(other).alias("low")), "lowest")


def _star(edges: DataFrame) -> DataFrame:
    """Every edge (a, b), b < a, turned by one large and one small star."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both, "a", "b")
    joined = both.join(low, both.a == low.k).where("b > a")
    large = stored(joined.select(F.col("b").alias("a"), F.least("low", "a").alias("b")).distinct(), "large")
    forget(low)
    low = _lowest(large, "a", "b")
    joined = large.join(low, large.a == low.k)
    pairs = F.when(F.col("b") == F.col("low"), F.struct(F.col("a").alias("a"), F.col("low").alias("b"))).otherwise(F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
    extra = F.struct(F.col("a").alias("a"), F.col("low").alias("b"))
    small = joined.select(F.explode(F.when(F.col("b") == F.col("low"), F.array(pairs)).otherwise(F.array(pairs, extra))).alias("e")).select("e.a", "e.b").distinct()
    out = stored(small, "small")
    forget(low)
    forget(large)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (a, b), with root < node; roots themselves have no row.

    The list must be without loops and may be empty.  Each round halves the depth of the
    forest at least; the rounds end when every edge leads from a node to its root.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    measure = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))]
    seen = now.agg(*measure).first()
    while seen[0]:
        after = _star(now)
        forget(now)
        now, was, seen = after, seen, after.agg(*measure).first()
        if was == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
