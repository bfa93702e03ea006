"""N-ary structural set algebra over DataFrames of one schema.

Plain forms take whole rows as elements (null equals null); the "by" forms take keys.
Rows that lack a key field are no elements; a non-empty set whose rows all lack one
raises when it is evaluated.  Results have no duplicates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sets).distinct()


def intersection(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b.select(a.columns)), sets).distinct()


def difference(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.subtract(b.select(a.columns)), others, first.distinct())


def symmetric_difference(*sets: DataFrame) -> DataFrame:
    """Elements of some, but not of all, of the sets."""
    return _by(sets, sets[0].columns, lambda n: F.col("_n") < n, null_keys=True)


def _keyed(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with all key fields; raises where there are rows, but none of these."""
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by))
    check = df.agg(F.when((F.count(F.lit(1)) > 0) & (F.count(F.when(whole, 1)) == 0), F.raise_error(F.lit(f"no element has all of {', '.join(by)}")).cast("boolean")).otherwise(True).alias("_comparable"))
    # the check has no row to add, but is evaluated even where none is left
    none = check.where("not _comparable").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.where(whole).unionByName(none)


def _by(sets, by: list[str], wanted, null_keys: bool = False) -> DataFrame:
    """Rows of all sets whose key is in a wanted number of them."""
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    kept = sets if null_keys else [_keyed(s, by) for s in sets]
    counted = reduce(lambda a, b: a.unionByName(b), [s.select(*keys).distinct() for s in kept]).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    chosen = counted.where(wanted(len(sets))).select(*names)
    rows = reduce(lambda a, b: a.unionByName(b), kept).distinct()
    return rows.join(chosen, [rows[c].eqNullSafe(chosen[n]) for c, n in zip(by, names)], "left_semi")


def intersection_by(by: list[str], *sets: DataFrame) -> DataFrame:
    """Of every set, the rows whose key is in all sets."""
    return _by(sets, by, lambda n: F.col("_n") == n)


def symmetric_difference_by(by: list[str], *sets: DataFrame) -> DataFrame:
    return _by(sets, by, lambda n: F.col("_n") < n)


def difference_by(by: list[str], first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of the first set whose key is in none of the others."""
    keys = reduce(lambda a, b: a.unionByName(b), [_keyed(s, by).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]) for s in others]).distinct()
    rows = _keyed(first, by).distinct()
    return rows.join(keys, [rows[c].eqNullSafe(keys[f"_k{i}"]) for i, c in enumerate(by)], "left_anti")


def relations(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row: equals, subset, superset, disjoint."""
    if by:
        left, right = _keyed(left, by), _keyed(right, by)
    by = by or left.columns
    names = [f"_k{i}" for i in range(len(by))]
    side = lambda df, n: df.select(*[F.col(c).alias(k) for c, k in zip(by, names)], F.lit(n).alias("_side"))
    where = side(left, 1).unionByName(side(right, 2)).groupBy(*names).agg(F.min("_side").alias("low"), F.max("_side").alias("high"))
    counts = where.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, c in (("only_left", F.col("high") == 1), ("only_right", F.col("low") == 2), ("common", (F.col("low") == 1) & (F.col("high") == 2)))])
    return counts.select(((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equals"), (F.col("only_left") == 0).alias("subset"), (F.col("only_right") == 0).alias("superset"), (F.col("common") == 0).alias("disjoint"))


def cardinality(df: DataFrame) -> DataFrame:
    return df.distinct().agg(F.count(F.lit(1)).alias("cardinality"))


def contains(df: DataFrame, **values) -> DataFrame:
    """One row: whether some element has these values."""
    hit: Column = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()))
    return df.agg(F.coalesce(F.max(hit), F.lit(False)).alias("contains"))


def group_properties(table: DataFrame) -> DataFrame:
    """One row of checks on a Cayley table (left, right, result): closed, associative, identity, inverse, commutative, group, abelian.

    The members are all left and right values; a missing product counts as a failure.
    Associativity looks products up for n**3 triples, as its definition has it, by
    joins on the table's keys.
    """
    t = table.select("left", "right", "result").distinct()
    members = t.select(F.col("left").alias("m")).union(t.select("right")).distinct()
    n = members.agg(F.count(F.lit(1)).alias("n"))
    member = members.select(F.col("m").alias("x"))
    products = t.join(member, t.result == member.x, "left_semi").select("left", "right").distinct().agg(F.count(F.lit(1)).alias("products"))
    ab, abc = t.select(F.col("left").alias("a"), F.col("right").alias("b"), F.col("result").alias("ab")), t.select(F.col("left").alias("ab"), F.col("right").alias("c"), F.col("result").alias("ab_c"))
    bc, a_bc = t.select(F.col("left").alias("b"), F.col("right").alias("c"), F.col("result").alias("bc")), t.select(F.col("left").alias("a"), F.col("right").alias("bc"), F.col("result").alias("a_bc"))
    agree = ab.join(abc, "ab").join(bc, ["b", "c"]).join(a_bc, ["a", "bc"]).where("ab_c = a_bc").agg(F.count(F.lit(1)).alias("agree"))
    neutral = t.select(F.col("left").alias("e"), F.col("right").alias("x"), "result").where("x = result").select("e", "x").join(t.select(F.col("right").alias("e"), F.col("left").alias("x"), "result").where("x = result").select("e", "x"), ["e", "x"])
    neutral = neutral.groupBy("e").agg(F.count(F.lit(1)).alias("k")).join(n, F.col("k") == F.col("n")).select("e")
    identity = neutral.agg(F.count(F.lit(1)).alias("identities"))
    to_e = t.join(neutral, t.result == neutral.e).select("left", "right", "e")
    back = to_e.select(F.col("right").alias("left"), F.col("left").alias("right"), "e")
    inverse = to_e.join(back, ["left", "right", "e"], "left_semi").select("left").distinct().agg(F.count(F.lit(1)).alias("inverses"))
    mirror = t.select(F.col("right").alias("left"), F.col("left").alias("right"), "result")
    commute = t.join(mirror, ["left", "right", "result"], "left_semi").agg(F.count(F.lit(1)).alias("commutes"))
    row = n
    for part in (products, agree, identity, inverse, commute):  # one row each
        row = row.crossJoin(part)
    checks = row.select((F.col("products") == F.col("n") * F.col("n")).alias("closed"), (F.col("agree") == F.col("n") * F.col("n") * F.col("n")).alias("associative"), (F.col("identities") > 0).alias("identity"), ((F.col("inverses") == F.col("n")) & (F.col("identities") > 0)).alias("inverse"), (F.col("commutes") == F.col("n") * F.col("n")).alias("commutative"))
    is_group = F.col("closed") & F.col("associative") & F.col("identity") & F.col("inverse")
    return checks.select("*", is_group.alias("group"), (is_group & F.col("commutative")).alias("abelian"))
