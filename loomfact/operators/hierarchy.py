"""Type hierarchies: closures, common ancestors, paths and path-based similarities.

An edge table has (child, parent).  Closures come from a semi-naive loop whose every
round joins only what the last one found, and writes only what is new; they end on
cyclic edges too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from ..store import Table


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], whole: bool = False) -> DataFrame:
    """All rows that start and ``step(new rows)`` lead to, by key: semi-naive evaluation.

    Rows found again, by key, are dropped, so recursion ends where nothing is new.  With
    ``whole``, step gets (new rows, all rows) instead, for recursion that isn't linear.
    """
    seen = Table(start.sparkSession, "fixpoint")
    fresh = seen.add(start.dropDuplicates(key))
    while not fresh.isEmpty():
        found = (step(fresh, seen.all()) if whole else step(fresh)).select(fresh.columns).dropDuplicates(key)
        old = seen.all().select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(key)])
        fresh = seen.add(found.join(old, [found[c].eqNullSafe(old[f"_s{i}"]) for i, c in enumerate(key)], "left_anti"))
    return seen.all()


def closure(edges: DataFrame, reflexive: bool = True) -> DataFrame:
    """(descendant, ancestor, depth): the least number of edges between them."""
    e = edges.select(F.col("child"), F.col("parent")).where("child is not null and parent is not null").distinct()
    start = e.where("child <> parent").select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    step = lambda new: new.join(e, new.ancestor == e.child).where("descendant <> parent").select("descendant", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
    found = fixpoint(start, step, ["descendant", "ancestor"])
    if not reflexive:
        return found
    nodes = e.select(F.explode(F.array("child", "parent")).alias("descendant")).distinct()
    return found.unionByName(nodes.select("descendant", F.col("descendant").alias("ancestor"), F.lit(0).alias("depth")))


def edges_of(facts: DataFrame, type_col: str = "_type", parent_col: str = "_parent") -> DataFrame:
    """The edge table that facts carry: their types and those types' parents."""
    return facts.select(F.col(type_col).alias("child"), F.col(parent_col).alias("parent")).where("child is not null and parent is not null").distinct()


def has_cycle(edges: DataFrame) -> bool:
    e = edges.select("child", "parent").distinct()
    step = lambda new: new.join(e, new.ancestor == e.child).select("descendant", F.col("parent").alias("ancestor"))
    return not fixpoint(e.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor")), step, ["descendant", "ancestor"]).where("descendant = ancestor").isEmpty()


def descendants(spark: SparkSession, parents: dict[str, list[str]], root: str) -> list[str]:
    """Types assignable to root, from a catalog of type names."""
    found, grown = {root}, True
    while grown:
        more = {t for t, up in parents.items() if found & set(up)} - found
        found, grown = found | more, bool(more)
    return sorted(found)


def _two(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """Common ancestors of each pair (l, r), with both depths."""
    left = closed.select(F.col("descendant").alias("l"), "ancestor", F.col("depth").alias("dl"))
    right = closed.select(F.col("descendant").alias("r"), "ancestor", F.col("depth").alias("dr"))
    return pairs.select("l", "r").distinct().join(left, "l").join(right, ["r", "ancestor"]).select("l", "r", "ancestor", "dl", "dr")


def common_ancestors(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    return _two(pairs, closed).select("l", "r", "ancestor")


def _extreme(pairs: DataFrame, closed: DataFrame, lowest: bool) -> DataFrame:
    common = common_ancestors(pairs, closed)
    strict = closed.where("descendant <> ancestor").select("descendant", F.col("ancestor").alias("above"))
    # an ancestor that another common one lies below (above) isn't lowest (highest)
    beaten = common.withColumnRenamed("ancestor", "descendant").join(strict, "descendant")
    beaten = beaten.select("l", "r", F.col("above" if lowest else "descendant").alias("ancestor"), F.col("descendant" if lowest else "above").alias("by"))
    valid = beaten.join(common.withColumnRenamed("ancestor", "by"), ["l", "r", "by"], "left_semi")
    return common.join(valid, ["l", "r", "ancestor"], "left_anti")


def lowest_common_ancestors(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """Of each pair's common ancestors, those without a more specific one; there may be several."""
    return _extreme(pairs, closed, True)


def highest_common_ancestors(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    return _extreme(pairs, closed, False)


def ancestor_analysis(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """(l, r, ancestor, distance, lowest, highest): every common ancestor of each pair, and which of them are extreme."""
    common = _two(pairs, closed).select("l", "r", "ancestor", (F.col("dl") + F.col("dr")).alias("distance"))
    for name, found in (("lowest", lowest_common_ancestors(pairs, closed)), ("highest", highest_common_ancestors(pairs, closed))):
        common = common.join(found.withColumn(name, F.lit(True)), ["l", "r", "ancestor"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return common


def is_ancestor(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """(ancestor, descendant) pairs with whether it holds; a type is its own ancestor."""
    known = closed.select("ancestor", "descendant", F.lit(True).alias("_hit"))
    same = F.col("ancestor") == F.col("descendant")
    return pairs.join(known, ["ancestor", "descendant"], "left").select("ancestor", "descendant", (F.coalesce("_hit", F.lit(False)) | same).alias("holds"))


def direct_relation(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    known = edges.select("parent", "child").distinct().withColumn("_hit", F.lit(True))
    return pairs.join(known, ["parent", "child"], "left").select("parent", "child", F.coalesce("_hit", F.lit(False)).alias("holds"))


def proof_paths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """For each child in start (column child): one shortest path, child to ancestor, to each of its ancestors, however far."""
    e = edges.select(F.col("child").alias("_c"), F.col("parent").alias("_p")).distinct()
    first = start.select(F.col("child"), F.col("child").alias("ancestor"), F.array("child").alias("path"))
    step = lambda new: new.join(e, new.ancestor == e._c).groupBy("child", F.col("_p").alias("ancestor")).agg(F.min(F.concat("path", F.array("_p"))).alias("path"))
    return fixpoint(first, step, ["child", "ancestor"])


def similarities(pairs: DataFrame, closed: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """Distance, path and Wu-Palmer similarity of each pair, by its nearest common ancestor; with frequencies (type, information_content) Resnik and Lin too, as they are and within [0, 1].

    A node's size, in Wu-Palmer's formula, is the number of its ancestors, itself included.
    The common ancestor is the one nearest to the left type, by name among equals.
    """
    nearest = _two(pairs, closed).groupBy("l", "r").agg(F.min(F.struct("dl", "ancestor", "dr")).alias("b")).select("l", "r", F.col("b.ancestor").alias("lca"), (F.col("b.dl") + F.col("b.dr")).alias("distance"))
    size = closed.groupBy(F.col("descendant").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    out = nearest
    for side, name in (("l", "nl"), ("r", "nr"), ("lca", "na")):
        out = out.join(size.select(F.col("t").alias(side), F.col("n").alias(name)), side)
    out = out.select("l", "r", "lca", "distance", (1 / (F.col("distance") + 1)).alias("path_similarity"), (2 * F.col("na") / (F.col("nl") + F.col("nr"))).alias("wu_palmer"))
    if frequency is None:
        return out
    for side, name in (("l", "il"), ("r", "ir"), ("lca", "ia")):
        out = out.join(frequency.select(F.col("type").alias(side), F.col("information_content").alias(name)), side, "left")
    lin = F.when(F.col("il") + F.col("ir") > 0, 2 * F.col("ia") / F.when(F.col("il") + F.col("ir") > 0, F.col("il") + F.col("ir"))).otherwise(F.when(F.col("l") == F.col("r"), 1.0).otherwise(0.0))
    clamped = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return out.select("l", "r", "lca", "distance", "path_similarity", "wu_palmer", F.col("ia").alias("resnik"), clamped(F.col("ia")).alias("resnik_score"), lin.alias("lin"), clamped(lin).alias("lin_score"))


def shortest_path(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(l, r, ancestor, distance, path, edge_types) of each pair, by way of the common ancestor nearest to the left type (the first by name among equals); pairs without one have distance null.

    The path goes up from the left type (edge type parent) and down to the right one (child).
    """
    asked = pairs.select("l", "r").distinct()
    ways = proof_paths(edges, asked.select(F.explode(F.array("l", "r")).alias("child")).distinct())
    left = ways.select(F.col("child").alias("l"), "ancestor", F.col("path").alias("up"))
    right = ways.select(F.col("child").alias("r"), "ancestor", F.col("path").alias("other"))
    best = asked.join(left, "l").join(right, ["r", "ancestor"]).groupBy("l", "r").agg(F.min(F.struct(F.size("up").alias("n"), "ancestor", "up", "other")).alias("b"))
    down = F.reverse(F.slice("b.other", 1, F.size("b.other") - 1))
    kinds = F.concat(F.array_repeat(F.lit("parent"), F.size("b.up") - 1), F.array_repeat(F.lit("child"), F.size("b.other") - 1))
    found = best.select("l", "r", "b.ancestor", (F.size("b.up") + F.size("b.other") - 2).alias("distance"), F.concat("b.up", down).alias("path"), kinds.alias("edge_types"))
    return asked.join(found, ["l", "r"], "left")


def common_field(a: Column, b: Column, ta, tb) -> Column | None:
    """What two fields have in common: an equal value stays, unequal numbers become a range, records go field by field, anything else goes."""
    if isinstance(ta, StructType) and isinstance(tb, StructType):
        inner = [(f.name, common_field(a[f.name], b[f.name], f.dataType, tb[f.name].dataType)) for f in ta if f.name in tb.names]
        inner = [c.alias(n) for n, c in inner if c is not None]
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(*inner)) if inner else None
    if isinstance(ta, NumericType) and isinstance(tb, NumericType):
        same = a.eqNullSafe(b)
        spread = F.when(~same & a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("min"), F.greatest(a, b).alias("max")))
        return F.struct(F.when(same, a).alias("value"), spread.alias("range"))
    return F.when(a.eqNullSafe(b), a) if ta == tb else None


def generalised(left: DataFrame, right: DataFrame, on: list[str], fields: list[str], ancestors: DataFrame | None = None) -> DataFrame:
    """What both facts of a joined pair have in common; a number is (value, range), one of which is null.

    ``ancestors`` (l, r, ancestor) names the type of the generalised fact of two facts with
    columns _type: the declared one, CommonFact where there is none.
    """
    l, r = left.alias("l"), right.alias("r")
    joined = l.join(r, on)
    kept = [(c, common_field(F.col(f"l.{c}"), F.col(f"r.{c}"), left.schema[c].dataType, right.schema[c].dataType)) for c in fields]
    out = joined.select(*[F.col(c) for c in on], *([F.col("l._type").alias("_tl"), F.col("r._type").alias("_tr")] if ancestors is not None else []), *[c.alias(n) for n, c in kept if c is not None and n not in on])
    if ancestors is None:
        return out
    named = ancestors.groupBy(F.col("l").alias("_tl"), F.col("r").alias("_tr")).agg(F.min("ancestor").alias("_type"))
    return out.join(named, ["_tl", "_tr"], "left").withColumn("_type", F.coalesce("_type", F.lit("CommonFact"))).drop("_tl", "_tr")


def propagate(parent: dict, changes: list[str], child: DataFrame) -> DataFrame:
    """Copies of the child facts with the parent's changed fields."""
    return child.withColumns({c: F.lit(parent[c]) for c in changes})


def relation_properties(pairs: DataFrame) -> DataFrame:
    """One row on a relation (left, right): nodes, pairs, reflexive, symmetric, asymmetric, transitive."""
    p = pairs.select("left", "right").distinct()
    nodes = p.select(F.explode(F.array("left", "right")).alias("node")).distinct()
    mirror = p.select(F.col("right").alias("left"), F.col("left").alias("right"))
    loops = p.where("left = right").agg(F.count(F.lit(1)).alias("loops"))
    mutual = p.join(mirror, ["left", "right"], "left_semi").agg(F.count(F.lit(1)).alias("mutual"))
    second = p.select(F.col("left").alias("right"), F.col("right").alias("third"))
    missing = p.join(second, "right").select("left", F.col("third").alias("right")).distinct().join(p, ["left", "right"], "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    row = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(p.agg(F.count(F.lit(1)).alias("pairs"))).crossJoin(loops).crossJoin(mutual).crossJoin(missing)
    return row.select("nodes", "pairs", (F.col("loops") == F.col("nodes")).alias("reflexive"), (F.col("mutual") == F.col("pairs")).alias("symmetric"), (F.col("mutual") == 0).alias("asymmetric"), (F.col("missing") == 0).alias("transitive"))
