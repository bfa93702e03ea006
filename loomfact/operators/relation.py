"""Contextual comparison of facts: what a fact knows of itself, read by the family of the other.

A pair's left fact is described by the most specific membership method of its type that
is meant for the right one's family; the right type's own, or inherited, interpretation
says what that means.  Where there is none, the members are compared with the right
fact's fields one by one.  Dispatch is by type, thus settled when the plan is made: a
CASE over the types that occur in the hierarchy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compare import compare
from .hierarchy import fixpoint

#: Fields that say which fact it is, not what it is like.
IDENTITY = {"_type", "_labels", "_id", "name", "id"}
MEMBERS = "map<string,string>"


def structural_state(left: Column, right: Column) -> Column:
    """How a fact's array of members stands to another's: exact, subset, partial, conflicting or unknown."""
    shared = F.size(F.array_intersect(left, right))
    return (F.when(left.isNull() | right.isNull(), "incomparable").when(F.size(left) == 0, "unknown")
            .when((shared == F.size(F.array_distinct(left))) & (shared == F.size(F.array_distinct(right))), "exact-member")
            .when(shared == F.size(F.array_distinct(left)), "subset-member").when(shared > 0, "partial-member").otherwise("conflicting"))


def members(fields: dict[str, Column]) -> Column:
    """Named values as a map from name to JSON; those that are null are no members."""
    if not fields:
        return F.create_map().cast(MEMBERS)
    made = F.create_map(*[x for k, c in sorted(fields.items()) for x in (F.lit(k), F.to_json(F.array(c)))])
    return F.map_filter(made, lambda _, v: v != "[null]")


def field_state(known: Column, target: Column) -> Column:
    """How members (a map) stand to a target's fields: exact-member if both have the same, subset-member if the target has more, partial-member if some agree, conflicting if none does, unknown without a common field."""
    common = F.map_filter(known, lambda k, _: F.map_contains_key(target, k))
    agree = F.size(F.map_filter(common, lambda k, v: F.element_at(target, k) == v))
    n, shared = F.size(known), F.size(common)
    return F.when(known.isNull(), "incomparable").when(shared == 0, "unknown").when((agree == n) & (n == F.size(target)), "exact-member").when(agree == n, "subset-member").when(agree > 0, "partial-member").otherwise("conflicting")


def membership(session, fact_type: str, against: str, method) -> None:
    """What a fact of a type tells to the family ``against``: a function of its struct that gives {name: Column}, or None, which makes a pair incomparable."""
    session.memberships[fact_type, against] = method


def interpretation(session, fact_type: str, method) -> None:
    """How a family reads members: a function of (members as a map, structural state, target's struct) that gives a state."""
    session.interpretations[fact_type] = method


def _membership(session, left: str, right: str):
    """The method of the most specific type at or above left, for the most specific family at or above right."""
    families = session.ancestors(right)
    for owner in session.ancestors(left):
        for family in families:
            if (owner, family) in session.memberships:
                return owner, session.memberships[owner, family]
    return None, None


def relate(session, pairs: DataFrame, left: str, right: str, left_id: str, right_id: str, dependencies: DataFrame | None = None, relationships: DataFrame | None = None, max_depth: int = 3, relationship: str | None = None) -> DataFrame:
    """pairs (l, r: ids of facts of the types left and right, or below) with state, members, evidence and shared relationships.

    ``dependencies`` has (id, satisfied): a left fact with one that isn't makes its pairs
    unresolved.  ``relationships`` has (src, dst, name): edges of that name, up to
    max_depth, are followed from both facts, and the nodes that both reach are counted.
    A null membership makes a pair incomparable.
    """
    a, b = session.scan(left), session.scan(right)
    l = a.select(F.col(left_id).alias("l"), F.struct(*a.columns).alias("_a"))
    r = b.select(F.col(right_id).alias("r"), F.struct(*b.columns).alias("_b"))
    df = pairs.select("l", "r").join(l, "l").join(r, "r")
    lt, rt = F.col("_a._type"), F.col("_b._type")
    plain = lambda side, frame: members({c: F.col(f"{side}.{c}") for c in frame.columns if c not in IDENTITY})
    target = plain("_b", b)
    known, owner = F.lit(None).cast(MEMBERS), F.lit(None).cast("string")
    ancestor, nothing = F.lit(None).cast("string"), F.lit(False)
    here = lambda kind: [t for t in session.descendants(kind) if t in session.tables]
    for x in here(left):
        for y in here(right):
            own, method = _membership(session, x, y)
            told = plain("_a", a) if method is None else method(F.col("_a"))
            is_pair = (lt == x) & (rt == y)
            if told is None:
                nothing = nothing | is_pair
                told = F.lit(None).cast(MEMBERS)
            elif isinstance(told, dict):
                told = members(told)
            known = F.when(is_pair, told).otherwise(known)
            owner = F.when(is_pair, F.lit(own)).otherwise(owner)
            shared = next((t for t in session.ancestors(x) if t in session.ancestors(y)), None)
            ancestor = F.when(is_pair, F.lit(shared)).otherwise(ancestor)
    df = df.withColumns({"_known": known, "_target": target, "membership": owner, "_ancestor": ancestor, "_none": nothing})
    structural = field_state(F.col("_known"), F.col("_target"))
    state = structural
    for y in here(right):
        reader = next((session.interpretations[t] for t in session.ancestors(y) if t in session.interpretations), None)
        if reader is not None:
            state = F.when((rt == y) & F.col("_known").isNotNull(), reader(F.col("_known"), structural, F.col("_b"))).otherwise(state)
    same = [c for c in a.columns if c not in IDENTITY], [c for c in b.columns if c not in IDENTITY]
    df = df.withColumns({"_pa": F.struct(*[F.col(f"_a.{c}").alias(c) for c in same[0]]), "_pb": F.struct(*[F.col(f"_b.{c}").alias(c) for c in same[1]])})
    alike = compare(F.col("_pa"), F.col("_pb"), df.schema["_pa"].dataType, df.schema["_pb"].dataType, "exact").score
    kin = F.col("_ancestor").isNotNull().cast("double")
    evidence = F.struct(alike.alias("propertySimilarity"), kin.alias("ancestorSimilarity"), (0.75 * alike + 0.25 * kin).alias("similarity"), F.col("_ancestor").alias("matchedAncestor"))
    df = df.withColumns({"state": F.when(F.col("_known").isNull(), "incomparable").otherwise(state), "evidence": evidence})
    if dependencies is not None:
        unmet = dependencies.where(~F.col("satisfied")).select(F.col("id").alias("l")).distinct().withColumn("_unmet", F.lit(True))
        df = df.join(unmet, "l", "left").withColumn("state", F.when(F.col("_unmet"), "unresolved").otherwise(F.col("state"))).drop("_unmet")
    out = df.select("l", "r", "state", F.col("_known").alias("members"), "membership", "evidence")
    if relationships is None:
        return out
    reached = lambda side: related(relationships, pairs.select(F.col(side).alias("start")).distinct(), max_depth, relationship).select(F.col("start").alias(side), "node")
    met = pairs.select("l", "r").distinct().join(reached("l"), "l").join(reached("r"), ["r", "node"]).groupBy("l", "r").agg(F.count(F.lit(1)).alias("shared"))
    return out.join(met, ["l", "r"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def related(edges: DataFrame, start: DataFrame, max_depth: int = 3, name: str | None = None) -> DataFrame:
    """(start, node, depth): what relationships (src, dst, name) lead to from each start, by those of one name only if it is given; other edges are pruned before anything is followed."""
    e = (edges.where(F.col("name") == name) if name else edges).select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    first = start.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    step = lambda new: new.where(F.col("depth") < max_depth).join(e, new.node == e._s).select("start", F.col("_d").alias("node"), (F.col("depth") + 1).alias("depth"))
    return fixpoint(first, step, ["start", "node"]).where("depth > 0")


def dependency(facts: DataFrame, id_col: str, *required: Column) -> DataFrame:
    """(id, satisfied): whether all that a fact depends on is there; without any requirement it is."""
    return facts.select(F.col(id_col).alias("id"), reduce(lambda x, y: x & y, (F.coalesce(c, F.lit(False)) for c in required), F.lit(True)).alias("satisfied"))
