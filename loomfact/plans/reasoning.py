"""Four-valued truth and graded evidence.

Evidence weighs degree times reliability; support and opposition are kept apart, each the
maximum of its weights, and a profile's conjunction is the minimum, its disjunction the
maximum and its negation one minus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.degrees import degree


def prove(asked: DataFrame, key: list[str], positive: DataFrame, negative: DataFrame) -> DataFrame:
    """asked with truth: proved, disproved, both or unknown, by whether its key is in the predicate and in its contrary."""
    out = asked
    for name, table in (("_p", positive), ("_n", negative)):
        known = table.select(*[F.col(c).alias(f"{name}{i}") for i, c in enumerate(key)], F.lit(True).alias(name)).distinct()
        out = out.join(known, [out[c].eqNullSafe(known[f"{name}{i}"]) for i, c in enumerate(key)], "left").drop(*[f"{name}{i}" for i in range(len(key))])
    p, n = F.coalesce("_p", F.lit(False)), F.coalesce("_n", F.lit(False))
    return out.withColumn("truth", F.when(p & n, "both").when(p, "proved").when(n, "disproved").otherwise("unknown")).drop("_p", "_n")


def grade(evidence: DataFrame, key: list[str]) -> DataFrame:
    """Support and opposition by key; evidence has degree, reliability and polarity (support or oppose)."""
    weight = degree(F.col("degree")) * degree(F.col("reliability"))
    side = lambda name: F.coalesce(F.max(F.when(F.col("polarity") == name, weight)), F.lit(0.0)).alias(name)
    return evidence.groupBy(*key).agg(side("support"), side("oppose"), F.count(F.lit(1)).alias("n"))


#: The one combination of each kind that is defined.
PROFILE = {"conjunction": "minimum", "disjunction": "maximum", "evidence_aggregation": "maximum", "negation": "one_minus"}


def decide(asked: DataFrame, key: list[str], positive: DataFrame, negative: DataFrame, evidence: DataFrame, profile: dict[str, str] | None = None, probability: float | Column | None = None, similarity: float | Column | None = None) -> DataFrame:
    """Truth and grades together, and the degree that survives opposition: the minimum of support and one minus oppose.

    Probability and similarity are degrees of their own: they stand beside, and change
    nothing.  A profile (a name apart) must say how grades combine, as PROFILE does.
    """
    told = {k: v for k, v in (profile or PROFILE).items() if k != "name"}
    if told != PROFILE:
        raise ValueError(f"no such profile: {told}")
    graded = grade(evidence, key).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(key)], "support", "oppose")
    proved = prove(asked, key, positive, negative)
    out = proved.join(graded, [proved[c].eqNullSafe(graded[f"_g{i}"]) for i, c in enumerate(key)], "left").drop(*[f"_g{i}" for i in range(len(key))])
    out = out.withColumns({"support": F.coalesce("support", F.lit(0.0)), "oppose": F.coalesce("oppose", F.lit(0.0))})
    aside = {n: degree(v if isinstance(v, Column) else F.lit(v)) for n, v in (("probability", probability), ("similarity", similarity)) if v is not None}
    return out.withColumns({"degree": F.least("support", 1 - F.col("oppose")), **aside})


def satisfied(asked: DataFrame, key: list[str], *required: DataFrame) -> DataFrame:
    """Rows of asked whose key is in every required table."""
    for table in required:
        known = table.select(*[F.col(c).alias(f"_d{i}") for i, c in enumerate(key)])
        asked = asked.join(known, [asked[c].eqNullSafe(known[f"_d{i}"]) for i, c in enumerate(key)], "left_semi")
    return asked
