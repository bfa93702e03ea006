"""Degrees: fuzzy membership and similarity, as Column expressions."""

from __future__ import annotations

from functools import reduce

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Membership that is left where a profile has faded.
FADED = 0.01
#: Standard deviations between the peak and the place where a profile has faded.
SPREAD = math.sqrt(-2 * math.log(FADED))


def degree(value: Column) -> Column:
    """The value as a degree; raises outside [0, 1]."""
    x = value.cast("double")
    return F.when(x.isNull() | ((x >= 0) & (x <= 1)), x).otherwise(F.raise_error(F.lit("a degree lies in [0, 1]")).cast("double"))


def membership(value: Column, peak: Column, fades_in: Column, fades_out: Column) -> Column:
    """Asymmetric Gaussian: 1 at the peak, FADED at either boundary.

    A side without width borrows the other's; without either, only the peak belongs.
    Raises unless fades_in <= peak <= fades_out.
    """
    value, peak, low, high = (c.cast("double") for c in (value, peak, fades_in, fades_out))
    left, right = (peak - low) / SPREAD, (high - peak) / SPREAD
    side = F.when(value <= peak, F.when(left > 0, left).otherwise(right)).otherwise(F.when(right > 0, right).otherwise(left))
    bell = F.exp(-0.5 * F.pow((value - peak) / F.nullif(side, F.lit(0.0)), F.lit(2.0)))
    inside = F.when(side > 0, bell).otherwise(F.when(value == peak, 1.0).otherwise(0.0))
    return F.when((low <= peak) & (peak <= high), inside).when(low.isNull() | peak.isNull() | high.isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.lit("a profile needs fades_in <= peak <= fades_out")).cast("double"))


def similar_numbers(a: Column, b: Column) -> Column:
    return 1 / (1 + F.abs(a.cast("double") - b.cast("double")))


def similar_degrees(a: Column, b: Column) -> Column:
    return 1 - F.abs(a.cast("double") - b.cast("double"))


def similar_texts(a: Column, b: Column) -> Column:
    """Share of a's pieces that b has too, of the longer one's pieces; not symmetric.  Pieces are the words between spaces."""
    left, right = (F.filter(F.split(c, " "), lambda x: x != "") for c in (a, b))
    most = F.greatest(F.size(left), F.size(right))
    return F.when(most == 0, 1.0).otherwise(F.size(F.filter(left, lambda x: F.array_contains(right, x))) / most)


def similar_arrays(a: Column, b: Column, each=similar_numbers) -> Column:
    """Similarities place by place, over the length of the longer one."""
    most, least = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), each)
    return F.when(most == 0, 1.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / most)


def similar_maps(pairs: list[tuple[Column, Column, object]], n_left: int | None = None, n_right: int | None = None) -> Column:
    """Similarities of shared fields, given as (left, right, how), over the number of fields of the larger map."""
    total = reduce(lambda s, x: s + x, (how(a, b) for a, b, how in pairs), F.lit(0.0))
    return total / max(n_left or len(pairs), n_right or len(pairs), 1)


def similar_facts(left_type: Column, right_type: Column, pairs: list[tuple[Column, Column, object]], n_left: int | None = None, n_right: int | None = None) -> Column:
    """A quarter for the type, three quarters for the fields."""
    return 0.25 * left_type.eqNullSafe(right_type).cast("double") + 0.75 * similar_maps(pairs, n_left, n_right)


def same(a: Column, b: Column) -> Column:
    """1 where two values are equal, nulls included."""
    return a.eqNullSafe(b).cast("double")
