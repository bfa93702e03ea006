"""Fact comparison: a score, its parts and the differences, over static schemas.

Fields are compared one with one; nested records recurse, arrays go place by place.  The
comparison of two schemas is unrolled into one Column expression, so a pair of facts is
scored within generated code.  Fields that have no namesake are aligned by name and kind
(mode semantic, the default) or not at all (exact).  Options of lexical comparison,
collections and missing fields are accepted and change nothing.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, NumericType, StructType

from ..functions.scalars import edit_similarity, normalised
from ..store import stored
from .hierarchy import generalised

#: Weights of (structure, fields, values) of records, (structure, values) of arrays and of scalars.
RECORD, LIST, SCALAR = (0.15, 0.10, 0.75), (0.45, 0.55), (0.25, 0.75)
#: Least name similarity of aligned fields, and how much of a renamed field's score is its name.
NAME_LEAST, RENAMED = 0.35, 0.2
#: Similarity of names that differ in case and marks only; weights of name and equal kind.
NAME_ALIKE, KIND_OF_NAME = 0.95, (0.75, 0.25)
#: Comparison algorithms.
ALGORITHMS = ("exact_recursive", "structural", "semantic_recursive", "semantic_pattern", "relationship_aware")


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def kind(t: DataType) -> str:
    return "number" if isinstance(t, NumericType) else "boolean" if isinstance(t, BooleanType) else "array" if isinstance(t, ArrayType) else "object" if isinstance(t, StructType) else "string"


def scalar_similarity(a: Column, b: Column, ta: DataType, tb: DataType) -> Column:
    if kind(ta) != kind(tb):
        return F.when(a.isNull() & b.isNull(), 1.0).otherwise(0.0)
    if kind(ta) == "number":
        x, y = a.cast("double"), b.cast("double")
        inner = F.greatest(F.lit(0.0), 1 - F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-9)))
    elif kind(ta) == "string":
        x, y = a.cast("string"), b.cast("string")
        inner = F.when(x == y, 1.0).when(normalised(x) == normalised(y), 0.95).otherwise(0.65 * edit_similarity(x, y))
    else:
        inner = (a == b).cast("double")
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(inner)


def _plain_name(s: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())


def name_similarity(a: str, b: str) -> float:
    """1 for equal names, 0.95 for names that differ in case and marks only, else their edit similarity."""
    if a == b:
        return 1.0
    x, y = _plain_name(a), _plain_name(b)
    if x == y:
        return NAME_ALIKE
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, last = [i], row
        for j, d in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return 1 - row[-1] / max(len(x), len(y))


def _candidate(a: str, b: str, same_kind: bool) -> float:
    """How well two differently named fields fit each other."""
    name = name_similarity(a, b)
    return KIND_OF_NAME[0] * name + KIND_OF_NAME[1] if same_kind else name


def align(left: StructType, right: StructType, mode: str = "semantic") -> list[tuple[str, str, float]]:
    """(left field, right field, name similarity) of the fields that are compared, in order of the left names.

    A field without a namesake takes the best right field that no earlier one has taken,
    the first by name among equals, if that fits well enough.
    """
    used: set[str] = set()
    out = []
    for f in sorted(left, key=lambda f: f.name):
        if f.name in right.names:
            out.append((f.name, f.name, 1.0))
            used.add(f.name)
        elif mode == "semantic":
            fits = sorted((-_candidate(f.name, g.name, kind(f.dataType) == kind(g.dataType)), g.name) for g in right if g.name not in used)
            if fits and -fits[0][0] >= NAME_LEAST:
                out.append((f.name, fits[0][1], name_similarity(f.name, fits[0][1])))
                used.add(fits[0][1])
    return out


def _below(name: str, differences: Column) -> Column:
    return F.transform(differences, lambda d: F.concat(F.lit(f"{name}."), d))


class Comparison:
    """Columns of one comparison: structure, fields, values, score, differences."""

    def __init__(self, structure: Column, fields: Column, values: Column, score: Column, differences: Column):
        self.structure, self.fields, self.values, self.score, self.differences = structure, fields, values, score, differences


def compare(a: Column, b: Column, ta: DataType, tb: DataType, mode: str = "semantic") -> Comparison:
    none = F.array().cast("array<string>")
    if isinstance(ta, StructType) and isinstance(tb, StructType):
        pairs = align(ta, tb, mode)
        size = max(len(ta), len(tb))
        cover = len(pairs) / size if size else 1.0
        scores, diffs = [], []
        for x, y, name in pairs:
            inner = compare(a[x], b[y], ta[x].dataType, tb[y].dataType, mode)
            scores.append(inner.score if x == y else inner.score * (1 - RENAMED) + name * RENAMED)
            diffs.append(_below(x, inner.differences))
        gone = [F.lit(f"removed:{f.name}") for f in sorted(ta, key=lambda f: f.name) if f.name not in {p[0] for p in pairs}]
        come = [F.lit(f"added:{f.name}") for f in sorted(tb, key=lambda f: f.name) if f.name not in {p[1] for p in pairs} and f.name not in ta.names]
        values = _sum(scores) / len(scores) if scores else F.lit(1.0 if not size else 0.0)
        listed = F.concat(F.array(*gone, *come).cast("array<string>"), *diffs)
        missing = a.isNull() | b.isNull()  # a record on one side only is a scalar's nil
        both = a.isNull() & b.isNull()
        pick = lambda there, nil, one: F.when(both, nil).when(missing, one).otherwise(there)
        score = pick((RECORD[0] + RECORD[1]) * cover + RECORD[2] * values, F.lit(1.0), F.lit(0.0))
        return Comparison(pick(F.lit(cover), F.lit(1.0), F.lit(0.0)), pick(F.lit(cover), F.lit(1.0), F.lit(0.0)), pick(values, F.lit(1.0), F.lit(0.0)), score, pick(listed, none, F.array(F.lit("changed_value"))))
    if isinstance(ta, ArrayType) and isinstance(tb, ArrayType):
        n, m = F.size(a), F.size(b)
        most, least = F.greatest(n, m), F.least(n, m)
        structure = F.when(most == 0, 1.0).otherwise(least / F.when(most > 0, most))
        each = F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: compare(x, y, ta.elementType, tb.elementType, mode).score)
        values = F.when(least == 0, structure).otherwise(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.when(least > 0, least))
        diffs = F.when(n == m, none).otherwise(F.array(F.lit("collection_size")))
        return Comparison(structure, structure, values, LIST[0] * structure + LIST[1] * values, diffs)
    same = F.lit(float(kind(ta) == kind(tb))) if kind(ta) != kind(tb) else F.when(a.isNull() == b.isNull(), 1.0).otherwise(0.0)
    values = scalar_similarity(a, b, ta, tb)
    score = SCALAR[0] * same + SCALAR[1] * values
    return Comparison(same, same, values, score, F.when(score < 1, F.array(F.lit("changed_value"))).otherwise(none))


def scored(a: Column, b: Column, ta: DataType, tb: DataType, algorithm: str = "semantic_recursive", mode: str = "semantic") -> tuple[Column, Comparison]:
    """The score that an algorithm gives, and the comparison behind it.

    exact_recursive is 1 for equal facts, else 0, by exact names; structural counts fields
    only; the other algorithms agree.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no comparison algorithm {algorithm}")
    if mode not in ("exact", "semantic"):
        raise ValueError(f"no alignment {mode}")
    c = compare(a, b, ta, tb, "exact" if algorithm == "exact_recursive" else mode)
    if algorithm == "structural":
        return c.structure, c
    if algorithm == "exact_recursive":
        return F.when((c.score >= 1 - 1e-12) & (F.size(c.differences) == 0), 1.0).otherwise(0.0), c
    return c.score, c


def compare_pairs(df: DataFrame, left: str, right: str, algorithm: str = "semantic_recursive", mode: str = "semantic", threshold: float = 0.8) -> DataFrame:
    """df with similarity, its parts structure, fields and values, difference, differences and matched, for two struct columns."""
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold lies in [0, 1]")
    score, c = scored(F.col(left), F.col(right), df.schema[left].dataType, df.schema[right].dataType, algorithm, mode)
    return df.withColumns({"similarity": score, "structure": c.structure, "fields": c.fields, "values": c.values, "difference": 1 - score, "differences": c.differences, "matched": score >= threshold})


def check_difference(df: DataFrame, left: str, right: str) -> DataFrame:
    return compare_pairs(df, left, right).drop("similarity", "matched", "structure", "fields", "values")


def are_similar(a: Column, b: Column, schema: DataType, algorithm: str = "semantic_recursive", threshold: float = 0.8, other: DataType | None = None) -> Column:
    """Whether two records score at least the threshold."""
    return scored(a, b, schema, other or schema, algorithm)[0] >= threshold


def near(df: DataFrame, left: str, right: str, threshold: float = 0.8) -> DataFrame:
    return compare_pairs(df, left, right, threshold=threshold).where("matched")


def match_pattern(df: DataFrame, pattern: str, fact: str, threshold: float = 0.8) -> DataFrame:
    """df with matched, similarity and failed (threshold_not_met or nothing), for a pattern and a fact; a pattern binds nothing."""
    out = compare_pairs(df, pattern, fact, threshold=threshold).drop("structure", "fields", "values", "difference", "differences")
    return out.withColumn("failed", F.when(~F.col("matched"), F.array(F.lit("threshold_not_met"))).otherwise(F.array().cast("array<string>")))


def semantic_unify(df: DataFrame, pattern: str, candidate: str, threshold: float = 0.8) -> DataFrame:
    return match_pattern(df, pattern, candidate, threshold).withColumnRenamed("matched", "unified")


def compare_properties(df: DataFrame, left: str, right: str) -> DataFrame:
    """The comparison by exact names alone; only equal records match."""
    return compare_pairs(df, left, right, mode="exact", threshold=1.0)


def property_difference(df: DataFrame, left: str, right: str) -> DataFrame:
    return compare_properties(df, left, right).select(*df.columns, "difference", "differences")


#: Views by the names that rules use.
RULES = {"Near": near, "FactSimilarity": compare_pairs, "FactDifference": check_difference, "FactPropertyComparison": compare_properties, "FactCommonAncestor": generalised}


#: Pairs that a task of a search scores at about, and that meet in one cell of inputs and candidates at most, where records spread evenly.
TASK_PAIRS, CELL_PAIRS = 1_000_000, 250_000


#: What rounding may add to a bound, and to a score beside its equals.
SLACK, LEVEL = 1e-9, 1e-12


def _dealt(left: DataFrame, right: DataFrame, on: list[str], ids: tuple[str, str] = ("_n", "_m")) -> tuple[DataFrame, DataFrame, int]:
    """Both sides (numbered by ``ids``) with a column _cell to join on besides ``on``, which holds no nulls, the right one dealt out, and to how many tasks.

    No task then meets many more pairs than others: the records of one side are parted by
    a hash, and those of the other, the one that is cheaper to repeat, go to every part.
    """
    sizes = [df.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias(n)) for df, n in ((left, "_a"), (right, "_b"))]
    met = sizes[0].join(sizes[1], on) if on else sizes[0].crossJoin(sizes[1])
    pairs, largest, n, m = (x or 0 for x in met.agg(F.sum(F.col("_a") * F.col("_b")), F.max(F.col("_a") * F.col("_b")), F.sum("_a"), F.sum("_b")).first())
    cells, tasks = max(1, ceil(largest / CELL_PAIRS)), ceil(pairs / TASK_PAIRS)
    if tasks < 2:
        return left.withColumn("_cell", F.lit(0)), right.withColumn("_cell", F.lit(0)), 1
    part = lambda df, c: df.withColumn("_cell", F.pmod(F.xxhash64(c), F.lit(cells)).cast("int"))
    copy = lambda df: df.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    left, right = (copy(left), part(right, ids[1])) if n <= m else (part(left, ids[0]), copy(right))
    return left, right.repartition(tasks, *on, "_cell"), tasks


def _met(some: DataFrame, found: DataFrame, tasks: int, on: list[str]) -> DataFrame:
    """All pairs of what ``_dealt`` gave; they are never shuffled."""
    cell = [*on, "_cell"]
    return (some.repartition(tasks, *cell) if tasks > 1 else some).join(found, cell)


def _best(by: str, of: str = "_n", then: str = "_c", up: bool = False) -> Column:
    """Places within ``of``; Spark's window group limit keeps the best of each task before anything is shuffled."""
    return F.row_number().over(Window.partitionBy(of).orderBy(F.asc(by) if up else F.desc(by), then))


def _seekable(x: Column) -> Column:
    return x.isNull() | ~(F.isnan(x) | (F.abs(x) == float("inf")))


def _lined(seekers: DataFrame, line: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seekers with _p, how many of the line come up to their number _x and group _g (nulls first) or before, and the line with _p, each one's own place.

    The order is one over all groups, cut into ranges, so that no group has to fit a task.
    """
    both = line.withColumn("_seeks", F.lit(False)).unionByName(seekers.withColumn("_seeks", F.lit(True)), allowMissingColumns=True)
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(both.repartitionByRange(parts, "_g", "_x").withColumn("_part", F.spark_partition_id()), "ranges")
    one = F.when(F.col("_seeks"), 0).otherwise(1)
    before = F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    offset = ranged.groupBy("_part").agg(F.sum(one).alias("_k")).select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    own = F.sum(one).over(Window.partitionBy("_part").orderBy("_g", "_x", "_seeks", "_c").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_own", own).join(F.broadcast(offset), "_part").withColumn("_p", F.col("_own") + F.col("_offset"))
    return placed.where("_seeks").select(*seekers.columns, "_p"), placed.where("not _seeks").select(*line.columns, "_p")


def _beside(seekers: DataFrame, line: DataFrame, count: int) -> DataFrame:
    """Seekers with those of their group that may be the ``count`` likest: _m, _c, the number _y, and whether the line may go on at that score (_last).

    These are ``count`` + 1 on either side; the lowest ids, which count where a line ends
    level at the least score; and infinite numbers, which have no place in a line.
    """
    found, placed = _lined(seekers, line.where(_seekable(F.col("_x"))))
    first, last = F.col("_p") - count, F.col("_p") + count + 1
    some = placed.select("_g", F.col("_p").alias("_at"), F.col("_x").alias("_y"), "_m", "_c")
    near = found.withColumn("_at", F.explode(F.sequence(first, last))).join(some, ["_g", "_at"]).withColumn("_last", (F.col("_at") == first) | (F.col("_at") == last))
    low = some.withColumn("_k", _best("_c", "_g", up=True)).where(F.col("_k") <= count + 1).drop("_k")
    low = low.unionByName(line.where(~_seekable(F.col("_x"))).select("_g", F.col("_x").alias("_y"), "_m", "_c"), allowMissingColumns=True)
    far = found.join(low, "_g").where(F.col("_at").isNull() | ~F.col("_at").between(first, last)).withColumn("_last", F.lit(False))
    return near.unionByName(far).drop("_at", "_p")


def nearest(inputs: DataFrame, candidates: DataFrame, input_id: str, candidate_id: str, fields: list[str], count: int, required: list[str] | None = None) -> DataFrame:
    """The ``count`` candidates most like each input: input, candidate, similarity, distance, rank, differences.

    ``required`` fields must agree, null with null; they make the search one within equal
    keys.  Without any, each input meets all candidates: a stated query set against all
    rows.  Equal records are scored once: of candidates that equal each other the ``count``
    lowest ids can be among the best, and equal inputs share what is found.

    Records fall into shapes, which agree in all fields but the number of most values.
    Shapes meet, records don't: those of one shape stand in a line by that number, and the
    likest are the ``count`` next to the input's own on either side.  Lines of the shapes
    that are likest for sure give each input a floor; the others are entered if their best
    could reach it.  What no line tells (numbers so close that scores are level, infinite
    ones) is scored pair by pair.
    """
    keys = [f"_q{k}" for k in range(len(required or []))]
    named = [F.col(c).alias(q) for c, q in zip(required or [], keys)]
    left = inputs.select(F.col(input_id).alias("_i"), F.struct(*fields).alias("_l"), *named)
    right = candidates.select(F.col(candidate_id).alias("_c"), F.struct(*fields).alias("_r"), *named)
    schema: StructType = left.schema["_l"].dataType
    # sorted by a hash first, as numbers sort faster than texts
    lowest = Window.partitionBy("_h", *keys, "_r").orderBy("_c")
    ids = right.withColumn("_h", F.xxhash64(*keys, "_r")).withColumn("_k", F.row_number().over(lowest)).where(F.col("_k") <= count)
    ids = ids.withColumn("_cs", F.collect_list(F.struct("_c")).over(lowest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("_k = 1").select(*keys, "_r", "_cs", "_c")
    equal = lambda a, b, on: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_o{k}"]) for k in on))
    other = lambda df, on: df.withColumnsRenamed({k: f"_o{k}" for k in on})
    # numbered, so that what is sorted and joined is narrow; stored, as the numbers of another run may differ
    number = F.monotonically_increasing_id
    block = other(stored(right.select(*keys).distinct().withColumn("_block", number()), "blocks"), keys) if keys else None
    placed = lambda df: df.join(block, equal(df, block, keys)).select(*df.columns, "_block") if keys else df
    kept = stored(placed(ids).withColumn("_m", number()), "candidates")
    asked = stored(placed(left.select(*keys, "_l").distinct()).withColumn("_n", number()), "inputs")
    top = _likest(asked.drop(*keys), kept.drop("_cs", *keys), schema, count, ["_block"] if keys else [])
    differences = compare(F.col("_l"), F.col("_r"), schema, schema, "exact").differences
    top = top.join(asked.drop("_block"), "_n").join(kept.select("_m", "_r", "_cs"), "_m")
    top = top.select(*keys, "_l", "similarity", differences.alias("differences"), F.explode("_cs").alias("_e"))
    top = other(top.select(*keys, "_l", "similarity", "differences", F.col("_e._c").alias("_c")), [*keys, "_l"])
    # score down, candidate up
    rank = F.row_number().over(Window.partitionBy("_i").orderBy(F.desc("similarity"), "_c"))
    out = left.join(top, equal(left, top, [*keys, "_l"])).withColumn("rank", rank).where(F.col("rank") <= count)
    return out.select(F.col("_i").alias("input"), F.col("_c").alias("candidate"), "similarity", (1 - F.col("similarity")).alias("distance"), "rank", "differences")


def _likest(asked: DataFrame, kept: DataFrame, schema: StructType, count: int, on: list[str]) -> DataFrame:
    """(_n, _m, similarity) of the ``count`` likest of distinct records kept (_m, _r, _c) to each of asked (_n, _l), both with ``on``."""
    numbers = [f.name for f in schema if kind(f.dataType) == "number"]
    if len(numbers) > 1:
        seen = kept.agg(*[F.approx_count_distinct(F.col("_r")[c]).alias(f"_{i}") for i, c in enumerate(numbers)]).first()
        numbers = [numbers[max(range(len(numbers)), key=lambda i: seen[i])]]
    swept = numbers[0] if numbers else None
    rest = [f for f in schema if f.name != swept]
    costly = [f for f in rest if kind(f.dataType) not in ("number", "boolean")]
    base, weight, most = RECORD[0] + RECORD[1], RECORD[2] / len(schema), RECORD[2] / len(schema) * bool(swept)
    part = lambda f: compare(F.col("_l")[f.name], F.col("_r")[f.name], f.dataType, f.dataType, "exact").score
    total = lambda scores: base + RECORD[2] * _sum(scores) / len(schema)
    of = lambda r: F.col(r)[swept].cast("double") if swept else F.lit(None).cast("double")
    next_to = compare(F.col("_x"), F.col("_y"), DoubleType(), DoubleType(), "exact").score if swept else F.lit(0.0)

    shape = lambda r: F.struct(F.lit(0).alias("_shape"), *[F.col(r)[f.name].alias(f.name) for f in rest]).alias("_s")
    own = kept.select(*on, shape("_r"), of("_r").alias("_x"), "_m", "_c")
    sought = asked.select(*on, shape("_l"), of("_l").alias("_x"), "_n")
    size, odd = F.count(F.when(_seekable(F.col("_x")) & F.col("_own"), 1)), F.coalesce(F.max(~_seekable(F.col("_x")) & F.col("_own")), F.lit(False))
    every = own.select(*on, "_s", "_x", F.lit(True).alias("_own")).unionByName(sought.select(*on, "_s", "_x", F.lit(False).alias("_own")))
    every = every.groupBy(*on, "_s").agg(size.alias("_size"), odd.alias("_odd"), F.max(~F.col("_own")).alias("_sought"))
    shapes = stored(every.withColumn("_g", F.monotonically_increasing_id()), "shapes")
    names = shapes.select(*[F.col(c).alias(f"_o{c}") for c in [*on, "_s"]], "_g")
    named = lambda df: df.join(names, reduce(lambda a, b: a & b, (df[c].eqNullSafe(names[f"_o{c}"]) for c in [*on, "_s"]))).drop(*on, "_s", *[f"_o{c}" for c in [*on, "_s"]])
    line = stored(named(own), "line")
    forms, found, tasks = _dealt(shapes.where("_sought").select(*on, F.col("_g").alias("_f"), F.col("_s").alias("_l")), shapes.where("_size > 0 or _odd").select(*on, "_g", F.col("_s").alias("_r"), "_size", "_odd"), on, ("_f", "_g"))

    # a floor for each input: the count-th best along the lines of shapes that hold enough, by what is sure without comparing texts
    sure = [part(f) if f not in costly else F.when(F.col("_l")[f.name].eqNullSafe(F.col("_r")[f.name]), 1.0).otherwise(0.0) for f in rest]
    home = _met(forms, found, tasks, on).where("_size > 0").select("_f", "_g", "_size", (base + _sum(sure) * weight).alias("_sure"))
    home = home.withColumn("_k", _best("_sure", "_f", "_g")).where(F.col("_k") <= count)
    before = F.sum("_size").over(Window.partitionBy("_f").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    home = stored(home.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < count)).select("_f", "_g", "_sure"), "home")
    seekers = named(sought).withColumnRenamed("_g", "_f")
    beside = stored(_beside(seekers.join(home, "_f"), line, count).withColumn("_next", next_to), "beside")
    floor = beside.select("_n", "_c", (F.col("_sure") + F.col("_next") * weight).alias("_least"))
    floor = floor.withColumn("_k", _best("_least")).where(F.col("_k") <= count).where(F.col("_k") == count).select("_n", F.col("_least").alias("_floor"))
    seekers = stored(seekers.join(floor, "_n", "left"), "floors")

    # shapes that could reach it
    reach = lambda least, bound: least.isNull() | F.col("_odd") | (bound >= least - SLACK)
    least = seekers.groupBy("_f").agg(F.when(F.count("_floor") == F.count(F.lit(1)), F.min("_floor")).alias("_least"))
    cheap = base + (_sum([part(f) for f in rest if f not in costly]) + len(costly)) * weight + most
    pairs = _met(forms.join(least, "_f"), found, tasks, on).where(reach(F.col("_least"), cheap))
    parts = {f.name: f"_s{k}" for k, f in enumerate(rest)}
    pairs = pairs.select("_f", "_g", "_odd", "_least", *[part(f).alias(parts[f.name]) for f in rest])
    bound = base + _sum([F.col(c) for c in parts.values()]) * weight + most
    pairs = stored(pairs.where(reach(F.col("_least"), bound)).drop("_least"), "pairs")
    entered = seekers.join(pairs.join(home, ["_f", "_g"], "left_anti"), "_f").where(reach(F.col("_floor"), bound))
    entered = stored(entered.select("_n", "_f", "_g", "_x"), "entered")
    beside = beside.drop("_sure")
    if not entered.isEmpty():
        beside = beside.unionByName(_beside(entered, line.join(entered.select("_g").distinct(), "_g", "left_semi"), count).withColumn("_next", next_to))
    scored_pairs = beside.join(pairs, ["_f", "_g"]).select("_n", "_m", "_c", total([F.col("_next") if f.name == swept else F.col(parts[f.name]) for f in schema]).alias("similarity"), (F.col("_last") & (F.col("_next") > SCALAR[0])).alias("_last"))
    beyond = F.max(F.when(F.col("_last"), F.col("similarity"))).over(Window.partitionBy("_n"))
    top = stored(scored_pairs.withColumn("_beyond", beyond).withColumn("_k", _best("similarity")).where(F.col("_k") <= count), "found")

    # the line may go on at the same score: those inputs meet every record
    level = top.where((F.col("_k") == count) & (F.col("_beyond") >= F.col("similarity") - LEVEL)).select("_n")
    level = level.unionByName(sought.where(~_seekable(F.col("_x"))).select("_n")).distinct()
    top = top.select("_n", "_m", "similarity")
    if level.isEmpty():
        return top
    some, found, tasks = _dealt(asked.join(level, "_n", "left_semi"), kept, on)
    pairs = _met(some, found, tasks, on).select("_n", "_m", "_c", total([part(f) for f in schema]).alias("similarity"))
    pairs = pairs.withColumn("_k", _best("similarity")).where(F.col("_k") <= count)
    return top.join(level, "_n", "left_anti").unionByName(pairs.select("_n", "_m", "similarity"))


def nearest_counts(inputs: DataFrame, candidates: DataFrame, input_id: str, count: int, required: list[str] | None = None) -> DataFrame:
    """For each input: candidates in all, those that agree in the required fields, those that don't, and how many are returned."""
    total = candidates.agg(F.count(F.lit(1)).alias("candidate_count"))
    keys = required or []
    sizes = candidates.groupBy(*[F.col(c).alias(f"_q{k}") for k, c in enumerate(keys)]).agg(F.count(F.lit(1)).alias("matched_candidate_count"))
    asked = inputs.select(F.col(input_id).alias("input"), *[F.col(c).alias(f"_p{k}") for k, c in enumerate(keys)])
    met = asked.join(sizes, [asked[f"_p{k}"].eqNullSafe(sizes[f"_q{k}"]) for k in range(len(keys))], "left") if keys else asked.crossJoin(sizes)
    n = F.coalesce("matched_candidate_count", F.lit(0))
    return met.crossJoin(total).select("input", "candidate_count", n.alias("matched_candidate_count"), (F.col("candidate_count") - n).alias("rejected_count"), F.least(n, F.lit(count)).alias("returned"))


#: What extraction takes at most unless told otherwise: depth and features of a fact.
DEPTH, FEATURES = 32, 256


def _features(c: Column, t: DataType, path: Column, field: Column, depth: int, maximum: int) -> Column:
    """Array of (path, field, kind, value, depth): a record and its fields, a collection and its members, or one leaf."""
    named = lambda c: F.when(c == "", "$").otherwise(c)
    row = lambda k, value: F.struct(named(path).alias("path"), named(field).alias("field"), k.alias("kind"), value.alias("value"), F.lit(depth).alias("depth"))
    empty = F.array().cast("array<struct<path:string,field:string,kind:string,value:string,depth:int>>")
    if depth > maximum:
        return empty
    if isinstance(t, StructType):
        under = lambda name: F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))
        own = [F.array(row(F.lit("fact"), F.lit("")))]
        parts = [_features(c[f.name], f.dataType, under(f.name), F.lit(f.name), depth + 1, maximum) for f in sorted(t, key=lambda f: f.name)]
        return F.when(c.isNull(), F.array(row(F.lit("nil"), F.lit(None).cast("string")))).otherwise(F.concat(*own, *parts) if own or parts else empty)
    if isinstance(t, ArrayType):
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        each = F.transform(c, lambda x, i: _features(x, t.elementType, at(i), at(i), depth + 1, maximum))
        return F.when(c.isNull(), F.array(row(F.lit("nil"), F.lit(None).cast("string")))).otherwise(F.concat(F.array(row(F.lit("collection"), F.size(c).cast("string"))), F.flatten(each)))
    return F.array(row(F.when(c.isNull(), "nil").otherwise(kind(t)), c.cast("string")))


def extract_semantics(df: DataFrame, id_col: str, maximum_depth: int = DEPTH, maximum_fields: int = FEATURES) -> DataFrame:
    """Records, collections and leaves of every fact, by name: id, path, field, kind, value, depth; the first ``maximum_fields`` of each."""
    if not 1 <= maximum_depth <= 512 or not 1 <= maximum_fields <= 100_000:
        raise ValueError("a depth lies in 1..512, a number of fields in 1..100000")
    fields = [c for c in df.columns if c != id_col]
    found = _features(F.struct(*fields), StructType([df.schema[c] for c in fields]), F.lit(""), F.lit(""), 0, maximum_depth)
    return df.select(F.col(id_col).alias("id"), F.inline(F.slice(found, 1, maximum_fields)))


def _leaf_paths(t: DataType, path: str = "", name: str = "") -> list[tuple[str, str, str]]:
    """(path, name, kind) of a schema's leaves; an array counts as one."""
    if isinstance(t, StructType):
        return [x for f in sorted(t, key=lambda f: f.name) for x in _leaf_paths(f.dataType, f"{path}.{f.name}".lstrip("."), f.name)]
    return [(path, name, kind(t))]


def align_fields(left: StructType, right: StructType, mode: str = "semantic") -> list[tuple[str, str, float]]:
    """(left path, right path, score) of the leaves of two schemas that belong together, in order of the left paths."""
    mine, others = (sorted(_leaf_paths(t)) for t in (left, right))
    taken: set[str] = set()
    paths = {p for p, _, _ in others}
    out = []
    for path, name, k in mine:
        if path in paths:
            out.append((path, path, 1.0))
            taken.add(path)
        elif mode == "semantic":
            fits = sorted((-_candidate(name, n, k == m), p) for p, n, m in others if p not in taken)
            if fits and -fits[0][0] >= NAME_LEAST:
                out.append((path, fits[0][1], -fits[0][0]))
                taken.add(fits[0][1])
    return out


RECORDS = "array<struct<depth:int,path:string,%s>>"


def _inner(c: Column, t: DataType, path: Column, depth: int, maximum: int, made, kinds: str) -> Column:
    """Array of what ``made(record, its schema)`` gives for every record within a value, arrays walked too."""
    empty = F.array().cast(RECORDS % kinds)
    if depth > maximum:
        return empty
    if isinstance(t, StructType):
        own = made(c, t)
        parts = [F.array(F.struct(F.lit(depth).alias("depth"), path.alias("path"), own)).cast(RECORDS % kinds)] if own is not None else []
        under = lambda name: F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))
        parts += [_inner(c[f.name], f.dataType, under(f.name), depth + 1, maximum, made, kinds) for f in sorted(t, key=lambda f: f.name) if isinstance(f.dataType, StructType | ArrayType)]
        return F.when(c.isNull(), empty).otherwise(F.concat(*parts) if parts else empty)
    if isinstance(t, ArrayType) and isinstance(t.elementType, StructType | ArrayType):
        each = F.transform(c, lambda x, i: _inner(x, t.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1, maximum, made, kinds))
        return F.when(c.isNull(), empty).otherwise(F.flatten(each))
    return empty


def contains_subfact(df: DataFrame, fact: str, candidate: str, maximum_depth: int = DEPTH) -> DataFrame:
    """df with found and the path of the first record within fact, nearest first, then by path, that equals candidate; the fact itself has path "."."""
    wanted: StructType = df.schema[candidate].dataType

    def made(c, t):
        if set(wanted.names) != set(t.names) or any(t[n].dataType != wanted[n].dataType for n in wanted.names):
            return None
        return reduce(lambda a, b: a & b, (c[n].eqNullSafe(F.col(candidate)[n]) for n in wanted.names), F.lit(True)).alias("hit")

    found = _inner(F.col(fact), df.schema[fact].dataType, F.lit(""), 0, maximum_depth, made, "hit:boolean")
    first = F.array_min(F.filter(found, lambda x: x["hit"]))["path"]
    return df.withColumns({"path": F.when(first == "", ".").otherwise(first), "found": first.isNotNull()})


def nearest_subfacts(df: DataFrame, fact: str, id_col: str, maximum_depth: int = 8, most: int = 1024) -> DataFrame:
    """Typed records (with a field _type) within a fact, at most ``most``: id, path, type, depth, nearest first, then by path."""
    if not 1 <= maximum_depth <= 64:
        raise ValueError("a depth lies in 1..64")
    found = _inner(F.col(fact), df.schema[fact].dataType, F.lit(""), 0, maximum_depth, lambda c, t: c["_type"].cast("string").alias("type") if "_type" in t.names else None, "type:string")
    kept = F.slice(F.array_sort(F.filter(found, lambda x: (x["depth"] > 0) & x["type"].isNotNull())), 1, most)
    return df.select(F.col(id_col).alias("id"), F.inline(kept)).select("id", "path", "type", "depth")


def compare_facts(df: DataFrame, left: str, right: str, related: Column) -> DataFrame:
    """df with similarity: three quarters for the properties, by exact names, and a quarter for a common declared ancestor (``related``); and property_similarity and differences."""
    drop = {"_type", "__type", "__parent", "name", "id"}
    sides = []
    for c in (left, right):
        names = [n for n in df.schema[c].dataType.names if n not in drop]
        sides.append(F.struct(*[F.col(f"{c}.{n}").alias(n) for n in names]))
    typed = df.withColumns({"_a": sides[0], "_b": sides[1]})
    c = compare(F.col("_a"), F.col("_b"), typed.schema["_a"].dataType, typed.schema["_b"].dataType, "exact")
    return typed.withColumns({"property_similarity": c.score, "similarity": 0.75 * c.score + 0.25 * F.coalesce(related, F.lit(False)).cast("double"), "differences": c.differences}).drop("_a", "_b")
