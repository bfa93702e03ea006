"""Statistics over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import stored


def _finite(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def profile(df: DataFrame, features: list[str]) -> DataFrame:
    """A row for each feature: n, missing, low, high, mean, variance, stddev (of the population), from one pass."""
    aggs = []
    for i, f in enumerate(features):
        x = _finite(F.col(f))
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.stddev_pop(x).alias(f"s{i}")]
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), (F.col("total") - F.col(f"n{i}")).alias("missing"), F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("variance"), F.col(f"s{i}").alias("stddev")) for i, f in enumerate(features)]
    return df.agg(F.count(F.lit(1)).alias("total"), *aggs).select(F.inline(F.array(*rows)))


def correlate(df: DataFrame, left: str, right: str) -> DataFrame:
    """Pearson's correlation over complete pairs (0 without variance), and how strong it is."""
    a, b = _finite(F.col(left)), _finite(F.col(right))
    sums = df.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("a", "b").alias("cov"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    r = F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.col("cov") / F.when(F.col("sa") * F.col("sb") > 0, F.col("sa") * F.col("sb"))).otherwise(0.0)
    return sums.select("n", r.alias("correlation")).select("*", F.when(F.abs("correlation") >= 0.75, "strong").when(F.abs("correlation") >= 0.4, "moderate").otherwise("weak").alias("strength"))


def frequencies(facts: DataFrame, closure: DataFrame, type_col: str = "_type") -> DataFrame:
    """Count of each type with its descendants, and its information content.  closure: (descendant, ancestor), reflexive."""
    counted = facts.groupBy(F.col(type_col).alias("descendant")).agg(F.count(F.lit(1)).alias("own"))
    total = counted.agg(F.sum("own").alias("total"))
    sums = counted.join(closure.select("descendant", "ancestor").distinct(), "descendant").groupBy(F.col("ancestor").alias("type")).agg(F.sum("own").alias("n"))
    return sums.crossJoin(total).select("type", "n", (-F.ln(F.col("n") / F.col("total"))).alias("information_content"))


def associations(df: DataFrame, id_col: str, items: list[str], min_support: float) -> DataFrame:
    """Ordered pairs of field=value items of one fact: support (of all facts with an item), confidence, evidence_count.

    Items that alone miss the support are dropped before they pair up, which loses nothing.
    """
    unpivoted = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in items]))).alias("item")).where("item is not null").distinct()
    usable = unpivoted.agg(F.count_distinct("id").alias("usable"))
    single = unpivoted.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).crossJoin(usable).where(F.col("n_item") / F.col("usable") >= min_support)
    kept = unpivoted.join(single, "item")
    # a fact has as many items as it has fields: its pairs are made within its row
    baskets = kept.groupBy("id").agg(F.collect_list(F.struct("item", "n_item", "usable")).alias("b"))
    pairs = baskets.select(F.explode("b").alias("l"), "b").select("l", F.explode("b").alias("r")).where("l.item <> r.item")
    counted = pairs.groupBy(F.col("l.item").alias("when_item"), F.col("r.item").alias("then_item")).agg(F.count(F.lit(1)).alias("evidence_count"), F.max("l.n_item").alias("n_item"), F.max("l.usable").alias("usable"))
    return counted.select("when_item", "then_item", (F.col("evidence_count") / F.col("usable")).alias("support"), (F.col("evidence_count") / F.col("n_item")).alias("confidence"), "evidence_count").where(F.col("support") >= min_support)


def normalise(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Each value over the sum of all; the sum is one row, joined to the rest."""
    total = df.agg(F.sum(F.col(value).cast("double")).alias("_total"))
    return df.crossJoin(total).withColumn(out, F.col(value) / F.col("_total")).drop("_total")


def entropy(df: DataFrame, by: str) -> DataFrame:
    """Entropy, in nats, of a column's distribution."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return counts.crossJoin(total).agg((-F.sum(p * F.ln(p))).alias("entropy"))


def moments(df: DataFrame, left: str, right: str) -> DataFrame:
    """Mean, variance, stddev of left, and covariance with right, of the population."""
    a, b = F.col(left).cast("double"), F.col(right).cast("double")
    return df.agg(F.avg(a).alias("mean"), F.var_pop(a).alias("variance"), F.stddev_pop(a).alias("stddev"), F.covar_pop(a, b).alias("covariance"))


def population(df: DataFrame, type_col: str) -> DataFrame:
    return df.groupBy(F.col(type_col).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def weighted_choice(df: DataFrame, weight: str, seed: int | None = None) -> DataFrame:
    """One row, drawn with a chance in proportion to its weight (the largest of u ** (1/weight))."""
    u = F.rand(seed) if seed is not None else F.rand()
    return df.where(F.col(weight) > 0).orderBy((F.ln(u) / F.col(weight)).desc()).limit(1)


# --- data behind plots ----------------------------------------------------------


def histogram(df: DataFrame, value: str, bins: int = 6) -> DataFrame:
    """bin, low, high, n for every bin (1 to 24 of them); the last one is closed."""
    bins = min(24, max(1, bins))
    x = df.select(_finite(F.col(value)).alias("x")).where("x is not null")
    span = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))
    counted = x.crossJoin(span).groupBy(F.least(F.floor((F.col("x") - F.col("lo")) / width * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = span.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (F.col("lo") + width * F.col("bin") / bins).alias("low"), (F.col("lo") + width * (F.col("bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def bar(df: DataFrame, category: str, value: str) -> DataFrame:
    """Bars of (category, value) rows, as they are: rows without a finite value have none."""
    return df.select(F.col(category).cast("string").alias("category"), _finite(F.col(value)).alias("value")).where("value is not null")


def pie(df: DataFrame, category: str, value: str, order: str) -> DataFrame:
    """A slice for each row, in the rows' ``order``: share, start and end angle; only positive values have one.

    Angles are running sums over ranges of the order: each range starts where those before
    it end.
    """
    spark = df.sparkSession
    rows = df.select(F.col(category).cast("string").alias("category"), _finite(F.col(value)).alias("value"), F.col(order).alias("_o")).where("value > 0")
    ranged = stored(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_o").withColumn("_part", F.spark_partition_id()), "slices")
    sums = ranged.groupBy("_part").agg(F.sum("value").alias("_s"))
    before = sums.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_b"))  # a row for each range
    inside = F.sum("value").over(Window.partitionBy("_part").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0))
    total = ranged.agg(F.sum("value").alias("_t"))
    run = F.col("_run") + F.col("_b")
    joined = ranged.withColumn("_run", inside).join(F.broadcast(before), "_part").crossJoin(total)
    return joined.select("category", "value", (F.col("value") / F.col("_t")).alias("share"), (360 * (run - F.col("value")) / F.col("_t")).alias("start_angle"), (360 * run / F.col("_t")).alias("end_angle"))


def points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows of a scatter plot or time series: both values finite."""
    return df.select(_finite(F.col(x)).alias("x"), _finite(F.col(y)).alias("y")).where("x is not null and y is not null")


def graph(df: DataFrame, source: str, target: str, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes, with degree, and edges."""
    edges = df.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).cast("string").alias("from"), F.col(target).cast("string").alias("to"), *([F.col(label).alias("label")] if label else []))
    ends = edges.select(F.explode(F.array("from", "to")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), edges


#: Plot data by name, for facts of one exact type.
PLOTS = {"histogram": histogram, "bar": bar, "pie": pie, "points": points, "graph": graph}


def from_fact_type(session, fact_type: str, plot: str, *args, **options):
    """The data behind a plot of the facts of exactly one type."""
    return PLOTS[plot](session.snapshot(fact_type), *args, **options)
