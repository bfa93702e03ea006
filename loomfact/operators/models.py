"""Small models that can be read: a decision stump, k-means, one-feature regression, next values."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StructType

from ..store import stored
from .stats import _finite


@dataclass
class Stump:
    """At most threshold goes left, more goes right, a missing feature to the majority."""

    feature: str | None
    threshold: float | None
    left: str | None
    right: str | None
    majority: str | None
    confidence: float
    target: str = ""
    gini: float = field(default=0.0)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.feature is None:
            return df.withColumn(out, F.lit(self.majority))
        x = _finite(F.col(self.feature))
        return df.withColumn(out, F.when(x <= self.threshold, F.lit(self.left)).when(x > self.threshold, F.lit(self.right)).otherwise(F.lit(self.majority)))


def _majority(counts: dict[str, int]) -> str | None:
    return min(counts, key=lambda k: (-counts[k], k)) if counts else None


#: Distinct labels of a target at most: each becomes a column of the counts.
LABELS = 1_000


def train_stump(df: DataFrame, target: str, features: list[str]) -> Stump:
    """The split with the least Gini impurity: thresholds lie half way between neighbouring values; the earlier feature and the lower threshold win ties.

    Counts go by (feature, value, label) before anything is ordered.  Distinct values are
    dealt to ranges by feature and value and stored; each range's running sums start from
    the sums of the ranges before it, so no task holds a whole feature.
    """
    spark = df.sparkSession
    y = F.col(target).cast("string")
    total = {r["y"]: r["n"] for r in df.where(y.isNotNull()).groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n")).limit(LABELS + 1).collect()}
    if len(total) > LABELS:
        raise ValueError(f"{target} has more than {LABELS} labels")
    if not total:
        return Stump(None, None, None, None, None, 0.0, target)
    majority, labels = _majority(total), sorted(total)
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), _finite(F.col(c)).alias("x")) for i, c in enumerate(features)]))
    counts = df.where(y.isNotNull()).select(y.alias("y"), cells).where("x is not null").groupBy("f", "x").agg(*[F.sum(F.when(F.col("y") == k, 1).otherwise(0)).alias(f"n{i}") for i, k in enumerate(labels)])
    ranged = stored(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "f", "x").withColumn("part", F.spark_partition_id()), "values")
    every = range(len(labels))
    # one row for each range and feature in it
    sums = ranged.groupBy("f", "part").agg(F.min("x").alias("first"), *[F.sum(f"n{i}").alias(f"s{i}") for i in every])
    along = Window.partitionBy("f").orderBy("part")
    before = sums.select("f", "part", F.lead("first").over(along).alias("after"), *[F.coalesce(F.sum(f"s{i}").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"b{i}") for i in every], *[F.sum(f"s{i}").over(Window.partitionBy("f")).alias(f"t{i}") for i in every])
    inside = Window.partitionBy("f", "part").orderBy("x")
    joined = ranged.select("*", F.lead("x").over(inside).alias("next"), *[F.sum(f"n{i}").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(f"r{i}") for i in every]).join(before, ["f", "part"])
    split = joined.select("f", "x", F.coalesce("next", "after").alias("next"), *[(F.col(f"r{i}") + F.col(f"b{i}")).alias(f"l{i}") for i in every], *[f"t{i}" for i in every]).where("next is not null")
    total_of = lambda p: sum((F.col(f"{p}{i}") for i in range(1, len(labels))), F.col(f"{p}0"))
    gini = lambda parts, n: 1 - sum((F.pow(x / n, F.lit(2.0)) for x in parts), F.lit(0.0))
    n_left, n_all = total_of("l"), total_of("t")
    left, right = [F.col(f"l{i}") for i in every], [F.col(f"t{i}") - F.col(f"l{i}") for i in every]
    impurity = (n_left * gini(left, n_left) + (n_all - n_left) * gini(right, n_all - n_left)) / n_all
    best = split.select(F.round(impurity, 12).alias("g"), "f", ((F.col("x") + F.col("next")) / 2).alias("cut"), F.array(*left).alias("left"), F.array(*right).alias("right")).orderBy("g", "f", "cut").limit(1).collect()
    if not best:
        return Stump(None, None, None, None, majority, total[majority] / sum(total.values()), target)
    b = best[0]
    return Stump(features[b["f"]], b["cut"], _majority(dict(zip(labels, b["left"]))), _majority(dict(zip(labels, b["right"]))), majority, 1 - b["g"], target, b["g"])


@dataclass
class Line:
    """A regression line of one feature; its confidence is r2."""

    feature: str
    slope: float
    intercept: float
    confidence: float
    target: str = ""

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Null where the feature is missing or not a number."""
        return df.withColumn(out, self.intercept + self.slope * _finite(F.col(self.feature)))


def apply_model(model: Stump | Line, df: DataFrame) -> DataFrame:
    """df with prediction, confidence and the route that led there."""
    out = model.predict(df)
    if isinstance(model, Line):
        route = F.lit("linear_regression")
    elif model.feature is None:
        route = F.lit("model_prediction_field")
    else:
        x = _finite(F.col(model.feature))
        route = F.when(x <= model.threshold, "numeric_split_left").when(x > model.threshold, "numeric_split_right").otherwise("model_prediction_field")
    return out.withColumns({"confidence": F.lit(model.confidence), "route": route})


def predict_fact(facts: DataFrame, inputs: DataFrame, target: str, features: list[str]) -> DataFrame:
    """inputs with the prediction of a stump that is trained on facts."""
    return apply_model(train_stump(facts, target, features), inputs)


def train_line(df: DataFrame, target: str, feature: str) -> Line:
    row = linear_regression(df, target, feature).first()
    return Line(feature, row["slope"], row["intercept"], row["r2"], target)


def predict_numeric_fact(facts: DataFrame, inputs: DataFrame, target: str, feature: str) -> DataFrame:
    """inputs with the prediction of a regression line through facts."""
    return apply_model(train_line(facts, target, feature), inputs)


_KINDS = {"decision_tree": Stump, "linear_regression": Line}


def save_model(spark: SparkSession, model: Stump | Line, path: str) -> None:
    """Writes the model's numbers and labels as one line of JSON."""
    kind = next(k for k, c in _KINDS.items() if type(model) is c)
    text = json.dumps({"model_type": kind, **asdict(model)})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Stump | Line:
    found = json.loads(spark.read.text(path).first()["value"])
    return _KINDS[found.pop("model_type")](**found)


def evaluate(model: Stump, df: DataFrame, text_labels: bool = True) -> DataFrame:
    """n and accuracy over rows with a label; numeric targets never equal a predicted label, which is text."""
    y = F.col(model.target).cast("string") if text_labels else F.lit(None).cast("string")
    return model.predict(df.where(F.col(model.target).isNotNull()), "_p").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("_p") == y, F.lit(False)).cast("double")).alias("accuracy"))


def linear_regression(df: DataFrame, target: str, feature: str) -> DataFrame:
    """One row: n, slope, intercept, r2 (1 without variance of the target); raises without variance of the feature."""
    x, y = _finite(F.col(feature)), _finite(F.col(target))
    sums = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("cov"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.col("cov") / F.when(F.col("vx") > 0, F.col("vx")).otherwise(F.raise_error(F.lit("the feature has no variance")).cast("double"))
    r2 = F.when(F.col("vy") == 0, 1.0).otherwise(F.least(F.greatest(slope * F.col("cov") / F.when(F.col("vy") > 0, F.col("vy")), F.lit(0.0)), F.lit(1.0)))
    return sums.select("n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), r2.alias("r2"))


def k_means(df: DataFrame, features: list[str], clusters: int, order: str, rounds: int = 12) -> tuple[list[list[float]], DataFrame]:
    """Centroids in the features' own units, and the rows with cluster and distance (standardised).

    Rows that lack a finite feature belong to no cluster.  Features are scaled by mean and standard deviation of the population; the first rows by
    ``order`` start the clusters; ties go to the lower number, an empty cluster stays put.
    Rounds are sums by cluster over all rows; only clusters * features numbers come back.
    """
    xs = [_finite(F.col(c)) for c in features]
    rows = df.where(sum((x.isNull().cast("int") for x in xs), F.lit(0)) == 0)
    stat = rows.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(xs) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if stat["m0"] is None:
        return [], rows.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("double")})
    mean, sd = [stat[f"m{i}"] for i in range(len(xs))], [stat[f"s{i}"] if stat[f"s{i}"] > 1e-12 else 1.0 for i in range(len(xs))]
    z = [(x - m) / s for x, m, s in zip(xs, mean, sd)]
    centres = [list(r) for r in rows.orderBy(order).limit(clusters).select(*[c.alias(f"z{i}") for i, c in enumerate(z)]).collect()]

    def assigned(frame: DataFrame) -> DataFrame:
        squares = [sum(((c - F.lit(v)) * (c - F.lit(v)) for c, v in zip(z, centre)), F.lit(0.0)) for centre in centres]
        low = F.array_min(F.array(*squares))
        return frame.withColumns({"cluster": (F.array_position(F.array(*squares), low) - 1).cast("int"), "distance": F.sqrt(low)})

    for _ in range(rounds):
        moved = {r["cluster"]: [r[f"z{i}"] for i in range(len(z))] for r in assigned(rows).groupBy("cluster").agg(*[F.avg(c).alias(f"z{i}") for i, c in enumerate(z)]).collect()}
        after = [moved.get(k, c) for k, c in enumerate(centres)]
        if after == centres:
            break
        centres = after
    return [[v * s + m for v, s, m in zip(c, sd, mean)] for c in centres], assigned(rows)


def _method(t) -> tuple[str, float]:
    """How values of a type go on, but for numbers: method and confidence."""
    return ("recursive_nested_prediction", 0.65) if isinstance(t, StructType) else ("last_collection_value", 0.50) if isinstance(t, ArrayType) else ("unsupported", 0.0) if isinstance(t, BooleanType) else ("last_value", 0.60)


def predict_next(df: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """A row for each field, and one (field null) for all: predicted value (as text), method, confidence; from the rows in their order.

    Numbers go on by the step between the last two rows (0.75; 0.55 for a single row, which
    is repeated); a null is a value like any other: if the last one is null, null is
    repeated, if the one before is, the last number is.  Other values are repeated; the
    confidence of all is the mean of the fields'.
    """
    last = df.orderBy(F.desc(order)).limit(2).select(F.struct(order, *[F.col(c).alias(f"v{i}") for i, c in enumerate(fields)]).alias("r"))
    both = last.agg(F.count(F.lit(1)).alias("n"), F.max_by("r", "r." + order).alias("a"), F.min_by("r", "r." + order).alias("b")).where("n > 0")
    rows = []
    for i, c in enumerate(fields):
        t, x, y = df.schema[c].dataType, F.col("a")[f"v{i}"], F.col("b")[f"v{i}"]
        text = x.cast("string") if not isinstance(t, StructType | ArrayType) else F.to_json(x)
        if isinstance(t, NumericType):
            there, several = x.isNotNull(), F.col("n") > 1
            text = F.when(there & several & y.isNotNull(), (2 * x.cast("double") - y.cast("double")).cast("string")).otherwise(x.cast("double").cast("string"))
            method = F.when(~there, "last_value").when(several, "linear_trend").otherwise("last_numeric_value")
            sure = F.when(~there, 0.60).when(several, 0.75).otherwise(0.55)
        else:
            name, value = _method(t)
            method, sure = F.when(x.isNull(), "last_value").otherwise(name), F.when(x.isNull(), 0.60).otherwise(value)
            text = text if name != "unsupported" else F.lit(None).cast("string")
        rows.append(F.struct(F.lit(c).alias("field"), text.alias("predicted"), method.alias("method"), sure.alias("confidence")))
    mean = sum((r["confidence"] for r in rows[1:]), rows[0]["confidence"]) / len(rows)
    rows.append(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("predicted"), F.lit("field_wise_sequence_prediction").alias("method"), mean.alias("confidence")))
    return both.select(F.inline(F.array(*rows)))


def vector_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
