"""Temporal facts: lineages by id, their current rows, timelines and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import stored


def rank(df: DataFrame, effective_at: str, priority: str, id_col: str) -> DataFrame:
    """df with its rank by time down, priority down, id up; a missing or non-finite field raises.

    A global rank needs one order over all rows.  The rows are dealt to ranges by time,
    counted there, and each range starts where those before it end, so no task holds all.
    """
    good = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    checked = df.withColumn("_ok", F.when(good(effective_at) & good(priority), True).otherwise(F.raise_error(F.lit("time and priority must be there")).cast("boolean")))
    order = [F.desc(effective_at), F.desc(priority), F.asc(id_col)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored, so that counting and ranking see the same ranges
    ranged = stored(checked.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("rank", (F.col("_inside") + F.col("_before")).cast("bigint")).drop("_ok", "_part", "_n", "_before", "_inside")


def current(df: DataFrame, lineage: str, effective_at: str, sequence: str, now: Column, provenance: str | None = None) -> DataFrame:
    """The latest row of each lineage that is in effect; rows without a time go by their sequence, before all timed ones.

    Predicted rows (by ``provenance``) are no facts yet: they never are current.  A maximum
    by key: it is combined before the shuffle, so a long lineage costs no more than its last
    row of each task.
    """
    live = df.where(F.col(effective_at).isNull() | (F.col(effective_at) <= now))
    if provenance:
        live = live.where(F.coalesce(F.col(provenance), F.lit("")) != "predicted")
    key = F.struct(F.col(effective_at).isNotNull().alias("timed"), F.col(effective_at).alias("at"), F.col(sequence).alias("seq"), F.struct(*df.columns).alias("row"))
    return live.groupBy(F.col(lineage).alias("_l")).agg(F.max(key).alias("k")).select("k.row.*")


def scheduled(df: DataFrame, effective_at: str, now: Column) -> DataFrame:
    """Rows that will be in effect later."""
    return df.where(F.col(effective_at) > now)


def timeline(df: DataFrame, lineage: str, effective_at: str, sequence: str) -> DataFrame:
    """df with version, valid_from, valid_to and the order within each lineage.

    Rows are dealt to ranges by (lineage, time, sequence), so a long lineage is spread over
    several; each range goes on where the one before it ends.
    """
    spark = df.sparkSession
    order = [F.asc(lineage), F.asc(effective_at), F.asc(sequence)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part", lineage).orderBy(effective_at, sequence)
    # a row for each range and lineage that goes on in it: a lineage in one range only is left out
    ends = ranged.groupBy("_part").agg(F.min(F.struct(lineage)).alias("lo"), F.max(F.struct(lineage)).alias("hi"))
    shared = ends.select(F.explode(F.array("lo", "hi")).alias("k")).select(f"k.{lineage}").groupBy(lineage).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(F.col(lineage).alias("_l"))
    pieces = ranged.join(shared, ranged[lineage].eqNullSafe(shared["_l"]), "left_semi").groupBy("_part", F.col(lineage).alias("_l")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col(effective_at).isNotNull().alias("timed"), F.col(effective_at).alias("at"))).alias("_first"))
    along = Window.partitionBy("_l").orderBy("_part")
    pieces = pieces.select(F.col("_part").alias("_p"), "_l", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first.at").over(along).alias("_next"))
    numbered = ranged.withColumns({"_v": F.row_number().over(inside), "_to": F.lead(effective_at).over(inside), "_last": F.lead(F.lit(True)).over(inside).isNull()})
    joined = numbered.join(pieces, (numbered._part == pieces._p) & numbered[lineage].eqNullSafe(pieces._l), "left")
    return joined.withColumns({"version": (F.col("_v") + F.coalesce("_before", F.lit(0))).cast("int"), "valid_from": F.col(effective_at), "valid_to": F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_to"))}).select(*df.columns, "version", "valid_from", "valid_to")
