"""Tables that loops write on their way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all run on one machine, a folder of our own; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomfact-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Table:
    """Rows that only grow: each part is a folder of its own, written once; a lost executor costs no more than its tasks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.paths, self.schema = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", [], None

    def add(self, part: DataFrame) -> DataFrame:
        """Writes a part, and gives it as a scan."""
        self.schema = self.schema or part.schema
        path = f"{self.base}/{len(self.paths):06d}"
        part.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df with its lineage cut: written, and read back."""
    return Table(df.sparkSession, name).add(df)
