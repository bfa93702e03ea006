"""Token counts as delta-maintained rollups.

A batch of signed events (inserts, deletes, and revised counts as a delete and an insert)
is summed to one row per (source, lang, tokenizer), written beside the ledger, and moved
into it under the batch's id in one rename that fails where the id is taken: a batch
counts once however often it is sent, and a writer that dies half way leaves nothing.
Totals are the sums of all batches; ``compact`` folds the batches so far into a
snapshot, which names them, so that late readers see every batch once.

Tokenizer versions are vocabularies: ``count_tokens`` encodes whole texts with each of them.

Defined results: null text counts as empty; null source, language and tokenizer are keys
of their own; null counts and signs count as nothing; groups whose documents and tokens
both come to zero have no row; empty batches are committed too; a batch that is committed
while a snapshot is made is in the totals once, whichever of the two is read.  The names
of batches (not their rows) are listed on the driver.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import frugal, spread, steps, whole

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def count_tokens(docs: DataFrame, tokenizers: dict[str, tuple[str, Column | None]], source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """source, lang and, for each tokenizer (a vocabulary's path, and a condition on the rows that it counts, or None for all), how many ids it makes of the text; null where it doesn't count."""
    paths = [path for path, _ in tokenizers.values()]

    @frugal
    def run(batches):
        for batch in batches:
            text = batch.column(2).cast(pa.large_string())
            for a, b in steps(np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])):
                texts, counts = text.slice(a, b - a).to_pylist(), []
                for k, path in enumerate(paths):
                    asked = np.flatnonzero(batch.column(3 + k).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool))
                    n = np.full(b - a, -1, np.int64)
                    if len(asked):
                        n[asked] = encoder(path).encode([texts[i] for i in asked.tolist()])[1]
                    counts.append(pa.array(n, mask=n < 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *counts], ["source", "lang", *(f"n{k}" for k in range(len(paths)))])

    asked = [F.lit(True) if on is None else F.coalesce(on, F.lit(False)) for _, on in tokenizers.values()]
    rows = spread(docs).select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), whole(F.col(text_col)).alias("text"), *[x.alias(f"on{k}") for k, x in enumerate(asked)])
    found = rows.mapInArrow(run, "source string, lang string, " + ", ".join(f"n{k} bigint" for k in range(len(paths))))
    return found.toDF("source", "lang", *tokenizers)


def events(rows: DataFrame, tokenizer: str, n_tokens: Column, sign: int) -> DataFrame:
    """Signed events for rows with source and lang: +1 inserts, -1 deletes."""
    return rows.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("bigint").alias("sign"), n_tokens.cast("bigint").alias("n_tokens"))


def revised(rows: DataFrame, old: tuple[str, Column], new: tuple[str, Column]) -> DataFrame:
    """Counts that change: the old count leaves, the new one comes."""
    return events(rows, *old, -1).unionByName(events(rows, *new, +1))


class Rollup:
    """Totals kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.at = jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(self.path).getFileSystem(self.conf)
        self.files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        self.plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        for sub in ("batches", "snapshots", "staging"):
            self.fs.mkdirs(self.at(f"{self.path}/{sub}"))

    def _names(self, sub: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(f"{self.path}/{sub}")))

    def _publish(self, rows: DataFrame, place: str) -> bool:
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        try:
            self.files.rename(self.at(staged), self.at(f"{self.path}/{place}"), self.plain)
            return True
        except Exception:
            if not self.fs.exists(self.at(f"{self.path}/{place}")):
                raise
            self.fs.delete(self.at(staged), True)
            return False

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Adds a batch of events; False, and no change, if that id was committed before."""
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError("a batch id has letters, digits, '_', '.' and '-' only")
        if self.fs.exists(self.at(f"{self.path}/batches/{batch_id}")):
            return False
        sign = F.coalesce("sign", F.lit(0))
        sums = batch.groupBy(*KEYS).agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))
        return self._publish(sums, f"batches/{batch_id}")

    def _parts(self) -> tuple[list[str], list[str]]:
        """Folders whose sums are the totals, and the batches in them."""
        shots = self._names("snapshots")
        base, done = [], set()
        if shots:
            base = [f"{self.path}/snapshots/{shots[-1]}/totals"]
            done = {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{shots[-1]}/batches").collect()}
        batches = self._names("batches")
        return base + [f"{self.path}/batches/{b}" for b in batches if b not in done], batches

    def _sums(self, parts: list[str]) -> DataFrame:
        read = self.spark.read.schema(DELTA).parquet(*parts) if parts else self.spark.createDataFrame([], DELTA)
        sums = read.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        return self._sums(self._parts()[0])

    def compact(self) -> bool:
        """Folds what is there into a snapshot; False if another writer was faster."""
        number = len(self._names("snapshots"))
        parts, batches = self._parts()
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        self._sums(parts).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").write.parquet(f"{staged}/batches")
        place = self.at(f"{self.path}/snapshots/{number:09d}")
        try:
            self.files.rename(self.at(staged), place, self.plain)
            return True
        except Exception:
            if not self.fs.exists(place):
                raise
            self.fs.delete(self.at(staged), True)
            return False
