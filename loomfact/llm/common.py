"""Pieces that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import cache, wraps
from inspect import signature

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of the six ASCII white-space bytes, as a Java (and RE2) pattern.
SPACES = r"[\x20\x09-\x0D]+"
#: Stands for a null id while ids travel as plain 64-bit numbers.
NO_ID = -(1 << 63)
#: UTF-8 bytes of text that one vectorised step holds at most, single longer texts aside.
STEP_BYTES = 2 << 20
#: Rows that Spark hands to a Python worker at a time; its default of 10,000 long texts would not fit beside their arrays.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Keys, of some 40 bytes each, that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where it is unset and all run on one machine, one of our own."""
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


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _libc(name: str, *args: int) -> None:
    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except (AttributeError, OSError):  # not the GNU C library
        pass


@cache
def _thrift() -> None:
    """In a Python worker, which lives as long as its executor: freed arrays go back to the system, not to a store of the allocator's.

    Fixed values: M_TRIM_THRESHOLD (-1), M_MMAP_THRESHOLD (-3) and M_ARENA_MAX (-8).
    """
    for option, value in ((-1, 8 << 20), (-3, 4 << 20), (-8, 2)):
        _libc("mallopt", option, value)
    pa.set_memory_pool(pa.system_memory_pool())


def trimmed(run):
    """A function of a group, in a Python worker, that gives its memory back: idle workers of an executor keep theirs else."""

    def over(*groups):
        _thrift()
        try:
            return run(*groups)
        finally:
            _libc("malloc_trim", 0)

    # Spark asks how many arguments there are
    return (lambda one: over(one)) if len(signature(run).parameters) == 1 else (lambda one, other: over(one, other))


def frugal(run):
    """The same for a generator of batches."""

    @wraps(run)
    def wrapped(batches):
        _thrift()
        try:
            yield from run(batches)
        finally:
            _libc("malloc_trim", 0)

    return wrapped


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def spread(df: DataFrame) -> DataFrame:
    """Texts on their way to Python workers.

    Where the session has no size of Arrow batches of its own, batches become smaller for
    it.  Rows are dealt out anew where a small file would leave most cores idle; larger
    inputs, and what comes from a shuffle, keep their own splits.
    """
    spark = df.sparkSession
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # to count its splits would run it
        return df
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def without(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_anti") -> DataFrame:
    """rows joined with a table of keys, which is broadcast if it is small; texts then stay where they are."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys.hint("merge"), on, how)


def steps(sizes: np.ndarray, most: int = STEP_BYTES):
    """(from, to) row ranges of at most ``most`` bytes each; a longer single row has its own range."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Tokens:
    """Words of several texts, as byte ranges of one buffer.

    ``lo``/``hi`` are a word's byte range, ``doc`` the row it belongs to and
    ``first`` the index of each row's first word (one more entry at the end).
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = b"\n".join([*texts, b""])
        self.raw = np.frombuffer(self.data, np.uint8)
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])
        blank = _SPACE[self.raw]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1 if len(blank) else np.zeros(0, np.int64)
        if len(blank) and not blank[0]:
            edge = np.concatenate([[0], edge])
        self.lo, self.hi = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.lo, self.at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word: a sum over its bytes in an odd-based ring, then mixed with its length."""
        return ring(self.raw, self.lo, self.hi, lower)


def ring(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes in each range."""
    n = len(raw)
    if not n:
        return mix(np.zeros(len(lo), np.uint64))
    grown, back = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLD if lower else _BYTE)[raw] * grown[:n], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20, 5 * len(_POWERS[0]) // 4)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            made = np.full(size, base, np.uint64)
            made[0] = 1
            _POWERS[k] = np.cumprod(made)
    return _POWERS[0], _POWERS[1]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
