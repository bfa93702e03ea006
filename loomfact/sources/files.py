"""Files: CSV, JSON, plain text and fact files, read and written by Spark on any store it knows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.rows import change_one, find_many
from ..store import stored


def read_csv(spark: SparkSession, path: str, fact_type: str | None = None) -> DataFrame:
    """Header and rows, every value a text; doubled quotes escape; ragged rows raise.  With a type, a leading _type column."""
    df = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST", escape='"')
    return df.select(F.lit(fact_type).alias("_type"), "*") if fact_type else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All columns but _type, quoted where needed; nulls are empty."""
    df.drop("_type").write.mode(mode).csv(path, header=True, quote='"', escape='"')


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole)


def write_text(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.write.mode(mode).text(path)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.delete(at, True)


def read_line(spark: SparkSession, path: str, number: int) -> str | None:
    """The line with a number, from 0, of one file; None beyond its end."""
    found = spark.read.text(path, wholetext=True).select(F.get(F.split("value", "\r?\n"), F.lit(number)).alias("line")).first()
    return found["line"] if found else None


# --- fact files ---------------------------------------------------------------

_SKIP = re.compile(r"(?:\s+|\#[^\n]*)*")
_HEAD = re.compile(r"([A-Z]\w*)\s*\(")
_NAME = re.compile(r"([\w-]+)\s*:")
_ATOM = re.compile(r'"((?:[^"\\]|\\.)*)"|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false)\b|(nil)\b', re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class FactError(ValueError):
    """A text that is no fact."""


class _Facts:
    """Facts of a text, one after the other: Type(name: value, ...); values nest in [ ] and { }."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> str:
        self.at = _SKIP.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def expect(self, mark: str) -> None:
        if self.skip() != mark:
            raise FactError(f"expected {mark!r} at {self.text[self.at : self.at + 20]!r}")
        self.at += 1

    def many(self, closing: str, one) -> list:
        out = []
        while self.skip() != closing:
            out.append(one())
            if self.skip() == ",":
                self.at += 1
            elif self.skip() != closing:
                raise FactError(f"expected {closing!r} at {self.text[self.at : self.at + 20]!r}")
        self.at += 1
        return out

    def field(self) -> tuple:
        self.skip()
        name = _NAME.match(self.text, self.at)
        if not name:
            raise FactError(f"expected a field at {self.text[self.at : self.at + 20]!r}")
        self.at = name.end()
        return name[1], self.value()

    def value(self):
        mark = self.skip()
        if mark in "[{" and mark:
            self.at += 1
            return self.many("]", self.value) if mark == "[" else dict(self.many("}", self.field))
        found = _ATOM.match(self.text, self.at)
        if not found:
            raise FactError(f"expected a value at {self.text[self.at : self.at + 20]!r}")
        self.at = found.end()
        text, number, flag, _ = found.groups()
        if text is not None:
            return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text, flags=re.DOTALL)
        return float(number) if number else flag == "true" if flag else None

    def facts(self) -> list[tuple[str, dict]]:
        out = []
        while self.skip():
            head = _HEAD.match(self.text, self.at)
            if not head:
                raise FactError(f"expected a fact at {self.text[self.at : self.at + 20]!r}")
            self.at = head.end()
            out.append((head[1], dict(self.many(")", self.field))))
        return out


def parse_facts(text: str) -> list[tuple[str, dict]]:
    """(type, fields) of each fact of a text."""
    return _Facts(text).facts()


def _records(batches):
    import json

    import pyarrow as pa

    for batch in batches:
        types, facts, rejects = [], [], []
        for text in batch.column(0).to_pylist():
            # a record ends where a line ends with ")": the mark itself is cut off, but for a last line
            text = (text or "").replace("\r", "")
            for whole in (text + ")", text):
                try:
                    found = parse_facts(whole)
                    break
                except FactError:
                    found = None
            for kind, fields in found or []:
                types.append(kind)
                facts.append(json.dumps(fields))
                rejects.append(None)
            if found is None:
                types.append(None)
                facts.append(None)
                rejects.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(types, pa.string()), pa.array(facts, pa.string()), pa.array(rejects, pa.string())], ["type", "fact", "reject"])


def fact_records(spark: SparkSession, path: str) -> DataFrame:
    """(type, fact as JSON, reject) of fact files; a fact may go over several lines, each ends with its line, and files are split between facts.  What can't be read is in reject."""
    return spark.read.text(path, lineSep=")\n").mapInArrow(_records, "type string, fact string, reject string")


def _schema_of(facts: DataFrame) -> str | None:
    """DDL of what JSON texts have in common; all numbers are doubles, a field of several kinds is a text."""
    found = facts.agg(F.schema_of_variant_agg(F.parse_json("fact")).alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<") or found == "OBJECT<>":
        return None
    found = re.sub(r"DECIMAL\(\d+, ?\d+\)|BIGINT|FLOAT", "DOUBLE", found)
    return re.sub(r"\bVOID\b|\bVARIANT\b", "STRING", found.replace("OBJECT<", "STRUCT<"))


def read_facts(spark: SparkSession, path: str, fact_type: str, schema: StructType | str | None = None, rejects: str = "raise") -> DataFrame:
    """Facts of one type from files.  Records that are no facts raise, or, with rejects="keep", come as rows with the text in _reject.

    The text is read once: parsed facts are stored, and the schema, if none is given, is
    what those of the type have in common.
    """
    records = stored(fact_records(spark, path), "facts")
    bad = records.where("reject is not null")
    if rejects == "raise" and (first := bad.select("reject").first()):
        raise FactError(f"no fact: {first['reject'][:80]!r}")
    own = records.where(F.col("type") == fact_type)
    schema = schema or _schema_of(own)
    if schema is None:
        return spark.createDataFrame([], "_reject string" if rejects == "keep" else "_type string")
    out = own.select(F.from_json("fact", schema).alias("f")).select("f.*")
    return out.unionByName(bad.select(F.col("reject").alias("_reject")), allowMissingColumns=True) if rejects == "keep" else out


def schema_header(models: list[str]) -> str:
    """The comment that opens a file of facts of several types."""
    if any(not m.strip() for m in models):
        raise ValueError("types have names")
    return "# models: " + " ".join(m.strip() for m in models) + "\n"


class FactStore:
    """Tables of facts in a folder: inserts, changes and saves write a new version beside the old ones.

    A version is written to a staging folder and moved in one rename that fails where its
    number is taken: readers never see half of one, a writer that dies leaves nothing, and
    of two writers one gets an error.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, fact_type: str) -> list[str]:
        fs, at = _fs(self.spark, f"{self.path}/{fact_type}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("v")) if fs.exists(at) else []

    def types(self) -> list[str]:
        fs, at = _fs(self.spark, self.path)
        return sorted(n for s in fs.listStatus(at) if (n := s.getPath().getName()) != "_staging") if fs.exists(at) else []

    def read(self, fact_type: str) -> DataFrame:
        versions = self._versions(fact_type)
        if not versions:
            raise FileNotFoundError(f"no facts of type {fact_type}")
        return self.spark.read.parquet(f"{self.path}/{fact_type}/{versions[-1]}")

    def sync(self, session) -> None:
        """Registers the facts as they are now with a session, type by type."""
        for t in self.types():
            session.register(t, self.read(t), session.parents.get(t, []))

    def write(self, fact_type: str, df: DataFrame) -> None:
        versions = self._versions(fact_type)
        number = int(versions[-1][1:]) + 1 if versions else 0
        staged = f"{self.path}/_staging/{uuid.uuid4().hex}"
        df.write.parquet(staged)
        fs, at = _fs(self.spark, staged)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{fact_type}/v{number:06d}")
        fs.mkdirs(place.getParent())
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(at, place, plain)
        except Exception:
            fs.delete(at, True)
            raise

    def insert(self, fact_type: str, rows: DataFrame, *key: str) -> dict:
        """Adds rows; a key (or, without one, a whole row) that is there already, or twice among the rows, is a DuplicateKey problem, and nothing changes."""
        on = list(key or rows.columns)
        rows = stored(rows, "rows")
        n = rows.count()
        if rows.dropDuplicates(on).count() < n:
            return {"matched": 0, "modified": 0, "inserted": 0, "deleted": 0, "problem": "DuplicateKey"}
        done = {"matched": 0, "modified": n, "inserted": n, "deleted": 0, "problem": None}
        if not self._versions(fact_type):
            self.write(fact_type, rows)
            return done
        old = self.read(fact_type)
        known = old.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)])
        if not rows.join(known, [rows[c].eqNullSafe(known[f"_k{i}"]) for i, c in enumerate(on)], "left_semi").isEmpty():
            return {"matched": 0, "modified": 0, "inserted": 0, "deleted": 0, "problem": "DuplicateKey"}
        self.write(fact_type, old.unionByName(rows, allowMissingColumns=True))
        return done

    def change(self, fact_type: str, conditions: dict, patch: dict | None) -> dict:
        """Updates the one row that matches, or, without a patch, deletes it; else a problem, and nothing changes."""
        after, report = change_one(self.read(fact_type), conditions, patch)
        if not report["problem"]:
            self.write(fact_type, after)
        return report

    def find(self, fact_type: str, conditions: dict) -> DataFrame:
        return find_many(self.read(fact_type), **conditions)

    def save(self, fact_type: str, rows: DataFrame) -> dict:
        """Makes the stored facts a multiset equal to rows; says how many were kept, inserted and deleted."""
        rows = stored(rows, "rows")
        if not self._versions(fact_type):
            self.write(fact_type, rows)
            return {"kept": 0, "inserted": rows.count(), "deleted": 0}
        old = self.read(fact_type).select(rows.columns)
        inserted, deleted = rows.exceptAll(old).count(), old.exceptAll(rows).count()
        kept = old.count() - deleted
        self.write(fact_type, rows)
        return {"kept": kept, "inserted": inserted, "deleted": deleted}
