"""A session of typed facts: tables by type, a hierarchy over the types, polymorphic scans.

A type's facts are a DataFrame, or, with those of other types, the rows of one table that
a column tells apart.  A scan of a type unites it with its descendants, missing fields as
nulls; types of one table are one filter on it, and filters and projections reach every
table's own scan.  Labels are a hidden array column, attachments and logs are tables of
their own.
"""

from __future__ import annotations

import json
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import hierarchy

LABELS = "_labels"


class FactSession:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.parents: dict[str, list[str]] = {}
        self.methods: dict[tuple[str, str], object] = {}
        self.references: dict[str, list] = {}
        self.memberships: dict[tuple[str, str], object] = {}
        self.interpretations: dict[str, object] = {}
        #: Of the types that share a table: (number of the table, its column of types).
        self._shared: dict[str, int] = {}
        self._sources: list[tuple[DataFrame, str, dict[str, list[str]]]] = []
        self.log: list[tuple[int, str, str]] = []
        self._pool = ThreadPoolExecutor(8)
        self._jobs: dict[int, Future] = {}

    # types

    def register(self, fact_type: str, df: DataFrame | None = None, parents: list[str] = (), labels: list[str] = ()) -> None:
        """Adds a type, or replaces its facts; a hierarchy with a cycle, and a field that two parents define with different types, raise."""
        self.parents[fact_type] = list(parents)
        if fact_type in reduce(lambda s, p: s | set(self.ancestors(p)), parents, set()):
            del self.parents[fact_type]
            raise ValueError(f"{fact_type} would be its own ancestor")
        seen: dict[str, tuple[str, str]] = {}
        own = set(df.columns) if df is not None else set()
        for p in parents:
            for f in self.tables[p].schema if p in self.tables else ():
                if f.name not in own and seen.setdefault(f.name, (f.dataType.simpleString(), p))[0] != f.dataType.simpleString():
                    raise ValueError(f"{fact_type} inherits {f.name} from {seen[f.name][1]} and {p}, with different types")
        self._shared.pop(fact_type, None)
        if df is not None:
            marks = F.array(*[F.lit(x) for x in labels]).cast("array<string>")
            self.tables[fact_type] = df.withColumn(LABELS, F.array_union(F.col(LABELS), marks) if LABELS in df.columns else marks)
            self.log.append((len(self.log), fact_type, "register"))

    def register_types(self, df: DataFrame, column: str, types: dict[str, list[str]], labels: dict[str, list[str]] | None = None) -> None:
        """Adds types whose facts are the rows of one table; ``types`` has the parents of each value of the column."""
        for t, parents in types.items():
            self.register(t, df.where(F.col(column) == t), parents, (labels or {}).get(t, []))
            self._shared[t] = len(self._sources)
        self._sources.append((df, column, labels or {}))

    def ancestors(self, fact_type: str) -> list[str]:
        out, todo = [], [fact_type]
        while todo:
            t = todo.pop(0)
            if t not in out:
                out.append(t)
                todo += self.parents.get(t, [])
        return out

    def descendants(self, fact_type: str) -> list[str]:
        return hierarchy.descendants(self.spark, self.parents, fact_type)

    def instance_of(self, type_col: Column, fact_type: str) -> Column:
        return type_col.isin(self.descendants(fact_type))

    def edges(self) -> DataFrame:
        return self.spark.createDataFrame([(c, p) for c, ps in self.parents.items() for p in ps], "child string, parent string")

    # scans

    def snapshot(self, fact_type: str) -> DataFrame:
        """Facts whose type is exactly this."""
        if fact_type not in self.parents:
            raise KeyError(fact_type)
        if fact_type not in self.tables:
            return self.spark.createDataFrame([], "_type string")
        return self.tables[fact_type].select(F.lit(fact_type).alias("_type"), "*")

    def scan(self, fact_type: str | None = None) -> DataFrame:
        """Facts of a type and its descendants (of all types without one), each once."""
        wanted = [t for t in (self.descendants(fact_type) if fact_type else sorted(self.parents)) if t in self.tables]
        if fact_type and fact_type not in self.parents:
            raise KeyError(fact_type)
        parts = [self.snapshot(t) for t in wanted if t not in self._shared]
        parts += [self._together(k, [t for t in wanted if self._shared.get(t) == k]) for k in sorted({self._shared[t] for t in wanted if t in self._shared})]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else self.spark.createDataFrame([], "_type string")

    def _together(self, number: int, types: list[str]) -> DataFrame:
        """Facts of several types of one table, by one filter on it."""
        df, column, labels = self._sources[number]
        none = F.array().cast("array<string>")
        marks = reduce(lambda c, t: F.when(F.col(column) == t, F.array(*[F.lit(x) for x in labels[t]])).otherwise(c), [t for t in types if labels.get(t)], none)
        return df.where(F.col(column).isin(types)).select(F.col(column).alias("_type"), "*", marks.alias(LABELS))

    def closure(self) -> DataFrame:
        """(descendant, ancestor, depth) of the catalog's types, each its own ancestor."""
        rows = []
        for t in self.parents:
            depth, ring = {t: 0}, [t]
            while ring:
                ring = [p for c in ring for p in self.parents.get(c, []) if p not in depth and not depth.__setitem__(p, depth[c] + 1)]
            rows += [(t, a, d) for a, d in depth.items()]
        return self.spark.createDataFrame(rows, "descendant string, ancestor string, depth int")

    def correlated(self, facts: DataFrame, key: str, fact_type: str, field: str, order: str, prefix: str = "") -> DataFrame:
        """For each fact the first fact of a type, by ``order``, whose field equals its key (null without one): a lookup within a loop, as one join."""
        found = self.scan(fact_type).where(F.col(field).isNotNull())
        first = found.groupBy(F.col(field).alias("_on")).agg(F.min_by(F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in found.columns if c not in ("_type", LABELS)]), order).alias("_first"))
        return facts.join(first, facts[key] == first["_on"], "left").select(*facts.columns, "_first.*")

    def with_field(self, field: str) -> DataFrame:
        having = [t for t in sorted(self.tables) if field in self.tables[t].columns]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.snapshot(t) for t in having]).where(F.col(field).isNotNull())

    def find(self, fact_type: str, field: str, equals) -> DataFrame:
        return self.scan(fact_type).where(F.col(field).eqNullSafe(F.lit(equals)))

    def first(self, fact_type: str, field: str, equals, order: str) -> DataFrame:
        return self.find(fact_type, field, equals).orderBy(order).limit(1)

    def count(self, fact_type: str) -> int:
        return self.scan(fact_type).count()

    def exists(self, fact_type: str, field: str, equals) -> bool:
        return not self.find(fact_type, field, equals).isEmpty()

    def types(self) -> DataFrame:
        return self.spark.createDataFrame([(t, ",".join(p)) for t, p in sorted(self.parents.items())], "type string, parents string")

    def fields(self, fact_type: str) -> list[str]:
        return [c for c in self.scan(fact_type).columns if c not in ("_type", LABELS)]

    def labelled(self, label: str, fact_type: str | None = None) -> DataFrame:
        return self.scan(fact_type).where(F.array_contains(LABELS, label))

    def select(self, fact_type: str, field: str | None = None, equals=None) -> DataFrame:
        """A lazy selection: all facts of a type, or those whose field equals a value."""
        return self.scan(fact_type) if field is None else self.find(fact_type, field, equals)

    def select_where(self, fact_type: str, test) -> DataFrame:
        """lambda(Type, x => predicate): ``test`` gets the scan and returns a condition."""
        df = self.scan(fact_type)
        return df.where(test(df))

    def materialize(self, selection: DataFrame) -> DataFrame:
        """The selection with its rows kept by the executors from its first use on."""
        return selection.persist()

    def release(self, selection: DataFrame) -> None:
        selection.unpersist()

    def each(self, fact_type: str, value, name: str = "value") -> DataFrame:
        """lambda(Type, x => value): one result for each fact; nulls, which stand for failure, are dropped."""
        df = self.scan(fact_type)
        return df.select(value(df).alias(name)).where(F.col(name).isNotNull())

    # changes

    def assert_facts(self, fact_type: str, df: DataFrame) -> None:
        """Appends facts; a fact that is there already only gains the new labels."""
        self._shared.pop(fact_type, None)
        new = df if LABELS in df.columns else df.withColumn(LABELS, F.array().cast("array<string>"))
        both = self.tables[fact_type].unionByName(new, allowMissingColumns=True) if fact_type in self.tables else new
        self.tables[fact_type] = merge_labels(both)
        self.log.append((len(self.log), fact_type, "assert"))

    def set_field(self, fact_type: str, condition: Column, field: str, value) -> None:
        self._shared.pop(fact_type, None)
        df = self.tables[fact_type]
        self.tables[fact_type] = df.withColumn(field, F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(df[field] if field in df.columns else F.lit(None)))
        self.log.append((len(self.log), fact_type, f"set {field}"))

    def mutations(self) -> DataFrame:
        return self.spark.createDataFrame(self.log, "sequence bigint, type string, action string")

    # what the session says of itself

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes (type, facts) and edges (child, parent) of the hierarchy."""
        own = [self.snapshot(t).agg(F.lit(t).alias("type"), F.count(F.lit(1)).alias("facts")) for t in sorted(self.parents)]
        return reduce(lambda a, b: a.unionByName(b), own), self.edges()

    def graph_json(self) -> str:
        """The hierarchy as JSON: nodes with their number of facts, and edges."""
        nodes, edges = self.graph()
        return json.dumps({"nodes": [{"id": r["type"], "facts": r["facts"]} for r in nodes.orderBy("type").collect()], "edges": [{"from": r["child"], "to": r["parent"]} for r in edges.orderBy("child", "parent").collect()]})

    def data_json(self) -> str:
        """The catalog as JSON: fields of each type with their kinds, and how many facts it has; a row for each type comes to the driver."""
        nodes = {r["type"]: r["facts"] for r in self.graph()[0].collect()}
        return json.dumps({"types": [{"type": t, "parents": self.parents[t], "facts": nodes[t], "fields": [{"field": f.name, "kind": f.dataType.simpleString()} for f in (self.tables[t].schema if t in self.tables else []) if f.name != LABELS]} for t in sorted(self.parents)]})

    # methods, references, threads

    def method(self, fact_type: str, name: str, f) -> None:
        """A Column function of a scan; the most specific type's wins."""
        self.methods[fact_type, name] = f

    def call(self, name: str, df: DataFrame) -> Column:
        """A method by each row's _type: a CASE over the types in df's hierarchy that define it."""
        owners = {t: next(((a, name) for a in self.ancestors(t) if (a, name) in self.methods), None) for t in self.parents}
        out = None
        for t, key in owners.items():
            if key:
                value = self.methods[key](df)
                out = F.when(F.col("_type") == t, value) if out is None else out.when(F.col("_type") == t, value)
        if out is None:
            raise KeyError(name)
        return out

    def reference(self, fact_type: str, alias: str, f) -> None:
        """An ordered, pure derivation that scans of the type may add."""
        self.references.setdefault(fact_type, []).append((alias, f))

    def derived(self, fact_type: str, factor: Column | None = None) -> DataFrame:
        df = self.scan(fact_type)
        for alias, f in self.references.get(fact_type, []):
            df = df.withColumn(alias, f(df) if factor is None else f(df) * factor)
        return df

    def start(self, job, *args) -> int:
        """Runs a function of the session on a thread of the driver, against the tables as they are."""
        self._jobs[len(self._jobs)] = self._pool.submit(job, self.frozen(), *args)
        return len(self._jobs) - 1

    def status(self, job: int) -> str:
        f = self._jobs[job]
        return "running" if not f.done() else "failed" if f.exception() else "done"

    def result(self, job: int):
        return self._jobs[job].result()

    def frozen(self) -> "FactSession":
        """A snapshot: later changes here don't show there."""
        other = FactSession(self.spark)
        other.tables, other.parents, other.methods, other.references = dict(self.tables), {k: list(v) for k, v in self.parents.items()}, dict(self.methods), {k: list(v) for k, v in self.references.items()}
        other.memberships, other.interpretations = dict(self.memberships), dict(self.interpretations)
        other._shared, other._sources = dict(self._shared), list(self._sources)
        return other


def merge_labels(df: DataFrame) -> DataFrame:
    """One row for each fact, with the labels of all its copies."""
    fields = [c for c in df.columns if c != LABELS]
    return df.groupBy(*fields).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(LABELS)))).alias(LABELS))


def relation_find(facts: DataFrame, edges: DataFrame, key: str, name: str) -> DataFrame:
    """facts with the id related to each under a name (null without one): the lowest, if there are several."""
    first = edges.where(F.col("name") == name).groupBy(F.col("src_id").alias("_src")).agg(F.min("dst_id").alias("related"))
    return facts.join(first, facts[key] == first["_src"], "left").drop("_src")
