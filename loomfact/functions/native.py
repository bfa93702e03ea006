"""Native modules: functions from JSON to JSON under names that a program may call.

A module says what it can do: ``pure`` functions may be cached and reordered, others are
run once for each row; ``batch`` functions get lists of arguments.  Only names that are
allowed can be called.  Calls travel to Python workers in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import LIBRARY

#: Functions of the library that give another value each time; all others are pure.
VOLATILE = frozenset({"math:random", "probability:bernoulli", "probability:sample"})
CAPABILITIES = frozenset({"pure", "thread_safe", "batch", "fact_selections"})


def effect(name: str) -> str:
    """Pure or Volatile, of a library function."""
    if name not in LIBRARY:
        raise KeyError(name)
    return "Volatile" if name in VOLATILE else "Pure"


@dataclass(frozen=True)
class Native:
    run: Callable[[str], str]
    capabilities: frozenset[str]


class Modules:
    """Native functions by module and name."""

    def __init__(self):
        self.functions: dict[str, Native] = {}

    def register(self, module: str, name: str, run: Callable[[str], str], capabilities: set[str] = frozenset({"pure", "thread_safe"})) -> None:
        """``run`` gets a JSON text with the named arguments (a list of those with batch), and gives one with the result (a list of results)."""
        if unknown := set(capabilities) - CAPABILITIES:
            raise ValueError(f"no capability {', '.join(sorted(unknown))}")
        self.functions[f"{module}.{name}"] = Native(run, frozenset(capabilities))

    def invoke(self, name: str, **args):
        """One call with plain values."""
        native = self._found(name)
        out = json.loads(native.run(json.dumps([args] if "batch" in native.capabilities else args)))
        return out[0] if "batch" in native.capabilities else out

    def _found(self, name: str) -> Native:
        if name not in self.functions:
            raise KeyError(f"{name} isn't allowed")
        return self.functions[name]

    def column(self, name: str, **args: Column) -> Column:
        """The result, as a JSON text, of a call for each row."""
        native = self._found(name)
        run, batch = native.run, "batch" in native.capabilities

        def call(texts: pd.Series) -> pd.Series:
            if batch:
                return pd.Series([json.dumps(x) for x in json.loads(run("[" + ",".join(texts) + "]"))], dtype=object)
            return texts.map(run)

        call = F.pandas_udf(call, "string")
        if "pure" not in native.capabilities:
            call = call.asNondeterministic()
        return call(F.to_json(F.struct(*[c.alias(k) for k, c in args.items()]), {"ignoreNullFields": "false"}))
