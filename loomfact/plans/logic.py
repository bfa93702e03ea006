"""Logic queries as plans: conjunctions of goals become joins, disjunctions unions, negation
anti-joins, comparisons filters, and recursive rules semi-naive fixpoints, of several
predicates at once where these recur by way of each other.

    p = Program({"Route": routes, "Blocked": blocked})
    p.rule("Reach", ["a", "b"], [Goal("Route", start="?a", stop="?b"), Not("Blocked", start="?a", stop="?b")])
    p.rule("Reach", ["a", "b"], [Goal("Route", start="?a", stop="?n"), Goal("Reach", a="?n", b="?b")])
    p.query("Reach", a="x", b="?where")

A text that begins with "?" is a variable, "_" is anonymous, anything else a value.  A
name of a field may be a path ("meta.role").  Null unifies with null.  Tables whose keys
are declared spare a query its last step, which drops equal bindings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..store import Table


class PlanError(ValueError):
    """A program that has no plan."""


class Goal:
    negative = False

    def __init__(self, predicate: str, **terms):
        self.predicate = predicate
        self.terms = {k.replace("__", "."): v for k, v in terms.items()}

    def variables(self) -> list[str]:
        return list(dict.fromkeys(v[1:] for v in self.terms.values() if isinstance(v, str) and v.startswith("?")))


class Not(Goal):
    negative = True


class Where:
    """A guard: a function of the bindings' columns; those that are ``ordered`` must be numbers."""

    def __init__(self, *variables: str, test: Callable[..., Column], ordered: tuple[str, ...] = ()):
        self.names, self.test, self.ordered = list(variables), test, ordered


class Or:
    def __init__(self, *branches: list):
        self.branches = branches


def _match(df: DataFrame, goal: Goal) -> DataFrame:
    """Rows that agree with a goal's values; its variables as columns."""
    seen: dict[str, Column] = {}
    for name, term in goal.terms.items():
        if term == "_":
            continue
        if isinstance(term, str) and term.startswith("?"):
            if term[1:] in seen:
                df = df.where(seen[term[1:]].eqNullSafe(F.col(name)))
            else:
                seen[term[1:]] = F.col(name)
        else:
            df = df.where(F.col(name).eqNullSafe(F.lit(term)))
    return df.select(*[c.alias(v) for v, c in seen.items()])


def _join(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    if left is None:
        return right
    shared = [c for c in right.columns if c in left.columns]
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in shared]
    if how != "inner":
        return left.join(renamed, on, how) if on else left.where(F.lit(right.isEmpty()) if how == "left_anti" else F.lit(not right.isEmpty()))
    joined = left.join(renamed, on) if on else left.crossJoin(renamed)
    return joined.drop(*[f"_r_{c}" for c in shared])


#: Stands behind a predicate's name for its rows that are new in a round.
NEW = " (new)"


class Program:
    def __init__(self, facts: dict[str, DataFrame], keys: dict[str, list[str]] | None = None):
        self.facts, self.keys = dict(facts), dict(keys or {})
        self.rules: dict[str, list[tuple[list[str], list]]] = {}
        self.contraries: dict[str, str] = {}

    def rule(self, name: str, head: list[str], body: list) -> None:
        arity = {len(h) for h, _ in self.rules.get(name, [])} | {len(head)}
        if len(arity) > 1 or (name in self.rules and self.rules[name][0][0] != head):
            raise PlanError(f"the clauses of {name} have different heads")
        if name in self.facts:
            raise PlanError(f"{name} is a table of facts")
        self.rules.setdefault(name, []).append((head, body))

    def _goals(self, body: list) -> list[Goal]:
        out: list[Goal] = []
        for g in body:
            out += [x for b in g.branches for x in self._goals(b)] if isinstance(g, Or) else [g] if isinstance(g, Goal) else []
        return out

    def _reach(self, name: str, through: str | None = None) -> set[str]:
        found, todo = set(), [name]
        while todo:
            for _, body in self.rules.get(todo.pop(), []):
                for g in self._goals(body):
                    if g.predicate not in found:
                        found.add(g.predicate)
                        todo.append(g.predicate)
        return found

    def check(self, name: str) -> None:
        """Raises for a recursion through negation, and for predicates that nothing defines."""
        for p in {name} | self._reach(name):
            if p not in self.facts and p not in self.rules:
                raise PlanError(f"nothing defines {p}")
            for _, body in self.rules.get(p, []):
                for g in self._goals(body):
                    if g.negative and (g.predicate == p or p in self._reach(g.predicate)):
                        raise PlanError(f"{p} depends on its own negation")

    def body(self, goals: list, tables: dict[str, DataFrame]) -> DataFrame:
        """Bindings of a conjunction: positive goals first, then guards and negation as their variables are bound."""
        out: DataFrame | None = None
        for g in goals:
            if isinstance(g, Goal) and not g.negative:
                out = _join(out, _match(tables[g.predicate], g))
            elif isinstance(g, Or):
                branches = [self.body(b, tables) for b in g.branches]
                names = [c for c in branches[0].columns if all(c in b.columns for b in branches)]
                out = _join(out, reduce(lambda a, b: a.unionByName(b), [b.select(*names) for b in branches]).distinct())
        for g in goals:
            if isinstance(g, Where):
                if out is None or any(n not in out.columns for n in g.names):
                    raise PlanError("a guard's variables must be bound")
                for n in g.ordered:
                    if not isinstance(out.schema[n].dataType, NumericType):
                        raise PlanError(f"{n} is no number: only numbers are ordered")
                out = out.where(g.test(*[F.col(n) for n in g.names]))
            elif isinstance(g, Goal) and g.negative:
                if out is None or any(v not in out.columns for v in g.variables()):
                    raise PlanError(f"not {g.predicate}: all variables must be bound")
                out = _join(out, _match(tables[g.predicate], g), "left_anti")
        if out is None:
            raise PlanError("a body needs a positive goal")
        return out

    def _variants(self, body: list, group: set[str]) -> list[list]:
        """The body, once for each goal of the group, which asks for new rows there."""
        out = []

        def walk(goals, rebuild):
            for i, g in enumerate(goals):
                if isinstance(g, Or):
                    for j, b in enumerate(g.branches):
                        walk(b, lambda x, i=i, j=j, g=g: rebuild([*goals[:i], Or(*g.branches[:j], x, *g.branches[j + 1 :]), *goals[i + 1 :]]))
                elif isinstance(g, Goal) and not g.negative and g.predicate in group:
                    asked = Goal(g.predicate + NEW)
                    asked.terms = g.terms
                    out.append(rebuild([*goals[:i], asked, *goals[i + 1 :]]))

        walk(body, lambda x: x)
        return out

    def _group(self, name: str, group: set[str], done: dict[str, DataFrame]) -> None:
        """Semi-naive evaluation of predicates that recur by way of each other: each round joins what the last one found."""
        clauses = [(p, head, body) for p in sorted(group) for head, body in self.rules[p]]
        outer = {g.predicate for _, _, b in clauses for g in self._goals(b)} - group
        tables = {p: self.table(p, done) for p in sorted(outer)}
        own = lambda body: {g.predicate for g in self._goals(body)} & group
        shape = lambda df, head: df.select(*[F.col(c) for c in head])
        union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
        seen: dict[str, Table] = {}
        fresh: dict[str, DataFrame] = {}
        # predicates start with the clauses whose goals have rows already
        while len(seen) < len(group):
            ready = {p: parts for p in sorted(group - set(seen)) if (parts := [shape(self.body(b, tables | {q: seen[q].all() for q in seen}), h) for o, h, b in clauses if o == p and own(b) <= set(seen)])}
            if not ready:
                raise PlanError(f"{', '.join(sorted(group - set(seen)))}: no clause to start from")
            for p, parts in ready.items():
                table = Table(parts[0].sparkSession, "predicate")
                fresh[p] = table.add(union(parts).distinct())
                seen[p] = table
        while any(not df.isEmpty() for df in fresh.values()):
            now = tables | {p: t.all() for p, t in seen.items()} | {p + NEW: df for p, df in fresh.items()}
            found = {}
            for p in sorted(group):
                parts = [shape(self.body(v, now), h) for o, h, b in clauses if o == p for v in self._variants(b, group)]
                if parts:
                    found[p] = union(parts).select(seen[p].schema.names).distinct()
            for p in sorted(group):
                if p in found:
                    names = seen[p].schema.names
                    old = seen[p].all().select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(names)])
                    fresh[p] = seen[p].add(found[p].join(old, [found[p][c].eqNullSafe(old[f"_s{i}"]) for i, c in enumerate(names)], "left_anti"))
                else:
                    fresh[p] = fresh[p].limit(0)
        done |= {p: t.all() for p, t in seen.items()}

    def table(self, name: str, done: dict[str, DataFrame] | None = None) -> DataFrame:
        """All rows of a predicate."""
        done = {} if done is None else done
        if name in self.facts:
            return self.facts[name]
        if name in done:
            return done[name]
        self.check(name)
        group = {p for p in self._reach(name) if p in self.rules and name in self._reach(p)}
        if group:
            self._group(name, group, done)
            return done[name]
        tables = {p: self.table(p, done) for _, b in self.rules[name] for p in {g.predicate for g in self._goals(b)}}
        parts = [self.body(b, tables).select(*[F.col(c) for c in head]) for head, b in self.rules[name]]
        done[name] = reduce(lambda a, b: a.unionByName(b), parts).distinct()
        return done[name]

    def query(self, predicate: str, **terms) -> DataFrame:
        """Distinct bindings of the variables of one goal."""
        return self.ask([Goal(predicate, **terms)])

    def _unique(self, goals: list) -> bool:
        """Whether the bindings can't repeat: every goal is a table whose key they hold."""
        for g in goals:
            if isinstance(g, Or) or (isinstance(g, Goal) and not g.negative and not (g.predicate in self.keys and all(isinstance(t := g.terms.get(k, "_"), str) and t != "_" or t is not None and t != "_" for k in self.keys[g.predicate]))):
                return False
        return True

    def ask(self, goals: list) -> DataFrame:
        """Distinct bindings of a conjunction."""
        done: dict[str, DataFrame] = {}
        found = self.body(goals, {g.predicate: self.table(g.predicate, done) for g in self._goals(goals)})
        return found if self._unique(goals) else found.distinct()

    def lineage(self, name: str) -> DataFrame:
        """All rows of a predicate with _rules, the numbers of the clauses that each follows from."""
        done: dict[str, DataFrame] = {}
        self.table(name, done)
        parts = []
        for number, (head, body) in enumerate(self.rules[name]):
            tables = {g.predicate: self.table(g.predicate, done) for g in self._goals(body)}
            parts.append(self.body(body, tables).select(*[F.col(c) for c in head]).distinct().withColumn("_rule", F.lit(number)))
        both = reduce(lambda a, b: a.unionByName(b), parts)
        return both.groupBy(*self.rules[name][0][0]).agg(F.array_sort(F.collect_set("_rule")).alias("_rules"))

    def contrary(self, positive: str, negative: str) -> None:
        """Makes two predicates opposites, either of the other."""
        for a, b in ((positive, negative), (negative, positive)):
            if self.contraries.get(a, b) != b:
                raise PlanError(f"{a} is the contrary of {self.contraries[a]}")
            self.contraries[a] = b

    def prove(self, predicate: str, asked: DataFrame) -> DataFrame:
        """asked (columns are fields of the predicate) with truth: proved, disproved by its contrary, both or unknown."""
        from .reasoning import prove

        done: dict[str, DataFrame] = {}
        against = self.contraries.get(predicate)
        return prove(asked, asked.columns, self.table(predicate, done), self.table(against, done) if against else asked.limit(0))
