"""Methods and expressions of program texts.

    double(value: number) => return value * 2
    grade(x: Employee) =>
        x.role == "Engineer"
        return (name: x.name, pay: double(value: x.pay))
    else
        return (name: x.name, pay: x.pay)
    factorial(value: number) =>
        if value <= 1 then return 1 else previous := factorial(value: value - 1) return value * previous
    @overload(operator: above, pattern: "{value} isAbove {least}", precedence: relationship)
    keep() => where value > least return value

A method is compiled into one Column, so calls, branches and pipelines stay within
generated code.  A method that calls itself has no such form: it runs in an interpreter,
to a depth of ``DEPTH``, under Arrow for Columns and plainly for values.  A guard that
fails ends its branch; of several branches the first that returns something counts, and
none returns nil.  Only numbers are ordered and added; only nil and false are false.
Operators may be declared by pattern; they are calls under another look.
"""

from __future__ import annotations

import math
import operator
import re
import sys
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .logic import Goal, PlanError, Program

#: Calls within calls at most, and Python's own, of which each takes several.
DEPTH, FRAMES = 256, 20_000
#: Words that stand for kinds of values in a method's head.
KINDS = {"number", "string", "text", "bool", "boolean", "any", "array", "int", "float", "Degree", "Fact", "map", "record"}
#: Levels of binary operators, the loosest first; declared operators name one of them.
LEVELS = ["or", "and", "relationship", "ordering", "then", "additive", "multiplicative"]
_MARKS = {"ordering": ("==", "!=", "<=", ">=", "<", ">"), "additive": ("+", "-"), "multiplicative": ("*", "/", "%")}
PROTECTED = {"==", "!=", "and", "or", "not", "then"}
_WORDS = {"return", "else", "if", "then", "where", "and", "or", "not"}


@dataclass
class Method:
    name: str
    params: dict[str, str]
    branches: list[list]
    cardinality: str = "one"
    effects: str = "pure"


@dataclass
class Operator:
    """A pattern of words and captures, and the method it calls."""

    parts: list[tuple[str, str]]
    method: str
    level: str = "relationship"
    kinds: dict[str, str] = field(default_factory=dict)

    @property
    def prefix(self) -> bool:
        return self.parts[0][0] == "word"


class Expressions:
    """Reads expressions and method bodies from a Reader's tokens."""

    def __init__(self, reader, operators: list[Operator]):
        self.r, self.operators = reader, operators

    def _is(self, *texts: str) -> bool:
        kind, text = self.r.peek()
        return kind != "text" and text in texts

    def _same_line(self) -> bool:
        return self.r.line() == self.r.line(-1)

    # expressions

    def expression(self, level: int = 0):
        if level == len(LEVELS):
            return self.unary()
        name = LEVELS[level]
        if name == "and" and self._is("not"):
            self.r.take()
            return ("not", self.expression(level + 1))
        left = self.expression(level + 1)
        while True:
            found = next((o for o in self.operators if o.level == name and not o.prefix and self._ahead(o.parts[1][1])), None)
            if found and self._same_line():
                left = self._mixfix(found, left, level)
            elif name in ("or", "and") and self._is(name):
                self.r.take()
                right = ("not", self.expression(level + 1)) if self._is("not") and self.r.take() else self.expression(level + 1)
                left = ("bin", name, left, right)
            elif name == "then" and self._is("then") and not self.in_if:
                self.r.take()
                left = ("then", left, self.expression(level + 1))
            elif name in _MARKS and self._is(*_MARKS[name]) and self._same_line():
                op = self.r.take()
                left = ("bin", op, left, self.expression(level + 1))
                if name == "ordering" and self._is(*_MARKS[name]):
                    raise PlanError("comparisons don't chain")
            else:
                return left

    #: Within an if's condition, "then" ends it.
    in_if = False

    def _ahead(self, words: str) -> bool:
        return all(self.r.peek(i)[1] == w and self.r.peek(i)[0] == "name" for i, w in enumerate(words.split()))

    def _mixfix(self, op: Operator, left, level: int):
        args = [] if left is None else [(op.parts[0][1], left)]
        for kind, text in op.parts[0 if left is None else 1 :]:
            if kind == "word":
                for w in text.split():
                    self.r.take(w)
            else:
                args.append((text, self.expression(level + 1)))
        return ("call", op.method, args)

    def unary(self):
        if self._is("-"):
            self.r.take()
            return ("bin", "-", ("value", 0.0), self.unary())
        found = next((o for o in self.operators if o.prefix and self._ahead(o.parts[0][1])), None)
        if found:
            return self._mixfix(found, None, len(LEVELS) - 1)
        return self.postfix()

    def postfix(self):
        out = self.primary()
        while self._is(".") and self._same_line():
            self.r.take()
            name = self.r.take()
            if out[0] == "var" and self._is("(") and self._same_line():
                out = ("call", f"{out[1]}.{name}", self.arguments())
            elif out[0] == "var" and out[1] == "system" and name == "result":
                out = ("result",)
            else:
                out = ("field", out, name)
        return out

    def arguments(self) -> list:
        self.r.take("(")
        out = []
        while not self._is(")"):
            named = self.r.peek()[0] == "name" and self.r.peek(1)[1] == ":"
            name = self.r.take() if named else None
            if named:
                self.r.take(":")
            out.append((name, self._free(self.expression)))
            if self._is(","):
                self.r.take()
        self.r.take(")")
        return out

    def _free(self, read, *args):
        """Reads within brackets, where a condition's "then" has no meaning."""
        before, self.in_if = self.in_if, False
        try:
            return read(*args)
        finally:
            self.in_if = before

    def primary(self):
        kind, text = self.r.peek()
        if kind == "text":
            return ("value", re.sub(r"\\(.)", r"\1", self.r.take()[1:-1]))
        if kind == "number":
            text = self.r.take()
            return ("value", float(text[:-1]) / 100 if text.endswith("%") else float(text))
        if text == "[":
            self.r.take()
            out = []
            while not self._is("]"):
                out.append(self._free(self.expression))
                if self._is(","):
                    self.r.take()
            self.r.take("]")
            return ("list", out)
        if text == "{":
            return ("record", self.named("{", "}"))
        if text == "(":
            if self.r.peek(1)[0] == "name" and self.r.peek(2)[1] == ":":
                return ("record", self.named("(", ")"))
            self.r.take()
            out = self._free(self.expression)
            self.r.take(")")
            return out
        if kind == "name" and text == "if":
            return self.conditional(self.expression)
        if kind == "name" and text == "lambda":
            self.r.take()
            self.r.take("(")
            source = self._free(self.expression)
            self.r.take(",")
            name = self.r.take()
            self.r.take("=>")
            body = self._free(self.expression)
            self.r.take(")")
            return ("lambda", source, name, body)
        if kind == "name" and text not in _WORDS:
            name = self.r.take()
            while self._is("::"):
                self.r.take()
                name += "::" + self.r.take()
            if name in ("true", "false", "nil"):
                return ("value", {"true": True, "false": False, "nil": None}[name])
            if self._is("(") and self._same_line():
                return ("call", name, self.arguments())
            return ("var", name)
        raise PlanError(f"no expression: {text or 'the end'}")

    def named(self, opening: str, closing: str) -> dict:
        self.r.take(opening)
        out = {}
        while not self._is(closing):
            name = self.r.take()
            self.r.take(":")
            out[name] = self._free(self.expression)
            if self._is(","):
                self.r.take()
        self.r.take(closing)
        return out

    def conditional(self, read):
        """if c then a else b, of expressions or of statements."""
        self.r.take("if")
        before, self.in_if = self.in_if, True
        condition = self.expression()
        self.in_if = before
        self.r.take("then")
        yes = read()
        no = ("value", None) if read == self.expression else []
        if self._is("else"):
            self.r.take()
            no = read()
        return ("if", condition, yes, no)

    # statements

    def _assigns(self) -> list[tuple[str, str | None]] | None:
        """Targets of a := that comes next, with their kinds."""
        at, out = 0, []
        while self.r.peek(at)[0] == "name" and self.r.peek(at)[1] not in _WORDS:
            name, kind = self.r.peek(at)[1], None
            at += 1
            if self.r.peek(at)[1] == ":" and self.r.peek(at + 1)[1] in KINDS:
                kind = self.r.peek(at + 1)[1]
                at += 2
            out.append((name, kind))
            if self.r.peek(at)[1] == ":=":
                self.r.at += at + 1
                return out
            if self.r.peek(at)[1] != ",":
                return None
            at += 1
        return None

    def block(self) -> list:
        out = []
        while True:
            kind, text = self.r.peek()
            if text == ",":
                self.r.take()
                continue
            if kind == "end" or text in ("else", "?", "@", ")") or self.r.starts_statement():
                return out
            if targets := self._assigns():
                out.append(("let", targets, self.expression()))
            elif text == "return":
                line = self.r.line()
                self.r.take()
                bare = self.r.peek()[0] == "end" or self.r.line() != line or self._is("else", ",")
                out.append(("return", ("value", None) if bare else self.expression()))
                return out
            elif text == "if":
                out.append(self.conditional(self.block))
            elif text == "where":
                self.r.take()
                out.append(("where", self.expression()))
            elif kind == "name" and self.r.peek(1)[1] == "(" and self.r.peek(2)[0] == "name" and self.r.peek(3)[1] == ":" and text[0].isupper():
                out.append(("goal", *self.r.term()))
            else:
                e = self.expression()
                out.append(("where", e) if e[0] in ("bin", "not") else ("do", e))

    def branches(self) -> list[list]:
        out = [self.block()]
        while self._is("else"):
            self.r.take()
            out.append(self.block())
        return out


# --- compiled to Columns --------------------------------------------------------

_NUMERIC = "^(tinyint|smallint|int|bigint|float|double|decimal.*|void)$"
_ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul}


def _column(value) -> Column:
    """A value within a plan as one Column: records as structs, lists as arrays."""
    if isinstance(value, dict):
        return F.struct(*[_column(v).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        return F.array(*[_column(v) for v in value])
    return value


def _number(value) -> Column:
    c = _column(value)
    return F.when(F.typeof(c).rlike(_NUMERIC), c.cast("double")).otherwise(F.raise_error(F.lit("only numbers are ordered or added")).cast("double"))


def _truth(value) -> Column:
    """Only nil and false are false."""
    c = _column(value)
    return F.when(F.typeof(c) == "boolean", F.coalesce(c.cast("string") == "true", F.lit(False))).otherwise(c.isNotNull())


def _holds(node, value) -> Column:
    """An if's condition: a comparison as it is, anything else only if it is exactly true."""
    c = _column(value)
    return F.coalesce(c, F.lit(False)) if node[0] in ("bin", "not") else F.when(F.typeof(c) == "boolean", F.coalesce(c.cast("string") == "true", F.lit(False))).otherwise(F.lit(False))


def _compare(op: str, a, b) -> Column:
    x, y = _column(a), _column(b)
    if op in ("==", "!="):
        return x.eqNullSafe(y) if op == "==" else ~x.eqNullSafe(y)
    return {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op](_number(x), _number(y))


class Methods:
    """The methods of a program: by name, as Columns, values or tables."""

    def __init__(self, program: Program | None = None):
        self.program, self.methods, self.operators = program, {}, []
        self.library, self.plain = dict(scalars.LIBRARY), dict(PLAIN)

    def add(self, method: Method) -> None:
        if method.name in self.methods:
            raise PlanError(f"{method.name} is declared twice")
        self.methods[method.name] = method

    def declare(self, pattern: str, method: str, level: str = "relationship", kinds: dict[str, str] | None = None) -> None:
        """Adds an operator by its pattern of words and {captures}."""
        parts = [("capture", x[1:-1]) if x.startswith("{") else ("word", x.strip()) for x in re.findall(r"\{\w+\}|[^{}]+", pattern) if x.strip()]
        words = [w for k, t in parts if k == "word" for w in t.split()]
        if not words or PROTECTED & set(words) or level not in (*LEVELS, "prefix"):
            raise PlanError(f"no operator: {pattern}")
        if any(a[0] == b[0] == "capture" for a, b in zip(parts, parts[1:])) or len(parts) > 1 and parts[0][0] == "capture" and parts[1][0] != "word":
            raise PlanError(f"captures of {pattern} need words between them")
        if any(o.parts == parts and o.kinds == (kinds or {}) for o in self.operators):
            raise PlanError(f"{pattern} has more than one meaning")
        self.operators.append(Operator(parts, method, "relationship" if level == "prefix" else level, kinds or {}))

    def _calls(self, name: str) -> set[str]:
        found, todo = set(), [name]
        walk = lambda x: [c for y in x for c in ([y[1], *walk(y[2:])] if isinstance(y, tuple) and y and y[0] == "call" and isinstance(y[1], str) else walk(y.values()) if isinstance(y, dict) else walk(y) if isinstance(y, list | tuple) else [])]
        while todo:
            m = self.methods.get(todo.pop())
            for c in walk(m.branches) if m else []:
                if c in self.methods and c not in found:
                    found.add(c)
                    todo.append(c)
        return found

    def recursive(self, name: str) -> bool:
        return name in self._calls(name)

    def _bound(self, m: Method, args: list) -> dict:
        """Arguments by parameter, named or in order."""
        out, free = {}, [p for p in m.params]
        for name, value in args:
            if name is None:
                name = next((p for p in free if p not in out), None)
            if name not in m.params and not (not m.params and name):
                raise PlanError(f"{m.name} has no parameter {name}")
            if name in out:
                raise PlanError(f"{m.name}: {name} is given twice")
            out[name] = value
        if missing := [p for p in m.params if p not in out]:
            raise PlanError(f"{m.name} needs {', '.join(missing)}")
        return out

    def column(self, name: str, *args, returns: str = "double", **named) -> Column:
        """A call of a method with Columns (or plain values); a recursive one gives what ``returns`` says."""
        lit = lambda v: v if isinstance(v, Column | dict | list) else F.lit(v)
        return _column(self._call(name, [(None, lit(a)) for a in args] + [(k, lit(v)) for k, v in named.items()], returns))

    def expression(self, text: str, returns: str = "double", **names) -> Column:
        """An expression over named Columns."""
        from .language import Reader

        reader = Reader(text)
        out = Expressions(reader, self.operators).expression()
        if reader.peek()[0] != "end":
            raise PlanError(f"can't read on from {reader.peek()[1]!r}")
        return _column(self._eval(out, names, None, returns))

    def _call(self, name: str, args: list, returns: str):
        m = self.methods.get(name)
        if m is None:
            key = name.replace(".", ":").replace("::", ":")
            key = {"fn:array": "array:array", "fn:pair": "array:pair", "fn:tuple": "array:tuple"}.get(key, key)
            if key in ("fn:array", "array:array", "array:tuple", "array:pair"):
                return [v for _, v in args]
            if key not in self.library:
                raise PlanError(f"nothing defines {name}")
            return self.library[key](*[_plain_literal(v) if key in _LITERAL and i else _column(v) for i, (_, v) in enumerate(args)])
        bound = self._bound(m, args)
        if self.recursive(name):
            return self._by_interpreter(m, bound, returns)
        return self._branches(m.branches, bound, returns)

    def _by_interpreter(self, m: Method, bound: dict, returns: str) -> Column:
        names = list(bound)
        own = Methods()
        own.methods, own.operators = dict(self.methods), list(self.operators)

        @F.pandas_udf(returns)
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series([own.value(m.name, **dict(zip(names, row))) for row in zip(*[c.astype(object).where(c.notna(), None) for c in columns])])

        return run(*[_column(bound[n]) for n in names])

    def _branches(self, branches: list[list], env: dict, returns: str):
        results = [self._block(b, dict(env), [], returns) for b in branches]
        if len(results) == 1 and not isinstance(results[0], tuple):
            return results[0]
        return F.coalesce(*[_column(r[1] if isinstance(r, tuple) else r) for r in results])

    def _block(self, stmts: list, env: dict, guards: list[Column], returns: str):
        """What a block returns: null where a guard fails or where it returns nothing."""
        for at, s in enumerate(stmts):
            if s[0] == "let":
                value = self._eval(s[2], env, None, returns)
                if len(s[1]) > 1 and (not isinstance(value, list) or len(value) != len(s[1])):
                    raise PlanError(f"{len(s[1])} names for a value that is no tuple of that many")
                for (n, kind), v in zip(s[1], value if len(s[1]) > 1 else [value]):
                    if n in env:
                        raise PlanError(f"{n} is bound twice")
                    env[n] = _checked(v, kind)
            elif s[0] == "where":
                guards = [*guards, _holds(s[1], self._eval(s[1], env, None, returns))]
            elif s[0] == "goal":
                raise PlanError("a method with goals gives a table")
            elif s[0] == "if":
                rest = stmts[at + 1 :]
                condition = _holds(s[1], self._eval(s[1], env, None, returns))
                yes, no = (_column(_value(self._block([*b, *rest], dict(env), [], returns))) for b in (s[2], s[3]))
                return _guarded(F.when(condition, yes).otherwise(no), guards)
            elif s[0] == "return":
                value = self._eval(s[1], env, None, returns)
                return _guarded(value, guards)
        return _guarded(F.lit(None), guards)

    def _eval(self, node, env: dict, result, returns: str):
        ev = lambda n: self._eval(n, env, result, returns)
        kind = node[0]
        if kind == "value":
            return F.lit(node[1])
        if kind == "var":
            if node[1] not in env:
                raise PlanError(f"nothing binds {node[1]}")
            return env[node[1]]
        if kind == "result":
            return result
        if kind == "field":
            of = ev(node[1])
            if isinstance(of, dict):
                if node[2] not in of:
                    raise PlanError(f"no field {node[2]}")
                return of[node[2]]
            return of[node[2]]
        if kind == "list":
            return [ev(x) for x in node[1]]
        if kind == "record":
            return {k: ev(v) for k, v in node[1].items()}
        if kind == "not":
            return ~_truth(ev(node[1]))
        if kind == "then":
            first = _column(ev(node[1]))
            return F.when(first.isNotNull(), _column(self._eval(node[2], env, first, returns)))
        if kind == "if":
            return F.when(_holds(node[1], ev(node[1])), _column(ev(node[2]))).otherwise(_column(ev(node[3])))
        if kind == "lambda":
            source = _column(ev(node[1]))
            inner = lambda x: self._eval(node[3], {**env, node[2]: x}, result, returns)
            test = node[3][0] == "not" or (node[3][0] == "bin" and node[3][1] not in ("+", "-", "*", "/", "%"))
            mapped = lambda x: _column(inner(x))
            return F.filter(source, mapped) if test else F.filter(F.transform(source, mapped), lambda x: x.isNotNull())
        if kind == "call":
            return self._call(node[1], [(n, ev(v)) for n, v in node[2]], returns)
        op, a, b = node[1], ev(node[2]), ev(node[3])
        if op in ("and", "or"):
            return _truth(a) & _truth(b) if op == "and" else _truth(a) | _truth(b)
        if op in _ARITHMETIC:
            return _ARITHMETIC[op](_number(a), _number(b))
        if op in ("/", "%"):
            return scalars.MATH["div" if op == "/" else "mod"](_number(a), _number(b))
        return _compare(op, a, b)

    # tables

    def table(self, name: str, program: Program | None = None, **args) -> DataFrame:
        """Rows of a method of cardinality many (or optional): one for each way to meet its goals and guards; column value, or the fields of a record."""
        m, program = self.methods[name], program or self.program
        bound = {k: F.lit(v) for k, v in self._bound(m, list(args.items())).items()}
        parts = []
        for stmts in m.branches:
            goals = [_as_goal(s[1], s[2]) for s in stmts if s[0] == "goal"]
            if not goals:
                raise PlanError(f"{name} has no goal")
            df = program.body(goals, {g.predicate: program.table(g.predicate) for g in goals})
            env = {**{c: F.col(c) for c in df.columns}, **bound}
            value = _column(_value(self._block([s for s in stmts if s[0] != "goal"], env, [], "double")))
            parts.append(df.select(value.alias("value")).where("value is not null"))
        out = reduce(lambda a, b: a.unionByName(b), parts)
        if m.cardinality == "one" and out.limit(2).count() > 1:
            raise PlanError(f"{name} gives one value")
        return out.select("value.*") if out.schema["value"].dataType.typeName() == "struct" else out

    # values

    def value(self, name: str, _depth: int = 0, **args):
        """A call of a method with plain values."""
        m = self.methods.get(name)
        if m is None:
            key = name.replace(".", ":").replace("::", ":")
            if key not in self.plain:
                raise PlanError(f"nothing defines {name}")
            return self.plain[key](*args.values())
        if _depth >= DEPTH:
            raise RecursionError(f"{name}: more than {DEPTH} calls within calls")
        if not _depth:
            sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
        env = self._bound(m, list(args.items()))
        for stmts in m.branches:
            found = self._run(stmts, dict(env), _depth)
            if found is not None and found[0] is not None:
                return found[0]
        return None

    def _run(self, stmts: list, env: dict, depth: int):
        """(what a block returns,), or None where a guard fails or nothing is returned."""
        for s in stmts:
            if s[0] == "let":
                value = self._plain(s[2], env, None, depth)
                values = value if len(s[1]) > 1 else [value]
                if len(s[1]) > 1 and (not isinstance(value, list | tuple) or len(value) != len(s[1])):
                    raise PlanError(f"{len(s[1])} names for a value that is no tuple of that many")
                for (n, kind), v in zip(s[1], values):
                    if n in env:
                        raise PlanError(f"{n} is bound twice")
                    if kind and v is not None and not _is_a(v, kind):
                        raise PlanError(f"{n} is no {kind}")
                    env[n] = v
            elif s[0] == "where":
                if self._plain(s[1], env, None, depth) is not True:
                    return None
            elif s[0] == "if":
                chosen = s[2] if self._plain(s[1], env, None, depth) is True else s[3]
                found = self._run(chosen, dict(env), depth)
                if found is not None:
                    return found
            elif s[0] == "return":
                return (self._plain(s[1], env, None, depth),)
            elif s[0] == "do":
                self._plain(s[1], env, None, depth)
        return None

    def _plain(self, node, env: dict, result, depth: int):
        ev = lambda n: self._plain(n, env, result, depth)
        kind = node[0]
        if kind == "value":
            return node[1]
        if kind == "var":
            if node[1] not in env:
                raise PlanError(f"nothing binds {node[1]}")
            return env[node[1]]
        if kind == "result":
            return result
        if kind == "field":
            of = ev(node[1])
            if not isinstance(of, dict) or node[2] not in of:
                raise PlanError(f"no field {node[2]}")
            return of[node[2]]
        if kind == "list":
            return [ev(x) for x in node[1]]
        if kind == "record":
            return {k: ev(v) for k, v in node[1].items()}
        if kind == "not":
            return not _true(ev(node[1]))
        if kind == "then":
            first = ev(node[1])
            return None if first is None else self._plain(node[2], env, first, depth)
        if kind == "if":
            return ev(node[2]) if ev(node[1]) is True else ev(node[3])
        if kind == "lambda":
            each = [(x, self._plain(node[3], {**env, node[2]: x}, result, depth)) for x in ev(node[1])]
            test = node[3][0] == "not" or (node[3][0] == "bin" and node[3][1] not in ("+", "-", "*", "/", "%"))
            return [x for x, y in each if y is True] if test else [y for _, y in each if y is not None]
        if kind == "call":
            args = [(n, ev(v)) for n, v in node[2]]
            if node[1] in self.methods:
                return self.value(node[1], depth + 1, **self._bound(self.methods[node[1]], args))
            key = node[1].replace(".", ":").replace("::", ":")
            if key in ("fn:array", "fn:tuple", "fn:pair"):
                return [v for _, v in args]
            if key not in self.plain:
                raise PlanError(f"nothing defines {node[1]}")
            return self.plain[key](*[v for _, v in args])
        op, a, b = node[1], ev(node[2]), ev(node[3])
        if op in ("and", "or"):
            return _true(a) and _true(b) if op == "and" else _true(a) or _true(b)
        if op in ("==", "!="):
            return (a == b and isinstance(a, bool) == isinstance(b, bool)) == (op == "==")
        if any(isinstance(x, bool) or not isinstance(x, int | float) for x in (a, b)):
            raise PlanError("only numbers are ordered or added")
        if op in ("/", "%") and b == 0:
            raise ZeroDivisionError("division by zero")
        return {**_ARITHMETIC, "/": operator.truediv, "%": math.fmod, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op](a, b)


def _as_goal(name: str, fields: dict) -> Goal:
    from .language import _goal

    return _goal(Goal, name, fields)


def _value(x):
    return x[1] if isinstance(x, tuple) else x


def _guarded(value, guards: list[Column]):
    """The value, or ("guarded", Column) that is null where a guard fails."""
    return ("guarded", F.when(reduce(operator.and_, guards), _column(value))) if guards else value


def _plain_literal(value):
    """Library functions take some arguments as plain values, not as Columns."""
    if not isinstance(value, Column):
        return value
    text = value._jc.toString() if hasattr(value, "_jc") else str(value)
    return int(float(text)) if re.fullmatch(r"-?\d+(\.0+)?", text) else text


#: Library functions whose further arguments are plain values.
_LITERAL = {"array:get", "str:split", "json:get", "json:has", "json:set", "json:remove"}


def _is_a(value, kind: str) -> bool:
    if kind in ("number", "int", "float", "Degree"):
        return isinstance(value, int | float) and not isinstance(value, bool)
    return {"string": isinstance(value, str), "text": isinstance(value, str), "bool": isinstance(value, bool), "boolean": isinstance(value, bool), "array": isinstance(value, list | tuple)}.get(kind, True)


def _checked(value, kind: str | None):
    """A bound value of a stated kind: another kind raises."""
    if kind is None or kind in ("any", "Fact", "map", "record") or isinstance(value, dict | list):
        return value
    pattern = _NUMERIC if kind in ("number", "int", "float", "Degree") else "^(string|void)$" if kind in ("string", "text") else "^(boolean|void)$" if kind in ("bool", "boolean") else "^(array.*|void)$"
    ok = F.typeof(value).rlike(pattern)
    return F.when(F.when(ok, True).otherwise(F.raise_error(F.lit(f"this is no {kind}")).cast("boolean")), value)


def _true(x) -> bool:
    return x is not None and x is not False


def _round(x: float) -> float:
    return math.copysign(math.floor(abs(x) + 0.5), x)


#: The library's pure functions on plain values, for methods that run in the interpreter.
PLAIN = {
    "math:pi": lambda: math.pi, "math:e": lambda: math.e, "math:pow": math.pow, "math:sqrt": math.sqrt, "math:sin": math.sin, "math:cos": math.cos, "math:tan": math.tan, "math:asin": math.asin, "math:acos": math.acos,
    "math:atan": math.atan, "math:atan2": math.atan2, "math:log": math.log, "math:log10": math.log10, "math:exp": math.exp, "math:abs": abs, "math:floor": lambda x: float(math.floor(x)), "math:ceil": lambda x: float(math.ceil(x)),
    "math:round": _round, "math:add": operator.add, "math:sub": operator.sub, "math:mul": operator.mul, "math:div": operator.truediv, "math:mod": math.fmod,
    "str:len": len, "str:contains": operator.contains, "str:concat": lambda *a: "".join(a), "str:join": lambda a, sep: sep.join(a), "str:lower": str.lower, "str:upper": str.upper, "str:trim": lambda s: s.strip(" \t\n\v\f\r"),
    "str:split": lambda s, sep: s.split(sep), "str:replace": str.replace, "str:startsWith": str.startswith, "str:endsWith": str.endswith,
    "array:get": lambda a, i: a[int(i)] if 0 <= int(i) < len(a) else None, "array:len": len, "array:push": lambda a, x: [*a, x], "array:count": len, "array:sum": sum, "array:min": min, "array:max": max,
    "array:average": lambda a: sum(a) / len(a) if a else None, "array:sort": sorted, "array:contains": operator.contains,
}
