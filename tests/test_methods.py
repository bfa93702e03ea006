"""Methods of program texts: as values, as Columns, as tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomfact.functions.native import Modules
from loomfact.plans.language import parse
from loomfact.plans.logic import PlanError
from loomfact.plans.methods import DEPTH, Methods

TEXT = """
Increment(value: number) => return value + 1
Double(value: number) =>
    return value * 2
pipelineMath.increment(value: number) =>
    return value + 1
pipelineMath.double(value: number) =>
    return value * 2
pipelineMath.select(value: number) =>
    if value > 0 then
        return pipelineMath.increment(value: value)
            then pipelineMath.double(value: system.result)
    else
        return pipelineMath.double(value: 0)
            then pipelineMath.increment(value: system.result)
Stop(value: any) =>
    value == value
    return nil
Explode(value: any) =>
    return value / 0
Wrap(value: any) =>
    return (seen: value, tag: "wrapped")
UseNested(value: number) =>
    inner := Increment(value: value)
        then Double(value: system.result)
    return inner + 3
stopped() => return Increment(value: 1) then Stop(value: system.result) then Explode(value: system.result)
precedence() => return Increment(value: 1) then Double(value: (system.result) + 3)
wrapped() => return UseNested(value: 4) then Wrap(value: system.result)
down(n: number) =>
    if n <= 0 then
        return 0
    else
        return down(n: n - 1)
role(x: any) =>
    x.role == "Engineer"
    return "engineering"
else
    x.role == "Manager"
    return "management"
else
    return "default"
swap(a: any, b: any) => return [b, a]
swapped(a: number) =>
    x, y := swap(a: a, b: 7)
    return x * 10 + y
typed() =>
    x: string, y: number := swap(a: 1, b: "t")
    return x
mistyped() =>
    x: number, y: number := swap(a: 1, b: "t")
    return x
again() =>
    x := 1
    x := 2
    return x
either(a: any, b: any) => return a or b
above(limit: number) => return lambda([1, 2, 3, 4], v => v > limit)
squares() => return lambda([1, 2, 3], v => v * v)
"""


@pytest.fixture(scope="module")
def methods(spark):
    return parse(spark, TEXT).methods


@pytest.mark.parametrize(
    "name, args, want",
    [
        ("pipelineMath.select", {"value": 5}, 12), ("pipelineMath.select", {"value": 0}, 1), ("UseNested", {"value": 4}, 13), ("stopped", {}, None), ("precedence", {}, 10), ("wrapped", {}, {"seen": 13, "tag": "wrapped"}),
        ("role", {"x": {"role": "Manager"}}, "management"), ("role", {"x": {"role": "Cook"}}, "default"), ("swapped", {"a": 2}, 72), ("typed", {}, "t"), ("either", {"a": None, "b": False}, False), ("either", {"a": 0, "b": None}, True),
        ("above", {"limit": 2}, [3, 4]), ("squares", {}, [1, 4, 9]), ("down", {"n": DEPTH - 1}, 0),
    ],
)
def test_values_and_columns(spark, methods, name, args, want):
    assert methods.value(name, **args) == want
    plain = {k: F.struct(*[F.lit(y).alias(x) for x, y in v.items()]) if isinstance(v, dict) else v for k, v in args.items()}
    got = spark.range(1).select(methods.column(name, **plain).alias("v")).first().v
    assert (got.asDict() if hasattr(got, "asDict") else got) == want


@pytest.mark.parametrize("name, args", [("mistyped", {}), ("again", {}), ("down", {"n": DEPTH}), ("Increment", {}), ("Increment", {"value": 1, "other": 2}), ("nobody", {})])
def test_what_is_refused(spark, methods, name, args):
    with pytest.raises((PlanError, RecursionError)):
        methods.value(name, **args)
    with pytest.raises((PlanError, RecursionError, PySparkException)):
        spark.range(1).select(methods.column(name, **args)).collect()


def test_numbers_only(spark):
    m = Methods()
    df = spark.createDataFrame([("a", 1)], "t string, n int")
    for text in ("t + 1", "t < 2", "n / 0", "n % 0"):
        with pytest.raises(PySparkException):
            df.select(m.expression(text, t=F.col("t"), n=F.col("n"))).collect()
    for text in ("n < 2 < 3", "n +", "(n", "missing + 1"):
        with pytest.raises(PlanError):
            m.expression(text, n=F.col("n"))
    assert df.select(m.expression("-n - -3 * 2 + 7 % 4 == 8", n=F.col("n"))).first()[0]
    assert df.select(m.expression("nil == nil and not nil and t != nil", t=F.col("t"))).first()[0]


def test_operators(spark):
    text = """
    @overload(operator: plus, pattern: "{a} and_then {b}", precedence: additive)
    joinThem() => return a * 10 + b
    @mixfix(operator: between, pattern: "{x} lies from {low} upto {high}", captures: {x: number, low: number, high: number}, precedence: ordering)
    inside() => return x >= low and x <= high
    f(x: number) => return x and_then 2 and_then 3
    g(x: number) => return x lies from 2 upto 5 and not (x lies from 3 upto 3)
    """
    m = parse(spark, text).methods
    assert m.value("f", x=1) == 123 and [m.value("g", x=x) for x in (1, 2, 3, 5)] == [False, True, False, True]
    assert [r[0] for r in spark.range(4).select(m.column("g", x=F.col("id") + 2)).collect()] == [True, False, True, True]
    for pattern in ("{a} and {b}", "{a}", "{a} {b} x", "{a} == {b}"):
        with pytest.raises(PlanError):
            m.declare(pattern, "inside")
    with pytest.raises(PlanError):
        m.declare("{a} and_then {b}", "inside", "additive", {"a": "any", "b": "any"})


def test_tables(spark):
    text = """
    Choice(value: 1) Choice(value: 2) Choice(value: 3)
    @overload(operator: choicesThrough, pattern: "choices through {limit}", type: prefix, captures: {limit: number}, precedence: prefix, cardinality: many)
    collectChoices() =>
        Choice(value: choice)
        where choice <= limit
        return choice
    only(limit: number) =>
        Choice(value: choice)
        where choice >= limit
        return choice
    """
    m = parse(spark, text).methods
    assert sorted(r.value for r in m.table("collectChoices", limit=2).collect()) == [1, 2]
    assert [r.value for r in m.table("only", limit=3).collect()] == [3]
    with pytest.raises(PlanError, match="one value"):
        m.table("only", limit=1)


def test_native_modules(spark):
    m = Modules()
    m.register("text", "size", lambda x: str(len(x)))
    m.register("text", "once", lambda x: x, {"thread_safe"})
    assert m.invoke("text.size", a="b") == len('{"a": "b"}')
    with pytest.raises(KeyError):
        m.invoke("os.system", a="b")
    with pytest.raises(ValueError):
        m.register("text", "bad", len, {"magic"})
    assert [r[0] for r in spark.range(2).select(m.column("text.once", a=F.col("id"))).collect()] == ['{"a":0}', '{"a":1}']
