"""Registered queries by way of program texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.native import Modules, effect
from .plans import language
from .plans.methods import Methods
from .registry import Tables, query
from .registry import rounded as _r


def _tables(spark, sf_dir, *names):
    t = Tables(spark, sf_dir)
    return {n: getattr(t, n) for n in names}


@query("SELECT n_name AS \"Name\" FROM nation WHERE n_regionkey = 1")
def ad_hoc_query(spark, sf_dir):
    return language.run(spark, "? nation(n_name: Name, n_regionkey: 1, n_nationkey: _)", _tables(spark, sf_dir, "nation"))


@query("SELECT DISTINCT c_custkey AS who, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 AND (n_regionkey = 1 OR n_regionkey = 2) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def program_rules(spark, sf_dir):
    text = """
    Near(key: k, name: n) => nation(n_nationkey: k, n_name: n, n_regionkey: 1) | nation(n_nationkey: k, n_name: n, n_regionkey: 2)
    Buyer(who: w) => orders(o_custkey: w, o_orderstatus: "P")
    Idle(who: w, place: p) =>
        customer(c_custkey: w, c_nationkey: k, c_acctbal: b)
        Near(key: k, name: p)
        b > 5000
        not Buyer(who: w)
        return
    ? Idle(who: who, place: place)
    """
    return language.run(spark, text, _tables(spark, sf_dir, "customer", "nation", "orders"))


@query("WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS c, 'r' || n_regionkey AS p FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region), a AS (SELECT c, p FROM e UNION SELECT a.c, e.p FROM a JOIN e ON a.p = e.c) SELECT c AS child FROM a WHERE p = 'world'")
def program_recursion(spark, sf_dir):
    t = Tables(spark, sf_dir)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t.nation.select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent")).unionByName(t.region.select(key("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")))
    text = """
    Below(child: c, parent: p) => edge(child: c, parent: p)
    Below(child: c, parent: p) =>
        Below(child: c, parent: n)
        Below(child: n, parent: p)
    ? Below(child: child, parent: "world")
    """
    return language.run(spark, text, {"edge": edges})


@query("SELECT \"Name\", CAST(\"Legs\" AS DOUBLE) AS \"Legs\" FROM (VALUES ('tom', 4.0), ('rex', 4.0), ('ann', 2.0)) t(\"Name\", \"Legs\")")
def program_families(spark, sf_dir):
    """A goal on a type meets the facts of the types below it."""
    text = """
    Animal(name: "ann", legs: 2)
    Cat extend Animal(name: "tom", legs: 4)
    Dog extend Animal(name: "rex", legs: 4)
    ? Animal(name: Name, legs: Legs)
    """
    return language.run(spark, text)


@query("SELECT r_name AS name FROM region WHERE r_regionkey > 1")
def program_modules(spark, sf_dir):
    """Texts that name each other are read once each."""
    modules = {"rules/far": 'import "rules/near"\nFar(name: n) =>\n    Place(key: k, name: n)\n    k > 1\n', "rules/near": 'import "rules/far"\nPlace(key: k, name: n) => region(r_regionkey: k, r_name: n)\n'}
    return language.run(spark, 'import "rules"\n? Far(name: name)', _tables(spark, sf_dir, "region"), modules)


PRICES = """
double(value: number) => return value * 2
tax(price: number, rate: number) =>
    base := price * rate
    return base + 1
grade(x: Part) =>
    x.p_size > 40
    return (size: "large", cost: double(value: x.p_size))
else
    x.p_size > 20
    return (size: "middle", cost: x.p_size)
else
    return (size: "small", cost: 0)
spread(value: number) => return [value - 1, value + 1]
width(value: number) =>
    low, high := spread(value: value)
    return high - low + low * 0
chain(value: number) => return double(value: value) then tax(price: system.result, rate: 0.5) then double(value: system.result)
stopped(value: number) => return (if value > 25 then value else nil) then double(value: system.result)
factorial(value: number) =>
    if value <= 1 then
        return 1
    else
        previous := factorial(value: value - 1)
        return value * previous
mixed(a: number, b: string) => return not (a > 10 and b == "PROMO") or a == 5
nothing(value: number) => return
@overload(operator: isAbove, pattern: "{value} isAbove {least}", captures: {value: number, least: number}, precedence: relationship, cardinality: optional)
keepWhenAbove() =>
    where value > least
    return value
@overload(operator: within, pattern: "twice {value}", type: prefix, precedence: prefix)
twiceOf() => return value * 2
kept(value: number) => return twice value isAbove 50
"""


def _methods(spark, tables=None) -> Methods:
    return language.parse(spark, PRICES, tables).methods


@query("SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) AS doubled, round(p_retailprice * 0.1 + 1, 6) AS taxed, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'middle' ELSE 'small' END AS size, CAST(CASE WHEN p_size > 40 THEN p_size * 2 WHEN p_size > 20 THEN p_size ELSE 0 END AS DOUBLE) AS cost, CAST(2 AS DOUBLE) AS width FROM part")
def methods_on_facts(spark, sf_dir):
    """Methods with named arguments, ordered branches, records, local names and tuples."""
    part = Tables(spark, sf_dir).part
    m = _methods(spark, {"Part": part})
    df = part.withColumn("x", F.struct(*part.columns)).select("p_partkey", m.column("double", value=F.col("p_size")).alias("doubled"), _r(m.column("tax", F.col("p_retailprice"), 0.1)).alias("taxed"), m.column("grade", x=F.col("x")).alias("g"), m.column("width", value=F.col("p_size")).alias("width"))
    return df.select("p_partkey", "doubled", "taxed", "g.size", F.col("g.cost").cast("double").alias("cost"), "width")


@query("SELECT p_partkey, CAST((p_size + 1) * 2 AS DOUBLE) AS chained, CAST(CASE WHEN p_size > 25 THEN p_size * 2 END AS DOUBLE) AS stopped, NOT (p_size > 10 AND p_type = 'PROMO') OR p_size = 5 AS mixed, CAST(CASE WHEN p_size * 2 > 50 THEN p_size * 2 END AS DOUBLE) AS kept, CAST(NULL AS VARCHAR) AS nothing FROM part")
def methods_with_pipelines(spark, sf_dir):
    """Pipelines that nil stops, operators of the text's own, and logic in which only nil and false are false."""
    part = Tables(spark, sf_dir).part
    m, size = _methods(spark, {"Part": part}), F.col("p_size")
    return part.select("p_partkey", m.column("chain", value=size).alias("chained"), m.column("stopped", value=size).alias("stopped"), m.column("mixed", a=size, b=F.col("p_type")).alias("mixed"), m.column("kept", value=size).alias("kept"), m.column("nothing", value=size).cast("string").alias("nothing"))


@query("SELECT p_partkey, CAST(factorial(CAST(p_size % 12 AS INTEGER)) AS DOUBLE) AS product FROM part")
def recursive_method(spark, sf_dir):
    """A method that calls itself runs in the interpreter, under Arrow."""
    part = Tables(spark, sf_dir).part
    return part.select("p_partkey", _methods(spark, {"Part": part}).column("factorial", value=(F.col("p_size") % 12).cast("double")).alias("product"))


@query("SELECT n_name AS name, CAST(n_nationkey AS DOUBLE) + 0.5 AS key FROM nation WHERE n_nationkey <= 7 AND n_regionkey = 1")
def table_valued_method(spark, sf_dir):
    """A method of cardinality many: a row for each way to meet its goals."""
    text = """
    @overload(operator: through, pattern: "nations through {limit}", type: prefix, captures: {limit: number}, cardinality: many, precedence: prefix)
    collect() =>
        Nation(n_nationkey: key, n_name: name, n_regionkey: 1)
        where key <= limit
        return (name: name, key: key + 0.5)
    """
    found = language.parse(spark, text, {"Nation": Tables(spark, sf_dir).nation})
    return found.methods.table("collect", limit=7)


@query("SELECT p_partkey, CAST(p_size % 7 + 3 AS DOUBLE) / 2 AS half, round(sqrt(p_retailprice), 6) AS root, upper(p_type) AS loud, CAST(list_sum(list_transform([1.0, 2.0, 3.0], lambda v: v * p_size)) AS DOUBLE) AS scaled FROM part")
def expressions(spark, sf_dir):
    """Arithmetic, library calls and lambdas over arrays."""
    m, names = Methods(), {"size": F.col("p_size"), "price": F.col("p_retailprice"), "type": F.col("p_type")}
    part = Tables(spark, sf_dir).part
    return part.select("p_partkey", m.expression("(size % 7 + 3) / 2", **names).alias("half"), _r(m.expression("math.sqrt(price)", **names)).alias("root"), m.expression("str.upper(type)", **names).alias("loud"), m.expression("array.sum(lambda([1, 2, 3], v => v * size))", **names).alias("scaled"))


@query("SELECT n_nationkey, n_regionkey * 10 + n_nationkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM nation")
def native_module(spark, sf_dir):
    """Functions from JSON to JSON, one call for each row, or one for each batch."""
    import json

    def code(text):
        args = json.loads(text)
        return json.dumps(args["region"] * 10 + args["key"])

    def parity(text):
        return json.dumps(["even" if a["key"] % 2 == 0 else "odd" for a in json.loads(text)])

    modules = Modules()
    modules.register("places", "code", code)
    modules.register("places", "parity", parity, {"pure", "batch"})
    n, key = Tables(spark, sf_dir).nation, F.col("n_nationkey")
    return n.select("n_nationkey", modules.column("places.code", region=F.col("n_regionkey"), key=key).cast("int").alias("code"), F.from_json(F.concat(F.lit('{"v":'), modules.column("places.parity", key=key), F.lit("}")), "v string")["v"].alias("parity"))


@query("SELECT * FROM (VALUES ('math:sqrt', 'Pure'), ('math:random', 'Volatile'), ('probability:sample', 'Volatile'), ('str:upper', 'Pure')) t(name, effect)")
def purity(spark, sf_dir):
    return spark.createDataFrame([(n, effect(n)) for n in ("math:sqrt", "math:random", "probability:sample", "str:upper")], "name string, effect string")
