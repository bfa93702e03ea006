"""The scalar library: every function takes and gives Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- comparison, logic and control ------------------------------------------


def equal(a: Column, b: Column) -> Column:
    """Deep equality; null equals null."""
    return a.eqNullSafe(b)


def truthy(x: Column, boolean: bool = True) -> Column:
    """Only null and false are false; pass boolean=False for a Column of another type."""
    return F.coalesce(x, F.lit(False)) if boolean else x.isNotNull()


def both(a: Column, b: Column) -> Column:
    return truthy(a) & truthy(b)


def either(a: Column, b: Column) -> Column:
    return truthy(a) | truthy(b)


def negation(a: Column) -> Column:
    return ~truthy(a)


def branch(condition: Column, yes: Column, no: Column) -> Column:
    """if/else: the condition holds only where it is exactly true."""
    return F.when(condition.eqNullSafe(F.lit(True)), yes).otherwise(no)


def first_success(*branches: Column) -> Column:
    """Ordered else branches: the first one that returns a value."""
    return F.coalesce(*branches)


def then(value: Column, *steps) -> Column:
    """A pipeline of Column functions that a null ends."""
    return reduce(lambda x, f: F.when(x.isNotNull(), f(x)), steps, value)


def result_ok(value: Column) -> Column:
    return F.struct(F.lit(True).alias("ok"), value.alias("value"), F.lit(None).cast("struct<kind:string,message:string,source:string>").alias("error"))


def result_failure(kind: Column, message: Column, source: Column, like: str = "string") -> Column:
    return F.struct(F.lit(False).alias("ok"), F.lit(None).cast(like).alias("value"), F.struct(kind.alias("kind"), message.alias("message"), source.alias("source")).alias("error"))


def throw(message: Column | str) -> Column:
    return F.raise_error(message)


def implication(antecedent: Column, consequent: Column, kind: str = "implication") -> Column:
    """A statement record; converse, contrapositive and contradiction rearrange it."""
    return F.struct(F.lit(kind).alias("kind"), antecedent.alias("antecedent"), consequent.alias("consequent"))


def converse(s: Column) -> Column:
    return implication(s.consequent, s.antecedent, "converse")


def negated(x: Column) -> Column:
    return F.struct(F.lit("negation").alias("kind"), x.alias("statement"))


def contrapositive(s: Column) -> Column:
    return implication(negated(s.consequent), negated(s.antecedent), "contrapositive")


def contradiction(x: Column) -> Column:
    return F.struct(F.lit("contradiction").alias("kind"), x.alias("statement"), negated(x).alias("negation"))


# --- arithmetic ---------------------------------------------------------------


def _d(x: Column) -> Column:
    return x.cast("double")


def _divisor(x: Column, what: str) -> Column:
    return F.when(x == 0, F.raise_error(F.lit(f"{what} by zero")).cast("double")).otherwise(x)


MATH = {
    "pi": lambda: F.lit(3.141592653589793), "e": lambda: F.lit(2.718281828459045),
    "random": lambda low, high: F.rand() * (_d(high) - _d(low)) + _d(low),
    "pow": lambda a, b: F.pow(_d(a), _d(b)), "atan2": lambda a, b: F.atan2(_d(a), _d(b)), "sqrt": lambda a: F.sqrt(_d(a)),
    "sin": lambda a: F.sin(_d(a)), "cos": lambda a: F.cos(_d(a)), "tan": lambda a: F.tan(_d(a)),
    "asin": lambda a: F.asin(_d(a)), "acos": lambda a: F.acos(_d(a)), "atan": lambda a: F.atan(_d(a)),
    "log": lambda a: F.ln(_d(a)), "log10": lambda a: F.log10(_d(a)), "exp": lambda a: F.exp(_d(a)), "abs": lambda a: F.abs(_d(a)),
    "floor": lambda a: _d(F.floor(_d(a))), "ceil": lambda a: _d(F.ceil(_d(a))), "round": lambda a: F.round(_d(a)),
    "add": lambda a, b: _d(a) + _d(b), "sub": lambda a, b: _d(a) - _d(b), "mul": lambda a, b: _d(a) * _d(b),
    "div": lambda a, b: _d(a) / _divisor(_d(b), "division"), "mod": lambda a, b: _d(a) % _divisor(_d(b), "remainder"),
}

# --- text, arrays, records ------------------------------------------------------

STR = {
    "len": F.length, "contains": lambda a, b: F.contains(a, b), "concat": lambda *a: F.concat(*a), "join": lambda a, sep: F.array_join(a, sep),
    "lower": F.lower, "upper": F.upper, "trim": lambda a: F.regexp_replace(a, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""),
    "split": lambda a, sep: F.split(a, "\\Q" + sep + "\\E") if sep else F.split(a, ""), "replace": lambda a, old, new: F.replace(a, old, new),
    "startsWith": lambda a, b: F.startswith(a, b), "endsWith": lambda a, b: F.endswith(a, b),
    "ParseDoc": lambda name: F.struct(name.alias("name")),
}

ARRAY = {
    "get": lambda a, i: F.get(a, i), "len": F.size, "push": lambda a, x: F.array_append(a, x), "array": lambda *x: F.array(*x),
    "pair": lambda a, b: F.struct(a.alias("first"), b.alias("second")), "tuple": lambda *x: F.struct(*[c.alias(f"_{i}") for i, c in enumerate(x, 1)]),
    "first": lambda p: p.first, "second": lambda p: p.second,
    "count": F.size, "sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), "min": F.array_min, "max": F.array_max,
    "average": lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)),
    "sort": lambda a: F.array_sort(a), "search": lambda a, q: F.filter(a, lambda x: F.contains(x.cast("string"), q)),
    "contains": lambda a, x: F.exists(a, lambda y: y.eqNullSafe(x)), "position": lambda a, x: F.array_position(a, x) - 1,
}

def _members(text: Column, but: str) -> Column:
    """The members of a JSON object but for one, each with its own type."""
    return F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, _: k != but)


def _variant(value: Column) -> Column:
    """Any value as it stands in JSON."""
    return F.try_variant_get(F.parse_json(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})), "$.v", "variant")


JSON = {
    "object": lambda **fields: F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])), "parse": lambda s: F.parse_json(s),
    "get": lambda s, key: F.get_json_object(s, f"$.{key}"), "has": lambda s, key: F.coalesce(F.array_contains(F.json_object_keys(s), key), F.lit(False)),
    "keys": lambda s: F.json_object_keys(s),
    "set": lambda s, key, value: F.to_json(F.map_concat(_members(s, key), F.create_map(F.lit(key), _variant(value)))),
    "remove": lambda s, key: F.to_json(_members(s, key)), "toText": F.to_json,
}

# --- text normalisation ------------------------------------------------------------


def normalised(text: Column) -> Column:
    """Lower-case ASCII letters and digits, anything between as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def stemmed(text: Column) -> Column:
    """A token with '_' between its parts and common English endings taken off."""
    t = F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ", "_")
    cut = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    return F.when(t.endswith("ies") & (F.length(t) > 3), F.concat(cut(3), F.lit("y"))).when(t.endswith("ing") & (F.length(t) > 3), cut(3)).when(t.endswith("ed") & (F.length(t) > 2), cut(2)).when(t.endswith("s") & (F.length(t) > 1), cut(1)).otherwise(t)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance of the normalised texts over the longer one's length."""
    x, y = normalised(a), normalised(b)
    most = F.greatest(F.length(x), F.length(y))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / most)


# --- probability and small models ---------------------------------------------------


def _log_factorial(n: Column) -> Column:
    return F.aggregate(F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, k: s + F.ln(k))


def binomial_pmf(k: Column, n: Column, p: Column) -> Column:
    inside = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)) * F.pow(p, k) * F.pow(1 - p, n - k)
    return F.when((k < 0) | (k > n), 0.0).otherwise(inside)


def poisson_pmf(k: Column, rate: Column) -> Column:
    return F.when(k < 0, 0.0).otherwise(F.exp(-rate - _log_factorial(k)) * F.pow(rate, k))


def _sum_to(k: Column, pmf) -> Column:
    return F.when(k < 0, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(0)).cast("int")), F.lit(0.0), lambda s, i: s + pmf(i)))


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    return _sum_to(F.least(k, n), lambda i: binomial_pmf(i, n, p))


def poisson_cdf(k: Column, rate: Column) -> Column:
    return _sum_to(k, lambda i: poisson_pmf(i, rate))


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / sd, F.lit(2.0))) / (sd * 2.5066282746310002)


#: Abramowitz and Stegun 7.1.26, error below 1.5e-7.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def normal_cdf(x: Column, mean: Column, sd: Column) -> Column:
    z = F.abs((x - mean) / sd) / 1.4142135623730951
    t = 1 / (1 + ERF_P * z)
    poly = reduce(lambda s, a: s * t + a, reversed(ERF[:-1]), F.lit(ERF[-1])) * t
    upper = 0.5 * (1 + (1 - poly * F.exp(-z * z)))
    return F.when(x >= mean, upper).otherwise(1 - upper)


def uniform_pdf(x: Column, low: Column, high: Column) -> Column:
    return F.when((x >= low) & (x <= high), 1 / (high - low)).otherwise(0.0)


def uniform_cdf(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


PROBABILITY = {
    "bernoulli": lambda p: F.rand() < p, "binomialPmf": binomial_pmf, "binomialCdf": binomial_cdf, "poissonPmf": poisson_pmf, "poissonCdf": poisson_cdf,
    "normalPdf": normal_pdf, "normalCdf": normal_cdf, "uniformPdf": uniform_pdf, "uniformCdf": uniform_cdf,
    "sample": lambda a: F.get(F.shuffle(a), 0),
}

ML = {
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)), "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "dot": lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x),
    "meanSquaredError": lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x) / F.size(a),
}

#: Names as the language has them, for lookup by a planner.
LIBRARY = {f"{group}:{name}": f for group, names in (("math", MATH), ("str", STR), ("array", ARRAY), ("json", JSON), ("probability", PROBABILITY), ("ml", ML)) for name, f in names.items()}


def call(name: str, *args, **named):
    """A library function by name; raises KeyError for what doesn't exist or can't run in a plan."""
    return LIBRARY[name](*args, **named)
