"""Registered queries of catalogues, comparison, relations, hierarchies and lexical graphs, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import degrees, scalars
from .operators import compare, hierarchy, lexicon, lists, relation, rows, sets, stats, temporal
from .plans.logic import Goal, Or, Program, Where
from .plans.reasoning import decide
from .queries import _evidence, event_session, place_edges, user_sets
from .registry import Tables, query
from .registry import rounded as _r
from .session import FactSession

# --- catalogue and scans ----------------------------------------------------------


def places(spark, sf_dir) -> FactSession:
    """Nations and suppliers as facts below Place, customers apart."""
    t, s = Tables(spark, sf_dir), FactSession(spark)
    s.register("Place")
    s.register("Nation", t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("region")), ["Place"])
    s.register("Supplier", t.supplier.select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation")), ["Place"])
    s.register("Customer", t.customer.select("c_custkey", "c_name", F.col("c_nationkey").alias("nation")))
    return s


@query("SELECT 'Supplier' AS _type, s_nationkey AS nation FROM supplier UNION ALL SELECT 'Customer', c_nationkey FROM customer")
def scan_with_field(spark, sf_dir):
    return places(spark, sf_dir).with_field("nation").select("_type", "nation")


@query("SELECT event_id, round(value * 3, 6) AS triple FROM events WHERE event_type IN ('click', 'signup')")
def for_each_fact(spark, sf_dir):
    s = event_session(spark, sf_dir)
    return s.each("Lead", lambda x: F.struct(x.event_id, _r(x.value * 3).alias("triple"))).select("value.*")


@query("SELECT column_name AS field FROM (DESCRIBE part)")
def fact_fields(spark, sf_dir):
    s = FactSession(spark)
    s.register("Part", Tables(spark, sf_dir).part)
    return spark.createDataFrame([(f,) for f in s.fields("Part")], "field string")


@query("SELECT p_type, count(*) AS n FROM part WHERE p_size = 7 GROUP BY 1")
def fact_select(spark, sf_dir):
    """A lazy selection, materialised, read and released."""
    s = FactSession(spark)
    s.register("Part", Tables(spark, sf_dir).part)
    chosen = s.materialize(s.select("Part", "p_size", 7))
    out = chosen.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    s.release(chosen)
    return out


@query("SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def correlated_lookup(spark, sf_dir):
    s, t = FactSession(spark), Tables(spark, sf_dir)
    s.register("Customer", t.customer)
    return s.correlated(t.orders.where("o_orderstatus = 'P'"), "o_custkey", "Customer", "c_custkey", "c_custkey").select("o_orderkey", "c_name", "c_acctbal")


@query("SELECT event_id, event_type AS type, event_type IN ('click', 'view') AS visit, event_type IN ('click', 'signup') AS lead FROM events")
def instance_of(spark, sf_dir):
    s = event_session(spark, sf_dir)
    df = s.scan("Event")
    return df.select("event_id", F.col("_type").alias("type"), s.instance_of(F.col("_type"), "Visit").alias("visit"), s.instance_of(F.col("_type"), "Lead").alias("lead"))


@query("SELECT r_regionkey, r_name, CASE WHEN r_regionkey < 2 THEN 'first,known' ELSE 'known' END AS labels FROM region UNION ALL SELECT 77, 'ELSEWHERE', 'new'")
def assert_facts(spark, sf_dir):
    """Facts that are there already only gain labels."""
    s, r = FactSession(spark), Tables(spark, sf_dir).region
    s.register("Region", r, labels=["known"])
    s.assert_facts("Region", r.where("r_regionkey < 2").withColumn("_labels", F.array(F.lit("first"))))
    s.assert_facts("Region", spark.createDataFrame([(77, "ELSEWHERE", ["new"])], "r_regionkey int, r_name string, _labels array<string>"))
    return s.scan("Region").select("r_regionkey", "r_name", F.array_join(F.array_sort("_labels"), ",").alias("labels"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 3 THEN 'CHANGED' ELSE r_name END AS r_name FROM region")
def set_field(spark, sf_dir):
    s = FactSession(spark)
    s.register("Region", Tables(spark, sf_dir).region)
    s.set_field("Region", F.col("r_regionkey") == 3, "r_name", "CHANGED")
    return s.scan("Region").select("r_regionkey", "r_name")


@query("SELECT CAST(sequence AS BIGINT) AS sequence, type, action FROM (VALUES (0, 'Region', 'register'), (1, 'Region', 'set r_name'), (2, 'Region', 'assert')) t(sequence, type, action)")
def mutation_log(spark, sf_dir):
    s, r = FactSession(spark), Tables(spark, sf_dir).region
    s.register("Region", r)
    s.set_field("Region", F.col("r_regionkey") == 3, "r_name", "CHANGED")
    s.assert_facts("Region", r.limit(0))
    return s.mutations()


@query("SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer")
def thread_job(spark, sf_dir):
    """A job on a thread sees the facts as they were when it started."""
    s = FactSession(spark)
    s.register("Customer", Tables(spark, sf_dir).customer)
    job = s.start(lambda own: own.scan("Customer").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("s")))
    s.register("Customer", Tables(spark, sf_dir).customer.limit(0))
    return s.result(job)


@query("SELECT 'Customer' AS type, count(*) AS facts FROM customer UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Place', 0")
def graph_json(spark, sf_dir):
    import json

    found = json.loads(places(spark, sf_dir).graph_json())
    return spark.createDataFrame([(x["id"], x["facts"]) for x in found["nodes"]], "type string, facts bigint")


@query("SELECT 'Customer' AS type, column_name AS field FROM (DESCRIBE SELECT c_custkey, c_name, c_nationkey AS nation FROM customer) UNION ALL SELECT 'Nation', column_name FROM (DESCRIBE SELECT n_nationkey, n_name, n_regionkey AS region FROM nation) UNION ALL SELECT 'Supplier', column_name FROM (DESCRIBE SELECT s_suppkey, s_name, s_nationkey AS nation FROM supplier)")
def data_json(spark, sf_dir):
    import json

    found = json.loads(places(spark, sf_dir).data_json())
    return spark.createDataFrame([(t["type"], f["field"]) for t in found["types"] for f in t["fields"]], "type string, field string")


@query("SELECT * FROM (VALUES ('click', 'Visit'), ('click', 'Lead'), ('view', 'Visit'), ('signup', 'Lead'), ('purchase', 'Event'), ('error', 'Event'), ('Visit', 'Event'), ('Lead', 'Event')) t(child, parent)")
def parent_graph(spark, sf_dir):
    return event_session(spark, sf_dir).edges()


@query("SELECT DISTINCT p_type AS child, p_brand AS parent FROM part WHERE p_size < 10")
def edges_from_facts(spark, sf_dir):
    """Facts that carry their type and its parent."""
    p = Tables(spark, sf_dir).part
    return hierarchy.edges_of(p.select(F.col("p_type").alias("_type"), F.when(F.col("p_size") < 10, F.col("p_brand")).alias("_parent")))


@query("SELECT a.p_partkey AS k, CASE WHEN a.p_size = b.p_size THEN a.p_size END AS size FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def common_ancestor_rule(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    out = compare.RULES["FactCommonAncestor"](p.select(F.col("p_partkey").alias("k"), "p_size"), p.select((F.col("p_partkey") - 1).alias("k"), "p_size"), ["k"], ["p_size"])
    return out.select("k", F.col("p_size.value").alias("size"))


# --- projection, records, library ---------------------------------------------------


@query("SELECT p_partkey, p_name AS name, p_size + 1 AS size, p_type AS inner_type FROM part")
def record_construction(spark, sf_dir):
    made = F.struct(F.col("p_name").alias("name"), F.struct((F.col("p_size") + 1).alias("size"), F.col("p_type").alias("type")).alias("inner"))
    return Tables(spark, sf_dir).part.select("p_partkey", made.alias("r")).select("p_partkey", "r.name", "r.inner.size", F.col("r.inner.type").alias("inner_type"))


@query("SELECT p_partkey, p_size > 10 AS ok, CASE WHEN p_size > 10 THEN p_name END AS value, CASE WHEN p_size <= 10 THEN 'Small' END AS kind, CASE WHEN p_size <= 10 THEN 'size ' || p_size END AS message FROM part")
def result_records(spark, sf_dir):
    good = F.col("p_size") > 10
    failure = scalars.result_failure(F.lit("Small"), F.concat(F.lit("size "), F.col("p_size").cast("string")), F.lit("part"))
    r = F.when(good, scalars.result_ok(F.col("p_name"))).otherwise(failure)
    return Tables(spark, sf_dir).part.select("p_partkey", r.alias("r")).select("p_partkey", "r.ok", "r.value", "r.error.kind", "r.error.message")


@query("SELECT n_nationkey, 'converse' AS kind, CAST(n_regionkey AS VARCHAR) AS first, n_name AS second, 'contrapositive' AS other, 'negation' AS inner_kind, CAST(n_regionkey AS VARCHAR) AS statement, 'contradiction' AS both FROM nation")
def logic_records(spark, sf_dir):
    s = scalars.implication(F.col("n_name"), F.col("n_regionkey").cast("string"))
    df = Tables(spark, sf_dir).nation.select("n_nationkey", scalars.converse(s).alias("c"), scalars.contrapositive(s).alias("p"), scalars.contradiction(F.col("n_name")).alias("d"))
    return df.select("n_nationkey", "c.kind", F.col("c.antecedent").alias("first"), F.col("c.consequent").alias("second"), F.col("p.kind").alias("other"), F.col("p.antecedent.kind").alias("inner_kind"), F.col("p.antecedent.statement").alias("statement"), F.col("d.kind").alias("both"))


@query("SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS sorted, CAST(len(list_filter(string_split(p_name, ' '), lambda x: contains(x, 'e'))) AS INTEGER) AS found, list_contains(string_split(p_name, ' '), 'red') AS has, CAST(coalesce(list_position(string_split(p_name, ' '), 'part'), 0) - 1 AS BIGINT) AS place, array_to_string(list_append(string_split(p_name, ' '), 'end'), ' ') AS pushed FROM part")
def array_library(spark, sf_dir):
    A, words = scalars.ARRAY, scalars.STR["split"](F.col("p_name"), " ")
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(A["sort"](words), " ").alias("sorted"), F.size(A["search"](words, F.lit("e"))).alias("found"), A["contains"](words, F.lit("red")).alias("has"), A["position"](words, "part").alias("place"), F.array_join(A["push"](words, F.lit("end")), " ").alias("pushed"))


@query("SELECT event_id, json_keys(props)[1] AS first_key, CAST(json_extract(json_merge_patch(props, '{\"extra\": 2.5}'), '$.extra') AS DOUBLE) AS extra, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS gone, '{\"n\":' || event_id || ',\"t\":\"' || event_type || '\"}' AS text FROM events")
def json_library(spark, sf_dir):
    J, p = scalars.JSON, F.col("props")
    more = J["set"](p, "extra", F.lit(2.5))
    text = J["toText"](F.struct(F.col("event_id").alias("n"), F.col("event_type").alias("t")))
    return Tables(spark, sf_dir).events.select("event_id", F.get(J["keys"](p), 0).alias("first_key"), F.try_variant_get(J["parse"](more), "$.extra", "double").alias("extra"), F.try_variant_get(J["parse"](more), "$.k", "bigint").alias("k"), J["get"](J["remove"](p, "k"), "k").alias("gone"), text.alias("text"))


@query("""WITH t AS (SELECT p_partkey, replace(trim(regexp_replace(lower(w), '[^a-z0-9]+', ' ', 'g')), ' ', '_') AS x FROM (SELECT p_partkey, p_name || 's ' || p_type || 'ing' AS w FROM part))
SELECT p_partkey, CASE WHEN x LIKE '%ies' AND length(x) > 3 THEN left(x, length(x) - 3) || 'y' WHEN x LIKE '%ing' AND length(x) > 3 THEN left(x, length(x) - 3) WHEN x LIKE '%ed' AND length(x) > 2 THEN left(x, length(x) - 2) WHEN x LIKE '%s' AND length(x) > 1 THEN left(x, length(x) - 1) ELSE x END AS token FROM t""")
def normalised_tokens(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", scalars.stemmed(F.concat("p_name", F.lit("s "), "p_type", F.lit("ing"))).alias("token"))


@query("""SELECT p_partkey, round(list_sum(list_transform(range(0, k + 1), lambda i: factorial(CAST(20 AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(20 - i AS INTEGER))) * pow(0.3, i) * pow(0.7, 20 - i))), 9) AS binomial,
round(list_sum(list_transform(range(0, k + 1), lambda i: exp(-4.5) * pow(4.5, i) / factorial(CAST(i AS INTEGER)))), 9) AS poisson, round(least(greatest((p_size - 10) / 20.0, 0), 1), 9) AS uniform FROM (SELECT *, CAST(p_size % 20 AS INTEGER) AS k FROM part)""")
def cumulative_distributions(spark, sf_dir):
    k = (F.col("p_size") % 20).cast("int")
    return Tables(spark, sf_dir).part.select("p_partkey", _r(scalars.binomial_cdf(k, F.lit(20), F.lit(0.3)), 9).alias("binomial"), _r(scalars.poisson_cdf(k, F.lit(4.5)), 9).alias("poisson"), _r(scalars.uniform_cdf(F.col("p_size").cast("double"), F.lit(10.0), F.lit(30.0)), 9).alias("uniform"))


@query("SELECT l_orderkey, l_linenumber, round(1 - abs(l_discount - l_tax), 9) AS degree, round((1 / (1 + abs(l_quantity - 5)) + 1 / (1 + abs(l_discount - l_tax))) / 2, 9) AS members, round((1 / (1 + abs(l_quantity - 5))) / 2, 9) AS uneven FROM lineitem")
def degree_arrays(spark, sf_dir):
    a = F.array("l_quantity", "l_discount")
    same = degrees.similar_numbers
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", _r(degrees.similar_degrees(F.col("l_discount"), F.col("l_tax")), 9).alias("degree"), _r(degrees.similar_arrays(a, F.array(F.lit(5.0), F.col("l_tax")), same), 9).alias("members"), _r(degrees.similar_arrays(a, F.array(F.lit(5.0)), same), 9).alias("uneven"))


# --- goals -----------------------------------------------------------------------------


@query("SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9000 AND (c_mktsegment = 'BUILDING' OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def grouped_goals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = Program({"customer": t.customer, "nation": t.nation})
    either = Or([Goal("customer", c_custkey="?c", c_mktsegment="BUILDING")], [Goal("customer", c_custkey="?c", c_nationkey="?n"), Goal("nation", n_nationkey="?n", n_regionkey=1)])
    return p.ask([Goal("customer", c_custkey="?c", c_acctbal="?b"), either, Where("b", test=lambda b: b > 9000, ordered=("b",))]).select("c")


@query("SELECT DISTINCT c_mktsegment AS s FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def anonymous_variables(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = Program({"customer": t.customer, "nation": t.nation})
    return p.ask([Goal("customer", c_custkey="_", c_mktsegment="?s", c_nationkey="?n"), Goal("nation", n_nationkey="?n", n_name="_", n_regionkey=2)]).select("s").distinct()


@query("SELECT s_suppkey AS s, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 3")
def nested_pattern(spark, sf_dir):
    t = Tables(spark, sf_dir)
    wrapped = t.supplier.select("s_suppkey", F.struct(F.struct(F.col("s_nationkey").alias("key")).alias("nation")).alias("home"))
    named = t.nation.select(F.struct(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region")).alias("at"), "n_name")
    p = Program({"wrapped": wrapped, "named": named})
    return p.ask([Goal("wrapped", s_suppkey="?s", home__nation__key="?k"), Goal("named", at__key="?k", at__region=3, n_name="?n")]).select("s", "n")


_FLOW = "e AS (SELECT DISTINCT user_id AS a, CAST(floor(value) AS BIGINT) % 50 AS b FROM events WHERE event_type = 'purchase')"


def _flow(spark, sf_dir):
    e = Tables(spark, sf_dir).events.where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("a"), (F.floor("value") % 50).alias("b")).distinct()


@query(f"WITH RECURSIVE {_FLOW}, w AS (SELECT a, b, 1 AS odd FROM e UNION SELECT w.a, e.b, 1 - odd FROM w JOIN e ON w.b = e.a) SELECT DISTINCT a, b FROM w WHERE odd = 0")
def mutual_recursion(spark, sf_dir):
    """Ends of walks of even length, by way of those of odd length and the other way round."""
    p = Program({"edge": _flow(spark, sf_dir)})
    p.rule("odd", ["a", "b"], [Goal("edge", a="?a", b="?b")])
    p.rule("odd", ["a", "b"], [Goal("even", a="?a", b="?n"), Goal("edge", a="?n", b="?b")])
    p.rule("even", ["a", "b"], [Goal("odd", a="?a", b="?n"), Goal("edge", a="?n", b="?b")])
    return p.query("even", a="?a", b="?b")


@query(f"WITH RECURSIVE {_FLOW}, reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a, b FROM reach")
def nonlinear_recursion(spark, sf_dir):
    """Walks made of two walks: the rounds are as many as the logarithm of the longest."""
    p = Program({"edge": _flow(spark, sf_dir)})
    p.rule("reach", ["a", "b"], [Goal("edge", a="?a", b="?b")])
    p.rule("reach", ["a", "b"], [Goal("reach", a="?a", b="?n"), Goal("reach", a="?n", b="?b")])
    return p.query("reach", a="?a", b="?b")


@query("SELECT c_custkey AS c, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN '0,1' WHEN c_acctbal < 0 THEN '0' ELSE '1' END AS rules FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def rule_lineage(spark, sf_dir):
    """Which clauses each derived row follows from."""
    p = Program({"customer": Tables(spark, sf_dir).customer})
    p.rule("watch", ["c"], [Goal("customer", c_custkey="?c", c_acctbal="?b"), Where("b", test=lambda b: b < 0)])
    p.rule("watch", ["c"], [Goal("customer", c_custkey="?c", c_mktsegment="BUILDING")])
    return p.lineage("watch").select("c", F.array_join("_rules", ",").alias("rules"))


@query("SELECT user_id, CASE WHEN p AND n THEN 'both' WHEN p THEN 'proved' WHEN n THEN 'disproved' ELSE 'unknown' END AS truth FROM (SELECT user_id, bool_or(event_type = 'purchase' AND value > 150) AS p, bool_or(event_type = 'error' AND value > 150) AS n FROM events GROUP BY 1)")
def prove_contrary(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    p = Program({"event": e})
    for name, kind in (("buyer", "purchase"), ("loser", "error")):
        p.rule(name, ["user_id"], [Goal("event", user_id="?user_id", event_type=kind, value="?v"), Where("v", test=lambda v: v > 150, ordered=("v",))])
    p.contrary("buyer", "loser")
    return p.prove("buyer", e.select("user_id").distinct())


@query("SELECT user_id, CASE WHEN p > 0 THEN 'proved' ELSE 'unknown' END AS truth, round(least(s, 1 - o), 9) AS degree, CAST(0.7 AS DOUBLE) AS probability, round(s, 9) AS similarity FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, coalesce(max(CASE WHEN event_type = 'purchase' THEN greatest(least(value / 1000, 1.0), 0.0) * 0.9 END), 0) AS s, coalesce(max(CASE WHEN event_type = 'error' THEN greatest(least(value / 1000, 1.0), 0.0) * 0.9 END), 0) AS o FROM events GROUP BY 1)")
def decide_with_profile(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    asked, bought = e.select("user_id").distinct(), e.where("event_type = 'purchase'").select("user_id")
    profile = {"name": "plain", "conjunction": "minimum", "disjunction": "maximum", "evidence_aggregation": "maximum", "negation": "one_minus"}
    out = decide(asked, ["user_id"], bought, asked.limit(0), _evidence(spark, sf_dir), profile, 0.7, F.col("support"))
    return out.select("user_id", "truth", _r("degree", 9).alias("degree"), F.col("probability").cast("decimal(2,1)").cast("double").alias("probability"), _r("similarity", 9).alias("similarity"))


# --- comparison ----------------------------------------------------------------------------

#: Score of two scalars of one kind, and of texts, as SQL.
_TEXT = "(0.25 + 0.75 * (CASE WHEN {a} = {b} THEN 1 WHEN lower({a}) = lower({b}) THEN 0.95 ELSE 0.65 * (1 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b}))) END))"
_NUM = "(0.25 + 0.75 * greatest(0, 1 - abs({a} - {b}) / greatest(abs({a}), abs({b}), 1e-9)))"


def _part_pairs(spark, sf_dir, left, right):
    """Parts beside the next part, each as a struct."""
    p = Tables(spark, sf_dir).part
    a, b = p.select("p_partkey", F.struct(*left).alias("a")), p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.struct(*right).alias("b"))
    return a.join(b, "p_partkey")


_RENAMED = f"0.25 + 0.75 * (({_NUM.format(a='a.p_size', b='b.p_size')} * 0.8 + 0.2 * (1 - 1 / 6)) + {_TEXT.format(a='a.p_type', b='b.p_type')}) / 2"


@query(f"SELECT a.p_partkey, round({_RENAMED} + 1e-9, 6) AS similarity, round({_RENAMED} + 1e-9, 6) >= 0.8 AS matched FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def renamed_fields(spark, sf_dir):
    """A field under another spelling is compared, and its name counts."""
    pairs = _part_pairs(spark, sf_dir, [F.col("p_size").alias("colour"), "p_type"], [F.col("p_size").alias("color"), "p_type"])
    out = compare.compare_pairs(pairs, "a", "b")
    score = _r(F.col("similarity") + 1e-9)  # off the middle between two roundings
    return out.select("p_partkey", score.alias("similarity"), (score >= 0.8).alias("matched"))


_EXACT = f"0.25 / 2 + 0.75 * {_TEXT.format(a='a.p_type', b='b.p_type')}"


@query(f"SELECT a.p_partkey, round({_EXACT}, 9) AS similarity, a.p_type = b.p_type AS same, CASE WHEN a.p_type = b.p_type THEN 'removed:colour,added:color' ELSE 'removed:colour,added:color,p_type.changed_value' END AS differences, 0 AS exact, CAST(0.5 AS DOUBLE) AS structure FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def compare_properties(spark, sf_dir):
    pairs = _part_pairs(spark, sf_dir, [F.col("p_size").alias("colour"), "p_type"], [F.col("p_size").alias("color"), "p_type"])
    out = compare.property_difference(compare.compare_properties(pairs, "a", "b").select("p_partkey", "a", "b", "similarity"), "a", "b")
    t = pairs.schema["a"].dataType, pairs.schema["b"].dataType
    exact, structure = (compare.scored(F.col("a"), F.col("b"), *t, how, "exact")[0] for how in ("exact_recursive", "structural"))
    return out.select("p_partkey", _r("similarity", 9).alias("similarity"), (F.size("differences") == 2).alias("same"), F.array_join("differences", ",").alias("differences"), exact.cast("int").alias("exact"), structure.cast("decimal(2,1)").cast("double").alias("structure"))


_BOTH = f"(0.25 + 0.75 * ({_NUM.format(a='a.p_size', b='b.p_size')} + {_TEXT.format(a='a.p_type', b='b.p_type')}) / 2)"


@query(f"SELECT a.p_partkey, round({_BOTH}, 9) >= 0.9 AS near, round({_BOTH}, 9) >= 0.7 AS matched, CASE WHEN round({_BOTH}, 9) >= 0.7 THEN '' ELSE 'threshold_not_met' END AS failed, round(1 - {_BOTH} + 1e-9, 6) AS difference FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def match_pattern(spark, sf_dir):
    pairs = _part_pairs(spark, sf_dir, ["p_size", "p_type"], ["p_size", "p_type"])
    t = pairs.schema["a"].dataType
    why = compare.match_pattern(pairs, "a", "b", 0.7 - 5e-10).select("p_partkey", "a", "b", F.col("failed").alias("why"))
    found = compare.semantic_unify(why, "a", "b", 0.7 - 5e-10).select("p_partkey", "a", "b", "why", "unified")
    differ = compare.check_difference(found, "a", "b")
    return differ.select("p_partkey", compare.are_similar(F.col("a"), F.col("b"), t, threshold=0.9 - 5e-10).alias("near"), F.col("unified").alias("matched"), F.array_join("why", ",").alias("failed"), _r(F.col("difference") + 1e-9).alias("difference"))


@query(f"SELECT a.p_partkey FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE round({_BOTH}, 9) >= 0.8")
def near_pairs(spark, sf_dir):
    return compare.RULES["Near"](_part_pairs(spark, sf_dir, ["p_size", "p_type"], ["p_size", "p_type"]), "a", "b", 0.8 - 5e-10).select("p_partkey")


@query(f"SELECT a.p_partkey, round({_BOTH}, 9) AS property_similarity, round(0.75 * {_BOTH} + CASE WHEN a.p_brand = b.p_brand THEN 0.25 ELSE 0 END, 9) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def compare_facts(spark, sf_dir):
    """Names don't count, a common family does: here, a brand."""
    fields = ["p_size", "p_type", F.col("p_name").alias("name"), F.col("p_brand").alias("_type")]
    pairs = _part_pairs(spark, sf_dir, fields, fields)
    out = compare.compare_facts(pairs, "a", "b", F.col("a._type") == F.col("b._type"))
    return out.select("p_partkey", _r("property_similarity", 9).alias("property_similarity"), _r("similarity", 9).alias("similarity"))


@query("SELECT l, r, CAST(score AS DOUBLE) AS score FROM (VALUES ('address.city', 'home.city', 1.0), ('id', 'id', 1.0), ('pay', 'wages', 0.4), ('tags', 'tag', 0.8125)) t(l, r, score)")
def align_fields(spark, sf_dir):
    from pyspark.sql.types import StructType

    left = StructType.fromDDL("id bigint, address struct<city: string>, tags array<string>, pay double")
    right = StructType.fromDDL("id bigint, home struct<city: string>, tag array<string>, wages double")
    return spark.createDataFrame([(a, b, round(s, 9)) for a, b, s in compare.align_fields(left, right)], "l string, r string, score double")


@query("SELECT n_nationkey, n_regionkey = 1 AS found, CASE WHEN n_regionkey = 1 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'home' ELSE 'seen[1]' END END AS path FROM nation")
def contains_subfact(spark, sf_dir):
    """A record is found within records and arrays, the nearest first."""
    place = lambda r: F.struct(r.alias("region"))
    even = F.col("n_nationkey") % 2 == 0
    own, none = place(F.col("n_regionkey")), place(F.lit(-1).cast("int"))
    fact = F.struct(F.when(even, own).otherwise(none).alias("home"), F.array(none, own).alias("seen"))
    df = Tables(spark, sf_dir).nation.select("n_nationkey", fact.alias("fact"), place(F.lit(1).cast("int")).alias("asked"))
    return compare.contains_subfact(df, "fact", "asked").select("n_nationkey", "found", "path")


@query("SELECT n_nationkey AS id, path, type, depth FROM nation CROSS JOIN (VALUES ('home', 'Place', 1), ('seen[0]', 'Place', 2), ('seen[1]', 'Region', 2)) t(path, type, depth)")
def nearest_subfacts(spark, sf_dir):
    place = lambda t: F.struct(F.lit(t).alias("_type"), F.col("n_regionkey").alias("region"))
    df = Tables(spark, sf_dir).nation.select("n_nationkey", F.struct(place("Place").alias("home"), F.array(place("Place"), place("Region")).alias("seen")).alias("fact"))
    return compare.nearest_subfacts(df, "fact", "n_nationkey")


@query("SELECT p_partkey AS input, (SELECT count(*) FROM part) AS candidate_count, (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand) AS matched_candidate_count, (SELECT count(*) FROM part b WHERE b.p_brand <> a.p_brand) AS rejected_count, least(3, (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand)) AS returned FROM part a WHERE p_partkey % 20 = 0")
def nearest_counters(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return compare.nearest_counts(p.where(F.col("p_partkey") % 20 == 0), p, "p_partkey", 3, ["p_brand"])


# --- relations -------------------------------------------------------------------------------


def trade(spark, sf_dir) -> FactSession:
    """Customers and suppliers below Party, nations apart; parties tell nations where they are."""
    t, s = Tables(spark, sf_dir), FactSession(spark)
    s.register("Party")
    s.register("Customer", t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), (F.col("c_nationkey") % 5).alias("region")), ["Party"])
    s.register("Supplier", t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit(9).alias("region")), ["Party"])
    s.register("Nation", t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")))
    return s


def _party_pairs(spark, sf_dir):
    """Every party with the nation of its number modulo 25."""
    t = Tables(spark, sf_dir)
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("l"), F.concat(F.lit("n"), (F.col("c_custkey") % 25).cast("string")).alias("r"))
    return c.unionByName(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("l"), F.concat(F.lit("n"), (F.col("s_suppkey") % 25).cast("string")).alias("r")))


_PARTY = "p AS (SELECT 'c' || c_custkey AS l, 'n' || (c_custkey % 25) AS r, c_nationkey AS nation, c_nationkey % 5 AS region, c_custkey AS k, 'Customer' AS t FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || (s_suppkey % 25), s_nationkey, 9, s_suppkey, 'Supplier' FROM supplier), q AS (SELECT p.*, n_nationkey AS nn, n_regionkey AS nr FROM p JOIN nation ON p.r = 'n' || n_nationkey)"
_STATE = "CASE WHEN nation = nn AND region = nr THEN 'exact-member' WHEN nation = nn OR region = nr THEN 'partial-member' ELSE 'conflicting' END"


@query(f"WITH {_PARTY} SELECT l, r, {_STATE} AS state, round(0.25 + 0.75 * ({_NUM.format(a='nation', b='nn')} + {_NUM.format(a='region', b='nr')}) / 2, 9) AS property, 0 AS ancestor FROM q")
def relation_structural(spark, sf_dir):
    """Without methods, members are compared with the target's fields."""
    out = relation.relate(trade(spark, sf_dir), _party_pairs(spark, sf_dir), "Party", "Nation", "id", "id")
    return out.select("l", "r", "state", _r("evidence.propertySimilarity", 9).alias("property"), F.col("evidence.ancestorSimilarity").cast("int").alias("ancestor"))


@query(f"WITH {_PARTY} SELECT l, r, t AS membership, CASE WHEN t = 'Supplier' AND k % 2 = 0 THEN 'incomparable' WHEN t = 'Customer' AND k % 3 = 0 THEN 'unresolved' WHEN nation = nn THEN 'native' ELSE 'foreign:' || CASE WHEN t = 'Supplier' THEN 'conflicting' ELSE 'conflicting' END END AS state FROM q")
def relation_methods(spark, sf_dir):
    """The most specific membership speaks, the target's family reads, nil and unmet dependencies show."""
    s = trade(spark, sf_dir)
    relation.membership(s, "Party", "Nation", lambda x: {"nation": x.region})
    relation.membership(s, "Customer", "Nation", lambda x: {"nation": x.nation})
    even = lambda x: F.substring(x.id, 2, 20).cast("int") % 2 == 0
    relation.membership(s, "Supplier", "Nation", lambda x: F.when(~even(x), relation.members({"nation": x.nation})))
    relation.interpretation(s, "Nation", lambda known, state, target: F.when(state.isin("exact-member", "subset-member"), "native").otherwise(F.concat(F.lit("foreign:"), state)))
    needs = relation.dependency(s.scan("Customer"), "id", F.substring("id", 2, 20).cast("int") % 3 != 0)
    return relation.relate(s, _party_pairs(spark, sf_dir), "Party", "Nation", "id", "id", needs).select("l", "r", "membership", "state")


@query("""WITH RECURSIVE d AS (SELECT c_custkey AS src, c_nationkey AS dst FROM customer), up AS (SELECT n_nationkey AS src, 100 + n_regionkey AS dst FROM nation),
f AS (SELECT src, dst, 1 AS k FROM d UNION ALL SELECT d.src, up.dst, 2 FROM d JOIN up ON d.dst = up.src) SELECT src AS start, dst AS node, k AS depth FROM f""")
def relationship_paths(spark, sf_dir):
    """Edges of one name are followed to a depth; others are pruned."""
    t = Tables(spark, sf_dir)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    home = t.customer.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit("home").alias("name"))
    above = t.nation.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("home").alias("name"))
    noise = t.customer.select(key("c", "c_custkey").alias("src"), F.lit("r0").alias("dst"), F.lit("noise").alias("name"))
    found = relation.related(home.unionByName(above).unionByName(noise), t.customer.select(key("c", "c_custkey").alias("start")), 3, "home")
    number = F.substring("node", 2, 20).cast("int") + F.when(F.col("node").startswith("r"), 100).otherwise(0)
    return found.select(F.substring("start", 2, 20).cast("bigint").alias("start"), number.alias("node"), "depth")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') AND value < 3 AND user_id IN (SELECT user_id FROM events WHERE event_type IN ('click', 'purchase') AND value < 3 GROUP BY 1 HAVING count(DISTINCT event_type) < 2) GROUP BY 1")
def set_symmetric_difference_by(spark, sf_dir):
    found = sets.symmetric_difference_by(["user_id"], *user_sets(spark, sf_dir, "click", "purchase", columns=("user_id", "event_id")))
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value < 3), b AS (SELECT DISTINCT user_id FROM events WHERE value < 3) SELECT (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS equals, NOT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM b) AS subset, NOT EXISTS (SELECT * FROM b EXCEPT SELECT * FROM a) AS superset, false AS disjoint")
def set_relations_by(spark, sf_dir):
    (a,) = user_sets(spark, sf_dir, "click", columns=("user_id", "event_id"))
    return sets.relations(a, Tables(spark, sf_dir).events.where("value < 3").select("user_id", "event_id"), ["user_id"])


# --- hierarchies with several parents --------------------------------------------------------


def part_edges(spark, sf_dir):
    """Parts below their brand and their type, brands and types below kinds: each part has two parents, many pairs have several common ancestors."""
    p = Tables(spark, sf_dir).part
    own = p.select(F.concat(F.lit("p"), "p_partkey").alias("child"), F.explode(F.array("p_brand", "p_type")).alias("parent"))
    return own.unionByName(p.select(F.col("p_brand").alias("child"), F.lit("brand").alias("parent")).distinct()).unionByName(p.select(F.col("p_type").alias("child"), F.lit("type").alias("parent")).distinct())


def _part_neighbours(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(F.concat(F.lit("p"), "p_partkey").alias("l"), F.concat(F.lit("p"), (F.col("p_partkey") + 1).cast("string")).alias("r"))


_ANCESTORS = "g AS (SELECT 'p' || a.p_partkey AS l, 'p' || b.p_partkey AS r, a.p_brand = b.p_brand AS sb, a.p_type = b.p_type AS st, a.p_brand AS brand, a.p_type AS type FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), c AS (SELECT l, r, 'brand' AS ancestor, 4 AS distance, NOT sb AS lowest, true AS highest FROM g UNION ALL SELECT l, r, 'type', 4, NOT st, true FROM g UNION ALL SELECT l, r, brand, 2, true, false FROM g WHERE sb UNION ALL SELECT l, r, type, 2, true, false FROM g WHERE st)"


@query(f"WITH {_ANCESTORS} SELECT l, r, ancestor FROM c")
def common_ancestors(spark, sf_dir):
    return hierarchy.common_ancestors(_part_neighbours(spark, sf_dir), hierarchy.closure(part_edges(spark, sf_dir)))


@query(f"WITH {_ANCESTORS} SELECT * FROM c")
def ancestor_analysis(spark, sf_dir):
    """Several lowest and several highest common ancestors of one pair."""
    return hierarchy.ancestor_analysis(_part_neighbours(spark, sf_dir), hierarchy.closure(part_edges(spark, sf_dir)))


@query("SELECT 'p' || p_partkey AS descendant, p_type AS ancestor, true AS holds FROM part UNION ALL SELECT 'p' || p_partkey, 'Brand#11', p_brand = 'Brand#11' FROM part UNION ALL SELECT 'brand', 'brand', true")
def is_ancestor(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    own = F.concat(F.lit("p"), "p_partkey").alias("descendant")
    asked = p.select(F.col("p_type").alias("ancestor"), own).unionByName(p.select(F.lit("Brand#11").alias("ancestor"), own)).unionByName(spark.createDataFrame([("brand", "brand")], "ancestor string, descendant string"))
    return hierarchy.is_ancestor(asked, hierarchy.closure(part_edges(spark, sf_dir))).select("descendant", "ancestor", "holds")


@query("SELECT 'p' || p_partkey AS child, 'Brand#11' AS parent, p_brand = 'Brand#11' AS holds FROM part UNION ALL SELECT 'p' || p_partkey, 'brand', false FROM part")
def direct_relation(spark, sf_dir):
    own = F.concat(F.lit("p"), "p_partkey").alias("child")
    p = Tables(spark, sf_dir).part
    asked = p.select(own, F.lit("Brand#11").alias("parent")).unionByName(p.select(own, F.lit("brand").alias("parent")))
    return hierarchy.direct_relation(asked, part_edges(spark, sf_dir)).select("child", "parent", "holds")


@query("SELECT 'p' || a.p_partkey AS l, 'p' || b.p_partkey AS r, CASE WHEN a.p_brand = b.p_brand THEN a.p_brand WHEN a.p_type = b.p_type THEN a.p_type ELSE 'brand' END AS ancestor, CASE WHEN a.p_brand = b.p_brand OR a.p_type = b.p_type THEN 2 ELSE 4 END AS distance, CASE WHEN a.p_brand = b.p_brand THEN 'p' || a.p_partkey || '>' || a.p_brand || '>p' || b.p_partkey WHEN a.p_type = b.p_type THEN 'p' || a.p_partkey || '>' || a.p_type || '>p' || b.p_partkey ELSE 'p' || a.p_partkey || '>' || a.p_brand || '>brand>' || b.p_brand || '>p' || b.p_partkey END AS path, CASE WHEN a.p_brand = b.p_brand OR a.p_type = b.p_type THEN 'parent,child' ELSE 'parent,parent,child,child' END AS kinds FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def shortest_path(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    last = p.agg(F.max("p_partkey")).first()[0]
    pairs = _part_neighbours(spark, sf_dir).where(F.col("l") != f"p{last}")
    return hierarchy.shortest_path(pairs, part_edges(spark, sf_dir)).select("l", "r", "ancestor", "distance", F.array_join("path", ">").alias("path"), F.array_join("edge_types", ",").alias("kinds"))


@query("SELECT n_nationkey, 'EVERYWHERE' AS n_name, 7 AS n_regionkey FROM nation WHERE n_regionkey = 1")
def propagate_fact(spark, sf_dir):
    own = Tables(spark, sf_dir).nation.where("n_regionkey = 1")
    return hierarchy.propagate({"n_name": "EVERYWHERE", "n_regionkey": 7, "n_nationkey": 0}, ["n_name", "n_regionkey"], own)


@query("SELECT a.s_suppkey AS k, CASE WHEN a.s_nationkey = b.s_nationkey THEN 'n' || a.s_nationkey WHEN x.n_regionkey = y.n_regionkey THEN 'r' || x.n_regionkey ELSE 'world' END AS _type FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 JOIN nation x ON x.n_nationkey = a.s_nationkey JOIN nation y ON y.n_nationkey = b.s_nationkey")
def common_ancestor_fact(spark, sf_dir):
    """A generalised fact has the type of the nearest declared ancestor."""
    s = Tables(spark, sf_dir).supplier
    own = lambda k: s.select(k.alias("k"), F.concat(F.lit("n"), "s_nationkey").alias("_type"), "s_name")
    closed = hierarchy.closure(place_edges(spark, sf_dir))
    left, right = own(F.col("s_suppkey")), own(F.col("s_suppkey") - 1)
    pairs = left.select("k", F.col("_type").alias("l")).join(right.select("k", F.col("_type").alias("r")), "k").select("l", "r").distinct()
    return hierarchy.generalised(left, right, ["k"], ["s_name"], hierarchy.lowest_common_ancestors(pairs, closed)).select("k", "_type")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-25'")
def scheduled_facts(spark, sf_dir):
    return temporal.scheduled(Tables(spark, sf_dir).events, "ts", F.lit("2024-01-25").cast("timestamp_ntz")).select("event_id")


@query("SELECT user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1")
def current_without_predictions(spark, sf_dir):
    """Predicted rows (here, errors) are never current."""
    e = Tables(spark, sf_dir).events.withColumn("provenance", F.when(F.col("event_type") == "error", "predicted"))
    return temporal.current(e, "user_id", "ts", "event_id", F.lit("2030-01-01").cast("timestamp_ntz"), "provenance").select("user_id", "event_id")


# --- rows, lists, plots -------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) AS BIGINT) AS place FROM part QUALIFY place BETWEEN 11 AND 30")
def sorted_page(spark, sf_dir):
    """A page of sorted rows, with each row's place in it."""
    page = rows.sort_rows(Tables(spark, sf_dir).part, "p_size", "desc", "p_partkey").offset(10).limit(20)
    return temporal.rank(page, "p_size", "p_size", "p_partkey").select("p_partkey", "p_name", (F.col("rank") + 10).alias("place"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'NEW' UNION ALL SELECT 51, NULL")
def add_rows(spark, sf_dir):
    r = Tables(spark, sf_dir).region
    more = rows.add_rows(r, spark.createDataFrame([(50, "NEW")], r.schema))
    return rows.add_rows(more, spark.createDataFrame([(51,)], "r_regionkey int"))


@query("SELECT p_partkey FROM part WHERE p_size = 7 AND p_type = 'PROMO'")
def find_many(spark, sf_dir):
    """A number equals the text of it."""
    return rows.find_many(Tables(spark, sf_dir).part, p_size="7", p_type="PROMO").select("p_partkey")


@query("SELECT n_name AS value, 'get' AS how FROM nation WHERE n_regionkey = 2 AND n_nationkey = (SELECT min(n_nationkey) + 0 FROM nation WHERE n_regionkey = 2) UNION ALL SELECT n_name, 'label' FROM nation WHERE n_name = 'NATION_8' UNION ALL SELECT n_name, 'second' FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) WHERE n_regionkey = 2 AND k = 2")
def list_library(spark, sf_dir):
    from pyspark.sql import Window

    n = Tables(spark, sf_dir).nation
    place = (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("pos")
    items = n.select(F.col("n_regionkey").cast("string").alias("list"), place, F.col("n_name").alias("label"), F.col("n_name").alias("value"))
    named = lambda df, how: df.select("value", F.lit(how).alias("how"))
    label = n.where("n_name = 'NATION_8'").select(F.col("n_regionkey").cast("string")).first()
    by_label = lists.get(items, label[0], label="NATION_8") if label else items.limit(0).select("value")
    return named(lists.first(items, "2"), "get").unionByName(named(by_label, "label")).unionByName(named(lists.first(lists.pop(items, "2")[1], "2"), "second"))


@query("SELECT n_name AS \"from\", CAST(n_regionkey AS VARCHAR) AS \"to\", 'in' AS label FROM nation")
def graph_edges(spark, sf_dir):
    return stats.graph(Tables(spark, sf_dir).nation.withColumn("l", F.lit("in")), "n_name", "n_regionkey", "l")[1]


@query("SELECT c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer")
def scatter_points(spark, sf_dir):
    return stats.points(Tables(spark, sf_dir).customer, "c_acctbal", "c_nationkey")


@query("SELECT n_name AS category, CAST(n_regionkey AS DOUBLE) AS value FROM nation")
def bars_from_fact_type(spark, sf_dir):
    s = FactSession(spark)
    s.register("Nation", Tables(spark, sf_dir).nation)
    return stats.from_fact_type(s, "Nation", "bar", "n_name", "n_regionkey")


# --- lexical graph over tables ----------------------------------------------------------------------


def place_lexicon(spark, sf_dir) -> lexicon.Lexicon:
    """Places as synsets: suppliers below nations below regions below the world; names in two languages, gloss and frequency from the tables."""
    t = Tables(spark, sf_dir)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    synset = t.supplier.select(key("s", "s_suppkey").alias("id")).unionByName(t.nation.select(key("n", "n_nationkey").alias("id"))).unionByName(t.region.select(key("r", "r_regionkey").alias("id"))).unionByName(spark.createDataFrame([("world",), ("alone",)], "id string")).withColumn("pos", F.lit("n"))
    lemma = t.nation.select(key("l", "n_nationkey").alias("id"), F.lower("n_name").alias("text"), F.lit("en").alias("language"))
    lemma = lemma.unionByName(t.nation.select(key("d", "n_nationkey").alias("id"), F.concat(F.lit("de_"), F.lower("n_name")).alias("text"), F.lit("de").alias("language")))
    # a nation's English name also names its region, less often
    sense = t.nation.select(key("x", "n_nationkey").alias("id"), key("l", "n_nationkey").alias("lemma"), key("n", "n_nationkey").alias("synset"), F.lit(9).alias("frequency"))
    sense = sense.unionByName(t.nation.select(key("y", "n_nationkey").alias("id"), key("l", "n_nationkey").alias("lemma"), key("r", "n_regionkey").alias("synset"), F.lit(2).alias("frequency")))
    sense = sense.unionByName(t.nation.select(key("z", "n_nationkey").alias("id"), key("d", "n_nationkey").alias("lemma"), key("n", "n_nationkey").alias("synset"), F.lit(5).alias("frequency")))
    gloss = t.nation.select(key("n", "n_nationkey").alias("synset"), F.lower(F.concat(F.lit("a land called "), "n_name")).alias("text")).unionByName(t.region.select(key("r", "r_regionkey").alias("synset"), F.lower(F.concat(F.lit("a wide region called "), "r_name")).alias("text")))
    example = t.region.select(key("r", "r_regionkey").alias("synset"), F.lit("many lands lie in this region").alias("text"))
    exception = t.nation.select(F.concat(F.lower("n_name"), F.lit("land")).alias("surface"), F.lower("n_name").alias("lemma"))
    frequency = t.customer.groupBy(key("n", "c_nationkey").alias("synset")).agg(F.count(F.lit(1)).cast("int").alias("count"))
    return lexicon.Lexicon(synset, lemma, sense, gloss, example, exception, frequency, place_edges(spark, sf_dir))


@query("SELECT lower(n_name) AS text, 'n' || n_nationkey AS synset, 9 AS frequency, 'n' AS pos FROM nation WHERE n_nationkey = 3 UNION ALL SELECT lower(n_name), 'r' || n_regionkey, 2, 'n' FROM nation WHERE n_nationkey = 3")
def lexicon_lookup(spark, sf_dir):
    name = Tables(spark, sf_dir).nation.where("n_nationkey = 3").first()["n_name"]
    return lexicon.RULES["WordNetLookup"](place_lexicon(spark, sf_dir), name).select("text", "synset", "frequency", "pos")


@query("SELECT n_name AS word, lower(n_name) AS lemma FROM nation UNION ALL SELECT n_name || 's', lower(n_name) FROM nation UNION ALL SELECT n_name || 'LAND', lower(n_name) FROM nation")
def lexicon_lemmas(spark, sf_dir):
    n = Tables(spark, sf_dir).nation
    words = n.select(F.explode(F.array("n_name", F.concat("n_name", F.lit("s")), F.concat("n_name", F.lit("LAND")))).alias("word"))
    return place_lexicon(spark, sf_dir).lemmatize(words)


@query("SELECT 's1' AS start, 'n' || s_nationkey AS node, 1 AS depth FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT 's1', 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1 UNION ALL SELECT 's1', 'world', 3")
def lexicon_ancestors(spark, sf_dir):
    return lexicon.RULES["WordNetAncestors"](place_lexicon(spark, sf_dir), "s1").select("start", "node", "depth")


@query("SELECT 'r1' AS start, 'n' || n_nationkey AS node, 1 AS depth FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'r1', 's' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def lexicon_descendants(spark, sf_dir):
    return lexicon.RULES["WordNetDescendants"](place_lexicon(spark, sf_dir), "r1").select("start", "node", "depth")


_SYN = f"k AS (SELECT count(*) AS t FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region)), f AS (SELECT 'n' || c_nationkey AS s, count(*) AS c FROM customer GROUP BY 1), tot AS (SELECT (SELECT sum(c) FROM f) + t + 2 AS t FROM k)"
_IC = "icn AS (SELECT n_nationkey AS n, n_regionkey AS r, -ln((coalesce(c, 0) + 1) / t) AS ic FROM nation LEFT JOIN f ON s = 'n' || n_nationkey CROSS JOIN tot), icr AS (SELECT n_regionkey AS r, -ln((sum(coalesce(c, 0)) + 1) / max(t)) AS ic FROM nation LEFT JOIN f ON s = 'n' || n_nationkey CROSS JOIN tot GROUP BY 1), icw AS (SELECT -ln(((SELECT sum(c) FROM f) + 1) / t) AS ic FROM tot)"


@query(f"""WITH {_SYN}, {_IC}, q AS (SELECT a.n AS x, b.n AS y, a.r = b.r AS same, a.ic AS ia, b.ic AS ib, CASE WHEN a.r = b.r THEN icr.ic ELSE icw.ic END AS ic, CASE WHEN a.r = b.r THEN 'r' || a.r ELSE 'world' END AS lcs FROM icn a JOIN icn b ON b.n = a.n + 1 JOIN icr ON icr.r = a.r CROSS JOIN icw)
SELECT 'n' || x AS l, 'n' || y AS r, lcs, CASE WHEN same THEN 2 ELSE 4 END AS distance, round(CASE WHEN same THEN 1 / 3 ELSE 1 / 5 END, 9) AS path, round(CASE WHEN same THEN 2 * 2 / 6 ELSE 2 * 1 / 6 END, 9) AS wup, round(ic, 9) AS resnik, round(2 * ic / (ia + ib), 9) AS lin, round(1 / (ia + ib - 2 * ic + 1), 9) AS jcn, round(CASE WHEN same THEN 1 / 3 ELSE 1 / 5 END, 9) AS lch FROM q
UNION ALL SELECT 'alone', 'n1', NULL, NULL, 0, 0, 0, 0, round(1 / ((SELECT -ln(1 / t) FROM tot) + ic + 1), 9), 0 FROM icn WHERE n = 1""")
def lexicon_similarity(spark, sf_dir):
    n = Tables(spark, sf_dir).nation
    pairs = n.select(F.concat(F.lit("n"), "n_nationkey").alias("l"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string")).alias("r")).where("r <> 'n25'")
    s = place_lexicon(spark, sf_dir).similarity(pairs.unionByName(spark.createDataFrame([("alone", "n1")], "l string, r string")))
    return s.select("l", "r", "lcs", "distance", *[_r(c, 9).alias(c) for c in ("path", "wup", "resnik", "lin", "jcn", "lch")])


@query("SELECT 's' || a.s_suppkey AS l, 's' || b.s_suppkey AS r, CASE WHEN a.s_nationkey = b.s_nationkey THEN 2 WHEN x.n_regionkey = y.n_regionkey THEN 4 ELSE 6 END AS distance FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 JOIN nation x ON x.n_nationkey = a.s_nationkey JOIN nation y ON y.n_nationkey = b.s_nationkey UNION ALL SELECT 'alone', 's1', NULL")
def lexicon_distance(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    last = s.agg(F.max("s_suppkey")).first()[0]
    pairs = s.where(F.col("s_suppkey") < last).select(F.concat(F.lit("s"), "s_suppkey").alias("l"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("r"))
    return place_lexicon(spark, sf_dir).shortest_path(pairs.unionByName(spark.createDataFrame([("alone", "s1")], "l string, r string"))).select("l", "r", "distance")


@query("SELECT 'n' || x.n_nationkey AS l, 'n' || y.n_nationkey AS r, CASE WHEN x.n_regionkey = y.n_regionkey THEN 'r' || x.n_regionkey ELSE 'world' END AS ancestor, CASE WHEN x.n_regionkey = y.n_regionkey THEN 2 ELSE 1 END AS depth FROM nation x JOIN nation y ON y.n_nationkey = x.n_nationkey + 1 UNION ALL SELECT 'n' || x.n_nationkey, 'n' || y.n_nationkey, 'world', 1 FROM nation x JOIN nation y ON y.n_nationkey = x.n_nationkey + 1 WHERE x.n_regionkey = y.n_regionkey")
def lexicon_subsumers(spark, sf_dir):
    n = Tables(spark, sf_dir).nation
    pairs = n.select(F.concat(F.lit("n"), "n_nationkey").alias("l"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string")).alias("r"))
    return place_lexicon(spark, sf_dir).common_subsumers(pairs).select("l", "r", "ancestor", "depth")


@query("SELECT 'de_' || lower(n_name) AS text, 'translation' AS kind FROM nation WHERE n_nationkey = 3 UNION ALL SELECT lower(b.n_name), 'synonym' FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey = 3 AND b.n_nationkey <> 3")
def lexicon_words(spark, sf_dir):
    lex = place_lexicon(spark, sf_dir)
    name = Tables(spark, sf_dir).nation.where("n_nationkey = 3").first()["n_name"].lower()
    translated = lexicon.RULES["WordNetTranslate"](lex, name, "en", "de").select("text", F.lit("translation").alias("kind"))
    return translated.unionByName(lexicon.RULES["WordNetSynonyms"](lex, name).select("text", F.lit("synonym").alias("kind")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'n3' ELSE 'r' || (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) END AS synset, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 5 END AS overlap FROM customer")
def lexicon_senses(spark, sf_dir):
    """Of a nation's name, the nation or its region, by the words around it."""
    t = Tables(spark, sf_dir)
    name = t.nation.where("n_nationkey = 3").first()["n_name"].lower()
    contexts = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "a land so far").otherwise("a wide region, and many friends in it").alias("text"))
    return place_lexicon(spark, sf_dir).lesk(name, F.col("text"), contexts, "c_custkey")
