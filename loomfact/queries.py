"""Registered queries of the fact operators, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import degrees, scalars
from .operators import compare, hierarchy, models, rows, sets, stats, temporal
from .operators.relation import structural_state
from .plans.logic import Goal, Not, Or, Program, Where
from .plans.reasoning import decide, grade, prove, satisfied
from .registry import ORACLE, QUERIES, Tables, folder, query
from .registry import rounded as _r
from .session import FactSession, merge_labels, relation_find
from .streaming import events as streams

# --- scans ---------------------------------------------------------------------


def event_session(spark, sf_dir) -> FactSession:
    """Events as facts of a small hierarchy: Event > Visit > (click, view); Event > (purchase, signup, error); Lead > (signup, click)."""
    s, events = FactSession(spark), Tables(spark, sf_dir).events
    s.register("Event")
    s.register("Visit", parents=["Event"])
    s.register("Lead", parents=["Event"])
    types = {"click": ["Visit", "Lead"], "view": ["Visit"], "purchase": ["Event"], "signup": ["Lead"], "error": ["Event"]}
    s.register_types(events, "event_type", types, {"click": ["web"], "view": ["web"]})
    return s


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def scan_exact(spark, sf_dir):
    return event_session(spark, sf_dir).snapshot("click").select("event_id", "user_id", "value")


@query("SELECT event_type AS _type, event_id, value FROM events WHERE event_type IN ('click', 'view')")
def scan_polymorphic(spark, sf_dir):
    return event_session(spark, sf_dir).scan("Visit").select("_type", "event_id", "value")


@query("SELECT event_type AS _type, count(*) AS n FROM events GROUP BY 1")
def scan_full_population(spark, sf_dir):
    return stats.population(event_session(spark, sf_dir).scan("Event"), "_type").withColumnRenamed("type", "_type")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND value > 50")
def designation_scan(spark, sf_dir):
    return event_session(spark, sf_dir).labelled("web").where("value > 50").select("event_id", "event_type")


@query("SELECT c_nationkey, CASE WHEN bool_or(c_acctbal > 5000) AND bool_or(c_acctbal < 0) THEN 'debt,rich' WHEN bool_or(c_acctbal > 5000) THEN 'rich' ELSE 'debt' END AS labels FROM customer WHERE c_acctbal > 5000 OR c_acctbal < 0 GROUP BY 1")
def designation_merge(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    mark = lambda cond, label: c.where(cond).select("c_nationkey", F.array(F.lit(label)).alias("_labels"))
    return merge_labels(mark("c_acctbal > 5000", "rich").unionByName(mark("c_acctbal < 0", "debt"))).select("c_nationkey", F.array_join("_labels", ",").alias("labels"))


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO'")
def fact_find(spark, sf_dir):
    s = FactSession(spark)
    s.register("Part", Tables(spark, sf_dir).part)
    return s.find("Part", "p_type", "PROMO").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' ORDER BY p_partkey LIMIT 1")
def fact_first(spark, sf_dir):
    s = FactSession(spark)
    s.register("Part", Tables(spark, sf_dir).part)
    return s.first("Part", "p_type", "PROMO", "p_partkey").select("p_partkey", "p_name")


@query("SELECT count(*) AS n, count(*) > 0 AS found FROM part WHERE p_size = 7")
def fact_count_exists(spark, sf_dir):
    s = FactSession(spark)
    s.register("Part", Tables(spark, sf_dir).part)
    return s.find("Part", "p_size", 7).agg(F.count(F.lit(1)).alias("n")).select("n", (F.col("n") > 0).alias("found"))


@query("SELECT event_type AS type, max(CASE event_type WHEN 'click' THEN 'Visit,Lead' WHEN 'view' THEN 'Visit' WHEN 'signup' THEN 'Lead' ELSE 'Event' END) AS parents FROM events GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('Event', ''), ('Visit', 'Event'), ('Lead', 'Event')) t(type, parents)")
def fact_types(spark, sf_dir):
    return event_session(spark, sf_dir).types()


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN value * 2 WHEN event_type = 'view' THEN value + 1 ELSE value END AS score FROM events")
def method_dispatch(spark, sf_dir):
    s = event_session(spark, sf_dir)
    s.method("Event", "score", lambda df: df["value"])
    s.method("Visit", "score", lambda df: df["value"] + 1)
    s.method("click", "score", lambda df: df["value"] * 2)
    df = s.scan("Event")
    return df.select("event_id", s.call("score", df).alias("score"))


@query("SELECT p_partkey, p_retailprice * 2 AS double_price, p_retailprice / 10 AS tenth FROM part")
def fact_references(spark, sf_dir):
    s = FactSession(spark)
    s.register("Part", Tables(spark, sf_dir).part)
    s.reference("Part", "double_price", lambda df: df["p_retailprice"] * 2)
    s.reference("Part", "tenth", lambda df: df["p_retailprice"] / 10)
    return s.derived("Part").select("p_partkey", "double_price", "tenth")


# --- projection, filters, control --------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING'")
def filter_lambda(spark, sf_dir):
    s = FactSession(spark)
    s.register("Customer", Tables(spark, sf_dir).customer)
    return s.select_where("Customer", lambda x: scalars.both(x.c_acctbal > 1000, scalars.equal(x.c_mktsegment, F.lit("BUILDING")))).select("c_custkey", "c_name")


@query("SELECT upper(c_name) AS value FROM customer")
def map_lambda(spark, sf_dir):
    s = FactSession(spark)
    s.register("Customer", Tables(spark, sf_dir).customer)
    return s.each("Customer", lambda x: F.upper(x.c_name))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'later' END AS todo FROM orders")
def if_else_fallback(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    todo = scalars.first_success(F.when(F.col("o_orderpriority") == "1-URGENT", "now"), F.when(F.col("o_orderstatus") == "F", "done"), F.lit("later"))
    return o.select("o_orderkey", scalars.branch(F.col("o_totalprice") > 100000, F.lit("big"), F.lit("small")).alias("size"), todo.alias("todo"))


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM NULL AS is_nil, nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY' AS other FROM customer")
def nil_equality(spark, sf_dir):
    seg = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return Tables(spark, sf_dir).customer.select("c_custkey", scalars.equal(seg, F.lit(None)).alias("is_nil"), scalars.negation(scalars.equal(seg, F.lit("MACHINERY"))).alias("other"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal) * 10 + 1, 6) END AS piped FROM customer")
def then_pipeline(spark, sf_dir):
    piped = scalars.then(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), scalars.MATH["sqrt"], lambda x: x * 10, lambda x: x + 1)
    return Tables(spark, sf_dir).customer.select("c_custkey", _r(piped).alias("piped"))


# --- joins as goals ------------------------------------------------------------------


def program(spark, sf_dir) -> Program:
    t = Tables(spark, sf_dir)
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey"]}
    return Program({n: getattr(t, n) for n in keys}, keys)


@query("SELECT c_custkey AS c, n_name AS nation, o_orderkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey")
def join_conjunctive(spark, sf_dir):
    return program(spark, sf_dir).ask([Goal("customer", c_custkey="?c", c_nationkey="?k"), Goal("nation", n_nationkey="?k", n_name="?nation"), Goal("orders", o_custkey="?c", o_orderkey="?o")]).select("c", "nation", "o")


@query("SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation")
def cross_goal(spark, sf_dir):
    return program(spark, sf_dir).ask([Goal("region", r_name="?region"), Goal("nation", n_name="?nation")])


@query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey = n_regionkey")
def self_unify(spark, sf_dir):
    return program(spark, sf_dir).ask([Goal("nation", n_nationkey="?k", n_regionkey="?k")])


@query("SELECT DISTINCT s_suppkey AS s, c_custkey AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > s_acctbal + 5000")
def theta_goal(spark, sf_dir):
    goals = [Goal("supplier", s_suppkey="?s", s_nationkey="?n", s_acctbal="?x"), Goal("customer", c_custkey="?c", c_nationkey="?n", c_acctbal="?y"), Where("x", "y", test=lambda x, y: y > x + 5000)]
    return program(spark, sf_dir).ask(goals).select("s", "c")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_nationkey IN (SELECT s_nationkey FROM supplier)")
def semi_depends(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return satisfied(satisfied(t.customer, ["c_custkey"], t.orders.select(F.col("o_custkey").alias("c_custkey"))), ["c_nationkey"], t.supplier.select(F.col("s_nationkey").alias("c_nationkey"))).select("c_custkey", "c_name")


@query("SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_negation(spark, sf_dir):
    return program(spark, sf_dir).ask([Goal("customer", c_custkey="?c"), Not("orders", o_custkey="?c", o_orderstatus="P")])


@query("SELECT c_custkey AS c FROM customer WHERE c_acctbal < 0 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def or_goal(spark, sf_dir):
    p = program(spark, sf_dir)
    return p.ask([Or([Goal("customer", c_custkey="?c", c_acctbal="?b"), Where("b", test=lambda b: b < 0)], [Goal("orders", o_custkey="?c", o_totalprice="?t"), Where("t", test=lambda t: t > 300000)])])


@query("SELECT c_custkey, min(o_orderkey) AS related FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1")
def relation_find_first(spark, sf_dir):
    t = Tables(spark, sf_dir)
    edges = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("src_id"), F.col("o_orderkey").alias("dst_id"), F.lit("urgent").alias("name"))
    return relation_find(t.customer, edges, "c_custkey", "urgent").select("c_custkey", "related")


@query("SELECT 'customer' AS side, count(*) AS n FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey <> 7")
def cascade_delete(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c, o = rows.delete_cascade(t.customer, t.orders, "c_custkey", "o_custkey", 7)
    side = lambda df, n: df.agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("n"))
    return side(c, "customer").unionByName(side(o, "orders"))


# --- aggregates -----------------------------------------------------------------------


def profile_by_flag(df):
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), _r(F.avg("l_extendedprice"), 4).alias("mean"), _r(F.var_pop("l_discount"), 9).alias("variance"))


@query("SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_discount), 9) AS variance FROM lineitem GROUP BY 1")
def agg_by_flag(spark, sf_dir):
    s = FactSession(spark)
    s.register("LineItem", Tables(spark, sf_dir).lineitem)
    return profile_by_flag(s.scan("LineItem"))


@query("SELECT round(sum(l_quantity), 4) AS s, round(avg(l_quantity), 6) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem")
def csv_aggregates(spark, sf_dir):
    asked = {"s": ("sum", "l_quantity"), "a": ("average", "l_quantity"), "lo": ("min", "l_quantity"), "hi": ("max", "l_quantity"), "n": ("count", None)}
    one = rows.aggregates(Tables(spark, sf_dir).lineitem, asked)
    return one.select(_r("s", 4).alias("s"), _r("a").alias("a"), "lo", "hi", "n")


@query("SELECT p_brand, min(p_partkey) AS first_seen FROM part GROUP BY 1")
def csv_distinct(spark, sf_dir):
    return rows.distinct(Tables(spark, sf_dir).part, "p_brand", "p_partkey")


@query("""SELECT 'l_quantity' AS feature, count(l_quantity) AS n, count(*) - count(l_quantity) AS missing, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 5) AS variance, round(stddev_pop(l_quantity), 6) AS stddev FROM lineitem
UNION ALL SELECT 'l_discount', count(l_discount), count(*) - count(l_discount), min(l_discount), max(l_discount), round(avg(l_discount), 6), round(var_pop(l_discount), 5), round(stddev_pop(l_discount), 6) FROM lineitem""")
def profile_facts(spark, sf_dir):
    p = stats.profile(Tables(spark, sf_dir).lineitem, ["l_quantity", "l_discount"])
    return p.select("feature", "n", "missing", "low", "high", _r("mean").alias("mean"), _r("variance", 5).alias("variance"), _r("stddev").alias("stddev"))


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS correlation, CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.75 THEN 'strong' WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM lineitem")
def correlate_facts(spark, sf_dir):
    c = stats.correlate(Tables(spark, sf_dir).lineitem, "l_quantity", "l_extendedprice")
    return c.select("n", _r("correlation").alias("correlation"), "strength")


EVENT_CLOSURE = "(VALUES ('click', 'click'), ('click', 'Visit'), ('click', 'Lead'), ('click', 'Event'), ('view', 'view'), ('view', 'Visit'), ('view', 'Event'), ('purchase', 'purchase'), ('purchase', 'Event'), ('signup', 'signup'), ('signup', 'Lead'), ('signup', 'Event'), ('error', 'error'), ('error', 'Event')) c(d, a)"


@query(f"SELECT a AS type, count(*) AS n, round(-ln(count(*) / (SELECT count(*) FROM events)), 9) AS information_content FROM events JOIN {EVENT_CLOSURE} ON event_type = d GROUP BY 1")
def frequency_ic(spark, sf_dir):
    s = event_session(spark, sf_dir)
    f = stats.frequencies(Tables(spark, sf_dir).events, s.closure(), "event_type")
    return f.select("type", "n", _r("information_content", 9).alias("information_content"))


@query("""WITH i AS (SELECT p_partkey AS id, 'p_brand=' || p_brand AS item FROM part UNION SELECT p_partkey, 'p_type=' || p_type FROM part UNION SELECT p_partkey, 'p_size=' || p_size FROM part),
u AS (SELECT count(DISTINCT id) AS u FROM i), k AS (SELECT item, count(*) AS k FROM i GROUP BY 1)
SELECT a.item AS when_item, b.item AS then_item, count(*) / max(u) AS support, round(count(*) / max(k), 9) AS confidence, count(*) AS evidence_count
FROM i a JOIN i b ON a.id = b.id AND a.item <> b.item JOIN k ON k.item = a.item CROSS JOIN u GROUP BY 1, 2 HAVING count(*) / max(u) >= 0.005""")
def associations(spark, sf_dir):
    found = stats.associations(Tables(spark, sf_dir).part, "p_partkey", ["p_brand", "p_type", "p_size"], 0.005)
    return found.withColumn("confidence", _r("confidence", 9))


@query("SELECT event_id, round(value / (SELECT sum(value) FROM events), 12) AS share FROM events")
def prob_normalize(spark, sf_dir):
    return stats.normalise(Tables(spark, sf_dir).events, "value").select("event_id", F.round("share", 12).alias("share"))


@query("SELECT round(-sum(p * ln(p)), 9) AS entropy FROM (SELECT count(*) / (SELECT count(*) FROM part) AS p FROM part GROUP BY p_type)")
def prob_entropy(spark, sf_dir):
    return stats.entropy(Tables(spark, sf_dir).part, "p_type").select(_r("entropy", 9).alias("entropy"))


@query("SELECT round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 5) AS variance, round(stddev_pop(l_quantity), 6) AS stddev, round(covar_pop(l_quantity, l_extendedprice), 2) AS covariance FROM lineitem")
def prob_moments(spark, sf_dir):
    m = stats.moments(Tables(spark, sf_dir).lineitem, "l_quantity", "l_extendedprice")
    return m.select(_r("mean").alias("mean"), _r("variance", 5).alias("variance"), _r("stddev").alias("stddev"), _r("covariance", 2).alias("covariance"))


@query("""SELECT p_partkey, round(factorial(20) / (factorial(k) * factorial(20 - k)) * pow(0.3, k) * pow(0.7, 20 - k), 9) AS binomial, round(exp(-4.5) * pow(4.5, k) / factorial(k), 9) AS poisson, round(exp(-0.5 * pow((p_size - 25) / 10.0, 2)) / (10 * sqrt(2 * pi())), 9) AS normal, CASE WHEN p_size BETWEEN 10 AND 30 THEN CAST(0.05 AS DOUBLE) ELSE 0 END AS uniform
FROM (SELECT *, CAST(p_size % 20 AS INTEGER) AS k FROM part)""")
def distributions(spark, sf_dir):
    k = (F.col("p_size") % 20).cast("int")
    return Tables(spark, sf_dir).part.select(
        "p_partkey", _r(scalars.binomial_pmf(k, F.lit(20), F.lit(0.3)), 9).alias("binomial"), _r(scalars.poisson_pmf(k, F.lit(4.5)), 9).alias("poisson"),
        _r(scalars.normal_pdf(F.col("p_size"), F.lit(25.0), F.lit(10.0)), 9).alias("normal"), scalars.uniform_pdf(F.col("p_size").cast("double"), F.lit(10.0), F.lit(30.0)).alias("uniform"),
    )


# --- time and order ----------------------------------------------------------------------


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, value DESC, event_id) AS rank FROM events")
def rank_time_priority(spark, sf_dir):
    e = Tables(spark, sf_dir).events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return temporal.rank(e, "at", "value", "event_id").select("event_id", "rank")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-20') WHERE k = 1")
def current_of_lineage(spark, sf_dir):
    return temporal.current(Tables(spark, sf_dir).events, "user_id", "ts", "event_id", F.lit("2024-01-20").cast("timestamp_ntz")).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, CAST(row_number() OVER w AS INTEGER) AS version, ts AS valid_from, lead(ts) OVER w AS valid_to FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def timeline(spark, sf_dir):
    return temporal.timeline(Tables(spark, sf_dir).events, "user_id", "ts", "event_id").select("user_id", "event_id", "version", "valid_from", "valid_to")


@query("""WITH l AS (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS k FROM events)
SELECT 'value' AS field, round(2 * max(CASE WHEN k = 1 THEN value END) - max(CASE WHEN k = 2 THEN value END), 6) AS number, NULL AS text, 'linear_trend' AS method, CAST(0.75 AS DOUBLE) AS confidence FROM l WHERE k <= 2
UNION ALL SELECT 'event_type', NULL, max(CASE WHEN k = 1 THEN event_type END), 'last_value', 0.6 FROM l WHERE k <= 2
UNION ALL SELECT NULL, NULL, NULL, 'field_wise_sequence_prediction', 0.675""")
def predict_next(spark, sf_dir):
    p = models.predict_next(Tables(spark, sf_dir).events, "event_id", ["value", "event_type"])
    number = F.col("method") == "linear_trend"
    return p.select("field", _r(F.when(number, F.col("predicted").cast("double"))).alias("number"), F.when(~number, F.col("predicted")).alias("text"), "method", _r("confidence", 9).alias("confidence"))


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_partkey")
def sort_rows(spark, sf_dir):
    return rows.sort_rows(Tables(spark, sf_dir).part, "p_size", "desc", "p_partkey").select("p_partkey", "p_name", "p_size")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_type), 'prom')")
def search_rows(spark, sf_dir):
    return rows.search_rows(Tables(spark, sf_dir).part, "p_type", "ProM").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25 OFFSET 50")
def paginate(spark, sf_dir):
    return rows.paginate(Tables(spark, sf_dir).part, 50, 25, "p_partkey").select("p_partkey", "p_name")


# --- sets and groups ----------------------------------------------------------------------


def user_sets(spark, sf_dir, *types, columns=("user_id",)):
    """Users with a rather small event of each type: sets that overlap, none of which has all."""
    e = Tables(spark, sf_dir).events.where("value < 3")
    return [e.where(F.col("event_type") == t).select(*columns) for t in types]


def _of(t: str, columns: str = "user_id") -> str:
    return f"SELECT {columns} FROM events WHERE event_type = '{t}' AND value < 3"


@query(f"{_of('click')} UNION {_of('view')}")
def set_union(spark, sf_dir):
    return sets.union(*user_sets(spark, sf_dir, "click", "view"))


@query(f"{_of('click')} INTERSECT {_of('view')} INTERSECT {_of('purchase')}")
def set_intersection(spark, sf_dir):
    return sets.intersection(*user_sets(spark, sf_dir, "click", "view", "purchase"))


@query(f"{_of('click')} EXCEPT {_of('purchase')}")
def set_difference(spark, sf_dir):
    return sets.difference(*user_sets(spark, sf_dir, "click", "purchase"))


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value < 3 GROUP BY 1 HAVING count(DISTINCT event_type) < 3")
def set_symmetric_difference(spark, sf_dir):
    return sets.symmetric_difference(*user_sets(spark, sf_dir, "click", "view", "purchase"))


@query(f"SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND value < 3 AND user_id IN ({_of('click')}) AND user_id IN ({_of('purchase')})")
def set_intersection_by(spark, sf_dir):
    return sets.intersection_by(["user_id"], *user_sets(spark, sf_dir, "click", "purchase", columns=("user_id", "event_type")))


@query(f"SELECT DISTINCT user_id, event_type FROM events WHERE event_type = 'click' AND value < 3 AND user_id NOT IN ({_of('purchase')})")
def set_difference_by(spark, sf_dir):
    return sets.difference_by(["user_id"], *user_sets(spark, sf_dir, "click", "purchase", columns=("user_id", "event_type")))


@query(f"SELECT NOT EXISTS ({_of('click')} EXCEPT {_of('view')}) AND NOT EXISTS ({_of('view')} EXCEPT {_of('click')}) AS equals, NOT EXISTS ({_of('click')} EXCEPT {_of('view')}) AS subset, NOT EXISTS ({_of('view')} EXCEPT {_of('click')}) AS superset, NOT EXISTS ({_of('click')} INTERSECT {_of('view')}) AS disjoint")
def set_relations(spark, sf_dir):
    return sets.relations(*user_sets(spark, sf_dir, "click", "view"))


@query("SELECT count(*) AS cardinality, max(user_id = 5) AS contains FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value < 3)")
def set_cardinality_contains(spark, sf_dir):
    (s,) = user_sets(spark, sf_dir, "click")
    return sets.cardinality(s).crossJoin(sets.contains(s, user_id=5))


@query("""WITH t AS (SELECT a.r_regionkey AS l, b.r_regionkey AS r, (a.r_regionkey + b.r_regionkey) % 5 AS p FROM region a CROSS JOIN region b), m AS (SELECT l AS x FROM t UNION SELECT r FROM t),
e AS (SELECT x FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE (t.l = m.x AND t.p <> t.r) OR (t.r = m.x AND t.p <> t.l))),
c AS (SELECT NOT EXISTS (SELECT 1 FROM t WHERE p NOT IN (SELECT x FROM m)) AS closed,
NOT EXISTS (SELECT 1 FROM t ab JOIN t q ON q.l = ab.p JOIN t bc ON bc.l = ab.r AND bc.r = q.r JOIN t w ON w.l = ab.l AND w.r = bc.p WHERE q.p <> w.p) AS associative, EXISTS (SELECT 1 FROM e) AS identity,
NOT EXISTS (SELECT 1 FROM m WHERE NOT EXISTS (SELECT 1 FROM t JOIN t u ON u.l = t.r AND u.r = t.l JOIN e ON t.p = e.x AND u.p = e.x WHERE t.l = m.x)) AS inverse, NOT EXISTS (SELECT 1 FROM t JOIN t u ON u.l = t.r AND u.r = t.l WHERE u.p <> t.p) AS commutative)
SELECT *, closed AND associative AND identity AND inverse AS "group", closed AND associative AND identity AND inverse AND commutative AS abelian FROM c""")
def group_validate(spark, sf_dir):
    n = Tables(spark, sf_dir).region.select(F.col("r_regionkey").alias("left"))
    return sets.group_properties(n.crossJoin(n.withColumnRenamed("left", "right")).select("left", "right", ((F.col("left") + F.col("right")) % 5).alias("result")))


# --- scalar packs ----------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, upper(p_name) AS up, replace(p_type, 'M', '-') AS cut, starts_with(p_type, 'S') AS s, ends_with(p_type, 'D') AS d, contains(p_name, 'a') AS a, p_brand || '/' || p_type AS joined, trim('  ' || p_type || ' ') AS trimmed, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS words FROM part")
def str_pack(spark, sf_dir):
    S, c = scalars.STR, F.col
    return Tables(spark, sf_dir).part.select(
        "p_partkey", S["len"](c("p_name")).alias("n"), S["upper"](c("p_name")).alias("up"), S["replace"](c("p_type"), F.lit("M"), F.lit("-")).alias("cut"), S["startsWith"](c("p_type"), F.lit("S")).alias("s"), S["endsWith"](c("p_type"), F.lit("D")).alias("d"),
        S["contains"](c("p_name"), F.lit("a")).alias("a"), S["concat"](c("p_brand"), F.lit("/"), c("p_type")).alias("joined"), S["trim"](F.concat(F.lit("  "), c("p_type"), F.lit(" "))).alias("trimmed"), F.size(S["split"](c("p_name"), " ")).alias("words"),
    )


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS l10, round(sin(p_size), 9) AS s, round(atan2(p_size, 3), 9) AS t, CAST(floor(p_retailprice / 7) AS DOUBLE) AS f, CAST(ceil(p_retailprice / 7) AS DOUBLE) AS c, round(p_retailprice) AS r, CAST(p_size % 7 AS DOUBLE) AS m, pow(p_size, 2) AS sq, CAST(abs(p_size - 20) AS DOUBLE) AS ab FROM part")
def math_pack(spark, sf_dir):
    M, p, z = scalars.MATH, F.col("p_retailprice"), F.col("p_size")
    return Tables(spark, sf_dir).part.select(
        "p_partkey", _r(M["sqrt"](p)).alias("root"), _r(M["log"](p), 9).alias("l"), _r(M["log10"](p), 9).alias("l10"), _r(M["sin"](z), 9).alias("s"), _r(M["atan2"](z, F.lit(3)), 9).alias("t"), M["floor"](p / 7).alias("f"), M["ceil"](p / 7).alias("c"),
        M["round"](p).alias("r"), M["mod"](z, F.lit(7)).alias("m"), M["pow"](z, F.lit(2)).alias("sq"), M["abs"](z - 20).alias("ab"),
    )


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.zz') AS has_zz FROM events")
def json_pack(spark, sf_dir):
    J, p = scalars.JSON, F.col("props")
    return Tables(spark, sf_dir).events.select("event_id", J["get"](p, "k").alias("k"), J["has"](p, "k").alias("has_k"), J["has"](p, "zz").alias("has_zz"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS s, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS DOUBLE) AS head, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS dot, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 9) AS sig, greatest(CAST(embedding[2] AS DOUBLE), 0) AS relu FROM embeddings")
def array_ml_pack(spark, sf_dir):
    A, M, e = scalars.ARRAY, scalars.ML, F.col("embedding")
    head = A["get"](e, 0).cast("double")
    return Tables(spark, sf_dir).embeddings.select("vec_id", _r(A["sum"](e), 5).alias("s"), A["min"](e).cast("double").alias("lo"), A["max"](e).cast("double").alias("hi"), A["len"](e).alias("n"), head.alias("head"), _r(M["dot"](e, e), 5).alias("dot"), _r(M["sigmoid"](head), 9).alias("sig"), M["relu"](A["get"](e, 1).cast("double")).alias("relu"))


@query("SELECT p_partkey, round(CASE WHEN p_size <= 25 THEN exp(-0.5 * pow((p_size - 25) / (20 / sqrt(-2 * ln(0.01))), 2)) ELSE exp(-0.5 * pow((p_size - 25) / (30 / sqrt(-2 * ln(0.01))), 2)) END, 9) AS degree FROM part")
def degree_membership(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", _r(degrees.membership(F.col("p_size"), F.lit(25), F.lit(5), F.lit(55)), 9).alias("degree"))


@query("""SELECT p_partkey, round(1 / (1 + abs(p_size - 20)), 9) AS number, round(0.25 * CAST(p_type = 'PROMO' AS DOUBLE) + 0.75 * (1 / (1 + abs(p_size - 20)) + CAST(p_brand = 'Brand#11' AS DOUBLE)) / 2, 9) AS fact,
round(len(list_filter(list_filter(string_split(p_name, ' '), lambda x: x <> ''), lambda x: list_contains(['blue', 'red', 'part'], x))) / greatest(len(list_filter(string_split(p_name, ' '), lambda x: x <> '')), 3), 9) AS words FROM part""")
def degree_similarity(spark, sf_dir):
    n = lambda a, b: degrees.similar_numbers(a, b)
    fact = degrees.similar_facts(F.col("p_type"), F.lit("PROMO"), [(F.col("p_size"), F.lit(20), n), (F.col("p_brand"), F.lit("Brand#11"), degrees.same)])
    return Tables(spark, sf_dir).part.select("p_partkey", _r(n(F.col("p_size"), F.lit(20)), 9).alias("number"), _r(fact, 9).alias("fact"), _r(degrees.similar_texts(F.col("p_name"), F.lit("blue red part")), 9).alias("words"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || '--X!'), '[^a-z0-9]+', ' ', 'g')) AS plain, round(1 - levenshtein(lower(p_type), 'standard') / greatest(length(p_type), 8), 9) AS likeness FROM part")
def text_pack(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", scalars.normalised(F.concat("p_name", F.lit("--X!"))).alias("plain"), _r(scalars.edit_similarity(F.col("p_type"), F.lit("Standard")), 9).alias("likeness"))


# --- comparison ----------------------------------------------------------------------------------

_SIM = "0.25 + 0.75 * ((0.25 + 0.75 * (1 - abs(a.p_size - b.p_size) / greatest(abs(a.p_size), abs(b.p_size), 1e-9))) + (0.25 + 0.75 * (CASE WHEN a.p_type = b.p_type THEN 1 ELSE 0.65 * (1 - levenshtein(lower(a.p_type), lower(b.p_type)) / greatest(length(a.p_type), length(b.p_type))) END)) + (0.25 + 0.75 * (1 - abs(a.p_retailprice - b.p_retailprice) / greatest(abs(a.p_retailprice), abs(b.p_retailprice), 1e-9)))) / 3"


@query(f"SELECT a.p_partkey, round({_SIM}, 9) AS similarity, CAST(a.p_size <> b.p_size AS INTEGER) + CAST(a.p_type <> b.p_type AS INTEGER) + CAST(a.p_retailprice <> b.p_retailprice AS INTEGER) AS n_differences, {_SIM} >= 0.8 AS matched FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def fact_similarity(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    fields = ["p_size", "p_type", "p_retailprice"]
    pairs = p.select("p_partkey", F.struct(*fields).alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.struct(*fields).alias("b")), "p_partkey")
    return compare.compare_pairs(pairs, "a", "b").select("p_partkey", _r("similarity", 9).alias("similarity"), F.size("differences").alias("n_differences"), "matched")


@query(f"""SELECT input, candidate, round(s, 9) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT a.p_partkey AS input, b.p_partkey AS candidate, {_SIM} AS s, row_number() OVER (PARTITION BY a.p_partkey ORDER BY {_SIM} DESC, b.p_partkey) AS rank
FROM part a JOIN part b ON a.p_brand = b.p_brand WHERE a.p_partkey % 20 = 0) WHERE rank <= 3""")
def nearest_where(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    asked = p.where(F.col("p_partkey") % 20 == 0)  # the stated query set: ids divisible by 20, against all rows
    found = compare.nearest(asked, p, "p_partkey", "p_partkey", ["p_size", "p_type", "p_retailprice"], 3, ["p_brand"])
    return found.select("input", "candidate", _r("similarity", 9).alias("similarity"), "rank")


@query("SELECT n_nationkey AS id, u.path, coalesce(u.field, u.path) AS field, u.kind, u.value, u.depth FROM nation CROSS JOIN LATERAL (VALUES ('$', NULL, 'fact', '', 0), ('home', NULL, 'fact', '', 1), ('home.region', 'region', 'number', CAST(n_regionkey AS VARCHAR), 2), ('names', NULL, 'collection', '2', 1), ('names[0]', NULL, 'string', n_name, 2), ('names[1]', NULL, 'string', lower(n_name), 2)) u(path, field, kind, value, depth)")
def extract_semantics(spark, sf_dir):
    n = Tables(spark, sf_dir).nation.select("n_nationkey", F.struct(F.col("n_regionkey").alias("region")).alias("home"), F.array("n_name", F.lower("n_name")).alias("names"))
    return compare.extract_semantics(n, "n_nationkey")


@query("""WITH p AS (SELECT DISTINCT n_nationkey AS l, n_regionkey AS r FROM nation), k AS (SELECT l AS k FROM p UNION SELECT r FROM p)
SELECT (SELECT count(*) FROM k) AS nodes, (SELECT count(*) FROM p) AS pairs, (SELECT count(*) FROM p WHERE l = r) = (SELECT count(*) FROM k) AS reflexive,
NOT EXISTS (SELECT l, r FROM p EXCEPT SELECT r, l FROM p) AS symmetric, NOT EXISTS (SELECT l, r FROM p INTERSECT SELECT r, l FROM p) AS asymmetric,
NOT EXISTS (SELECT a.l, b.r FROM p a JOIN p b ON a.r = b.l EXCEPT SELECT l, r FROM p) AS transitive""")
def relation_properties(spark, sf_dir):
    return hierarchy.relation_properties(Tables(spark, sf_dir).nation.select(F.col("n_nationkey").alias("left"), F.col("n_regionkey").alias("right")))


# --- hierarchy ------------------------------------------------------------------------------------


def place_edges(spark, sf_dir):
    """Suppliers below nations below regions below the world."""
    t = Tables(spark, sf_dir)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s = t.supplier.select(name("s", "s_suppkey").alias("child"), name("n", "s_nationkey").alias("parent"))
    n = t.nation.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    return s.unionByName(n).unionByName(t.region.select(name("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")))


PLACES = "e AS (SELECT 's' || s_suppkey AS c, 'n' || s_nationkey AS p FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region), closed AS (SELECT c AS d, c AS a, 0 AS k FROM e UNION SELECT 'world', 'world', 0 UNION SELECT d, p, k + 1 FROM closed JOIN e ON a = c)"


@query(f"WITH RECURSIVE {PLACES} SELECT d AS descendant, a AS ancestor, k AS depth FROM closed")
def closure(spark, sf_dir):
    return hierarchy.closure(place_edges(spark, sf_dir))


def _pairs(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    return s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("l"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("r"))


@query(f"WITH RECURSIVE {PLACES}, q AS (SELECT x.d AS l, y.d AS r, x.a, x.k FROM closed x JOIN closed y ON x.a = y.a AND x.d LIKE 's%' AND y.d = 's' || (CAST(substr(x.d, 2) AS BIGINT) + 1)) SELECT l, r, a AS ancestor FROM q WHERE k = (SELECT min(k) FROM q z WHERE z.l = q.l)")
def lca(spark, sf_dir):
    return hierarchy.lowest_common_ancestors(_pairs(spark, sf_dir), hierarchy.closure(place_edges(spark, sf_dir)))


@query(f"WITH RECURSIVE {PLACES} SELECT DISTINCT x.d AS l, y.d AS r, 'world' AS ancestor FROM closed x JOIN closed y ON x.d LIKE 's%' AND y.d = 's' || (CAST(substr(x.d, 2) AS BIGINT) + 1)")
def mgca(spark, sf_dir):
    return hierarchy.highest_common_ancestors(_pairs(spark, sf_dir), hierarchy.closure(place_edges(spark, sf_dir)))


@query(f"WITH RECURSIVE {PLACES}, q AS (SELECT x.d AS l, y.d AS r, x.a, x.k AS kx, y.k AS ky FROM closed x JOIN closed y ON x.a = y.a AND x.d LIKE 's%' AND y.d = 's' || (CAST(substr(x.d, 2) AS BIGINT) + 1)), b AS (SELECT * FROM q WHERE kx = (SELECT min(kx) FROM q z WHERE z.l = q.l)), z AS (SELECT d, count(*) AS n FROM closed GROUP BY 1) SELECT l, r, a AS lca, kx + ky AS distance, round(1 / (kx + ky + 1), 9) AS path_similarity, round(2 * za.n / (zl.n + zr.n), 9) AS wu_palmer FROM b JOIN z za ON za.d = a JOIN z zl ON zl.d = l JOIN z zr ON zr.d = r")
def path_similarities(spark, sf_dir):
    s = hierarchy.similarities(_pairs(spark, sf_dir), hierarchy.closure(place_edges(spark, sf_dir)))
    return s.select("l", "r", "lca", "distance", _r("path_similarity", 9).alias("path_similarity"), _r("wu_palmer", 9).alias("wu_palmer"))


@query(f"WITH f AS (SELECT a, -ln(count(*) / (SELECT count(*) FROM events)) AS ic FROM events JOIN {EVENT_CLOSURE} ON event_type = d GROUP BY 1) SELECT p.l, p.r, p.lca, round(f.ic, 9) AS resnik, round(2 * f.ic / (fl.ic + fr.ic), 9) AS lin FROM (VALUES ('click', 'view', 'Visit'), ('click', 'signup', 'Lead'), ('view', 'error', 'Event')) p(l, r, lca) JOIN f ON f.a = p.lca JOIN f fl ON fl.a = p.l JOIN f fr ON fr.a = p.r")
def information_similarities(spark, sf_dir):
    closed = event_session(spark, sf_dir).closure()
    freq = stats.frequencies(Tables(spark, sf_dir).events, closed, "event_type")
    pairs = spark.createDataFrame([("click", "view"), ("click", "signup"), ("view", "error")], "l string, r string")
    return hierarchy.similarities(pairs, closed, freq).select("l", "r", "lca", _r("resnik", 9).alias("resnik"), _r("lin", 9).alias("lin"))


@query("SELECT 's' || s_suppkey || '>n' || s_nationkey || '>r' || n_regionkey || '>world' AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def hierarchy_proof(spark, sf_dir):
    start = Tables(spark, sf_dir).supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"))
    return hierarchy.proof_paths(place_edges(spark, sf_dir), start).where("ancestor = 'world'").select(F.array_join("path", ">").alias("path"))


@query("SELECT a.p_partkey AS k, CASE WHEN a.p_type = b.p_type THEN a.p_type END AS p_type, CASE WHEN a.p_size = b.p_size THEN a.p_size END AS size, CASE WHEN a.p_size <> b.p_size THEN least(a.p_size, b.p_size) END AS low, CASE WHEN a.p_size <> b.p_size THEN greatest(a.p_size, b.p_size) END AS high, CASE WHEN a.p_brand = b.p_brand THEN a.p_brand END AS brand FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def generalised_fact(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    side = lambda k: p.select(k.alias("k"), "p_type", "p_size", F.struct("p_brand", "p_name").alias("more"))
    out = hierarchy.generalised(side(F.col("p_partkey")), side(F.col("p_partkey") - 1), ["k"], ["p_size", "p_type", "more"])
    return out.select("k", "p_type", F.col("p_size.value").alias("size"), F.col("p_size.range.min").alias("low"), F.col("p_size.range.max").alias("high"), F.col("more.p_brand").alias("brand"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, CAST(floor(value) AS BIGINT) % 50 AS b FROM events WHERE event_type = 'purchase'), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a, b FROM reach")
def reachable(spark, sf_dir):
    e = Tables(spark, sf_dir).events.where("event_type = 'purchase'").select(F.col("user_id").alias("a"), (F.floor("value") % 50).alias("b")).distinct()
    p = Program({"edge": e})
    p.rule("reach", ["a", "b"], [Goal("edge", a="?a", b="?b")])
    p.rule("reach", ["a", "b"], [Goal("reach", a="?a", b="?n"), Goal("edge", a="?n", b="?b")])
    return p.query("reach", a="?a", b="?b")


# --- reasoning --------------------------------------------------------------------------------------


def _buyers(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.select("user_id").distinct(), e.where("event_type = 'purchase'").select("user_id"), e.where("event_type = 'error'").select("user_id")


@query("SELECT user_id, CASE WHEN p AND n THEN 'both' WHEN p THEN 'proved' WHEN n THEN 'disproved' ELSE 'unknown' END AS truth FROM (SELECT user_id, bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'error') AS n FROM events GROUP BY 1)")
def prove_four_valued(spark, sf_dir):
    asked, p, n = _buyers(spark, sf_dir)
    return prove(asked, ["user_id"], p, n)


def _evidence(spark, sf_dir):
    degree = F.least(F.col("value") / 1000, F.lit(1.0))
    return Tables(spark, sf_dir).events.where("event_type in ('purchase', 'error')").select("user_id", F.greatest(degree, F.lit(0.0)).alias("degree"), F.lit(0.9).alias("reliability"), F.when(F.col("event_type") == "purchase", "support").otherwise("oppose").alias("polarity"))


@query("SELECT user_id, round(coalesce(max(CASE WHEN event_type = 'purchase' THEN greatest(least(value / 1000, 1.0), 0.0) * 0.9 END), 0), 9) AS support, round(coalesce(max(CASE WHEN event_type = 'error' THEN greatest(least(value / 1000, 1.0), 0.0) * 0.9 END), 0), 9) AS oppose, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1")
def grade_evidence(spark, sf_dir):
    return grade(_evidence(spark, sf_dir), ["user_id"]).select("user_id", _r("support", 9).alias("support"), _r("oppose", 9).alias("oppose"), "n")


@query("SELECT user_id, CASE WHEN p > 0 AND n > 0 THEN 'both' WHEN p > 0 THEN 'proved' WHEN n > 0 THEN 'disproved' ELSE 'unknown' END AS truth, round(least(s, 1 - o), 9) AS degree FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'error') AS n, coalesce(max(CASE WHEN event_type = 'purchase' THEN greatest(least(value / 1000, 1.0), 0.0) * 0.9 END), 0) AS s, coalesce(max(CASE WHEN event_type = 'error' THEN greatest(least(value / 1000, 1.0), 0.0) * 0.9 END), 0) AS o FROM events GROUP BY 1)")
def decide_query(spark, sf_dir):
    asked, p, n = _buyers(spark, sf_dir)
    return decide(asked, ["user_id"], p, n, _evidence(spark, sf_dir)).select("user_id", "truth", _r("degree", 9).alias("degree"))


@query("SELECT user_id, CASE WHEN s = m THEN CASE WHEN s = 5 THEN 'exact-member' ELSE 'subset-member' END END AS state FROM (SELECT user_id, count(DISTINCT event_type) AS s, count(DISTINCT event_type) FILTER (event_type IN ('click', 'error', 'purchase', 'signup', 'view')) AS m FROM events GROUP BY 1)")
def relation_compare(spark, sf_dir):
    kinds = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return kinds.select("user_id", structural_state(F.col("k"), F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])).alias("state"))


# --- models ---------------------------------------------------------------------------------------------

_STUMP = """WITH v AS (SELECT l_quantity AS x, CAST(l_returnflag = 'R' AS INTEGER) AS r, CAST(l_returnflag = 'A' AS INTEGER) AS a FROM lineitem),
g AS (SELECT x, count(*) AS n, sum(r) AS r, sum(a) AS a FROM v GROUP BY 1),
s AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER w AS ln, sum(r) OVER w AS lr, sum(a) OVER w AS la, sum(n) OVER () AS tn, sum(r) OVER () AS tr, sum(a) OVER () AS ta FROM g WINDOW w AS (ORDER BY x)),
c AS (SELECT (x + nx) / 2 AS cut, round((ln * (1 - pow(lr / ln, 2) - pow(la / ln, 2) - pow((ln - lr - la) / ln, 2)) + (tn - ln) * (1 - pow((tr - lr) / (tn - ln), 2) - pow((ta - la) / (tn - ln), 2) - pow((tn - ln - tr + lr - ta + la) / (tn - ln), 2))) / tn, 12) AS gini FROM s WHERE nx IS NOT NULL)"""


@query(f"{_STUMP} SELECT 'l_quantity' AS feature, cut AS threshold, round(1 - gini, 9) AS confidence FROM c ORDER BY gini, cut LIMIT 1")
def train_stump(spark, sf_dir):
    m = models.train_stump(Tables(spark, sf_dir).lineitem, "l_returnflag", ["l_quantity"])
    return spark.createDataFrame([(m.feature, m.threshold, round(m.confidence, 9))], "feature string, threshold double, confidence double")


_BEST = f"{_STUMP}, b AS (SELECT cut FROM c ORDER BY gini, cut LIMIT 1), k AS (SELECT l_quantity <= cut AS low, l_returnflag AS y, count(*) AS n FROM lineitem CROSS JOIN b GROUP BY 1, 2), w AS (SELECT low, y FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY n DESC, y) AS r FROM k) WHERE r = 1)"


@query(f"{_BEST} SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN k.y = w.y THEN n ELSE 0 END) / sum(n), 9) AS accuracy FROM k JOIN w ON k.low = w.low")
def evaluate_stump(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem
    return models.evaluate(models.train_stump(df, "l_returnflag", ["l_quantity"]), df).select("n", _r("accuracy", 9).alias("accuracy"))


@query(f"{_BEST} SELECT l_orderkey, l_linenumber, w.y AS prediction, CASE WHEN w.low THEN 'numeric_split_left' ELSE 'numeric_split_right' END AS route FROM lineitem CROSS JOIN b JOIN w ON w.low = (l_quantity <= cut)")
def predict_fact(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem
    return models.predict_fact(df, df, "l_returnflag", ["l_quantity"]).select("l_orderkey", "l_linenumber", "prediction", "route")


_FIT = "SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, regr_r2(l_extendedprice, l_quantity) AS r FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, round(i + s * l_quantity, 2) AS prediction, round(r, 6) AS confidence, 'linear_regression' AS route FROM lineitem CROSS JOIN ({_FIT})")
def predict_numeric_fact(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem
    return models.predict_numeric_fact(df, df, "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", _r("prediction", 2).alias("prediction"), _r("confidence").alias("confidence"), "route")


@query(f"{_STUMP} SELECT 'l_quantity' AS feature, cut AS threshold, round(1 - gini, 9) AS confidence FROM c ORDER BY gini, cut LIMIT 1")
def saved_model(spark, sf_dir):
    """A model that is written and read again."""
    path = folder(spark, "model")
    models.save_model(spark, models.train_stump(Tables(spark, sf_dir).lineitem, "l_returnflag", ["l_quantity"]), path)
    m = models.load_model(spark, path)
    return spark.createDataFrame([(m.feature, m.threshold, round(m.confidence, 9))], "feature string, threshold double, confidence double")


@query("SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def linear_regression(spark, sf_dir):
    m = models.linear_regression(Tables(spark, sf_dir).lineitem, "l_extendedprice", "l_quantity")
    return m.select("n", _r("slope").alias("slope"), _r("intercept", 4).alias("intercept"), _r("r2").alias("r2"))


def _k_means_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds, one after the other, over standardised features x and y."""
    out = ["WITH m AS (SELECT avg(p_size) AS mx, stddev_pop(p_size) AS sx, avg(p_retailprice) AS my, stddev_pop(p_retailprice) AS sy FROM part), z AS (SELECT p_partkey AS id, (p_size - mx) / sx AS x, (p_retailprice - my) / sy AS y FROM part CROSS JOIN m)"]
    out.append(f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS c, x, y FROM (SELECT * FROM z ORDER BY id LIMIT {k}))")
    near = lambda t: f"(SELECT id, z.x, z.y, arg_min(c, (z.x - {t}.x) * (z.x - {t}.x) + (z.y - {t}.y) * (z.y - {t}.y) + c * 1e-15) AS c, min((z.x - {t}.x) * (z.x - {t}.x) + (z.y - {t}.y) * (z.y - {t}.y)) AS d FROM z CROSS JOIN {t} GROUP BY 1, 2, 3)"
    for i in range(rounds):
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.x, o.x) AS x, coalesce(n.y, o.y) AS y FROM c{i} o LEFT JOIN (SELECT c, avg(x) AS x, avg(y) AS y FROM {near(f'c{i}')} GROUP BY 1) n ON n.c = o.c)")
    return ", ".join(out) + f" SELECT c AS cluster, count(*) AS n, round(avg(sqrt(d)), 6) AS mean_distance FROM {near(f'c{rounds}')} GROUP BY 1"


@query(_k_means_sql(3, 12))
def k_means(spark, sf_dir):
    centres, assigned = models.k_means(Tables(spark, sf_dir).part, ["p_size", "p_retailprice"], 3, "p_partkey")
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("distance")).alias("mean_distance"))


# --- plots, rows, streams ----------------------------------------------------------------------------------


@query("SELECT b AS bin, round(lo + (hi - lo) * b / 8, 6) AS low, count(x) AS n FROM (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) CROSS JOIN (SELECT CAST(unnest(range(8)) AS INTEGER) AS b) LEFT JOIN (SELECT l_quantity AS x FROM lineitem) ON least(floor((x - lo) / (hi - lo) * 8), 7) = b GROUP BY b, lo, hi")
def histogram(spark, sf_dir):
    return stats.histogram(Tables(spark, sf_dir).lineitem, "l_quantity", 8).select("bin", _r("low").alias("low"), "n")


@query("SELECT c_name AS category, round(c_acctbal / sum(c_acctbal) OVER (), 9) AS share, round(360 * sum(c_acctbal) OVER (ORDER BY c_custkey) / sum(c_acctbal) OVER (), 6) AS end_angle FROM customer WHERE c_acctbal > 0")
def pie_share(spark, sf_dir):
    return stats.pie(Tables(spark, sf_dir).customer, "c_name", "c_acctbal", "c_custkey").select("category", _r("share", 9).alias("share"), _r("end_angle").alias("end_angle"))


@query("SELECT node, count(*) AS degree FROM (SELECT CAST(n_name AS VARCHAR) AS node FROM nation UNION ALL SELECT CAST(n_regionkey AS VARCHAR) FROM nation) GROUP BY 1")
def graph_nodes(spark, sf_dir):
    return stats.graph(Tables(spark, sf_dir).nation, "n_name", "n_regionkey")[0]


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_rows(spark, sf_dir):
    return rows.update_rows(Tables(spark, sf_dir).customer, "c_mktsegment", "BUILDING", c_mktsegment="CONSTRUCTION").select("c_custkey", "c_mktsegment")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE'")
def insert_unique(spark, sf_dir):
    r = Tables(spark, sf_dir).region
    return rows.insert_unique(r, spark.createDataFrame([(0, "AGAIN"), (99, "NOWHERE")], r.schema), "r_regionkey")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 3")
def delete_one(spark, sf_dir):
    return rows.change_one(Tables(spark, sf_dir).region, {"r_regionkey": 3})[0]


@query("SELECT 'Nation(n_nationkey: ' || n_nationkey || ', n_name: \"' || n_name || '\", n_regionkey: ' || n_regionkey || ')' AS value FROM nation")
def fact_lines(spark, sf_dir):
    return rows.fact_text(Tables(spark, sf_dir).nation, "Nation")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    w = streams.windowed(Tables(spark, sf_dir).events)
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", _r("total", 4).alias("total"))


@query("SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS running FROM lineitem")
def running_total(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")  # rows with equal numbers get one sum
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w).alias("running"))


from . import queries_facts, queries_language, queries_sources  # noqa: E402,F401  they register themselves
