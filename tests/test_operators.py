"""Stated results, must-fail cases and round trips."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomfact.functions import degrees, scalars
from loomfact.operators import compare, hierarchy, models, rows, sets, stats, temporal
from loomfact.plans.logic import Goal, Not, Or, PlanError, Program, Where
from loomfact.session import FactSession, merge_labels
from loomfact.sources import files
from loomfact.streaming import events as streams


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def profile(v, peak, low, high):
    return degrees.membership(*map(F.lit, (v, peak, low, high)))


@pytest.mark.parametrize("args, want", [((68, 75, 50, 90), 0.696947396356321), ((75, 75, 50, 90), 1), ((50, 75, 50, 90), 0.01), ((90, 75, 50, 90), 0.01), ((75, 75, 75, 90), 1), ((5, 5, 5, 5), 1), ((6, 5, 5, 5), 0)])
def test_membership(spark, args, want):
    assert value(spark, profile(*args)) == pytest.approx(want, abs=1e-12)


def test_failures_of_values(spark):
    for bad in (profile(1, 2, 3, 4), degrees.degree(F.lit(1.5)), scalars.MATH["div"](F.lit(1), F.lit(0)), scalars.MATH["mod"](F.lit(1), F.lit(0))):
        with pytest.raises(PySparkException):
            value(spark, bad)


def test_scalars(spark):
    assert value(spark, scalars.MATH["mod"](F.lit(-7), F.lit(3))) == -1
    assert value(spark, scalars.equal(F.lit(None), F.lit(None))) is True
    assert value(spark, scalars.normal_cdf(F.lit(1.96), F.lit(0.0), F.lit(1.0))) == pytest.approx(0.9750021, abs=1e-6)
    assert value(spark, scalars.binomial_cdf(F.lit(3), F.lit(10), F.lit(0.5))) == pytest.approx(0.171875)
    assert value(spark, scalars.poisson_cdf(F.lit(2), F.lit(3.0))) == pytest.approx(0.42319008, abs=1e-8)
    assert value(spark, scalars.stemmed(F.lit("Running Ponies"))) == "running_pony"
    assert value(spark, scalars.JSON["set"](F.lit('{"a":"1"}'), F.lit("b"), F.lit("2"))) == '{"a":"1","b":"2"}'
    assert value(spark, scalars.contrapositive(scalars.implication(F.lit("p"), F.lit("q")))).kind == "contrapositive"
    assert value(spark, degrees.similar_arrays(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0)))) == pytest.approx(0.5)


EDGES = [("feline", "mammal"), ("canine", "mammal"), ("mammal", "animal"), ("cat", "feline"), ("dog", "canine")]


def test_hierarchy(spark):
    edges = spark.createDataFrame(EDGES, "child string, parent string")
    closed = hierarchy.closure(edges)
    pair = spark.createDataFrame([("feline", "canine")], "l string, r string")
    assert [r.ancestor for r in hierarchy.lowest_common_ancestors(pair, closed).collect()] == ["mammal"]
    assert [r.ancestor for r in hierarchy.highest_common_ancestors(pair, closed).collect()] == ["animal"]
    assert not hierarchy.has_cycle(edges)
    loop = edges.union(spark.createDataFrame([("animal", "cat")], edges.schema))
    assert hierarchy.has_cycle(loop)
    assert hierarchy.closure(loop).count() == 4 * 4 + 5 + 6
    diamond = spark.createDataFrame([("l", "a"), ("l", "b"), ("r", "a"), ("r", "b"), ("a", "top"), ("b", "top")], "child string, parent string")
    got = hierarchy.lowest_common_ancestors(spark.createDataFrame([("l", "r")], "l string, r string"), hierarchy.closure(diamond))
    assert {r.ancestor for r in got.collect()} == {"a", "b"}


def test_ancestor_analysis(spark):
    closed = hierarchy.closure(spark.createDataFrame(EDGES, "child string, parent string"))
    got = hierarchy.ancestor_analysis(spark.createDataFrame([("cat", "dog")], "l string, r string"), closed).collect()
    assert {(r.ancestor, r.distance, r.lowest, r.highest) for r in got} == {("mammal", 4, True, False), ("animal", 6, False, True)}


def test_sql_functions(spark):
    from loomfact.functions.sql import register

    assert "membership" in register(spark)
    for args, want in (((68, 75, 50, 90), 0.696947396356321), ((75, 75, 50, 90), 1), ((90, 75, 50, 90), 0.01), ((5, 5, 5, 5), 1), ((6, 5, 5, 5), 0), ((90, 75, 75, 90), 0.01), ((60, 75, 60, 75), 0.01)):
        assert spark.sql("SELECT membership({}D, {}D, {}D, {}D)".format(*args)).first()[0] == pytest.approx(want, abs=1e-12)
    assert spark.sql("SELECT similar_numbers(b => 3D, a => 1D)").first()[0] == pytest.approx(1 / 3)


def test_logic(spark):
    t = lambda data, schema: spark.createDataFrame(data, schema)
    p = Program({"color": t([("red",), ("green",)], "value string"), "shape": t([("box",), ("ball",)], "value string"), "pair": t([("red", "red"), ("green", "green"), ("red", "green"), (None, None)], "left string, right string"), "bird": t([("tweety",), ("opus",)], "name string"), "penguin": t([("opus",)], "name string"), "route": t([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "start string, stop string"), "blocked": t([("c", "d")], "start string, stop string")})
    assert p.ask([Goal("color", value="?c"), Goal("shape", value="?s")]).count() == 4
    assert {r[0] for r in p.ask([Goal("pair", left="?v", right="?v")]).collect()} == {"red", "green", None}
    assert [r[0] for r in p.ask([Goal("bird", name="?n"), Not("penguin", name="?n")]).collect()] == ["tweety"]
    p.rule("reach", ["a", "b"], [Goal("route", start="?a", stop="?b"), Not("blocked", start="?a", stop="?b")])
    p.rule("reach", ["a", "b"], [Goal("reach", a="?a", b="?n"), Goal("route", start="?n", stop="?b"), Not("blocked", start="?n", stop="?b")])
    assert {r[0] for r in p.query("reach", a="a", b="?to").collect()} == {"a", "b", "c"}
    assert p.ask([Or([Goal("color", value="?v")], [Goal("shape", value="?v")]), Where("v", test=lambda v: v > "c")]).count() == 2
    with pytest.raises(PlanError):
        p.ask([Goal("bird", name="?n"), Not("penguin", name="?other")])
    p.rule("p", ["x"], [Goal("bird", name="?x"), Not("q", x="?x")])
    p.rule("q", ["x"], [Goal("bird", name="?x"), Not("p", x="?x")])
    with pytest.raises(PlanError):
        p.query("p", x="?x")
    with pytest.raises(PlanError):
        p.ask([Goal("nothing", x="?x")]) if "nothing" in p.facts else p.query("nothing", x="?x")


def test_session(spark):
    t = lambda data, schema: spark.createDataFrame(data, schema)
    s = FactSession(spark)
    s.register("Animal", t([("any", 1.0)], "name string, weight double"))
    s.register("Pet", t([("rex",)], "name string"), labels=["tame"])
    s.register("Dog", t([("fido", 9.0, "x")], "name string, weight double, tag string"), ["Animal", "Pet"])
    assert {r.name for r in s.scan("Pet").collect()} == {"rex", "fido"}
    assert s.scan("Animal").count() == 2 and s.count("Dog") == 1 and s.exists("Animal", "name", "fido")
    assert s.fields("Dog") == ["name", "weight", "tag"] and s.labelled("tame").count() == 1
    s.assert_facts("Pet", merge_labels(t([("rex", ["old"])], "name string, _labels array<string>")))
    assert s.snapshot("Pet").first()["_labels"] == ["old", "tame"]
    job = s.start(lambda frozen: frozen.scan("Pet").count())
    s.set_field("Dog", F.lit(True), "weight", 3.0)
    assert s.result(job) == 2 and s.status(job) == "done" and s.scan("Dog").first()["weight"] == 3.0 and s.mutations().count() == 5
    with pytest.raises(ValueError):
        s.register("Animal", None, ["Dog"])
    s.register("A", t([("1",)], "v string"))
    s.register("B", t([(1,)], "v int"))
    with pytest.raises(ValueError):
        s.register("C", t([(1,)], "w int"), ["A", "B"])
    with pytest.raises(KeyError):
        s.scan("Nobody")


def test_ranking(spark):
    ranked = temporal.rank(spark.createDataFrame([(1, 10.0, 90.0), (2, 20.0, 10.0), (3, 20.0, 20.0)], "id int, at double, p double"), "at", "p", "id")
    assert [r.id for r in ranked.orderBy("rank").collect()] == [3, 2, 1]
    for odd in (None, float("inf"), float("-inf"), float("nan")):
        for row in ((1, odd, 1.0), (1, 1.0, odd)):
            with pytest.raises(PySparkException):
                temporal.rank(spark.createDataFrame([row], "id int, at double, p double"), "at", "p", "id").collect()


def test_timeline_of_a_long_lineage(spark):
    """One lineage with most rows is spread over ranges, and numbered as one."""
    rows_ = [("hot", i % 400, i) for i in range(800)] + [(f"k{i}", i, 1000 + i) for i in range(20)] + [(None, 5, 2000), (None, 6, 2001)]
    df = spark.createDataFrame(rows_, "l string, at int, seq int").repartition(3)
    got = temporal.timeline(df, "l", "at", "seq").collect()
    want = []
    for name in {r[0] for r in rows_}:
        own = sorted([r for r in rows_ if r[0] == name], key=lambda r: (r[1], r[2]))
        want += [(*r, k + 1, r[1], own[k + 1][1] if k + 1 < len(own) else None) for k, r in enumerate(own)]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)


def test_rows(spark):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "k string, v string")
    assert rows.find_many(df, k=1.0).count() == 1 and rows.find_rows(df, "k", 1).count() == 1
    assert rows.delete_rows(df, "k", "x").count() == 2
    with pytest.raises(PySparkException):
        rows.aggregate(df, "sum", "k").collect()
    assert rows.change_one(df, {"v": "zz"})[1]["problem"] == "NotFound"
    assert rows.change_one(df.union(df), {"v": "a"})[1]["problem"] == "MultipleMatches"
    with pytest.raises(ValueError):
        rows.paginate(df, -1, 2, "k")


def test_sets_and_groups(spark):
    t = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    assert {r.x for r in sets.symmetric_difference(t(1, 2, 2), t(2, 3), t(2, 4)).collect()} == {1, 3, 4}
    r = sets.relations(t(1, 2), t(1, 2, 3)).first()
    assert (r.equals, r.subset, r.superset, r.disjoint) == (False, True, False, False)
    empty = sets.relations(t(1).where("false"), t(1).where("false")).first()
    assert empty.equals and empty.disjoint
    xor = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)], "left int, right int, result int")
    assert all(sets.group_properties(xor).first())
    assert not sets.group_properties(xor.where("left < 1 or right < 1")).first()["closed"]


def test_comparison(spark):
    df = spark.range(1).select(F.struct(F.lit(1.0).alias("a"), F.lit("Hello World").alias("b"), F.struct(F.lit(2).alias("c")).alias("n")).alias("l"), F.struct(F.lit(2.0).alias("a"), F.lit("hello, world").alias("b"), F.struct(F.lit(2).alias("c")).alias("n")).alias("r"))
    got = compare.compare_pairs(df, "l", "r").first()
    assert got.similarity == pytest.approx(0.25 + 0.75 * ((0.25 + 0.75 * 0.5) + (0.25 + 0.75 * 0.95) + 1) / 3)
    assert got.differences == ["a.changed_value", "b.changed_value"]
    assert compare.compare_pairs(df.select("l", F.col("l").alias("r")), "l", "r", "exact_recursive").first().similarity == 1
    with pytest.raises(ValueError):
        compare.compare_pairs(df, "l", "r", "guess")
    with pytest.raises(ValueError):
        compare.compare_pairs(df, "l", "r", threshold=2)
    renamed = df.select("l", F.struct(F.lit(1.0).alias("a"), F.lit("Hello World").alias("bb"), F.struct(F.lit(2).alias("c")).alias("n")).alias("r"))
    assert compare.compare_pairs(renamed, "l", "r").first().similarity == pytest.approx(0.25 + 0.75 * (1 + (0.8 + 0.2 * 0.5) + 1) / 3)
    assert compare.compare_pairs(renamed, "l", "r", mode="exact").first().similarity == pytest.approx(0.25 * 2 / 3 + 0.75)
    for algorithm in ("semantic_pattern", "relationship_aware"):
        assert compare.compare_pairs(renamed, "l", "r", algorithm).first().similarity == compare.compare_pairs(renamed, "l", "r").first().similarity
    part = df.select("l", F.struct(F.lit(2).alias("c")).alias("w"))
    assert compare.contains_subfact(part, "l", "w").first().path == "n"


def test_sets_whose_elements_have_no_key(spark):
    some = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    none = spark.createDataFrame([(None, "a"), (None, "b")], "k int, v string")
    assert sets.intersection_by(["k"], some, some).count() == 1 and sets.difference_by(["k"], some.limit(0), some).count() == 0
    for f in (sets.intersection_by, sets.symmetric_difference_by, sets.difference_by):
        with pytest.raises(PySparkException):
            f(["k"], some, none).collect()
    with pytest.raises(PySparkException):
        sets.relations(some, none, ["k"]).collect()


def test_nested_comparison(spark):
    one = spark.createDataFrame([({"tags": ["a", "b"], "in": {"x": 1}},)], "l struct<tags: array<string>, in: struct<x: int>>")
    two = spark.createDataFrame([({"tags": ["a"], "in": None},)], "r struct<tags: array<string>, in: struct<x: int>>")
    got = compare.compare_pairs(one.crossJoin(two), "l", "r").first()
    assert got.differences == ["in.changed_value", "tags.collection_size"]
    assert got.similarity == pytest.approx(0.25 + 0.75 * ((0.45 * 0.5 + 0.55) + 0) / 2)
    left, right = (StructType.fromDDL(x) for x in ("color string, n int", "Colour string, n double"))
    assert compare.align(left, right) == [("color", "Colour", pytest.approx(1 - 1 / 6)), ("n", "n", 1.0)] and compare.align(left, right, "exact") == [("n", "n", 1.0)]
    assert compare.name_similarity("first_name", "First Name") == 0.95
    with pytest.raises(ValueError):
        compare.extract_semantics(one, "l", 0)


def test_values_that_are_no_numbers(spark):
    """Rows without a finite feature belong to no cluster, and train nothing."""
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 1.2, "a"), (3, 9.0, "b"), (4, 9.2, "b"), (5, nan, "b"), (6, inf, "a"), (7, None, "a")], "i int, x double, y string")
    centres, got = models.k_means(df, ["x"], 2, "i")
    assert sorted(c[0] for c in centres) == pytest.approx([1.1, 9.1]) and got.count() == 4
    m = models.train_stump(df, "y", ["x"])
    assert m.threshold == pytest.approx(5.1) and {r.i: r.prediction for r in m.predict(df).collect()}[5] == "a"
    assert models.train_line(df.withColumn("z", 2 * F.col("x") + 1).where("i < 5"), "z", "x").slope == pytest.approx(2)


def test_next_values(spark):
    at = lambda rows, schema: {r.field: (r.predicted, r.method, round(r.confidence, 6)) for r in models.predict_next(spark.createDataFrame(rows, schema), "i", [f.split()[0] for f in schema.split(", ")[1:]]).collect()}
    assert at([(1, 1.0, "a"), (2, 4.0, None)], "i int, x double, t string") == {"x": ("7.0", "linear_trend", 0.75), "t": (None, "last_value", 0.6), None: (None, "field_wise_sequence_prediction", 0.675)}
    assert at([(1, 5.0, True), (2, None, True)], "i int, x double, b boolean")["x"] == (None, "last_value", 0.6)
    assert at([(1, None), (2, 3.0)], "i int, x double")["x"] == ("3.0", "linear_trend", 0.75)
    one = at([(1, 5.0, {"a": 1}, [1, 2], False)], "i int, x double, s struct<a: int>, l array<int>, b boolean")
    assert one["x"] == ("5.0", "last_numeric_value", 0.55) and one["s"] == ('{"a":1}', "recursive_nested_prediction", 0.65) and one["l"] == ("[1,2]", "last_collection_value", 0.5)
    assert one["b"] == (None, "unsupported", 0.0) and one[None][2] == pytest.approx(0.425)
    assert at([], "i int, x double") == {}


def test_models(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (8.0, "b"), (9.0, "b"), (None, "a")], "x double, y string")
    m = models.train_stump(df, "y", ["x"])
    assert (m.feature, m.threshold, m.left, m.right, m.majority) == ("x", 5.0, "a", "b", "a")
    assert models.evaluate(m, df).first().accuracy == 1
    centres, got = models.k_means(df.withColumn("i", F.monotonically_increasing_id()), ["x"], 2, "i")
    assert sorted(c[0] for c in centres) == pytest.approx([1.5, 8.5]) and got.count() == 4
    with pytest.raises(PySparkException):
        models.linear_regression(df.withColumn("c", F.lit(1.0)), "x", "c").collect()
    assert stats.correlate(df.withColumn("c", F.lit(1.0)), "x", "c").first().correlation == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi", you'), ("02", "x")], "id string, text string")
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c")).exceptAll(df).count() == 0
    assert files.read_csv(spark, str(tmp_path / "c"), "T").columns == ["_type", "id", "text"]
    files.write_text(rows.fact_text(df, "Note"), str(tmp_path / "f"))
    assert files.read_facts(spark, str(tmp_path / "f"), "Note").select("id", "text").exceptAll(df).count() == 0
    assert files.parse_facts('P(a: "x\\"y", n: -2.5, t: true, z: nil)') == [("P", {"a": 'x"y', "n": -2.5, "t": True, "z": None})]
    store = files.FactStore(spark, str(tmp_path / "db"))
    assert store.insert("Note", df, "id")["inserted"] == 2
    assert store.insert("Note", df.limit(1), "id")["problem"] == "DuplicateKey"
    assert store.change("Note", {"id": "1"}, {"text": "new"})["modified"] == 1
    assert store.change("Note", {"id": "none"}, None)["problem"] == "NotFound"
    assert store.save("Note", df) == {"kept": 1, "inserted": 1, "deleted": 1}
    assert store.read("Note").exceptAll(df).count() == 0 and store.types() == ["Note"]
    twice = spark.createDataFrame([("9", "a"), ("9", "b")], "id string, text string")
    assert store.insert("Fresh", twice, "id")["problem"] == "DuplicateKey" and store.insert("Note", twice, "id")["problem"] == "DuplicateKey" and "Fresh" not in store.types()
    # a writer that died leaves a staging folder behind, and blocks nobody
    df.write.parquet(str(tmp_path / "db" / "_staging" / "dead"))
    store.write("Note", df.limit(1))
    assert store.read("Note").count() == 1
    # two writers of one version: the second is told
    slow = files.FactStore(spark, str(tmp_path / "db"))
    seen = slow._versions("Note")
    slow._versions = lambda t: seen
    store.write("Note", df)
    with pytest.raises(Exception, match="exist"):
        slow.write("Note", df.limit(1))
    assert store.read("Note").count() == 2
    assert files.exists(spark, str(tmp_path / "db")) and files.delete(spark, str(tmp_path / "db"))


def test_fact_files(spark, tmp_path):
    text = """# two types
Note(
    id: 1,
    more: {tags: ["a", "b, c"], at: {x: -1.5e2}},
    text: "line\\nnext (x: 1)"
)
Note(id: 2, text: nil) Other(a: true)
"""
    (tmp_path / "one.facts").write_text(text)
    got = files.read_facts(spark, str(tmp_path), "Note").orderBy("id").collect()
    assert [(r.id, r.text) for r in got] == [(1.0, "line\nnext (x: 1)"), (2.0, None)] and got[0].more.tags == ["a", "b, c"] and got[0].more["at"].x == -150
    assert files.read_facts(spark, str(tmp_path), "Other").first().a is True and files.read_facts(spark, str(tmp_path), "None").count() == 0
    (tmp_path / "two.facts").write_text("Note(id: 3)\nNote(id: )\nNote(id: 4)\n")
    with pytest.raises(files.FactError):
        files.read_facts(spark, str(tmp_path), "Note")
    kept = files.read_facts(spark, str(tmp_path), "Note", rejects="keep").collect()
    assert sorted(r.id for r in kept if r.id) == [1, 2, 3, 4] and [r._reject for r in kept if r._reject] == ["Note(id: "]
    with pytest.raises(ValueError):
        files.schema_header(["A", " "])


def test_streams(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read(spark, str(tmp_path / "in"), batch.schema)
    q = streams.windowed(stream, late="60 days").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").select("start", "event_type", "n").exceptAll(streams.windowed(batch).select("start", "event_type", "n")).count() == 0
    q = streams.running(stream).writeStream.format("memory").queryName("r").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = {r.user_id: r.n for r in spark.table("r").groupBy("user_id").agg(F.max("n").alias("n")).collect()}
    assert last == {r.user_id: r["count"] for r in batch.groupBy("user_id").count().collect()}
    assert streams.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()
