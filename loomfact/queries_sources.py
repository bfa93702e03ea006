"""Registered queries of sources and sinks: each writes files in the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import rows
from .registry import Tables, folder, query
from .session import FactSession
from .sources import files


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, '\"' || c_mktsegment || '\", so' AS remark FROM customer")
def csv_round_trip(spark, sf_dir):
    """Every value is a text; quotes and commas survive."""
    path = folder(spark, "csv")
    files.write_csv(Tables(spark, sf_dir).customer.select("c_custkey", "c_name", F.concat(F.lit('"'), "c_mktsegment", F.lit('", so')).alias("remark")), path)
    return files.read_csv(spark, path)


@query("SELECT 'Nation' AS _type, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_typed_facts(spark, sf_dir):
    path = folder(spark, "csv")
    files.write_csv(Tables(spark, sf_dir).nation.select(F.lit("Nation").alias("_type"), "n_nationkey", "n_name"), path)
    return files.read_csv(spark, path, "Nation")


@query("SELECT p_brand, CAST(min(CAST(p_partkey AS BIGINT)) AS BIGINT) AS first_seen, count(*) AS n FROM part GROUP BY 1")
def csv_file_aggregates(spark, sf_dir):
    """Distinct values and sums of a CSV file, whose values are texts."""
    path = folder(spark, "csv")
    files.write_csv(Tables(spark, sf_dir).part.select("p_partkey", "p_brand"), path)
    df = files.read_csv(spark, path).withColumn("at", F.col("p_partkey").cast("bigint"))
    return rows.distinct(df, "p_brand", "at").join(df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), "p_brand")


@query("SELECT n_nationkey, n_name, n_regionkey * 2 AS doubled, n_name || '|x' AS names FROM nation")
def json_round_trip(spark, sf_dir):
    path = folder(spark, "json")
    files.write_json(Tables(spark, sf_dir).nation.select("n_nationkey", "n_name", F.struct((F.col("n_regionkey") * 2).alias("doubled"), F.array("n_name", F.lit("x")).alias("names")).alias("inner")), path)
    return files.read_json(spark, path, "n_nationkey int, n_name string, inner struct<doubled: int, names: array<string>>").select("n_nationkey", "n_name", "inner.doubled", F.array_join("inner.names", "|").alias("names"))


@query("SELECT n_name AS value FROM nation UNION ALL SELECT r_name FROM region")
def text_round_trip(spark, sf_dir):
    """Lines that are written, and lines that are added."""
    t, path = Tables(spark, sf_dir), folder(spark, "text")
    files.write_text(t.nation.select(F.col("n_name").alias("value")), path)
    files.write_text(t.region.select(F.col("r_name").alias("value")), path, "append")
    return files.read_text(spark, path)


@query("SELECT n_name AS third, true AS there, false AS after FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) WHERE k = 3")
def text_line(spark, sf_dir):
    """A line by its number, and whether a file is there before and after it goes."""
    path = folder(spark, "text")
    lines = Tables(spark, sf_dir).nation.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\n").alias("value"))
    files.write_text(lines.coalesce(1), path)
    third, there = files.read_line(spark, path, 2), files.exists(spark, path)
    files.delete(spark, path)
    return spark.createDataFrame([(third, there, files.exists(spark, path))], "third string, there boolean, after boolean")


@query("SELECT CAST(c_custkey AS DOUBLE) AS key, c_name || chr(10) || '\"x\" (y), {z: 1}' AS name, c_acctbal AS balance, c_acctbal > 0 AS rich, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS segment, CAST(c_nationkey AS DOUBLE) AS nation, c_name || '|' || c_mktsegment AS names FROM customer")
def fact_file_round_trip(spark, sf_dir):
    """Facts with nested records and arrays, line feeds, quotes and brackets within texts."""
    path = folder(spark, "facts")
    c = Tables(spark, sf_dir).customer
    made = c.select(F.col("c_custkey").alias("key"), F.concat("c_name", F.lit('\n"x" (y), {z: 1}')).alias("name"), F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") > 0).alias("rich"), F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("segment"), F.struct(F.col("c_nationkey").alias("nation"), F.array("c_name", "c_mktsegment").alias("names")).alias("more"))
    files.write_text(rows.fact_text(made, "Customer"), path)
    return files.read_facts(spark, path, "Customer").select("key", "name", "balance", "rich", "segment", "more.nation", F.array_join("more.names", "|").alias("names"))


@query("SELECT CAST(n_nationkey AS DOUBLE) AS key, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region FROM nation")
def fact_file_lines(spark, sf_dir):
    """Facts over several lines, of two types, with comments between them."""
    path = folder(spark, "facts")
    n = Tables(spark, sf_dir).nation
    text = F.format_string('# nation %d\nNation(\n  key: %d,\n  name: "%s",\n  region: %d\n)\nOther(x: 1)', "n_nationkey", "n_nationkey", "n_name", "n_regionkey")
    files.write_text(n.select(text.alias("value")), path)
    return files.read_facts(spark, path, "Nation")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 1 AND r_regionkey <> 2 UNION ALL SELECT 2, 'TWO' UNION ALL SELECT 90, 'NINETY'")
def store_changes(spark, sf_dir):
    """Inserts, an insert that is refused, an update and a delete of a stored table."""
    store, r = files.FactStore(spark, folder(spark, "store")), Tables(spark, sf_dir).region
    store.insert("Region", r, "r_regionkey")
    new = spark.createDataFrame([(90, "NINETY")], r.schema)
    store.insert("Region", new, "r_regionkey")
    store.insert("Region", new, "r_regionkey")
    store.change("Region", {"r_regionkey": 2}, {"r_name": "TWO"})
    store.change("Region", {"r_regionkey": 1}, None)
    return store.read("Region")


@query("SELECT 'save' AS step, (SELECT count(*) FROM nation WHERE n_regionkey < 3) AS kept, CAST(1 AS BIGINT) AS inserted, (SELECT count(*) FROM nation WHERE n_regionkey >= 3) AS deleted, NULL AS problem UNION ALL SELECT 'twice', NULL, 0, NULL, 'DuplicateKey' UNION ALL SELECT 'many', NULL, NULL, NULL, 'MultipleMatches' UNION ALL SELECT 'none', NULL, NULL, NULL, 'NotFound'")
def store_reports(spark, sf_dir):
    """What a store says: of a save, of a batch with a key twice, of changes that match several rows or none."""
    store, n = files.FactStore(spark, folder(spark, "store")), Tables(spark, sf_dir).nation
    store.save("Nation", n)
    saved = store.save("Nation", n.where("n_regionkey < 3").unionByName(spark.createDataFrame([(99, "NEW", 0)], n.schema)))
    twice = spark.createDataFrame([(100, "A", 0), (100, "B", 0)], n.schema)
    found = [("save", saved["kept"], saved["inserted"], saved["deleted"], None)]
    report = store.insert("Nation", twice, "n_nationkey")
    found.append(("twice", None, report["inserted"], None, report["problem"]))
    found.append(("many", None, None, None, store.change("Nation", {"n_regionkey": 1}, {"n_name": "x"})["problem"]))
    found.append(("none", None, None, None, store.change("Nation", {"n_regionkey": 77}, None)["problem"]))
    return spark.createDataFrame(found, "step string, kept bigint, inserted bigint, deleted bigint, problem string")


@query("SELECT 'Nation' AS type, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region")
def store_sync(spark, sf_dir):
    """What a store holds becomes what a session knows."""
    t, store, s = Tables(spark, sf_dir), files.FactStore(spark, folder(spark, "store")), FactSession(spark)
    store.write("Nation", t.nation)
    store.write("Region", t.region.limit(0))
    store.write("Region", t.region)
    store.sync(s)
    return s.scan().groupBy(F.col("_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '# models: Nation Region' AS header")
def store_schema(spark, sf_dir):
    path = folder(spark, "facts")
    files.write_text(spark.createDataFrame([(files.schema_header(["Nation", "Region"]).strip(),)], "value string"), path)
    return files.read_text(spark, path).withColumnRenamed("value", "header")
