"""From raw documents to packed training sequences.

STAGES lists (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read back as the next one's docs.  All but the
last return the columns of documents.  Stages that drop copies do so by row: of rows that
share doc_id and text one stays, and a row goes for its own text only, whatever other rows
have its doc_id or none.  Empty tables pass through, null texts count as empty, texts
of any length are worked on whole, and other columns go on as they are, whatever their
names and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfact.llm import exact_dedup, packing, shingle_dedup, substring_dedup, toxicity
from loomfact.llm.common import stored, whole, without
from loomfact.llm.queries import vocabulary


def _key(docs: DataFrame) -> Column:
    """A key of each row's id and text."""
    return exact_dedup.row_key(docs["doc_id"], docs["text"])


def _one_each(docs: DataFrame, gone: DataFrame, several: DataFrame) -> DataFrame:
    """docs but for the rows whose keys are in gone (column _row), and one row of each key in several."""
    # by number: a column of docs may have any name
    left = without(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], _key(docs).alias("_row")), gone, "_row")
    if not several.isEmpty():
        left = without(left, several, "_row").unionByName(without(left, several, "_row", "left_semi").dropDuplicates(["_row"]))
    return left.drop("_row").toDF(*docs.columns)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    net, cuts = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, net, cuts)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays: one with the smallest doc_id."""
    found = exact_dedup.exact_dedup(docs).where("group_size > 1")
    copies = stored(found.groupBy("id", "digest", "kept").agg(F.count(F.lit(1)).alias("n")), "copies")
    key = exact_dedup.key_of(F.col("id"), F.col("digest")).alias("_row")
    return _one_each(docs, copies.where("not kept").select(key), copies.where("kept and n > 1").select(key))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 and more over shingles of five words), the row with the smallest doc_id stays."""
    rows = stored(docs.groupBy(_key(docs).alias("_row")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_row"), "several")
    found = shingle_dedup.near_components(docs.select(_key(docs).alias("row"), whole(F.col("text")).alias("text")), words=5, similar=0.8)
    return _one_each(docs, stored(found.select(F.col("node").alias("_row")), "dropped"), rows)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more stay where they occur first."""
    return substring_dedup.without_repeats(docs, k=20)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token runs placed in sequences of 2048 tokens, of at most 24 documents each, where attention costs no more than one full run; residuals of all three count."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), max_docs=24, max_cost=2048.0**2, rule="norm", weights=(1.0, 0.1, 0.1))


STAGES = [
    ("toxicity", toxic_documents),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packed),
]

#: SQL can express neither the classifier nor the sub-word tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
