"""Small tables with everything that may go wrong in a document."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Words of the small texts.
WORDS = "the of and a lamp river stone window garden paper silver morning table letter winter road signal harbour bread field".split()


def passage(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def edge_rows():
    common = passage(1, 60)
    return [
        (1, passage(2, 80), "en", "s0", 0), (2, passage(2, 80), "en", "s0", 0), (3, passage(2, 80).replace(" ", "\n\t "), "de", "s1", 0),
        (4, common + " " + passage(3, 30), "en", "s0", 0), (5, passage(4, 30) + " " + common + " " + common, "en", None, 0), (6, "", "en", "s0", 0), (7, None, None, None, None),
        (8, "   \n ", "en", "s0", 0), (9, "one", "en", "s0", 0), (10, "Zwölf Boxkämpfer   jagen \x1c Виктор 日本", "de", "s0", 0), (None, "no id here, but words", "en", "s0", 0),
        (None, passage(2, 80), "en", "s0", 0), (11, passage(5, 9000), "en", "s0", 0), (12, "aa" * 30_000, "en", "s0", 0), (13, "one", "en", "s0", 0), (13, "one", "en", "s0", 0),
        (14, "<|endoftext|> special <|startoftext|>", "en", "s0", 0), (15, "it's  we'll, DON'T stop.\x0b\x0c", "en", "s0", 0), (16, "\x00 zero", "en", "s0", 0),
    ]


def edge_docs(spark, extra=True):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in ("id", "digest", "fp", "tag", "rest", "kept", "piece", "length", "score", "keep_id", "chunk", "shard", "words", "root", "row")})
    return df.repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
