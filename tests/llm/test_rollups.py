import uuid
from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomfact.llm import rollups
from loomfact.llm.common import shared_dir
from loomfact.llm.queries import op3_token_rollups, vocabulary

from .frames import edge_docs, empty_docs

ONE, TWO = "word_bpe_49k", "byte_bpe_50k"
PATHS = {x: vocabulary(f"{x}.json") for x in (ONE, TWO)}


def size(name):
    library = Tokenizer.from_file(PATHS[name])
    return lambda text: len(library.encode(text or "", add_special_tokens=False).ids)


def rollup(spark):
    return rollups.Rollup(spark, f"{shared_dir(spark)}/r-{uuid.uuid4().hex}")


def test_counts_as_the_library(spark):
    docs = edge_docs(spark)
    got = rollups.count_tokens(docs, {ONE: (PATHS[ONE], None), TWO: (PATHS[TWO], F.col("lang") == "de")}).collect()
    one, two = size(ONE), size(TWO)
    want = [(r.source, r.lang, one(r.text), two(r.text) if r.lang == "de" else None) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_batches_count_once(spark):
    docs = edge_docs(spark, False)
    r = rollup(spark)
    counts = rollups.count_tokens(docs, {ONE: (PATHS[ONE], None), TWO: (PATHS[TWO], None)}).cache()
    assert r.totals().count() == 0
    assert r.commit("a", rollups.events(counts, ONE, F.col(ONE), +1)) and not r.commit("a", rollups.events(counts, ONE, F.col(ONE), +1))
    want, one = {}, size(ONE)
    for x in docs.collect():
        n, t = want.get((x.source, x.lang), (0, 0))
        want[x.source, x.lang] = n + 1, t + one(x.text)
    totals = lambda: {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert totals() == want
    german = counts.where("lang = 'de'")
    change = rollups.revised(german, (ONE, F.col(ONE)), (TWO, F.col(TWO)))
    assert r.commit("b", change) and r.compact() and not r.commit("b", change)
    assert r.totals().where(f"lang = 'de' and tokenizer = '{ONE}'").count() == 0
    assert r.commit("c", rollups.events(counts.where("lang <> 'de' or lang is null"), ONE, F.col(ONE), -1)) and r.compact()
    assert {x.tokenizer for x in r.totals().collect()} == {TWO}
    none = rollups.count_tokens(empty_docs(spark), {ONE: (PATHS[ONE], None)})
    assert r.commit("d", rollups.events(none, ONE, F.col(ONE), +1)) and not r.commit("d", rollups.events(counts, ONE, F.col(ONE), +1))


def test_a_commit_while_a_snapshot_is_made(spark):
    """Between any two listings of the folder, another writer commits a batch; every batch counts once in the end."""
    rows = spark.createDataFrame([("s", "en", 5), ("s", "en", 7)], "source string, lang string, n int")
    batch = rollups.events(rows, "t", F.col("n"), +1)
    for when in range(1, 5):
        r = rollup(spark)
        other = rollups.Rollup(spark, r.path)
        assert r.commit("first", batch)
        calls, names = [], r._names

        def listed(sub):
            calls.append(sub)
            found = names(sub)
            if len(calls) == when:
                other.commit("second", batch)
            return found

        r._names = listed
        assert r.compact()
        r._names = names
        other.commit("second", batch)
        assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 4, 24)]
        assert r.compact() and [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 4, 24)]


def test_two_snapshots_at_once(spark):
    rows = spark.createDataFrame([("s", "en", 5)], "source string, lang string, n int")
    r = rollup(spark)
    assert r.commit("first", rollups.events(rows, "t", F.col("n"), +1))
    names = r._names
    slow = rollups.Rollup(spark, r.path)
    slow._names = lambda sub: names(sub) if sub == "batches" else []  # listed before the other was done
    assert r.compact() and not slow.compact() and r.totals().first().n_tokens == 5


def test_registered_query(spark, tmp_path):
    docs = edge_docs(spark, False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    one, two, docs_of, tokens_of = size(ONE), size(TWO), Counter(), Counter()
    for x in docs.collect():
        if one(x.text):
            key = (x.source, x.lang, TWO if x.lang == "en" else ONE)
            docs_of[key] += 1
            tokens_of[key] += (two if x.lang == "en" else one)(x.text)
    got = op3_token_rollups(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(*k, docs_of[k], tokens_of[k]) for k in docs_of], key=str)
