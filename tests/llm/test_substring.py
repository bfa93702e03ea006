import datetime
import hashlib

import pytest

from loomfact.llm import substring_dedup
from loomfact.llm.queries import op9_substring

from .frames import edge_docs, empty_docs, passage


def brute(rows, k):
    """Of (id, text) rows: words, removed and kept text; null ids first, equal rows as one document."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    words = {r: (r[1] or "").encode().split() for r in order}
    first = {}
    for r in order:
        for s in range(len(words[r]) - k + 1):
            key, place = tuple(words[r][s : s + k]), (r[0] is not None, r[0] or 0, s)
            first[key] = min(first.get(key, place), place)
    out = []
    for r in rows:
        drop = set()
        for s in range(len(words[r]) - k + 1):
            if first[tuple(words[r][s : s + k])] < (r[0] is not None, r[0] or 0, s):
                drop |= set(range(s, s + k))
        kept = b" ".join(w for j, w in enumerate(words[r]) if j not in drop)
        out.append((r[0], len(words[r]), len(drop), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs, k, m):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substring_dedup.substring_dedup(docs, k, m).collect()
    assert sorted([(r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute(rows, k)


def test_edge_documents(spark):
    check(edge_docs(spark), 20, 3)


def test_shared_passages(spark):
    rows = [(i, passage(i, 30) + " " + passage(500 + i % 4, 45) + " " + passage(i % 3, 25)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    check(docs, 20, 3)
    check(docs, 6, 2)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_shared_ids_in_any_layout(spark, parts):
    """Texts that share an id and a beginning repeat nothing; nor does the way rows are dealt out matter."""
    common = passage(1, 40)
    rows = [(5, common + " x " + passage(2, 30)), (5, common + " y " + passage(3, 30)), (5, passage(4, 10) + " " + common), (None, common + " a"), (None, common + " b"), (None, common + " b"), (7, passage(8, 25)), (7, passage(9, 3) + " " + passage(8, 25)), (6, common)]
    rows += [(None, passage(i, 40) + f" {i} " + common) for i in range(20, 40)]
    for order in (rows, rows[::-1]):
        check(spark.createDataFrame(order, "doc_id bigint, text string").coalesce(1).repartition(parts), 20, 3)
    two = spark.createDataFrame(rows[:2], "doc_id bigint, text string").repartition(parts)
    assert {r.n_removed for r in substring_dedup.substring_dedup(two).collect()} == {0}


def test_columns_of_any_type(spark):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [(1, passage(1, 30), at, bytearray(b"\x00\xff"), [1.5, None], 30), (2, passage(1, 30) + " end", at, None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, `a.b` timestamp, raw binary, `x y` array<double>, n_chars int")
    got = substring_dedup.without_repeats(docs)
    assert got.schema == docs.schema
    one, two = got.orderBy("doc_id").collect()
    assert tuple(one) == rows[0] and (two.text, two["a.b"], two.n_chars) == ("end", at, 3)


def test_registered_query(spark, tmp_path):
    docs = edge_docs(spark, False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op9_substring(spark, str(tmp_path)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], 20)


def test_rows_keep_their_columns(spark):
    docs = edge_docs(spark)
    out = substring_dedup.without_repeats(docs)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    assert {r.lang for r in out.collect()} == {"en", "de", None}
    assert out.where("doc_id = 2").first().text == "" and out.where("doc_id = 1").first().n_chars == 0


def test_empty(spark):
    assert substring_dedup.substring_dedup(empty_docs(spark)).count() == 0
    assert substring_dedup.without_repeats(empty_docs(spark)).count() == 0
