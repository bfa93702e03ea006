import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfact.llm import exact_dedup

from .frames import SCHEMA, edge_docs, empty_docs


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).digest()


@given(st.sets(st.binary(min_size=32, max_size=32), max_size=300), st.sets(st.binary(min_size=32, max_size=32), max_size=50))
@settings(deadline=None, max_examples=40)
def test_perfect_hash(inside, outside):
    inside = sorted(inside)
    keys = np.frombuffer(b"".join(inside), np.uint64).reshape(-1, 4)
    sizes, bits, slots = exact_dedup.perfect_hash(keys)
    assert sorted(slots.tolist()) == list(range(len(inside)))
    assert (exact_dedup.find(keys, sizes, bits) == slots).all()
    rest = sorted(outside - set(inside))
    found = exact_dedup.find(np.frombuffer(b"".join(rest), np.uint64).reshape(-1, 4), sizes, bits)
    assert all(s < len(inside) for s in found.tolist())


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(digest(text), []).append(i)
    low = {d: min((i for i in ids if i is not None), default=None) for d, ids in groups.items()}
    return sorted(((i, low[digest(t)], len(groups[digest(t)]), i == low[digest(t)]) for i, t in rows), key=str)


def test_against_brute_force(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for history in (None, F.lit(True), F.lit(False), F.col("id") > 5):
        got = exact_dedup.exact_dedup(docs, history)
        assert sorted([(r.id, r.keep_id, r.group_size, r.kept) for r in got.collect()], key=str) == brute(rows)


def test_index_tells_members(spark):
    rows = exact_dedup.digests(edge_docs(spark))
    index = exact_dedup.build_index(exact_dedup.grouped(rows), 3)
    other = spark.createDataFrame([(100, "quite another text", "en", "x", 0), (101, None, "en", "x", 0)], SCHEMA)
    got = {r.digest: r.member for r in exact_dedup.merge(exact_dedup.grouped(exact_dedup.digests(other)), index, 3).collect()}
    assert got[digest("quite another text")] is False and got[digest("")] is True


def test_empty(spark):
    assert exact_dedup.exact_dedup(empty_docs(spark)).count() == 0
