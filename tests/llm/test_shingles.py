import random

import numpy as np

import corpus_pipeline
from loomfact.llm import shingle_dedup as S

from .frames import edge_docs, empty_docs, passage

SCHEMA = "doc_id bigint, text string, lang string"


def shingle_set(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def altered(seed, text, n):
    """n words apart, anywhere, become new ones."""
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def survivors(texts):
    """Smallest number of each component of the texts that are alike."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return {r for r in root}


def kept(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(corpus_pipeline.near_copies(spark, docs, "").collect(), key=str)


def test_near_copies_by_similarity(spark):
    texts = []
    for i in range(40):
        words = [300, 1000][i % 2]
        base = " ".join(f"w{random.Random(i * 5000 + j).randrange(5000)}" for j in range(words))
        texts += [base, altered(i, base, words // (50 + i)), altered(-i, base, words // 15)]
    want = survivors(texts)
    assert 40 < len(want) < 90
    got = kept(spark, [(i, t, "en") for i, t in enumerate(texts)])
    assert {r.doc_id for r in got} == want


def test_a_group_apart_from_its_smallest_is_joined():
    far, one = np.arange(100), np.arange(1000, 1100)
    sets = [far, one, one + 5, one + 300, np.arange(20)]
    label = np.array([0, 1, 2, 3, 0])
    pairs = S.similar_pairs(sets, label, 0.8)
    assert pairs == [(1, 2)] or pairs == [(2, 1)]


def test_chance_to_meet():
    for similar in (0.7, 0.8, 0.9):
        assert (1 - similar**S.ROWS) ** S.bands_for(similar) <= S.MISSED


def test_rows_not_ids_go(spark):
    base = passage(7, 120)
    rows = [(1, base, "a"), (None, base + " end", "b"), (None, "alone without id", "c"), (2, base + " stop", "d"), (2, "alone with a shared id", "e"), (3, "twice", "f"), (3, "twice", "f"), (None, "  ", "g"), (4, None, "h")]
    got = [(r.doc_id, r.text) for r in kept(spark, rows)]
    assert sorted(got, key=str) == sorted([(1, base), (None, "alone without id"), (2, "alone with a shared id"), (3, "twice"), (4, None)], key=str)


def test_empty_and_edges(spark):
    assert corpus_pipeline.near_copies(spark, empty_docs(spark), "").count() == 0
    docs = edge_docs(spark)
    got = corpus_pipeline.near_copies(spark, docs, "")
    texts = [r.text for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))]
    assert got.columns == docs.columns and got.count() == len(survivors(texts))
