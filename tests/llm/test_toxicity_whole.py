"""Every labelled row, however many and however long, takes part."""

import numpy as np
from pyspark.sql import functions as F

from loomfact.llm import toxicity

from .frames import SCHEMA, passage
from .test_toxicity import LABELS, labelled


def test_long_texts_and_many_rows_teach(spark, monkeypatch):
    # toxic words only in texts of more than 32 kB, and many shards
    rows, labels = [], []
    for i in range(120):
        rows.append((i, passage(i, 20) + " filler" * 6_000 + (" scoundrel" if i % 2 else ""), "en", "s", 0))
        labels.append((i, 1, i % 2))
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 150_000)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    net, cuts = toxicity.fit(docs, marks, F.col("doc_id") % 3 != 0)
    got = {r.id: r for r in toxicity.score_table(docs, net, cuts).collect()}
    assert np.mean([(got[i].score >= 0.3) == bool(i % 2) for i in range(0, 120, 3)]) > 0.9


def test_every_row_is_in_one_shard(spark, monkeypatch):
    rows, labels = labelled(400)
    seen = []

    def learnt(rows, shards, share):
        seen.append((shards, rows.select("k", "y", "shard").collect()))
        return real(rows, shards, share)

    real = toxicity._learnt
    monkeypatch.setattr(toxicity, "_learnt", learnt)
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 4_000)
    docs = spark.createDataFrame(rows, SCHEMA)
    net, cuts = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    shards, learn = seen[0]
    held = {i for i in range(400) if i * 0x9E3779B97F4A7C15 % (1 << 64) >> 62 == 3}
    assert shards > 2 and sorted((r.k, r.y) for r in learn) == [(i, y) for i, _, y in labels if i not in held]
    got = {r.id: r.score for r in toxicity.score_table(docs, net, cuts).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(labels[i][2]) for i in held]) > 0.9


def test_maxima_by_pieces(monkeypatch):
    net, rng = toxicity.Network(3), np.random.default_rng(1)
    at = rng.integers(0, toxicity.BUCKETS, (2, 40, toxicity.TABLES)).astype(np.int32)
    real = np.ones((2, 40, 1), np.float32)
    whole = toxicity._maxima(net, at, real)
    monkeypatch.setattr(toxicity, "BATCH_WORDS", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, toxicity._maxima(net, at, real)))


def test_threshold_counts():
    rng = np.random.default_rng(0)
    for _ in range(200):
        score, y, n = np.round(rng.random(9), 1), rng.integers(0, 2, 9), rng.integers(1, 4, 9)
        assert toxicity.threshold(score, y, n) == toxicity.threshold(np.repeat(score, n), np.repeat(y, n))
        order = np.unique(score)
        cuts = [0.0, *(order[1:] + order[:-1]) / 2, 1.0]
        gaps = [0.0, *(order[1:] - order[:-1]), 0.0]
        right = [(((score >= c) == (y > 0)) * n).sum() for c in cuts]
        assert toxicity.threshold(score, y, n) == max(zip(right, gaps, [-i for i in range(len(cuts))], cuts))[3]
