import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomfact.llm import toxicity
from loomfact.llm.queries import op7_toxicity

from .frames import SCHEMA, edge_docs, empty_docs, passage

LABELS = "doc_id bigint, quality int, toxic int"


def labelled(n):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        text = passage(i, rng.randint(20, 120)).split()
        for _ in range(rng.randint(2, 5) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["scoundrel", "Blockhead,", "nitwit", "vermin."]))
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), "s", 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_learns_and_generalises(spark):
    rows, labels = labelled(600)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    net, cuts = toxicity.fit(docs, marks, F.col("doc_id") % 3 != 0)
    got = {r.id: r for r in toxicity.score_table(docs, net, cuts).collect()}
    held = [(got[i].score, got[i].toxic, y) for i, _, y in labels if i % 3 == 0]
    assert np.mean([(s >= 0.3) == bool(y) for s, _, y in held]) > 0.95 and np.mean([t == bool(y) for _, t, y in held]) > 0.95
    assert {None, "en", "de"} >= set(cuts)
    kept = toxicity.clean(docs, net, cuts)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].toxic}


def test_edges(spark):
    rows, labels = labelled(200)
    net, cuts = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (10**6, 1, 1), (3, 1, None)], LABELS))
    docs = edge_docs(spark)
    got = toxicity.score_table(docs, net, cuts).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r, d in zip(sorted(got, key=lambda r: str(r.id)), sorted(docs.collect(), key=lambda r: str(r.doc_id))):
        if d.doc_id is not None:
            assert by_text.setdefault(d.text or "", r.score) == r.score
    assert toxicity.score_table(empty_docs(spark), net, cuts).count() == 0 and toxicity.clean(docs, net, cuts).columns == docs.columns


def test_without_labels(spark):
    docs = edge_docs(spark)
    net, cuts = toxicity.fit(docs, spark.createDataFrame([], LABELS))
    assert {r.score for r in toxicity.score_table(docs, net, cuts).collect()} == {0.0}
    assert toxicity.clean(docs, net, cuts).count() == docs.count()


def test_long_text_is_read_to_its_end():
    rng = np.random.default_rng(0)
    rows = [(toxicity._features([(" ".join(["word"] * rng.integers(5, 30)) + (" vermin" if y else "")).encode()])[0], y) for y in [0, 1] * 100]
    net = toxicity.train(rows)
    z = [net.logits(*toxicity._features([t])) for t in (b"word " * 50_000, b"word " * 50_000 + b"vermin")]
    assert z[1] > z[0] + 1


def naive(net, buckets):
    """The logit of one text, number by number."""
    words = [[float(net.tables[h][row[h]][k]) for h in range(toxicity.TABLES) for k in range(toxicity.HALF)] for row in buckets.tolist()]
    z = float(net.shift)
    for c in range(len(net.bias)):
        f = net.filters[c // toxicity.FILTERS][:, :, c % toxicity.FILTERS]
        best = 0.0  # an empty window
        for start in range(len(words)):
            best = max(best, sum(float(f[j, k]) * words[start + j][k] for j in range(len(f)) if start + j < len(words) for k in range(toxicity.SIZE)))
        z += max(best + float(net.bias[c]), 0.0) * float(net.dense[c])
    return z


def some_network():
    net, rng = toxicity.Network(3), np.random.default_rng(1)
    net.tables = rng.normal(0, 0.5, net.tables.shape).astype(np.float32)
    net.bias = rng.normal(0, 0.2, len(net.bias)).astype(np.float32)
    return net


def test_forward_pass_number_by_number():
    net = some_network()
    texts = [b"", b"one", b"two words", b"a rather longer text, of some words: one two", b"x " * 30]
    buckets, counts = toxicity._features(texts)
    cut = np.cumsum([0, *counts])
    want = [naive(net, buckets[a:b]) for a, b in zip(cut, cut[1:])]
    assert np.allclose(net.logits(buckets, counts), want, atol=1e-4)
    assert np.allclose([net.logits(*toxicity._features([t]))[0] for t in texts], want, atol=1e-4)


def test_gradients_by_differences():
    net, rng = some_network(), np.random.default_rng(2)
    texts = [b"one two three four", b"five six", b"one"]
    parts = [toxicity._features([t])[0] for t in texts]
    longest = max(map(len, parts)) + 1
    at, real = np.zeros((3, longest + toxicity.GAP, toxicity.TABLES), np.int32), np.zeros((3, longest + toxicity.GAP, 1), np.float32)
    for i, p in enumerate(parts):
        at[i, : len(p)], real[i, : len(p)] = p, 1
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.2, 0.3])

    def loss():
        z = np.array([naive(net, p) for p in parts])
        p = 1 / (1 + np.exp(-z))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    def slope(array, place, eps=1e-3):
        old = array[place]
        array[place] = old + eps
        up = loss()
        array[place] = old - eps
        down = loss()
        array[place] = old
        return (up - down) / (2 * eps)

    g = toxicity.gradients(net, at, real, y, weight)
    for k, f in enumerate(net.filters):
        for _ in range(6):
            place = tuple(rng.integers(0, n) for n in f.shape)
            assert abs(slope(f, place) - g.filters[k][place]) < 2e-3
    for c in range(0, len(net.dense), 5):
        assert abs(slope(net.dense, c) - g.dense[c]) < 2e-3 and abs(slope(net.bias, c) - g.bias[c]) < 2e-3
    for h in range(toxicity.TABLES):
        for b in parts[0][:, h]:
            own = g.vectors[g.words[:, h] == b][:, h * toxicity.HALF : (h + 1) * toxicity.HALF].sum(axis=0)
            for k in range(toxicity.HALF):
                assert abs(slope(net.tables[h], (b, k)) - own[k]) < 2e-3


def test_registered_query(spark, tmp_path):
    rows, labels = labelled(400)
    rows += [(None, rows[0][1], "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    got = op7_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
