import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomfact.llm import hpylm
from loomfact.llm.queries import op2_hpylm

from .frames import SCHEMA, edge_docs, empty_docs, passage


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def check(docs, got=None):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(w for i, t in rows if not hpylm.is_held_out(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, hpylm.is_held_out(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows), key=str)
    got = hpylm.score(docs).withColumnRenamed("id", "doc_id").collect() if got is None else got
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=str) == want
    assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in got)
    return got


def test_edge_documents(spark):
    got = check(edge_docs(spark))
    by_text = defaultdict(set)
    texts = {r.doc_id: r.text for r in edge_docs(spark).collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            by_text[texts[r.doc_id] or ""].add(r.score)
    assert all(len(x) == 1 for x in by_text.values())


def test_registered_query(spark, tmp_path):
    docs = edge_docs(spark, False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    check(docs, op2_hpylm(spark, str(tmp_path)).collect())


def test_model_beats_its_base(spark):
    text = lambda i: passage(i, 200) if i % 2 else " ".join(w[::-1] for w in passage(i, 200).split())
    got = check(spark.createDataFrame([(i, text(i), "en", "s", 0) for i in range(80)], SCHEMA))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_whose_sums_collide(spark):
    """Thue-Morse words and their complements have equal sums in any ring of 64 bits; they are words of their own."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << 11))
    other = one.translate(str.maketrans("ab", "ba"))
    held = next(i for i in range(100) if hpylm.is_held_out(i))
    train = next(i for i in range(100) if not hpylm.is_held_out(i))
    got = {r.id: r for r in hpylm.score(spark.createDataFrame([(train, one, "en", "s", 0), (held, f"{one} {other}", "en", "s", 0)], SCHEMA)).collect()}
    assert got[held].n_known == 2 and got[held].n_tokens == 3


def test_stirling_numbers():
    """Against the sum over all seatings of five customers."""
    d = 0.4
    weights = Counter()

    def seat(tables, left, weight):
        if not left:
            weights[len(tables)] += weight
            return
        seat([*tables, 1], left - 1, weight)
        for k in range(len(tables)):
            seat([*tables[:k], tables[k] + 1, *tables[k + 1 :]], left - 1, weight * (tables[k] - d))

    seat([1], 4, 1.0)
    got = np.exp(hpylm.stirling(d, 5)[10:15])
    assert got == pytest.approx([weights[t] for t in range(1, 6)])


@pytest.mark.parametrize("c", [2, 3, 17, 900, 1500, 3000])
@pytest.mark.parametrize("n, t", [(3, 2), (0, 1), (1, 3), (1100, 40)])
def test_draws_follow_the_conditional(c, n, t):
    """Means and spreads of drawn table counts, against weights summed one by one; also beyond the tables, by the scaling limit."""
    d, above, theta, others, total = 0.6, 0.4, 1.5, 40.0, 900.0 if n < 900 else 50_000.0
    if c < t - n:
        return
    size = max(c, n + c)
    own = hpylm.stirling(d, c)[-c:]
    up = hpylm.stirling(above, size)
    at = np.arange(n + 1, n + c + 1)
    there = at >= t
    parent_weight = np.where(there, up[np.where(there, at * (at - 1) // 2 + t - 1, 0)], -np.inf)
    j = np.arange(c)
    weight = own + np.cumsum(np.log(theta + d * (others + j)) - np.log(0.7 + total + j)) + parent_weight
    p = np.exp(weight - weight.max())
    p /= p.sum()
    mean = (p * (j + 1)).sum()
    spread = math.sqrt((p * (j + 1 - mean) ** 2).sum())
    many = 4000
    parent = hpylm.Parent(np.full(many, n), np.full(many, t), 0.7, np.full(many, total), above)
    got = hpylm.draw(np.random.default_rng(c), np.full(many, c), np.full(many, others), theta, d, parent)
    assert got.min() >= max(1, t - n) and got.max() <= c
    assert got.mean() == pytest.approx(mean, abs=5 * spread / math.sqrt(many) + (0.01 * mean if c > hpylm.EXACT else 0))
    assert got.std() == pytest.approx(spread, rel=0.1, abs=0.03)


# --- a sampler that seats customers one by one -------------------------------


class Restaurant:
    """Customers of each dish by table, one parent above."""

    def __init__(self, theta, d, parent, rng):
        self.theta, self.d, self.parent, self.rng = theta, d, parent, rng
        self.tables = defaultdict(list)
        self.c = self.t = 0

    def p(self, w):
        own = self.tables[w]
        base = self.parent.p(w)
        return (sum(own) - self.d * len(own) + (self.theta + self.d * self.t) * base) / (self.theta + self.c) if self.c else base

    def add(self, w):
        own = self.tables[w]
        weights = [x - self.d for x in own] + [(self.theta + self.d * self.t) * self.parent.p(w)]
        k = self.rng.choices(range(len(weights)), weights)[0]
        self.c += 1
        if k == len(own):
            own.append(1)
            self.t += 1
            self.parent.add(w)
        else:
            own[k] += 1

    def remove(self, w):
        own = self.tables[w]
        k = self.rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        self.c -= 1
        if not own[k]:
            own.pop(k)
            self.t -= 1
            self.parent.remove(w)


class Uniform:
    def __init__(self, n):
        self.n = n

    def p(self, w):
        return 1 / self.n

    def add(self, w):
        pass

    remove = add


def discounts(pairs):
    return hpylm.discount(sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values()))


def one_by_one(rows, theta, d, d0, sweeps, seed=1):
    """Averaged probability of every (context, word) asked for, by customers that are seated one by one."""
    rng = random.Random(seed)
    train = [(a, b) for i, t in rows if not hpylm.is_held_out(i) for a, b in zip(["", *words(t)], words(t))]
    vocab = {b for _, b in train}
    top = Restaurant(hpylm.THETA, d0, Uniform(len(vocab) + 1), rng)
    own = defaultdict(lambda: Restaurant(theta, d, top, rng))
    for a, b in train:
        own[a].add(b)
    total = Counter()
    asked = {(a, b) for _, t in rows for a, b in zip(["", *words(t)], words(t))}
    for k in range(sweeps):
        for a, b in rng.sample(train, len(train)):
            own[a].remove(b)
            own[a].add(b)
        if k >= sweeps // 5:
            for a, b in asked:
                total[a, b] += own[a].p(b) if a in own else top.p(b)
    kept = sweeps - sweeps // 5
    return {x: total[x] / kept for x in asked}


def test_scores_of_a_sampler_that_seats_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(hpylm, "PRIOR", (2e6, 1e6))  # holds the concentration at 2
    rng = random.Random(4)
    names = [f"w{k}" for k in range(25)]
    rows = [(i, " ".join(rng.choices(names, [1 / (k + 1) for k in range(25)], k=rng.randint(3, 30)))) for i in range(60)]
    rows.append((next(i for i in range(100, 200) if hpylm.is_held_out(i)), "w1 never w2 seen w24 w23"))
    got = {r.id: r.score for r in hpylm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), sweeps=16).collect()}
    train = [(a, b) for i, t in rows if not hpylm.is_held_out(i) for a, b in zip(["", *words(t)], words(t))]
    d = discounts(Counter(train))
    # the parent's discount follows from how many contexts have a table for a word: most often one for each pair
    d0 = discounts(Counter(b for _, b in set(train)))
    want = one_by_one(rows, 2.0, d, d0, 150)
    for i, t in rows:
        w = words(t)
        expected = sum(math.log10(want[a, b]) for a, b in zip(["", *w], w))
        assert got[i] == pytest.approx(expected, abs=0.03 * len(w))
    assert sum(got.values()) == pytest.approx(sum(math.log10(want[a, b]) for _, t in rows for a, b in zip(["", *words(t)], words(t))), rel=0.01)


def test_probabilities_add_up(spark):
    """Of all words and the unknown one after each context, hot or not, from the shard's own tables."""
    rng = random.Random(9)
    names = [f"w{k}" for k in range(12)]
    train = [i for i in range(400) if not hpylm.is_held_out(i)]
    held = [i for i in range(400) if hpylm.is_held_out(i)]
    rows = [(i, " ".join(rng.choices(names, k=20))) for i in train]
    # held-out texts bring every pair, and one word that was never seen
    rows += [(i, " ".join(f"{a} {b}" for b in [*names, "unseen"])) for i, a in zip(held, [*names, "other"])]
    rows += [(held[-1], " ".join(names)), (held[-2], "unseen")]
    seen = {}
    original = hpylm.predictive

    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    for hot in ([], [b"w0", b"w3"]):
        asked = pd.DataFrame(texts.repartition(1).mapInArrow(hpylm._ask(1, hot, hpylm.is_held_out, True), hpylm.ASK).toPandas())
        for c in asked.columns[2:]:
            asked[c] = [bytes(x) if x is not None else None for x in asked[c]]
        shard = hpylm.Shard(asked, 1)
        state = hpylm._open(1, hot)(asked)
        told = pd.DataFrame([{**x, "source": 0} for x in state["out"].iloc[0]])
        parent = hpylm._parent_open(told)
        sums = 5 + 2 * len(hot)
        now, above, sweeps = hpylm.Totals(np.array(state["totals"].iloc[0]), len(hot)), hpylm.Above(np.array(parent["totals"].iloc[0])), []
        for k in range(3):
            replies = pd.DataFrame([{**x, "shard": 0} for x in parent["out"].iloc[0]])
            state = hpylm._sweep(now, above, len(hot), k, k > 0)(state, replies)
            after = hpylm.Totals(np.array(state["totals"].iloc[0]), len(hot), 0.7)
            assert len(state["totals"].iloc[0]) == sums
            if k:
                sweeps.append((now, after, above))
            told = pd.DataFrame([{**x, "source": 0} for x in state["out"].iloc[0]])
            parent = hpylm._parent_sweep(above, k)(parent, told)
            now, above = after, hpylm.Above(np.array([*parent["totals"].iloc[0][:3], above.tokens, *parent["totals"].iloc[0][4:]]))
        p = original(shard, shard.hot(hot), list(state["kept"].iloc[0]), sweeps)
        us, ws = shard.u.to_pylist(), shard.w.to_pylist()
        by = {(us[u], ws[w]): x for u, w, x in zip(shard.pu, shard.pw, p)}
        for a in names:
            a = a.encode()
            # the end of a text is a word like any other; pairs of it that no text asks for are left out
            total = sum(by[a, b.encode()] for b in names) + by[a, b"unseen"]
            assert total + by.get((a, b""), 0.0) == pytest.approx(1, abs=1e-9) or ((a, b"") not in by and total < 1)
        assert any((a.encode(), b"") in by for a in names)
        seen[len(hot)] = by
    # hot contexts have the same totals, thus much the same probabilities
    assert all(seen[0][x] == pytest.approx(seen[2][x], rel=0.5) for x in seen[0])


def test_hot_contexts_are_dealt_by_their_words(spark, monkeypatch):
    rows = [(i, " ".join(f"the {w}" for w in passage(i, 60).split())) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = {r.id: r.score for r in hpylm.score(docs).collect()}
    monkeypatch.setattr(hpylm, "hot_words", lambda rows: [])
    cold = {r.id: r.score for r in hpylm.score(docs).collect()}
    assert all(whole[i] == pytest.approx(cold[i], rel=0.03) for i in whole)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if hpylm.is_held_out(i))
    row = hpylm.score(spark.createDataFrame([(held, "a b", "en", "s", 0)], SCHEMA)).first()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 3) and row.score == pytest.approx(0)
    assert hpylm.score(empty_docs(spark)).count() == 0
