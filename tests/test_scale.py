"""What is left out on the way to a result, and that the result is whole."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomfact.operators import compare, lexicon


def test_shortest_path_keeps_out_of_dead_ends(spark, monkeypatch):
    # 400 leaves below each of two nodes, which a ring through them would all take in
    edges = [(f"s{i}", f"n{i % 2}") for i in range(800)] + [("n0", "r"), ("n1", "r"), ("n0", "q"), ("n1", "q"), ("x", "y")]
    table = spark.createDataFrame(edges, "child string, parent string")
    none = spark.createDataFrame([], "id string")
    pairs = [(f"s{i}", f"s{i + 1}") for i in range(0, 40)] + [("s0", "s2"), ("s0", "n0"), ("r", "s5"), ("x", "y"), ("y", "x"), ("x", "s1"), ("s3", "s3"), ("gone", "s1")]
    rows = []

    class Counted(lexicon.Table):
        def add(self, part):
            out = super().add(part)
            if "/rings-" in self.base:
                rows.append(out.count())
            return out

    monkeypatch.setattr(lexicon, "Table", Counted)
    lex = lexicon.Lexicon(none, none, none, none, none, none, none, table)
    got = {(r.l, r.r): r.path for r in lex.shortest_path(spark.createDataFrame(pairs, "l string, r string")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a, b in pairs:
        ring, seen = {a: [a]}, {a}
        while ring and b not in ring:
            step = {}
            for n, p in ring.items():
                for m in near.get(n, set()) - seen:
                    step[m] = min(step.get(m, [*p, m]), [*p, m])
            ring, seen = step, seen | set(step)
        assert got[(a, b)] == ring.get(b), (a, b)
    assert len(got) == len(pairs) and sum(rows) < 10 * len(pairs)


@pytest.mark.parametrize("required", [["brand", "kind"], None])
def test_nearest_scores_equal_records_once(spark, monkeypatch, required):
    rng = random.Random(4)
    seen = [(rng.choice([None, 1.0, 2.5, 7.0]), rng.choice(["red", "Red", "blue", None]), rng.choice(["a", "b", None]), rng.choice([1, None])) for _ in range(300)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(seen)], "id int, size double, colour string, brand string, kind int")
    rows = {}

    def stored(df, name):
        out = real(df, name)
        rows[name] = out.count()
        return out

    real = compare.stored
    monkeypatch.setattr(compare, "stored", stored)
    monkeypatch.setattr(compare, "TASK_PAIRS", 40)
    monkeypatch.setattr(compare, "CELL_PAIRS", 15)
    asked = table.where("id % 4 = 0")
    got = {}
    for r in compare.nearest(asked, table, "id", "id", ["size", "colour"], 3, required).collect():
        got.setdefault(r.input, {})[r["rank"]] = (r.candidate, r.similarity, r.differences)
    pairs = asked.select(F.col("id").alias("i"), F.struct("size", "colour").alias("l"), F.struct("brand", "kind").alias("lk")).crossJoin(table.select(F.col("id").alias("c"), F.struct("size", "colour").alias("r"), F.struct("brand", "kind").alias("rk")))
    want = {}
    for r in compare.compare_pairs(pairs, "l", "r", mode="exact").collect():
        if not required or r.lk == r.rk:
            want.setdefault(r.i, []).append((-r.similarity, r.c, r.differences))
    assert set(got) == set(want)
    for i, all_of in want.items():
        best = sorted(all_of)[:3]
        assert [(c, d) for _, c, d in best] == [(got[i][k][0], got[i][k][2]) for k in range(1, len(best) + 1)]
        assert all(abs(got[i][k][1] + s) < 1e-12 for k, (s, _, _) in enumerate(best, 1))
    assert rows["candidates"] == len(set(seen) if required else {r[:2] for r in seen}) and rows["inputs"] <= rows["candidates"]


def likest(rows, asked, count):
    """By plain Python: the ids most like each, of (id, number, text of one letter)."""

    def number(x, y):
        if x is None or y is None:
            return float(x is y)
        like = 1 - abs(x - y) / max(abs(x), abs(y), 1e-9)
        return 0.25 + 0.75 * (like if math.isnan(like) else max(0.0, like))

    out = {}
    for i, x, t in asked:
        scores = [(0.25 + 0.75 * (number(x, y) + (1.0 if t == u else 0.0 if None in (t, u) else 0.25)) / 2, j) for j, y, u in rows]
        out[i] = [j for _, _, j in sorted((not math.isnan(s), 0.0 if math.isnan(s) else -s, j) for s, j in scores)[:count]]
    return out


def found(spark, rows, asked, count):
    table = lambda rows: spark.createDataFrame(rows, "id int, size double, colour string")
    out = {}
    for r in sorted(compare.nearest(table(asked), table(rows), "id", "id", ["size", "colour"], count).collect(), key=lambda r: r["rank"]):
        out.setdefault(r.input, []).append(r.candidate)
    return out


def test_nearest_meets_shapes_not_records(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, round(rng.uniform(900, 1000), 6), rng.choice("abcd")) for i in range(3000)]
    asked = rows[::20]
    pairs = []

    def dealt(left, right, *rest):
        pairs.append(left.count() * right.count())
        return real(left, right, *rest)

    real = compare._dealt
    monkeypatch.setattr(compare, "_dealt", dealt)
    assert found(spark, rows, asked, 3) == likest(rows, asked, 3)
    assert sum(pairs) <= 100


@pytest.mark.parametrize("count", [1, 3])
def test_nearest_by_odd_numbers(spark, count):
    rng = random.Random(5)
    inf, nan = float("inf"), float("nan")
    sizes = [None, 0.0, -0.0, 1e-12, -3.0, -2.0, 5.0, 1e308, -1e308, *[1.0 + k * 2.0**-52 for k in range(9)], 1e18, *[1000.0 * k for k in range(1, 9)], *[-7.0 * k for k in range(1, 7)]]
    rows = [(s, c) for s in [*sizes, inf, -inf, nan] for c in ["a", "b", None]] * 2
    rng.shuffle(rows)
    rows = [(i, *r) for i, r in enumerate(rows)]
    assert found(spark, rows, rows, count) == likest(rows, rows, count)
    # without infinite numbers, and with texts that one side lacks
    plain = [r for r in rows if r[1] is None or math.isfinite(r[1])]
    asked = [(r[0], r[1], "c") for r in plain[::3]]
    assert found(spark, plain, asked, count) == likest(plain, asked, count)
