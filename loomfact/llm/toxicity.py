"""Toxicity by a convolutional text classifier.

Words (runs of ASCII letters and digits or of any other letters, in lower case) get a
vector from two hashed tables side by side, so that two words look alike only if both
hashes meet, and from a third one for their first bytes, which inflected words share.
Filters of several widths run over the vectors, the maximum of each over the whole text goes through a dense layer, and the result, scaled on rows kept back, is
the score.  All labelled rows take part, whole texts of any length: three quarters of
them, by a hash of the id, in learning, the rest in scale and thresholds.  Learning is
plain numpy on shards of the rows, side by side: a shard starts each round from the
network of the round before, goes twice through its rows, and what the shards make of it is
averaged, a bucket's vectors over the shards that moved them.  Few rows are one shard, which
goes through them as often in one round.

Thresholds are calibrated for each language on the rows kept back: between the highest
score of its clean rows and the lowest of its toxic ones where they part, and where the
most are right if not; a language with too few rows takes the threshold of all.

Defined results: null text counts as empty and is scored like any other; a null label is
no label, a null language is a language of its own; without both classes to learn from,
every score is the share of toxic rows (0 if there are none); labels without a document
are ignored; rows that share an id are scored each by its text, a null id like any other;
equal texts get equal scores; one text's words are held in memory as a whole, however
long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import BROADCAST_KEYS, frugal, spread, steps, stored, Tokens, trimmed, whole

BUCKETS, HALF, WIDTHS, FILTERS = 1 << 17, 4, (1, 2, 3), 8
GAP = max(WIDTHS) - 1
TABLES = 3
SIZE = TABLES * HALF
#: Bytes of a word that count as its stem.
STEM = 5
#: Words of a training batch, padding included, and of a piece of a longer text; of a shard at about; passes over the rows, and rounds they fall into where shards are many.
BATCH_WORDS, SHARD_WORDS, EPOCHS, ROUNDS, RATE = 60_000, 1_500_000, 8, 4, 0.02
#: Rows of each class that a language needs for a threshold of its own.
LEAST = 10
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c < 58 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of every word, and the number of words of each text."""
    tok = Tokens([t.translate(_FOLD) for t in texts])
    h = tok.hashes()
    tok.hi = np.minimum(tok.hi, tok.lo + STEM)
    return np.stack([h % np.uint64(BUCKETS), (h >> np.uint64(40)) % np.uint64(BUCKETS), tok.hashes() % np.uint64(BUCKETS)], axis=1).astype(np.int32), tok.count


class Network:
    """Weights, and what they make of texts."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.01, (TABLES, BUCKETS, HALF)).astype(np.float32)
        self.filters = [rng.normal(0, 0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(0)
        #: Of each bucket, the squares of its gradients so far.
        self.squares = np.zeros((TABLES, BUCKETS), np.float32)
        #: Of the score: sigmoid(scale[0] * z + scale[1]); without a fit, constant.
        self.scale = (1.0, 0.0)
        self.constant: float | None = None

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[h][buckets[..., h]] for h in range(TABLES)], axis=-1)

    def convolved(self, x: np.ndarray) -> np.ndarray:
        """x: (..., words + GAP, SIZE), the last GAP rows zero; (..., words, filters)."""
        n = x.shape[-2] - GAP
        out = np.empty((*x.shape[:-2], n, len(self.bias)), np.float32)
        for k, f in enumerate(self.filters):
            part = out[..., k * FILTERS : (k + 1) * FILTERS]
            part[...] = x[..., :n, :] @ f[0]
            for j in range(1, len(f)):
                part += x[..., j : j + n, :] @ f[j]
        return out

    def logits(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One number for each of the texts, whose words lie one after the other."""
        first = np.concatenate([[0], np.cumsum(counts + GAP)])
        x = np.zeros((first[-1] + GAP, SIZE), np.float32)
        doc = np.repeat(np.arange(len(counts)), counts)
        x[np.arange(len(buckets)) + GAP * doc] = self.vectors(buckets)
        conv = self.convolved(x)
        # windows that start in a gap reach into the next text: they stand for an empty window
        conv[(first[1:, None] - 1 - np.arange(GAP)).ravel()] = 0
        top = np.maximum.reduceat(conv, first[:-1], axis=0) if len(counts) else np.zeros((0, len(self.bias)), np.float32)
        # summed row by row, so that equal texts get equal numbers in any batch
        return (np.maximum(top + self.bias, 0).astype(np.float64) * self.dense).sum(axis=1) + float(self.shift)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        buckets, counts = _features(texts)
        return np.round(_sigmoid(self.scale[0] * self.logits(buckets, counts) + self.scale[1]), 6)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, name, value, grad):
        m, v = self.m.get(name, 0.0), self.v.get(name, 0.0)
        self.m[name], self.v[name] = m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        return value - self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


class Gradients(NamedTuple):
    """Of a batch's weighted log loss; ``vectors`` belongs to the words whose buckets are in ``words``, entries of one bucket add up."""

    filters: list[np.ndarray]
    words: np.ndarray
    vectors: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    shift: np.ndarray


def _maxima(net: Network, at: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place and value of every filter's maximum in each text; long texts go piece by piece."""
    place, top = None, None
    for a in range(0, at.shape[1] - GAP, BATCH_WORDS):
        b = min(a + BATCH_WORDS, at.shape[1] - GAP) + GAP
        conv = net.convolved(net.vectors(at[:, a:b]) * real[:, a:b])
        own = conv.argmax(axis=1)
        best = np.take_along_axis(conv, own[:, None, :], axis=1)[:, 0]
        if place is None:
            place, top = own, best
        else:
            place, top = np.where(best > top, own + a, place), np.maximum(best, top)
    return place, top


def gradients(net: Network, at: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Gradients:
    """at: buckets (texts, words + 1 + GAP, TABLES), of which ``real`` marks words; every text has an empty window."""
    place, top = _maxima(net, at, real)
    pre = top + net.bias
    act = np.maximum(pre, 0)
    dz = ((_sigmoid(act @ net.dense + net.shift) - y) * weight).astype(np.float32)
    da = dz[:, None] * net.dense * (pre > 0)
    filters, words, vectors = [], [], []
    doc = np.arange(len(at))[:, None]
    for k, f in enumerate(net.filters):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        g = np.zeros_like(f)
        for j in range(len(f)):
            where = place[:, cols] + j
            g[j] = np.einsum("df,dfs->sf", da[:, cols], net.vectors(at[doc, where]) * real[doc, where])
            words.append(at[doc, where].reshape(-1, TABLES))
            vectors.append((da[:, cols, None] * f[j].T[None] * real[doc, where]).reshape(-1, SIZE))
        filters.append(g)
    return Gradients(filters, np.concatenate(words), np.concatenate(vectors), dz @ act, da.sum(axis=0), dz.sum())


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7, start: Network | None = None, share: float | None = None) -> Network:
    """Fits a network, ``start`` if given, to (buckets of a text, label) rows; both classes weigh the same, by the share of toxic rows in all."""
    net, rng, adam = start or Network(seed), np.random.default_rng(seed), _Adam(rate)
    squares = net.squares
    y = np.array([r[1] for r in rows], np.float32)
    share = y.mean() if share is None else share
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    sizes = np.array([len(r[0]) for r in rows])
    for _ in range(epochs):
        order = np.argsort(sizes * rng.uniform(0.8, 1.25, len(sizes)), kind="stable")
        batches, start = [], 0
        for i in range(1, len(order) + 1):
            if i == len(order) or (i + 1 - start) * (sizes[order[start : i + 1]].max() + GAP) > BATCH_WORDS or i - start >= 64:
                batches.append(order[start:i])
                start = i
        for b in rng.permutation(len(batches)):
            own = batches[b]
            adam.t += 1
            longest = int(sizes[own].max()) + 1  # so that every text has an empty window
            at = np.zeros((len(own), longest + GAP, TABLES), np.int32)
            real = np.zeros((len(own), longest + GAP, 1), np.float32)
            for i, r in enumerate(own):
                at[i, : sizes[r]] = rows[r][0]
                real[i, : sizes[r]] = 1
            grads = gradients(net, at, real, y[own], weight[own] / len(own))
            for k, f in enumerate(net.filters):
                net.filters[k] = adam.step(("f", k), f, grads.filters[k]).astype(np.float32)
            for h in range(TABLES):
                ids, inverse = np.unique(grads.words[:, h], return_inverse=True)
                g = np.zeros((len(ids), HALF), np.float32)
                np.add.at(g, inverse, grads.vectors[:, h * HALF : (h + 1) * HALF])
                live = np.abs(g).max(axis=1) > 0
                ids, g = ids[live], g[live]
                squares[h][ids] += (g**2).sum(axis=1)
                net.tables[h][ids] -= 2 * rate * g / (np.sqrt(squares[h][ids])[:, None] + 1e-6)
            net.dense, net.bias = adam.step("d", net.dense, grads.dense).astype(np.float32), adam.step("b", net.bias, grads.bias).astype(np.float32)
            net.shift = np.float32(adam.step("s", net.shift, grads.shift))
    return net


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through logits, by Newton's steps on a weighted, slightly damped loss."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g = np.array([(weight * (p - y) * z).sum() + 0.01 * (a - 1), (weight * (p - y)).sum() + 0.01 * b])
        w = weight * p * (1 - p)
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 1e-3)), float(b)


def threshold(score: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The cut that gets the most rows right, of which each stands for n; the middle of the widest gap of such cuts."""
    n = np.ones(len(score), np.int64) if n is None else n
    order, at = np.unique(score, return_inverse=True)
    cuts = np.concatenate([[0.0], (order[1:] + order[:-1]) / 2, [1.0]])
    gaps = np.concatenate([[0.0], order[1:] - order[:-1], [0.0]])
    toxic, clean = (np.bincount(at, np.where((y > 0) == label, n, 0), len(order)) for label in (True, False))
    # below each cut, and of a cut of 1 the rows that score 1 aren't below
    below = np.concatenate([[0], np.arange(1, len(order)), [len(order) - (order[-1] >= 1)]])
    sums = [np.concatenate([[0], np.cumsum(c)])[below] for c in (toxic, clean)]
    right = sums[1] + toxic.sum() - sums[0]
    best = np.flatnonzero(right == right.max())
    return float(cuts[best[np.argmax(gaps[best])]])


#: Bits of a bucket; a word's buckets lie in one 64-bit number.
BITS = BUCKETS.bit_length() - 1


def _packed(buckets: np.ndarray) -> bytes:
    numbers = (buckets.astype(np.uint64) << (np.arange(TABLES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return pa.compress(numbers.tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, n: int, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _buckets(numbers: np.ndarray) -> np.ndarray:
    return (numbers[:, None] >> (np.arange(TABLES, dtype=np.uint64) * np.uint64(BITS)) & np.uint64(BUCKETS - 1)).astype(np.int32)


@frugal
def _feature_batches(batches):
    for batch in batches:
        k = np.array(batch.column(0).to_pylist(), np.int64)
        held = pa.array(k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(62) == 3)
        text = batch.column(3).cast(pa.large_binary()).to_pylist()
        sizes = np.array([len(t) for t in text], np.int64)
        for a, b in steps(sizes):
            buckets, counts = _features(text[a:b])
            cut = [_packed(x) for x in np.split(buckets, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), held.slice(a, b - a), pa.array(counts, pa.int64()), pa.array(cut, pa.large_binary())], ["k", "y", "lang", "held", "n", "words"])


def _slots(net: Network) -> np.ndarray:
    """All weights as rows of HALF numbers and a square: the buckets' first, then the rest."""
    rest = np.concatenate([*(f.ravel() for f in net.filters), net.dense, net.bias, [net.shift]]).astype(np.float32)
    rest = np.pad(rest, (0, -len(rest) % HALF)).reshape(-1, HALF)
    return np.concatenate([np.column_stack([net.tables.reshape(-1, HALF), net.squares.reshape(-1)]), np.column_stack([rest, np.zeros(len(rest), np.float32)])])


def _of_slots(slots: np.ndarray) -> Network:
    net, n = Network(), TABLES * BUCKETS
    net.tables, net.squares = slots[:n, :HALF].reshape(net.tables.shape).copy(), slots[:n, HALF].reshape(net.squares.shape).copy()
    rest, at = slots[n:, :HALF].ravel(), 0
    for k, f in enumerate(net.filters):
        net.filters[k], at = rest[at : at + f.size].reshape(f.shape).copy(), at + f.size
    net.dense, net.bias, net.shift = rest[at : at + len(net.dense)].copy(), rest[at + len(net.dense) : at + 2 * len(net.dense)].copy(), np.float32(rest[at + 2 * len(net.dense)])
    return net


@trimmed
def _shard(group: pa.Table) -> pa.Table:
    """The rows of a shard as one: labels, lengths, distinct words, and the place of each word among them."""
    group = group.sort_by([("k", "ascending"), ("words", "ascending")])
    n = group.column("n").to_numpy()
    words, at = np.unique(np.concatenate([_numbers(w, int(c)) for w, c in zip(group.column("words").to_pylist(), n)]), return_inverse=True)
    small = lambda x, kind: pa.array([pa.compress(x.astype(kind).tobytes(), codec="zstd", asbytes=True)], pa.binary())
    return pa.table([pa.array([x]) for x in (len(n), len(words), len(at))] + [small(group.column("y").to_numpy(), np.int32), small(n, np.int64), small(words, np.uint64), small(at, np.uint32)], ["rows", "distinct", "size", "y", "n", "words", "at"])


def _round(shared, turn: int, epochs: int, share: float, names: list[str], seed: int):
    """A function of shards: what a round changes of the weights that each of them moves."""

    @frugal
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                rows, distinct, size, y, n, words, at = (c[i].as_py() for c in batch.columns)
                buckets = _buckets(_numbers(words, distinct))[_numbers(at, size, np.uint32)]
                data = list(zip(np.split(buckets, np.cumsum(_numbers(n, rows, np.int64))[:-1]), _numbers(y, rows, np.int32)))
                before = _slots(shared.value)
                made = _slots(train(data, epochs, seed=seed + turn, start=_of_slots(before), share=share))
                moved = np.flatnonzero((made != before).any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(moved.astype(np.int32)), *(pa.array((made - before)[moved, j]) for j in range(HALF + 1))], ["slot", *names])

    return run


def _learnt(rows: DataFrame, shards: int, share: float, seed: int = 7) -> Network:
    """The network that rows (k, y, n, words, shard) teach, in rounds; a round brings the driver one row for a weight that moved, however many the rows."""
    net = Network(seed)
    names = [f"v{i}" for i in range(HALF + 1)]
    dealt = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(_shard, "rows bigint, distinct bigint, size bigint, y binary, n binary, words binary, at binary")
    dealt = stored(dealt, "shards")
    rounds = 1 if shards == 1 else ROUNDS
    for turn in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(net)  # fixed size
        # as multiples of 2^-40, so that sums don't hang on the order in which shards come
        exact = [F.sum(F.round(F.col(c).cast("double") * 2.0**40).cast("decimal(28,0)")).cast("double").alias(c) for c in names]
        moved = dealt.mapInArrow(_round(shared, turn, EPOCHS // rounds, share, names, seed), "slot int, " + ", ".join(f"{c} float" for c in names))
        found = moved.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), *exact).toArrow()
        slots, step = _slots(net), np.column_stack([found.column(c).to_numpy() for c in names]) / 2.0**40 / found.column("n").to_numpy()[:, None]
        slots[found.column("slot").to_numpy()] += step.astype(np.float32)
        net = _of_slots(slots)
        shared.unpersist()
    return net


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> tuple[Network, dict[str | None, float]]:
    """A network and the thresholds by language; ``None`` holds the threshold of all.

    Learns from all labelled rows of ids for which ``usable`` (a condition on the labels
    table) holds; a quarter of them, by another hash of the id, only scales the score and
    sets the thresholds.
    """
    rows = labels.where(usable) if usable is not None else labels
    marked = stored(rows.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("k"), (F.col(label_col) > 0).cast("int").alias("y")).groupBy("k").agg(F.max("y").alias("y")), "marked")
    few = marked.count() <= BROADCAST_KEYS
    found = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).cast("string").alias("lang"), whole(F.col(text_col)).alias("text")).join(F.broadcast(marked) if few else marked.hint("merge"), F.col("id") == F.col("k"))
    got = stored(found.select("k", "y", "lang", "text").mapInArrow(_feature_batches, "k bigint, y int, lang string, held boolean, n bigint, words binary"), "labelled")
    seen = {(r.held, r.y): (r.rows, r.words) for r in got.groupBy("held", "y").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("words")).collect()}
    part = lambda held, y: seen.get((held, y), (0, 0))[0]
    toxic, clean = part(True, 1) + part(False, 1), part(True, 0) + part(False, 0)
    if not part(False, 1) or not part(False, 0):
        net = Network()
        net.constant = toxic / (toxic + clean) if toxic + clean else 0.0
        return net, {}
    # shards of whole rows, by a hash of the id; each row counts once in a round
    shards = max(1, -(-sum(w for (held, _), (_, w) in seen.items() if not held) // SHARD_WORDS))
    learn = got.where("not held").select("k", "y", "n", "words", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int").alias("shard"))
    net = _learnt(learn, shards, part(False, 1) / (part(False, 1) + part(False, 0)))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size

    @frugal
    def logits(batches):
        for batch in batches:
            counts, words = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            for a, b in steps(counts * 8):
                z = shared.value.logits(_buckets(np.concatenate([_numbers(w, int(c)) for w, c in zip(words[a:b], counts[a:b])])), counts[a:b])
                # three decimals: what goes to the driver is as many rows as there are logits, not as there are texts
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.round(z, 3))], ["lang", "y", "z"])

    both = part(True, 1) and part(True, 0)
    test = got.where("held" if both else "not held").select(F.coalesce("lang", F.lit("")).alias("lang"), "y", "n", "words").mapInArrow(logits, "lang string, y int, z double")
    table = stored(test.groupBy("lang", "y", "z").agg(F.count(F.lit(1)).alias("n")), "logits")
    every = table.groupBy("y", "z").agg(F.sum("n").alias("n")).orderBy("z", "y").toArrow()
    y, z, n = (every.column(c).to_numpy() for c in ("y", "z", "n"))
    weight = n * np.where(y > 0, toxic / n[y > 0].sum(), clean / n[y == 0].sum()) / (toxic + clean) * n.sum()
    net.scale = slope, offset = calibrate(z, y, weight)
    cuts: dict[str | None, float] = {None: threshold(_sigmoid(slope * z + offset), y, n)}

    def cut(group: pa.Table) -> pa.Table:
        y, z, n = (group.column(c).to_numpy() for c in ("y", "z", "n"))
        enough = min(n[y > 0].sum(), n[y == 0].sum()) >= LEAST
        return pa.table({"lang": group.column("lang")[:1], "cut": pa.array([threshold(_sigmoid(slope * z + offset), y, n) if enough else None], pa.float64())})

    return net, cuts | {r.lang: r.cut for r in table.groupBy("lang").applyInArrow(cut, "lang string, cut double").where("cut is not null").collect()}


def score_table(docs: DataFrame, net: Network, cuts: dict[str | None, float], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, score, toxic (by its language's threshold); the language has no part in the score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: TABLES * BUCKETS * HALF numbers

    @frugal
    def run(batches):
        net = shared.value
        for batch in batches:
            text = batch.column(2).cast(pa.large_binary())
            for a, b in steps(np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]), 2 << 20):
                score = net.scores(text.slice(a, b - a).to_pylist())
                cut = [cuts.get(x or "", cuts.get(None, 0.5)) for x in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), pa.array(score >= np.array(cut))], ["id", "score", "toxic"])

    rows = spread(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).cast("string").alias("lang"), whole(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "id bigint, score double, toxic boolean")


def clean(docs: DataFrame, net: Network, cuts: dict[str | None, float], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, that aren't toxic by their language's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    @frugal
    def run(batches):
        net = shared.value
        for batch in batches:
            text = [t or b"" for t in batch.column(text_at).cast(pa.large_binary()).to_pylist()]
            keep = np.ones(len(text), bool)
            for a, b in steps(np.array([len(t) for t in text], np.int64), 2 << 20):
                cut = [cuts.get(x or "", cuts.get(None, 0.5)) for x in batch.column(lang_at).slice(a, b - a).to_pylist()]
                keep[a:b] = net.scores(text[a:b]) < np.array(cut)
            yield batch.filter(pa.array(keep))

    # by number: names may hold dots
    numbered = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    return spread(docs).toDF(*numbered.names).mapInArrow(run, numbered).toDF(*docs.columns)
