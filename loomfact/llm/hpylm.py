"""Language-model scores from a hierarchical Pitman-Yor process over word pairs.

Every word that comes before another is a context with a restaurant of its own: its
customers are the tokens that follow it, its dishes their words, whatever the number of
contexts.  The end of a text is a token too, and the context of the next text's first
word.  All context restaurants share one parent, the unigram restaurant, whose base is
uniform over the training words and one unknown word; every table of a context is a
customer of the parent.  Words are compared as bytes throughout.

Seating is sampled by Gibbs sweeps over the number of tables of each (context, word).
Its conditional weight, all other tables given, is a generalised Stirling number (which
sums the seatings of one pair's customers over so many tables) times the weights of
opening those tables in the context, and of their customers at the parent's tables.  Pairs of up to ``EXACT``
customers are drawn from exact tables of these numbers; larger ones from their scaling
limit, which is off by less than a hundredth of the mean number of tables
(``tests/llm/test_hpylm.py`` measures it), on at most ``GRID`` places.  Pairs are dealt
at random to ``TURNS`` turns; those of one turn are drawn side by side from the totals
before it, and the parent's customers and tables are those of the sweep before: the
usual approximation of distributed Gibbs sampling.  The concentration of the contexts is
sampled with auxiliary variables, that of the parent is fixed at one; discounts are set
from the counts of pairs (and, at the parent, of words) seen once and twice.
Probabilities are averaged over the sweeps after the first.

Contexts are sharded by their word; those with more than one in ``HOT`` of all tokens
(fewer than ``HOT`` words, whatever the input) are dealt by the word that follows, and
have only their totals in common.  A text goes to each shard as pairs, counted for a
piece of many texts.  A shard's words meet those of the others in the parent's shards:
each sweep sends the number of tables of each word there, and gets back the parent's
customers and tables.  At the end the pairs travel again, each with the texts it stands
in; the shards rebuild their restaurants, and return a sum for each text.

Defined results: null text counts as empty and has just its end token; null ids are
training rows (their text for the remainder is empty); without any training token the
model is its base, with a vocabulary of none; rows that share an id are documents of
their own, equal texts get equal scores; one text is held in memory as a whole, however
long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, frugal, ragged, ring, shuffles, spread, steps, stored, trimmed, whole

#: Sweeps, the first of which isn't averaged; turns of a sweep.
SWEEPS, TURNS = 3, 4
#: Customers of a pair up to which Stirling numbers are tabulated; places of the grid beyond.
EXACT, GRID = 1_024, 257
#: A context with more than this part of all tokens is hot; words of a step that are counted for it.
HOT = 256
#: Bytes of text that are counted together, of a shard, and of a shard of the parent, on average at most.
PIECE_BYTES, SHARD_BYTES, PARENT_BYTES = 8 << 20, 20_000_000, 64_000_000
#: Shards of the parent at least; more would only add to the messages, of which every shard sends one to each.
PARENTS = 16
#: Concentration of the parent, and shape and rate of the prior of the contexts'.
THETA, PRIOR = 1.0, (1.0, 1.0)
#: The token that ends a document; no word is empty.
END = b""
ASK = "shard int, piece bigint, u binary, un binary, w binary, wi binary, n binary, times binary, doc binary, meta binary"
OUT = "array<struct<to: int, words: binary, c: binary, t: binary>>"
STATE = f"shard int, ends binary, single_u binary, single_w binary, mu binary, mw binary, mn binary, t binary, hot binary, kept array<binary>, totals array<double>, out {OUT}"
PARENT = "shard int, sources array<int>, routes array<binary>, t binary, totals array<double>, out array<struct<to: int, c: binary, n: binary, t: binary>>"
SUMS = "piece bigint, shard int, doc binary, score binary, base binary, known binary, meta binary"


@cache
def _press() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each for this process: a worker has one thread."""
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _zip(x: np.ndarray | bytes) -> bytes:
    return _press()[0].compress(x if isinstance(x, bytes) else x.tobytes())


def _plain(x: bytes) -> bytes:
    return _press()[1].decompress(x)


def _unzip(x: bytes | None, kind=np.int64) -> np.ndarray:
    return np.frombuffer(_plain(x), kind) if x else np.zeros(0, kind)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers, as bytes that tell how wide they are."""
    kind = next(k for k in "BHIQ" if not len(x) or int(x.max()) <= np.iinfo(np.dtype(k)).max)
    return kind.encode() + _zip(x.astype(kind))


def _wide(x: bytes | None) -> np.ndarray:
    return _unzip(x[1:], np.dtype(x[:1].decode())).astype(np.int64) if x else np.zeros(0, np.int64)


def _home(words: pa.Array, shards: int) -> np.ndarray:
    """The shard of each word; only decides where pairs meet."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return (ring(np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0], ends[1:] - ends[0]) % np.uint64(shards)).astype(np.int64)


def _listed(words: pa.Array, at: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """The words at ``at``, cut in lists, each packed in one string; no word holds a line feed."""
    taken = words.take(pa.array(at))
    ended = pc.binary_join_element_wise(taken, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    ends = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset :][cut].tolist()
    data = memoryview(ended.buffers()[2])
    return [_zip(bytes(data[a : b - 1])) for a, b in zip(ends, ends[1:])]


def _merged(lists: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of packed lists in order, and the number of each word of the lists."""
    flat = pc.split_pattern(pa.array([b"\n".join(map(_plain, lists))], pa.large_binary()), pattern="\n").flatten().dictionary_encode()
    order = pc.sort_indices(flat.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return flat.dictionary.take(pa.array(order)), rank[flat.indices.to_numpy()]


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def tokens(texts: pa.Array, ordered: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens, in order or as they come (the end first), the number of each token, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    flat = lists.flatten().cast(pa.large_binary())
    made = pa.concat_arrays([pa.array([END], pa.large_binary()), flat]).dictionary_encode()
    order = pc.sort_indices(made.dictionary).to_numpy() if ordered else np.arange(len(made.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # a text without words comes as one empty word, which is its end; others get theirs
    words = pc.binary_length(texts).to_numpy() > 0
    words[words] = rank[made.indices.to_numpy()[1:]][(np.cumsum(n) - n)[words]] > 0
    sizes = n + words
    ids = np.zeros(int(sizes.sum()), np.int64)
    ids[ragged(np.cumsum(sizes) - sizes, n)] = rank[made.indices.to_numpy()[1:]]
    return made.dictionary.take(pa.array(order)), ids, sizes


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal entries starts."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def _texts(batch: pa.RecordBatch):
    """(ids, texts) of a piece of a batch of (id, text)."""
    text = batch.column(1).cast(pa.large_string())
    for a, b in steps(np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]), PIECE_BYTES):
        yield batch.column(0).slice(a, b - a).to_pylist(), text.slice(a, b - a)


@frugal
def _common(batches):
    """The most frequent words of each piece, and, without a word, how many tokens it has."""
    for batch in batches:
        for _, texts in _texts(batch):
            vocab, ids, _ = tokens(texts, ordered=False)
            n = np.bincount(ids, minlength=len(vocab))
            top = np.argsort(-n, kind="stable")[:HOT].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([None, *vocab.take(pa.array(top)).to_pylist()], pa.binary()), pa.array([len(ids), *n[top].tolist()], pa.int64())], ["word", "n"])


def hot_words(rows: DataFrame) -> list[bytes]:
    """Words with more than one in HOT of all tokens; they only decide where pairs meet."""
    counts = stored(rows.mapInArrow(_common, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.where(F.col("word").isNotNull() & (F.col("n") * HOT > total)).select("word").collect()
    forget(counts)
    return sorted(bytes(r["word"]) for r in found)


def _ask(shards: int, hot: list[bytes], held_out, with_docs: bool):
    """A row for each shard that a piece has pairs for: contexts, how many words follow each, words, which word, training count; with_docs also how often each pair stands where, and, in one row, what the texts are."""
    def piece(number: int, ids: list, texts: pa.Array):
        vocab, w, sizes = tokens(texts)
        held = np.fromiter(map(held_out, ids), bool, len(ids))
        doc = np.repeat(np.arange(len(ids)), sizes)
        u = np.concatenate([[0], w[:-1]])  # the end of the text before is the first word's context
        home, v = _home(vocab, shards), len(vocab)
        warm = pc.is_in(vocab, value_set=pa.array(hot, pa.large_binary())).to_numpy(zero_copy_only=False)
        shard = np.where(warm[u], home[w], home[u])
        order = np.argsort((shard * v + u) * v + w) if shards * v * v < 1 << 62 else np.lexsort([w, u, shard])
        s, u, w, doc = shard[order], u[order], w[order], doc[order]
        context = np.ones(len(w), bool)
        context[1:] = (u[1:] != u[:-1]) | (s[1:] != s[:-1])
        new = context.copy()
        new[1:] |= w[1:] != w[:-1]
        at = np.flatnonzero(new)
        n = np.add.reduceat(~held[doc], at, dtype=np.int64)
        s, u, w, context = s[at], u[at], w[at], np.flatnonzero(context[at])
        at = np.append(at, len(doc))
        cut = np.append(_runs(s), len(s))
        own, wi = np.unique(s * v + w, return_inverse=True)
        u_cut, w_cut = np.searchsorted(context, cut), np.searchsorted(own, np.append(s[cut[:-1]], s[-1] + 1) * v)
        u_words, w_words = _listed(vocab, u[context], u_cut), _listed(vocab, own % v, w_cut)
        follow = np.diff(np.append(context, len(s)))
        meta = b""
        if with_docs:
            meta = _zip(np.array([i or 0 for i in ids], np.int64).tobytes() + sizes.tobytes() + np.array([i is None for i in ids]).tobytes() + held.tobytes())
        for k, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
            row = [int(s[a]), number, u_words[k], _narrow(follow[u_cut[k] : u_cut[k + 1]]), w_words[k], _narrow(wi[a:b] - w_cut[k]), _narrow(n[a:b])]
            yield (*row, _narrow(np.diff(at[a : b + 1])), _narrow(doc[at[a] : at[b]]), meta) if with_docs else (*row, None, None, None)
            meta = b""

    names = [c.split()[0] for c in ASK.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 8]

    @frugal
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in _texts(batch):
                rows = list(piece(number, ids, texts))
                number += 1
                for k in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64]), kinds)], names)

    return run


class Shard:
    """The pairs of a shard in order, from the rows that pieces sent it."""

    def __init__(self, part: pd.DataFrame, parents: int):
        #: Contexts by word; words by the parent's shard, then by word; where each parent's shard begins.
        self.u, u = _merged(part["u"])
        words, w = _merged(part["w"])
        home = _home(words, parents)
        order = np.argsort(home, kind="stable")
        self.w = words.take(pa.array(order))
        self.ends = np.searchsorted(home[order], np.arange(parents + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        w = place[w]
        keys, i, j = [], 0, 0
        for un, wi in zip(map(_wide, part["un"]), map(_wide, part["wi"])):
            n = int(wi.max()) + 1
            keys.append(np.repeat(u[i : i + len(un)], un) * len(self.w) + w[j : j + n][wi])
            i, j = i + len(un), j + n
        #: Entries of each row, and the place of every entry among the pairs.
        self.entries = np.cumsum([0, *map(len, keys)])
        pairs, self.place = np.unique(np.concatenate(keys), return_inverse=True)
        self.pu, self.pw = pairs // len(self.w), pairs % len(self.w)
        count = np.concatenate([_wide(x) for x in part["n"]])
        #: Customers of each pair; none where only held-out texts have it.
        self.n = np.bincount(self.place, count, len(pairs)).astype(np.int64)

    def hot(self, hot: list[bytes]) -> np.ndarray:
        """(context here, number among the hot ones) of the hot contexts."""
        at = pc.index_in(pa.array(hot, pa.large_binary()), value_set=self.u).to_pylist()
        return np.array([(x, k) for k, x in enumerate(at) if x is not None], np.int64).reshape(-1, 2)


# --- seating ----------------------------------------------------------------


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of c customers at t tables, row c - 1 of which starts at c (c - 1) / 2."""
    row, out = np.zeros(1), np.empty(most * (most + 1) // 2)
    for c in range(1, most + 1):
        out[c * (c - 1) // 2 : c * (c + 1) // 2] = row
        t = np.arange(1, c + 1)
        row = np.logaddexp(np.append(row + np.log(c - t * d), -np.inf), np.concatenate([[-np.inf], row]))
    return out


_TABLES: dict[float, np.ndarray] = {}


def _table(d: float) -> tuple[np.ndarray, np.ndarray]:
    """The numbers for a discount, and, from the largest row, the logarithm of a neighbour's ratio times d t: it depends on t / c**d alone in the limit."""
    if d not in _TABLES:
        if len(_TABLES) > 3:
            _TABLES.clear()
        made = stirling(d)
        _TABLES[d] = made, np.concatenate([[0.0], np.log(d * np.arange(1, EXACT)) + np.diff(made[-EXACT:])])
    return _TABLES[d]


def _ratio(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Logarithm of the number of c customers at t + 1 tables over that at t, times d t, by the scaling limit."""
    return np.interp(t * (EXACT / c) ** d, np.arange(EXACT), _table(d)[1])


class Parent:
    """What opening tables costs a pair at its parent, whose own tables stay as many as they are: customers that others gave the word, its tables there, and all customers of others."""

    def __init__(self, n: np.ndarray, t: np.ndarray, theta: float, customers: np.ndarray, discount: float):
        self.n, self.t, self.total, self.discount = n, t, theta + customers, discount

    def least(self, at: np.ndarray) -> np.ndarray:
        """Tables that the pair has at least: the parent's must have customers."""
        return np.maximum(1, self.t[at] - self.n[at])

    def log(self, at: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Log weight of one more customer at the parent after j of this pair, up to a factor where there can't be so few."""
        n, t, d = self.n[at] + j, self.t[at], self.discount
        back = np.zeros(len(at))
        some = np.flatnonzero((t > 1) & (n >= t) & (n <= EXACT))
        row, column = n[some].astype(np.int64), t[some]
        place = row * (row - 1) // 2 + column - 1
        made = _table(d)[0]
        back[some] = np.exp(made[place - 1] - made[place])
        many = np.flatnonzero((t > 1) & (n >= t) & (n > EXACT))
        back[many] = d * (t[many] - 1) * np.exp(-_ratio(d, n[many], t[many] - 1))
        return np.log(np.where(n >= t, np.maximum(n - d * t + back, 1e-300), 1.0)) - np.log(self.total[at] + j)


class Base:
    """A parent that always says the same."""

    def __init__(self, p: float):
        self.p = np.log(p)

    def least(self, at: np.ndarray) -> np.ndarray:
        return np.ones(len(at), np.int64)

    def log(self, at: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.full(len(at), self.p)


def draw(rng, c: np.ndarray, others: np.ndarray, theta: float, d: float, parent) -> np.ndarray:
    """Numbers of tables for pairs of c customers each, where other dishes have ``others`` tables in the restaurant."""
    out = np.minimum(c, 1)
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    for a, b in steps(c[some], 1 << 19):
        at = some[a:b]
        n = c[at]
        rep, j = np.repeat(at, n), ragged(np.zeros(len(at), np.int64), n)
        weight = np.log(theta + d * (others[rep] + j)) + parent.log(rep, j)
        start = np.cumsum(n) - n
        total = np.cumsum(weight)
        total -= np.repeat(total[start] - weight[start], n)
        total += _table(d)[0][np.repeat(n * (n - 1) // 2, n) + j]
        total[j + 1 < np.repeat(np.minimum(parent.least(at), n), n)] = -np.inf
        weight = np.cumsum(np.exp(total - np.repeat(np.maximum.reduceat(total, start), n)))
        low = np.concatenate([[0.0], weight[start[1:] - 1]])
        pick = np.searchsorted(weight, low + rng.random(len(at)) * (weight[start + n - 1] - low), "right") - start
        out[at] = 1 + np.clip(pick, 0, n - 1)
    many = np.flatnonzero(c > EXACT)
    for a in range(0, len(many), 1_024):
        out[many[a : a + 1_024]] = _draw_many(rng, c, others, theta, d, parent, many[a : a + 1_024])
    return out


def _draw_many(rng, c, others, theta, d, parent, at: np.ndarray) -> np.ndarray:
    """The same for pairs of over EXACT customers, by the scaling limit of neighbouring numbers."""

    def gain(at, t):
        """Log weight of t + 1 tables less that of t."""
        return _ratio(d, c[at], t) - np.log(d * t) + np.log(theta + d * (others[at] + t)) + parent.log(at, t)

    least = np.minimum(parent.least(at), c[at])
    low, high = least.astype(float), c[at].astype(float)
    for _ in range(48):
        middle = (low + high) / 2
        up = gain(at, middle) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    slope = gain(at, low * 0.99 + 0.01) - gain(at, low * 1.01 + 0.01)
    width = np.minimum(np.sqrt(low * 0.02 / np.maximum(slope, 1e-12)), low / 2 + 4)  # it may fall from the least number on, ever more slowly
    step = np.maximum(1, np.ceil(12 * width / GRID)).astype(np.int64)
    first = np.maximum(least, low.astype(np.int64) - GRID // 2 * step)
    places = first[:, None] + step[:, None] * np.arange(GRID)
    inside = places <= c[at][:, None]
    flat = np.repeat(at, GRID)
    gains = (gain(flat, np.minimum(places, c[at][:, None]).ravel() + np.repeat((step - 1) / 2, GRID)).reshape(len(at), GRID)) * step[:, None]
    weight = np.concatenate([np.zeros((len(at), 1)), np.cumsum(gains[:, :-1], axis=1)], axis=1)
    weight = np.where(inside, np.exp(weight - np.where(inside, weight, -np.inf).max(axis=1, keepdims=True)), 0).cumsum(axis=1)
    pick = (weight < rng.random((len(at), 1)) * weight[:, -1:]).sum(axis=1)
    return np.minimum(first + step * pick + rng.integers(0, step), c[at])


def discount(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice) if once + twice else 0.5, 0.05, 0.95))


class Totals:
    """What shards add up, sweep by sweep: of the contexts, and of the parent."""

    def __init__(self, contexts: np.ndarray, hot: int, theta: float = 1.0):
        #: Pairs seen once and twice, all tables, and auxiliary sums for the concentration.
        self.once, self.twice, self.tables, self.opened, self.logs = contexts[:5].tolist()
        self.hot_customers, self.hot_tables = contexts[5 : 5 + hot], contexts[5 + hot :]
        self.theta, self.discount = theta, discount(self.once, self.twice)


class Above:
    """The parent's sums: customers, tables, words, training tokens; words with one customer, with two."""

    def __init__(self, sums: np.ndarray):
        self.customers, self.tables, self.words, self.tokens, once, twice = sums.tolist()
        self.discount = discount(once, twice)
        self.mass = (THETA + self.discount * self.tables) / (self.words + 1)

    def p(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (n - self.discount * t + self.mass) / (THETA + self.customers)


def _out(shard: Shard | None, ends: np.ndarray, c: np.ndarray | None, t: np.ndarray) -> list[dict]:
    """What each of the parent's shards is told: words and training counts (the first time only), and tables."""
    some = np.flatnonzero(np.diff(ends))
    words = _listed(shard.w, np.arange(len(shard.w)), np.append(ends[some], ends[-1])) if shard else [None] * len(some)
    return [{"to": k, "words": x, "c": _narrow(c[ends[k] : ends[k + 1]]) if shard else None, "t": _narrow(t[ends[k] : ends[k + 1]])} for k, x in zip(some.tolist(), words)]


def _opened(rng, tables: np.ndarray, guests: np.ndarray, theta: float, d: float) -> tuple[float, float]:
    """Auxiliary sums for the concentration: tables that it opened, and logarithms of its shares; tables of a restaurant after the first ten thousand count by a Poisson variable."""
    most = 10_000
    more = np.bincount(np.minimum(tables, most), minlength=1)[::-1].cumsum()[::-1][2:]  # restaurants with over 1, 2, ... tables
    opened = rng.binomial(more, theta / (theta + d * np.arange(1, len(more) + 1))).sum()
    large = tables[tables > most]
    opened += rng.poisson(theta / d * np.log((large + theta / d) / (most + theta / d))).sum()
    return float(opened), float(np.log(rng.beta(theta + 1, guests[guests > 1] - 1)).sum())


def _sums(n, t, mu, single_u, customers, hot, hots: int, theta: float, d: float, rng) -> list[float]:
    tables = single_u + np.bincount(mu, t, len(single_u)).astype(np.int64)
    own = np.zeros((2, hots))
    own[0, hot[:, 1]], own[1, hot[:, 1]] = customers[hot[:, 0]], tables[hot[:, 0]]
    cold = np.ones(len(tables), bool)
    cold[hot[:, 0]] = False
    return [float((n == 1).sum() + single_u.sum()), float((n == 2).sum()), float(tables.sum()), *_opened(rng, tables[cold], customers[cold], theta, d), *own.ravel().tolist()]


def _open(parents: int, hot: list[bytes]):
    """A shard's restaurants, every dish at one table to begin with; pairs seen once never have another."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(part, parents)
        one, several = shard.n == 1, shard.n > 1
        mu, mw, mn = shard.pu[several], shard.pw[several], shard.n[several]
        single_u = np.bincount(shard.pu[one], minlength=len(shard.u))
        single_w = np.bincount(shard.pw[one], minlength=len(shard.w))
        customers = single_u + np.bincount(mu, mn, len(shard.u)).astype(np.int64)
        hots = shard.hot(hot)
        t = np.ones(len(mn), np.int64)
        c = single_w + np.bincount(mw, mn, len(shard.w)).astype(np.int64)
        tables = single_w + np.bincount(mw, minlength=len(shard.w))
        totals = _sums(mn, t, mu, single_u, customers, hots, len(hot), 1.0, 0.5, np.random.default_rng(0))
        row = [int(part["shard"].iloc[0]), _narrow(shard.ends), _narrow(single_u), _narrow(single_w), _narrow(mu), _narrow(mw), _narrow(mn), _narrow(t), _narrow(hots.ravel()), [], totals, _out(shard, shard.ends, c, tables)]
        return pd.DataFrame([row], columns=_names(STATE))

    return run


def _names(schema: str) -> list[str]:
    depth, out, word = 0, [], ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += ch
    return out


def _sweep(now: Totals, above: Above, hots: int, seed: int, keep: bool):
    """Seats the pairs of several customers anew; keeps what this sweep says for the average."""
    theta, d = now.theta, now.discount

    def run(state: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        row = state.iloc[0]
        ends, single_u, single_w, mu, mw, mn, t, hot = (_wide(row[x]) for x in ("ends", "single_u", "single_w", "mu", "mw", "mn", "t", "hot"))
        hot = hot.reshape(-1, 2)
        rng = np.random.default_rng([seed, row["shard"]])
        n, seated, c = (np.zeros(len(single_w), np.int64) for _ in range(3))
        for k, cc, nn, tt in zip(replies["shard"], replies["c"], replies["n"], replies["t"]):
            own = slice(ends[k], ends[k + 1])
            n[own], seated[own] = _wide(nn), _wide(tt)
            if cc is not None:
                c[own] = _wide(cc)
        before = t
        others_n = np.maximum(n[mw] - before, 0)  # the pair's own tables have left the parent
        parent = lambda at: Parent(others_n[at], seated[mw[at]], THETA, above.customers - before[at], above.discount)
        mine = single_u + np.bincount(mu, t, len(single_u)).astype(np.int64)
        elsewhere = np.zeros(len(single_u), np.int64)  # tables of hot contexts in other shards
        elsewhere[hot[:, 0]] = now.hot_tables[hot[:, 1]] - mine[hot[:, 0]]
        turn = rng.integers(0, TURNS, len(mn))
        t = t.copy()
        for k in range(TURNS):
            at = np.flatnonzero(turn == k)
            tables = elsewhere + single_u + np.bincount(mu, t, len(single_u)).astype(np.int64)
            t[at] = draw(rng, mn[at], tables[mu[at]] - t[at], theta, d, parent(at))
        customers = single_u + np.bincount(mu, mn, len(single_u)).astype(np.int64)
        kept = list(row["kept"])
        if not kept:
            kept = [_narrow(c)]
        if keep:
            kept += [_narrow(t), _narrow(n), _narrow(seated)]
        totals = _sums(mn, t, mu, single_u, customers, hot, hots, theta, d, rng)
        told = single_w + np.bincount(mw, t, len(single_w)).astype(np.int64)
        return pd.DataFrame([[row["shard"], *(row[x] for x in ("ends", "single_u", "single_w", "mu", "mw", "mn")), _narrow(t), row["hot"], kept, totals, _out(None, ends, None, told)]], columns=_names(STATE))

    return run


def _parent_row(shard: int, sources, routes, t, c, n) -> pd.DataFrame:
    totals = [float(n.sum()), float(t.sum()), float((n > 0).sum()), float(c.sum()) if c is not None else 0.0, float((n == 1).sum()), float((n == 2).sum())]
    out = [{"to": int(s), "c": _narrow(c[r]) if c is not None else None, "n": _narrow(n[r]), "t": _narrow(t[r])} for s, r in zip(sources, routes)]
    return pd.DataFrame([[shard, list(map(int, sources)), [_narrow(r) for r in routes], _narrow(t), totals, out]], columns=_names(PARENT))


def _parent_open(part: pd.DataFrame) -> pd.DataFrame:
    """A shard of the parent: its words are those that the contexts' shards name, each dish at one table to begin with."""
    part = part.sort_values("source")
    words, at = _merged(part["words"])
    counts, tables = [_wide(x) for x in part["c"]], [_wide(x) for x in part["t"]]
    routes = np.split(at, np.cumsum([len(x) for x in counts])[:-1])
    c, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for r, x, y in zip(routes, counts, tables):
        c[r] += x
        n[r] += y
    return _parent_row(int(part["to"].iloc[0]), part["source"].tolist(), routes, np.minimum(n, 1), c, n)


def _parent_sweep(above: Above, seed: int):
    def run(parent: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = parent.iloc[0]
        routes = dict(zip(row["sources"], map(_wide, row["routes"])))
        t = _wide(row["t"])
        n = np.zeros(len(t), np.int64)
        for s, x in zip(told["source"], told["t"]):
            n[routes[s]] += _wide(x)
        rng = np.random.default_rng([seed, row["shard"]])
        t = draw(rng, n, np.full(len(n), max(above.tables, 1.0)) - np.minimum(t, n), THETA, above.discount, Base(1 / (above.words + 1)))
        return _parent_row(row["shard"], list(routes), list(routes.values()), t, None, n)

    return run


# --- scores -----------------------------------------------------------------


def predictive(shard: Shard, hot: np.ndarray, kept: list[bytes], sweeps: list[tuple[Totals, Totals, Above]]) -> np.ndarray:
    """Probability of each of a shard's pairs, averaged over the sweeps that were kept."""
    some = np.flatnonzero(shard.n > 0)
    several = shard.n[some] > 1
    u, n = shard.pu[some], shard.n[some]
    customers = np.bincount(u, n, len(shard.u))
    out = np.zeros(len(shard.pu))
    for k, (now, after, above) in enumerate(sweeps):
        tables, parent_n, parent_t = (_wide(x) for x in kept[1 + 3 * k : 4 + 3 * k])
        t = np.ones(len(some))
        t[several] = tables
        seats = np.bincount(u, t, len(shard.u))
        guests = customers.copy()
        # the totals of hot contexts are those after this sweep
        seats[hot[:, 0]], guests[hot[:, 0]] = after.hot_tables[hot[:, 1]], after.hot_customers[hot[:, 1]]
        p = (now.theta + now.discount * seats)[shard.pu] * above.p(parent_n, parent_t)[shard.pw]
        p[some] += n - now.discount * t
        out += p / (now.theta + guests)[shard.pu]
    return out / len(sweeps)


def _finish(parents: int, hot: list[bytes], sweeps, above: Above):
    """A sum for each text of each piece: scores, base scores, and tokens that are known."""

    def run(asked: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(asked, parents)
        kept = state.iloc[0]["kept"]
        logs = np.log10(predictive(shard, shard.hot(hot), kept, sweeps))
        count = _wide(kept[0])
        base = np.log10((count + 1) / (above.tokens + above.words + 1))[shard.pw]
        known = (count > 0)[shard.pw]
        out = []
        for k, (piece, times, doc, meta) in enumerate(zip(asked["piece"], asked["times"], asked["doc"], asked["meta"])):
            at = np.repeat(shard.place[shard.entries[k] : shard.entries[k + 1]], _wide(times))
            docs, doc = np.unique(_wide(doc), return_inverse=True)
            out.append((piece, int(asked["shard"].iloc[0]), _narrow(docs), *(np.bincount(doc, x[at], len(docs)).tobytes() for x in (logs, base)), _narrow(np.bincount(doc, known[at], len(docs)).astype(np.int64)), meta or None))
        return pd.DataFrame(out, columns=_names(SUMS))

    return run


def _score(tokens: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        meta = _plain(next(x for x in part["meta"] if x))
        n = len(meta) // 18
        ids, sizes = np.frombuffer(meta, np.int64, n), np.frombuffer(meta, np.int64, n, 8 * n)
        none, held = np.frombuffer(meta, bool, n, 16 * n), np.frombuffer(meta, bool, n, 17 * n)
        score, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        for doc, s, b, k in zip(part["doc"], part["score"], part["base"], part["known"]):
            doc = _wide(doc)
            score[doc] += np.frombuffer(s)
            base[doc] += np.frombuffer(b)
            known[doc] += _wide(k)
        ids = pd.array(ids, dtype="Int64")
        ids[none] = pd.NA
        return pd.DataFrame({"id": ids, "held_out": held, "n_tokens": sizes, "n_known": known, "train_tokens": tokens, "base_score": base, "score": score, "perplexity": 10 ** (-score / sizes)})

    return run


def _added(df: DataFrame, size: int) -> np.ndarray:
    """The sum of all rows' totals, place by place."""
    row = df.agg(*[F.coalesce(F.sum(F.get("totals", F.lit(i))), F.lit(0.0)).alias(f"t{i}") for i in range(size)]).first()
    return np.array(row)


def score(docs: DataFrame, held_out=is_held_out, sweeps: int = SWEEPS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``held_out`` is a function of the id; the model learns from the other rows.
    """
    spark = docs.sparkSession
    rows = spread(docs).select(F.col(id_col).cast("bigint").alias("id"), whole(F.col(text_col)).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    shards, parents = max(2 * shuffles(spark), 24, -(-size // SHARD_BYTES)), max(PARENTS, -(-size // PARENT_BYTES))
    hot = hot_words(rows)
    sums = 5 + 2 * len(hot)
    rng = np.random.default_rng(seed)
    asked = rows.mapInArrow(_ask(shards, hot, held_out, False), ASK)
    state = stored(asked.groupBy("shard").applyInPandas(trimmed(_open(parents, hot)), STATE), "seats")
    told = lambda: state.select(F.col("shard").alias("source"), F.inline("out"))
    parent = stored(told().groupBy("to").applyInPandas(trimmed(_parent_open), PARENT), "parent")
    now, above = Totals(_added(state, sums), len(hot)), Above(_added(parent, 6))
    tokens, counted = above.tokens, []
    for k in range(sweeps):
        replies = parent.select("shard", F.inline("out"))
        after = stored(state.groupBy("shard").cogroup(replies.groupBy("to")).applyInPandas(trimmed(_sweep(now, above, len(hot), seed + k, k > 0 or sweeps == 1)), STATE), "seats")
        forget(state)
        state = after
        then = Totals(_added(state, sums), len(hot))
        if k or sweeps == 1:
            counted.append((now, then, above))
        opened, logs = _opened(rng, then.hot_tables.astype(np.int64), then.hot_customers, now.theta, now.discount)
        then.theta = max(1e-3, rng.gamma(PRIOR[0] + then.opened + opened) / (PRIOR[1] - then.logs - logs))
        now = then
        if k + 1 < sweeps:
            after = stored(parent.groupBy("shard").cogroup(told().groupBy("to")).applyInPandas(trimmed(_parent_sweep(above, seed + 1000 + k)), PARENT), "parent")
            forget(parent)
            parent = after
            above = Above(_added(parent, 6))
    above.tokens = tokens
    asked = rows.mapInArrow(_ask(shards, hot, held_out, True), ASK)
    found = asked.groupBy("shard").cogroup(state.select("shard", "kept").groupBy("shard")).applyInPandas(trimmed(_finish(parents, hot, counted, above)), SUMS)
    return found.groupBy("piece").applyInPandas(trimmed(_score(int(tokens))), "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
