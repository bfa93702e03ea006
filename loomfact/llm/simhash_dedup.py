"""SimHash near-duplicates, joined on Golay-code keys.

A 64-bit fingerprint is cut in three segments, each a word of the perfect binary
Golay code [23, 12, 7] (short ones padded with zeros): every word lies within three
errors of one codeword.  Two fingerprints at three or fewer differing bits have at
most one error in two of their three segments at least.  And for words one error
apart, the codeword of one is within four errors of the other: it is the other's
own codeword, or, where that is three errors off, one of five more.  Thus a
fingerprint files itself under its own codewords for each pair of segments, and
looks under up to six by six; no link is missed, and candidates are verified by
counting the differing bits.

Such keys have 24 bits.  Beyond ``WIDE`` distinct fingerprints they are made wider, at
the price of twice as many: at most three errors leave two segments without any, or one
without any and one with one error, or one error in each.  Keys are then two segments as
they are (42 bits), one as it is and one codeword (33 bits), or three codewords (36).  No
link is missed by either kind.

Keys travel packed, many to a row, to shards that grow with the number of distinct
fingerprints.  A shard returns stars of what it found connected, never all pairs, and
the stars of all shards meet in distributed connected components.

Defined results: null text counts as empty; texts without words have fingerprint zero;
null ids rank after all others; rows with equal ids share their answers, and of equal
fingerprints the smallest id stands for all; one text is held in memory as a whole,
however long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, frugal, mix, ragged, shuffles, spread, steps, stored, whole
from .graph import components

SEED = 42
WORDS = 3
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Keys that one shard gets, about, and pairs that it compares at a time.
SHARD_KEYS, BLOCK = 1_500_000, 1 << 20
#: Distinct fingerprints beyond which keys are wide; keys of a fingerprint of either kind, filed and looked for, on average.
WIDE, KEYS = 1 << 22, (87, 195)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ONES = np.uint64(0x0101010101010101)


def joined_words(tok: Tokens, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """data with one space after each word of tok, and each word's byte range there."""
    raw = np.frombuffer(data, np.uint8)
    keep = np.zeros(len(raw), bool)
    size = tok.hi - tok.lo
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[tok.lo] = 1
    edge[tok.hi] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    keep[tok.hi] = True
    out = raw[keep]
    hi = np.cumsum(size + 1) - 1
    out[hi] = 32
    return out.tobytes(), hi - size, hi


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The 64-bit SimHash of each text over its word shingles."""
    tok = Tokens(texts)
    data, lo, hi = joined_words(tok, tok.data.translate(_LOWER))
    n = np.where(tok.count >= WORDS, tok.count - WORDS + 1, np.minimum(tok.count, 1))
    first = ragged(tok.first[:-1], n)
    last = first + np.repeat(np.minimum(WORDS, np.maximum(tok.count, 1)) - 1, n)
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(data[a:b], SEED) for a, b in zip(lo[first].tolist(), hi[last].tolist())]), ">u8").astype(np.uint64)
    return majority(h, n)


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For consecutive runs of n[i] hashes each: the bits that are set in over half of a run."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    size = n[full]
    parts = -(-size // 255)  # a byte counts to 255
    at = np.repeat(np.cumsum(size) - size, parts) + 255 * ragged(np.zeros(len(full), np.int64), parts)
    own = np.cumsum(parts) - parts
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _ONES, at).view(np.uint8).reshape(-1, 8)
        votes = np.add.reduceat(lanes.astype(np.int64), own, axis=0)
        for j in range(8):
            out[full] |= (2 * votes[:, j] > size).astype(np.uint64) << np.uint64(8 * j + k)
    return out


@frugal
def _fingerprint_batches(batches):
    for batch in batches:
        text = batch.column(1).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])
        for a, b in steps(sizes):
            made = fingerprints(text.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(made.view(np.int64))], ["id", "fp"])


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed number."""
    rows = spread(docs).select(F.col(id_col).cast("bigint").alias("id"), whole(F.col(text_col)).alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "id bigint, fp bigint")


# --- Golay code -------------------------------------------------------------

#: Fixed value: generator polynomial of the binary Golay code [23, 12, 7].
GENERATOR = 0b110001110101


def _remainder(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
    return x


class Golay:
    """Decoding tables, built from the generator."""

    def __init__(self):
        self.low, self.high = _remainder(np.arange(1 << 12)), _remainder(np.arange(1 << 11) << 12)
        message = np.arange(1 << 12) << 11
        words = message ^ _remainder(message)
        sevens = words[np.bitwise_count(words) == 7]
        self.error = np.zeros(1 << 11, np.int64)
        self.keys = np.ones(1 << 11, np.int64)
        self.shift = np.zeros((1 << 11, 6), np.int64)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                s = self.syndrome(np.array([e]))[0]
                self.error[s] = e
                if weight == 3:
                    self.keys[s] = 6
                    self.shift[s, 1:] = sevens[(sevens & e) == e] >> 11

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 0xFFF] ^ self.high[x >> 12]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each word's codeword, and the word's syndrome."""
        s = self.syndrome(x)
        return (x ^ self.error[s]) >> 11, s


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, row) that each fingerprint is filed under, then (key, row) under which it looks."""
    code = golay()
    parts = [code.decode(((fp >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64)) for lo, n in SEGMENTS]
    row = np.arange(len(fp))
    filed, looked, rows = [], [], []
    for pair, (i, j) in enumerate(PAIRS):
        (a, s), (b, t) = parts[i], parts[j]
        filed.append((pair << 24) + (a << 12) + b)
        n, m = code.keys[s], code.keys[t]
        at = np.repeat(row, n * m)
        k = ragged(np.zeros(len(fp), np.int64), n * m)
        each = np.repeat(m, n * m)
        looked.append((pair << 24) + ((a[at] ^ code.shift[s[at], k // each]) << 12) + (b[at] ^ code.shift[t[at], k % each]))
        rows.append(at)
    return np.concatenate(filed), np.tile(row, len(PAIRS)), np.concatenate(looked), np.concatenate(rows)


def wide_keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with keys of more bits, folded to 31: what they have in common by chance only adds candidates."""
    code = golay()
    words = [((fp >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    parts = [code.decode(w) for w in words]
    row = np.arange(len(fp))
    filed, file_rows, looked, look_rows = [], [], [], []

    def add(kind: int, own: list[np.ndarray], free: list[int]) -> None:
        """Keys of segments as they are (own) and of codewords of the segments in ``free``."""
        fold = lambda key: (mix(key.astype(np.uint64) + np.uint64(kind << 48)) >> np.uint64(33)).astype(np.int64)
        base = np.zeros(len(fp), np.int64)
        for x in own:
            base = (base << 22) + x
        key = base
        for j in free:
            key = (key << 12) + parts[j][0]
        filed.append(fold(key))
        file_rows.append(row)
        at, key = row, base
        for j in free:
            a, s = parts[j]
            n = code.keys[s[at]]
            k = ragged(np.zeros(len(at), np.int64), n)
            at, key = np.repeat(at, n), np.repeat(key, n)
            key = (key << 12) + (a[at] ^ code.shift[s[at], k])
        looked.append(fold(key))
        look_rows.append(at)

    for kind, (i, j) in enumerate(PAIRS):
        add(kind, [words[i], words[j]], [])
        add(3 + kind, [words[i]], [j])
        add(6 + kind, [words[j]], [i])
    add(9, [], [0, 1, 2])
    return np.concatenate(filed), np.concatenate(file_rows), np.concatenate(looked), np.concatenate(look_rows)


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (key * 0x9E3779B1 >> 7) % shards


def _pack(shards: int, wide: bool):
    """Keys of a batch of distinct fingerprints, a row for each shard: keys and fingerprints, filed ones first."""

    @frugal
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(a, 4096).to_numpy().view(np.uint64)
                fk, fr, lk, lr = (wide_keys_of if wide else keys_of)(fp)
                out = {}
                for name, key, row in (("f", fk, fr), ("l", lk, lr)):
                    at = _shard(key, shards)
                    order = np.argsort(at, kind="stable")
                    ends = np.searchsorted(at[order], np.arange(shards + 1))
                    out[name] = key[order].astype(np.int32), fp[row[order]], ends
                has = np.flatnonzero((np.diff(out["f"][2]) + np.diff(out["l"][2])) > 0)
                cut = lambda name, k: [out[name][k][out[name][2][s] : out[name][2][s + 1]].tobytes() for s in has]
                yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), *(pa.array(cut(n, k), pa.binary()) for n in "fl" for k in (0, 1))], ["shard", "fk", "ff", "lk", "lf"])

    return run


class Forest:
    """Union of nodes 0..n-1 by batches of edges."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            hook = np.arange(len(self.root))
            np.minimum.at(hook, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                after = hook[hook]
                if (after == hook).all():
                    break
                hook = after
            self.root = hook[self.root]


def links(fk: np.ndarray, ff: np.ndarray, lk: np.ndarray, lf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, root) of the fingerprints that are connected within one shard."""
    order = np.argsort(fk, kind="stable")
    fk, ff = fk[order], ff[order]
    lo, hi = np.searchsorted(fk, lk, "left"), np.searchsorted(fk, lk, "right")
    busy = hi > lo
    lo, hi, lf = lo[busy], hi[busy], lf[busy]
    nodes, at = np.unique(np.concatenate([ff, lf]), return_inverse=True)
    fa, la = at[: len(ff)], at[len(ff) :]
    forest = Forest(len(nodes))
    done = np.cumsum(hi - lo)
    start = 0
    while start < len(lo):
        end = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + BLOCK, "right")))
        n = hi[start:end] - lo[start:end]
        x, y = np.repeat(la[start:end], n), fa[ragged(lo[start:end], n)]
        near = forest.root[x] != forest.root[y]
        x, y = x[near], y[near]
        near = np.bitwise_count(nodes[x] ^ nodes[y]) <= bits
        forest.add(x[near], y[near])
        start = end
    out = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[out], nodes[forest.root[out]]


def _link(bits: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        fk, lk = (np.frombuffer(b"".join(part[c]), np.int32) for c in ("fk", "lk"))
        ff, lf = (np.frombuffer(b"".join(part[c]), np.uint64) for c in ("ff", "lf"))
        a, b = links(fk, ff, lk, lf, bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def link_edges(fps: DataFrame, bits: int = 3, wide: bool | None = None) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within ``bits`` of each other, three at most."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys hold for 0 to 3 differing bits")
    spark, n = fps.sparkSession, fps.count()
    wide = n > WIDE if wide is None else wide
    shards = max(6 * shuffles(spark), -(-n * KEYS[wide] // SHARD_KEYS))
    packed = fps.select("fp").mapInArrow(_pack(shards, wide), "shard int, fk binary, ff binary, lk binary, lf binary")
    return packed.groupBy("shard").applyInPandas(_link(bits), "a bigint, b bigint")


def simhash_components(docs: DataFrame, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fp, component_id (the smallest id that links reach)."""
    rows = stored(fingerprint_table(docs, id_col, text_col), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    tree = stored(components(link_edges(distinct, bits)), "components")
    rooted = distinct.join(tree, distinct.fp == tree.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "roots")
    linked = stored(rooted.join(lowest, "root").select("fp", "component_id"), "linked")
    several = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    several = stored(several, "answers").withColumnRenamed("fp", "of")
    return rows.join(several, rows.fp == several.of, "left").select("id", "fp", "component_id")
