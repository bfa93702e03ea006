"""The general form of the SimHash operator: near-duplicates by Jaccard similarity of word shingles.

Candidates come two ways.  SimHash fingerprints of the shingles, equal or linked by Golay
keys, find what is all but equal.  At a similarity of 0.8 fingerprints differ in some ten
of 64 bits, which no such keys reach; so texts also meet by shared keys: each has a number
of bands, each the mix of ``ROWS`` MinHash values of its shingles, as many as it takes for
two texts at the similarity asked for to meet but for a chance of ``MISSED``; more alike
ones meet more surely.  Every link is verified on the sets of 64-bit shingle hashes.

A band's rows are first compared with the smallest one among them, which joins almost all
that belong together, in plain joins.  Rows of a band that are still apart are compared with
each other, all but those of the largest component among themselves; thus components are
those of all similar pairs that share a band.

Defined results: shingles are of lower-case (ASCII) words; texts shorter than a shingle are
one shingle, texts without words are near copies of each other; repeated rows count once;
one text is held in memory as a whole, however long; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, mix, ragged, shuffles, spread, steps, stored, Tokens, without
from .graph import components
from .simhash_dedup import link_edges, majority

WORDS, SIMILAR = 5, 0.8
#: MinHash values in a band; chance that two texts just similar enough share no band.
ROWS, MISSED = 4, 5e-4
#: Bytes of shingle sets that one shard compares, about.
SHARD_BYTES = 16 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similar: float) -> int:
    return ceil(log(MISSED) / log(1 - similar**ROWS)) if similar < 1 else 1


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one text after the other, and how many each text has."""
    tok = Tokens(texts)
    own = tok.hashes(lower=True)
    n = np.where(tok.count >= words, tok.count - words + 1, np.minimum(tok.count, 1))
    at = ragged(tok.first[:-1], n)
    end = np.repeat(tok.first[1:], n)
    h = np.zeros(len(at), np.uint64)
    for k in range(words):
        inside = at + k < end
        h = h * _ODD + np.where(inside, own[np.where(inside, at + k, 0)], np.uint64(k))
    return mix(h), n


def band_keys(h: np.ndarray, n: np.ndarray, bands: int) -> np.ndarray:
    """A row of keys for each text with shingles."""
    size = n[n > 0]
    start = np.cumsum(size) - size
    salts = mix(np.arange(1, 2 * bands * ROWS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    out = np.empty((len(size), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(size), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * _ODD + np.minimum.reduceat(h * salts[2 * k] + salts[2 * k + 1], start)) if len(size) else key
        out[:, band] = key
    return out


def _each(column: str, make, key: str = "row"):
    """(key, make's list of numbers) of every (key, text)."""

    @frugal
    def run(batches):
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])
            for a, b in steps(sizes):
                values, n = make(text.slice(a, b - a).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [key, column])

    return run


def _keys(words: int, bands: int):
    """The fingerprint, then the bands; texts without words have fingerprint 0 and one band, 0."""

    def make(texts):
        h, n = shingles(texts, words)
        made = np.zeros((len(n), 1 + bands), np.uint64)
        made[:, 0] = majority(h, n)
        made[n > 0, 1:] = band_keys(h, n, bands)
        size = np.where(n > 0, 1 + bands, 2)
        return made[np.arange(1 + bands) < size[:, None]], size

    return make


def _sets(words: int):
    def make(texts):
        h, n = shingles(texts, words)
        ends = np.cumsum(n)
        found = [np.unique(h[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
        return np.concatenate([np.zeros(0, np.uint64), *found]), np.fromiter(map(len, found), np.int64, len(found))

    return make


def similar_pairs(sets: list[np.ndarray], label: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Pairs that join the components (label) of all similar pairs among sets."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(size) - size
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)
    label, out = label.copy(), []
    most = np.bincount(label).argmax()
    for i in range(len(sets)):
        if label[i] == most:
            continue
        far = (label != label[i]) & (np.minimum(size, size[i]) >= similar * np.maximum(size, size[i]) - 1e-9)
        if not far.any():
            continue
        mine = ids[start[i] : start[i] + size[i]]
        mark[mine] = True
        common = np.add.reduceat(mark[ids], start, dtype=np.int64)
        mark[mine] = False
        for j in np.flatnonzero(far & (common >= similar * (size + size[i] - common) - 1e-9)).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                old, new = (label[i], label[j]) if label[j] == most else (label[j], label[i])
                label[label == old] = new
    return out


def _compare(similar: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in part[part["set"].map(len) > 0].groupby("key", sort=False):
            row = rows["row"].tolist()
            for i, j in similar_pairs([np.asarray(x, np.int64) for x in rows["set"]], pd.factorize(rows["root"])[0], similar):
                out.append((row[i], row[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def near_components(rows: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """(node, root) of every row that is linked to a smaller one; rows has row (binary, a key of the text) and text.

    The root is the smallest row of a component and has no line.
    """
    spark = rows.sparkSession
    rows = rows.select("row", "text")
    made = spread(rows).mapInArrow(_each("keys", _keys(words, bands_for(similar))), "row binary, keys array<bigint>")
    made = made.groupBy("row").agg(F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    # numbers are shorter than keys on the way through the joins
    keys = stored(made.withColumn("num", F.monotonically_increasing_id()), "keys")
    prints = stored(keys.groupBy(F.get("keys", F.lit(0)).alias("fp")).agg(F.min("num").alias("low")), "prints")
    equal = keys.select("num", F.get("keys", F.lit(0)).alias("fp")).join(prints, "fp").where("num <> low").select("num", "low")
    first = lambda c, name: prints.select(F.col("fp").alias(c), F.col("low").alias(name))
    linked = link_edges(prints.select("fp")).join(first("a", "num"), "a").join(first("b", "low"), "b").select("num", "low")
    alike_prints = stored(equal.unionByName(linked), "linked")
    filed = keys.select("num", F.explode(F.slice("keys", 2, bands_for(similar))).alias("key"))
    heads = stored(filed.groupBy("key").agg(F.min("num").alias("low"), F.max("num").alias("high")).where("low <> high").drop("high"), "heads")
    members = stored(filed.join(heads, "key"), "members")
    met = members.select("num").unionByName(alike_prints.select(F.explode(F.array("num", "low")).alias("num"))).distinct()
    busy = stored(keys.select("num", "row", "copies").join(met, "num", "left_semi"), "busy")
    repeated = busy.where("copies > 1").limit(1).count()
    sets = without(rows, busy.select("row", "num"), "row", "inner").select("num", "text").mapInArrow(_each("set", _sets(words), "num"), "num bigint, set array<bigint>")
    sets = stored(sets.dropDuplicates(["num"]) if repeated else sets, "sets")
    low = sets.select(F.col("num").alias("low"), F.col("set").alias("other"))
    pairs = stored(members.where("num <> low").select("num", "low").unionByName(alike_prints).distinct(), "pairs")
    common = F.size(F.array_intersect("set", "other"))
    alike = common >= F.lit(similar) * (F.size("set") + F.size("other") - common) - F.lit(1e-9)
    stars = stored(pairs.join(sets, "num").join(low, "low").where(alike).select(F.col("num").alias("a"), F.col("low").alias("b")), "stars")
    tree = stored(components(stars), "trees")
    placed = stored(members.select("key", "num").join(tree, members.num == tree.node, "left").select("key", "num", F.coalesce("root", "num").alias("root")), "placed")
    apart = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
    apart = stored(placed.join(apart, "key"), "apart")
    n = apart.count()
    if n:
        mean = sets.agg(F.avg(F.size("set"))).first()[0]
        shards = max(6 * shuffles(spark), ceil(8 * n * mean / SHARD_BYTES))
        shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
        more = apart.join(sets, "num").select(shard, "key", F.col("num").alias("row"), "root", "set").groupBy("shard").applyInPandas(_compare(similar), "a bigint, b bigint")
        tree = stored(components(stars.unionByName(more)), "trees")
    # numbers say nothing of the order of keys: the smallest key of a component is its root
    both = tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
    named = stored(both.join(busy.select("num", "row"), both.node == busy.num).select("root", "row"), "named")
    least = named.groupBy("root").agg(F.min("row").alias("least"))
    return named.join(least, "root").where("row <> least").select(F.col("row").alias("node"), F.col("least").alias("root"))
