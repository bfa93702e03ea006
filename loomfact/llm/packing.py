"""Packing documents into training sequences by vector best fit.

A bin has three capacities: tokens, documents, and attention cost (the sum of squared
lengths).  Pieces come in order of falling length.  Of the bins that can still take a
piece under every constraint, it goes to the one with the highest weighted dot product
of its needs and the bin's residuals ("dot"), or to the one that it leaves with the
smallest weighted norm of residuals ("norm"); needs and residuals count in shares of the
capacities.  Among equals the oldest bin wins.

Pieces are dealt evenly to groups that are packed side by side; a second round takes the
bins that were left short, deals their pieces to fewer groups and packs those anew.

Defined results: null text counts as empty (a document then still has its end id);
documents longer than a sequence are cut into full sequences and a rest; rows that share
an id are documents of their own, equal ones too, and an id of -2**63 stands for none;
of bins that fit as well the oldest is taken; one text's tokens are held in memory as a
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import frugal, NO_ID, spread, steps, stored, whole

TOKENS = 2_048
#: Pieces of a group, on average at most.
GROUP = 12_000
#: A bin with a smaller share of its tokens in use is packed again in the second round.
WELL_FILLED = 0.995
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint, fill double"


def _pieces(path: str, most: int, end_id: int):
    @frugal
    def run(batches):
        for batch in batches:
            text = batch.column(1).cast(pa.large_string())
            sizes = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])
            for a, b in steps(sizes):
                ids, counts = encoder(path).encode(text.slice(a, b - a).to_pylist())
                own = batch.column(0).slice(a, b - a).to_pylist()
                out = []
                for i, each in zip(own, np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])):
                    each = np.append(each, np.uint32(end_id))
                    out += [(i, k, s, len(x := each[s : s + most]), zlib.crc32(x.tobytes())) for k, s in enumerate(range(0, len(each), most))]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, most: int = TOKENS, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token runs of at most ``most`` ids: doc_id, piece, start, length, ids_crc32."""
    rows = spread(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    return rows.mapInArrow(_pieces(path, most, end_id), PIECES)


def best_fit(lengths: np.ndarray, most: int, max_docs: int, max_cost: float, rule: str, weights: tuple[float, float, float]) -> np.ndarray:
    """The bin of each length; lengths must fall."""
    n = len(lengths)
    w = np.array(weights)
    left = np.empty((3, n))
    # bins that no later piece can use are closed: the shortest piece tells
    least = lengths.min() if n else 0
    live = np.empty(n, np.int64)
    count = used = 0
    out = np.empty(n, np.int64)
    need = np.stack([lengths / most, np.full(n, 1 / max_docs), lengths.astype(float) ** 2 / max_cost], axis=1)
    floor = np.array([least / most, 1 / max_docs, float(least) ** 2 / max_cost])
    for i in range(n):
        a = need[i]
        have = left[:, :count]
        fits = (have[0] >= a[0] - 1e-12) & (have[1] >= a[1] - 1e-12) & (have[2] >= a[2] - 1e-12)
        at = np.flatnonzero(fits)
        if len(at):
            rest = have[:, at]
            if rule == "dot":
                k = at[np.argmax((w * a) @ rest)]
            else:
                k = at[np.argmin(w @ (rest - a[:, None]) ** 2)]
        else:
            k = count
            left[:, k] = 1
            live[k] = used
            count, used = count + 1, used + 1
        left[:, k] -= a
        out[i] = live[k]
        if (left[:, k] < floor - 1e-12).any():
            count -= 1
            left[:, k : count] = left[:, k + 1 : count + 1]
            live[k:count] = live[k + 1 : count + 1]
    return out


def _pack(most: int, max_docs: int, max_cost: float, rule: str, weights: tuple[float, float, float], base: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first")
        length = part["length"].to_numpy(np.int64)
        full = int((length == most).sum())  # these come first, each in a bin of its own
        at = np.concatenate([np.arange(full), full + best_fit(length[full:], most, max_docs, max_cost, rule, weights)])
        order = np.argsort(at, kind="stable")
        part, at, length = part.iloc[order], at[order], length[order]
        before = np.cumsum(length) - length
        first = np.searchsorted(at, at, "left")
        fill = np.bincount(at, length)[at] / most
        group = int(part["g"].iloc[0])
        return part.drop(columns="g").assign(sequence_id=base + (group << 32) + at, offset=before - before[first], fill=fill)

    return run


def pack(made: DataFrame, most: int = TOKENS, max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> DataFrame:
    """Pieces with sequence_id, offset and fill (the share of the sequence's tokens in use)."""
    if rule not in ("dot", "norm"):
        raise ValueError("rule is dot or norm")
    max_docs, max_cost = max_docs or most, max_cost or float(most) ** 2
    # pandas would turn ids with nulls among them into floating point
    made = stored(made.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), "pieces")
    if made.where(F.col("length").cast("double") ** 2 > max_cost).limit(1).count():
        raise ValueError("a piece alone exceeds the attention cost of a sequence")
    cols = made.columns

    def round_of(rows: DataFrame, base: int) -> DataFrame:
        groups = max(1, -(-rows.count() // GROUP))
        # by row of a stored table, so that equal pieces part as well
        g = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(base)), F.lit(groups)).cast("bigint").alias("g")
        return rows.select(g, *cols).groupBy("g").applyInPandas(_pack(most, max_docs, max_cost, rule, weights, base), PACKED)

    first = stored(round_of(made, 0), "packed")
    again = round_of(first.where(F.col("fill") < WELL_FILLED).select(*cols), 1 << 61)
    return first.where(F.col("fill") >= WELL_FILLED).unionByName(again).withColumn("doc_id", F.expr(f"nullif(doc_id, {NO_ID})"))


def pack_documents(docs: DataFrame, path: str, most: int = TOKENS, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    return pack(pieces(docs, path, most, end_id, id_col, text_col), most, **how)
