"""Substring deduplication by super-k-mers.

A window is ``k`` consecutive words.  Its minimiser is the run of ``m`` words in it
with the lowest hash; consecutive windows with the same minimiser form a super-k-mer,
which travels once, as one packed string, to the shard of its minimiser.  Equal windows
have equal minimisers, so they meet in one shard, where windows are sorted by hash, id
and start, and every window is compared with the first of its hash, byte by byte.

Before that, each step of a map task sends equal super-k-mers once only, from where they
start first; the other copies are settled on the spot.  A passage that is in a third of
all documents thus reaches its shard once for each step.  The windows around such a
passage differ but share its minimisers.  So a first pass over all texts counts
minimisers, and the windows of those with more than one in ``HOT`` of all super-k-mers
(fewer than ``HOT`` minimisers, whatever the input) travel one by one, each to the shard
of its own hash, where equal windows meet just as well.

Defined results: null text has no words; fewer than k words, nothing removed; a null id
ranks before all others; of rows that share an id, neither is earlier than the other,
only a start may be: windows at the same start repeat nothing there, whether the texts
are equal or not; a text is cut in words as a whole, however long; an empty table gives
an empty result; other columns are ignored, or kept as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import NO_ID, STEP_BYTES, Tokens, _powers, frugal, mix, ragged, shuffles, spread, steps, stored, whole
from .simhash_dedup import joined_words

K, M = 20, 3
#: A minimiser with more than this part of all super-k-mers is hot; minimisers of a step that are counted.
HOT, COUNTED = 4_096, 1_024
#: zstd level of what travels.
LEVEL = 3
#: Bytes of packed strings that a shard gets on average at most.
SHARD_BYTES = 20_000_000


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of h."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    grown, back = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * grown[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * back[: len(h) - k + 1])


def super_kmers(tok: Tokens, h: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each super-k-mer; windows are numbered by their first word."""
    none = np.zeros(0, np.int64)
    if len(h) < k:
        return none, none, np.zeros(0, np.uint64)
    mm = window_hashes(h, m)
    n = len(h) - k + 1
    best, where = mm[:n].copy(), np.arange(n)
    for j in range(1, k - m + 1):
        less = mm[j : j + n] < best
        np.copyto(best, mm[j : j + n], where=less)
        np.copyto(where, np.arange(j, j + n), where=less)
    inside = np.flatnonzero(tok.doc[:n] == tok.doc[k - 1 :])
    if not len(inside):
        return none, none, np.zeros(0, np.uint64)
    where, best = where[inside], best[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (where[1:] != where[:-1]) | (inside[1:] != inside[:-1] + 1)
    at = np.flatnonzero(new)
    return inside[at], np.diff(np.append(at, len(inside))), best[at]


_OUT = pa.schema([("shard", pa.int32()), ("ids", pa.binary()), ("tags", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary()), ("done", pa.binary())])
SENT = "shard int, ids binary, tags binary, starts binary, sizes binary, body binary, done binary"
FLAGS = "id bigint, tag bigint, start int, n int"
_FLAG = np.dtype([("id", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("n", "<i4")])


def _minimisers(k: int, m: int):
    """How often each step's most frequent minimisers occur, and, without a minimiser, how many super-k-mers it has."""

    @frugal
    def run(batches):
        for batch in batches:
            text = batch.column(0).cast(pa.large_binary())
            for a, b in steps(np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])):
                tok = Tokens(text.slice(a, b - a).to_pylist())
                low, n = np.unique(super_kmers(tok, tok.hashes(), k, m)[2], return_counts=True)
                some = np.flatnonzero(n > 1)
                some = some[np.lexsort([low[some], -n[some]])[:COUNTED]]
                yield pa.RecordBatch.from_arrays([pa.array([None, *low[some].view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n[some].tolist()], pa.int64())], ["low", "n"])

    return run


def hot_minimisers(rows: DataFrame, k: int, m: int) -> np.ndarray:
    """Minimisers of more than 1 / HOT of all super-k-mers, in order."""
    counts = stored(rows.select("text").mapInArrow(_minimisers(k, m), "low bigint, n bigint").groupBy("low").agg(F.sum("n").alias("n")), "minimisers")
    total = counts.where("low is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.where(F.col("low").isNotNull() & (F.col("n") * HOT > total)).select("low").collect()
    return np.sort(np.array([r["low"] for r in found], np.int64).view(np.uint64))


def _send(k: int, m: int, shards: int, hot: np.ndarray):
    def step(ids: np.ndarray, tags: np.ndarray, texts: list[bytes]) -> pa.RecordBatch | None:
        tok = Tokens(texts)
        h = tok.hashes()
        first, n, low = super_kmers(tok, h, k, m)
        if not len(first):
            return None
        single = np.isin(low, hot)
        if single.any():
            alone = ragged(first[single], n[single])
            first, n, low = (np.concatenate([x[~single], y]) for x, y in ((first, alone), (n, np.ones(len(alone), np.int64)), (low, window_hashes(h, k)[alone])))
            order = np.argsort(first)
            first, n, low = first[order], n[order], low[order]
        data, lo, hi = joined_words(tok, tok.data)
        # by id and start, so that the first of equal strings is an earliest one, whatever the order of rows
        order = np.lexsort([first - tok.first[tok.doc[first]], ids[tok.doc[first]]])
        first, n, low = first[order], n[order], low[order]
        doc = tok.doc[first]
        start = first - tok.first[doc]
        parts = [data[a:b] for a, b in zip(lo[first].tolist(), (hi[first + n + k - 2] + 1).tolist())]
        seen: dict[bytes, int] = {}
        lead = np.fromiter((seen.setdefault(x, j) for j, x in enumerate(parts)), np.int64, len(parts))
        level = (ids[doc[lead]] == ids[doc]) & (start[lead] == start)
        # a first copy of an equal row stands for both; other texts of its id speak for themselves
        send = np.flatnonzero((lead == np.arange(len(parts))) | (level & (tags[doc[lead]] != tags[doc])))
        told = np.flatnonzero(~level)
        at = (low % np.uint64(shards)).astype(np.int32)
        # what is settled needs no meeting place: it goes where its document leads
        at[told] = (mix(ids[doc[told]].view(np.uint64) ^ mix(tags[doc[told]].view(np.uint64))) % np.uint64(shards)).astype(np.int32)
        # like next to like, for the compressor
        send, told = send[np.lexsort([low[send], at[send]])], told[np.argsort(at[told], kind="stable")]
        every = np.unique(np.concatenate([at[send], at[told]]))
        a, b = np.searchsorted(at[send], [every, every + 1])
        c, d = np.searchsorted(at[told], [every, every + 1])
        done = np.empty(len(told), _FLAG)
        done["id"], done["tag"], done["start"], done["n"] = ids[doc[told]], tags[doc[told]], start[told], n[told]
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        cols = {x: [] for x in ("ids", "tags", "starts", "sizes", "body", "done")}
        for x, y, z, w in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()):
            own = send[x:y]
            mine = [parts[j] for j in own.tolist()]
            cols["ids"].append(ids[doc[own]].tobytes())
            cols["tags"].append(tags[doc[own]].tobytes())
            cols["starts"].append(start[own].astype(np.int32).tobytes())
            cols["sizes"].append(np.fromiter(map(len, mine), np.int32, len(mine)).tobytes())
            cols["body"].append(press(b"".join(mine)))
            cols["done"].append(done[z:w].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(every, pa.int32()), *(pa.array(v, pa.binary()) for v in cols.values())], schema=_OUT)

    @frugal
    def run(batches):
        for batch in batches:
            order = np.lexsort([batch.column(0).to_numpy(zero_copy_only=False)])
            batch = batch.take(pa.array(order))
            text = batch.column(2).cast(pa.large_binary())
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in steps(np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])):
                made = step(ids[a:b], tags[a:b], text.slice(a, b - a).to_pylist())
                if made is not None:
                    for c in range(0, made.num_rows, 64):  # small batches: bodies add up
                        yield made.slice(c, 64)

    return run


def repeats(k: int, ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """Runs of windows, as flags, that some earlier equal window makes repeats."""
    hashes, rows, offsets = [], [], []
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    for a, b in steps(sizes, STEP_BYTES // 2):
        tok = Tokens(parts[a:b])
        wh = window_hashes(tok.hashes(), k)
        inside = np.flatnonzero(tok.doc[: len(wh)] == tok.doc[k - 1 :]) if len(wh) else np.zeros(0, np.int64)
        hashes.append(wh[inside])
        rows.append((tok.doc[inside] + a).astype(np.int32))
        offsets.append((inside - tok.first[tok.doc[inside]]).astype(np.int32))
    if not hashes:
        return np.empty(0, _FLAG)
    h, row, off = np.concatenate(hashes), np.concatenate(rows), np.concatenate(offsets)
    order = np.argsort(h)
    hs = h[order]
    twin = np.zeros(len(hs), bool)
    twin[1:] = hs[1:] == hs[:-1]
    twin[:-1] |= twin[1:]
    some = order[twin]
    h, row, off = h[some], row[some], off[some]
    start = starts[row] + off
    order = np.lexsort([tags[row], start, ids[row], h])
    h, row, off, start = h[order], row[order], off[order], start[order]
    lead = np.ones(len(h), bool)
    lead[1:] = h[1:] != h[:-1]
    head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    byte_lo, byte_hi = word_edges(parts, np.unique(row), row, off, k)
    flagged = np.zeros(len(h), bool)
    firsts: dict[bytes, tuple[int, int]] = {}
    for i, (fresh, r, a, b, place) in enumerate(zip(lead.tolist(), row.tolist(), byte_lo.tolist(), byte_hi.tolist(), zip(ids[row].tolist(), start.tolist()))):
        if fresh:
            firsts = {}
        flagged[i] = firsts.setdefault(parts[r][a:b], place) < place
    flags = np.flatnonzero(flagged)
    out = np.empty(len(flags), _FLAG)
    out["id"], out["tag"], out["start"], out["n"] = ids[row[flags]], tags[row[flags]], start[flags], 1
    return runs(out)


def word_edges(parts: list[bytes], used: np.ndarray, row: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte range in its packed string of each window, given by string and offset."""
    lo, hi = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    order = np.argsort(row, kind="stable")
    sizes = np.fromiter((len(parts[r]) for r in used.tolist()), np.int64, len(used))
    for a, b in steps(sizes, STEP_BYTES // 2):
        tok = Tokens([parts[r] for r in used[a:b].tolist()])
        own = order[slice(*np.searchsorted(row[order], [used[a], used[b - 1] + 1]))]
        local = np.searchsorted(used[a:b], row[own])
        word = tok.first[local] + off[own]
        lo[own], hi[own] = tok.lo[word] - tok.at[local], tok.hi[word + k - 1] - tok.at[local]
    return lo, hi


def runs(flags: np.ndarray) -> np.ndarray:
    """Flags with consecutive windows of one document joined."""
    if not len(flags):
        return flags
    flags = flags[np.lexsort([flags["start"], flags["tag"], flags["id"]])]
    new = np.ones(len(flags), bool)
    new[1:] = (flags["id"][1:] != flags["id"][:-1]) | (flags["tag"][1:] != flags["tag"][:-1]) | (flags["start"][1:] > flags["start"][:-1] + flags["n"][:-1])
    at = np.flatnonzero(new)
    out = flags[at].copy()
    out["n"] = np.maximum.reduceat(flags["start"] + flags["n"], at) - out["start"]
    return out


def _count(k: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, tags = (np.frombuffer(b"".join(part[c]), np.int64) for c in ("ids", "tags"))
        starts = np.frombuffer(b"".join(part["starts"]), np.int32)
        plain = zstandard.ZstdDecompressor().decompress
        parts: list[bytes] = []
        for body, size in zip(part["body"], part["sizes"]):
            whole_body = plain(body) if len(size) else b""
            ends = np.cumsum(np.frombuffer(size, np.int32)).tolist()
            parts += [whole_body[a:b] for a, b in zip([0, *ends], ends)]
        told = np.frombuffer(b"".join(part["done"]), _FLAG)
        out = runs(np.concatenate([told, repeats(k, ids, tags, starts, parts)]))
        return pd.DataFrame({c: out[c] for c in ("id", "tag", "start", "n")})

    return run


def repeated_windows(rows: DataFrame, k: int = K, m: int = M, total: int | None = None) -> DataFrame:
    """Runs of n windows from start, of document (id, tag), that repeat an earlier window; rows has id, tag, text."""
    spark = rows.sparkSession
    total = total if total is not None else text_bytes(rows)
    shards = max(6 * shuffles(spark), -(-3 * total // SHARD_BYTES))
    hot = hot_minimisers(rows, k, m)
    return rows.select("id", "tag", "text").mapInArrow(_send(k, m, shards, hot), SENT).groupBy("shard").applyInPandas(_count(k), FLAGS)


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]


def cover(n_words: int, start: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a flagged window."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + n - 1 + k, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def _apply(k: int, text_at: int, found, schema: pa.Schema):
    """Texts (column ``text_at``) without the runs in the last column; ``found(batch, rows)`` makes the columns from (words, removed, kept text) of each row."""

    @frugal
    def run(batches):
        for batch in batches:
            text = batch.column(text_at).cast(pa.large_binary())
            runs = batch.column(batch.num_columns - 1)
            text = text.fill_null(b"") if text.null_count else text
            for a, b in steps(np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])):
                rows = []
                for whole_text, own in zip(text.slice(a, b - a).to_pylist(), runs.slice(a, b - a).to_pylist()):
                    words = whole_text.split()  # of bytes: splits at the six white-space bytes only
                    drop = cover(len(words), np.array([r["start"] for r in own], np.int64), np.array([r["n"] for r in own], np.int64), k) if own else None
                    rows.append((words, 0 if drop is None else int(drop.sum()), None if drop is None else b" ".join(w for w, x in zip(words, drop.tolist()) if not x)))
                yield pa.RecordBatch.from_arrays(found(batch.slice(a, b - a), rows), schema=schema)

    return run


def _with_runs(docs: DataFrame, k: int, m: int, id_col: str, text_col: str) -> DataFrame:
    """docs and, as their last column, the runs of windows of each row that repeat an earlier one."""
    text = whole(F.col(f"`{text_col}`"))
    key = [F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)), F.xxhash64(text)]
    rows = docs.select(key[0].alias("id"), key[1].alias("tag"), text.cast("binary").alias("text"))
    flags = stored(repeated_windows(spread(rows), k, m, text_bytes(rows)).groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "repeats")
    # the columns of docs go on as they are, whatever their names and types
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key[0].alias("id"), key[1].alias("tag"))
    joined = packed.join(flags, ["id", "tag"], "left")
    # by number: names may hold dots
    return joined.select(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], "runs")


def substring_dedup(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one space)."""
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def found(batch, rows):
        return [batch.column(0).cast(pa.int64()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(b" ".join(r[0]) if r[2] is None else r[2]).hexdigest() for r in rows])]

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return _with_runs(rows, k, m, "id", "text").mapInArrow(_apply(k, 1, found, schema), "id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of docs, with all their columns, their texts without repeats (and size_col, if there is one, counted anew where something went)."""
    joined = _with_runs(docs, k, m, id_col, text_col)
    names = docs.columns
    numbered = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    schema = to_arrow_schema(numbered)
    text_at, size_at = names.index(text_col), names.index(size_col) if size_col in names else None

    def found(batch, rows):
        out = [batch.column(i).cast(f.type) for i, f in enumerate(schema)]
        kept = [None if r[2] is None else r[2].decode() for r in rows]
        changed = pa.array([x is not None for x in kept])
        out[text_at] = pc.if_else(changed, pa.array(kept, pa.string()), out[text_at])
        if size_at is not None:
            out[size_at] = pc.if_else(changed, pa.array([None if x is None else len(x) for x in kept], pa.int64()).cast(schema.field(size_at).type), out[size_at])
        return out

    return joined.mapInArrow(_apply(k, text_at, found, schema), numbered).toDF(*names)
