"""Exact deduplication through a minimal perfect hash over historical digests.

The digests of the texts seen before are sharded by a hash.  Each shard holds a
minimal perfect hash (levels of bit vectors; a digest sits at the first level
where nothing else took its place, and the number of bits set before it is its
slot) and a slot table with the full 32-byte digest, the winner's id and the
number of copies.  A lookup goes to one slot and compares all 32 bytes, so a
text that was never seen can't pass for a member.

Copies are counted before anything is shuffled, thus a text that makes up a third
of all rows reaches a shard as one row from each task.

Defined results: null text counts as empty; a null id loses against any other id
and, alone, keeps itself, and an id of -2**63 stands for none; rows that share id and
text are one record and get the same answer, so that ties don't matter; texts of any
length are hashed where they lie; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, SPACES, mix, shuffles, spread, stored, whole

INDEX = "shard int, sizes array<int>, bits binary, digests binary, winners binary, copies binary"
GROUPS = "digest binary, winner bigint, copies bigint, member boolean"
#: Distinct digests in a shard at most, on average.
SHARD_ROWS = 50_000
#: Places for each digest on a level.
ROOM = 1.7


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole(text), SPACES, " ")


def key_of(id: Column, digest: Column) -> Column:
    """41 bytes for an id and a digest, ordered by id with null last, then by digest."""
    number = F.lpad(F.hex(id.cast("bigint").bitwiseXOR(F.lit(NO_ID))), 16, "0")
    return F.unhex(F.concat(F.coalesce(F.concat(F.lit("00"), number), F.lit("01" + "0" * 16)), F.hex(digest)))


def row_key(id: Column, text: Column) -> Column:
    """Key of a row: of its id and normalised text."""
    return key_of(id, F.unhex(F.sha2(normalised(text), 256)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row; the SHA-256 of the normalised text."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each distinct digest: the smallest id and the number of copies."""
    return rows.groupBy("digest").agg(F.coalesce(F.min("id"), F.lit(NO_ID)).alias("winner"), F.count(F.lit(1)).alias("copies"))


def shard(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("shard")


def shards_for(rows: DataFrame) -> int:
    return max(6 * shuffles(rows.sparkSession), -(-rows.count() // SHARD_ROWS))


def _keys(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, 4)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    return (mix((keys[:, level % 4] ^ salt) + keys[:, (level + 1) % 4]) % np.uint64(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """Sizes of the levels, their bits, and each key's slot; the keys must be distinct."""
    slots, left, sizes, bits, base = np.empty(len(keys), np.int64), np.arange(len(keys)), [], [], 0
    while len(left):
        size = -(-max(8, int(ROOM * len(left))) // 8) * 8
        at = _place(keys[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        seated = alone[at]
        slots[left[seated]] = base + (np.cumsum(alone) - 1)[at[seated]]
        base += int(alone.sum())
        sizes.append(size)
        bits.append(np.packbits(alone).tobytes())
        left = left[~seated]
    return sizes, b"".join(bits), slots


def find(keys: np.ndarray, sizes: list[int], bits: bytes) -> np.ndarray:
    """The slot of each key, or -1 where no level has a bit; a key outside the set may get a slot too."""
    slots, left, at_byte, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0, 0
    for level, size in enumerate(sizes):
        alone = np.unpackbits(np.frombuffer(bits, np.uint8, size // 8, at_byte)).astype(bool)
        at = _place(keys[left], level, size)
        hit = alone[at]
        slots[left[hit]] = base + (np.cumsum(alone) - 1)[at[hit]]
        base += int(alone.sum())
        at_byte += size // 8
        left = left[~hit]
    return slots


def _build(part: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(part["digest"])
    sizes, bits, slots = perfect_hash(keys)
    order = np.argsort(slots)
    return pd.DataFrame(
        {
            "shard": part["shard"].iloc[:1].to_numpy(),
            "sizes": [sizes],
            "bits": [bits],
            "digests": [keys[order].tobytes()],
            "winners": [part["winner"].to_numpy(np.int64)[order].tobytes()],
            "copies": [part["copies"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index over grouped() digests of what was seen before: a row for each shard."""
    return history.select(shard(shards), "digest", "winner", "copies").groupBy("shard").applyInPandas(_build, INDEX)


def _merge(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Members of the index take over its winner and copies; nonmembers stay groups of their own; unvisited slots follow."""
    keys = _keys(new["digest"])
    winner, copies = new["winner"].to_numpy(np.int64), new["copies"].to_numpy(np.int64)
    member = np.zeros(len(keys), bool)
    rest = ([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(index):
        row = index.iloc[0]
        held = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        won, seen = np.frombuffer(row["winners"], np.int64), np.frombuffer(row["copies"], np.int64)
        slots = find(keys, list(row["sizes"]), row["bits"])
        member[slots >= 0] = (held[slots[slots >= 0]] == keys[slots >= 0]).all(axis=1)
        at = slots[member]
        older = won[at]
        winner, copies = winner.copy(), copies.copy()
        mine = winner[member]
        winner[member] = np.where(older == NO_ID, mine, np.where(mine == NO_ID, older, np.minimum(mine, older)))
        copies[member] += seen[at]
        idle = np.ones(len(held), bool)
        idle[at] = False
        rest = ([x.tobytes() for x in held[idle]], won[idle], seen[idle])
    return pd.DataFrame(
        {
            "digest": [*new["digest"], *rest[0]],
            "winner": np.concatenate([winner, rest[1]]),
            "copies": np.concatenate([copies, rest[2]]),
            "member": np.concatenate([member, np.ones(len(rest[0]), bool)]),
        }
    )


def merge(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Every distinct digest of index and incoming groups: winner, copies, and whether the index holds it."""
    new = incoming.select(shard(shards), "digest", "winner", "copies").groupBy("shard")
    return new.cogroup(index.groupBy("shard")).applyInPandas(_merge, GROUPS)


def exact_dedup(docs: DataFrame, history: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, digest, keep_id, group_size, kept.

    ``history`` is true for rows of the batch that was ingested earlier: an index is
    built over those, and the others are looked up in it.  The winner is the smallest
    id whichever batch it came in, so the result doesn't depend on the split.
    """
    if history is None:
        history = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(2)) == 0
    rows = stored(digests(spread(docs), id_col, text_col), "digests")
    early = F.coalesce(history, F.lit(False))
    shards = shards_for(rows)
    index = build_index(grouped(rows.where(early)), shards)
    groups = merge(grouped(rows.where(~early)), index, shards)
    several = groups.where("copies > 1").select(F.col("digest").alias("g"), F.expr(f"nullif(winner, {NO_ID})").alias("winner"), "copies", F.lit(True).alias("found"))
    joined = rows.join(several, rows.digest == several.g, "left")
    keep = F.when(F.col("found"), F.col("winner")).otherwise(F.col("id"))
    return joined.select("id", "digest", keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"))
