"""BPE encoding and decoding with public vocabularies.

``UnitEncoder`` encodes whole texts by way of units, a run of white space and the word
after it, which no pre-token crosses, and keeps the ids of units that it has seen.

Long texts are cut in halves, down to leaves of at most ``LEAF`` characters wherever
that falls, and the leaves are encoded in parallel.  ``join`` then concatenates two
neighbours: it re-encodes windows around the cut, which grow until the pre-tokens on
both sides agree with those that either side found by itself; and where a single
pre-token goes on across the cut for long, windows of its tokens grow until the first and
last token agree with those of the sides.  Tokens of a byte-level vocabulary, whose
pairs each stand as the merges of their own bytes would leave them, are the encoding of
the whole, so the result is that of encoding the text in one go.

Defined results: null text counts as empty; the empty text has no ids; the string of a
special token is that token, as the library has it by default; of merges that tie the
vocabulary's rank decides, thus equal texts get equal ids; rows that share an id are
encoded each by its text, and an id of -2**63 stands for none; a long text is held in
memory as a whole where its tree ends; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, mix, NO_ID, ragged, spread, steps, Tokens, whole

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the characters with Unicode's White_Space property, as a class of a pattern; those of ASCII first.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_UNIT_ASCII = re.compile("[\t\n\x0b\x0c\r ]*[^\t\n\x0b\x0c\r ]+|[\t\n\x0b\x0c\r ]+")
#: Characters of a leaf; tokens that a first window takes from either side; longer pre-tokens are joined by tokens.
LEAF, WINDOW, LONG = 32_768, 16, 2_048
#: Units that an encoder keeps, and their characters in all.
KEPT, KEPT_CHARS = 500_000, 10_000_000
_WIDE_SPACE = re.compile("[" + WHITE.split(" ")[1] + "]")
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class UnitEncoder:
    """Encodes many texts at once, as Tokenizer.encode(text, add_special_tokens=False) does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        #: Special tokens end a unit, so what follows them starts anew.
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in added.values()) + ")") if added else None
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        #: Byte-level words keep the space before them; word vocabularies drop it and lower the case.
        self.kind = "byte" if spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] else "word" if [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] else ""
        self.char = [chr(b) if 33 <= b < 127 or 161 <= b < 173 or b >= 174 else "" for b in range(256)]
        spare = iter(range(256, 512))
        self.char = [c or chr(next(spare)) for c in self.char]
        self._reset()

    def _word(self, unit: str) -> str | None:
        """The one pre-token, as the model takes it, of a unit that is plainly a word of Latin letters; else None."""
        word = unit[1:] if unit[0] == " " else unit
        if not word.isalpha():
            return None
        if word.isascii():
            return word.lower() if self.kind == "word" else "\u0120" + word if unit != word else word
        if max(word) > "\xff":
            return None
        if self.kind == "word":
            return "".join(map(self.char.__getitem__, word.lower().encode()))
        return "".join(map(self.char.__getitem__, unit.encode()))

    def _encode_new(self, new: list[bytes]) -> list[list[int]]:
        """Ids of units; a plain word, and a plain word before plain punctuation, straight from the model."""
        made: list = [None] * len(new)
        rest = []
        tokenize = self.tokenizer.model.tokenize
        word_kind, marks = self.kind == "word", self.marks if self.kind else {}
        for i, unit in enumerate(new):
            mark = marks.get(unit[-1])
            body = unit[:-1] if mark else unit
            if word_kind and body.isalpha():
                word = body.lower().decode()
            elif body[:1] == b" " and body[1:].isalpha() and not word_kind and marks:
                word = "\u0120" + body[1:].decode()
            else:
                word = self._word(body.decode()) if marks and body else None
            if word is None:
                rest.append(i)
            else:
                made[i] = [t.id for t in tokenize(word)]
                if mark:
                    made[i] += mark
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([new[i].decode() for i in rest], add_special_tokens=False)):
            made[i] = e.ids
        return made

    def _reset(self) -> None:
        self.units: dict[bytes, int] = {}
        self.chars = self.used = 0
        self.arena = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)
        #: Steps that used a unit, halved whenever the store was full.
        self.hits = np.zeros(1 << 14, np.int32)
        self.marks = {ord(c): self.tokenizer.encode(c, add_special_tokens=False).ids for c in ".,;:!?"}

    def _learn(self, new: list[bytes]) -> None:
        made = self._encode_new(new)
        lengths = np.fromiter(map(len, made), np.int32, len(made))
        n, total = len(self.units), int(lengths.sum())
        self.arena, self.start, self.length = _room(self.arena, self.used + total), _room(self.start, n + len(new)), _room(self.length, n + len(new))
        self.hits = _room(self.hits, n + len(new))
        self.arena[self.used : self.used + total] = np.fromiter(chain.from_iterable(made), np.int32, total)
        self.length[n : n + len(new)] = lengths
        self.start[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.units.update(zip(new, range(n, n + len(new))))
        self.chars += sum(map(len, new))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text."""
        collects = gc.isenabled()
        gc.disable()  # so many small objects, and no cycles among them
        try:
            odd = [] if self.kind == "word" else [i for i, t in enumerate(texts) if not t.isascii() and _WIDE_SPACE.search(t)]
            if not odd:
                return self._encode_plain(texts)
            # white space of several bytes: units come from the slower pattern
            made: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
            plain = sorted(set(range(len(texts))) - set(odd))
            ids, sizes = self._encode_plain([texts[i] for i in plain])
            for i, x in zip(plain, np.split(ids, np.cumsum(sizes)[:-1])):
                made[i] = x
            for i in odd:
                made[i] = self.encode_units([u.encode() for u in _UNIT.findall(texts[i])])[0]
            return np.concatenate(made), np.fromiter(map(len, made), np.int64, len(made))
        finally:
            if collects:
                gc.enable()

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts whose white space is ASCII; in a word vocabulary, any."""
        tok = Tokens([t.encode() for t in texts])
        start, end, count = tok.lo, tok.hi, tok.count
        if self.kind != "word":
            # a unit takes in the white space before its word; what ends a text stands alone
            before = np.concatenate([[0], end[:-1]]) if len(end) else end
            opens = tok.first[:-1][count > 0]
            before[opens] = tok.at[:-1][count > 0]
            tail = tok.at[:-1].copy()
            tail[count > 0] = end[tok.first[1:][count > 0] - 1]
            close = tok.at[1:] - 1
            tails = np.flatnonzero(tail < close)
            place = tok.first[1:][tails]
            start, end = np.insert(before, place, tail[tails]), np.insert(end, place, close[tails])
            count = count.copy()
            count[tails] += 1
        at = self._known(tok.data, start, end)
        lengths = self.length[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        docs = np.concatenate([[0], np.cumsum(count)])
        return self.arena[ragged(self.start[at], lengths)], np.diff(ends[docs])

    def _known(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of the unit in each byte range; those of up to 16 bytes are told apart by their first and last eight."""
        n = end - start
        padded = data + bytes(16)
        loads = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
        head = loads[start] & _MASK[np.minimum(n, 8)]
        tail = np.where(n > 8, loads[np.maximum(end - 8, 0)], np.uint64(0))
        h = mix(head ^ mix(tail + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        # equal hashes of unequal units, and longer units, are looked up one by one
        _, first, group = np.unique(h, return_index=True, return_inverse=True)
        lead = first[group]
        same = (n <= 16) & (n == n[lead]) & (head == head[lead]) & (tail == tail[lead])
        single = np.flatnonzero(~same)
        # hashes that only long units have need no lookup of their own
        some = np.flatnonzero(n[first] <= 16)
        asked = np.concatenate([first[some], single])
        units = [data[a:b] for a, b in zip(start[asked].tolist(), end[asked].tolist())]
        found = self._numbers(units)
        at = np.empty(len(first), np.int64)
        at[some] = found[: len(some)]
        out = at[group]
        out[single] = found[len(some) :]
        return out

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each unit."""
        at = self._numbers(units)
        lengths = self.length[at].astype(np.int64)
        return self.arena[ragged(self.start[at], lengths)], lengths

    def _numbers(self, units: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.units.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list(dict.fromkeys(units[i] for i in missing))
            if len(self.units) + len(new) > KEPT or self.chars > KEPT_CHARS:
                self._keep(set(units))
                missing = range(len(units))
            self._learn(new)
            at[missing] = np.fromiter((self.units[units[i]] for i in missing), np.int64, len(missing))
        self.hits[at] += 1
        return at

    def _keep(self, asked: set[bytes]) -> None:
        """Forgets all units but those that the present step uses, and, up to half the store, those that most steps used."""
        hits = self.hits[: len(self.units)]
        often = max(2, int(np.partition(hits, -(KEPT // 2))[-(KEPT // 2)]) + 1) if len(hits) > KEPT // 2 else 2
        some = [u for u, x in zip(self.units, (hits >= often).tolist()) if x or u in asked]
        at = np.fromiter(map(self.units.__getitem__, some), np.int64, len(some))
        lengths = self.length[at].astype(np.int64)
        self.arena, self.length, self.hits = self.arena[ragged(self.start[at], lengths)], self.length[at], self.hits[at] // 2
        self.start = np.cumsum(lengths) - lengths
        self.used = int(lengths.sum())
        self.units = dict(zip(some, range(len(some))))
        self.chars = sum(map(len, some))


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n entries, at least doubled if it grows."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The encoder of a vocabulary file in this process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


class Bytes:
    """Byte strings of the tokens of a byte-level vocabulary, and the way back."""

    def __init__(self, tokenizer):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.byte = {c: b for b, c in self.char.items()}
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        self.of = [b""] * (max(vocab.values()) + 1)
        self.numbers = [b"%d" % i for i in range(len(self.of))]
        for token, i in vocab.items():
            self.of[i] = bytes(self.byte[c] for c in token) if all(c in self.byte for c in token) else token.encode()

    def text(self, ids) -> bytes:
        return b"".join(map(self.of.__getitem__, ids))


_BYTES: dict[str, Bytes] = {}


def byte_table(path: str) -> Bytes:
    if path not in _BYTES:
        _BYTES[path] = Bytes(encoder(path).tokenizer)
    return _BYTES[path]


def decode(path: str, ids) -> str:
    """The text of a list of ids, as the library's decode(ids, skip_special_tokens=False)."""
    return byte_table(path).text(ids).decode("utf-8", "replace")


# --- tree concatenation -----------------------------------------------------


class Piece:
    """Encoded text: its pre-tokens (end offsets in characters) and the ids of each."""

    def __init__(self, text: str, ends: list[int], ids: list[list[int]]):
        self.text, self.ends, self.ids = text, ends, ids

    def flat(self) -> list[int]:
        return [i for x in self.ids for i in x]


def _scan(path: str, text: str) -> list[tuple[int, int]]:
    """Pre-tokens and special tokens as (start, end) in characters."""
    enc = encoder(path)
    out, at = [], 0
    for part in enc.special.split(text) if enc.special else [text]:
        if part and enc.special and enc.special.fullmatch(part):
            out.append((at, at + len(part)))
        else:
            out += [(at + a, at + b) for _, (a, b) in enc.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        at += len(part)
    return out


def encode_piece(path: str, text: str) -> Piece:
    """One leaf.  Away from its ends, whole units stand for their pre-tokens."""
    enc = encoder(path)
    if enc.special and enc.special.search(text):
        spans = _scan(path, text)
        ids, sizes = enc.encode_units([text[a:b].encode() for a, b in spans]) if spans else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        return Piece(text, [b for _, b in spans], cut(ids, sizes))
    units = (_UNIT_ASCII if text.isascii() else _UNIT).findall(text)
    parts: list[str] = []
    for k, unit in enumerate(units):
        parts += [unit] if 2 <= k < len(units) - 2 else [unit[a:b] for a, b in _scan(path, unit)]
    ids, sizes = enc.encode_units([x.encode() for x in parts])
    return Piece(text, np.cumsum([len(x) for x in parts]).tolist(), cut(ids, sizes))


def cut(ids: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    flat, ends = ids.tolist(), np.cumsum(sizes).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _merge_tokens(path: str, left: list[int], right: list[int]) -> list[int]:
    """The ids of one pre-token from those of its two parts."""
    table, model = byte_table(path), encoder(path).tokenizer.model
    n = WINDOW
    while True:
        a, b = left[-n:], right[:n]
        made = [t.id for t in model.tokenize("".join(table.char[x] for x in table.text([*a, *b])))]
        if (n >= len(left) or made[0] == a[0]) and (n >= len(right) or made[-1] == b[-1]):
            return left[: len(left) - len(a)] + made + right[len(b) :]
        n *= 2


def join(path: str, left: Piece, right: Piece) -> Piece:
    """The encoding of left.text + right.text."""
    if not left.text or not right.text:
        return right if not left.text else left
    enc = encoder(path)
    margin = max((len(t.content) for t in enc.tokenizer.get_added_tokens_decoder().values()), default=0) + 2
    n = WINDOW
    cut = len(left.text)
    right_ends = {e: k for k, e in enumerate(right.ends)}
    while True:
        # from a boundary of the left side, far enough from its end for lookahead and special tokens
        keep = max(0, len(left.ends) - n)
        while keep and cut - left.ends[keep - 1] < margin:
            keep -= 1
        c = left.ends[keep - 1] if keep else 0
        last = min(len(right.ends), n) - 1
        e = right.ends[last]
        window = left.text[c:] + right.text[:e]
        spans = [(a + c, b + c) for a, b in _scan(path, window)]
        whole_right = last == len(right.ends) - 1
        # a boundary in the right side that both scans have, again far enough from the window's end
        agreed = next((i for i, (_, b) in enumerate(spans) if b - cut >= margin and (b - cut) in right_ends and (whole_right or cut + e - b >= margin) and i < len(spans) - (0 if whole_right else 2)), None)
        left_agrees = not keep or any(b == left.ends[keep] for _, b in spans) or keep == len(left.ends)
        if agreed is not None and left_agrees:
            d = spans[agreed][1]
            break
        if whole_right and not keep:
            agreed, d = len(spans) - 1, cut + len(right.text)
            break
        if whole_right and left_agrees:
            agreed, d = len(spans) - 1, cut + len(right.text)
            break
        n *= 2
    inner = spans[: agreed + 1]
    rest = right_ends[d - cut] + 1
    known = {(s, b): k for k, (s, b) in enumerate(zip([0, *left.ends], left.ends)) if k >= keep and k < len(left.ends)}
    short = [s for s in inner if s not in known and s[1] - s[0] <= LONG]
    full = left.text[c:] + right.text[: d - cut]
    made = dict(zip(short, (e.ids for e in enc.tokenizer.encode_batch_fast([full[a - c : b - c] for a, b in short], add_special_tokens=False))))
    ids = []
    for a, b in inner:
        if (a, b) in known and b < cut:
            ids.append(left.ids[known[a, b]])
        elif (a, b) in made:
            ids.append(made[a, b])
        elif (a, b) in known:
            ids.append(left.ids[known[a, b]])
        else:
            k, m = known.get((a, cut)), right_ends.get(b - cut)
            if k is not None and m == 0:
                ids.append(_merge_tokens(path, left.ids[k], right.ids[0]))
            else:
                ids.append(enc.tokenizer.encode(full[a - c : b - c], add_special_tokens=False).ids)
    return Piece(left.text + right.text, left.ends[:keep] + [b for _, b in inner] + [x + cut for x in right.ends[rest:]], left.ids[:keep] + ids + right.ids[rest:])


def leaves(text: str, most: int = LEAF) -> list[str]:
    """The text in halves of halves, until none is longer than most."""
    if len(text) <= most:
        return [text]
    half = len(text) // 2
    return leaves(text[:half], most) + leaves(text[half:], most)


def concatenate(path: str, pieces: list[Piece]) -> Piece:
    """Neighbours joined pairwise, level by level."""
    while len(pieces) > 1:
        pieces = [join(path, *pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


# --- DataFrame operators ----------------------------------------------------

ENCODED = "id bigint, ids array<int>"


def _plain(ids: list[np.ndarray], path: str) -> list[pa.Array]:
    return [pa.array(ids, pa.list_(pa.int32()))]


def _short(path: str, finish, names: list[str]):
    @frugal
    def run(batches):
        for batch in batches:
            text = batch.column(1).cast(pa.large_string())
            sizes = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])
            for a, b in steps(sizes):
                ids, counts = encoder(path).encode(text.slice(a, b - a).to_pylist())
                each = np.split(ids, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *finish(each, path)], ["id", *names])

    return run


def _leaf(path: str):
    @frugal
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                piece = encode_piece(path, row["text"])
                yield pa.RecordBatch.from_pylist([{**row, "ends": np.array(piece.ends, np.int32).tobytes(), "sizes": np.array([len(x) for x in piece.ids], np.int32).tobytes(), "ids": np.array(piece.flat(), np.int32).tobytes()}], _LEAF_SCHEMA)

    return run


_LEAF_SCHEMA = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("leaf", pa.int32()), ("copies", pa.int64()), ("text", pa.string()), ("ends", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])


def _tree(path: str, finish, names: list[str]):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        pieces = []
        for text, ends, sizes, ids in part.sort_values("leaf")[["text", "ends", "sizes", "ids"]].itertuples(index=False):
            pieces.append(Piece(text, np.frombuffer(ends, np.int32).tolist(), cut(np.frombuffer(ids, np.int32), np.frombuffer(sizes, np.int32))))
        made = finish([np.array(concatenate(path, pieces).flat(), np.int32)], path)
        out = pd.DataFrame({"id": part["id"].iloc[:1].to_numpy(), **{n: x.to_pylist() for n, x in zip(names, made)}})
        return out.loc[out.index.repeat(int(part["copies"].iloc[0]))]

    return run


@frugal
def _halves(batches):
    for batch in batches:
        for row in batch.to_pylist():
            for k, text in enumerate(leaves(row["text"])):
                yield pa.RecordBatch.from_pylist([{"id": row["id"], "tag": row["tag"], "leaf": k, "copies": row["copies"], "text": text}], pa.schema(list(_LEAF_SCHEMA)[:5]))


def encode_table(docs: DataFrame, path: str, finish=_plain, schema: str = ENCODED, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: id and its ids, or what ``finish(list of ids, path)`` makes of them (schema: "id bigint, ...")."""
    names = [x.split()[0] for x in schema.split(", ")][1:]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), whole(F.col(text_col)).alias("text"))
    short = spread(rows).where(F.length("text") <= leaf).mapInArrow(_short(path, finish, names), schema)
    # rows that share id and text are encoded once
    long = rows.where(F.length("text") > leaf).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("tag"), F.lit(1).cast("bigint").alias("copies"), "text")
    part = long.mapInArrow(_halves, "id bigint, tag bigint, leaf int, copies bigint, text string")
    part = part.groupBy("id", "tag", "leaf").agg(F.sum("copies").alias("copies"), F.first("text").alias("text")).select("id", "tag", "leaf", "copies", "text")
    done = part.mapInArrow(_leaf(path), "id bigint, tag bigint, leaf int, copies bigint, text string, ends binary, sizes binary, ids binary")
    joined = done.groupBy("id", "tag").applyInPandas(_tree(path, finish, names), schema)
    return short.unionByName(joined.withColumn("id", F.expr(f"nullif(id, {NO_ID})")))
