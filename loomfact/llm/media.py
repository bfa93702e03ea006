"""Media columns: signature sniffing, declared types corrected, embedded media carved.

An Aho-Corasick automaton finds every magic byte string of a media file in one pass.  At
each hit the format's validator walks the structure (chunks, blocks, directories, check
sums) and returns the length of the file that starts there, or nothing.  What starts at
offset 0 gives the type of the whole; files further in are carved, outermost first, one
after the other.

``store_wav`` keeps any bytes, losslessly, as samples of an 8-bit WAV file.

Defined results: null or empty media have no type and nothing embedded; a declared type
stands where nothing was recognised; of overlapping files the one that starts first is
carved; equal rows give equal rows; one medium is held in memory as a whole, however long,
and a text of four GiB or more is refused; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, spread, steps, whole

#: Magic bytes of each type.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"RIFF": "audio/wav",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
}


def _png(data: bytes, at: int) -> int | None:
    here, first = at + 8, True
    while here + 12 <= len(data):
        size = int.from_bytes(data[here : here + 4], "big")
        kind = data[here + 4 : here + 8]
        end = here + 12 + size
        if end > len(data) or (first and (kind != b"IHDR" or size != 13)) or zlib.crc32(data[here + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return end - at
        here, first = end, False
    return None


def _gif_blocks(data: bytes, here: int) -> int | None:
    while here < len(data):
        if not data[here]:
            return here + 1
        here += 1 + data[here]
    return None


def _gif(data: bytes, at: int) -> int | None:
    if at + 13 > len(data):
        return None
    here = at + 13 + (3 << ((data[at + 10] & 7) + 1) if data[at + 10] & 128 else 0)
    while here < len(data):
        mark = data[here]
        if mark == 0x3B:
            return here + 1 - at
        if mark == 0x21 and here + 2 <= len(data):
            following = _gif_blocks(data, here + 2)
        elif mark == 0x2C and here + 10 <= len(data):
            flags = data[here + 9]
            following = _gif_blocks(data, here + 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
        else:
            return None
        if following is None:
            return None
        here = following
    return None


def _jpeg(data: bytes, at: int) -> int | None:
    here, frames = at + 2, 0
    while here + 4 <= len(data):
        if data[here] != 0xFF:
            return None
        mark = data[here + 1]
        if mark == 0xFF:
            here += 1
            continue
        if mark == 0 or 0xD0 <= mark <= 0xD8:
            return None
        size = int.from_bytes(data[here + 2 : here + 4], "big")
        if size < 2 or here + 2 + size > len(data):
            return None
        frames += 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        here += 2 + size
        if mark == 0xDA:
            if not frames:
                return None
            while True:  # coded data: up to a marker that isn't stuffing or a restart
                here = data.find(b"\xff", here)
                if here < 0 or here + 1 >= len(data):
                    return None
                if data[here + 1] == 0xD9:
                    return here + 2 - at
                if data[here + 1] and not 0xD0 <= data[here + 1] <= 0xD7:
                    break
                here += 2
    return None


def _wav_chunks(data: bytes, at: int) -> dict[bytes, tuple[int, int]] | None:
    """Place and size of each chunk, if all of them fit the file's length."""
    if at + 12 > len(data) or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if end > len(data):
        return None
    found: dict[bytes, tuple[int, int]] = {}
    here = at + 12
    while here + 8 <= end:
        size = int.from_bytes(data[here + 4 : here + 8], "little")
        if here + 8 + size > end:
            return None
        found.setdefault(data[here : here + 4], (here + 8, size))
        here += 8 + size + size % 2
    return found if here in (end, end + 1) and b"fmt " in found and found[b"fmt "][1] >= 16 and b"data" in found else None


def _wav(data: bytes, at: int) -> int | None:
    return 8 + int.from_bytes(data[at + 4 : at + 8], "little") if _wav_chunks(data, at) else None


def _bmp(data: bytes, at: int) -> int | None:
    if at + 30 > len(data):
        return None
    size, spare, start, header = struct.unpack_from("<IIII", data, at + 2)
    if spare or header not in (40, 108, 124) or start < 14 + header or size < start or at + size > len(data):
        return None
    width, height, planes, bits = struct.unpack_from("<iiHH", data, at + 18)
    packed = int.from_bytes(data[at + 30 : at + 34], "little")
    if planes != 1 or width <= 0 or not height or bits not in (1, 4, 8, 16, 24, 32):
        return None
    return size if packed or start + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


class Marks:
    """What closes files of formats that are closed from behind, found in one pass over the data."""

    def __init__(self, data: bytes):
        #: Ends of archives by where they begin: the directory's place and size say so.
        self.zips: dict[int, int] = {}
        end = data.find(b"PK\x05\x06")
        while end >= 0:
            if end + 22 <= len(data):
                count, size, start, note = struct.unpack_from("<HIIH", data, end + 10)
                at = end - start - size
                if at >= 0 and (not count or data[at + start : at + start + 4] == b"PK\x01\x02") and end + 22 + note <= len(data):
                    self.zips.setdefault(at, end + 22 + note)
            end = data.find(b"PK\x05\x06", end + 4)
        #: Headers of documents; ends, and, for each, what its file must begin before.
        self.headers = [m.start() for m in re.finditer(rb"%PDF-\d", data)]
        self.ends, self.before, seen = [], [], 0
        end = data.find(b"%%EOF") if self.headers else -1
        while end >= 0:
            begin = data.rfind(b"startxref", seen, end)
            place = data[begin + 9 : end].strip() if begin >= 0 else b""
            if place.isdigit():
                self.ends.append(end + 5)
                self.before.append(begin - int(place))
            seen, end = end, data.find(b"%%EOF", end + 5)


def _pdf(data: bytes, at: int, marks: Marks) -> int | None:
    """Up to the last end, before the next header, whose cross references lie in this file: earlier ones close its first section or an older revision."""
    if not data[at + 5 : at + 6].isdigit():
        return None
    following = bisect_right(marks.headers, at)
    limit = marks.headers[following] if following < len(marks.headers) else len(data)
    for k in range(bisect_right(marks.ends, limit) - 1, bisect_right(marks.ends, at) - 1, -1):
        if at < marks.before[k]:
            return marks.ends[k] - at
    return None


def _zip(data: bytes, at: int, marks: Marks) -> int | None:
    return marks.zips[at] - at if at in marks.zips else None


def _gzip(data: bytes, at: int) -> int | None:
    if at + 18 > len(data) or data[at + 3] & 0xE0:
        return None
    unpack = zlib.decompressobj(31)
    try:
        part = memoryview(data)[at:]
        while part and not unpack.eof:
            unpack.decompress(part, 1 << 20)  # thrown away: a bomb takes no room
            part = unpack.unconsumed_tail
    except zlib.error:
        return None
    return len(data) - at - len(unpack.unused_data) if unpack.eof else None


VALID = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "audio/wav": _wav, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip}
_MACHINE: list = []


def _machine():
    if not _MACHINE:
        made = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            made.add_word(magic.decode("latin-1"), (len(magic), kind))
        made.make_automaton()
        _MACHINE.append(made)
    return _MACHINE[0]


def sniff(data: bytes | None) -> tuple[str | None, int, list[tuple[str, int, int]]]:
    """(type, length) of the file that starts at 0, or (None, 0); and (type, offset, length) of what is embedded."""
    if not data:
        return None, 0, []
    own, own_size, found, free, marks = None, 0, [], 1, None
    for last, (n, kind) in _machine().iter(data.decode("latin-1")):
        at = last - n + 1
        if at and at < free:
            continue
        if kind in ("application/pdf", "application/zip"):
            marks = marks or Marks(data)
            size = VALID[kind](data, at, marks)
        else:
            size = VALID[kind](data, at)
        if size is None:
            continue
        if at:
            found.append((kind, at, size))
            free = at + size
        else:
            own, own_size = kind, size
    return own, own_size, found


def store_wav(payload: bytes, rate: int = 8_000) -> bytes:
    """The bytes as unsigned 8-bit samples of one channel; lengths have 32 bits in this format."""
    size = len(payload)
    if size > (1 << 32) - 46:
        raise ValueError("a WAV file holds less than four GiB")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size + size % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", size) + payload + b"\0" * (size % 2)


def read_wav(data: bytes) -> bytes:
    """The samples of an 8-bit WAV file."""
    chunks = _wav_chunks(data, 0)
    if chunks is None or struct.unpack_from("<HHIIHH", data, chunks[b"fmt "][0])[::5] != (1, 8):
        raise ValueError("not an 8-bit WAV file")
    at, size = chunks[b"data"]
    return data[at : at + size]


def features(data: bytes, declared: str | None) -> str:
    """What sniffing and the samples tell, as one line."""
    kind, size, inside = sniff(data)
    out = [f"type={kind or declared or ''}", f"declared={declared or ''}", f"length={size}", "embedded=" + ",".join(f"{k}@{a}+{n}" for k, a, n in inside)]
    if kind == "audio/wav":
        x = np.frombuffer(read_wav(data), np.uint8)
        if len(x):
            out += [f"samples={len(x)}", f"low={x.min()}", f"high={x.max()}", f"sum={int(x.sum(dtype=np.int64))}", f"steps={int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))}"]
    return ";".join(out)


SNIFFED = "id bigint, declared string, type string, corrected boolean, length bigint, embedded array<struct<type: string, offset: bigint, length: bigint, data: binary>>"


def sniff_table(media: DataFrame, id_col: str = "id", data_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """One row per row of media: its real type, whether that corrects the declared one, its length, and the files carved from it."""

    @frugal
    def run(batches):
        for batch in batches:
            out = []
            for i, data, declared in zip(*(batch.column(k).to_pylist() for k in range(3))):
                kind, size, inside = sniff(data)
                out.append({"id": i, "declared": declared, "type": kind or declared, "corrected": kind is not None and kind != declared, "length": size, "embedded": [{"type": k, "offset": a, "length": n, "data": data[a : a + n]} for k, a, n in inside]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("id", pa.int64()), ("declared", pa.string()), ("type", pa.string()), ("corrected", pa.bool_()), ("length", pa.int64()), ("embedded", pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])))]))

    return media.select(F.col(id_col).cast("bigint").alias("id"), F.col(data_col).cast("binary").alias("media"), F.col(declared_col).cast("string").alias("declared")).mapInArrow(run, SNIFFED)


def stored_texts(docs: DataFrame, finish, schema: str, unit: int = 576, declared: str = "image/bmp", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as UTF-8, filled with bytes 255 to a positive multiple of ``unit`` and stored as WAV; ``finish(n_bytes, media, declared)`` gives the columns after id."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "bigint" else pa.string() if x.split()[1] == "string" else pa.binary() for x in schema.split(", ")]

    @frugal
    def run(batches):
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            for a, b in steps(np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])):
                rows = []
                for data in text.slice(a, b - a).to_pylist():
                    size = max(1, -(-len(data) // unit)) * unit
                    rows.append(finish(len(data), store_wav(data.ljust(size, b"\xff")), declared))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:]))], names)

    rows = spread(docs).select(F.col(id_col).cast("bigint").alias("id"), whole(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, schema)
