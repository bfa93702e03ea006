import gzip
import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib

import pytest

from loomfact.llm import media
from loomfact.llm.queries import op5_media

from .frames import edge_docs


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\1\2" * 2)) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello" * 50)
    return out.getvalue()


FILES = {
    "image/png": png(), "application/zip": zipped(), "application/gzip": gzip.compress(b"q" * 999), "audio/wav": media.store_wav(b"abc"), "application/pdf": b"%PDF-1.4\nxxxx\nstartxref\n9\n%%EOF",
    "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0;",
    "image/jpeg": b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xc0\0\x0b\x08\0\1\0\1\1\1\x11\0\xff\xda\0\x08\1\1\0\0?\0abc\xff\0def\xff\xd0xx\xff\xd9",
    "image/bmp": b"BM" + struct.pack("<IIIIiiHHIIIIII", 62, 0, 54, 40, 1, 2, 1, 24, 0, 8, 0, 0, 0, 0) + b"\0" * 8,
}


@pytest.mark.parametrize("kind", sorted(FILES))
def test_formats(kind):
    data = FILES[kind]
    assert media.sniff(data)[:2] == (kind, len(data))
    noise = b"BM junk RIFF %PDF- PK\3\4 GIF89a"
    own, _, found = media.sniff(noise + data + b"tail" + png())
    assert own is None and [(k, a) for k, a, _ in found] == [(kind, len(noise)), ("image/png", len(noise) + len(data) + 4)]
    assert found[0][2] == len(data)
    assert media.sniff(data[:-1])[0] is None
    assert media.sniff(None) == (None, 0, []) and media.sniff(b"") == (None, 0, [])


def test_table(spark):
    rows = [(1, FILES["image/png"], "image/gif"), (2, b"text", "text/plain"), (3, None, None), (4, b"xx" + FILES["image/gif"] + b"yy", "text/plain")]
    got = {r.id: r for r in media.sniff_table(spark.createDataFrame(rows, "id bigint, media binary, declared string")).collect()}
    assert (got[1].type, got[1].corrected) == ("image/png", True) and (got[2].type, got[2].corrected) == ("text/plain", False) and got[3].type is None
    assert bytes(got[4].embedded[0].data) == FILES["image/gif"] and got[4].embedded[0].offset == 2


def wav(payload):
    """An 8-bit file, written by the standard library."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(payload)
    return out.getvalue()


def test_registered_query(spark, tmp_path):
    docs = edge_docs(spark, False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for r in docs.collect():
        data = (r.text or "").encode()
        full = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        file = wav(full)
        turns = sum(abs(a - b) for a, b in zip(full, full[1:]))
        feature = f"type=audio/wav;declared=image/bmp;length={len(file)};embedded=;samples={len(full)};low={min(full)};high={max(full)};sum={sum(full)};steps={turns}"
        want.append((r.doc_id, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature))
    got = op5_media(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_documents_of_several_sections():
    """An end that closes the first section, or an older revision, isn't the end of the file."""
    first = b"%PDF-1.5\nhead\nstartxref\n0\n%%EOF\n"
    data = first + b"body\nstartxref\n12\n%%EOF"
    assert media.sniff(data)[:2] == ("application/pdf", len(data))
    assert media.sniff(b"x" + data + b" " + FILES["application/pdf"])[2] == [("application/pdf", 1, len(data)), ("application/pdf", len(data) + 2, len(FILES["application/pdf"]))]


@pytest.mark.parametrize("noise", [b"%PDF-1 ", b"PK\x03\x04", b"\x1f\x8b\x08\x00"])
def test_many_signatures_take_no_square_of_time(noise):
    began = time.perf_counter()
    assert media.sniff(noise * 200_000 + b"%%EOF PK\x05\x06" + b"\0" * 18)[0] is None
    assert time.perf_counter() - began < 10
