"""Containers, formats and candidate names on small built inputs."""

import gzip
import io
import struct
import wave
import zipfile
import zlib

import pytest

from basalt.functions import formats
from basalt.operators import names
from basalt.sources import container as c

FILES = [("a.txt", b"alpha" * 50), ("dir/b.bin", bytes(range(256)) * 9), ("empty", b""), ("名.ks", "日本".encode())]


@pytest.mark.parametrize("options", [{}, {"zlib_index": False}, {"compress": False}, {"segment_size": 100}, {"prefix": b"MZ" + b"\0" * 77}])
def test_round_trip(options):
    data = c.packed_container(FILES, **options)
    index = c.read_index(data)
    assert [(e.name, c.restored(data, e)) for e in index.entries] == FILES
    assert [e.adler for e in index.entries] == [zlib.adler32(b) for _, b in FILES]


def test_names_resync_and_errors():
    data = bytearray(c.packed_container([("x", b"1234")], zlib_index=False, compress=False))
    start = struct.unpack_from("<Q", data, 11)[0]
    size = struct.unpack_from("<Q", data, start + 1)[0]
    name = struct.pack("<IH", 7, 4) + "real".encode("utf-16-le") + b"\0\0"
    body = b"\xff" * 3 + struct.pack("<4sQ", b"sen:", len(name)) + name + bytes(data[start + 9 : start + 9 + size])
    data[start:] = struct.pack("<BQ", 0, len(body)) + body
    (entry,) = c.read_index(bytes(data)).entries
    assert (entry.name, entry.alternate_name, c.stored(bytes(data), entry)) == ("x", "real", b"1234")
    for broken in (b"", b"MZ" + b"\0" * 99, bytes(data[:-1]), bytes(data[:13])):
        with pytest.raises(c.Malformed):
            c.read_index(broken)
    with pytest.raises(c.Malformed):
        c.read_index(bytes(data), tolerant=False)
    with pytest.raises(c.Malformed):
        c.inflated(zlib.compress(b"123"), 2)


def test_frames(spark):
    df = spark.createDataFrame([("ok", c.packed_container(FILES)), ("bad", b"nothing"), ("null", None)], "archive_id string, content binary")
    index = c.indexed(df)
    assert {r.archive_id: r.error is None for r in index.collect()} == {"ok": True, "bad": False, "null": False}
    assert [(r.preferred_name, r.original_size) for r in c.entries(index).orderBy("entry_no").collect()] == [(n, len(b)) for n, b in FILES]
    assert c.index_blocks(index).count() == 1 and c.root_chunks(index).where("kind = 'file'").count() == len(FILES)
    got = c.contents(df).collect()
    assert sorted((r.name, bytes(r.content)) for r in got if r.error is None) == sorted(FILES)
    assert all(r.adler_ok for r in got if r.error is None) and sum(r.error is not None for r in got) == 2


def _png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", b"xy") + chunk(b"IEND", b"")


def _wave():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(b"1234")
    return out.getvalue()


def _zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b")
    return out.getvalue()


def _ogg():
    page = bytearray(struct.pack("<4sBBqIIIB", b"OggS", 0, 2, 0, 5, 0, 0, 1) + b"\x03abc")
    struct.pack_into("<I", page, 22, formats.ogg_crc(bytes(page)))
    return bytes(page)


GOOD = {
    "png": _png(),
    "wave": _wave(),
    "zip": _zip(),
    "ogg": _ogg(),
    "gzip": gzip.compress(b"text"),
    "gif": b"GIF89a\1\0\1\0\0\0\0" + b",\0\0\0\0\1\0\1\0\0\2\2\x44\1\0;",
    "bmp": b"BM" + struct.pack("<III", 16, 0, 14) + b"\0\0",
    "midi": b"MThd\0\0\0\6\0\0\0\1\0\x60MTrk\0\0\0\1x",
    "flac": b"fLaC" + struct.pack(">I", 0x80000022) + b"\0" * 34 + b"x",
    "iso_bmff": struct.pack(">I4sQ", 16, b"ftyp", 0) + struct.pack(">I4s", 8, b"moov") + struct.pack(">I4s", 8, b"mdat"),
    "h264": b"\0\0\0\1\x67a\0\0\1\x68b\0\0\1\x65c",
    "utf8_text": b"\xef\xbb\xbfa = [1];",
    "utf16le_text": b"\xff\xfe" + "a = 1;".encode("utf-16-le"),
    "cp932_text": "日本 = 1; abc".encode("cp932"),
}


@pytest.mark.parametrize("name", sorted(GOOD))
def test_formats(name):
    assert formats.verdict(name, GOOD[name]) == (True, formats.CHECKS[name][1], "ok")
    for other in formats.CHECKS:  # nothing raises anything but Bad, whatever is cut off
        for cut in range(len(GOOD[name])):
            valid, _, _ = formats.verdict(other, GOOD[name][:cut])
            assert not (valid and other == name and name in ("png", "zip", "ogg", "gif", "bmp", "midi", "iso_bmff"))


def test_candidates(spark):
    rows = [("./Story\\one?x", "call:loadImage"), ("a.b>fg/c.png", ""), ("true", ""), (None, "x"), ("", "")]
    df = spark.createDataFrame(rows, "v string, ctx string")
    got = {r.candidate for r in names.candidates(df, "v", "ctx").collect()}
    assert got == {"Story/one", "one", "Story/one.ks", "Story/one.tlg", "Story/one.png", "Story/one.jpg", "a.b>fg/c.png", "c.png", "fg/c.png"}
    near = names.neighbours(spark.createDataFrame([("p/ev09a.png",), ("none",), ("n1234567",)], "n string"), "n", 2)
    assert sorted(r.candidate for r in near.collect()) == ["ev07a.png", "ev08a.png", "ev10a.png", "ev11a.png"]
