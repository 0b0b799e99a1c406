"""A small whole file of each checked format, and the same with one fault, built field by field."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib

from . import formats, formats_more

p = struct.pack
TEXT = "storage = 'first.ks'; // text"


def _png() -> bytes:
    chunk = lambda kind, body: p(">I", len(body)) + kind + body + p(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"xy") + chunk(b"IEND", b"")


def _riff(form: bytes, *chunks: tuple[bytes, bytes]) -> bytes:
    body = form + b"".join(k + p("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    return b"RIFF" + p("<I", len(body)) + body


def _page(body: bytes, kind: int, sequence: int, serial: int = 5) -> bytes:
    lacing = b"\xff" * (len(body) // 255) + bytes([len(body) % 255])
    page = bytearray(p("<4sBBqIIIB", b"OggS", 0, kind, 0, serial, sequence, 0, len(lacing)) + lacing + body)
    page[22:26] = p("<I", formats.ogg_crc(bytes(page)))
    return bytes(page)


def _zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("a"), "b")
    return out.getvalue()


def _seven_zip() -> bytes:
    start = p("<QQI", 0, 2, 0)
    return bytes.fromhex("377ABCAF271C0004") + p("<I", zlib.crc32(start)) + start + b"ab"


def _font(signature: bytes, base: int = 0) -> bytes:
    tables, at = b"", 12 + 16 * 3
    for tag in (b"cmap", b"head", b"maxp"):
        tables += tag + p(">III", 0, base + at, 16)
        at += 16
    head = bytes(12) + p(">I", 0x5F0F3CF5)
    return signature + p(">HHHH", 3, 0, 0, 0) + tables + bytes(16) + head + bytes(16)


def _bitmap_font(version: int) -> bytes:
    return formats_more.FONT + bytes([version, 2]) + p("<III", 2, 36, 40) + p("<HH", 65, 66) + (p("<IHH", 36, 1, 1) + bytes(12)) * 2


def _tlg5(wrap: bool = False) -> bytes:
    block = (b"\1" + p("<I", 2) + b"xy") * 3
    raw = formats_more.TLG5 + b"\3" + p("<III", 4, 4, 4) + p("<I", len(block)) + block
    return _wrapped(raw) if wrap else raw


def _tlg6(wrap: bool = False) -> bytes:
    raw = formats_more.TLG6 + b"\1\0\0\0" + p("<IIII", 4, 9, 64, 1) + b"f" + (p("<I", 9) + b"ab") * 2
    return _wrapped(raw) if wrap else raw


def _wrapped(raw: bytes) -> bytes:
    tags = b"4:mode=3:alp,1:a=1:b,"
    return formats_more.TLG_WRAPPED + p("<I", len(raw)) + raw + b"tags" + p("<I", len(tags)) + tags


def _numbers(*values: int) -> bytes:
    return b"\x0d" + bytes([len(values)]) + b"\x0d" + bytes(values)


def _packed_structure() -> bytes:
    names = _numbers(0) * 3
    strings = _numbers(0)
    at = 40
    places, body = [], b""
    for part in (names, strings, b"text\0", _numbers(0), _numbers(2), b"xy", b"\x21"):
        places.append(at + len(body))
        body += part
    head = b"PSB\0" + p("<HH", 2, 0) + p("<8I", places[0], *places)
    return head + body


def _compiled_script() -> bytes:
    text = "ab".encode("utf-16-le")
    pools = p("<I", 1) + b"x\0\0\0" + p("<I", 1) + b"yy\0\0" + p("<III", 0, 0, 0) + p("<II", 1, 2) + text + p("<I", 0)
    objects = p("<ii", 0, 1) + b"TJS2" + bytes(4)
    body = b"DATA" + p("<I", 8 + len(pools)) + pools + b"OBJS" + p("<I", 8 + len(objects)) + objects
    return b"TJS2100\0" + p("<I", 12 + len(body)) + body


def _pe() -> bytes:
    head = b"MZ" + bytes(58) + p("<I", 64)
    section = bytes(16) + p("<II", 0, 0) + bytes(16)
    return head + p("<4sHHIIIHH", b"PE\0\0", 0x14C, 1, 0, 0, 0, 0, 0) + section


def _asf() -> bytes:
    part = bytes(16) + p("<Q", 24)
    return bytes.fromhex("3026B2758E66CF11A6D900AA0062CE6C") + p("<QIBB", 30 + len(part), 1, 1, 2) + part


def _jpeg() -> bytes:
    frame = b"\xff\xc0" + p(">HBHHB", 11, 8, 1, 1, 1) + b"\1\x11\0"
    scan = b"\xff\xda" + p(">HB", 8, 1) + b"\1\0\0\x3f\0"
    return b"\xff\xd8" + frame + scan + b"ab\xff\x00cd\xff\xd0e" + b"\xff\xd9"


def _vorbis() -> bytes:
    return _page(b"\x01vorbis" + p("<IBI", 0, 2, 44100) + bytes(12) + b"\x01\x01", 2, 0)


def _opus() -> bytes:
    return _page(b"OpusHead" + p("<BBHIHB", 1, 2, 0, 48000, 0, 0), 2, 0) + _page(b"OpusTags" + bytes(8), 0, 1)


def files() -> dict[str, bytes]:
    """format -> a whole file."""
    utf16 = TEXT.encode("utf-16-le")
    gif = b"GIF89a" + p("<HHBBB", 1, 1, 0, 0, 0) + b"," + p("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2\x44\1\0;"
    mpeg = b"\0\0\1\xb3" + (16 << 20 | 16 << 8 | 1 << 4 | 3).to_bytes(4, "big") + b"\0\0\x20\0" + b"\0\0\1\xb8abcd" + b"\0\0\1\x00abcd"
    woff = lambda tag, n: tag + bytes(4) + p(">IH", 64 + 4, 1) + bytes(30)
    out = {
        "png": _png(),
        "wave": _riff(b"WAVE", (b"fmt ", bytes(16)), (b"data", b"abc")),
        "avi": _riff(b"AVI ", (b"LIST", b"hdrlab"), (b"LIST", b"movicd")),
        "webp": _riff(b"WEBP", (b"VP8L", b"ab")),
        "gif": gif,
        "ogg": _page(b"abc", 2, 0),
        "bmp": b"BM" + p("<III", 16, 0, 14) + b"\0\0",
        "zip": _zip(),
        "7z": _seven_zip(),
        "gzip": gzip.compress(b"text", mtime=0),
        "woff": woff(b"wOFF", 1) + p(">4sIIII", b"head", 64, 4, 4, 0) + b"body",
        "woff2": woff(b"wOF2", 1) + bytes(24),
        "flac": b"fLaC" + p(">I", 0x80000022) + bytes(34) + b"x",
        "iso_bmff": p(">I4sQ", 16, b"ftyp", 0) + p(">I4s", 8, b"moov") + p(">I4s", 8, b"mdat"),
        "midi": b"MThd\0\0\0\6" + p(">HHH", 0, 1, 96) + b"MTrk" + p(">I", 1) + b"x",
        "dds": b"DDS " + p("<IIII", 124, 0, 4, 4) + bytes(56) + p("<I", 32) + bytes(48),
        "ico": p("<HHH", 0, 1, 1) + bytes(8) + p("<II", 2, 22) + b"xy",
        "cur": p("<HHH", 0, 2, 1) + bytes(8) + p("<II", 2, 22) + b"xy",
        "ebml": bytes.fromhex("1A45DFA3") + b"abcd",
        "id3": b"ID3\4\0\0\0\0\0\2xy",
        "pe": _pe(),
        "asf": _asf(),
        "mpeg_ps": b"\0\0\1\xba" + bytes(10) + b"\0\0\1\xbbab" + b"\0\0\1\xe0ab",
        "mpeg1_video": mpeg,
        "h264": b"\0\0\0\1\x67a\0\0\1\x68b\0\0\1\x65c",
        "psd": b"8BPS\0\1" + bytes(6) + p(">HIIHH", 3, 1, 1, 8, 3) + bytes(12) + b"\0\0",
        "tga": b"\0\0\2" + bytes(9) + p("<HHB", 1, 1, 24) + b"\0" + bytes(3) + bytes(8) + b"TRUEVISION-XFILE.\0",
        "utf8_text": b"\xef\xbb\xbf" + TEXT.encode(),
        "utf16le_text": b"\xff\xfe" + utf16,
        "utf16be_text": b"\xfe\xff" + TEXT.encode("utf-16-be"),
        "cp932_text": ("日本 = 1; " + TEXT).encode("cp932"),
        "jpeg": _jpeg(),
        "jpeg_xr": b"II\xbc\x01abcd",
        "vorbis": _vorbis(),
        "opus": _opus(),
        "truetype": _font(b"\0\1\0\0"),
        "opentype": _font(b"OTTO"),
        "ttc": b"ttcf\0\1\0\0" + p(">II", 1, 16) + _font(b"OTTO", 16),
        "bitmap_font0": _bitmap_font(0),
        "bitmap_font1": _bitmap_font(1),
        "tlg5": _tlg5(),
        "tlg6": _tlg6(),
        "tlg5_wrapped": _tlg5(True),
        "tlg6_wrapped": _tlg6(True),
        "psz_shell": b"PSZ\0",
        "mdf_shell": b"mdf\0",
        "mfl_shell": b"mfl\0",
        "psb": _packed_structure(),
        "compiled_script": _compiled_script(),
    }
    return out | {f"wrapped_text{mode}": formats_more.wrapped(b"\xff\xfe" + utf16, mode) for mode in (0, 1, 2)}


def damaged(name: str, data: bytes) -> bytes:
    """data with one fault: in texts a broken character at the end, else another byte in the signature."""
    if name in ("utf8_text", "cp932_text"):
        return data + b"\x81"
    if "text" in name:
        return data[:-1]
    if name == "tga":  # signed at its end
        return data[:-1] + b"x"
    return bytes([data[0] ^ 0x40]) + data[1:]
