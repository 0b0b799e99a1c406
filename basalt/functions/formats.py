"""Is a byte string a whole file of a named format?

A check raises Bad with a reason, or returns; its strength, 0 to 100, is listed with it in CHECKS.
Formats made of length-prefixed parts share `parts`, which walks them and holds them to their bounds.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes import copied

STRONG = 80
#: Characters of a text that are listed at once.
PIECE = 1 << 16


class Bad(ValueError):
    """Why bytes are not of a format."""


def need(ok: bool, why: str) -> None:
    if not ok:
        raise Bad(why)


def num(data: bytes, layout: str, at: int):
    """Numbers at an offset; one number comes bare."""
    try:
        got = struct.unpack_from(layout, data, at)
    except struct.error:
        raise Bad("truncated") from None
    return got[0] if len(got) == 1 else got


def parts(data: bytes, at: int, end: int, layout: str, *, size_at: int, tail: int = 0, even: bool = False, whole: bool = False) -> Iterator[tuple]:
    """(header fields, start, stop) of parts that fill data[at:end] exactly.

    Field `size_at` of the header is the size of the content, or of header and content if `whole`.
    `tail` bytes follow each content, and with `even` a byte of padding follows an odd one.
    """
    head = struct.calcsize(layout)
    while at < end:
        need(at + head <= end, "truncated part")
        fields = struct.unpack_from(layout, data, at)
        start = at + head
        stop = (at if whole else start) + fields[size_at]
        at = stop + tail + (even and (stop - start) % 2)
        need(start <= stop and at <= end, "a part is outside the file")
        yield fields, start, stop


def png(b: bytes) -> None:
    need(b.startswith(b"\x89PNG\r\n\x1a\n"), "signature")
    kind = None
    for k, ((size, name), start, stop) in enumerate(parts(b, 8, len(b), ">I4s", size_at=0, tail=4)):
        need(kind != b"IEND", "bytes after IEND")
        need(k > 0 or (name, size) == (b"IHDR", 13), "first chunk")
        need(zlib.crc32(b[start - 4 : stop]) == num(b, ">I", stop), "chunk CRC")
        need(name != b"IEND" or size == 0, "IEND is not empty")
        kind = name
    need(kind == b"IEND", "no IEND")


#: What a form needs: chunk names, of which all or any must occur. LIST chunks count by their type.
RIFF_NEEDS = {b"WAVE": (all, (b"fmt ", b"data")), b"AVI ": (all, (b"hdrl", b"movi")), b"WEBP": (any, (b"VP8 ", b"VP8L", b"VP8X"))}


def riff(form: bytes, b: bytes) -> None:
    need(len(b) >= 12 and b[:4] == b"RIFF" and b[8:12] == form, "header or form")
    end = num(b, "<I", 4) + 8
    need(len(b) - end in (0, 1), "declared size")
    seen = set()
    for (name, size), start, _ in parts(b, 12, end, "<4sI", size_at=1, even=True):
        need((form, name) != (b"WAVE", b"fmt ") or size >= 16, "fmt chunk too small")
        seen.add(b[start : start + 4] if name == b"LIST" and form == b"AVI " and size >= 4 else name)
    how, names = RIFF_NEEDS[form]
    need(how(n in seen for n in names), "required chunks")


def _past_blocks(b: bytes, at: int) -> int:
    while size := num(b, "B", at):
        at += 1 + size
    return at + 1


def _past_palette(packed: int, at: int) -> int:
    return at + (3 << ((packed & 7) + 1) if packed & 0x80 else 0)


def gif(b: bytes) -> None:
    need(b[:6] in (b"GIF87a", b"GIF89a"), "signature")
    width, height, packed = num(b, "<HHB", 6)
    need(width > 0 and height > 0, "screen size")
    at, images = _past_palette(packed, 13), 0
    while (mark := num(b, "B", at)) != 0x3B:
        if mark == 0x21:
            at = _past_blocks(b, at + 2)
            continue
        need(mark == 0x2C, "block introducer")
        width, height, packed = num(b, "<HHB", at + 5)
        need(width > 0 and height > 0, "image size")
        at = _past_palette(packed, at + 10)
        need(2 <= num(b, "B", at) <= 8, "code size")
        at, images = _past_blocks(b, at + 1), images + 1
    need(images > 0 and at + 1 == len(b), "trailer or no image")


REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_crc(data: bytes) -> int:
    """CRC-32 of the same polynomial with the most significant bit first, from 0: that of the bytes with
    their bits reversed, reversed.
    """
    r = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{r:032b}"[::-1], 2)


def ogg(b: bytes) -> None:
    need(bool(b), "empty")
    at, following = 0, {}
    while at < len(b):
        magic, version, flags, _, serial, sequence, crc, n = num(b, "<4sBBqIIIB", at)
        need(magic == b"OggS" and version == 0, "page header")
        end = at + 27 + n + sum(b[at + 27 : at + 27 + n])
        need(at + 27 + n <= len(b) and end <= len(b), "page outside the file")
        need(ogg_crc(b[at : at + 22] + b"\0\0\0\0" + b[at + 26 : end]) == crc, "page CRC")
        need(bool(flags & 2) == (serial not in following) and sequence == following.get(serial, 0), "page order")
        following[serial] = sequence + 1
        at = end


def bmp(b: bytes) -> None:
    need(b[:2] == b"BM", "signature")
    size, _, pixels = num(b, "<III", 2)
    need(size == len(b) and 14 <= pixels <= size, "size or pixel offset")


def zip_(b: bytes) -> None:
    need(b[:2] == b"PK", "signature")
    at = b.rfind(b"PK\5\6", max(len(b) - 65_557, 0))
    need(at >= 0, "no end record")
    need(at + 22 + num(b, "<H", at + 20) == len(b), "comment size")


def seven_zip(b: bytes) -> None:
    need(b[:6] == bytes.fromhex("377ABCAF271C"), "signature")
    crc, offset, size, _ = num(b, "<IQQI", 8)
    need(zlib.crc32(b[12:32]) == crc, "start header CRC")
    need(32 + offset + size <= len(b), "next header outside the file")


def gzip_(b: bytes) -> None:
    need(b[:3] == b"\x1f\x8b\x08", "signature")
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(b)) as stream:
            while stream.read(1 << 20):
                pass
    except (OSError, EOFError, zlib.error):
        raise Bad("decompression") from None


def woff(b: bytes) -> None:
    need(b[:4] == b"wOFF" and num(b, ">I", 8) == len(b), "header or length")
    n = num(b, ">H", 12)
    need(0 < n <= 4096 and 44 + 20 * n <= len(b), "directory")
    for i in range(n):
        offset, packed, original = num(b, ">III", 48 + 20 * i)
        need(0 < packed <= original and offset + packed <= len(b), "table range")


def woff2(b: bytes) -> None:
    need(len(b) >= 48 and b[:4] == b"wOF2" and num(b, ">I", 8) == len(b), "header or length")
    need(num(b, ">H", 12) > 0, "no tables")


def flac(b: bytes) -> None:
    need(b[:4] == b"fLaC", "signature")
    at, last, k = 4, False, 0
    while not last:
        head = num(b, ">I", at)
        last, kind, size = bool(head >> 31), head >> 24 & 0x7F, head & 0xFFFFFF
        need(k > 0 or (kind, size) == (0, 34), "first block")
        need(kind != 127 and k <= 1024, "metadata block")
        at, k = at + 4 + size, k + 1
    need(at < len(b), "no audio")


def iso_bmff(b: bytes) -> None:
    need(len(b) >= 16 and b[4:8] == b"ftyp", "no ftyp")
    at, seen = 0, set()
    while at < len(b):
        size, name = num(b, ">I4s", at)
        head = 8
        if size == 1:
            size, head = num(b, ">Q", at + 8), 16
        elif size == 0:
            size = len(b) - at
        need(head <= size <= len(b) - at, "box size")
        seen.add(name)
        at += size
    need(b"moov" in seen and bool(seen & {b"mdat", b"moof"}), "required boxes")


def midi(b: bytes) -> None:
    need(b[:8] == b"MThd\0\0\0\6", "header")
    kind, tracks, division = num(b, ">HHH", 8)
    need(kind <= 2 and tracks > 0 and division > 0, "header fields")
    names = [name for (name, _), _, _ in parts(b, 14, len(b), ">4sI", size_at=1)]
    need(names == [b"MTrk"] * tracks, "tracks")


def dds(b: bytes) -> None:
    need(len(b) >= 128 and b[:4] == b"DDS " and num(b, "<I", 4) == 124 and num(b, "<I", 76) == 32, "header")
    need(all(0 < side <= 1_000_000 for side in num(b, "<II", 12)), "dimensions")


def icon(kind: int, b: bytes) -> None:
    zero, got, n = num(b, "<HHH", 0)
    first = 6 + 16 * n
    need(zero == 0 and got == kind and 0 < n <= 4096 and first <= len(b), "directory")
    for i in range(n):
        size, offset = num(b, "<II", 14 + 16 * i)
        need(size > 0 and offset >= first and offset + size <= len(b), "image range")


def ebml(b: bytes) -> None:
    need(len(b) >= 8 and b[:4] == bytes.fromhex("1A45DFA3"), "signature")


def id3(b: bytes) -> None:
    need(len(b) >= 10 and b[:3] == b"ID3" and 0xFF not in b[3:5], "header")
    need(max(b[6:10]) < 0x80, "size digits")
    size = 0
    for digit in b[6:10]:
        size = size * 128 + digit
    need(10 + size <= len(b), "tag outside the file")


def pe(b: bytes) -> None:
    need(b[:2] == b"MZ", "signature")
    at = num(b, "<I", 60)
    magic, _, n, _, _, _, optional, _ = num(b, "<4sHHIIIHH", at)
    need(magic == b"PE\0\0" and 0 < n <= 96, "header")
    for i in range(n):
        row = at + 24 + optional + 40 * i
        size, offset = num(b, "<II", row + 16)
        need(row + 40 <= len(b) and (size == 0 or offset + size <= len(b)), "section range")


def asf(b: bytes) -> None:
    need(b[:16] == bytes.fromhex("3026B2758E66CF11A6D900AA0062CE6C"), "signature")
    size, n, one, two = num(b, "<QIBB", 16)
    need(30 <= size <= len(b) and 0 < n <= 100_000 and (one, two) == (1, 2), "header")
    need(sum(1 for _ in parts(b, 30, size, "<16sQ", size_at=1, whole=True)) == n, "object count")


def mpeg_ps(b: bytes) -> None:
    need(len(b) >= 14 and b[:4] == b"\0\0\1\xba", "pack header")
    need(len(re.findall(rb"\x00\x00\x01(?=.)", b, re.S)) >= 3, "start codes")


def mpeg1_video(b: bytes) -> None:
    need(len(b) >= 12 and b[:4] == b"\0\0\1\xb3", "sequence header")
    head = int.from_bytes(b[4:8], "big")
    need(head >> 20 > 0 and head >> 8 & 0xFFF > 0 and head >> 4 & 15 > 0 and 1 <= head & 15 <= 8, "size or rate")
    need(bool(b[10] & 0x20), "marker bit")
    codes = {m[0][3] for m in re.finditer(rb"\x00\x00\x01[\x00\xb3\xb5\xb7\xb8]", b, re.S)}
    need(0 in codes and len(codes) > 1, "pictures")


def h264(b: bytes) -> None:
    need(bool(re.match(rb"\x00?\x00\x00\x01", b)), "start code")
    kinds = []
    for m in re.finditer(rb"\x00\x00\x01(.?)", b, re.S):
        need(bool(m[1]), "empty unit")
        need(m[1][0] < 0x80 and 0 < m[1][0] & 31 < 24, "unit type")
        kinds.append(m[1][0] & 31)
    need(len(kinds) >= 3 and {7, 8} <= set(kinds) and bool({1, 5} & set(kinds)), "parameter sets or slices")


def psd(b: bytes) -> None:
    need(b[:12] == b"8BPS\0\1" + bytes(6), "header")
    channels, height, width, depth, mode = num(b, ">HIIHH", 12)
    need(1 <= channels <= 56 and width > 0 and height > 0 and depth in (1, 8, 16, 32) and mode <= 9, "fields")
    at = 26
    for _ in range(3):
        at += 4 + num(b, ">I", at)
    need(num(b, ">H", at) <= 3, "compression")


def tga(b: bytes) -> None:
    need(len(b) >= 36 and b.endswith(b"TRUEVISION-XFILE.\0"), "footer")
    width, height, depth = num(b, "<HHB", 12)
    need(b[2] in (0, 1, 2, 3, 9, 10, 11) and width > 0 and height > 0 and depth in (8, 15, 16, 24, 32), "fields")


# ---- text

#: Characters that show structure (fixed values), and classes as regular expressions of Java and RE2.
STRUCTURAL = "{}[]();=,.@/*+-_<>\"'\\:#$%&|!?"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"
IMPLAUSIBLE = r"[\x{e000}-\x{f8ff}\x{fffe}\x{ffff}]"
SIGNAL = r"[0-9A-Za-z \t\n\r]"
SYNTAX = "[" + "".join("\\" + c for c in STRUCTURAL if c != "_") + "_]"
SPACE = r"[ \t\n\r]"


def _text_signal(total, ascii_pct, structural, structure_pct, lines):
    """The rule on counts, for columns; percentages are whole numbers."""
    short = (ascii_pct >= 20) | (structural >= 2)
    long = (ascii_pct >= 8) | (structure_pct >= 6) | (lines & (ascii_pct >= 5))
    return ((total < 32) & short) | ((total >= 32) & long)


def text_reason(text: Column) -> Column:
    """null for plausible text, else why not; null text is `too short`. All in the JVM."""

    def count(kind: str) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, F.lit(kind), F.lit("")))

    total = F.length(text)
    lines = text.contains("\n") | text.contains("\r")
    pct = lambda n: F.floor(n * 100 / F.greatest(total, F.lit(1)))
    structural = count(SYNTAX)
    strange = (count(CONTROL) > 0) | text.contains("\ufffd") | ((total - count(IMPLAUSIBLE)) * 100 < total * 98)
    return (
        F.when(text.isNull() | (total < 4), "too short")
        .when(strange, "strange characters")
        .when(~_text_signal(total, pct(count(SIGNAL)), structural, pct(structural + count(SPACE)), lines), "no structure")
    )


def _python_class(kind: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", kind))


_CLASSES = {k: _python_class(v) for k, v in (("control", CONTROL), ("odd", IMPLAUSIBLE), ("signal", SIGNAL), ("syntax", SYNTAX), ("space", SPACE))}


def _count(kind: re.Pattern, s: str) -> int:
    """Characters of a class, piece by piece: a long text is not listed whole."""
    return sum(len(kind.findall(s, start, start + PIECE)) for start in range(0, len(s), PIECE))


def text(encoding: str, mark: bytes, b: bytes) -> None:
    """Bytes in an encoding, after its mark if that is there."""
    body = b[len(mark) :] if mark and b.startswith(mark) else b
    need(len(body) > 0 and (not encoding.startswith("utf-16") or len(body) >= 4), "too short")
    try:
        s = body.decode(encoding)
    except UnicodeDecodeError:
        raise Bad("encoding") from None
    n, total = {k: _count(p, s) for k, p in _CLASSES.items()}, len(s)
    need(total >= 4, "too short")
    need(not n["control"] and "\ufffd" not in s and (total - n["odd"]) * 100 >= total * 98, "strange characters")
    pct = lambda k: k * 100 // total
    need(bool(_text_signal(total, pct(n["signal"]), n["syntax"], pct(n["syntax"] + n["space"]), "\n" in s or "\r" in s)), "no structure")


#: Format: check, and its strength where it holds (fixed values).
CHECKS: dict[str, tuple[Callable[[bytes], None], int]] = {
    "png": (png, 100),
    "wave": (partial(riff, b"WAVE"), 95),
    "avi": (partial(riff, b"AVI "), 95),
    "webp": (partial(riff, b"WEBP"), 95),
    "gif": (gif, 98),
    "ogg": (ogg, 100),
    "bmp": (bmp, 85),
    "zip": (zip_, 90),
    "7z": (seven_zip, 95),
    "gzip": (gzip_, 100),
    "woff": (woff, 95),
    "woff2": (woff2, 75),
    "flac": (flac, 95),
    "iso_bmff": (iso_bmff, 95),
    "midi": (midi, 95),
    "dds": (dds, 90),
    "ico": (partial(icon, 1), 95),
    "cur": (partial(icon, 2), 95),
    "ebml": (ebml, 70),
    "id3": (id3, 70),
    "pe": (pe, 95),
    "asf": (asf, 95),
    "mpeg_ps": (mpeg_ps, 75),
    "mpeg1_video": (mpeg1_video, 90),
    "h264": (h264, 90),
    "psd": (psd, 90),
    "tga": (tga, 90),
    "utf8_text": (partial(text, "utf-8", b"\xef\xbb\xbf"), 95),
    "utf16le_text": (partial(text, "utf-16-le", b"\xff\xfe"), 95),
    "utf16be_text": (partial(text, "utf-16-be", b"\xfe\xff"), 95),
    "cp932_text": (partial(text, "cp932", b""), 95),
}


def verdict(name: str, data: bytes) -> tuple[bool, int, str]:
    """valid, strength and reason; a name that is not known is not valid."""
    from . import formats_more  # noqa: F401  (adds its checks, in workers too)

    if name not in CHECKS:
        return False, 0, "unknown format"
    check, strength = CHECKS[name]
    try:
        check(data)
    except Bad as e:
        return False, 0, str(e)
    return True, strength, "ok"


def validated(df: DataFrame, id_col: str, name: Column, data: Column) -> DataFrame:
    """id, format, valid, strength, reason and strong for each row; null bytes are empty."""

    schema = pa.schema([("id", pa.int64()), ("format", pa.string()), ("valid", pa.bool_()), ("strength", pa.int32()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One value at a time is copied out of the batch.
            found = [verdict(n.as_py(), b.as_py()) for n, b in zip(batch.column("format"), batch.column("data"))]
            columns = zip(*found) if found else ((), (), ())
            made = [pa.array(c, schema.field(k + 2).type) for k, c in enumerate(columns)]
            made = [copied(batch, "id"), copied(batch, "format"), *made]
            del batch
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(name, F.lit("")).alias("format"), F.coalesce(data, F.lit(b"")).alias("data"))
    out = rows.mapInArrow(run, "id long, format string, valid boolean, strength int, reason string")
    return out.withColumn("strong", F.col("valid") & (F.col("strength") >= STRONG))
