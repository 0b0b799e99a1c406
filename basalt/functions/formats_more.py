"""More format checks: images in markers, audio in Ogg pages, fonts, engine texts, scripts and images.

Formats read field by field share a Cursor, which raises Bad at the end of the bytes. Importing this
module adds its checks to formats.CHECKS.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import partial

from . import formats
from .formats import Bad, need, num

# Signatures, and limits on counts and sizes.
TLG_WRAPPED, TLG5, TLG6 = b"TLG0.0\0sds\x1a", b"TLG5.0\0raw\x1a", b"TLG6.0\0raw\x1a"
FONT = b"TVP pre-rendered font\x1a"
MAX_SIDE, MAX_TABLES, MAX_FONTS, MAX_PACKED, MAX_TEXT = 1_000_000, 4096, 1024, 10_000_000, 1 << 30


class Cursor:
    """Reads little-endian fields one behind the other, up to `end`."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int, why: str = "truncated") -> bytes:
        need(0 <= n <= self.end - self.at, why)
        self.at += n
        return self.data[self.at - n : self.at]

    def whole(self, n: int = 4) -> int:
        return int.from_bytes(self.take(n), "little")

    def aligned(self, n: int) -> None:
        self.take(-self.at % n)


# --- JPEG

_MARKER = re.compile(rb"\xff+[^\xff\x00\xd0-\xd7]", re.S)
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def jpeg(b: bytes) -> None:
    need(len(b) >= 4 and b[:2] == b"\xff\xd8", "start marker")
    c, frame, scan, coded = Cursor(b, 2), False, False, False
    while c.at < len(b):
        if coded:  # entropy-coded bytes last until a marker that is neither stuffing nor a restart
            found = _MARKER.search(b, c.at)
            need(found is not None, "no end marker")
            c.at, coded = found.start(), False
        need(c.take(1) == b"\xff", "marker prefix")
        code = 0xFF
        while code == 0xFF:
            code = c.whole(1)
        if code == 0xD9:
            need(frame and scan, "ends before frame and scan")
            need(not b[c.at :].strip(b"\0"), "bytes after the end")
            return
        need(code != 0xD8, "second start")
        if code == 0x01 or 0xD0 <= code <= 0xD7:
            continue
        size = int.from_bytes(c.take(2), "big")
        need(size >= 2, "segment size")
        body = c.take(size - 2, "a segment is outside the file")
        if code in FRAMES:
            need(size >= 11, "frame too short")
            _, height, width, n = struct.unpack_from(">BHHB", body)
            need(bool(width and height and n) and size == 8 + 3 * n, "frame")
            frame = True
        elif code == 0xDA:
            need(size >= 6 and body[0] > 0 and size == 6 + 2 * body[0], "scan")
            scan = coded = True
    raise Bad("no end marker")


def jpeg_xr(b: bytes) -> None:
    need(len(b) >= 8 and b[:4] == b"II\xbc\x01", "signature")


# --- Ogg with a known codec


def _pages(b: bytes) -> list[tuple[int, int, int, int, bytes, bytes]]:
    """Kind, position, serial number, sequence, lacing and body of each page, once formats.ogg() has passed them."""
    formats.ogg(b)
    at, out = 0, []
    while at < len(b):
        kind, granule, serial, sequence, _, n = struct.unpack_from("<BqIIIB", b, at + 5)
        lacing = b[at + 27 : at + 27 + n]
        body = b[at + 27 + n : at + 27 + n + sum(lacing)]
        out.append((kind, granule, serial, sequence, lacing, body))
        at += 27 + n + len(body)
    kind, granule, _, sequence, _, _ = out[0]
    need(kind & 2 and not sequence and not granule, "first page")
    return out


def vorbis(b: bytes) -> None:
    body = _pages(b)[0][5]
    need(len(body) >= 30 and body.startswith(b"\x01vorbis"), "identification packet")
    version, channels, rate = struct.unpack_from("<IBI", body, 7)
    need(not version and channels > 0 and rate > 0, "identification fields")
    need(body[29] & 1 == 1, "framing flag")


def opus(b: bytes) -> None:
    pages = _pages(b)
    _, _, serial, _, lacing, body = pages[0]
    need(len(lacing) > 0 and lacing[-1] < 255, "head does not end on its page")
    need(all(x == 255 for x in lacing[:-1]), "several packets on the first page")
    need(len(body) >= 19 and body.startswith(b"OpusHead"), "head packet")
    version, channels, mapping = body[8], body[9], body[18]
    need(0 < version < 16 and channels > 0, "version or channels")
    need((len(body) == 19 and channels <= 2) if mapping == 0 else len(body) >= 21 + channels, "channel mapping")
    need(len(pages) > 1 and pages[1][5].startswith(b"OpusTags"), "tags packet")
    need(pages[1][2] == serial, "serial numbers differ")


# --- fonts


def _font(b: bytes, base: int, signatures: tuple[bytes, ...]) -> None:
    need(b[base : base + 4] in signatures and len(b) >= base + 12, "font signature")
    count = num(b, ">H", base + 4)
    need(0 < count <= MAX_TABLES, "table count")
    tables = {}
    for k in range(count):
        tag, _, offset, size = num(b, ">4sIII", base + 12 + 16 * k)
        need(base <= offset and offset + size <= len(b), "a table is outside the file")
        tables[tag] = (offset, size)
    need({b"head", b"cmap", b"maxp"} <= tables.keys(), "required tables")
    offset, size = tables[b"head"]
    need(size >= 16 and num(b, ">I", offset + 12) == 0x5F0F3CF5, "head table")


def sfnt(signature: bytes, b: bytes) -> None:
    _font(b, 0, (signature,))


def ttc(b: bytes) -> None:
    need(b[:4] == b"ttcf", "signature")
    count = num(b, ">I", 8)
    need(0 < count <= MAX_FONTS, "font count")
    for at in struct.unpack(f">{count}I", Cursor(b, 12).take(4 * count)):
        _font(b, at, (b"\0\x01\0\0", b"OTTO"))


def bitmap_font(versions: tuple[int, ...], b: bytes) -> None:
    need(len(b) >= 36 and b.startswith(FONT), "signature")
    version, wide, count, characters, glyphs = num(b, "<BBIII", 22)
    need(version in versions and wide == 2, "version")
    need(count > 0, "no characters")
    need(min(characters, glyphs) >= 36 and characters + 2 * count <= len(b) and glyphs + 20 * count <= len(b), "an index is outside the file")
    codes = struct.unpack_from(f"<{count}H", b, characters)
    need(all(x < y for x, y in zip(codes, codes[1:])), "characters out of order")
    for offset, width, height in struct.iter_unpack("<IHH12x", b[glyphs : glyphs + 20 * count]):
        need(not (width and height) or 36 <= offset < len(b), "a glyph is outside the file")


# --- texts in a wrapper

_SWAPPED = bytes((i & 0xAA) >> 1 | (i & 0x55) << 1 for i in range(256))


def unwrapped(b: bytes) -> tuple[int, bytes]:
    """The mode of a wrapped text, and the text as UTF-16LE with its mark. Modes: 0 masks the high byte of
    units from 32 on and turns their last bit, 1 swaps neighbouring bits, 2 is zlib behind two sizes.
    """
    need(len(b) >= 5 and b[:2] == b"\xfe\xfe" and b[3:5] == b"\xff\xfe" and b[2] <= 2, "header")
    mode, body = b[2], b[5:]
    if mode == 2:
        c = Cursor(b, 5)
        stored, size = c.whole(8), c.whole(8)
        need(size <= MAX_TEXT and 21 + stored == len(b), "sizes")
        inflate = zlib.decompressobj()
        try:
            body = inflate.decompress(b[21:], size + 1)
        except zlib.error:
            raise Bad("compressed text") from None
        need(inflate.eof and len(body) == size, "size of the text")
        return mode, body if body.startswith(b"\xff\xfe") else b"\xff\xfe" + body
    need(len(body) % 2 == 0, "odd size")
    if mode == 1:
        return mode, b"\xff\xfe" + body.translate(_SWAPPED)
    units = struct.unpack(f"<{len(body) // 2}H", body)
    return mode, b"\xff\xfe" + struct.pack(f"<{len(units)}H", *(u ^ (u & 0xFE) << 8 ^ 1 if u >= 32 else u for u in units))


def wrapped(text: bytes, mode: int) -> bytes:
    """UTF-16LE with its mark in a wrapper. Mode 0 has no code for some units; those raise Bad."""
    need(text[:2] == b"\xff\xfe" and len(text) % 2 == 0 and mode in (0, 1, 2), "UTF-16LE with its mark, and a mode")
    head, body = bytes([0xFE, 0xFE, mode, 0xFF, 0xFE]), text[2:]
    if mode == 2:
        packed = zlib.compress(body)
        return head + struct.pack("<QQ", len(packed), len(body)) + packed
    if mode == 1:
        return head + body.translate(_SWAPPED)
    units = struct.unpack(f"<{len(body) // 2}H", body)
    # The mask depends on the low byte but its last bit, which decoding leaves as it is.
    coded = [u ^ (u & 0xFE) << 8 ^ 1 if u >= 32 else u for u in units]
    need(all(u < 32 or c >= 32 for u, c in zip(units, coded)), "a character without a code")
    return head + struct.pack(f"<{len(coded)}H", *coded)


def wrapped_text(mode: int, b: bytes) -> None:
    found, text = unwrapped(b)
    need(found == mode, "mode")
    formats.text("utf-16-le", b"\xff\xfe", text)


# --- engine images


def _raw_part(b: bytes, wrapper: bool) -> Cursor:
    if not wrapper:
        return Cursor(b)
    need(len(b) >= 15 and b.startswith(TLG_WRAPPED), "wrapper")
    size = num(b, "<I", 11)
    need(0 < size <= len(b) - 15, "size of the wrapped image")
    return Cursor(b, 15, 15 + size)


def image_header(b: bytes) -> tuple[int, int, int, int]:
    """Version (5 or 6), channels, width and height, from the first bytes alone; a wrapper is looked through."""
    at = 15 if b.startswith(TLG_WRAPPED) else 0
    need(b[at : at + 11] in (TLG5, TLG6), "signature")
    if b[at : at + 11] == TLG5:
        return (5, *num(b, "<BII", at + 11))
    return (6, *num(b, "<B3xII", at + 11))


def image_tags(b: bytes) -> dict[str, str]:
    """The tags behind a wrapped image: len:name=len:value, and so on. A later tag replaces an earlier one."""
    c, out = _raw_part(b, True), {}
    at = c.end
    while at + 8 <= len(b):
        name, size = num(b, "<4sI", at)
        body, at = b[at + 8 : at + 8 + size], at + 8 + size
        need(at <= len(b), "a part is outside the file")
        if name != b"tags":
            continue
        k = 0
        while k < len(body):
            pair = []
            for end in (b"=", b","):
                colon = body.find(b":", k)
                need(colon > k and body[k:colon].isdigit(), "tag size")
                stop = colon + 1 + int(body[k:colon])
                need(body[stop : stop + 1] == end, "tag end")
                pair.append(body[colon + 1 : stop].decode("utf-8", "replace"))
                k = stop + 1
            out[pair[0]] = pair[1]
    return out


def _sides(width: int, height: int, third: int) -> None:
    need(0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE and third > 0, "dimensions")


def tlg5(wrapper: bool, b: bytes) -> None:
    c = _raw_part(b, wrapper)
    need(c.take(11) == TLG5, "signature")
    channels = c.whole(1)
    need(channels in (3, 4), "channels")
    width, height, rows = c.whole(), c.whole(), c.whole()
    _sides(width, height, rows)
    for size in struct.unpack("<%dI" % (k := (height - 1) // rows + 1), c.take(4 * k)):
        begin = c.at
        for _ in range(channels):
            need(c.whole(1) <= 1, "method")
            c.take(c.whole(), "a channel is outside the file")
        need(c.at - begin == size, "block size")
    need(c.at == c.end, "size")


def tlg6(wrapper: bool, b: bytes) -> None:
    c = _raw_part(b, wrapper)
    need(c.take(11) == TLG6, "signature")
    channels = c.whole(1)
    need(channels in (1, 3, 4) and c.take(3) == b"\0\0\0", "channels or flags")
    width, height, most = c.whole(), c.whole(), c.whole()
    _sides(width, height, most)
    c.take(c.whole(), "filter types are outside the file")
    for row in range(0, height, 8):
        pixels = min(8, height - row) * width
        for _ in range(channels):
            bits = c.whole()
            need(bits >> 30 == 0 and bits <= min(most, 64 * pixels), "bit length")
            c.take((bits + 7) // 8, "a block is outside the file")
    need(c.at == c.end, "size")


# --- packed structures and compiled scripts


def _packed_numbers(c: Cursor) -> list[int]:
    """A count and numbers, each of as many bytes as the tag before it says."""
    width = c.whole(1) - 12
    need(1 <= width <= 8, "width of a count")
    count = c.whole(width)
    width = c.whole(1) - 12
    need(1 <= width <= 8 and count <= MAX_PACKED, "width or count of numbers")
    data = c.take(count * width)
    return [int.from_bytes(data[k : k + width], "little") for k in range(0, len(data), width)]


def packed_shell(signature: bytes, b: bytes) -> None:
    need(b.startswith(signature), "signature")


def packed_structure(b: bytes) -> None:
    need(len(b) >= 40 and b[:4] == b"PSB\0", "header")
    version = num(b, "<H", 4)
    need(1 <= version <= 4, "version")
    head = 44 if version >= 3 else 40
    sections = num(b, "<8I", 8)
    need(all(head <= x < len(b) for x in sections), "a section is outside the file")
    ciphered, names, strings, text, offsets, sizes, data, root = sections
    need(ciphered == names, "encryption and names differ")
    need(version < 3 or (extra := num(b, "<I", 40)) == 0 or head <= extra < len(b), "extra section")
    c = Cursor(b, names)
    for _ in range(3):
        _packed_numbers(c)
    need(c.at <= strings, "names overlap strings")
    c = Cursor(b, strings)
    starts = _packed_numbers(c)
    need(c.at <= text, "string offsets overlap strings")
    room = min([x for x in (offsets, sizes, data, root) if x >= text], default=len(b)) - text
    need(all(x <= room for x in starts), "a string is outside its section")
    at, length = _packed_numbers(Cursor(b, offsets)), _packed_numbers(Cursor(b, sizes))
    need(len(at) == len(length) and all(x + n <= len(b) - data for x, n in zip(at, length)), "a resource is outside its section")
    need(b[root] in (0x20, 0x21), "root")


def script_pools(b: bytes) -> None:
    """The constants of a compiled script: bytes, shorts, ints, longs, doubles, strings, octets."""
    c = Cursor(b)
    c.take(c.whole())
    c.aligned(4)
    n = c.whole()
    c.take(2 * n + 2 * (n & 1))
    for width in (4, 8, 8):
        c.take(width * c.whole())
    count = c.whole()
    need(count <= len(b) // 4, "string count")
    for _ in range(count):
        n = c.whole()
        try:
            c.take(2 * n).decode("utf-16-le")
        except UnicodeDecodeError:
            raise Bad("a string is no UTF-16") from None
        c.take(2 * (n & 1))
    count = c.whole()
    need(count <= len(b) // 4, "octet count")
    for _ in range(count):
        c.take(c.whole())
        c.aligned(4)
    need(c.at == len(b), "bytes after the pools")


def compiled_script(b: bytes) -> None:
    need(len(b) >= 28 and b[:8] == b"TJS2100\0", "header")
    size, tag, data = num(b, "<I4sI", 8)
    need(size == len(b) and tag == b"DATA" and data >= 8, "size or data tag")
    c = Cursor(b, 20)
    script_pools(c.take(data - 8, "data outside the file"))
    need(c.take(4) == b"OBJS", "objects tag")
    need((objects := c.whole()) >= 16 and 12 + data + objects == len(b), "objects size")
    top, count = num(b, "<ii", c.at)
    need(count > 0 or (count == 0 and c.at + 8 == len(b)), "object count")
    need(count == 0 or (len(b) - c.at >= 16 and b[c.at + 8 : c.at + 12] == b"TJS2" and -1 <= top < count), "first object")


# Strengths of the checks where they hold.
formats.CHECKS.update(
    {
        "jpeg": (jpeg, 98),
        "jpeg_xr": (jpeg_xr, 70),
        "vorbis": (vorbis, 100),
        "opus": (opus, 100),
        "truetype": (partial(sfnt, b"\0\x01\0\0"), 98),
        "opentype": (partial(sfnt, b"OTTO"), 98),
        "ttc": (ttc, 98),
        "bitmap_font0": (partial(bitmap_font, (0,)), 100),
        "bitmap_font1": (partial(bitmap_font, (1,)), 100),
        "wrapped_text0": (partial(wrapped_text, 0), 98),
        "wrapped_text1": (partial(wrapped_text, 1), 98),
        "wrapped_text2": (partial(wrapped_text, 2), 100),
        "tlg5": (partial(tlg5, False), 95),
        "tlg6": (partial(tlg6, False), 95),
        "tlg5_wrapped": (partial(tlg5, True), 95),
        "tlg6_wrapped": (partial(tlg6, True), 95),
        "psz_shell": (partial(packed_shell, b"PSZ"), 65),
        "mdf_shell": (partial(packed_shell, b"mdf"), 65),
        "mfl_shell": (partial(packed_shell, b"mfl"), 65),
        "psb": (packed_structure, 98),
        "compiled_script": (compiled_script, 100),
    }
)
# The check of each hypothesis, in the order of the hypotheses.
OF_HYPOTHESIS = dict(
    line.rsplit(" ", 1)
    for line in """PNG png
JPEG jpeg
JPEG-XR/WMP jpeg_xr
Ogg ogg
Ogg/Opus opus
Ogg/Opus-family0 opus
Ogg/Opus-family0-smalltags opus
Ogg/Vorbis vorbis
WAVE/RIFF wave
AVI/RIFF avi
WebP/RIFF webp
GIF87a gif
GIF89a gif
BMP bmp
ZIP/local zip
ZIP/empty zip
7-Zip 7z
gzip gzip
Text/UTF-16LE-BOM utf16le_text
Text/UTF-16LE utf16le_text
Text/UTF-16BE-BOM utf16be_text
Text/UTF-16BE utf16be_text
Text/UTF-8-BOM utf8_text
Text/UTF-8 utf8_text
Text/CP932 cp932_text
Kirikiri/Text-mode0 wrapped_text0
Kirikiri/Text-mode1 wrapped_text1
Kirikiri/Text-mode2 wrapped_text2
TJS2/Bytecode compiled_script
PSB/M2-Emote psb
PSZ/PSB-shell psz_shell
MDF/PSB-shell mdf_shell
MFL/PSB-shell mfl_shell
TrueType/sfnt truetype
OpenType/CFF opentype
TrueType/Collection ttc
WOFF woff
WOFF2 woff2
Kirikiri/PrerenderedFont-v0 bitmap_font0
Kirikiri/PrerenderedFont-v1 bitmap_font1
FLAC flac
MP4/ISO-BMFF iso_bmff
MIDI midi
DDS dds
ICO ico
CUR cur
WebM/Matroska ebml
MP3/ID3 id3
PE/COFF pe
ASF/WMV-WMA asf
MPEG-PS mpeg_ps
MPEG-1/Video mpeg1_video
H264/AnnexB-4 h264
H264/AnnexB-3 h264
Photoshop/PSD psd
TGA tga
TLG5 tlg5
TLG5-rgb-block4 tlg5
TLG5-rgba-block4 tlg5
TLG6-gray tlg6
TLG6-rgb tlg6
TLG6-rgba tlg6
TLG0/TLG5 tlg5_wrapped
TLG0/TLG6-gray tlg6_wrapped
TLG0/TLG6-rgb tlg6_wrapped
TLG0/TLG6-rgba tlg6_wrapped""".splitlines()
)
