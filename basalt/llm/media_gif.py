"""GIF media columns: LZW streams, palettes, disposal, transparency, timed frames, histograms.

composed() decodes any GIF87a or GIF89a into its screens with their times. media_of() keeps texts
in GIFs without loss: each screen holds 576 bytes, and its frame only what differs from the screen
before. features_of() reads them back by way of the screens, with a colour histogram of each.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

SIDE = 24
UNIT = SIDE * SIDE
DELAY = 4  # hundredths of a second
EDGES = 8  # histogram bins of a colour channel
#: Pixels of a screen beyond which a file is refused.
MAX_PIXELS = 1 << 24
#: Stands for an unchanged pixel where a frame does not hold it; UTF-8 never does.
SAME = 0xFE


@dataclass
class Frame:
    """One image of a GIF as stored: its place, indices and how it is shown."""

    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray  # (n, 3)
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None
    pixels: np.ndarray | None = None  # (height, width) palette indices, once decoded


# --- LZW


def _unpack(padded: np.ndarray, at: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Codes of the given bit widths, least significant bit first, at the given bits; padded: bytes and four more."""
    byte = at >> 3
    word = padded[byte] | (padded[byte + 1] << 8) | (padded[byte + 2] << 16)
    return (word >> (at & 7)) & ((1 << widths) - 1)


def _expand(codes: list[int], clear: int) -> bytes:
    """The bytes of the codes between two clear codes. Every code but the first adds an entry: the string
    of the code before and the first byte of its own.
    """
    if not codes:
        return b""
    entries = SINGLES[:clear] + [None, None]
    try:
        last = entries[codes[0]]
        out, add = [last], entries.append
        put = out.append
        for code in codes[1 : 4097 - clear - 2]:
            try:
                entry = entries[code]
            except IndexError:
                if code != len(entries):
                    raise
                entry = last + last[:1]
            add(last + entry[:1])
            put(entry)
            last = entry
        out += [entries[code] for code in codes[4097 - clear - 2 :]]  # a full table stays as it is
        return b"".join(out)
    except (IndexError, TypeError):
        raise ValueError("LZW code without an entry") from None


def _schedule(least: int) -> np.ndarray:
    """Widths of the codes after a clear code: an entry is added by every code but the first."""
    clear = 1 << least
    known = clear + 2 + np.maximum(np.arange(0, 4098 - clear) - 1, 0)
    return np.maximum(np.ceil(np.log2(known + 1)).astype(np.int64), least + 1).clip(max=12)


SCHEDULES = {least: _schedule(least) for least in range(1, 12)}
ENDS = {least: np.cumsum(widths) for least, widths in SCHEDULES.items()}
#: Widths and ends of the codes of a stream that begins with a clear code.
LEADS = {least: (w := np.concatenate([[least + 1], widths]), np.cumsum(w)) for least, widths in SCHEDULES.items()}
SINGLES = [bytes([i]) for i in range(256)] + [b""] * (1 << 11)


def lzw_decode(data: bytes, least: int, most: float = math.inf) -> bytes:
    """The indices of an LZW stream with minimum code size `least`; reading ends once `most` are there."""
    if least not in SCHEDULES:
        raise ValueError("an LZW code size out of range")
    clear, out, bit, bits, done = 1 << least, [], 0, 8 * len(data), 0
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    while bit + least + 1 <= bits and done < most:
        widths, ends = SCHEDULES[least], ENDS[least]
        while True:
            fit = int(np.searchsorted(ends, bits - bit, "right"))
            codes = _unpack(padded, bit + ends[:fit] - widths[:fit], widths[:fit])
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stops) or fit < len(widths):
                break
            widths = np.concatenate([widths, np.full(4096, 12)])
            ends = np.cumsum(widths)
        n = int(stops[0]) if len(stops) else len(codes)
        out.append(_expand(codes[:n].tolist(), clear))
        done += len(out[-1])
        if not len(stops) or codes[n] == clear + 1:
            break
        bit += int(ends[n])
    return b"".join(out)


def lzw_decoded(streams: list[bytes], least: int, most: list[int]) -> Iterator[bytes]:
    """The indices of each stream, as by lzw_decode(); none of one that is damaged.

    Streams of one run, from a clear code to the end code, are unpacked together.
    """
    if least not in LEADS:
        yield from (b"" for _ in streams)
        return
    clear, (widths, ends) = 1 << least, LEADS[least]
    sizes = np.array([len(x) for x in streams])
    fit = np.searchsorted(ends, 8 * sizes, "right")
    step = np.arange(int(fit.sum())) - np.repeat(np.cumsum(fit) - fit, fit)
    at = np.repeat(8 * (np.cumsum(sizes) - sizes), fit) + (ends - widths)[step]
    padded = np.frombuffer(b"".join([*streams, b"\0\0\0\0"]), np.uint8).astype(np.int64)
    codes = _unpack(padded, at, widths[step])
    whole = _expanded(codes, fit, clear)
    for k, (stream, n) in enumerate(zip(streams, most)):
        try:
            yield whole[k] if whole else lzw_decode(stream, least, n)
        except ValueError:
            yield b""


def _expanded(codes: np.ndarray, sizes: np.ndarray, clear: int) -> list[bytes] | None:
    """The bytes of streams whose codes stand behind each other, if each is one run; else None.

    Code k of a run, after the first, adds the entry: string of code k and the first byte of code
    k+1; that is a stretch of the output itself. So each output byte is a literal code's or equals
    an earlier one, and following those references halves their depth each time.
    """
    if not len(sizes) or not sizes.all():
        return None
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(codes))
    end = np.minimum.reduceat(np.where(codes == clear + 1, place, len(codes)), begin)
    if (end >= begin + sizes).any() or (codes[begin] != clear).any() or (end == begin + 1).any():
        return None
    run = np.repeat(end, sizes) > place
    run[begin] = False
    own, lengths = codes[run], end - begin - 1
    start, n = np.cumsum(lengths) - lengths, int(lengths.sum())
    from_ = np.repeat(start, lengths) + own - (clear + 2)
    further = own >= clear
    if ((own[further] < clear + 2) | (from_[further] >= np.flatnonzero(further))).any():
        return None
    at, source = np.flatnonzero(further), from_[further]
    size = np.ones(n, np.int64)
    while True:  # a string is one longer than the one it goes on from
        longer = size[source] + 1
        if (longer == size[at]).all():
            break
        size[at] = longer
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(n), size)
    reference = np.arange(len(owner))
    copied = further[owner]
    reference[copied] += (first[np.where(further, from_, 0)] - first)[owner[copied]]
    while True:
        next_ = reference[reference]
        if (next_ == reference).all():
            break
        reference = next_
    whole = own[owner[reference]].astype(np.uint8).tobytes()
    ends = np.append(first, len(owner))[start + lengths].tolist()
    return [whole[x:y] for x, y in zip([0, *ends], ends)]


def _add_codes(data: bytes, least: int, codes: array, runs: list[int]) -> None:
    """Adds the codes of a stream, times 256, and how many follow each other without a clear code before them."""
    clear = 1 << least
    first, full, room = clear + 2 << 8, 4096 << 8, 4096 - clear - 2  # numbers are kept times 256 too
    start = len(codes) + 1
    codes.append(clear << 8)
    runs.append(1)
    prefix, rest, number, table = data[0] << 8 if data else 0, data[1:], first, {}
    entry, append = table.setdefault, codes.append
    for begin in range(0, len(rest), room):
        some = rest[begin : begin + room]
        if number + (len(some) << 8) <= full:  # no step can meet a full table
            for byte in some:
                code = entry(prefix | byte, number)
                if code == number:
                    append(prefix)
                    prefix = byte << 8
                    number += 256
                else:
                    prefix = code
            continue
        for byte in some:
            code = table.get(prefix | byte)
            if code is not None:
                prefix = code
                continue
            append(prefix)
            if number < full:
                table[prefix | byte] = number
                number += 256
            else:
                append(clear << 8)
                runs.append(len(codes) - start)
                start, number = len(codes), first
                table.clear()
            prefix = byte << 8
    if data:
        append(prefix)
    append(clear + 1 << 8)
    runs.append(len(codes) - start)


def lzw_streams(parts: list[bytes], least: int = 8) -> list[bytes]:
    """A compressed LZW stream of each part, with a clear code whenever the table is full."""
    codes, runs, ends = array("q"), [], []
    for part in parts:
        _add_codes(part, least, codes, runs)
        ends.append(len(codes))
    steps = np.array(runs)
    width = SCHEDULES[least][np.arange(len(codes)) - np.repeat(np.cumsum(steps) - steps, steps)]
    sizes = np.diff([0, *ends])
    bits = np.add.reduceat(width, np.array(ends) - sizes)
    size = (bits + 7) >> 3
    begin = np.cumsum(size) - size
    # Each stream begins at a byte of its own.
    at = np.cumsum(width) - width + np.repeat(8 * begin - (np.cumsum(bits) - bits), sizes)
    spread = np.frombuffer(codes, np.int64) >> 8 << (at & 7)
    whole = sum(np.bincount((at >> 3) + k, spread >> (8 * k) & 255, int(size.sum()) + 2) for k in range(3))  # bits never meet
    packed = whole.astype(np.uint8).tobytes()
    return [packed[b : b + n] for b, n in zip(begin.tolist(), size.tolist())]


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    return lzw_streams([data], least)[0]


# --- files


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := data[at]) != 0:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def parse_gif(data: bytes) -> tuple[int, int, list[tuple[Frame, bytes, int]]]:
    """Width, height and, for each image, a frame without pixels, its LZW data and code size."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > MAX_PIXELS:
        raise ValueError("too large a screen")
    shared, at = _palette(data, 13, flags)
    frames, delay, disposal, transparent = [], 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, end = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                delay = body[1] | body[2] << 8
                disposal, transparent = body[0] >> 2 & 7, body[3] if body[0] & 1 else None
            at = end
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            if w * h > MAX_PIXELS:
                raise ValueError("too large an image")
            own, at = _palette(data, at + 10, flags)
            palette = own if own is not None else shared
            if palette is None:
                raise ValueError("an image without a palette")
            least = data[at]
            body, at = _blocks(data, at + 1)
            frames.append((Frame(left, top, w, h, palette, delay, disposal, transparent), body, least | (flags & 0x40) << 2))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("an unknown block")
    return width, height, frames


def _pixels(parsed: Iterable[tuple[Frame, bytes, int]]) -> Iterator[bytes]:
    """The indices of each image, decoded some images of one code size at a time."""
    for least, some in groupby(parsed, lambda image: image[2] & 255):
        while part := list(islice(some, 256)):
            yield from lzw_decoded([body for _, body, _ in part], least, [f.width * f.height for f, _, _ in part])


def levels_of(palette: np.ndarray) -> np.ndarray:
    """The bin of brightness (sum of channels, EDGES bins) of each colour."""
    return (palette.sum(axis=1, dtype=np.int64) * EDGES // 766).astype(np.uint8)


def rgba_of(palette: np.ndarray) -> np.ndarray:
    return np.column_stack([palette, np.full(len(palette), 255, np.uint8)])


def composed(gif: tuple, pixels: Iterable[bytes], colours=rgba_of, nothing: int = 0) -> Iterator[tuple[Frame, np.ndarray, np.ndarray, int]]:
    """For each image of a parsed GIF, whose decoded images follow each other in pixels: its frame, the screen as palette indices (0 where nothing has been
    drawn) and in colours, and when it is shown (1/100 s). The two arrays change with the next image.

    colours: what stands for each colour of a palette; `nothing` where nothing has been drawn.
    """
    width, height, parsed = gif
    shown, canvas, now, known, table = np.zeros((height, width), np.uint8), None, 0, None, None
    for (frame, _, packed), indices in zip(parsed, pixels):
        h, w = frame.height, frame.width
        raw = np.frombuffer(indices, np.uint8)
        if len(raw) < h * w:
            raise ValueError("an image without all its pixels")
        frame.pixels = raw[: h * w].reshape(h, w)
        if packed >> 8:  # interlaced: rows 0, 8.., 4, 12.., 2, 6.., 1, 3..
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            frame.pixels = frame.pixels[np.argsort(order)]
        if frame.palette is not known:  # an index beyond the palette shows its last colour
            known, table = frame.palette, colours(frame.palette)
            table = np.concatenate([table, np.repeat(table[-1:], 256 - len(table), axis=0)])
        if canvas is None:
            canvas = np.full((height, width, *table.shape[1:]), nothing, np.uint8)
        before = (shown.copy(), canvas.copy()) if frame.disposal == 3 else None
        at = np.s_[frame.top : frame.top + h, frame.left : frame.left + w]
        area, painted = shown[at], canvas[at]
        new = frame.pixels[: area.shape[0], : area.shape[1]]
        if frame.transparent is None:
            area[:], painted[:] = new, table[new]
        else:
            opaque = new != frame.transparent
            area[opaque], painted[opaque] = new[opaque], table[new[opaque]]
        yield frame, shown, canvas, now
        now += frame.delay
        if frame.disposal == 2:
            area[:], painted[:] = 0, nothing
        elif before:
            shown, canvas = before


def read_gif(data: bytes) -> tuple[list[Frame], list[np.ndarray], list[int]]:
    """The frames as stored, the composed RGBA screens, and when each is shown (1/100 s)."""
    gif = parse_gif(data)
    found = [(frame, canvas.copy(), now) for frame, _, canvas, now in composed(gif, _pixels(gif[2]))]
    return [f for f, *_ in found], [c for _, c, _ in found], [t for *_, t in found]


GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
HEADER = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + GREYS


def _chunked(body: bytes) -> bytes:
    return b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)) + b"\0"


def _images(screens: np.ndarray) -> list[tuple[bytes, bytes]]:
    """For each screen the control block and image head that follow from the screen before, and the pixels.

    The image covers what differs; unchanged pixels inside are transparent where they are half of
    it or more and SAME is free. The screen stays as it is (disposal 1).
    """
    differs = np.ones(screens.shape, bool)
    differs[1:] = screens[1:] != screens[:-1]
    places = []
    for lines in (differs.any(axis=2), differs.any(axis=1)):
        some = lines.any(axis=1)
        places += [np.where(some, lines.argmax(axis=1), 0).tolist(), np.where(some, SIDE - lines[:, ::-1].argmax(axis=1), 1).tolist()]
    counts, out = differs.sum(axis=(1, 2)).tolist(), []
    for k, (top, bottom, left, right) in enumerate(zip(*places)):
        height, width = bottom - top, right - left
        new, clear = screens[k, top:bottom, left:right], None
        if 2 * counts[k] <= height * width and not (new == SAME).any():
            new, clear = np.where(differs[k, top:bottom, left:right], new, np.uint8(SAME)), SAME
        control = struct.pack("<BHBB", 1 << 2 | (clear is not None), DELAY, clear or 0, 0)
        head = struct.pack("<HHHHB", left, top, width, height, 0)
        out.append((b"\x21\xf9\x04" + control + b"\x2c" + head + b"\x08", new.tobytes()))
    return out


def gifs_of(payloads: list[bytes]) -> list[bytes]:
    """Grey GIFs of 24 x 24 screens, each with 576 bytes of its payload, which is whole screens."""
    images = [_images(np.frombuffer(p, np.uint8).reshape(-1, SIDE, SIDE)) for p in payloads]
    streams = iter(lzw_streams([pixels for own in images for _, pixels in own]))
    return [b"".join([HEADER, *(head + _chunked(next(streams)) for head, _ in own), b"\x3b"]) for own in images]


def write_gif(payload: bytes) -> bytes:
    return gifs_of([payload])[0]


def media_of(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and gif: each whole text as UTF-8, padded with 255, as samples of a GIF.

    Null texts count as empty; the payload is a positive multiple of 576 bytes. Equal texts have
    equal files. Repeated rows and an empty table need no rule; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 64):
                raw = [text_bytes(t) for t in batch.column("text").to_pylist()]
                files = gifs_of([b + b"\xff" * (-len(b) % UNIT if b else UNIT) for b in raw])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(files, pa.binary())],
                    names=["id", "n_bytes", "gif"],
                )

    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, n_bytes long, gif binary"
    )


#: What a damaged file may raise.
UNREADABLE = (ValueError, IndexError, struct.error, TypeError, OverflowError, MemoryError)
#: Columns of the frames of a file: when and how long each is shown (1/100 s), its place, how it
#: leaves the screen, and its screen's histogram.
FRAME = ("shown_at", "delay", "left", "top", "width", "height", "disposal")
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string, n_frames int, duration int, histogram array<long>,"
    f" frames array<struct<{', '.join(f'{c}: int' for c in FRAME)}, histogram: array<int>>>, error string"
)


def described(data: bytes, gif: tuple, pixels: Iterable[bytes]) -> tuple[dict, np.ndarray]:
    """The features of one parsed file, and a row of FRAME and histogram numbers for each frame."""
    payload, rows = [], []
    for f, shown, levels, now in composed(gif, pixels, levels_of, EDGES):
        payload.append(shown.tobytes())
        bins = np.bincount(levels.ravel(), minlength=EDGES + 1)[:EDGES].tolist()
        rows.append([now, f.delay, f.left, f.top, f.width, f.height, f.disposal, *bins])
    if not rows:
        raise ValueError("no image")
    if rows[-1][0] + rows[-1][1] >= 1 << 31:
        raise ValueError("too long a time")
    table = np.array(rows, np.int64)
    bins, duration, whole = table[:, len(FRAME) :].sum(axis=0), int(table[:, 1].sum()), b"".join(payload)
    return {
        "payload_bytes": len(whole), "payload_sha256": hashlib.sha256(whole).hexdigest(), "tail_crc32": zlib.crc32(whole[-32:]),
        "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "n_frames": len(rows), "duration": duration,
        "histogram": bins.tolist(), "feature": f"frames={len(rows)};duration={duration};bins=" + ",".join(map(str, bins)),
    }, table


def _frame_lists(tables: list[np.ndarray | None]) -> pa.Array:
    """The frames column; a file without features has null."""
    sizes = [0 if t is None else len(t) for t in tables]
    flat = np.concatenate([np.zeros((0, len(FRAME) + EDGES), np.int64), *[t for t in tables if t is not None]]).astype(np.int32)
    bins = pa.ListArray.from_arrays(pa.array(np.arange(0, EDGES * len(flat) + 1, EDGES, dtype=np.int32)), pa.array(flat[:, len(FRAME) :].ravel()))
    rows = pa.StructArray.from_arrays([*[pa.array(flat[:, i]) for i in range(len(FRAME))], bins], names=[*FRAME, "histogram"])
    ends = np.cumsum([0, *sizes]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), rows, mask=pa.array([t is None for t in tables], pa.bool_()))


def features_of(media: DataFrame) -> DataFrame:
    """Reads GIFs (id, n_bytes, gif), such as those of media_of(): samples, digests, timed frames, histograms.

    payload: the palette indices that each composed screen shows, screen by screen. histogram:
    opaque pixels of the composed screens by brightness in EDGES bins, of each frame and together.
    feature: frames, duration in 1/100 s and the histogram. A file that cannot be decoded whole, a
    null one and one without an image have an error and null features. Repeated rows and an empty
    table need no rule; other columns are not read.
    """

    def parsed(data: bytes) -> tuple | Exception:
        try:
            return parse_gif(data)
        except UNREADABLE as e:
            return e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = [
            ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
            ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int32()), ("duration", pa.int32()), ("histogram", pa.list_(pa.int64())),
        ]
        for whole in batches:
            for batch in slices(whole, 64):
                rows, tables, files = [], [], batch.column("gif").to_pylist()
                gifs = [parsed(data) for data in files]
                pixels = _pixels(image for gif in gifs if isinstance(gif, tuple) for image in gif[2])
                for data, gif in zip(files, gifs):
                    own = list(islice(pixels, len(gif[2]))) if isinstance(gif, tuple) else []
                    try:
                        if isinstance(gif, Exception):
                            raise gif
                        row, table = described(data, gif, own)
                    except UNREADABLE as e:
                        row, table = {"error": str(e) or type(e).__name__}, None
                    rows.append(row)
                    tables.append(table)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("n_bytes"), *[pa.array([r.get(c) for r in rows], kind) for c, kind in plain],
                     _frame_lists(tables), pa.array([r.get("error") for r in rows], pa.string())],
                    names=["doc_id", "n_bytes", *[c for c, _ in plain], "frames", "error"],
                )

    return media.select("id", "n_bytes", "gif").mapInArrow(run, FEATURES)


def frames_table(media: DataFrame) -> DataFrame:
    """A row for each frame of the GIFs (id, gif): id, frame, shown_at and delay (1/100 s), width, height, rgba.

    rgba: the composed screen. A file that cannot be decoded whole has one row with an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "frame", "shown_at", "delay", "width", "height", "rgba", "error"]
        kinds = [pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.string()]
        for batch in batches:
            for ident, data in zip(*(batch.column(c).to_pylist() for c in ("id", "gif"))):
                try:
                    frames, screens, times = read_gif(data)
                    rows = [(ident, k, t, f.delay, x.shape[1], x.shape[0], x.tobytes(), None) for k, (f, x, t) in enumerate(zip(frames, screens, times))]
                except UNREADABLE as e:
                    rows = [(ident, *[None] * 6, str(e) or type(e).__name__)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return media.select("id", "gif").mapInArrow(run, "id long, frame int, shown_at int, delay int, width int, height int, rgba binary, error string")


def stored_texts(docs: DataFrame, **columns) -> DataFrame:
    """One row per row of docs: what features_of() reads from the GIF of media_of()."""
    return features_of(media_of(docs, **columns))
