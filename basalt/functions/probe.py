"""What lies inside a blob: signatures, compressed streams, chunks, known formats, one-byte masks, entropy."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hypotheses import _formats
from ..sources.container import MAGIC
from . import formats, formats_more
from .bytes import entropy

# Signatures that need no further look, with label, kind and confidence; the tags of
# known chunks; other confidences and the bounds of the entropy row.
SIGNATURES = (
    (MAGIC, "container", "container", 100),
    (b"\x28\xb5\x2f\xfd", "zstd frame", "compression", 90),
    (b"\xfd7zXZ\0", "xz/lzma2 stream", "compression", 90),
    (b"BZh", "bzip2 stream", "compression", 88),
    (b"\x04\x22\x4d\x18", "lz4 frame", "compression", 88),
)
KNOWN_TAGS = (b"File", b"info", b"segm", b"adlr", b"time", b"Hxv4")
MASKED_TAGS = (b"File", b"Hxv4", b"info", b"segm")
ENTROPY_BYTES, ENTROPY_LEAST, ENTROPY_BITS = 8192, 256, 7.65
MASK_MOST = 64 << 20
#: Bytes that one stream may inflate to; beyond them it does not count as a stream.
INFLATE_MOST = 64 << 20
#: Blobs whose findings are put together at once.
ROWS_AT_ONCE = 1024
SCHEMA = "id long, offset long, length long, kind string, label string, confidence int, decoded_length long"


def _inflated(data: memoryview, mode: int) -> bytes | None:
    """What a stream at the start of data inflates to; null if it breaks off, is empty or too large."""
    d = zlib.decompressobj(mode)
    try:
        out = d.decompress(data, INFLATE_MOST + 1)
    except zlib.error:
        return None
    return out if d.eof and 0 < len(out) <= INFLATE_MOST else None


def _tagged(data: bytes, at: int) -> int | None:
    """The end of a chunk at an offset: a visible tag and a size within the bytes."""
    if at + 12 > len(data) or any(not 0x20 <= c <= 0x7E for c in data[at : at + 4]):
        return None
    end = at + 12 + int.from_bytes(data[at + 4 : at + 12], "little")
    return end if end <= len(data) else None


def chunk_count(data: bytes) -> int:
    """Chunks that fill the bytes exactly; 0 if they do not."""
    at = count = 0
    while (end := _tagged(data, at)) is not None:
        at, count = end, count + 1
    return count if at == len(data) else 0


_TAG = re.compile(rb"(?=[\x20-\x7e]{4})")
_ZLIB = re.compile(rb"(?=[\x08\x18\x28\x38\x48\x58\x68\x78\x88\x98\xa8\xb8\xc8\xd8\xe8\xf8])")
#: What a stream begins with: the two bytes of zlib, whose number is a multiple of 31, or those of gzip.
_ZLIB_STARTS = frozenset(bytes((a, b)) for a in range(8, 256, 16) for b in range(256) if (a << 8 | b) % 31 == 0)
_GZIP_START = b"\x1f\x8b\x08"
#: Each format's first bytes, if there are three at least, and its check, made once and not for each blob.
_STARTS = tuple(
    (start, name, formats_more.OF_HYPOTHESIS.get(name))
    for _, name, _, cribs, _ in _formats()
    if (start := next((b for at, b in cribs if at == 0 and len(b) >= 3), None))
)


def _places(data: bytes, needle: bytes) -> Iterator[int]:
    """Where needle stands, overlapping places too."""
    at = data.find(needle)
    while at >= 0:
        yield at
        at = data.find(needle, at + 1)


def _found(data: bytes) -> Iterator[tuple[int, int | None, str, str, int, int | None]]:
    view = memoryview(data)
    for needle, label, kind, sure in SIGNATURES:
        for at in _places(data, needle):
            yield at, None, kind, label, sure, None
    for m in _ZLIB.finditer(data, 0, max(len(data) - 2, 0)):
        at = m.start()
        if data[at : at + 2] in _ZLIB_STARTS and (out := _inflated(view[at:], 15)):
            yield at, None, "zlib", "zlib stream", 90, len(out)
            if n := chunk_count(out):
                yield at, None, "chunks", f"zlib -> chunks={n}", 99, len(out)
    for at in _places(data, _GZIP_START):
        if out := _inflated(view[at:], 31):
            yield at, None, "gzip", "gzip stream", 95, len(out)
    for m in _TAG.finditer(data):
        at = m.start()
        if at + 12 < len(data) and (end := _tagged(data, at)) is not None:
            tag = data[at : at + 4]
            yield at, end - at, "chunks", f"chunk {tag.decode()} payload={end - at - 12}", 98 if tag in KNOWN_TAGS else 70, None
    for start, name, check in _STARTS:
        for at in _places(data, start):
            strong = at == 0 and check is not None and _strong(check, data)
            yield at, None, "format", name, 100 if strong else 75, None
    yield from _masked(data)
    if len(data) >= ENTROPY_LEAST and (bits := entropy(data[:ENTROPY_BYTES])) >= ENTROPY_BITS:
        yield 0, len(data), "entropy", f"high entropy={math.floor(bits * 1000 + 0.5) / 1000:.3f}", 55, None


def _strong(check: str, data: bytes) -> bool:
    valid, strength, _ = formats.verdict(check, data)
    return valid and strength >= formats.STRONG


def _masked(data: bytes) -> Iterator[tuple[int, int | None, str, str, int, int | None]]:
    """One byte XORed over the whole blob, where that shows a stream or a chunk at its start."""
    if not 4 <= len(data) <= MASK_MOST:
        return
    for key in _mask_keys(data[0]):
        head = bytes(b ^ key for b in data[:16])
        packed, gz = head[:2] in _ZLIB_STARTS, head.startswith(_GZIP_START)
        if packed or gz:
            out = _inflated(memoryview((np.frombuffer(data, np.uint8) ^ key).tobytes()), 15 if packed else 31)
            if out:
                n = chunk_count(out) if packed else 0
                label = f"xor-byte 0x{key:02x} -> " + ("zlib" if packed else "gzip") + (f" -> chunks={n}" if n else "")
                yield 0, len(data), "masked", label, 99 if n else 88 if packed else 92, len(out)
        elif head.startswith(MAGIC) or (len(data) >= 12 and head[:4] in MASKED_TAGS):
            yield 0, len(data), "masked", f"xor-byte 0x{key:02x} -> " + ("container" if head.startswith(MAGIC) else "chunk"), 96, None


@cache
def _mask_keys(first: int) -> tuple[int, ...]:
    """The keys, but 0, that turn a first byte into one that _masked() looks for; others show nothing."""
    starts = {*range(8, 256, 16), _GZIP_START[0], MAGIC[0], *(tag[0] for tag in MASKED_TAGS)}
    return tuple(sorted({first ^ b for b in starts} - {0}))


def probed(df: DataFrame, id_col: str, data: Column) -> DataFrame:
    """id, offset, length, kind, label, confidence, decoded_length: a row for each finding, one of a label at an offset.

    Null bytes have none. A stream is inflated to INFLATE_MOST bytes at most; a longer one is not reported.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("label", pa.string()), ("confidence", pa.int32()), ("decoded_length", pa.int64())]
        )
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece, rows = batch.slice(start, ROWS_AT_ONCE), []
                for ident, blob in zip(piece.column("id").to_pylist(), piece.column("data")):
                    best = {}
                    for row in _found(blob.as_py() or b""):
                        at = (row[0], row[3])
                        if at not in best or row[4] > best[at][4]:
                            best[at] = row
                    rows += [(ident, *row) for row in best.values()]
                columns = zip(*rows) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), data.alias("data")).mapInArrow(run, SCHEMA)
