"""Containers of resources: an index of named entries, each in ordered segments of a file.

`packed_container` writes one, `read_index` reads its index. Over DataFrames, `packed` makes containers
of rows, `indexed` and its children `entries`, `segments` and `index_blocks` list them, and `contents`
restores the bytes of entries. A container is read in one task and nothing is shuffled: an entry's
segments lie in its own container. Containers are binary values, so each is below 2 GB.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The signature, the tags of chunks, and the bits of index and segment flags.
MAGIC = bytes.fromhex("5850330D0A200A1A8B6701")
FILE, INFO, SEGMENTS, CHECKSUM, GROUPED_NAMES = b"File", b"info", b"segm", b"adlr", b"hnfn"
METHOD, RAW, ZLIB, CONTINUES = 0x07, 0, 1, 0x80
MAX_BLOCKS, PARAGRAPH = 1_000_000, 16


class Malformed(ValueError):
    """Bytes that are no container, or break its rules."""


class Segment(NamedTuple):
    flags: int
    archive_offset: int
    original_size: int
    archive_size: int


class Entry(NamedTuple):
    name: str
    alternate_name: str | None
    flags: int
    original_size: int
    archive_size: int
    adler: int | None
    segments: list[Segment]


class Block(NamedTuple):
    physical_offset: int
    flags: int
    stored_size: int
    original_size: int


class Root(NamedTuple):
    tag: str
    size: int
    index_block: int
    index_offset: int
    kind: str


class Index(NamedTuple):
    offset: int
    blocks: list[Block]
    roots: list[Root]
    entries: list[Entry]


def inflated(data: bytes, size: int) -> bytes:
    """A zlib stream of exactly `size` bytes; no more than one byte beyond it is ever made."""
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data, size + 1)
    except zlib.error as e:
        raise Malformed(f"zlib: {e}") from None
    if len(out) != size or not stream.eof:
        raise Malformed("zlib: another size than stated")
    return out


def _span(data: bytes, at: int, size: int) -> bytes:
    if at < 0 or at + size > len(data):
        raise Malformed(f"{size} bytes at {at} are outside the file")
    return data[at : at + size]


def _numbers(layout: str, data: bytes, at: int) -> tuple:
    return struct.unpack(layout, _span(data, at, struct.calcsize(layout)))


def _chunks(body: bytes, resync: bool) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, tag, content) of consecutive chunks. A length beyond the body raises, or with
    resync the next byte is tried."""
    at = 0
    while at + 12 <= len(body):
        tag, size = _numbers("<4sQ", body, at)
        if at + 12 + size <= len(body):
            yield at, tag, body[at + 12 : at + 12 + size]
            at += 12 + size
        elif resync:
            at += 1
        else:
            raise Malformed("a chunk is longer than its body")


def located(data: bytes) -> int:
    """Where the signature is: at the start, or at a paragraph of an executable that has it behind."""
    if data.startswith(MAGIC):
        return 0
    at = data.find(MAGIC) if data.startswith(b"MZ") else -1
    while at >= 0 and at % PARAGRAPH:
        at = data.find(MAGIC, at + 1)
    if at < 0:
        raise Malformed("no signature")
    return at


def _alternate_name(body: bytes) -> str | None:
    """The name of a chunk of u32 hash, u16 units and UTF-16LE name, which fills it but for one NUL."""
    if len(body) < 8:
        return None
    units = int.from_bytes(body[4:6], "little")
    if units > 4096 or len(body) - 6 - 2 * units not in (0, 2) or any(body[6 + 2 * units :]):
        return None
    name = body[6 : 6 + 2 * units].decode("utf-16-le", "replace")
    return name if name and name.isprintable() and "�" not in name else None


def _entry(body: bytes, alternate: str | None) -> Entry | None:
    """The entry of a File chunk; None without a whole info and segments, or if a chunk is too long."""
    info, segments, adler = None, [], None
    try:
        for _, tag, part in _chunks(body, resync=False):
            if tag == INFO and len(part) >= 22:
                flags, original, stored, units = struct.unpack_from("<IQQH", part)
                if 22 + 2 * units <= len(part):
                    info = part[22 : 22 + 2 * units].decode("utf-16-le", "replace"), flags, original, stored
            elif tag == SEGMENTS and part and len(part) % 28 == 0:
                segments += [Segment(*s) for s in struct.iter_unpack("<IQQQ", part)]
            elif tag == CHECKSUM and len(part) >= 4:
                adler = int.from_bytes(part[:4], "little")
    except Malformed:
        return None
    if info is None or not segments:
        return None
    name, flags, original, stored = info
    return Entry(name, alternate, flags, original, stored, adler, segments)


def read_index(data: bytes, tolerant: bool = True) -> Index:
    """The index of a container, block after block as their pointers lead; raises Malformed."""
    start = located(data)
    index, pointer, pending = Index(start, [], [], []), start + len(MAGIC), None
    while True:
        if len(index.blocks) > MAX_BLOCKS:
            raise Malformed("too many index blocks")
        at = start + _numbers("<Q", data, pointer)[0]
        (flags,) = _numbers("<B", data, at)
        if flags & METHOD == RAW:
            (stored,) = sizes = _numbers("<Q", data, at + 1)
        elif flags & METHOD == ZLIB:
            stored, _ = sizes = _numbers("<QQ", data, at + 1)
        else:
            raise Malformed(f"index method {flags & METHOD}")
        pointer = at + 1 + 8 * len(sizes)
        body = _span(data, pointer, stored)
        pointer += stored
        if len(sizes) == 2:
            body = inflated(body, sizes[1])
        for offset, tag, part in _chunks(body, tolerant):
            kind = "unknown"
            if tag == FILE:
                kind = "file"
                if (entry := _entry(part, pending)) is not None:
                    index.entries.append(entry)
                pending = None
            elif (name := _alternate_name(part)) is not None:
                kind, pending = "alternate_name", None if tag == GROUPED_NAMES else name
            index.roots.append(Root(tag.decode("latin-1"), len(part), len(index.blocks), offset, kind))
        index.blocks.append(Block(at, flags, stored, len(body)))
        if not flags & CONTINUES:
            return index


def stored(data: bytes, entry: Entry) -> bytes:
    """An entry's bytes as they are in the file, segments in order."""
    return b"".join(_span(data, s.archive_offset, s.archive_size) for s in entry.segments)


def restored(data: bytes, entry: Entry) -> bytes:
    """An entry's content: its segments in order, inflated where they are compressed."""
    parts = []
    for s in entry.segments:
        part = _span(data, s.archive_offset, s.archive_size)
        if s.flags & METHOD == ZLIB:
            part = inflated(part, s.original_size)
        elif s.flags & METHOD != RAW or len(part) != s.original_size:
            raise Malformed("a segment's method or size")
        parts.append(part)
    return b"".join(parts)


def _chunk(tag: bytes, body: bytes) -> bytes:
    return struct.pack("<4sQ", tag, len(body)) + body


def packed_container(files: Iterable[tuple[str, bytes]], *, segment_size: int = 1 << 20, compress: bool = True, zlib_index: bool = True, prefix: bytes = b"") -> bytes:
    """A container of (name, content) in the given order; after `prefix`, padded to a paragraph.

    Contents are cut into segments of `segment_size`; a segment is compressed where that shortens it.
    An empty content is one empty segment.
    """
    head = prefix + b"\0" * (-len(prefix) % PARAGRAPH)
    out, roots = bytearray(head + MAGIC + b"\0" * 8), []
    for name, content in files:
        segments = b""
        begun = len(out)
        for at in range(0, max(len(content), 1), segment_size):
            part = content[at : at + segment_size]
            small = zlib.compress(part) if compress else part
            flags, put = (ZLIB, small) if len(small) < len(part) else (RAW, part)
            segments += struct.pack("<IQQQ", flags, len(out), len(part), len(put))
            out += put
        units = name.encode("utf-16-le")
        info = struct.pack("<IQQH", 0, len(content), len(out) - begun, len(units) // 2) + units
        roots.append(_chunk(FILE, _chunk(INFO, info) + _chunk(SEGMENTS, segments) + _chunk(CHECKSUM, struct.pack("<I", zlib.adler32(content)))))
    index = b"".join(roots)
    struct.pack_into("<Q", out, len(head) + len(MAGIC), len(out) - len(head))
    if zlib_index:
        small = zlib.compress(index)
        out += struct.pack("<BQQ", ZLIB, len(small), len(index)) + small
    else:
        out += struct.pack("<BQ", RAW, len(index)) + index
    return bytes(out)


# ---- DataFrames

SEGMENT = "struct<flags:long,archive_offset:long,original_size:long,archive_size:long>"
INDEX = (
    "archive_id string, container_offset long, physical_size long,"
    " blocks array<struct<physical_offset:long,flags:long,stored_size:long,original_size:long>>,"
    " roots array<struct<tag:string,size:long,index_block:long,index_offset:long,kind:string>>,"
    " entries array<struct<name:string,alternate_name:string,flags:long,original_size:long,archive_size:long,adler:long,"
    f"segments:array<{SEGMENT}>>>, error string"
)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(archive_id, content) of all files under a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return read.load(path).select(F.col("path").alias("archive_id"), "content")


def packed(df: DataFrame, archive: Column, name: Column, content: Column, **options) -> DataFrame:
    """(archive_id, content): a container for each value of `archive`, its entries in order of name.

    Each is made in one task, so keep what one holds bounded. Null contents are empty.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name", kind="stable")
        return pd.DataFrame({"archive_id": [key[0]], "content": [packed_container(zip(rows["name"], map(bytes, rows["content"])), **options)]})

    rows = df.select(archive.cast("string").alias("archive_id"), name.alias("name"), F.coalesce(content, F.lit(b"")).alias("content"))
    return rows.groupBy("archive_id").applyInPandas(run, "archive_id string, content binary")


def _signed(value):
    """Unsigned 64-bit numbers beyond a long become null."""
    return None if isinstance(value, int) and value >= 1 << 63 else value


def _plain(record: NamedTuple) -> dict:
    return {k: [_plain(s) for s in v] if isinstance(v, list) else _signed(v) for k, v in record._asdict().items()}


def indexed(df: DataFrame, tolerant: bool = True) -> DataFrame:
    """One row per container of df(archive_id, content): its index, or the error that stopped it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for archive, data in zip(batch["archive_id"], batch["content"]):
                row = {"archive_id": archive, "container_offset": None, "physical_size": None, "blocks": [], "roots": [], "entries": [], "error": None}
                try:
                    index = read_index(data := bytes(data or b""), tolerant)
                    row |= {"container_offset": index.offset, "physical_size": len(data)}
                    row |= {k: [_plain(r) for r in getattr(index, k)] for k in ("blocks", "roots", "entries")}
                except Malformed as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pd.DataFrame(rows, columns=["archive_id", "container_offset", "physical_size", "blocks", "roots", "entries", "error"])

    return df.select("archive_id", "content").mapInPandas(run, INDEX)


def entries(index: DataFrame) -> DataFrame:
    """archive_id, entry_no, preferred_name and the entry's fields."""
    out = index.select("archive_id", F.posexplode("entries").alias("entry_no", "e")).select("archive_id", "entry_no", "e.*")
    return out.withColumn("preferred_name", F.coalesce("alternate_name", "name"))


def segments(index: DataFrame) -> DataFrame:
    """archive_id, entry_no, pos and the segment's fields."""
    out = entries(index).select("archive_id", "entry_no", F.posexplode("segments").alias("pos", "s"))
    return out.select("archive_id", "entry_no", "pos", "s.*")


def index_blocks(index: DataFrame) -> DataFrame:
    """archive_id, block_no and the block's fields."""
    return index.select("archive_id", F.posexplode("blocks").alias("block_no", "b")).select("archive_id", "block_no", "b.*")


def root_chunks(index: DataFrame) -> DataFrame:
    """archive_id, root_no and the chunk's fields."""
    return index.select("archive_id", F.posexplode("roots").alias("root_no", "r")).select("archive_id", "root_no", "r.*")


def contents(df: DataFrame) -> DataFrame:
    """One row per entry of df(archive_id, content): archive_id, entry_no, name, content, adler_ok, error.

    adler_ok is null without a checksum. A container without a readable index gives one row, with the
    error alone.
    """
    names = ["archive_id", "entry_no", "name", "content", "adler_ok", "error"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.bool_(), pa.string()]

    def rows(archive: str, data: bytes) -> Iterator[tuple]:
        try:
            index = read_index(data)
        except Malformed as e:
            yield archive, None, None, None, None, str(e)
            return
        for i, entry in enumerate(index.entries):
            name = entry.alternate_name or entry.name
            try:
                out = restored(data, entry)
                yield archive, i, name, out, None if entry.adler is None else zlib.adler32(out) == entry.adler, None
            except Malformed as e:
                yield archive, i, name, None, None, str(e)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for row in rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""):
                    held.append(row)
                    size += len(row[3] or b"")
                    if size >= 1 << 24 or len(held) >= 1000:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    return df.select("archive_id", "content").mapInArrow(run, "archive_id string, entry_no int, name string, content binary, adler_ok boolean, error string")
