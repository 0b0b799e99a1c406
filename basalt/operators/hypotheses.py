"""Format hypotheses as a dimension: which formats a name allows, and what bytes they fix.

The tables are small and fixed, so joins with them are broadcast joins of at most a few hundred
rows, whatever the other side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spread import spread

# Extensions of texts; then for each format its name, its extensions (* for those of
# texts), the bytes it fixes (offset:hexadecimal) and how more of them are found. In natural order.
TEXTS = "tjs ks asd txt csv func stand ini ksd kdt json xml cfg conf js css html htm lua toml sli dic svg"
FORMATS = """
PNG | png | 0:89504e470d0a1a0a 8:0000000d 12:49484452 | png
JPEG | jpg jpeg | 0:ffd8ff |
JPEG-XR/WMP | jxr wdp hdp | 0:4949bc01 |
Ogg | ogg oga ogv | 0:4f676753 4:00 18:00000000 | ogg
Ogg/Opus | opus ogg oga | 0:4f676753 4:00 5:02 6:0000000000000000 18:00000000 | opus
Ogg/Opus-family0 | opus ogg oga | 0:4f676753 4:00 5:02 6:0000000000000000 18:00000000 26:01 27:13 28:4f70757348656164 36:01 46:00 47:4f676753 51:00 65:01000000 | opus
Ogg/Opus-family0-smalltags | opus ogg oga | 0:4f676753 4:00 5:02 6:0000000000000000 18:00000000 26:01 27:13 28:4f70757348656164 36:01 46:00 47:4f676753 51:00 65:01000000 52:00 53:0000000000000000 73:01 75:4f70757354616773 | opus
Ogg/Vorbis | ogg oga | 0:4f676753 4:00 18:00000000 26:01 27:1e 28:01766f72626973 | ogg
WAVE/RIFF | wav | 0:52494646 8:57415645 |
AVI/RIFF | avi | 0:52494646 8:41564920 |
WebP/RIFF | webp | 0:52494646 8:57454250 |
GIF87a | gif | 0:474946383761 |
GIF89a | gif | 0:474946383961 |
BMP | bmp | 0:424d |
ZIP/local | zip jar | 0:504b0304 |
ZIP/empty | zip jar | 0:504b0506 |
7-Zip | 7z | 0:377abcaf271c |
gzip | gz | 0:1f8b08 |
Text/UTF-16LE-BOM | * | 0:fffe |
Text/UTF-16LE | * | |
Text/UTF-16BE-BOM | * | 0:feff |
Text/UTF-16BE | * | |
Text/UTF-8-BOM | * | 0:efbbbf |
Text/UTF-8 | * | |
Text/CP932 | * | |
Kirikiri/Text-mode0 | * | 0:fefe00fffe |
Kirikiri/Text-mode1 | * | 0:fefe01fffe |
Kirikiri/Text-mode2 | * | 0:fefe02fffe |
KiriKiri/PBD-ns0 | pbd | 0:544a532f6e733000 |
KiriKiri/PBD-4s0 | pbd | 0:544a532f34733000 |
TJS2/Bytecode | tjs | 0:544a533231303000 12:44415441 |
PSB/M2-Emote | psb pimg scn mmo emtbytes mtn dpak psb.m | 0:50534200 |
PSZ/PSB-shell | psz psb.m | 0:50535a |
MDF/PSB-shell | mdf psb.m | 0:6d6466 |
MFL/PSB-shell | mfl psb.m | 0:6d666c |
TrueType/sfnt | ttf | 0:00010000 |
OpenType/CFF | otf | 0:4f54544f |
TrueType/Collection | ttc | 0:74746366 |
WOFF | woff | 0:774f4646 |
WOFF2 | woff2 | 0:774f4632 |
Kirikiri/PrerenderedFont-v0 | tft | 0:545650207072652d72656e646572656420666f6e741a0002 |
Kirikiri/PrerenderedFont-v1 | tft | 0:545650207072652d72656e646572656420666f6e741a0102 |
FLAC | flac | 0:664c6143 |
MP4/ISO-BMFF | mp4 m4a m4v mov | 4:66747970 |
MIDI | mid midi | 0:4d546864 |
DDS | dds | 0:44445320 |
ICO | ico | 0:00000100 |
CUR | cur | 0:00000200 |
WebM/Matroska | webm mkv | 0:1a45dfa3 |
MP3/ID3 | mp3 | 0:494433 |
PE/COFF | exe dll tpm ax | 0:4d5a |
ASF/WMV-WMA | wmv wma asf | 0:3026b2758e66cf11a6d900aa0062ce6c |
MPEG-PS | mpg mpeg | 0:000001ba |
MPEG-1/Video | m1v mpv mpg mpeg | 0:000001b3 |
H264/AnnexB-4 | 264 h264 avc | 0:00000001 |
H264/AnnexB-3 | 264 h264 avc | 0:000001 |
Photoshop/PSD | psd | 0:38425053 |
TGA | tga | |
TLG5 | tlg | 0:544c47352e30007261771a | tlg5
TLG5-rgb-block4 | tlg | 0:544c47352e30007261771a 11:03 20:04000000 | tlg5
TLG5-rgba-block4 | tlg | 0:544c47352e30007261771a 11:04 20:04000000 | tlg5
TLG6-gray | tlg | 0:544c47362e30007261771a 11:01000000 | tlg6
TLG6-rgb | tlg | 0:544c47362e30007261771a 11:03000000 | tlg6
TLG6-rgba | tlg | 0:544c47362e30007261771a 11:04000000 | tlg6
TLG0/TLG5 | tlg | 0:544c47302e30007364731a 15:544c47352e30007261771a | tlg5
TLG0/TLG6-gray | tlg | 0:544c47302e30007364731a 15:544c47362e30007261771a 26:01000000 | tlg6
TLG0/TLG6-rgb | tlg | 0:544c47302e30007364731a 15:544c47362e30007261771a 26:03000000 | tlg6
TLG0/TLG6-rgba | tlg | 0:544c47302e30007364731a 15:544c47362e30007261771a 26:04000000 | tlg6
"""
# Bytes that follow from the length n of a file: format, least n, offset as SQL, bytes as
# SQL in hexadecimal. le(x, k) is x as k little-endian bytes.
BY_LENGTH = (
    ("PNG", 12, "n - 12", "'0000000049454E44AE426082'"),
    ("PNG", 29, "26", "'0000'"),
    ("JPEG", 2, "n - 2", "'FFD9'"),
    ("WAVE/RIFF", 8, "4", "le(n - 8, 4)"),
    ("AVI/RIFF", 8, "4", "le(n - 8, 4)"),
    ("WebP/RIFF", 8, "4", "le(n - 8, 4)"),
    ("BMP", 0, "2", "le(n, 4)"),
    ("GIF87a", 1, "n - 1", "'3B'"),
    ("GIF89a", 1, "n - 1", "'3B'"),
    ("TGA", 18, "n - 18", "'54525545564953494F4E2D5846494C452E00'"),
    ("Kirikiri/Text-mode2", 21, "5", "le(n - 21, 8)"),
    ("TJS2/Bytecode", 16, "8", "le(n, 4)"),
    ("PSB/M2-Emote", 6, "5", "'00'"),
)
# Bytes that must be among several: format, least length, offset, the allowed values.
ONE_OF = (
    ("PNG", 29, 24, (1, 2, 4, 8, 16)),
    ("PNG", 29, 25, (0, 2, 3, 4, 6)),
    ("PNG", 29, 28, (0, 1)),
    ("Ogg", 6, 5, (2, 6)),
    ("Ogg/Vorbis", 6, 5, (2, 6)),
    ("Ogg/Opus-family0", 38, 37, (1, 2)),
    ("Ogg/Opus-family0-smalltags", 38, 37, (1, 2)),
    ("TLG5", 12, 11, (3, 4)),
    ("PSB/M2-Emote", 5, 4, (1, 2, 3, 4)),
)
GENERIC = ("", "bin", "dat")


def _formats() -> list[tuple[int, str, list[str], list[tuple[int, bytes]], str]]:
    out = []
    for line in FORMATS.strip().splitlines():
        name, extensions, cribs, model = (x.strip() for x in line.split("|"))
        pairs = [c.split(":") for c in cribs.split()]
        out.append((len(out), name, (TEXTS if extensions == "*" else extensions).split(), [(int(at), bytes.fromhex(h)) for at, h in pairs], model or "none"))
    return out


def hypotheses(spark: SparkSession) -> DataFrame:
    """hyp_no, hypothesis, extensions, model: one row a format."""
    return spark.createDataFrame([(i, n, e, m) for i, n, e, _, m in _formats()], "hyp_no int, hypothesis string, extensions array<string>, model string")


def facts(spark: SparkSession) -> DataFrame:
    """hypothesis, offset, plain: the bytes each format fixes."""
    rows = [(n, at, bytearray(b)) for _, n, _, cribs, _ in _formats() for at, b in cribs]
    return spark.createDataFrame(rows, "hypothesis string, offset long, plain binary")


def extension(name: Column) -> Column:
    """What follows the last dot of the last part of a path, lower-cased; empty for dot files and for null."""
    last = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(last, r"(?s)^.+\.([^.]*)$", 1))


def _by_key() -> dict[str, list[tuple[int, str]]]:
    """The hypotheses (hyp_no, hypothesis) of each extension, compound ones too, and of the generic ones."""
    every = [(i, n) for i, n, *_ in _formats()]
    out = {g: list(every) for g in GENERIC}
    for i, n, extensions, *_ in _formats():
        for e in extensions:
            out.setdefault(e, []).append((i, n))
    return out


def _dimension(spark: SparkSession) -> DataFrame:
    """_key, _allowed (its hypotheses) and _common (the facts that they share): a row for each key of _by_key()."""
    held = {n: set(cribs) for _, n, _, cribs, _ in _formats()}
    rows = []
    for key, allowed in _by_key().items():
        common = set.intersection(*(held[n] for _, n in allowed))
        rows.append((key, allowed, [(at, bytearray(b)) for at, b in sorted(common)]))
    return spark.createDataFrame(rows, "_key string, _allowed array<struct<hyp_no:int,hypothesis:string>>, _common array<struct<offset:bigint,plain:binary>>")


def _with_allowed(entries: DataFrame, name_col: str, taken: str, merged: Callable[[Column, Column], Column]) -> DataFrame:
    """entries with a column of the dimension, as _found: that of a name's extension and of its compound one, merged
    where a name has both, null where it has neither. A row stays one row.
    """
    name, keys = F.col(f"`{name_col}`"), _dimension(entries.sparkSession)
    tail = F.regexp_extract(F.lower(F.translate(F.coalesce(name, F.lit("")), "\\", "/")), r"(?s)\.([^.]*\.[^.]*)$", 1)
    one = F.broadcast(keys.select(F.col("_key").alias("_key1"), F.col(taken).alias("_found1")))
    two = F.broadcast(keys.where("_key like '%.%'").select(F.col("_key").alias("_key2"), F.col(taken).alias("_found2")))
    rows = entries.withColumns({"_ext": extension(name), "_tail": tail}).join(one, F.col("_ext") == F.col("_key1"), "left").join(two, F.col("_tail") == F.col("_key2"), "left")
    first, second = F.col("_found1"), F.col("_found2")
    found = F.when(first.isNotNull() & second.isNotNull(), merged(first, second)).otherwise(F.coalesce(first, second))
    return rows.withColumn("_found", found).drop("_ext", "_tail", "_key1", "_key2", "_found1", "_found2")


def allowed(entries: DataFrame, name_col: str) -> DataFrame:
    """entries with `allowed`: the hypotheses (hyp_no, hypothesis) that their names allow; rows without any are left out.

    By the extension, or by a compound one that the name ends with. A name without an extension, or
    with a generic one, allows all; one with an unknown extension none.
    """
    return _with_allowed(entries, name_col, "_allowed", F.concat).where("_found is not null").withColumnRenamed("_found", "allowed")


def for_names(entries: DataFrame, name_col: str) -> DataFrame:
    """entries times the hypotheses (hyp_no, hypothesis) that their names allow, as allowed() has them."""
    each = allowed(spread(entries), name_col).withColumn("_h", F.explode("allowed"))
    return each.select(*[F.col(f"`{c}`") for c in entries.columns], "_h.hyp_no", "_h.hypothesis")


def common_facts(entries: DataFrame, keys: list[str], name_col: str) -> DataFrame:
    """keys, offset, plain: the facts that all hypotheses of a name share; keys tell the rows of entries apart.

    What a key's hypotheses share is told from the fixed table, so no row meets another.
    """
    named = entries.where(~extension(F.col(f"`{name_col}`")).isin(*GENERIC))
    each = _with_allowed(named, name_col, "_common", F.array_intersect).withColumn("_f", F.explode("_found"))
    return each.select(*[F.col(f"`{c}`") for c in keys], "_f.offset", "_f.plain")


def little_endian(x: str, size: int) -> str:
    """SQL for a whole number as hexadecimal little-endian bytes."""
    return "concat(" + ", ".join(f"lpad(hex(shiftright({x}, {8 * k}) & 255), 2, '0')" for k in range(size)) + ")"


def length_facts(rows: DataFrame, length_col: str) -> DataFrame:
    """rows (with a hypothesis) times offset and plain: what a file of that length must hold.

    Numbers of four bytes are only given for lengths that fit them.
    """
    found = []
    for name, least, offset, value in BY_LENGTH:
        size = 4 if ", 4)" in value else 8
        hexed = little_endian("n - 21" if "21" in value else "n - 8" if "- 8" in value else "n", size) if value.startswith("le") else value
        fits = f"n >= {least}" + (" and n - 8 <= 4294967295" if "- 8, 4" in value else " and n <= 4294967295" if "le(n, 4)" in value else "")
        found.append(F.expr(f"case when hypothesis = '{name}' and {fits} then named_struct('offset', cast({offset} as bigint), 'plain', unhex({hexed})) end"))
    each = rows.withColumn("n", F.col(f"`{length_col}`").cast("long")).withColumn("_f", F.explode(F.array_compact(F.array(*found))))
    return each.select(*[F.col(f"`{c}`") for c in rows.columns], "_f.offset", "_f.plain")


def byte_choices(rows: DataFrame, length_col: str) -> DataFrame:
    """rows (with a hypothesis) times offset and allowed: bytes that must be among several values."""
    table = rows.sparkSession.createDataFrame([(n, k, at, list(v)) for n, k, at, v in ONE_OF], "hypothesis string, least long, offset long, allowed array<int>")
    return rows.join(F.broadcast(table), "hypothesis").where(F.col(f"`{length_col}`") >= F.col("least")).drop("least")


def all_facts(rows: DataFrame, length_col: str) -> DataFrame:
    """rows times their formats' facts and those by length, each (offset, plain) once."""
    fixed = rows.join(F.broadcast(facts(rows.sparkSession)), "hypothesis").select(*rows.columns, "offset", "plain")
    return fixed.union(length_facts(rows, length_col).select(*rows.columns, "offset", "plain")).distinct()
