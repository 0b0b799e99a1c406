"""Detection by magic bytes, as expressions on a binary column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of formats, and the bytes in hexadecimal that their files begin with.
MAGIC = (
    ("png", "89504E470D0A1A0A"),
    ("gif", "474946383761"),
    ("gif", "474946383961"),
    ("jpeg", "FFD8FF"),
    ("ogg", "4F676753"),
    ("riff", "52494646"),
    ("flac", "664C6143"),
    ("zip", "504B0304"),
    ("7z", "377ABCAF271C"),
    ("gzip", "1F8B"),
    ("bmp", "424D"),
    ("pe", "4D5A"),
    ("midi", "4D546864"),
    ("psd", "38425053"),
    ("dds", "44445320"),
    ("id3", "494433"),
)


def sniffed(data: Column) -> Column:
    """The name of the longest magic that the bytes begin with, else `unknown`; null for null."""
    out = F.when(data.isNull(), F.lit(None).cast("string"))
    for name, magic in sorted(MAGIC, key=lambda m: -len(m[1])):
        out = out.when(F.hex(F.substring(data, 1, len(magic) // 2)) == magic, name)
    return out.otherwise("unknown")
