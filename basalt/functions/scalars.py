"""Scalar functions of names, hexadecimal, bits and single bytes, as expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The signs of program texts, and scores of single bytes by encoding. In natural order:
# line ends, blank, tab, signs, letters and digits, other visible ASCII, zero, what remains.
SIGNS = "{}[]();=,.@/*+-_<>\"'\\:#$%&|!?"
ASCII_SCORES = (9.0, 8.0, 6.0, 6.0, 4.5, 2.5, -3.0, 0.25)
UTF8_SCORES = (8.0, 7.0, 5.0, 5.0, 3.5, 1.75, -2.0, -6.0)
CP932_SCORES = (8.0, 7.0, 5.0, 5.0, 3.5, 1.75, -2.0, 0.25)
# Scores of ranges of bytes beyond ASCII (first, last, score).
UTF8_RANGES = ((0x80, 0xBF, 0.9), (0xC2, 0xDF, 0.7), (0xE0, 0xEF, 0.8), (0xF0, 0xF4, 0.35))
CP932_RANGES = ((0xA1, 0xDF, 1.0), (0x81, 0x9F, 0.9), (0xE0, 0xFC, 0.9), (0x80, 0x80, -5.0), (0xA0, 0xA0, -5.0), (0xFD, 0xFF, -5.0))
# Scores of UTF-16 units: first, last, score, in the order they are tried.
UNIT_RANGES = (
    (0xFEFF, 0xFEFF, 10.0), (0x09, 0x0A, 10.0), (0x0D, 0x0D, 10.0), (0x20, 0x20, 8.0), (0x2000, 0x2FFF, 2.5), (0x3000, 0x30FF, 3.0),
    (0x3400, 0x9FFF, 2.25), (0xFF00, 0xFFEF, 2.5), (0x00, 0x1F, -18.0), (0xD800, 0xDFFF, -28.0),
)
# Signs of UTF-16 texts and the scores of signs, letters and digits, and other visible ASCII.
UNIT_SIGNS, UNIT_SCORES = "{}[]();=,@/*+-_<>\"'\\:#$%&|!?", (7.0, 5.0, 3.0)
# The code unit that stands for 0 in synthetic names, the bits a unit carries, and the units of 64 bits.
FIRST_UNIT, UNIT_BITS, UNITS_MOST = 0x5000, 14, 5


def hex_bytes(text: Column) -> Column:
    """The bytes of hexadecimal digits; blanks, `_` and `:` between them are skipped. Null if anything else is there."""
    digits = F.regexp_replace(text, "[ \\t\\n\\x0c\\r_:]", "")
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(digits))


def hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def whole_number(text: Column) -> Column:
    """A decimal number, or a hexadecimal one behind 0x; null for anything else and beyond 64 bits."""
    t = F.trim(text)
    wide = F.conv(F.regexp_extract(t, "^0[xX]([0-9A-Fa-f]{1,15})$", 1), 16, 10)
    return F.when(t.rlike("^0[xX][0-9A-Fa-f]{1,15}$"), wide.cast("long")).when(t.rlike("^[0-9]{1,18}$"), t.try_cast("long"))


def crib(text: Column) -> Column:
    """OFFSET:HEX as a struct (offset, plain); null if either part is no such thing."""
    offset, plain = whole_number(F.substring_index(text, ":", 1)), hex_bytes(F.regexp_extract(text, "(?s)^[^:]*:(.*)$", 1))
    return F.when(text.contains(":") & offset.isNotNull() & plain.isNotNull(), F.struct(offset.alias("offset"), plain.alias("plain")))


def normal_name(name: Column) -> Column:
    """A-Z lower-cased, `\\` as `/`, no leading and no repeated `/`."""
    lower = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\\", "abcdefghijklmnopqrstuvwxyz/")
    return F.regexp_replace(F.regexp_replace(lower, "^/+", ""), "/+", "/")


def safe_path(name: Column) -> Column:
    """A relative path without `..`; `.` parts and empty ones go. Null for any other, and where nothing is left."""
    parts = F.filter(F.split(name, "/"), lambda p: ~p.isin("", "."))
    fine = ~name.startswith("/") & ~F.exists(parts, lambda p: p == "..") & (F.size(parts) > 0)
    return F.when(fine, F.array_join(parts, "/"))


def named_like(name: Column, starts: list[str]) -> Column:
    """Whether a name begins with one of the given texts."""
    out = F.lit(False)
    for s in starts:
        out = out | name.startswith(s)
    return out


def holds(name: Column, text: str) -> Column:
    """Substring search that takes no heed of case."""
    return F.contains(F.lower(name), F.lower(F.lit(text)))


def synthetic_name(ident: Column) -> Column:
    """A number as text: UNIT_BITS bits a character, the lowest first, from FIRST_UNIT on."""
    number, mask = ident.cast("long"), (1 << UNIT_BITS) - 1

    def one(k: int) -> Column:
        """A unit's three bytes in UTF-8; null for those above the highest that is not zero."""
        rest = F.shiftrightunsigned(number, k * UNIT_BITS)
        unit = rest.bitwiseAND(F.lit(mask)) + FIRST_UNIT
        high, middle = F.shiftleft(unit.bitwiseAND(F.lit(0xF000)), 4), F.shiftleft(unit.bitwiseAND(F.lit(0xFC0)), 2)
        coded = F.hex(high.bitwiseOR(middle).bitwiseOR(unit.bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0xE08080)))
        return F.when(rest != 0, coded) if k else coded

    return F.unhex(F.concat_ws("", *map(one, range(UNITS_MOST)))).cast("string")


def synthetic_id(name: Column) -> Column:
    """The number that synthetic_name() makes this name of; null for any other name."""
    once = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  (value is computed once, however often body has it)

    def unit(x: Column, k: int) -> Column:
        return F.when(F.length(x) > k, F.ascii(F.substring(x, k + 1, 1)).cast("long") - FIRST_UNIT).otherwise(F.lit(0).cast("long"))

    def number(n: Column, units: Column) -> Column:
        total = units[0]
        for k in range(1, UNITS_MOST):
            total = total.bitwiseOR(F.shiftleft(units[k], k * UNIT_BITS))
        # The highest unit is not zero, and the last one holds what is left of 64 bits.
        fits = n.between(1, UNITS_MOST) & (F.array_min(units) >= 0) & (F.array_max(units) < 1 << UNIT_BITS)
        fits = fits & (units[UNITS_MOST - 1] < 1 << 64 - (UNITS_MOST - 1) * UNIT_BITS)
        return F.when(fits & ((n == 1) | (F.get(units, n - 1) > 0)), total)

    return once(name, lambda x: once(F.array(*[unit(x, k) for k in range(UNITS_MOST)]), lambda units: number(F.length(x), units)))


def utf16_text(data: Column) -> Column:
    """UTF-16LE bytes as text; a last odd byte is left out, and what is no character becomes U+FFFD."""
    even = F.octet_length(data) - F.octet_length(data) % 2
    return F.decode(F.substring(data, F.lit(1), even), "UTF-16LE")


@F.pandas_udf(StringType())
def cp932_text(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """CP932 bytes as text; null where they are not. Spark itself does not know that encoding."""

    def one(b):
        try:
            return None if b is None else bytes(b).decode("cp932")
        except UnicodeDecodeError:
            return None

    for batch in data:
        yield batch.map(one)


def partial_plain(data: Column, key: Column, filler: int = 0) -> Column:
    """data XOR a key given as an array of bytes, of which some may be null; those give the filler. As an array."""
    n = F.octet_length(data)
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int")
    at = lambda i: F.get(key, (i % F.size(key)).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(byte(i).bitwiseXOR(at(i).cast("int")), F.lit(filler)))
    return F.when((n > 0) & (F.size(key) > 0), each).otherwise(F.array().cast("array<int>"))


def _class_score(byte: Column, scores: tuple, ranges: tuple = ()) -> Column:
    code = lambda chars: byte.isin(*[ord(c) for c in chars])
    alnum = byte.between(48, 57) | byte.between(65, 90) | byte.between(97, 122)
    out = F.when(code("\r\n"), scores[0]).when(code(" "), scores[1]).when(code("\t"), scores[2]).when(code(SIGNS), scores[3])
    out = out.when(alnum, scores[4]).when(byte.between(0x21, 0x7E), scores[5]).when(byte == 0, scores[6])
    for low, high, score in ranges:
        out = out.when(byte.between(low, high), score)
    return out.otherwise(scores[7])


def ascii_score(byte: Column) -> Column:
    return _class_score(byte, ASCII_SCORES)


def utf8_score(byte: Column) -> Column:
    return _class_score(byte, UTF8_SCORES, UTF8_RANGES)


def cp932_score(byte: Column) -> Column:
    return _class_score(byte, CP932_SCORES, CP932_RANGES)


def utf16_score(offset: Column, byte: Column, little: bool = True) -> Column:
    """Of a byte at an offset of a UTF-16 text: high bytes are mostly zero, low ones are ASCII."""
    high = offset % 2 == (1 if little else 0)
    rest = F.when(byte == 0, 10.0).when(byte.between(0x20, 0x9F), 0.8).when(byte.between(0xD8, 0xDF), -3.0).otherwise(0.0)
    return F.when(high, rest).otherwise(ascii_score(byte))


def unit_score(unit: Column) -> Column:
    """Of a UTF-16 code unit."""
    out = F.when(F.lit(False), 0.0)
    for low, high, score in UNIT_RANGES:
        out = out.when(unit.between(low, high), score)
    alnum = unit.between(48, 57) | unit.between(65, 90) | unit.between(97, 122)
    visible = unit.between(0x21, 0x7E)
    out = out.when(visible & unit.isin(*[ord(c) for c in UNIT_SIGNS]), UNIT_SCORES[0]).when(visible & alnum, UNIT_SCORES[1]).when(visible, UNIT_SCORES[2])
    return out.otherwise(0.25)


def swapped_bits(unit: Column) -> Column:
    """A 16-bit number with each pair of neighbouring bits swapped."""
    return F.shiftright(unit.bitwiseAND(F.lit(0xAAAA)), 1).bitwiseOR(F.shiftleft(unit.bitwiseAND(F.lit(0x5555)), 1))


def masked_unit(unit: Column) -> Column:
    """A 16-bit number of 32 or more with its low byte, but for the last bit, over the high one, and the last bit turned."""
    return F.when(unit >= 0x20, unit.bitwiseXOR(F.shiftleft(unit.bitwiseAND(F.lit(0xFE)), 8).bitwiseXOR(F.lit(1)))).otherwise(unit)


def guessed_keys(histogram: DataFrame, keys: list[str], score: Callable[[Column], Column]) -> DataFrame:
    """keys, slot, key: for each slot the key byte whose plain bytes score best in sum; the smallest on ties.

    histogram: keys, slot, value, n; score: a function of a column of bytes.
    """
    each = histogram.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(255))))
    sums = each.groupBy(*keys, "slot", "key").agg(F.sum(F.col("n") * score(F.col("value").bitwiseXOR(F.col("key")))).alias("score"))
    best = F.max(F.struct("score", (-F.col("key")).alias("order"))).alias("b")
    return sums.groupBy(*keys, "slot").agg(best).select(*keys, "slot", (-F.col("b.order")).alias("key"), F.round("b.score", 6).alias("score"))


def refined_extension(name: Column, proven: Column, strong: Column, magic: Column, generic: tuple[str, ...] = ("", "bin", "dat")) -> Column:
    """The extension to store a file under: a name's own unless generic, else what is proven, strong, or sniffed."""
    own = F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/]*)$", 1), r"(?s)^.+\.([^.]*)$", 1))
    return F.when(own.isin(*generic), F.coalesce(proven, strong, magic, own)).otherwise(own)
