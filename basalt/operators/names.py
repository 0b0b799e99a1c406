"""Candidates for unknown names, and the choice of a bounded sample. All in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spread import spread

# Words of a context, and the extensions that names met there may lack.
HINTS = (
    (("tjs", "execstorage", "include", "require", "plugin"), ("tjs",)),
    (("scenario", "jump", "call", "kag", "ks"), ("ks",)),
    (("image", "graphic", "face", "layer", "background", "kag:bg"), ("tlg", "png", "jpg")),
    (("voice", "bgm", "sound", "playse", "audio"), ("ogg", "opus", "wav")),
    (("movie", "video"), ("mpg", "mp4", "wmv")),
)
ANY_STORAGE = ("tjs", "ks", "tlg", "png", "ogg", "opus")
# How far neighbouring numbers reach, and the longest number, name and value.
RADIUS, MAX_DIGITS, MAX_NAME, MAX_VALUE = 128, 6, 240, 1024


def neighbours(df: DataFrame, name_col: str, radius: int = RADIUS) -> DataFrame:
    """df's rows times candidate: the names whose last run of digits is another number near by.

    The run is that before the extension, of at most six digits; numbers stay at 0 or more and keep
    their padding. Names without such a run, and null names, give no row.
    """
    file = F.regexp_extract(F.col(f"`{name_col}`"), r"([^/]*)$", 1)
    # Parts are found once a name, before its candidates are laid out; a name has so many that few short rows need many tasks.
    found = spread(df).select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.regexp_extract(file, r"^(.+?)(\.[^.]+)?$", 1).alias("stem"), F.regexp_extract(file, r"^(.+?)(\.[^.]+)?$", 2).alias("suffix"),
    )
    cut_up = found.select(
        "row", F.regexp_extract("stem", r"^(.*?)[0-9]+[^0-9]*$", 1).alias("before"), F.regexp_extract("stem", r"([0-9]+)[^0-9]*$", 1).alias("digits"),
        F.concat(F.regexp_extract("stem", r"([^0-9]*)$", 1), "suffix").alias("after"),
    ).where(F.length("digits").between(1, MAX_DIGITS))
    value = F.col("digits").cast("long")
    near = F.array_except(F.sequence(F.greatest(value - radius, F.lit(0)), value + radius), F.array(value))
    each = cut_up.select("row", "before", "after", F.length("digits").alias("width"), F.explode(near).alias("number"))
    plain = F.col("number").cast("string")
    number = F.when(F.length(plain) < F.col("width"), F.lpad(plain, F.col("width"), F.lit("0"))).otherwise(plain)
    return each.select("row.*", F.concat("before", number, "after").alias("candidate"))


def candidates(df: DataFrame, value_col: str, context_col: str) -> DataFrame:
    """df's rows times candidate: the names that a reference in a script may stand for.

    A value is cleaned of schemes, leading `./`, queries and fragments; it, its part behind `>`, its
    form without a leading `/` and the last part of each are candidates, and where one has no
    extension, those that the context hints at. Null, implausible and over-long values give no row.
    """
    value = F.translate(F.regexp_replace(F.col(value_col), r"^[\s\x00]+|[\s\x00]+$", ""), "\\", "/")
    clean = F.regexp_replace(F.regexp_replace(value, r"^(\./)+", ""), r"(?i)^(file://)?(storage://)?", "")
    clean = F.regexp_replace(clean, r"(?s)[?#].*$", "")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.where((F.length(value) > 0) & (F.octet_length(value) <= MAX_VALUE)).select(row, F.col(f"`{context_col}`").alias("context"), clean.alias("clean"))
    bases = F.array(F.col("clean"), F.regexp_extract("clean", r"(?s)^.*>(.+)$", 1), F.regexp_extract("clean", r"(?s)^/(.+)$", 1))
    stripped = F.transform(bases, lambda b: F.regexp_replace(F.trim(b), r"^[\"'\[\]{}]+|[\"'\[\]{}]+$", ""))
    rows = rows.select("row", "context", F.explode(F.array_distinct(stripped)).alias("base"))
    base = F.col("base")
    plausible = (F.length(base) > 0) & (F.length(base) <= MAX_NAME) & ~base.rlike(r"\p{Cc}") & ~F.lower(base).isin("true", "false", "null", "void")
    rows = rows.where(plausible & base.rlike(r"[./>]|^[\p{L}\p{N}_+@~ \-]+$"))
    context = F.lower(F.coalesce("context", F.lit("")))
    none = F.array().cast("array<string>")
    hints = F.concat(*[F.when(F.greatest(*[context.contains(w) for w in words]), F.array(*map(F.lit, exts))).otherwise(none) for words, exts in HINTS])
    hints = F.when((F.size(hints) == 0) & context.contains("storage"), F.array(*map(F.lit, ANY_STORAGE))).otherwise(hints)
    last = F.regexp_extract(base, r"([^/]*)$", 1)
    bare = ~last.rlike(r"^.+\.[^.]{1,8}$")
    more = F.when(bare, F.transform(hints, lambda e: F.concat(base, F.lit("."), e))).otherwise(none)
    found = F.array_distinct(F.concat(F.filter(F.array(base, last), lambda c: c != ""), more))
    return rows.select("row.*", F.explode(found).alias("candidate"))


def bounded_sample(df: DataFrame, size_col: str, order: list[str], most: int, most_size: int) -> DataFrame:
    """The smallest rows, at most `most` of them and of `most_size` together (ties by `order`).

    Only the top `most` rows meet in one task. A row that does not fit has no later one that does, as
    sizes rise.
    """
    keys = [F.col(size_col), *map(F.col, order)]
    top = df.where(F.col(size_col).isNotNull()).orderBy(*keys).limit(most)
    reach = F.sum(size_col).over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return top.select(row, reach.alias("reach")).where(F.col("reach") <= most_size).select("row.*")
