"""Names and identities: resolution by hash, comparison of two versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def resolved(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the name of their key; keys that stand for several names resolve to none."""
    sure = names.groupBy(key).agg(F.min(name).alias(name), F.max(name).alias("other")).where(F.col(name) == F.col("other")).drop("other")
    return rows.join(sure, key, "left")


def matched_sums(left: DataFrame, right: DataFrame, value: str, need: int, modulus: int) -> DataFrame:
    """Pairs of both halves whose values add up to `need` modulo `modulus`: an equi-join on what
    the left half still needs."""
    wanted = left.withColumn("key", F.pmod(F.lit(need) - F.col(value), F.lit(modulus)))
    offered = right.withColumn("key", F.pmod(F.col(value), F.lit(modulus)))
    return wanted.select("key", F.col("id").alias("left_id")).join(offered.select("key", F.col("id").alias("right_id")), "key").drop("key")


def compared(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys and status: missing, added, changed or same, by a full outer join."""
    both = old.select(*keys, F.struct(*fields).alias("a")).join(new.select(*keys, F.struct(*fields).alias("b")), keys, "full_outer")
    return both.select(*keys, status(F.col("a"), F.col("b")).alias("status"))


def status(a: Column, b: Column) -> Column:
    return F.when(b.isNull(), "missing").when(a.isNull(), "added").when(a.eqNullSafe(b), "same").otherwise("changed")


def known_names(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary of names, one a line: name and its hashes (md5, sha256). Blank lines and repeats go."""
    lines = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()
    return lines.withColumn("md5", F.md5("name")).withColumn("sha256", F.sha2("name", 256))


def named_by_two(rows: DataFrame, names: DataFrame, file_key: str, folder_key: str) -> DataFrame:
    """rows with file and folder: names looked up by their own hashes; names: hash, name. Ambiguous hashes give none."""
    sure = names.groupBy("hash").agg(F.min("name").alias("name"), F.max("name").alias("other")).where("name = other").drop("other")
    file = sure.select(F.col("hash").alias(file_key), F.col("name").alias("file"))
    folder = sure.select(F.col("hash").alias(folder_key), F.col("name").alias("folder"))
    return rows.join(file, file_key, "left").join(folder, folder_key, "left")


def alternate_names(entries: DataFrame, names: DataFrame, keys: list[str], name: str) -> DataFrame:
    """entries with the name of their keys (token and checksum); keys with several names have none."""
    sure = names.groupBy(*keys).agg(F.min(name).alias(name), F.max(name).alias("_other")).where(F.col(name) == F.col("_other")).drop("_other")
    return entries.join(sure, keys, "left")


def last_by_id(rows: DataFrame, key: str, order: str, slot: str = "slot") -> DataFrame:
    """One row for each id in slot 0: a later one replaces those before."""
    cols = [c for c in rows.columns if c != key]
    return rows.where(F.col(slot) == 0).groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r")).select(key, "_r.*")


def wanted_only(candidates: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Candidates whose hash is a target's."""
    return candidates.join(targets.select(key).distinct(), key, "left_semi")


def zipped(records: DataFrame, entries: DataFrame, keys: list[str], order: str, matches: Column) -> DataFrame:
    """The n-th record of a group with its n-th entry, and whether they match; `matches` is of r and e."""
    place = Window.partitionBy(*keys).orderBy(order)
    r = records.select(*keys, F.row_number().over(place).alias("n"), F.struct("*").alias("r"))
    e = entries.select(*keys, F.row_number().over(place).alias("n"), F.struct("*").alias("e"))
    return r.join(e, [*keys, "n"], "full_outer").withColumn("matches", F.coalesce(matches, F.lit(False)))


def families(chunks: DataFrame, keys: list[str], own_kind: str, indirect_kinds: list[str]) -> DataFrame:
    """keys, family and what is tried, by the kinds of chunks an archive has."""
    own, indirect = F.bool_or(F.col("kind") == own_kind), F.bool_or(F.col("kind").isin(*indirect_kinds))
    out = chunks.groupBy(*keys).agg(F.coalesce(own, F.lit(False)).alias("own"), F.coalesce(indirect, F.lit(False)).alias("indirect"))
    family = F.when(F.col("own"), "own").when(F.col("indirect"), "indirect").otherwise("standard")
    true = F.lit(True)
    return out.select(
        *keys, family.alias("family"), true.alias("try_plain"), (~F.col("own")).alias("try_shared"), true.alias("try_per_file"),
        F.col("own").alias("try_own_filter"), true.alias("probe_unknown"),
    )


def bootstrapped(texts: DataFrame, targets: DataFrame, start: DataFrame, store: Callable[[DataFrame], DataFrame], rounds: int = 16) -> DataFrame:
    """name, round: the names reached from `start`, round by round, until none is new or `rounds` are over.

    texts: name, mentions (what the file of that name mentions); targets: hash. Each round reads the
    files named in the last one; of what they mention only names whose MD5 is a target stay. `store`
    writes a round's names down and returns them, so that lineage does not grow.
    """
    found = store(start.select("name").distinct().withColumn("round", F.lit(0)))
    last = found
    for n in range(1, rounds + 1):
        met = texts.join(last.select("name"), "name", "left_semi").select(F.explode("mentions").alias("name")).distinct()
        new = wanted_only(met.withColumn("hash", F.md5("name")), targets, "hash").join(found, "name", "left_anti")
        last = store(new.select("name", F.lit(n).alias("round")))
        if last.isEmpty():
            break
        found = store(found.union(last))
    return found
