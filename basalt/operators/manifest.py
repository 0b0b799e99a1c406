"""Manifests of containers, and what a rebuilt container keeps of the one it was made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import container

ENTRY_KEYS = ["archive_id", "entry_no"]


def manifest(containers: DataFrame) -> DataFrame:
    """A row for each entry of df(archive_id, content): its name, sizes, checksum, segments and the SHA-256 of
    its content and of what an edit must not change.
    """
    listed = container.entries(container.indexed(containers))
    read = container.contents(containers).where("entry_no is not null").select(*ENTRY_KEYS, F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n_bytes"), "error")
    return listed.withColumn("fixed_sha256", fixed_hash(F.col("preferred_name"), F.col("flags"), F.col("adler"), F.col("segments"))).join(read, ENTRY_KEYS, "left")


def fixed_hash(name: Column, flags: Column, adler: Column, segments: Column) -> Column:
    """SHA-256 of an entry's name, flags, checksum and the flags of its segments in order; sizes and offsets may change."""
    kinds = F.array_join(F.transform(segments, lambda s: s["flags"].cast("string")), ",")
    return F.sha2(F.concat_ws("\n", name, flags.cast("string"), F.coalesce(adler.cast("string"), F.lit("-")), kinds), 256)


def write_manifest(rows: DataFrame, path: str) -> None:
    """Stores a manifest as Parquet, a folder for each archive, so that readers prune by archive."""
    rows.write.partitionBy("archive_id").mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).withColumn("archive_id", F.col("archive_id").cast("string"))


def repartitioned(segments: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, new_size: segments that keep their boundaries under a new length.

    segments: keys, pos, original_size; lengths: keys, length. Growth goes to the last segment, and
    shrinking empties those behind the new end.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    before = F.coalesce(F.sum("original_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lead("pos").over(order).isNull()
    marked = segments.withColumn("_before", before).withColumn("_last", last).join(lengths, keys)
    left = F.greatest(F.col("length") - F.col("_before"), F.lit(0))
    return marked.select(*keys, "pos", F.when(F.col("_last"), left).otherwise(F.least("original_size", left)).alias("new_size"))


def reports(source: DataFrame, rebuilt: DataFrame, edited: DataFrame) -> DataFrame:
    """A row for each entry of either manifest: its checks (name, status), class and whether it passed.

    edited: archive_id, entry_no, lossy: entries that were meant to change. Class: byte_exact where
    content is the same; semantic_exact or lossy for edited ones; unsupported for any other.
    """
    both = source.select(*ENTRY_KEYS, F.struct("preferred_name", "fixed_sha256", "sha256", F.size("segments").alias("n")).alias("s")).join(
        rebuilt.select(*ENTRY_KEYS, F.struct("preferred_name", "fixed_sha256", "sha256", F.size("segments").alias("n")).alias("r")), ENTRY_KEYS, "full_outer"
    )
    all_ = both.join(edited.select(*ENTRY_KEYS, F.lit(True).alias("edited"), "lossy"), ENTRY_KEYS, "left")
    s, r, wanted = F.col("s"), F.col("r"), F.coalesce("edited", F.lit(False))
    same = s["sha256"].eqNullSafe(r["sha256"]) & s.isNotNull() & r.isNotNull()

    def check(name: str, ok: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.when(s.isNull() | r.isNull(), "unsupported").when(ok, "pass").otherwise("fail").alias("status"))

    checks = F.array(
        check("name", s["preferred_name"].eqNullSafe(r["preferred_name"])),
        check("metadata", s["fixed_sha256"].eqNullSafe(r["fixed_sha256"]) | wanted),
        check("segments", s["n"].eqNullSafe(r["n"]) | wanted),
        check("content", same | wanted),
    )
    kind = F.when(same, "byte_exact").when(~wanted, "unsupported").when(F.coalesce("lossy", F.lit(False)), "lossy").otherwise("semantic_exact")
    out = all_.select(*ENTRY_KEYS, checks.alias("checks"), kind.alias("class"))
    return out.withColumn("passed", F.forall("checks", lambda c: c["status"] == "pass"))


def joined_report(manifest_rows: DataFrame, report: DataFrame) -> DataFrame:
    """Manifest entries with their row of a pack report."""
    return manifest_rows.join(report, ENTRY_KEYS, "left")


def with_dimensions(layers: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """layers with the image of their key, and whether its dimensions are those the layer states."""
    sized = images.select(key, F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    agree = F.col("width").eqNullSafe(F.col("image_width")) & F.col("height").eqNullSafe(F.col("image_height"))
    return layers.join(sized, key, "left").withColumn("verified", agree)


def with_resources(references: DataFrame, resources: DataFrame, key: str) -> DataFrame:
    """References (palettes, textures) with the resource of their index; missing ones stay, with nulls."""
    return references.join(resources, key, "left")
