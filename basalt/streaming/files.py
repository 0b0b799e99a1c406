"""A stream of files, some at a time, and the integrity of the entries of those that are containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import container

# Files and bytes that one batch takes at most.
BATCH_FILES, BATCH_BYTES = 64, "512m"
BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, glob: str = "*", most_files: int = BATCH_FILES) -> DataFrame:
    """(archive_id, content) of files as they appear under a folder, at most `most_files` a batch."""
    read = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", most_files)
    return read.load(path).select(F.col("path").alias("archive_id"), "content")


def integrity(containers: DataFrame) -> DataFrame:
    """archive_id, entry_no, name, n_bytes, sha256, adler_ok, error of each entry; the same for a table or a stream."""
    found = container.contents(containers)
    return found.select("archive_id", "entry_no", "name", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "adler_ok", "error")


def write_integrity(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Reads all files that are there and ends. The checkpoint makes reruns go on where they were stopped."""
    return integrity(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
