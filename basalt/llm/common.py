"""What several training-data operators share: cutting lineage and bounded word caches."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import cut, ensure_checkpoint_dir  # noqa: F401

#: The six ASCII white-space characters that part words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = "[ \\t\\n\\x0B\\f\\r]+"


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints that nothing refers to any more.

    Its cleaner acts on what the driver's garbage collector has found, which may be long after an
    iteration has left its files on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words_of(text: Column) -> Column:
    """The words of a text (runs of anything but ASCII white space); none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def with_columns(batch: pa.RecordBatch, schema: pa.Schema, **new: Iterable) -> pa.RecordBatch:
    """The batch's own columns as far as the schema names them, then the new ones."""
    arrays = [
        pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name).cast(f.type) for f in schema
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch, so that what Python makes of one piece stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


_worker_caches: list[dict] = []


def worker_cache(cache: dict) -> dict:
    """A cache that stays for the next tasks of a Python worker, until another operator works there."""
    _worker_caches.append(cache)
    return cache


def alone(cache: dict) -> None:
    """Empties what other operators have left in this worker's caches, so that these never add up."""
    for other in _worker_caches:
        if other is not cache:
            other.clear()


class GramBuckets(dict):
    """Hashed buckets of character n-grams; bounded, as a forgotten one is hashed again."""

    def __init__(self, buckets: int, limit: int = 200_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def __missing__(self, gram: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[gram] = zlib.crc32(gram.encode("utf-8", "replace")) % self.buckets
        return value


class WordIds(dict):
    """Numbers words as they come and keeps a row of figures for each.

    figures(word) gives the row. When `limit` words are held all are forgotten, so memory is
    bounded whatever the vocabulary; a forgotten word is merely computed again. Call reserve()
    before a text: ids stay valid until the next reserve().
    """

    def __init__(self, figures, width: int, limit: int = 200_000):
        super().__init__()
        self.figures, self.limit = figures, limit
        self.table = np.zeros((1024, width))

    def reserve(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.table = np.zeros((1024, self.table.shape[1]))

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = self.figures(word)
        self[word] = n
        return n

    def ids(self, words: list[bytes]) -> np.ndarray:
        self.reserve()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))
