"""Functions of byte strings: checksums, histograms, entropy, coincidence at a lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOD = 65521
#: Bytes that are widened to numbers at once.
BLOCK = 1 << 16


def payload(text: str) -> Column:
    """A text column as UTF-8 bytes; null as no bytes."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def xor_repeating(data: bytes, key: bytes, offset: int = 0) -> bytes:
    """data XOR the key repeated from stream position `offset`; an empty key changes nothing."""
    if not key or not data:
        return data
    a = np.frombuffer(data, np.uint8)
    return (a ^ np.frombuffer(key, np.uint8)[(offset + np.arange(len(a))) % len(key)]).tobytes()


def adler32(data: bytes) -> int:
    """Adler-32 in closed form, block by block: of n bytes d, b grows by n a + sum (n - i) d and a by sum d, both
    modulo 65521.
    """
    a, b, whole = 1, 0, np.frombuffer(data, np.uint8)
    for start in range(0, len(whole), BLOCK):
        d = whole[start : start + BLOCK].astype(np.int64)
        b = (b + len(d) * a + int((np.arange(len(d), 0, -1) * d).sum())) % MOD
        a = (a + int(d.sum())) % MOD
    return b << 16 | a


def counted(data: bytes) -> np.ndarray:
    """How often each of the 256 bytes is there."""
    whole, out = np.frombuffer(data, np.uint8), np.zeros(256, np.int64)
    for start in range(0, len(whole), BLOCK):
        out += np.bincount(whole[start : start + BLOCK], minlength=256)
    return out


def entropy(data: bytes) -> float:
    """Shannon entropy in bits a byte; 0 for no bytes."""
    n = counted(data)
    p = n[n > 0] / max(len(data), 1)
    return float(-(p * np.log2(p)).sum()) + 0.0


def coincidence(data: bytes, lag: int) -> tuple[int, int]:
    """Equal and all pairs of bytes at a lag."""
    a = np.frombuffer(data, np.uint8)
    total = max(len(a) - lag, 0)
    return (int((a[lag:] == a[:total]).sum()) if total else 0), total


# The bytes that entropy is taken of, and what is dense.
ENTROPY_BYTES, DENSE_LEAST, DENSE_BITS = 8192, 256, 7.65


def byte_facts(df: DataFrame, id_col: str, bytes_col: Column, wanted: tuple[str, ...] = ("adler32", "entropy", "dense")) -> DataFrame:
    """id, n_bytes and of adler32, entropy (of the first 8192 bytes) and dense (7.65 bits or more of 256 bytes at
    least) those that are wanted; only they are computed.
    """
    kinds = {"adler32": "long", "entropy": "double", "dense": "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: copied(batch, c) for c in ("id", "n_bytes")}
            if "adler32" in wanted:
                out["adler32"] = pa.array([adler32(b) for b in values(batch, "data")], pa.int64())
            if "entropy" in wanted or "dense" in wanted:
                bits = [entropy(b[:ENTROPY_BYTES]) for b in values(batch, "data")]
                out["entropy"] = pa.array(bits, pa.float64())
                out["dense"] = pa.array([n >= DENSE_LEAST and x >= DENSE_BITS for n, x in zip(out["n_bytes"].to_pylist(), bits)], pa.bool_())
            names = ["id", "n_bytes", *wanted]
            del batch
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([out[c] for c in names], names=names)

    schema = "id long, n_bytes long, " + ", ".join(f"{c} {kinds[c]}" for c in wanted)
    # Only Adler-32 is of all bytes: without it, Python gets no more of them than entropy is taken of.
    data = bytes_col if "adler32" in wanted else F.substring(bytes_col, 1, ENTROPY_BYTES)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.octet_length(bytes_col).cast("long").alias("n_bytes"), data.alias("data"))
    return rows.mapInArrow(run, schema)


def copied(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A column that does not keep its batch's bytes: all columns of a batch are parts of one buffer."""
    return pa.array(batch.column(column).to_pylist(), batch.schema.field(column).type)


def values(batch: pa.RecordBatch, column: str) -> Iterator[memoryview]:
    """The byte strings of a column, one after another and not copied; null as no bytes."""
    for value in batch.column(column):
        yield memoryview(value.as_buffer() if value.is_valid else b"")


def histogram(df: DataFrame, bytes_col: Column) -> DataFrame:
    """byte, n over all rows: each task sums into 256 counters before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256, np.int64)
        for batch in batches:
            for b in values(batch, "data"):
                counts += counted(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(counts)], names=["byte", "n"])

    return df.select(bytes_col.alias("data")).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).where("n > 0")


def lag_scores(df: DataFrame, bytes_col: Column, lags: range, prior: int = 512) -> DataFrame:
    """lag, equal, total, score over all rows; score is the equal share with `prior` pairs at 1/256."""
    steps = list(lags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(steps), 2), np.int64)
        for batch in batches:
            for b in values(batch, "data"):
                sums += [coincidence(b, k) for k in steps]
        yield pa.RecordBatch.from_arrays(
            [pa.array(steps, pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["lag", "equal", "total"]
        )

    out = df.select(bytes_col.alias("data")).mapInArrow(run, "lag int, equal long, total long")
    out = out.groupBy("lag").agg(F.sum("equal").alias("equal"), F.sum("total").alias("total"))
    return out.withColumn("score", (F.col("equal") + prior / 256) / (F.col("total") + prior))
