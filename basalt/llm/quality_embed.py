"""Quality scores by supervised subword embeddings.

A document is the mean of learned vectors: one for each word and each of its character n-grams
(hashed), and one for whether the word was among the few before it. A softmax over a linear layer
gives the classes. Vectors and layer are learned by stochastic gradient descent in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GramBuckets, WordIds, slices, text_bytes
from .sampling import fold, labelled_texts

BUCKETS, WIDTH = 1 << 14, 8
GRAMS = (3, 4)
LOOK_BACK = 8
SEEN, NEW = BUCKETS, BUCKETS + 1
#: Bounds of the sample that the model is fitted to.
PER_CLASS, MAX_CHARS = 1500, 20_000


_buckets = GramBuckets(BUCKETS)


def grams_of(word: bytes) -> list[int]:
    """Buckets of a word: itself and its character n-grams, with marks at both ends."""
    marked = f"<{word.decode('utf-8', 'replace')}>"
    out = [zlib.crc32(b"w" + word) % BUCKETS]
    for n in GRAMS:
        out += [_buckets[marked[i : i + n]] for i in range(len(marked) - n + 1)]
    return out


def repeats(ids: np.ndarray) -> int:
    """Words equal to one of the LOOK_BACK words before them."""
    seen = np.zeros(len(ids), bool)
    for k in range(1, min(LOOK_BACK, len(ids) - 1) + 1):
        seen[k:] |= ids[k:] == ids[:-k]
    return int(seen.sum())


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares; a text without words has none."""
    words = text_bytes(text).split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    counts = np.bincount(ids)
    grams = [grams_of(w) for w in numbers]
    flat = np.concatenate([np.array(g) for g in grams] + [np.array([SEEN, NEW])])
    weight = np.concatenate([np.repeat(counts, [len(g) for g in grams]), [repeats(ids), len(ids) - repeats(ids)]]).astype(float)
    buckets, place = np.unique(flat, return_inverse=True)
    shares = np.bincount(place, weights=weight)
    return buckets, shares / shares.sum()


@dataclass
class Embeddings:
    vectors: np.ndarray  # (BUCKETS + 2, WIDTH)
    layer: np.ndarray  # (WIDTH, classes)
    bias: np.ndarray

    def scores(self, text: str | None) -> np.ndarray:
        buckets, shares = bag(text)
        z = (shares @ self.vectors[buckets]) @ self.layer + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()


def fit(rows: list[tuple[str, int]], classes: int = 2, epochs: int = 8, rate: float = 0.5, seed: int = 1) -> Embeddings:
    """Learn from (text, class). Without rows, or with one class, all scores are uniform."""
    rng = np.random.default_rng(seed)
    m = Embeddings(rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS + 2, WIDTH)), np.zeros((WIDTH, classes)), np.zeros(classes))
    if len({c for _, c in rows}) < 2:
        return m
    bags = [(*bag(t), c) for t, c in rows]
    bags = [b for b in bags if len(b[0])]
    share = np.bincount([c for *_, c in bags], minlength=classes)
    weight = len(bags) / (classes * np.maximum(share, 1))  # classes count alike
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            buckets, shares, c = bags[i]
            now = rate * (1 - done / steps)
            done += 1
            rows_ = m.vectors[buckets]
            hidden = shares @ rows_
            z = hidden @ m.layer + m.bias
            e = np.exp(z - z.max())
            error = e / e.sum()
            error[c] -= 1
            error *= weight[c]
            back = m.layer @ error
            m.layer -= now * np.outer(hidden, error)
            m.bias -= 0.1 * now * error
            # Vectors of a mean move by the document's whole step, shared by how often they occur.
            m.vectors[buckets] -= now * np.outer(shares / max(shares @ shares, 1e-9) * 0.1, back)
    return m


class _Scorer:
    """Values of the buckets; the words met stay for the next tasks of the same worker."""

    def __init__(self, values: np.ndarray):
        self.values, self.words = values, None

    def started(self) -> WordIds:
        listed = self.values.tolist()

        def figures(word: bytes) -> tuple[float, int]:
            grams = grams_of(word)
            return sum(map(listed.__getitem__, grams)), len(grams)

        if self.words is None:
            self.words = WordIds(figures, 2)
        return self.words


def scored(docs: DataFrame, model: Embeddings, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (probability of class 1) of each row of docs; two classes.

    Words that a task has met before cost one look-up: a document's score needs only sums over
    words, whatever its length. Null and empty texts score by the bias alone. Equal texts score
    equally; other columns are not read; an empty table gives an empty result.
    """
    slope = model.layer[:, 1] - model.layer[:, 0]
    values = model.vectors @ slope
    bias = float(model.bias[1] - model.bias[0])
    shared = docs.sparkSession.sparkContext.broadcast(_Scorer(values))  # BUCKETS + 2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, words = shared.value.values, shared.value.started()
        for whole in batches:
            for batch in slices(whole):
                out = []
                for text in batch.column("text").to_pylist():
                    ids = words.ids(text_bytes(text).split())
                    total = 0.0
                    if len(ids):
                        again = repeats(ids)
                        sums = words.table[ids].sum(axis=0)
                        total = (sums[0] + again * values[SEEN] + (len(ids) - again) * values[NEW]) / (sums[1] + len(ids))
                    out.append(1 / (1 + np.exp(-np.clip(total + bias, -30, 30))))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"{id_col} long, score double"
    )


def quality_scores(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. labels: doc_id, quality.

    Labels are learned only from documents whose id has fold(id, 3) other than 1, a sample of at
    most per_class a class. A null id is not held out.
    """
    rows = labelled_texts(
        docs, labels.where(fold("doc_id", 3) != 1), label_col="quality", classes=[0, 1], per_class=per_class, max_chars=max_chars
    )
    out = scored(docs, fit(rows))
    return out.select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
