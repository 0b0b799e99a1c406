"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with the follow-the-regularised-leader proximal rule and elastic-net penalties, then
calibrated by one temperature on documents that the fit has not seen. Document frequencies are
counted over all documents that may be learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GramBuckets, WordIds, alone, slices, text_bytes, worker_cache
from .sampling import fold, labelled_texts

BUCKETS = 1 << 13
LONGEST = 3
SCALE = 30.0
PER_CLASS, MAX_CHARS, MAX_LANGS = 500, 5_000, 200
UNKNOWN = "und"


#: A-Z to lower case; every other ASCII character but letters parts words.
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).lower()


def words_in(text: str | None) -> list[bytes]:
    """The words of a whole text: runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return text_bytes(text).translate(LETTERS).split()


_buckets = worker_cache(GramBuckets(BUCKETS))


def _begin() -> None:
    alone(_buckets)


def grams_of(word: bytes) -> np.ndarray:
    """Buckets of the 1- to 3-character n-grams of a word, lower-cased, with a blank at each end."""
    marked = f" {word.decode('utf-8', 'replace').lower()} "
    grams = [marked[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(marked) - n + 1)]
    return np.fromiter(map(_buckets.__getitem__, grams), np.int32, len(grams))


class _Grams(dict):
    """grams_of() the words met; bounded, as a forgotten word is hashed again."""

    def reserve(self) -> None:
        if len(self) > 150_000:
            self.clear()

    def __missing__(self, word: bytes) -> np.ndarray:
        grams = self[word] = grams_of(word)
        return grams


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all docs each bucket occurs, and how many docs there are.

    Each task counts into an array of BUCKETS numbers; the driver gets their BUCKETS sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        cache = _Grams()
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for whole in batches:
            for batch in slices(whole):
                for text in batch.column("text").to_pylist():
                    n += 1
                    words = set(words_in(text))
                    if not words:
                        continue
                    cache.reserve()
                    flags = np.zeros(BUCKETS, bool)
                    flags[np.concatenate(list(map(cache.__getitem__, words)))] = True
                    df[:BUCKETS] += flags
        df[BUCKETS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1, dtype=np.int32)), pa.array(df)], names=["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out[:BUCKETS], int(out[BUCKETS])


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, langs), already times idf and SCALE
    bias: np.ndarray
    temperature: float
    words: WordIds | None = None  # stays for the next tasks of the same worker

    def started(self) -> WordIds:
        if self.words is None:
            ones = np.ascontiguousarray(np.column_stack([self.weights, np.ones(BUCKETS)]))
            figures = lambda word: ones.take(grams_of(word), axis=0).sum(axis=0)
            self.words = WordIds(figures, len(self.langs) + 1)
        return self.words

    def logits(self, text: str | None) -> np.ndarray:
        grams = [grams_of(w) for w in words_in(text)]
        n = sum(map(len, grams))
        return (self.weights[np.concatenate(grams)].sum(axis=0) / n if n else 0.0) + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature_of(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature in [0.05, 20] of least mean log loss, by golden section on its logarithm."""
    if not len(classes):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(classes)), classes], 1e-12)).mean()
    low, high, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(
    rows: list[tuple[str, str]],
    df: np.ndarray,
    n_docs: int,
    epochs: int = 3,
    alpha: float = 0.3,
    l1: float = 0.02,
    l2: float = 0.1,
    seed: int = 1,
) -> Model:
    """FTRL-proximal over (text, lang), one document in five kept for the temperature.

    A weight is 0 until the sum of its gradients exceeds l1, so weights are sparse.
    """
    langs = sorted({c for _, c in rows})
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    z, n = np.zeros((BUCKETS + 1, max(len(langs), 1))), np.zeros((BUCKETS + 1, max(len(langs), 1)))

    def weights_at(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((1 + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    bags = []
    for text, lang in rows:
        grams = [grams_of(w) for w in words_in(text)]
        if grams:
            buckets, counts = np.unique(np.concatenate(grams), return_counts=True)
            x = np.append(counts / counts.sum() * idf[buckets] * SCALE, 1.0)
            bags.append((np.append(buckets, BUCKETS), x, langs.index(lang)))
    held = rng.permutation(len(bags)) % 5 == 0
    train = np.flatnonzero(~held)
    for _ in range(epochs):
        for i in rng.permutation(train):
            at, x, c = bags[i]
            w = weights_at(at)
            p = softmax(x @ w)
            p[c] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights_at(slice(None))
    checks = [bags[i] for i in np.flatnonzero(held)]
    logits = np.array([x @ w[at] for at, x, _ in checks]) if checks else np.zeros((0, len(langs)))
    t = temperature_of(logits, np.array([c for *_, c in checks], int))
    return Model(langs, w[:BUCKETS] * (idf * SCALE)[:, None], w[BUCKETS], t)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predicted(docs: DataFrame, model: Model, *, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two columns more, lang_pred and score (its calibrated probability).

    `und` with score 0: the text is null or without a letter, or no language was learned. Columns
    of docs that have the new names are replaced. Equal texts get equal results; repeated rows and
    an empty table need no rule.
    """
    kept = [c for c in docs.columns if c not in (lang, score)]
    table = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = table.withColumn(lang, F.lit("")).withColumn(score, F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x MAX_LANGS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.langs)

        _begin()
        words = model.started()
        for whole in batches:
            for batch in slices(whole):
                names, sure = [], []
                for text in batch.column(text_col).to_pylist():
                    if not k or not has_letter(text):
                        names.append(UNKNOWN)
                        sure.append(0.0)
                        continue
                    ids = words.ids(words_in(text))
                    sums = words.table[ids].sum(axis=0)
                    p = softmax((sums[:k] / max(sums[k], 1) + model.bias) / model.temperature)
                    best = int(p.argmax())
                    names.append(model.langs[best])
                    sure.append(float(p[best]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=[*kept, lang, score]
                )

    return table.mapInArrow(run, schema)


def learned(docs: DataFrame, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """A model from docs (doc_id, text, lang): fold(doc_id, 4) other than 2, lang not null.

    Document frequencies come from all of those, weights from per_class of each language. Raises
    ValueError beyond MAX_LANGS languages.
    """
    usable = docs.where(F.coalesce(fold("doc_id", 4) != 2, F.lit(False)) & F.col("lang").isNotNull())
    langs = sorted(r["lang"] for r in usable.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    rows = labelled_texts(
        usable.select("doc_id", "text"), usable.select("doc_id", "lang"), label_col="lang", classes=langs, per_class=per_class, max_chars=max_chars
    )
    return fit(rows, *frequencies(usable))


def language_table(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score; as learned() and predicted()."""
    out = predicted(docs.select("doc_id", F.col("text").cast("string").alias("text")), learned(docs))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_languages(docs: DataFrame, *, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is predicted with probability `least` or more.

    Where no language can be learned (no label, or only held-out rows), texts with a letter stay.
    docs' own columns only, whatever their names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows, model = docs.select(row, F.col("text").cast("string").alias("text")), learned(docs)
    if not model.langs:
        return rows.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select("row.*")
    marked = predicted(rows, model)
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
