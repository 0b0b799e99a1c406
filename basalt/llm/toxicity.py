"""Toxicity by a weighted lexicon matched with Aho-Corasick over folded text.

Folding lower-cases, takes marks off letters, drops characters without width, maps look-alike
letters of other scripts to Latin ones and digits or signs inside words to the letters they stand
for; letters set apart by blanks are read as a word too. The lexicon's stems match at word starts. Matches
inside exception phrases don't count. The weights found, alone and for each word of the text, go
through a logistic function.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .sampling import fold, labelled_texts

# Look-alike letters and the Latin letters they stand for.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕһԁѵтмнкв" "αβεικνορτυχ" "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ",
    "aeopcyxijshdvtmhkb" "abeiknoptux" "abcdefghijklmnopqrstuvwxyz",
)
# Digits and signs that stand for letters inside words.
DIGITS = str.maketrans("0134578@$!", "oieastba" "si")
EDGES = ".,;:?!\"'()[]{}<>*#%&|-_/\\…«»“”‘’¡¿"

PER_CLASS, MAX_CHARS = 3000, 20_000
SHORTEST, LONGEST_STEM = 3, 12


class Folded(dict):
    """Folded forms of words as UTF-8; bounded, as a forgotten word is folded again."""

    def __missing__(self, word: bytes) -> str:
        if len(self) > 150_000:
            self.clear()
        text = word.decode("utf-8", "replace").lower().translate(HOMOGLYPHS)
        if not text.isascii():  # marks on letters and characters without width
            text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf")).translate(HOMOGLYPHS)
        core = text.strip(EDGES)
        if any(map(str.isalpha, core)):
            core = core.translate(DIGITS)
        self[word] = core
        return core


#: Three or more letters that stand alone.
SPACED = re.compile(r"(?<= )(?:[^\W\d_] ){3,}")


def folded_text(text: str | None, forms: Folded) -> tuple[str, int]:
    """A blank before each folded word and one at the end; and the number of words.

    Letters that stand alone, three or more in a row, follow once more as one word.
    """
    words = text_bytes(text).split()
    line = " " + " ".join(map(forms.__getitem__, words)) + " "
    spaced = [x.replace(" ", "") for x in SPACED.findall(line)]
    return line + " ".join([*spaced, ""]) if spaced else line, len(words)


@dataclass
class Lexicon:
    stems: dict[str, float]  # matched at word starts
    exceptions: set[str] = field(default_factory=set)  # folded phrases, matched as whole words
    layer: tuple[float, float, float] = (2.0, 1.0, -3.0)  # of the sum, the sum by length, and 1
    forms: Folded | None = None  # stays for the next tasks of the same worker

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for stem, weight in self.stems.items():
            found.add_word(" " + stem, (len(stem) + 1, weight))
        for phrase in self.exceptions:
            found.add_word(" " + phrase + " ", (len(phrase) + 2, 0.0))
        if not len(found):
            found.add_word("\0", (1, 0.0))
        found.make_automaton()
        return found


def hits(text: str, automaton) -> tuple[float, int]:
    """Sum of the weights matched outside exception phrases, the heaviest for each word; how many."""
    found, free, reach = {}, [], -1
    for end, (size, weight) in automaton.iter(text):
        start = end - size + 1
        if weight:
            found[start] = max(weight, found.get(start, 0.0))
        else:
            free.append((start, end))
    if free:  # one pass over both in order; reach: where the phrases begun so far end
        free.sort(reverse=True)
        for at in sorted(found):
            while free and free[-1][0] <= at:
                reach = max(reach, free.pop()[1])
            if at < reach:
                del found[at]
    return sum(found.values()), len(found)


def stems_of(texts: list[tuple[str, int]], share: float = 0.0075, sure: float = 3.0) -> dict[str, float]:
    """Stems that `share` of the toxic documents have (four at least), at log odds `sure` or more.

    Of the prefixes of all words, the shortest that is sure, made longer as long as one longer
    prefix has nearly all (95 %) of its toxic documents. The weight is its log odds.
    """
    toxic, clean, size = Counter(), Counter(), [0, 0]
    forms = Folded()
    for text, label in texts:
        size[label] += 1
        words = set(folded_text(text, forms)[0].split())
        prefixes = {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST_STEM) + 1)}
        (toxic if label else clean).update(prefixes)
    least = max(4, share * size[1])
    odds = lambda p: math.log((toxic[p] + 0.5) / (size[1] + 1)) - math.log((clean[p] + 0.5) / (size[0] + 1))
    longer: dict[str, list[str]] = {}
    for p in toxic:
        longer.setdefault(p[:-1], []).append(p)
    good = lambda p: toxic[p] >= least and odds(p) >= sure
    out = {}
    for p in toxic:
        if good(p) and not any(good(p[:k]) for k in range(SHORTEST, len(p))):
            while best := max(longer.get(p, []), key=lambda q: (toxic[q], q), default=""):
                if toxic[best] < 0.95 * toxic[p]:
                    break
                p = best
            out[p] = round(odds(p), 6)
    return out


def exceptions_of(texts: list[tuple[str, int]], stems: dict[str, float], least: int = 3) -> set[str]:
    """Two-word phrases with a matched word that at least `least` clean and no toxic documents have."""
    forms, clean, toxic = Folded(), Counter(), set()
    automaton = Lexicon(stems).automaton()
    for text, label in texts:
        words = folded_text(text, forms)[0].split()
        marked = [i for i, w in enumerate(words) if hits(f" {w} ", automaton)[1]]
        phrases = {" ".join(words[max(i + k, 0) : i + k + 2]) for i in marked for k in (-1, 0)}
        phrases = {p for p in phrases if " " in p}
        if label:
            toxic |= phrases
        else:
            clean.update(phrases)
    return {p for p, n in clean.items() if n >= least and p not in toxic}


def features(total: float, words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100 * total / (words + 20))


def fit(texts: list[tuple[str, int]], exceptions: set[str] = frozenset(), rounds: int = 400) -> Lexicon:
    """Lexicon, exceptions and logistic layer from (text, toxic). Without rows of both: no stems."""
    if len({c for _, c in texts}) < 2:
        return Lexicon({}, set(exceptions))
    stems = stems_of(texts)
    lexicon = Lexicon(stems, set(exceptions) | exceptions_of(texts, stems))
    automaton, forms, rows = lexicon.automaton(), Folded(), []
    for text, _ in texts:
        line, n = folded_text(text, forms)
        rows.append((*features(hits(line, automaton)[0], n), 1.0))
    x, y = np.array(rows), np.array([c for _, c in texts], float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w = np.zeros(3)
    for _ in range(rounds):  # damped Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-3 * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    # More matches never lower a score.
    lexicon.layer = (max(float(w[0]), 0.0), max(float(w[1]), 0.0), float(w[2]))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, n_hits of each row of docs.

    Null and empty texts have no hits and the score of that. Equal texts score equally; other
    columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # stems of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        if lexicon.forms is None:
            lexicon.forms = Folded()
        forms = lexicon.forms
        automaton = lexicon.automaton()
        a, b, c = lexicon.layer
        for whole in batches:
            for batch in slices(whole):
                scores, counts = [], []
                for text in batch.column("text").to_pylist():
                    line, n = folded_text(text, forms)
                    total, k = hits(line, automaton)
                    x, y = features(total, n)
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c)))))
                    counts.append(k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())], names=[id_col, "score", "n_hits"]
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"{id_col} long, score double, n_hits long"
    )


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_hits. labels: doc_id, toxic.

    Labels are learned only from documents whose id has fold(id, 5) other than 0, a sample of at
    most per_class a class. A null id is not held out.
    """
    rows = labelled_texts(
        docs, labels.where(fold("doc_id", 5) != 0), label_col="toxic", classes=[0, 1], per_class=per_class, max_chars=max_chars
    )
    out = scored(docs, fit(rows))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")
