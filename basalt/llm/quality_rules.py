"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

All of it is DataFrame functions. The votes of all documents are counted by pattern (at most
2 * 3 ** len(RULES) patterns, whatever the input), the two-class model is fitted to those counts,
and each document gets the posterior probability that it is good.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, words_of

#: What is believed beforehand: the share of good documents and, by class (bad, good), how often a
#: rule accuses and praises. It weighs PRIOR_ROWS documents and PRIOR_WEIGHT times the table.
GOOD_SHARE = 0.8
PRIOR = {-1: (0.15, 0.005), 1: (0.5, 0.8)}
PRIOR_ROWS, PRIOR_WEIGHT = 100.0, 0.2
SYMBOLS = "#*$%&|<>"
BREAKS = " \t\n\x0b\x0c\r"
MARKS = "0123456789" + SYMBOLS + ".,;:!?()[]{}'\"-_/\\+=@^~`"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: name, measure, the range that is no fault, the range that votes good. Beyond the first a rule
#: votes bad; within the second it votes good; else it abstains.
RULES = (
    ("length", "n_words", (50, 1e18), (80, 5000)),
    ("symbols", "symbol_rate", (0, 0.25), (0, 0.02)),
    ("repeats", "repeat_rate", (0, 0.4), (0, 0.05)),
    ("lines", "dup_line_rate", (0, 0.4), None),
    ("variety", "variety", (0.12, 1e18), (0.8, 1e18)),
    ("word_length", "mean_word", (2.2, 14), (4.4, 6.5)),
    ("capitals", "capital_rate", (0, 0.4), (0.003, 0.08)),
    ("letters", "letter_share", (0.9, 1), (0.94, 1)),
)


def _removed(text: Column, chars: str) -> Column:
    """How many code points of text are among chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(windows: Column, n_words: Column) -> Column:
    """Words that lie in a window found twice or more; windows: a hash for each start.

    Sorted by (hash, start) equal windows stand together. The starts of those, in order, cover
    three words each, less what the next start covers again.
    """

    def covered(pairs: Column) -> Column:
        twin = lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"])
        starts = F.array_sort(F.transform(F.filter(pairs, lambda p, i: F.coalesce(twin(p, i), F.lit(False))), lambda p: p["i"]))
        return let(
            starts,
            lambda s: F.aggregate(
                F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    return let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)
        ),
    )


def measures(text: Column) -> Column:
    """A struct of the counts of one whole text; null counts as empty.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct, n_lines, n_capitals, n_marks (long).
    Words are runs of anything but ASCII white space. n_dup_lines: lines with a word that equal an
    earlier line. n_repeat_words: words in windows of three words found twice or more.
    Windows are compared by 64-bit hash.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BREAKS, "")) > 0)
    windows = lambda w: F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(text).cast("long") - _removed(text, BREAKS)).alias("word_chars"),
            _removed(text, SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(windows(w), F.size(w)).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
            _removed(text, UPPER).alias("n_capitals"),
            _removed(text, MARKS).alias("n_marks"),
        ),
    )


def votes(m: Column) -> dict[str, Column]:
    """1 (good), -1 (bad) or 0 (abstains) of each rule; m: a struct of measures()."""
    n = F.greatest(m["n_words"], F.lit(1)).cast("double")
    found = {
        "n_words": m["n_words"].cast("double"),
        "symbol_rate": m["n_symbols"] / n,
        "repeat_rate": m["n_repeat_words"] / n,
        "dup_line_rate": m["n_dup_lines"] / (m["n_lines"] + 4),
        "variety": m["n_distinct"] / F.sqrt(n * 60),
        "mean_word": m["word_chars"] / n,
        "capital_rate": m["n_capitals"] / F.greatest(m["word_chars"], F.lit(1)),
        "letter_share": 1 - m["n_marks"] / F.greatest(m["word_chars"], F.lit(1)),
    }
    return {
        name: F.when(~found[by].between(*fair), -1).when(found[by].between(*good) if good else F.lit(False), 1).otherwise(0)
        for name, by, fair, good in RULES
    }


def fit(patterns: list[tuple[tuple[int, ...], bool, int]], rounds: int = 200) -> tuple[float, list[dict]]:
    """Two-class model of vote patterns by expectation-maximisation.

    patterns: (votes, base_failed, documents). Returns the share of good documents among those
    that passed, at least 0.5, so that a text without a vote is kept, and for each rule its odds
    {vote: log P(vote | good) - log P(vote | bad)}; an abstention has none. Texts that failed are
    bad, whatever the votes: they and the priors say which class is which. They count for
    accusations; most are too short to be praised, so how often bad texts are praised is told by
    those that passed. A rule starts as right in no more documents than are bad by the prior
    share, and ends as its votes agree with the class estimates: one that accuses many documents
    on its own loses its weight.
    """
    rules, documents = len(patterns[0][0]) if patterns else len(RULES), sum(n for _, failed, n in patterns if not failed)
    weight, bad = PRIOR_ROWS + PRIOR_WEIGHT * documents, 1 - GOOD_SHARE
    share, odds = GOOD_SHARE, []
    for j in range(rules):
        accused = max(sum(n for v, failed, n in patterns if v[j] == -1 and not failed) / max(documents, 1), 1e-9)
        right = min(0.99, bad / accused)
        odds.append({-1: math.log((1 - right) * bad) - math.log(right * GOOD_SHARE), 0: 0.0, 1: math.log(PRIOR[1][1] / PRIOR[1][0])})
    for _ in range(rounds if patterns else 0):
        prior = (weight * bad, weight * GOOD_SHARE)
        counts = [{v: [m * p for m, p in zip(prior, PRIOR[v])] for v in (-1, 1)} for _ in range(rules)]
        passed, known_bad = list(prior), 0
        for pattern, failed, n in patterns:
            p = 0.0 if failed else posterior(pattern, share, odds)
            known_bad += n if failed else 0
            for c, part in ((1, n * p), (0, n * (1 - p))):
                passed[c] += 0 if failed else part
                for j, v in enumerate(pattern):
                    if v and not (failed and v == 1):
                        counts[j][v][c] += part
        share = max(0.5, passed[1] / sum(passed))
        sums = {-1: (passed[0] + known_bad, passed[1]), 1: tuple(passed)}
        for j in range(rules):
            rate = {v: [counts[j][v][c] / sums[v][c] for c in (0, 1)] for v in (-1, 1)}
            odds[j] = {v: math.log(rate[v][1]) - math.log(rate[v][0]) for v in (-1, 1)} | {0: 0.0}
    return share, odds


def posterior(pattern: tuple[int, ...], share: float, odds: list[dict]) -> float:
    x = math.log(share) - math.log(1 - share) + sum(o[v] for o, v in zip(odds, pattern))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _votes(m: Column) -> Column:
    """A struct of the rules' votes and `failed`, from a struct of measures()."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return F.struct(*[v.cast("byte").alias(k) for k, v in votes(m).items()], failed.alias("failed"))


def _pattern_counts(voted: DataFrame) -> list[tuple[tuple[int, ...], bool, int]]:
    """(votes, base_failed, rows) of the patterns in column v; at most 2 * 3 ** len(RULES) of them."""
    names = [r[0] for r in RULES]
    rows = voted.select("v.*").groupBy(*names, "failed").count().collect()
    return sorted((tuple(r[k] for k in names), r["failed"], r["count"]) for r in rows)


def _judge(voted: DataFrame, patterns) -> DataFrame:
    """voted (with votes in v) and quality, base_failed, kept."""
    share, odds = fit(patterns)
    x = F.lit(math.log(share) - math.log(1 - share))
    for (name, *_), o in zip(RULES, odds):
        x = x + F.when(F.col(f"v.{name}") == 1, o[1]).when(F.col(f"v.{name}") == -1, o[-1]).otherwise(o[0])
    return (
        voted.withColumn("quality", F.round(1 / (1 + F.exp(-x)), 9))
        .withColumn("base_failed", F.col("v.failed"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    )


def quality_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, kept, quality.

    base_failed: fewer than 50 words, or over half of the words repeated. kept: not base_failed
    and quality >= 0.5 (a tie keeps); quality is the posterior by the votes alone. Null and empty
    texts have no words and so fail. Repeated rows are judged alike, each counting in the fit; an
    empty table gives an empty result. Other columns are not read. The model is fitted to all rows
    of docs. Texts are read once: the counts are stored in the checkpoint folder between the fit
    and the verdicts.
    """
    m = measures(F.col(f"`{text_col}`").cast("string"))
    voted = cut(docs.select(F.col(f"`{id_col}`").alias("doc_id"), m.alias("m"))).withColumn("v", _votes(F.col("m")))
    out = _judge(voted, _pattern_counts(voted))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in base], "base_failed", "kept", "quality")


def keep_good(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_table() keeps, with docs' own columns, whatever their names.

    Rows stand in the checkpoint folder with their votes between the fit and the verdicts, so that
    texts are measured once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measured = docs.select(row, measures(F.col(f"`{text_col}`").cast("string")).alias("m"))
    voted = cut(measured.select("row", _votes(F.col("m")).alias("v")))
    return _judge(voted, _pattern_counts(voted)).where("kept").select("row.*")
