"""URL verdicts: host and path rules, and beyond them a ratio of character language models.

Rules label a part of the URLs. From those, two variable-order Markov models are smoothed and
learned, one for accepted and one for rejected URLs. A URL without a rule is allowed if its
log-likelihood difference per character is above a threshold calibrated on labelled URLs that the
models have not seen. Everything is DataFrame functions; the models are one table of all n-grams,
which the n-grams of the URLs are joined to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

#: Longest context, in characters.
ORDER = 4
#: Log ratios are added as whole numbers of this part of one, so that the order does not matter.
UNIT = 1e-9
#: Rows of window values that are broadcast; beyond them a join with SALTS parts of each is used.
BROADCAST_ROWS, SALTS = 20_000, 16
#: Weight of the shorter context's estimate, in observations; characters of the base alphabet.
PRIOR, ALPHABET = 2.0, 96.0


@dataclass(frozen=True)
class Rule:
    """A host suffix with the start of a path, as in example.com/en/."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The rule that fits, as a struct (rule, verdict); the longest wins, then the first by name."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.pattern).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    empty = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return empty if out is None else out.otherwise(empty)


def _characters(text: Column) -> Column:
    """The characters of a text, so that pieces are cut without walking through it each time."""
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def _grams(text: Column, longest: int) -> Column:
    """All substrings of up to `longest` characters that end at each character of text."""
    ends = lambda c: F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1)))
    piece = lambda c, e, n: F.array_join(F.slice(c, e - n + 1, n), "")
    return let(
        _characters(text),
        lambda c: F.flatten(F.transform(ends(c), lambda e: F.transform(F.sequence(F.lit(1), F.least(e, F.lit(longest))), lambda n: piece(c, e, n)))),
    )


def _model(urls: DataFrame) -> DataFrame:
    """gram, yes and no: the log-likelihoods, in UNITs, that the models of accepted and of rejected URLs
    give the last character of every n-gram seen after the others.

    urls: text, accepted. An n-gram's estimate in a model is (its count + PRIOR * the estimate of
    the n-gram without its first character) / (count of its context + PRIOR), so longer contexts
    count as far as they have been seen.
    """
    grams = (
        urls.select("accepted", F.explode(_grams(F.col("text"), ORDER + 1)).alias("gram"))
        .groupBy("gram")
        .agg(
            F.sum(F.col("accepted").cast("long")).alias("yes"),
            F.sum((~F.col("accepted")).cast("long")).alias("no"),
        )
    )
    grams = cut(grams.withColumn("size", F.length("gram")))
    totals = grams.where("size = 1").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    known = grams.where("size = 1").withColumn("t", totals.select(F.struct("*")).scalar())
    level = known.select(
        "gram",
        "yes",
        "no",
        ((F.col("yes") + PRIOR / ALPHABET) / (F.col("t.all_yes") + PRIOR)).alias("p_yes"),
        ((F.col("no") + PRIOR / ALPHABET) / (F.col("t.all_no") + PRIOR)).alias("p_no"),
    )
    levels = [level]
    for n in range(2, ORDER + 2):
        context = levels[-1].select(
            F.col("gram").alias("context"), F.col("yes").alias("c_yes"), F.col("no").alias("c_no")
        )
        shorter = levels[-1].select(F.col("gram").alias("short"), "p_yes", "p_no")
        level = (
            grams.where(F.col("size") == n)
            .select(
                "gram",
                "yes",
                "no",
                F.substring("gram", 1, n - 1).alias("context"),
                F.substring("gram", 2, n - 1).alias("short"),
            )
            .join(context, "context")
            .join(shorter, "short")
            .select(
                "gram",
                "yes",
                "no",
                ((F.col("yes") + PRIOR * F.col("p_yes")) / (F.col("c_yes") + PRIOR)).alias("p_yes"),
                ((F.col("no") + PRIOR * F.col("p_no")) / (F.col("c_no") + PRIOR)).alias("p_no"),
            )
        )
        levels.append(cut(level))
    ratios = levels[0]
    for level in levels[1:]:
        ratios = ratios.union(level)
    return ratios.select("gram", *[F.round(F.log(f"p_{m}") / UNIT).cast("long").alias(m) for m in ("yes", "no")])


def _windows(text: Column) -> Column:
    """For each character of text, the up to ORDER + 1 characters that end there."""
    piece = lambda c, e: F.array_join(F.slice(c, F.greatest(e - ORDER, F.lit(1)), F.least(e, F.lit(ORDER + 1))), "")
    return let(_characters(text), lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), lambda e: piece(c, e)))


def _values(windows: DataFrame, model: DataFrame) -> DataFrame:
    """window, yes, no: the estimates of the longest ending of each distinct window that the model has.

    Endings of each length take the model's value or else that of the ending one shorter, from the
    shortest on; so no key of a join stands for more rows than there are characters. Windows
    without any known ending have 0.
    """
    known = None
    for n in range(1, ORDER + 2):
        endings = windows.where(F.length("window") >= n).select(F.expr(f"substring(window, -{n}, {n})").alias("gram")).distinct()
        found = endings.join(model, "gram", "left")
        if known is None:
            shorter = found.select(F.col("gram").alias("window"), *[F.coalesce(m, F.lit(0)).alias(m) for m in ("yes", "no")])
        else:
            below = shorter.select(F.col("window").alias("short"), F.col("yes").alias("s_yes"), F.col("no").alias("s_no"))
            joined = found.withColumn("short", F.expr(f"substring(gram, 2, {n - 1})")).join(below, "short", "left")
            shorter = joined.select(F.col("gram").alias("window"), *[F.coalesce(m, f"s_{m}", F.lit(0)).alias(m) for m in ("yes", "no")])
        shorter = cut(shorter)
        known = shorter if known is None else known.union(shorter)
    return known.join(windows, "window", "left_semi")


def _scores(texts: DataFrame, model: DataFrame) -> DataFrame:
    """text and x, by character how much likelier the model of accepted URLs holds the text.

    texts: distinct, in `text`. Each character counts with the estimates of the longest context
    known; so an n-gram that was not seen backs off. A window that is in most texts is no hot key:
    few windows are broadcast, and of many each stands in SALTS copies.
    """
    parts = texts.where("text <> ''").select("text", F.explode(_windows(F.col("text"))).alias("window"))
    windows = cut(parts.select("window").distinct())
    known = _values(windows, model).select("window", (F.col("yes") - F.col("no")).alias("v"))
    if windows.count() <= BROADCAST_ROWS:
        joined = parts.join(F.broadcast(known), "window", "left")  # at most BROADCAST_ROWS rows
    else:
        copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = parts.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(copies, ["window", "salt"], "left")
    return (
        joined.groupBy("text")
        .agg(F.sum(F.coalesce("v", F.lit(0))).alias("sum"))
        .select("text", (F.col("sum") * UNIT / F.length("text")).alias("x"))
    )


def judged_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score.

    verdict: the rule's, else the models'. host: after the first :// up to / ? # or the end, A-Z
    lower-cased; path: from there up to ? or #. A null URL, or one without ://, has both empty and
    no rule, and scores 0. Where rules label no URL of one kind there is no ratio: all scores are
    0 and URLs without a rule are allowed. Repeated rows are judged alike; other columns are not
    read; an empty table gives an empty result. One labelled URL in four (by hash) is held back
    from the models to calibrate the threshold.
    """
    url = F.col(f"`{url_col}`").cast("string")
    split = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = split.withColumn("m", matched(F.col("host"), F.col("path"), rules)).select(
        "page_id",
        "host",
        "path",
        F.col("m.rule").alias("rule"),
        F.col("m.verdict").alias("given"),
        F.concat("host", "path").alias("text"),
    )
    labelled = ruled.where("given is not null").select((F.col("given") == "allow").alias("accepted"), "text")
    part = F.pmod(F.xxhash64("text"), F.lit(4))
    scores = cut(_scores(ruled.select("text").distinct(), _model(labelled.where(part != 0))))
    held = labelled.where(part == 0).join(scores, "text", "left").select("accepted", F.coalesce("x", F.lit(0.0)).alias("x"))
    stats = {
        r["accepted"]: r
        for r in held.groupBy("accepted").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).collect()
    }
    if len(stats) == 2:
        yes, no = stats[True], stats[False]
        spread = yes["sd"] + no["sd"]
        cutoff = (yes["mean"] * no["sd"] + no["mean"] * yes["sd"]) / spread if spread else (yes["mean"] + no["mean"]) / 2
    else:
        cutoff = None
    return (
        ruled.join(scores, "text", "left")
        .withColumn("score", F.round(F.coalesce("x", F.lit(0.0)) if cutoff is not None else F.lit(0.0), 9))
        .withColumn("verdict", F.coalesce("given", F.when(F.col("score") >= (cutoff if cutoff is not None else -1.0), "allow").otherwise("block")))
        .select("page_id", "host", "path", "rule", "verdict", "score")
    )
