"""Candidate key bytes of a repeating pad: likelihoods, sizes of what is left, orders and verdicts.

All is relational: byte statistics come in as counts, so a stream of any length is at most 256 rows a
slot here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of searches, and the least scores and gaps that prune.
DIRECT_LIMIT, HALF_LIMIT, SOLUTIONS, TOP = 1 << 24, 1 << 20, 4, 8
MIN_TEMPLATE, MIN_SAMPLES, ALPHA = 512, 64, 0.5
GAP_SINGLE, GAP_SEVERAL = 24.0, 12.0
BASELINE, NEAR_BEST = 1 / 256, 0.6
#: Decimal digits that combinations are counted in; beyond them the count is null.
DIGITS = 38


# --- bytes by slot


def slot_histogram(bytes_: DataFrame, keys: list[str], period: Column) -> DataFrame:
    """keys, slot, value, n from rows of offset and value; offsets count from 0."""
    return bytes_.groupBy(*keys, F.pmod("offset", period).alias("slot"), "value").agg(F.count("*").alias("n"))


def key_log_likelihoods(histogram: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slot, key, samples, score: how likely each of the 256 key bytes makes a slot's bytes.

    histogram: keys, slot, value, n. template: keys, value, n, the plain bytes known so far; those of
    fewer than MIN_TEMPLATE bytes score nothing, nor do slots of fewer than MIN_SAMPLES.
    """
    total = template.groupBy(*keys).agg(F.sum("n").alias("total")).where(F.col("total") >= MIN_TEMPLATE)
    every = total.select(*keys, "total", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("plain"))
    seen = template.groupBy(*keys, F.col("value").alias("plain")).agg(F.sum("n").alias("seen"))
    log = F.log((F.coalesce("seen", F.lit(0)) + ALPHA) / (F.col("total") + ALPHA * 256))
    plain = every.join(seen, [*keys, "plain"], "left").select(*keys, "plain", log.alias("log"))
    enough = histogram.groupBy(*keys, "slot").agg(F.sum("n").alias("samples")).where(F.col("samples") >= MIN_SAMPLES)
    each = histogram.join(enough, [*keys, "slot"]).withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(255))))
    each = each.withColumn("plain", F.col("value").bitwiseXOR(F.col("key")).cast("int"))
    scored = each.join(plain, [*keys, "plain"])
    return scored.groupBy(*keys, "slot", "key").agg(F.max("samples").alias("samples"), F.sum(F.col("n") * F.col("log")).alias("score"))


def implied_bytes(slots: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """keys, period, implied: plain bytes that the known slots of a period tell of a stream that long."""
    count = F.when(F.col("slot") < length, 1 + F.floor((length - 1 - F.col("slot")) / F.col("period"))).otherwise(0)
    return slots.groupBy(*keys, "period").agg(F.sum(count).cast("long").alias("implied"))


# --- what is left to search


def allowed_values(choices: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value: values that every one of a slot's constraints allows; choices: keys, constraint, value."""
    sizes = choices.groupBy(*keys).agg(F.countDistinct("constraint").alias("_all"))
    met = choices.groupBy(*keys, "value").agg(F.countDistinct("constraint").alias("_met"))
    return met.join(sizes, keys).where("_met = _all").select(*keys, "value")


def search_size(slots: DataFrame, keys: list[str], direct: int = DIRECT_LIMIT, half: int = HALF_LIMIT) -> DataFrame:
    """keys, used_slots, ambiguous_slots, entropy_bits, combinations, direct_feasible, halves_feasible.

    slots: keys, slot, n (candidates). combinations is null beyond DIGITS digits. The halves are filled
    greedily: slots by size, largest first, each to the half of the smaller product. Sizes alone decide
    that, so a group gathers counts by size (256 at most), not slots.
    """
    by_size = slots.groupBy(*keys, "n").agg(F.count("*").alias("times"))
    packed = by_size.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "n", "times"))).alias("s"))
    sizes = F.col("s")
    total = lambda f: F.aggregate(sizes, F.lit(0.0), lambda a, x: a + f(x))
    used = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x["times"])
    ambiguous = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + F.when(x["n"] > 1, x["times"]).otherwise(0))
    bits = total(lambda x: x["times"] * F.log2(x["n"].cast("double")))
    wide = lambda x: x.cast(f"decimal({DIGITS},0)")
    one = wide(F.lit(1))
    # A product is null once it does not fit; 128 factors of two do not, so no more steps are made.
    times = lambda a, n: wide(F.try_multiply(a, wide(n)))
    steps = lambda x: F.sequence(F.lit(1), F.least(x["times"], F.lit(128).cast("long")))
    product = F.aggregate(
        F.filter(sizes, lambda x: x["n"] > 1), one, lambda a, x: F.aggregate(steps(x), a, lambda b, _: times(b, x["n"]))
    )
    start = F.struct(one.alias("left"), one.alias("right"))
    put = lambda h, n: F.struct(
        F.when(h["left"] <= h["right"], times(h["left"], n)).otherwise(h["left"]).alias("left"),
        F.when(h["left"] <= h["right"], h["right"]).otherwise(times(h["right"], n)).alias("right"),
    )
    halves = F.aggregate(F.filter(sizes, lambda x: x["n"] > 1), start, lambda h, x: F.aggregate(steps(x), h, lambda g, _: put(g, x["n"])))
    out = packed.select(*keys, used.alias("used_slots"), ambiguous.alias("ambiguous_slots"), bits.alias("entropy_bits"), product.alias("combinations"), halves.alias("h"))
    return out.select(
        *keys, "used_slots", "ambiguous_slots", "entropy_bits", "combinations",
        F.coalesce(F.col("combinations") <= direct, F.lit(False)).alias("direct_feasible"),
        F.coalesce((F.col("h.left") <= half) & (F.col("h.right") <= half), F.lit(False)).alias("halves_feasible"),
    )


def halves(slots: DataFrame, keys: list[str]) -> DataFrame:
    """slots with `half` (0 or 1): largest first, each to the half with the smaller sum of logarithms.

    A group's slots (a period's, so at most some thousands) are one value while they are dealt.
    """
    packed = slots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "slot", "n"))).alias("s"))
    none = F.array().cast("array<struct<slot:bigint,n:bigint,half:int>>")
    start = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("right"), none.alias("out"))

    def step(a, x):
        first, cost = a["left"] <= a["right"], F.log2(x["n"].cast("double"))
        row = F.struct(x["slot"].cast("long").alias("slot"), x["n"].cast("long").alias("n"), F.when(first, 0).otherwise(1).alias("half"))
        return F.struct(
            F.when(first, a["left"] + cost).otherwise(a["left"]).alias("left"),
            F.when(first, a["right"]).otherwise(a["right"] + cost).alias("right"),
            F.concat(a["out"], F.array(row)).alias("out"),
        )

    return packed.select(*keys, F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("r")).select(*keys, "r.*")


def enumerated(slots: DataFrame, keys: list[str], limit: int = DIRECT_LIMIT) -> DataFrame:
    """keys and assignment (slot -> value, by slot) for every choice of one value a slot.

    slots: keys, slot, value. Groups of more than `limit` choices give none, so the rows that come out
    are bounded by the caller's limit and not by the data's.
    """
    sets = slots.groupBy(*keys, "slot").agg(F.array_sort(F.collect_set("value")).alias("values"))
    packed = sets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "values"))).alias("s"))
    size = F.aggregate("s", F.lit(1.0), lambda a, x: a * F.size(x["values"]))
    fits = packed.withColumn("size", size).where(F.col("size") <= limit).withColumn("no", F.expr("explode(sequence(0L, cast(size as bigint) - 1))"))
    start = F.struct(F.col("no").alias("rest"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct(
        ((a["rest"] - a["rest"] % F.size(x["values"])) / F.size(x["values"])).cast("long").alias("rest"),
        F.concat(a["out"], F.array(F.element_at(x["values"], (a["rest"] % F.size(x["values"]) + 1).cast("int")).cast("int"))).alias("out"),
    )
    return fits.select(*keys, F.aggregate("s", start, step, lambda a: a["out"]).alias("assignment"))


def change_points(observations: DataFrame, keys: list[str], most_outliers: int) -> DataFrame:
    """keys, split, left_value, right_value, agreements, outliers, rank: one value before, one behind.

    observations: keys, offset, value. Splits are tried at each offset, one behind it, and at 16 and the
    length (column `length`), which bounds no split: offsets may lie beyond it. A side's value is its most frequent, the largest on ties; an empty side
    has the other's. Splits with more outliers than allowed, more than two on a side, or fewer than two
    agreements are left out. Order: most agreements, fewest outliers, the first split. Observations of a
    group come from a few known bytes of one stream, so pairing them with their splits stays small.
    """
    seen = observations.select(*keys, "offset", "value", "length")
    ends = seen.select(*keys, F.explode(F.array(F.col("offset"), F.col("offset") + 1, F.lit(16).cast("long"), F.col("length"))).alias("split")).distinct()
    sides = ends.join(seen, keys).withColumn("behind", F.col("offset") >= F.col("split"))
    counts = sides.groupBy(*keys, "split", "behind", "value").agg(F.count("*").alias("n"))
    modes = counts.groupBy(*keys, "split", "behind").agg(F.max(F.struct("n", "value")).alias("m"), F.sum("n").alias("all"))
    pick = lambda side, c: F.max(F.when(F.col("behind") == side, c))
    both = modes.groupBy(*keys, "split").agg(
        pick(False, F.col("m.value")).alias("l"), pick(True, F.col("m.value")).alias("r"), F.sum("m.n").alias("agreements"),
        F.sum(F.col("all") - F.col("m.n")).alias("outliers"), F.max(F.col("all") - F.col("m.n")).alias("worst"),
    )
    fine = both.where((F.col("outliers") <= most_outliers) & (F.col("worst") <= 2) & (F.col("agreements") >= 2))
    order = Window.partitionBy(*keys).orderBy(F.desc("agreements"), "outliers", "split")
    return fine.select(
        *keys, "split", F.coalesce("l", "r").alias("left_value"), F.coalesce("r", "l").alias("right_value"), "agreements", "outliers"
    ).withColumn("rank", F.row_number().over(order))


# --- orders


def text_order() -> list[Column]:
    """Of candidates by text: conflicts first, then the lag's score."""
    return [F.col("conflict_weight"), F.col("conflicts"), F.desc("score"), F.desc("known_slots"), F.col("period")]


def recovery_order() -> list[Column]:
    """Of candidates over all hypotheses; no entropy counts as infinite."""
    bits = F.coalesce("entropy_bits", F.lit(float("inf")))
    return [F.col("conflict_weight"), F.col("conflicts"), bits, F.desc("known_slots"), F.desc("agreement_weight"), F.desc("agreements"), F.col("period")]


def validated_order() -> list[Column]:
    return [F.col("period"), F.desc("strength"), F.col("combinations").asc_nulls_last()]


def ranked(rows: DataFrame, keys: list[str], order: list[Column], top: int | None = None) -> DataFrame:
    """rows with their rank in their group, and only the first `top`, if given."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out.where(F.col("rank") <= top) if top else out


def fundamental_ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their rank: among consistent periods that score near the best the shortest comes first.

    Near: at least NEAR_BEST of the way from the baseline of random bytes to the best score of a period
    without conflicts. Where no such score is twice the baseline, the rank is that of agreements.
    """
    group = Window.partitionBy(*keys)
    best = F.max(F.when(F.col("conflicts") == 0, F.col("score"))).over(group)
    rows = rows.withColumn("_best", F.coalesce(best, F.lit(float("-inf"))))
    clear, near = F.col("_best") >= 2 * BASELINE, F.col("score") >= BASELINE + (F.col("_best") - BASELINE) * NEAR_BEST
    order = [
        F.col("conflict_weight"), F.col("conflicts"),
        F.when(clear, F.when(near, 0).otherwise(1)).otherwise(0),
        F.when(clear & ~near, -F.col("score")).otherwise(0.0),
        F.when(clear, 0.0).otherwise(-F.col("agreement_weight")),
        F.when(clear, 0).otherwise(-F.col("agreements")), F.col("period"),
    ]
    return rows.withColumn("rank", F.row_number().over(group.orderBy(*order))).drop("_best")


def refined_periods(period: Column, rank: Column, top: int = TOP) -> Column:
    """Whether a period (rank from 0) is worth refining."""
    return (rank < top) | (period <= 64) | (F.bit_count(period) == 1) | (period % 64 == 0)


def probe_order(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with their position; of those with one offset and label only the surest.

    Stricter than dropping neighbours: the same pair is dropped wherever it stands.
    """
    same = Window.partitionBy(*keys, "offset", "label").orderBy(F.desc("confidence"))
    first = probes.withColumn("_k", F.row_number().over(same)).where("_k = 1").drop("_k")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("offset", F.desc("confidence"), "label")))


def first_solutions(rows: DataFrame, keys: list[str], order: list[Column], most: int = SOLUTIONS) -> DataFrame:
    """The first `most` solutions of each group, in a fixed order, so that reruns agree."""
    return ranked(rows, keys, order, most)


def first_hit(rows: DataFrame, keys: list[str], start: str) -> DataFrame:
    """keys and the smallest start that was found."""
    return rows.groupBy(*keys).agg(F.min(start).alias(start))


# --- verdicts


def shared_vote(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tested, strong, accepted from rows of adler_ok (null: no sum) and strong.

    Accepted: no sum differs, at least two agree and at least two formats are strong.
    """
    out = checks.groupBy(*keys).agg(
        F.count("adler_ok").alias("tested"), F.count_if(F.col("strong")).alias("strong"), F.coalesce(F.bool_and("adler_ok"), F.lit(True)).alias("agree")
    )
    return out.select(*keys, "tested", "strong", (F.col("agree") & (F.col("tested") >= 2) & (F.col("strong") >= 2)).alias("accepted"))


def key_verdict(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tested, matched, strong, verdict from rows of readable, adler_ok and strong.

    Unreadable rows do not count. A sum that differs rejects; all agreeing with one strong format
    accepts, and so do two strong formats where there are no sums; else it stays open.
    """
    read = checks.groupBy(*keys).agg(
        F.count(F.when(F.col("readable"), F.col("adler_ok"))).alias("tested"),
        F.count_if(F.col("readable") & F.coalesce("adler_ok", F.lit(False))).alias("matched"),
        F.count_if(F.col("readable") & F.col("strong")).alias("strong"),
    )
    t, m, s = F.col("tested"), F.col("matched"), F.col("strong")
    verdict = F.when(m < t, "rejected").when((t > 0) & (s >= 1), "accepted").when((t == 0) & (s >= 2), "accepted").otherwise("open")
    return read.withColumn("verdict", verdict)


def most_frequent(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, zeros: the most frequent value (the smallest on ties) and how many are zero."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col(value)).alias("order"))).alias("b")
    out = counts.groupBy(*keys).agg(best, F.sum(F.when(F.col(value) == 0, F.col("n")).otherwise(0)).alias("zeros"))
    return out.select(*keys, (-F.col("b.order")).alias(value), F.col("b.n").alias("n"), "zeros")


def state_counts(rows: DataFrame, keys: list[str], state: str, states: list[str]) -> DataFrame:
    """keys and a column for each state with its count, in one pass."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states])
