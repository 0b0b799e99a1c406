"""Mixing sources to target weights by entropy balancing.

Every document starts with rate 1. Among all rates between 0 and the cap that meet one token
constraint a source, those of least relative entropy to the start are exp(multiplier of its source
* size of the document), cut off at the cap: the tilt is exponential in the document's tokens. The
dual is convex; each Newton iteration sums gradient and Hessian over all documents in one job, for
all sources at once. Rates are rounded to whole copies in blocks, largest documents first, each
block carrying the error in words along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5, 2, 1)
CAP = 3
#: Documents in a rounding block, about; and the most sources that the driver takes.
BLOCK, MAX_SOURCES = 4096, 100_000
#: Copies of one row that are laid out by one task.
CHUNK = 65_536
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> dict[str | None, float]:
    """Each source's target in words: the total shared by weight, at most cap times its size.

    Sources in code point order, null last, weigh 5, 2, 1 and so on again. What a source can't
    take is shared again by weight among those below their cap, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > cap * sizes[s]]
        for s in full or free:
            out[s] = float(cap * sizes[s]) if full else unit * weight[s]
        if not full:
            break
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def multipliers(sizes: DataFrame, facts: dict, cap: int = CAP, rounds: int = 100) -> dict:
    """The dual's solution by source; sizes: source, size, n (documents of that size, size > 0).

    facts: source -> (source_size, target, unit); sizes count in units, so that multipliers stay
    near 1. An iteration is one job: sums by source of the tokens taken and of their slope. Where
    Newton's step leaves the bracket that the signs seen so far leave, or nothing has a slope, the
    bracket is halved (or the step doubled, while it is open). Targets of 0 and of all that the cap
    allows are met by no finite multiplier, and get -inf and inf.
    """
    out = {s: -math.inf if goal <= 0 else math.inf for s, (size, goal, _) in facts.items()}
    now = {s: 0.0 for s, (size, goal, _) in facts.items() if 0 < goal < cap * size * (1 - 1e-12)}
    low, high = dict.fromkeys(now, -math.inf), dict.fromkeys(now, math.inf)
    for _ in range(rounds):
        if not now:
            break
        table = sizes.sparkSession.createDataFrame([(s, m, facts[s][2]) for s, m in now.items()], "key string, multiplier double, unit double")
        table = F.broadcast(table)  # at most MAX_SOURCES rows
        x = F.col("size") / F.col("unit")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("multiplier") * x))
        mass = F.col("n") * F.col("size") * rate
        sums = sizes.join(table, sizes["source"].eqNullSafe(table["key"])).groupBy("source").agg(
            F.sum(mass).alias("mass"), F.sum(F.when(rate < cap, mass * x).otherwise(0.0)).alias("slope")
        )
        for r in sums.collect():  # one row a source
            s, goal = r["source"], facts[r["source"]][1]
            gap = goal - r["mass"]
            if abs(gap) <= 1e-9 * goal:
                out[s] = now.pop(s)
                continue
            (low if gap > 0 else high)[s] = now[s]
            step = now[s] + (gap / r["slope"] if r["slope"] else math.copysign(math.inf, gap))
            if not low[s] < step < high[s] or abs(step - now[s]) > 8:
                ends = math.isfinite(low[s]) and math.isfinite(high[s])
                step = (low[s] + high[s]) / 2 if ends else now[s] + math.copysign(max(1.0, abs(now[s])), gap)
            now[s] = step
    return out | now


def _rounded(cap: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("mark", "ascending")])
        due, whole, extra = 0.0, [], []
        for size, rows, rate in zip(*(table[c].to_pylist() for c in ("size", "rows", "rate"))):
            base = min(cap, math.floor(rate + 1e-9))
            due += max(0.0, rate - base) * size * rows
            k = min(rows, max(0, math.floor(due / size + 0.5))) if size and base < cap and rate - base > 1e-9 else 0
            due -= k * size
            whole.append(base)
            extra.append(k)
        for name, values in (("whole", whole), ("extra", extra)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        yield from table.select(["doc_id", "mark", "source", "size", "rows", "rate", "whole", "extra"]).to_batches()

    return run


def _shares(docs: DataFrame, id_col: str, text_col: str, source_col: str, cap: int) -> DataFrame:
    """doc_id, mark, source, size, rows, rate, whole, extra, source_size, target: a row for each distinct
    (id, text, source). Of its `rows` equal rows, `extra` get a copy more than the others' `whole`.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    sized = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.xxhash64(text).alias("mark"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = cut(sized.groupBy("doc_id", "source", "mark", "size").agg(F.count("*").alias("rows")))
    found = sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("size"), F.count("*").alias("n"), F.sum(F.when(F.col("size") > 0, F.col("rows"))).alias("full")
    )
    found = found.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    goal = targets({r["source"]: r["size"] for r in found}, cap=cap)
    facts = {r["source"]: (r["size"], goal[r["source"]], r["size"] / (r["full"] or 1)) for r in found}
    counted = sized.where("size > 0").groupBy("source", "size").agg(F.sum("rows").alias("n"))
    solved = multipliers(cut(counted), facts, cap) if facts else {}
    table = spark.createDataFrame(
        [(r["source"], *facts[r["source"]], solved[r["source"]], math.ceil(r["n"] / BLOCK)) for r in found],
        "key string, source_size long, target double, unit double, multiplier double, blocks long",
    )
    table = F.broadcast(table)  # at most MAX_SOURCES rows
    tilted = F.least(F.lit(float(cap)), F.exp(F.col("multiplier") * F.col("size") / F.col("unit")))
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("size") == 0, 1.0).otherwise(tilted)
    known = sized.join(table, sized["source"].eqNullSafe(table["key"]))
    blocks = known.select("doc_id", "mark", "source", "size", "rows", rate.alias("rate"), F.pmod(F.xxhash64("doc_id", "mark"), F.col("blocks")).alias("block"))
    rounded = blocks.groupBy("source", "block").applyInArrow(
        _rounded(cap), "doc_id long, mark long, source string, size long, rows long, rate double, whole long, extra long"
    )
    return cut(rounded).join(table.select("key", "source_size", "target"), F.col("source").eqNullSafe(F.col("key"))).drop("key")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, rate, copies, taken.

    size: words of the text (null: 0). taken = copies * size, and copies <= cap. Null is a source
    of its own, the last. Sources without words have target 0 and no copies; documents without
    words in other sources have one. Equal rows (id, text, source) share their copies evenly, some
    a copy more than others. The same rows give the same copies. Ids are whole numbers or null.
    Other columns are not read; an empty table gives an empty result. Raises ValueError beyond
    MAX_SOURCES sources, which the driver holds.
    """
    shares = _shares(docs, id_col, text_col, source_col, cap)
    # Rows of one key are laid out in chunks, so that many equal rows are not one task's.
    chunk = F.expr(f"explode(sequence(0L, (rows - 1) div {CHUNK}L))")
    few = shares.where(F.col("rows") <= CHUNK).withColumn("chunk", F.lit(0).cast("long"))
    many = shares.where(F.col("rows") > CHUNK).withColumn("chunk", chunk).repartition("doc_id", "mark", "chunk")
    number = F.expr(f"explode(sequence(chunk * {CHUNK}L, least(chunk * {CHUNK}L + {CHUNK - 1}L, rows - 1)))")
    rows = few.union(many).withColumn("number", number)
    copies = F.col("whole") + F.when(F.col("number") < F.col("extra"), 1).otherwise(0)
    return rows.select(
        "doc_id", "size", "source", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def take_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with every row repeated as often as mixed() says; docs' own columns only.

    Rows that repeat id, text and source share their copies out evenly, the remainder one each.
    """
    names = docs.columns
    id_col, text_col, source_col = (options.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    counts = _shares(docs, id_col, text_col, source_col, options.get("cap", CAP))
    counts = counts.select("doc_id", "mark", "source", "rows", (F.col("whole") * F.col("rows") + F.col("extra")).alias("copies")).where("copies > 0")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("mark"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
    )
    joined = keyed.join(
        counts, keyed["id"].eqNullSafe(counts["doc_id"]) & (keyed["mark"] == counts["mark"]) & keyed["source"].eqNullSafe(counts["source"])
    ).select("row", "id", keyed["mark"], keyed["source"], F.expr("copies div rows").alias("n"), F.expr("copies % rows").alias("left"))
    # Only rows with a remainder are numbered: in their stored parts, after the rows of earlier parts.
    key = ["id", "mark", "source"]
    some = cut(joined.where("left > 0").withColumn("part", F.spark_partition_id()))
    parts = some.groupBy(*key, "part").agg(F.count("*").alias("here"))
    earlier = F.sum("here").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("part").alias("_part"), F.coalesce(earlier, F.lit(0)).alias("earlier"))
    number = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.lit(0)))
    numbered = some.withColumn("number", number).join(
        parts, (F.col("part") == F.col("_part")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")) & F.col("source").eqNullSafe(F.col("_source"))
    )
    extra = F.when(F.col("earlier") + F.col("number") <= F.col("left"), 1).otherwise(0)
    each = joined.where("left = 0").select("row", "n").union(numbered.select("row", (F.col("n") + extra).alias("n"))).where("n > 0")
    return each.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
