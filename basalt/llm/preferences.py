"""Preference formatting: one prompt, and a chosen and a rejected completion with loss masks.

The prompt is the longest common prefix of turns of the two conversations, rendered once. The
completions are what follows, with run lengths that say which characters are trained on: the texts
of assistant turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

ASSISTANT = "assistant"


def conversations_of(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id and turns, an array of (role, text) by turn number, then role and text.

    Null roles and texts count as empty, a null turn number comes first; rows without an id belong
    to no conversation; repeated rows are turns of their own. One conversation is one value of the
    result, as one document is. Other columns are not read.
    """
    ident, turn, role, text = (F.col(f"`{c}`") for c in (id_col, turn_col, role_col, text_col))
    clean = turns.where(ident.isNotNull()).select(
        ident.alias("id"),
        F.struct(
            turn.alias("turn"),
            F.coalesce(role.cast("string"), F.lit("")).alias("role"),
            F.coalesce(text.cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = F.array_sort(F.collect_list("t"))
    return clean.groupBy("id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns of two arrays are equal."""
    shorter = F.least(F.size(a), F.size(b))
    return F.when(shorter == 0, 0).otherwise(
        F.coalesce(
            F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(shorter - 1, F.lit(0))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))),
            shorter,
        )
    )


def escaped(turns: Column) -> Column:
    """turns in which no text or role holds a turn's mark: `<|` becomes `<\\|`, and `<\\` becomes `<\\\\`."""
    safe = lambda c: F.regexp_replace(c, r"<([|\\])", r"<\\$1")
    return F.transform(turns, lambda t: F.struct(safe(t["role"]).alias("role"), safe(t["text"]).alias("text")))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def mask_of(turns: Column) -> Column:
    """Runs (length, trained) over the rendered turns: heads and line ends are never trained on."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct((F.length(t["role"]) + 5).alias("length"), F.lit(False).alias("trained")),
                F.struct(F.length(t["text"]).alias("length"), (t["role"] == ASSISTANT).alias("trained")),
                F.struct(F.lit(1).alias("length"), F.lit(False).alias("trained")),
            ),
        )
    )


def formatted(pairs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, kind, prompt_turns, prompt, chosen, rejected and the masks.

    pairs: chosen_id, rejected_id, a and b (arrays of turns). kind: `pair`; `prefix` where one
    conversation goes on from the end of the other, whose completion is then empty; `identical`
    where both completions are empty; `alone` where b is null: the prompt is then all before the
    last run of assistant turns, and rejected is null. Marks inside texts are escaped().
    """
    last_other = lambda a: F.coalesce(
        F.array_max(F.transform(a, lambda t, i: F.when(t["role"] != ASSISTANT, i + 1))), F.lit(0)
    )
    n = F.when(F.col("b").isNull(), last_other(F.col("a"))).otherwise(common_turns(F.col("a"), F.col("b")))
    safe = [F.when(F.col(c).isNotNull(), escaped(F.col(c))).alias(c) for c in ("a", "b")]
    cut_at = pairs.select("chosen_id", "rejected_id", *safe, n.alias("n"))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c), F.lit(0)))
    both = cut_at.select(
        "chosen_id", "rejected_id", F.col("n").alias("prompt_turns"),
        F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("c"), rest("b").alias("r"),
    )
    empty = (F.size("c") == 0).cast("int") + (F.size("r") == 0).cast("int")
    kind = F.when(F.col("r").isNull(), "alone").when(empty == 2, "identical").when(empty == 1, "prefix").otherwise("pair")
    return both.select(
        "chosen_id", "rejected_id", kind.alias("kind"), "prompt_turns", rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), mask_of(F.col("c")).alias("chosen_mask"),
        rendered(F.col("r")).alias("rejected"), mask_of(F.col("r")).alias("rejected_mask"),
    )


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, said and path: for each turn a hash of all turns up to it."""
    for whole in batches:
        for batch in slices(whole):
            paths = []
            for hashes in batch.column("hashes").to_pylist():
                path, before = [], 0
                for h in hashes:
                    before = hash((before, h))  # of whole numbers only, so the same in every process
                    path.append(before)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("said"), pa.array(paths, pa.list_(pa.int64()))], names=["id", "said", "path"])


def _neighbours(light: DataFrame) -> DataFrame:
    """light (id, said, first, path) with the next row's other and other_said, and before, the id of the
    last row, by path and id, as far as those have the same first.

    Rows are dealt by ranges, so a group of any size is spread; what stands at the ends of a range
    (a row for each, on the driver) is handed to the next.
    """
    dealt = cut(light.repartitionByRange("first", "path", "id").withColumn("range", F.spark_partition_id()))
    place, row = F.struct("first", "path", "id"), F.struct("id", "said", "first")
    ends = dealt.groupBy("range").agg(F.min_by(row, place).alias("low"), F.max_by(row, place).alias("high")).orderBy("range").collect()
    edges = [
        (e["range"], *(tuple(ends[k + 1]["low"]) if k + 1 < len(ends) else (None,) * 3), *((ends[k - 1]["high"]["id"], ends[k - 1]["high"]["first"]) if k else (None,) * 2))
        for k, e in enumerate(ends)
    ]
    kind = light.schema["id"].dataType.simpleString()
    edge = light.sparkSession.createDataFrame(edges, f"range int, next_id {kind}, next_said long, next_first long, last_id {kind}, last_first long")
    order = Window.partitionBy("range").orderBy("first", "path", "id")
    near = dealt.select(
        "*", F.lead(row).over(order).alias("after"), F.lag(row).over(order).alias("prior")
    ).join(F.broadcast(edge), "range")  # a row for each range
    after = F.coalesce("after", F.struct(F.col("next_id").alias("id"), F.col("next_said").alias("said"), F.col("next_first").alias("first")))
    prior_id = F.when(F.col("prior").isNull(), F.col("last_id")).otherwise(F.col("prior.id"))
    prior_first = F.when(F.col("prior").isNull(), F.col("last_first")).otherwise(F.col("prior.first"))
    return near.withColumn("after", after).select(
        "id", "said",
        F.when(F.col("after.first") == F.col("first"), F.col("after.id")).alias("other"),
        F.when(F.col("after.first") == F.col("first"), F.col("after.said")).alias("other_said"),
        F.when(prior_first == F.col("first"), prior_id).alias("before"),
    )


def paired(conversations: DataFrame) -> DataFrame:
    """Each conversation with the next of those whose first turn is the same.

    They stand by the hashes of the longest run of leading turns that they share with any other,
    then by id. So each stands beside one it shares most leading turns with, and those that share
    equally many are in the order of their ids. Chosen is the one with more assistant text, on
    ties the smaller id. The last that begins alike goes without a partner, unless it was the
    partner of the one before it.
    """
    said = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.when(t["role"] == ASSISTANT, F.length(t["text"])).otherwise(0))
    kind = conversations.schema["id"].dataType.simpleString()
    hashed = conversations.select("id", said.alias("said"), F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])).alias("hashes"))
    paths = cut(hashed.mapInArrow(_prefixes, f"id {kind}, said long, path array<bigint>"))
    each = paths.select("id", F.posexplode("path").alias("depth", "prefix"))
    # Stored first, so that the join deals both sides anew and Spark can split a prefix that many share.
    shared = cut(each.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"))
    deepest = each.join(shared, "prefix").groupBy("id").agg((F.max("depth") + 1).alias("depth"))
    light = paths.join(deepest, "id", "left").select(
        "id", "said", F.get("path", F.lit(0)).alias("first"), F.slice("path", F.lit(1), F.coalesce("depth", F.lit(1))).alias("path")
    )
    linked = _neighbours(light).where("other is not null or before is null")
    swap = (F.col("other_said") > F.col("said")) | ((F.col("other_said") == F.col("said")) & (F.col("other") < F.col("id")))
    chosen = linked.select(
        F.when(swap, F.col("other")).otherwise(F.col("id")).alias("chosen_id"),
        F.when(swap, F.col("id")).otherwise(F.col("other")).alias("rejected_id"),
    )
    a = conversations.select(F.col("id").alias("chosen_id"), F.col("turns").alias("a"))
    b = conversations.select(F.col("id").alias("rejected_id"), F.col("turns").alias("b"))
    chosen = cut(chosen)
    alone = chosen.where("rejected_id is null").join(a, "chosen_id").withColumn("b", F.lit(None).cast(conversations.schema["turns"].dataType))
    pairs = chosen.where("rejected_id is not null").join(a, "chosen_id").join(b, "rejected_id")
    return pairs.select("chosen_id", "rejected_id", "a", "b").union(alone.select("chosen_id", "rejected_id", "a", "b"))


def preferences(turns: DataFrame, **columns) -> DataFrame:
    """formatted() pairs of the conversations of a table of turns; empty for an empty table.

    Two conversations whose first turns merely share a hash have no common turn, and an empty prompt.
    """
    return formatted(paired(conversations_of(turns, **columns)))
