"""Bounded samples of labelled texts to fit classifiers on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(ident, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % folds


def labelled_texts(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str,
    classes: list,
    per_class: int,
    max_chars: int,
) -> list[tuple[str, object]]:
    """(text, label) of at most per_class documents of each class, in a fixed order.

    They are the first by a hash of the id among labelled documents of at most max_chars
    characters; where a class has too few of those, its shortest longer ones follow, as long as the
    class stays within per_class * max_chars characters. So the driver holds at most
    len(classes) * per_class * max_chars characters, whatever the table. Null texts, ids and labels
    are left out; an id with two labels counts with both, and one with several texts with the
    shortest (on ties the smallest).
    """
    ident, text = F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")
    wanted = labels.select(ident, F.col(f"`{label_col}`").alias("label")).where("id is not null and label is not null").distinct()
    known = docs.select(ident, text).where("id is not null and text is not null")
    # The ids are chosen from narrow rows; only their texts are then fetched, one each.
    lean = known.select("id", F.length("text").alias("chars")).groupBy("id").agg(F.min("chars").alias("chars")).join(wanted, "id")
    late = F.greatest(F.col("chars") - F.lit(int(max_chars)), F.lit(0))
    order = [late.asc(), F.xxhash64(F.col("id"), F.lit(7)), F.col("id")]
    reach = F.sum("chars").over(Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    parts = [lean.where(F.col("label") == c).orderBy(*order).limit(per_class) for c in classes]
    chosen = reduce(DataFrame.union, parts).withColumn("reach", reach).where(F.col("reach") <= per_class * max_chars).select("id", "label", "chars")
    texts = known.join(F.broadcast(chosen), "id").where(F.length("text") == F.col("chars"))  # at most len(classes) * per_class ids
    rows = texts.groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["id"], str(r["label"]), r["text"]))]
