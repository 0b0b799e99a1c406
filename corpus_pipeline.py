"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.llm import langid, mixing, near_dedup, quality_rules, queries
from basalt.llm.common import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weighed rules reject."""
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language of probability 0.5 or more."""
    return langid.keep_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five words a shingle, similarity 0.8 or more."""
    return near_dedup.keep_representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources have their target shares."""
    return mixing.take_copies(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and copy: doc_id, n_tokens, ids_sha256, decoded_sha256, checked."""
    return queries.op1_of(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("SentencePiece", tokens),
]

#: The learned stages and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds run() against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
