"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, media_gif, mixing, near_dedup, preferences, quality_embed, quality_rules, sentencepiece_codec, toxicity, url_filter

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: The digests of a contract for near duplicates: three words, 85 %.
NEAR = {"width": 3, "threshold_pct": 85}
RULES = [
    url_filter.Rule("com/en/", "block"),
    url_filter.Rule("example.com/en/7", "allow"),
    url_filter.Rule("net/de/", "allow"),
    url_filter.Rule("example.net/de/8", "block"),
    url_filter.Rule("org/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_of(docs: DataFrame) -> DataFrame:
    return sentencepiece_codec.encoded(docs, Path(MODEL).read_bytes(), texts=False)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_of(table(spark, sf_dir, "documents"))


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_gif.stored_texts(table(spark, sf_dir, "documents"))


def op3_quality_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_embed.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_table(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"
    )


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.preferences(table(spark, sf_dir, "conversations"))


def op7_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged_urls(table(spark, sf_dir, "pages"), RULES)


def op8_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_table(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), **NEAR)


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that op8 judges by."""
    out = quality_rules.quality_table(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, and the targets that op5 mixes to."""
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source", "source_size", F.round("target", 6).alias("target"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and rules of op7."""
    return url_filter.judged_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_gif, op3_quality_embeddings, op4_language_id, op5_mixing, op6_preferences, op7_url_ratio,
        op8_weak_rules, op9_toxicity, op10_near_dedup, rule_counts, mix_targets, url_rules,
    )
}

#: Models, sequential codecs, digests of binary forms and iterations are beyond SQL; those queries
#: are tested against brute force, round trips and held-out accuracy instead. What is plain in op5,
#: op7 and op8 has queries of its own, with SQL.
ORACLES: dict[str, str] = {
    "rule_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
      g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
      r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
      m AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM r WHERE n > 1) GROUP BY doc_id)
      SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(m.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(m.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN m USING (doc_id)""",
    "mix_targets": r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
      s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
      f(round, source, source_size, weight, fixed, target) AS (
        SELECT 0, source, source_size, weight, false, NULL::DOUBLE FROM s
        UNION ALL
        SELECT round + 1, source, source_size, weight, fixed OR share > 3 * source_size, CASE WHEN fixed THEN target ELSE least(share, 3 * source_size) END
        FROM (SELECT *, weight * (sum(source_size) OVER () - coalesce(sum(target) FILTER (fixed) OVER (), 0)) / sum(weight) FILTER (NOT fixed) OVER () AS share FROM f)
        WHERE round <= (SELECT count(*) FROM s))
      SELECT doc_id, size, source, source_size, round(target, 6) AS target FROM d JOIN (SELECT * FROM f WHERE round = (SELECT max(round) FROM f)) t
        ON d.source IS NOT DISTINCT FROM t.source""".replace("SELECT doc_id, size, source,", "SELECT doc_id, size, d.source,"),
    "url_rules": r"""WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
      v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
      r(rule, h, p) AS (VALUES ('com/en/', 'com', '/en/'), ('example.com/en/7', 'example.com', '/en/7'), ('net/de/', 'net', '/de/'), ('example.net/de/8', 'example.net', '/de/8'), ('org/es/', 'org', '/es/'))
      SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM v""",
}
