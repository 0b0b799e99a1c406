"""Queries of the engine's own operators, each with the SQL that an independent engine runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import more_queries
from .functions import bytes as B
from .functions import formats, samples
from .operators import detect, evidence, identity, names, ranges
from .sources import container


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BYTES_SQL = """b AS (SELECT doc_id, i, n, ('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2))::INTEGER AS d
  FROM (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n, unnest(range(1, octet_length(encode(text)) + 1)) AS i
        FROM documents))"""


def checksums(spark, d):
    t = _t(spark, d, "documents")
    p = B.payload("text")
    return t.select("doc_id", F.octet_length(p).cast("long").alias("n_bytes"), F.md5(p).alias("md5"), F.sha2(p, 256).alias("sha256"))


def adler_sums(spark, d):
    return B.byte_facts(_t(spark, d, "documents"), "doc_id", B.payload("text"), ("adler32",))


def byte_entropy(spark, d):
    f = B.byte_facts(_t(spark, d, "documents"), "doc_id", B.payload("text"), ("entropy", "dense"))
    return f.select("id", F.round("entropy", 6).alias("entropy"), "dense")


def byte_histogram(spark, d):
    return B.histogram(_t(spark, d, "documents"), B.payload("text"))


def lag_coincidence(spark, d):
    return B.lag_scores(_t(spark, d, "documents"), B.payload("text"), range(1, 9)).withColumn("score", F.round("score", 9))


def _observations(spark, d):
    return _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("offset"), F.col("l_linenumber").cast("long").alias("value"), F.col("l_quantity").cast("long").alias("weight")
    )


def period_votes(spark, d):
    return evidence.period_votes(_observations(spark, d), range(1, 17)).withColumn("agreement_weight", F.round("agreement_weight", 6))


def period_ranking(spark, d):
    slots = evidence.period_votes(_observations(spark, d), range(1, 17))
    return evidence.ranked_periods(slots).withColumn("agreement_weight", F.round("agreement_weight", 4))


VOTES_SQL = """v AS (SELECT period, l_orderkey % period AS slot, l_linenumber::BIGINT AS value, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS w
    FROM lineitem, range(1, 17) AS p(period) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY period, slot ORDER BY w DESC, n DESC, value) AS k,
    sum(n) OVER (PARTITION BY period, slot) AS an, sum(w) OVER (PARTITION BY period, slot) AS aw FROM v),
  s AS (SELECT period, slot, value, (an - n)::BIGINT AS conflicts, (aw - w)::BIGINT AS conflict_weight, n - 1 AS agreements,
    w * (n - 1) / n AS agreement_weight FROM r WHERE k = 1)"""


def pruned_slots(spark, d):
    scores = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("score"))
    return evidence.pruned(scores, ["l_suppkey"], "l_linenumber", "score", 60.0, 120.0, 3)


def _spans(spark, d):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return _t(spark, d, "events").select("user_id", F.floor(start).alias("s"), (F.floor(start) + 3600 * (1 + F.col("event_id") % 5)).alias("e"))


def merged_ranges(spark, d):
    return ranges.merged(_spans(spark, d), ["user_id"], "s", "e")


def uncovered_ranges(spark, d):
    return ranges.uncovered(_spans(spark, d), ["user_id"], "s", "e")


SPANS_SQL = """x AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 3600 * (1 + event_id % 5) AS e FROM events),
  y AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
  z AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM y),
  m AS (SELECT user_id, min(s) AS s, max(e) AS e FROM z GROUP BY user_id, k)"""


def layout(spark, d):
    o = _t(spark, d, "orders").select(
        "o_custkey", "o_orderkey", (F.col("o_orderkey") * 40).alias("old"), (F.floor("o_totalprice") % 900).alias("size")
    )
    return ranges.layout(o, ["o_custkey"], ["o_orderkey"], "old", "size", 19)


def name_resolution(spark, d):
    names = _t(spark, d, "part").select(F.substring(F.md5("p_name"), 1, 3).alias("token"), "p_name")
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 3).alias("token"))
    return identity.resolved(rows, names, "token", "p_name")


def matched_halves(spark, d):
    left = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 + 11).alias("v"))
    right = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 101 + 3).alias("v"))
    return identity.matched_sums(left, right, "v", 12345, 4093)


def version_compare(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.where("o_orderkey % 97 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 31 == 0, "X").otherwise(F.col("o_orderstatus")))
    new = new.union(o.where("o_orderkey % 89 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    return identity.compared(o, new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


def sniffed_payloads(spark, d):
    """Whole sample files in front of each text."""
    heads = [F.lit(bytes(samples.files()[n])) for n in ("png", "gif", "jpeg", "ogg", "wave", "flac", "zip", "7z", "gzip", "bmp", "pe", "midi", "psd", "dds", "id3", "tga")]
    p = F.concat(F.element_at(F.array(*heads), (F.col("doc_id") % 16 + 1).cast("int")), B.payload("text"))
    return _t(spark, d, "documents").select("doc_id", detect.sniffed(p).alias("format"))


def _containers(spark, d):
    docs = _t(spark, d, "documents")
    name = F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt"))
    return container.packed(docs, F.floor(F.col("doc_id") / 64), name, B.payload("text"), segment_size=4096)


def container_round_trip(spark, d):
    found = container.contents(_containers(spark, d))
    doc_id = F.regexp_extract("name", "([0-9]+)", 1).cast("long")
    return found.select(
        F.col("archive_id").cast("long").alias("archive"), doc_id.alias("doc_id"), F.octet_length("content").cast("long").alias("n_bytes"),
        F.sha2("content", 256).alias("sha256"), "adler_ok", "error",
    )


def container_listing(spark, d):
    segments = container.segments(container.indexed(_containers(spark, d)))
    return segments.groupBy(F.col("archive_id").cast("long").alias("archive")).agg(
        F.countDistinct("entry_no").alias("entries"), F.count("*").alias("segments"), F.sum("original_size").alias("n_bytes")
    )


def format_verdicts(spark, d):
    """Each text in UTF-8, plain or with what the named format may not hold, as its id says."""
    docs = _t(spark, d, "documents").withColumn("k", F.col("doc_id") % 4)
    data = F.when(F.col("k") == 1, F.concat(B.payload("text"), F.lit(b"\xff"))).when(F.col("k") == 2, F.concat(B.payload("text"), F.lit(b"\0"))).otherwise(B.payload("text"))
    name = F.when(F.col("k") == 3, "png").otherwise("utf8_text")
    out = formats.validated(docs, "doc_id", name, data)
    return out.select("id", "format", "valid", "strength", "strong")


def text_verdicts(spark, d):
    docs, props = _t(spark, d, "documents"), _t(spark, d, "events")
    rows = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").union(props.select(F.lit("event"), "event_id", "props"))
    return rows.select("kind", "id", F.coalesce(formats.text_reason(F.col("text")), F.lit("ok")).alias("verdict"))


def neighbour_names(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("cg"), F.format_string("%02d", F.col("p_partkey") % 1000), F.lit("b.png")).alias("name"))
    return names.neighbours(rows, "name")


def reference_names(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("./ev\\cg"), F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, ".png?x").otherwise("")).alias("v"), F.when(F.col("p_partkey") % 2 == 0, "call:loadImage").otherwise("literal").alias("context"))
    return names.candidates(rows, "v", "context").select("p_partkey", "candidate").distinct()


def sampled_smallest(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.octet_length(B.payload("text")).cast("long").alias("size"))
    return names.bounded_sample(rows, "size", ["doc_id"], 512, 100_000)


TEXT_SQL = r"""t AS (SELECT 'document' AS kind, doc_id AS id, text AS s FROM documents UNION ALL SELECT 'event', event_id, props FROM events),
  n AS (SELECT *, length(s) AS total, length(regexp_replace(s, '[^0-9A-Za-z \t\n\r]', '', 'g')) AS ascii,
    length(s) - length(translate(s, '{}[]();=,.@/*+-_<>"''\:#$%&|!?', '')) AS syntax, length(regexp_replace(s, '[^ \t\n\r]', '', 'g')) AS space,
    regexp_matches(s, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffd}]') AS bad, length(regexp_replace(s, '[^\x{e000}-\x{f8ff}\x{fffe}\x{ffff}]', '', 'g')) AS odd,
    regexp_matches(s, '[\n\r]') AS lines FROM t)"""

FLAGSHIP = "period_ranking"
QUERIES = {
    f.__name__: f
    for f in (
        checksums, adler_sums, byte_entropy, byte_histogram, lag_coincidence, period_votes, period_ranking, pruned_slots, merged_ranges,
        uncovered_ranges, layout, name_resolution, matched_halves, version_compare, sniffed_payloads, container_round_trip, container_listing,
        format_verdicts, text_verdicts, neighbour_names, reference_names, sampled_smallest,
    )
}

ORACLES: dict[str, str] = {
    "checksums": "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "adler_sums": f"""WITH {BYTES_SQL} SELECT doc_id AS id, max(n)::BIGINT AS n_bytes,
      (((max(n) + sum((n - i + 1)::HUGEINT * d)) % 65521) * 65536 + (1 + sum(d)) % 65521)::BIGINT AS adler32 FROM b GROUP BY doc_id""",
    "byte_entropy": f"""WITH {BYTES_SQL}, c AS (SELECT doc_id, d, count(*) AS k, max(n) AS n FROM b WHERE i <= 8192 GROUP BY doc_id, d),
      e AS (SELECT doc_id, max(n) AS n, -sum(k / least(n, 8192) * log2(k / least(n, 8192))) AS x FROM c GROUP BY doc_id)
      SELECT doc_id AS id, round(x + 0.0, 6) AS entropy, n >= 256 AND x >= 7.65 AS dense FROM e""",
    "byte_histogram": f"WITH {BYTES_SQL} SELECT d AS byte, count(*) AS n FROM b GROUP BY d",
    "lag_coincidence": f"""WITH {BYTES_SQL}, g AS (SELECT lag AS k, d = lag(d, lag::INTEGER) OVER (PARTITION BY doc_id, lag ORDER BY i) AS same FROM b, range(1, 9) AS r(lag))
      SELECT k::INTEGER AS lag, count_if(same) AS equal, count(same) AS total, round((count_if(same) + 2.0) / (count(same) + 512), 9) AS score FROM g GROUP BY k""",
    "period_votes": f"WITH {VOTES_SQL} SELECT period, slot, value, conflicts, conflict_weight, agreements, round(agreement_weight, 6) AS agreement_weight FROM s",
    "period_ranking": f"""WITH {VOTES_SQL}, q AS (SELECT period, sum(conflicts)::BIGINT AS conflicts, sum(conflict_weight)::BIGINT AS conflict_weight,
        sum(agreements)::BIGINT AS agreements, sum(agreement_weight) AS agreement_weight, count(*) AS known_slots FROM s GROUP BY period)
      SELECT period, conflicts, conflict_weight, agreements, round(agreement_weight, 4) AS agreement_weight, known_slots,
        row_number() OVER (ORDER BY conflict_weight, conflicts, q.agreement_weight DESC, agreements DESC, period) AS rank FROM q""",
    "pruned_slots": """WITH a AS (SELECT l_suppkey, l_linenumber, sum(l_quantity::BIGINT)::DOUBLE AS score FROM lineitem GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_linenumber) AS rank FROM a),
      g AS (SELECT l_suppkey, max(score) FILTER (rank = 1) AS f, max(score) FILTER (rank = 2) AS s, max(score) FILTER (rank = 4) AS k FROM r GROUP BY l_suppkey)
      SELECT r.* FROM r JOIN g USING (l_suppkey) WHERE CASE WHEN f - s >= 60 THEN rank <= 1 WHEN f - k >= 120 THEN rank <= 3 ELSE true END""",
    "merged_ranges": f"WITH {SPANS_SQL} SELECT user_id, s, e FROM m",
    "uncovered_ranges": f"WITH {SPANS_SQL}, g AS (SELECT user_id, e AS gap_start, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS gap_end FROM m) SELECT * FROM g WHERE gap_end IS NOT NULL",
    "layout": """WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey * 40 AS old, floor(o_totalprice)::BIGINT % 900 AS size FROM orders),
      p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY o_custkey ORDER BY old, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM o)
      SELECT o_custkey, o_orderkey, old, size, (greatest(19, max(old - b) OVER (PARTITION BY o_custkey ORDER BY old, o_orderkey ROWS UNBOUNDED PRECEDING)) + b)::BIGINT AS new_offset FROM p""",
    "name_resolution": """WITH n AS (SELECT substr(md5(p_name), 1, 3) AS token, min(p_name) AS p_name FROM part GROUP BY 1 HAVING min(p_name) = max(p_name))
      SELECT token, l_orderkey, l_linenumber, l_partkey, n.p_name FROM (SELECT *, substr(md5(l_partkey::VARCHAR), 1, 3) AS token FROM lineitem) l LEFT JOIN n USING (token)""",
    "matched_halves": "SELECT c_custkey AS left_id, s_suppkey AS right_id FROM customer, supplier WHERE (c_custkey * 37 + 11 + s_suppkey * 101 + 3) % 4093 = 12345 % 4093",
    "version_compare": """WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 97 <> 0
        UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 89 = 0)
      SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'added'
        WHEN o.o_orderstatus = n.s AND o.o_orderpriority = n.p THEN 'same' ELSE 'changed' END AS status FROM orders o FULL JOIN n USING (o_orderkey)""",
    "container_round_trip": """SELECT doc_id // 64 AS archive, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS sha256,
      true AS adler_ok, NULL::VARCHAR AS error FROM documents""",
    "container_listing": """WITH x AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents)
      SELECT doc_id // 64 AS archive, count(*) AS entries, sum(greatest(1, (n + 4095) // 4096))::BIGINT AS segments, sum(n)::BIGINT AS n_bytes FROM x GROUP BY 1""",
    "text_verdicts": f"""WITH {TEXT_SQL} SELECT kind, id, CASE WHEN s IS NULL OR total < 4 THEN 'too short' WHEN bad OR (total - odd) * 100 < total * 98 THEN 'strange characters'
      WHEN total < 32 AND (ascii * 100 // total >= 20 OR syntax >= 2) THEN 'ok' WHEN total >= 32 AND (ascii * 100 // total >= 8 OR (syntax + space) * 100 // total >= 6
      OR lines AND ascii * 100 // total >= 5) THEN 'ok' ELSE 'no structure' END AS verdict FROM n""",
    "format_verdicts": f"""WITH {TEXT_SQL}, v AS (SELECT id, id % 4 = 0 AND total >= 4 AND NOT bad AND (total - odd) * 100 >= total * 98 AND CASE WHEN total < 32
        THEN ascii * 100 // total >= 20 OR syntax >= 2 ELSE ascii * 100 // total >= 8 OR (syntax + space) * 100 // total >= 6 OR lines AND ascii * 100 // total >= 5 END AS ok
        FROM n WHERE kind = 'document')
      SELECT id, CASE WHEN id % 4 = 3 THEN 'png' ELSE 'utf8_text' END AS format, coalesce(ok, false) AS valid, CASE WHEN ok THEN 95 ELSE 0 END AS strength, coalesce(ok, false) AS strong FROM v""",
    "neighbour_names": """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 1000 < 10 THEN '0' ELSE '' END || (p_partkey % 1000)::VARCHAR AS digits FROM part),
      y AS (SELECT *, digits::BIGINT AS v, unnest(range(greatest(digits::BIGINT - 128, 0), digits::BIGINT + 129)) AS w FROM x)
      SELECT p_partkey, 'cg' || digits || 'b.png' AS name, 'cg' || CASE WHEN length(w::VARCHAR) < length(digits) THEN lpad(w::VARCHAR, length(digits)::INTEGER, '0') ELSE w::VARCHAR END || 'b.png' AS candidate FROM y WHERE w <> v""",
    "reference_names": """WITH x AS (SELECT p_partkey, 'cg' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.png' ELSE '' END AS f FROM part)
      SELECT p_partkey, unnest(['ev/' || f, f] || CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN ['ev/' || f || '.ks', 'ev/' || f || '.tlg', 'ev/' || f || '.png', 'ev/' || f || '.jpg'] ELSE [] END) AS candidate FROM x""",
    "sampled_smallest": """WITH x AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents),
      y AS (SELECT *, row_number() OVER w AS rank, sum(size) OVER w AS reach FROM x WINDOW w AS (ORDER BY size, doc_id ROWS UNBOUNDED PRECEDING))
      SELECT doc_id, size FROM y WHERE rank <= 512 AND reach <= 100000""",
    "sniffed_payloads": """SELECT doc_id, ['png', 'gif', 'jpeg', 'ogg', 'riff', 'flac', 'zip', '7z', 'gzip', 'bmp', 'pe', 'midi', 'psd', 'dds', 'id3', 'unknown'][doc_id % 16 + 1] AS format FROM documents""",
}
QUERIES |= more_queries.QUERIES
ORACLES |= more_queries.ORACLES
