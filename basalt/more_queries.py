"""Queries of hypotheses, recovery, names, scripts, blobs and manifests, each with SQL where SQL can tell."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from .functions import bytes as B
from .functions import formats, probe, samples, scalars, scripts
from .operators import hypotheses, identity, manifest, names, recovery, spread, stored
from .sources import container


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(column, values):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


#: Names of files, dealt to rows by number; SQL states what they allow by itself.
NAMES = ("a/b.png", "x.OGG", "s.tlg", "data.psb.m", "noext", "k.bin", "u.unknown", "v.jar", ".hidden", "m.mpg", "t.ks")


def hypotheses_by_name(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", _pick(F.col("p_partkey"), NAMES).alias("name"))
    found, each = hypotheses.allowed(rows, "name"), "allowed.hypothesis"
    return found.select("p_partkey", "name", F.size("allowed").cast("long").alias("n"), F.array_min(each).alias("first"), F.array_max(each).alias("last"))


def common_facts_by_name(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", _pick(F.col("p_partkey"), NAMES).alias("name"))
    return hypotheses.common_facts(rows, ["p_partkey"], "name").select("p_partkey", "offset", F.lower(F.hex("plain")).alias("plain"))


SIZED = ("PNG", "JPEG", "WAVE/RIFF", "BMP", "GIF89a", "TGA", "Kirikiri/Text-mode2", "TJS2/Bytecode", "PSB/M2-Emote", "MIDI")


def facts_by_length(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.octet_length(B.payload("text")).cast("long").alias("size"), _pick(F.col("doc_id"), SIZED).alias("hypothesis"))
    return hypotheses.length_facts(rows, "size").select("doc_id", "hypothesis", "offset", F.lower(F.hex("plain")).alias("plain"))


def byte_choices(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"), _pick(F.col("p_partkey"), ("PNG", "Ogg", "TLG5", "PSB/M2-Emote", "ZIP/local")).alias("hypothesis"))
    return hypotheses.byte_choices(rows, "size").select("p_partkey", "hypothesis", "offset", F.array_join(F.transform("allowed", lambda x: x.cast("string")), " ").alias("allowed"))


def fact_union(spark, d):
    """Facts of formats and of lengths, each once."""
    rows = _t(spark, d, "part").select("p_partkey", (F.col("p_size") + 20).cast("long").alias("size"), _pick(F.col("p_partkey"), ("PNG", "BMP")).alias("hypothesis"))
    return hypotheses.all_facts(rows, "size").select("p_partkey", "offset", F.lower(F.hex("plain")).alias("plain"))


def _bytes(spark, d):
    return _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_orderkey").alias("offset"), F.col("l_quantity").cast("int").alias("value"))


def slot_histogram(spark, d):
    return recovery.slot_histogram(_bytes(spark, d), ["l_returnflag"], F.lit(7)).select("l_returnflag", F.col("slot").cast("long").alias("slot"), "value", "n")


def key_likelihoods(spark, d):
    hist = recovery.slot_histogram(_bytes(spark, d), ["l_returnflag"], F.lit(3))
    plain = _bytes(spark, d).where("l_linestatus = 'O'").groupBy("l_returnflag", "value").agg(F.count("*").alias("n"))
    out = recovery.key_log_likelihoods(hist, plain, ["l_returnflag"])
    return out.select("l_returnflag", F.col("slot").cast("long").alias("slot"), "key", "samples", F.round("score", 5).alias("score"))


def implied_bytes(spark, d):
    slots = _t(spark, d, "lineitem").select("l_returnflag", F.expr("explode(sequence(1L, 12L))").alias("period"), "l_orderkey").selectExpr("l_returnflag", "period", "l_orderkey % period AS slot").distinct()
    return recovery.implied_bytes(slots, ["l_returnflag"], F.lit(1000))


def allowed_values(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_suppkey", "l_linenumber AS constraint", "CAST(l_quantity AS INT) AS value")
    return recovery.allowed_values(rows, ["l_suppkey"])


def search_sizes(spark, d):
    slots = _t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("slot")).agg(F.countDistinct("l_quantity").alias("n"))
    out = recovery.search_size(slots, ["l_orderkey"], direct=30)
    return out.select("l_orderkey", "used_slots", "ambiguous_slots", F.round("entropy_bits", 6).alias("entropy_bits"), F.col("combinations").cast("long").alias("combinations"), "direct_feasible")


def change_points(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_partkey", "l_orderkey AS offset", "CAST(l_linenumber % 2 AS INT) AS value", "100000L AS length")
    return recovery.change_points(rows, ["l_partkey"], 4)


def _candidates(spark, d):
    return _t(spark, d, "orders").selectExpr(
        "o_custkey", "o_orderkey AS period", "CAST(o_totalprice AS BIGINT) % 3 AS conflicts", "CAST(CAST(o_totalprice AS BIGINT) % 3 AS DOUBLE) AS conflict_weight",
        "CAST(o_orderkey % 5 AS DOUBLE) / 7 AS score", "o_orderkey % 4 AS known_slots", "CAST(o_orderkey % 11 AS DOUBLE) AS agreement_weight", "o_orderkey % 6 AS agreements",
        "IF(o_orderkey % 9 = 0, NULL, CAST(o_orderkey % 8 AS DOUBLE)) AS entropy_bits", "CAST(o_totalprice AS BIGINT) % 50 + 50 AS strength", "IF(o_orderkey % 7 = 0, NULL, o_orderkey % 13) AS combinations",
    )


def text_ranking(spark, d):
    return recovery.ranked(_candidates(spark, d), ["o_custkey"], recovery.text_order()).select("o_custkey", "period", "rank")


def recovery_ranking(spark, d):
    return recovery.ranked(_candidates(spark, d), ["o_custkey"], recovery.recovery_order(), recovery.TOP).select("o_custkey", "period", "rank")


def validated_ranking(spark, d):
    rows = _candidates(spark, d).withColumn("no", F.col("period")).withColumn("period", F.col("period") % 6)
    return recovery.ranked(rows, ["o_custkey"], [*recovery.validated_order(), F.col("no")]).select("o_custkey", "no", "rank")


def fundamental_ranking(spark, d):
    return recovery.fundamental_ranked(_candidates(spark, d).withColumn("score", F.col("score") / F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(500)), ["o_custkey"]).select("o_custkey", "period", "rank")


def refined_periods(spark, d):
    rows = recovery.ranked(_candidates(spark, d), ["o_custkey"], recovery.text_order())
    return rows.where(recovery.refined_periods(F.col("period"), F.col("rank") - 1, 2)).select("o_custkey", "period")


def _findings(spark, d):
    return _t(spark, d, "lineitem").selectExpr("l_suppkey", "l_orderkey % 50 AS offset", "l_returnflag AS label", "CAST(l_quantity AS INT) AS confidence")


def probe_order(spark, d):
    return recovery.probe_order(_findings(spark, d), ["l_suppkey"])


def first_hits(spark, d):
    return recovery.first_hit(_findings(spark, d).where("confidence > 40"), ["l_suppkey"], "offset")


def first_solutions(spark, d):
    return recovery.first_solutions(_candidates(spark, d).where("conflicts = 0"), ["o_custkey"], [F.col("period")]).select("o_custkey", "period", "rank")


def _checks(spark, d):
    return _t(spark, d, "lineitem").selectExpr(
        "l_partkey", "IF(l_linenumber = 7, NULL, l_quantity <> 50) AS adler_ok", "l_tax < 0.03 AS strong", "l_discount < 0.09 AS readable"
    )


def shared_votes(spark, d):
    return recovery.shared_vote(_checks(spark, d), ["l_partkey"])


def key_verdicts(spark, d):
    return recovery.key_verdict(_checks(spark, d), ["l_partkey"])


def most_frequent_values(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_suppkey", "CAST(l_quantity AS INT) % 5 AS value")
    return recovery.most_frequent(rows, ["l_suppkey"], "value")


def entry_states(spark, d):
    rows = _t(spark, d, "orders").selectExpr("o_custkey", "element_at(array('solved', 'unresolved', 'ignored', 'failed'), CAST(o_orderkey % 4 + 1 AS INT)) AS state")
    return recovery.state_counts(rows, ["o_custkey"], "state", ["solved", "unresolved", "ignored", "failed"])


def guessed_keys(spark, d):
    hist = recovery.slot_histogram(_t(spark, d, "lineitem").selectExpr("l_returnflag", "l_orderkey AS offset", "CAST(l_quantity AS INT) + 40 AS value"), ["l_returnflag"], F.lit(2))
    return scalars.guessed_keys(hist, ["l_returnflag"], scalars.utf8_score).select("l_returnflag", F.col("slot").cast("long").alias("slot"), "key", "score")


# --- names


def alternate_names(spark, d):
    entries = _t(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey % 40 AS token", "l_suppkey % 5 AS adler")
    known = _t(spark, d, "part").selectExpr("p_partkey % 40 AS token", "p_size % 5 AS adler", "p_brand AS name")
    return identity.alternate_names(entries, known, ["token", "adler"], "name")


def two_hash_names(spark, d):
    rows = _t(spark, d, "orders").selectExpr("o_orderkey", "md5(o_orderstatus) AS f", "md5(o_orderpriority) AS p")
    known = _t(spark, d, "orders").where("o_orderstatus <> 'P'").selectExpr("md5(o_orderstatus) AS hash", "o_orderstatus AS name").union(_t(spark, d, "orders").selectExpr("md5(o_orderpriority)", "IF(o_orderpriority LIKE '1%', concat(o_orderpriority, o_orderkey % 2), o_orderpriority)"))
    return identity.named_by_two(rows, known, "f", "p").select("o_orderkey", "file", "folder")


def rows_by_id(spark, d):
    rows = _t(spark, d, "orders").selectExpr("o_custkey AS id", "o_orderkey AS no", "o_orderkey % 3 AS slot", "o_orderpriority AS value")
    return identity.last_by_id(rows, "id", "no").select("id", "no", "value")


def wanted_candidates(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.md5(F.col("p_partkey").cast("string")).alias("hash"))
    goal = _t(spark, d, "supplier").select(F.md5((F.col("s_suppkey") * 3).cast("string")).alias("hash"))
    return identity.wanted_only(rows, goal, "hash")


def zipped_records(spark, d):
    records = _t(spark, d, "orders").selectExpr("o_custkey AS k", "o_orderkey AS no", "length(o_orderpriority) AS size")
    entries = _t(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 100 + 1).alias("k"), F.col("l_orderkey").alias("no")).agg(F.count("*").alias("size"))
    out = identity.zipped(records, entries, ["k"], "no", F.col("r.size") == F.col("e.size") + 3)
    return out.select("k", "n", F.col("r.no").alias("record"), F.col("e.no").alias("entry"), "matches")


def archive_families(spark, d):
    rows = _t(spark, d, "events").selectExpr("user_id", "IF(event_type = 'purchase' AND user_id % 3 = 0, 'own', IF(user_id % 2 = 0 AND event_type = 'click', 'v2', 'file')) AS kind")
    return identity.families(rows, ["user_id"], "own", ["v1", "v2", "v3", "generic"]).select("user_id", "family", "try_shared", "try_own_filter")


def bootstrapped_names(spark, d):
    """Each part mentions two others; every third name is no target."""
    name = lambda k: F.concat(F.lit("f"), F.pmod(k, F.lit(200)))
    key = F.col("k")
    texts = spark.range(200).select(F.col("id").alias("k")).select(name(key).alias("name"), F.array(name(key * 2 + 1), name(key * 7 + 3)).alias("mentions"))
    goal = _t(spark, d, "part").where("p_partkey % 3 <> 0").select(F.md5(F.concat(F.lit("f"), F.pmod("p_partkey", F.lit(200)))).alias("hash")).distinct()
    start = spark.createDataFrame([("f1",)], "name string")
    return identity.bootstrapped(texts, goal, start, stored.cut)


def free_names(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("\x01dir/f"), F.col("p_partkey"), F.lit('.png" <ab> x=word_'), F.col("p_size"), F.lit("\x00")).cast("binary").alias("b"))
    return scripts.mined_names(rows, "p_partkey", F.col("b")).where("length(candidate) = octet_length(candidate)")


def parsed_literals(spark, d):
    number = F.col("p_partkey")
    crib = F.concat(F.when(number % 3 == 0, F.concat(F.lit("0x"), F.lower(F.hex(number)))).otherwise(number.cast("string")), F.when(number % 5 == 4, "").otherwise(":"), F.lower(F.hex("p_brand")), F.when(number % 7 == 6, "z").otherwise(" "))
    c = scalars.crib(crib)
    return _t(spark, d, "part").select("p_partkey", c["offset"].alias("offset"), scalars.hex_text(c["plain"]).alias("plain"))


def cleaned_names(spark, d):
    name = F.concat(_pick(F.col("page_id"), ("//", "\\", "", "../", "./")), F.regexp_replace("url", "://", "//\\\\"))
    rows = _t(spark, d, "pages").select("page_id", name.alias("name"))
    return rows.select("page_id", scalars.normal_name(F.col("name")).alias("normal"), scalars.safe_path(F.col("name")).alias("safe"), scalars.holds(F.col("name"), "EXAMPLE").alias("found"), scalars.named_like(F.col("name"), ["//h", "../"]).alias("marked"))


def synthetic_names(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 1_000_003).alias("v"))
    made = scalars.synthetic_name(F.col("v"))
    return rows.select("o_orderkey", F.lower(F.hex(F.encode(made, "UTF-16BE"))).alias("units"), scalars.synthetic_id(made).alias("back"), scalars.synthetic_id(F.concat(made, F.lit("a"))).alias("none"))


def byte_scores(spark, d):
    b = F.col("id").cast("int")
    return spark.range(256).select(
        b.alias("byte"), scalars.ascii_score(b).alias("ascii"), scalars.utf8_score(b).alias("utf8"), scalars.cp932_score(b).alias("cp932"),
        scalars.utf16_score(F.lit(1), b).alias("high"), scalars.swapped_bits(b * 257).alias("swapped"), scalars.masked_unit(b).alias("masked"),
    )


def partly_plain(spark, d):
    key = F.array(F.lit(1), F.lit(None).cast("int"), F.lit(255))
    plain = scalars.partial_plain(F.col("p_name").cast("binary"), key, 63)
    return _t(spark, d, "part").select("p_partkey", F.array_join(F.transform(plain, lambda x: x.cast("string")), " ").alias("plain"))


def refined_extensions(spark, d):
    name = _pick(F.col("p_partkey"), ("a.png", "b.bin", "c", "d.DAT", "e.tar.gz"))
    some = lambda k, v: F.when(F.col("p_partkey") % k == 0, v)
    return _t(spark, d, "part").select("p_partkey", scalars.refined_extension(name, some(3, "tlg"), some(4, "ogg"), some(7, "exe")).alias("extension"))


# --- scripts, blobs, manifests


def mined_references(spark, d):
    script = F.concat(F.lit('// "no"\nSystem.load("'), F.col("p_partkey"), F.lit('.png", g("x"));\nstorage = \'s\' + "'), F.col("p_size"), F.lit('";'))
    rows = _t(spark, d, "part").select("p_partkey", _pick(F.col("p_partkey"), ("a.tjs", "b.KS", "c.txt")).alias("name"), F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('[image storage="'), F.col("p_size"), F.lit('" on]\n; [no a=b]\n@jump to=x'))).otherwise(script).alias("text"))
    return scripts.mined(rows, ["p_partkey"], F.col("name"), F.col("text").cast("binary"))


#: A compressed stream that the blobs below hold somewhere.
PACKED = zlib.compress(b"hello hello hello")


def probed_blobs(spark, d):
    blob = F.concat(F.repeat(F.lit("q"), (F.col("p_partkey") % 20 + 1).cast("int")).cast("binary"), F.when(F.col("p_partkey") % 2 == 0, F.lit(PACKED)).otherwise(F.lit(b"BZh9")))
    rows = spread.spread(_t(spark, d, "part").select("p_partkey"))
    return probe.probed(rows.select("p_partkey", blob.alias("b")), "p_partkey", F.col("b")).select("id", "offset", "kind", "label", "confidence", "decoded_length")


def format_samples(spark, d):
    """A whole file of each format and a damaged one, for each of the regions."""
    rows = [(k, name, case, bytearray(data)) for k, (name, whole) in enumerate(samples.files().items()) for case, data in (("whole", whole), ("damaged", samples.damaged(name, whole)))]
    made = spark.createDataFrame(rows, "k long, name string, case string, data binary")
    each = F.broadcast(made).crossJoin(_t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r")))  # a few rows each
    each = each.withColumn("id", F.col("k") * 1000 + F.col("r") * 2 + F.when(F.col("case") == "whole", 0).otherwise(1))
    out = formats.validated(each, "id", F.col("name"), F.col("data"))
    return out.select("format", (F.floor(F.col("id") / 2) % 500).alias("r"), F.when(F.col("id") % 2 == 0, "whole").otherwise("damaged").alias("case"), "valid", "strength")


def repartitioned_segments(spark, d):
    segments = _t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("pos")).agg(F.sum(F.col("l_quantity").cast("long")).alias("original_size"))
    lengths = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice").cast("long") % 200).alias("length"))
    return manifest.repartitioned(segments, lengths, ["l_orderkey"]).withColumn("new_size", F.col("new_size").cast("long"))


def _containers(spark, d, edit):
    docs = _t(spark, d, "documents").where("doc_id % 3 = 0") if edit is None else _t(spark, d, "documents").where("doc_id % 3 = 0").withColumn("text", edit)
    return container.packed(docs, F.floor(F.col("doc_id") / 96), F.format_string("%08d.txt", "doc_id"), B.payload("text"), segment_size=4096)


def round_trip_report(spark, d):
    """Every eleventh document is edited, and said to be; every thirteenth is edited without a word."""
    edit = F.when((F.col("doc_id") % 11 == 0) | (F.col("doc_id") % 13 == 0), F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    before, after = manifest.manifest(_containers(spark, d, None)), manifest.manifest(_containers(spark, d, edit))
    ident = F.regexp_extract("preferred_name", "([0-9]+)", 1).cast("long")
    said = before.where(ident % 11 == 0).select("archive_id", "entry_no", (ident % 2 == 0).alias("lossy"))
    report = manifest.joined_report(before.select("archive_id", "entry_no", ident.alias("doc_id"), "n_bytes"), manifest.reports(before, after, said))
    return report.select("doc_id", "n_bytes", "class", "passed", F.array_join(F.transform("checks", lambda c: c["status"]), ",").alias("checks"))


def verified_layers(spark, d):
    layers = _t(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey AS k", "CAST(l_quantity AS INT) % 7 AS width", "1 AS height", "l_extendedprice AS x")
    images = _t(spark, d, "part").where("p_partkey % 4 <> 0").selectExpr("p_partkey AS k", "p_size % 7 AS width", "1 AS height")
    return manifest.with_dimensions(layers, images, "k").select("l_orderkey", "l_linenumber", "x", "k", "verified")


def resolved_resources(spark, d):
    rows = _t(spark, d, "orders").selectExpr("o_orderkey", "o_custkey % 500 AS k")
    return manifest.with_resources(rows, _t(spark, d, "customer").selectExpr("c_custkey AS k", "c_name"), "k")


def deduplicated_references(spark, d):
    rows = names.candidates(_t(spark, d, "part").selectExpr("p_partkey", "concat('ev', p_size, '.png') AS v", "'literal' AS c"), "v", "c")
    return rows.select("candidate").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        hypotheses_by_name, common_facts_by_name, facts_by_length, byte_choices, fact_union, slot_histogram, key_likelihoods, implied_bytes, allowed_values,
        search_sizes, change_points, text_ranking, recovery_ranking, validated_ranking, fundamental_ranking, refined_periods, probe_order, first_hits,
        first_solutions, shared_votes, key_verdicts, most_frequent_values, entry_states, guessed_keys, alternate_names, two_hash_names, rows_by_id,
        wanted_candidates, zipped_records, archive_families, bootstrapped_names, free_names, parsed_literals, cleaned_names, synthetic_names, byte_scores,
        partly_plain, refined_extensions, mined_references, probed_blobs, repartitioned_segments, round_trip_report, verified_layers, resolved_resources,
        deduplicated_references, format_samples,
    )
}

_NAMES = "['a/b.png', 'x.OGG', 's.tlg', 'data.psb.m', 'noext', 'k.bin', 'u.unknown', 'v.jar', '.hidden', 'm.mpg', 't.ks'][p_partkey % 11 + 1]"
_CAND = """c AS (SELECT o_custkey, o_orderkey AS period, trunc(o_totalprice)::BIGINT % 3 AS conflicts, (o_orderkey % 5)::DOUBLE / 7 AS score, o_orderkey % 4 AS known_slots,
  (o_orderkey % 11)::DOUBLE AS agreement_weight, o_orderkey % 6 AS agreements, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 8)::DOUBLE END AS entropy_bits,
  trunc(o_totalprice)::BIGINT % 50 + 50 AS strength, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 13 END AS combinations FROM orders)"""
_CHECKS = """k AS (SELECT l_partkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity <> 50 END AS ok, l_tax < 0.03 AS strong, l_discount < 0.09 AS readable FROM lineitem)"""
_SCORE = """CASE WHEN {b} IN (10, 13) THEN {0} WHEN {b} = 32 THEN {1} WHEN {b} = 9 THEN {2} WHEN {b} IN (33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 58, 59, 60, 61, 62, 63, 64, 91, 92, 93, 95, 123, 124, 125) THEN {3}
  WHEN {b} BETWEEN 48 AND 57 OR {b} BETWEEN 65 AND 90 OR {b} BETWEEN 97 AND 122 THEN {4} WHEN {b} BETWEEN 33 AND 126 THEN {5} WHEN {b} = 0 THEN {6} {more} ELSE {7} END"""


def _score(b, values, more=""):
    return _SCORE.format(*values.split(), b=b, more=more.format(b=b))


_UTF8 = ("8.0 7.0 5.0 5.0 3.5 1.75 -2.0 -6.0", "WHEN {b} BETWEEN 128 AND 191 THEN 0.9 WHEN {b} BETWEEN 194 AND 223 THEN 0.7 WHEN {b} BETWEEN 224 AND 239 THEN 0.8 WHEN {b} BETWEEN 240 AND 244 THEN 0.35")
_CP932 = ("8.0 7.0 5.0 5.0 3.5 1.75 -2.0 0.25", "WHEN {b} BETWEEN 161 AND 223 THEN 1.0 WHEN {b} BETWEEN 129 AND 159 OR {b} BETWEEN 224 AND 252 THEN 0.9 WHEN {b} IN (128, 160, 253, 254, 255) THEN -5.0")
_LE4 = "printf('%02x%02x%02x%02x', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, ({0} >> 24) & 255)"

ORACLES: dict[str, str] = {
    "hypotheses_by_name": f"""WITH n AS (SELECT p_partkey, {_NAMES} AS name FROM part),
      e(name, n, first, last) AS (VALUES ('a/b.png', 1, 'PNG', 'PNG'), ('x.OGG', 5, 'Ogg', 'Ogg/Vorbis'), ('s.tlg', 10, 'TLG0/TLG5', 'TLG6-rgba'), ('data.psb.m', 4, 'MDF/PSB-shell', 'PSZ/PSB-shell'),
        ('noext', 68, '7-Zip', 'gzip'), ('k.bin', 68, '7-Zip', 'gzip'), ('v.jar', 2, 'ZIP/empty', 'ZIP/local'), ('.hidden', 68, '7-Zip', 'gzip'), ('m.mpg', 2, 'MPEG-1/Video', 'MPEG-PS'), ('t.ks', 10, 'Kirikiri/Text-mode0', 'Text/UTF-8-BOM'))
      SELECT p_partkey, name, n::BIGINT AS n, first, last FROM n JOIN e USING (name)""",
    "common_facts_by_name": f"""WITH n AS (SELECT p_partkey, {_NAMES} AS name FROM part),
      e(name, "offset", plain) AS (VALUES ('a/b.png', 0, '89504e470d0a1a0a'), ('a/b.png', 8, '0000000d'), ('a/b.png', 12, '49484452'), ('x.OGG', 0, '4f676753'), ('x.OGG', 4, '00'), ('x.OGG', 18, '00000000'))
      SELECT p_partkey, "offset"::BIGINT AS "offset", plain FROM n JOIN e USING (name)""",
    "facts_by_length": f"""WITH r AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, ['PNG', 'JPEG', 'WAVE/RIFF', 'BMP', 'GIF89a', 'TGA', 'Kirikiri/Text-mode2', 'TJS2/Bytecode', 'PSB/M2-Emote', 'MIDI'][doc_id % 10 + 1] AS hypothesis FROM documents),
      f AS (SELECT doc_id, hypothesis, n - 12 AS "offset", '0000000049454e44ae426082' AS plain FROM r WHERE hypothesis = 'PNG' AND n >= 12
        UNION ALL SELECT doc_id, hypothesis, 26, '0000' FROM r WHERE hypothesis = 'PNG' AND n >= 29 UNION ALL SELECT doc_id, hypothesis, n - 2, 'ffd9' FROM r WHERE hypothesis = 'JPEG' AND n >= 2
        UNION ALL SELECT doc_id, hypothesis, 4, {_LE4.format("(n - 8)")} FROM r WHERE hypothesis = 'WAVE/RIFF' AND n >= 8 UNION ALL SELECT doc_id, hypothesis, 2, {_LE4.format("n")} FROM r WHERE hypothesis = 'BMP'
        UNION ALL SELECT doc_id, hypothesis, n - 1, '3b' FROM r WHERE hypothesis = 'GIF89a' AND n > 0 UNION ALL SELECT doc_id, hypothesis, n - 18, '54525545564953494f4e2d5846494c452e00' FROM r WHERE hypothesis = 'TGA' AND n >= 18
        UNION ALL SELECT doc_id, hypothesis, 5, {_LE4.format("(n - 21)")} || '00000000' FROM r WHERE hypothesis LIKE '%mode2' AND n >= 21
        UNION ALL SELECT doc_id, hypothesis, 8, {_LE4.format("n")} FROM r WHERE hypothesis LIKE 'TJS2%' AND n >= 16 UNION ALL SELECT doc_id, hypothesis, 5, '00' FROM r WHERE hypothesis LIKE 'PSB%' AND n >= 6)
      SELECT doc_id, hypothesis, "offset", plain FROM f""",
    "byte_choices": """WITH r AS (SELECT p_partkey, p_size AS n, ['PNG', 'Ogg', 'TLG5', 'PSB/M2-Emote', 'ZIP/local'][p_partkey % 5 + 1] AS hypothesis FROM part),
      c(hypothesis, least, "offset", allowed) AS (VALUES ('PNG', 29, 24, '1 2 4 8 16'), ('PNG', 29, 25, '0 2 3 4 6'), ('PNG', 29, 28, '0 1'), ('Ogg', 6, 5, '2 6'), ('TLG5', 12, 11, '3 4'), ('PSB/M2-Emote', 5, 4, '1 2 3 4'))
      SELECT p_partkey, hypothesis, "offset"::BIGINT AS "offset", allowed FROM r JOIN c USING (hypothesis) WHERE n >= least""",
    "fact_union": f"""WITH r AS (SELECT p_partkey, (p_size + 20)::BIGINT AS n, p_partkey % 2 = 0 AS png FROM part)
      SELECT p_partkey, unnest([0, 8, 12])::BIGINT AS "offset", unnest(['89504e470d0a1a0a', '0000000d', '49484452']) AS plain FROM r WHERE png
      UNION ALL SELECT p_partkey, n - 12, '0000000049454e44ae426082' FROM r WHERE png UNION ALL SELECT p_partkey, 26, '0000' FROM r WHERE png AND n >= 29
      UNION ALL SELECT p_partkey, 0, '424d' FROM r WHERE NOT png UNION ALL SELECT p_partkey, 2, {_LE4.format("n")} FROM r WHERE NOT png""",
    "slot_histogram": "SELECT l_returnflag, l_orderkey % 7 AS slot, l_quantity::INTEGER AS value, count(*) AS n FROM lineitem GROUP BY ALL",
    "key_likelihoods": """WITH h AS (SELECT l_returnflag AS g, l_orderkey % 3 AS slot, l_quantity::INTEGER AS value, count(*) AS n FROM lineitem GROUP BY ALL),
      t AS (SELECT l_returnflag AS g, l_quantity::INTEGER AS plain, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), s AS (SELECT g, sum(n) AS total FROM t GROUP BY g HAVING sum(n) >= 512),
      p AS (SELECT s.g, b.plain, ln((coalesce(t.n, 0) + 0.5::DOUBLE) / (total + 128)) AS l FROM s CROSS JOIN range(256) b(plain) LEFT JOIN t ON t.g = s.g AND t.plain = b.plain),
      z AS (SELECT g, slot, sum(n) AS samples FROM h GROUP BY ALL HAVING sum(n) >= 64)
      SELECT h.g AS l_returnflag, slot, k.key::INTEGER AS key, max(samples)::BIGINT AS samples, round(sum(n * l), 5) AS score FROM h JOIN z USING (g, slot) CROSS JOIN range(256) k(key) JOIN p ON p.g = h.g AND p.plain = xor(value, k.key::INTEGER) GROUP BY ALL""",
    "implied_bytes": """WITH s AS (SELECT DISTINCT l_returnflag, period, l_orderkey % period AS slot FROM lineitem, range(1, 13) AS p(period))
      SELECT l_returnflag, period, sum(CASE WHEN slot < 1000 THEN 1 + (999 - slot) // period ELSE 0 END)::BIGINT AS implied FROM s GROUP BY ALL""",
    "allowed_values": """WITH n AS (SELECT l_suppkey, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1),
      m AS (SELECT l_suppkey, l_quantity::INTEGER AS value, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY ALL) SELECT l_suppkey, value FROM m JOIN n USING (l_suppkey, k)""",
    "search_sizes": """WITH s AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_quantity) AS n FROM lineitem GROUP BY ALL),
      t AS (SELECT l_orderkey, count(*) AS used_slots, count_if(n > 1) AS ambiguous_slots, round(sum(log2(n)), 6) AS entropy_bits, product(n)::BIGINT AS combinations FROM s GROUP BY 1)
      SELECT l_orderkey, used_slots, ambiguous_slots::BIGINT AS ambiguous_slots, entropy_bits, combinations, combinations <= 30 AS direct_feasible FROM t""",
    "change_points": """WITH o AS (SELECT l_partkey, l_orderkey AS off, l_linenumber % 2 AS v FROM lineitem), s AS (SELECT DISTINCT l_partkey, unnest([off, off + 1, 16, 100000]) AS split FROM o),
      c AS (SELECT l_partkey, split, off >= split AS behind, v, count(*) AS n FROM s JOIN o USING (l_partkey) GROUP BY ALL),
      m AS (SELECT l_partkey, split, behind, max(struct_pack(n := n, v := v)) AS m, sum(n) AS total FROM c GROUP BY ALL),
      b AS (SELECT l_partkey, split, max(m.v) FILTER (NOT behind) AS l, max(m.v) FILTER (behind) AS r, sum(m.n)::BIGINT AS agreements, sum(total - m.n)::BIGINT AS outliers, max(total - m.n) AS worst FROM m GROUP BY ALL)
      SELECT l_partkey, split, coalesce(l, r) AS left_value, coalesce(r, l) AS right_value, agreements, outliers,
        row_number() OVER (PARTITION BY l_partkey ORDER BY agreements DESC, outliers, split)::INTEGER AS rank FROM b WHERE outliers <= 4 AND worst <= 2 AND agreements >= 2""",
    "text_ranking": f"WITH {_CAND} SELECT o_custkey, period, row_number() OVER (PARTITION BY o_custkey ORDER BY conflicts, score DESC, known_slots DESC, period)::INTEGER AS rank FROM c",
    "recovery_ranking": f"""WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY conflicts, coalesce(entropy_bits, 1e300), known_slots DESC, agreement_weight DESC, agreements DESC, period)::INTEGER AS rank FROM c)
      SELECT o_custkey, period, rank FROM r WHERE rank <= 8""",
    "validated_ranking": f"WITH {_CAND} SELECT o_custkey, period AS no, row_number() OVER (PARTITION BY o_custkey ORDER BY period % 6, strength DESC, combinations NULLS LAST, period)::INTEGER AS rank FROM c",
    "fundamental_ranking": f"""WITH {_CAND}, s AS (SELECT * REPLACE (score / CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 500 END AS score) FROM c), m AS (SELECT *, max(score) FILTER (conflicts = 0) OVER (PARTITION BY o_custkey) AS best FROM s),
      a AS (SELECT *, coalesce(best >= 2 / 256, false) AS clear, score >= 1 / 256 + (best - 1 / 256) * 0.6 AS near FROM m)
      SELECT o_custkey, period, row_number() OVER (PARTITION BY o_custkey ORDER BY conflicts, CASE WHEN clear AND NOT near THEN 1 ELSE 0 END, CASE WHEN clear AND NOT near THEN -score ELSE 0 END,
        CASE WHEN clear THEN 0 ELSE -agreement_weight END, CASE WHEN clear THEN 0 ELSE -agreements END, period)::INTEGER AS rank FROM a""",
    "refined_periods": f"""WITH {_CAND}, r AS (SELECT o_custkey, period, row_number() OVER (PARTITION BY o_custkey ORDER BY conflicts, score DESC, known_slots DESC, period) - 1 AS rank FROM c)
      SELECT o_custkey, period FROM r WHERE rank < 2 OR period <= 64 OR (period & (period - 1)) = 0 OR period % 64 = 0""",
    "probe_order": """WITH f AS (SELECT l_suppkey, l_orderkey % 50 AS "offset", l_returnflag AS label, max(l_quantity::INTEGER) AS confidence FROM lineitem GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY "offset", confidence DESC, label)::INTEGER AS position FROM f""",
    "first_hits": """SELECT l_suppkey, min(l_orderkey % 50) AS "offset" FROM lineitem WHERE l_quantity > 40 GROUP BY 1""",
    "first_solutions": f"WITH {_CAND}, r AS (SELECT o_custkey, period, row_number() OVER (PARTITION BY o_custkey ORDER BY period)::INTEGER AS rank FROM c WHERE conflicts = 0) SELECT * FROM r WHERE rank <= 4",
    "shared_votes": f"WITH {_CHECKS} SELECT l_partkey, count(ok) AS tested, count_if(strong)::BIGINT AS strong, coalesce(bool_and(ok), true) AND count(ok) >= 2 AND count_if(strong) >= 2 AS accepted FROM k GROUP BY 1",
    "key_verdicts": f"""WITH {_CHECKS}, s AS (SELECT l_partkey, count(ok) FILTER (readable) AS tested, count(*) FILTER (readable AND ok) AS matched, count(*) FILTER (readable AND strong) AS strong FROM k GROUP BY 1)
      SELECT *, CASE WHEN matched < tested THEN 'rejected' WHEN tested > 0 AND strong > 0 OR tested = 0 AND strong > 1 THEN 'accepted' ELSE 'open' END AS verdict FROM s""",
    "most_frequent_values": """WITH c AS (SELECT l_suppkey, l_quantity::INTEGER % 5 AS value, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, value) AS k,
        coalesce(sum(n) FILTER (value = 0) OVER (PARTITION BY l_suppkey), 0)::BIGINT AS zeros FROM c) SELECT l_suppkey, value, n, zeros FROM r WHERE k = 1""",
    "entry_states": """SELECT o_custkey, count_if(o_orderkey % 4 = 0)::BIGINT AS solved, count_if(o_orderkey % 4 = 1)::BIGINT AS unresolved, count_if(o_orderkey % 4 = 2)::BIGINT AS ignored, count_if(o_orderkey % 4 = 3)::BIGINT AS failed FROM orders GROUP BY 1""",
    "guessed_keys": f"""WITH h AS (SELECT l_returnflag, l_orderkey % 2 AS slot, l_quantity::INTEGER + 40 AS value, count(*) AS n FROM lineitem GROUP BY ALL),
      e AS (SELECT l_returnflag, slot, key::INTEGER AS key, n, xor(value, key::INTEGER) AS b FROM h, range(256) k(key)), s AS (SELECT l_returnflag, slot, key, sum(n * {_score("b", *_UTF8)})::DOUBLE AS score FROM e GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, slot ORDER BY score DESC, key) AS k FROM s) SELECT l_returnflag, slot, key, round(score, 6) AS score FROM r WHERE k = 1""",
    "alternate_names": """WITH n AS (SELECT p_partkey % 40 AS token, p_size % 5 AS adler, min(p_brand) AS name FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_brand) = 1)
      SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey % 40 AS token, l_suppkey % 5 AS adler, name FROM lineitem LEFT JOIN n ON l_partkey % 40 = token AND l_suppkey % 5 = adler""",
    "two_hash_names": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS file, CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_orderpriority END AS folder FROM orders",
    "rows_by_id": "SELECT o_custkey AS id, max(o_orderkey) AS no, arg_max(o_orderpriority, o_orderkey) AS value FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1",
    "wanted_candidates": "SELECT p_partkey, md5(p_partkey::VARCHAR) AS hash FROM part WHERE p_partkey IN (SELECT s_suppkey * 3 FROM supplier)",
    "zipped_records": """WITH r AS (SELECT o_custkey AS k, o_orderkey AS no, length(o_orderpriority) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS n FROM orders),
      g AS (SELECT l_orderkey % 100 + 1 AS k, l_orderkey AS no, count(*) AS size FROM lineitem GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY no)::INTEGER AS n FROM g)
      SELECT k, n, r.no AS record, e.no AS entry, coalesce(r.size = e.size + 3, false) AS matches FROM r FULL JOIN e USING (k, n)""",
    "archive_families": """WITH f AS (SELECT user_id, bool_or(event_type = 'purchase' AND user_id % 3 = 0) AS own, bool_or(event_type = 'click' AND user_id % 2 = 0) AS v2 FROM events GROUP BY 1)
      SELECT user_id, CASE WHEN own THEN 'own' WHEN v2 THEN 'indirect' ELSE 'standard' END AS family, NOT own AS try_shared, own AS try_own_filter FROM f""",
    "bootstrapped_names": """WITH RECURSIVE t AS (SELECT DISTINCT p_partkey % 200 AS k FROM part WHERE p_partkey % 3 <> 0),
      e AS (SELECT i AS k, unnest([(i * 2 + 1) % 200, (i * 7 + 3) % 200]) AS m FROM range(200) r(i)),
      f(k, round) AS (SELECT 1::BIGINT, 0 UNION SELECT m, round + 1 FROM f JOIN e USING (k) WHERE m IN (SELECT k FROM t) AND round < 16)
      SELECT 'f' || k AS name, min(round) AS round FROM f GROUP BY k""",
    "free_names": "SELECT p_partkey AS id, unnest(['dir/f' || p_partkey || '.png', 'word_' || p_size]) AS candidate FROM part",
    "parsed_literals": "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 7 <> 6 THEN p_partkey END AS \"offset\", CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 7 <> 6 THEN lower(hex(encode(p_brand))) END AS plain FROM part",
    "cleaned_names": r"""WITH n AS (SELECT page_id, ['//', '\', '', '../', './'][page_id % 5 + 1] || replace(url, '://', '//\') AS name FROM pages),
      s AS (SELECT *, list_filter(string_split(name, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM n)
      SELECT page_id, regexp_replace(ltrim(replace(lower(name), '\', '/'), '/'), '/+', '/', 'g') AS normal, CASE WHEN NOT starts_with(name, '/') AND NOT list_contains(parts, '..') AND len(parts) > 0 THEN array_to_string(parts, '/') END AS safe,
        contains(lower(name), 'example') AS found, starts_with(name, '//h') OR starts_with(name, '../') AS marked FROM s""",
    "synthetic_names": """WITH v AS (SELECT o_orderkey, o_orderkey * 1000003 AS v FROM orders), u AS (SELECT *, printf('%04x', 20480 + (v & 16383)) || CASE WHEN v >> 14 > 0 THEN printf('%04x', 20480 + ((v >> 14) & 16383)) ELSE '' END
        || CASE WHEN v >> 28 > 0 THEN printf('%04x', 20480 + ((v >> 28) & 16383)) ELSE '' END || CASE WHEN v >> 42 > 0 THEN printf('%04x', 20480 + ((v >> 42) & 16383)) ELSE '' END AS units FROM v)
      SELECT o_orderkey, units, v AS back, NULL::BIGINT AS "none" FROM u""",
    "byte_scores": f"""WITH b AS (SELECT i::INTEGER AS b FROM range(256) r(i)) SELECT b AS byte, ({_score("b", "9.0 8.0 6.0 6.0 4.5 2.5 -3.0 0.25")})::DOUBLE AS ascii, ({_score("b", *_UTF8)})::DOUBLE AS utf8, ({_score("b", *_CP932)})::DOUBLE AS cp932,
      (CASE WHEN b = 0 THEN 10.0 WHEN b BETWEEN 32 AND 159 THEN 0.8 WHEN b BETWEEN 216 AND 223 THEN -3.0 ELSE 0.0 END)::DOUBLE AS high,
      (((b * 257) & 43690) >> 1) | (((b * 257) & 21845) << 1) AS swapped, CASE WHEN b >= 32 THEN xor(b, xor((b & 254) << 8, 1)) ELSE b END AS masked FROM b""",
    "partly_plain": """WITH c AS (SELECT p_partkey, i, ord(p_name[i + 1]) AS c FROM (SELECT p_partkey, p_name, unnest(range(length(p_name))) AS i FROM part))
      SELECT p_partkey, string_agg(CASE i % 3 WHEN 0 THEN xor(c, 1) WHEN 1 THEN 63 ELSE xor(c, 255) END::VARCHAR, ' ' ORDER BY i) AS plain FROM c GROUP BY 1""",
    "refined_extensions": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'png' WHEN 4 THEN 'gz' ELSE coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'tlg' END, CASE WHEN p_partkey % 4 = 0 THEN 'ogg' END, CASE WHEN p_partkey % 7 = 0 THEN 'exe' END,
      CASE p_partkey % 5 WHEN 1 THEN 'bin' WHEN 2 THEN '' ELSE 'dat' END) END AS extension FROM part""",
    "mined_references": """SELECT p_partkey, unnest([2, 2, 3, 3, 2, 2, 3, 3])::INTEGER AS line, unnest(['literal', 'literal', 'literal', 'literal', 'call:System.load', 'call:g', 'field:storage', 'concat']) AS context,
        unnest([p_partkey || '.png', 'x', 's', p_size::VARCHAR, p_partkey || '.png', 'x', 's', 's' || p_size]) AS value FROM part WHERE p_partkey % 3 = 0
      UNION ALL SELECT p_partkey, unnest([1, 1, 3])::INTEGER, unnest(['kag:image:storage', 'kag:image:on', 'kag:jump:to']), unnest([p_size::VARCHAR, 'true', 'x']) FROM part WHERE p_partkey % 3 = 1""",
    "probed_blobs": """SELECT p_partkey AS id, p_partkey % 20 + 1 AS "offset", CASE WHEN p_partkey % 2 = 0 THEN 'zlib' ELSE 'compression' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'zlib stream' ELSE 'bzip2 stream' END AS label,
      CASE WHEN p_partkey % 2 = 0 THEN 90 ELSE 88 END AS confidence, CASE WHEN p_partkey % 2 = 0 THEN 17 END::BIGINT AS decoded_length FROM part""",
    "repartitioned_segments": """WITH s AS (SELECT l_orderkey, l_linenumber AS pos, sum(l_quantity::BIGINT) AS size FROM lineitem GROUP BY ALL),
      b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, max(pos) OVER (PARTITION BY l_orderkey) = pos AS last FROM s)
      SELECT l_orderkey, pos, (CASE WHEN last THEN greatest(trunc(o_totalprice)::BIGINT % 200 - before, 0) ELSE least(size, greatest(trunc(o_totalprice)::BIGINT % 200 - before, 0)) END)::BIGINT AS new_size FROM b JOIN orders ON o_orderkey = l_orderkey""",
    "round_trip_report": """WITH x AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, doc_id % 11 = 0 AS said, doc_id % 11 = 0 OR doc_id % 13 = 0 AS edited FROM documents WHERE doc_id % 3 = 0),
      y AS (SELECT *, greatest(1, (n + 4095) // 4096) <> greatest(1, (n + 4096) // 4096) AS grown FROM x)
      SELECT doc_id, n AS n_bytes, CASE WHEN NOT edited THEN 'byte_exact' WHEN NOT said THEN 'unsupported' WHEN doc_id % 2 = 0 THEN 'lossy' ELSE 'semantic_exact' END AS class, NOT edited OR said AS passed,
        CASE WHEN edited AND NOT said THEN CASE WHEN grown THEN 'pass,fail,fail,fail' ELSE 'pass,fail,pass,fail' END ELSE 'pass,pass,pass,pass' END AS checks FROM y""",
    "verified_layers": """SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_partkey AS k, coalesce(p_partkey % 4 <> 0 AND p_size % 7 = l_quantity::INTEGER % 7, false) AS verified
      FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""",
    "resolved_resources": "SELECT o_orderkey, o_custkey % 500 AS k, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey % 500",
    "format_samples": """WITH f(format, strength) AS (VALUES
      ('png', 100), ('wave', 95), ('avi', 95), ('webp', 95), ('gif', 98), ('ogg', 100), ('bmp', 85), ('zip', 90), ('7z', 95), ('gzip', 100),
      ('woff', 95), ('woff2', 75), ('flac', 95), ('iso_bmff', 95), ('midi', 95), ('dds', 90), ('ico', 95), ('cur', 95), ('ebml', 70), ('id3', 70),
      ('pe', 95), ('asf', 95), ('mpeg_ps', 75), ('mpeg1_video', 90), ('h264', 90), ('psd', 90), ('tga', 90), ('utf8_text', 95), ('utf16le_text', 95),
      ('utf16be_text', 95), ('cp932_text', 95), ('jpeg', 98), ('jpeg_xr', 70), ('vorbis', 100), ('opus', 100), ('truetype', 98), ('opentype', 98),
      ('ttc', 98), ('bitmap_font0', 100), ('bitmap_font1', 100), ('tlg5', 95), ('tlg6', 95), ('tlg5_wrapped', 95), ('tlg6_wrapped', 95),
      ('psz_shell', 65), ('mdf_shell', 65), ('mfl_shell', 65), ('psb', 98), ('compiled_script', 100), ('wrapped_text0', 98), ('wrapped_text1', 98),
      ('wrapped_text2', 100))
      SELECT format, r_regionkey::BIGINT AS r, c.unnest AS "case", c.unnest = 'whole' AS valid, CASE WHEN c.unnest = 'whole' THEN strength ELSE 0 END AS strength FROM f, region, unnest(['whole', 'damaged']) c""",
    "deduplicated_references": "SELECT DISTINCT 'ev' || p_size || '.png' AS candidate FROM part",
}
