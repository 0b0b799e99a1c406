"""What the third round found: change points beyond a length, and steps that grew faster than their input."""

import re
import tracemalloc
import zlib

from pyspark.sql import functions as F

from basalt import queries
from basalt.functions import bytes as bytes_
from basalt.functions import formats, probe, samples, scalars
from basalt.operators import hypotheses, names, recovery

DIR = "/root/testdata/sf0.001"


def test_change_points_beyond_the_length(spark):
    seen = spark.createDataFrame([(1, o, v, 100) for o, v in ((90, 1), (95, 1), (120, 0), (130, 0))], "k long, offset long, value int, length long")
    found = {x.split: (x.left_value, x.right_value, x.agreements, x.rank) for x in recovery.change_points(seen, ["k"], 4).collect()}
    assert sorted(found) == [16, 90, 91, 95, 96, 100, 120, 121, 130, 131]  # one behind 120 and 130 too
    assert found[96] == (1, 0, 4, 1) and found[131] == (1, 1, 2, 10) and found[121] == (1, 0, 3, 6)


def test_blobs_are_probed_in_many_tasks_without_reading_the_table_of_formats(spark, monkeypatch):
    assert queries.QUERIES["probed_blobs"](spark, DIR).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(probe, "_formats", None)
    whole = samples.files()["png"]
    assert ("format", "PNG", 0) in {(kind, label, at) for at, _, kind, label, *_ in probe._found(whole)}


def test_masked_blobs_under_every_key():
    packed = zlib.compress(b"hello" * 9)
    for key in range(1, 256):
        blob = bytes(b ^ key for b in packed)
        assert (0, len(blob), "masked", f"xor-byte 0x{key:02x} -> zlib", 88, 45) in list(probe._masked(blob))


def test_neighbours_are_laid_out_in_many_tasks(spark):
    rows = spark.createDataFrame([(1, "a/ev09.png"), (2, "ev0a"), (3, None), (4, "n999999")], "k long, n string").coalesce(1)
    near = names.neighbours(rows, "n", 1)
    assert near.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, near.collect())) == [
        (1, "a/ev09.png", "ev08.png"), (1, "a/ev09.png", "ev10.png"), (2, "ev0a", "ev1a"), (4, "n999999", "n1000000"), (4, "n999999", "n999998"),
    ]


def test_synthetic_names_make_each_name_once(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 1, 16383, 16384, 2**63 - 1, -1, -(2**63))], "v long")
    made = scalars.synthetic_name(F.col("v"))
    back = rows.select("v", scalars.synthetic_id(made).alias("back"), F.lower(F.hex(F.encode(made, "UTF-16BE"))).alias("units"))
    assert all(x.v == x.back for x in back.collect())
    assert back.collect()[3].units == "50005001"
    odd = spark.createDataFrame([(n,) for n in ("", "a", "倀倀", "倁\n", "迿" * 5, "迿" * 6, "倁退", None)], "n string")
    assert {x[0] for x in odd.select(scalars.synthetic_id(F.col("n"))).collect()} == {None}
    plan = rows.select(scalars.synthetic_id(made).alias("back"))._jdf.queryExecution().optimizedPlan().expressions().toString()
    assert plan.count("unhex(") == 1


def _no_exchange(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
    return "Aggregate" not in plan[0] and plan[1].count("Exchange") == plan[1].count("BroadcastExchange")


def test_hypotheses_of_a_name_are_counted_in_its_row(spark):
    df = queries.QUERIES["hypotheses_by_name"](spark, DIR)
    assert _no_exchange(df)
    rows = spark.createDataFrame([(1, "a/b.PNG"), (2, "x.psb.m"), (3, None), (4, "u.unknown"), (1, "a/b.PNG")], "k long, n string")
    assert sorted((x.k, len(x.allowed)) for x in hypotheses.allowed(rows, "n").collect()) == [(1, 1), (1, 1), (2, 4), (3, 68)]
    assert sorted((x.k, x.hyp_no) for x in hypotheses.for_names(rows.where("k < 3"), "n").collect())[:2] == [(1, 0), (1, 0)]


def test_common_facts_are_told_in_the_row(spark):
    assert _no_exchange(queries.QUERIES["common_facts_by_name"](spark, DIR))
    rows = spark.createDataFrame([(1, "x.png"), (2, "x.psb.m"), (3, "x.opus"), (4, "x.bin"), (5, "x.unknown"), (6, None), (None, "x.GIF"), (7, "x.flac")], "k long, n string")
    got = {(x.k, x.offset, bytes(x.plain)) for x in hypotheses.common_facts(rows, ["k"], "n").collect()}
    opus = {(3, at, b) for at, b in ((0, b"OggS"), (4, b"\0"), (5, b"\2"), (6, bytes(8)), (18, bytes(4)))}
    assert got == {(1, 0, b"\x89PNG\r\n\x1a\n"), (1, 8, b"\0\0\0\r"), (1, 12, b"IHDR"), (7, 0, b"fLaC")} | opus


def test_entropy_is_handed_no_more_bytes_than_it_is_taken_of(spark):
    rows = spark.createDataFrame([(1, "ab" * 50_000), (2, None), (3, "a" * 8192 + "b" * 8192), (4, "")], "id long, t string")
    facts = bytes_.byte_facts(rows, "id", bytes_.payload("t"), ("entropy", "dense"))
    got = {x.id: (x.n_bytes, x.entropy, x.dense) for x in facts.collect()}
    assert got == {1: (100_000, 1.0, False), 2: (0, 0.0, False), 3: (16_384, 0.0, False), 4: (0, 0.0, False)}
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"substring\(.*, 1, 8192\)", plan)


def test_bytes_are_widened_block_by_block():
    tracemalloc.start()
    data = bytes(range(256)) * (1 << 14)  # 4 MB
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    assert bytes_.adler32(data) == zlib.adler32(data) and bytes_.entropy(data) == 8
    assert tracemalloc.get_traced_memory()[1] - before < len(data)
    tracemalloc.stop()


def test_verdicts_do_not_list_a_long_text_whole():
    data = b"plain text, " * 400_000
    tracemalloc.start()
    assert formats.verdict("utf8_text", data) == (True, 95, "ok")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * len(data)
    assert formats._count(formats._CLASSES["syntax"], "," * 70_000 + "a," * 70_000) == 140_000
