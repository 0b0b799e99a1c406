"""Operators that SQL cannot tell, against plain loops and round trips."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from basalt import queries
from basalt.functions import formats, formats_more, samples, scalars, scripts
from basalt.operators import hypotheses, manifest, recovery
from basalt.sources import container as c
from basalt.streaming import files


def test_every_hypothesis_has_its_row(spark):
    names = [r.hypothesis for r in hypotheses.hypotheses(spark).orderBy("hyp_no").collect()]
    assert len(names) == len(set(names)) == 68
    assert set(names) - set(formats_more.OF_HYPOTHESIS) == {"KiriKiri/PBD-ns0", "KiriKiri/PBD-4s0"}
    assert set(formats_more.OF_HYPOTHESIS.values()) <= set(formats.CHECKS) | set(samples.files())


def test_search_sizes_and_halves(spark):
    r = random.Random(2)
    groups = {g: [r.choice((1, 2, 3, 8, 256)) for _ in range(r.randint(1, 40))] for g in range(30)}
    df = spark.createDataFrame([(g, k, n) for g, ns in groups.items() for k, n in enumerate(ns)], "g long, slot long, n long")
    got = {x.g: x for x in recovery.search_size(df, ["g"]).collect()}
    dealt = {(x.g, x.slot): x.half for x in recovery.halves(df, ["g"]).collect()}
    for g, ns in groups.items():
        product, sides, logs = math.prod(ns), [1, 1], [0.0, 0.0]
        for n in sorted((n for n in ns if n > 1), reverse=True):
            sides[sides[0] > sides[1]] *= n
        x = got[g]
        assert x.combinations == (product if product < 10**38 else None)
        assert x.direct_feasible == (product <= 1 << 24) and x.halves_feasible == (max(sides) <= 1 << 20)
        for k in sorted(range(len(ns)), key=lambda k: (-ns[k], k)):
            side = int(logs[0] > logs[1])
            assert dealt[g, k] == side
            logs[side] += math.log2(ns[k])


def test_enumerated(spark):
    sets = {0: [1, 5], 1: [7], 2: [2, 3, 9]}
    df = spark.createDataFrame([("a", k, v) for k, vs in sets.items() for v in vs] + [("big", k, v) for k in range(9) for v in range(9)], "g string, slot long, value int")
    got = recovery.enumerated(df, ["g"], 1000).collect()
    assert {tuple(x.assignment) for x in got} == set(itertools.product(*sets.values())) and len(got) == 6


def test_wrapped_texts(spark):
    for mode in (0, 1, 2):
        text = b"\xff\xfe" + "scenario = 'é日本';\r\n".encode("utf-16-le")
        assert formats_more.unwrapped(formats_more.wrapped(text, mode)) == (mode, text)
    with pytest.raises(formats.Bad):
        formats_more.wrapped(b"\xff\xfe" + bytes([0x10, 0x10]), 0)  # its code would fall below 32
    assert formats_more.image_header(samples.files()["tlg5_wrapped"]) == (5, 3, 4, 4)
    assert formats_more.image_header(samples.files()["tlg6"]) == (6, 1, 4, 9)
    assert formats_more.image_tags(samples.files()["tlg6_wrapped"]) == {"mode": "alp", "a": "b"}
    text = spark.createDataFrame([("日本".encode("cp932"),), (b"\x81",), (None,)], "b binary").select(scalars.cp932_text("b").alias("t"), scalars.utf16_text(F.col("b")).alias("u")).collect()
    assert [r.t for r in text] == ["日本", None, None]


@pytest.mark.parametrize("name", sorted(samples.files()))
def test_cut_files_raise_nothing(name):
    whole = samples.files()[name]
    assert formats.verdict(name, whole)[0]
    for other in ("jpeg", "opus", "psb", "compiled_script", "ttc", "tlg5_wrapped", "tlg6", "bitmap_font0", "wrapped_text2", name):
        for cut in range(0, len(whole), 1 + len(whole) // 60):
            formats.verdict(other, whole[:cut])


def test_references():
    source = 'System.execStorage("initialize.tjs");\nvar scenario = "scenario/" + "first.ks";\nstorage = "option"; /* "no" */ f(g("a\\x41"), \'b\''
    found = scripts.source_references(source)
    assert {(1, "call:System.execStorage", "initialize.tjs"), (2, "concat", "scenario/first.ks"), (3, "field:storage", "option"), (3, "call:g", "aA"), (3, "call:f", "b")} <= set(found)
    assert not any(v == "no" for *_, v in found) and len(found) == len(set(found))
    scene = '; comment\n[image storage="ev/scene01.tlg" layer=base]\n@jump storage=next.ks target=*start\n[iscript]\nSystem.execStorage("plugin.tjs");\n[endscript]\n'
    assert {"ev/scene01.tlg", "next.ks", "plugin.tjs"} <= {v for *_, v in scripts.scenario_references(scene)}
    assert scripts.references("a.png", b"x") == [] == scripts.references("a.tjs", None)
    assert scripts.source_references('"\\') == [] and scripts.source_references("a(" * 2000 + '"x"')[-1][1:] == ("call:a", "x")


def test_stream_equals_batch(spark, tmp_path):
    data, out = tmp_path / "in", str(tmp_path / "out")
    data.mkdir()
    for k in range(5):
        (data / f"{k}.bin").write_bytes(c.packed_container([(f"f{k}", b"x" * k), ("g", b"yy")]) if k else b"nothing")
    query = files.write_integrity(files.arriving(spark, str(data), most_files=2), out, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert query.exception() is None and len([p for p in query.recentProgress if p["numInputRows"]]) >= 3
    key = lambda r: tuple((v is None, str(v)) for v in r)
    streamed = sorted(map(tuple, spark.read.parquet(out).collect()), key=key)
    assert streamed == sorted(map(tuple, files.integrity(c.files(spark, str(data))).collect()), key=key) and len(streamed) == 9


def test_manifests_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", c.packed_container([("x", b"12"), ("y", b"")])), ("b", c.packed_container([("z", b"3")]))], "archive_id string, content binary")
    rows = manifest.manifest(df)
    manifest.write_manifest(rows, str(tmp_path / "m"))
    back = manifest.read_manifest(spark, str(tmp_path / "m"))
    pick = lambda t: sorted(map(tuple, t.select("archive_id", "entry_no", "name", "sha256", "fixed_sha256").collect()))
    assert pick(back) == pick(rows) and back.where("archive_id = 'b'").count() == 1


def test_the_plan_of_a_fixpoint_does_not_grow(spark):
    d = "/root/testdata/sf0.01"
    allowed = {r.k for r in spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 3 <> 0").selectExpr("p_partkey % 200 AS k").collect()}
    want, last = {1: 0}, [1]
    for n in range(1, 17):
        last = sorted({m for k in last for m in ((k * 2 + 1) % 200, (k * 7 + 3) % 200) if m in allowed and m not in want})
        want |= dict.fromkeys(last, n)
    got = queries.QUERIES["bootstrapped_names"](spark, d)
    assert {r.name: r.round for r in got.collect()} == {f"f{k}": n for k, n in want.items()} and max(want.values()) > 5
    assert len(got._jdf.queryExecution().optimizedPlan().toString().split("\n")) < 10
