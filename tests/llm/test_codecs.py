"""Codecs against the library, round trips and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basalt.llm import media_gif, mixing, quality_rules, sentencepiece_codec, url_filter

HARD = [None, "", " ", "a", "\n\n", "a  b\t c", "▁x", "日本 é́ \U0001f600\x00", "the " * 3000, "x" * 5000, "The cat.\nThe cat.\nThe cat.\n"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(HARD)] + [(3, "a", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def test_agenda_equals_library():
    codec = sentencepiece_codec.Codec(Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice("ab the,.▁ \n\té日<s>\U0001f6001’»-\"") for _ in range(r.randint(0, 40)))
        assert codec.encode(text) == codec.library.encode(text)
        part = " " + text.replace(" ", "").replace("▁", "")
        assert codec.short_agenda(part) == codec.heap_agenda(part)


def test_encoded_rows(spark, odd):
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    rows = sentencepiece_codec.encoded(odd, model).collect()
    assert len(rows) == len(HARD) + 1 and all(r.checked for r in rows)
    empty = next(r for r in rows if r.doc_id == 0)
    assert empty.n_tokens == 0 and empty.ids_sha256 == hashlib.sha256(b"").hexdigest() == empty.decoded_sha256
    assert sentencepiece_codec.encoded(odd.limit(0), model).count() == 0


def test_rows_come_from_the_agenda(spark, odd, monkeypatch):
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    codec, runs = sentencepiece_codec.Codec(model), []
    monkeypatch.setattr(type(odd), "mapInArrow", lambda self, run, schema: runs.append(run))
    monkeypatch.setattr(sentencepiece_codec, "codec_of", lambda model: codec)
    monkeypatch.setattr(codec, "encode", lambda text: [5])  # a wrong agenda shows in the rows
    sentencepiece_codec.encoded(odd, model)
    rows = [r for b in runs[0]([pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["the cat", "sat"]})]) for r in b.to_pylist()]
    assert [(r["ids"], r["n_tokens"], r["checked"]) for r in rows] == [([5], 1, False)] * 2


@pytest.mark.parametrize("n", [0, 1, 600, 5000, 70000])
def test_lzw_round_trip(n):
    r = random.Random(n)
    for data in (bytes(r.randrange(256) for _ in range(n)), bytes(r.choice(b"ab") for _ in range(n)), b"\0" * n):
        assert media_gif.lzw_decode(media_gif.lzw_encode(data), 8) == data
    parts = [bytes(r.choice(b"abcd"[: 1 + i % 4]) for _ in range(min(n, 900) + i)) for i in range(20)]
    streams, most = media_gif.lzw_streams(parts), [len(p) for p in parts]
    assert list(media_gif.lzw_decoded(streams, 8, most)) == parts == [media_gif.lzw_decode(x, 8) for x in streams]
    assert media_gif._expanded(np.array([256, 65, 259, 257]), np.array([4]), 256) is None


def test_disposal_transparency_and_times():
    payload = bytes(r % 256 for r in range(576 * 2))
    _, screens, times = media_gif.read_gif(media_gif.write_gif(payload))
    assert b"".join(s[..., 0].tobytes() for s in screens) == payload and times == [0, 4]
    assert tuple(screens[1][0, 0]) == (payload[576],) * 3 + (255,)
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x81, 0, 0]) + palette

    def image(left, pixels, disposal, clear=None):
        control = bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), 7, 0, clear or 0, 0])
        body = media_gif.lzw_encode(bytes(pixels), 2)
        return control + bytes([0x2C, left, 0, 0, 0, len(pixels), 0, 1, 0, 0, 2, len(body)]) + body + b"\0"

    data = head + image(0, [1, 1], 1) + image(1, [2], 2) + image(0, [3, 0], 3, 0) + image(0, [2], 0) + b"\x3b"
    _, screens, times = media_gif.read_gif(data)
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    shown = [[tuple(int(v) for v in p) for p in s[0]] for s in screens]
    assert shown == [[red, red], [red, green], [blue, none], [green, none]] and times == [0, 7, 14, 21]


def test_stored_frames_use_the_format():
    r = random.Random(2)
    first = bytes(r.randrange(32, 96) for _ in range(576))
    second = first[:50] + b"x" + first[51:70] + b"yy" + first[72:]  # a few pixels change
    for payload in (first + second + second + bytes(576) + b"\xfe" * 576 + bytes(575) + b"\xfe", b"ab ab ab " * 128):
        data = media_gif.write_gif(payload)
        parsed = media_gif.parse_gif(data)[2]
        gif = media_gif.parse_gif(data)
        assert b"".join(shown.tobytes() for _, shown, _, _ in media_gif.composed(gif, media_gif._pixels(gif[2]))) == payload
    assert all(len(body) < 300 for _, body, _ in parsed)  # so dictionary codes, not literal ones of 9 bits
    frames = [f for f, _, _ in media_gif.parse_gif(media_gif.write_gif(first + second + second))[2]]
    assert [(f.left, f.top, f.width, f.height, f.transparent) for f in frames] == [(0, 0, 24, 24, None), (2, 2, 22, 1, 254), (0, 0, 1, 1, 254)]


def test_texts_come_back(spark, odd):
    rows = {(r.doc_id, r.n_bytes): r for r in media_gif.stored_texts(odd).collect()}
    for i, t in enumerate(HARD):
        raw = (t or "").encode()
        whole = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = rows[(i, len(raw))]
        assert r.payload_sha256 == hashlib.sha256(whole).hexdigest() and r.tail_crc32 == zlib.crc32(whole[-32:])
        assert r.payload_bytes == len(whole) and sum(r.histogram) == len(whole) and r.error is None
        # The feature by brute force: grey levels of the payload, and frames at even times.
        level = Counter(3 * b * 8 // 766 for b in whole)
        bins = [level[k] for k in range(8)]
        assert r.feature == f"frames={len(whole) // 576};duration={len(whole) // 144};bins=" + ",".join(map(str, bins))
        assert [f.shown_at for f in r.frames] == list(range(0, len(whole) // 144, 4))
        for k, f in enumerate(r.frames[:50]):
            level = Counter(3 * b * 8 // 766 for b in whole[576 * k : 576 * (k + 1)])
            assert list(f.histogram) == [level[x] for x in range(8)]


def test_damaged_media_has_an_error(spark):
    df = spark.createDataFrame([(1, 0, b"GIF89a"), (2, 0, b"")], "id long, n_bytes long, gif binary")
    assert all(r.error and r.feature is None for r in media_gif.features_of(df).collect())


def test_ordinary_gifs_are_read(spark):
    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x81, 0, 0, 0, 0, 0, 255, 0, 0, 0, 255, 0, 255, 255, 255])
    image = lambda pixels: bytes([0x21, 0xF9, 4, 5, 7, 0, 0, 0, 0x2C, 0, 0, 0, 0, 2, 0, 1, 0, 0, 2, len(b := media_gif.lzw_encode(bytes(pixels), 2))]) + b + b"\0"
    small = head + image([1, 1]) + image([0, 3]) + b"\x3b"
    whole = media_gif.write_gif(bytes(576))
    short = whole[: whole.index(b"\x08", len(media_gif.HEADER) + 8) + 1] + media_gif._chunked(media_gif.lzw_encode(bytes(9))) + b"\x3b"
    bad = whole[:-4] + b"\xff\xff\0\x3b"
    df = spark.createDataFrame([(1, 0, small), (2, 0, short), (3, 0, whole), (4, 0, bad), (5, 0, None), (3, 0, whole)], "id long, n_bytes long, gif binary").coalesce(1)
    one, two, three, again, four, five = media_gif.features_of(df).orderBy("doc_id").collect()
    assert (one.n_frames, one.duration, one.histogram, one.error) == (2, 14, [0, 0, 3, 0, 0, 0, 0, 1], None)
    assert one.payload_sha256 == hashlib.sha256(bytes([1, 1, 1, 3])).hexdigest()
    assert three == again and four.error and five.error and five.frames is None and media_gif.features_of(df.limit(0)).count() == 0
    assert two.error and two.feature is None and three.error is None and three.payload_bytes == 576
    shown = media_gif.frames_table(df).where("id < 3").orderBy("id", "frame").collect()
    red, white = bytes([255, 0, 0, 255]), b"\xff" * 4
    assert [(r.id, r.shown_at, r.rgba and bytes(r.rgba)) for r in shown] == [(1, 0, red * 2), (1, 7, red + white), (2, None, None)]


def test_rule_counts_by_brute_force(spark, odd):
    for r in quality_rules.quality_table(odd).collect():
        text = HARD[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(marked))
        assert r.base_failed == (len(words) < 50 or 100 * len(marked) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_table(odd.limit(0)).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


def slow_fit(rows, rounds=200):
    """The rule model again, document by document."""
    q, passed = quality_rules, [v for v, failed in rows if not failed]
    weight, rules = q.PRIOR_ROWS + q.PRIOR_WEIGHT * len(passed), range(len(rows[0][0]))
    mass = {False: weight * (1 - q.GOOD_SHARE), True: weight * q.GOOD_SHARE}
    share, odds = q.GOOD_SHARE, []
    for j in rules:
        right = min(0.99, (1 - share) / max(sum(v[j] < 0 for v in passed) / max(len(passed), 1), 1e-9))
        odds.append((math.log((1 - right) * (1 - share) / (right * share)), math.log(0.8 / 0.5)))
    good = lambda v: 1 / (1 + (1 - share) / share * math.exp(-sum(o[0] if x < 0 else o[1] for x, o in zip(v, odds) if x)))
    for _ in range(rounds):
        belief = [(v, failed, 0.0 if failed else good(v)) for v, failed in rows]
        total = {g: mass[g] + sum(p if g else 1 - p for _, failed, p in belief if not failed) for g in mass}
        everyone = {True: total[True], False: total[False] + sum(failed for _, failed in rows)}
        rate = lambda j, x, g: (
            mass[g] * q.PRIOR[x][g] + sum(p if g else 1 - p for v, failed, p in belief if v[j] == x and not (failed and x > 0))
        ) / (everyone if x < 0 else total)[g]
        odds = [tuple(math.log(rate(j, x, True) / rate(j, x, False)) for x in (-1, 1)) for j in rules]
        share = max(0.5, total[True] / (total[True] + total[False]))
    return good


def test_the_rule_model_by_brute_force():
    r = random.Random(1)
    rows = [(tuple(r.choices((-1, 0, 1), (1, 2, 6))[0] for _ in range(3)), r.random() < 0.1) for _ in range(60)]
    share, odds = quality_rules.fit([(*k, n) for k, n in Counter(rows).items()], rounds=20)
    good = slow_fit(rows, rounds=20)
    for votes in {v for v, _ in rows}:
        assert quality_rules.posterior(votes, share, odds) == pytest.approx(good(votes), abs=1e-9)


def test_estimated_accuracies_decide():
    n = len(quality_rules.RULES)
    vote = lambda **at: tuple(at.get(f"r{j}", 0) for j in range(n))
    praised = {f"r{j}": 1 for j in range(2, n)}
    # Rule 0 accuses many alone, rule 1 few, who lack praise too.
    table = [(vote(**praised), False, 3000), (vote(r0=-1, **praised), False, 2000), (vote(r1=-1, r0=-1), False, 150), (vote(r1=-1), False, 150), (vote(r0=-1), True, 100)]
    share, odds = quality_rules.fit(table)
    verdict = lambda v: quality_rules.posterior(v, share, odds) >= 0.5
    assert verdict(vote(r0=-1, **praised)) and not verdict(vote(r1=-1)) and verdict(vote())
    # Praise outweighs one weak accusation, and one that no rule corroborates.
    weak = [{-1: -2.0, 0: 0.0, 1: 0.5}] * n
    alone, two = vote(r0=-1), vote(r0=-1, r1=-1)
    keeps = lambda v: quality_rules.posterior(v, 0.9, weak) >= 0.5
    assert keeps(alone) and not keeps(two) and keeps(vote(r0=-1, r1=-1, **praised))
    # A tie keeps; and without any document the priors alone speak.
    assert quality_rules.posterior(vote(), 0.5, weak) == 0.5 and quality_rules.fit([])[0] == quality_rules.GOOD_SHARE


def test_verdicts_are_not_all_must_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumnRenamed("quality", "label")
    strict = docs.select("doc_id", quality_rules._votes(quality_rules.measures(F.col("text"))).alias("v")).select(
        "doc_id", (~F.col("v.failed") & (F.least(*[f"v.{r[0]}" for r in quality_rules.RULES]) >= 0)).alias("strict")
    )
    out = quality_rules.quality_table(docs).join(strict, "doc_id").join(labels, "doc_id").where("not base_failed").toPandas()
    assert (out.kept & ~out.strict).any() and (out.kept == out.label).mean() > 0.99


def test_odd_tables_of_rules(spark, odd):
    same = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))] * 50, "doc_id long, text string")
    assert len({(r.kept, r.quality) for r in quality_rules.quality_table(same).collect()}) == 1
    clash = odd.selectExpr("*", "text AS v", "text AS m", "text AS `a.b`", "text AS row").withColumnRenamed("score", "kept")
    assert quality_rules.keep_good(clash).columns == clash.columns


def test_targets_and_mix(spark, odd):
    goal = mixing.targets({"a": 10, "b": 1000, None: 90})
    assert sum(goal.values()) == pytest.approx(1100) and goal["a"] == 30.0 and goal[None] <= 270
    words = [(i, "w " * (1 + i % 40), ["x", "y", None][i % 3]) for i in range(900)]
    df = spark.createDataFrame(words, "doc_id long, text string, source string")
    rows = mixing.mixed(df).collect()
    for s in ("x", "y", None):
        mine = [r for r in rows if r.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.01)
    assert all(r.taken <= 3 * r["size"] for r in rows) and sorted(rows) == sorted(mixing.mixed(df).collect())
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(odd.limit(0)).count() == 0
    assert mixing.take_copies(df).count() == sum(r.copies for r in rows)


def test_rates_solve_the_dual(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.choice((0, 1, 5, 40, 200, 900)), r.choice(("a", "a", "a", "b", "c", None))) for i in range(600)]
    rows += [(i, "w " * 30, "tiny") for i in range(600, 604)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in ("a", "b", "c", None, "tiny"):
        mine = [x for x in out if x.source == source]
        goal, total = mine[0].target, sum(x["size"] for x in mine)
        unit = total / sum(x["size"] > 0 for x in mine)
        mass = lambda m: sum(x["size"] * min(3.0, math.exp(min(9.0, m * x["size"] / unit))) for x in mine)
        low, high = -2000.0, 2000.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if mass(middle) < goal else (low, middle)
        for x in mine:
            assert x.rate == pytest.approx(1.0 if not x["size"] else min(3.0, math.exp(min(9.0, low * x["size"] / unit))), abs=1e-5)
            assert abs(x.copies - x.rate) < 1 + 1e-6 and x.taken == x.copies * x["size"]
    assert len({round(x.rate, 3) for x in out if x.source == "a"}) > 3  # documents of a source differ


def test_copies_of_repeated_rows(spark):
    rows = [(1, "a b", "x")] * 1000 + [(1, "a b", "y")] * 1000 + [(2, "c d", "y")] * 7 + [(i, "e f", None) for i in range(10, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    said, taken = Counter(), Counter((r.doc_id, r.source) for r in mixing.take_copies(df).collect())
    for r in mixing.mixed(df).collect():
        said[r.doc_id, r.source] += r.copies
    assert taken == +said and any(n % 1000 for (i, _), n in said.items() if i == 1)
    # One text in two sources, ties, null ids and clashing names, and rows beyond a chunk.
    odd_rows = [(None, "a b", "x", 1)] * 3 + [(None, None, None, 2)] * 2 + [(7, "", "z", 3), (8, "p q r", "x", 4), (8, "p q r", "y", 5)] * 2
    odd_df = spark.createDataFrame(odd_rows, "doc_id long, text string, source string, mark long").selectExpr("*", "mark AS `a.b`", "mark AS rows", "mark AS number")
    out = mixing.mixed(odd_df)
    assert out.count() == len(odd_rows) and mixing.take_copies(odd_df).columns == odd_df.columns
    assert mixing.take_copies(odd_df).count() == sum(r.copies for r in out.collect())
    assert mixing.take_copies(odd_df.limit(0)).count() == 0


def test_many_equal_rows_are_laid_out_in_chunks(spark, monkeypatch):
    rows = [(1, "a b", "x")] * 1000 + [(2, "c d e", "x")] * 10
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = sorted(mixing.mixed(df).collect())
    monkeypatch.setattr(mixing, "CHUNK", 64)
    assert sorted(mixing.mixed(df).collect()) == whole and len(whole) == 1010


def test_url_rules(spark):
    urls = ["https://www.Example.com/en/7a?x#y", "http://a.com/en/1", "http://net/de/9", "x.example.net/de/8", None, "", "http://b.example.net/de/8#f", "ftp://org/es/", "http://acom/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [url_filter.Rule("com/en/", "block"), url_filter.Rule("example.com/en/7", "allow"), url_filter.Rule("net/de/", "allow"), url_filter.Rule("example.net/de/8", "block"), url_filter.Rule("org/es/", "block")]
    out = {r.page_id: r for r in url_filter.judged_urls(df, rules).collect()}
    assert [out[i].rule for i in range(9)] == ["example.com/en/7", "com/en/", "net/de/", None, None, None, "example.net/de/8", "org/es/", None]
    assert (out[0].host, out[0].path) == ("www.example.com", "/en/7a") and (out[3].host, out[3].path) == ("", "") == (out[4].host, out[4].path)
    assert url_filter.judged_urls(df.limit(0), rules).count() == 0


def markov(seen, order=4, prior=2.0, alphabet=96.0):
    """The two smoothed models again: gram -> (log p accepted, log p rejected)."""
    counts = Counter((t[max(0, e - n) : e], ok) for t, ok in seen for e in range(1, len(t) + 1) for n in range(1, min(e, order + 1) + 1))
    total = {ok: sum(c for (g, k), c in counts.items() if k == ok and len(g) == 1) for ok in (True, False)}
    p = {}
    for gram in sorted({g for g, _ in counts}, key=len):
        for ok in (True, False):
            if len(gram) == 1:
                p[gram, ok] = (counts[gram, ok] + prior / alphabet) / (total[ok] + prior)
            else:
                p[gram, ok] = (counts[gram, ok] + prior * p[gram[1:], ok]) / (counts[gram[:-1], ok] + prior)
    return {g: (math.log(p[g, True]), math.log(p[g, False])) for g, _ in counts}


def ratio(text, model):
    total = 0.0
    for e in range(1, len(text) + 1):
        gram = next((text[e - n : e] for n in range(min(e, 5), 0, -1) if text[e - n : e] in model), None)
        total += model[gram][0] - model[gram][1] if gram else 0.0
    return total / len(text) if text else 0.0


@pytest.mark.parametrize("broadcast", [0, 20_000])
def test_url_scores_by_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", broadcast)
    r = random.Random(3)
    name = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 24)))
    seen = [(name("abcdefghijklmnopqrst"), True) for _ in range(1500)] + [(name("ghijklmnopqrstuvwxyz日😀"), False) for _ in range(1500)]
    truth = markov(seen)
    table = url_filter._model(spark.createDataFrame(seen, "text string, accepted boolean"))
    model = {m.gram: (m.yes, m.no) for m in table.collect()}
    assert set(model) == set(truth) and len(model) > 1 << 15  # none is thrown away
    assert all(model[g] == tuple(pytest.approx(v / url_filter.UNIT, abs=2) for v in truth[g]) for g in r.sample(sorted(truth), 500))
    texts = [name("abcdefghijklmnopqrstuvwxyz0") for _ in range(50)] + ["", "0", "日本", "g", "😀a😀", "ab" * 3000]
    got = {x.text: x.x for x in url_filter._scores(spark.createDataFrame([(t,) for t in set(texts)], "text string"), table).collect()}
    assert set(got) == set(texts) - {""}
    for t in got:
        assert got[t] == pytest.approx(ratio(t, truth), abs=1e-7)


def test_url_verdicts_by_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rules = [url_filter.Rule("com/en/", "block"), url_filter.Rule("example.com/en/7", "allow"), url_filter.Rule("net/de/", "allow")]
    rows = url_filter.judged_urls(pages, rules).collect()
    part = {r.text: r.part for r in spark.createDataFrame([(r.host + r.path,) for r in rows], "text string").selectExpr("text", "pmod(xxhash64(text), 4) AS part").collect()}
    said = {p: v for p, v in ((x.pattern, x.verdict) for x in rules)}
    labelled = [(r.host + r.path, said[r.rule] == "allow") for r in rows if r.rule]
    model = markov([(t, ok) for t, ok in labelled if part[t]])
    mean, spread = {}, {}
    for ok in (True, False):
        x = [ratio(t, model) for t, k in labelled if k == ok and not part[t]]
        mean[ok] = sum(x) / len(x)
        spread[ok] = math.sqrt(sum((v - mean[ok]) ** 2 for v in x) / len(x))
    cutoff = (mean[True] * spread[False] + mean[False] * spread[True]) / (spread[True] + spread[False])
    for r in rows:
        x = ratio(r.host + r.path, model)
        assert r.score == pytest.approx(x, abs=1e-7)
        if r.rule or abs(x - cutoff) > 1e-6:
            assert r.verdict == (said[r.rule] if r.rule else "allow" if x >= cutoff else "block")


def test_url_tables_of_one_kind_and_odd_urls(spark):
    urls = ["http://a.com/en/" + "é" * 5000, None, "http://b.org/x", "http://b.org/x", "", "no scheme", "://", "http://日本.com/en/1"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, score string").withColumn("a.b", F.lit(1))
    blocked = {r.page_id: r for r in url_filter.judged_urls(df, [url_filter.Rule("com/en/", "block")]).collect()}
    assert [blocked[i].verdict for i in range(8)] == ["block", *["allow"] * 6, "block"] and {r.score for r in blocked.values()} == {0.0}
    assert {r.verdict for r in url_filter.judged_urls(df, []).collect()} == {"allow"}
    assert blocked[2] == blocked[2] and url_filter.judged_urls(df.unionAll(df), []).count() == 16
