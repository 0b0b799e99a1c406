"""Learned operators by held-out accuracy, near duplicates by brute force, formats by hand."""

import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basalt.llm import langid, near_dedup, preferences, quality_embed, sampling, toxicity

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DIR}/labels.parquet")


def accuracy(df):
    return df.agg(F.avg(F.col("ok").cast("double"))).first()[0]


def test_quality_held_out(docs, labels):
    out = quality_embed.quality_scores(docs, labels)
    assert out.count() == docs.count()
    assert accuracy(out.where("held_out").join(labels, "doc_id").withColumn("ok", F.col("predicted") == F.col("quality"))) > 0.9


def test_language_held_out(spark, docs):
    out = langid.language_table(docs)
    assert accuracy(out.where("held_out").join(docs, "doc_id").withColumn("ok", F.col("lang_pred") == F.col("lang"))) > 0.97
    odd = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "123 %", None), (None, "le la", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.language_table(odd).orderBy("doc_id").collect()][1:] == ["und"] * 3
    assert langid.keep_languages(docs).columns == docs.columns


def test_toxicity_held_out(docs, labels):
    out = toxicity.toxicity_scores(docs, labels)
    assert accuracy(out.where("held_out").join(labels, "doc_id").withColumn("ok", F.col("predicted") == F.col("toxic"))) > 0.9


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 2.0}, {"idiot light"})
    automaton, forms = lexicon.automaton(), toxicity.Folded()
    find = lambda t: toxicity.hits(toxicity.folded_text(t, forms)[0], automaton)
    assert find("an 1d10t!")[1] == 1 and find("іdіоt")[1] == 1 and find("Idiots")[1] == 1
    assert find("the idiot light") == (0, 0) and find("idiot lights")[1] == 1 and find(None) == (0, 0)


def test_folding_marks_and_spaced_letters():
    automaton, forms = toxicity.Lexicon({"idiot": 2.0}).automaton(), toxicity.Folded()
    count = lambda t: toxicity.hits(toxicity.folded_text(t, forms)[0], automaton)[1]
    assert count("i\u200bd\u00adiot") == 1 and count("ídîöt") == 1 and count("i\u0301diot") == 1 and count("so i d i o t !") == 1
    assert count("i d") == 0 and count("a b c d") == 0 and count("i d i o t s i d i o t") == 1 and toxicity.folded_text("a b c d", forms)[1] == 4


def test_exception_spans_by_brute_force():
    r = random.Random(6)
    lexicon = toxicity.Lexicon({"a": 1.0, "ab": 2.0, "c": 3.0}, {"a b", "b a b", "c c", "ab c a"})
    automaton = lexicon.automaton()
    for _ in range(500):
        words = [r.choice(("a", "b", "c", "ab")) for _ in range(r.randint(0, 12))]
        text = " " + " ".join(words) + " "
        spans = [(k, k + len(p) + 1) for p in lexicon.exceptions for k in range(len(text)) if text.startswith(f" {p} ", k)]
        starts = {k: max(w for s, w in lexicon.stems.items() if text.startswith(f" {s}", k)) for k in range(len(text)) if any(text.startswith(f" {s}", k) for s in lexicon.stems)}
        free = {k: w for k, w in starts.items() if not any(a <= k < b for a, b in spans)}
        assert toxicity.hits(text, automaton) == (sum(free.values()), len(free))


ODD = [(1, None, None), (2, "", "en"), (3, " \n", "en"), (4, "x" * 300_000, "en"), (5, "the cat and the hat " * 20_000, "en"), (6, "日本 é \x00 \U0001f600", "ja"), (6, "other text", "en"), (None, "le la", None)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame([(*r, "clash") for r in ODD + ODD[4:6]], "doc_id long, text string, lang string, score string")
    return rows.selectExpr("*", "score AS held_out", "score AS `a.b`", "score AS text_a", "score AS row")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


SCORERS = {"quality": quality_embed.quality_scores, "toxic": toxicity.toxicity_scores}


@pytest.mark.parametrize("name", sorted(SCORERS))
def test_odd_texts_and_labels(spark, odd, name):
    twice = [(i, i % 2, i % 2) for i in range(1, 30)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None)]
    for labels in (labels_of(spark, twice), labels_of(spark, [(i, 1, 1) for i in range(30)]), labels_of(spark, [])):
        out = SCORERS[name](odd, labels).collect()
        assert len(out) == len(ODD) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in out)
        assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in out if r.doc_id == 5}) == 1
    assert SCORERS[name](odd.limit(0), labels_of(spark, twice)).count() == 0


def test_odd_texts_of_languages(spark, docs, odd):
    for table in (odd, odd.withColumn("lang", F.lit(None).cast("string")), odd.limit(0)):
        out = langid.language_table(table).collect()
        assert len(out) == table.count() and all((r.lang_pred == "und") == (r.score == 0) for r in out)
        kept = langid.keep_languages(table)
        assert kept.columns == table.columns and kept.count() <= len(out)
    assert langid.keep_languages(odd.withColumn("lang", F.lit(None).cast("string"))).count() == len(ODD) + 2 - 3  # all with a letter


def test_scores_by_brute_force(spark, docs, labels):
    """What the tasks add up word by word is what the models say of whole texts."""
    some = docs.where("doc_id % 9 = 0")
    texts = {r.doc_id: r.text for r in some.collect()}
    rows = [(t, i % 2) for i, t in texts.items()]
    model = quality_embed.fit(rows, epochs=2)
    for r in quality_embed.scored(some, model).collect():
        assert r.score == pytest.approx(model.scores(texts[r.doc_id])[1], abs=1e-9)
    speech = langid.fit([(r.text, r.lang) for r in some.collect()], *langid.frequencies(some))
    assert 0.5 < (speech.weights == 0).mean() < 1  # sparse
    for r in langid.predicted(some, speech).collect():
        p = langid.softmax(speech.logits(r.text) / speech.temperature)
        assert r.score == pytest.approx(p.max(), abs=1e-9) and r.lang_pred == speech.langs[int(p.argmax())]


def test_frequencies_by_brute_force(docs):
    df, n = langid.frequencies(docs.limit(50))
    sets = [set().union(*(langid.grams_of(w).tolist() for w in langid.words_in(r.text)), set()) for r in docs.limit(50).collect()]
    assert n == 50 and all(df[b] == sum(b in s for s in sets) for b in range(0, langid.BUCKETS, 7))


def test_the_sample_is_bounded(spark):
    docs = spark.range(20_000).selectExpr("CAST(1 AS LONG) AS doc_id", "concat('text ', id) AS text").union(spark.createDataFrame([(2, "y" * 500), (3, "z" * 90), (4, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (1, 1), (4, 1), (None, 1)], "doc_id long, label int")
    get = lambda per, most: sampling.labelled_texts(docs, labels, label_col="label", classes=[0, 1], per_class=per, max_chars=most)
    assert get(10, 100) == [("text 0", 0), ("text 0", 1), ("y" * 500, 1), ("z" * 90, 1)]
    assert get(2, 50) == [("text 0", 0), ("text 0", 1), ("z" * 90, 1)] and get(2, 40) == [("text 0", 0), ("text 0", 1)]


def brute(rows, width, pct):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                shared[j] += 1
            index[s].append(i)
        for j, n in shared.items():
            if 100 * n >= pct * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_by_brute_force(docs):
    truth = brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    rows = near_dedup.near_duplicates(docs, width=3, threshold_pct=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == truth
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base, "a"), (4, base.upper(), "b"), (9, base + " tail", "c"), (7, None, None), (8, " \n", "d"), (None, base, "e"), (3, "one two", "f"), (2, "One Two", "g"), (9, base + " tail", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    out = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect() if r.doc_id is not None)
    assert out == [(2, 2, True), (3, 2, False), (4, 4, True), (5, 4, False), (7, 7, True), (8, 8, True), (9, 4, False), (9, 4, False)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "bucket AS `a.b`", "bucket AS node", "bucket AS id", "bucket AS row")
    kept = near_dedup.keep_representatives(clash)
    assert kept.columns == clash.columns and sorted(r[0] for r in kept.collect() if r[0]) == [2, 4, 7, 8]


def test_near_duplicates_of_the_pipeline_by_brute_force(docs):
    truth = brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    rows = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == truth
    kept = {r.doc_id for r in near_dedup.keep_representatives(docs).collect()}
    assert kept == {i for i, (_, root) in truth.items() if i == root}


def test_hot_buckets_and_long_texts(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(f"x{i}" for i in range(60_000)))]  # a very long one
    for i in range(2, 400):  # a family of near copies, of which some are too far apart, and exact copies
        words = list(base)
        for k in r.sample(range(400), r.choice((0, 1, 4, 20, 60))):
            words[k] = f"y{i}-{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df).collect()}
    assert got == brute(rows, 5, 80)


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no way"), (3, 0, "user", "solo"), (3, 1, "assistant", None), (None, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r.chosen_id: r for r in preferences.preferences(df).collect()}
    assert set(out) == {2, 3} and out[2].rejected_id == 1 and out[2].prompt == "<|user|>\nhi\n"
    assert out[2].chosen == "<|assistant|>\nno way\n" and out[2].rejected == "<|assistant|>\nyes\n"
    assert sum(m.length for m in out[2].chosen_mask) == len(out[2].chosen) and [m.length for m in out[2].chosen_mask if m.trained] == [6]
    assert out[3].rejected is None and out[3].prompt_turns == 1
    assert preferences.preferences(df.limit(0)).count() == 0


def test_partners_share_most_turns(spark):
    def talk(i, *texts):
        return [(i, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)]

    turns = [t for i in range(3000) for t in talk(i, "system", f"answer {i}")]  # one hot first turn
    turns += talk(5001, "q", "a", "r", "x") + talk(5002, "q", "b", "s") + talk(5003, "q", "a", "r", "yy") + talk(5004, "q", "b", "t")
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    rows = [r for r in preferences.preferences(df).collect() if r.rejected_id is not None]
    got = {tuple(sorted((r.chosen_id, r.rejected_id))): r.prompt_turns for r in rows}
    assert {k for k in got if k[0] < 3000} == {(i, i + 1) for i in range(2999)}
    assert got[5001, 5003] == 3 and got[5002, 5004] == 2 and len([k for k in got if k[0] > 5000]) == 3


def render(turns):
    mark = lambda x: re.sub(r"<([|\\])", r"<\\\1", x)
    return "".join(f"<|{mark(r)}|>\n{mark(t)}\n" for r, t in turns)


def test_preferences_by_brute_force(spark):
    r = random.Random(4)
    talks = {i: [(("user", "assistant")[k % 2], r.choice(("a", "b", "<|user|>", "<\\x"))) for k in range(r.randint(1, 5))] for i in range(300)}
    rows = [(i, k, *turn, "clash") for i, turns in talks.items() for k, turn in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").withColumn("a.b", F.lit(1)).repartition(7)
    out = preferences.preferences(df).collect()
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    said = lambda t: sum(len(x) for role, x in t if role == "assistant")
    seen = set()
    for x in out:
        a, b = talks[x.chosen_id], talks.get(x.rejected_id)
        seen |= {x.chosen_id, x.rejected_id}
        if b is None:
            assert x.kind == "alone" and not any(o[0] == a[0] for i, o in talks.items() if i != x.chosen_id)
            continue
        n = common(a, b)
        assert n and x.prompt_turns == n and (x.prompt, x.chosen, x.rejected) == (render(a[:n]), render(a[n:]), render(b[n:]))
        assert x.kind == {0: "pair", 1: "prefix", 2: "identical"}[(n == len(a)) + (n == len(b))]
        assert (said(a), -x.chosen_id) > (said(b), -x.rejected_id)
        for mask, text in ((x.chosen_mask, x.chosen), (x.rejected_mask, x.rejected)):
            assert sum(m.length for m in mask) == len(text)
    assert seen - {None} == set(talks)
    # Each has a partner that no other shares more turns with.
    best = {i: max(common(t, o) for j, o in talks.items() if j != i) for i, t in talks.items()}
    met = {i: max([x.prompt_turns for x in out if x.rejected_id is not None and i in (x.chosen_id, x.rejected_id)], default=0) for i in talks}
    assert met == best


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x" * 100_000), (2, 0, "user", "y"), (2, 0, "user", "y"), (3, 0, "user", "y"), (3, 0, "user", "y"), (3, 1, "assistant", "z")]
    out = {x.chosen_id: x for x in preferences.preferences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {1, 3} and out[1].kind == "alone" and out[1].prompt_turns == 2 and out[1].prompt.startswith("<||>\n\n<|user|>\nxx")
    assert out[3].kind == "prefix" and out[3].rejected_id == 2 and out[3].prompt_turns == 2 and out[3].rejected == "" == out[3].rejected and not out[3].rejected_mask


def test_near_duplicates_in_few_jobs(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):  # copies of very different distance, so that several rounds are needed
        words = list(base)
        for k in r.sample(range(300), r.choice((0, 3, 12, 20, 30))):
            words[k] = f"y{i}-{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    sc, out = spark.sparkContext, {}
    for limit in (near_dedup.UNION, 0):  # all links in one task, and by label spreading
        sc.setJobGroup(f"few-{limit}", "near duplicates")
        near_dedup.UNION, kept = limit, near_dedup.UNION
        try:
            got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df).collect()}
        finally:
            near_dedup.UNION = kept
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert got == brute(rows, 5, 80)
        out[limit] = len(sc.statusTracker().getJobIdsForGroup(f"few-{limit}"))
    assert out[near_dedup.UNION] < 110, out


def test_united_links_by_plain_loops():
    r = random.Random(3)
    links = [(r.randrange(500), r.randrange(500, 900)) for _ in range(350)] + [(1000 + k, 1001 + k) for k in range(300)] + [(7, 7)]
    least = {x: x for pair in links for x in pair}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in part]), pa.array([b for _, b in part])], names=["a", "b"]) for part in (links[:200], links[200:])]
    got = [x for b in near_dedup._united(iter(batches)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert dict(got) == {x: c for x, c in least.items() if x != c} and len(got) == len(dict(got))
    assert list(near_dedup._united(iter([]))) == []


def test_an_id_with_two_texts_joins_both_classes(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(4, a), (5, a + " tail"), (6, b), (9, a), (9, b + " tail"), (7, c), (8, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.component_id) for x in near_dedup.near_duplicates(df).collect())
    assert got == [(4, 4), (5, 4), (6, 4), (7, 7), (8, 7), (9, 4), (9, 4)]
