"""The pipeline against the same five stages written as plain loops."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from basalt.llm import langid, mixing, quality_rules

DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def votes(text):
    words = WORD.findall(text)
    n, chars = max(len(words), 1), max(sum(map(len, words)), 1)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = len({i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    found = {
        "n_words": len(words), "symbol_rate": sum(text.count(c) for c in "#*$%&|<>") / n, "repeat_rate": again / n,
        "dup_line_rate": (len(lines) - len(set(lines))) / (len(lines) + 4), "variety": len(set(words)) / math.sqrt(n * 60),
        "mean_word": sum(map(len, words)) / n, "capital_rate": sum("A" <= c <= "Z" for c in text) / chars,
        "letter_share": 1 - sum(text.count(c) for c in quality_rules.MARKS) / chars,
    }
    failed = len(words) < 50 or 100 * again > 50 * len(words)
    inside = lambda x, r: r is not None and r[0] <= x <= r[1]
    return tuple(-1 if not inside(found[by], fair) else int(inside(found[by], good)) for _, by, fair, good in quality_rules.RULES), failed


def near(texts):
    sets = {i: set(zip(*(t.lower().encode().split()[k:] for k in range(min(5, len(t.split())))))) for i, t in texts.items()}
    root = {i: i for i in texts}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in index[s])
        for s in sets[i]:
            index[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((of(i), of(j)))
                root[b] = a
    return [i for i in sorted(texts) if of(i) == i]


def copies(rows):
    """rows: id -> (source, size). One block a source, as in tables of this size."""
    sizes = Counter()
    for s, n in rows.values():
        sizes[s] += n
    out = {}
    for source, goal in mixing.targets(sizes).items():
        mine = sorted(((n, i) for i, (s, n) in rows.items() if s == source), key=lambda x: (-x[0], x[1]))
        unit = sum(n for n, _ in mine) / len(mine)
        rate = lambda m, n: min(3.0, math.exp(min(9.0, m * n / unit)))
        low, high = -500.0, 500.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(n * rate(middle, n) for n, _ in mine) < goal else (low, middle)
        due = 0.0
        for n, i in mine:
            r = rate(low, n)
            base = min(3, math.floor(r + 1e-9))
            due += max(0.0, r - base) * n
            extra = int(base < 3 and r - base > 1e-9 and due >= n / 2)
            due -= extra * n
            out[i] = base + extra
    return out


def test_the_pipeline_by_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    judged = {i: votes(r.text) for i, r in docs.items()}
    share, odds = quality_rules.fit([(*k, n) for k, n in Counter(judged.values()).items()])
    good = {i: docs[i] for i, (v, failed) in judged.items() if not failed and quality_rules.posterior(v, share, odds) >= 0.5}
    model = langid.learned(spark.createDataFrame(list(good.values()), spark.read.parquet(f"{DIR}/documents.parquet").schema))
    sure = {i: r for i, r in good.items() if langid.softmax(model.logits(r.text) / model.temperature).max() >= 0.5 and any(map(str.isalpha, r.text))}
    left = near({i: r.text for i, r in sure.items()})
    times = copies({i: (sure[i].source, len(WORD.findall(sure[i].text))) for i in left})
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert 0 < len(good) < len(docs) and len(left) < len(sure)
    got = Counter(r.doc_id for r in rows)
    # Copies differ by one at most where a sum of words in another order falls on the other side of a half.
    assert set(got) == {i for i, n in times.items() if n} and sum(got[i] != times[i] for i in times) <= 2
    for r in rows:
        ids = library.encode(docs[r.doc_id].text)
        assert r.checked and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_odd_tables(spark):
    text = " ".join(f"Word{i % 70}" for i in range(80))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (None, text + " tail", None, None, 5), (5, "x" * 200_000, "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("checked", F.lit("clash"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, DIR)
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == table.columns
            assert table.count() or out.count() == 0
            table = out
