"""Runs of repeated words against brute force."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quorumlake.llm import periodic


def runs_by_hand(s, min_length):
    """Every maximal stretch of each period; of equal stretches the least period."""
    out = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def periodic_text(r, words, n):
    out = [r.choice(words) for _ in range(n)]
    if n and r.random() < 0.5:
        a = r.randrange(n)
        p = 1 + (n - a) // (3 + r.randrange(8))
        out = [out[i] if i < a else out[a + (i - a) % p] for i in range(n)]
    return out


def test_runs_equal_brute_force():
    r = random.Random(5)
    for _ in range(800):
        least = r.choice([2, 3, 4, 6, 7, 12, 13])
        texts = [periodic_text(r, range(r.choice([1, 2, 3, 5])), r.choice([0, 1, 5, 20, 60])) for _ in range(r.randint(1, 4))]
        symbols = np.array([10 * i + x for i, t in enumerate(texts) for x in t], np.int64)
        want, begin = [], 0
        for t in texts:
            want += [(a + begin, n, q) for a, n, q in runs_by_hand(t, least)]
            begin += len(t)
        assert list(zip(*(x.tolist() for x in periodic.find_runs(symbols, least)))) == sorted(want, key=lambda x: (x[0], x[2]))


def test_well_known_words():
    fibonacci, before = "ab", "a"
    for _ in range(9):
        fibonacci, before = fibonacci + before, fibonacci
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(256))
    for word in (fibonacci, thue, "a" * 300, "ab" * 150, "abaab" * 40 + "c" + "abaab" * 40):
        symbols = np.frombuffer(word.encode(), np.uint8).astype(np.int64)
        for least in (2, 12):
            assert list(zip(*(x.tolist() for x in periodic.find_runs(symbols, least)))) == runs_by_hand(word, least)


def test_a_long_text_of_one_word():
    assert [x.tolist() for x in periodic.find_runs(np.zeros(300_000, np.int64), 12)] == [[0], [300_000], [1]]


def described(doc_id, text, least=12, plant=False):
    raw = (text or "").encode()
    words = (periodic.with_planted_period(doc_id, raw) if plant else raw).split()
    runs = runs_by_hand(words, least)
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (len(words), len(runs), *best, b" ".join(w for i, w in enumerate(words) if i not in dropped).decode(), runs)


def test_texts(spark):
    r = random.Random(9)
    texts = [None, "", " \n", "a", "la " * 50, "é x " * 20, "x" * 5000, "a b " * 4000 + "c", "a\tb\nc\x0bd\x0ce\rf " * 3, " ".join(["one two three"] * 4)]
    texts += [" ".join(map(str, periodic_text(r, range(4), r.randint(0, 90)))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "la " * 20), (4, texts[4]), (4, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("id", "start", "period", "runs", "n_runs")})
    got = periodic.repetition_runs(docs).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((g["doc_id"], g["n_words"], g["n_runs"], g["start"], g["length"], g["period"], g["collapsed"], [tuple(x) for x in g["runs"]]) for g in got), key=str) == sorted(((i, *described(i, t)) for i, t in rows), key=str)
    assert periodic.repetition_runs(docs.limit(0)).count() == 0


def test_the_query_equals_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in periodic.op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        _, n, start, length, period, text, runs = described(d["doc_id"], d["text"], plant=True)
        planted += zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], n, start, length, period, None if start is None else 1000 * length // period, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert planted
