"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quorumlake.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_by_hand(docs, slip, least_points):
    found = Counter()
    for i, t in docs:
        for w in RUN.findall((t or "").translate(LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least_points:
                found[w] += 1
    return found


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def forms_by_hand(n):
    """All neighbours by deleting a letter of each word, then by comparison."""
    meet = {}
    for w in n:
        for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            meet.setdefault(k, set()).add(w)
    near = {w: {x for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} for x in meet[k] if one_apart(w, x)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def test_words_of_texts():
    r = random.Random(1)
    texts = ["".join(r.choices("abAZzÉéÀÿ×÷ \n,1ĀÐ日¿", k=r.randint(0, 200))) for _ in range(200)] + ["x" * 5000, "", "Ã" * 90]
    words, points, of = spelling.text_words([t.encode() for t in texts])
    want = [(w.translate(LOW), i) for i, t in enumerate(texts) for w in RUN.findall(t)]
    assert [(w.decode(), i) for w, i in zip(words.to_pylist(), of.tolist())] == want and points.tolist() == [len(w) for w, _ in want]
    crc = spelling.crc32_of(words, np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(texts))], np.uint32)[of])
    assert crc.tolist() == [zlib.crc32(f"{i}:{w}".encode()) for w, i in want]


def test_counts_with_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "Étude étude"), (3, "ABCDE abcde Àbcde àbcde"), (3, "ABCDE abcde Àbcde àbcde"), (4, "1 ,"), (5, "y" * 9000), (6, "a×b÷cd"), (7, "wordsword " * 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("id", "word", "n", "size")})
    for slip in (None, 1, 2, 97):
        assert {r["word"]: r["n"] for r in spelling.word_counts(df, slip=slip).collect()} == dict(counts_by_hand(docs, slip, 5))
    assert spelling.word_counts(df.limit(0)).count() == 0


def test_forms_equal_brute_force(spark, monkeypatch):
    r = random.Random(4)
    n = {"".join(r.choices("ab", k=r.randint(1, 7))): r.randint(1, 40) for _ in range(150)}
    n |= {"".join(r.choices("abcdeé", k=r.randint(4, 9))): r.choice([3, 6, 12, 24, 48]) for _ in range(400)}
    n |= {"prefix" + "".join(r.choices("abc", k=5)): r.randint(3, 99) for _ in range(150)}  # one hot chunk
    n |= {"aaaaaa": 100, "aaaaaaa": 50, "aaaaaaaa": 25, "x": 1, "": 5, "y" * 500: 3, "y" * 501: 7}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    for hot in (1, 16, 10**6):
        monkeypatch.setattr(spelling, "HOT_WORDS", hot)
        pairs = [frozenset((p["a"], p["b"])) for p in spelling.near_pairs(words).collect()]
        assert len(pairs) == len(set(pairs))  # each once
        out = spelling.spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert {tuple(x) for x in out} == forms_by_hand(n) and len(out) == len(n)
    assert spelling.spelling_forms(words.limit(0)).count() == 0


def test_a_long_chain_of_forms(spark):
    chain = {"w" * k: 2 ** (30 - k) for k in range(5, 30)}
    out = spelling.spelling_forms(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()
    assert {r["root"] for r in out} == {"wwwww"} and len(out) == 25


def test_the_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = {w: k for w, k in counts_by_hand(docs, 97, 5).items() if k >= 3}
    out = spelling.op13_spelling(spark, sf)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in out.collect()} == forms_by_hand(n)
