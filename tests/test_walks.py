"""Greedy walks in rounds against the walk in order."""

import random

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import textcheck, walks


def related(a, b):
    return a.startswith(b) or b.startswith(a) or a.endswith(b) or b.endswith(a) or (len(a) > 1 and len(b) > 1 and a[:2] == b[:2])


def walk_pairs(left, right):
    out = set()
    for g in {r[0] for r in left}:
        used = set()
        for _, k, i in sorted((r for r in left if r[0] == g and r[1] is not None), key=lambda r: r[2]):
            mine = [j for h, kk, j in sorted(right, key=lambda r: r[2]) if h == g and kk is not None and j not in used and related(k, kk)]
            if mine:
                used.add(mine[0])
                out.add((g, i, mine[0]))
    return out


def matched(spark, left, right):
    a, b = spark.createDataFrame(left, "g string, key string, left long"), spark.createDataFrame(right, "g string, key string, right long")
    return walks.greedy_match(a, b, walks.root_related(a, b, "g"), "g")


@pytest.mark.parametrize("rounds", [8, 0])
def test_pairs_equal_the_walk(spark, monkeypatch, rounds):
    monkeypatch.setattr(walks, "ROUNDS", rounds)
    r = random.Random(rounds)
    key = lambda: r.choice([None, *("".join(r.choices("brt", k=r.randint(0, 3))) for _ in range(12))])
    left = [(f"g{r.randint(0, 9)}", key(), i) for i in range(150)]
    right = [(f"g{r.randint(0, 9)}", key(), i) for i in range(1000, 1130)]
    got = [tuple(x) for x in matched(spark, left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == walk_pairs(left, right)


def test_chains_of_losers(spark):
    """Each left row wants what the one before it takes: a round settles little."""
    left = [("g", "br" if i % 2 else "brt", i) for i in range(24)]
    right = [("g", "brt" if i % 3 else "br", 100 + i) for i in range(20)]
    assert {tuple(x) for x in matched(spark, left, right).collect()} == walk_pairs(left, right)


def test_a_group_of_a_hundred_thousand(spark):
    a = spark.range(100_000).select(F.lit("hot").alias("g"), F.concat(F.lit("k"), (F.col("id") % 3 + 7).cast("string")).alias("key"), F.col("id").alias("left"))
    b = spark.range(100_000).select(F.lit("hot").alias("g"), F.concat(F.lit("k"), (F.col("id") % 3 + 7).cast("string")).alias("key"), F.col("id").alias("right"))
    out = walks.greedy_match(a, b, walks.root_related(a, b, "g"), "g")
    assert out.count() == 100_000 and out.where("left <> right").isEmpty()


def test_matches_of_empty_tables(spark):
    assert matched(spark, [], []).count() == 0 and matched(spark, [("g", "b", 1)], []).count() == 0


def walk_sets(rows):
    kept = []
    for g in {r[0] for r in rows}:
        seen = set()
        for _, o, i, toks in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            if not toks or not seen & set(toks):
                seen |= set(toks)
                kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("rounds", [8, 0])
def test_suppression_equals_the_walk(spark, monkeypatch, rounds):
    monkeypatch.setattr(walks, "ROUNDS", rounds)
    r = random.Random(rounds + 10)
    rows = [(f"g{r.randint(0, 5)}", r.randint(0, 20), i, r.choices("abcdefghij", k=r.randint(0, 3))) for i in range(200)]
    rows += [("chain", i, 1000 + i, [str(i), str(i + 1)]) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, o long, id long, t array<string>")
    assert sorted(x["id"] for x in walks.greedy_suppress(df, "g", ["o"], "id", "t").collect()) == walk_sets(rows)
    assert walks.greedy_suppress(df.limit(0), "g", ["o"], "id", "t").count() == 0


def test_longest_matches_equal_the_walk(spark):
    r = random.Random(1)
    phrases = [" ".join(r.choices("abc", k=n)) for n in (1, 2, 2, 2, 3, 3, 3)]
    texts = {u: r.choices("abcd", k=n) for u, n in enumerate([0, 1, 2, 3, 50, 400])}
    texts[9] = ["a"] * 333
    phrases.append("a a a")
    want = set()
    for u, words in texts.items():
        i = 0
        while i < len(words):
            n = next((n for n in (3, 2, 1) if " ".join(words[i:i + n]) in phrases and i + n <= len(words)), 0)
            if n:
                want.add((u, i, n, " ".join(words[i:i + n])))
            i += n or 1
    rows = [(u, i, w) for u, words in texts.items() for i, w in enumerate(words)]
    index = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = textcheck.longest_matches(spark.createDataFrame(rows, "u long, pos int, token string"), index, ["u"]).select("u", "pos", "n", "phrase").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_a_text_of_a_million_words(spark):
    words = spark.range(1_000_000).select(F.lit(1).alias("u"), F.col("id").cast("int").alias("pos"), F.lit("la").alias("token"))
    got = textcheck.longest_matches(words, spark.createDataFrame([("la la la",), ("la",)], "phrase string"), ["u"])
    assert got.agg(F.count(F.lit(1)), F.sum("n"), F.max(F.when(F.col("n") == 3, F.col("pos") % 3))).first() == (333_334, 1_000_000, 0)


def test_an_index_too_large_to_broadcast_gives_the_same(spark, monkeypatch):
    """both joins, and words that bring those behind them, give the same matches."""
    texts = spark.createDataFrame([(1, "a b c a b a d a b c a".split()), (2, []), (3, ["a"]), (4, ["b", "a", "b"] * 40)], "u long, t array<string>")
    index = spark.createDataFrame([(p,) for p in ("a", "a b", "b a b", "c a b", "a d a")], "phrase string")
    plain = texts.select("u", F.posexplode("t").alias("pos", "token"))
    ahead = texts.select("u", F.posexplode(textcheck.words_ahead(F.col("t"))).alias("pos", "w")).select("u", "pos", "w.*")
    got = []
    for most in (0, 500_000):
        monkeypatch.setattr(textcheck, "BROADCAST_PHRASES", most)
        got += [sorted(tuple(r) for r in textcheck.longest_matches(words, index, ["u"]).collect()) for words in (plain, ahead)]
    assert all(g == got[0] for g in got) and [(u, pos, n) for u, pos, n, _ in got[0] if u == 1] == [(1, 0, 2), (1, 2, 3), (1, 5, 3), (1, 10, 1)]


def test_spans_and_pairs_are_made_in_the_row(spark, sf, monkeypatch):
    """no word is shuffled before it has matched."""
    from quorumlake.plans import queries_text

    seen = []
    monkeypatch.setattr(textcheck, "_taken", lambda best, unit, most: seen.append(best) or best)
    queries_text.j22(spark, sf)
    for df in (*seen, queries_text._phrases(spark, sf)):
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
