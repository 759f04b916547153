"""Small hand-made cases of the operators: published expectations, ties and abstentions."""

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import cascade, keys as K
from quorumlake.operators import consensus, graph, link, stats, textcheck, walks
from quorumlake.operators.cluster import connected_components


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("word,want", [("běly", "bely"), ("rųka", "ruka"), ("mȯre", "more"), ("moŕe", "more"), ("måly", "maly"), ("međa", "medža"), ("noćь", "nočь")])
def test_standard_fold(spark, word, want):
    assert one(spark, word, K.to_standard) == want


@pytest.mark.parametrize("word,want", [("vodå", "voda"), ("běly", "bely"), ("žaba", "zaba"), ("moře", "more"), ("Łódź", "lodz")])
def test_skeleton(spark, word, want):
    assert one(spark, word, K.ascii_skeleton) == want


def test_consonant_keys(spark):
    key = lambda w: one(spark, w, K.consonant_key)
    assert key("golova") == key("glava") == "glv" and key("holova") == "glv" and key("anna") == "n" and key("nana") == "nn"
    df = spark.createDataFrame([("bbk", "bbk", True), ("bb", "bbk", True), ("prstr", "prst", True), ("strc", "bbk", False), ("", "x", True)], "a string, b string, want boolean")
    assert df.where(K.shares_consonant_root(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_cells_and_citations(spark):
    cells = lambda c: [tuple(r) for r in one(spark, c, K.split_cell)]
    assert cells("!dom, (x (y)) kuća; 'hiša'. / 42 / [z]") == [("dom", True), ("kuća", False), ("hiša", False)]
    assert cells("a (unclosed, b") == [("a", False)]
    forms = lambda c: one(spark, c, K.citation_forms)
    assert forms("iměti, imati") == ["iměti", "imati"] and forms("pozirati (na)") == ["pozirati"] and forms("dobry, #dobrějši, !dobrěje, *dobro") == ["dobry"]
    assert forms("pęt na desęte") == ["pęt na desęte"] and forms("a (b, c), a") == ["a"]


@pytest.mark.parametrize("codes,want", [("v", ["be", "ru", "uk"]), ("cz~", ["cs", "sk"]), ("bm", ["bg", "mk"]), ("(sh)", ["bs", "hr", "sr"]), ("yu", ["bs", "hr", "sl", "sr"]), ("sb", ["dsb", "hsb"]), ("ps", []), ("", []),
                                        ("j yu mk", ["bg", "bs", "hr", "mk", "sl", "sr"])])
def test_group_expansion(spark, codes, want):
    assert one(spark, codes, lambda c: K.expand_groups(c, K.LANGUAGE_GROUPS, K.LANGUAGES)) == want


def test_hashes(spark):
    assert one(spark, "12345", K.fnv1a32) == 1136836824 and one(spark, "", K.fnv1a32) == 2166136261

    def fnv64(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h % 4 == 0

    rows = spark.range(300).select(F.col("id").cast("string").alias("t")).select("t", K.is_holdout(F.col("t")).alias("h")).collect()
    assert all(r["h"] == fnv64(r["t"]) for r in rows)


def test_breaks_between_words(spark):
    got = one(spark, "Dom, čij-nebųď dom- 'x", K.tokens_with_breaks)
    assert [tuple(r) for r in got] == [("dom", True), ("čij-nebųď", True), ("dom", False), ("x", True)]


def test_cascade_logs_changes_only(spark):
    df = spark.createDataFrame([("abba",)], "w string")
    r = cascade.apply_cascade(df, "w", [cascade.Rule("one", "b", "p"), cascade.Rule("none", "q", "r"), cascade.Rule("guarded", "a", "o", guard="^x")]).first()
    assert r["rewritten"] == "appa" and [tuple(s) for s in r["trace"]] == [("one", "abba", "appa")]


def test_ties(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "g int, v string")
    assert {r["g"]: r["m"] for r in consensus.mode_greatest(df, ["g"], "v", "m").collect()} == {1: "b", 2: "z"}
    m = spark.createDataFrame([(1, "ab", 2), (1, "ac", 1)], "g int, f string, o int")
    assert consensus.medoid(m, ["g"], "f", "o").first()["medoid"] == "ac"


def test_ambiguous_exact_key_abstains(spark):
    words = spark.createDataFrame([("Aa", 1), ("Aa", 2), ("bb", 3), ("Bb", 4), ("c", 5)], "w string, id int")
    q = spark.createDataFrame([("Aa",), ("aa",), ("bb",), ("BB",), ("C",)], "w string")
    got = {r["w"]: r["resolved"] for r in link.resolve_headwords(q, words, "w", F.lower("w"), "id").collect()}
    assert got == {"Aa": None, "aa": None, "bb": 3, "BB": None, "C": 5}


def test_pointer_chain_of_four_hops(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, None)], "k long, p long")
    got = {r["k"]: (r["end"], r["hops"]) for r in link.chase_parents(df, "k", "p", F.col("k") == 5).collect()}
    assert got[1] == (5, 4) and got[0] == (None, None) and got[5] == (5, 0) and got[6] == (None, None)


def test_isotonic_fills_empty_bins(spark):
    bins = spark.createDataFrame([(1, 0.5, 10), (2, 0.2, 30), (5, 0.9, 5)], "bin int, v double, w long")
    got = [round(r["p"], 6) for r in stats.isotonic(bins, "v", "w").orderBy("bin").collect()]
    assert got == [0.275, 0.275, 0.275, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9]


def test_sign_test(spark):
    df = spark.createDataFrame([(0, 0), (5, 0), (3, 3), (8, 2)], "f long, b long")
    got = [round(r["p"], 6) for r in df.select(stats.sign_test(F.col("f"), F.col("b")).alias("p")).collect()]
    assert got == [1.0, 0.0625, 1.0, 0.109375]


def test_empty_token_sets_never_suppress(spark):
    df = spark.createDataFrame([(1, 1, 1, []), (1, 2, 2, []), (1, 3, 3, ["a"]), (1, 4, 4, ["a", "b"]), (1, 5, 5, ["b"])], "g int, o int, id long, t array<string>")
    assert sorted(r["id"] for r in walks.greedy_suppress(df, "g", ["o"], "id", "t").collect()) == [1, 2, 3, 5]


def test_components(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_snapshots_refuse_repeated_ids(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "id long, v string")
    with pytest.raises(ValueError):
        link.snapshot_diff(a, a, "id", ["v"])
    b = spark.createDataFrame([(1, "x")], "id long, v string")
    assert link.snapshot_diff(b, b, "id", ["v"]).count() == 0


def test_families_and_pairs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, k string")
    assert sorted(tuple(r) for r in graph.family_edges(df, "k", "id").collect()) == [(1, 2), (2, 1)]


def test_longest_match_uses_words_once(spark):
    words = spark.createDataFrame([(1, i, t) for i, t in enumerate("a b c a b d".split())], "u int, pos int, token string")
    phrases = spark.createDataFrame([("a b c",), ("b c",), ("a b",), ("d",)], "phrase string")
    got = sorted((r["pos"], r["phrase"]) for r in textcheck.longest_matches(words, phrases, ["u"]).collect())
    assert got == [(0, "a b c"), (3, "a b"), (5, "d")]
