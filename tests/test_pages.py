"""Hand-made cases of nested pages, merges, prefixes, exact tests and streams."""

import json
import math
from itertools import combinations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quorumlake.functions import cascade
from quorumlake.functions import distill as D
from quorumlake.functions import keys as K
from quorumlake.operators import consensus, link, publish, stats
from quorumlake.session import scratch
from quorumlake.sources import scans
from quorumlake.streaming import ingest

TEMPLATES = "array<struct<name:string,lang:string,term:string>>"


def pick(spark, *templates, own="pl"):
    df = spark.createDataFrame([([dict(zip(("name", "lang", "term"), t)) for t in templates],)], f"t {TEMPLATES}")
    r = df.select(D.etymon(F.col("t"), F.lit(own)).alias("e")).first()["e"]
    return None if r is None else (r["rank"], r["lang"], r["term"])


def test_etymon_by_rank_of_its_language(spark):
    assert pick(spark, ("bor", "de", "a"), ("bor", "la", "b"), ("der", "grc", "c")) == (6, "la", "b")
    assert pick(spark, ("bor", "it", "first"), ("bor", "fr", "second")) == (3, "it", "first")
    assert pick(spark, ("cog", "la", "no"), ("bor", "xx", "other")) == (1, "xx", "other")
    assert pick(spark, ("inh", "pl", "own"), ("bor", "la", "")) is None and pick(spark) is None


def test_triples_of_a_tree_template(spark):
    rows = [("ety", {"2": ":inh", "3": "zlw-opl:aloes<ref:x>"}), ("ety", {"2": ":bor", "3": "la:-"}), ("ety", {"3": "no colon"}), ("bor", {"2": ":inh", "3": "la:x"}), ("ety", {"2": ":der", "3": "grc: a:b "})]
    df = spark.createDataFrame(rows, "name string, args map<string,string>").select(F.struct("name", "args").alias("t"))
    got = [r["x"] and tuple(r["x"]) for r in df.select(D.triple(F.col("t")).alias("x")).collect()]
    assert got == [(":inh", "zlw-opl", "aloes"), None, None, None, (":der", "grc", "a:b")]


def test_nested_pages_from_lines_of_json(spark, tmp_path):
    leaf = {"lang": "c", "word": "3", "descendants": []}
    pages = [{"word": "a", "senses": [{"glosses": ["x", " y "], "form_of": None}, {"glosses": ["form"], "form_of": ["b"]}, {"glosses": ["x", ""]}], "d": [{"lang": "a", "word": "1", "descendants": [{"lang": "b", "word": "2", "descendants": [leaf]}]}, {"lang": "d", "word": ""}]},
             {"word": "marked elsewhere", "note": "mark"}, {"word": "b"}]
    (tmp_path / "dump.jsonl").write_text("\n".join([*map(json.dumps, pages), '{"word": "mark broken', ""]))
    schema = f"word string, senses array<struct<glosses:array<string>,form_of:array<string>>>, d {D.tree_type(3)}"
    got = scans.json_lines(spark, str(tmp_path), "word", schema, F.col("page.senses").isNotNull()).select("page.*")
    r = got.select("word", D.real_glosses(F.col("senses"), 5).alias("g"), D.descendants(F.col("d"), 3).alias("d")).collect()
    assert [(x["word"], x["g"], [tuple(d) for d in x["d"]]) for x in r] == [("a", ["x", "y"], [("a", "1"), ("b", "2"), ("c", "3")])]


def test_head_tokens_and_stemmed_sets(spark):
    df = spark.createDataFrame([("to ask; inquire, question (someone) / no",), ("head of state, the., etc",), (None,), ("x or Yes.",)], "g string")
    got = [(r["h"], sorted(r["s"])) for r in df.select(K.head_tokens(F.col("g"), ["the"]).alias("h"), K.stemmed_set(F.col("g"), ["to", "of", "the", "or"]).alias("s")).collect()]
    assert got[0] == (["ask", "inquire", "question"], ["ask", "inquire", "no", "question"]) and got[1][0] == ["etc"] and got[2] == ([], []) and got[3][0] == ["yes"]


def test_citation_forms_that_begin_with_their_place(spark):
    got = spark.createDataFrame([("0zero, 1one,  two2 ,3",)], "t string").select(K.citation_forms(F.col("t")).alias("f")).first()["f"]
    assert got == ["0zero", "1one", "two2", "3"]


def test_majority_prefix(spark):
    rows = [(1, "g", "po-a"), (2, "g", "po-b"), (3, "g", "c"), (4, "h", "po-d"), (5, "i", "za-e"), (6, "i", "po-f"), (7, "i", "x"), (8, "i", "y"), (9, "j", "za-k"), (10, "j", "po-l"), (11, "j", "za-m"), (12, "j", "po-n")]
    out = link.strip_majority_prefix(spark.createDataFrame(rows, "id long, g string, form string"), ["g"], "form", ["po-", "za-"])
    got = {r["id"]: (r["form"], r["stripped"]) for r in out.collect()}
    assert [got[i] for i in (1, 2, 3)] == [("a", True), ("b", True), ("c", False)] and got[4] == ("po-d", False) and got[5] == ("za-e", False)
    assert [got[i] for i in (9, 10, 11, 12)] == [("za-k", False), ("l", True), ("za-m", False), ("n", True)]


def test_links_and_repeated_kinds(spark):
    left = spark.createDataFrame([(1, "old ring", "n", ["old", "ring"]), (3, "old ring", "n", ["old", "ring"]), (5, "x", "n", [])], "id long, form string, pos string, toks array<string>")
    right = spark.createDataFrame([(4, "old ring", "n", ["old", "ring"]), (2, "old ring", "n", ["old", "ring"]), (0, "ring", "v", ["ring"])], "rid long, rform string, rpos string, rtoks array<string>")
    assert sorted(tuple(r) for r in link.fuzzy_link(left, right).collect()) == [(1, 2, 1.0), (3, 2, 1.0)]


def test_chase_with_a_repeated_key(spark):
    df = spark.createDataFrame([(1, 2, False), (2, 3, False), (2, 4, False), (3, None, True), (4, None, False)], "k long, p long, ok boolean")
    got = sorted(tuple(r) for r in link.chase_parents(df, "k", "p", F.col("ok")).where("k = 1").collect())
    assert got == [(1, 3, 2)]


@pytest.mark.parametrize("a,b", [(0, 0), (3, 9), (0, 8), (400, 523), (5000, 5200), (1_000_000, 1_002_000)])
def test_sign_test_of_any_size(spark, a, b):
    got = spark.createDataFrame([(a, b)], "a long, b long").select(stats.sign_test(F.col("a"), F.col("b")).alias("p")).first()["p"]
    n, m = a + b, min(a, b)
    want = min(1.0, 2 * math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(max(0, m - 40_000), m + 1)))
    assert got == pytest.approx(want, rel=1e-6)


def test_bootstrap_interval(spark):
    df = spark.range(5000).select((F.col("id") % 5 == 0).alias("hit"))
    r = stats.bootstrap(df, "hit").first()
    sd = math.sqrt(0.2 * 0.8 / 5000)
    assert abs(r["low"] - (0.2 - 1.96 * sd)) < 0.3 * sd and abs(r["high"] - (0.2 + 1.96 * sd)) < 0.3 * sd
    assert tuple(stats.bootstrap(df.where("hit"), "hit").first()) == (1.0, 1.0) and tuple(stats.bootstrap(df.limit(0), "hit").first()) == (0.0, 0.0)


def test_merged_arrays_and_form_records(spark):
    rows = spark.createDataFrame([("k", 2, ["b", "a"], ["t"]), ("k", 1, ["c", "b"], []), ("m", 1, [], [])], "k string, n long, x array<string>, y array<string>")
    got = {r["k"]: (r["x"], r["y"]) for r in consensus.merge_arrays(rows, "k", "n", {"x": 3, "y": 1}).collect()}
    assert got == {"k": (["c", "b", "a"], ["t"])}
    cells = spark.createDataFrame([("den / denj", "acc", "den", "inflection", 1), ("den", "nom", "den", "lemma", 2), ("—", "gen", "den", "inflection", 3), ("den", "acc", "den", "inflection", 4)], "c string, f string, l string, s string, o long")
    got = {r["key"]: tuple(r)[2:] for r in publish.form_records(cells, "c", "f", "l", "s", "o").collect()}
    assert got == {"den": ("den", "acc,nom", "lemma", 3), "denj": ("denj", "acc", "inflection", 1)}


def test_evidence_needs_two_tokens_and_fills_uncited_languages(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["z"])], "id long, toks array<string>")
    cand = spark.createDataFrame([(10, "ru", ["a", "b"]), (9, "ru", ["b", "a", "c"]), (8, "ru", ["a"]), (7, "cs", ["a", "c"]), (6, "pl", ["b", "c"])], "cand long, lang string, toks array<string>")
    cited = spark.createDataFrame([(1, "cs")], "id long, lang string")
    assert sorted(tuple(r) for r in link.augment_evidence(rows, cand, cited).collect()) == [(1, "pl", 6, 2), (1, "ru", 9, 3)]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([Row(v=i), Row(v=i)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(tuple(r) for r in ingest.drain(stream, "tally").collect()) == [(0, 2), (1, 2), (2, 2)]


def test_a_folder_of_events_is_a_stream_too(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for folder in (sf, str(tmp_path)):
        tally = ingest.drain(ingest.event_stream(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "events")
        assert {r["event_type"]: r["n"] for r in tally.collect()} == {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        scratch(Session(), "x")


def test_stages_and_blocking_rules(spark):
    df = spark.createDataFrame([("thing",), ("king",), ("ing",), ("seeing",)], "w string")
    rules = [cascade.Rule("end", "ing$", "in", stage=1, guard="^.{4,}$", unless="th"), cascade.Rule("th", "th", "t"), cascade.Rule("ee", "ee", "i")]
    got = {r["w"]: (r["rewritten"], [s["id"] for s in r["trace"]]) for r in cascade.apply_cascade(df, "w", rules).collect()}
    assert got == {"thing": ("ting", ["th"]), "king": ("kin", ["end"]), "ing": ("ing", []), "seeing": ("siin", ["ee", "end"])}
    with pytest.raises(ValueError):
        cascade.apply_cascade(df, "w", [cascade.Rule("a", "x", "y", unless="b"), cascade.Rule("b", "x", "y")])


def test_tables_with_tabs_and_stale_caches(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('id\tname\n1\t"two\nlines, and a ""quote"""\n2\tplain, with commas\n\t\n')
    (tmp_path / "c.csv").write_text("id,name\n1,a\n")
    t = scans.official_table(spark, str(tmp_path / "t.tsv"), StructType.fromDDL("id int, name string"))
    assert sorted(tuple(r) for r in t.collect()) == [(1, 'two\nlines, and a "quote"'), (2, "plain, with commas")]
    assert scans.official_table(spark, str(tmp_path / "c.csv"), StructType.fromDDL("id int, name string")).collect()[0]["name"] == "a"
    path = scans.write_versioned(spark.range(3), "numbers", 2)
    assert scans.read_versioned(spark, path, "numbers", 2).count() == 3
    for name, version in (("numbers", 3), ("letters", 2)):
        with pytest.raises(ValueError):
            scans.read_versioned(spark, path, name, version)


@pytest.mark.parametrize("a,b", [("kitten", "sitting"), ("abc", "abc"), ("", "ab"), ("ab", "ba"), ("abcd", "badc"), ("x", "abc")])
def test_near_words_share_what_deletions_leave(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(F.arrays_overlap(link.deletions(F.col("a"), 2), link.deletions(F.col("b"), 2)).alias("met"), F.levenshtein("a", "b").alias("d"), link.deletions(F.col("a"), 2).alias("x")).first()
    assert r["met"] or r["d"] > 2
    assert set(r["x"]) == {"".join(c) for n in range(max(0, len(a) - 2), len(a) + 1) for c in combinations(a, n)}


def test_pages_are_parsed_once(spark, sf):
    """the plan of a marker scan parses a line once."""
    from quorumlake.plans import queries_pages as P

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    path = P.write_pages(spark, sf)
    assert plan(P.distilled(spark, path)).count("from_json(") == 1
    assert plan(P.distilled(spark, path).select("etymon.rank", "etymon.lang")).count("array_max(") == 1


def test_the_chain_reads_the_dump_once(spark, sf):
    """gates are written, so the joins of the chase do not parse the dump again."""
    from quorumlake.plans import queries_pages as P

    assert "from_json(" not in P.job_extraction_chain(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
