"""Hand-made pages for every pick of the distiller, and pages that wait in a stream."""

import random

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import distill as D
from quorumlake.functions import keys as K
from quorumlake.session import scratch
from quorumlake.streaming import pending

SCHEMA = "templates array<struct<name:string,args:map<string,string>>>"


def picked(spark, templates, build):
    rows = [([(n, {str(i): a for i, a in enumerate(args, 1) if a is not None}) for n, *args in templates],)]
    got = spark.createDataFrame(rows, SCHEMA).select(build(F.col("templates")).alias("x")).first()["x"]
    return tuple(got) if isinstance(got, tuple) else got


@pytest.mark.parametrize("templates,want", [
    ([("bor", "pl", "fr", "beau"), ("der", "pl", "la", "bellus"), ("der", "pl", "ML.", "other")], (6, "la", "bellus")),
    *[([("bor", "pl", "xx", "one"), ("bor", "pl", code, "two")], (rank, code, "two")) for code, rank in D.ETYMON_RANK.items()],
    ([("bor", "pl", "xx", "one"), ("lbor+", "pl", "yy", "two")], (1, "xx", "one")),
    ([("bor", "pl", "sla-pro", "one"), ("inh", "pl", "la", "two"), ("cog", "pl", "la", "three")], None),
    ([("derived", "pl", "la", "-"), ("borrowed", "pl", "la", " "), ("bor+", "pl", " el ", "  word<id:1> ")], (5, "el", "word")),
    ([("bor", None, None, None)], None), ([], None)])
def test_sources(spark, templates, want):
    assert picked(spark, templates, lambda t: D.source_pick(t, ["sla-pro", "sla", "pl"])) == want


@pytest.mark.parametrize("templates,want", [
    ([("inh", "ru", "sla-pro", "*voda")], "*voda"), ([("der+", "ru", "sla-pro", "voda<id:x>")], "*voda"), ([("inh", "ru", "orv", "voda")], None),
    ([("inh", "ru", "sla-pro", "*"), ("inherited", "ru", "sla-pro", "*per-"), ("inh", "ru", "sla-pro", "-ъkъ"), ("inh", "ru", "sla-pro", "*12"), ("derived", "ru", "sla-pro", "%D0%B2oda")], "*вoda"),
    ([("bor", "ru", "sla-pro", "*voda"), ("inh", "ru", "sla-pro", None)], None)])
def test_ancestors(spark, templates, want):
    assert picked(spark, templates, lambda t: D.ancestor_pick(t, "sla-pro")) == want


@pytest.mark.parametrize("templates,want", [
    ([("inh", "pl", "zlw-opl", "aloes<x>")], ("zlw-opl", "aloes")), ([("ety", "pl", ":inh", "zlw-opl:aloes<ref>")], ("zlw-opl", "aloes")), ([("ety", "pl", ":bor", "zlw-opl:aloes")], None),
    ([("inh", "pl", "zlw-opl", "-"), ("ety", "pl", ":inh", "zlw-opl"), ("ety", "pl", ":inh", "orv:x"), ("inh+", "pl", "zlw-opl", "b")], ("zlw-opl", "b"))])
def test_old_stages(spark, templates, want):
    assert picked(spark, templates, lambda t: D.stage_parent(t, ["zlw-opl"])) == want


def test_needles_and_stems(spark):
    df = spark.createDataFrame([("From Proto-X *ab, cf. *cd", ["verbs", "Proto masculine N-stem nouns", "a-stem"]), ("From Proto-X none", ["verbs"]), ("*ab before Proto-X", [None]), ("nothing", None)], "t string, c array<string>")
    assert [tuple(r) for r in df.select(D.after_needle(F.col("t"), "Proto-X"), D.stem_class(F.col("c"))).collect()] == [("*ab", "Proto masculine N-stem nouns"), ("", None), ("", None), ("", None)]


@pytest.mark.parametrize("raw,want", [("a%C3%A9b", "aéb"), ("a%ff%C3%A9b", "a%ff%C3%A9b"), ("%", "%"), ("%4", "%4"), ("%zz+%41", "%zz+A"), ("a%EF%BF%BDb", "a�b"), ("%ff%EF%BF%BD", "%ff%EF%BF%BD"), ("�%41", "�A"), ("", ""), (None, None)])
def test_percent_escapes(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(K.percent_decoded(F.col("s"))).first()[0] == want


def test_pages_wait_for_their_parents_in_any_order(spark):
    rows = [(str(i), str(i // 3) if i >= 3 else None, f"e{i}" if i % 11 == 2 else None) for i in range(60)] + [("orphan", "none such", None), ("self", "self", None)]
    known = {i: (p, v) for i, p, v in rows}

    def by_hand(i, hops=2):
        for h in range(hops + 1):
            if i not in known:
                return None
            if known[i][1]:
                return known[i][1], h
            i = known[i][0]
        return None

    want = {i: by_hand(i) for i in known if by_hand(i)}
    schema = "id string, parent string, value string"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for seed in (1, 2):
            random.Random(seed).shuffle(rows)
            path, (out, checkpoint) = scratch(spark, "arriving"), pending.scratch_paths(spark)
            spark.createDataFrame(rows[:30], schema).coalesce(1).write.parquet(path)
            stream = spark.readStream.schema(schema).parquet(path)
            pending.drain_settled(stream, out, checkpoint, hops=2)
            spark.createDataFrame(rows[30:], schema).coalesce(1).write.mode("append").parquet(path)
            pending.drain_settled(stream, out, checkpoint, hops=2)  # goes on where it stopped
            got = spark.read.schema("id string, value string, hops int").parquet(out).collect()
            assert {r["id"]: (r["value"], r["hops"]) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_pages_wait_without_python_a_key(spark, tmp_path):
    schema = "id string, parent string, value string"
    spark.createDataFrame([("a", None, "v")], schema).write.parquet(str(tmp_path / "in"))
    plan = pending.settled_pages(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))._jdf.queryExecution().logical().toString()
    assert "Join Inner" in plan and "TransformWithState" not in plan  # a call of Python for each key and hop took too long
