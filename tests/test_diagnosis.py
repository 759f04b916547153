"""Counterfactual votes by hand, and releases that write only what changed."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.operators import counterfactual as C
from quorumlake.operators import manifest as M
from quorumlake.session import scratch

VOTES = "item long, source string, branch string, cluster string, form string, wt long"


def test_counterfactuals_by_hand(spark):
    votes = [(1, "A", "e", "x", "xa", 5), (1, "B", "e", "x", "x", 5), (1, "C", "w", "x", "xa", 5), (1, "D", "s", "y", "y", 9),  # x wins; its priority form is x, its modal one xa
             (2, "A", "e", "p", "pp", 1), (2, "B", "e", "p", "pp", 1), (2, "D", "w", "q", "q", 1), (2, "C", "s", "q", "qq", 1),  # q: 2 branches of its own
             (3, "A", "e", "z", "zz", 1)]
    gold = spark.createDataFrame([(1, "y"), (2, "q"), (3, "not there")], "item long, gold string")
    table = C.cluster_table(spark.createDataFrame(votes, VOTES), gold, ["B", "C"])
    got = {(r["item"], r["config"]): r["form"] for r in C.counterfactuals(table, gold).collect()}
    assert [got[1, c] for c in C.LADDER] == ["x", "x", "x", "xa", "x", "y", "x", "y"]
    assert [got[2, c] for c in C.LADDER] == ["qq", "qq", "qq", "q", "q", "qq", "q", "q"]
    assert {got[3, c] for c in C.LADDER} == {"zz"}
    report = {r["config"]: (r["n"], r["fixed"], r["broke"], r["recovered"], r["delta"]) for r in C.headroom(C.counterfactuals(table, gold)).collect()}
    assert report["production"] == (3, 0, 0, 0, 0.0) and report["modal"] == (3, 1, 0, 1, 0.333333) and report["oracle cluster"] == (3, 1, 0, 1, 0.333333) and report["oracle all"] == (3, 2, 0, 2, 0.666667)


def files(path):
    root = path.removeprefix("file://")
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_releases(spark):
    path = scratch(spark, "releases")
    rows = spark.range(100).select("id", F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("v"))
    shard, schema = F.col("id") % 4, T.StructType([*rows.schema.fields, T.StructField("digest", T.StringType())])
    actions = lambda df: {r["shard"]: r["action"] for r in df.collect()}
    assert actions(M.publish(rows, shard, path)) == dict.fromkeys(range(4), "written")
    before = files(path)
    assert actions(M.publish(rows.orderBy(F.desc("id")).repartition(7), shard, path)) == dict.fromkeys(range(4), "kept")
    assert files(path) == before  # a second publication of equal data writes nothing
    new = rows.where("id % 4 <> 2").withColumn("v", F.when(F.col("id") == 5, F.lit("other")).otherwise(F.col("v")))
    assert actions(M.publish(new, shard, path)) == {0: "kept", 1: "written", 2: "removed", 3: "kept"}
    got = M.read_release(spark, path, schema)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, new.collect()), key=str)
    # back to the first rows: the old shards have their old digests
    before = files(path + "/data")
    assert actions(M.publish(rows, shard, path)) == {0: "kept", 1: "restored", 2: "restored", 3: "kept"}
    assert files(path + "/data") == before and sorted(map(tuple, M.read_release(spark, path, schema).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_repeated_rows_count_in_the_digest(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "a")], "id long, v string")
    one = lambda df: M.shard_digests(df, F.lit(0), ["id", "v"]).first()["digest"]
    assert one(rows) != one(rows.distinct()) and one(rows) == one(rows.orderBy(F.desc("id")))


def test_damaged_releases_are_refused(spark):
    path, rows = scratch(spark, "releases"), spark.range(10).toDF("id")
    M.publish(rows, F.lit(0), path)
    spark.read.parquet(f"{path}/data").write.mode("append").partitionBy("digest").parquet(f"{path}/data")
    with pytest.raises(ValueError):
        M.read_release(spark, path, T.StructType([T.StructField("id", T.LongType()), T.StructField("digest", T.StringType())]))
