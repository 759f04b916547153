"""The data source of gzip members: members, markers, stamps, files of others."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from quorumlake.session import scratch
from quorumlake.sources import members


def local(path):
    return path.removeprefix("file://")


@pytest.fixture(scope="module")
def folder(spark):
    path = scratch(spark, "members")
    rows = spark.range(0, 1000, 1, 3).select(F.to_json(F.struct("id", F.when(F.col("id") % 3 == 0, "é x").otherwise("y").alias("k"))))
    members.write_members(rows, path, "pages", 4, member_bytes=2000)
    return path


def test_members_and_markers(spark, folder):
    lists = [json.load(open(os.path.join(local(folder), f))) for f in os.listdir(local(folder)) if f.endswith(".members")]
    assert len(lists) == 3 and min(map(len, lists)) > 2
    df = members.read_members(spark, folder, "pages", 4, task_bytes=1)
    assert df.count() == 1000 and df.rdd.getNumPartitions() > 10
    assert df.where(F.contains("value", F.lit('"k":"y"'))).count() == 666
    assert members.read_members(spark, folder, "pages", 4, marker='"k":"é').count() == 334
    ids = df.select(F.from_json("value", "id long, k string").alias("x")).agg(F.sum("x.id"), F.count_distinct("x.id")).first()
    assert tuple(ids) == (499500, 1000)


def test_each_member_can_be_read_alone(folder):
    root = local(folder)
    for name in [f for f in os.listdir(root) if f.endswith(".json.gz")]:
        raw = open(os.path.join(root, name), "rb").read()
        for offset, length, lines in json.load(open(os.path.join(root, name + ".members"))):
            assert gzip.decompress(raw[offset:offset + length]).count(b"\n") == lines


@pytest.mark.parametrize("dataset,version", [("pages", 5), ("other", 4)])
def test_stale_stamps_are_refused(spark, folder, dataset, version):
    with pytest.raises(Exception, match="write it again"):
        members.read_members(spark, folder, dataset, version).count()


def test_other_counts_and_missing_stamps_are_refused(spark, folder):
    path = scratch(spark, "members")
    members.write_members(spark.createDataFrame([("a",), ("b",)], "v string"), path, "x", 1)
    assert members.read_members(spark, path, "x", 1).count() == 2
    stamp = os.path.join(local(path), "_stamp.json")
    with open(stamp) as f:
        kept = f.read()
    with open(stamp, "w") as f:
        f.write(kept.replace('"row_count": 2', '"row_count": 5'))
    with pytest.raises(Exception, match="should hold 5 lines"):
        members.read_members(spark, path, "x", 1).count()
    # files of others, plain and packed, count as lines too
    with open(os.path.join(local(path), "plain.json"), "w") as f:
        f.write("c\n")
    with open(os.path.join(local(path), "packed.json"), "wb") as f:
        f.write(gzip.compress(b"d\ne\n"))
    assert sorted(r["value"] for r in members.read_members(spark, path, "x", 1).collect()) == list("abcde")
    os.remove(stamp)
    with pytest.raises(Exception, match="no stamp"):
        members.read_members(spark, path, "x", 1).count()


def test_an_empty_table(spark):
    path = scratch(spark, "members")
    members.write_members(spark.createDataFrame([], "v string"), path, "x", 1)
    assert members.read_members(spark, path, "x", 1).count() == 0
