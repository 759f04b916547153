"""Sharding shuffles the records once."""

from pyspark.sql import functions as F

from quorumlake.llm import shards
from quorumlake.session import scratch


def test_records_are_shuffled_once(spark, tmp_path):
    text = F.concat(*[F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(8)])
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), text.alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where what is joined is large
    spark.sparkContext.setJobGroup("shards", "shards")
    try:
        out = shards.write_shards(spark.read.parquet(str(tmp_path / "docs")), scratch(spark, "shards"), shards=7, stable=True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("shards") for s in tracker.getJobInfo(j).stageIds}
    moved = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    size = docs.select(F.sum(F.length("text"))).first()[0]
    assert out.count() == 2000 and 0 < moved < 1.3 * size, (moved, size)
