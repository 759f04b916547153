"""Releases by content: a manifest of shards, and publishing only what changed.

Every shard has a digest that does not depend on the order of its rows, and lies in a
folder of that name.  A release is the list of its shards and their digests; a shard
whose digest the release before has is not written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions.keys import one_zero
from quorumlake.session import written

SCHEMA = "shard int, digest string, records long, release int"


def shard_digests(rows: DataFrame, shard: Column, columns: list[str]) -> DataFrame:
    """(shard, digest, records): sums of the rows' digests, combined before the shuffle."""
    values = [one_zero(F.col(f"`{c}`"), rows.schema[c].dataType).alias(c) for c in columns]
    line = F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(line, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    sums = rows.groupBy(shard.cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("records"), *[p.alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select("shard", F.sha2(F.concat_ws(":", "shard", "records", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest"), "records")


def latest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest manifest of a folder and its number; 0 and no rows where none is."""
    try:
        known = spark.read.schema(SCHEMA).parquet(f"{path}/manifest")
        number = known.agg(F.max("release")).first()[0] or 0
    except Exception as e:  # the first release finds no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA), 0
    return known.where(F.col("release") == number), number


def publish(rows: DataFrame, shard: Column, path: str) -> DataFrame:
    """Write a release of ``rows`` below ``path`` and return (shard, digest, records,
    action): written, restored (an earlier release has it), kept or removed.  Shards go to
    ``data/digest=…``; a release equal to the one before writes nothing and has no number of its own."""
    spark = rows.sparkSession
    old, number = latest(spark, path)
    new = shard_digests(rows, shard, rows.columns)
    ever = spark.read.schema(SCHEMA).parquet(f"{path}/manifest").select(F.col("digest").alias("d")).distinct() if number else old.select(F.col("digest").alias("d"))
    new = new.join(ever, F.col("digest") == F.col("d"), "left")
    both = new.join(old.select(F.col("shard").alias("was"), F.col("digest").alias("old_digest"), F.col("records").alias("old_records")), F.col("shard") == F.col("was"), "full")
    action = F.when(F.col("shard").isNull(), "removed").when(F.col("digest") == F.col("old_digest"), "kept").when(F.col("d").isNotNull(), "restored").otherwise("written")
    plan = both.select(F.coalesce("shard", "was").alias("shard"), F.coalesce("digest", "old_digest").alias("digest"), F.coalesce("records", "old_records").alias("records"), action.alias("action"))
    plan = written(plan, "release")  # a row a shard
    if plan.where("action <> 'kept'").isEmpty():
        return plan
    changed = plan.where("action = 'written'").select(F.col("shard").alias("s"), "digest")
    if not changed.isEmpty():
        rows.select("*", shard.cast("int").alias("__shard")).join(changed, F.col("__shard") == F.col("s")).drop("s", "__shard").repartition("digest").write.mode("append").partitionBy("digest").parquet(f"{path}/data")
    plan.where("action <> 'removed'").select("shard", "digest", "records", F.lit(number + 1).alias("release")).write.mode("append").parquet(f"{path}/manifest")
    return plan


def read_release(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the newest release, after the number of records in each shard was tested."""
    known, _ = latest(spark, path)
    data = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(f"{path}/data")
    mine = data.join(known.select("digest", "records"), "digest")
    bad = known.join(mine.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digest", "left").where("n is null or n <> records")
    if not bad.isEmpty():
        raise ValueError(f"{path}: shards do not hold what the manifest says")
    return mine.drop("digest", "records")
