"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records over memory-sized buckets by a seeded hash of their
place in the input; pass 2 shuffles each bucket (Fisher-Yates, Spark's own
``shuffle``) and writes it.  The buckets end to end are one random order of all
records; shard s is its s-th equal slice, so shards differ by one row at most
(the law ``rows``).  DataFrame functions only.

A bucket is put in the order of places before it is shuffled, so the seed alone
fixes the result.  The hash is of the place and not of the key, so a key, source or text that a
third of the rows share is spread like any other.  A bucket is the only thing
gathered in one task, and its size is a parameter; beyond BUCKETS buckets they grow
with the data (500 MB each at 100 TB) instead of their number.

Defined results: null text has no bytes (size is the overhead alone, crc32 that
of the empty text); texts of any length are whole records; repeated rows are records of their own; an empty table
gives no rows; extra columns are written along, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.session import scratch, shuffle_partitions, written

#: Bytes of records that a bucket holds on average.
BUCKET_BYTES = 16 << 20
#: Buckets at most (reducers of the scatter, and rows that one task sums for the offsets).
BUCKETS = 200_000


def write_shards(docs: DataFrame, path: str, *, shards: int, seed: int = 0, text: str = "text", overhead: int = 16,
                 bucket_bytes: int = BUCKET_BYTES, stable: bool = False) -> DataFrame:
    """Write ``docs`` as Parquet folders shard=0 … below ``path`` and return
    them as read back: (record: the input's columns, size, slot, shard).

    stable: whether ``docs`` is a plain scan of files, so that each row has the
    same place in every pass; any other plan is written as a table first.
    """
    spark = docs.sparkSession
    if not stable:
        docs = written(docs, "records")
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + overhead
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), size.alias("size"),
                       F.monotonically_increasing_id().alias("place"))
    total = docs.select(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(min(math.ceil((total["b"] or 0) / bucket_bytes), BUCKETS), shuffle_partitions(spark))
    scattered = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(buckets)).cast("int"))
    # offsets: one row a bucket
    before = F.sum("rows").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    packed = (scattered.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "place").groupBy("bucket")
              .agg(F.collect_list(F.struct("record", "size")).alias("all")))
    at = F.col("before") + F.col("pos")
    shard = F.expr(f"(before + pos) * {shards} div {max(1, total['n'])}")
    # a row a bucket, BUCKETS at most: broadcast, as a join by key would shuffle all records once more
    out = (packed.join(F.broadcast(counts), "bucket")
           .select("before", F.posexplode(F.shuffle("all", F.lit(seed + 1))).alias("pos", "one"))
           .select("one.record", "one.size", at.alias("at"), shard.cast("int").alias("shard")))
    first = F.expr(f"(shard * {max(1, total['n'])}L + {shards - 1}) div {shards}")
    out = out.select("record", "size", (F.col("at") - first).cast("long").alias("slot"), "shard")
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def op9_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = write_shards(docs, scratch(spark, "shards"), shards=40, seed=9, stable=True)
    crc = F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary"))
    return out.select("record.doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
