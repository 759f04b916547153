"""Publishing: sharded lookup indexes, prefix buckets, numbering and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.functions import keys as K


def with_shard(df: DataFrame, key: str, shards: int) -> DataFrame:
    return df.withColumn("shard", K.shard_of(F.col(key), shards))


def shard_meta(df: DataFrame, key: str, shards: int, payload: Column) -> DataFrame:
    """(shard, records, keys, bytes) of each shard."""
    return with_shard(df, key, shards).groupBy("shard").agg(F.count(F.lit(1)).alias("records"), F.count_distinct(key).alias("keys"), F.sum(F.octet_length(payload)).alias("bytes"))


def write_sharded(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Records by shard, ordered by key; one task writes a shard."""
    with_shard(df, key, shards).repartition("shard").sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(path)


def prefix_buckets(df: DataFrame, words: Column, payload: Column, budget: int) -> DataFrame:
    """(bucket, row columns): each row in the bucket of every word that finds it;
    a one-letter bucket above ``budget`` bytes is split by its second letter."""
    each = df.select("*", F.explode(F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.left(w, F.lit(2))))).alias("__b2"), F.octet_length(payload).alias("__bytes"))
    size = each.groupBy(F.left("__b2", F.lit(1)).alias("__b1")).agg(F.sum("__bytes").alias("__total"))  # one row a letter
    each = each.withColumn("__b1", F.left("__b2", F.lit(1))).join(size, "__b1")
    return each.withColumn("bucket", F.when(F.col("__total") > budget, F.col("__b2")).otherwise(F.col("__b1"))).drop("__b1", "__b2", "__bytes", "__total").distinct()


def systematic_sample(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Every n/parts-th row in order.  Ranks come from a sort by ranges and the
    counts of its partitions, so no window holds the whole table."""
    ranked = global_rank(df, order)
    n = df.count()
    step = max(1, n // parts)
    return ranked.where((F.col("rank") - 1) % step == 0)


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """``rank`` from 1 in a total order: range partitions, counts, offsets."""
    from quorumlake.session import shuffle_partitions, written

    parts = shuffle_partitions(df.sparkSession)
    ranged = written(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ranged")
    before = F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))  # one row a partition
    offsets = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).select("__p", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "__p").withColumn("rank", (F.col("before") + inside).cast("long")).drop("__p", "before")


def numbered_slugs(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """``slug`` of each title, equal ones numbered from the second on."""
    df = df.withColumn("__s", K.slug(F.col(title)))
    n = F.row_number().over(W.partitionBy("__s").orderBy(*order))
    return df.withColumn("__n", n).withColumn("slug", F.concat("__s", F.when(F.col("__n") > 1, F.concat(F.lit("-"), F.col("__n").cast("string"))).otherwise(F.lit("")))).drop("__s", "__n")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_flat(df: DataFrame, path: str, kind: str, order: list[str]) -> None:
    """A small report as one sorted JSON or CSV file."""
    one = df.orderBy(*order).coalesce(1)
    one.write.json(path) if kind == "json" else one.write.option("header", True).csv(path, sep="\t" if kind == "tsv" else ",")


def form_records(cells: DataFrame, cell: str, feats: str, lemma: str, source: str, order: str) -> DataFrame:
    """(key, lemma, form, analyses, source, cells): cells split at ``/`` into variants;
    records of one key and lemma have the first form, distinct analyses in order, and
    the source ``lemma`` if any cell has it."""
    each = cells.select(order, feats, lemma, source, F.explode(F.split(cell, "/")).alias("form")).withColumn("form", F.trim("form")).where(~F.col("form").isin("", "—"))
    each = each.withColumn("key", F.replace(F.lower("form"), F.lit("-"), F.lit("")))
    first = each.groupBy("key", lemma, feats).agg(F.min(order).alias("o"), F.min_by("form", order).alias("form"), F.max((F.col(source) == "lemma").cast("int")).alias("is"), F.count(F.lit(1)).alias("n"))
    g = first.groupBy("key", lemma).agg(F.min_by("form", "o").alias("form"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", feats))), lambda s: s[feats]), ",").alias("analyses"), F.max("is").alias("is"), F.sum("n").alias("cells"))
    return g.select("key", lemma, "form", "analyses", F.when(F.col("is") == 1, "lemma").otherwise("inflection").alias("source"), "cells")
