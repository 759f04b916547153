"""The whole publication: components, matches, fates, edges and indexes, each written
in shards and counted as read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators import publish as B
from quorumlake.plans.base import QUERIES, SQLS, query
from quorumlake.session import scratch

#: Published tables: query and key.
TABLES = {"components": ("j1_components", "id"), "matches": ("j11_authoritative_match", "id"), "representatives": ("w7_one_per_row", "rid"), "fates": ("j12_row_fates", "token"),
          "kept": ("w8_suppression", "id"), "pairs": ("j34_reciprocal_links", "source"), "index": ("a26_ranked_index", "skey")}
SHARDS = 16


def _sql() -> str:
    return " union all ".join(f"select '{t}' as part, count(*) as rows, count(distinct {k}) as keys from ({SQLS[q]})" for t, (q, k) in TABLES.items())


def published(spark: SparkSession, table: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """``table`` written in shards of its key's hash, and read back."""
    path = scratch(spark, "published")
    B.write_sharded(table.withColumn("__key", F.col(key).cast("string")), "__key", shards, path)
    return spark.read.parquet(path).drop("__key", "shard")


@query("job_publish", _sql())
def job_publish(spark: SparkSession, sf: str) -> DataFrame:
    counts = []
    for name, (q, key) in TABLES.items():
        back = published(spark, QUERIES[q](spark, sf), key)
        counts.append(back.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).select(F.lit(name).alias("part"), "rows", "keys"))
    return reduce(DataFrame.unionByName, counts)
