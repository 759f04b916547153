"""Ranked lookup: keys of rows, best candidates of keys, fallback ladders and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def search_keys(df: DataFrame, id_col: str, forms: list[Column], least: int = 2) -> DataFrame:
    """(id, skey, rank): keys of each row in order of preference, the least rank of equal ones."""
    keys = F.array(*[F.struct(f.alias("skey"), F.lit(i + 1).alias("rank")) for i, f in enumerate(forms)])
    each = df.select(id_col, F.explode(keys).alias("k")).select(id_col, "k.skey", "k.rank").where(F.length("skey") >= least)
    return each.groupBy(id_col, "skey").agg(F.min("rank").alias("rank"))


def ranked_index(rows: DataFrame, key: str, entry: str, status: Column, match: Column, p: Column, keep: int | None = None) -> DataFrame:
    """(key, entry, rank, place): the best rank of each (key, entry), placed by rank and entry."""
    best = rows.select(key, entry, (status + match + F.round(10 * p)).cast("int").alias("rank")).groupBy(key, entry).agg(F.max("rank").alias("rank"))
    placed = best.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("rank"), entry)))
    return placed if keep is None else placed.where(F.col("place") <= keep)


def ladder(queries: DataFrame, levels: list[tuple[int, Column]], index: DataFrame, query: str, key: str, entry: str, verified: str) -> DataFrame:
    """(query, level, entry, verified): hits of each query at all levels up to the
    first that has a verified one, least entry of each kind."""
    asked = queries.select(query, F.explode(F.array(*[F.struct(F.lit(n).alias("level"), k.alias("__keys")) for n, k in levels])).alias("x")).select(query, "x.level", F.explode("x.__keys").alias("__key"))
    hits = asked.where("__key <> ''").distinct().join(index.select(F.col(key).alias("__key"), entry, verified), "__key")
    stop = F.min(F.when(F.col(verified), F.col("level"))).over(W.partitionBy(query))
    upto = hits.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("level") <= F.col("__stop")))
    return upto.groupBy(query, verified).agg(F.min(F.struct("level", entry)).alias("x")).select(query, verified, "x.level", f"x.{entry}")


def query_score(query: Column, title: Column, fold_q: Column, fold_t: Column, rank: Column) -> Column:
    """Tiers of a match between a query and a title."""
    return F.greatest(F.when(query == title, 100), F.when(fold_q == fold_t, 90), F.when(title.startswith(query), 85 - 3 * rank), F.when(fold_t.startswith(fold_q), 60 - 0 * rank),
                      F.when(F.contains(title, query), 40), F.lit(0)).cast("int")
