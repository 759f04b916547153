"""Links between rows: pairs, edges, backlinks and category trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def greedy_pairs(df: DataFrame, group: str, order: str, left: Column, right: Column) -> DataFrame:
    """One-to-one pairs in each group: in order, each left row takes the first
    right row that is free.  With no further test this is the pairing by rank, so
    two windows and an equi-join do it and no group is gathered."""
    n = F.row_number().over(W.partitionBy(group).orderBy(order))
    a = df.where(left).select(group, F.col(order).alias("left_key"), n.alias("__n"))
    b = df.where(right).select(group, F.col(order).alias("right_key"), n.alias("__n"))
    return a.join(b, [group, "__n"]).drop("__n")


def reciprocal(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.col(a).alias("source"), F.col(b).alias("target")).unionByName(pairs.select(F.col(b).alias("source"), F.col(a).alias("target")))


def family_edges(df: DataFrame, key: str, member: str, low: int = 2, high: int = 15) -> DataFrame:
    """All ordered pairs within groups of ``low`` to ``high`` members; larger groups are no families."""
    sized = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(key))).where((F.col("__n") >= low) & (F.col("__n") <= high))
    a, b = sized.select(key, F.col(member).alias("source")), sized.select(key, F.col(member).alias("target"))
    return a.join(b, key).where("source <> target").select("source", "target").distinct()


def page_links(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(source, target) of the distinct links of each page."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit('href="([^"]+)"'), 1))
    return pages.select(F.col(id_col).alias("source"), F.explode(found).alias("target"))


def backlinks(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target").agg(F.count(F.lit(1)).alias("links"), F.min("source").alias("first_source"))


def category_tree(df: DataFrame, path: list[str], member: str) -> DataFrame:
    """Every prefix of a category path with its level and distinct members: a rollup."""
    level = sum((F.grouping(c) == 0).cast("int") for c in path)
    return df.rollup(*path).agg(F.count_distinct(member).alias("members"), level.alias("level"))
