"""Data-quality checks: queries whose result should be empty, and invariant censuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_reverse(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges without their reverse."""
    back = edges.select(F.col(b).alias(a), F.col(a).alias(b))
    return edges.select(a, b).join(back, [a, b], "left_anti")


def check_invariants(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(rule, checked, passed) of rules name -> (applies, holds), in one pass."""
    sums = [F.struct(F.lit(name).alias("rule"), F.count_if(applies).alias("checked"), F.count_if(applies & holds).alias("passed")) for name, (applies, holds) in rules.items()]
    return df.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def out_of_range(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    return df.where(~((F.col(value) > low) & (F.col(value) < high)))


def lexicon_violations(df: DataFrame, word: str, pos: str, allowed: list[str], gender: str, gloss: str, fold: Column) -> DataFrame:
    """Offending rows with the first rule that each breaks."""
    from pyspark.sql import Window as W

    n = F.count(F.lit(1)).over(W.partitionBy(fold))
    rule = (F.when(F.contains(word, F.lit(" ")), "several tokens").when(~F.col(pos).isin(allowed), "class").when((F.col(pos) == allowed[0]) & (F.col(gender) == ""), "gender")
            .when(F.col(gloss) == "", "gloss").when(n > 1, "repeated"))
    return df.withColumn("rule", rule).where("rule is not null")
