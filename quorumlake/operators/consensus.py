"""Votes across sources and source groups.

Inputs are long tables (item, source, branch, vkey, place): one row a form, with
place 1 the primary form of a source, which alone votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def vote_groups(votes: DataFrame, weights: DataFrame, keep: int = 3) -> DataFrame:
    """(item, vkey, vote, n_sources, weight, subvote, agreement, branches, rank):
    groups of agreeing primaries of each item, the best ``keep`` of them.

    One aggregation by (item, vkey, branch) feeds everything: counts add up to
    groups, and windows over the few groups of an item give the totals present.
    """
    one = votes.where("place = 1").join(weights, "source", "left")
    cell = one.groupBy("item", "vkey", "branch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("wt", F.lit(0))).alias("w"))
    cell = cell.withColumn("present", F.sum("n").over(W.partitionBy("item", "branch")))
    group = cell.groupBy("item", "vkey").agg(F.sum("n").alias("n_sources"), F.sum("w").alias("weight"), F.sum(F.col("n") / F.col("present")).alias("subvote"),
                                             F.count(F.lit(1)).alias("branches"))
    all_of = W.partitionBy("item")
    group = group.withColumn("agreement", F.col("n_sources") / F.sum("n_sources").over(all_of)).withColumn("subvote", F.round("subvote", 9))
    order = all_of.orderBy(F.desc("subvote"), F.desc("n_sources"), F.desc("weight"), "vkey")
    return group.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def candidate_score(groups: DataFrame) -> DataFrame:
    """``score`` from sub-group vote, agreement and rank."""
    # The published weights.
    raw = 0.28 + 0.105 * F.col("subvote") + 0.12 * F.col("agreement") - 0.12 * (F.col("rank") - 1)
    return groups.withColumn("score", F.round(F.least(F.greatest(raw, F.lit(0.05)), F.lit(0.97)), 3))


def cap_alternatives(cands: DataFrame, group: str = "item", score: str = "score") -> DataFrame:
    """Every alternative at most the top score less 0.01."""
    top = F.max(F.when(F.col("rank") == 1, F.col(score))).over(W.partitionBy(group))
    return cands.withColumn(score, F.when(F.col("rank") > 1, F.least(F.col(score), F.round(top - 0.01, 3))).otherwise(F.col(score)))


def coverage_confidence(n: Column, b: Column) -> tuple[Column, Column]:
    """(score, label) of n sources in b branches."""
    # The published weights.
    s = F.least(F.greatest(0.12 + 0.55 * F.least(n, F.lit(8)) / 8 + 0.33 * b / 3, F.lit(0.05)), F.lit(0.99))
    return F.round(s, 6), F.when((n >= 5) & (b >= 2), "High").when((n >= 3) & (b >= 2), "Medium").otherwise("Low")


def dedupe_candidates(cands: DataFrame, group: list[str], fold: Column, preferred: Column) -> DataFrame:
    """One candidate of each folded form: the spelling of a preferred source if
    there is one, the largest score, all evidence counted."""
    c = cands.withColumn("fold", fold).withColumn("preferred", preferred)
    return c.groupBy(*group, "fold").agg(F.max_by("form", F.struct("preferred", "score", "form")).alias("form"), F.max("score").alias("score"), F.sum("evidence").alias("evidence"))


def secondary_alternatives(votes: DataFrame, primaries: DataFrame, groups: int = 3, total: int = 6) -> DataFrame:
    """(item, vkey, n, slot): groups of later forms that no primary has, at most
    ``groups`` of them and ``total`` candidates with the primaries."""
    later = votes.where("place > 1").groupBy("item", "vkey").agg(F.count_distinct("source").alias("n"))
    fresh = later.join(primaries.select("item", "vkey").distinct(), ["item", "vkey"], "left_anti")
    have = primaries.groupBy("item").agg(F.count(F.lit(1)).alias("have"))
    slot = F.row_number().over(W.partitionBy("item").orderBy(F.desc("n"), "vkey"))
    return fresh.join(have, "item").withColumn("slot", slot).where((F.col("slot") <= groups) & (F.col("slot") + F.col("have") <= total)).select("item", "vkey", "n", "slot")


def medoid(members: DataFrame, group: list[str], form: str, order: str) -> DataFrame:
    """The member with the least sum of edit distances to its group; of equals
    the first in ``order``.  Equal forms are compared once and weighted."""
    forms = members.groupBy(*group, form).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    other = forms.select(*group, F.col(form).alias("__other"), F.col("n").alias("__n"))
    total = forms.join(other, group).groupBy(*group, form).agg(F.sum(F.levenshtein(F.col(form), F.col("__other")) * F.col("__n")).alias("cost"), F.first("first").alias("first"))
    best = F.row_number().over(W.partitionBy(*group).orderBy("cost", "first", form))
    return total.withColumn("k", best).where("k = 1").select(*group, F.col(form).alias("medoid"), "cost")


def representatives(members: DataFrame, group: list[str], form: str, order: str) -> DataFrame:
    """One row a (group, rule): the modal form (greatest key of equals), the
    shortest, and the first in priority order."""
    g = members.groupBy(*group, form).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    picked = g.groupBy(*group).agg(F.max_by(form, F.struct("n", form)).alias("modal"), F.min_by(form, F.struct(F.length(form), F.col(form))).alias("shortest"),
                                   F.min_by(form, F.struct("first", form)).alias("priority"))
    return picked.selectExpr(*group, "stack(3, 'modal', modal, 'shortest', shortest, 'priority', priority) as (rule, form)")


def strip_shared_suffix(df: DataFrame, group: list[str], form: str, suffix: str) -> DataFrame:
    """Strip a marker that at least two and at least half of a group have."""
    has = F.col(form).endswith(suffix)
    w = W.partitionBy(*group)
    marked, n = F.sum(has.cast("int")).over(w), F.count(F.lit(1)).over(w)
    df = df.withColumn("stripped", (marked >= 2) & (marked * 2 >= n)).withColumn("__has", has)
    return df.withColumn(form, F.when(F.col("stripped") & F.col("__has"), F.substr(F.col(form), F.lit(1), F.length(form) - len(suffix))).otherwise(F.col(form))).where(F.col(form) != "").drop("__has")


def mode_greatest(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """The most frequent value; of equals the greatest."""
    return df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(F.max_by(value, F.struct("n", value)).alias(out))


def override_base(cands: DataFrame) -> DataFrame:
    """Two-stage override of a linked candidate's score by the top vote."""
    # The published weights and marks; half-way values round up.
    base = 0.58 + 0.40 * F.col("link")
    score = (F.when(~F.col("equivalent") & (F.col("link") < 0.62) & ~F.col("adjective"), F.least(base, F.col("top_vote") - 0.03))
             .when(F.col("link") >= 0.60, F.greatest(base, F.col("top_vote") + 0.02)).otherwise(base))
    return cands.withColumn("score", F.round(F.least(F.greatest(score, F.lit(0.05)), F.lit(0.98)) + 1e-9, 3))


def merge_arrays(rows: DataFrame, key: str, order: str, caps: dict[str, int]) -> DataFrame:
    """(key, each array of ``caps``): the arrays of a key's rows end to end in order,
    without repeats, cut to their caps (the rule of the merge).  First places are
    aggregated, so a key of many rows costs its distinct values only."""
    out = None
    for name, cap in caps.items():
        each = rows.select(key, order, F.posexplode(name).alias("__i", "__v")).groupBy(key, "__v").agg(F.min(F.struct(order, "__i")).alias("__at"))
        kept = each.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy("__at"))).where(F.col("__k") <= cap)
        one = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__v"))), lambda s: s["__v"]).alias(name))
        out = one if out is None else out.join(one, key, "full")
    return out
