"""Counterfactual votes: what a perfect, or another, choice at one stage would give.

Clusters of an item and representatives of a cluster are aggregated once; each
configuration is a pair of rules (which cluster, which representative) read from that
aggregate, so all of them cost one pass.  Rules named ``oracle`` read the answer and
serve diagnosis only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Orders of an item's clusters, the greatest first; ties go to the least cluster.
CLUSTER_RULES = {"production": ["subvote", "n_sources", "weight"], "most sources": ["n_sources", "subvote"], "most branches": ["branches", "n_sources"]}
#: Configurations: cluster rule and representative rule.
LADDER = {"production": ("production", "priority"), "most sources": ("most sources", "priority"), "most branches": ("most branches", "priority"), "modal": ("production", "modal"), "shortest": ("production", "shortest"),
          "oracle cluster": ("oracle", "priority"), "oracle representative": ("production", "oracle"), "oracle all": ("oracle", "oracle")}


def cluster_table(votes: DataFrame, gold: DataFrame, priority: list[str]) -> DataFrame:
    """(item, cluster, n_sources, branches, weight, subvote, has_gold, reps): one row a
    cluster, from votes (item, source, branch, cluster, form, wt) and gold (item, gold)."""
    cell = votes.groupBy("item", "cluster", "branch").agg(F.count(F.lit(1)).alias("n"), F.sum("wt").alias("w"))
    cell = cell.withColumn("present", F.sum("n").over(W.partitionBy("item", "branch")))
    stats = cell.groupBy("item", "cluster").agg(F.sum("n").alias("n_sources"), F.count(F.lit(1)).alias("branches"), F.sum("w").alias("weight"), F.round(F.sum(F.col("n") / F.col("present")), 9).alias("subvote"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("source")), F.lit(0))
    place = F.when(place > 0, place).otherwise(len(priority) + 1)
    forms = votes.select("item", "cluster", "form", "source", place.alias("place")).groupBy("item", "cluster", "form").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "source")).alias("first"))
    told = forms.join(gold, "item", "left")
    reps = told.groupBy("item", "cluster").agg(
        F.min(F.struct("first", "form")).alias("priority"), F.min(F.struct((-F.col("n")).alias("n"), "form")).alias("modal"), F.min(F.struct(F.length("form").alias("long"), "form")).alias("shortest"),
        F.max(F.when(F.col("form") == F.col("gold"), F.col("form"))).alias("told"))
    chosen = F.struct(F.col("priority.form").alias("priority"), F.col("modal.form").alias("modal"), F.col("shortest.form").alias("shortest"), F.coalesce("told", "priority.form").alias("oracle"))
    return stats.join(reps.select("item", "cluster", F.col("told").isNotNull().alias("has_gold"), chosen.alias("reps")), ["item", "cluster"])


def counterfactuals(clusters: DataFrame, gold: DataFrame, ladder: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(item, gold, config, form, present) of every item and configuration: one grouping."""
    ladder = ladder or LADDER
    rank = W.partitionBy("item").orderBy("cluster")  # the clusters of one item are few
    placed = clusters.withColumn("place", -F.row_number().over(rank))
    orders = {name: [F.col(c) for c in by] for name, by in CLUSTER_RULES.items()}
    orders["oracle"] = [F.col("has_gold").cast("int"), *orders["production"]]
    best = placed.groupBy("item").agg(F.bool_or("has_gold").alias("present"), *[F.max_by("reps", F.struct(*by, F.col("place"))).alias(f"by {name}") for name, by in orders.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("config"), F.col(f"`by {cluster}`")[rep].alias("form")) for c, (cluster, rep) in ladder.items()])
    return best.join(gold, "item").select("item", "gold", "present", F.explode(rows).alias("c")).select("item", "gold", "c.config", "c.form", "present")


def headroom(results: DataFrame, base: str = "production") -> DataFrame:
    """(config, n, exact, delta, fixed, broke, recovered): rates of each configuration
    and what it changes against the base; recovered: of items whose answer is among the forms."""
    hit = F.col("form") == F.col("gold")
    before = F.max(F.when(F.col("config") == base, hit)).over(W.partitionBy("item"))  # a row a configuration
    r = results.select("item", "config", "present", F.coalesce(hit, F.lit(False)).alias("hit"), F.coalesce(before, F.lit(False)).alias("base"))
    out = r.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("exact"), F.round(F.avg(F.col("hit").cast("double") - F.col("base").cast("double")), 6).alias("delta"),
                                  F.count_if(F.col("hit") & ~F.col("base")).alias("fixed"), F.count_if(F.col("base") & ~F.col("hit")).alias("broke"), F.count_if(F.col("present") & F.col("hit")).alias("recovered"))
    return out
