"""Mixing sources to target weights by Poisson replication.

Each document is repeated k times, k drawn from a Poisson distribution whose
mean is the repetition rate of its source: target rows of the source over its
rows.  The draw inverts the distribution at a uniform number hashed from seed
and document, so it does not depend on partitions or retries.  Copies are
shuffled globally by a seeded hash.

Defined results: a null source is a source of its own; a source without weight
has rate 0 and goes; repeated rows (same id) are drawn alike; an empty table
gives no rows; null ids are drawn as the text ''; texts of any length travel whole.
The input's columns keep their names and values; an added column whose name the
input has takes underscores behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.session import shuffle_partitions, written

#: Source tables of up to so many rows are broadcast.
BROADCAST_SOURCES = 50_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    text = F.concat_ws("\u001f", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities P(X <= 0), P(X <= 1), … of a Poisson variable,
    up to ten deviations and 30 beyond its mean; kept in logarithms, so that
    large rates do not underflow."""
    top = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("steps"))
    walk = F.aggregate(F.sequence(F.lit(1), top), start, lambda a, k: F.struct(
        (a["log"] + F.ln(rate / k)).alias("log"),
        F.concat(a["steps"], F.array(F.element_at(a["steps"], -1) + F.exp(a["log"] + F.ln(rate / k)))).alias("steps")))
    return F.when(rate > 0, walk["steps"]).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, *, source: str = "source", weights: dict[str, float] | None = None, exponent: float = 0.7,
                 target_rows: int | None = None) -> DataFrame:
    """(__source, rows, rate, steps) of every source.  Weights are those given,
    or rows ** exponent, which lifts small sources; target_rows: rows that the
    mixture has on average (by default as many as the input)."""
    counts = docs.groupBy(F.col(f"`{source}`").alias("__source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(exponent))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("__source") == name, F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    total = counts.agg(F.sum("weight").alias("weight"), F.sum("rows").alias("all_rows"))
    target = F.col("all_rows") if target_rows is None else F.lit(target_rows)
    rate = F.when(F.col("t.weight") > 0, target * F.col("c.weight") / (F.col("t.weight") * F.col("c.rows"))).otherwise(0.0)
    rates = counts.alias("c").join(F.broadcast(total.alias("t")), how="cross").select("__source", "c.rows", rate.alias("rate"))  # t is one row
    return rates.withColumn("steps", poisson_steps(F.col("rate")))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it as long as it is taken (in any case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def mix_sources(docs: DataFrame, *, source: str = "source", id_col: str = "doc_id", seed: int = 0, weights: dict[str, float] | None = None,
                exponent: float = 0.7, target_rows: int | None = None, stable: bool = False) -> DataFrame:
    """The columns of ``docs``, copies, replica (from 0) and shuffle_key; rows in
    a global random order (by partition, then by key).

    stable: whether ``docs`` is a plain scan of files, so that each row has the
    same place in every pass; any other plan is written as a table first.
    """
    if not stable:
        docs = written(docs, "records")
    rates = source_rates(docs, source=source, weights=weights, exponent=exponent, target_rows=target_rows)
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rates = rates.select(F.col("__source").alias("of"), F.col("steps").alias("steps"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(f"`{source}`").alias("from"), F.col(f"`{id_col}`").alias("id"))
    drawn = (rows.join(rates, F.col("from").eqNullSafe(F.col("of")), "left")
             .select("r", "id", F.size(F.filter("steps", lambda s: s <= uniform(seed, F.col("id")))).alias("copies")).where("copies > 0"))
    each = drawn.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("replica"))
    # equal rows (equal key) would meet in one task: a place in the input spreads them
    each = each.withColumn("key", F.xxhash64(F.lit(seed), "id", "replica")).withColumn("place", F.monotonically_increasing_id())
    dealt = each.repartition(shuffle_partitions(docs.sparkSession), "key", "place").sortWithinPartitions("key")
    added = {"copies": "copies", "replica": "replica", "shuffle_key": "key"}
    return dealt.select(*[F.col("r").getField(c).alias(c) for c in docs.columns], *[F.col(v).alias(free_name(k, docs.columns)) for k, v in added.items()])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs, seed=3, stable=True).select("doc_id", "source", "text", "copies", "replica")


SQL = """
with recursive counts as (select source, count(*) as n from documents group by source),
rates as (select source, (select sum(n) from counts) * pow(n, 0.7) / ((select sum(pow(n, 0.7)) from counts) * n) as rate from counts),
steps as (
  select source, rate, 0 as k, exp(-rate) as p, exp(-rate) as cum from rates
  union all
  select source, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) from steps where k < rate + 10 * sqrt(rate) + 30),
u as (select doc_id, source, text, ('0x' || substr(md5('3' || chr(31) || doc_id::varchar), 1, 13))::bigint / pow(2, 52) as u from documents),
drawn as (select u.doc_id, u.source, any_value(u.text) as text, count(*)::int as copies from u join steps s on u.source = s.source and s.cum <= u.u group by u.doc_id, u.source)
select doc_id, source, text, copies, unnest(range(copies))::int as replica from drawn
"""
