"""Prefix search: terms in one order, and a prefix as a range of their places.

Terms and the two ends of each query's range are put in one total order by ranges; the
terms between the ends begin with the query.  Terms lie in blocks of places, so query
and term meet by an equality on the block and not on letters.  What holds a query
inside a text is the beginning of one of its suffixes, so substrings are ranges too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.operators.publish import global_rank
from quorumlake.session import discard, written

#: Places of a block.
BLOCK = 1024
#: A query's hits, in the order of entries, are read until there are more than so many.
STOP = 5000
#: Behind every text that begins with what stands before it.
LAST = "\U0010ffff"

# Scores of a match with an alias that is equal, equal when folded, or a beginning; for languages of the first rank, and for others.
ALIAS = {True: (82, 72, 56), False: (62, 54, 44)}


def terms_of(rows: DataFrame, fold) -> DataFrame:
    """(entry, text, eq_plain, eq_fold, begins_plain, begins_fold, begins_least): what
    entries (entry, title, gloss, keys: array<struct<key, rank>>, aliases:
    array<struct<word, first>>) are found by, with the scores of a plain and a folded
    query; begins_least: characters that a query needs to count as a beginning."""
    def term(text: Column, plain: tuple, folded: tuple, least: int = 1) -> Column:
        value = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
        return F.struct(text.alias("text"), value(plain[0]).alias("eq_plain"), value(folded[0]).alias("eq_fold"), value(plain[1]).alias("begins_plain"), value(folded[1]).alias("begins_fold"), F.lit(least).alias("begins_least"))

    title, gloss = F.lower("title"), F.lower(F.coalesce("gloss", F.lit("")))
    tails = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substr(t, i))).otherwise(F.array().cast("array<string>"))
    by_alias = lambda a, k: F.when(a["first"], ALIAS[True][k]).otherwise(ALIAS[False][k])
    every = F.concat(
        F.array(term(title, (100, 60), (0, 0)), term(fold(title), (0, 0), (90, 60))),
        F.transform("keys", lambda k: term(k["key"], (85 - 3 * F.least(k["rank"], F.lit(5)), 0), (85 - 3 * F.least(k["rank"], F.lit(5)), 50))),
        F.transform(F.transform(F.split(gloss, r"[,;]\s*"), lambda s: F.trim(s)), lambda s: term(s, (55, 0), (0, 0))),
        F.transform("aliases", lambda a: term(F.lower(a["word"]), (by_alias(a, 0), by_alias(a, 2)), (by_alias(a, 0), 0), 2)),
        F.transform("aliases", lambda a: term(fold(F.lower(a["word"])), (0, 0), (by_alias(a, 1), by_alias(a, 2)), 2)),
        F.transform(tails(title), lambda t: term(t, (40, 40), (0, 0))), F.transform(tails(gloss), lambda t: term(t, (20, 20), (0, 0))))
    return rows.select("entry", F.explode(every).alias("t")).select("entry", "t.*").where("text <> ''")


def search(queries: DataFrame, terms: DataFrame, titles: DataFrame, fold, keep: int = 20, stop: int = STOP) -> DataFrame:
    """(q, entry, title, score, k): the ``keep`` best of each query's hits, by score and
    title (then entry).  A leading "to" of a query is left out.  Of more than ``stop``
    hits the first stop + 1 entries count, as a search that reads entries in order does."""
    plain = F.regexp_replace(F.lower(F.trim("q")), r"^to\s+", "")
    asked = queries.select("q").distinct().select("q", F.explode(F.array(F.struct(plain.alias("probe"), F.lit(False).alias("folded")), F.struct(fold(plain).alias("probe"), F.lit(True).alias("folded")))).alias("p")).select("q", "p.*").where("probe <> ''")
    texts = terms.groupBy("text").agg(F.lit(1).alias("kind")).select("text", "kind")
    ends = asked.select("probe").distinct().select(F.explode(F.array(F.struct(F.col("probe").alias("text"), F.lit(0).alias("kind")), F.struct(F.concat("probe", F.lit(LAST)).alias("text"), F.lit(2).alias("kind")))).alias("e")).select("e.*")
    placed = written(global_rank(texts.unionByName(ends), ["text", "kind"]).select("text", "kind", "rank"), "places")
    low = placed.where("kind = 0").select(F.col("text").alias("probe"), F.col("rank").alias("low"))
    high = placed.where("kind = 2").select(F.expr(f"left(text, char_length(text) - {len(LAST)})").alias("probe"), F.col("rank").alias("high"))
    spans = low.join(high, "probe").select("probe", "low", "high", F.explode(F.sequence(F.expr(f"low div {BLOCK}"), F.expr(f"high div {BLOCK}"))).alias("block"))
    blocks = placed.where("kind = 1").select("text", "rank", F.expr(f"rank div {BLOCK}").alias("block"))
    found = written(spans.join(blocks, "block").where("rank > low and rank < high").select("probe", "text"), "found")
    # of terms that differ in the entry alone, the first entries only can be among a query's first
    alike = ["text", "eq_plain", "eq_fold", "begins_plain", "begins_fold", "begins_least"]
    first = terms.join(found.select("text").distinct(), "text").withColumn("n", F.dense_rank().over(W.partitionBy(*alike).orderBy("entry"))).where(F.col("n") <= stop + 1)
    first = written(first.select(*alike, "entry", "n").distinct(), "terms")
    equal = F.col("text") == F.col("probe")
    begins = F.when(F.char_length("probe") >= F.col("begins_least"), F.when(F.col("folded"), F.col("begins_fold")).otherwise(F.col("begins_plain"))).otherwise(0)
    score = F.when(equal, F.greatest(F.when(F.col("folded"), F.col("eq_fold")).otherwise(F.col("eq_plain")), begins)).otherwise(begins)
    scored = lambda some: asked.join(found, "probe").join(some, "text").select("q", "entry", score.alias("s")).where("s > 0")
    # a term that has so many entries alone says where a query's reading ends at the latest
    last = scored(first.where(F.col("n") == stop + 1)).groupBy("q").agg(F.min("entry").alias("last"))
    hits = scored(first).join(last, "q", "left").where("last is null or entry <= last")
    best = hits.groupBy("q", "entry").agg(F.max("s").alias("score"))
    read = best.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("entry"))).where(F.col("n") <= stop + 1)
    top = read.join(titles, "entry").withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "title", "entry"))).where(F.col("k") <= keep)
    top = written(top.select("q", "entry", "title", "score", "k"), "hits")
    discard(placed, found, first)
    return top
