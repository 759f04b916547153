"""URL rules looked up by short hash prefixes.

Every url is expanded into host-suffix and path-prefix expressions, the
expressions meet the rules in an equi-join on the first hex digits of their
SHA-256 digests, full digests confirm the hit, and the longest rule wins.
DataFrame functions only.

Every row is judged where it lies: its expressions meet the rules, and only hits are
gathered again, by the row's place, so neither a url that a third of the rows share
nor null urls crowd a task.

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule; repeated rows and repeated ids stay as they are; an empty table
gives no rows, no rules the default everywhere.  A rule of an empty host or
a null part fits nothing.  Two rules of equal length: the longer host wins, then
block over allow.  Urls of any length are read whole.  Columns of the input other
than id and url do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.session import written

#: Hex digits of the digest that the join compares.
PREFIX = 8
#: Rule tables of up to so many rows are broadcast (each is some hundred bytes).
BROADCAST_RULES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host with A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", stable: bool = False) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    rules: host, path, verdict.  A rule fits its host and all subdomains, if the
    url's path starts with the rule's path.  Expressions are made for those
    label counts and path lengths only that occur among the rules, at most one
    for each pair of them.  stable: whether ``pages`` is a plain scan of files, so
    that each row has the same place in every pass; any other plan is written first.
    """
    rules = (rules.where("host <> '' and path is not null and verdict is not null")
             .select("host", "path", "verdict", F.concat("host", "path").alias("rule"),
                     (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
                     F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_size")))
    shape = rules.agg(F.collect_set("labels").alias("l"), F.collect_set("path_size").alias("p"), F.count("*").alias("n")).first()
    digest = F.sha2(F.concat_ws("\u0000", "host", "path"), 256)
    rules = (rules.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, PREFIX))
             .select("short", "digest", F.struct("size", "host_size", "verdict", "rule").alias("found")))
    if shape["n"] <= BROADCAST_RULES:
        rules = F.broadcast(rules)

    if not stable:
        pages = written(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")), "pages").select(F.col("id").alias(id_col), F.col("url").alias(url_col))
    host, path = url_parts(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    labels, sizes = F.array(*map(F.lit, sorted(shape["l"]))).cast("array<int>"), F.array(*map(F.lit, sorted(shape["p"]))).cast("array<int>")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\u0000", h, p), 256))))
    some = F.when(F.col("host") != "", digests).otherwise(F.array().cast("array<string>"))
    # the row itself comes first, without a digest
    each = rows.select("id", "host", "path", "row", F.explode(F.concat(F.array(F.lit(None).cast("string")), some)).alias("own")).withColumn("own_short", F.substring("own", 1, PREFIX))
    hit = each.join(rules, F.col("own_short") == F.col("short"), "left").where("own is null or own = digest")
    best = hit.groupBy("row").agg(F.min("id").alias("id"), F.min("host").alias("host"), F.min("path").alias("path"), F.max(F.when(F.col("own") == F.col("digest"), F.col("found"))).alias("found"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
