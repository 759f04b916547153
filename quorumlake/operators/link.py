"""Record linkage: block-key equi joins, residual tests, and explainable scores.

No operator compares all pairs: candidates meet by an equality on a block key
(a token, a fold, a first letter), and the similarity is tested on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.functions.keys import one_zero

def explicit_link(att: DataFrame, item: str, ancestor: str, source: str) -> DataFrame:
    """The ancestor that most distinct sources name (the greatest of equals), if two do."""
    g = att.groupBy(item, ancestor).agg(F.count_distinct(source).alias("n"))
    best = g.groupBy(item).agg(F.max_by(F.struct(F.col(ancestor).alias("ancestor"), "n"), F.struct("n", ancestor)).alias("x"))
    return best.select(item, "x.ancestor", "x.n").where("n >= 2").withColumn("confidence", F.round(F.least(F.lit(0.95), 0.75 + 0.05 * F.col("n")), 6))


def unique_or_abstain(keyed: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owner, owners): the owner of a key that one owner has; null if several do."""
    g = keyed.groupBy(key).agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("__least"))
    return g.select(key, F.when(F.col("owners") == 1, F.col("__least")).alias(owner), "owners")


def resolve_headwords(queries: DataFrame, words: DataFrame, word: str, fold: Column, owner: str) -> DataFrame:
    """Exact first, then folded: an ambiguous exact hit abstains and does not fall through."""
    exact = unique_or_abstain(words.select(F.col(word).alias("__word"), owner), "__word", owner).select("__word", F.col(owner).alias("__e"), F.col("owners").alias("__en"))
    folded = unique_or_abstain(words.select(fold.alias("__fold"), owner), "__fold", owner).select("__fold", F.col(owner).alias("__f"))
    q = queries.withColumn("__qf", fold)
    out = q.join(exact, F.col(word) == F.col("__word"), "left").join(folded, F.col("__qf") == F.col("__fold"), "left")
    return out.withColumn("resolved", F.when(F.col("__en").isNotNull(), F.col("__e")).otherwise(F.col("__f"))).drop("__word", "__e", "__en", "__qf", "__fold", "__f")


def chase_parents(df: DataFrame, key: str, parent: str, found: Column, hops: int = 4) -> DataFrame:
    """(key, end, hops): follow parents until a row is found, at most ``hops`` times; null end: unresolved.
    Of a repeated key the row with the least parent is followed."""
    look = df.groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(F.col(parent).alias("p"), found.alias("f"))).alias("x")).select("__k", F.col("x.p").alias("__p"), F.col("x.f").alias("__f"))
    cur = df.select(key, F.col(key).alias("at"), F.col(parent).alias("next"), found.alias("done"), F.lit(0).alias("hops"))
    for _ in range(hops):
        step = cur.join(look, (F.col("next") == F.col("__k")) & ~F.col("done"), "left")
        moved = ~F.col("done") & F.col("__k").isNotNull()
        cur = step.select(key, F.when(moved, F.col("__k")).otherwise(F.col("at")).alias("at"), F.when(moved, F.col("__p")).otherwise(F.col("next")).alias("next"),
                          F.when(moved, F.col("__f")).otherwise(F.col("done")).alias("done"), (F.col("hops") + moved.cast("int")).alias("hops"))
    return cur.select(key, F.when(F.col("done"), F.col("at")).alias("end"), F.when(F.col("done"), F.col("hops")).alias("hops"))


#: Columns that tell rows of the two sides apart.
LEFT, RIGHT = ("form", "pos", "toks"), ("rform", "rpos", "rtoks")


def met_kinds(left: DataFrame, right: DataFrame) -> DataFrame:
    """(form, pos, toks, lid, rform, rpos, rtoks, rid) of kinds of rows that share a
    token and are of one class: rows equal in these columns are one kind, with its
    least id, so a token that many rows have meets as often as it has kinds of rows."""
    a = left.groupBy(*LEFT).agg(F.min("id").alias("lid"))
    b = right.groupBy(*RIGHT).agg(F.min("rid").alias("rid"))
    a, b = a.select("*", F.explode(F.array_distinct("toks")).alias("t")), b.select("*", F.explode(F.array_distinct("rtoks")).alias("rt"))
    # kinds that share several tokens count where they meet on the first of them
    first = F.element_at(F.array_intersect("toks", "rtoks"), 1)
    return a.join(b, (F.col("t") == F.col("rt")) & (F.col("pos") == F.col("rpos"))).where(F.col("t") == first).drop("t", "rt")


def shared_tokens() -> Column:
    return F.size(F.array_intersect("toks", "rtoks"))


def link_score() -> Column:
    """Shares of tokens and closeness of forms of a pair that met."""
    near = 1 - F.levenshtein("form", "rform") / F.greatest(F.length("form"), F.length("rform"), F.lit(1))
    # Weights of the published score.
    return F.round(0.42 * shared_tokens() / F.size("rtoks") + 0.36 * near + 0.22 * shared_tokens() / F.size("toks"), 6)


def fuzzy_link(left: DataFrame, right: DataFrame, accept: float = 0.42) -> DataFrame:
    """(id, rid, score) best link of left (id, form, pos, toks) with right (rid,
    rform, rpos, rtoks): block on a shared token, equal class, then shares of
    tokens and closeness of forms; of equals the least rid."""
    met = met_kinds(left, right).withColumn("score", link_score())
    best = met.groupBy(*LEFT).agg(F.max_by(F.struct("rid", "score"), F.struct("score", -F.col("rid"))).alias("x")).where(F.col("x.score") >= accept)
    return left.select("id", *LEFT).join(best, list(LEFT)).select("id", "x.rid", "x.score")


def strip_majority_prefix(rows: DataFrame, group: list[str], form: str, prefixes: list[str], least: int = 2) -> DataFrame:
    """``rows`` with ``form`` stripped of the prefix that ``least`` members of the
    group, and half of them, have (the first listed of equally common ones), and
    stripped: whether it was."""
    has = F.array(*[F.when(F.col(form).startswith(p), F.lit(i)) for i, p in enumerate(prefixes)])
    n = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    each = rows.select(*group, F.explode(F.filter(has, lambda x: x.isNotNull())).alias("__i")).groupBy(*group, "__i").agg(F.count(F.lit(1)).alias("__c"))
    most = each.join(n, group).where((F.col("__c") >= least) & (2 * F.col("__c") >= F.col("__n"))).groupBy(*group).agg(F.max_by("__i", F.struct("__c", -F.col("__i"))).alias("__i"))
    prefix = F.get(F.array(*map(F.lit, prefixes)), F.col("__i"))
    out = rows.join(most, group, "left").withColumn("stripped", F.coalesce(F.col(form).startswith(prefix), F.lit(False)))
    return out.withColumn(form, F.when(F.col("stripped"), F.substr(F.col(form), F.length(prefix) + 1)).otherwise(F.col(form))).drop("__i")


def deletions(word: Column, most: int) -> Column:
    """A word, and what is left of it without up to ``most`` of its characters."""
    once = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    level = found = F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, once)))
        found = F.concat(found, level)
    return F.array_distinct(found)


def nearest_by_edit(queries: DataFrame, index: DataFrame, q: str, form: str, block_q: Column, block_i: Column, most: int = 2, keep: int = 3) -> DataFrame:
    """(q, form, distance, k): forms of a query's block within ``most`` edits, the ``keep`` nearest.

    Words within so many edits have a common rest after as many deletions, so they
    meet in an equi-join on what deletions leave, and not on the block alone."""
    a = queries.select(q).distinct().select(q, block_q.alias("__b"), F.explode(deletions(F.col(q), most)).alias("__d"))
    b = index.select(form).distinct().select(form, block_i.alias("__c"), F.explode(deletions(F.col(form), most)).alias("__e"))
    met = a.join(b, (F.col("__d") == F.col("__e")) & (F.col("__b") == F.col("__c"))).select(q, form).distinct()
    near = met.withColumn("distance", F.levenshtein(F.col(q), F.col(form), most)).where("distance >= 0")
    return near.withColumn("k", F.row_number().over(W.partitionBy(q).orderBy("distance", form))).where(F.col("k") <= keep).select(q, form, "distance", "k")


def compare_configs(results: DataFrame, a: str, b: str) -> DataFrame:
    """(id, fate) of each id under two configurations: one aggregation, no self-join."""
    g = results.where(F.col("config").isin(a, b)).groupBy("id").agg(F.bool_or(F.when(F.col("config") == a, F.col("exact"))).alias("x"), F.bool_or(F.when(F.col("config") == b, F.col("exact"))).alias("y"))
    return g.select("id", F.when(F.col("y") & ~F.col("x"), "fixed").when(F.col("x") & ~F.col("y"), "broke").otherwise("unchanged").alias("fate"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) of rows added, removed or changed; a repeated key raises."""
    for side in (old, new):
        if not side.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} repeats in a snapshot")
    digest = lambda t: F.sha2(F.concat_ws("\u001f", *[F.coalesce(one_zero(F.col(c), t.schema[c].dataType).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    a, b = old.select(F.col(key).alias("__a"), digest(old).alias("x")), new.select(F.col(key).alias("__b"), digest(new).alias("y"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return both.select(F.coalesce("__a", "__b").alias(key), change.alias("change")).where("change is not null")


def augment_evidence(rows: DataFrame, candidates: DataFrame, cited: DataFrame, least: int = 2) -> DataFrame:
    """(id, lang, cand, overlap): for each row (id, toks) the best candidate (cand,
    lang, toks) of every language it does not cite, of those that share ``least``
    tokens; of equals the least.  Rows meet on pairs of tokens, not on single ones."""
    pairs = lambda t: F.flatten(F.transform(t, lambda x: F.transform(F.filter(t, lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    a = rows.select("id", F.array_distinct("toks").alias("toks"))
    b = candidates.select("cand", "lang", F.array_distinct("toks").alias("ctoks"))
    if least == 2:
        a, b = a.withColumn("k", F.explode(pairs(F.col("toks")))), b.withColumn("k", F.explode(pairs(F.col("ctoks"))))
    else:
        a, b = a.withColumn("k", F.explode("toks")), b.withColumn("k", F.explode("ctoks"))
    met = a.join(b, "k").select("id", "lang", "cand", F.size(F.array_intersect("toks", "ctoks")).alias("overlap")).distinct().where(F.col("overlap") >= least)
    fresh = met.join(cited.select("id", "lang").distinct(), ["id", "lang"], "left_anti")
    best = fresh.groupBy("id", "lang").agg(F.max_by(F.struct("cand", "overlap"), F.struct("overlap", -F.col("cand"))).alias("x"))
    return best.select("id", "lang", "x.cand", "x.overlap")
