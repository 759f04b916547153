"""Operators over lexicons: synonyms, cross-source meanings, false friends, derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def repeated(rows: DataFrame, id_col: str, flag: str) -> DataFrame:
    """``rows`` with a flag: whether several rows have this id."""
    return rows.withColumn(flag, F.count(F.lit(1)).over(W.partitionBy(id_col)) > 1)


#: Ids of one kind of rows that meet a row together.
CHUNK = 1000


def synonym_edges(rows: DataFrame, id_col: str, lang: str, trans: str, pos: str, toks: str, key: str, least: int = 3) -> DataFrame:
    """Symmetric (id, other): two rows share a translation of a language, are of
    one class, and have disjoint gloss tokens and other keys.

    Ids of one row meet each other once: they leave the join as they are, without a
    shuffle of pairs, and meet chunks of ids whose rows are equal but for the id.
    Only pairs of ids of several rows are made distinct.
    """
    e = rows.where(F.length(trans) >= least).select(F.col(id_col).alias("i"), F.col(lang).alias("l"), F.col(trans).alias("tr"), F.col(pos).alias("p"), F.col(toks).alias("t"), F.col(key).alias("k"))
    e = repeated(e.where("i is not null and k is not null and t is not null"), "i", "many")
    once, many = e.where("not many"), e.where("many")
    kind, n = ["l", "tr", "p", "t", "k"], F.row_number().over(W.partitionBy("l", "tr", "p", "t", "k").orderBy("i"))
    chunks = once.withColumn("n", F.floor((n - 1) / CHUNK)).groupBy(*kind, "n").agg(F.collect_list("i").alias("others"))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        a, b = x.alias("a"), y.alias("b")
        return a.join(b, (F.col("a.l") == F.col("b.l")) & (F.col("a.tr") == F.col("b.tr")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.k") != F.col("b.k")) & ~F.arrays_overlap("a.t", "b.t"))

    plain = met(once, chunks).select(F.col("a.i").alias(id_col), F.explode("b.others").alias("other"))
    some = met(many, e).select(F.col("a.i").alias(id_col), F.col("b.i").alias("other")).where(F.col(id_col) != F.col("other"))
    return plain.unionByName(some.unionByName(some.select(F.col("other").alias(id_col), F.col(id_col).alias("other"))).distinct())


def cross_source_index(rows: DataFrame, token: str, lang: str, word: str, most_rows: int = 150, most_words: int = 5) -> DataFrame:
    """(token, lang, word, k): words that share a token, tokens of more than
    ``most_rows`` rows told as too common (a rule of the index, not a limit of the
    engine), at most ``most_words`` words of a language."""
    rare = rows.groupBy(token).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(lang).alias("langs")).where((F.col("n") <= most_rows) & (F.col("langs") > 1)).select(token)
    w = rows.join(rare, token, "left_semi").select(token, lang, word).distinct()
    return w.withColumn("k", F.row_number().over(W.partitionBy(token, lang).orderBy(word))).where(F.col("k") <= most_words)


def false_friends(rows: DataFrame, word: str, lang: str, meaning: str, home: str) -> DataFrame:
    """(word, langs, severity): words of ``home`` whose spelling other languages
    have with another meaning; severity by how many do."""
    h = rows.where(F.col(lang) == home).select(word, F.col(meaning).alias("__own"))
    other = rows.where(F.col(lang) != home).select(word, lang, meaning)
    apart = other.join(h, word).where(F.col(meaning) != F.col("__own"))
    g = apart.groupBy(word).agg(F.count_distinct(lang).alias("langs"))
    return g.withColumn("severity", F.when(F.col("langs") >= 2, "high").when(F.col("langs") == 1, "medium").otherwise("low"))


def mates(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Canonical distinct unordered pairs."""
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def derivation_pairs(words: DataFrame, word: str, rules: list[tuple[str, str]], least: int = 3) -> DataFrame:
    """(base, derived, pattern): derived words whose stripped form is a word; the
    first rule that finds a base wins."""
    bases = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"{a}>{b}").alias("pattern"),
                               F.when(F.col(word).endswith(a) & (F.length(word) - len(a) >= least), F.concat(F.substr(F.col(word), F.lit(1), F.length(word) - len(a)), F.lit(b))).alias("base"))
                      for i, (a, b) in enumerate(rules)])
    each = words.select(F.col(word).alias("derived"), F.explode(bases).alias("r")).select("derived", "r.i", "r.pattern", "r.base").where("base is not null and base <> derived")
    hit = each.join(words.select(F.col(word).alias("base")).distinct(), "base", "left_semi")
    return hit.groupBy("derived").agg(F.min_by(F.struct("base", "pattern"), "i").alias("x")).select("x.base", "derived", "x.pattern")


def bigrams(words: DataFrame, word: str) -> DataFrame:
    """(bigram) inventory with word edges marked."""
    t = F.concat(F.lit("^"), F.col(word), F.lit("$"))
    return words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))).alias("bigram")).distinct()


def bigram_violations(cands: DataFrame, word: str, inventory: DataFrame) -> DataFrame:
    """(word, bigram) of candidates outside the inventory."""
    t = F.concat(F.lit("^"), F.col(word), F.lit("$"))
    each = cands.select(word, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2))))).alias("bigram"))
    return each.join(inventory, "bigram", "left_anti").select(word, "bigram")


def low_evidence(rows: DataFrame, key: str, lang: str, branch: str, gloss: str, token: str, taken: DataFrame) -> DataFrame:
    """(key, langs, gloss): keys that two languages and two branches share with a
    common gloss token, none of them taken; the shortest gloss that carries it."""
    shared = rows.groupBy(key, token).agg(F.count_distinct(lang).alias("n")).where("n >= 2").select(key, token)
    g = rows.groupBy(key).agg(F.count_distinct(lang).alias("langs"), F.count_distinct(branch).alias("branches")).where("langs >= 2 and branches >= 2")
    short = rows.join(shared, [key, token], "left_semi").groupBy(key).agg(F.min_by(gloss, F.struct(F.length(gloss), gloss)).alias("gloss"))
    return g.join(short, key).join(taken, key, "left_anti").select(key, "langs", "gloss")
