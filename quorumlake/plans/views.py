"""Views of the driver tables that queries run on, and the same as SQL.

Each view is a function (spark, sf_dir) -> DataFrame; ``SQL`` holds the text of
the equivalent common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.functions import keys as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with nation and region: dimensions, small beside lineitem; the
    optimizer broadcasts them when their measured size allows it."""
    return (table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.col("n_name").alias("source"), F.col("r_name").alias("branch")))


def attestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, source, branch)"""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return lines.join(_places(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("item"), "source", "branch").distinct()


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, source, branch, vkey, place): place 1 is the source's primary form."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("item"), F.concat("l_returnflag", "l_linestatus").alias("vkey"))
    rows = lines.join(_places(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
    order = W.partitionBy("item", "source").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "vkey")
    return rows.select("item", "source", "branch", "vkey", F.row_number().over(order).alias("place"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, wt): customers of a nation."""
    return (table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("wt"))
            .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("source"), "wt"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, pos, token).  The outer explode is for speed: for a plain
    one the optimizer takes words apart twice, to leave out texts without any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode_outer(K.tokens(F.col("text"))).alias("pos", "token"))
    return docs.where("token is not null").withColumn("pos", F.col("pos") + 1)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, token, df): document frequency of each word of a language."""
    docs = table(spark, sf_dir, "documents").select("lang", F.explode_outer(F.array_distinct(K.tokens(F.col("text")))).alias("token")).where("token is not null")
    return docs.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("df"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pos, langs, score, score_b, hit)"""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("pos"), (F.col("user_id") % 9).alias("langs"), F.least(F.col("value") / 200, F.lit(1.0)).alias("score"),
        F.least(F.col("value") / 150, F.lit(1.0)).alias("score_b"), F.col("event_type").isin("purchase", "signup").alias("hit"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, form, pos, lang, freq): form is two words."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("form"), F.col("p_type").alias("pos"), F.col("p_brand").alias("lang"),
                                              F.col("p_retailprice").alias("freq"), F.col("p_size").alias("size"))


SQL = {
    "att": "att as (select distinct l_partkey as item, n_name as source, r_name as branch from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)",
    "vote": "vote as (select l_partkey as item, n_name as source, r_name as branch, l_returnflag || l_linestatus as vkey, row_number() over (partition by l_partkey, n_name order by l_orderkey, l_linenumber, l_suppkey, l_returnflag || l_linestatus) as place from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)",
    "wt": "wt as (select n_name as source, count(*) as wt from customer join nation on c_nationkey = n_nationkey group by 1)",
    "tok": r"tok as (select doc_id, lang, source, unnest(t) as token, generate_subscripts(t, 1) as pos from (select doc_id, lang, source, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+(?:-\p{L}+)*') as t from documents))",
    "lex": "lex as (select lang, token, count(distinct doc_id) as df from tok group by 1, 2)",
    "scored": "scored as (select event_id as id, event_type as pos, user_id % 9 as langs, least(value / 200, 1.0) as score, least(value / 150, 1.0) as score_b, event_type in ('purchase', 'signup') as hit from events)",
    "parts": "parts as (select p_partkey as id, p_name as form, p_type as pos, p_brand as lang, p_retailprice as freq, p_size as size from part)",
}


def sql(*names: str) -> str:
    """The named common table expressions, after ``with``."""
    return "with recursive " + ", ".join(SQL[n] for n in names) + " "
