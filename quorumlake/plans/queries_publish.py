"""Queries of sinks, graphs, numbering and checks (K1-K7, J21, A9, A23-A25, A27, A32, W9, Q-checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.functions import keys as K
from quorumlake.operators import graph as G
from quorumlake.operators import publish as B
from quorumlake.operators import quality as Q
from quorumlake.plans import views as V
from quorumlake.plans.base import query
from quorumlake.plans.queries_keys import sql_fnv, sql_fnv_utf8, sql_skeleton
from quorumlake.session import scratch

P = V.sql("parts")


@query("k1_hash_shards", P + f", s as (select ({sql_fnv('form')} % 2048)::int as shard, form, lang from parts) select shard, count(*) as records, count(distinct form) as keys, sum(length(lang))::bigint as bytes from s group by 1")
def k1(spark, sf):
    path = scratch(spark, "shards")
    B.write_sharded(V.parts(spark, sf).select("form", "lang", "id"), "form", 2048, path)
    back = spark.read.parquet(path)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("form").alias("keys"), F.sum(F.octet_length("lang")).cast("long").alias("bytes"))


@query("k2_lookup_shards", P + f", k as (select distinct unnest(string_split(form, ' ')) as skey, id from parts) select ({sql_fnv('skey')} % 256)::int as shard, count(*) as records, count(distinct skey) as keys from k group by 1")
def k2(spark, sf):
    k = V.parts(spark, sf).select("id", F.explode(F.split("form", " ")).alias("skey")).distinct()
    return B.shard_meta(k, "skey", 256, F.col("skey")).drop("bytes")


@query("k3_note_shards", V.sql("tok", "lex") + f", s as (select distinct {sql_skeleton('token')} as k from lex) select ({sql_fnv_utf8('k')} % 64)::int as shard, count(*) as records from s group by 1")
def k3(spark, sf):
    k = V.lexicon(spark, sf).select(K.ascii_skeleton(F.col("token")).alias("k")).distinct()
    return B.with_shard(k, "k", 64).groupBy("shard").agg(F.count(F.lit(1)).alias("records"))


@query("k4_first_letter_shards", P + f", f as (select distinct form from parts) select left(form, 1) as letter, ({sql_fnv('left(form, 1)')} % 32)::int as shard, count(*) as forms from f group by 1, 2")
def k4(spark, sf):
    f = V.parts(spark, sf).select("form").distinct().withColumn("letter", F.left("form", F.lit(1)))
    return B.with_shard(f, "letter", 32).groupBy("letter", "shard").agg(F.count(F.lit(1)).alias("forms"))


BUCKETS = P + ", e as (select distinct id, left(w, 2) as b2, lang from (select id, lang, unnest(string_split(form, ' ')) as w from parts)), s as (select left(b2, 1) as b1, sum(length(lang)) as total from e group by 1), k as (select distinct e.id, case when total > 2000 then b2 else b1 end as bucket from e join s on left(b2, 1) = b1) "


def _buckets(spark, sf):
    return B.prefix_buckets(V.parts(spark, sf).select("id", "lang", F.split("form", " ").alias("w")), F.col("w"), F.col("lang"), 2000).select("id", "bucket")


@query("k5_prefix_buckets", BUCKETS + "select bucket, count(*) as rows from k group by 1")
def k5(spark, sf):
    return _buckets(spark, sf).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))


@query("q2_bucket_completeness", "select p_partkey as id from part where p_partkey % 40 = 3")
def q2(spark, sf):
    """Rows that no bucket holds: exactly those that were taken out of the buckets here."""
    return V.parts(spark, sf).select("id").join(_buckets(spark, sf).where("id % 40 <> 3"), "id", "left_anti")


@query("k6_systematic_sample", P + ", r as (select id, form, row_number() over (order by form, id) as k, count(*) over () as n from parts) select id, form from r where (k - 1) % greatest(1, n // 256) = 0")
def k6(spark, sf):
    """The sampling operator: every n/256-th row in order."""
    return B.systematic_sample(V.parts(spark, sf).select("id", "form"), ["form", "id"], 256).select("id", "form")


@query("k7_flat_publish", P + "select lang, pos, count(*) as n from parts group by 1, 2")
def k7(spark, sf):
    path = scratch(spark, "report")
    B.write_flat(V.parts(spark, sf).groupBy("lang", "pos").agg(F.count(F.lit(1)).alias("n")), path, "json", ["lang", "pos"])
    return spark.read.schema("lang string, pos string, n long").json(path)


@query("k8_report_table", V.sql("scored") + "select pos, count(*) as n, count(*) filter (hit) as hits, round(avg(score), 6) as mean_score from scored group by rollup (pos)")
def k8(spark, sf):
    return V.scored(spark, sf).rollup("pos").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("j21_semantic_edges", P + ", g as (select id, lang || size as k, count(*) over (partition by lang || size) as n from parts), f as (select * from g where n between 2 and 15) select distinct a.id as source, b.id as target from f a join f b on a.k = b.k and a.id <> b.id")
def j21(spark, sf):
    return G.family_edges(V.parts(spark, sf).withColumn("k", F.concat("lang", "size")), "k", "id")


LINKS = "with l as (select distinct page_id as source, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as target from pages) "


@query("j21_page_edges", LINKS + "select source, target from l")
def j21b(spark, sf):
    return G.page_links(V.table(spark, sf, "pages"), "page_id", "html")


@query("a27_backlinks", LINKS + "select target, count(*) as links, min(source) as first_source from l group by 1")
def a27(spark, sf):
    return G.backlinks(G.page_links(V.table(spark, sf, "pages"), "page_id", "html"))


@query("a9_record_merge", "select o_custkey, o_orderstatus, count(*) as records, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as analyses, max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) = 1 as outranked from orders group by 1, 2")
def a9(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("records"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("analyses"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("outranked"))


CUST = "with c as (select r_name, n_name, c_mktsegment, c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) "


@query("a23_category_tree", CUST + "select r_name, n_name, c_mktsegment, count(distinct c_custkey) as members, (3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment))::int as level from c group by rollup (r_name, n_name, c_mktsegment)")
def a23(spark, sf):
    c = (V.table(spark, sf, "customer").join(V.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(V.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    return G.category_tree(c, ["r_name", "n_name", "c_mktsegment"], "c_custkey")


@query("a24_frequency_tables", CUST + ", f as (select n_name as label, count(*) as n from c group by 1), r as (select *, row_number() over (order by n desc, label) as k from f) select label, n from r where k <= 24")
def a24(spark, sf):
    """A top-24 report."""
    c = V.table(spark, sf, "customer").join(V.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(24)


@query("a25_homographs", P + "select replace(form, ' ', '') as fold, count(*) as n, min(id) as first from parts group by 1 having count(*) > 1")
def a25(spark, sf):
    g = V.parts(spark, sf).groupBy(F.replace("form", F.lit(" "), F.lit("")).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return g.where("n > 1")


@query("w9_contiguous_ids", P + "select id, row_number() over (order by pos, form, id) as rank from parts")
def w9(spark, sf):
    return B.global_rank(V.parts(spark, sf).select("id", "pos", "form"), ["pos", "form", "id"]).select("id", "rank")


@query("a32_invariants", "select 'discount in range' as rule, count(*) as checked, count(*) filter (l_discount between 0 and 0.1) as passed from lineitem union all select 'returned lines are shipped', count(*) filter (l_returnflag = 'R'), count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') from lineitem union all select 'positive quantity', count(*), count(*) filter (l_quantity > 0) from lineitem")
def a32(spark, sf):
    t = F.lit(True)
    return Q.check_invariants(V.table(spark, sf, "lineitem"), {
        "discount in range": (t, F.col("l_discount").between(0, 0.1)), "returned lines are shipped": (F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"), "positive quantity": (t, F.col("l_quantity") > 0)})


@query("q4_probability_range", V.sql("scored") + "select id, score from scored where not (score > 0.0001 and score < 1)")
def q4(spark, sf):
    return Q.out_of_range(V.scored(spark, sf).select("id", "score"), "score", 0.0001, 1)


@query("q8_repeated_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def q8(spark, sf):
    return Q.repeated_keys(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
