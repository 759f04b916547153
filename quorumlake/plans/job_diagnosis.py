"""Diagnosis and release jobs: counterfactual votes (oracle, selection and representative ladders) and content-addressed releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.operators import counterfactual as C
from quorumlake.operators import manifest as M
from quorumlake.plans import views as V
from quorumlake.plans.base import query
from quorumlake.session import scratch, written

PRIORITY = ["GERMANY", "FRANCE", "JAPAN"]

VOTES = V.sql("vote", "wt") + f""", v as (select item, source, branch, left(vkey, 1) as cluster, vkey || repeat('x', (item % 3 + case when right(vkey, 1) = 'O' then 1 else 0 end)::int % 3) as form, coalesce(wt, 0) as wt from vote left join wt using (source) where place = 1),
gold as (select item, case when item % 4 = 0 then max(form) else min(form) end as gold from v group by 1),
cell as (select item, cluster, branch, count(*) as n, sum(wt)::bigint as w from v group by 1, 2, 3), cell2 as (select *, sum(n) over (partition by item, branch) as present from cell),
st as (select item, cluster, sum(n)::bigint as n_sources, count(*) as branches, sum(w)::bigint as weight, round(sum(n / present), 9) as subvote from cell2 group by 1, 2),
f as (select item, cluster, form, count(*) as n, min(case source when 'GERMANY' then 1 when 'FRANCE' then 2 when 'JAPAN' then 3 else 4 end) as place, min(source) filter (source not in ('GERMANY', 'FRANCE', 'JAPAN')) as other from v group by 1, 2, 3),
r as (select item, cluster, row_number() over (partition by item, cluster order by place, other, form) as p, row_number() over (partition by item, cluster order by n desc, form) as m, row_number() over (partition by item, cluster order by length(form), form) as s, form, form = gold as told from f join gold using (item)),
reps as (select item, cluster, max(case when p = 1 then form end) as priority, max(case when m = 1 then form end) as modal, max(case when s = 1 then form end) as shortest, coalesce(max(case when told then form end), max(case when p = 1 then form end)) as oracle, bool_or(told) as has_gold from r group by 1, 2),
c as (select * from st join reps using (item, cluster)),
k as (select *, row_number() over (partition by item order by subvote desc, n_sources desc, weight desc, cluster) as production, row_number() over (partition by item order by n_sources desc, subvote desc, cluster) as sources, row_number() over (partition by item order by branches desc, n_sources desc, cluster) as branchy, row_number() over (partition by item order by has_gold desc, subvote desc, n_sources desc, weight desc, cluster) as orc from c),
pick as (select item, 'production' as config, priority as form from k where production = 1 union all select item, 'most sources', priority from k where sources = 1 union all select item, 'most branches', priority from k where branchy = 1 union all select item, 'modal', modal from k where production = 1
  union all select item, 'shortest', shortest from k where production = 1 union all select item, 'oracle cluster', priority from k where orc = 1 union all select item, 'oracle representative', oracle from k where production = 1 union all select item, 'oracle all', oracle from k where orc = 1),
h as (select p.item, p.config, p.form = gold as hit, b.form = gold as base from pick p join gold using (item) join pick b on b.item = p.item and b.config = 'production') """


@query("job_oracle_ladder", VOTES + "select config, count(*) as n, round(avg(hit::int), 6) as exact, round(avg(hit::int - base::int), 6) as delta, count(*) filter (hit and not base) as fixed, count(*) filter (base and not hit) as broke, count(*) filter (hit) as recovered from h group by 1")
def job_oracle_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """What each stage would give if it were perfect, and what rules that do not read the answer recover."""
    v = V.votes(spark, sf).where("place = 1").join(V.weights(spark, sf), "source", "left")
    tail = (F.col("item") % 3 + (F.right("vkey", F.lit(1)) == "O").cast("int")) % 3
    v = v.select("item", "source", "branch", F.left("vkey", F.lit(1)).alias("cluster"), F.concat("vkey", F.repeat(F.lit("x"), tail.cast("int"))).alias("form"), F.coalesce("wt", F.lit(0)).alias("wt"))
    v = written(v, "votes")
    gold = v.groupBy("item").agg(F.when(F.col("item") % 4 == 0, F.max("form")).otherwise(F.min("form")).alias("gold"))
    return C.headroom(C.counterfactuals(C.cluster_table(v, gold, PRIORITY), gold))


@query("job_data_manifest", """with o as (select c_custkey, c_custkey % 16 as shard, c_acctbal from customer where c_custkey % 16 <> 3), n as (select c_custkey, c_custkey % 16 as shard, c_acctbal + case when c_custkey % 160 = 5 then 1 else 0 end as c_acctbal from customer where c_custkey % 16 <> 9),
s as (select coalesce(o.shard, n.shard) as shard, bool_or(o.c_custkey is null or n.c_custkey is null or o.c_acctbal <> n.c_acctbal) as changed, count(n.c_custkey) as now, count(o.c_custkey) as before from o full join n using (c_custkey) group by 1)
select shard::int as shard, 'second' as release, case when now = 0 then 'removed' when changed then 'written' else 'kept' end as action, case when now = 0 then before else now end as records from s union all select shard::int, 'third', 'kept', now from s where now > 0""")
def job_data_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Three releases of the customers: the second writes what changed, the third, equal to it, nothing."""
    c = V.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    shard, path = F.col("c_custkey") % 16, scratch(spark, "releases")
    M.publish(c.where("c_custkey % 16 <> 3"), shard, path)
    new = c.where("c_custkey % 16 <> 9").withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 160 == 5, 1).otherwise(0))
    second, third = M.publish(new, shard, path), M.publish(new, shard, path)
    M.read_release(spark, path, T.StructType([*c.schema.fields, T.StructField("digest", T.StringType())]))
    return second.select("shard", F.lit("second").alias("release"), "action", "records").unionByName(third.select("shard", F.lit("third").alias("release"), "action", "records"))
