"""Queries of votes, sets and candidate ranking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.functions import keys as K
from quorumlake.operators import consensus as C
from quorumlake.plans import views as V
from quorumlake.plans.base import query

GROUPS = V.sql("vote", "wt") + """, cell as (select item, vkey, branch, count(*) as n, sum(coalesce(wt, 0))::bigint as w from vote left join wt using (source) where place = 1 group by 1, 2, 3),
cell2 as (select *, sum(n) over (partition by item, branch) as present from cell),
grp as (select item, vkey, sum(n)::bigint as n_sources, sum(w)::bigint as weight, round(sum(n / present), 9) as subvote, count(*) as branches from cell2 group by 1, 2),
agr as (select *, n_sources / sum(n_sources) over (partition by item) as agreement, row_number() over (partition by item order by subvote desc, n_sources desc, weight desc, vkey) as rank from grp),
top as (select * from agr where rank <= 3),
sc as (select *, round(least(greatest(0.28::double + 0.105::double * subvote + 0.12::double * agreement - 0.12::double * (rank - 1), 0.05), 0.97), 3) as score from top)
"""


def _groups(spark, sf):
    return C.vote_groups(V.votes(spark, sf), V.weights(spark, sf))


@query("a3_consensus_vote", GROUPS + "select item, vkey, n_sources, weight, rank::int as rank from top")
def a3(spark, sf):
    return _groups(spark, sf).select("item", "vkey", "n_sources", "weight", "rank")


@query("a4_subgroup_vote", GROUPS + "select item, vkey, round(subvote, 6) as subvote, branches from top")
def a4(spark, sf):
    return _groups(spark, sf).select("item", "vkey", F.round("subvote", 6).alias("subvote"), "branches")


@query("a5_candidate_score", GROUPS + "select item, vkey, rank::int as rank, n_sources, round(agreement, 6) as agreement, score from sc")
def a5(spark, sf):
    return C.candidate_score(_groups(spark, sf)).select("item", "vkey", "rank", "n_sources", F.round("agreement", 6).alias("agreement"), "score")


@query("w3_headword_dominance", GROUPS + "select item, vkey, rank::int as rank, case when rank > 1 then least(score, round(max(case when rank = 1 then score end) over (partition by item) - 0.01, 3)) else score end as score from sc")
def w3(spark, sf):
    return C.cap_alternatives(C.candidate_score(_groups(spark, sf))).select("item", "vkey", "rank", "score")


@query("w1_candidate_dedupe", V.sql("vote") + ", c as (select item, vkey, left(vkey, 1) as fold, count(*) as n from vote where place = 1 group by 1, 2, 3) select item, fold, arg_max(vkey, (right(vkey, 1) = 'F', n, vkey)) as form, round(max(n) / 10, 3) as score, sum(n)::bigint as evidence from c group by 1, 2")
def w1(spark, sf):
    c = V.votes(spark, sf).where("place = 1").groupBy("item", F.col("vkey").alias("form")).agg(F.count(F.lit(1)).alias("evidence")).withColumn("score", F.round(F.col("evidence") / 10, 3))
    return C.dedupe_candidates(c, ["item"], F.left("form", F.lit(1)), F.right("form", F.lit(1)) == "F").select("item", "fold", "form", "score", "evidence")


@query("w4_secondary_alternatives", GROUPS + """, later as (select item, vkey, count(distinct source) as n from vote where place > 1 group by 1, 2),
fresh as (select * from later l where not exists (select 1 from top t where t.item = l.item and t.vkey = l.vkey)), have as (select item, count(*) as have from top group by 1),
s as (select f.*, have, row_number() over (partition by f.item order by n desc, vkey) as slot from fresh f join have using (item)) select item, vkey, n, slot::int as slot from s where slot <= 3 and slot + have <= 6""")
def w4(spark, sf):
    return C.secondary_alternatives(V.votes(spark, sf), _groups(spark, sf))


@query("w2_two_stage_override", V.sql("parts") + """, b as (select id, form, round(0.3 + size / 80, 4) as link, (pos = 'SMALL') as adjective, left(form, 1) = left(lang, 1) as equivalent, max(round(freq / 2500, 4)) over (partition by form) as top_vote from parts),
s as (select id, case when not equivalent and link < 0.62 and not adjective then least(0.58 + 0.4 * link, top_vote - 0.03) when link >= 0.6 then greatest(0.58 + 0.4 * link, top_vote + 0.02) else 0.58 + 0.4 * link end as s from b)
select id, round(least(greatest(s, 0.05), 0.98) + 1e-9, 3) as score from s""")
def w2(spark, sf):
    p = V.parts(spark, sf).select("id", F.round(0.3 + F.col("size") / 80, 4).alias("link"), (F.col("pos") == "SMALL").alias("adjective"), (F.left("form", F.lit(1)) == F.left("lang", F.lit(1))).alias("equivalent"),
                                 F.max(F.round(F.col("freq") / 2500, 4)).over(W.partitionBy("form")).alias("top_vote"))
    return C.override_base(p).select("id", "score")


@query("w5_medoid", V.sql("parts") + ", f as (select lang, pos, form, count(*) as n, min(id) as first from parts group by 1, 2, 3), c as (select a.lang, a.pos, a.form, a.first, sum(levenshtein(a.form, b.form) * b.n)::bigint as cost from f a join f b on a.lang = b.lang and a.pos = b.pos group by 1, 2, 3, 4), r as (select *, row_number() over (partition by lang, pos order by cost, first, form) as k from c) select lang, pos, form as medoid, cost from r where k = 1")
def w5(spark, sf):
    return C.medoid(V.parts(spark, sf), ["lang", "pos"], "form", "id")


@query("w6_representatives", V.sql("parts") + ", f as (select lang, pos, form, count(*) as n, min(id) as first from parts group by 1, 2, 3), p as (select lang, pos, arg_max(form, (n, form)) as modal, arg_min(form, (length(form), form)) as shortest, arg_min(form, (first, form)) as priority from f group by 1, 2) select lang, pos, 'modal' as rule, modal as form from p union all select lang, pos, 'shortest', shortest from p union all select lang, pos, 'priority', priority from p")
def w6(spark, sf):
    return C.representatives(V.parts(spark, sf), ["lang", "pos"], "form", "id")


@query("a1_inherited_grouping", V.sql("tok", "lex") + ", g as (select lang, left(token, 5) as ancestor, count(*) as members, sum(df)::bigint as uses from lex where length(token) >= 5 and token not like '%-%' group by 1, 2) select * from g")
def a1(spark, sf):
    rows = V.lexicon(spark, sf).where((F.length("token") >= 5) & ~F.contains("token", F.lit("-")))
    return rows.groupBy("lang", F.left("token", F.lit(5)).alias("ancestor")).agg(F.count(F.lit(1)).alias("members"), F.sum("df").alias("uses"))


@query("a2_set_finishing", V.sql("att") + ", m as (select item, branch, count(*) as n from att group by 1, 2) select item, arg_max(branch, (n, branch)) as modal_branch, sum(n)::bigint as members from m group by 1")
def a2(spark, sf):
    a = V.attestations(spark, sf)
    return C.mode_greatest(a, ["item"], "branch", "modal_branch").join(a.groupBy("item").agg(F.count(F.lit(1)).alias("members")), "item").select("item", "modal_branch", "members")


@query("a6_coverage_confidence", V.sql("att") + ", g as (select item, count(distinct source) as n, count(distinct branch) as b from att group by 1) select item, n, b, round(least(greatest(0.12::double + 0.55::double * least(n, 8) / 8 + 0.33::double * b / 3, 0.05), 0.99), 6) as confidence, case when n >= 5 and b >= 2 then 'High' when n >= 3 and b >= 2 then 'Medium' else 'Low' end as label from g")
def a6(spark, sf):
    g = V.attestations(spark, sf).groupBy("item").agg(F.count_distinct("source").alias("n"), F.count_distinct("branch").alias("b"))
    score, label = C.coverage_confidence(F.col("n"), F.col("b"))
    return g.select("item", "n", "b", score.alias("confidence"), label.alias("label"))


@query("a7_weighted_coverage", V.sql("att", "wt") + ", t as (select sum(wt) as total from wt) select item, round(coalesce(sum(wt), 0) / (select total from t), 6) as coverage, round(coalesce(sum(case when branch = 'EUROPE' then wt end), 0) / (select total from t), 6) as europe from att left join wt using (source) group by item")
def a7(spark, sf):
    w = V.weights(spark, sf)
    total = w.agg(F.sum("wt").alias("total"))  # one row
    rows = V.attestations(spark, sf).join(w, "source", "left").groupBy("item").agg(F.coalesce(F.sum("wt"), F.lit(0)).alias("c"), F.coalesce(F.sum(F.when(F.col("branch") == "EUROPE", F.col("wt"))), F.lit(0)).alias("e"))
    return rows.join(F.broadcast(total), how="cross").select("item", F.round(F.col("c") / F.col("total"), 6).alias("coverage"), F.round(F.col("e") / F.col("total"), 6).alias("europe"))


@query("a36_portal_slices", V.sql("att") + ", g as (select item, count(distinct source) as n, count(distinct branch) as b, min(source) as least from att group by 1) select least as source, count(*) filter (n = 1) as unique_items, count(*) filter (b >= 3) as wide_items from g group by 1")
def a36(spark, sf):
    g = V.attestations(spark, sf).groupBy("item").agg(F.count_distinct("source").alias("n"), F.count_distinct("branch").alias("b"), F.min("source").alias("source"))
    return g.groupBy("source").agg(F.count_if(F.col("n") == 1).alias("unique_items"), F.count_if(F.col("b") >= 3).alias("wide_items"))


@query("a37_cohesion_histogram", V.sql("vote") + ", g as (select item, count(distinct vkey) as clusters from vote where place = 1 group by 1) select clusters, count(*) as items from g group by 1")
def a37(spark, sf):
    g = V.votes(spark, sf).where("place = 1").groupBy("item").agg(F.count_distinct("vkey").alias("clusters"))
    return g.groupBy("clusters").agg(F.count(F.lit(1)).alias("items"))


@query("a38_position_vote", V.sql("parts") + ", p as (select lang, pos, unnest([split_part(form, ' ', 1), split_part(form, ' ', 2)]) as w, unnest([1, 2]) as k from parts), c as (select lang, pos, k, w, count(*) as n from p group by 1, 2, 3, 4), b as (select lang, pos, k, arg_max(w, (n, w)) as w from c group by 1, 2, 3) select lang, pos, string_agg(w, ' ' order by k) as phrase from b group by 1, 2")
def a38(spark, sf):
    """A vote for each position of a phrase, then the winners joined."""
    each = V.parts(spark, sf).select("lang", "pos", F.posexplode(F.split("form", " ")).alias("k", "w"))
    best = C.mode_greatest(each, ["lang", "pos", "k"], "w", "w")
    return best.groupBy("lang", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda s: s["w"]), " ").alias("phrase"))


@query("j3_explicit_link", V.sql("att") + ", g as (select item, branch, count(distinct source) as n from att group by 1, 2), r as (select *, row_number() over (partition by item order by n desc, branch desc) as k from g) select item, branch as ancestor, n, round(least(0.95::double, 0.75::double + 0.05::double * n), 6) as confidence from r where k = 1 and n >= 2")
def j3(spark, sf):
    from quorumlake.operators.link import explicit_link

    return explicit_link(V.attestations(spark, sf), "item", "branch", "source")


@query("j35_config_cross", V.sql("vote") + ", cfg(config, least_n) as (values ('any', 1), ('two', 2), ('three', 3)), g as (select item, vkey, count(*) as n from vote where place = 1 group by 1, 2), x as (select config, item, arg_max(vkey, (n, vkey)) as winner from g, cfg where n >= least_n group by 1, 2) select * from x")
def j35(spark, sf):
    """Every configuration against every row: configurations are a few fixed rows."""
    cfg = F.broadcast(spark.createDataFrame([("any", 1), ("two", 2), ("three", 3)], "config string, least_n int"))
    g = V.votes(spark, sf).where("place = 1").groupBy("item", "vkey").agg(F.count(F.lit(1)).alias("n"))
    return g.join(cfg, F.col("n") >= F.col("least_n")).groupBy("config", "item").agg(F.max_by("vkey", F.struct("n", "vkey")).alias("winner"))


@query("u4_membership_union", V.sql("att") + ", w as (select item, string_agg(distinct source, ',' order by source) as members from (select item, source from att union select l_partkey, 'HOME' from lineitem where l_returnflag = 'R' and l_quantity > 49) group by 1) select * from w")
def u4(spark, sf):
    a = V.attestations(spark, sf).groupBy("item").agg(F.collect_set("source").alias("m"))
    home = V.table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_partkey").alias("item")).distinct().withColumn("h", F.array(F.lit("HOME")))
    return a.join(home, "item", "full").select("item", F.array_join(F.array_sort(F.array_union(F.coalesce("m", F.array().cast("array<string>")), F.coalesce("h", F.array().cast("array<string>")))), ",").alias("members"))
