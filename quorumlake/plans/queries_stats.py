"""Queries of metrics, calibration and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.functions import keys as K
from quorumlake.operators import stats as S
from quorumlake.plans import views as V
from quorumlake.plans.base import query
from quorumlake.plans.queries_keys import sql_holdout

SC = V.sql("scored")
BIN = "least(floor(least(greatest({}, 0), 1) * 10), 9)::int"


def _results(spark, sf):
    """(config, id, pos, conf, exact, normalized, edit): two configurations of the scored view, one scan."""
    s = V.scored(spark, sf)
    both = F.array(F.struct(F.lit("base").alias("config"), F.col("score").alias("p")), F.struct(F.lit("wide").alias("config"), F.col("score_b").alias("p")))
    r = s.select("id", "pos", "langs", "hit", F.explode(both).alias("c")).select("id", "pos", "langs", "hit", "c.config", "c.p")
    return r.withColumn("conf", K.confidence_by_score(F.col("p"))).withColumn("exact", F.col("hit") & (F.col("p") >= 0.3)).withColumn("normalized", F.col("hit") & (F.col("p") >= 0.1)).withColumn("edit", 1 - F.col("p"))


RESULTS = SC + """, r0 as (select id, pos, langs, hit, 'base' as config, score as p from scored union all select id, pos, langs, hit, 'wide', score_b from scored),
r as (select *, case when p >= 0.72 then 'High' when p >= 0.45 then 'Medium' else 'Low' end as conf, hit and p >= 0.3 as exact, hit and p >= 0.1 as normalized, 1 - p as edit from r0) """


@query("a11_accuracy", RESULTS + "select config, pos, langs, conf, count(*) as n, sum(exact::int)::bigint as exact, sum(normalized::int)::bigint as normalized, round(avg(edit), 6) as mean_edit from r group by grouping sets ((config), (config, pos), (config, langs), (config, conf))")
def a11(spark, sf):
    return S.accuracy(_results(spark, sf), ["pos", "langs", "conf"])


@query("a12_holdout_split", RESULTS + f", h as (select *, {sql_holdout('id::varchar')} as holdout from r) select config, holdout, count(*) as n, round(avg(exact::int), 6) as exact_rate, round(avg(normalized::int), 6) as normalized_rate from h group by 1, 2")
def a12(spark, sf):
    r = _results(spark, sf).withColumn("holdout", K.is_holdout(F.col("id").cast("string")))
    return r.groupBy("config", "holdout").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("exact_rate"), F.round(F.avg(F.col("normalized").cast("int")), 6).alias("normalized_rate"))


@query("a13_reliability", SC + f"select {BIN.format('score')} as bin, count(*) as n, round(avg(score), 6) as mean_p, round(avg(hit::int), 6) as rate from scored group by 1")
def a13(spark, sf):
    return S.reliability(V.scored(spark, sf), "score", "hit").select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


@query("a13_ece_brier", SC + f", b as (select {BIN.format('score')} as bin, count(*) as n, sum(score) as sp, sum(hit::int) as sy, sum((score - hit::int) * (score - hit::int)) as sq from scored group by 1) select round(sum(abs(sp - sy)) / sum(n), 6) as ece, round(sum(sq) / sum(n), 6) as brier, sum(n)::bigint as n from b")
def a13b(spark, sf):
    return S.ece_brier(V.scored(spark, sf), "score", "hit").select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"), "n")


ISO = """, m as (select x.bin as a, z.bin as b, sum(y.v * y.w) / sum(y.w) as mean from bins x join bins z on x.bin <= z.bin join bins y on y.bin between x.bin and z.bin group by 1, 2),
low as (select i.bin as i, m.a, min(m.mean) as low from m join bins i on m.a <= i.bin and m.b >= i.bin group by 1, 2), fit as (select i as bin, max(low) as p from low group by 1),
every as (select unnest(range(10))::int as bin) select e.bin, round((select p from fit where bin = coalesce((select min(bin) from fit where bin >= e.bin), (select max(bin) from fit))), 6) as p from every e"""


@query("a14_isotonic_deciles", SC + f", bins as (select {BIN.format('score')} as bin, count(*) as w, avg(hit::int) as v from scored group by 1)" + ISO)
def a14(spark, sf):
    return S.isotonic(S.reliability(V.scored(spark, sf), "score", "hit"), "rate", "n").select("bin", F.round("p", 6).alias("p"))


WILSON = "least(greatest(((k / n) + 1.959964 * 1.959964 / (2 * n) - 1.959964 * sqrt((k / n) * (1 - k / n) / n + 1.959964 * 1.959964 / (4.0::double * n * n))) / (1 + 1.959964 * 1.959964 / n), 0.005), 0.995)"


@query("a15_wilson_bands", SC + f", c as (select case when langs <= 3 then '2-3' when langs <= 6 then '4-6' else '7+' end as band, {BIN.format('score')} as bin, count(*)::double as n, sum(hit::int)::double as k from scored group by 1, 2) select band, bin, n::bigint as n, round({WILSON}, 6) as lower from c")
def a15(spark, sf):
    band = F.when(F.col("langs") <= 3, "2-3").when(F.col("langs") <= 6, "4-6").otherwise("7+")
    c = V.scored(spark, sf).groupBy(band.alias("band"), S.bin_of(F.col("score")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("int")).alias("k"))
    return c.select("band", "bin", "n", F.round(S.wilson_lower(F.col("k"), F.col("n")), 6).alias("lower"))


@query("a15_wilson_isotonic", SC + f", c as (select {BIN.format('score')} as bin, count(*)::double as n, sum(hit::int)::double as k from scored group by 1), bins as (select bin, n as w, {WILSON} as v from c)" + ISO)
def a15b(spark, sf):
    c = V.scored(spark, sf).groupBy(S.bin_of(F.col("score")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("int")).alias("k"))
    return S.isotonic(c.withColumn("v", S.wilson_lower(F.col("k"), F.col("n"))), "v", "n").select("bin", F.round("p", 6).alias("p"))


@query("a16_operating_points", SC + ", t(threshold) as (values (0.1::double), (0.3), (0.6)) select threshold, count(*) filter (score >= threshold) as n, round(sum(case when score >= threshold then hit::int else 0 end) / count(*) filter (score >= threshold), 6) as precision, round(sum(case when score >= threshold then hit::int else 0 end) / sum(hit::int), 6) as recall from scored, t group by 1")
def a16(spark, sf):
    o = S.operating_points(V.scored(spark, sf), "score", "hit", [0.1, 0.3, 0.6])
    return o.select("threshold", "n", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


AB = RESULTS + ", a as (select id, exact from r where config = 'base'), b as (select id, exact from r where config = 'wide'), j as (select id, a.exact as x, b.exact as y from a join b using (id)) "


@query("j31_config_ab", AB + "select case when y and not x then 'fixed' when x and not y then 'broke' else 'unchanged' end as fate, count(*) as n from j group by 1")
def j31(spark, sf):
    from quorumlake.operators.link import compare_configs

    return compare_configs(_results(spark, sf), "base", "wide").groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


@query("a17_sign_test", SC + ", g as (select langs, count(*) filter (hit and score >= 0.1 and score_b < 0.35) as fixed, count(*) filter (hit and score > 0.6 and langs > 6) as broke from scored group by 1), s as (select langs, fixed as f, broke as b from g) select langs, f::bigint as fixed, b::bigint as broke, round(case when f + b = 0 then 1.0 else least(2 * list_sum(list_transform(range(0, least(f, b) + 1), lambda k: exp(lgamma(f + b + 1) - lgamma(k + 1) - lgamma(f + b - k + 1) - (f + b) * ln(2)))), 1.0) end, 9) as p from s")
def a17(spark, sf):
    hit = F.col("hit")
    g = V.scored(spark, sf).groupBy("langs").agg(F.count_if(hit & (F.col("score") >= 0.1) & (F.col("score_b") < 0.35)).alias("fixed"), F.count_if(hit & (F.col("score") > 0.6) & (F.col("langs") > 6)).alias("broke"))
    return g.select("langs", "fixed", "broke", F.round(S.sign_test(F.col("fixed"), F.col("broke")), 9).alias("p"))


@query("a18_bootstrap", SC + """, c as (select count(*) filter (hit) as k, count(*) as n from scored), b as (select k, n, greatest(0, k - 20 * ceil(sqrt(k * (n - k) / n))::bigint - 20) as lo, least(n, k + 20 * ceil(sqrt(k * (n - k) / n))::bigint + 20) as hi from c),
t as (select unnest(range(lo, hi + 1)) as i, * from b), l as (select i, n, k, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(k / n) + (n - i) * ln((n - k) / n) as log from t), w as (select i, n, exp(log - max(log) over ()) as w from l),
p as (select i, n, sum(w) over (order by i) / sum(w) over () as p from w), u as (select ('0x' || substr(md5('1:' || r::varchar), 1, 13))::bigint / pow(2, 52) as u from range(1000) t(r)),
d as (select round(i / n, 6) as rate from u asof join p on u.u <= p.p), r as (select rate, row_number() over (order by rate) - 1 as k from d) select max(rate) filter (k = 25) as low, max(rate) filter (k = 974) as high from r""")
def a18(spark, sf):
    return S.bootstrap(V.scored(spark, sf), "hit")


@query("a19_miss_stages", RESULTS + ", m as (select config, case when exact then 'hit' when normalized then 'spelling' when hit and p >= 0.05 then 'rank' when hit then 'vote' else 'absent' end as stage from r) select config, stage, count(*) as n from m group by 1, 2")
def a19(spark, sf):
    r = _results(spark, sf)
    trace = F.array(F.struct(F.lit("hit").alias("s"), F.col("exact").alias("ok")), F.struct(F.lit("spelling").alias("s"), F.col("normalized").alias("ok")),
                    F.struct(F.lit("rank").alias("s"), (F.col("hit") & (F.col("p") >= 0.05)).alias("ok")), F.struct(F.lit("vote").alias("s"), F.col("hit").alias("ok")))
    stage = F.coalesce(F.get(F.filter(trace, lambda x: x["ok"]), F.lit(0))["s"], F.lit("absent"))
    return r.select("config", stage.alias("stage")).groupBy("config", "stage").agg(F.count(F.lit(1)).alias("n"))


@query("a20_error_kinds", V.sql("parts") + "select case when form like 'small%' then 'prefix' when form like '%ring' then 'suffix' when length(form) > 9 then 'long' else 'other' end as kind, count(*) as n from parts group by 1")
def a20(spark, sf):
    kind = F.when(F.col("form").startswith("small"), "prefix").when(F.col("form").endswith("ring"), "suffix").when(F.length("form") > 9, "long").otherwise("other")
    return V.parts(spark, sf).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("a30_bucket_probability", SC + f", b as (select langs, pos, count(*)::double as n, sum(hit::int)::double as k from scored where {sql_holdout('id::varchar')} = false and langs <> 3 group by 1, 2), d as (select distinct langs, pos from scored) select d.langs, d.pos, round(coalesce(least({WILSON}, 0.9), 0.3), 6) as p from d left join b on d.langs = b.langs and d.pos = b.pos")
def a30(spark, sf):
    s = V.scored(spark, sf)
    b = s.where(~K.is_holdout(F.col("id").cast("string")) & (F.col("langs") != 3)).groupBy("langs", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("int")).alias("k"))
    return s.select("langs", "pos").distinct().join(b, ["langs", "pos"], "left").select("langs", "pos", F.round(F.coalesce(F.least(S.wilson_lower(F.col("k"), F.col("n")), F.lit(0.9)), F.lit(0.3)), 6).alias("p"))


@query("w13_topk_errors", SC + ", e as (select id, score, row_number() over (order by score desc, id) as k from scored where not hit) select id, round(score, 6) as score from e where k <= 60")
def w13(spark, sf):
    """The most confident errors: a top-k report."""
    return V.scored(spark, sf).where("not hit").orderBy(F.desc("score"), "id").limit(60).select("id", F.round("score", 6).alias("score"))


@query("p22_label_check", "with s as (select l.doc_id, least(n_chars / 4000, 1.0) as p, quality = 1 as hit from labels l join documents d on l.doc_id = d.doc_id) select case when p >= 0.6 then 'High' when p >= 0.3 then 'Medium' else 'Low' end as conf, count(*) as n, round(avg(hit::int), 6) as rate from s group by 1")
def p22b(spark, sf):
    s = V.table(spark, sf, "labels").join(V.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return s.groupBy(K.confidence_by_probability(F.least(F.col("n_chars") / 4000, F.lit(1.0))).alias("conf")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("quality") == 1).cast("int")), 6).alias("rate"))
