"""Composite jobs: the library's operators composed as whole runs, and their queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.functions import keys as K
from quorumlake.operators import consensus as C
from quorumlake.operators import link as L
from quorumlake.operators import lookup as LU
from quorumlake.operators import stats as S
from quorumlake.plans import views as V
from quorumlake.plans.base import query
from quorumlake.plans.queries_consensus import GROUPS
from quorumlake.plans.queries_ingest import REASON
from quorumlake.plans.queries_keys import sql_holdout
from quorumlake.session import scratch
from quorumlake.streaming import ingest, pending


def evaluate(results: DataFrame, p: str, hit: str, id_text) -> DataFrame:
    """(metric, value) of a result table: rate, hold-out gap, ECE, Brier, each from one pass."""
    y = F.col(hit).cast("double")
    r = results.withColumn("__hold", K.is_holdout(id_text))
    rates = r.agg(F.avg(y).alias("rate"), F.avg(F.when(~F.col("__hold"), y)).alias("dev"), F.avg(F.when(F.col("__hold"), y)).alias("hold"), F.count_if("__hold").cast("double").alias("n_hold"))
    cal = S.ece_brier(results, p, hit).select("ece", "brier")
    both = rates.join(F.broadcast(cal), how="cross")  # one row each
    return both.selectExpr("stack(5, 'rate', round(rate, 6), 'gap', round(dev - hold, 6), 'holdout rows', n_hold, 'ece', round(ece, 6), 'brier', round(brier, 6)) as (metric, value)")


BIN = "least(floor(least(greatest(score, 0), 1) * 10), 9)::int"


@query("job_evaluate", V.sql("scored") + f""", h as (select *, {sql_holdout('id::varchar')} as hold from scored), a as (select avg(hit::int) as rate, avg(case when not hold then hit::int end) as dev, avg(case when hold then hit::int end) as hd, count(*) filter (hold) as n from h),
b as (select {BIN} as bin, count(*) as n, sum(score) as sp, sum(hit::int) as sy, sum((score - hit::int) * (score - hit::int)) as sq from scored group by 1), c as (select sum(abs(sp - sy)) / sum(n) as ece, sum(sq) / sum(n) as brier from b)
select 'rate' as metric, round(rate, 6) as value from a union all select 'gap', round(dev - hd, 6) from a union all select 'holdout rows', n from a union all select 'ece', round(ece, 6) from c union all select 'brier', round(brier, 6) from c""")
def job_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate(V.scored(spark, sf), "score", "hit", F.col("id").cast("string"))


@query("job_export", GROUPS + ", best as (select item, vkey, score from sc where rank = 1), cov as (select item, count(distinct source) as n, count(distinct branch) as b from vote group by 1) select item, vkey, score, case when n >= 5 and b >= 2 then 'High' when n >= 3 and b >= 2 then 'Medium' else 'Low' end as confidence from best join cov using (item)")
def job_export(spark: SparkSession, sf: str) -> DataFrame:
    """Vote, score, cap, confidence; written once as the published table and read back."""
    votes = V.votes(spark, sf)
    ranked = C.cap_alternatives(C.candidate_score(C.vote_groups(votes, V.weights(spark, sf)))).where("rank = 1")
    cov = votes.groupBy("item").agg(F.count_distinct("source").alias("n"), F.count_distinct("branch").alias("b"))
    out = ranked.join(cov, "item").select("item", "vkey", "score", C.coverage_confidence(F.col("n"), F.col("b"))[1].alias("confidence"))
    path = scratch(spark, "export")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


CHECK = V.sql("tok", "lex") + r""", ct as (select conv_id, unnest(t) as token from (select conv_id, regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*') as t from conversations)), known as (select distinct token from lex where df >= 10), u as (select conv_id, c.token, k.token is null as miss from ct c left join known k on c.token = k.token),
m as (select distinct token from u where miss), d as (select m.token, k.token as hint, levenshtein(m.token, k.token) as distance from m join known k on left(m.token, 2) = left(k.token, 2) and abs(length(m.token) - length(k.token)) <= 1 where not regexp_matches(m.token, '[^a-z-]') and not regexp_matches(k.token, '[^a-z-]') and levenshtein(m.token, k.token) <= 1),
h as (select token, min(hint) as hint from d group by 1) select conv_id, count(*) as tokens, count(*) filter (miss) as unknown, count(*) filter (miss and hint is not null) as hinted from u left join h using (token) group by 1"""


@query("job_check_text", CHECK)
def job_check_text(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each conversation against the known words, with nearest suggestions for the distinct unknown ones."""
    known = V.lexicon(spark, sf).where("df >= 10").select("token").distinct()
    words = V.table(spark, sf, "conversations").select("conv_id", F.explode(K.tokens(F.col("text"))).alias("token"))
    u = words.join(known.withColumn("ok", F.lit(True)), "token", "left").withColumn("miss", F.col("ok").isNull())
    plain = ~F.col("token").rlike("[^a-z-]")
    m, k = u.where(F.col("miss") & plain).select("token").distinct(), known.where(plain).select(F.col("token").alias("hint"))
    a, b = m.select("token", F.explode(L.deletions(F.col("token"), 1)).alias("d")), k.select("hint", F.explode(L.deletions(F.col("hint"), 1)).alias("d"))
    near = a.join(b, "d").where((F.left("token", F.lit(2)) == F.left("hint", F.lit(2))) & (F.levenshtein("token", "hint", 1) >= 0))
    hints = near.groupBy("token").agg(F.min("hint").alias("hint"))
    return u.join(hints, "token", "left").groupBy("conv_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if("miss").alias("unknown"), F.count_if(F.col("miss") & F.col("hint").isNotNull()).alias("hinted"))


@query("job_extract_stream", REASON + "select reason as gate, count(*) as n from r group by 1")
def job_extract_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The reason-coded gate as a drained stream; the tally of what it wrote."""
    e = ingest.event_stream(spark, sf).select(F.col("event_type").alias("pos"), "user_id", F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())]))["k"].alias("k"))
    tests = [(F.col("pos") == "error", "redirect"), (F.col("k") < 10, "multiword"), (F.col("user_id") % 7 == 0, "non-content"), (F.col("k") > 90, "no-gloss")]
    out = scratch(spark, "gated")
    ingest.gate_stream(e, tests, "kept", out, checkpoint=scratch(spark, "gated-checkpoint"))
    return spark.read.schema("gate string").parquet(out).groupBy(F.col("gate").cast("string").alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_windowed_tally", "select time_bucket(interval '6 hours', ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_windowed_tally(spark: SparkSession, sf: str) -> DataFrame:
    e = ingest.event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    done = ingest.drain(ingest.windowed_tally(e, "ts", "event_type", "6 hours", "1 day"), "tally")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("q6_holdout_leak", V.sql("scored") + f"select id from scored where {sql_holdout('id::varchar')} and id % 30 = 0")
def q6(spark: SparkSession, sf: str) -> DataFrame:
    """Hold-out ids among the rows that a fit used: those that were let in here."""
    s = V.scored(spark, sf).select("id").withColumn("hold", K.is_holdout(F.col("id").cast("string")))
    used = s.where("not hold or id % 30 = 0").select("id")
    return s.where("hold").select("id").join(used, "id", "left_semi")


@query("q7_domain_mismatch", "select event_id as id, event_type as domain from events where event_type in (select event_type from events group by 1 having count(*) < (select max(n) from (select count(*) as n from events group by event_type)))")
def q7(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a domain that the calibrator was not fitted on (it knows the largest
    one), told instead of mapped."""
    s = V.scored(spark, sf)
    fits = S.reliability(s.withColumn("domain", F.col("pos")), "score", "hit", ["domain"]).groupBy("domain").agg(F.sum("n").alias("n"))
    largest = fits.agg(F.max("n").alias("n"))  # one row
    fitted = fits.join(F.broadcast(largest), "n").select("domain")
    return s.select("id", F.col("pos").alias("domain")).join(fitted, "domain", "left_anti").select("id", "domain")


@query("explain_lookup", V.sql("parts") + ", q as (select id as qid, upper(form) || case when id % 2 = 0 then '' else ' x' end as q from parts), idx as (select form, min(id) as hit from parts group by 1), l as (select qid, case when a.form is not null then 1 when b.form is not null then 2 when c.form is not null then 3 end as level, coalesce(a.hit, b.hit, c.hit) as hit from q left join idx a on q.q = a.form left join idx b on lower(q.q) = b.form left join idx c on split_part(lower(q.q), ' ', 1) || ' ' || split_part(lower(q.q), ' ', 2) = c.form) select qid, level::int as level, hit from l where level is not null")
def explain_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Exact, then folded, then trimmed lookup: the first level that hits."""
    p = V.parts(spark, sf)
    q = p.select(F.col("id").alias("qid"), F.concat(F.upper("form"), F.when(F.col("id") % 2 == 0, "").otherwise(" x")).alias("q"))
    idx = p.groupBy(F.col("form").alias("key")).agg(F.min("id").alias("hit"))
    keys = F.array(F.struct(F.lit(1).alias("level"), F.col("q").alias("key")), F.struct(F.lit(2).alias("level"), F.lower("q").alias("key")),
                   F.struct(F.lit(3).alias("level"), F.array_join(F.slice(F.split(F.lower("q"), " "), 1, 2), " ").alias("key")))
    met = q.select("qid", F.explode(keys).alias("k")).select("qid", "k.level", "k.key").join(idx, "key")
    return met.groupBy("qid").agg(F.min(F.struct("level", "hit")).alias("x")).select("qid", "x.level", "x.hit")


LADDER = V.sql("tok", "lex") + r""", idx as (select token as key, df >= 40 as verified from lex where length(token) >= 6),
q as (select conv_id, turn, lower(text) as q from conversations where role = 'user'), w as (select conv_id, turn, q, regexp_extract_all(q, '\p{L}+(?:-\p{L}+)*') as t from q),
k as (select conv_id, turn, 1 as level, q as key from w union all select conv_id, turn, 2, unnest(t) from w union all select conv_id, turn, 3, regexp_replace(unnest(t), 's$', '') from w),
h as (select distinct conv_id, turn, level, verified from k join idx using (key)), s as (select conv_id, turn, min(case when verified then level end) as stop, min(level) as first from h group by 1, 2) """


@query("job_lookup_batch", LADDER + "select case when stop is not null then 'verified' when first is not null then 'generated' else 'miss' end as class, coalesce(stop, first)::int as level, count(*) as queries from q left join s using (conv_id, turn) group by 1, 2")
def job_lookup_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of queries through the fallback ladder (whole, words, words without a
    plural ending), classed by the best hit."""
    index = V.lexicon(spark, sf).where(F.length("token") >= 6).select(F.col("token").alias("key"), F.col("lang").alias("entry"), (F.col("df") >= 40).alias("verified"))
    asked = V.table(spark, sf, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("qid"), F.lower("text").alias("q"))
    words = K.tokens(F.col("q"))
    levels = [(1, F.array("q")), (2, words), (3, F.transform(words, lambda w: F.regexp_replace(w, "s$", "")))]
    hits = LU.ladder(asked, levels, index, "qid", "key", "entry", "verified").groupBy("qid").agg(F.bool_or("verified").alias("ok"), F.min(F.when(F.col("verified"), F.col("level"))).alias("stop"), F.min("level").alias("first"))
    best = asked.select("qid").join(hits, "qid", "left")
    found = F.when(F.col("ok"), "verified").when(F.col("first").isNotNull(), "generated").otherwise("miss")
    return best.groupBy(found.alias("class"), F.coalesce("stop", "first").alias("level")).agg(F.count(F.lit(1)).alias("queries"))


COVER = V.sql("att", "wt") + """, t as (select sum(wt) as total from wt), g as (select item, count(distinct source) as n, count(distinct branch) as b, sum(coalesce(wt, 0)) as w from att left join wt using (source) group by 1),
c as (select *, case when n >= 5 and b >= 2 then 'High' when n >= 3 and b >= 2 then 'Medium' else 'Low' end as label from g) select label, b as branches, count(*) as items, round(avg(w / (select total from t)), 6) as population, max(n) as most_sources from c group by grouping sets ((label, b), (label), ()) """


@query("job_coverage", COVER)
def job_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage of items by sources, branches and population, by label and in all."""
    w = V.weights(spark, sf)
    total = w.agg(F.sum("wt").alias("total"))  # one row
    g = V.attestations(spark, sf).join(w, "source", "left").groupBy("item").agg(F.count_distinct("source").alias("n"), F.count_distinct("branch").alias("branches"), F.sum(F.coalesce("wt", F.lit(0))).alias("w"))
    c = g.join(F.broadcast(total), how="cross").withColumn("label", C.coverage_confidence(F.col("n"), F.col("branches"))[1])
    return c.groupingSets([["label", "branches"], ["label"], []], "label", "branches").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg(F.col("w") / F.col("total")), 6).alias("population"), F.max("n").alias("most_sources"))


FIT = V.sql("scored") + f""", s as (select *, {BIN} as bin, {sql_holdout('id::varchar')} as hold from scored), f as (select bin, avg(hit::int) as rate from s where not hold group by 1), h as (select s.score, s.hit::int as y, coalesce(f.rate, s.score) as p from s left join f using (bin) where hold),
r as (select 'raw' as scale, score as p, y from h union all select 'fitted', p, y from h), b as (select scale, least(floor(least(greatest(p, 0), 1) * 10), 9)::int as bin, sum(p) as sp, sum(y) as sy, count(*) as n, sum((p - y) * (p - y)) as sq from r group by 1, 2)
select scale, round(sum(abs(sp - sy)) / sum(n), 6) as ece, round(sum(sq) / sum(n), 6) as brier, sum(n)::bigint as rows from b group by 1"""


@query("job_corpus_eval", FIT)
def job_corpus_eval(spark: SparkSession, sf: str) -> DataFrame:
    """A calibration fitted on the rows that are not held out (rates of score bins), and
    its error on the held-out ones beside that of the raw scores."""
    s = V.scored(spark, sf).withColumn("bin", S.bin_of(F.col("score"))).withColumn("hold", K.is_holdout(F.col("id").cast("string")))
    fit = s.where("not hold").groupBy("bin").agg(F.avg(F.col("hit").cast("int")).alias("rate"))
    held = s.where("hold").join(fit, "bin", "left").select("hit", F.explode(F.array(F.struct(F.lit("raw").alias("scale"), F.col("score").alias("p")), F.struct(F.lit("fitted").alias("scale"), F.coalesce("rate", "score").alias("p")))).alias("x"))
    y = F.col("hit").cast("int")
    rows = held.select(y.alias("y"), "x.scale", "x.p").groupBy("scale", S.bin_of(F.col("p")).alias("bin")).agg(F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"))
    return rows.groupBy("scale").agg(F.round(F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"), F.sum("n").alias("rows"))


@query("stream_settled_pages", """with c as (select c_custkey as k, case when c_custkey >= 4 then c_custkey // 4 end as p, case when c_mktsegment in ('BUILDING', 'MACHINERY') then c_mktsegment end as v from customer),
w as (select a.k, case when a.v is not null then 0 when b.v is not null then 1 when d.v is not null then 2 when e.v is not null then 3 when f.v is not null then 4 end as hops, coalesce(a.v, b.v, d.v, e.v, f.v) as v
  from c a left join c b on a.p = b.k and a.v is null left join c d on b.p = d.k and b.v is null left join c e on d.p = e.k and d.v is null left join c f on e.p = f.k and e.v is null)
select case when hops is null then 'open' when hops = 0 then 'direct' else 'parent ' || hops end as via, coalesce(v, '') as value, count(*) as pages from w group by 1, 2""")
def stream_settled_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as pages that come in two parts, in no order: those without evidence
    wait in the stream's state until the page that they name has settled."""
    c = V.table(spark, sf, "customer")
    pages = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") >= 4, F.floor(F.col("c_custkey") / 4).cast("string")).alias("parent"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).alias("value"))
    path = scratch(spark, "arriving")
    for part in range(2):
        pages.where(F.pmod(F.hash("id"), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(path)
    out, checkpoint = pending.scratch_paths(spark)
    pending.drain_settled(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(path), out, checkpoint)
    settled = spark.read.schema("id string, value string, hops int").parquet(out)
    via = F.when(F.col("hops").isNull(), "open").when(F.col("hops") == 0, "direct").otherwise(F.concat(F.lit("parent "), F.col("hops").cast("string")))
    return pending.kept_and_open(pages, settled).groupBy(via.alias("via"), F.coalesce("value", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("pages"))
