"""Queries of text verification and lookup."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.functions import keys as K
from quorumlake.operators import lookup as LU
from quorumlake.operators import quality as Q
from quorumlake.operators import textcheck as T
from quorumlake.operators import walks
from quorumlake.plans import views as V
from quorumlake.plans.base import query

P = V.sql("parts")
CONV = r"ct as (select conv_id, turn, unnest(t) as token, generate_subscripts(t, 1) - 1 as pos from (select conv_id, turn, regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*') as t from conversations))"


def _conv(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(K.tokens_with_breaks(F.col("text"))).alias("pos", "t")).select("conv_id", "turn", "pos", "t.token", "t.brk")


@query("s7_whole_text", r"select doc_id, length(text) as chars, len(regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*'))::int as words from documents")
def s7(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.size(K.tokens(F.col("text"))).alias("words"))


@query("s8_carried_headers", "select conv_id, turn, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as header from conversations")
def s8(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return V.table(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w).alias("header"))


@query("s9_lexicon_violations", P + ", v as (select id, form, pos, case when lang = 'Brand#5' then '' else 'm' end as gender, case when size = 7 then '' else 'g' end as gloss, replace(form, ' ', '') || lang || size as fold, count(*) over (partition by replace(form, ' ', '') || lang || size) as n from parts) select id, case when contains(replace(form, ' ', '_'), ' ') then 'several tokens' when pos not in ('SMALL', 'LARGE', 'PROMO') then 'class' when pos = 'SMALL' and gender = '' then 'gender' when gloss = '' then 'gloss' when n > 1 then 'repeated' end as rule from v where pos not in ('SMALL', 'LARGE', 'PROMO') or (pos = 'SMALL' and gender = '') or gloss = '' or n > 1")
def s9(spark, sf):
    p = V.parts(spark, sf).select("id", F.replace("form", F.lit(" "), F.lit("_")).alias("word"), "pos", F.when(F.col("lang") == "Brand#5", "").otherwise("m").alias("gender"),
                                 F.when(F.col("size") == 7, "").otherwise("g").alias("gloss"), F.concat(F.replace("form", F.lit(" "), F.lit("")), "lang", "size").alias("fold"))
    return Q.lexicon_violations(p, "word", "pos", ["SMALL", "LARGE", "PROMO"], "gender", "gloss", F.col("fold")).select("id", "rule")


PH = V.sql("tok", "lex") + f""", {CONV}, ph as (select token as phrase from lex where df >= 40 union select a.token || ' ' || b.token from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.token in ('the', 'of', 'la', 'de') group by 1 having count(*) >= 5),
sp as (select *, lead(token) over (partition by conv_id, turn order by pos) as t1, lead(token, 2) over (partition by conv_id, turn order by pos) as t2 from ct),
b as (select conv_id, turn, pos, case when token || ' ' || t1 || ' ' || t2 in (select phrase from ph) then 3 when token || ' ' || t1 in (select phrase from ph) then 2 when token in (select phrase from ph) then 1 end as n, token, t1 from sp),
m as (select *, row_number() over (partition by conv_id, turn order by pos) as k from b where n is not null),
g(conv_id, turn, k, pos, n, stop, taken, token, t1) as (select conv_id, turn, k, pos, n, pos + n, true, token, t1 from m where k = 1 union all select m.conv_id, m.turn, m.k, m.pos, m.n, case when m.pos >= g.stop then m.pos + m.n else g.stop end, m.pos >= g.stop, m.token, m.t1 from g join m on m.conv_id = g.conv_id and m.turn = g.turn and m.k = g.k + 1) """


def _phrases(spark, sf):
    """Frequent words, and frequent pairs of an article and a word, made in the row of their document."""
    pairs = lambda t: F.filter(F.transform(t, lambda x, i: F.when(x.isin("the", "of", "la", "de"), F.concat(x, F.lit(" "), F.get(t, i + 1)))), lambda p: p.isNotNull())
    found = F.flatten(F.transform(F.array(K.tokens(F.col("text"))), pairs))
    two = V.table(spark, sf, "documents").where("doc_id is not null").select(F.explode_outer(found).alias("phrase")).where("phrase is not null").groupBy("phrase").count().where("count >= 5").select("phrase")
    return V.lexicon(spark, sf).where("df >= 40").select(F.col("token").alias("phrase")).unionByName(two).distinct()


@query("j22_longest_match", PH + "select conv_id, turn, pos::int as pos, n::int as n from g where taken")
def j22(spark, sf):
    words = V.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode_outer(T.words_ahead(K.tokens(F.col("text")))).alias("pos", "w")).where("w is not null").select("conv_id", "turn", "pos", "w.*")
    return T.longest_matches(words, _phrases(spark, sf), ["conv_id", "turn"]).select("conv_id", "turn", "pos", "n")


KNOWN = V.sql("tok", "lex") + f", {CONV}, known as (select distinct token from lex where df >= 10) "


@query("a31_gate_summary", KNOWN + "select c.conv_id, count(*) as tokens, count(*) filter (k.token is null) as unknown, count(*) filter (k.token is null) * 100 <= count(*) * 30 as passed from ct c left join known k on c.token = k.token group by 1")
def a31(spark, sf):
    known = V.lexicon(spark, sf).where("df >= 10").select("token").distinct().withColumn("ok", F.lit(True))
    c = _conv(spark, sf).join(known, "token", "left")
    unknown = F.count_if(F.col("ok").isNull())
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("tokens"), unknown.alias("unknown"), (unknown * 100 <= F.count(F.lit(1)) * 30).alias("passed"))


@query("a34_probe_categories", KNOWN + "select v.role, case when k.token is null then 'miss' else 'hit' end as status, count(*) as n, count(*) > 1000 as moved from ct c join conversations v on c.conv_id = v.conv_id and c.turn = v.turn left join known k on c.token = k.token group by 1, 2")
def a34(spark, sf):
    known = V.lexicon(spark, sf).where("df >= 10").select("token").distinct().withColumn("ok", F.lit(True))
    c = V.table(spark, sf, "conversations").select("role", F.explode(K.tokens(F.col("text"))).alias("token")).join(known, "token", "left")
    return c.groupBy("role", F.when(F.col("ok").isNull(), "miss").otherwise("hit").alias("status")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 1000).alias("moved"))


@query("w10_adjacent_pairs", r"with t as (select conv_id, turn, lower(text) as x from conversations), e as (select conv_id, turn, regexp_extract_all(x, '([^\pL]*)(\p{L}+(?:-\p{L}+)*)', 2) as w, regexp_extract_all(x, '([^\pL]*)(\p{L}+(?:-\p{L}+)*)', 1) as g from t), p as (select conv_id, turn, k::int as pos, w[k + 1] as token, w[k + 2] as next, regexp_matches(g[k + 2], '\S') as nb from (select *, unnest(range(len(w))) as k from e)) select conv_id, turn, pos, token, next from p where next is not null and not nb and token = next")
def w10(spark, sf):
    return T.adjacent_violations(_conv(spark, sf), ["conv_id", "turn"], F.col("token") == F.col("next")).select("conv_id", "turn", "pos", "token", "next")


@query("j24_consistency", P + ", t as (select id, form, pos, unnest(string_split(form, ' ')) as tok from parts where id % 2 = 0), l as (select id as lid, form as lform, unnest(string_split(form, ' ')) as tok from parts where id % 2 = 1), f as (select lform, tok, min(lid) as lid from l group by 1, 2), m as (select t.id, f.lid, f.lform, row_number() over (partition by t.id order by f.lid) as k from t join f on t.tok = f.tok and t.form <> f.lform) select id, lid, lform from m where k = 1")
def j24(spark, sf):
    p = V.parts(spark, sf)
    # equal forms conflict with the same rows: forms meet, of the lexicon each with its first row
    t = p.where("id % 2 = 0").select("id", "form")
    f = t.select("form").distinct().select("form", F.explode(F.split("form", " ")).alias("tok"))
    l = p.where("id % 2 = 1").groupBy(F.col("form").alias("lform")).agg(F.min("id").alias("lid")).select("lform", "lid", F.explode(F.split("lform", " ")).alias("tok"))  # noqa: E741
    first = f.join(l, "tok").where("form <> lform").groupBy("form").agg(F.min(F.struct("lid", "lform")).alias("x"))
    return t.join(first, "form").select("id", "x.lid", "x.lform")


@query("j25_dispositions", P + ", o as (select form, count(*) as n, count(distinct pos) as classes from parts where id % 2 = 0 and size > 10 group by 1) select l.id, case when o.form is null then 'coinage' when o.classes = 1 then 'official' when l.freq >= 1500 then 'generated' else 'rejected' end as disposition from parts l left join o on l.form = o.form where l.id % 2 = 1")
def j25(spark, sf):
    p = V.parts(spark, sf)
    o = p.where("id % 2 = 0 and size > 10").groupBy("form").agg(F.count_distinct("pos").alias("classes"))
    d = F.when(F.col("classes").isNull(), "coinage").when(F.col("classes") == 1, "official").when(F.col("freq") >= 1500, "generated").otherwise("rejected")
    return p.where("id % 2 = 1").join(o, "form", "left").select("id", d.alias("disposition"))


@query("a21_conflict_absorb", P + "select form || lang as key, case when count(distinct pos) = 1 then min(pos) else ' ' end as pos from parts group by 1")
def a21(spark, sf):
    return T.absorb(V.parts(spark, sf).select(F.concat("form", "lang").alias("key"), "pos"), "key", "pos")


@query("w8_suppression", P + """, r as (select id, pos || lang || size as g, form, row_number() over (partition by pos || lang || size order by freq desc, id) as k from parts),
s(g, k, id, keep, seen) as (select g, k, id, true, string_split(form, ' ') from r where k = 1 union all select r.g, r.k, r.id, not list_has_any(s.seen, string_split(r.form, ' ')), case when list_has_any(s.seen, string_split(r.form, ' ')) then s.seen else list_concat(s.seen, string_split(r.form, ' ')) end from s join r on r.g = s.g and r.k = s.k + 1) select g, id from s where keep""")
def w8(spark, sf):
    p = V.parts(spark, sf).select("id", F.concat("pos", "lang", "size").alias("g"), (-F.col("freq")).alias("nf"), F.split("form", " ").alias("toks"))
    return walks.greedy_suppress(p, "g", ["nf"], "id", "toks")


@query("a26_ranked_index", P + ", k as (select unnest([form, split_part(form, ' ', 1), split_part(form, ' ', 2)]) as skey, unnest([120, 100, 80]) as m, id, case when size > 40 then 300 when size > 20 then 280 else 100 end as st, round(10 * (freq / 2500)) as p from parts), b as (select skey, id, max(st + m + p)::int as rank from k group by 1, 2), r as (select *, row_number() over (partition by skey order by rank desc, id) as place from b) select skey, id, rank, place::int as place from r where place <= 10")
def a26(spark, sf):
    w = F.split("form", " ")
    keys = F.array(*[F.struct(k.alias("skey"), F.lit(m).alias("m")) for k, m in ((F.col("form"), 120), (w[0], 100), (w[1], 80))])
    rows = V.parts(spark, sf).select("id", "size", "freq", F.explode(keys).alias("k")).select("id", "size", "freq", "k.skey", "k.m")
    status = F.when(F.col("size") > 40, 300).when(F.col("size") > 20, 280).otherwise(100)
    return LU.ranked_index(rows, "skey", "id", status, F.col("m"), F.col("freq") / 2500, keep=10)


@query("j32_fallback_ladder", P + """, q as (select min(id) as qid, form || ' s' as q from parts group by form), idx as (select form as key, id as entry, size > 25 as verified from parts union all select split_part(form, ' ', 2), id, size > 45 from parts),
k as (select qid, 1 as level, q as key from q union all select qid, 2, left(q, length(q) - 2) from q union all select qid, 3, unnest(string_split(q, ' ')) from q), h as (select distinct k.qid, level, key, entry, verified from k join idx using (key)),
s as (select *, min(case when verified then level end) over (partition by qid) as stop from h), f as (select * from s where stop is null or level <= stop), r as (select *, row_number() over (partition by qid, verified order by level, entry) as n from f) select qid, verified, level::int as level, entry from r where n = 1""")
def j32(spark, sf):
    p = V.parts(spark, sf)
    q = p.groupBy("form").agg(F.min("id").alias("qid")).select("qid", F.concat("form", F.lit(" s")).alias("q"))  # equal queries are asked once
    idx = p.select(F.col("form").alias("key"), F.col("id").alias("entry"), (F.col("size") > 25).alias("verified")).unionByName(
        p.select(F.split("form", " ")[1].alias("key"), F.col("id").alias("entry"), (F.col("size") > 45).alias("verified")))
    levels = [(1, F.array("q")), (2, F.array(F.substr("q", F.lit(1), F.length("q") - 2))), (3, F.split("q", " "))]
    return LU.ladder(q, levels, idx, "qid", "key", "entry", "verified")


@query("w11_head_flag", P + ", r as (select pos || lang as key, first_value(size > 25) over (partition by pos || lang order by freq desc, id) as head_token, form like 'new%' as exact from parts) select key, any_value(head_token) as head_token, bool_or(exact) as has_exact, any_value(head_token) and bool_or(exact) as flagged from r group by 1")
def w11(spark, sf):
    p = V.parts(spark, sf).select(F.concat("pos", "lang").alias("key"), "freq", "id", (F.col("size") > 25).alias("tokenlike"), F.col("form").startswith("new").alias("exact"))
    g = p.groupBy("key").agg(F.max_by("tokenlike", F.struct("freq", -F.col("id"))).alias("head_token"), F.bool_or("exact").alias("has_exact"))
    return g.withColumn("flagged", F.col("head_token") & F.col("has_exact"))


@query("w12_query_scores", P + ", q as (select distinct left(form, 5) as q from parts), t as (select distinct form as title from parts), s as (select q, title, greatest(case when q = title then 100 else 0 end, case when replace(q, ' ', '') = replace(title, ' ', '') then 90 else 0 end, case when starts_with(title, q) then 82 else 0 end, case when starts_with(replace(title, ' ', ''), replace(q, ' ', '')) then 60 else 0 end, case when contains(title, q) then 40 else 0 end) as score from q join t on left(q, 2) = left(title, 2)), r as (select *, row_number() over (partition by q order by score desc, title) as k from s where score > 0) select q, title, score::int as score, k::int as k from r where k <= 20")
def w12(spark, sf):
    p = V.parts(spark, sf)
    q, t = p.select(F.left("form", F.lit(5)).alias("q")).distinct(), p.select(F.col("form").alias("title")).distinct()
    met = q.join(t, F.left("q", F.lit(2)) == F.left("title", F.lit(2)))
    fold = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    s = met.withColumn("score", LU.query_score(F.col("q"), F.col("title"), fold("q"), fold("title"), F.lit(1))).where("score > 0")
    return s.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "title"))).where("k <= 20")
