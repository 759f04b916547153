"""Queries of record linkage (J2, J4-J6, J9-J13, J23, J27-J31, W7, U-operators)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.functions import keys as K
from quorumlake.operators import link as L
from quorumlake.plans import views as V
from quorumlake.plans.base import query

P = V.sql("parts")


@query("j2_pointer_chase", """with c as (select c_custkey as k, case when c_custkey >= 4 then c_custkey // 4 end as p, c_mktsegment in ('BUILDING', 'MACHINERY') as f from customer)
select a.k as c_custkey, case when a.f then a.k when b.f then b.k when c2.f then c2.k when d.f then d.k when e.f then e.k end as "end", case when a.f then 0 when b.f then 1 when c2.f then 2 when d.f then 3 when e.f then 4 end as hops
from c a left join c b on a.p = b.k and not a.f left join c c2 on b.p = c2.k and not b.f left join c d on c2.p = d.k and not c2.f left join c e on d.p = e.k and not d.f""")
def j2(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") >= 4, F.floor(F.col("c_custkey") / 4)).alias("parent"), "c_mktsegment")
    return L.chase_parents(c, "c_custkey", "parent", F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))


@query("a35_chain_census", """with c as (select c_custkey as k, case when c_custkey >= 4 then c_custkey // 4 end as p, c_mktsegment as s from customer),
r as (select a.k, coalesce(case when a.s in ('BUILDING', 'MACHINERY') then a.s end, case when b.s in ('BUILDING', 'MACHINERY') then b.s end) as s from c a left join c b on a.p = b.k),
n as (select *, case when s = 'BUILDING' then 'inherited' when s = 'MACHINERY' then 'borrowed' else 'unresolved' end as class from r), o as (select *, row_number() over (partition by class order by k) as i from n)
select class, count(*) as n, string_agg(case when i <= 5 then k::varchar end, ',' order by i) as samples from o group by 1""")
def a35(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") >= 4, F.floor(F.col("c_custkey") / 4)).alias("parent"), "c_mktsegment")
    r = L.chase_parents(c, "c_custkey", "parent", F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), hops=1)
    seg = c.select(F.col("c_custkey").alias("end"), "c_mktsegment")
    n = r.join(seg, "end", "left").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "inherited").when(F.col("c_mktsegment") == "MACHINERY", "borrowed").otherwise("unresolved").alias("class"))
    return K_samples(n, "class", "c_custkey", 5)


def K_samples(df, label, key, keep):
    """Counts and the first keys of each class; only ``keep`` rows a class are gathered."""
    k = F.row_number().over(W.partitionBy(label).orderBy(key))
    first = df.withColumn("i", k).where(F.col("i") <= keep).groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", key))), lambda s: s[key].cast("string")), ",").alias("samples"))
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(first, label)


@query("u6_keep_union_resolved", "select c_custkey, 'direct' as via from customer where c_mktsegment = 'BUILDING' union all select c.c_custkey, 'parent' from customer c join customer p on c.c_custkey // 4 = p.c_custkey where c.c_mktsegment <> 'BUILDING' and p.c_mktsegment = 'BUILDING' and c.c_custkey >= 4")
def u6(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    keep = c.where("c_mktsegment = 'BUILDING'")
    late = c.where("c_mktsegment <> 'BUILDING' and c_custkey >= 4").withColumn("p", F.floor(F.col("c_custkey") / 4)).join(keep.select(F.col("c_custkey").alias("p")), "p", "left_semi")
    return keep.select("c_custkey", F.lit("direct").alias("via")).unionByName(late.select("c_custkey", F.lit("parent").alias("via")))


@query("j9_unique_or_abstain", P + "select form || '/' || lang as key, case when count(distinct id) = 1 then min(id) end as id, count(distinct id) as owners from parts group by 1")
def j9(spark, sf):
    return L.unique_or_abstain(V.parts(spark, sf).select(F.concat("form", F.lit("/"), "lang").alias("key"), "id"), "key", "id")


@query("j10_headword_resolution", P + """, w as (select id, form || ' ' || size as word, replace(form, ' ', '') || size as fold from parts), e as (select word, count(distinct id) as n, min(id) as i from w group by 1), f as (select fold, count(distinct id) as n, min(id) as i from w group by 1),
q as (select id as qid, word, replace(split_part(word, ' ', 1) || split_part(word, ' ', 2), ' ', '') || split_part(word, ' ', 3) as fold from (select id, case when id % 3 = 0 then upper(form || ' ' || size) else form || ' ' || size end as word from parts))
select qid, case when e.word is not null then case when e.n = 1 then e.i end else case when f.n = 1 then f.i end end as resolved from q left join e on q.word = e.word left join f on q.fold = f.fold""")
def j10(spark, sf):
    p = V.parts(spark, sf)
    word = F.concat("form", F.lit(" "), "size")
    q = p.select(F.col("id").alias("qid"), F.when(F.col("id") % 3 == 0, F.upper(word)).otherwise(word).alias("word"))
    return L.resolve_headwords(q, p.select("id", word.alias("word")), "word", F.replace("word", F.lit(" "), F.lit("")), "id").select("qid", "resolved")


def _sides(spark, sf):
    """Two halves of the parts as candidates and as the authoritative table."""
    p = V.parts(spark, sf).withColumn("toks", F.split(F.concat("form", F.lit(" "), F.lower("lang")), " "))
    left = p.where("id % 2 = 1").select("id", "form", "pos", "toks", "freq")
    right = p.where("id % 2 = 0").select(F.col("id").alias("rid"), F.col("form").alias("rform"), F.col("pos").alias("rpos"), F.col("toks").alias("rtoks"))
    return left, right


SIDES = P + """, t as (select *, string_split(form || ' ' || lower(lang), ' ') as toks from parts), l as (select * from t where id % 2 = 1), r as (select id as rid, form as rform, pos as rpos, toks as rtoks from t where id % 2 = 0),
m as (select id, rid, form, rform, pos, len(list_intersect(toks, rtoks)) as shared, len(toks) as n, len(rtoks) as rn from l join r on pos = rpos and len(list_intersect(toks, rtoks)) > 0) """
SCORE = "round(0.42::double * shared / rn + 0.36::double * (1 - levenshtein(form, rform) / greatest(length(form), length(rform), 1)) + 0.22::double * shared / n, 6)"


@query("j4_fuzzy_link", SIDES + f", s as (select id, rid, {SCORE} as score from m), b as (select *, row_number() over (partition by id order by score desc, rid) as k from s) select id, rid, score from b where k = 1 and score >= 0.42")
def j4(spark, sf):
    return L.fuzzy_link(*_sides(spark, sf))


PREFIXES = ["small ", "large ", "hot ", "old "]
SQL_HAS = "[" + ", ".join(f"case when starts_with(form, '{p}') then {i} end" for i, p in enumerate(PREFIXES)) + "]"


@query("j5_stripped_retry", SIDES + f""", s as (select id, rid, {SCORE} as score from m), b as (select *, row_number() over (partition by id order by score desc, rid) as k from s), hit as (select id, rid, score from b where k = 1 and score >= 0.8),
miss as (select l.* from l where id not in (select id from hit)), mem as (select pos, lang, unnest(list_filter({SQL_HAS}, lambda x: x is not null)) as i from miss), cnt as (select pos, lang, count(*) as n from miss group by 1, 2),
pre as (select pos, lang, i, count(*) as c from mem group by 1, 2, 3), maj as (select pos, lang, arg_max(i, (c, -i)) as i from pre join cnt using (pos, lang) where c >= 2 and 2 * c >= n group by 1, 2),
t2 as (select m.id, rid, rform, shared, m.n, rn, coalesce(starts_with(m.form, {PREFIXES}[i + 1]), false) as cut, case when starts_with(m.form, {PREFIXES}[i + 1]) then substr(m.form, length({PREFIXES}[i + 1]) + 1) else m.form end as form from m join miss on m.id = miss.id left join maj on miss.pos = maj.pos and miss.lang = maj.lang),
s2 as (select id, rid, cut, round(case when cut then 0.94 else 1 end * {SCORE}, 6) as score from t2), b2 as (select *, row_number() over (partition by id order by score desc, rid) as k from s2)
select id, rid, score, false as stripped from hit union all select id, rid, score, cut from b2 where k = 1 and score >= 0.42""")
def j5(spark, sf):
    """Rows without a strong link are linked again without the prefix that most of
    their group share, at a discount."""
    left, right = _sides(spark, sf)
    hit = L.fuzzy_link(left, right, 0.8)
    rest = left.join(V.parts(spark, sf).select("id", "lang"), "id").join(hit.select("id"), "id", "left_anti")
    bare = L.strip_majority_prefix(rest, ["pos", "lang"], "form", PREFIXES)
    again = L.fuzzy_link(bare, right, 0.0).join(bare.select("id", "stripped"), "id")
    again = again.withColumn("score", F.round(F.when(F.col("stripped"), 0.94).otherwise(1.0) * F.col("score"), 6)).where("score >= 0.42")
    return hit.withColumn("stripped", F.lit(False)).unionByName(again)


@query("j6_rescue", SIDES + f""", s as (select id, rid, {SCORE} as score from m), b as (select *, row_number() over (partition by id order by score desc, rid) as k from s), d as (select form, count(*) as n, count(*) filter (lang in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8', 'Brand#9', 'Brand#10', 'Brand#11', 'Brand#12')) as named from parts group by 1)
select b.id, b.rid, 0.42::double as score from b join parts p on b.id = p.id join d on p.form = d.form where k = 1 and score >= 0.34 and score < 0.72 and named * 2 >= n""")
def j6(spark, sf):
    """Links below the mark are accepted at it when half of the group names the same ancestor."""
    left, right = _sides(spark, sf)
    weak = L.fuzzy_link(left, right, 0.34).where("score < 0.72")
    p = V.parts(spark, sf)
    group = p.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang").isin(*[f"Brand#{i}" for i in range(1, 13)])).alias("named")).where("named * 2 >= n").select("form")
    return weak.join(p.select("id", "form"), "id").join(group, "form", "left_semi").select("id", "rid", F.lit(0.42).alias("score"))


@query("j11_authoritative_match", P + """, o as (select form, pos, min(id) as oid, count(*) as n, max(size) as size from parts where id % 2 = 0 group by 1, 2), c as (select id, form, pos, size, row_number() over (partition by pos, lang order by freq desc, id) as rank from parts where id % 2 = 1),
m as (select c.pos, c.id, rank, o.oid, abs(c.size - o.size) as gap from c join o on c.form = o.form and c.pos = o.pos where rank <= 5), b as (select *, row_number() over (partition by id order by rank, gap, oid) as k from m) select id, oid, rank::int as rank from b where k = 1""")
def j11(spark, sf):
    p = V.parts(spark, sf)
    o = p.where("id % 2 = 0").groupBy("form", "pos").agg(F.min("id").alias("oid"), F.max("size").alias("osize"))
    c = p.where("id % 2 = 1").withColumn("rank", F.row_number().over(W.partitionBy("pos", "lang").orderBy(F.desc("freq"), "id"))).where("rank <= 5")
    m = c.join(o, ["form", "pos"]).withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("rank", F.abs(F.col("size") - F.col("osize")), "oid")))
    return m.where("k = 1").select("id", "oid", "rank")


FATES = V.sql("tok", "lex") + """, own as (select token, count(distinct lang) as langs, min(lang) as lang from lex group by 1), f as (select l.lang, l.token, case when length(l.token) < 3 then 'Skipped' when o.langs > 1 and l.lang <> o.lang then 'DedupedXref' when l.df = 1 and l.token like '%-%' then 'DedupedFold' end as first from lex l join own o using (token)),
t as (select *, row_number() over (partition by left(token, 6), lang order by token) as k from f where first is null) select lang, token, first as fate from f where first is not null union all select lang, token, case when k > 1 then 'DedupedRawTwin' else 'Rendered' end from t"""


@query("j12_row_fates", FATES)
def j12(spark, sf):
    return row_fates(spark, sf)


def row_fates(spark, sf):
    """First claim wins: skipped, claimed by another owner, by a fold, by a twin among the unclaimed, else rendered."""
    lex = V.lexicon(spark, sf)
    own = lex.groupBy("token").agg(F.count(F.lit(1)).alias("langs"), F.min("lang").alias("owner"))
    f = lex.join(own, "token").withColumn("first", F.when(F.length("token") < 3, "Skipped").when((F.col("langs") > 1) & (F.col("lang") != F.col("owner")), "DedupedXref")
                                          .when((F.col("df") == 1) & F.contains("token", F.lit("-")), "DedupedFold"))
    # claimed rows get a partition of their own token, so they cannot crowd a twin group
    twin = F.row_number().over(W.partitionBy("lang", F.when(F.col("first").isNull(), F.left("token", F.lit(6))).otherwise(F.col("token")), F.col("first").isNull()).orderBy("token"))
    return f.withColumn("k", twin).select("lang", "token", F.coalesce("first", F.when(F.col("k") > 1, "DedupedRawTwin").otherwise("Rendered")).alias("fate"))


@query("a10_coverage_report", FATES.replace("select lang, token, first as fate from f where", ", fates as (select lang, token, first as fate from f where").rstrip() + ") select lang, fate, count(*) as n from fates group by grouping sets ((lang, fate), (fate), ())")
def a10(spark, sf):
    return row_fates(spark, sf).groupingSets([["lang", "fate"], ["fate"], []], "lang", "fate").agg(F.count(F.lit(1)).alias("n"))


@query("j13_near_match", SIDES + ", d as (select id, rid, rform, levenshtein(form, rform) as distance from m where levenshtein(form, rform) <= 2), b as (select *, row_number() over (partition by id order by distance, rform, rid) as k from d) select id, rid, distance::int as distance from b where k = 1")
def j13(spark, sf):
    left, right = _sides(spark, sf)
    near = L.met_kinds(left, right).withColumn("distance", F.levenshtein(F.col("form"), F.col("rform"), 2)).where("distance >= 0")
    best = near.groupBy(*L.LEFT).agg(F.min(F.struct("distance", "rform", "rid")).alias("x"))
    return left.join(best, list(L.LEFT)).select("id", "x.rid", "x.distance")


@query("j23_nearest_suggestion", P + ", q as (select distinct translate(form, 'aeo', 'oea') as q from parts), f as (select distinct form from parts), d as (select q, form, levenshtein(q, form) as distance from q join f on left(q, 1) = left(form, 1) and abs(length(q) - length(form)) <= 2), r as (select *, row_number() over (partition by q order by distance, form) as k from d where distance <= 2) select q, form, distance::int as distance, k::int as k from r where k <= 3")
def j23(spark, sf):
    p = V.parts(spark, sf)
    q = p.select(F.translate("form", "aeo", "oea").alias("q"))
    return L.nearest_by_edit(q, p, "q", "form", F.left("q", F.lit(1)), F.left("form", F.lit(1)))


CONCEPTS = P + ", k as (select form, pos, lang, list_distinct(string_split(form || ' ' || lower(pos), ' ')) as toks, min(id) as least from parts group by 1, 2, 3), rows as (select min(least) as id, form, pos, toks from k group by form, pos, toks) "


@query("j27_evidence_augmentation", CONCEPTS + ", cited as (select r.id, k.lang from rows r join k using (form, pos)), met as (select r.id, k.lang, k.least as cand, len(list_intersect(r.toks, k.toks)) as overlap from rows r join k on len(list_intersect(r.toks, k.toks)) >= 2), fresh as (select * from met where (id, lang) not in (select (id, lang) from cited)), b as (select *, row_number() over (partition by id, lang order by overlap desc, cand) as n from fresh) select id, lang, cand, overlap::int as overlap from b where n = 1")
def j27(spark, sf):
    """Concepts (a form and class) cite the languages of their parts; other languages are
    filled by the part that shares most of at least two tokens."""
    p = V.parts(spark, sf).select("id", "form", "pos", "lang", F.split(F.concat("form", F.lit(" "), F.lower("pos")), " ").alias("toks"))
    kinds = p.groupBy("form", "pos", "lang", "toks").agg(F.min("id").alias("cand"))
    rows = kinds.groupBy("form", "pos", "toks").agg(F.min("cand").alias("id"))
    return L.augment_evidence(rows, kinds, kinds.join(rows.select("form", "pos", "id"), ["form", "pos"]))


@query("j28_calibration_samples", SIDES + ", b as (select id, rid, form, rform, shared, row_number() over (partition by id order by shared desc, rid) as k from m) select id, rid, shared::int as overlap, form = rform as hit from b where k = 1")
def j28(spark, sf):
    left, right = _sides(spark, sf)
    m = L.met_kinds(left, right).withColumn("overlap", L.shared_tokens())
    best = m.groupBy(*L.LEFT).agg(F.min(F.struct(-F.col("overlap"), "rid", (F.col("form") == F.col("rform")).alias("hit"), "overlap")).alias("x"))
    return left.join(best, list(L.LEFT)).select("id", "x.rid", "x.overlap", "x.hit")


ORD = "with o as (select o_custkey as g, o_orderkey as k, o_orderstatus as s, row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) as r from orders where o_orderstatus in ('O', 'F'))"


@query("j29_greedy_pairs", ORD + " select a.g as o_custkey, a.k as left_key, b.k as right_key from o a join o b on a.g = b.g and a.r = b.r and a.s = 'O' and b.s = 'F'")
def j29(spark, sf):
    from quorumlake.operators.graph import greedy_pairs

    return greedy_pairs(V.table(spark, sf, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F")


@query("j34_reciprocal_links", ORD + ", p as (select a.k as x, b.k as y from o a join o b on a.g = b.g and a.r = b.r and a.s = 'O' and b.s = 'F') select x as source, y as target from p union all select y, x from p")
def j34(spark, sf):
    from quorumlake.operators.graph import reciprocal

    return reciprocal(j29(spark, sf), "left_key", "right_key")


@query("q3_reciprocity_check", ORD + ", p as (select a.k as x, b.k as y from o a join o b on a.g = b.g and a.r = b.r and a.s = 'O' and b.s = 'F') select y as source, x as target from p where x % 50 = 0")
def q3(spark, sf):
    """Links without their reverse: exactly those whose reverse was taken away here."""
    from quorumlake.operators.quality import missing_reverse

    links = j34(spark, sf)
    gone = j29(spark, sf).where("left_key % 50 = 0").select(F.col("left_key").alias("source"), F.col("right_key").alias("target"))
    return missing_reverse(links.join(gone, ["source", "target"], "left_anti"), "source", "target")


@query("a39_pair_scoring", ORD + ", p as (select a.g, a.k as x, b.k as y from o a join o b on a.g = b.g and a.r = b.r and a.s = 'O' and b.s = 'F'), t as (select p.*, ox.o_orderpriority as px, oy.o_orderpriority as py from p join orders ox on x = ox.o_orderkey join orders oy on y = oy.o_orderkey) select count(*) as pairs, count(*) filter (px <= '2' and py <= '2') as both_high, count(*) filter (px <= '2' or py <= '2') as either_high, count(*) filter (px = py) as consistent from t")
def a39(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    t = (j29(spark, sf).join(o.select(F.col("o_orderkey").alias("left_key"), F.col("o_orderpriority").alias("px")), "left_key")
         .join(o.select(F.col("o_orderkey").alias("right_key"), F.col("o_orderpriority").alias("py")), "right_key"))
    x, y = F.col("px") <= "2", F.col("py") <= "2"
    return t.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(x & y).alias("both_high"), F.count_if(x | y).alias("either_high"), F.count_if(F.col("px") == F.col("py")).alias("consistent"))


SNAP = "with o as (select * from customer where c_custkey % 10 <> 0), n as (select c_custkey, c_name, c_nationkey, c_acctbal + case when c_custkey % 7 = 0 then 1 else 0 end as c_acctbal, c_mktsegment from customer where c_custkey % 10 <> 1) "


@query("j30_snapshot_diff", SNAP + "select coalesce(o.c_custkey, n.c_custkey) as c_custkey, case when o.c_custkey is null then 'added' when n.c_custkey is null then 'removed' else 'changed' end as change from o full join n using (c_custkey) where o.c_custkey is null or n.c_custkey is null or o.c_acctbal <> n.c_acctbal")
def j30(spark, sf):
    old, new = _snapshots(spark, sf)
    return L.snapshot_diff(old, new, "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


def _snapshots(spark, sf):
    c = V.table(spark, sf, "customer")
    new = c.where("c_custkey % 10 <> 1").withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0))
    return c.where("c_custkey % 10 <> 0"), new


@query("u5_snapshot_sets", SNAP + "select c_custkey, 'added' as change from n where c_custkey not in (select c_custkey from o) union all select c_custkey, 'removed' from o where c_custkey not in (select c_custkey from n)")
def u5(spark, sf):
    old, new = (x.select("c_custkey") for x in _snapshots(spark, sf))
    return new.join(old, "c_custkey", "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new, "c_custkey", "left_anti").withColumn("change", F.lit("removed")))


@query("u2_taken_set", P + ", k as (select id, form || 's' as skey, row_number() over (partition by form order by id) as r from parts where id % 2 = 1) select id, skey from k where r = 1 and skey not in (select form || 's' from parts where id % 2 = 0 and size > 25)")
def u2(spark, sf):
    p = V.parts(spark, sf)
    taken = p.where("id % 2 = 0 and size > 25").select(F.concat("form", F.lit("s")).alias("skey")).distinct()
    return p.where("id % 2 = 1").groupBy(F.concat("form", F.lit("s")).alias("skey")).agg(F.min("id").alias("id")).join(taken, "skey", "left_anti").select("id", "skey")


@query("u3_token_tests", P + ", a as (select id, string_split(form, ' ') as x, string_split(lower(pos) || ' ring', ' ') as y from parts) select id, len(list_intersect(x, y))::int as shared, list_has_any(x, y) as meets, len(list_filter(list_distinct(x), lambda t: not list_contains(y, t))) = 0 as subset from a")
def u3(spark, sf):
    x, y = F.split("form", " "), F.split(F.concat(F.lower("pos"), F.lit(" ring")), " ")
    return V.parts(spark, sf).select("id", F.size(F.array_intersect(x, y)).alias("shared"), F.arrays_overlap(x, y).alias("meets"), (F.size(F.array_except(x, y)) == 0).alias("subset"))


@query("u7_uncovered", P + "select id, form from parts where id % 2 = 0 and (form, pos) not in (select (form, pos) from parts where id % 2 = 1 and size > 30)")
def u7(spark, sf):
    p = V.parts(spark, sf)
    return p.where("id % 2 = 0").join(p.where("id % 2 = 1 and size > 30").select("form", "pos"), ["form", "pos"], "left_anti").select("id", "form")


@query("w7_one_per_row", SIDES + f", s as (select id, rid, shared, {SCORE} as score from m), b as (select *, row_number() over (partition by rid order by shared desc, floor(score * 1000) desc, id) as k from s) select rid, id from b where k = 1")
def w7(spark, sf):
    left, right = _sides(spark, sf)
    best = L.met_kinds(left, right).groupBy(*L.RIGHT).agg(F.max_by("lid", F.struct(L.shared_tokens(), F.floor(L.link_score() * 1000), -F.col("lid"))).alias("id"))
    return right.join(best, list(L.RIGHT)).select("rid", "id")


@query("j33_evidence_plumbing", P + ", t as (select id, case when size > 40 then 'inline' end as tag from parts) select p.id, coalesce(t.tag, case when e.event_type is not null then e.event_type end, 'none') as tag from parts p left join t on p.id = t.id left join events e on p.id = e.event_id")
def j33(spark, sf):
    p = V.parts(spark, sf)
    e = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    inline = p.where("size > 40").select("id", F.lit("inline").alias("tag"))
    return p.join(inline, "id", "left").join(e, "id", "left").select("id", F.coalesce("tag", "event_type", F.lit("none")).alias("tag"))


@query("w14_proposals", P + ", o as (select distinct replace(form, ' ', '') as f from parts where id % 2 = 0 and size > 20) select id, form, case when freq >= 1500 then 'propose' else 'review' end as bucket from parts where id % 2 = 1 and length(form) >= 3 and freq >= 1000 and replace(form, ' ', '') not in (select f from o)")
def w14(spark, sf):
    p = V.parts(spark, sf)
    fold = F.replace("form", F.lit(" "), F.lit(""))
    taken = p.where("id % 2 = 0 and size > 20").select(fold.alias("f")).distinct()
    c = p.where("id % 2 = 1").where((F.length("form") >= 3) & (F.col("freq") >= 1000)).withColumn("f", fold)
    return c.join(taken, "f", "left_anti").select("id", "form", F.when(F.col("freq") >= 1500, "propose").otherwise("review").alias("bucket"))
