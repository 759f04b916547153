"""Queries over the lexicon: joins J7, J8, J14-J20, J26, A8, A29, A33, S4, U1, J1."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.functions import keys as K
from quorumlake.operators import lexical as X
from quorumlake.operators.cluster import connected_components
from quorumlake.plans import views as V
from quorumlake.plans.base import query
from quorumlake.plans.queries_keys import sql_consonants, sql_skeleton
from quorumlake.session import discard, written

P = V.sql("parts")
LEX = V.sql("tok", "lex")


@query("j1_components", P + """, n as (select id, 'S:' || split_part(form, ' ', 1) || '/' || lang || '/' || pos as node from parts union all select id, 'E:' || split_part(form, ' ', 2) || '/' || lang || '/' || size from parts union all select id, 'F:' || replace(form, ' ', '') || '/' || pos || '/' || size from parts where length(replace(form, ' ', '')) >= 4),
k as (select node, min(id) as first from n group by 1), e as (select distinct n.id as x, k.first as y from n join k using (node) where n.id <> k.first), b as (select x, y from e union all select y, x from e), r(id, root) as (select id, id from parts union select b.x, r.root from r join b on b.y = r.id) select id, min(root) as component from r group by id""")
def j1(spark, sf):
    """Rows hang together by shared keys of three kinds (surface, etymon, identical
    fold); keys are nodes too, so no pairs of rows are made."""
    p = V.parts(spark, sf)
    w, fold = F.split("form", " "), F.replace("form", F.lit(" "), F.lit(""))
    keys = F.array(F.concat_ws("/", F.concat(F.lit("S:"), w[0]), "lang", "pos"), F.concat_ws("/", F.concat(F.lit("E:"), w[1]), "lang", "size"),
                   F.when(F.length(fold) >= 4, F.concat_ws("/", F.concat(F.lit("F:"), fold), "pos", "size")))
    # key nodes stand above all row ids, so the least node of a component is a row
    edges = p.select("id", F.explode(keys).alias("k")).where("k is not null").select("id", (F.pmod(F.xxhash64("k"), F.lit(2**62)) + F.lit(2**62)).alias("node"))
    c = connected_components(edges, "id", "node").withColumnRenamed("node", "id")
    return p.select("id").join(c, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


WANTED = LEX + ", wanted as (select token from lex where lang = 'fr' and df >= 5 union select token from lex where lang = 'es' and df >= 5 union select form as token from (select 'the' as form)) "


@query("u1_wanted_union", WANTED + "select token from wanted")
def u1(spark, sf):
    lex = V.lexicon(spark, sf)
    both = lex.where("lang in ('fr', 'es') and df >= 5").select("token")
    return both.unionByName(spark.createDataFrame([("the",)], "token string")).distinct()


@query("j7_wanted_semi_join", WANTED + "select lang, token, df from lex where token in (select token from wanted)")
def j7(spark, sf):
    return V.lexicon(spark, sf).join(u1(spark, sf), "token", "left_semi").select("lang", "token", "df")


@query("s4_restricted_scan", WANTED + "select source, token, count(*) as uses from tok where token in (select token from wanted) group by 1, 2")
def s4(spark, sf):
    """Secondary editions (sources) scanned for wanted keys only, merged by key."""
    return V.words(spark, sf).join(u1(spark, sf), "token", "left_semi").groupBy("source", "token").agg(F.count(F.lit(1)).alias("uses"))


@query("j8_folded_lookup", LEX + f", f as (select lang, {sql_skeleton('token')} as fold, min(token) as first from lex group by 1, 2) select l.lang, l.token, f.first from lex l left join f on l.lang = f.lang and {sql_skeleton('l.token')} = f.fold")
def j8(spark, sf):
    lex = V.lexicon(spark, sf)
    fold = K.ascii_skeleton(F.col("token"))
    first = lex.groupBy("lang", fold.alias("fold")).agg(F.min("token").alias("first"))
    return lex.withColumn("fold", fold).join(first, ["lang", "fold"], "left").select("lang", "token", "first")


@query("j14_synonyms", P + ", e as (select id, lang, split_part(form, ' ', 2) as tr, pos, split_part(form, ' ', 1) as tok, form from parts), p as (select distinct a.id as x, b.id as y from e a join e b on a.lang = b.lang and a.tr = b.tr and a.pos = b.pos and a.id < b.id and a.tok <> b.tok and a.form <> b.form where length(a.tr) >= 3) select x as id, y as other from p union all select y, x from p")
def j14(spark, sf):
    w = F.split("form", " ")
    rows = V.parts(spark, sf).select("id", "lang", w[1].alias("tr"), "pos", F.array(w[0]).alias("toks"), "form")
    return X.synonym_edges(rows, "id", "lang", "tr", "pos", "toks", "form")


@query("j15_cross_source", V.sql("tok") + ", r as (select distinct source as word, lang, token from tok where length(token) >= 4), rare as (select token from r group by 1 having count(*) <= 150 and count(distinct lang) > 1), w as (select r.* from r where token in (select token from rare)), k as (select *, row_number() over (partition by token, lang order by word) as k from w) select token, lang, word, k::int as k from k where k <= 5")
def j15(spark, sf):
    rows = V.words(spark, sf).where(F.length("token") >= 4).select(F.col("source").alias("word"), "lang", "token").distinct()
    return X.cross_source_index(rows, "token", "lang", "word")


@query("j16_false_friends", LEX + ", m as (select token, lang, case when df >= 20 then 'common' when df >= 5 then 'known' else 'rare' end as meaning from lex where length(token) >= 2), a as (select o.token, o.lang from m o join m h on o.token = h.token and h.lang = 'en' and o.lang <> 'en' and o.meaning <> h.meaning) select token, count(distinct lang) as langs, case when count(distinct lang) >= 2 then 'high' else 'medium' end as severity from a group by 1")
def j16(spark, sf):
    meaning = F.when(F.col("df") >= 20, "common").when(F.col("df") >= 5, "known").otherwise("rare")
    rows = V.lexicon(spark, sf).where(F.length("token") >= 2).select("token", "lang", meaning.alias("meaning"))
    return X.false_friends(rows, "token", "lang", "meaning", "en")


@query("j17_mates", r"with s as (select doc_id, regexp_extract_all(lower(text), '(\p{L}+) (?:or|and|et|und|y) (\p{L}+)', 1) as a, regexp_extract_all(lower(text), '(\p{L}+) (?:or|and|et|und|y) (\p{L}+)', 2) as b from documents), p as (select unnest(a) as a, unnest(b) as b from s) select distinct least(a, b) as a, greatest(a, b) as b from p where a <> b")
def j17(spark, sf):
    t, pat = F.lower("text"), F.lit(r"(\p{L}+) (?:or|and|et|und|y) (\p{L}+)")
    zipped = F.arrays_zip(F.regexp_extract_all(t, pat, 1).alias("a"), F.regexp_extract_all(t, pat, 2).alias("b"))
    return X.mates(V.table(spark, sf, "documents").select(F.explode(zipped).alias("z")).select("z.a", "z.b"), "a", "b")


@query("j18_best_alternative", P + ", c as (select a.form, b.id, count(*) filter (contains(a.lang, left(b.lang, 7))) as bridges, max(b.freq) as freq from parts a join parts b on a.pos = b.pos and split_part(a.form, ' ', 2) = split_part(b.form, ' ', 2) and a.form <> b.form group by 1, 2), r as (select *, row_number() over (partition by form order by bridges > 0 desc, bridges desc, freq desc, id) as k from c) select form, id, bridges from r where k = 1")
def j18(spark, sf):
    p = X.repeated(V.parts(spark, sf).withColumn("tail", F.element_at(F.split("form", " "), -1)), "id", "many")
    # equal rows of the asking side count as often as they are, and meet once
    a = p.groupBy("form", "pos", "tail", F.col("lang")).agg(F.count(F.lit(1)).alias("times"))
    # rows of one kind have equal bridges: only their best one meets
    b = p.select("id", "pos", "tail", F.col("form").alias("oform"), F.col("lang").alias("olang"), "freq", "many")
    kinds = b.where("not many").groupBy("pos", "tail", "oform", "olang").agg(F.max_by(F.struct("id", "freq"), F.struct("freq", -F.col("id"))).alias("x")).select("x.id", "pos", "tail", "oform", "olang", "x.freq")
    met = kinds.unionByName(b.where("many").drop("many"))
    c = a.join(met, ["pos", "tail"]).where("form <> oform").groupBy("form", "id").agg(F.sum(F.when(F.contains("lang", F.left("olang", F.lit(7))), F.col("times")).otherwise(0)).alias("bridges"), F.max("freq").alias("freq"))
    return c.groupBy("form").agg(F.max_by(F.struct("id", "bridges"), F.struct(F.col("bridges") > 0, "bridges", "freq", -F.col("id"))).alias("x")).select("form", "x.id", "x.bridges")


@query("j19_surface_readings", LEX + f", q as materialized (select token as surface, {sql_skeleton('token')} as fold from lex where lang = 'en' and df >= 30), f as materialized (select lang, token, {sql_skeleton('token')} as fold from lex where lang <> 'en') select surface, lang, token, token = surface as exact from q join f using (fold)")
def j19(spark, sf):
    lex = V.lexicon(spark, sf)
    q = lex.where("lang = 'en' and df >= 30").select(F.col("token").alias("surface"), K.ascii_skeleton(F.col("token")).alias("fold"))
    f = lex.where("lang <> 'en'").select("lang", "token", K.ascii_skeleton(F.col("token")).alias("fold"))
    return q.join(f, "fold").select("surface", "lang", "token", (F.col("token") == F.col("surface")).alias("exact"))


@query("j20_reflex_join", LEX + f", h as (select {sql_skeleton('token')} as fold, count(*) as words from lex where lang = 'fr' group by 1), o as (select lang, {sql_skeleton('token')} as fold from lex where lang <> 'fr') select o.lang, count(*) filter (h.fold is not null) as linked, count(*) filter (h.fold is null) as missed, coalesce(sum(h.words), 0)::bigint as homonyms from o left join h on o.fold = h.fold group by 1")
def j20(spark, sf):
    lex = V.lexicon(spark, sf).withColumn("fold", K.ascii_skeleton(F.col("token")))
    h = lex.where("lang = 'fr'").groupBy("fold").agg(F.count(F.lit(1)).alias("words"))
    o = lex.where("lang <> 'fr'").select("lang", "fold").join(h, "fold", "left")
    return o.groupBy("lang").agg(F.count_if(F.col("words").isNotNull()).alias("linked"), F.count_if(F.col("words").isNull()).alias("missed"), F.coalesce(F.sum("words"), F.lit(0)).alias("homonyms"))


RULES = [("ing", ""), ("ed", ""), ("s", ""), ("ly", ""), ("er", "e")]
SQL_DERIVE = " union all ".join(f"select token as derived, {i} as i, '{a}>{b}' as pattern, left(token, length(token) - {len(a)}) || '{b}' as base from w where token like '%{a}' and length(token) - {len(a)} >= 3" for i, (a, b) in enumerate(RULES))


@query("j26_derivation_pairs", LEX + f", w as (select token from lex where lang = 'en'), c as ({SQL_DERIVE}), h as (select c.*, row_number() over (partition by derived order by i) as k from c where base <> derived and base in (select token from w)) select base, derived, pattern from h where k = 1")
def j26(spark, sf):
    return X.derivation_pairs(V.lexicon(spark, sf).where("lang = 'en'").select("token"), "token", RULES)


@query("a33_bigram_violations", LEX + ", w as (select lang, '^' || token || '$' as t, token from lex), b as (select lang, token, substr(t, k::int, 2) as bigram from (select *, unnest(range(1, length(t))) as k from w)), inv as (select distinct bigram from b where lang = 'en') select distinct token, bigram from b where lang = 'fr' and bigram not in (select bigram from inv)")
def a33(spark, sf):
    lex = V.lexicon(spark, sf)
    return X.bigram_violations(lex.where("lang = 'fr'").select("token"), "token", X.bigrams(lex.where("lang = 'en'"), "token"))


@query("a29_low_evidence", V.sql("tok") + f", r as (select distinct {sql_consonants('token')} as k, lang, source, token, left(token, 3) as g from tok where length(token) >= 4), l as (select * from r where length(k) >= 4), sh as (select k, g from l group by 1, 2 having count(distinct lang) >= 2), a as (select k, count(distinct lang) as langs from l group by 1 having count(distinct lang) >= 2 and count(distinct source) >= 2), s as (select k, arg_min(token, (length(token), token)) as gloss from l join sh using (k, g) group by 1), taken as (select distinct k from l where token like '%tion') select k as ckey, langs, gloss from a join s using (k) where k not in (select k from taken)")
def a29(spark, sf):
    docs = V.table(spark, sf, "documents").select("lang", "source", F.explode_outer(F.array_distinct(K.tokens(F.col("text")))).alias("token"))
    # written: keys are made once for each word of a language and source, not for each of its uses
    seen = written(docs.where(F.length("token") >= 4).distinct(), "words")
    l = written(seen.withColumn("ckey", K.consonant_key(F.col("token"))), "keyed").where(F.length("ckey") >= 4).withColumn("g", F.left("token", F.lit(3)))  # noqa: E741
    discard(seen)
    taken = l.where("token like '%tion'").select("ckey").distinct()
    return X.low_evidence(l, "ckey", "lang", "source", "token", "g", taken)


@query("a8_capped_merge", "with r as (select distinct lang, source, n from (select lang, source, n_chars % 50 as n from documents)), k as (select *, row_number() over (partition by lang order by n, source) as k from (select lang, n, min(source) as source from r group by 1, 2)) select lang, string_agg(n::varchar, ',' order by k) as merged from k where k <= 10 group by 1")
def a8(spark, sf):
    """Arrays of a group merged in order without repeats, cut to ten (the rule of the merge)."""
    rows = V.table(spark, sf, "documents").select("lang", (F.col("n_chars") % 50).alias("n")).distinct()
    k = F.row_number().over(W.partitionBy("lang").orderBy("n"))
    kept = rows.withColumn("k", k).where("k <= 10")
    return kept.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda s: s["n"].cast("string")), ",").alias("merged"))
