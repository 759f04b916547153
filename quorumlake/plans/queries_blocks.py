"""Queries of linkage by several kinds of blocks, deep rescue, and prefix search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.functions import keys as K
from quorumlake.operators import blocklink as B
from quorumlake.operators import prefix as P
from quorumlake.plans import views as V
from quorumlake.plans.base import query
from quorumlake.plans.queries_keys import sql_skeleton

# A third of the groups has a gloss of its own, so that only descendants can link it.
PARTS = V.sql("parts") + """, g as (select id, case when id % 5 = 0 then null else pos end as pos, case when id % 3 = 0 then ['own' || id] else list_distinct(string_split(form, ' ') || [lower(lang)]) end as toks,
  [split_part(form, ' ', 1) || size % 3, split_part(form, ' ', 2) || lower(right(lang, 2)), split_part(form, ' ', 2) || lower(right(lang, 2))] as sks from parts where id % 2 = 1),
e as (select id as rid, pos as rpos, split_part(form, ' ', 2) || size % 10 as rform, list_distinct(string_split(form, ' ') || [lower(lang)]) as rtoks, [split_part(form, ' ', 1) || size % 3, split_part(form, ' ', 2) || lower(right(lang, 2))] as rsks from parts where id % 2 = 0),
p as (select g.*, e.*, list_sort(list_transform(list_distinct(sks), lambda v: {'n': len(list_filter(sks, lambda x: x = v)), 'v': v}), 'desc')[1].v as mode from g join e on (list_has_any(toks, rtoks) or list_has_any(sks, rsks)) and (pos is null or rpos is null or pos = rpos)),
s as (select id, rid, len(list_filter(sks, lambda x: list_contains(rsks, x)))::double / len(sks) as m, 1 - levenshtein(rform, mode)::double / greatest(length(rform), length(mode), 1) as f, len(list_intersect(toks, rtoks))::double / len(toks) as o from p),
t as (select *, round(0.42::double * m + 0.36::double * f + 0.22::double * o, 6) as score from s), b as (select *, row_number() over (partition by id order by score desc, rid) as k from t) """


def sides(spark, sf):
    p = V.parts(spark, sf)
    one, two = F.split("form", " ")[0], F.split("form", " ")[1]
    tail = F.lower(F.right("lang", F.lit(2)))
    toks = F.array_distinct(F.array(one, two, F.lower("lang")))
    first, second = F.concat(one, (F.col("size") % 3).cast("string")), F.concat(two, tail)
    groups = p.where("id % 2 = 1").select("id", F.when(F.col("id") % 5 != 0, F.col("pos")).alias("pos"), F.when(F.col("id") % 3 == 0, F.array(F.concat(F.lit("own"), F.col("id").cast("string")))).otherwise(toks).alias("toks"), F.array(first, second, second).alias("sks"))
    entries = p.where("id % 2 = 0").select(F.col("id").alias("rid"), F.col("pos").alias("rpos"), F.concat(two, (F.col("size") % 10).cast("string")).alias("rform"), toks.alias("rtoks"), F.array(first, second).alias("rsks"))
    return groups, entries


@query("j4_block_link", PARTS + "select id, rid, score, round(m, 6) as membership, round(f, 6) as form_similarity, round(o, 6) as gloss_overlap from b where k = 1 and score >= 0.42")
def j4_blocks(spark, sf):
    """Groups meet reconstructions on tokens that may decide and on skeletons of descendants."""
    return B.block_link(*sides(spark, sf))


@query("j6_deep_rescue", PARTS + """, w as (select id, rid from b where k = 1 and score >= 0.5 and score < 0.75), i as (select g.id, unnest(range(3)) as item from g), n as (select w.id, w.rid, i.item, (w.id + i.item) % 4 = w.rid % 4 or (w.id * 3 + i.item) % 5 = w.rid % 5 as hit from w join i using (id)),
c as (select id, rid, count(*) filter (hit) / count(*) as share from n group by 1, 2) select id, rid, 0.75::double as score, round(share, 6) as share from c where share >= 0.5""")
def j6_deep(spark, sf):
    """Weak links are accepted where half of the cognates name a deep ancestor of the
    candidate in their own etymologies."""
    groups, entries = sides(spark, sf)
    links = B.block_link(groups, entries, accept=0.5)
    text = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    cognates = groups.select("id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("item"))
    cognates = cognates.select("id", "item", F.array(text("a", (F.col("id") + F.col("item")) % 4), text("b", (F.col("id") * 3 + F.col("item")) % 5)).alias("deep"))
    ancestors = entries.select("rid", F.explode(F.array(text("a", F.col("rid") % 4), text("b", F.col("rid") % 5))).alias("deep"))
    return B.deep_rescue(links, cognates, ancestors, floor=0.5, share=0.5, accept=0.75)


SEARCH = V.sql("parts") + f""", e0 as (select id as entry, form || ' ' || lower(right(lang, 2)) as title, lower(pos) || ', ' || split_part(form, ' ', 2) || '; x ' || lower(lang) as gloss, [form, split_part(form, ' ', 2) || size] as keys, [split_part(form, ' ', 1) || 'ě' || size % 7, 'Za' || split_part(form, ' ', 2)] as words, size % 2 = 0 as first from parts),
e as (select *, {sql_skeleton("title")} as ft, list_transform(words, lambda w: lower(w)) as lw, list_transform(words, lambda w: {sql_skeleton("w")}) as fw, string_split(regexp_replace(gloss, '[,;]\\s*', '|', 'g'), '|') as segs from e0),
q as (select distinct unnest([left(form, 5), 'to ' || split_part(form, ' ', 2), split_part(form, ' ', 2) || size, split_part(form, ' ', 1) || 'ě', 'Zab', left(split_part(form, ' ', 2), 1), lower(right(lang, 2)), substr(form, 3, 4)]) as q from parts),
n as (select q, regexp_replace(lower(trim(q)), '^to\\s+', '') as s2, {sql_skeleton("regexp_replace(lower(trim(q)), '^to\\s+', '')")} as sf from q),
m as (select q, s2, sf, e.* from n, e),
s as (select q, entry, title, greatest(case when lower(title) = s2 then 100 else 0 end, case when ft = sf then 90 else 0 end, case when keys[1] in (s2, sf) then 82 when keys[2] in (s2, sf) then 79 else 0 end,
  case when starts_with(lower(title), s2) or starts_with(ft, sf) then 60 else 0 end, case when list_contains(segs, s2) then 55 else 0 end, case when starts_with(keys[1], sf) or starts_with(keys[2], sf) then 50 else 0 end, case when contains(lower(title), s2) then 40 else 0 end, case when contains(gloss, s2) then 20 else 0 end,
  greatest({", ".join(f"case when lw[{i}] in (s2, sf) then case when first then 82 else 62 end when fw[{i}] = sf then case when first then 72 else 54 end when (length(s2) >= 2 and starts_with(lw[{i}], s2)) or (length(sf) >= 2 and starts_with(fw[{i}], sf)) then case when first then 56 else 44 end else 0 end" for i in (1, 2))})) as score from m where s2 <> ''),
h as (select *, row_number() over (partition by q order by entry) as n from s where score > 0), k as (select *, row_number() over (partition by q order by score desc, title, entry) as k from h where n <= 301) """


@query("w12_prefix_search", SEARCH + "select q, entry, title, score::int as score, k::int as k from k where k <= 20")
def w12_prefix(spark, sf):
    """All tiers of a search, aliases too, over prefix ranges; hits are read up to 301."""
    p = V.parts(spark, sf)
    one, two, brand = F.split("form", " ")[0], F.split("form", " ")[1], F.lower(F.right("lang", F.lit(2)))
    size = F.col("size").cast("string")
    alias = lambda w: F.struct(w.alias("word"), (F.col("size") % 2 == 0).alias("first"))
    key = lambda k, r: F.struct(k.alias("key"), F.lit(r).alias("rank"))
    rows = p.select(F.col("id").alias("entry"), F.concat_ws(" ", "form", brand).alias("title"), F.concat(F.lower("pos"), F.lit(", "), two, F.lit("; x "), F.lower("lang")).alias("gloss"),
                    F.array(key(F.col("form"), 1), key(F.concat(two, size), 2)).alias("keys"), F.array(alias(F.concat(one, F.lit("ě"), (F.col("size") % 7).cast("string"))), alias(F.concat(F.lit("Za"), two))).alias("aliases"))
    asked = p.select(F.explode(F.array(F.left("form", F.lit(5)), F.concat(F.lit("to "), two), F.concat(two, size), F.concat(one, F.lit("ě")), F.lit("Zab"), F.left(two, F.lit(1)), brand, F.substring("form", 3, 4))).alias("q"))
    return P.search(asked, P.terms_of(rows, K.ascii_skeleton), rows.select("entry", "title"), K.ascii_skeleton, keep=20, stop=300)
