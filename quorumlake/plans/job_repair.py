"""Aspect pairs as a job: matched by their roots, repaired under a ladder of configurations, scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import keys as K
from quorumlake.operators import repair as R
from quorumlake.operators import walks
from quorumlake.plans import views as V
from quorumlake.plans.base import query
from quorumlake.plans.queries_keys import sql_consonants, sql_holdout, sql_standard
from quorumlake.session import discard, written

#: The inventory that the reports below were registered with.
VERBS_DIGEST = "a7e0831a9ba6f74ab7875c063c2bf3d8dc09ac015b2b33b77bf3593403825008"

ENDINGS = ["ati", "nųti", "iti", "jati", "ovati", "yvati", "ivati", "avati"]
PREFIXES = ["", "za", "po", "", "prě", ""]
#: Forms as they are generated: as they should be, with an ending of their own, with a
#: prefix, or from the other word of the name.
SQL_VERBS = f"""verbs as (select id, pos || lang as g, freq, size <= 25 as is_first, freq / 2500 as score, {PREFIXES}[id % 6 + 1] || split_part(form, ' ', 2) || {ENDINGS}[id % 8 + 1] as gold,
  case id % 5 when 0 then split_part(form, ' ', 1) || {ENDINGS}[id % 7 + 1] when 1 then split_part(form, ' ', 2) || {ENDINGS}[id % 3 + 1] when 2 then 'za' || split_part(form, ' ', 1) || {ENDINGS}[id % 8 + 1] else {PREFIXES}[id % 6 + 1] || split_part(form, ' ', 2) || {ENDINGS}[id % 8 + 1] end as form from parts),
keyed as (select *, {sql_consonants("gold")} as key from verbs)"""
#: Each left row in order takes the first related right row that no earlier one took.
SQL_MATCH = """rel as (select distinct a.g, a.key as lk, b.key as rk from (select distinct g, key from keyed where is_first) a join (select distinct g, key from keyed where not is_first) b
  on a.g = b.g and (starts_with(a.key, b.key) or starts_with(b.key, a.key) or ends_with(a.key, b.key) or ends_with(b.key, a.key) or (length(a.key) >= 2 and length(b.key) >= 2 and left(a.key, 2) = left(b.key, 2)))),
cand as (select l.g, l.id, row_number() over (partition by l.g order by l.id) as k, (select list(r.id order by r.id) from rel join keyed r on r.g = rel.g and r.key = rel.rk and not r.is_first where rel.g = l.g and rel.lk = l.key) as mine from keyed l where l.is_first),
walk(g, k, id, got, used) as (select g, k, id, mine[1], case when mine[1] is null then [] else [mine[1]] end from cand where k = 1
  union all select c.g, c.k, c.id, list_filter(c.mine, lambda x: not list_contains(w.used, x))[1], case when list_filter(c.mine, lambda x: not list_contains(w.used, x))[1] is null then w.used else list_append(w.used, list_filter(c.mine, lambda x: not list_contains(w.used, x))[1]) end from walk w join cand c on c.g = w.g and c.k = w.k + 1),
pair as (select g, id as left_id, got as right_id from walk where got is not null)"""


def verbs(spark: SparkSession, sf: str) -> DataFrame:
    """(id, g, is_first, score, gold, form, key): words of the part names as verbs."""
    ends, pres = F.array(*map(F.lit, ENDINGS)), F.array(*map(F.lit, PREFIXES))
    p = V.parts(spark, sf)
    one, two = F.split("form", " ")[0], F.split("form", " ")[1]
    end = lambda m: F.get(ends, (F.col("id") % m).cast("int"))
    gold = F.concat(F.get(pres, (F.col("id") % 6).cast("int")), two, end(8))
    five = F.col("id") % 5
    form = F.when(five == 0, F.concat(one, end(7))).when(five == 1, F.concat(two, end(3))).when(five == 2, F.concat(F.lit("za"), one, end(8))).otherwise(gold)
    return p.select("id", F.concat("pos", "lang").alias("g"), (F.col("size") <= 25).alias("is_first"), (F.col("freq") / 2500).alias("score"), gold.alias("gold"), form.alias("form"), K.consonant_key(gold).alias("key"))


def matched(rows: DataFrame) -> DataFrame:
    """(g, left_id, right_id) of the greedy walk on related roots."""
    left, right = rows.where("is_first").select("g", "key", F.col("id").alias("left")), rows.where("not is_first").select("g", "key", F.col("id").alias("right"))
    pairs = walks.greedy_match(left, right, walks.root_related(left, right, "g"), "g")
    return pairs.select("g", F.col("left").alias("left_id"), F.col("right").alias("right_id"))


@query("j29_related_pairs", V.sql("parts") + f", {SQL_VERBS}, {SQL_MATCH} select g, left_id, right_id from pair")
def j29_related(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(verbs(spark, sf), "verbs")  # their keys are read several times
    pairs = written(matched(rows), "pairs")
    discard(rows)
    return pairs


def _sql_ladder() -> str:
    """The repair in SQL: one row an option, the cheapest of each pair and configuration."""
    rules = ", ".join(f"({i}, '{r.name}', '{r.makes}', '{r.ending}', '{r.put}', '{r.level}', {list(r.unless)}::varchar[])" for i, r in enumerate(R.VERBS.rules))
    prefixes = ", ".join(f"({len(R.VERBS.rules) + i}, '{p}')" for i, p in enumerate(R.VERBS.prefixes))
    odd = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(R.VERBS.exceptions))
    use = ", ".join(f"('{n}', {list(u)}::varchar[])" for n, u in R.LADDER.items())
    related = lambda x, y: f"(starts_with({x}, {y}) or starts_with({y}, {x}) or ends_with({x}, {y}) or ends_with({y}, {x}) or (length({x}) >= 2 and length({y}) >= 2 and left({x}, 2) = left({y}, 2)))"
    one = lambda x: f"translate({x}, 'ųěåę', '1234')"  # noqa: E731  (there the distance counts bytes)
    edit = lambda x, y: f"levenshtein({one(x)}, {one(y)}) / greatest(length({x}), length({y}), 1)"
    norm = lambda x: sql_standard(f"lower(trim({x}))")
    return f"""rules(place, rule, makes, ending, put, level, nots) as (values {rules}), prefixes(place, prefix) as (values {prefixes}), odd(place, x, y) as (values {odd}), cfg(config, use) as (values {use}),
t as (select p.g, p.left_id, p.right_id, a.form as a, b.form as b, a.score as sa, b.score as sb, a.gold as ga, b.gold as gb, a.score >= b.score as held, {sql_holdout("(p.left_id || ':' || p.right_id)")} as held_out from pair p join keyed a on a.id = p.left_id join keyed b on b.id = p.right_id),
made as (select left_id, right_id, config, min(place) as place, makes, arg_min(rule, place) as rule, form from (select t.left_id, t.right_id, config, place, rule, makes, left(src, length(src) - length(ending)) || put as form from (select *, unnest([a, b]) as src, unnest(['second', 'first']) as side from t) t, rules, cfg
  where rules.makes = side and list_contains(use, level) and ends_with(src, ending) and len(list_filter(nots, lambda u: ends_with(src, u))) = 0 and left(src, length(src) - length(ending)) || put <> src) m group by left_id, right_id, config, makes, form),
opt as (select m.left_id, m.right_id, config, place, rule, case when makes = 'first' then m.form else a end as x, case when makes = 'first' then b else m.form end as y, round(case when makes = 'first' then {edit("m.form", "a")} + greatest(sa, 0) else {edit("m.form", "b")} + greatest(sb, 0) end, 6) as cost,
    case when makes = 'first' then not held else held end as may, {sql_consonants("case when makes = 'first' then m.form else a end")} as kx, {sql_consonants("case when makes = 'first' then b else m.form end")} as ky from made m join t using (left_id, right_id)),
opt2 as (select left_id, right_id, config, place, rule, x, y, cost from opt where may and {related("kx", "ky")} union all
  select left_id, right_id, config, place, 'prefix-perfectivization', a, prefix || a, round({edit("prefix || a", "b")} + greatest(sb, 0), 6) from t, prefixes, cfg where list_contains(use, 'prefix') and held and starts_with(b, prefix) and not starts_with(a, prefix) and length(b) > length(prefix) and {edit("a", "substr(b, length(prefix) + 1)")} <= {R.VERBS.near}),
best as (select *, row_number() over (partition by left_id, right_id, config order by cost, rule, place) as k from opt2),
irr as (select left_id, right_id, arg_min(x, place) as ox, arg_min(y, place) as oy from t, odd where {norm("a")} = {norm("x")} or {norm("b")} = {norm("y")} group by 1, 2),
tk as (select *, {sql_consonants("a")} as ka, {sql_consonants("b")} as kb from t),
fixed as (select tk.*, c.config, case when c.config = 'independent' then a when ox is not null then ox when {related("ka", "kb")} then a else coalesce(o.x, a) end as fa, case when c.config = 'independent' then b when ox is not null then oy when {related("ka", "kb")} then b else coalesce(o.y, b) end as fb,
   case when c.config = 'independent' then 'independent-baseline' when ox is not null then 'closed-suppletive-pair' when {related("ka", "kb")} then 'independent-roots-agree' else coalesce(o.rule, 'unrepaired') end as rule
   from tk cross join cfg c left join irr using (left_id, right_id) left join best o on o.left_id = tk.left_id and o.right_id = tk.right_id and o.config = c.config and o.k = 1),
judged as (select *, {norm("fa")} = {norm("ga")} as okx, {norm("fb")} = {norm("gb")} as oky, {sql_consonants("fa")} as kfa, {sql_consonants("fb")} as kfb from fixed),
scored as (select *, okx and oky as both_right, okx or oky as either_right, {related("kfa", "kfb")} as consistent from judged)"""


LADDER_SQL = V.sql("parts") + f", {SQL_VERBS}, {SQL_MATCH}, {_sql_ladder()} "


def scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The ladder's rows; pairs whose production result is an irregular pair are left out, as the report does."""
    inventory = R.VERBS.guarded(VERBS_DIGEST)
    rows = written(verbs(spark, sf), "verbs")
    side = lambda k, n: rows.select(F.col("id").alias(f"{k}_id"), F.col("form").alias(n), F.col("score").alias(f"{n}_score"), F.col("gold").alias(f"gold_{n}"))
    pairs = matched(rows).join(side("left", "first"), "left_id").join(side("right", "second"), "right_id")
    scored = written(R.score_ladder(pairs, inventory, F.concat_ws(":", "left_id", "right_id"), "gold_first", "gold_second"), "ladder")
    discard(rows)
    return scored


@query("a39_repair_ladder", LADDER_SQL + "select left_id, right_id, config, rule, fa as fixed_first, fb as fixed_second, both_right, either_right, consistent, held_out from scored")
def a39_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).select("left_id", "right_id", "config", "rule", "fixed_first", "fixed_second", "both_right", "either_right", "consistent", "held_out")


REGULAR = ", reg as (select * from scored where (left_id, right_id) not in (select (left_id, right_id) from scored where config = 'prefixes' and rule = 'closed-suppletive-pair')) "


@query("job_aspect_eval", LADDER_SQL + REGULAR + """, sp as (select *, unnest(['all', case when held_out then 'holdout' else 'dev' end]) as split from reg),
s as (select count(*) filter (m.both_right and not b.both_right) as fb, count(*) filter (b.both_right and not m.both_right) as bb, count(*) filter (m.either_right and not b.either_right) as fe, count(*) filter (b.either_right and not m.either_right) as be from reg b join reg m using (left_id, right_id) where b.config = 'independent' and m.config = 'prefixes')
select config || ' ' || split as item, count(*) as n, count(*) filter (both_right) as both, count(*) filter (either_right) as either, count(*) filter (consistent) as consistent from sp group by config, split
union all select 'rule ' || rule, count(*), null, null, null from reg where config = 'prefixes' group by rule
union all select 'sign test both_right', fb + bb, fb, bb, null from s union all select 'sign test either_right', fe + be, fe, be, null from s""")
def job_aspect_eval(spark: SparkSession, sf: str) -> DataFrame:
    """The report: rates by configuration and split, rules fired in production, pairs mended and broken."""
    scored = scored_pairs(spark, sf)
    irregular = scored.where("config = 'prefixes' and rule = 'closed-suppletive-pair'").select("left_id", "right_id")
    regular = scored.join(irregular, ["left_id", "right_id"], "left_anti")
    none = F.lit(None).cast("long")
    rates = R.ladder_report(regular).select(F.concat_ws(" ", "config", "split").alias("item"), "n", "both", "either", "consistent")
    rules = regular.where("config = 'prefixes'").groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("rule "), "rule").alias("item"), "n", none.alias("both"), none.alias("either"), none.alias("consistent"))
    signs = R.ladder_significance(regular, ["left_id", "right_id"], "independent", "prefixes").select(F.concat(F.lit("sign test "), "metric").alias("item"), (F.col("fixed") + F.col("broke")).alias("n"), F.col("fixed").alias("both"), F.col("broke").alias("either"), none.alias("consistent"))
    return rates.unionByName(rules).unionByName(signs)
