"""Queries of keys, predicates and projections (P operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.functions import cascade, keys as K, tags
from quorumlake.plans import views as V
from quorumlake.plans.base import query

STOP = ["the", "and", "of", "to", "in", "for", "with", "that"]

# ---- SQL text of the column builders -------------------------------------------


def sql_standard(x: str) -> str:
    return f"replace(translate({x}, '{K.FLAVOURED[0]}', '{K.FLAVOURED[1]}'), 'đ', 'dž')"


def sql_skeleton(x: str) -> str:
    return f"translate({sql_standard(f'lower({x})')}, '{K.ACCENTED[0]}', '{K.ACCENTED[1]}')"


def sql_consonants(x: str) -> str:
    x = f"translate({sql_skeleton(x)}, 'hw', 'gv')"
    for c in "bcdfgklmnpqrstvxzñßäöüëï-":
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return f"regexp_replace({x}, '[aeiouyj''ьъ]', '', 'g')"


def sql_fnv(x: str) -> str:
    """FNV-1a, 32 bits, of ASCII text."""
    return f"list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i::int, 1))::bigint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


def sql_fnv_utf8(x: str) -> str:
    """FNV-1a, 32 bits, of any text."""
    return f"list_reduce(list_prepend(2166136261::bigint, list_transform(range(0, length(hex(encode({x}))) // 2), lambda i: ('0x' || substr(hex(encode({x})), (2 * i + 1)::int, 2))::bigint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


def sql_holdout(x: str) -> str:
    return f"(list_reduce(list_prepend(1, list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i::int, 1)))), lambda h, b: (xor(h, b & 3) * 3) % 4) = 0)"


LEX = V.sql("tok", "lex")


@query("p1_standard_fold", LEX + f"select lang, token, {sql_standard('token')} as fold from lex")
def p1(spark, sf):
    return V.lexicon(spark, sf).select("lang", "token", K.to_standard(F.col("token")).alias("fold"))


@query("p2_ascii_skeleton", LEX + f"select lang, token, {sql_skeleton('token')} as skeleton from lex")
def p2(spark, sf):
    return V.lexicon(spark, sf).select("lang", "token", K.ascii_skeleton(F.col("token")).alias("skeleton"))


@query("p3_consonant_key", LEX + f"select lang, token, {sql_consonants('token')} as ckey from lex")
def p3(spark, sf):
    return V.lexicon(spark, sf).select("lang", "token", K.consonant_key(F.col("token")).alias("ckey"))


def _name_pairs(spark, sf):
    """Distinct names that share their second word, in order: an equi-join, not all pairs."""
    n = V.parts(spark, sf).select("form").distinct().withColumn("tail", F.element_at(F.split("form", " "), -1))
    a, b = n.select(F.col("form").alias("a"), "tail"), n.select(F.col("form").alias("b"), "tail")
    return a.join(b, "tail").where("a < b").select("a", "b")


PAIRS = V.sql("parts") + ", n as (select distinct form, split_part(form, ' ', 2) as tail from parts), pairs as (select x.form as a, y.form as b from n x join n y on x.tail = y.tail and x.form < y.form) "


@query("p4_shares_root", PAIRS + f""", k as (select a, b, {sql_consonants('a')} as x, {sql_consonants('b')} as y from pairs)
select a, b, (x = '' or y = '' or starts_with(x, y) or starts_with(y, x) or (length(x) >= 2 and length(y) >= 2 and substr(x, 1, 2) = substr(y, 1, 2))) as related from k""")
def p4(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", K.shares_consonant_root(K.consonant_key(F.col("a")), K.consonant_key(F.col("b"))).alias("related"))


#: Spellings of a name: in capitals, with flavoured letters, with accents, and another name.
SPELT = "case id % 4 when 0 then ' ' || upper(form) when 1 then translate(form, 'eo', 'ėȯ') when 2 then translate(form, 'oa', 'óá') else form || 's' end"


@query("p5_match_predicates", V.sql("parts") + f""", s as (select id, form as a, {SPELT} as b from parts)
select id, lower(trim(a)) = lower(trim(b)) as exact, {sql_standard("lower(trim(a))")} = {sql_standard("lower(trim(b))")} as normalized, {sql_skeleton("trim(a)")} = {sql_skeleton("trim(b)")} as skeleton from s""")
def p5(spark, sf):
    a, four = F.col("form"), F.col("id") % 4
    b = F.when(four == 0, F.concat(F.lit(" "), F.upper("form"))).when(four == 1, F.translate("form", "eo", "ėȯ")).when(four == 2, F.translate("form", "oa", "óá")).otherwise(F.concat("form", F.lit("s")))
    return V.parts(spark, sf).select("id", K.exact_match(a, b).alias("exact"), K.normalized_match(a, b).alias("normalized"), K.skeleton_match(a, b).alias("skeleton"))


@query("p6_edit_distance", PAIRS + "select a, b, levenshtein(a, b)::int as distance, round(levenshtein(a, b) / greatest(length(a), length(b), 1), 6) as normalized from pairs")
def p6(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", F.levenshtein("a", "b").alias("distance"), F.round(K.normalized_edit_distance(F.col("a"), F.col("b")), 6).alias("normalized"))


# Spelling tables that stand for per-language transliteration packs.
SPELL = {"de": [("sch", "š"), ("ß", "ss"), ("ä", "e"), ("w", "v")], "fr": [("eau", "o"), ("ou", "u"), ("ç", "s"), ("é", "e")], "es": [("ll", "j"), ("ñ", "nj"), ("que", "ke")]}


def _sql_spell() -> str:
    out = "case"
    for code, pairs in SPELL.items():
        x = "token"
        for a, b in pairs:
            x = f"replace({x}, '{a}', '{b}')"
        out += f" when lang = '{code}' then {x}"
    return out + " else token end"


@query("p7_transliterate", LEX + f"select lang, token, {_sql_spell()} as common from lex")
def p7(spark, sf):
    return V.lexicon(spark, sf).select("lang", "token", cascade.transliterate(F.col("token"), F.col("lang"), SPELL).alias("common"))


CELL = "'!' || form || ' (' || lang || ') / ' || pos || '.; 42, \"' || lang || '.\" {x (y) z}'"
PIECES = rf"list_filter(regexp_split_to_array(regexp_replace(regexp_replace({CELL}, '\([^()]*\)', '', 'g'), '[{{][^{{}}]*[}}]', '', 'g'), '[,;/]'), lambda x: regexp_matches(x, '\pL'))"


@query("p8_split_cell", V.sql("parts") + rf"""select id, k::int as k, regexp_replace(regexp_replace(piece, '^[\s!]+', ''), '^[."''’ ]+|[."''’\s]+$', '', 'g') as variant, starts_with(trim(piece), '!') as flagged
from (select id, unnest({PIECES}) as piece, generate_subscripts({PIECES}, 1) - 1 as k from parts)""")
def p8(spark, sf):
    cell = F.concat(F.lit("!"), "form", F.lit(" ("), "lang", F.lit(") / "), "pos", F.lit('.; 42, "'), "lang", F.lit('." {x (y) z}'))
    return V.parts(spark, sf).select("id", F.posexplode(K.split_cell(cell)).alias("k", "v")).select("id", "k", "v.variant", "v.flagged")


@query("p9_citation_forms", r"""with g as (select doc_id, array_to_string(list_transform(regexp_extract_all(text, '[^()\[\]{}]*[()\[\]{}]?'), lambda s: case when regexp_matches(s, '[)\]}]$') then replace(s, ',', chr(1)) else s end), '') as t from documents),
p as (select doc_id, unnest(list_filter(list_transform(string_split(t, ','), lambda p: trim(p)), lambda p: p <> '' and not regexp_matches(p, '[#!]'))) as p from g),
c as (select doc_id, trim(split_part(replace(regexp_replace(p, '\([^()]*\)', '', 'g'), chr(1), ','), ',', 1)) as form from p) select distinct doc_id, form from c where form <> '' and not regexp_matches(form, '[#!*()]')""")
def p9(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.explode(K.citation_forms(F.col("text"))).alias("form"))


# Tags and what they mean, written out by hand: (tag, class, gender, animate, plural only, singular only, indeclinable, aspect, valency).
MEANT = [
    ("m.", "noun", "masculine", 0, 0, 0, 0, None, None), ("m.anim.", "noun", "masculine", 1, 0, 0, 0, None, None), ("f.pl.", "noun", "feminine", 0, 1, 0, 0, None, None),
    ("n.sg.", "noun", "neuter", 0, 0, 1, 0, None, None), ("f.indecl.", "noun", "feminine", 0, 0, 0, 1, None, None), ("m./f.", "noun", "masculine", 0, 0, 0, 0, None, None),
    ("v.tr. ipf.", "verb", None, 0, 0, 0, 0, "ipf", "tr"), ("v.intr. pf.", "verb", None, 0, 0, 0, 0, "pf", "intr"), ("v.refl. ipf./pf.", "verb", None, 0, 0, 0, 0, "ipf/pf", "refl"),
    ("verb", "verb", None, 0, 0, 0, 0, None, None), ("adj.", "adjective", None, 0, 0, 0, 0, None, None), ("adv.", "adverb", None, 0, 0, 0, 0, None, None), ("num.", "numeral", None, 0, 0, 0, 0, None, None),
    ("pron.poss.", "pronoun", None, 0, 0, 0, 0, None, None), ("prep.", "preposition", None, 0, 0, 0, 0, None, None), ("postp", "preposition", None, 0, 0, 0, 0, None, None),
    ("conj.", "conjunction", None, 0, 0, 0, 0, None, None), ("intj.", "interjection", None, 0, 0, 0, 0, None, None), ("particle", "particle", None, 0, 0, 0, 0, None, None),
    (" Proper Noun ", "proper noun", None, 0, 0, 0, 0, None, None), ("name", "proper noun", None, 0, 0, 0, 0, None, None), ("prefix", "prefix", None, 0, 0, 0, 0, None, None),
    ("suffix", "suffix", None, 0, 0, 0, 0, None, None), ("idiom", "phrase", None, 0, 0, 0, 0, None, None), ("", "other", None, 0, 0, 0, 0, None, None), ("xyz", "other", None, 0, 0, 0, 0, None, None),
]
SQL_MEANT = ", ".join(f"({i}, " + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else str(bool(x)).lower() for x in m) + ")" for i, m in enumerate(MEANT))


@query("p10_tag_parsing", V.sql("parts") + f", e(i, tag, label, gender, animate, plural_only, singular_only, indeclinable, aspect, valency) as (values {SQL_MEANT}) select id, tag, label, gender, animate, plural_only, singular_only, indeclinable, aspect, valency from parts join e on size % {len(MEANT)} = i")
def p10(spark, sf):
    p = V.parts(spark, sf).select("id", F.element_at(F.array(*[F.lit(m[0]) for m in MEANT]), F.col("size") % len(MEANT) + 1).alias("tag"))
    return p.select("id", "tag", tags.part_of_speech(F.col("tag")).alias("label"), tags.noun_traits(F.col("tag")).alias("n"), tags.verb_traits(F.col("tag")).alias("v")).select("id", "tag", "label", "n.*", "v.*")


@query("p11_fnv_holdout", V.sql("scored") + f"select id, {sql_fnv('id::varchar')} as hash, ({sql_fnv('id::varchar')} % 64)::int as shard, {sql_holdout('id::varchar')} as holdout from scored")
def p11(spark, sf):
    t = F.col("id").cast("string")
    return V.scored(spark, sf).select("id", K.fnv1a32(t).alias("hash"), K.shard_of(t, 64).alias("shard"), K.is_holdout(t).alias("holdout"))


SQL_STOP = "(" + ", ".join(f"'{s}'" for s in STOP) + ")"


@query("p12_content_tokens", r"with t as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*'))) as token from documents) select doc_id, token, "
       + "case when token like '%ing' and length(token) > 5 then left(token, length(token) - 3) when token like '%ed' and length(token) > 4 then left(token, length(token) - 2) when token like '%s' and token not like '%ss' and length(token) > 3 then left(token, length(token) - 1) else token end as stem"
       + f" from t where octet_length(encode(token)) >= 3 and token not in {SQL_STOP}")
def p12(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.explode(K.content_tokens(F.col("text"), STOP)).alias("token"))
    return docs.select("doc_id", "token", K.light_stem(F.col("token")).alias("stem"))


GROUPS = {"west": ["EUROPE", "AMERICA"], "east": ["ASIA", "MIDDLE EAST"], "all": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]}


@query("p13_group_expansion", V.sql("att") + """, c as (select item, case when item % 3 = 0 then 'west' when item % 3 = 1 then 'east AFRICA~' else '#all zz' end as codes from att group by 1),
m as (select distinct item, unnest(case when item % 3 = 0 then ['EUROPE', 'AMERICA'] when item % 3 = 1 then ['ASIA', 'MIDDLE EAST', 'AFRICA'] else ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'] end) as member from c)
select item, string_agg(member, ',' order by member) as members from m group by item""")
def p13(spark, sf):
    a = V.attestations(spark, sf).select("item").distinct()
    codes = F.when(F.col("item") % 3 == 0, "west").when(F.col("item") % 3 == 1, "east AFRICA~").otherwise("#all zz")
    return a.select("item", F.array_join(K.expand_groups(codes, GROUPS, GROUPS["all"]), ",").alias("members"))


@query("p15_hygiene", r"select page_id, left(translate(url || ' “é”–%zz+%4', '’‘“”–—', '''''' || chr(34) || chr(34) || '--'), 60) as clean, (contains(html, '<script') or contains(html, 'track(')) as leaked, left(translate(url || '%ff%C3%A9b', '’‘“”–—', '''''' || chr(34) || chr(34) || '--'), 60) as broken, left(translate(url, '’‘“”–—', '''''' || chr(34) || chr(34) || '--') || 'éb', 60) as sound from pages")
def p15(spark, sf):
    """Urls and what follows them percent-encoded here, with two invalid escapes and a plus sign behind, decoded again;
    with bytes behind them that form no character, and with such that do."""
    raw = F.concat(F.replace(F.url_encode(F.concat("url", F.lit(" “é”–"))), F.lit("+"), F.lit("%20")), F.lit("%zz+%4"))
    return V.table(spark, sf, "pages").select("page_id", K.hygiene(raw, 60).alias("clean"), F.col("html").rlike(r"<script|track\(").alias("leaked"),
                                                     K.hygiene(F.concat("url", F.lit("%ff%C3%A9b")), 60).alias("broken"), K.hygiene(F.concat("url", F.lit("%C3%A9b")), 60).alias("sound"))


RULES = [cascade.Rule("final-ing", "ing$", "in", guard="^.{5,}$", stage=2, unless="th-to-t"), cascade.Rule("drop-final-e", "e$", ""), cascade.Rule("th-to-t", "th", "t"), cascade.Rule("double-vowel", "oo|ee", "o", stage=1)]
SQL_CASCADE = LEX + """, s1 as (select *, regexp_replace(token, 'e$', '') as a from lex), s2 as (select *, regexp_replace(a, 'th', 't', 'g') as b from s1),
s3 as (select *, regexp_replace(b, 'oo|ee', 'o', 'g') as c from s2), s4 as (select *, case when length(c) >= 5 and a = b then regexp_replace(c, 'ing$', 'in') else c end as d from s3)"""


@query("p16_rewrite_cascade", SQL_CASCADE + " select lang, token, d as rewritten, ((token <> a)::int + (a <> b)::int + (b <> c)::int + (c <> d)::int) as steps from s4")
def p16(spark, sf):
    return cascade.apply_cascade(V.lexicon(spark, sf), "token", RULES).select("lang", "token", "rewritten", F.size("trace").alias("steps"))


@query("a22_rule_fired_index", SQL_CASCADE + """, f as (select lang, token, unnest([case when token <> a then 'drop-final-e' end, case when a <> b then 'th-to-t' end, case when b <> c then 'double-vowel' end, case when c <> d then 'final-ing' end]) as rule from s4)
select rule, count(*) as firings, min(lang || ':' || token) as first_example from f where rule is not null group by rule""")
def a22(spark, sf):
    # an outer explode: of a plain one a filter on the trace goes down below the counts, where each word of a document is rewritten
    fired = cascade.apply_cascade(V.lexicon(spark, sf), "token", RULES).select("lang", "token", F.explode_outer("trace").alias("s")).where("s is not null")
    return fired.groupBy(F.col("s.id").alias("rule")).agg(F.count(F.lit(1)).alias("firings"), F.min(F.concat("lang", F.lit(":"), "token")).alias("first_example"))


@query("p17_alphabet_residue", LEX + ", c as (select lang, df, unnest(string_split(regexp_replace(token, '[a-z-]', '', 'g'), '')) as ch from lex where regexp_matches(token, '[^a-z-]')) select lang, ch, count(*) as words, sum(df)::bigint as uses from c where ch <> '' group by 1, 2")
def p17(spark, sf):
    chars = V.lexicon(spark, sf).select("lang", "df", F.explode(F.split(K.residue(F.col("token"), "a-z-"), "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("lang", "ch").agg(F.count(F.lit(1)).alias("words"), F.sum("df").alias("uses"))


@query("p18_benchmarkable", V.sql("parts") + "select id, form from parts where not regexp_matches(lang, '[!\"(]|1[0-9]') and pos in ('SMALL', 'LARGE', 'PROMO')")
def p18(spark, sf):
    return V.parts(spark, sf).where(~F.col("lang").rlike(r'[!"(]|1[0-9]') & F.col("pos").isin("SMALL", "LARGE", "PROMO")).select("id", "form")


@query("p19_group_strip", V.sql("parts") + """, g as (select *, (form like '% ring')::int as m from parts), w as (select *, sum(m) over (partition by lang, size) as marked, count(*) over (partition by lang, size) as n from g)
select id, case when marked >= 2 and marked * 2 >= n and m = 1 then left(form, length(form) - 5) else form end as form, (marked >= 2 and marked * 2 >= n) as stripped from w""")
def p19(spark, sf):
    from quorumlake.operators.consensus import strip_shared_suffix

    return strip_shared_suffix(V.parts(spark, sf), ["lang", "size"], "form", " ring").select("id", "form", "stripped")


@query("p20_source_exclusion", V.sql("att") + "select item, source from att where not (source in ('FRANCE', 'CHINA') and item % 2 = 0)")
def p20(spark, sf):
    return V.attestations(spark, sf).where(~(F.col("source").isin("FRANCE", "CHINA") & (F.col("item") % 2 == 0))).select("item", "source")


@query("p21_international", LEX + "select lang, token from lex where regexp_matches(token, '(tion|ment|able|ción|keit|lich)$')")
def p21(spark, sf):
    return V.lexicon(spark, sf).where(F.col("token").rlike("(tion|ment|able|ción|keit|lich)$")).select("lang", "token")


@query("p22_confidence_buckets", V.sql("scored") + "select id, case when score >= 0.72 then 'High' when score >= 0.45 then 'Medium' else 'Low' end as by_score, case when score_b >= 0.6 then 'High' when score_b >= 0.3 then 'Medium' else 'Low' end as by_probability from scored")
def p22(spark, sf):
    return V.scored(spark, sf).select("id", K.confidence_by_score(F.col("score")).alias("by_score"), K.confidence_by_probability(F.col("score_b")).alias("by_probability"))


BRANCHES = [("EUROPE", "E"), ("ASIA", "A"), ("AMERICA", "M"), ("AFRICA", "F"), ("MIDDLE EAST", "I")]


@query("p23_branch_pattern", V.sql("att") + "select item, concat_ws('+', " + ", ".join(f"max(case when branch = '{b}' then '{x}' end)" for b, x in BRANCHES) + ") as pattern from att group by item")
def p23(spark, sf):
    return V.attestations(spark, sf).groupBy("item").agg(F.collect_set("branch").alias("b")).select("item", K.pattern_of(F.col("b"), BRANCHES).alias("pattern"))


@query("p24_labels", V.sql("parts") + "select id, upper(left(form, 1)) as first_bucket, right(form, 2) as suffix, case when freq >= 1500 then 'strong' when freq >= 1000 then 'fair' else 'weak' end as quality, (size < 5 and pos = 'PROMO') as needs_review from parts")
def p24(spark, sf):
    quality = F.when(F.col("freq") >= 1500, "strong").when(F.col("freq") >= 1000, "fair").otherwise("weak")
    return V.parts(spark, sf).select("id", F.upper(F.left("form", F.lit(1))).alias("first_bucket"), F.right("form", F.lit(2)).alias("suffix"), quality.alias("quality"),
                                    ((F.col("size") < 5) & (F.col("pos") == "PROMO")).alias("needs_review"))


SUFFIXES = ["tion", "ment", "ing", "ed", "er", "es"]
SQL_STEM = "case " + " ".join(f"when token like '%{x}' and length(token) - {len(x)} >= 4 then left(token, length(token) - {len(x)})" for x in sorted(SUFFIXES, key=lambda x: (-len(x), x))) + " when length(token) >= 4 then token end"


@query("p25_family_stem", LEX + f"select lang, token, {SQL_STEM} as stem from lex")
def p25(spark, sf):
    return V.lexicon(spark, sf).select("lang", "token", K.longest_suffix_strip(F.col("token"), SUFFIXES).alias("stem"))


@query("a28_families", LEX + f", s as (select lang, token, {SQL_STEM} as stem from lex) select lang, stem, count(*) as members, min(token) as head from s where stem is not null group by 1, 2")
def a28(spark, sf):
    rows = V.lexicon(spark, sf).select("lang", "token", K.longest_suffix_strip(F.col("token"), SUFFIXES).alias("stem")).where("stem is not null")
    return rows.groupBy("lang", "stem").agg(F.count(F.lit(1)).alias("members"), F.min("token").alias("head"))


VARIANTS = [("ies", "y"), ("es", ""), ("s", ""), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e")]


@query("p26_suffix_variants", LEX + ", v as (" + " union ".join(f"select token, left(token, length(token) - {len(a)}) || '{b}' as variant from lex where lang = 'en' and token like '%{a}' and length(token) - {len(a)} + {len(b)} >= 3" for a, b in VARIANTS) + ") select token, variant from v")
def p26(spark, sf):
    return V.lexicon(spark, sf).where("lang = 'en'").select("token", F.explode(K.suffix_variants(F.col("token"), VARIANTS)).alias("variant"))


@query("p27_tokenize_breaks", r"""with t as (select conv_id, turn, lower(text) as x from conversations), e as (select conv_id, turn, regexp_extract_all(x, '([^\pL]*)(\p{L}+(?:-\p{L}+)*)', 2) as w, regexp_extract_all(x, '([^\pL]*)(\p{L}+(?:-\p{L}+)*)', 1) as g from t)
select conv_id, turn, k::int as pos, w[k + 1] as token, (k = 0 or regexp_matches(g[k + 1], '\S')) as brk from (select *, unnest(range(len(w))) as k from e)""")
def p27(spark, sf):
    rows = V.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(K.tokens_with_breaks(F.col("text"))).alias("pos", "t"))
    return rows.select("conv_id", "turn", "pos", "t.token", "t.brk")


@query("p28_feature_parse", "select id, unnest(['gen', 'dat']) as kind, unnest([size % 2, size % 3])::int as number, left(pos, 1) as gender from (select p_partkey as id, p_size as size, p_type as pos from part)")
def p28(spark, sf):
    """Readings such as ``gen.1.S / dat.0.S`` parsed to structs."""
    from quorumlake.operators.textcheck import parse_features

    cell = F.concat(F.lit("gen."), F.col("size") % 2, F.lit("."), F.left("pos", F.lit(1)), F.lit(" / dat."), F.col("size") % 3, F.lit("."), F.left("pos", F.lit(1)))
    return V.parts(spark, sf).select("id", F.explode(parse_features(cell)).alias("f")).select("id", "f.kind", "f.number", "f.gender")


@query("p29_slug_numbers", V.sql("parts") + "select id, replace(form, ' ', '-') || case when k = 1 then '' else '-' || k end as slug from (select id, form, row_number() over (partition by form order by id) as k from parts)")
def p29(spark, sf):
    from quorumlake.operators.publish import numbered_slugs

    return numbered_slugs(V.parts(spark, sf), "form", ["id"]).select("id", "slug")


@query("p31_search_keys", V.sql("parts") + """, k as (select id, unnest([form, replace(form, ' ', ''), split_part(form, ' ', 1), split_part(form, ' ', 2)]) as skey, unnest([1, 2, 3, 4]) as rank from parts)
select id, skey, min(rank)::int as rank from k where length(skey) >= 2 group by 1, 2""")
def p31(spark, sf):
    from quorumlake.operators.lookup import search_keys

    w = F.split("form", " ")
    return search_keys(V.parts(spark, sf), "id", [F.col("form"), F.replace("form", F.lit(" "), F.lit("")), w[0], w[1]])


@query("p32_reading_enrichment", V.sql("parts") + ", r as (select id, unnest(case when size % 2 = 0 then ['gen', 'dat'] else ['dat', 'nom'] end) as reading from parts), e as (select r.id, 'acc' as reading from r join parts p on r.id = p.id where r.reading = 'gen' and p.pos = 'PROMO'), u as (select * from r union select * from e) select id, string_agg(reading, ',' order by reading) as readings from u group by id")
def p32(spark, sf):
    """A gen reading adds the matching acc reading for eligible keys."""
    from quorumlake.operators.textcheck import enrich_readings

    p = V.parts(spark, sf)
    rows = p.select("id", F.when(F.col("size") % 2 == 0, F.array(F.lit("gen"), F.lit("dat"))).otherwise(F.array(F.lit("dat"), F.lit("nom"))).alias("readings"))
    return enrich_readings(rows, p.where("pos = 'PROMO'").select("id"), "id").select("id", F.array_join(F.array_sort("readings"), ",").alias("readings"))
