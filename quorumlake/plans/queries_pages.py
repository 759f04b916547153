"""Queries and jobs over pages of nested JSON, made of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.functions import distill as D
from quorumlake.functions import keys as K
from quorumlake.operators import link as L
from quorumlake.operators import publish as B
from quorumlake.plans import views as V
from quorumlake.plans.base import query
from quorumlake.session import scratch, written
from quorumlake.sources import scans

LANGS = ["la", "grc", "it", "fr", "de", "en", "xx"]
#: What an etymon is picked from, and the whole page.
NAMED = "word string, lang string, templates array<struct<name:string,lang:string,term:string>>"
PAGE = f"{NAMED}, senses array<struct<glosses:array<string>,form_of:array<string>>>, categories array<string>, descendants {D.tree_type(3)}"


def write_pages(spark: SparkSession, sf: str) -> str:
    """Orders as a dump of pages, a line of JSON each: their lines are senses, templates,
    categories and descendants."""
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("i"))
    g = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("i")).alias("i"))  # an order has a few lines
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    name = F.create_map(*map(F.lit, ["A", "inh", "R", "bor", "N", "cog"]))
    langs = F.array(*map(F.lit, LANGS))
    node = lambda x, *more: F.struct(F.element_at(langs, x["l_linenumber"] % 7 + 1).alias("lang"), text("d", x["l_partkey"]).alias("word"), *more)
    page = g.select(F.to_json(F.struct(
        text("o", F.col("l_orderkey")).alias("word"), F.lit("zz").alias("lang"),
        F.transform("i", lambda x: F.struct(F.array(text("g", x["l_suppkey"] % 50)).alias("glosses"), F.when(x["l_linestatus"] == "F", F.array(F.lit("w"))).alias("form_of"))).alias("senses"),
        F.transform("i", lambda x: F.struct(name[x["l_returnflag"]].alias("name"), F.element_at(langs, x["l_linenumber"] % 7 + 1).alias("lang"), text("w", x["l_partkey"]).alias("term"))).alias("templates"),
        F.transform("i", lambda x: text("c", x["l_suppkey"] % 10)).alias("categories"),
        F.transform("i", lambda x: node(x, F.array(F.struct(F.lit("en").alias("lang"), text("e", x["l_suppkey"]).alias("word"), F.array().cast(D.tree_type(1)).alias("descendants"))).alias("descendants"))).alias("descendants"))))
    path = scratch(spark, "pages")
    page.write.text(path)
    return path


def borrowing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The pages that borrow a word, as far as ``schema`` reads them, and their etymon."""
    pages = scans.json_lines(spark, path, '"bor"', schema, F.exists("page.templates", lambda t: t["name"] == "bor"))
    return pages.select("page.*").withColumn("etymon", D.etymon(F.col("templates"), F.col("lang")))


def distilled(spark: SparkSession, path: str) -> DataFrame:
    """(word, etymon, glosses, categories, descendants) of the pages that borrow a word."""
    p = borrowing(spark, path, PAGE)
    return p.select("word", "etymon", D.real_glosses(F.col("senses"), 10).alias("glosses"), D.in_order(F.col("categories"), 3).alias("categories"),
                    D.descendants(F.col("descendants"), 3).alias("descendants"))


FLAT = """with l as (select l_orderkey as o, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) as n, l_returnflag as r, l_linestatus as s, 'w' || l_partkey as term, 'g' || l_suppkey % 50 as gloss, 'c' || l_suppkey % 10 as cat,
['la', 'grc', 'it', 'fr', 'de', 'en', 'xx'][(l_linenumber % 7 + 1)::int] as lang, [6, 5, 3, 3, 2, 2, 1][(l_linenumber % 7 + 1)::int] as rank from lineitem),
b as (select distinct o from l where r = 'R'), t as (select l.* from l join b using (o)),
e as (select o, arg_max(term, (rank, -n)) as term, arg_max(lang, (rank, -n)) as lang, max(rank) as rank from t where r in ('A', 'R') group by o),
g as (select o, string_agg(gloss, ',' order by n) as glosses from (select *, row_number() over (partition by o order by n) as k from (select o, gloss, min(n) as n from t where s <> 'F' group by 1, 2)) where k <= 10 group by o),
c as (select o, string_agg(cat, ',' order by n) as categories from (select *, row_number() over (partition by o order by n) as k from (select o, cat, min(n) as n from t group by 1, 2)) where k <= 3 group by o),
d as (select o, count(*) * 2 as descendants from t group by o) """


@query("p14_json_distillation", FLAT + "select 'o' || b.o as word, e.lang, e.term, e.rank::int as rank, coalesce(glosses, '') as glosses, categories, descendants from b join e using (o) left join g using (o) join c using (o) join d using (o)")
def p14(spark, sf):
    """Etymon by rank of its language, glosses of real senses, capped labels and
    flattened descendants of pages, read from lines of JSON that hold a marker."""
    d = distilled(spark, write_pages(spark, sf))
    return d.select("word", "etymon.lang", "etymon.term", "etymon.rank", F.array_join("glosses", ",").alias("glosses"), F.array_join("categories", ",").alias("categories"), F.size("descendants").cast("long").alias("descendants"))


NAMES = ["bor", "bor+", "lbor+", "derived", "inh", "inherited", "der", "cog", "ety"]
CODES = ["la", "ML.", "LL.", "el", "fro", "gmh", "nl", "frm", "pro", "old-a", "old-b", "xx"]
FAMILY = ["pro", "old-a", "old-b"]
RANKS = [6, 6, 6, 5, 3, 2, 2, 3, 1, 1, 1, 1]
PICKS = f"""with l as (select l_orderkey as o, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) as n, {NAMES}[l_partkey % 9 + 1] as name, {CODES}[l_suppkey % 12 + 1] as code, {RANKS}[l_suppkey % 12 + 1] as rank,
  case l_partkey % 6 when 0 then '*w' || l_partkey when 1 then '-w' when 2 then 'w' || l_partkey || '<id:1>' when 3 then '-' when 4 then '%C3%A9w' || l_partkey else '*' end as raw, l_partkey % 2 = 0 as even, l_suppkey % 8 as c, l_partkey as part from lineitem),
t as (select *, trim(regexp_replace(raw, '<.*$', '')) as term from l), d as (select *, regexp_replace(replace(term, '%C3%A9', 'é'), '^[*]', '') as bare from t),
src as (select o, arg_max(code || ' ' || term, (rank, -n)) as source, max(rank) as rank from t where name in ('bor', 'bor+', 'lbor+', 'derived', 'der') and code not in ('pro', 'old-a', 'old-b') and term not in ('', '-') group by 1),
anc as (select o, arg_min('*' || bare, n) as ancestor from d where name in ('inh', 'inherited', 'der', 'derived') and code = 'pro' and bare <> '' and not starts_with(bare, '-') and not ends_with(bare, '-') and regexp_matches(bare, '\\pL') group by 1),
par as (select o, arg_min(code || ':' || term, n) as parent from t where (name in ('inh', 'inherited') or (name = 'ety' and even)) and code in ('old-a', 'old-b') and term not in ('', '-') group by 1),
cls as (select o, arg_min('group ' || c || ' N-stem nouns', n) filter (c in (2, 5)) as stem from l group by 1),
need as (select o, arg_min('*' || part, n) as deep from l group by 1)
"""


@query("p14_ancestry_picks", PICKS + "select 'o' || cls.o as word, source, rank::int as rank, ancestor, parent, stem, case when cls.o % 3 = 0 then '' else deep end as deep from cls join need using (o) left join src using (o) left join anc using (o) left join par using (o)")
def p14_picks(spark: SparkSession, sf: str) -> DataFrame:
    """Foreign source, ancestor, old-stage parent, declension and deep ancestor of pages
    whose templates carry every language of the rank table and all guarded shapes."""
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    g = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("i"))  # an order has a few lines
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    text = lambda *c: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in c])

    def template(x):
        six = x["l_partkey"] % 6
        term = F.when(six == 0, text("*w", x["l_partkey"])).when(six == 1, "-w").when(six == 2, text("w", x["l_partkey"], "<id:1>")).when(six == 3, "-").when(six == 4, text("%C3%A9w", x["l_partkey"])).otherwise("*")
        name, code = pick(NAMES, x["l_partkey"] % 9), pick(CODES, x["l_suppkey"] % 12)
        tree = name == "ety"
        return F.struct(name.alias("name"), F.create_map(F.lit("1"), F.lit("zz"), F.lit("2"), F.when(tree, F.when(x["l_partkey"] % 2 == 0, ":inh").otherwise(":bor")).otherwise(code), F.lit("3"), F.when(tree, text(code, ":", term)).otherwise(term)).alias("args"))

    label = lambda x: text("group ", x["l_suppkey"] % 8, F.when((x["l_suppkey"] % 8).isin(2, 5), F.lit(" N-stem nouns")).otherwise(F.lit(" nouns")))
    named = F.when(F.col("l_orderkey") % 3 == 0, F.lit("from nothing *x")).otherwise(text("From Proto-Old ", "and so on *", F.col("i")[0]["l_partkey"], ", and *more"))
    pages = g.select(text("o", F.col("l_orderkey")).alias("word"), F.transform("i", template).alias("templates"), F.transform("i", label).alias("categories"), named.alias("text"))
    source = D.source_pick(F.col("templates"), FAMILY)
    p = pages.select("word", source.alias("s"), D.ancestor_pick(F.col("templates"), "pro").alias("ancestor"), D.stage_parent(F.col("templates"), FAMILY[1:]).alias("p"), D.stem_class(F.col("categories")).alias("stem"), D.after_needle(F.col("text"), "Proto-Old").alias("deep"))
    return p.select("word", F.concat_ws(" ", "s.lang", "s.term").alias("source"), "s.rank", "ancestor", F.concat_ws(":", "p.lang", "p.term").alias("parent"), "stem", "deep").withColumns({"source": F.when(F.col("rank").isNotNull(), F.col("source")), "parent": F.when(F.col("parent") != "", F.col("parent"))})


@query("job_extraction_chain", FLAT + """, k as (select o, term, rank, case when rank >= 5 then 'direct' when o % 3 = 0 then 'pending' else 'dropped' end as gate from e),
p as (select k.o, case when gate = 'direct' then 'direct' when gate = 'pending' and exists (select 1 from k p where p.o = k.o // 2 and p.gate = 'direct') then 'inherited' when gate = 'pending' then 'unresolved' else 'dropped' end as via from k) select via, count(*) as pages, min('o' || o) as first from p group by 1""")
def job_extraction_chain(spark, sf):
    """Marker scan, distillation, evidence gate, pointer chase of pending pages to a
    page with evidence, union of both, census."""
    d = borrowing(spark, write_pages(spark, sf), NAMED).select(F.substr("word", F.lit(2)).cast("long").alias("id"), "etymon.rank")
    # written: the chase reads the gates several times, and the dump is parsed once
    g = written(scans.gated(d, [(F.col("rank") >= 5, "direct"), (F.col("id") % 3 == 0, "pending")], "dropped").select("id", "gate"), "gates")
    chased = L.chase_parents(g.select("id", F.floor(F.col("id") / 2).alias("parent"), "gate"), "id", "parent", F.col("gate") == "direct", hops=1)
    via = F.when(F.col("gate") == "direct", "direct").when((F.col("gate") == "pending") & F.col("end").isNotNull(), "inherited").when(F.col("gate") == "pending", "unresolved").otherwise("dropped")
    out = g.join(chased, "id").select("id", via.alias("via"))
    return out.groupBy("via").agg(F.count(F.lit(1)).alias("pages"), F.min(F.concat(F.lit("o"), F.col("id").cast("string"))).alias("first"))


GLOSS = "form || ' (' || lower(lang) || ', old), to ' || lower(pos) || ' or the ' || form || ' of x; ' || split_part(form, ' ', 2) || 's / a'"


def _gloss():
    return F.concat("form", F.lit(" ("), F.lower("lang"), F.lit(", old), to "), F.lower("pos"), F.lit(" or the "), "form", F.lit(" of x; "), F.split("form", " ")[1], F.lit("s / a"))


STOP = ["the", "and", "of", "to", "in", "for", "with", "that", "or", "a"]
SQL_STOP = ", ".join(repr(w) for w in STOP)
HEADS = "'To ' || form || '; ' || split_part(form, ' ', 2) || ' / The, piece of ' || lower(lang) || ' or ..' || upper(split_part(form, ' ', 1)) || '., x, ' || form || ' etc; to ' || form || ' (' || lower(pos) || ', other)'"


@query("p12_head_tokens", V.sql("parts") + f""", h as (select id, unnest(regexp_split_to_array(split_part({HEADS}, '(', 1), '[,;/]| or ')) as raw, generate_subscripts(regexp_split_to_array(split_part({HEADS}, '(', 1), '[,;/]| or '), 1) as n from parts),
t as (select id, n, trim(regexp_replace(lower(regexp_replace(trim(raw), '^[.]+|[.]+$', '', 'g')), '^ *to ', '')) as token from h), k as (select id, token, min(n) as n from t where length(token) between 2 and 32 and not ends_with(token, ' etc') and not contains(token, ' of ') and token not in ({SQL_STOP}) group by 1, 2)
select id, token, (row_number() over (partition by id order by n))::int as place from k""")
def p12_heads(spark, sf):
    """Synonyms that stand before the first bracket of a gloss, split at marks and "or"."""
    one, two = F.split("form", " ")[0], F.split("form", " ")[1]
    gloss = F.concat(F.lit("To "), "form", F.lit("; "), two, F.lit(" / The, piece of "), F.lower("lang"), F.lit(" or .."), F.upper(one), F.lit("., x, "), "form", F.lit(" etc; to "), "form", F.lit(" ("), F.lower("pos"), F.lit(", other)"))
    return V.parts(spark, sf).select("id", F.posexplode(K.head_tokens(gloss, STOP)).alias("place", "token")).select("id", "token", (F.col("place") + 1).alias("place"))


BARE = rf"lower(regexp_replace({GLOSS}, '\([^()]*\)', ' ', 'g'))"


@query("p12_stemmed_set", V.sql("parts") + f", w as (select id, unnest(regexp_split_to_array({BARE}, '[^\\pL]+')) as w from parts), s as (select id, case when w like '%ing' and length(w) > 5 then left(w, length(w) - 3) when w like '%ed' and length(w) > 4 then left(w, length(w) - 2) when w like '%s' and w not like '%ss' and length(w) > 3 then left(w, length(w) - 1) else w end as token from w where w <> '' and w not in ({', '.join(repr(s) for s in STOP)})) select distinct id, token from s where length(token) >= 2")
def p12_stemmed(spark, sf):
    """Words outside brackets, without stop words, stemmed, as a set."""
    return V.parts(spark, sf).select("id", F.explode(K.stemmed_set(_gloss(), STOP)).alias("token"))


# Endings that a retry takes off, with what it puts in their place, longest first.
DESUFFIX = [("ibility", "ible"), ("ability", "able"), ("iness", "y"), ("ness", ""), ("ation", ""), ("ation", "ate"), ("ition", ""), ("ition", "e"), ("ition", "ite"), ("ity", ""), ("ity", "e"),
            ("ing", ""), ("ing", "e"), ("ies", "y"), ("es", ""), ("s", "")]


@query("p26_desuffix_retry", V.sql("tok", "lex") + ", w as (select token from lex where lang = 'en'), v as (" + " union ".join(f"select token, left(token, length(token) - {len(a)}) || '{b}' as variant from w where token like '%{a}'" for a, b in DESUFFIX)
       + r" union select token, left(token, length(token) - 4) from w where regexp_matches(token, '[a-z]ing$') and length(token) >= 5 and substr(token, length(token) - 3, 1) = substr(token, length(token) - 4, 1)) select token, min(variant) as found from v where length(variant) >= 3 and variant <> token and variant in (select token from w) group by 1")
def p26_retry(spark, sf):
    """Words whose de-suffixed form, or one with a doubled consonant undone, is a word."""
    w = V.lexicon(spark, sf).where("lang = 'en'").select("token")
    doubled = F.when(F.col("token").rlike("[a-z]ing$") & (F.length("token") >= 5) & (F.substr("token", F.length("token") - 3, F.lit(1)) == F.substr("token", F.length("token") - 4, F.lit(1))), F.substr("token", F.lit(1), F.length("token") - 4))
    made = F.concat(K.suffix_variants(F.col("token"), DESUFFIX), F.array(doubled))
    each = w.select("token", F.explode(made).alias("variant")).where((F.length("variant") >= 3) & (F.col("variant") != F.col("token")))
    return each.join(w.select(F.col("token").alias("variant")), "variant", "left_semi").groupBy("token").agg(F.min("variant").alias("found"))


CAPS = {"synonyms": 4, "topics": 3, "tags": 2}
MERGE = "with r as (select o_custkey as k, o_orderkey as n, o_orderpriority as synonyms, o_orderstatus as topics, year(o_orderdate)::varchar as tags from orders), "


@query("a8_record_merge", MERGE + ", ".join(f"{c} as (select k, string_agg(v, ',' order by n) as {c} from (select *, row_number() over (partition by k order by n) as i from (select k, {c} as v, min(n) as n from r group by 1, 2)) where i <= {m} group by k)" for c, m in CAPS.items())
       + " select k as o_custkey, synonyms, topics, tags from synonyms join topics using (k) join tags using (k)")
def a8_records(spark, sf):
    """Records of one key merged in order, each array without repeats and with its own cap."""
    from quorumlake.operators.consensus import merge_arrays

    rows = V.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.array("o_orderpriority").alias("synonyms"), F.array("o_orderstatus").alias("topics"), F.array(F.year("o_orderdate").cast("string")).alias("tags"))
    return merge_arrays(rows, "o_custkey", "o_orderkey", CAPS).select("o_custkey", *[F.array_join(c, ",").alias(c) for c in CAPS])


@query("a9_form_records", V.sql("parts") + ", c as (select id, form, pos, size, lang, trim(unnest(string_split(replace(form, ' ', ' / ') || ' / —', '/'))) as variant from parts), k as (select replace(lower(variant), '-', '') as key, lang as lemma, * from c where variant not in ('', '—')), u as (select key, lemma, pos, min(id) as first from k group by 1, 2, 3), a as (select key, lemma, string_agg(pos, ',' order by first) as analyses from u group by 1, 2), s as (select key, lemma, bool_or(size > 45) as is_lemma, count(*) as cells, arg_min(variant, id) as form from k group by 1, 2) select key, lemma, form, analyses, case when is_lemma then 'lemma' else 'inflection' end as source, cells from a join s using (key, lemma)")
def a9_forms(spark, sf):
    """Cells split into variants; records of one key and lemma have their analyses in
    order, and count as the lemma if any of them is it."""
    p = V.parts(spark, sf).select("id", F.concat(F.replace("form", F.lit(" "), F.lit(" / ")), F.lit(" / —")).alias("cell"), F.col("pos").alias("feats"), F.col("lang").alias("lemma"), F.when(F.col("size") > 45, "lemma").otherwise("inflection").alias("source"))
    return B.form_records(p, "cell", "feats", "lemma", "source", "id")
