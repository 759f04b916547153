"""What is kept of a page's nested JSON: etymons, glosses, labels and descendants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank of the languages that an etymon may come from; any other has 1.
ETYMON_RANK = {"la": 6, "ML.": 6, "LL.": 6, "la-med": 6, "la-lat": 6, "grc": 5, "el": 5, "it": 3, "fr": 3, "frm": 3, "fro": 3, "de": 2, "gmh": 2, "nl": 2, "en": 2}
#: Template names that name an etymon.
BORROWED = ["bor", "der", "inh", "lbor"]
# Names of templates that name a foreign source, an inherited form, and an ancestor.
SOURCE_NAMES = ["bor", "bor+", "borrowed", "lbor", "lbor+", "der", "der+", "derived"]
INHERITED_NAMES = ["inh", "inh+", "inherited"]
ANCESTOR_NAMES = ["inh", "inh+", "inherited", "der", "der+", "derived"]
# Operations of an etymology tree that name a foreign source.
TREE_SOURCES = [":bor", ":lbor", ":ubor", ":obor", ":slbor", ":der"]


def _argument(t: Column, key: str) -> Column:
    return F.trim(F.coalesce(t["args"][key], F.lit("")))


def _uncut(word: Column) -> Column:
    """A form without what is behind ``<``."""
    return F.trim(F.regexp_replace(word, r"(?s)<.*$", ""))


def source_pick(templates: Column, family: list[str]) -> Column:
    """struct<rank, lang, term> of the foreign source that templates (name, args) name: the
    best rank, the first of equals; languages of the family, blanks and ``-`` are none."""
    table = F.create_map(*[x for k, v in ETYMON_RANK.items() for x in (F.lit(k), F.lit(v))])
    fits = F.filter(templates, lambda t: t["name"].isin(SOURCE_NAMES) & (_argument(t, "2") != "") & ~_argument(t, "2").isin(family) & ~_uncut(_argument(t, "3")).isin("", "-"))
    ranked = F.transform(fits, lambda t, i: F.struct(F.coalesce(F.try_element_at(table, _argument(t, "2")), F.lit(1)).alias("rank"), (-i).alias("place"), _argument(t, "2").alias("lang"), _uncut(_argument(t, "3")).alias("term")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct(best["rank"].alias("rank"), best["lang"].alias("lang"), best["term"].alias("term")))


def real_form(form: Column) -> Column:
    """``*form`` of a reconstruction; null for placeholders and bound parts (a hyphen at
    either end), and where there is no letter."""
    bare = F.regexp_replace(form, r"^\*", "")
    return F.when((bare != "") & ~bare.startswith("-") & ~bare.endswith("-") & bare.rlike(r"\p{L}"), F.concat(F.lit("*"), bare))


def ancestor_pick(templates: Column, code: str) -> Column:
    """The first real form of the ancestor language that a template inherits or derives from."""
    from quorumlake.functions.keys import percent_decoded

    fits = F.filter(templates, lambda t: t["name"].isin(ANCESTOR_NAMES) & (_argument(t, "2") == code))
    return F.get(F.filter(F.transform(fits, lambda t: real_form(percent_decoded(_uncut(_argument(t, "3"))))), lambda x: x.isNotNull()), F.lit(0))


def stage_parent(templates: Column, codes: list[str]) -> Column:
    """struct<lang, term>: the first form of an old stage (one of ``codes``) that is
    inherited, by a template or a tree's ``:inh``; null if none."""
    def pick(t: Column) -> Column:
        lang, term = _argument(t, "2"), _uncut(_argument(t, "3"))
        tree = triple(t)
        plain = F.when(t["name"].isin(INHERITED_NAMES) & lang.isin(codes) & ~term.isin("", "-"), F.struct(lang.alias("lang"), term.alias("term")))
        return F.coalesce(plain, F.when((tree["op"] == ":inh") & tree["lang"].isin(codes), F.struct(tree["lang"].alias("lang"), tree["term"].alias("term"))))

    return F.get(F.filter(F.transform(templates, pick), lambda x: x.isNotNull()), F.lit(0))


def after_needle(text: Column, needle: str) -> Column:
    """The first ``*form`` behind a name in running text, up to a blank or one of , ; ] ); '' if there is none."""
    rest = F.substr(text, F.instr(text, F.lit(needle)) + len(needle))
    return F.when(F.contains(text, F.lit(needle)), F.regexp_extract(rest, r"\*[^\s,;\])]*", 0)).otherwise("")


# What names a declension in a category.
STEMS = ["o-stem", "a-stem", "ā-stem", "i-stem", "u-stem", "v-stem", "n-stem", "s-stem", "r-stem", "jo-stem", "ja-stem", "consonant stem"]


def stem_class(categories: Column) -> Column:
    """The first category that names a declension; null if none does."""
    names = lambda c: F.lower(c).rlike("|".join(STEMS))
    return F.get(F.filter(categories, names), F.lit(0))


def etymon(templates: Column, own: Column | None = None) -> Column:
    """struct<rank, lang, term> of the best template (name, lang, term): by rank of
    its language, the first of equals; not of the page's own language; null if none."""
    table = F.create_map(*[x for k, v in ETYMON_RANK.items() for x in (F.lit(k), F.lit(v))])
    fits = F.filter(templates, lambda t: t["name"].isin(BORROWED) & (F.coalesce(t["term"], F.lit("")) != "") & (F.lit(True) if own is None else t["lang"] != own))
    # position counts down, so that the first of equal rank is the greatest
    ranked = F.transform(fits, lambda t, i: F.struct(F.coalesce(F.try_element_at(table, t["lang"]), F.lit(1)).alias("rank"), (-i).alias("place"), t["lang"].alias("lang"), t["term"].alias("term")))
    # as an argument of a function, the best one is found once for all its fields
    return F.get(F.transform(F.array(F.array_max(ranked)), lambda best: F.when(best.isNotNull(), F.struct(best["rank"].alias("rank"), best["lang"].alias("lang"), best["term"].alias("term")))), F.lit(0))


def triple(template: Column) -> Column:
    """struct<op, lang, term> of a template whose third argument is ``lang:term``, with
    anything from ``<`` on cut off; null if it is none."""
    target = F.trim(template["args"]["3"])
    lang, term = F.trim(F.substring_index(target, ":", 1)), F.trim(F.regexp_replace(F.regexp_replace(target, "^[^:]*:", ""), "<.*$", ""))
    return F.when((template["name"] == "ety") & F.contains(target, F.lit(":")) & (lang != "") & ~term.isin("", "-"), F.struct(F.trim(template["args"]["2"]).alias("op"), lang.alias("lang"), term.alias("term")))


def in_order(values: Column, most: int) -> Column:
    """The first ``most`` distinct values that are neither null nor blank."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))), 1, most)


def real_glosses(senses: Column, most: int) -> Column:
    """Glosses of the senses that are no form of another word."""
    own = F.filter(senses, lambda s: F.coalesce(F.size(s["form_of"]), F.lit(0)) <= 0)
    return in_order(F.flatten(F.transform(own, lambda s: F.coalesce(s["glosses"], F.array().cast("array<string>")))), most)


def descendants(tree: Column, depth: int) -> Column:
    """array<struct<lang, word>> of a tree of struct<lang, word, descendants> whose
    type is ``depth`` levels deep, parents before their children."""
    def down(nodes: Column, left: int) -> Column:
        one = lambda n: F.array(F.struct(n["lang"].alias("lang"), n["word"].alias("word")))
        if left == 1:
            return F.flatten(F.transform(nodes, one))
        empty = F.array().cast("array<struct<lang:string,word:string>>")
        return F.flatten(F.transform(nodes, lambda n: F.concat(one(n), F.coalesce(down(n["descendants"], left - 1), empty))))

    return F.filter(down(tree, depth), lambda d: F.coalesce(d["word"], F.lit("")) != "")


def tree_type(depth: int) -> str:
    """The type of a tree that many levels deep."""
    return "array<struct<lang:string,word:string" + (f",descendants:{tree_type(depth - 1)}" if depth > 1 else "") + ">>"
