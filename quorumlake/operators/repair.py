"""Repair of pairs: cost-labelled options for the weaker member, the cheapest kept.

Of a pair of forms with scores (first, second, first_score, second_score) that do not
belong together, the weaker is made anew from the stronger by the rules of an
inventory.  Each option costs the normalised edit distance to the form that it
replaces, plus that form's score; the cheapest wins, then the rule's name, then its
place; a missing form counts as distance 1.  An inventory has a digest, so a report can refuse one that has drifted.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import keys as K
from quorumlake.operators import stats as S


@dataclass(frozen=True)
class Rule:
    """makes: the member that the rule makes ("first" from the second, or "second" from
    the first) by putting one ending in the place of another.  unless: endings that
    the source must not have.  level: the configurations that use it."""

    name: str
    makes: str
    ending: str
    put: str
    level: str = "core"
    unless: tuple[str, ...] = ()


@dataclass(frozen=True)
class Inventory:
    rules: tuple[Rule, ...]
    prefixes: tuple[str, ...] = ()
    exceptions: tuple[tuple[str, str], ...] = ()
    near: float = 0.45

    def digest(self) -> str:
        """SHA-256 of the inventory in its order."""
        lines = [f"{r.name}\t{r.makes}\t{r.ending}\t{r.put}\t{r.level}\t{','.join(r.unless)}" for r in self.rules]
        return hashlib.sha256("\n".join([*lines, *self.prefixes, *("\t".join(e) for e in self.exceptions), str(self.near)]).encode()).hexdigest()

    def guarded(self, digest: str) -> Inventory:
        if self.digest() != digest:
            raise ValueError(f"the rule inventory has drifted: {self.digest()} in place of {digest}")
        return self


# Endings, prefixes and irregular pairs of verbs whose aspects make a pair.
_LONG = ("yvati", "ivati", "avati", "ovati")
VERBS = Inventory(
    rules=(
        Rule("pf-nuti-to-ipf-ati", "first", "nųti", "ati"),
        Rule("pf-iti-to-ipf-jati", "first", "iti", "jati"),
        Rule("ovati-to-secondary-ovyvati", "first", "ovati", "ovyvati", "secondary"),
        Rule("secondary-ipf-yvati", "first", "ati", "yvati", "secondary"),
        Rule("secondary-ipf-ivati", "first", "ati", "ivati", "secondary"),
        Rule("secondary-ipf-avati", "first", "ati", "avati", "secondary"),
        Rule("ipf-jati-to-pf-iti", "second", "jati", "iti"),
        Rule("ipf-ati-to-pf-nuti", "second", "ati", "nųti", unless=_LONG),
        Rule("secondary-ovyvati-to-ovati", "second", "ovyvati", "ovati", "secondary"),
        Rule("secondary-ipf-yvati-reverse", "second", "yvati", "ati", "secondary"),
        Rule("secondary-ipf-ivati-reverse", "second", "ivati", "ati", "secondary"),
        Rule("secondary-ipf-avati-reverse", "second", "avati", "ati", "secondary"),
    ),
    prefixes=("prě", "råz", "pod", "nad", "pri", "pro", "iz", "na", "po", "do", "od", "ob", "za", "vy", "o", "s", "v", "u"),
    exceptions=(("idti", "pojdti"), ("jęti", "vzęti"), ("tykati", "tknųti"), ("pinati", "pnųti"), ("jesti", "sjesti")),
)

#: What each configuration of a ladder uses.
LADDER = {"independent": (), "endings": ("core",), "prefixes": ("core", "prefix"), "secondary": ("core", "prefix", "secondary")}


def _related(x: Column, y: Column) -> Column:
    return x.endswith(y) | y.endswith(x) | K.shares_consonant_root(x, y)


def belong(a: Column, b: Column) -> Column:
    """Whether the consonant keys of two forms are related."""
    return _related(K.consonant_key(a), K.consonant_key(b))


def _listed(rows: list[Column], kind: str) -> Column:
    return F.array(*rows) if rows else F.array().cast(f"array<struct<{kind}>>")


def _made(rules: list[tuple[int, Rule]], source: Column, key: Column, price) -> Column:
    """(cost, rule, place, form, level) of the forms that rules make of a form, if their
    keys are related to its own.  The rules are data, so the expression stays small however many they are."""
    listed = _listed([F.struct(F.lit(i).alias("place"), F.lit(r.name).alias("rule"), F.lit(r.level).alias("level"), F.lit(r.ending).alias("ending"), F.lit(r.put).alias("put"),
                               F.array(*map(F.lit, r.unless)).cast("array<string>").alias("unless")) for i, r in rules], "place:int,rule:string,level:string,ending:string,put:string,unless:array<string>")
    fits = F.filter(listed, lambda r: source.endswith(r["ending"]) & ~F.exists(r["unless"], lambda u: source.endswith(u)))
    forms = F.filter(F.transform(fits, lambda r: F.struct(r.alias("r"), F.concat(F.substr(source, F.lit(1), F.length(source) - F.length(r["ending"])), r["put"]).alias("form"))), lambda c: c["form"] != source)
    keyed = F.transform(forms, lambda c: F.struct(c["r"].alias("r"), c["form"].alias("form"), K.consonant_key(c["form"]).alias("key")))  # once for all tests of a key
    return F.transform(F.filter(keyed, lambda c: _related(c["key"], key)), lambda c: F.struct(price(c["form"]).alias("cost"), c["r"]["rule"].alias("rule"), c["r"]["place"].alias("place"), c["form"].alias("form"), c["r"]["level"].alias("level")))


def _with_options(pairs: DataFrame, inventory: Inventory, first: str, second: str, first_score: str, second_score: str) -> DataFrame:
    """``pairs`` with what all configurations choose from: __held (the first is the
    stronger), __odd, __agree, and the options by rules and by prefixes, which only
    pairs have that neither are irregular nor belong together."""
    a, b = F.col(first), F.col(second)
    plain = lambda c: K.to_standard(F.lower(F.trim(c)))
    keys = pairs.select("*", K.consonant_key(a).alias("__ka"), K.consonant_key(b).alias("__kb"), plain(a).alias("__na"), plain(b).alias("__nb"),
                        (F.coalesce(F.col(first_score), F.lit(0.0)) >= F.coalesce(F.col(second_score), F.lit(0.0))).alias("__held"))
    ka, kb, held = F.col("__ka"), F.col("__kb"), F.col("__held")
    irregular = F.lit(None).cast("struct<x:string,y:string>")
    for x, y in reversed(inventory.exceptions):
        irregular = F.when((F.col("__na") == plain(F.lit(x))) | (F.col("__nb") == plain(F.lit(y))), F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))).otherwise(irregular)
    judged = keys.select("*", irregular.alias("__odd"), F.coalesce(_related(ka, kb), F.lit(False)).alias("__agree"))
    price = lambda old, score: lambda form: F.round(F.coalesce(K.normalized_edit_distance(form, old), F.lit(1.0)) + F.greatest(F.coalesce(F.col(score), F.lit(0.0)), F.lit(0.0)), 6)
    of = lambda side: [(i, r) for i, r in enumerate(inventory.rules) if r.makes == side]
    ruled = F.when(held, _made(of("second"), a, ka, price(b, second_score))).otherwise(_made(of("first"), b, kb, price(a, first_score)))
    listed = _listed([F.struct(F.lit(p).alias("prefix"), F.lit(len(inventory.rules) + i).alias("place")) for i, p in enumerate(inventory.prefixes)], "prefix:string,place:int")
    begun = F.filter(listed, lambda p: b.startswith(p["prefix"]) & ~a.startswith(p["prefix"]))
    rest = F.filter(F.transform(begun, lambda p: F.struct(p.alias("p"), F.substr(b, F.length(p["prefix"]) + 1).alias("rest"))), lambda c: (c["rest"] != "") & (K.normalized_edit_distance(a, c["rest"]) <= inventory.near))
    form = lambda c: F.concat(c["p"]["prefix"], a)
    moved = F.transform(rest, lambda c: F.struct(price(b, second_score)(form(c)).alias("cost"), F.lit("prefix-perfectivization").alias("rule"), c["p"]["place"].alias("place"), form(c).alias("form"), F.lit("prefix").alias("level")))
    open_ = F.col("__odd").isNull() & ~F.col("__agree")
    return judged.select("*", F.when(open_, ruled).alias("__ruled"), F.when(open_ & held, moved).alias("__moved"))


def _repaired(options: DataFrame, use: Column, columns: list[str], first: str, second: str) -> DataFrame:
    """``columns``, and (fixed_first, fixed_second, rule) of rows ``_with_options`` under
    the configuration of levels ``use``."""
    a, b = F.col(first), F.col(second)
    fits = options.withColumn("__fits", F.filter("__ruled", lambda o: F.array_contains(use, o["level"])))
    # of equal forms the first rule's
    first_of = F.filter("__fits", lambda o: ~F.exists("__fits", lambda q: (q["form"] == o["form"]) & (q["place"] < o["place"])))
    moved = F.when(F.array_contains(use, "prefix"), F.col("__moved"))
    best = fits.withColumn("__best", F.least(F.array_min(first_of), F.array_min(moved)))
    choice = lambda x, y, rule: F.struct(x.alias("x"), y.alias("y"), rule.alias("rule"))
    plain = lambda rule: choice(a, b, F.lit(rule))
    made = F.col("__best.form")
    chosen = (F.when(F.size(use) == 0, plain("independent-baseline")).when(F.col("__odd").isNotNull(), choice(F.col("__odd.x"), F.col("__odd.y"), F.lit("closed-suppletive-pair")))
              .when(F.col("__agree"), plain("independent-roots-agree")).when(F.col("__best").isNull(), plain("unrepaired"))
              .when(F.col("__held"), choice(a, made, F.col("__best.rule"))).otherwise(choice(made, b, F.col("__best.rule"))))
    return best.select(*columns, chosen.alias("__c")).select(*columns, F.col("__c.x").alias("fixed_first"), F.col("__c.y").alias("fixed_second"), F.col("__c.rule").alias("rule"))


def _levels(use: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, use)).cast("array<string>")


def repair(pairs: DataFrame, inventory: Inventory, use: tuple[str, ...], first: str = "first", second: str = "second", first_score: str = "first_score", second_score: str = "second_score") -> DataFrame:
    """``pairs`` with the repaired forms in (fixed_first, fixed_second) and the rule that
    decided: an irregular pair, "independent-roots-agree", a rule of the inventory,
    "prefix-perfectivization", or "unrepaired".  Without ``use`` all are "independent-baseline"."""
    options = _with_options(pairs, inventory, first, second, first_score, second_score)
    return _repaired(options, _levels(use), pairs.columns, first, second)


def manifest_digest(pairs: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """(pairs, digest) of an inventory of pairs that does not depend on the order of
    rows: the sum of the rows' digests, so no list of pairs is gathered."""
    line = F.sha2(F.concat_ws("\t", F.col(group).cast("string"), F.col(left).cast("string"), F.col(right).cast("string")), 256)
    part = F.conv(F.left(line, F.lit(12)), 16, 10).cast("decimal(20,0)")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def score_ladder(pairs: DataFrame, inventory: Inventory, id_text: Column, gold_first: str, gold_second: str, ladder: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per pair and configuration: both_right, either_right, consistent, held_out, rule.

    ``pairs`` are read once: their options are made once for all configurations, each of which
    then takes the cheapest that it knows."""
    options = _with_options(pairs.select("*", K.is_holdout(id_text).alias("held_out")), inventory, "first", "second", "first_score", "second_score")
    steps = F.array(*[F.struct(F.lit(name).alias("config"), _levels(use).alias("use")) for name, use in (ladder or LADDER).items()])
    each = options.select("*", F.inline(steps).alias("config", "__use"))
    fixed = _repaired(each, F.col("__use"), [*pairs.columns, "held_out", "config"], "first", "second")
    x, y = K.normalized_match(F.col("fixed_first"), F.col(gold_first)), K.normalized_match(F.col("fixed_second"), F.col(gold_second))
    keyed = fixed.select("*", x.alias("__x"), y.alias("__y"), K.consonant_key(F.col("fixed_first")).alias("__kx"), K.consonant_key(F.col("fixed_second")).alias("__ky"))
    return keyed.select(*pairs.columns, "held_out", "rule", "config", F.expr("__x and __y").alias("both_right"), F.expr("__x or __y").alias("either_right"), _related(F.col("__kx"), F.col("__ky")).alias("consistent"), "fixed_first", "fixed_second")


def ladder_report(scored: DataFrame) -> DataFrame:
    """(config, split, n, both, either, consistent) over all, development and held-out pairs, in one pass."""
    split = F.explode(F.array(F.lit("all"), F.when(F.col("held_out"), "holdout").otherwise("dev")))
    return scored.select("config", "both_right", "either_right", "consistent", split.alias("split")).groupBy("config", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("both_right").alias("both"), F.count_if("either_right").alias("either"), F.count_if("consistent").alias("consistent"))


def ladder_significance(scored: DataFrame, pair: list[str], base: str, model: str) -> DataFrame:
    """(metric, fixed, broke, p): pairs that the model gets right and the base does not,
    and the reverse, with the exact two-sided sign test."""
    each = scored.where(F.col("config").isin(base, model)).groupBy(*pair).agg(*[F.bool_or(F.when(F.col("config") == c, F.col(m))).alias(f"{m}_{k}") for m in ("both_right", "either_right") for c, k in ((base, "b"), (model, "m"))])
    rows = [F.struct(F.lit(m).alias("metric"), F.count_if(F.col(f"{m}_m") & ~F.col(f"{m}_b")).alias("fixed"), F.count_if(F.col(f"{m}_b") & ~F.col(f"{m}_m")).alias("broke")) for m in ("both_right", "either_right")]
    sums = each.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return sums.select("metric", "fixed", "broke", F.round(S.sign_test(F.col("fixed"), F.col("broke")), 9).alias("p"))
