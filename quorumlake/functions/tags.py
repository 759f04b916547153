"""Grammatical tags, as dictionaries abbreviate them and as dumps spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spelt-out classes.
CLASSES = {
    "noun": "noun", "proper noun": "proper noun", "proper_noun": "proper noun", "name": "proper noun", "verb": "verb", "adj": "adjective", "adjective": "adjective", "adv": "adverb", "adverb": "adverb",
    "num": "numeral", "numeral": "numeral", "number": "numeral", "pron": "pronoun", "pronoun": "pronoun", "prep": "preposition", "preposition": "preposition", "postp": "preposition",
    "conj": "conjunction", "conjunction": "conjunction", "intj": "interjection", "interjection": "interjection", "particle": "particle", "prtcl": "particle", "prefix": "prefix",
    "suffix": "suffix", "affix": "suffix", "phrase": "phrase", "proverb": "phrase", "idiom": "phrase",
}
# Beginnings of abbreviated tags, in order.
BEGINNINGS = [(r"^v([. ]|$)", "verb"), ("^adj", "adjective"), ("^adv", "adverb"), ("^num", "numeral"), ("^pron", "pronoun"), ("^(prep|postp)", "preposition"), ("^conj", "conjunction"),
              ("^intj", "interjection"), ("^prefix", "prefix"), ("^suffix", "suffix"), ("^phrase", "phrase"), (r"^([mfn](\.|$)|m/)", "noun")]


def part_of_speech(raw: Column) -> Column:
    """Class of a tag: spelt out, else by its beginning, else ``other``."""
    s = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    begins = F.coalesce(*[F.when(s.rlike(pattern), label) for pattern, label in BEGINNINGS], F.lit("other"))
    return F.coalesce(F.try_element_at(known, s), begins)


def noun_traits(raw: Column) -> Column:
    """struct<gender, animate, plural_only, singular_only, indeclinable> of a noun's tag."""
    s = F.lower(F.coalesce(raw, F.lit("")))
    gender = F.when(s.rlike("^m([./ ]|$)"), "masculine").when(s.rlike(r"^f(\.|$)"), "feminine").when(s.rlike(r"^n(\.|$)"), "neuter")
    return F.struct(gender.alias("gender"), F.contains(s, F.lit("anim")).alias("animate"), s.rlike(r"\.pl|pl\.").alias("plural_only"), s.rlike(r"\.sg|sg\.").alias("singular_only"),
                    F.contains(s, F.lit("indecl")).alias("indeclinable"))


def verb_traits(raw: Column) -> Column:
    """struct<aspect, valency> of a verb's tag; a verb of both aspects has both."""
    s = F.lower(F.coalesce(raw, F.lit("")))
    aspects = F.filter(F.array(F.when(s.rlike(r"\bipf\b"), "ipf"), F.when(s.rlike(r"\bpf\b"), "pf")), lambda a: a.isNotNull())
    valency = F.when(s.rlike(r"\brefl\b"), "refl").when(s.rlike(r"\bintr\b"), "intr").when(s.rlike(r"\btr\b"), "tr")
    return F.struct(F.when(F.size(aspects) > 0, F.array_join(aspects, "/")).alias("aspect"), valency.alias("valency"))
