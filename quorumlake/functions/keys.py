"""Text keys, folds, predicates and tokenizers as Column builders.

Everything here is made of built-in functions, so it stays inside one generated
stage of the scan that it is used in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Flavoured letters and the standard ones that they fold to.
FLAVOURED = ("ćěęėǫȯųńŕśťďĺľůåăąõ", "čeeeoounrstdlluaaao")
# Letters with diacritics and their ASCII letters.
ACCENTED = ("čćçšśşžźżđďńňľĺłřŕťáàâāǎåéèêēěęíìîīóòôōȯǫúùûūůųýỳŷȳ",
            "cccssszzzddnnlllrrtaaaaaaeeeeeeiiiioooooouuuuuuyyyy")
# Letters that consonant keys drop.
VOWELS = "aeiouyj'ьъ"


def one_zero(c: Column, of: T.DataType) -> Column:
    """A value of type ``of`` with 0.0 for -0.0, which is equal to it but not as text."""
    if isinstance(of, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0.0).cast(of)).otherwise(c)
    if isinstance(of, T.ArrayType):
        return F.transform(c, lambda x: one_zero(x, of.elementType))
    if isinstance(of, T.MapType):
        return F.transform_values(c, lambda _, x: one_zero(x, of.valueType))
    if isinstance(of, T.StructType) and of.fields:
        return F.when(c.isNotNull(), F.struct(*[one_zero(c.getField(f.name), f.dataType).alias(f.name) for f in of.fields]))
    return c


def to_standard(s: Column) -> Column:
    """Diacritic fold to the standard alphabet: one letter for one by
    translation, one for two by replacement."""
    return F.replace(F.translate(s, *FLAVOURED), F.lit("đ"), F.lit("dž"))


def ascii_skeleton(s: Column) -> Column:
    """Lower-cased standard form without accents; other letters stay."""
    return F.translate(to_standard(F.lower(s)), *ACCENTED)


def consonant_key(s: Column) -> Column:
    """Skeleton with h→g and w→v, equal neighbouring consonants made one, then
    vowels dropped; in this order, so that a vowel between equals keeps both."""
    s = F.translate(ascii_skeleton(s), "hw", "gv")
    s = F.regexp_replace(s, rf"([^{VOWELS}])\1+", "$1")
    return F.regexp_replace(s, f"[{VOWELS}]", "")


def shares_consonant_root(a: Column, b: Column) -> Column:
    """Whether two consonant keys belong together: one is empty or begins with
    the other, or the first two consonants agree."""
    return (a == "") | (b == "") | a.startswith(b) | b.startswith(a) | (
        (F.length(a) >= 2) & (F.length(b) >= 2) & (F.substring(a, 1, 2) == F.substring(b, 1, 2)))


def exact_match(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def normalized_match(a: Column, b: Column) -> Column:
    return to_standard(F.lower(F.trim(a))) == to_standard(F.lower(F.trim(b)))


def skeleton_match(a: Column, b: Column) -> Column:
    return ascii_skeleton(F.trim(a)) == ascii_skeleton(F.trim(b))


def normalized_edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def fnv1a32(s: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-8 bytes."""
    h = F.hex(F.encode(s, "UTF-8"))
    n = (F.length(h) / 2).cast("int")
    step = lambda a, i: F.pmod(a.bitwiseXOR(F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long")) * F.lit(16777619), F.lit(4294967296))
    walk = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(2166136261).cast("long"), step)
    return F.when(n == 0, F.lit(2166136261).cast("long")).otherwise(walk)


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(fnv1a32(key), F.lit(shards)).cast("int")


def is_holdout(id_text: Column) -> Column:
    """Whether FNV-1a, 64 bits, of the id's text is divisible by four; only the
    last two bits of the hash are followed."""
    h = F.hex(F.encode(id_text, "UTF-8"))
    n = (F.length(h) / 2).cast("int")
    step = lambda a, i: F.pmod(a.bitwiseXOR(F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseAND(F.lit(3))) * 3, F.lit(4))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(1), step) == 0


def split_cell(cell: Column) -> Column:
    """array<struct<variant, flagged>> of a cell: bracketed spans go, ``, ; /``
    split, leading ``!`` flags, quotes, dots and blanks at the edges go, pieces
    without letters too."""
    s = cell
    for _ in range(4):  # nested brackets, innermost first
        s = F.regexp_replace(s, r"[(\[{][^()\[\]{}]*[)\]}]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)[(\[{].*$", ""), r"[)\]}]", "")
    piece = F.transform(F.split(s, r"[,;/]"), lambda p: F.struct(
        F.regexp_replace(F.regexp_replace(p, r"^[\s!]+", ""), r"""^[."'’ ]+|[."'’\s]+$""", "").alias("variant"), F.trim(p).startswith("!").alias("flagged")))
    return F.filter(piece, lambda p: p["variant"].rlike(r"\p{L}"))


def citation_forms(raw: Column) -> Column:
    """Distinct forms split at top-level commas, without parentheses; flagged and
    reconstructed ones go."""
    guarded = F.regexp_replace(raw, r",(?=[^()\[\]{}]*[)\]}])", "\u0001")
    parts = F.filter(F.transform(F.split(guarded, ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike("[#!]"))
    clean = F.transform(parts, lambda p: F.trim(F.split(F.replace(F.regexp_replace(p, r"\([^()]*\)", ""), F.lit("\u0001"), F.lit(",")), ",")[0]))
    return F.array_distinct(F.filter(clean, lambda p: (p != "") & ~p.rlike(r"[#!*()]")))


# Group codes of languages and their members; branch letters stand for a branch.
LANGUAGE_GROUPS = {"ub": ["be", "uk"], "cz": ["cs", "sk"], "sb": ["dsb", "hsb"], "bm": ["bg", "mk"], "yu": ["bs", "hr", "sl", "sr"], "sh": ["bs", "hr", "sr"],
                   "v": ["be", "ru", "uk"], "z": ["cs", "pl", "sk"], "j": ["bg", "hr", "mk", "sl", "sr"]}
LANGUAGES = ["be", "bg", "bs", "cs", "csb", "cu", "dsb", "hr", "hsb", "mk", "pl", "ru", "rue", "sk", "sl", "sr", "uk"]


def expand_groups(codes: Column, groups: dict[str, list[str]], known: list[str]) -> Column:
    """Sorted distinct members of blank-separated codes: group codes by their
    members, known codes as they are, marks at the edges and others go."""
    table = F.create_map(*[x for k in sorted({*groups, *known}) for x in (F.lit(k), F.array(*map(F.lit, groups.get(k, [k]))))])
    plain = F.transform(F.split(codes, r"\s+"), lambda c: F.regexp_replace(c, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    return F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(plain, lambda c: F.try_element_at(table, c)), lambda m: m.isNotNull()))))


def first_of(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that is found; order matters."""
    out = F.when(text.rlike(rules[0][0]), rules[0][1])
    for pattern, label in rules[1:]:
        out = out.when(text.rlike(pattern), label)
    return out.otherwise(default)


def percent_decoded(s: Column) -> Column:
    """Percent escapes decoded as UTF-8; incomplete escapes stay as they are, and a
    value whose bytes form no characters stays as it is, whole."""
    bad = "\ufffd"
    count = lambda text, what: (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)
    kept = F.regexp_replace(F.replace(s, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    out = F.try_url_decode(kept)
    # more replacement characters than were written, plainly or escaped, stand for bytes that form none
    broken = count(out, bad) > count(s, bad) + count(F.upper(s), "%EF%BF%BD")
    return F.when(out.isNull() | broken, s).otherwise(out)


def hygiene(s: Column, limit: int) -> Column:
    """Percent-decoding (``percent_decoded``), homoglyph fold, and a cut to so many characters."""
    return F.left(F.translate(percent_decoded(s), "’‘“”–— ", "''\"\"-- "), F.lit(limit))


def residue(s: Column, allowed: str) -> Column:
    """Characters outside an allowed set."""
    return F.regexp_replace(s, f"[{allowed}]", "")


TOKEN = r"\p{L}+(?:-\p{L}+)*"


def tokens(text: Column) -> Column:
    """Lower-cased words; a hyphen inside a word is kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)


def tokens_with_breaks(text: Column) -> Column:
    """array<struct<token, brk>>: brk if anything but white space stands between
    the word and that before it, and at the start."""
    t = F.lower(F.coalesce(text, F.lit("")))
    both = F.arrays_zip(F.regexp_extract_all(t, F.lit(rf"([^\p{{L}}]*)({TOKEN})"), 1).alias("gap"), F.regexp_extract_all(t, F.lit(rf"([^\p{{L}}]*)({TOKEN})"), 2).alias("token"))
    return F.transform(both, lambda x, i: F.struct(x["token"].alias("token"), ((i == 0) | x["gap"].rlike(r"\S")).alias("brk")))


def content_tokens(text: Column, stop: list[str], least: int = 3) -> Column:
    """Distinct words of at least so many bytes outside a stop list."""
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.octet_length(w) >= least) & ~w.isin(stop)))


def light_stem(w: Column) -> Column:
    """An English plural or participle ending goes from words that stay long enough."""
    return (F.when(w.endswith("ing") & (F.length(w) > 5), F.substr(w, F.lit(1), F.length(w) - 3))
            .when(w.endswith("ed") & (F.length(w) > 4), F.substr(w, F.lit(1), F.length(w) - 2))
            .when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def stemmed_set(text: Column, stop: list[str]) -> Column:
    """Distinct stemmed words outside brackets and a stop list, of two characters or more."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\([^()]*\)", " "))
    words = F.filter(F.split(bare, r"[^\p{L}]+"), lambda w: (w != "") & ~w.isin(stop))
    return F.array_distinct(F.filter(F.transform(words, light_stem), lambda w: F.length(w) >= 2))


def head_tokens(gloss: Column, stop: list[str]) -> Column:
    """Distinct synonyms before the first bracket of a gloss: split at ``, ; /`` and "or",
    without a leading "to"; phrases with "of", stop words and very long ones go."""
    head = F.substring_index(F.coalesce(gloss, F.lit("")), "(", 1)
    bare = F.transform(F.split(head, r"[,;/]| or "), lambda p: F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.trim(p), r"^\.+|\.+$", "")), r"^\s*to ", "")))
    return F.array_distinct(F.filter(bare, lambda t: F.length(t).between(2, 32) & ~t.endswith(" etc") & ~F.contains(t, F.lit(" of ")) & ~t.isin(stop)))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_skeleton(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def confidence_by_score(s: Column) -> Column:
    return F.when(s >= 0.72, "High").when(s >= 0.45, "Medium").otherwise("Low")


def confidence_by_probability(p: Column) -> Column:
    return F.when(p >= 0.6, "High").when(p >= 0.3, "Medium").otherwise("Low")


def pattern_of(branches: Column, order: list[tuple[str, str]]) -> Column:
    """Letters of the branches in canonical order, joined by +; null if none."""
    letters = F.filter(F.array(*[F.when(F.array_contains(branches, name), F.lit(letter)) for name, letter in order]), lambda x: x.isNotNull())
    return F.when(F.size(letters) > 0, F.array_join(letters, "+"))


def longest_suffix_strip(s: Column, suffixes: list[str], least: int = 4) -> Column:
    """Stem without the longest suffix that leaves enough characters."""
    out = None
    for x in sorted(suffixes, key=lambda x: (-len(x), x)):
        test = s.endswith(x) & (F.length(s) - len(x) >= least)
        stem = F.substr(s, F.lit(1), F.length(s) - len(x))
        out = F.when(test, stem) if out is None else out.when(test, stem)
    return out.otherwise(F.when(F.length(s) >= least, s))


def suffix_variants(s: Column, rules: list[tuple[str, str]], least: int = 3) -> Column:
    """Distinct forms with a suffix replaced, by each rule that fits."""
    made = [F.when(s.endswith(a) & (F.length(s) - len(a) + len(b) >= least), F.concat(F.substr(s, F.lit(1), F.length(s) - len(a)), F.lit(b))) for a, b in rules]
    return F.array_distinct(F.filter(F.array(*made), lambda x: x.isNotNull()))
