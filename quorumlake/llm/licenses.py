"""Licence scan by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings), and the SHA-256 of the form is hash-joined with those of
known licence texts.  The join compares entire texts: of each document, of each
of its lines, since notices stand on lines of their own, and of its runs of
blocks between blank lines, as long as known texts are.  DataFrame functions
only.

Defined results: null and empty texts, and such as have only copyright lines,
have the empty form, which is no licence.  Repeated rows stay.  Several names
with one canonical form: the least name.  Texts of any length are read whole, line
by line; an empty table gives no rows; columns other than id and text are not read,
whatever their names.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LICENCES = 20_000

# Spellings that count as equal (from the matching guidelines of
# public licence lists), as (found, put in its place), after lower-casing.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("organisations", "organizations"), ("favour", "favor"), ("honour", "honor"), ("programme", "program"), ("programmes", "programs"), ("whilst", "while"), ("wilful", "willful"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("http", "https"),
]

# Notices and short licence texts with their names.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]


def full_texts() -> list[tuple[str, str]]:
    """Full licence texts with their names, and each without its title or a line
    of reserved rights."""
    out = []
    for path in sorted(Path(__file__).with_name("licence_texts").glob("*.txt")):
        text = path.read_text()
        out.append((path.stem, text))
        if path.stem == "MIT":
            out.append((path.stem, text.removeprefix("MIT License\n")))
        if path.stem.startswith("BSD"):
            out.append((path.stem, text.replace("All rights reserved.\n", "")))
    return out


#: Copyright lines, and those that no sentence wrapped before "copyright" makes.
NOTICE, STRICT_NOTICE = r"copyright|\(c\)|©", r"copyright[ \t]*(?:\(c\)|©|[0-9<\[])|\(c\)|©"


def respelt(text: Column) -> Column:
    """Whether a text holds a word, or the rarer one of several, that has another
    spelling; texts that do not, nearly all, need no replacements."""
    low = F.lower(F.coalesce(text, F.lit("")))
    marks = sorted({max(found.split(" "), key=lambda w: w != "copyright" and len(w)) for found, _ in SPELLINGS})
    least = [m for m in marks if not any(o != m and o in m for o in marks)]  # a word within others stands for them
    out = F.lit(False)
    for m in least:
        out = out | F.contains(low, F.lit(m))
    return out


def canonical(text: Column, notice: str = NOTICE, odd: Column | None = None) -> Column:
    """Canonical form: copyright lines go, A-Z are lower-cased, every run of
    ASCII characters other than letters and digits is one blank, and equivalent
    spellings become one (odd: whether the text has any; by default they are looked for).
    Other characters stay as they are."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?im)^[ \t]*({notice})[^\n]*$", "")
    t = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = F.regexp_replace(t, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ")
    one = _respelled(F.concat(F.lit(" "), t, F.lit(" ")), lambda x, a, b: F.replace(x, F.lit(a), F.lit(b)))
    return F.trim(one if odd is None else F.when(odd, one).otherwise(t))


def _respelled(t, replaced):
    """Equivalent spellings of whole words, each twice: words that follow each other
    share a blank."""
    for found, put in SPELLINGS:
        for _ in range(2):
            t = replaced(t, f" {found} ", f" {put} ")
    return t


def _blocks(text: Column, odd: Column | None = None) -> Column:
    """Canonical forms of the blocks between blank lines, without empty ones;
    sentences may be wrapped anywhere."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n(?:[ \t\r\f]*\n)+"), lambda x: canonical(x, STRICT_NOTICE, odd)), lambda x: x != "")


def _run_digests(blocks: Column, sizes: Column, n: int, lengths: list[int]) -> Column:
    """Digests of all n blocks that follow each other, joined, if they are as long as a
    known text of n blocks; sizes: the lengths of the blocks.  One run at a time is joined."""
    long = lambda i: F.aggregate(F.slice(sizes, i, n), F.lit(n - 1), lambda a, x: a + x).isin(lengths)
    starts = F.filter(F.sequence(F.lit(1), F.size(blocks) - (n - 1)), long)
    return F.when(F.size(blocks) >= n, F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(blocks, i, n), " "), 256))).otherwise(F.array().cast("array<string>"))


def licence_table(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, blocks, chars, licence) of known texts, by default KNOWN and the full texts."""
    rows = spark.createDataFrame(KNOWN + full_texts() if known is None else known, "licence string, text string")
    rows = rows.withColumn("split", _blocks(F.col("text"))).withColumn("form", F.explode(F.array(canonical(F.col("text")), F.array_join("split", " "))))
    return rows.where("form <> ''").groupBy(F.sha2("form", 256).alias("digest"), F.size("split").alias("blocks")).agg(F.min(F.length("form")).alias("chars"), F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, licences: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_digest, licence, line_licences): the licence whose entire text
    the document is, and the sorted names of those that one of its lines, or a run
    of its blocks, is.

    Units are digested where they lie; only distinct digests of units as long as a
    known text meet the licence table, once for each document and digest, and no text
    is shuffled.  What a row holds grows with its text and not with the lengths of runs.
    """
    lengths: dict[int, set[int]] = {}
    for r in licences.select("blocks", "chars").distinct().collect():  # as long as the list of licences
        lengths.setdefault(r["blocks"], set()).add(r["chars"])
    every = sorted(set().union(*lengths.values()))
    licences = licences.groupBy("digest").agg(F.min("licence").alias("licence"))
    if licences.count() <= BROADCAST_LICENCES:
        licences = F.broadcast(licences)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").alias("__text"), F.monotonically_increasing_id().alias("__row"))
    rows = rows.withColumn("__odd", respelt(F.col("__text")))
    form = canonical(F.col("__text"), odd=F.col("__odd"))
    lines = F.transform(F.split(F.coalesce("__text", F.lit("")), "\n"), lambda x: canonical(x, odd=F.col("__odd")))
    lines = F.transform(F.filter(lines, lambda x: (x != "") & F.length(x).isin(every)), lambda x: F.sha2(x, 256))
    none = F.array().cast("array<string>")
    split = rows.withColumn("__lines", F.array_distinct(lines)).withColumn("__blocks", F.when(F.contains("__text", F.lit("\n")), _blocks(F.col("__text"), F.col("__odd"))).otherwise(none))
    split = split.withColumn("__sizes", F.transform("__blocks", lambda x: F.length(x)))
    runs = [_run_digests(F.col("__blocks"), F.col("__sizes"), n, sorted(of)) for n, of in sorted(lengths.items())]
    units = split.select(id_col, "__row", F.sha2(form, 256).alias("text_digest"), F.array_distinct(F.concat("__lines", *runs)).alias("__units"))
    # one row a unit, with the document's own digest on the first
    each = units.select(id_col, "__row", "text_digest", F.posexplode(F.concat(F.array("text_digest"), "__units")).alias("__at", "digest"))
    hit = each.join(licences, "digest", "left").where("__at = 0 or licence is not null")
    return (hit.groupBy("__row").agg(F.min(id_col).alias(id_col), F.min("text_digest").alias("text_digest"),
                                     F.max(F.when(F.col("__at") == 0, F.col("licence"))).alias("licence"),
                                     F.array_join(F.array_sort(F.collect_set(F.when(F.col("__at") > 0, F.col("licence")))), ",").alias("line_licences"))
            .drop("__row"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"), licence_table(spark))


def _sql_form(text: str) -> str:
    t = f"regexp_replace(coalesce({text}, ''), '(?im)^[ \\t]*(copyright|\\(c\\)|©)[^\\n]*$', '', 'g')"
    t = f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    t = f"regexp_replace({t}, '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g')"
    return f"trim({_respelled(f"' ' || {t} || ' '", lambda x, a, b: f"replace({x}, '{a}', '{b}')")})"


SQL = f"""
with known(licence, text) as (values {", ".join("('" + a + "', '" + b + "')" for a, b in KNOWN)}),
licences as (select sha256({_sql_form("text")}) as digest, min(licence) as licence from known group by 1),
docs as (select doc_id, text, row_number() over () as r from documents),
whole as (select r, doc_id, sha256({_sql_form("text")}) as text_digest from docs),
lines as (select r, unnest(string_split(coalesce(text, ''), chr(10))) as line from docs),
hits as (select r, l.licence from lines join licences l on sha256({_sql_form("line")}) = l.digest where {_sql_form("line")} <> ''),
names as (select r, string_agg(distinct licence, ',' order by licence) as line_licences from hits group by r)
select w.doc_id, w.text_digest, l.licence, coalesce(n.line_licences, '') as line_licences
from whole w left join licences l on w.text_digest = l.digest left join names n on w.r = n.r
"""
